"""SMOTE: synthetic rows of minority classes between a row and one of its nearest class neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .ranking import hash_key, hash_ranks
from .similarity import topk_nearest

CHUNK = 1000


def smote(df: DataFrame, key: str, vector: str, label: str, k: int = 5, seed: int = 42, max_features: int | None = None) -> DataFrame:
    """(key, vector, label, synthetic_no, neighbour_id, share) with as many synthetic rows per class as
    it lacks to the largest class. A class of one row has no neighbour and gets none.

    Every row of a class gets an even number of synthetic rows, the first ones by hash rank one more;
    neighbour and share come from a seeded hash. Rows are spread in chunks before they multiply. Vectors are of any width;
    a caller that wants a limit can set `max_features`, which looks at all rows."""
    if max_features is not None and (width := df.agg(F.max(F.size(vector))).first()[0] or 0) > max_features:
        raise MemoryError(f"{width} features exceed the limit of {max_features}")
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    need = counts.withColumn("_need", counts.agg(F.max("_n")).scalar() - F.col("_n"))
    hashed = hash_ranks(df.select(key, label, vector).withColumn("_h", hash_key(key, seed=seed)), "_h", [label], "_rank")
    share = F.floor(F.col("_need") / F.col("_n")) + F.when(F.col("_rank") <= F.col("_need") % F.col("_n"), 1).otherwise(0)
    bases = hashed.join(need, label).withColumn("_copies", share.cast("long")).filter("_copies > 0")
    numbered = checkpoint(counts.select(label).withColumn("_group", (F.row_number().over(Window.orderBy(label)) - 1)))     # one row per class
    neighbours = topk_nearest(df.join(numbered, label), k, key, vector, "_group")
    listed = (neighbours.join(df.select(F.col(key).alias("match_id"), F.col(vector).alias("_other")), "match_id")
              .groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "match_id", "_other"))).alias("_near")))       # at most k
    chunks = (bases.join(listed, key)
              .select(key, label, vector, "_near", "_copies", F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / CHUNK))).alias("_chunk"))
              .repartition(key, "_chunk"))
    first = F.col("_chunk") * CHUNK + 1
    rows = chunks.withColumn("synthetic_no", F.explode(F.sequence(first, F.least(first + CHUNK - 1, F.col("_copies")))))
    draw = lambda what: hash_key(F.col(key), F.col("synthetic_no"), F.lit(what), seed=seed)
    picked = F.element_at("_near", (F.pmod(draw("neighbour"), F.size("_near")) + 1).cast("int"))
    rows = rows.withColumn("_pick", picked).withColumn("share", draw("share") / F.lit(float(2**60)))
    mixed = F.zip_with(vector, F.col("_pick._other"), lambda a, b: a + F.col("share") * (b - a))
    return rows.select(key, label, "synthetic_no", F.col("_pick.match_id").alias("neighbour_id"), "share", mixed.alias(vector))
