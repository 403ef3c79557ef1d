"""Exact ranks, quantiles and running sums without a one-task global sort.

Three facts keep every task bounded:
* hash keys are uniform, so fixed hash buckets are equal in size;
* equal values collapse to one row in a map-side count, so ties cannot make a group hot;
* `percentile_approx` brackets a quantile to a known rank error, so only a sliver of rows is ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_BITS = 60
BUCKET_BITS = 12
ACCURACY = 10000


def hash_key(*cols, seed=None) -> Column:
    """Uniform 60-bit key: the first 15 hex digits of md5, so that plain SQL can replay it."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    if seed is not None:
        parts.append(F.lit(str(seed)))
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def hash_rank_cuts(df: DataFrame, groups: list[str], key: str, cuts: DataFrame) -> DataFrame:
    """Key of the row at given ranks within each group, ordered by a uniform hash key.

    `cuts` holds (groups..., part, rank); the result holds (groups..., part, cut): the rows with
    key <= cut are the first `rank` rows of the group. A rank below 1 has no row in the result."""
    bucket = F.shiftright(key, HASH_BITS - BUCKET_BITS)
    narrow = df.select(*groups, key, bucket.alias("_bucket"))
    counts = narrow.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*groups).orderBy("_bucket"))
    counts = counts.withColumn("_upto", upto)
    located = (counts.join(cuts, groups)
               .filter((F.col("rank") <= F.col("_upto")) & (F.col("rank") > F.col("_upto") - F.col("_n")))
               .select(*groups, "_bucket", "part", (F.col("rank") - F.col("_upto") + F.col("_n")).alias("_need")))
    order = Window.partitionBy(*groups, "_bucket", "part").orderBy(key)
    return (narrow.join(located, [*groups, "_bucket"])
            .withColumn("_rn", F.row_number().over(order)).filter("_rn = _need")
            .select(*groups, "part", F.col(key).alias("cut")))


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """(field, prob, value): linearly interpolated quantiles of each column's non-null values.

    Pass 1 brackets each quantile with approximate percentiles; pass 2 counts what lies below the
    bracket and ranks only the distinct values inside it."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(F.inline(pairs)).filter(F.col("value").isNotNull())
    margin = 3.0 / ACCURACY
    lows = [max(p - margin, 0.0) for p in probs]
    highs = [min(p + margin, 1.0) for p in probs]
    small = F.col("_n") <= ACCURACY        # below that a rank or two can exceed the margin: take all
    brackets = (long.groupBy("field")
                .agg(F.count(F.lit(1)).alias("_n"),
                     F.percentile_approx("value", lows, ACCURACY).alias("_lo"),
                     F.percentile_approx("value", highs, ACCURACY).alias("_hi"),
                     F.min("value").alias("_min"), F.max("value").alias("_max"))
                .select("field", "_n", "_min", "_max", F.posexplode(
                    F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("prob"), "_lo", "_hi")).alias("_i", "_b"))
                .select("field", "_n", F.col("_b.prob").alias("prob"),
                        F.when(small | (F.col("_b.prob") <= margin), F.col("_min")).otherwise(F.col("_b._lo")).alias("_lo"),
                        F.when(small | (F.col("_b.prob") >= 1 - margin), F.col("_max")).otherwise(F.col("_b._hi")).alias("_hi"),
                        ((F.col("_n") - 1) * F.col("_b.prob")).alias("_h")))
    per_field = brackets.groupBy("field").agg(F.collect_list(F.struct("prob", "_lo", "_hi", "_h", "_n")).alias("_q"))
    # one row per (value, quantile) that is not above the bracket; everything below it shares one key
    hits = (long.join(F.broadcast(per_field), "field")     # one row per column
            .select("field", "value", F.explode(F.filter("_q", lambda q: F.col("value") <= q["_hi"])).alias("_q"))
            .groupBy("field", F.col("_q.prob").alias("prob"), F.col("_q._h").alias("_h"), F.col("_q._n").alias("_n"),
                     F.when(F.col("value") >= F.col("_q._lo"), F.col("value")).alias("_v"))
            .agg(F.count(F.lit(1)).alias("_c")))
    order = Window.partitionBy("field", "prob").orderBy(F.col("_v").asc_nulls_first())
    ranked = hits.withColumn("_upto", F.sum("_c").over(order))
    inside = lambda rank: (F.col("_v").isNotNull() & (rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_c")))
    lower, upper = F.floor("_h"), F.least(F.floor("_h") + 1, F.col("_n") - 1)
    at = (ranked.groupBy("field", "prob")
          .agg(F.max(F.when(inside(lower), F.col("_v"))).alias("_a"), F.max(F.when(inside(upper), F.col("_v"))).alias("_b"),
               F.max(F.col("_h") - lower).alias("_w")))
    value = F.col("_a") + F.when(F.col("_w") > 0, (F.col("_b") - F.col("_a")) * F.col("_w")).otherwise(0.0)
    return at.select("field", "prob", value.alias("value"))


def running_sums(df: DataFrame, key: str, sums: dict[str, str], bounds: int = 256) -> DataFrame:
    """Running sums over distinct `key` values in descending order, `sums` = {output: input column}.

    The keys must be distinct: then quantile bounds cut them into even ranges, each range is summed
    by its own task, and only `bounds` range totals meet in one place."""
    probs = [i / bounds for i in range(1, bounds)]
    found = df.agg(F.percentile_approx(key, probs, ACCURACY)).first()[0] or []
    splits = sorted({float("-inf"), *found})
    # a range per bound at or below the key; -inf, as callers give a missing key, is the lowest of all
    ranged = df.withColumn("_range", F.size(F.filter(F.array(*[F.lit(float(s)) for s in splits]), lambda s: s <= F.col(key))))
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    before = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_t_{o}") for o in sums])
    within = Window.partitionBy("_range").orderBy(F.desc(key))
    return (ranged.withColumns({o: F.sum(c).over(within) for o, c in sums.items()})
            .join(F.broadcast(offsets), "_range")          # at most `bounds` rows
            .withColumns({o: F.col(o) + F.col(f"_t_{o}") for o in sums})
            .drop("_range", *[f"_t_{o}" for o in sums]))


def hash_ranks(df: DataFrame, key: str, groups: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Exact 1-based rank of every row in hash order (per group): a row number inside a small hash
    bucket plus the bucket's offset."""
    groups = groups or []
    bucketed = df.withColumn("_bucket", F.shiftright(key, HASH_BITS - BUCKET_BITS))
    counts = bucketed.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*groups, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*groups, "_bucket").orderBy(key)
    return (bucketed.withColumn("_rn", F.row_number().over(within)).join(offsets, [*groups, "_bucket"])
            .withColumn(name, F.col("_rn") + F.col("_offset")).drop("_bucket", "_rn", "_offset"))
