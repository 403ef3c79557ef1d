"""Train / validation / test assignment as a column. The wide rows are never shuffled for it:
aggregates find the cut keys, then the assignment is a projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions.signals import parse_time
from .ranking import ACCURACY, hash_key, hash_rank_cuts

SPLITS = ("train", "val", "test")


def stratified_split(df: DataFrame, key: str = "report_id", target: str = "target", seed: int = 42,
                     train_share: float = 0.6, validation_share: float = 0.2) -> DataFrame:
    """Exact share of every class (rounded half up), in the order of a seeded hash of the key."""
    hashed = df.withColumn("_h", hash_key(key, seed=seed))
    n = F.count(F.lit(1))
    shares = [train_share, train_share + validation_share]
    ranks = F.array(*[F.struct(F.lit(i).alias("part"), F.floor(n * F.lit(s) + 0.5).alias("rank")) for i, s in enumerate(shares)])
    cuts = hashed.groupBy(target).agg(ranks.alias("_r")).select(target, F.inline("_r"))
    found = hash_rank_cuts(hashed.select(target, "_h"), [target], "_h", cuts)
    per_class = found.groupBy(target).agg(F.max(F.when(F.col("part") == 0, F.col("cut"))).alias("_c0"),
                                          F.max(F.when(F.col("part") == 1, F.col("cut"))).alias("_c1"))
    split = (F.when(F.col("_h") <= F.col("_c0"), "train").when(F.col("_h") <= F.col("_c1"), "val").otherwise("test"))
    return hashed.join(per_class, target, "left").select(*df.columns, split.alias("split"))


def temporal_split(df: DataFrame, key: str = "report_id", time: str = "registered", seed: int = 42,
                   train_share: float = 0.6, validation_share: float = 0.2) -> DataFrame:
    """First rows by time to train, then validation, then test; rows without a date come last, rows
    of one instant are ordered by a seeded hash of the key."""
    # micros since epoch; the cast goes through the session zone on both ends, order is kept
    micros = F.unix_micros(parse_time(time).cast("timestamp"))
    keyed = df.withColumns({"_t": F.coalesce(micros, F.lit(2**62)), "_h": hash_key(key, seed=seed)})
    narrow = keyed.select("_t", "_h")
    shares = [train_share, train_share + validation_share]
    margin = 3.0 / ACCURACY
    near = narrow.agg(F.count(F.lit(1)).alias("n"),
                      F.percentile_approx("_t", [max(s - margin, 0.0) for s in shares], ACCURACY).alias("lo"),
                      F.percentile_approx("_t", [min(s + margin, 1.0) for s in shares], ACCURACY).alias("hi")).first()
    if not near.n:
        return df.withColumn("split", F.lit("train"))
    # the small epsilon keeps int(n * share) at the value of exact arithmetic
    ranks = [int(near.n * s + 1e-9) for s in shares]
    if near.n <= ACCURACY:                                   # the sketch is exact, but one rank off matters here
        near_lo, near_hi = [-(2**62)] * 2, [2**62] * 2
    else:
        near_lo, near_hi = near.lo, near.hi
    cut_rows = []
    for part, rank in enumerate(ranks):
        at = (narrow.filter(F.col("_t") <= near_hi[part])
              .groupBy(F.when(F.col("_t") >= near_lo[part], F.col("_t")).alias("_t")).agg(F.count(F.lit(1)).alias("_n")))
        upto = F.sum("_n").over(Window.orderBy(F.col("_t").asc_nulls_first()))   # only instants inside the bracket
        hit = (at.withColumn("_upto", upto).filter((F.col("_upto") >= rank) & F.col("_t").isNotNull())
               .orderBy("_upto").limit(1).first()) if rank > 0 else None
        cut_rows.append((hit["_t"], rank - (hit["_upto"] - hit["_n"])) if hit else None)
    spark = df.sparkSession
    wanted = [(c[0], i, c[1]) for i, c in enumerate(cut_rows) if c]
    cuts = spark.createDataFrame(wanted, "_t long, part int, rank long")
    ties = narrow.filter(F.col("_t").isin([c[0] for c in wanted])) if wanted else narrow.limit(0)
    found = {r["part"]: (r["_t"], r["cut"]) for r in hash_rank_cuts(ties, ["_t"], "_h", cuts).collect()}   # two rows

    def upto(part):
        if part not in found:
            return F.lit(False)
        t, h = found[part]
        return (F.col("_t") < t) | ((F.col("_t") == t) & (F.col("_h") <= h))

    return keyed.select(*df.columns, F.when(upto(0), "train").when(upto(1), "val").otherwise("test").alias("split"))


def split_reports(df: DataFrame, config: RunConfig = RunConfig()) -> DataFrame:
    shares = dict(seed=config.seed, train_share=config.train_share, validation_share=config.validation_share)
    if config.split_mode == "random_stratified":
        return stratified_split(df, **shares)
    if config.split_mode == "temporal":
        return temporal_split(df, **shares)
    raise ValueError(f"unknown split mode {config.split_mode!r}")


def split_contract(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, split, value): non-null values of val or test that train lacks. Empty = contract kept.

    Values are made distinct per split map-side, then one flag per value decides: no join at all."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    values = df.select("split", F.inline(pairs)).filter(F.col("value").isNotNull())
    where = values.groupBy("field", "value").agg(
        *[F.max((F.col("split") == s).cast("int")).alias(s) for s in SPLITS])
    present = F.filter(F.array(*[F.when(F.col(s) == 1, F.lit(s)) for s in SPLITS[1:]]), lambda s: s.isNotNull())
    return where.filter("train = 0").select("field", F.explode(present).alias("split"), "value")
