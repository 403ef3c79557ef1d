"""Preference formatting with DataFrame operations only.

Chosen and rejected conversations of a pair are compared as ordered sets of turns (turn, role, text). Their longest common
prefix ends before the least turn that only one of them has, so the cut is one minimum per pair, combined in the tasks: no
conversation is gathered to find it. Turns before the cut are rendered once as prompt; the rest of each side is its completion.
In a completion only assistant turns are trained, from behind their header to their end mark; the prompt is never trained.

Rendered turns are joined into rows of BLOCK turns each, in their order, whatever their turn numbers: the rank of a turn in its pair
is a sum of counts over ranges of the order. So a row holds at most BLOCK turns, and a pair's blocks in order, joined, are its whole
text. Spans count code points inside the row's own string.

Defined cases: null role counts as `user`, null text as empty, a null turn comes first (with the least long); rows without pair are dropped by no one
and form a pair of their own; a turn given twice counts once, different turns of one number follow each other by role and text; a
pair with one side only has an empty prompt and an empty other side; equal sides are all prompt with empty completions; extra
columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .common import read

OPEN, CLOSE, BLOCK = "<|im_start|>", "<|im_end|>\n", 64
#: Where a turn without number stands: before all others.
FIRST = -(1 << 63)


def _turns(turns: DataFrame) -> DataFrame:
    return turns.select("pair", F.coalesce("turn", F.lit(FIRST).cast("long")).alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _with_blocks(merged: DataFrame) -> DataFrame:
    """The distinct turns with the block of their rank in the pair. Ranks are counts over ranges of the order: no task needs a whole pair."""
    return scan.ranked(merged, ["pair"], ["turn", "role", "text"]).withColumn("block", F.floor(F.col("rank") / BLOCK)).drop("rank", "group_rows")


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """chosen, rejected: (pair, turn, role, text). Returns (pair, block, prompt, chosen, rejected, chosen_spans, rejected_spans),
    spans as start:end of the trained parts, comma-joined."""
    sides = _turns(chosen).withColumn("side", F.lit(1)).union(_turns(rejected).withColumn("side", F.lit(2)))
    # One row per distinct turn of a pair: 1 chosen only, 2 rejected only, 3 both.
    merged = sides.groupBy("pair", "turn", "role", "text").agg(F.bit_or("side").alias("sides"))
    cuts = merged.filter("sides <> 3").groupBy("pair").agg(F.min(F.struct("turn", "role", "text")).alias("cut")).withColumnRenamed("pair", "cut_pair")
    head = F.concat(F.lit(OPEN), F.col("role"), F.lit("\n"))
    parts = _with_blocks(merged).join(cuts, F.col("pair").eqNullSafe(F.col("cut_pair")), "left").select(
        "pair", "block", "turn", "role", "text", "sides", (F.col("cut").isNull() | (F.struct("turn", "role", "text") < F.col("cut"))).alias("shared"),
        F.concat(head, F.col("text"), F.lit(CLOSE)).alias("rendered"), F.length(head).alias("head"))

    def side(bit: int):
        own = ~F.col("shared") & (F.col("sides").bitwiseAND(bit) == bit)
        return F.sort_array(F.collect_list(F.when(own, F.struct("turn", "role", "text", "rendered", "head"))))

    prompt = F.sort_array(F.collect_list(F.when(F.col("shared"), F.struct("turn", "role", "text", "rendered", "head"))))
    blocks = parts.groupBy("pair", "block").agg(prompt.alias("p"), side(1).alias("c"), side(2).alias("r"))

    def text(name: str):
        return F.array_join(F.transform(name, lambda t: t["rendered"]), "")

    def spans(name: str):
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("found"))

        def step(state, turn):
            end = state["at"] + F.length(turn["rendered"])
            span = F.concat_ws(":", state["at"] + turn["head"], end)
            return F.struct(end.alias("at"), F.when(turn["role"] == "assistant", F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"))

        return F.array_join(F.aggregate(name, start, step)["found"], ",")

    return blocks.select("pair", "block", text("p").alias("prompt"), text("c").alias("chosen"), text("r").alias("rejected"), spans("c").alias("chosen_spans"), spans("r").alias("rejected_spans"))


def answer_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Preference pairs from plain conversations: a conversation of even id is chosen; its rejected form keeps all but its last
    turn and goes on with the next conversation from that turn number on, or with that conversation's last turn if it is shorter."""
    turns = conversations.select(F.floor(F.col("conv_id") / 2).alias("pair"), (F.pmod("conv_id", F.lit(2)) == 0).alias("even"), F.coalesce(F.col("turn").cast("long"), F.lit(FIRST).cast("long")).alias("turn"), "role", "text")
    ends = turns.groupBy("pair").agg(F.max(F.when(F.col("even"), F.col("turn"))).alias("last"), F.max(F.when(~F.col("even"), F.col("turn"))).alias("other_last")).withColumnRenamed("pair", "end_pair")
    known = turns.join(ends, F.col("pair").eqNullSafe(F.col("end_pair")))
    chosen = known.filter(F.coalesce("even", F.lit(True)))
    rejected = known.filter(F.coalesce(F.when(F.col("even"), F.col("turn") < F.col("last")).otherwise(F.col("turn") >= F.least("last", "other_last")), F.lit(False)))
    return tuple(side.select("pair", "turn", "role", "text") for side in (chosen, rejected))


def preferences(spark, sf_dir: str) -> DataFrame:
    return format_pairs(*answer_pairs(read(spark, sf_dir, "conversations"))).withColumnRenamed("pair", "pair_id")


SQL = f"""WITH t AS (SELECT conv_id // 2 AS pair, conv_id % 2 = 0 AS even, coalesce(turn, (-9223372036854775808)::BIGINT) AS turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations),
    e AS (SELECT pair, max(turn) FILTER (WHERE even) AS last, max(turn) FILTER (WHERE NOT even) AS other FROM t GROUP BY pair),
    s AS (SELECT DISTINCT pair, 1 AS side, turn, role, text FROM t WHERE coalesce(even, true) UNION ALL
          SELECT DISTINCT pair, 2, turn, role, text FROM t JOIN e USING (pair) WHERE CASE WHEN even THEN turn < last ELSE turn >= least(last, other) END),
    m AS (SELECT pair, turn, role, text, sum(side) AS sides FROM s GROUP BY ALL),
    c AS (SELECT *, first_value(CASE WHEN sides <> 3 THEN n END IGNORE NULLS) OVER (PARTITION BY pair ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS cut
          FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY turn, role, text) AS n FROM m)),
    p AS (SELECT pair, (n - 1) // {BLOCK} AS block, n, role, '{OPEN}' || role || chr(10) || text || '<|im_end|>' || chr(10) AS x, length('{OPEN}' || role) + 1 AS head,
          CASE WHEN cut IS NULL OR n < cut THEN 0 ELSE sides END AS side FROM c),
    d AS (SELECT pair, block, n, role, x, head, unnest(CASE side WHEN 0 THEN [0] WHEN 3 THEN [1, 2] ELSE [side] END) AS side FROM p),
    o AS (SELECT *, sum(length(x)) OVER (PARTITION BY pair, block, side ORDER BY n) AS stop FROM d),
    g AS (SELECT pair AS pair_id, block, coalesce(string_agg(x, '' ORDER BY n) FILTER (WHERE side = 0), '') AS prompt, coalesce(string_agg(x, '' ORDER BY n) FILTER (WHERE side = 1), '') AS chosen,
          coalesce(string_agg(x, '' ORDER BY n) FILTER (WHERE side = 2), '') AS rejected,
          coalesce(string_agg((stop - length(x) + head) || ':' || stop, ',' ORDER BY n) FILTER (WHERE side = 1 AND role = 'assistant'), '') AS chosen_spans,
          coalesce(string_agg((stop - length(x) + head) || ':' || stop, ',' ORDER BY n) FILTER (WHERE side = 2 AND role = 'assistant'), '') AS rejected_spans FROM o GROUP BY pair, block)
    FROM g"""
