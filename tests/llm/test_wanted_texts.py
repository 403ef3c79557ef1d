"""Near-dedup sends only the texts that it compares."""

from pyspark.sql import functions as F

from faultline.llm import near_dedup


def test_the_bitmap_keeps_every_wanted_row_and_few_others(spark):
    docs = spark.range(20_000).select(F.when(F.col("id") % 1000 != 7, F.col("id")).alias("doc_id"), F.xxhash64("id").alias("th"), F.concat(F.lit("text "), "id").alias("text"))
    wanted = docs.filter("doc_id is null or doc_id % 20 = 0").select(F.monotonically_increasing_id().alias("id"), F.col("doc_id").alias("d"), F.col("th").alias("t"))
    kept = near_dedup._likely(docs, wanted)
    assert kept.columns == docs.columns
    same = kept["doc_id"].eqNullSafe(wanted["d"]) & (kept["th"] == wanted["t"])
    n = wanted.count()
    assert kept.join(wanted, same).count() == n and n <= kept.count() < 3 * n
    assert near_dedup._likely(docs, wanted.limit(0)).count() == 0


def test_sets_are_made_of_wanted_texts_alone(spark, monkeypatch):
    near_dedup.prepare(spark)
    docs = spark.range(4_000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("th"), F.concat_ws(" ", F.lit("some words of"), F.col("id"), F.lit("and more")).alias("text"))
    docs = docs.unionByName(docs.filter("doc_id < 50"))                        # a repeated row still gives one set
    classes = docs.dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("id"), "doc_id", "th")
    sent, likely = [], near_dedup._likely
    monkeypatch.setattr(near_dedup, "_likely", lambda *a: sent.append(likely(*a)) or sent[-1])
    sets = near_dedup._sets(docs, classes, spark.range(0, 4_000, 40))
    assert sorted(r.id for r in sets.collect()) == list(range(0, 4_000, 40))
    assert sent[0].count() < 1_000
    assert all(r.shingles == near_dedup.shingle_set(f"some words of {r.id} and more".encode()).tobytes() for r in sets.collect())


def test_groups_that_share_members_become_one_while_small(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "MERGED", 5)
    groups = [[1, 2], [2, 3], [1, 3, 4], [10, 11], [20, 21, 22], [22, 23, 24], [24, 25]]
    rows = spark.createDataFrame([(g, i) for i, g in enumerate(groups)], "members array<long>, group long")
    classes = spark.range(30).select("id", F.lit(10).cast("long").alias("n_shingles"))
    found = sorted(r.members for r in near_dedup._merged(rows, classes).collect())
    assert found == [[1, 2, 3, 4], [10, 11], [20, 21, 22], [22, 23, 24], [24, 25]]
    assert near_dedup._merged(rows.limit(0), classes).count() == 0


def test_groups_are_compared_from_texts_and_hashes_are_not_sent(spark, monkeypatch):
    near_dedup.prepare(spark)
    same = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, same), (2, f"{same} end"), (3, "quite another text of seven words"), (4, None), (None, f"END {same}")], "doc_id long, text string")
    seen, link = [], near_dedup._group_links
    monkeypatch.setattr(near_dedup, "_group_links", lambda groups, texts: seen.append(texts.columns) or link(groups, texts))
    monkeypatch.setattr(near_dedup, "_sets", lambda *a: seen.append("sets"))   # no node is large here
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4, None: 1} and seen == [["id", "text"]]
