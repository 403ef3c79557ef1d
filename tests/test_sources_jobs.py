import pytest

from conftest import SF, tiny_rows
from faultline.config import RAW_COLUMNS, RunConfig
from faultline.jobs import score_job, train_job
from faultline.plans import catalog
from faultline.sources.columns import ensure_columns
from faultline.sources.csv_reports import read_reports_csv, write_reports

CSV = ('General.Eriref,General.Heading,extra,routed\r\n'
       'H1,"two\nlines, ""quoted""",NA,True\r\n'
       'H2,short\r\n'
       'H3,too,many,True,fields\r\n'
       'H4,caf\xe9,null,False\r\n')


def test_csv_keeps_quotes_newlines_and_short_rows(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_bytes(CSV.encode("latin-1"))
    got = write_reports(read_reports_csv(spark, str(path)), str(tmp_path / "out")).orderBy("ingest_pos").collect()
    assert [r.report_id for r in got] == ["H1", "H2", "H4"]
    assert got[0].heading == 'two\nlines, "quoted"' and got[0].extra is None and got[1].routed is None
    assert got[2].heading == "caf\xe9" and got[2].extra is None


def test_ensure_columns_adds_typed_nulls(spark):
    df = ensure_columns(spark.range(1), {"x": "double", "id": "string"})
    assert dict(df.dtypes) == {"id": "bigint", "x": "double"}


def test_config_round_trip():
    config = RunConfig(mode="balanced", min_samples=7)
    assert RunConfig.from_json(config.to_json()) == config
    assert RunConfig().section_budgets() == {"heading": 600, "effect": 1350, "config": 450, "cause": 600}


def test_jobs_train_and_score(spark, tmp_path):
    names = ["General.Eriref", "Faulty product.Design Responsible MHO", "General.Heading", "Observation.Observation", "Answer.Answer", "General.Submitter priority",
             "General.Superior MHO", "Observation.Fault type", "Registered"]
    assert set(names) <= set(RAW_COLUMNS)
    quote = lambda v: '"' + str(v).replace('"', '""') + '"'
    lines = [",".join(names)] + [",".join(quote(v) for v in row[1:10]) for row in tiny_rows()]
    path = tmp_path / "reports.csv"
    path.write_text("\n".join(lines), encoding="latin-1")
    train_job.run(spark, str(path), str(tmp_path / "model"), ["min_samples=1", "split_mode=temporal"])
    assert spark.read.parquet(str(tmp_path / "model" / "results")).count() == 5
    spark.createDataFrame([(f"n{i}", "Core dump crash after upgrade.") for i in range(4)], "report_id string, observation string").write.parquet(str(tmp_path / "new"))
    score_job.run(spark, score_job.parse_args(["--model", str(tmp_path / "model"), "--input", str(tmp_path / "new"), "--output", str(tmp_path / "scored")]))
    scored = spark.read.parquet(str(tmp_path / "scored")).collect()
    assert len(scored) == 4 and {r.routing for r in scored} <= {"auto", "human"}


def test_every_sql_text_belongs_to_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


@pytest.mark.parametrize("name", ["prepared_flags", "word_stats", "operating_points", "stratified_split"])
def test_result_does_not_depend_on_partitions(spark, name):
    fn = catalog.queries()[name]
    rows = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows.append(sorted(map(str, fn(spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert rows[0] == rows[1]


def test_surplus_fields_drop_a_row_even_when_empty(spark, tmp_path):
    from faultline.sources.csv_reports import read_reports_csv
    path = tmp_path / "odd.csv"
    path.write_text('General.Eriref,General.Heading,other\nH1,a,b\nH2,a,b,\nH3,a\nH4,"x\ny",b,,\nH5,"p\nq",b\nH6,a,b,c\n', encoding="ISO-8859-1")
    rows = {r["report_id"]: r["heading"] for r in read_reports_csv(spark, str(path)).collect()}
    assert rows == {"H1": "a", "H3": "a", "H5": "p\nq"}


def test_csv_is_cut_into_many_ranges(spark, tmp_path):
    """Ranges of 400 bytes: quotes and newlines across borders, fields longer than a range, stray quotes, several files."""
    import csv
    import random

    rng = random.Random(4)
    kinds = [lambda i: f"plain {i}", lambda i: 'say ""hi""' * rng.randrange(4), lambda i: "two\nlines, and\n\nmore", lambda i: "x" * rng.randrange(700),
             lambda i: "\n".join('"quoted", line' for _ in range(rng.randrange(60))), lambda i: 'inch 5"', lambda i: "", lambda i: '",\n"']
    folder = tmp_path / "in"
    folder.mkdir()
    want = []
    for name in ("a.csv", "b.csv", "c.csv"):
        rows = [(f"{name}{i}", kinds[rng.randrange(len(kinds))](i), str(i)) for i in range(40)]
        with open(folder / name, "w", newline="", encoding="ISO-8859-1") as f:
            f.write("General.Eriref,General.Heading,other\n")
            writer = csv.writer(f, lineterminator="\n")
            for n, r in enumerate(rows):
                f.write(f'{r[0]},5" pipe,{r[2]}\n') if n % 20 == 7 else writer.writerow(r)
        want += [(r[0], '5" pipe' if n % 20 == 7 else r[1] or None, r[2]) for n, r in enumerate(rows)]
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = read_reports_csv(spark, str(folder))
        many = df.orderBy("ingest_pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    one = read_reports_csv(spark, str(folder)).orderBy("ingest_pos").collect()
    assert len({r.ingest_pos >> 33 for r in many}) > 20 and len({r.ingest_pos >> 33 for r in one}) == 3
    for got in (many, one):
        assert [(r.report_id, r.heading, r.other) for r in got] == want
