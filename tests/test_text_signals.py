import math
import re

from pyspark.sql import functions as F

from conftest import TEXT_A, TEXT_B
from faultline.functions import signals as S
from faultline.functions import text as X


def values(spark, rows, expr, schema="t string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).coalesce(1).select(expr).collect()]


def test_clean_text(spark):
    got = values(spark, [None, "", "UE traffic stops after HO 123!", "a b\tC"], X.clean_text("t"))
    assert got == ["", "", "ue traffic stops after ho", "a b c"]
    assert values(spark, ["BB6630, 21.Q3"], X.clean_alphanum("t")) == ["bb6630 21.q3"]


def test_sections_equal_python_re(spark):
    texts = [TEXT_A, TEXT_B, "no layout", "1 EFFECT\n===\nshort rule\n", None, "", "x\r\n1 effect\n====\ny\n\n 2 TROUBLE\n===\nz"]
    got = values(spark, texts, X.sections("t"))
    for text, row in zip(texts, got):
        for name, pattern in X.SECTION_PATTERNS.items():
            m = re.search(pattern, text or "", re.DOTALL | re.IGNORECASE)
            assert row[name] == (m.group(1).strip() if m else ""), (text, name)
    assert got[0].effect == "Cell disabled alarm and traffic stopped." and got[1].config == "AIR6449 22.Q1"


def test_effect_and_cause_fall_back_to_full_text(spark):
    assert values(spark, [TEXT_A, "1 EFFECT\n===\nx\n2 TROUBLE", None], X.effect_or_full("t")) == [
        "Cell disabled alarm and traffic stopped.", "1 EFFECT\n===\nx\n2 TROUBLE", ""]
    assert values(spark, ["CAUSE OF FAULT\n----------\nsw\n----------", "plain"], X.cause_of_fault("t")) == ["sw", "plain"]


def test_combined_text_keeps_separator_as_word(spark):
    df = spark.createDataFrame([("Head 1", TEXT_A, None)], "h string, o string, a string")
    assert df.select(X.combined_text("h", "o", "a")).first()[0] == "head sep cell disabled alarm and traffic stopped sep"
    assert df.select(X.combined_text("h", "o")).first()[0] == "head sep cell disabled alarm and traffic stopped"


def test_word_count(spark):
    assert values(spark, [None, "", "  ", "one", " a  b c\n"], X.word_count("t")) == [0, 0, 0, 1, 3]


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), ([],), (["x"],)], "w array<string>")
    assert [r[0] for r in df.select(X.with_ngrams("w", 2)).collect()] == [["a", "b", "c", "a b", "b c"], [], ["x"]]


def test_fixture_signals(spark, tiny):
    a, b = tiny.select(*S.signals()).collect()[0], tiny.select(*S.signals()).collect()[8]
    flags = ["flag_crash", "flag_alarm", "flag_cell_disabled", "flag_restart", "flag_upgrade", "flag_race_cond", "flag_log_traces", "flag_coli_output"]
    assert [a[f] for f in flags] == [0, 1, 1, 1, 0, 0, 0, 0]
    assert [b[f] for f in flags] == [1, 0, 0, 0, 1, 0, 0, 0]
    assert (a.board_type, a.sw_release, b.board_type, b.sw_release) == ("BB6630", "21.Q3", "AIR6449", "22.Q1")
    assert (a.hour_of_day, a.day_of_week, a.reg_quarter, a.reg_year) == (1, 6, 1, 2023)
    assert math.isclose(a.log_routing_time, math.log(2)) and math.isclose(a.waiting_ratio, 1 / 3)
    assert (a.auto_routed, a.is_duplicate, a.num_duplicates, a.rstate_major, a.cross_component) == (1, 0, 0, 24.0, 0)
    assert (a.prod_family, a.prod_gen, a.prod_tech) == ("Baseband_6630", "G2", "NR")
    assert (a.alarm_category, a.alarm_severity, b.alarm_category) == ("RadioResource", "major", "unknown")


def test_edge_signals(spark):
    assert values(spark, ["cell\rdisabled", "cell\ndisabled", "CellDisabled", None], S.flag("t", "flag_cell_disabled")) == [1, 0, 1, 0]
    assert values(spark, ["éal", "x AL y"], S.flag("t", "flag_alarm")) == [0, 1]
    assert values(spark, ["HA1, HB22 h", None, "none"], S.duplicate_id_count("t")) == [2, 0, 0]
    assert values(spark, ["x R24A", None, "none"], S.rstate_major("t")) == [24.0, -1.0, -1.0]
    assert [r.prod_family for r in values(spark, ["KDU 137 848/1", "XYZ", None], S.product_info("t"))] == ["Baseband_6630", "unknown", "unknown"]
    assert [r.alarm_category for r in values(spark, ["SW Error and cell disabled", None, "x"], S.alarm_info("t"))] == ["Software", "none", "unknown"]
    assert values(spark, ["A", "B", "C", "D", None], S.priority_ordinal("t")) == [1, 2, 3, 0, 0]
    assert values(spark, ["2023-05-01 - 02:03:04", "bad", None], F.hour(S.parse_time("t"))) == [2, None, None]
    assert values(spark, ["2023-05-01 - 02:03:04"], F.hour(S.parse_time("t", dash_form=False))) == [None]
    df = spark.createDataFrame([("1", "-1"), ("0", "-1"), (None, None), ("x", "3")], "w string, t string")
    got = [r[0] for r in df.select(S.waiting_ratio("w", "t")).collect()]
    assert got[0] == float("inf") and math.isnan(got[1]) and got[2:] == [0.0, 0.0]
    df = spark.createDataFrame([(None, None), (None, "a"), ("a", "a")], "p string, n string")
    assert [r[0] for r in df.select(S.cross_component("p", "n")).collect()] == [0, 1, 0]


def test_date_forms_and_true_texts(spark):
    from faultline.functions.signals import is_true, parse_time
    texts = ["2023-01-05 03:04:05", "2023/01/05 03:04", "20230105", "01/02/2023 10:00", "2023-01-05 - 03:04:05", "soon", None]
    got = [str(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(parse_time("t")).collect()]
    assert got == ["2023-01-05 03:04:05", "2023-01-05 03:04:00", "2023-01-05 00:00:00", "2023-01-02 10:00:00", "2023-01-05 03:04:05", "None", "None"]
    flags = [r[0] for r in spark.createDataFrame([(t,) for t in ["true", "TRUE", "1", "yes", "y", "false", None]], "t string").select(is_true("t")).collect()]
    assert flags == [1, 1, 1, 0, 0, 0, 0]
