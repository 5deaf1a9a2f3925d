import pytest
from pyspark.sql import functions as F

from flowpane.functions import labels as L
from flowpane.functions import numbers as N
from flowpane.operators import clean as C
from flowpane.plans.clean_job import CleanSpec, clean_flows


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(fn(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize("text,want", [(" BENIGN", "Benign"), ("Benign ", "Benign"), ("benign", "benign"), ("DDoS", "DDoS")])
def test_canonical_label(spark, text, want):
    assert one(spark, text, L.canonical_label) == want


@pytest.mark.parametrize("text,want", [(None, None), ("  ", None), ("NORMAL", None), ("Infilteration", "Infiltration"), (" Bot ", "Bot")])
def test_normalise_attack(spark, text, want):
    assert one(spark, text, L.normalise_attack) == want


@pytest.mark.parametrize("cat,flag,want", [(None, 1, "Benign"), (" ", 1, "Benign"), ("nan", 1, "Benign"), ("Backdoor", 1, "Backdoors"),
                                           (" Exploits ", 1, "Exploits"), ("Exploits", 0, "Benign"), ("Worms", None, "Worms")])
def test_category_label(spark, cat, flag, want):
    df = spark.createDataFrame([(cat, flag)], "c string, f int")
    assert df.select(L.label_from_category(F.col("c"), F.col("f")).alias("r")).first()["r"] == want


def test_ascii_label(spark):
    assert one(spark, "Web Attack – XSS → é", L.ascii_label) == "Web Attack - XSS -> "
    assert one(spark, "éé", lambda c: L.ascii_label(c, F.lit("Attack_1"))) == "Attack_1"


@pytest.mark.parametrize("text,want", [("Infinity", None), ("-Infinity", None), ("NaN", None), ("abc", None), (" 3.5 ", 3.5), (None, None)])
def test_numbers(spark, text, want):
    assert one(spark, text, lambda c: N.finite(N.to_number(c))) == want


def test_harmonise_merges_spellings(spark):
    df = spark.createDataFrame([(None, 2.0, 5), (1.0, None, 6)], "`Dst Port` double, `Destination Port` double, other int")
    out = C.harmonise_columns(df)
    assert out.columns == ["Destination Port", "other"]
    assert sorted(r[0] for r in out.collect()) == [1.0, 2.0]


def test_dedup_keeps_earliest_and_is_idempotent(spark):
    # one group of copies holds most rows
    rows = [(i, "x" if i % 2 else "y", 1.0, None) for i in range(500, 1500)] + [(3, "late", 2.0, 0.5), (2, "early", 2.0, 0.5)]
    df = spark.createDataFrame(rows, "ts int, label string, a double, b double")
    once = C.dedup_flows(df, ["ts"])
    assert sorted(r["ts"] for r in once.collect()) == [2, 500]
    assert sorted(C.dedup_flows(once, ["ts"]).collect()) == sorted(once.collect())
    rep = {r["label"]: (r["rows"], r["kept"], r["removed"]) for r in C.dedup_report(df, ["ts"]).collect()}
    assert rep["y"] == (500, 1, 499) and rep["late"] == (1, 0, 1) and rep["early"] == (1, 1, 0)


def test_label_dictionary(spark):
    df = spark.createDataFrame([("Backdoors",), ("Benign",), ("Worms",), ("Benign",)], "label string")
    assert {r["label"]: r["code"] for r in C.label_dictionary(df).collect()} == {"Benign": 0, "Backdoors": 1, "Worms": 2}
    only = df.where("label <> 'Benign'")
    assert {r["label"]: r["code"] for r in C.label_dictionary(only).collect()} == {"Backdoors": 1, "Worms": 2}
    assert C.encode_labels(df, C.label_dictionary(df)).count() == 4


def test_clean_job_policies(spark):
    raw = spark.createDataFrame([
        ("s", "2017-07-03 01:00:00", " BENIGN", "1", "2"), ("s", "bad", "Bot", "1", "3"),
        ("s", "2017-07-03 09:00:00", "Bot", "Infinity", "4"), ("s", "2017-07-03 10:00:00", "Bot", "1", "2")],
        "source string, Timestamp string, Label string, `Flow Byts/s` string, `Tot Fwd Pkts` string")
    drop = clean_flows(raw, CleanSpec(na_policy="drop")).collect()
    assert [(r["ts"].hour, r["label"], r["Flow Bytes/s"]) for r in drop] == [(10, "Bot", 1.0)]
    zero = clean_flows(raw, CleanSpec(na_policy="zero")).orderBy("ts").collect()
    assert [(r["ts"].hour, r["Flow Bytes/s"], r["Total Fwd Packets"]) for r in zero] == [(9, 0.0, 4.0), (10, 1.0, 2.0)]
    with pytest.raises(ValueError):
        C.apply_na_policy(raw, "other", [])
