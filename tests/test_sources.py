import time

import pytest

from flowpane.functions import vocabulary as V
from flowpane.operators import catalog as K
from flowpane.session import scratch_dir
from flowpane.sources import readers as R
from flowpane.sources import writers as W


def test_headed_latin1_csv(spark, tmp_path):
    (tmp_path / "monday.csv").write_bytes("Flow ID, Label, Flow Byts/s\n1, BENIGN, Infinity\n2, Web Attack \xe9, 12.5\n".encode("latin-1"))
    df = R.read_flows(spark, str(tmp_path))
    assert df.columns == ["Flow ID", "Label", "Flow Byts/s", "source"]
    rows = sorted(df.collect())
    assert rows[0]["Flow Byts/s"] == "Infinity" and rows[1]["Label"] == "Web Attack \xe9" and rows[0]["source"] == "monday.csv"


def test_headerless_csv(spark, tmp_path):
    (tmp_path / "part.csv").write_text(",".join(str(i) for i in range(49)) + "\n")
    r = R.read_flows(spark, str(tmp_path), R.headerless_schema()).first()
    assert len(V.HEADERLESS_COLUMNS) == 49 and r["srcip"] == "0" and r["label"] == "48"


def test_feature_list(spark, tmp_path):
    p = tmp_path / "f.txt"
    p.write_text("b\n\n  a \nc\n")
    assert [r["feature"] for r in R.read_feature_list(spark, str(p)).orderBy("line").collect()] == ["b", "a", "c"]


def test_series(spark, tmp_path):
    (tmp_path / "s.csv").write_text("time_step,value\n0,1.5\n1,2.5\n")
    assert [(r["t"], r["value"]) for r in R.read_series(spark, str(tmp_path)).orderBy("t").collect()] == [(0, 1.5), (1, 2.5)]


def test_reports_and_classes(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01", "Benign", 1.0), ("2024-01-02", "Bot", 2.0)], "source string, label string, v double")
    W.write_report(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    with pytest.raises(ValueError):
        W.write_report(df, str(tmp_path / "x"), "xml")
    W.write_by_class(df, str(tmp_path / "cls"))
    assert spark.read.parquet(str(tmp_path / "cls")).where("is_malicious = 1").first()["label"] == "Bot"
    W.write_clean(df, str(tmp_path / "clean"))
    assert dict(R.read_clean(spark, str(tmp_path / "clean")).dtypes)["source"] == "string"


def test_selection_needs_a_match(spark):
    df = spark.createDataFrame([(1, 2.0)], "id int, a double")
    assert K.select_features(df, ["x", "a"], ["id"]).columns == ["id", "a"]
    with pytest.raises(ValueError):
        K.select_features(df, ["x"], ["id"])


class FakeSession:
    """What scratch_dir asks of a session."""

    def __init__(self, master, configured=None, current=None):
        self.conf = {"spark.checkpoint.dir": configured} if configured else {}
        self.sparkContext = type("Context", (), {
            "master": master, "applicationId": "fake", "getCheckpointDir": staticmethod(lambda: current)})()


def test_scratch_dir_comes_from_the_session(spark):
    assert scratch_dir(FakeSession("spark://host", "hdfs:///shared")) == "hdfs:///shared"
    assert scratch_dir(FakeSession("spark://host", None, "hdfs:///set")) == "hdfs:///set"
    with pytest.raises(RuntimeError):
        scratch_dir(FakeSession("spark://host"))
    assert scratch_dir(spark) == scratch_dir(spark)


def test_files_with_different_headers_keep_their_values(spark, tmp_path):
    from flowpane.operators.clean import harmonise_columns
    (tmp_path / "a, [1].csv").write_bytes(b"Dst Port, Tot Fwd Pkts,Label\r\n80, 5,Web Attack \x96 XSS\r\n81,6,BENIGN\r\n")
    (tmp_path / "b.csv").write_bytes(b"Total Fwd Packets,Destination Port,Twice,Twice\n7,443,x,y\n")
    (tmp_path / "empty.csv").write_bytes(b"")
    df = R.read_flows(spark, str(tmp_path))
    assert "Twice.1" in df.columns
    rows = sorted((r["Destination Port"], r["Total Fwd Packets"], r["Label"]) for r in harmonise_columns(df).collect() if r["Label"])
    assert rows == [("80", "5", "Web Attack \x96 XSS"), ("81", "6", "BENIGN")]
    b = harmonise_columns(df).where("Label IS NULL").first()
    assert (b["Destination Port"], b["Total Fwd Packets"], b["Twice"], b["Twice.1"], b["source"]) == ("443", "7", "x", "y", "b.csv")


def test_header_discovery_reads_first_lines_only(spark, tmp_path):
    """A file of 6 GB (sparse: header, two rows, then one endless line) has its header found at once, and files are not opened to be listed."""
    with (tmp_path / "huge.csv").open("wb") as f:
        f.write(b"\n  \nLabel,Port\nBENIGN,80\nBENIGN,81\n")
        f.truncate(6 << 30)
    for i in range(30):
        (tmp_path / f"day {i}.csv").write_text("Label,Port\nBENIGN,1\n" if i % 2 else "Port,Label\n1,BENIGN\n")
    (tmp_path / "blank.csv").write_text("\n \n")
    start = time.monotonic()
    found = R.files_by_header(spark, str(tmp_path))
    assert time.monotonic() - start < 30
    assert {k: len(v) for k, v in found.items()} == {"Label,Port": 16, "Port,Label": 15}


def test_blank_lines_before_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n\nLabel,Port\nBENIGN,80\n")
    (tmp_path / "b.csv").write_text("Port,Label\n81,BENIGN\n")
    (tmp_path / "c.csv").write_text("\n")
    df = R.read_flows(spark, str(tmp_path))
    assert sorted((r["Label"], r["Port"], r["source"]) for r in df.collect()) == [("BENIGN", "80", "a.csv"), ("BENIGN", "81", "b.csv")]
