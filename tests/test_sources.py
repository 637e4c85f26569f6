"""File readers and writers on small files."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from alertweave.functions import encode as E
from alertweave.functions.hashing import hex_mod10
from alertweave.operators import folds as FO
from alertweave.operators import joins as J
from alertweave.sources import readers as R
from alertweave.sources import writers as W


@pytest.fixture()
def alert_folder(tmp_path):
    lines = [
        json.dumps({"@timestamp": f"2026-01-01T00:00:{5 * i:02d}Z", "agent": {"id": "1"}, "rule": {"id": str(100 + i % 2)}, "extra": [1]})
        for i in range(10)
    ]
    lines += ["", "{broken", json.dumps({"@timestamp": "2026-01-01T00:00:00Z", "rule": {"id": "1"}}),
              json.dumps({"@timestamp": "2026-01-01T00:00:00Z", "agent": {"id": "1"}, "rule": {"id": "x"}})]
    (tmp_path / "demo_wazuh.json").write_text("\n".join(lines))
    (tmp_path / "labels.csv").write_text("scenario,attack,start,end\ndemo,attack_alpha,1767225615,1767225655\n")
    return tmp_path


def test_ingest(spark, alert_folder):
    alerts, rejected = R.read_alert_json(spark, str(alert_folder))
    rows = alerts.orderBy("timestamp").collect()
    assert len(rows) == 10 and rejected.count() == 1
    assert rows[0].asDict() == {"scenario": "demo", "timestamp": 1767225600.0, "machine": "demo_1", "event": 100}
    intervals = R.read_attack_intervals(spark, str(alert_folder / "labels.csv"))
    labels = [r["attack_id"] for r in J.label_by_interval(alerts, intervals).orderBy("timestamp").collect()]
    assert labels == [-1] * 3 + [0] * 7


def test_no_alert_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        R.read_alert_json(spark, str(tmp_path))


def test_scenario_of(spark):
    df = spark.createDataFrame([("a_b_1",), ("plain",)], "m string").select(E.scenario_of(F.col("m")).alias("s"))
    assert [r["s"] for r in df.collect()] == ["a_b", "plain"]


def test_alert_csv_source_rows_and_canonical(spark, tmp_path):
    header = "time,name,ip,host,short,time_label,event_label\n"
    for s, n in (("fox", 3), ("owl", 2)):
        body = "".join(f"{100 + i},n{i},10.0.0.{i},h{i},W-x{i % 2},{'false_positive' if i else 'scan'},{'dirb' if i else '-'}\n" for i in range(n))
        (tmp_path / f"{s}.csv").write_text(header + body)
    read = R.read_alert_csv(spark, str(tmp_path), ["fox", "owl"])
    assert sorted((r["scenario"], r["source_row"], r["time"]) for r in read.collect()) == [
        ("fox", 0, 100), ("fox", 1, 101), ("fox", 2, 102), ("owl", 0, 100), ("owl", 1, 101)]
    table = W.canonical_alerts(read)
    assert tuple(table.columns) == W.CANONICAL_COLUMNS
    rows = table.orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == [0, 1, 2, 3, 4] and rows[1]["event_incident_group"] == "fox::dirb"
    assert rows[0]["detector"] == "Wazuh" and rows[0]["window_incident_group"] == "fox::scan"


def test_wrong_csv_header_fails(spark, tmp_path):
    (tmp_path / "fox.csv").write_text("time,name\n1,a\n")
    with pytest.raises(Exception):
        R.read_alert_csv(spark, str(tmp_path), ["fox"]).collect()


def test_event_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"1  2 3\r\n\n4\n")
    got = R.read_event_sequences(spark, {"train": str(tmp_path / "a.txt")}).collect()
    assert sorted(list(r["tokens"]) for r in got) == [[1, 2, 3], [4]]
    for bad in ("1 x", "-1", "é 1", "1.5"):
        df = spark.createDataFrame([(bad,)], "line string")
        assert R.parse_event_lines(df).count() == 0
        with pytest.raises(Exception):
            R.parse_event_lines(df, strict=True).collect()


def test_split_ignores_line_ends_and_copies(spark):
    df = spark.createDataFrame([("test", "5 6 7"), ("test", "5 6 7\r\n"), ("train", "5 6 7")], "source string, line string")
    codes = [r["split"] for r in FO.sequence_split(df).collect()]
    assert codes[0] == codes[1] and codes[2] == 0


def test_hex_mod10(spark):
    texts = [str(i) for i in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", hex_mod10(F.sha2("t", 256)).alias("b"))
    for r in df.collect():
        assert r["b"] == int(hashlib.sha256(r["t"].encode()).hexdigest(), 16) % 10


def test_report_comment_lines(spark, tmp_path):
    (tmp_path / "r.csv").write_text("# made by a run\na,b\n1,2\n# note\n3,4\n")
    got = R.read_report_csv(spark, str(tmp_path / "r.csv"), "a int, b int").collect()
    assert [(r["a"], r["b"]) for r in got] == [(1, 2), (3, 4)]


def test_run_records(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    good = {"method": "m", "status": "complete", "operating_points": [{"eps": 0.1}, {"eps": 0.3}]}
    (tmp_path / "x" / "a.json").write_text(json.dumps(good, indent=2))
    (tmp_path / "x" / "y" / "b.json").write_text(json.dumps({**good, "status": "failed"}))
    (tmp_path / "x" / "y" / "c.json").write_text(json.dumps({**good, "operating_points": []}))
    schema = "method string, status string, operating_points array<struct<eps:double>>"
    got = R.read_run_records(spark, str(tmp_path), schema).collect()
    assert [(r["order"], r["point"]["eps"]) for r in got] == [(0, 0.1), (1, 0.3)]


def test_processed_events_reused(spark, tmp_path):
    rows = spark.createDataFrame([(1.5, "s_1", 7, -1)], "timestamp double, machine string, event int, label int")
    path = W.write_processed_events(rows, str(tmp_path / "out"))
    W.write_processed_events(rows.withColumn("event", F.lit(9)), path)
    assert [r["event"] for r in R.read_processed_events(spark, path).collect()] == [7]


def test_numbers_follow_file_names(spark, tmp_path):
    """Part files of very unequal size keep the order of their names, in intervals and in processed events."""
    folder = tmp_path / "events"
    folder.mkdir()
    for name, first, rows in (("part-0.csv", 0, 2), ("part-1.csv", 2, 5_000), ("part-2.csv", 5_002, 1)):
        body = "".join(f"{first + i}.0,s::h_1,{i % 7},-1\n" for i in range(rows))
        (folder / name).write_text("timestamp,machine,event,label\n" + body)
    got = R.read_processed_events(spark, str(folder)).collect()
    assert len(got) == 5_003 and all(r["row_id"] == int(r["timestamp"]) for r in got)
    folder = tmp_path / "intervals"
    folder.mkdir()
    (folder / "a.csv").write_text("scenario,attack,start,end\ndemo,first,10,20\n")
    (folder / "b.csv").write_text("scenario,attack,start,end\n" + "demo,later,10,30\n" * 2_000)
    intervals = R.read_attack_intervals(spark, str(folder))
    assert sorted(r["position"] for r in intervals.collect()) == list(range(2_001))
    alerts = spark.createDataFrame([("demo", 15.0)], "scenario string, timestamp double")
    assert J.label_by_interval(alerts, intervals).first()["attack_id"] == 0


def test_long_tokens(spark):
    lines = spark.createDataFrame([("00000000001 2",), ("4294967295 2",), ("99999999999999999999 1",), ("1 b",)], "line string")
    assert sorted(list(r["tokens"]) for r in R.parse_event_lines(lines).collect()) == [[1, 2], [4294967295, 2]]
    assert sorted(r["line"] for r in R.rejected_event_lines(lines).collect()) == ["1 b", "99999999999999999999 1"]
