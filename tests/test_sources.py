import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from knotwork.operators.audit import IntegrityError
from knotwork.sources import files
from knotwork.streaming import events


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_json_scan(spark, tmp_path):
    put(tmp_path / "a.json", '{"lecture_id": "l1", "knowledge_objects": [\n {"id": "1", "name": "Grad", "type": "Concept", "source_span": "s", "lecture_id": "l2"}]}')
    schema = "lecture_id string, knowledge_objects array<struct<id:string,name:string,type:string,source_span:string,lecture_id:string>>"
    r = files.exploded_predictions(files.read_json(spark, str(tmp_path), schema)).first()
    assert (r.lecture_id, r.predicted_ko_id, r.source_spans, r.provenance_conflict) == ("l1", "1", ["s"], True)
    assert r.provenance.source_file.endswith("a.json") and r.provenance.source_object_index == 0
    put(tmp_path / "b.json", '{"lecture_id": ')
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST|FAILED_READ"):
        files.read_json(spark, str(tmp_path / "b.json"), schema).collect()


def test_lectures(spark, tmp_path):
    put(tmp_path / "d" / "x_001.md", "title\n---\n\nbödy\n")
    put(tmp_path / "y_002.md", "no line")
    put(tmp_path / "z.txt", "no")
    rows = {r.lecture_id: r for r in files.read_lectures(spark, str(tmp_path)).collect()}
    assert set(rows) == {"x_001", "y_002"} and rows["x_001"].body == "bödy\n" and rows["y_002"].body == "no line\n"


def test_bundle(spark, tmp_path):
    path = f"file://{tmp_path}/bundle"
    df = spark.range(10)
    files.write_bundle({"rows": df, "more": df.limit(2)}, path)
    assert files.read_bundle(spark, path, "rows").count() == 10
    with pytest.raises(FileExistsError):
        files.write_bundle({"rows": df}, path)
    part = next((tmp_path / "bundle/rows").glob("*.parquet"))
    part.write_bytes(part.read_bytes()[:-1] + b"x")
    (part.parent / f".{part.name}.crc").unlink()
    with pytest.raises(IntegrityError):
        files.verify_bundle(spark, path)
    with pytest.raises(IntegrityError):
        files.verify_bundle(spark, f"file://{tmp_path}/none")


def test_copy_summary_and_guard(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/a")
    files.copy_table(spark, f"{tmp_path}/a", f"{tmp_path}/b")
    assert spark.read.parquet(f"{tmp_path}/b").count() == 3
    with pytest.raises(Exception, match="exists"):
        files.copy_table(spark, f"{tmp_path}/a", f"{tmp_path}/b")
    text = files.markdown(spark.createDataFrame([("recall", 0.5), ("none", None)], "metric string, value double"), "Result")
    assert "| recall | 0.5000 |" in text and "| none | – |" in text

    def fails(path):
        spark.range(1).write.parquet(f"{path}/metrics")
        raise RuntimeError("bad")

    assert files.guarded(spark, f"file://{tmp_path}/run", fails) == "invalid"
    assert os.listdir(tmp_path / "run") == ["status"] and spark.read.json(f"{tmp_path}/run/status").first().status == "invalid"
    assert files.guarded(spark, f"file://{tmp_path}/ok", lambda p: spark.range(1).write.parquet(p)) == "final"


def test_stream_equals_table(spark, tmp_path):
    t = dt.datetime(2025, 1, 1)
    rows = [(i, t + dt.timedelta(minutes=7 * i), "ab"[i % 2], float(i)) for i in range(50)] + [(0, t, "a", 0.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/e")
    table = events.windowed(events.deduplicated(spark.read.parquet(f"{tmp_path}/e")))
    stream = events.windowed(events.read_events(spark, f"{tmp_path}/e", spark.read.parquet(f"{tmp_path}/e").schema).dropDuplicates(["event_id", "ts"]))
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted(tuple(r) for r in df.select("window_start", "event_type", "n_events", F.round("total", 6)).collect())
    assert key(spark.table("w")) == key(table)


SWEPT = """
import os, sys
os.environ["PYSPARK_SUBMIT_ARGS"] = "--conf spark.checkpoint.dir=file://" + {folder!r} + " pyspark-shell"
sys.path.insert(0, {root!r})
import __spark_entry__ as e
from knotwork.session import local_session, shared_dir, listed
spark = local_session(2, 2)
for name in ("p2_found", "p3_found", "connected_components"):
    assert e.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
kinds = [n.split("_")[1] for n in listed(spark, shared_dir(spark)) if n.startswith("knotwork_")]
assert sorted(kinds) == ["compact", "edges", "union"], kinds  # what the three results read, nothing else
spark.stop()
"""


def test_nothing_is_left_in_the_shared_folder(tmp_path):
    """Only what a result still reads is left after a query, and nothing when the process has ended."""
    import os
    import subprocess
    import sys

    if not os.path.isdir("/root/testdata/sf0.001"):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", SWEPT.format(root=root, folder=str(tmp_path))], check=True, timeout=300, capture_output=True)
    assert not [p for p in tmp_path.rglob("*.parquet")]


def test_a_cluster_without_a_shared_folder_is_an_error():
    import pytest

    from knotwork.session import shared_dir

    class Nothing:
        def isDefined(self):  # noqa: N802
            return False

    class Fake:
        master, sparkContext, conf, _conf, _jsc = "spark://host:7077", None, None, {}, None

        def get(self, *a):
            return None

        def sc(self):
            return self

        def getCheckpointDir(self):  # noqa: N802
            return Nothing()

    fake = Fake()
    fake.sparkContext = fake.conf = fake._jsc = fake
    with pytest.raises(RuntimeError):
        shared_dir(fake)
