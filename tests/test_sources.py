"""Readers, writers and streams on small files."""

import base64
import gzip
import json
import os

import numpy as np
from pyspark.sql import functions as F

from tidemark.sources import files, sinks
from tidemark.streaming import sessions

PROJECT = """<Live><AudioClip><Name Value="drop"/><IsWarped Value="true"/><SampleRef><FileRef><Path Value="/x/drums.wav"/></FileRef></SampleRef>
<WarpMarkers><WarpMarker BeatTime="4" SecTime="3"/><WarpMarker BeatTime="-4" SecTime="1"/><WarpMarker BeatTime="x" SecTime="9"/></WarpMarkers></AudioClip>
<AudioClip><Name Value="none"/><IsWarped Value="true"/></AudioClip>
<AudioClip><Name Value="flat"/><IsWarped Value="false"/><WarpMarkers><WarpMarker BeatTime="0" SecTime="7"/></WarpMarkers></AudioClip></Live>"""


def test_project_clips(spark, tmp_path):
    (tmp_path / "a.als").write_bytes(gzip.compress(PROJECT.encode()))
    (tmp_path / "b.als").write_text("not xml")
    got = files.project_clips(spark, str(tmp_path)).collect()
    assert [(r.name, r.audio, r.target, [m.sec for m in r.markers]) for r in got] == [("drop", "/x/drums.wav", 2.0, [1.0, 3.0])]
    assert files.project_clips(spark, str(tmp_path), unwarped=True).count() == 2


def test_library_and_paths(spark, tmp_path):
    (tmp_path / "lib.xml").write_text('<L><TRACK Name="n" Artist="a" AverageBpm="120.5" Tonality="8A" Location="p"><POSITION_MARK Name="c" Start="1.5" Num="0"/></TRACK></L>')
    (r,) = files.library_tracks(spark, str(tmp_path / "lib.xml")).collect()
    assert (r.name, r.bpm, r.cues[0].start) == ("n", 120.5, 1.5)
    df = spark.createDataFrame([("/m/STEMS/128/8A/song/drums.wav",), ("/m/x.wav",)], "path string")
    assert [(r.bpm, r.key, r.track) for r in files.track_rows(df).collect()] == [(128.0, "8A", "song"), (None, None, None)]


def test_sidecar_and_cues(spark, tmp_path):
    run = np.arange(10, 500, 7, dtype="<u4")
    (tmp_path / "a.asd").write_bytes(b"\xff" * 5 + run.tobytes() + b"\xff" * 7)
    (r,) = files.onset_markers(spark, str(tmp_path), 10_000).collect()
    assert r.samples == run.tolist()
    tag = base64.b64encode(json.dumps({"cues": [{"name": "d", "time": 1500}]}).encode()).decode()
    got = files.cues(spark.createDataFrame([(tag,), ("%%",), (None,)], "tag string"), "tag").collect()
    assert got[0].cues[0].time == 1.5 and got[1].cues == [] and got[2].cues == []


def test_jsonl_csv_manifest(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\n{bad\n{"k": 2}\n')
    assert sorted(r.k for r in files.jsonl(spark, str(tmp_path / "a.jsonl"), "k int", files.LOSSY).collect() if r.k) == [1, 2]
    (tmp_path / "m.csv").write_text("path,n\nx.wav,1\n/y.wav,2\n")
    assert [r.path for r in files.manifest(spark, str(tmp_path / "m.csv"), "path string, n int", "/base").collect()] == ["/base/x.wav", "/y.wav"]
    rows = files.csv_rows(spark, str(tmp_path / "m.csv")).withColumn("f", F.lit("k"))
    assert files.last_wins(rows, ["f"], ["n"]).first().path == "/y.wav"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [0.5, 1.0])], "b int, a string, beats array<double>")
    for _ in range(2):
        sinks.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    sinks.summary_csv(df, str(tmp_path / "s"), ["a", "zz"])
    assert files.csv_rows(spark, str(tmp_path / "s")).columns == ["a", "zz"]
    sinks.beat_grid(df, str(tmp_path / "g"), "a")
    assert files.csv_rows(spark, str(tmp_path / "g")).count() == 2
    sinks.partitioned(df, str(tmp_path / "p"), ["a"])
    assert os.path.isdir(tmp_path / "p" / "a=a")


def test_streams_end_as_the_batch_does(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    rows = spark.read.parquet(src)
    (tmp_path / "in").mkdir()
    rows.write.mode("overwrite").parquet(str(tmp_path / "in"))
    seen = []
    stream = sessions.gap_sessions(sessions.event_stream(spark, str(tmp_path / "in")))
    sessions.to_batches(stream, lambda df, i: seen.extend(df.collect()), str(tmp_path / "cp")).awaitTermination()
    batch = sessions.gap_sessions(rows.withColumn("ts", F.col("ts").cast("timestamp"))).collect()
    # what ends after the watermark stays open
    assert 0 < len(seen) <= len(batch) and {(r.user_id, r.start, r.n) for r in seen} <= {(r.user_id, r.start, r.n) for r in batch}
    once = []
    sessions.to_batches(sessions.first_seen(sessions.event_stream(spark, str(tmp_path / "in"))), lambda df, i: once.extend(df.collect()), str(tmp_path / "cp2")).awaitTermination()
    assert len(once) == rows.select("event_id").distinct().count()


def test_snapshots_tell_what_moved(spark):
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    before = files.track_snapshot(paths("/m/120/8A/one/drums.wav", "/m/120/8A/one/bass.wav", "/m/121/9A/two/x.wav", "/m/abc/9A/no/x.wav", "/m/130/1B/gone/x.wav"))
    assert sorted(tuple(r) for r in before.collect()) == [(120, "8A", "one", "/m/120/8A/one"), (121, "9A", "two", "/m/121/9A/two"), (130, "1B", "gone", "/m/130/1B/gone")]
    after = files.track_snapshot(paths("/m/122/8A/one/drums.wav", "/m/121/9A/two/x.wav", "/m/100/1A/new/x.wav"))
    got = sorted(tuple(r) for r in files.snapshot_changes(before, after).collect())
    assert got == [("gone", "removed", "/m/130/1B/gone", None), ("new", "added", None, "/m/100/1A/new"), ("one", "moved", "/m/120/8A/one", "/m/122/8A/one")]


def test_queue_artifacts_are_written_in_parts(spark, tmp_path):
    rows = spark.createDataFrame([(1, "accept", 0.9), (2, "hold", 0.2), (3, "hold", 0.8), (4, None, None)], "id int, gate string, score double")
    counts = sinks.queue_artifacts(rows, str(tmp_path), {"holds": F.col("gate") == "hold", "sure": F.col("score") >= 0.5, "none": F.col("id") > 9}, ["id", "score", "missing"])
    assert counts == {"holds": 2, "sure": 2, "none": 0}
    sure = spark.read.option("header", True).csv(f"{tmp_path}/parts/_part=sure")
    assert sorted(r.id for r in sure.collect()) == ["1", "3"] and sure.columns == ["id", "score", "missing"]
    assert {(r.part, r.n) for r in spark.read.json(f"{tmp_path}/summary").collect()} == {("holds", 2), ("sure", 2), ("none", 0)}
