"""Readers of line-delimited JSON, CSV, manifests, track folders, compressed XML project files, library XML and binary sidecars."""

from __future__ import annotations

import gzip
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LOSSY, STRICT = "DROPMALFORMED", "FAILFAST"
AUDIO_SUFFIXES = ("wav", "aif", "aiff", "flac", "mp3", "m4a", "ogg")


def jsonl(spark: SparkSession, path: str, schema: str | StructType, mode: str = STRICT) -> DataFrame:
    """Rows of objects, one a line; blank lines are skipped; bad lines raise (STRICT) or go (LOSSY). The file's path is in `_file`."""
    return spark.read.schema(schema).option("mode", mode).json(path).withColumn("_file", F.col("_metadata.file_path"))


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, by the header."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the last in order."""
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(*key).orderBy(*(F.desc(c) for c in order)))).where("_k = 1").drop("_k")


def manifest(spark: SparkSession, path: str, schema: str, base: str | None = None, column: str = "path") -> DataFrame:
    """Rows of a csv, json or jsonl file, by its suffix; relative paths in `column` are put under `base`."""
    reader = spark.read.schema(schema)
    rows = reader.option("header", True).csv(path) if path.endswith(".csv") else reader.option("multiLine", path.endswith(".json")).option("mode", STRICT).json(path)
    if base is None:
        return rows
    absolute = F.col(column).startswith("/") | F.col(column).contains("://")
    return rows.withColumn(column, F.when(absolute, F.col(column)).otherwise(F.concat_ws("/", F.lit(base.rstrip("/")), F.col(column))))


def audio_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = AUDIO_SUFFIXES) -> DataFrame:
    """Paths, sizes and times of the audio files under a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes))


def track_rows(paths: DataFrame, column: str = "path") -> DataFrame:
    """bpm, key and track of paths `…/STEMS/<BPM>/<KEY>/<track>/…`; null where the layout isn't met."""
    part = lambda i: F.nullif(F.regexp_extract(column, r"/STEMS/([0-9.]+)/([^/]+)/([^/]+)", i), F.lit(""))
    return paths.withColumn("bpm", part(1).try_cast("double")).withColumn("key", part(2)).withColumn("track", part(3))


def _root(data: bytes) -> ET.Element | None:
    """Tree of an XML file, compressed or not; null if it is neither."""
    try:
        return ET.fromstring(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    except (OSError, EOFError, ET.ParseError):
        return None


def _value(node: ET.Element | None, name: str) -> str | None:
    found = node.find(name) if node is not None else None
    return None if found is None else found.get("Value")


CLIP = "project string, clip int, name string, audio string, warped boolean, markers array<struct<beat:double,sec:double>>, target double"


def beat_zero(markers: list[tuple[float, float]]) -> float | None:
    """Seconds of beat 0: its marker, else on the line through the two around it, else through the two nearest."""
    for beat, sec in markers:
        if beat == 0:
            return sec
    if len(markers) < 2:
        return None
    by_beat = sorted(markers)
    after = next((i for i, m in enumerate(by_beat) if m[0] > 0), None)
    i = len(by_beat) - 1 if after is None else max(1, after)
    (b0, s0), (b1, s1) = by_beat[i - 1], by_beat[i]
    return None if b1 == b0 else s0 - b0 * (s1 - s0) / (b1 - b0)


def project_clips(spark: SparkSession, path: str, unwarped: bool = False) -> DataFrame:
    """One row per audio clip of the project files: its markers by time, and the target (seconds of beat 0); clips without are left out."""

    def clips(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file, data in zip(batch["path"], batch["content"], strict=True):
                root = _root(data)
                for i, clip in enumerate(root.iter("AudioClip") if root is not None else ()):
                    marks = []
                    for m in clip.iter("WarpMarker"):
                        try:
                            marks.append((float(m.get("BeatTime")), float(m.get("SecTime"))))
                        except (TypeError, ValueError):
                            continue
                    marks.sort(key=lambda m: m[1])
                    warped = _value(clip, "IsWarped") == "true"
                    target = beat_zero(marks)
                    ref = clip.find(".//FileRef")
                    if target is not None and (warped or unwarped):
                        out.append((file, i, _value(clip, "Name"), _value(ref, "Path"), warped, [{"beat": b, "sec": s} for b, s in marks], target))
            yield pd.DataFrame(out, columns=["project", "clip", "name", "audio", "warped", "markers", "target"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInPandas(clips, CLIP)


def library_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Tracks of a library XML with their cue positions, by Spark's XML reader."""
    schema = "_Name string, _Artist string, _AverageBpm double, _Tonality string, _Location string, POSITION_MARK array<struct<_Name:string,_Start:double,_Num:int>>"
    rows = spark.read.format("xml").option("rowTag", "TRACK").schema(schema).load(path)
    return rows.select(F.col("_Name").alias("name"), F.col("_Artist").alias("artist"), F.col("_AverageBpm").alias("bpm"), F.col("_Tonality").alias("key"), F.col("_Location").alias("location"), F.transform("POSITION_MARK", lambda m: F.struct(m["_Name"].alias("name"), m["_Start"].alias("start"), m["_Num"].alias("num"))).alias("cues"))


def longest_rising_run(raw: bytes, most: int, least_run: int) -> np.ndarray:
    """The longest strictly rising run of 32-bit numbers up to `most`, at any byte offset; the first of the longest; empty below least_run."""
    best = np.zeros(0, np.uint32)
    for shift in range(4):
        x = np.frombuffer(raw[shift : shift + (len(raw) - shift) // 4 * 4], "<u4")
        if len(x) < least_run:
            continue
        ok = x <= most
        step = np.concatenate([[False], (x[1:] > x[:-1]) & ok[1:] & ok[:-1]])
        begin = np.flatnonzero(~step)
        size = np.diff(np.append(begin, len(x)))
        k = int(size.argmax())
        if size[k] >= least_run and size[k] > len(best):
            best = x[begin[k] : begin[k] + size[k]]
    return best


def onset_markers(spark: SparkSession, path: str, most: int, least_run: int = 8) -> DataFrame:
    """Onset positions in samples that binary sidecars hold as their longest rising run: path, samples."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "samples": [longest_rising_run(c, most, least_run).astype(np.int64).tolist() for c in batch["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(found, "path string, samples array<bigint>")


def cue_payload(encoded: str | None) -> list[dict]:
    """Cues of a base64 JSON tag; none if it isn't one."""
    import base64

    try:
        data = json.loads(base64.b64decode(re.sub(r"\s", "", encoded or "")))
    except ValueError:
        return []
    cues = data.get("cues", []) if isinstance(data, dict) else []
    return [{"name": str(c.get("name", "")), "time": float(c["time"]) / 1000} for c in cues if isinstance(c, dict) and isinstance(c.get("time"), (int, float))]


def cues(rows: DataFrame, column: str) -> DataFrame:
    """The rows with `cues` decoded from a base64 JSON tag, in the JVM; bad payloads give none."""
    schema = "struct<cues:array<struct<name:string,time:double>>>"
    text = F.try_to_binary(F.regexp_replace(column, r"\s", ""), F.lit("base64")).cast("string")
    return rows.withColumn("cues", F.coalesce(F.transform(F.from_json(text, schema)["cues"], lambda c: F.struct(c["name"].alias("name"), (c["time"] / 1000).alias("time"))), F.array().cast("array<struct<name:string,time:double>>")))


def track_snapshot(paths: DataFrame, column: str = "path") -> DataFrame:
    """bpm, key, track and folder of every track folder `…/<BPM>/<KEY>/<track>/…` under which files lie; folders of other names than digits, and empty ones, are not in it."""
    part = lambda i: F.regexp_extract(column, r"^(.*/([0-9]+)/([^/]+)/([^/]+))/[^/]+$", i)
    rows = paths.select(part(2).cast("int").alias("bpm"), part(3).alias("key"), part(4).alias("track"), part(1).alias("folder"))
    return rows.where("folder <> ''").distinct()


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """track, change (added, removed or moved), was and now (folders): a track that lies in one folder before and in one other after has moved."""
    left = before.groupBy("track").agg(F.array_sort(F.collect_set("folder")).alias("a"))
    both = left.join(after.groupBy("track").agg(F.array_sort(F.collect_set("folder")).alias("b")), "track", "full")
    none = F.array().cast("array<string>")
    gone, new = F.array_except(F.coalesce("a", none), F.coalesce("b", none)), F.array_except(F.coalesce("b", none), F.coalesce("a", none))
    told = both.select("track", gone.alias("gone"), new.alias("new")).withColumn("moved", (F.size("gone") == 1) & (F.size("new") == 1))
    moved = F.array(F.struct(F.lit("moved").alias("change"), F.get("gone", F.lit(0)).alias("was"), F.get("new", F.lit(0)).alias("now")))
    nothing = F.lit(None).cast("string")
    apart = F.concat(F.transform("gone", lambda f: F.struct(F.lit("removed").alias("change"), f.alias("was"), nothing.alias("now"))), F.transform("new", lambda f: F.struct(F.lit("added").alias("change"), nothing.alias("was"), f.alias("now"))))
    return told.select("track", F.inline(F.when(F.col("moved"), moved).otherwise(apart)))
