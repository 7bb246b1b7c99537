"""Spark data sources for caches of one file per track (npz) and for marker databases (JSON files of nested maps).

`npz_cache`: a row per file, `id` being its name; every other column of the schema is the array of that name (a list, a list of lists, or a scalar from an
array with one value); what a file lacks is null, arrays that aren't read aren't decompressed, and pickled objects are never loaded (null). Filters on `id`
(=, in, starts with) choose files before any is opened. `marker_map`: a row per entry of `{section: {key: {field: value}}}`; filters on `section` and lower
bounds on `drop_sec` are applied where entries are read, so others never become rows.

A broken file raises with option mode=strict, gives a row with `error` (npz) or none (marker_map) otherwise. Paths are folders, files or globs of
any file system that pyarrow opens by its URI; every task opens its own files. Writers put each file under another name first and rename
it, so readers see whole files only, and a task that runs again replaces what it wrote.
"""

from __future__ import annotations

import fnmatch
import io
import json
import math
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import ArrayType, StructType

CANDIDATES = "id string, times array<float>, confidence array<float>, downbeats array<float>, tempo_bpm float, version int, error string"
MARKERS = "file string, section string, key string, drop_sec double, bpm double, observations long, sample_path string"
FILES_PER_TASK = 64


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str, suffix: str) -> list[str]:
    """Paths of the files under a folder, or that a glob in the last part of the path names; none if there is no such folder."""
    system, path = opened(path)
    folder, _, name = path.rpartition("/")
    glob = any(c in name for c in "*?[")
    if not glob and system.get_file_info(path).type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(folder if glob else path, allow_not_found=True, recursive=not glob))
    return sorted(x.path for x in found if x.is_file and x.base_name.endswith(suffix) and not x.base_name.startswith((".", "_")) and (not glob or fnmatch.fnmatch(x.base_name, name)))


def put(path: str, data: bytes) -> None:
    """The file as a whole, or not at all."""
    system, path = opened(path)
    folder, _, name = path.rpartition("/")
    system.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, path)


@dataclass
class Files(InputPartition):
    paths: list[str]


class CacheReader(DataSourceReader):
    """What both readers share: files by option, tasks of FILES_PER_TASK files, and filters that are remembered."""

    suffix = ""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options
        self.strict = options.get("mode", "").lower() == "strict"

    def paths(self) -> list[str]:
        return listed(self.options["path"], self.suffix)

    def partitions(self) -> list[InputPartition]:
        paths, most = self.paths(), int(self.options.get("filesPerTask", FILES_PER_TASK))
        return [Files(paths[i : i + most]) for i in range(0, len(paths), most)] or [Files([])]

    def bytes_of(self, path: str) -> bytes:
        system, path = opened(self.options["path"])[0], path
        with system.open_input_stream(path) as data:
            return data.read()


class NpzReader(CacheReader):
    suffix = ".npz"
    ids: set[str] | None = None
    starts: tuple[str, ...] = ()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("id",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.ids = wanted if self.ids is None else self.ids & wanted
            elif isinstance(f, StringStartsWith) and f.attribute == ("id",):
                self.starts = (*self.starts, f.value)
            else:
                yield f

    def paths(self) -> list[str]:
        named = [(unquote(p.rpartition("/")[2].removesuffix(".npz")), p) for p in super().paths()]
        return [p for i, p in named if (self.ids is None or i in self.ids) and all(i.startswith(s) for s in self.starts)]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            row = dict.fromkeys(self.schema.names)
            row["id"] = unquote(path.rpartition("/")[2].removesuffix(".npz"))
            try:
                with np.load(io.BytesIO(self.bytes_of(path)), allow_pickle=False) as arrays:
                    for field in self.schema:
                        if field.name in arrays.files and field.name not in ("id", "error"):
                            row[field.name] = self.value(arrays, field.name, isinstance(field.dataType, ArrayType))
            except (OSError, ValueError, KeyError, EOFError, zipfile.BadZipFile) as e:
                if self.strict:
                    raise ValueError(f"{path}: {e}") from e
                if "error" in row:
                    row["error"] = f"{type(e).__name__}: {e}"
            yield tuple(row.values())

    @staticmethod
    def value(arrays, name: str, many: bool):
        try:
            found = arrays[name]
        except ValueError:  # pickled objects
            return None
        if many:
            return found.tolist() if found.ndim else [found.item()]
        return found.reshape(-1)[0].item() if found.size else None


class NpzWriter(DataSourceWriter):
    """A file for each row, named by its id; null columns are left out."""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"].rstrip("/")

    def write(self, iterator) -> WriterCommitMessage:
        kinds = {"float": np.float32, "double": np.float64, "integer": np.int32, "long": np.int64, "string": np.str_}
        for row in iterator:
            arrays = {}
            for field in self.schema:
                if field.name not in ("id", "error") and row[field.name] is not None:
                    inner = field.dataType
                    while isinstance(inner, ArrayType):
                        inner = inner.elementType
                    arrays[field.name] = np.atleast_1d(np.array(row[field.name], kinds.get(inner.typeName())))
            data = io.BytesIO()
            np.savez_compressed(data, **arrays)
            put(f"{self.path}/{quote(str(row['id']), safe='')}.npz", data.getvalue())
        return WriterCommitMessage()


class NpzCache(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz_cache"

    def schema(self) -> str:
        return CANDIDATES

    def reader(self, schema: StructType) -> NpzReader:
        return NpzReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> NpzWriter:
        if overwrite:
            clear(self.options["path"], ".npz")
        return NpzWriter(schema, dict(self.options))


def clear(path: str, suffix: str) -> None:
    system = opened(path)[0]
    for old in listed(path, suffix):
        system.delete_file(old)


def number(x) -> float | None:
    """A finite number, else null."""
    try:
        x = float(x)
    except (TypeError, ValueError):
        return None
    return x if math.isfinite(x) else None


class MarkerReader(CacheReader):
    suffix = ".json"
    sections: set[str] | None = None
    least = -math.inf
    above = -math.inf

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("section",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.sections = wanted if self.sections is None else self.sections & wanted
            elif isinstance(f, GreaterThanOrEqual) and f.attribute == ("drop_sec",):
                self.least = max(self.least, f.value)
            elif isinstance(f, GreaterThan) and f.attribute == ("drop_sec",):
                self.above = max(self.above, f.value)
            else:
                yield f

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                payload = json.loads(self.bytes_of(path))
                if not isinstance(payload, dict):
                    raise ValueError("no map")
            except (OSError, ValueError) as e:
                if self.strict:
                    raise ValueError(f"{path}: {e}") from e
                continue
            for section, entries in payload.items():
                if not isinstance(entries, dict) or (self.sections is not None and section not in self.sections):
                    continue
                for key, x in entries.items():
                    if not isinstance(x, dict):
                        continue
                    drop = number(x.get("drop_sec"))
                    if (drop is None and (self.least, self.above) != (-math.inf, -math.inf)) or (drop is not None and (drop < self.least or drop <= self.above)):
                        continue
                    seen = number(x.get("obs_used")) or number(x.get("obs")) or 1
                    row = {"file": path, "section": section, "key": key, "drop_sec": drop, "bpm": number(x.get("bpm")), "observations": int(seen), "sample_path": x.get("sample_path") and str(x["sample_path"])}
                    yield tuple(row.get(n) for n in self.schema.names)


class MarkerWriter(DataSourceWriter):
    """A file for each task with the map of its rows; of equal keys in a task the last stays."""

    def __init__(self, schema: StructType, options: dict):
        self.path = options["path"].rstrip("/")

    def write(self, iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        out: dict[str, dict] = {}
        for r in iterator:
            fields = {"drop_sec": r["drop_sec"], "bpm": r["bpm"], "obs_used": r["observations"], "sample_path": r["sample_path"]}
            out.setdefault(r["section"], {})[r["key"]] = {k: v for k, v in fields.items() if v is not None}
        if out:
            put(f"{self.path}/part-{TaskContext.get().partitionId():05d}.json", json.dumps(out, sort_keys=True).encode())
        return WriterCommitMessage()


class MarkerMap(DataSource):
    @classmethod
    def name(cls) -> str:
        return "marker_map"

    def schema(self) -> str:
        return MARKERS

    def reader(self, schema: StructType) -> MarkerReader:
        return MarkerReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> MarkerWriter:
        if overwrite:
            clear(self.options["path"], ".json")
        return MarkerWriter(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session, and lets Spark push filters into them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NpzCache)
    spark.dataSource.register(MarkerMap)


def candidate_cache(spark: SparkSession, path: str, mode: str = "permissive") -> DataFrame:
    """Candidate caches: downbeats are the times where a cache has none, tempo and version 0."""
    register(spark)
    rows = spark.read.format("npz_cache").option("mode", mode).load(path)
    return rows.withColumns({"downbeats": F.coalesce("downbeats", "times"), "tempo_bpm": F.coalesce("tempo_bpm", F.lit(0.0).cast("float")), "version": F.coalesce("version", F.lit(0))})


def feature_cache(spark: SparkSession, path: str, schema: str, mode: str = "permissive") -> DataFrame:
    """Feature caches by the schema of the arrays that are wanted."""
    register(spark)
    return spark.read.format("npz_cache").schema(schema).option("mode", mode).load(path)


def marker_database(spark: SparkSession, path: str, least_sec: float = 1.0, section: str = "exact", mode: str = "permissive") -> DataFrame:
    """track, drop_sec, bpm, observations, source_path: entries of a section at `least_sec` or later; the track is the sample's path, else the key."""
    register(spark)
    rows = spark.read.format("marker_map").option("mode", mode).load(path)
    kept = rows.where((F.col("section") == section) & (F.col("drop_sec") >= float(least_sec)))
    named = F.coalesce(F.nullif("sample_path", F.lit("")), F.col("key"))
    return kept.select(named.alias("track"), "drop_sec", "bpm", "observations", F.col("file").alias("source_path"))


def save(rows: DataFrame, path: str, form: str, mode: str = "append") -> None:
    """Writes npz_cache or marker_map files; `overwrite` removes what is there first."""
    register(rows.sparkSession)
    rows.write.format(form).mode(mode).save(path)
