"""Writers: append-only logs, fixed-column CSV, JSON lines, grid rows, partitioned tables, and tables that are replaced as a whole."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def append_log(rows: DataFrame, path: str) -> None:
    """Adds JSON lines; what is there stays."""
    rows.write.mode("append").json(path)


def jsonl(rows: DataFrame, path: str) -> None:
    """JSON lines in place of what was there; keys sorted."""
    rows.select(*sorted(rows.columns)).write.mode("overwrite").json(path)


def summary_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with exactly these columns, in this order; missing ones are empty."""
    rows.select(*(F.col(c).cast("string").alias(c) if c in rows.columns else F.lit("").alias(c) for c in columns)).write.mode("overwrite").option("header", True).csv(path)


def beat_grid(rows: DataFrame, path: str, key: str = "track", beats: str = "beats") -> None:
    """CSV of (track, index, time), one row per beat."""
    rows.select(key, F.posexplode(beats).alias("index", "time")).write.mode("overwrite").option("header", True).csv(path)


def partitioned(rows: DataFrame, path: str, by: list[str], files: int = 1) -> None:
    """Parquet folders by value; rows of a value are dealt to `files` files, so a hot value is written by several tasks."""
    rows.withColumn("_deal", F.pmod(F.xxhash64(*rows.columns), F.lit(files))).repartition(*by, "_deal").drop("_deal").write.mode("overwrite").partitionBy(*by).parquet(path)


POINTER = "_current"


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder of the table's present version; null before the first one."""
    pointer, files = _files(spark, f"{path}/{POINTER}")
    if not files.exists(pointer):
        return None
    stream = files.open(pointer)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def replace_whole(rows: DataFrame, path: str, keep: int = 2) -> str:
    """Puts the rows in place of the table at `path` as a whole, and returns the new version's folder.

    The rows are written to a folder of their own; then a pointer file is written aside and renamed over the old one, which the file system does in one
    step. Whoever reads finds the old version or the new one; a write that fails leaves the old. The last `keep` versions stay for readers that began
    before. One writer at a time.
    """
    spark = rows.sparkSession
    version = f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    rows.write.parquet(f"{path}/{version}")
    aside, files = _files(spark, f"{path}/.{POINTER}-{uuid.uuid4().hex}")
    out = files.create(aside, True)
    try:
        out.write(version.encode())
    finally:
        out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    modes = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    modes[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(aside.toUri(), spark._jsc.hadoopConfiguration()).rename(aside, hadoop.Path(f"{path}/{POINTER}"), modes)
    folder = hadoop.Path(path)
    old = sorted(s.getPath().getName() for s in files.listStatus(folder) if s.isDirectory() and s.getPath().getName().startswith("v-"))
    whole = [name for name in old if files.exists(hadoop.Path(f"{path}/{name}/_SUCCESS"))]
    for name in set(old) - set(whole[-max(keep, 1) :]) - {version}:  # also what failed writes left
        files.delete(hadoop.Path(f"{path}/{name}"), True)
    return version


def read_whole(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The table's present version; no rows before the first one."""
    version = current_version(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/{version}") if version else spark.createDataFrame([], schema)


def queue_artifacts(rows: DataFrame, folder: str, parts: dict[str, Column], columns: list[str]) -> dict[str, int]:
    """One CSV folder for each part with the rows that its condition holds for, and `summary` (JSON lines) with each part's count; returns the counts.

    A row may be in several parts. Every row gets the list of its parts once, so conditions are judged in one pass and counts agree with what is written.
    """
    named = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in parts.items())))
    put = rows.withColumn("_part", F.explode(named))
    shown = [F.col(c).cast("string").alias(c) if c in rows.columns else F.lit("").alias(c) for c in columns]
    put.select("_part", *shown).write.mode("overwrite").partitionBy("_part").option("header", True).csv(f"{folder}/parts")
    spark = rows.sparkSession
    kinds = ", ".join(f"`{c}` string" for c in columns)
    counted = spark.read.schema(f"{kinds}, _part string").option("header", True).csv(f"{folder}/parts").groupBy("_part").count().collect()
    counts = dict.fromkeys(parts, 0) | {r["_part"]: r["count"] for r in counted}
    jsonl(spark.createDataFrame(list(counts.items()), "part string, n long"), f"{folder}/summary")
    return counts
