"""Scans and sinks of files: JSON lines, source trees, manifests and staged writes."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engine.functions.text import file_type
from engine.operators.statistics import last_rows, nearest_root

#: Folders that a tree scan leaves out, in any case.
PRUNED = ["intermediate", "binaries", "saved", "deriveddatacache", ".git", ".svn"]


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str, required: list[str] | None = None) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, a broken line or a null in a required field ends the read with an error that shows the line."""
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("x"), F.input_file_name().alias("_file"))
    bad = F.col("x").isNull() | F.try_parse_json("value").isNull()
    for name in required or []:
        bad = bad | F.col(f"x.{name}").isNull()
    checked = F.when(bad, F.raise_error(F.concat(F.lit("not a valid record in "), "_file", F.lit(": "), F.substring("value", 1, 200)))).otherwise(F.col("x"))
    return lines.select(checked.alias("x")).select("x.*")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, a JSON array or a single JSON object, as one row for each object."""
    return spark.read.option("multiLine", path.endswith(".json")).json(path)


def scan_tree(spark: SparkSession, root: str, version: str, hidden: list[str] | None = None) -> DataFrame:
    """relative_path, module, plugin, file_type, engine_version, size and sha256 of the source files below a folder.

    Folders of `hidden` are left out, whatever their case, and below Plugins files count only under a Source folder. The module is that of the nearest build file above, else
    the folder after Source; the plugin that of the nearest descriptor above.
    """
    root = root.rstrip("/")
    skipped = "|".join(x.replace(".", r"\.") for x in (hidden or PRUNED))
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", f"^(?:file:/*)?/*{root.removeprefix('file:').lstrip('/')}/", "")
    every = every.select(path.alias("path"), "length", "content").where(~F.col("path").rlike(f"(?i)(^|/)({skipped})/"))
    files = every.where(file_type("path").isNotNull() & (~F.col("path").rlike(r"(?i)(^|/)plugins/") | F.col("path").rlike(r"(?i)/source/")))
    dirname, stem = F.regexp_replace("path", r"/?[^/]*$", ""), F.regexp_extract("path", r"([^/]*?)(?:\.[Bb]uild\.[Cc][Ss]|\.[^./]*)$", 1)
    built = every.where(F.lower("path").endswith(".build.cs")).select(dirname.alias("root"), stem.alias("module")).distinct()
    described = every.where(F.lower("path").rlike(r"\.[a-z]*plugin$")).select(dirname.alias("root"), stem.alias("module")).distinct()
    names = files.select("path").distinct()
    modules, plugins = nearest_root(names, built), nearest_root(names, described).withColumnRenamed("module", "plugin")
    rows = files.join(modules, "path", "left").join(plugins, "path", "left")
    fallback = F.nullif(F.regexp_extract("path", r"(?i)(?:^|/)source/(?:(?:runtime|editor|developer|programs)/)?([^/]+)/", 1), F.lit(""))
    return rows.select(
        F.col("path").alias("relative_path"), F.coalesce("module", fallback).alias("module"), "plugin", file_type("path").alias("file_type"), F.lit(version).alias("engine_version"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"),
    )


def check_root(root: str | Path, *needed: str) -> Path:
    """The root as a full path; an error if it or one of the folders needed isn't there or lies outside of it."""
    full = Path(root).resolve()
    for name in ("", *needed):
        part = (full / name).resolve()
        if not part.is_dir() or not part.is_relative_to(full):
            raise FileNotFoundError(f"{full / name} isn't a folder of the root")
    return full


def read_manifest(spark: SparkSession, path: str, key: str, order: str, status: str | None = None) -> DataFrame:
    """The last record of each key, and only then those of a status."""
    last = last_rows(spark.read.json(path), [key], [order])
    return last.where(F.col("status") == status) if status else last


def write_staged(rows: DataFrame, path: str) -> None:
    """Written aside and moved into place at the end, so that a reader sees the old rows or the new ones, and a path that is being read can be replaced."""
    spark = rows.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    aside, old = f"{path}.{uuid.uuid4().hex}.new", f"{path}.{uuid.uuid4().hex}.old"
    rows.write.parquet(aside)
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(hadoop(path)):
        fs.rename(hadoop(path), hadoop(old))
    fs.rename(hadoop(aside), hadoop(path))
    fs.delete(hadoop(old), True)


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").json(path)


def write_text(path: str, text: str) -> None:
    """A small file, replaced at once."""
    aside = f"{path}.{uuid.uuid4().hex}"
    Path(aside).write_text(text, encoding="utf-8")
    os.replace(aside, path)


def unique_across(rows: DataFrame, key: str) -> DataFrame:
    """The rows, with an error if a key comes twice."""
    twice = rows.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{key} comes twice: {twice[0][0]}")
    return rows


def report_markdown(averages: DataFrame) -> str:
    """A table of figures, one line for each row; for reports of a few rows."""
    rows = [r.asDict() for r in averages.collect()]
    names = list(rows[0]) if rows else averages.columns
    show = lambda x: f"{x:.4f}" if isinstance(x, float) else str(x)
    return "\n".join(["| " + " | ".join(names) + " |", "|" + " --- |" * len(names), *("| " + " | ".join(show(r[n]) for n in names) + " |" for r in rows)])


def script_json(text: str) -> str:
    """JSON that can stand within a script of a page."""
    return text.replace("&", "\\u0026").replace("<", "\\u003c").replace(">", "\\u003e").replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")
