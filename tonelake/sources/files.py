"""Readers and sinks for files: delimited text, JSON, audio, manifests, checkpoints of units.

Schemas are always stated: nothing is inferred from data. Sinks write folders of parts, as Spark does.
"""

from __future__ import annotations

import io
import json
import wave
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonelake.functions.text import header_name  # noqa: F401  (the column form of `normal_header`)
from tonelake.sources.tables import require


def normal_header(name: str) -> str:
    """A header in lower case with single underscores for other characters than a-z 0-9."""
    import re

    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def _csv(spark: SparkSession):
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")


def read_strings(spark: SparkSession, path: str, required: list[str] | None = None, normalise: bool = False) -> DataFrame:
    """A delimited file with all columns as text; a byte order mark is no part of the first header. Raises ValueError naming missing columns."""
    df = _csv(spark).option("inferSchema", False).csv(path)
    names = [c.lstrip("﻿") for c in df.columns]
    df = df.toDF(*([normal_header(c) for c in names] if normalise else names))
    if required:
        require(df, required)
    return df


def read_typed(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A delimited file with a stated schema, matched by position; values that do not fit become null."""
    return _csv(spark).schema(schema).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """`read_typed`, or no rows of that schema where the file is missing."""
    return read_typed(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def first_existing(spark: SparkSession, root: str, *candidates: str) -> str:
    for c in candidates:
        if exists(spark, f"{root}/{c}"):
            return f"{root}/{c}"
    raise FileNotFoundError(f"none of {', '.join(candidates)} under {root}")


def catalogue(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """(name, path, present) of named sources."""
    return spark.createDataFrame([(n, p, exists(spark, p)) for n, p in sources.items()], "name string, path string, present boolean")


def append(*frames: DataFrame) -> DataFrame:
    """All rows of several sources by column name; absent columns are null."""
    out = frames[0].select("*")
    for f in frames[1:]:
        out = out.unionByName(f.select("*"), allowMissingColumns=True)
    return out


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_csv(df: DataFrame, path: str, columns: list[str], digits: int = 12) -> None:
    """Declared columns only; doubles with `digits` significant digits, not finite ones empty; booleans in lower case."""
    shown = []
    types = dict(df.dtypes)
    for c in columns:
        if types[c] in ("double", "float"):
            shown.append(F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.format_string(f"%.{digits}g", F.col(c))).alias(c))
        else:
            shown.append(F.col(c).cast("string").alias(c))
    df.select(*shown).write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def write_report(report: dict, path: str) -> None:
    """A small report of the driver as JSON."""
    Path(path).write_text(json.dumps(report, indent=2, sort_keys=True, ensure_ascii=False, default=str) + "\n", encoding="utf-8")


def markdown_table(df: DataFrame, most: int = 10_000) -> str:
    """A small table as Markdown, whole; ValueError beyond `most` rows."""
    head = df.limit(most + 1).collect()
    if len(head) > most:
        raise ValueError(f"more than {most} rows are no report")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in head])


def manifest(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256) of all files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def decode_wav(content: bytes, seconds: float | None = None) -> tuple[int, np.ndarray]:
    """(rate, samples by channel in -1..1) of a PCM wave file of 8, 16, 24 or 32 bits or of floats; raises ValueError for anything else."""
    try:
        with wave.open(io.BytesIO(content)) as w:
            rate, width, channels = w.getframerate(), w.getsampwidth(), w.getnchannels()
            raw = w.readframes(w.getnframes() if seconds is None else min(w.getnframes(), int(seconds * rate)))
    except (wave.Error, EOFError) as e:
        if "unknown format: 3" in str(e):
            from tonelake.sources.packages import decode_float_wav

            rate, x = decode_float_wav(content)
            return rate, x if seconds is None else x[:, : int(seconds * rate)]
        raise ValueError(str(e)) from e
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, {2: np.int16, 4: np.int32}[width]).astype(np.float64) / float(1 << (8 * width - 1))
    return rate, x.reshape(-1, channels).T


def read_wav(spark: SparkSession, root: str, seconds: float | None = None) -> DataFrame:
    """(path, rate, channels, samples, problem): decoded audio of a folder, a row per file; unreadable or empty files carry the problem."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(root).select("path", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rate, x = decode_wav(content, seconds)
                    problem = "empty" if not x.size else None
                    out.append((path, rate, len(x), [c.tolist() for c in x], problem))
                except ValueError as e:
                    out.append((path, None, None, None, str(e)))
            got = pd.DataFrame(out, columns=["path", "rate", "channels", "samples", "problem"])
            yield got.astype({"rate": "Int32", "channels": "Int32"})

    return files.mapInPandas(decode, "path string, rate int, channels int, samples array<array<double>>, problem string")


def save_unit(df: DataFrame, path: str, run: str) -> None:
    """Appends a unit of work to a checkpoint table, partitioned by the run's tag."""
    df.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(path)


def saved_units(spark: SparkSession, path: str, run: str) -> DataFrame | None:
    """The units that a run has saved; None before the first."""
    if not exists(spark, path):
        return None
    return spark.read.parquet(path).where(F.col("run") == run).drop("run")
