"""Table access, cutting of lineage, and joins whose small side is broadcast only after a check of its size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a side may be broadcast after both were checked.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: Tasks over which one key of the large side is spread where the small side is not small.
SALTS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` under `sf_dir` (a file or a folder of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session. Only a local session may go without: it gets a temporary one."""
    at = spark.sparkContext.getCheckpointDir()
    if at:
        return at
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="tonelake-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """`df` written as a table to the shared checkpoint folder and read from there: its lineage is cut and survives lost executors.

    `release` deletes the table once nothing refers to it any more.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """`df`, persisted, with a broadcast hint if it holds at most `rows` rows and `size` bytes, and whether it does."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    # the count fills the store, whose statistics then are the measured bytes
    small = kept.count() <= rows and int(str(kept._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= size
    out = F.broadcast(kept) if small else kept
    out._kept, out._small = kept, small
    return out, small


def release(*frames: DataFrame | None) -> None:
    """Give up what `bounded` persisted and what `cut` wrote for these frames."""
    for f in frames:
        kept, path = getattr(f, "_kept", None), getattr(f, "_cut_path", None)
        if kept is not None:
            kept.unpersist()
        if path is not None:
            jvm = f.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(f.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def join_small(large: DataFrame, small: DataFrame, on: list[str], spread_by: str, how: str = "inner", rows: int = BROADCAST_ROWS, salts: int = SALTS, held: list[DataFrame] | None = None) -> DataFrame:
    """`large` joined with a side that usually is small: broadcast if it is, else each of its rows is repeated for `salts` parts of its key's rows.

    So a key that holds a third of all rows is spread over `salts` tasks. `spread_by` is a column of `large` that varies within a key.
    `small` may come from `bounded` already; what is persisted here goes to `held`, for `release`.
    """
    if hasattr(small, "_kept"):
        side, fits = small, small._small
    else:
        side, fits = bounded(small, rows)
        if held is not None:
            held.append(side)
    return join_known(large, side, on, spread_by, fits, how, salts)


def join_known(large: DataFrame, small: DataFrame, on: list[str], spread_by: str, fits: bool, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """`join_small` where it is known already whether the small side may be broadcast; nothing is run or persisted."""
    if fits:
        return large.join(F.broadcast(small), on, how)
    salted = large.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def text_rows(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches, so that what a Python worker makes of long texts stays small. Spark itself bounds a batch's bytes."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)


def require(df: DataFrame, columns: Iterable[str]) -> None:
    """Raise ValueError naming the required columns that `df` lacks."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
