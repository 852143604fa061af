"""What the training-data operators share: the shared folder, tables in it, words and row keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of letters, digits and characters beyond ASCII, after A-Z became a-z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_FOLD = bytearray(range(256))
for _b in range(128):
    _c = chr(_b).lower()
    _FOLD[_b] = ord(_c) if _c.isalnum() else 32
FOLD = bytes(_FOLD)


def words(text: str | None) -> list[bytes]:
    """Lower-cased words of a text as UTF-8; a null text has none."""
    return text.encode("utf-8", "replace").translate(FOLD).split() if text else []


def trim() -> None:
    """Give back what a worker's allocators keep after a block: workers live on between tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset and all tasks are on this machine."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = sc.getCheckpointDir()
        if not held and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        path = held.rsplit("/", 1)[0] if held else tempfile.mkdtemp(prefix="gleaner-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gleaner-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove the files of a table made by written()."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """df's rows over at least as many partitions as there are cores, without a shuffle where they are already."""
    spark = df.sparkSession
    n = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *cols: str) -> DataFrame:
    """The named columns alone, by exact name, so that further columns with like names do no harm."""
    return df.select(*[F.col(f"`{c}`") for c in cols])
