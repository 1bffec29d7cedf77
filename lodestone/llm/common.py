"""What several operators share: reading, cutting lineage, Arrow helpers."""

import tempfile
import uuid
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_folders: "WeakKeyDictionary[DataFrame, str]" = WeakKeyDictionary()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of our own only where none is set, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own[app]


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, drop_shuffles: bool = False) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage and survives lost executors. With drop_shuffles, the shuffle
    files that writing took are deleted with the table's last row, not when the driver collects garbage."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    if drop_shuffles:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if drop_shuffles:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables made by `written` which nothing reads any more."""
    for df in tables:
        if df is not None and (path := _folders.pop(df, None)):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def bounded_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Marks df for broadcast if its counted rows stay below the limit; otherwise Spark shuffles it."""
    return F.broadcast(df) if rows <= limit else df


def texts(batch: pa.RecordBatch | pa.Table, name: str = "text") -> list[bytes]:
    """A text column as UTF-8 bytes; null as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def small(batches, rows: int = 512):
    """The batches in slices, so that a task holds few rows at once as Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df has it (whatever its case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
