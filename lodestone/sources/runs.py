"""Runs that write several tables under one commit, and versioned copies that a pointer is swapped to.

A root folder has a folder for each version of each table and a manifest: one row for each table and run, naming the folder that
holds the table as of that run. A run writes its folders first and its manifest rows last, in one file that the commit of
Spark's writer makes visible at once; so readers, who take the newest run in the manifest, see all of a run or
nothing. Folders of a run that never committed are written over when it is repeated; a committed run is not repeated.
Runs of one root come one after the other; the caller sees to that.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.flow import replace_documents

MANIFEST = "run long, name string, path string"


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(run, name, path) of all committed runs."""
    return _stored(spark, f"{root}/manifest", MANIFEST)


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def current(spark: SparkSession, root: str, run: int | None = None) -> dict[str, str]:
    """The folder of each table as of the newest run, or of the given one."""
    rows = manifest(spark, root).where(F.lit(True) if run is None else F.col("run") == run)
    last = rows.agg(F.max("run").alias("run"))
    return {r["name"]: r["path"] for r in rows.join(F.broadcast(last), "run").collect()}  # a row for each table


def newest(spark: SparkSession, root: str) -> int | None:
    return manifest(spark, root).agg(F.max("run")).first()[0]


def read(spark: SparkSession, root: str, name: str, run: int | None = None) -> DataFrame:
    """A table as of the newest run, or of the given one."""
    path = current(spark, root, run).get(name)
    if path is None:
        raise ValueError(f"no committed run has a table {name}")
    return spark.read.parquet(f"{root}/{path}")


def publish(spark: SparkSession, root: str, run: int, paths: dict[str, str]) -> None:
    """Commits a run: tables that it does not name stay as they are."""
    rows = sorted((current(spark, root) | paths).items())
    spark.createDataFrame([(run, n, p) for n, p in rows], MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def write_run(spark: SparkSession, root: str, run: int, tables: dict[str, DataFrame], document: str | None = None) -> bool:
    """Writes and commits a run; False if it, or a later one, is committed already. With `document`, the tables hold the rows of some
    documents, which replace all stored rows of those documents; without, whole tables."""
    last = newest(spark, root)
    if last is not None and run <= last:
        return False
    have, paths = current(spark, root), {}
    for name, fresh in tables.items():
        path = f"{name}/run={run}"
        if document and name in have:
            fresh = replace_documents(spark.read.parquet(f"{root}/{have[name]}"), fresh, document)
        fresh.write.mode("overwrite").parquet(f"{root}/{path}")
        paths[name] = path
    publish(spark, root, run, paths)
    return True


def digest(df: DataFrame) -> tuple[int, int]:
    """Rows, and a sum of row hashes that does not depend on their order."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def backfill(spark: SparkSession, root: str, name: str, key: str, derive, version: int, parts: int = 16) -> bool:
    """Rewrites a table by `derive` (a function of a DataFrame) into a new version, part by part, and swaps the pointer to it.

    A part is the rows of one hash of the key, written in one folder and then noted as done with its rows and digest. After
    an interruption the next call takes up with the parts that are not noted. The pointer moves only when all parts are
    there and each reads back as it was noted; it is kept on the rows that the first call began with, so a table that got a newer run
    meanwhile is refused. False if the version is committed already."""
    done = f"{root}/backfill/{name}-{version}"
    base = newest(spark, root)
    if base is not None and version <= base:
        return False
    noted = {r["part"]: r for r in _stored(spark, done, "part int, base long, n long, h decimal(38,0)").collect()}  # a row a part
    if any(r["base"] != base for r in noted.values()):
        raise ValueError(f"{name} has another run than the backfill began with; take a new version")
    source = read(spark, root, name)
    part_of = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    for part in range(parts):
        folder = f"{root}/{name}/run={version}/part={part}"
        if part in noted:
            continue
        derive(source.where(part_of == part)).write.mode("overwrite").parquet(folder)
        n, h = digest(spark.read.parquet(folder))
        spark.createDataFrame([(part, base, n, h)], "part int, base long, n long, h string").withColumn("h", F.col("h").cast("decimal(38,0)")).coalesce(1).write.mode("append").parquet(done)
    want = _stored(spark, done, "part int, base long, n long, h decimal(38,0)").agg(F.sum("n").alias("n"), F.sum("h").alias("h")).first()
    whole = spark.read.parquet(f"{root}/{name}/run={version}").drop("part")
    if digest(whole) != (want["n"], int(want["h"] or 0)):
        raise ValueError(f"version {version} of {name} does not read back as it was written")
    publish(spark, root, version, {name: f"{name}/run={version}"})
    return True
