"""Portable bundles: tables as JSON lines with a manifest of counts and digests; import checks both and may remap ids."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.streaming.streams import shared_folder


def digest(df: DataFrame) -> DataFrame:
    """(rows, digest): the sum of the rows' SHA-256 values (60 bits of each), which their order does not change but any row
    more, less or other does, equal ones included."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    number = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(number).cast("string"), F.lit("0")).alias("digest"))


def export_bundle(tables: dict[str, DataFrame], path: str) -> None:
    manifest = None
    for name, df in tables.items():
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}.jsonl")
        row = digest(df).withColumn("name", F.lit(name))
        manifest = row if manifest is None else manifest.unionByName(row)
    if manifest is not None:
        manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")  # one row a table


def import_bundle(spark: SparkSession, path: str, schemas: dict[str, object]) -> dict[str, DataFrame]:
    """The tables; ValueError where a table's rows are not those of the manifest."""
    manifest = {r["name"]: (r["rows"], r["digest"]) for r in spark.read.schema("name string, rows long, digest string").json(f"{path}/manifest").collect()}
    out = {}
    for name, schema in schemas.items():
        df = spark.read.schema(schema).json(f"{path}/{name}.jsonl")
        got = digest(df).first()
        if manifest.get(name) != (got["rows"], got["digest"]):
            raise ValueError(f"{name}: the rows are not those of the manifest")
        out[name] = df
    return out


def remap(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """df with the column's ids replaced by ids (old, new); ids without a partner stay."""
    rows = df.join(ids.select(F.col("old").alias(column), F.col("new").alias("__new")), column, "left")
    return rows.withColumn(column, F.coalesce("__new", column)).drop("__new").select(*df.columns)


def round_trip(spark: SparkSession, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    path = shared_folder(spark)
    export_bundle(tables, path)
    return import_bundle(spark, path, {name: df.schema for name, df in tables.items()})
