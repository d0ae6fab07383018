"""Reading and writing grids, samples, fits and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))


def write_table(df: DataFrame, path: str, key: str | None = "grid_id", buckets: int = 64,
                fmt: str = "parquet", overwrite: bool = False, salts: int = 4) -> None:
    """Write a table, split into directories by a hash bucket of its key.

    A table that is already complete (its success marker exists) is kept unless
    overwrite is set.  One shuffle brings a bucket's rows together, spread over `salts` files.
    """
    if exists(df.sparkSession, path) and not overwrite:
        return
    if fmt == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    elif key is None:
        df.write.mode("overwrite").format(fmt).save(path)
    else:
        salt = F.pmod(F.xxhash64(*[F.col(c) for c, t in df.dtypes if "map" not in t]), F.lit(salts))
        (df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).repartition("bucket", salt)
         .write.mode("overwrite").partitionBy("bucket").format(fmt).save(path))


def read_table(spark: SparkSession, path: str, schema=None, fmt: str = "parquet",
               key=None, buckets: int = 64, first_n: int | None = None,
               order_by: str = "sample_id") -> DataFrame:
    """Read a table; `key` prunes to the key's bucket, `first_n` takes the first rows."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    if key is not None:
        name, value = key
        bucket = spark.range(1).select(
            F.pmod(F.xxhash64(F.lit(value)), F.lit(buckets)).cast("int")).first()[0]
        df = df.filter((F.col("bucket") == bucket) & (F.col(name) == value))
    df = df.drop("bucket")
    return df.orderBy(order_by).limit(first_n) if first_n is not None else df
