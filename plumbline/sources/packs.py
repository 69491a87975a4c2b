"""Keyed record sets: a Parquet table and a header written after it.

A pack without a header was not finished, and is not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import fixed
from plumbline.operators.joins import group_members

SCHEMA = T.StructType([
    T.StructField("ord", T.LongType()), T.StructField("key", T.StringType()), T.StructField("writer_id", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("split", T.StringType()), T.StructField("image", T.BinaryType()),
])
HEADER_SCHEMA = (
    "format_version int, height int, charset string, source string, count bigint, writers bigint, config map<string,string>"
)


class PackError(ValueError):
    """A pack that cannot be written or read."""


def pack_write(
    df: DataFrame, path: str, height: int, charset: str = "english", source: str = "", config: dict[str, str] | None = None,
    record_height: Column | None = None, files: int | None = None,
) -> DataFrame:
    """Write records (ord, key, writer_id, text, split, image) and return the header.

    A record of another height than the pack's stops the write. A repeated key is
    refused. Files are cut by key range, so looking a key up reads few of them.
    """
    spark = df.sparkSession
    rows = df
    if record_height is not None:
        told = F.concat(F.col("key"), F.lit(": height "), record_height.cast("string"), F.lit(f" is not the pack's {height}"))
        rows = rows.where(F.when(record_height == height, True).otherwise(F.raise_error(told).cast("boolean")))
    rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMA])
    clear(spark, f"{path}/header")
    ranged = rows.repartitionByRange(files, "key") if files else rows.repartitionByRange("key")
    ranged.sortWithinPartitions("key").write.mode("overwrite").parquet(f"{path}/records")

    written = spark.read.schema(SCHEMA).parquet(f"{path}/records")
    repeated = [r["key"] for r in written.groupBy("key").count().where("count > 1").limit(3).collect()]
    if repeated:
        raise PackError(f"keys written twice, e.g. {repeated}")
    facts = written.agg(F.count(F.lit(1)).alias("count"), F.count_distinct("writer_id").alias("writers"))
    settings = F.create_map(*[F.lit(x) for kv in (config or {}).items() for x in kv]) if config else F.create_map()
    header = facts.select(
        F.lit(fixed.PACK_VERSION).alias("format_version"), F.lit(height).alias("height"), F.lit(charset).alias("charset"),
        F.lit(source).alias("source"), "count", "writers", settings.cast("map<string,string>").alias("config"),
    )
    header.coalesce(1).write.mode("overwrite").parquet(f"{path}/header")
    return read_header(spark, path)


def clear(spark: SparkSession, path: str) -> None:
    """Take the old header away first, so a stopped rewrite does not look finished."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_header(spark: SparkSession, path: str) -> DataFrame:
    if not _exists(spark, f"{path}/header/_SUCCESS"):
        raise PackError(f"{path} has no header: still being written, or left unfinished")
    header = spark.read.schema(HEADER_SCHEMA).parquet(f"{path}/header")
    version = header.select("format_version").first()[0]
    if version != fixed.PACK_VERSION:
        raise PackError(f"{path} has format {version}, this reads {fixed.PACK_VERSION}")
    return header


def pack_read(spark: SparkSession, path: str) -> DataFrame:
    """All records; ``orderBy("ord")`` gives the order they were added in."""
    read_header(spark, path)
    return spark.read.schema(SCHEMA).parquet(f"{path}/records")


def pack_get(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The record with ``key``; an unknown key is refused."""
    found = pack_read(spark, path).where(F.col("key") == key)
    if found.limit(1).count() == 0:
        raise KeyError(f"{key} is not in {path}")
    return found


def pack_groups(spark: SparkSession, path: str) -> DataFrame:
    """(writer_id, part, n, keys) from the key columns alone; long lists come in parts."""
    return group_members(pack_read(spark, path).select("writer_id", "key"), ["writer_id"], "key")


def is_complete(spark: SparkSession, path: str) -> bool:
    try:
        read_header(spark, path)
    except PackError:
        return False
    return _exists(spark, f"{path}/records/_SUCCESS")


def pack_size(spark: SparkSession, path: str) -> DataFrame:
    """One row: files and bytes the records take, from the listing."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{path}/records").select("length")
    return listed.agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def pack_compact(
    spark: SparkSession, path: str, destination: str, bytes_per_file: int = 256 * 1024 * 1024, files: int | None = None
) -> DataFrame:
    """Rewrite a pack into files of about ``bytes_per_file``, or into ``files`` of them; returns the new header.

    A file is one task's, which sorts its records outside memory and writes them row group by row group.
    """
    header = read_header(spark, path).first()
    if files is None:
        size = pack_size(spark, path).first()["bytes"] or 0
        files = max(1, -(-size // bytes_per_file))
    return pack_write(
        pack_read(spark, path), destination, header["height"], header["charset"], header["source"], dict(header["config"]), files=files
    )
