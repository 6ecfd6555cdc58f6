"""Documents that arrive over time: what is new is processed once, and late versions replace earlier ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def process_new(spark: SparkSession, source: str, schema: T.StructType, change: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, form: str = "parquet", per_batch: int = 1000) -> None:
    """Run `change` over the files of `source` that earlier runs haven't seen and append to `target`, then stop.

    The checkpoint keeps which files are done, so a run that breaks off goes on
    where it stopped and no file is processed twice.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).format(form).load(source)
    query = change(rows).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    query.awaitTermination()


def first_deliveries(stream: DataFrame, key: str, time: str, late: str = "30 days") -> DataFrame:
    """The first delivery of each key within the watermark; redelivered rows are dropped, and the state stays bounded by `late`."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def counts_by_period(stream: DataFrame, time: str, by: list[str], period: str = "1 day", late: str = "7 days") -> DataFrame:
    """Rows per period and group, each period final once the watermark has passed it."""
    counted = stream.withWatermark(time, late).groupBy(F.window(time, period), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("period"), *by, "n")


#: Parts by hash of the key that a table of last versions is kept in; a batch rewrites only those that it touches.
PARTS = 256


def _newest(spark: SparkSession, target: str, below: int | None = None) -> dict[int, int]:
    """The newest version of each part of `target`, of versions under `below` where given."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/v=*/part=*")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    newest: dict[int, int] = {}
    for status in found:
        version, part = (int(x.split("=")[1]) for x in status.getPath().toString().rstrip("/").split("/")[-2:])
        if below is None or version < below:
            newest[part] = max(version, newest.get(part, -1))
    return newest


def read_latest(spark: SparkSession, target: str, schema: T.StructType, parts: list[int] | None = None, below: int | None = None) -> DataFrame:
    """The rows that upsert_latest keeps, of all parts or those named."""
    paths = [f"{target}/v={v}/part={p}" for p, v in sorted(_newest(spark, target, below).items()) if parts is None or p in parts]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert_latest(spark: SparkSession, source: str, schema: T.StructType, key: str, order: str, target: str, checkpoint: str) -> None:
    """Keep one row per key, the last by `order`: the parts of `target` that a batch touches are merged with it into a new version of their own.

    A batch that runs again writes its version again; an empty one writes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        part = F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")
        touched = [r[0] for r in batch.select(part.alias("p")).distinct().collect()]  # at most PARTS
        if not touched:
            return
        rows = read_latest(spark, target, batch.schema, touched, number).unionByName(batch)
        last = rows.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        last.withColumn("part", part).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{target}/v={number}")

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(source)
    rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
