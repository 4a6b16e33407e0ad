"""Documents as a stream: the same per-row plans, batch by batch, each input converted once. An addition of this library.

What has been converted is known from the output itself, not from a state that grows: each batch is joined with the digests that the
batches before it left, and written into a folder of its own, so that a batch that runs again replaces what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import emit

SCHEMA = "doc_id long, text string"


def source(spark: SparkSession, path: str, per_batch: int = 100) -> DataFrame:
    """A folder of Parquet files as they come."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_batch).parquet(path)


def _known(spark: SparkSession, out: str, batch: int) -> DataFrame:
    """Digests of the inputs of earlier batches."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "sha256_input string")
    return spark.read.schema("sha256_input string, batch long").option("basePath", out).parquet(out).where(F.col("batch") < batch).select("sha256_input")


def convert(stream: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Writes each new input's markdown to ``out``, a table split by batch; equal inputs are converted once, the least doc_id's."""

    def one(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        fresh = rows.withColumn("_sha", F.sha2(F.coalesce("text", F.lit("")), 256))
        fresh = fresh.join(_known(spark, out, batch).withColumnRenamed("sha256_input", "_sha"), "_sha", "left_anti")
        first = fresh.groupBy("_sha").agg(F.min_by(F.struct("doc_id", "text"), "doc_id").alias("d")).select("d.*")
        emit.wrapped_markdown(first).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    w = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
