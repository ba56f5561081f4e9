"""Analysis of a stream of sentences. Sentences are independent, so each micro-batch goes
through the batch plan; there is no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.plans.analyse import analyse


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(source, text): the lines of text files as they arrive."""
    return spark.readStream.format("text").load(folder).select(F.input_file_name().alias("source"), F.col("value").alias("text"))


def write_analysed(lines: DataFrame, words: DataFrame, out: str, checkpoint: str, output: str = "segmented"):
    """Starts a query that writes each batch's (source, id, out) under out/batch=N. A batch that
    is run again overwrites its own folder, so each line is written once, equal ones too. The id
    numbers lines within a batch; the batch is kept while it is analysed, so ids don't change."""

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("id", F.monotonically_increasing_id()).persist()
        analyse(rows, words, ["source", "id"], output).write.mode("overwrite").parquet(f"{out}/batch={number}")
        rows.unpersist()

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
