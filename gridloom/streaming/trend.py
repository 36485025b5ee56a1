"""A stream of runs kept as a rolling trend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.sources.reports import TREND_RUNS, last_runs


def keep_trend(runs: DataFrame, path: str, checkpoint: str, keep: int = TREND_RUNS) -> StreamingQuery:
    """Appends each batch of ``(graph_id, ts, ...)``; versions are folders, so a batch that is run again replaces its own."""

    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        seq = F.lit(epoch).cast("long") * (1 << 40) + F.monotonically_increasing_id()
        new = df.withColumn("append_seq", seq)
        if epoch:
            new = spark.read.parquet(f"{path}/v{epoch - 1}").unionByName(new)
        last_runs(new, keep).write.mode("overwrite").parquet(f"{path}/v{epoch}")

    return runs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
