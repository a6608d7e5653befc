"""Keeping search statistics current from a stream of new segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators.index import build_postings, corpus_stats


def stream_postings(fields: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch's postings and segment lengths; a batch that runs again replaces its own folder.

    Document frequencies and the average length are sums over these tables (``current_stats``),
    so late data needs no watermark.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        tables = build_postings(batch)
        for name in ("postings", "segment_stats"):
            tables[name].write.mode("overwrite").parquet(f"{out}/{name}/epoch={epoch}")

    return fields.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_stats(spark, out: str) -> dict[str, DataFrame]:
    postings, stats = (spark.read.parquet(f"{out}/{n}").drop("epoch") for n in ("postings", "segment_stats"))
    return {
        "postings": postings, "segment_stats": stats, "term_stats": postings.groupBy("term").agg(F.count("*").alias("df")),
        "corpus_stats": corpus_stats(stats.agg(F.count("*").alias("n_segments"), F.sum("n_tokens").alias("total_tokens"))),
    }
