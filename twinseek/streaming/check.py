"""Checking newly arriving units against a fixed corpus, or against one that takes them in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from twinseek.operators.match import build_index, match_index
from twinseek.operators.stored_index import StoredIndex
from twinseek.operators.thresholds import ThresholdConfig


def stream_check(
    arrivals: DataFrame,
    corpus: DataFrame,
    out_path: str,
    checkpoint_path: str,
    measure: str = "jaccard_tokens",
    thresholds: ThresholdConfig | None = None,
    allow_wide: bool = False,
) -> StreamingQuery:
    """Matches every micro-batch of `arrivals` (a streaming units table) against `corpus`.

    All files available at the start are worked off, then the query stops. Each batch owns one folder of the output
    and overwrites it, so a batch repeated after a failure does not add rows twice. The corpus is indexed once, before the
    stream starts.
    """
    index = build_index(corpus, measure, thresholds, allow_wide)

    def check(batch: DataFrame, batch_id: int) -> None:
        match_index(index, batch).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    return (
        arrivals.writeStream.foreachBatch(check)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )


def stream_arrivals(
    arrivals: DataFrame, index: StoredIndex, out_path: str, checkpoint_path: str, stream: str = "arrivals"
) -> StreamingQuery:
    """Matches every micro-batch of `arrivals` against the stored corpus, all earlier batches and itself.

    A batch is first added to the index, as one version under the name of the stream and the number of the batch, then
    matched with that version. A batch that is repeated after a failure finds its version in the log: nothing is added twice,
    and it meets what it met the first time. A restart reads the log and the table of bucket counts, no text.
    """

    def check(batch: DataFrame, batch_id: int) -> None:
        version = index.append(batch, batch=f"{stream}:{batch_id}")
        index.match_added(version).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    return (
        arrivals.writeStream.foreachBatch(check)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )


def read_stream_matches(spark: SparkSession, out_path: str) -> DataFrame:
    """All matches written so far, with the batch they came from."""
    return spark.read.parquet(out_path)
