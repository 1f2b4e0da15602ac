"""Classification of documents as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from docketry import catalog as C
from docketry.operators import classify as K


def stream_types(docs: DataFrame) -> DataFrame:
    """Regex-and-detector classification of a stream; needs no state."""
    return K.classify_regex(docs)


def stream_documents(
    docs: DataFrame, out: str, checkpoint: str, threshold: float = C.FUZZY_THRESHOLD, once: bool = True
) -> StreamingQuery:
    """Full classification, one micro-batch at a time, into Parquet under ``out``.

    Each batch owns a folder named by its id, so a batch that is repeated after a failure replaces itself.  A batch of
    fewer partitions than cores, such as one file that no split size divides, is spread over all of them.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        cores = batch.sparkSession.sparkContext.defaultParallelism
        if batch.rdd.getNumPartitions() < cores:
            batch = batch.repartition(cores)
        K.classify(batch, threshold).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
