"""Suffix arrays of texts as they arrive. A text's array depends on that text alone, so a stream of
texts is indexed batch by batch; a batch that runs again replaces its own rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from suffloom.operators.suffix_array import suffixes


def index_stream(texts: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts a query that writes suffixes of streamed (text_id, bytes) rows below path, a folder for each batch."""

    def write(batch: DataFrame, number: int) -> None:
        suffixes(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    out = texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()
