"""Streams of documents: a folder that fills up is guided batch by batch, and usage of templates is kept per document.

The reference semantics are per document and ordered, so state is keyed by the
document and never shared.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import patterns as P
from ..plans import guide
from ..sources.files import validated


def document_stream(spark: SparkSession, path: str) -> DataFrame:
    """Rows of read_corpus, from files as they come."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return validated(spark.readStream.schema(schema).format("binaryFile").option("pathGlobFilter", "*.{md,txt}").option("recursiveFileLookup", "true").load(path))


def guide_stream(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Guides every batch and appends its reports; each batch is written once by its number."""
    def batch(df: DataFrame, number: int) -> None:
        docs = df.where("problem is null").select(F.col("path").alias("doc_id"), "text")
        guide.report(docs).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


USAGE = "doc_id string, block_id int, family string, uses_before int"


def _usage(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    uses = dict(zip(P.TEMPLATE_CONNECTORS, state.get, strict=True)) if state.exists else dict.fromkeys(P.TEMPLATE_CONNECTORS, 0)
    rows = []
    for b in sorted((r for f in frames for r in f.itertuples(index=False)), key=lambda r: r.block_id):
        for word in P.TEMPLATE_CONNECTORS:
            n = b.text.count(word)
            if n:
                rows.append((key[0], b.block_id, word, uses[word]))
                uses[word] += n
    state.update(tuple(uses.values()))
    yield pd.DataFrame(rows, columns=["doc_id", "block_id", "family", "uses_before"])


def template_usage(blocks: DataFrame) -> DataFrame:
    """How often a document has used a template word before each of its blocks; the counts live on across batches."""
    columns = ", ".join(f"n{i} int" for i in range(len(P.TEMPLATE_CONNECTORS)))
    return blocks.groupBy("doc_id").applyInPandasWithState(_usage, USAGE, columns, "append", GroupStateTimeout.NoTimeout)


def event_windows(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Counts and sums of events by tumbling window and type, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
