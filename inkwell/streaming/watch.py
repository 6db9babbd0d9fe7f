"""File watch: new and changed files flow into an index by Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from inkwell.constants import SEGMENT_MAX_DOCS
from inkwell.operators.index import Index
from inkwell.sources.files import SCHEMA, to_documents


def watch(index: Index, path: str, checkpoint: str, *, every: str | None = "500 milliseconds", patterns: Sequence[str] | None = None) -> StreamingQuery:
    """Starts a query that upserts every new or changed file under `path`; `every=None` takes what is there and stops.

    A micro-batch that is run again after a failure replaces the same paths, so the index ends the same. Deleted files are no
    events of a file stream; `Index.update` finds them.
    """
    reader = index.spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", SEGMENT_MAX_DOCS)
    for p in patterns or ():
        reader = reader.option("pathGlobFilter", p)

    def upsert(batch: DataFrame, _: int) -> None:
        docs = to_documents(batch, note_paths=index.note_paths, strict=index.strict).dropDuplicates(["path"])
        if not docs.isEmpty():
            index.upsert(docs)

    writer = reader.load(path).writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()
