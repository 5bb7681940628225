"""Streams: batches of changes put into a stored collection, and queries that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..collection import Collection
from ..operators.mutate import upsert
from ..sources.catalog import Catalog


def upsert_stream(stream: DataFrame, catalog: Catalog, name: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Upserts each batch of a stream of points. Putting a batch again after a failure gives the same table."""

    def put(batch: DataFrame, _: int) -> None:
        catalog.save(name, upsert(catalog.get(name), batch))

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def nearest_stream(queries: DataFrame, c: Collection, k: int, sink: str, checkpoint: str, using: str = "", most: int = 10_000) -> StreamingQuery:
    """The k best points of each query (query_id, vector) of a stream, appended to a Parquet table. A batch holds at most so many queries."""
    from ..operators.batch import nearest_batch

    def answer(batch: DataFrame, number: int) -> None:
        rows = batch.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} queries in a batch")
        if rows:
            nearest_batch(c, {r["query_id"]: list(r["vector"]) for r in rows}, k, using).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
