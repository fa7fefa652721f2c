"""Streaming queries over the event table, run until the available rows are through."""

from __future__ import annotations

import uuid

from ..runtime import shared_dir, table
from ..streaming import ingest


def _run(stream, spark, mode: str):
    base = f"{shared_dir(spark)}/gridweave/stream-{uuid.uuid4().hex}"

    def publish(batch, number):
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")

    q = stream.writeStream.outputMode(mode).foreachBatch(publish).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def stream_arrivals(spark, sf):
    rows = ingest.read_stream(spark, sf, table(spark, sf, "events").schema, "events.parquet")
    return _run(ingest.arrivals(rows, "ts", "event_type"), spark, "complete")


QUERIES = {"stream_arrivals": stream_arrivals}
SQL = {"stream_arrivals": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL"}
