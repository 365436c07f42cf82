"""Streaming jobs: session history, incremental index, late-tolerant windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sessions import KEEP, TTL


def session_history(turns: DataFrame, ttl: int = TTL, keep: int = KEEP) -> DataFrame:
    """(session_id, n, last_seq, contents) of each session after every batch that touched it.

    ``turns``: session_id, seq, ts (with a watermark), content.  A session is forgotten once its
    newest turn is ``ttl`` seconds old, whether by the next turn or by the watermark; only appending renews it.
    """

    def update(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seqs, contents, last = state.get if state.exists else ([], [], 0)
        rows = pd.concat(parts).sort_values("seq")
        for r in rows.itertuples():
            now = int(r.ts.timestamp() * 1000)
            if seqs and now - last >= ttl * 1000:
                seqs, contents = [], []
            seqs, contents, last = [*seqs, int(r.seq)][-keep:], [*contents, r.content][-keep:], max(last, now)
        state.update((list(seqs), list(contents), last))
        state.setTimeoutTimestamp(max(last + ttl * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"session_id": [key[0]], "n": [len(seqs)], "last_seq": [seqs[-1]], "contents": ["\n".join(map(str, contents))]})

    return turns.groupBy("session_id").applyInPandasWithState(
        update, "session_id string, n long, last_seq long, contents string", "seqs array<long>, contents array<string>, last long", "update", GroupStateTimeout.EventTimeTimeout)


def index_increments(stream: DataFrame, path: str, checkpoint: str, key: str = "hash"):
    """Append to the table at ``path`` what it does not have by ``key``; a batch that is run again adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        if spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
            new = new.join(spark.read.parquet(path).select(key), key, "left_anti").select(*batch.columns)
        new.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Extension: counts and sums by type in event-time windows, closed by a watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def token_texts(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(session_id, text): the tokens of each session's event stream in order, after every batch that touched it.

    ``events``: session_id, seq, ts, event, data.  Only ``token`` events add text; bad JSON is skipped.
    """
    said = F.try_variant_get(F.try_parse_json("data"), "$.t", "string")
    tokens = events.withWatermark("ts", late).filter("event = 'token'").withColumn("t", said).filter("t is not null")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "t"))), lambda x: x["t"])
    return tokens.groupBy("session_id").agg(F.array_join(ordered, "").alias("text"))


def cancel(query, spark: SparkSession, group: str | None = None) -> None:
    """Stop a stream and the jobs of its group; what its checkpoint holds is done, the rest is done by the next start."""
    if group is not None:
        spark.sparkContext.cancelJobGroup(group)
    query.stop()
    query.awaitTermination()
