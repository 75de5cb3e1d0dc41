"""Sessions as a stream: log files of turns become exchanges with their context, each turn once, into a sink that a repeated batch can't double.

The state of a session holds the ids of its turns, a user turn that waits for its reply and the last four exchanges; it goes when the session has been silent
for `silent` (by event time).  Files are picked up as they appear, so newest-file discovery is the file source's own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fixed values of the memory model: exchanges in a context, and what is too short or says nothing.
CONTEXT, LEAST_HUMAN, LEAST_REPLY = 4, 15, 30
SILENT_HUMAN, SILENT_REPLY = "HEARTBEAT", "NO_REPLY"
TURN = "type string, session string, turn_id string, role string, text string, ts timestamp"
EXCHANGE = "session string, turn_id string, human string, reply string, n_before int, context string"
STATE = "seen array<string>, waiting string, earlier array<string>"


def turns(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """Turns of the JSON-lines files of a folder, as they appear; lines that are no messages of a user or an assistant are skipped."""
    raw = spark.readStream.schema(TURN).option("maxFilesPerTrigger", files).json(folder)
    return raw.where("type = 'message' AND role IN ('user', 'assistant') AND session IS NOT NULL AND turn_id IS NOT NULL AND text IS NOT NULL").drop("type")


def _worth(human: str, reply: str) -> bool:
    return not (len(human) < LEAST_HUMAN and len(reply) < LEAST_REPLY) and SILENT_HUMAN not in human and SILENT_REPLY not in reply


def exchanges(stream: DataFrame, late: str = "1 day", silent: str = "7 days") -> DataFrame:
    """EXCHANGE of turns (session, turn_id, role, text, ts): a user turn and the reply after it, with the four exchanges before.

    A turn id counts once in its session, however often it comes.  Exchanges that aren't worth keeping leave no trace in later contexts."""
    quiet = int(pd.Timedelta(silent).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, waiting, earlier = state.get if state.exists else ([], None, [])
        seen, earlier, out = list(seen), list(earlier), []
        known, latest = set(seen), 0
        rows = pd.concat(list(batches)).sort_values(["ts", "turn_id"], kind="stable")
        for turn, role, text, ts in zip(rows["turn_id"], rows["role"], rows["text"], rows["ts"], strict=True):
            if turn in known:
                continue
            known.add(turn)
            seen.append(turn)
            latest = max(latest, int(ts.timestamp() * 1000))
            if role == "user":
                waiting = text
            elif waiting is not None:
                if _worth(waiting, text):
                    out.append((key[0], turn, waiting, text, len(earlier), "\n".join(earlier)))
                    earlier = [*earlier, f"Human: {waiting}\nAgent: {text}"][-CONTEXT:]
                waiting = None
        state.update((seen, waiting, earlier))
        if latest + quiet > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(latest + quiet)
        yield pd.DataFrame(out, columns=["session", "turn_id", "human", "reply", "n_before", "context"]).astype({"n_before": "int32"})

    marked = stream.withWatermark("ts", late)
    return marked.groupBy("session").applyInPandasWithState(step, EXCHANGE, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def into(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: each batch is a folder of its own, overwritten when the batch comes again, so nothing is doubled and nothing lost."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def follow(spark: SparkSession, source: str, sink: str, checkpoint: str, files: int = 100, once: bool = False) -> StreamingQuery:
    """Start the stream from a folder of logs into a sink; once: take what is there and stop, else look every three seconds."""
    writer = exchanges(turns(spark, source, files)).writeStream.foreachBatch(into(sink)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="3 seconds")).start()


def stored(spark: SparkSession, sink: str) -> DataFrame:
    """Everything in a sink, with its batch."""
    return spark.read.schema(f"{EXCHANGE}, batch long").option("basePath", sink).parquet(f"{sink}/batch=*")


def contexts(exchanges_: DataFrame, since: int | None = None) -> DataFrame:
    """(session, context, exchanges): what a session's context is now, from the sink; with `since` only of sessions that have exchanges in later batches.

    A session's exchanges are few for a window: only the last four of each remain before they are joined."""
    touched = exchanges_ if since is None else exchanges_.join(exchanges_.where(F.col("batch") > since).select("session").distinct(), "session", "left_semi")
    newest = Window.partitionBy("session").orderBy(F.desc("batch"), F.desc("n_before"), F.desc("turn_id"))
    last = touched.withColumn("r", F.row_number().over(newest)).where(F.col("r") <= CONTEXT)
    line = F.concat(F.lit("Human: "), "human", F.lit("\nAgent: "), "reply")
    lines = F.array_sort(F.collect_list(F.struct((-F.col("r")).alias("o"), line.alias("line"))))
    return last.groupBy("session").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("context"), F.count("*").alias("exchanges"))
