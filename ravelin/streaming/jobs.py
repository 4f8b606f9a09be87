"""Structured Streaming: windows over traces, summaries with state, extraction that resumes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ravelin.operators import trace


def windowed_traces(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling windows of a stream (ts as timestamp); windows that the watermark has passed are final."""
    return trace.tumbling(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), size)


def distinct_traces(traces: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """A stream of traces (ts, key, ...) without those that repeat a key within ``late``: what a retried writer sends
    twice counts once, and the state forgets keys that the watermark has passed."""
    return traces.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def answered(questions: DataFrame, outcomes: DataFrame, key: str = "user_id", within: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, asked_at, answered_at, seconds) of a stream of questions (key, ts) and one of outcomes (key, ts): all outcomes
    of a question's key up to ``within`` after it. A question without one comes out too, once the watermark has passed
    its time. Neither side is held longer than that."""
    asked = questions.select(F.col(key), F.col("ts").cast("timestamp").alias("asked_at")).withWatermark("asked_at", late)
    done = outcomes.select(F.col(key).alias("_key"), F.col("ts").cast("timestamp").alias("answered_at")).withWatermark("answered_at", late)
    near = (F.col(key) == F.col("_key")) & (F.col("answered_at") >= F.col("asked_at")) & (F.col("answered_at") <= F.col("asked_at") + F.expr(f"INTERVAL {within}"))
    return asked.join(done, near, "left_outer").select(key, "asked_at", "answered_at", (F.col("answered_at").cast("double") - F.col("asked_at").cast("double")).alias("seconds"))


def dropped_as_late(query) -> int:
    """Rows that a finished query left out because they came behind the watermark."""
    return sum(int(op.numRowsDroppedByWatermark) for p in query.recentProgress for op in p.stateOperators)


def rolling_summaries(messages: DataFrame, merge: Callable[[str, list[str]], str], recent: int = 6) -> DataFrame:
    """(conv_id, summary, cursor) whenever messages have left a session's recent window.

    The state is the summary, the cursor and the messages that are still recent, so it stays as small as a window.
    ``merge`` takes the old summary and lines, and keeps both as they are by returning a blank.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        summary, cursor, turns, roles, texts = state.get if state.exists else ("", -1, [], [], [])
        kept = list(zip(turns, roles, texts))
        for batch in batches:
            kept += [(int(t), r, x) for t, r, x in zip(batch["turn"], batch["role"], batch["text"]) if t > cursor]
        kept = sorted(set(kept))
        pending = kept[:-recent] if len(kept) > recent else []
        if pending:
            new = merge(summary, [f"{r}: {(x or '')[:300]}" for _, r, x in pending])
            if new and new.strip():
                summary, cursor, kept = new, pending[-1][0], kept[-recent:]
                yield pd.DataFrame({"conv_id": [key[0]], "summary": [summary], "cursor": [cursor]})
        state.update((summary, cursor, [k[0] for k in kept], [k[1] for k in kept], [k[2] for k in kept]))

    schema = "conv_id long, summary string, cursor long"
    held = "summary string, cursor long, turns array<long>, roles array<string>, texts array<string>"
    return messages.groupBy("conv_id").applyInPandasWithState(step, schema, held, "append", GroupStateTimeout.NoTimeout)


def run_to_memory(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is there now, through a memory sink: for tests and small tables."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def extraction_stats(extracted: DataFrame, out: dict[str, int], seconds: float, left: int = 0) -> dict[str, float]:
    """What a run of ``extract_in_waves`` did: triples of (chunk, ok, triples) rows, chunks a second, seconds to go."""
    triples = extracted.where("ok").agg(F.sum(F.size("triples")).alias("n")).first().n or 0
    done = out["success"] + out["failed"]
    rate = done / seconds if seconds > 0 else 0.0
    return {**out, "triples": triples, "rate": round(rate, 4), "eta": round(left / rate, 1) if rate else 0.0}


def extract_in_waves(chunks: DataFrame, done: DataFrame, wave: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], None], waves: int = 8, most_failures: int = 20) -> dict[str, int]:
    """Extraction of what is not done, wave after wave. A wave's successes are written, failures are left for the next
    run; once as many calls as ``most_failures`` have failed since the last success of a wave, the rest is skipped."""
    if most_failures <= 0:
        raise ValueError("most_failures must be positive")
    todo = chunks.join(done, "chunk_id", "left_anti").withColumn("_wave", F.pmod(F.xxhash64("chunk_id"), F.lit(waves))).persist()
    out = {"success": 0, "failed": 0, "skipped": 0}
    failures = 0
    for k in range(waves):
        part = todo.where(F.col("_wave") == k).drop("_wave")
        if failures >= most_failures:
            out["skipped"] += part.count()
            continue
        found = wave(part).persist()
        good, n = found.where("raw IS NOT NULL").count(), found.count()
        if good:
            write(found.where("raw IS NOT NULL"))
        out["success"] += good
        out["failed"] += n - good
        failures = failures + n if n and not good else 0 if n else failures
        found.unpersist()
    todo.unpersist()
    return out
