"""Byte streams in chunks: a fixed head, a rolling tail, a count, folded by stream in Structured Streaming.

Chunks (stream, seq, chunk binary, eof boolean) may arrive in any order within and across batches: those
ahead of their turn wait in the state. A stream is finished by its eof row, or by silence.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tabscout import constants as C

OUTPUT = "stream string, size long, head binary, tail binary, read_error string"
STATE = "head binary, tail binary, seen long, next long, early binary, ended long"


def fold(state: dict[str, Any], chunk: bytes, head_bytes: int, tail_bytes: int) -> dict[str, Any]:
    """The state after one more chunk. Memory is bounded by head and tail."""
    missing = max(head_bytes - len(state["head"]), 0)
    head, rest = state["head"] + chunk[:missing], chunk[missing:]
    tail = (state["tail"] + rest)[-tail_bytes:] if tail_bytes else b""
    return state | {"head": head, "tail": tail, "seen": state["seen"] + len(chunk)}


def _finished(key: str, s: dict[str, Any], head_bytes: int, scan_limit: int, most: int | None, error: str | None) -> pd.DataFrame:
    if most is not None and s["seen"] > most:
        error = f"BodyTooLargeError: more than {most} bytes"
    far = s["seen"] - head_bytes > scan_limit
    return pd.DataFrame({"stream": [key], "size": [None if far else s["seen"]], "head": [s["head"]], "tail": [None if far else s["tail"]], "read_error": [error]}).astype({"size": "Int64"})


def rolling_windows(chunks: DataFrame, head_bytes: int = C.DEFAULT_HEAD_BYTES, tail_bytes: int = C.DEFAULT_TAIL_BYTES, scan_limit: int = C.MAX_FORWARD_SCAN_BYTES, most: int | None = None, stall_ms: int | None = None) -> DataFrame:
    """A streaming DataFrame of finished streams: windows as sample() takes them, or a read_error.

    Past `scan_limit` bytes after the head the tail is null: the end counts as not seen. More than `most`
    bytes, or no chunk for `stall_ms`, is an error; with such a limit a query never ends by itself, as a
time-out may always come. Chunks that wait for their turn are kept in the state.
    """
    import pickle

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            head, tail, seen, turn, early, ended = state.get
            s, waiting = {"head": bytes(head), "tail": bytes(tail), "seen": seen}, pickle.loads(bytes(early))
        else:
            s, turn, waiting, ended = {"head": b"", "tail": b"", "seen": 0}, 0, {}, -1
        if state.hasTimedOut:
            yield _finished(key[0], s, head_bytes, scan_limit, most, "FileSampleReadError: the sender stalled")
            state.remove()
            return
        for batch in batches:
            for r in batch.itertuples():
                if r.eof:
                    ended = int(r.seq)
                elif r.seq >= turn:
                    waiting[int(r.seq)] = bytes(r.chunk) if r.chunk is not None else b""
        while turn in waiting:
            s = fold(s, waiting.pop(turn), head_bytes, tail_bytes)
            turn += 1
        if turn == ended or (most is not None and s["seen"] > most):
            yield _finished(key[0], s, head_bytes, scan_limit, most, None)
            state.remove()
        else:
            state.update((s["head"], s["tail"], s["seen"], turn, pickle.dumps(waiting), ended))
            if stall_ms is not None:
                state.setTimeoutDuration(stall_ms)

    return chunks.groupBy("stream").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout if stall_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def inspect_new_files(spark, folder: str, sink: str, checkpoint: str, **options: Any):
    """A query that inspects each new file of a folder once and appends its result to a Parquet sink."""
    from tabscout.operators import inspection

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def batch(df: DataFrame, number: int) -> None:
        out = inspection.inspect(df.sparkSession, df.select("path", "content"), **options)
        out.select("path", "result", "error").withColumn("batch", F.lit(number)).write.mode("append").parquet(sink)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
