"""Streams: pieces of answers without their thoughts, and files that arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OPEN, CLOSE = "<think>", "</think>"


class ThoughtFilter:
    """M1: passes text on without ``<think>`` blocks, also where tags are cut by the pieces of a stream."""

    def __init__(self, held: str = "", inside: bool = False) -> None:
        self.held, self.inside = held, inside

    def feed(self, piece: str) -> str:
        """What can be shown after one more piece."""
        text, shown = self.held + piece, []
        while text:
            tag = CLOSE if self.inside else OPEN
            before, found, after = text.partition(tag)
            if found:
                if not self.inside:
                    shown.append(before)
                self.inside, text = not self.inside, after
                continue
            cut = next((k for k in range(min(len(tag) - 1, len(text)), 0, -1) if text.endswith(tag[:k])), 0)
            if not self.inside:
                shown.append(text[: len(text) - cut])
            self.held = text[len(text) - cut :]
            return "".join(shown)
        self.held = ""
        return "".join(shown)

    def flush(self) -> str:
        """What remains at the end; an open block is dropped."""
        rest, self.held = ("" if self.inside else self.held), ""
        return rest


def filter_pieces(pieces: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """Pieces (session_id, seq, piece) of a stream as session_id, seq, shown; state is kept per session.

    A session ends with a row whose column ``last`` is true, where there is such a column, or after ``timeout_ms``
    without pieces; what is held back then (the beginning of a tag that never came) is shown, on the last row or with
    a seq of -1, and its state is dropped.
    """
    ends = "last" in pieces.columns

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        f = ThoughtFilter(*(state.get if state.exists else ("", False)))
        if state.hasTimedOut:
            state.remove()
            if rest := f.flush():
                yield pd.DataFrame({"session_id": [key[0]], "seq": [-1], "shown": [rest]})
            return
        rows = pd.concat(list(frames)).sort_values("seq")
        shown = [f.feed(p or "") for p in rows.piece]
        if ends and rows["last"].fillna(False).astype(bool).any():
            shown[-1] += f.flush()
            state.remove()
        else:
            state.update((f.held, f.inside))
            if timeout_ms is not None:
                state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({"session_id": key[0], "seq": rows.seq, "shown": shown})

    wait = GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return pieces.groupBy("session_id").applyInPandasWithState(step, "session_id string, seq int, shown string", "held string, inside boolean", "append", wait)


def arriving(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None], schema: str, kind: str = "json") -> StreamingQuery:
    """M4, M5: hand every new batch of rows under a folder to ``handle`` once, then stop. Run again for what came since;
    batches run one at a time."""
    stream = spark.readStream.format(kind).schema(schema).load(folder)
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
