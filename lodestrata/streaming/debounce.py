"""Debounced batches of events: a batch closes after a quiet time, or a longest time after its first event.

The batch form folds each key's sorted events; the streaming form keeps first, last and
number of the open batch as state and gives the same batches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, first_ms long, last_ms long, n_events long"


def batches(events: DataFrame, quiet_ms: int = 5_000, cap_ms: int = 10_000) -> DataFrame:
    """key, first_ms, last_ms, n_events of each batch of (key, ms).

    Events come sorted; a task holds the open batch of one key and a slice of events.
    """

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, last, n = None, 0, 0, 0
        for part in parts:
            out: list[tuple] = []
            names = part.column("key").dictionary_encode()
            code, ms = np.asarray(names.indices), np.asarray(part.column("ms"))
            new = np.ones(len(ms), bool)
            new[1:] = (code[1:] != code[:-1]) | (ms[1:] - ms[:-1] >= quiet_ms)
            starts = np.append(np.flatnonzero(new), len(ms))
            for a, b in zip(starts.tolist(), starts[1:].tolist()):  # events of one key without a quiet time
                name = names.dictionary[int(code[a])].as_py()
                while a < b:
                    if key != name or ms[a] >= min(last + quiet_ms, first + cap_ms):
                        out += [(key, first, last, n)] if n else []
                        key, first, n = name, int(ms[a]), 0
                    end = max(a + 1, a + int(np.searchsorted(ms[a:b], first + cap_ms)))
                    last, n, a = int(ms[end - 1]), n + end - a, end
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], names=_NAMES)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((key, first, last, n), _TYPES)], names=_NAMES)

    return events.select("key", "ms").where("key is not null and ms is not null").repartition("key").sortWithinPartitions("key", "ms").mapInArrow(fold, OUT)


_NAMES, _TYPES = ("key", "first_ms", "last_ms", "n_events"), (pa.string(), pa.int64(), pa.int64(), pa.int64())


def stream(events: DataFrame, quiet_ms: int = 5_000, cap_ms: int = 10_000) -> DataFrame:
    """The same over a stream of (key, ms, ts with a watermark); a batch is given out when a later event or the watermark closes it."""

    def step(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else None
        done = []
        if state.hasTimedOut:
            done.append(held)
            state.remove()
        else:
            times = np.sort(np.concatenate([p["ms"].to_numpy() for p in parts]))
            for ms in times.tolist():
                if held and ms < min(held[1] + quiet_ms, held[0] + cap_ms):
                    held = [held[0], max(held[1], ms), held[2] + 1]
                else:
                    done += [held] if held else []
                    held = [ms, ms, 1]
            state.update(tuple(held))
            state.setTimeoutTimestamp(max(min(held[1] + quiet_ms, held[0] + cap_ms), state.getCurrentWatermarkMs() + 1))
        if done:
            yield pd.DataFrame([(key[0], *d) for d in done], columns=["key", "first_ms", "last_ms", "n_events"])

    return events.groupBy("key").applyInPandasWithState(step, OUT, "first_ms long, last_ms long, n_events long", "append", GroupStateTimeout.EventTimeTimeout)
