"""Sums of long vectors over the tasks of one job, as binary blocks added up on executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

BLOCK = 1 << 16  # numbers per block of an emitted vector


def blocks(key: int, total: np.ndarray, rows: int) -> Iterator[pa.RecordBatch]:
    """A task's summed vector as (key, block, task, rows, numbers) rows."""
    task = TaskContext.get().partitionId()
    for b in range(0, len(total), BLOCK):
        row = [[key], [b // BLOCK], [task], [rows], [np.ascontiguousarray(total[b : b + BLOCK]).tobytes()]]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types)], ["key", "block", "task", "n", "sums"])


def summed(rows: DataFrame, task: Callable) -> dict[int, tuple[np.ndarray, int]]:
    """Run ``task`` on every partition and add up what the tasks emit, by key, block by block, on the
    executors. The driver gets one vector a key, of the size a single task emits."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, count = None, None, 0

        def out() -> pa.RecordBatch:
            columns = [pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([count], pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, pa.array([total.tobytes()], pa.binary())], ["key", "block", "n", "sums"])

        for batch in batches:
            keys, blocks, counts = (batch.column(c).to_pylist() for c in ("key", "block", "n"))
            for key, block, n, sums in zip(keys, blocks, counts, batch.column("sums")):
                x = np.frombuffer(sums.as_buffer())
                if (key, block) != now:
                    if now is not None:
                        yield out()
                    now, total, count = (key, block), x.copy(), n
                else:
                    total += x
                    count += n
        if now is not None:
            yield out()

    parts = rows.mapInArrow(task, "key int, block int, task int, n bigint, sums binary")
    # in the order of tasks, so that the sums are the same on a rerun
    dealt = parts.repartition("key", "block").sortWithinPartitions("key", "block", "task")
    found: dict[int, list] = {}
    for r in dealt.mapInArrow(add, "key int, block int, n bigint, sums binary").collect():
        found.setdefault(r.key, []).append((r.block, r.n, r.sums))
    return {k: (np.concatenate([np.frombuffer(s) for _, _, s in sorted(v)]), v[0][1]) for k, v in found.items()}
