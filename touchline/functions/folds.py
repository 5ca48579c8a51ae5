"""Folds: state that is carried from frame to frame of a match, over tables; ``streaming`` runs the same steps over streams."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of an Arrow batch that a fold gives back, about.
ROWS = 10_000


def _values(column: pa.Array) -> list:
    """The column as Python values; numbers and lists of numbers without nulls go by NumPy, which is faster."""
    kind = column.type
    if not column.null_count and (pa.types.is_integer(kind) or pa.types.is_floating(kind)):
        return column.to_numpy(zero_copy_only=False).tolist()
    if not column.null_count and pa.types.is_list(kind) and pa.types.is_floating(kind.value_type) and not column.values.null_count:
        values, ends = column.values.to_numpy(zero_copy_only=False).tolist(), column.offsets.to_pylist()
        return [values[a:b] for a, b in zip(ends, ends[1:])]
    return column.to_pylist()


def _dicts(batch: pa.RecordBatch) -> list[dict]:
    names = batch.schema.names
    return [dict(zip(names, row)) for row in zip(*map(_values, batch.columns))]


def fold(rows: DataFrame, start: Callable, step: Callable, schema: str, ready: Callable | None = None, finish: Callable | None = None) -> DataFrame:
    """What ``step(state, match_id, frame, rows)`` gives for the frames of each match in order; the state is ``start()`` at first.

    Matches are dealt by id and each one's frames come in order, a batch at a
    time, so a task holds one state and one batch however long the match is.
    The number of tasks is given, since steps cost far more than their rows'
    bytes tell. What needs no state is done for many frames at once: ``ready``
    adds to the rows of a batch, ``finish`` turns what steps gave into rows.
    """
    spark = rows.sparkSession
    shape = to_arrow_schema(spark.createDataFrame([], schema).schema)
    names = shape.names

    def give(found: list[tuple]) -> pa.RecordBatch:
        found = found if finish is None else finish(found)
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], shape.field(i).type) for i in range(len(names))], names=names)

    def work(batches):
        match, state, at, waiting, found = None, None, None, [], []
        for batch in batches:
            taken = _dicts(batch)
            if ready is not None:
                ready(taken)
            for row in taken:
                key = (row["match_id"], row["frame"])
                if key != at:
                    if waiting:
                        found += step(state, *at, waiting)
                    if at is None or key[0] != match:
                        match, state = key[0], start()
                    at, waiting = key, []
                waiting.append(row)
            if len(found) >= ROWS:
                yield give(found)
                found = []
        if waiting:
            found += step(state, *at, waiting)
        yield give(found)

    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "match_id").sortWithinPartitions("match_id", "frame").mapInArrow(work, schema)


def fold_together(rows: DataFrame, start: Callable, step: Callable, schema: str) -> DataFrame:
    """What ``step(state, frame, rows)`` gives for the frames in order, where ``rows`` are those of all matches of a task that have the frame.

    The state is ``start()`` at first, one for all matches of the task; step
    gives a record batch or none. A task holds this state, an Arrow batch and
    one frame's rows, and work in Python is shared by its matches. Frames whose
    rows come in several batches wait for the rest.
    """
    conf = rows.sparkSession.conf

    def work(batches):
        state, waiting = start(), None
        for batch in batches:
            table = pa.Table.from_batches([batch] if waiting is None else [waiting, batch])
            together = table.combine_chunks().to_batches()
            if not together:
                continue
            frames = together[0].column("frame").to_numpy()
            ends = np.flatnonzero(np.diff(frames)) + 1
            found = [step(state, int(frames[a]), together[0].slice(a, b - a)) for a, b in zip([0, *ends], ends)]
            waiting = together[0].slice(ends[-1] if len(ends) else 0)
            yield from (f for f in found if f is not None)
        if waiting is not None:
            found = step(state, int(waiting.column("frame")[0].as_py()), waiting)
            if found is not None:
                yield found

    # the more matches a task has, the less a frame costs, but a task sorts what it has: twice what other steps give to a task
    parts = int(conf.get("spark.sql.shuffle.partitions"))
    tasks = max(parts, int(conf.get("spark.touchline.matchTasks", str(parts))) // 2)
    return rows.repartition(tasks, "match_id").sortWithinPartitions("frame", "match_id").mapInArrow(work, schema)
