"""Groups cut into leaves of bounded size, so that a hot key never lands in one task.

Rows (key, rank, payload ...) are ranged by key and rank. Ranges follow the data, so the rows of a hot
key spread over many tasks. Each task cuts its sorted rows into leaves: at most ``limit`` rows of one
key, as arrays in one row. Work on a group is then work on each leaf and on pairs of leaves of a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from gridtide.llm.batches import arrow_schema, record_batch


def cut(rows: DataFrame, payload: Sequence[str], limit: int) -> DataFrame:
    """(key, leaf, one array per payload column), ordered by rank within a leaf.

    A row alone under its key in the middle of a task has no partner anywhere and is left out.
    """
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = StructType(
        [StructField("key", LongType()), StructField("leaf", LongType())]
        + [StructField(name, ArrayType(kinds[name])) for name in payload]
    )
    out = to_arrow_schema(schema)
    ranged = rows.select("key", "rank", *payload).repartitionByRange("key", "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 40
        seq, before = 0, None
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys = held.column(0).to_numpy()
            last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            # The last key may go on in the next batch; full leaves of it can leave already.
            ready = last + (len(keys) - last) // limit * limit
            if ready:
                result, seq = _leaves(held.slice(0, ready), payload, limit, task, seq, before, out)
                yield from result
                before, held = keys[ready - 1], held.slice(ready).combine_chunks()
        if held is not None and held.num_rows:
            yield from _leaves(held, payload, limit, task, seq, before, out)[0]

    return ranged.sortWithinPartitions("key", "rank").mapInArrow(run, schema)


def _leaves(table, payload, limit, task, seq, before, out):
    keys = table.column(0).to_numpy()
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    ends = np.append(starts[1:], len(keys))
    cuts, sizes = [], []
    for at, (low, high) in enumerate(zip(starts.tolist(), ends.tolist())):
        # A row at either end may have partners in the neighbouring tasks or in a leaf that has left.
        edge = at == 0 and before in (None, keys[0]) or at == len(starts) - 1
        if high - low == 1 and not edge:
            continue
        for begin in range(low, high, limit):
            cuts.append(begin)
            sizes.append(min(limit, high - begin))
    if not cuts:
        return [], seq
    take = np.concatenate([np.arange(b, b + s) for b, s in zip(cuts, sizes)])
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    columns = [pa.array(keys[cuts]), pa.array(task + seq + np.arange(len(cuts)))]
    picked = table.take(pa.array(take)).combine_chunks()
    for at, name in enumerate(payload):
        values = picked.column(at + 2).combine_chunks()
        values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
        columns.append(pa.ListArray.from_arrays(offsets, values).cast(out.field(name).type))
    return [record_batch(out, columns)], seq + len(cuts)


def within(leaves: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work(columns)`` on each leaf of two or more rows."""
    names = [name for name in leaves.columns if name not in ("key", "leaf")]
    rows = leaves.filter(F.size(names[0]) > 1).select("key", *names)
    return rows.mapInArrow(_each(work, schema), schema)


def between(leaves: DataFrame, pairs: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work(left columns, right columns)`` on the listed pairs (key, left, right) of leaves."""
    names = [name for name in leaves.columns if name not in ("key", "leaf")]
    left = leaves.select("key", F.col("leaf").alias("left"), *(F.col(n).alias(f"left_{n}") for n in names))
    right = leaves.select("key", F.col("leaf").alias("right"), *(F.col(n).alias(f"right_{n}") for n in names))
    both = pairs.join(left, ["key", "left"]).join(right, ["key", "right"])
    rows = both.select("key", *(f"left_{n}" for n in names), *(f"right_{n}" for n in names))
    return rows.mapInArrow(_each(work, schema), schema)


def _each(work: Callable, schema: str):
    out = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_pylist()
            found = []
            for row in range(batch.num_rows):
                arrays = [batch.column(i)[row].values for i in range(1, batch.num_columns)]
                found += work(keys[row], arrays)
            if found:
                columns = list(zip(*found))
                yield record_batch(out, [np.concatenate(c) for c in columns])

    return run
