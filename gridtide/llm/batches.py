"""Plumbing shared by the operators: safe column picks and Arrow batches of texts inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from gridtide.functions.columns import field

# Texts are handed to an operator in slices of about this many bytes, whatever the batch size.
SLICE_BYTES = 1 << 20


def pick(frame: DataFrame, **columns: str) -> DataFrame:
    """Only these columns, under the operator's own names, so that extra columns never clash."""
    return frame.select(*(field(source).alias(name) for name, source in columns.items()))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(_parse_datatype_string(schema))


def record_batch(schema: pa.Schema, columns: Sequence) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def map_texts(
    rows: DataFrame,
    start: Callable[[], Callable[[list, list], Iterable[Sequence]]],
    schema: str,
    binary: bool = True,
) -> DataFrame:
    """Run an operator over the rows (key, text, ...) in slices of bounded size.

    ``start`` runs once per task and returns a function of (columns before the text, texts) that
    yields column tuples of the result. The text column is the last one; null texts arrive as None.
    """
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            if binary:
                texts = texts.cast(pa.binary())
            for low, high in slices(texts):
                keys = [batch.column(i).slice(low, high - low) for i in range(batch.num_columns - 1)]
                for columns in work(keys, texts.slice(low, high - low).to_pylist()):
                    yield record_batch(out, columns)

    return rows.mapInArrow(run, schema)


def rewrite_texts(
    docs: DataFrame, start: Callable[[], Callable[..., tuple[Sequence, Sequence]]], text_col: str, beside: str | None = None
) -> DataFrame:
    """All columns of the documents, with texts replaced and rows left out.

    ``start`` runs once per task and returns a function of a list of texts (bytes or None), and of the
    values of the column ``beside`` if there is one, that gives the new texts and, for each, whether its
    row stays.
    """
    at = docs.columns.index(text_col)
    other = None if beside is None else docs.columns.index(beside)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            for low, high in slices(texts):
                part = batch.slice(low, high - low)
                given = [texts.slice(low, high - low).to_pylist()]
                new, keep = work(*given, *([] if other is None else [part.column(other).to_pylist()]))
                body = pa.array(new, type=pa.binary()).cast(pa.string())
                yield part.set_column(at, batch.schema.field(at), body).filter(pa.array(keep, type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of at most about SLICE_BYTES of text each; one long text is a range of its own."""
    low = size = 0
    for at, length in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        if at > low and size + length > SLICE_BYTES:
            yield low, at
            low, size = at, 0
        size += length
    if len(texts) > low:
        yield low, len(texts)
