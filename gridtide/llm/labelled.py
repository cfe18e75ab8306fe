"""Labelled rows: the held-out rule, and a bounded sample to fit on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridtide.llm.batches import pick

# A classifier is fitted on about this many labelled rows, or on all if there are fewer.
SAMPLE_ROWS = 30_000
_STEPS = 1 << 62


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    """True where crc32 of the id's text leaves this rest; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))


def share(mixed: Column, rows: int, count: int) -> Column:
    """True for about ``rows`` of ``count`` rows, by a 64-bit hash of each; for all if there are no more.

    The bound is a 62-bit number, so it is as good at any count.
    """
    if count <= rows:
        return F.lit(True)
    return F.shiftrightunsigned(mixed, 2) < F.lit(_STEPS * rows // count)


def require_some(found: int, chosen: DataFrame, count: int) -> None:
    """An empty fit would score everything alike: raise if rows exist but none was chosen."""
    if not found and count and not chosen.limit(1).count():
        raise ValueError(f"The sample of {count} rows is empty")


def sample(
    docs: DataFrame, labels: DataFrame, label: str, modulus: int, rest: int, rows: int = SAMPLE_ROWS
) -> DataFrame:
    """(label, text) of labelled documents outside the held-out part.

    The ids are chosen by hash, so the same rows are taken however the tables are stored. Of repeated
    labels of one id the larger counts, of repeated documents one; null labels, ids and texts without label
    are left out.
    """
    known = pick(labels, doc_id="doc_id", label=label).filter("doc_id IS NOT NULL AND label IS NOT NULL")
    known = known.filter(~held_out(F.col("doc_id"), modulus, rest)).groupBy("doc_id").agg(F.max("label").alias("label"))
    count = known.count()
    chosen = known.filter(share(F.xxhash64("doc_id"), rows, count))
    if count > rows:
        require_some(0, chosen, count)
    texts = pick(docs, doc_id="doc_id", text="text")
    rows_once = texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "text"])
    return rows_once.select(F.col("label").cast("bigint").alias("label"), "text")
