"""Exact top-k search by inner product over a bit-sliced index.

Every vector entry x becomes the whole number floor(scale * x). The index holds blocks of rows; in a
block each attribute (dimension) is stored as bit slices: one bitmap per binary digit of the entry less
the block's smallest entry of that attribute. A query's score is a sum of attributes times whole numbers:
each query entry is written in signed binary digits, every digit adds the attribute's slices at that
digit's place (their complements for a negative digit, with a constant to match), and all bitmaps of
one place are added by carry-save adders, three to two, until every place has one. The result is the
score of every row of the block as slices. The top rows are selected from the most significant slice
downward: rows with the bit set are ahead of the rest while they are no more than wanted; rows still equal to
the boundary at the end have exactly the same score, and the smallest vec_ids of them fill up.

Blocks of the index and of the queries meet in cells of bounded size, one cogroup each; every block of
one side meets every block of the other once. Cells return ``top`` rows per query, and a ranked window
keeps the best.

Vectors that are null or hold a null or non-finite component take no part. Vectors of different lengths
have no score together; empty vectors score 0 with each other. Entries beyond 64 bits saturate, sums
are exact at any size, and a score beyond 64 bits shows as the nearest long. A query's own row is left
out, other rows with its vec_id are not; each query row gets results of its own. A null vec_id is no
query, and as a candidate comes last among equal scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gridtide.llm.batches import arrow_schema, pick, record_batch
from gridtide.plans.work import written

TOP, SCALE = 5, 256.0
# Rows of an index block and queries of a query block, fewer where vectors are long or the table is small.
BLOCK_ROWS, BLOCK_QUERIES, BLOCK_BYTES = 65_536, 4_096, 32 << 20
CELLS = 32
_INDEX = "size int, part bigint, own array<bigint>, vec_id array<bigint>, base array<bigint>, widths array<int>, slices binary"
_FOUND = "own bigint, query_id bigint, vec_id bigint, score bigint"
_LONG = 1 << 63


def search(
    vectors: DataFrame,
    queries: str = "vec_id % 50 = 0",
    top: int = TOP,
    scale: float = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the ``top`` best rows of each row that meets ``queries``.

    ``queries`` is a condition over the column ``vec_id``.
    """
    rows = pick(vectors, vec_id=id_col, v=vector_col).withColumn("v", F.col("v").cast("array<double>"))
    sound = rows.filter("v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) <> double('infinity'))")
    entries = F.transform("v", lambda x: F.floor(F.lit(scale) * x))
    stored = written(sound.select("vec_id", entries.alias("v")).withColumn("own", F.monotonically_increasing_id()))
    asked = stored.filter("vec_id IS NOT NULL").filter(queries)
    count, longest = stored.agg(F.count("*"), F.max(F.size("v"))).first()
    wanted = asked.count()
    fit = max(64, BLOCK_BYTES // (8 * max(1, longest or 1)))
    parts = max(1, -(-count // min(block_rows, fit)))
    # A small table still makes enough cells to keep the cluster busy.
    slots = max(1, -(-wanted // min(block_queries, fit)), min(-(-CELLS // parts), -(-wanted // 32)))
    index = written(_numbered(stored, "part", parts).groupBy("size", "part").applyInArrow(_builder(), _INDEX))
    asked = _numbered(asked, "slot", slots).select("*", F.explode(_up_to(parts)).alias("part"))
    cells = index.select("*", F.explode(_up_to(slots)).alias("slot"))
    key = ["size", "part", "slot"]
    found = cells.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_cell(top), _FOUND)
    order = Window.partitionBy("own").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _numbered(rows: DataFrame, name: str, count: int) -> DataFrame:
    """Rows dealt evenly over ``count`` numbers; ``own`` is never repeated, so no number is hot."""
    return rows.select("own", "vec_id", "v", F.size("v").alias("size"), F.pmod(F.xxhash64("own"), F.lit(count)).alias(name))


def _up_to(count: int):
    return F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint"))


def _matrix(rows: pa.Table) -> np.ndarray:
    return rows.column("v").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, rows.column("size")[0].as_py())


def _builder():
    """One block of the index from its rows. Places follow vec_id, so that of equal rows the smallest id comes first."""
    out = arrow_schema(_INDEX)

    def run(rows: pa.Table) -> pa.Table:
        null = rows.column("vec_id").is_null().to_numpy()
        order = np.lexsort((rows.column("vec_id").fill_null(0).to_numpy(), null))
        block = Slices.of(_matrix(rows)[order])
        rows = rows.take(pa.array(order))
        columns = [
            rows.column("size").to_pylist()[:1],
            rows.column("part").to_pylist()[:1],
            [rows.column("own").to_pylist()],
            [rows.column("vec_id").to_pylist()],
            [block.base.tolist()],
            [block.widths.tolist()],
            [block.bits.tobytes()],
        ]
        return pa.Table.from_batches([record_batch(out, columns)])

    return run


def _cell(top: int):
    """The best rows of one index block for each query of one slot."""
    out = arrow_schema(_FOUND)

    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        if not index.num_rows or not asked.num_rows:
            return out.empty_table()
        part = {name: index.column(name)[0] for name in ("own", "vec_id", "base", "widths", "slices")}
        ids = part["vec_id"].as_py()
        places = {own: place for place, own in enumerate(part["own"].as_py())}
        slices = Slices.stored(len(ids), part["base"].values.to_numpy(), part["widths"].values.to_numpy(), part["slices"].as_py())
        found = []
        for own, query_id, entries in zip(asked.column("own").to_pylist(), asked.column("vec_id").to_pylist(), _matrix(asked).tolist()):
            for place, score in slices.best(entries, top, places.get(own)):
                found.append((own, query_id, ids[place], max(-_LONG, min(_LONG - 1, score))))
        return pa.Table.from_batches([record_batch(out, list(zip(*found)) or [[]] * len(out))])

    return run


class Slices:
    """Bit slices of a block of rows: for attribute j ``widths[j]`` bitmaps of the entry less ``base[j]``."""

    def __init__(self, rows: int, base: np.ndarray, widths: np.ndarray, bits: np.ndarray) -> None:
        self.rows, self.base, self.widths, self.bits = rows, base, widths, bits
        self.starts = np.concatenate(([0], np.cumsum(widths))).tolist()
        self.valid = _packed(np.ones(rows, dtype=bool))

    @classmethod
    def of(cls, entries: np.ndarray) -> Slices:
        base = entries.min(axis=0) if len(entries) else np.zeros(entries.shape[1], dtype=np.int64)
        # The difference of two longs fits 64 bits without a sign.
        above = entries.view(np.uint64) - base.view(np.uint64)
        widths = np.array([int(high).bit_length() for high in above.max(axis=0)], dtype=np.int32)
        bitmaps = [
            _packed((above[:, j] >> np.uint64(digit)) & np.uint64(1) == 1) for j, width in enumerate(widths.tolist()) for digit in range(width)
        ]
        words = -(-len(entries) // 64)
        return cls(len(entries), base, widths, np.array(bitmaps, dtype=np.uint64).reshape(len(bitmaps), words))

    @classmethod
    def stored(cls, rows: int, base: np.ndarray, widths: np.ndarray, bits: bytes) -> Slices:
        return cls(rows, base, widths, np.frombuffer(bits, dtype=np.uint64).reshape(int(widths.sum()), -(-rows // 64)))

    def scores(self, query: list[int]) -> tuple[list[np.ndarray], int]:
        """Slices of all rows' scores, least significant first, and the constant that belongs to them."""
        places: list[list[np.ndarray]] = []
        constant = 0
        for j, entry in enumerate(query):
            constant += entry * int(self.base[j])
            low, high = self.starts[j], self.starts[j + 1]
            if low == high:
                continue
            places += [[] for _ in range(entry.bit_length() + 2 + high - low - len(places))]
            for digit, sign in _signed_digits(entry):
                if sign < 0:
                    constant -= ((1 << high - low) - 1) << digit
                for at in range(low, high):
                    places[digit + at - low].append(self.bits[at] if sign > 0 else ~self.bits[at])
        sums = []
        at = 0
        while at < len(places):
            here = places[at]
            if len(here) > 1 and at + 1 == len(places):
                places.append([])
            while len(here) > 2:
                a, b, c = here.pop(), here.pop(), here.pop()
                half = a ^ b
                here.append(half ^ c)
                places[at + 1].append((a & b) | (half & c))
            if len(here) == 2:
                a, b = here
                places[at + 1].append(a & b)
                here = [a ^ b]
            sums.append(here[0] if here else np.zeros_like(self.valid))
            at += 1
        return sums, constant

    def best(self, query: list[int], top: int, without: int | None = None) -> list[tuple[int, int]]:
        """(place, score) of the ``top`` rows with the highest scores, equal ones by place."""
        sums, constant = self.scores(query)
        equal = self.valid.copy()
        if without is not None:
            equal[without >> 6] &= ~np.uint64(1 << (without & 63))
        ahead = np.zeros_like(equal)
        want = top
        for bitmap in reversed(sums):
            with_bit = equal & bitmap
            count = int(np.bitwise_count(with_bit).sum())
            if count > want:
                equal = with_bit
                continue
            ahead |= with_bit
            want -= count
            if not want:
                break
            equal &= ~bitmap
        chosen = _places(ahead)
        if want:
            chosen = np.concatenate([chosen, _places(equal)[:want]])
        scores = [
            (constant + sum((int(bitmap[place >> 6]) >> (place & 63) & 1) << digit for digit, bitmap in enumerate(sums)), place)
            for place in chosen.tolist()
        ]
        return [(place, score) for score, place in sorted(scores, key=lambda s: (-s[0], s[1]))]


def _signed_digits(number: int) -> list[tuple[int, int]]:
    """Non-adjacent signed binary digits (place, +1 or -1) of a whole number."""
    digits, place = [], 0
    while number:
        if number & 1:
            sign = 2 - (number & 3)
            digits.append((place, sign))
            number -= sign
        number >>= 1
        place += 1
    return digits


def _packed(flags: np.ndarray) -> np.ndarray:
    """A bitmap in 64-bit words: row r is bit r % 64 of word r // 64."""
    padded = np.zeros(-(-len(flags) // 64) * 64, dtype=bool)
    padded[: len(flags)] = flags
    return np.packbits(padded, bitorder="little").view(np.uint64)


def _places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))
