"""Near-duplicate embeddings: random-hyperplane signs in several tables, exact cosines, components.

Equal vectors form one class. Each distinct vector gets one sign bit per random hyperplane; a table's
key is a group of these bits. Two vectors at the threshold agree on a bit with probability
1 - acos(threshold) / pi, so the number of bits per table follows from the number of vectors (buckets
stay small) and the number of tables from the recall asked for at the threshold; closer pairs are
found with higher probability. Then two passes over the buckets, both on leaves of bounded size
(leaves.py), so that a hot bucket is spread over tasks:

1. Short signatures only, of a fixed number of bits: a vector with a bucket partner whose signature
   differs in no more bits than a pair at the threshold does, five standard deviations allowed, is a
   candidate.
2. Vectors of candidates only: exact cosines in double precision. A pair counts in the first table in
   which its signatures share a key, so each link is counted once although it is found often. A leaf
   returns counts per vector and a spanning star of each component, never its pairs.

Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing, nor do
vectors of different lengths. Equal vec_ids are rows of their own; a null vec_id links like any other
but is never a component_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridtide.llm import leaves
from gridtide.llm.batches import arrow_schema, pick, record_batch
from gridtide.llm.graph import components, star
from gridtide.plans.work import written

THRESHOLD, RECALL, SEED, LEAF = 0.9, 0.97, 20_240, 512
# Bits per table: log2 of the number of vectors less this, so that a bucket holds about 2^8. Larger
# buckets cost bit counts inside tasks and save tables, each of which is a shuffled row per vector.
BUCKET_BITS = 8
SIGNATURE_BITS = 256
_FOUND = "kind int, a bigint, b bigint"


class Planes:
    """Sign bits and table keys of vectors of one length."""

    def __init__(self, count: int, threshold: float, recall: float, seed: int) -> None:
        agree = 1.0 - np.arccos(threshold) / np.pi
        self.bits = int(np.clip(np.ceil(np.log2(max(2, count))) - BUCKET_BITS, 4, 30))
        self.tables = int(np.ceil(np.log(1 - recall) / np.log(1 - agree**self.bits)))
        self.total = max(self.bits * self.tables, SIGNATURE_BITS)
        self.words = -(-self.total // 64)
        apart = (1 - agree) * SIGNATURE_BITS
        self.most = int(np.ceil(apart + 5 * np.sqrt(apart * agree)))
        self.seed = seed

    def signatures(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, words) packed sign bits; table t has the bits from t * bits on, the short signature the first."""
        normals = np.random.default_rng([self.seed, vectors.shape[1]]).standard_normal((vectors.shape[1], self.total))
        signs = vectors @ normals >= 0
        packed = np.zeros((len(vectors), self.words * 8), dtype=np.uint8)
        bytes_ = np.packbits(signs, axis=1, bitorder="little")
        packed[:, : bytes_.shape[1]] = bytes_
        return packed.view("<u8")

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """(rows, tables) numbers of the buckets."""
        out = np.empty((len(signatures), self.tables), dtype=np.int64)
        for table in range(self.tables):
            word, shift = divmod(table * self.bits, 64)
            value = signatures[:, word] >> np.uint64(shift)
            if shift + self.bits > 64:
                value = value | signatures[:, word + 1] << np.uint64(64 - shift)
            out[:, table] = (value & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        return out


def _sound(vectors: DataFrame) -> DataFrame:
    """Distinct usable vectors (v, number of rows ``size``, smallest vec_id ``least``)."""
    good = "size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) <> double('infinity')) AND exists(v, x -> x <> 0)"
    return vectors.filter(good).groupBy("v").agg(F.count("*").alias("size"), F.min("vec_id").alias("least"))


def link(
    embeddings: DataFrame,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    seed: int = SEED,
    leaf: int = LEAF,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    rows = pick(embeddings, vec_id=id_col, v=vector_col).withColumn("v", F.col("v").cast("array<double>"))
    classes = written(_sound(rows).withColumn("own", F.monotonically_increasing_id()))
    planes = Planes(classes.count(), threshold, recall, seed)
    signed = written(_signatures(classes, planes))
    active = _candidates(signed, planes, leaf)
    full = written(classes.select("own", "v", "size").join(active, "own"))
    found = written(_links(full, planes, threshold, leaf))
    counts = found.filter("kind = 0").groupBy(F.col("a").alias("own")).agg(F.sum("b").alias("n"))
    reached = components(found.filter("kind = 1").select("a", "b")).withColumnRenamed("node", "own")
    members = written(reached.join(classes.select("own", "least"), "own"))
    smallest = members.groupBy("component").agg(F.min("least").alias("smallest"))
    named = members.join(smallest, "component").select("own", "smallest")
    facts = (
        classes.select("own", "v", "size", "least")
        .join(counts, "own", "left")
        .join(named, "own", "left")
        .select("v", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n"), F.coalesce("smallest", "least").alias("component"))
    )
    component = F.coalesce("component", "vec_id")
    return rows.join(facts, "v", "left").select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def _signatures(classes: DataFrame, planes: Planes) -> DataFrame:
    out = arrow_schema("own bigint, signature array<bigint>, keys array<bigint>")

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                values = lists.take(pa.array(rows)).flatten().to_numpy().reshape(-1, size)
                signatures = planes.signatures(values)
                keys = planes.keys(signatures)
                yield record_batch(out, [batch.column(0).take(pa.array(rows)), signatures.view(np.int64).tolist(), keys.tolist()])

    return classes.select("own", "v").mapInArrow(run, "own bigint, signature array<bigint>, keys array<bigint>")


def _buckets(rows: DataFrame) -> DataFrame:
    """One row per table, under the bucket's key."""
    each = rows.select("*", F.posexplode("keys").alias("table", "bucket"), F.col("own").alias("rank"))
    return each.withColumn("key", F.shiftleft(F.col("table").cast("bigint"), 40) + F.col("bucket"))


def _leaf_pairs(cut: DataFrame) -> DataFrame:
    left = cut.select("key", F.col("leaf").alias("left"))
    return left.join(cut.select("key", F.col("leaf").alias("right")), "key").filter("left < right")


def _signed(array: pa.Array) -> np.ndarray:
    """Signatures of a leaf as a matrix of words."""
    return array.flatten().to_numpy().reshape(len(array), -1).view(np.uint64)


def _candidates(signed: DataFrame, planes: Planes, leaf: int) -> DataFrame:
    """own, signature and keys of the vectors with a close signature in some bucket."""
    short = F.slice("signature", 1, SIGNATURE_BITS // 64)
    cut = written(leaves.cut(_buckets(signed.select("own", short.alias("signature"), "keys")), ["own", "signature"], leaf))
    most = planes.most

    def apart(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        total = np.zeros((len(one), len(two)), dtype=np.int16)
        for word in range(one.shape[1]):
            total += np.bitwise_count(one[:, word][:, None] ^ two[:, word][None, :])
        return total

    def inside(key, columns):
        signature = _signed(columns[1])
        close = apart(signature, signature) <= most
        np.fill_diagonal(close, False)
        return [(columns[0].to_numpy()[close.any(axis=1)],)]

    def across(key, columns):
        close = apart(_signed(columns[1]), _signed(columns[3])) <= most
        one, two = columns[0].to_numpy()[close.any(axis=1)], columns[2].to_numpy()[close.any(axis=0)]
        return [(np.concatenate([one, two]),)]

    found = leaves.within(cut, inside, "own bigint").union(leaves.between(cut, _leaf_pairs(cut), across, "own bigint"))
    return signed.join(found.distinct(), "own")


class _Side:
    """Rows of a leaf with vectors of one length: ids, class sizes, bucket keys and unit vectors."""

    def __init__(self, columns: list[pa.Array], rows: np.ndarray, width: int, planes: Planes) -> None:
        take = pa.array(rows)
        self.own = columns[0].take(take).to_numpy()
        self.size = columns[2].take(take).to_numpy()
        self.keys = planes.keys(_signed(columns[3].take(take)))
        values = columns[1].take(take).flatten().to_numpy().reshape(-1, width)
        values = values / np.abs(values).max(axis=1, keepdims=True)
        self.unit = values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def _sides(columns: list[pa.Array], planes: Planes) -> dict[int, _Side]:
    widths = columns[1].value_lengths().to_numpy()
    return {w: _Side(columns, np.flatnonzero(widths == w), w, planes) for w in np.unique(widths).tolist()}


def _links(full: DataFrame, planes: Planes, threshold: float, leaf: int) -> DataFrame:
    """Rows (kind, a, b): b links of a (kind 0), and spanning links between a and b (kind 1)."""
    cut = written(leaves.cut(_buckets(full), ["own", "v", "size", "signature"], leaf))

    def close_pairs(key: int, one: _Side, two: _Side) -> np.ndarray:
        close = one.unit @ two.unit.T >= threshold
        for table in range(key >> 40):
            # A pair that met in an earlier table has been counted there.
            close &= one.keys[:, table][:, None] != two.keys[:, table][None, :]
        return close

    def inside(key, columns):
        out = []
        for side in _sides(columns, planes).values():
            close = close_pairs(key, side, side)
            np.fill_diagonal(close, False)
            out += _rows(side.own, close @ side.size, *np.nonzero(np.triu(close)))
        return out

    def across(key, columns):
        out = []
        first, second = _sides(columns[:4], planes), _sides(columns[4:], planes)
        for width in first.keys() & second.keys():
            one, two = first[width], second[width]
            close = close_pairs(key, one, two)
            left, right = np.nonzero(close)
            owners = np.concatenate([one.own, two.own])
            counts = np.concatenate([close @ two.size, close.T @ one.size])
            out += _rows(owners, counts, left, right + len(one.own))
        return out

    return leaves.within(cut, inside, _FOUND).union(leaves.between(cut, _leaf_pairs(cut), across, _FOUND))


def _rows(own: np.ndarray, counts: np.ndarray, one: np.ndarray, two: np.ndarray) -> list[tuple]:
    if not len(one):
        return []
    label = star(len(own), one, two)
    some, moved = np.flatnonzero(counts), np.flatnonzero(label != np.arange(len(own)))
    return [
        (np.zeros(len(some), dtype=np.int32), own[some], counts[some].astype(np.int64)),
        (np.ones(len(moved), dtype=np.int32), own[moved], own[label[moved]]),
    ]
