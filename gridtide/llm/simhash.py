"""SimHash near-duplicates by a Gray-order hierarchical index.

A document's fingerprint has 64 bits: bit i is 1 where over half of the shingles' XXH64 values have it.
Fingerprints that differ in at most ``max_diff`` bits are linked; a document's component is the
smallest doc_id it reaches.

The index works on the distinct fingerprints, so copies never meet. Its upper nodes are masked bit
patterns that fingerprints share: the 64 bits are cut into ``max_diff + 2`` blocks, and two linked
fingerprints agree on two blocks at least, so each pair of blocks with its values is a node. The
fingerprints below a node are sorted by Gray rank, where neighbours differ in few bits, and cut into
leaves of bounded size (see leaves.py). Over a leaf stands a tree: a node keeps the bits shared by all
below it that its parent doesn't share, and a search adds up the differences on the way down and
leaves out every group whose sum exceeds ``max_diff``. Pairs of leaves of a hot node are compared
only if their shared patterns allow it. Inside a leaf only a spanning star of each found component
is returned, so a dense group gives as many links as members.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from gridtide.llm import leaves
from gridtide.llm.batches import map_texts, pick
from gridtide.llm.graph import components, star
from gridtide.llm.words import split_lower
from gridtide.plans.work import written

SHINGLE, SEED, MAX_DIFF = 3, 42, 3
LEAF, FAN_OUT, SMALL = 1024, 8, 24
LINKS = "a bigint, b bigint"
NODES_IN_A_TASK = 100_000


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """0 for no words; with fewer words than a shingle has, the whole sequence is the only one."""
    words = split_lower(text)
    if not words:
        return 0
    parts = zip(*(words[at:] for at in range(shingle))) if len(words) > shingle else [words]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    values = np.array([digest(join(part), SEED) for part in parts], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for low in range(0, len(values), 1 << 14):
        block = values[low : low + (1 << 14)]
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``fp``, the fingerprint's 64 bits as a signed number; null texts are empty."""

    def start():
        def work(keys, texts):
            values = np.array([fingerprint(text, shingle) for text in texts], dtype=np.uint64)
            yield keys[0], values.view(np.int64)

        return work

    return map_texts(pick(docs, doc_id=id_col, text=text_col), start, "doc_id bigint, fp bigint")


def gray_rank(value: Column) -> Column:
    """Place of a bit pattern in the Gray sequence, as a signed number of the same order."""
    for shift in (1, 2, 4, 8, 16, 32):
        value = value.bitwiseXOR(F.shiftrightunsigned(value, shift))
    return value.bitwiseXOR(F.lit(-(2**63)))


def _bits(value: Column, low: int, count: int) -> Column:
    return F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << count) - 1))


def link_fingerprints(prints: DataFrame, max_diff: int = MAX_DIFF, leaf: int = LEAF) -> DataFrame:
    """Links (a, b) that join exactly the distinct fingerprints ``fp`` reachable from each other."""
    blocks = max_diff + 2
    edges = [64 * at // blocks for at in range(blocks + 1)]
    keys = []
    for number, (one, two) in enumerate(combinations(range(blocks), 2)):
        high = _bits(F.col("fp"), edges[one], edges[one + 1] - edges[one])
        low = _bits(F.col("fp"), edges[two], edges[two + 1] - edges[two])
        keys.append(F.shiftleft(F.lit(number).cast("bigint"), 56) + F.shiftleft(high, 28) + low)
    rows = prints.select(F.explode(F.array(*keys)).alias("key"), gray_rank(F.col("fp")).alias("rank"), "fp")
    cut = written(leaves.cut(rows, ["fp"], leaf))

    def inside(key, columns):
        return _stars(_values(columns[0]), None, max_diff)

    def across(key, columns):
        return _stars(_values(columns[0]), _values(columns[1]), max_diff)

    found = leaves.within(cut, inside, LINKS)
    return found.union(leaves.between(cut, _leaf_pairs(cut, max_diff), across, LINKS))


def _leaf_pairs(cut: DataFrame, max_diff: int) -> DataFrame:
    """Pairs of leaves under one key whose shared bits differ in few enough places."""
    fold = "aggregate(slice(fp, 2, size(fp)), fp[0], (s, x) -> s {op} x)"
    heads = cut.select("key", "leaf", F.expr(fold.format(op="&")).alias("every"), F.expr(fold.format(op="|")).alias("some"))
    shared = "~(every ^ some)"
    left = heads.select("key", F.col("leaf").alias("left"), F.col("every").alias("p"), F.expr(shared).alias("s"))
    right = heads.select("key", F.col("leaf").alias("right"), F.col("every").alias("q"), F.expr(shared).alias("t"))
    both = left.join(right, "key").filter(f"left < right AND bit_count((p ^ q) & s & t) <= {max_diff}")
    return both.select("key", "left", "right")


def _values(array) -> np.ndarray:
    return np.asarray(array).view(np.uint64)


def _stars(left: np.ndarray, right: np.ndarray | None, max_diff: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Star links of the components that close pairs form within one leaf, or between two."""
    if right is None:
        values = left
        one, two = close_pairs(left, left, max_diff)
        on = one < two
        one, two = one[on], two[on]
    else:
        values = np.concatenate([left, right])
        one, two = close_pairs(left, right, max_diff)
        two = two + len(left)
    if not len(one):
        return []
    label = star(len(values), one, two)
    member = np.flatnonzero(label != np.arange(len(values)))
    signed = values.view(np.int64)
    return [(signed[member], signed[label[member]])]


def close_pairs(queries: np.ndarray, values: np.ndarray, max_diff: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, value) of all pairs within ``max_diff`` bits; ``values`` in Gray order."""
    if len(queries) * len(values) <= SMALL * SMALL:
        one, two = np.nonzero(np.bitwise_count(queries[:, None] ^ values[None, :]) <= max_diff)
        return one, two
    tree = _tree(values)
    one = np.repeat(np.arange(len(queries)), len(tree[0][0]))
    node = np.tile(np.arange(len(tree[0][0])), len(queries))
    spent = np.zeros(len(one), dtype=np.uint8)
    for level, (pattern, own) in enumerate(tree):
        if level:
            node = node[:, None] * FAN_OUT + np.arange(FAN_OUT)
            inside = node < len(pattern)
            one = np.broadcast_to(one[:, None], node.shape)[inside]
            spent = np.broadcast_to(spent[:, None], node.shape)[inside]
            node = node[inside]
        spent = spent + np.bitwise_count((queries[one] ^ pattern[node]) & own[node])
        on = spent <= max_diff
        one, node, spent = one[on], node[on], spent[on]
    return one, node


def _tree(values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the top: each node's pattern, and its shared bits that its parent does not share."""
    every, some = [values], [values]
    while len(every[-1]) > FAN_OUT:
        starts = np.arange(0, len(every[-1]), FAN_OUT)
        every.append(np.bitwise_and.reduceat(every[-1], starts))
        some.append(np.bitwise_or.reduceat(some[-1], starts))
    levels, above = [], None
    for low, high in zip(reversed(every), reversed(some)):
        shared = ~(low ^ high)
        own = shared if above is None else shared & ~np.repeat(above, FAN_OUT)[: len(shared)]
        levels.append((low, own))
        above = shared
    return levels


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE,
    max_diff: int = MAX_DIFF,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Documents without words have fingerprint 0 and are linked like any other. Equal doc_ids are
    separate rows with separate texts. A null doc_id links others but never is a component_id, unless
    nothing else is reached: then the component is null.
    """
    prints = written(fingerprints(docs, shingle, id_col, text_col))
    # Some MB a task, however many partitions the shuffle has.
    tasks = -(-prints.count() // NODES_IN_A_TASK) or 1
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")).coalesce(tasks))
    reached = components(link_fingerprints(nodes, max_diff)).withColumnRenamed("node", "fp")
    joined = written(reached.join(nodes, "fp"))
    smallest = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = joined.join(smallest, "component").select("fp", "component_id")
    labels = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(labels, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without the near copies: of each group the row of the smallest doc_id stays.

    Rows without a doc_id stay. Repeated rows of one doc_id stay all or none.
    """
    groups = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    copies = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(copies, docs[id_col] == copies["doc_id"], "left_anti")
