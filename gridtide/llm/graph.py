"""Connected components of an undirected graph given as a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from gridtide.llm.batches import arrow_schema, record_batch
from gridtide.plans.work import written


# Up to this many links, some MB, one task settles the graph; beyond it the rounds below do.
SMALL_LINKS = 200_000


def components(links: DataFrame, small: int = SMALL_LINKS) -> DataFrame:
    """From links (a, b) of 64-bit ids to (node, component), the smallest id that each node reaches.

    Alternating large-star and small-star steps: every step links each node's neighbours to its
    smallest neighbour, until all links point at the smallest node of their component. Minima are
    combined before they are shuffled, and the join that spreads them lets Spark split a node with
    very many neighbours. Each round is written to the work folder, which also cuts the lineage. Of a few
    links, counted first, the rounds would be many tasks and plans around almost no rows: then one task
    does the same. Self-links, repeated links and nulls are allowed; an empty table gives an empty result.
    """
    ends = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.col("a").isNull().alias("n"))
    now = written(ends.filter("NOT n AND a IS NOT NULL AND b IS NOT NULL AND a > b").select("a", "b").distinct())
    if now.count() <= small:
        return written(now.coalesce(1).mapInArrow(_settle(), _SETTLED))
    state = _state(now)
    while state[0]:
        after = written(_small_star(_large_star(now)))
        changed = _state(after)
        now = after
        if changed == state:
            break
        state = changed
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(now.select("b", "b")).distinct()


_SETTLED = "node bigint, component bigint"


def _settle():
    out = arrow_schema(_SETTLED)

    def run(batches):
        ends = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
        if not ends:
            return
        one, two = (np.concatenate(column) for column in zip(*ends))
        nodes = np.unique(np.concatenate([one, two]))
        label = star(len(nodes), np.searchsorted(nodes, one), np.searchsorted(nodes, two))
        yield record_batch(out, [nodes, nodes[label]])

    return run


def _state(links: DataFrame) -> tuple:
    """Equal for equal sets of links; the links themselves stay on the executors.

    The hashes have either sign, so a sum of 40-bit parts stays far inside a bigint for any table.
    """
    mixed = F.xxhash64("a", "b")
    parts = (F.count("*"), F.sum(F.shiftright(mixed, 24)), F.bit_xor(mixed), F.sum(F.shiftright(F.xxhash64("b", "a"), 24)))
    return tuple(links.agg(*parts).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def star(count: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """For nodes 0 to count - 1 of a small graph with links (one, two): each node's smallest reachable."""
    label = np.arange(count)
    while True:
        left, right = label[one], label[two]
        low = np.minimum(left, right)
        new = label.copy()
        # The ends of a link take its smaller label, and so do the nodes that stood for them.
        for ends in (one, two, left, right):
            np.minimum.at(new, ends, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new
