import math
import re
from collections import Counter

import numpy as np
import pytest

from gridtide.llm import lexical_search
from gridtide.llm.queries import ranked_documents
from tests.llm.conftest import EXTRA, in_order

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w.translate(LOWER) for w in WORD.findall(text or "")]


def plain(docs, items, top=50):
    counted = [(i, Counter(words(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    total, length = len(counted), sum(n for *_, n in counted)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(words(text))
    held = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, terms in asked.items():
        scored = []
        for doc, counts, n in counted:
            m = 50 + 50 * n * total // length
            score = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * held[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 20 * m))
                for t in terms
                if t in counts
            )
            if score > 0:
                scored.append((score, doc))
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out += [(item, rank, doc, score) for rank, (score, doc) in enumerate(scored[:top], 1)]
    return in_order(out)


def result(found):
    return in_order(tuple(r) for r in found.collect())


def frames(spark, docs, items):
    extra = ", ".join(f"{c} string" for c in EXTRA)
    left = spark.createDataFrame([(i, t, *EXTRA.values()) for i, t in docs], f"doc_id bigint, text string, {extra}")
    right = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id string, text string, item string, n bigint")
    return left.repartition(3), right.repartition(2)


ITEMS = [
    ("a", "one two THREE"), ("b", None), ("c", ""), ("d", "text short"), ("a", "four, one"), ("e", "same"), ("f", "1 2 3 4"), (None, "漢字 ünïcödé"),
    ("g", "nothing of it anywhere-else zzz"), ("h", " \t "), ("a", "one two THREE"), ("i", "word"),
]


def test_query(spark, small, small_rows):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert result(ranked_documents(spark, small)) == plain(small_rows, items)


@pytest.mark.parametrize(("top", "vocabulary", "block_terms"), [(50, 200_000, 200_000), (3, 200_000, 4), (2, 4, 200_000), (1, 5, 3)])
def test_edges(spark, edge_rows, top, vocabulary, block_terms):
    found = lexical_search.search(*frames(spark, edge_rows, ITEMS), top=top, vocabulary=vocabulary, block_terms=block_terms)
    assert result(found) == plain(edge_rows, ITEMS, top)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]


def test_empty_tables(spark, edge_rows):
    docs, items = frames(spark, edge_rows, ITEMS)
    assert lexical_search.search(docs.limit(0), items).collect() == []
    assert lexical_search.search(docs, items.limit(0)).collect() == []
    assert lexical_search.search(docs.filter("text IS NULL"), items).collect() == []


def test_ties_take_the_smallest_ids(spark):
    docs = [(i, "alpha beta" if i % 2 else "alpha gamma") for i in range(400)] + [(i, "delta") for i in range(400, 900)]
    items = [("x", "alpha"), ("y", "beta gamma"), ("z", "alpha beta gamma delta epsilon")]
    assert result(lexical_search.search(*frames(spark, docs, items))) == plain(docs, items)


@pytest.mark.parametrize("block_docs", [1, 64, 8_192])
def test_random_texts_over_blocks(spark, block_docs):
    random = np.random.default_rng(8)
    rate = 1.0 / np.arange(1, 301)
    draw = lambda n: " ".join(f"w{k}" for k in random.choice(300, size=n, p=rate / rate.sum()))
    docs = [(int(i), draw(int(random.integers(1, 60)))) for i in random.permutation(900)]
    items = [(f"q{i}", draw(int(random.integers(1, 150)))) for i in range(25)]
    found = lexical_search.search(*frames(spark, docs, items), top=7, block_docs=block_docs)
    assert result(found) == plain(docs, items, 7)


def test_blocks_are_bounded():
    offsets = np.concatenate(([0], np.cumsum([5, 0, 3_000_000, 1, 1, 999_990, 20, 7])))
    cuts = list(lexical_search._cuts(offsets, 3))
    assert [low for low, _ in cuts][1:] == [high for _, high in cuts][:-1] and cuts[-1][1] == 8
    assert all(high - low == 1 or offsets[high] - offsets[low] <= lexical_search.BLOCK_POSTINGS for low, high in cuts)
    assert max(high - low for low, high in cuts) <= 3


def test_groups_of_equal_masks():
    random = np.random.default_rng(9)
    for terms in (1, 8, 63, 64, 65, 200):
        present = (random.random((terms, 500)) < 0.5 / terms).astype(np.uint8)
        group, first = lexical_search._groups(present)
        masks = [tuple(present[:, d]) for d in range(500)]
        assert len(set(masks)) == len(first)
        assert all(masks[first[group[d]]] == masks[d] for d in range(500))
