import hashlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from gridtide.llm import substring_dedup
from gridtide.llm.queries import substring
from tests.llm.conftest import in_order


def plain(rows, window=13):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for at in range(len(w) - window + 1):
                key = tuple(w[at : at + window])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in words:
        gone = set()
        if i is not None:
            for at in range(len(w) - window + 1):
                if first[tuple(w[at : at + window])] < i:
                    gone.update(range(at, at + window))
        kept = b" ".join(x for at, x in enumerate(w) if at not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return in_order(out)


def result(frame):
    return in_order((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in frame.collect())


def test_query_equals_all_windows(spark, small, small_rows):
    assert result(substring(spark, small)) == plain(small_rows)


def test_edges(edge_docs, edge_rows):
    assert result(substring_dedup.remove_repeats(edge_docs)) == plain(edge_rows)


@pytest.mark.parametrize("window", [1, 4, 10, 40])
def test_other_windows_have_other_levels(spark, edge_docs, edge_rows, window):
    assert result(substring_dedup.remove_repeats(edge_docs, window)) == plain(edge_rows, window)


def test_levels_double():
    assert substring_dedup.levels(13) == [7, 13]
    assert substring_dedup.levels(50) == [7, 13, 25, 50]
    assert substring_dedup.levels(3) == [3]


def test_empty_table(no_docs):
    assert substring_dedup.remove_repeats(no_docs).collect() == []


def test_spans_and_kept_words(spark):
    shared = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"a {shared} b"), (2, f"x y {shared} z")], "doc_id bigint, text string")
    row = substring_dedup.remove_repeats(docs).filter("doc_id = 2").first()
    assert [(s.start, s.end) for s in row.spans] == [(2, 22)]
    assert row.kept == "x y z"


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40).map(" ".join), min_size=2, max_size=8))
def test_few_words_repeat_much(spark, texts):
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(substring_dedup.remove_repeats(docs, 6)) == plain(rows, 6)


def test_longest_repeats_double_until_none_survive(spark, edge_docs, edge_rows):
    found = in_order((r.doc_id, r.n_words, r.longest) for r in substring_dedup.longest_repeats(edge_docs, 5).collect())
    words = [(i, tuple((t or "").encode().split())) for i, t in edge_rows]
    named = {w for i, w in words if i is not None}

    def longest(own):
        size, best = 5, 0
        while own in named:
            windows = {own[at : at + size] for at in range(len(own) - size + 1)}
            if not any(w[at : at + size] in windows for w in named if w != own for at in range(len(w) - size + 1)):
                break
            size, best = 2 * size, size
        return best

    assert found == in_order((i, len(w), longest(w)) for i, w in words)
    assert {r[2] for r in found} >= {0, 10}


@pytest.mark.parametrize("order", ["up", "down", "mixed"])
def test_a_passage_in_every_document_over_many_slices(spark, order):
    """Shared passages beside long texts of their own, so that a slice holds few documents."""
    passage = " ".join(f"p{i}" for i in range(30))
    own = lambda i: " ".join(f"d{i}w{k}" for k in range(12_000))
    rows = [(i, f"{own(i)} {passage} {own(i + 1) if i % 5 == 0 else own(i * 1000)}") for i in range(60)]
    rows += [(100 + i, f"{passage} end{i % 3}") for i in range(9)] + [(None, passage), (7, passage)]
    random = np.random.default_rng(1)
    rows = rows[::-1] if order == "down" else [rows[i] for i in random.permutation(len(rows))] if order == "mixed" else rows
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2)

    assert result(substring_dedup.remove_repeats(docs)) == plain(rows)


def test_hot_hashes_are_sent_once_by_a_task():
    """The rows that slices of one task send for a passage that all of their documents hold."""
    random = np.random.default_rng(2)
    passage = random.integers(0, 2**63, 20).astype(np.uint64)
    hot, sent = substring_dedup._Hot(), []
    for slice_ in range(50):
        anchors = substring_dedup._Anchors()
        for content in range(4):
            own = random.integers(0, 2**63, 5).astype(np.uint64)
            anchors.add(slice_ * 10 + content, np.concatenate([passage, own]), np.arange(25))
        value, content, place, sure = anchors.settle(hot)
        sent.append(int(np.isin(value, passage).sum()))
        assert len(value) == sent[-1] + 20
        assert all(sorted(places) == list(range(20)) for places in sure)
    assert sent == [20] + [0] * 49


def test_remembered_hashes_are_bounded(monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_KEYS", 10)
    hot = substring_dedup._Hot()
    values = np.arange(30, dtype=np.uint64)
    hot.add(values[:7], values[:7], np.full(7, 5))
    hot.add(values[7:], values[7:], np.full(23, 6))
    assert len(hot.one) == 10 and hot.find(values, values)[0].sum() == 10
    assert not hot.find(values[:3], values[3:6])[0].any()
