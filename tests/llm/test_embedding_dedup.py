import numpy as np
import pytest

from gridtide.llm import embedding_dedup
from gridtide.llm.queries import embedding_links

SCHEMA = "vec_id bigint, embedding array<double>, key string, own string, size string"


def plain(rows, threshold=0.9):
    good = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    good = [(i, v / np.abs(v).max()) for i, v in good]
    links, group = [0] * len(good), list(range(len(good)))
    for a in range(len(good)):
        for b in range(a):
            x, y = good[a][1], good[b][1]
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[a] += 1
                links[b] += 1
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(good, group):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    out = [(i, n, least.get(g), i is not None and i == least.get(g)) for (i, _), n, g in zip(good, links, group)]
    bad = [i for i, v in rows if not (v and None not in v and np.isfinite(v).all() and any(v))]
    return sorted([*out, *((i, 0, i, i is not None) for i in bad)], key=repr)


def result(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "k", "o", "s") for i, v in rows], SCHEMA).repartition(3)


def test_query(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert result(embedding_links(spark, small)) == plain(rows)


def test_edges(spark):
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.1]), (4, [0.0, 1.0]), (5, None), (6, []), (7, [0.0, 0.0]),
        (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (10, [None, 1.0]), (11, [1.0, 0.0, 0.0]), (12, [1e-300, 0.0]),
        (13, [-1.0, -0.0]), (None, [0.0, 1.0]), (4, [0.0, 1.0]), (14, [1e300, 1e299]), (None, None), (15, [0.0, 0.0, 1.0]), (15, [0.1, 0.0, 1.0]),
    ]
    assert result(embedding_dedup.link(frame(spark, rows))) == plain(rows)
    assert embedding_dedup.link(frame(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("leaf", [4, 512])
def test_recall_and_dense_groups_over_many_leaves(spark, leaf):
    random = np.random.default_rng(11)
    rows = [(i, v.tolist()) for i, v in enumerate(random.standard_normal((400, 16)))]
    centre = random.standard_normal(16)
    rows += [(1000 + i, (centre + 0.12 * random.standard_normal(16)).tolist()) for i in range(40)]
    rows += [(2000 + i, rows[5][1]) for i in range(30)]
    found, true = result(embedding_dedup.link(frame(spark, rows), leaf=leaf)), plain(rows)
    links = lambda out: sum(n for _, n, *_ in out)
    assert 0.95 * links(true) <= links(found) <= links(true)
    assert all(f[1] <= t[1] for f, t in zip(sorted(found, key=lambda r: r[0]), sorted(true, key=lambda r: r[0])))
    assert np.mean([f == t for f, t in zip(found, true)]) > 0.95


def test_what_a_vector_sends_stays_small():
    """Bytes per vector over all tables of the first pass: key, id, rank and the short signature."""
    for count, most in ((10**5, 1_000), (10**8, 5_000), (10**10, 12_000)):
        planes = embedding_dedup.Planes(count, 0.9, 0.97, 1)
        assert planes.tables * (24 + embedding_dedup.SIGNATURE_BITS // 8) < most
        assert planes.words * 8 < 700


def test_recall_of_random_close_pairs(spark):
    """Pairs at a cosine of about 0.9 to 0.95 among many others."""
    random = np.random.default_rng(12)
    rows = [(i, v.tolist()) for i, v in enumerate(random.standard_normal((3000, 32)))]
    for i in range(400):
        one = np.array(rows[i][1])
        noise = random.standard_normal(32)
        noise -= noise @ one / (one @ one) * one
        cosine = 0.9 + 0.05 * random.random()
        rows.append((5000 + i, (one + noise * np.linalg.norm(one) / np.linalg.norm(noise) * np.sqrt(1 / cosine**2 - 1)).tolist()))
    links = lambda out: {r[0]: r[1] for r in out}
    found = links(result(embedding_dedup.link(frame(spark, rows))))
    v = np.array([x for _, x in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    close = v @ v.T >= 0.9
    np.fill_diagonal(close, False)
    true = {i: int(n) for (i, _), n in zip(rows, close.sum(axis=1))}
    assert all(found[i] <= true[i] for i in true)
    assert sum(found.values()) >= 0.95 * sum(true.values())
