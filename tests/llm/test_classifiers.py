import zlib

import numpy as np
import pytest

from gridtide.llm import boosting, labelled, quality, queries, toxicity

CASES = [(queries.toxic_scores, "toxic", 4, 2, 0.85), (queries.quality_scores, "quality", 5, 0, 0.95)]


@pytest.mark.parametrize(("query", "label", "modulus", "rest", "least"), CASES)
def test_held_out_accuracy(spark, query, label, modulus, rest, least):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = query(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    known = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([y == p for y, p in known]) >= least


@pytest.mark.parametrize(("query", "label", "recall", "precision"), [(queries.toxic_scores, "toxic", 0.9, 0.85), (queries.quality_scores, "quality", 0.97, 0.97)])
def test_held_out_recall_and_precision(spark, query, label, recall, precision):
    """On a table large enough that a classifier which always says 0 fails."""
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    known = [(labels[r.doc_id], r.predicted) for r in query(spark, folder).collect() if r.held_out and r.doc_id in labels]
    right = sum(y and p for y, p in known)
    assert sum(y for y, _ in known) > 100
    assert right >= recall * sum(y for y, _ in known)
    assert right >= precision * sum(p for _, p in known)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_edges(spark, edge_docs, edge_rows, no_docs, module):
    label = "quality" if module is quality else "toxic"
    rows = [(i, i % 2, "x") for i, _ in edge_rows if i is not None] + [(None, 1, "x"), (3, None, "x"), (1, 1, "y")]
    labels = spark.createDataFrame(rows, f"doc_id bigint, {label} int, text string")
    found = module.classify(edge_docs, labels).collect()
    assert sorted((r.doc_id for r in found), key=repr) == sorted((i for i, _ in edge_rows), key=repr)
    assert all(0 <= r.score <= 1 for r in found)
    assert all(r.held_out is False for r in found if r.doc_id is None)
    assert module.classify(no_docs, labels).collect() == []
    assert len(module.classify(edge_docs, labels.limit(0)).collect()) == len(edge_rows)


def test_boosted_trees_learn_an_interaction():
    random = np.random.default_rng(3)
    x = random.random((4000, 5))
    y = ((x[:, 0] > 0.4) ^ (x[:, 3] > 0.7)).astype(float)
    model = boosting.fit(x[:3000], y[:3000], trees=40)
    assert ((model.scores(x[3000:]) > 0.5) == y[3000:]).mean() > 0.97


def test_flat_traversal_equals_walking_each_tree():
    random = np.random.default_rng(4)
    x, y = random.random((300, 3)), random.integers(0, 2, 300).astype(float)
    model = boosting.fit(x, y, trees=7, depth=3)
    for row, margin in zip(x, model.margins(x)):
        total = model.start
        for feature, threshold, value in zip(model.feature, model.threshold, model.value):
            node = 0
            while 2 * node + 1 < len(value):
                node = 2 * node + 1 + int(row[feature[node]] > threshold[node])
            total += value[node]
        assert total == pytest.approx(margin)


def test_one_class_or_no_rows():
    assert boosting.fit(np.zeros((0, 2)), np.zeros(0)).scores(np.zeros((3, 2))).shape == (3,)
    assert (boosting.fit(np.ones((9, 2)), np.ones(9)).scores(np.ones((1, 2))) > 0.5).all()


@pytest.fixture(scope="module")
def scorer():
    return toxicity.Scorer({"idiot": 4.0, "stup*": 3.0})


def clause(scorer, text):
    return scorer.describe(text.encode())[1]


def test_grammar_weighs_clauses(scorer):
    plain = clause(scorer, "what an idiot")
    assert clause(scorer, "you are an idiot") > plain
    assert clause(scorer, "an idiot you are") > plain
    assert clause(scorer, "not an idiot") < plain
    assert clause(scorer, "he said an idiot came") < plain
    assert clause(scorer, "he said so. what an idiot") == pytest.approx(plain)
    assert clause(scorer, "a stupidly long day") > 0
    assert clause(scorer, "a fine day") == 0
    assert clause(scorer, "i will kill you") > clause(scorer, "to kill time")


def test_composition_is_the_product_of_its_parts():
    one = toxicity.countdown(toxicity.NEGATION, 2, {toxicity.INSULT: 0.5}, {})
    two = toxicity.countdown(toxicity.REPORT, -1, {toxicity.INSULT: 0.1}, {})
    both = one.compose(two)
    random = np.random.default_rng(5)
    for _ in range(50):
        a = b = c = 0
        for symbol in random.integers(0, 6, 12).tolist():
            assert both.factor[c, symbol] == pytest.approx(one.factor[a, symbol] * two.factor[b, symbol])
            a, b, c = one.step[a, symbol], two.step[b, symbol], both.step[c, symbol]


def test_copies_of_a_document_enter_the_sample_once(spark):
    docs = spark.createDataFrame([(1, "one")] * 50 + [(2, "two"), (2, "other")], "doc_id bigint, text string")
    labels_of = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    rows = labelled.sample(docs, labels_of, "quality", 1_000_003, -1).collect()
    assert sorted((r.label, r.text) for r in rows) == [(0, "other"), (0, "two"), (1, "one")]


def plain_path(symbols):
    """The five rules read one by one, without states."""
    kinds = [hit[0] if hit else toxicity.OTHER for hit in symbols]
    score = threat = 0.0
    for at, hit in enumerate(symbols):
        if not hit or not hit[1]:
            continue
        near = kinds[max(0, at - toxicity.SCOPE) : at]
        gain = hit[1]
        if hit[0] == toxicity.THREAT:
            gain *= 1.0 if toxicity.TARGET in near else 0.25
        if hit[0] == toxicity.INSULT:
            gain *= 1.5 if toxicity.TARGET in near else 1.0
        if toxicity.NEGATION in near:
            gain *= 0.3
        if toxicity.REPORT in kinds[:at]:
            gain *= 0.6
        score += gain
        threat = max(threat, gain if hit[0] == toxicity.THREAT else 0.0)
    return score, threat


def test_grammar_equals_the_rules_read_one_by_one(scorer):
    random = np.random.default_rng(6)
    for _ in range(400):
        symbols = []
        for kind in random.choice(6, size=int(random.integers(1, 16)), p=[0.4, 0.15, 0.15, 0.1, 0.1, 0.1]).tolist():
            weight = float(random.integers(1, 9)) if kind in (toxicity.INSULT, toxicity.THREAT) else 0.0
            symbols.append((kind, weight) if kind else None)
        kinds = {hit[0] for hit in symbols if hit}
        wanted = plain_path(symbols)
        if toxicity.TARGET in kinds and not kinds & {toxicity.NEGATION, toxicity.REPORT}:
            wanted = max(wanted, plain_path(symbols[::-1]))
        assert scorer._clause(symbols) == pytest.approx(wanted)


@pytest.mark.parametrize("seed", range(6))
def test_regression_reaches_the_optimum(seed):
    """Separable and other rows: no small change of the weights lowers the loss, and classes come apart."""
    random = np.random.default_rng(seed)
    count = [60, 2000, 20_000][seed % 3]
    labels = (random.random(count) < 0.1).astype(float)
    rows = np.abs(random.standard_normal((count, toxicity.FEATURES))) * 0.3
    rows[:, :4] = (labels * (2 + random.random(count)))[:, None] * random.random(4) * 3 + (random.random(count) < 0.02 * (seed > 2))[:, None]
    rows[:, -1] = np.log1p(random.integers(0, 5000, count))
    weights = toxicity._regression(rows, labels)
    x, ridge = np.hstack([rows, np.ones((count, 1))]), np.eye(toxicity.FEATURES + 1) * 0.1
    ridge[-1, -1] = 1e-6
    best = toxicity._loss(x, labels, weights, ridge)
    for at in range(len(weights)):
        for change in (-1e-2, 1e-2):
            near = weights.copy()
            near[at] = near[at] + change if at >= toxicity.FEATURES - 1 else max(0.0, near[at] + change)
            assert toxicity._loss(x, labels, near, ridge) >= best - 1e-6
    assert (weights[:-2] >= 0).all()
    scores = toxicity._sigmoid(x @ weights)
    assert (scores[labels == 1] >= 0.3).mean() > 0.98 and (scores[labels == 0] < 0.3).mean() > 0.98


def test_nothing_learned_scores_low():
    weights = toxicity._regression(np.zeros((0, toxicity.FEATURES)), np.zeros(0))
    assert toxicity._sigmoid(weights[-1:])[0] == pytest.approx(toxicity.UNLEARNED)
