"""Quality scores: histogram gradient-boosted trees over statistics of a document.

The trees are fitted on a bounded sample of labelled rows (labelled.SAMPLE_ROWS) and sent to the tasks
as flat arrays. Statistics cover the whole text and use nothing but the text. Null and empty texts have
statistics of zero and get the score that the trees give these.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, functions as F

from gridtide.llm import boosting
from gridtide.llm.batches import map_texts, pick
from gridtide.llm.labelled import SAMPLE_ROWS, held_out, sample

MODULUS, REST, CUT = 5, 0, 0.3
_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_HIGH = _BYTES > 127
_SIGN = ~(_UPPER | _LOWER | _DIGIT | _SPACE | _HIGH)
_STOP = np.isin(_BYTES, list(b".,;:"))
_CLASSES = np.stack([_UPPER, _LOWER, _DIGIT, _SPACE, _HIGH, _SIGN, _SIGN & ~_STOP], axis=1).astype(np.float64)
STATISTICS = 27


def statistics(text: bytes | None) -> list[float]:
    """Lengths, character classes, repetition of words, pairs and lines, and word shapes."""
    if not text:
        return [0.0] * STATISTICS
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    size = len(text)
    classes = counts @ _CLASSES / size
    chance = counts[counts > 0] / size
    words = text.split()
    n = len(words)
    if not n:
        return [float(np.log1p(size)), *classes, *[0.0] * (STATISTICS - 8)]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    kinds = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    lines = [line for line in text.split(b"\n") if line.strip()]
    unlike = sum(c for w, c in kinds.items() if not (w.rstrip(b".,;:!?").isalpha() or max(w) > 127))
    signs = sum(c for w, c in kinds.items() if w[-1:] in b"!#$%&*|+=~^<>@")
    capitals = sum(c for w, c in kinds.items() if w.isupper() and len(w) > 1)
    alone = sum(c for w, c in kinds.items() if len(w) == 1 and not w.isalnum())
    ended = sum(c for w, c in kinds.items() if w[-1:] in b".?!")
    line_kinds = Counter(lines)
    return [
        float(np.log1p(size)),
        *classes,
        float(-(chance * np.log(chance)).sum()),
        float(np.log1p(n)),
        float(lengths.mean()),
        float(lengths.std()),
        float(np.log1p(lengths.max())),
        len(kinds) / n,
        len(kinds) / n**0.75,
        max(kinds.values()) / n,
        len(pairs) / max(1, n - 1),
        max(pairs.values(), default=0) / max(1, n - 1),
        unlike / n,
        signs / n,
        capitals / n,
        alone / n,
        ended / n,
        float(np.log1p(len(lines))),
        n / max(1, len(lines)),
        len(line_kinds) / max(1, len(lines)),
        max(line_kinds.values(), default=0) / max(1, len(lines)),
    ]


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, **options) -> boosting.Trees:
    """Trees for the ``quality`` label, from a bounded sample outside the held-out part."""

    def start():
        def work(keys, texts):
            yield keys[0], [statistics(text) for text in texts]

        return work

    rows = sample(docs, labels, "quality", MODULUS, REST, sample_rows)
    found = map_texts(rows, start, "label bigint, x array<double>").toPandas()
    x = np.array(found["x"].tolist(), dtype=np.float64).reshape(-1, STATISTICS)
    order = np.lexsort((*x.T, found["label"].to_numpy()))
    return boosting.fit(x[order], found["label"].to_numpy(dtype=np.float64)[order], **options)


def score(docs: DataFrame, model: boosting.Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row: near 1 where label 1 is likely."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        def work(keys, texts):
            x = np.array([statistics(text) for text in texts], dtype=np.float64).reshape(-1, STATISTICS)
            yield keys[0], shared.value.scores(x)

        return work

    return map_texts(pick(docs, doc_id=id_col, text=text_col), start, "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """Fit, then doc_id, held_out, score and predicted for every document."""
    return score(docs, fit(docs, labels)).select(
        "doc_id",
        held_out(F.col("doc_id"), MODULUS, REST).alias("held_out"),
        "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )
