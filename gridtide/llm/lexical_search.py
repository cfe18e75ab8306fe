"""Ranked lexical search: documents grouped by which of an item's terms they hold, best masks first.

The items' distinct terms are a vocabulary. One pass over the documents counts each text's words and its
occurrences of vocabulary terms; document frequencies, and with them the integer weights, follow from
that by aggregates. A second pass takes the counted documents in blocks. In a block every term has a
bitmap of the documents that hold it. For an item the bitmaps of its terms are combined to the
candidates, and turned into one mask of matched terms per candidate. Equal masks form a group, whose
maximum score is the sum of the terms' highest contributions in the block. Groups are scored exactly
from the highest maximum down, until it is below the score of the ``top``-th document found so far:
what is left cannot be in the result. At equality the search goes on, since a smaller doc_id would win.
Terms whose maxima together stay below that score make no candidates (but count in their masks).

Each task keeps the best documents of every item over all its blocks; these meet in a ranked window.
Items are few beside the documents, but this is not taken for granted. The texts are read once for
every ``vocabulary`` distinct terms or so, which is once for all but enormous item tables, and the stored
counts once for every block of about ``block_terms`` terms of items. Both are parts by hash of the item.

Null and empty texts hold no term, so they count nowhere. Rows with the same item_id form one item of
all their terms; items and documents without a common term of positive weight have no rows. Rows with
the same doc_id are documents of their own; a null doc_id comes last among equal scores.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gridtide.llm.batches import arrow_schema, map_texts, pick, record_batch
from gridtide.llm.words import split_alnum
from gridtide.plans.work import written

TOP = 50
VOCABULARY, BLOCK_TERMS = 400_000, 1_000_000
# Documents and term occurrences of a block, within a batch of rows.
BLOCK_DOCS, BLOCK_POSTINGS = 8_192, 1_000_000
# Terms found in this many documents of a block get a bitmap that all items share.
SHARED_BITMAP = 64
COUNTED = "doc_id bigint, n bigint, terms array<int>, counts array<bigint>"
FOUND = "item bigint, doc_id bigint, score bigint"


def search(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    vocabulary: int = VOCABULARY,
    block_terms: int = BLOCK_TERMS,
    block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's ``top`` best documents."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    queries = written(_item_terms(pick(items, text=item_text_col, item_id=item_col)))
    distinct = queries.select(F.explode("terms").alias("term")).distinct().count()
    found = []
    for group in _parts(queries, -(-distinct // vocabulary)):
        index = _Index(rows, group)
        size = group.agg(F.sum(F.size("terms"))).first()[0] or 0
        found += [index.best(block, top, block_docs) for block in _parts(group, -(-size // block_terms))]
    every = found[0] if len(found) == 1 else reduce(DataFrame.union, map(written, found))
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(queries.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _parts(queries: DataFrame, count: int) -> list[DataFrame]:
    """The items in this many parts by hash. Parts of parts divide them anew."""
    if count <= 1:
        return [queries]
    part = F.pmod(F.xxhash64("item", F.lit(count)), F.lit(count))
    return [queries.filter(part == at) for at in range(count)]


def _item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, terms): one row per item_id that has a term."""
    kind = items.schema["item_id"].dataType.simpleString()

    def start():
        def work(keys, texts):
            words = [sorted(set(split_alnum(text))) for text in texts]
            yield keys[0], words

        return work

    listed = map_texts(items.select("item_id", "text"), start, f"item_id {kind}, terms array<binary>")
    each = listed.select("item_id", F.explode("terms").alias("term")).distinct()
    grouped = each.groupBy("item_id").agg(F.collect_list("term").alias("terms"))
    return grouped.withColumn("item", F.monotonically_increasing_id())


class _Index:
    """The documents' counts of the terms of some items, stored, and what the weights follow from."""

    def __init__(self, rows: DataFrame, queries: DataFrame) -> None:
        self.spark = rows.sparkSession
        terms = sorted(bytes(r.term) for r in queries.select(F.explode("terms").alias("term")).distinct().collect())
        self.number = {term: at for at, term in enumerate(terms)}
        counted = written(_count(rows, self.spark.sparkContext.broadcast(self.number)).filter("n > 0"))
        self.documents, self.words = counted.agg(F.count("*"), F.sum("n")).first()
        self.counted = counted.filter(F.size("terms") > 0)
        held = self.counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
        self.weights = np.zeros(len(terms), dtype=np.int64)
        for term, frequency in held:
            self.weights[term] = math.floor(1000 * math.log((2 * self.documents + 2) / (2 * frequency + 1)))

    def best(self, queries: DataFrame, top: int, block_docs: int) -> DataFrame:
        """Rows ``FOUND``: for each task the documents that may be among the best of each item."""
        wanted = {
            r.item: np.array([self.number[bytes(t)] for t in r.terms], dtype=np.int64) for r in queries.select("item", "terms").collect()
        }
        shared = self.spark.sparkContext.broadcast((self.weights, wanted, self.documents, self.words))
        return self.counted.mapInArrow(_ranker(shared, top, block_docs), FOUND)


def _count(rows: DataFrame, shared) -> DataFrame:
    def start():
        number = shared.value.get

        def work(keys, texts):
            sizes, terms, counts = [], [], []
            for text in texts:
                words = split_alnum(text)
                held = Counter(map(number, words))
                held.pop(None, None)
                sizes.append(len(words))
                terms.append(list(held))
                counts.append(list(held.values()))
            yield keys[0], sizes, terms, counts

        return work

    return map_texts(rows.select("doc_id", "text"), start, COUNTED)


def _ranker(shared, top: int, block_docs: int):
    out = arrow_schema(FOUND)

    def run(batches):
        weights, wanted, documents, words = shared.value
        best = {item: _Best(top) for item in wanted}
        for batch in batches:
            for low, high in _cuts(batch.column(2).offsets.to_numpy(), block_docs):
                block = _Block(batch.slice(low, high - low), weights, documents, words)
                for item, terms in wanted.items():
                    block.search(terms, best[item])
        for item, kept in best.items():
            if len(kept.score):
                ids = pa.array(kept.ids, mask=kept.null)
                yield record_batch(out, [np.full(len(kept.score), item), ids, kept.score])

    return run


def _cuts(offsets: np.ndarray, block_docs: int):
    """Row ranges of at most ``block_docs`` documents and about BLOCK_POSTINGS terms."""
    low = 0
    while low < len(offsets) - 1:
        high = int(np.searchsorted(offsets, offsets[low] + BLOCK_POSTINGS, side="right")) - 1
        high = min(max(high, low + 1), low + block_docs, len(offsets) - 1)
        yield low, high
        low = high


class _Best:
    """The best documents of one item so far, best first."""

    def __init__(self, top: int) -> None:
        self.top = top
        self.score = np.empty(0, dtype=np.int64)
        self.ids, self.null = np.empty(0, dtype=np.int64), np.empty(0, dtype=bool)

    @property
    def least(self) -> int:
        """A document with a smaller score than this cannot be in the result."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        fit = score >= self.least
        score = np.concatenate([self.score, score[fit]])
        ids, null = np.concatenate([self.ids, ids[fit]]), np.concatenate([self.null, null[fit]])
        order = np.lexsort((ids, null, -score))[: self.top]
        self.score, self.ids, self.null = score[order], ids[order], null[order]


class _Block:
    """Postings of some documents by term: documents in order, contributions, maxima, bitmaps."""

    def __init__(self, batch: pa.RecordBatch, weights: np.ndarray, documents: int, words: int) -> None:
        ids = batch.column(0)
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()
        self.docs = len(self.ids)
        n = batch.column(1).to_numpy()
        terms, counts = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
        doc = np.repeat(np.arange(self.docs), batch.column(2).value_lengths().to_numpy())
        length = 50 + 50 * n * documents // words
        gain = weights[terms] * (1_000_000_000 * counts // (1000 * counts + 20 * length[doc]))
        order = np.argsort(terms, kind="stable")
        self.doc, self.gain = doc[order], gain[order]
        self.terms, starts = np.unique(terms[order], return_index=True)
        self.starts = np.append(starts, len(order))
        self.most = np.maximum.reduceat(self.gain, starts) if len(starts) else starts
        self.bitmaps: dict[int, np.ndarray] = {}

    def _bitmap(self, at: int) -> np.ndarray:
        found = self.bitmaps.get(at)
        if found is None:
            low, high = self.starts[at], self.starts[at + 1]
            flags = np.zeros(self.docs, dtype=np.uint8)
            flags[self.doc[low:high]] = 1
            found = np.packbits(flags)
            if high - low >= SHARED_BITMAP:
                self.bitmaps[at] = found
        return found

    def search(self, terms: np.ndarray, best: _Best) -> None:
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        at = at[self.terms[at] == terms]
        # Highest maximum first; a weight of zero adds nothing.
        at = at[np.argsort(-self.most[at], kind="stable")]
        at = at[self.most[at] > 0]
        most = self.most[at]
        # The sum of the maxima of this term and all weaker ones: below the least score they alone
        # make no candidate.
        rest = np.cumsum(most[::-1])[::-1]
        essential = int((rest >= best.least).sum())
        if not essential:
            return
        bitmaps = np.stack([self._bitmap(a) for a in at.tolist()])
        docs = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bitmaps[:essential]), count=self.docs))
        present = np.unpackbits(bitmaps, axis=1, count=self.docs)[:, docs]
        group, first = _groups(present)
        bound = most @ present[:, first].astype(np.int64)
        order = np.argsort(-bound, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        members = np.argsort(place[group], kind="stable")
        ends = np.cumsum(np.bincount(place[group], minlength=len(order)))
        done, want = 0, best.top
        while done < len(order) and bound[order[done]] >= best.least:
            # As many masks as can still matter, in steps of a growing number of documents.
            possible = int(np.searchsorted(-bound[order], -best.least, side="right"))
            before = int(ends[done - 1]) if done else 0
            upto = min(possible, int(np.searchsorted(ends, before + want)) + 1)
            chosen = np.sort(docs[members[before : ends[upto - 1]]])
            best.add(self._scores(chosen, at), self.ids[chosen], self.null[chosen])
            done, want = upto, want * 2

    def _scores(self, docs: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.zeros(len(docs), dtype=np.int64)
        for a in at.tolist():
            low, high = self.starts[a], self.starts[a + 1]
            held = self.doc[low:high]
            place = np.minimum(np.searchsorted(held, docs), len(held) - 1)
            total += np.where(held[place] == docs, self.gain[low:high][place], 0)
        return total


def _groups(present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a (terms, documents) presence matrix: each document's group of equal masks, and one
    document of each group."""
    masks = np.packbits(present, axis=0)
    words = np.zeros((present.shape[1], -(-len(masks) // 8) * 8), dtype=np.uint8)
    words[:, : len(masks)] = masks.T
    group = np.zeros(present.shape[1], dtype=np.int64)
    for word in words.view(np.uint64).T:
        values = np.unique(word, return_inverse=True)[1]
        group = np.unique(group * (int(values.max(initial=0)) + 1) + values, return_inverse=True)[1]
    return group, np.unique(group, return_index=True)[1]
