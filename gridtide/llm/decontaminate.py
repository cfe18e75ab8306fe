"""Benchmark decontamination by a generalised suffix automaton.

The normalised words of all items form one suffix automaton. A document's words are streamed through
it; the length of the longest match ending at each word tells which words lie inside a window of an
item. A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is
one window.

Items are few beside the documents, but their size is checked: they are cut into blocks of about
``BLOCK_WORDS`` words, and each block's automaton is broadcast in a pass of its own over the documents.
A pass over one of several blocks passes on the hits alone, under a digest of the text they are in, never
texts; the hits of all blocks are merged by that digest. Items longer than a block become pieces that
overlap by a window less one word, so that every window lies in one piece. Null texts have no words; a
null item_id counts as the empty string; items with the same id are one item; a null doc_id stays null.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridtide.functions.columns import field
from gridtide.llm.batches import let, map_texts, pick, rewrite_texts
from gridtide.llm.words import split_alnum
from gridtide.plans.work import written

WINDOW = 10
# A document with a larger share of hit words is dropped; below it only the spans go.
MOST_COVERED = 0.5
BLOCK_WORDS = 100_000
WORD_BYTES = 5
# Word bytes of a text as it stands: ASCII letters, digits, and every byte above 127.
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
SPANS, NAMES = "array<struct<start:int,end:int>>", "array<string>"
HITS = f"doc_id bigint, n_words bigint, n_hit bigint, spans {SPANS}, items {NAMES}"


class SuffixAutomaton:
    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(name, [self.ids.setdefault(w, len(self.ids)) for w in words]) for name, words in items if words]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        # The state of a match's last ``window`` words, and the nearest state with a short item's end.
        self.tail = [-1] * len(order)
        for state in order:
            if self.length[state] >= window:
                up = self.link[state]
                self.tail[state] = state if self.length[up] < window else self.tail[up]
        self.found: dict[int, set[str]] = {}
        short: dict[int, list[tuple[int, str]]] = {}
        for name, words in items:
            state = 0
            for at, word in enumerate(words):
                state = self.next[state][word]
                if at + 1 >= window:
                    self.found.setdefault(self.tail[state], set()).add(name)
            if len(words) < window:
                while self.length[self.link[state]] >= len(words):
                    state = self.link[state]
                short.setdefault(state, []).append((len(words), name))
        self.short = short
        self.nearest_short = [-1] * len(order)
        for state in order:
            up = self.link[state]
            self.nearest_short[state] = state if state in short else self.nearest_short[up] if up >= 0 else -1
        self.least = min((min(len(words), window) for _, words in items), default=0)

    def _extend(self, last: int, word: int) -> int:
        target = self.next[last].get(word)
        if target is not None:
            if self.length[target] == self.length[last] + 1:
                return target
            return self._split(last, word, target)
        new = self._state(self.length[last] + 1, 0, {})
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            target = self.next[last][word]
            if self.length[target] == self.length[last] + 1:
                self.link[new] = target
            else:
                self.link[new] = self._split(last, word, target)
        return new

    def _split(self, last: int, word: int, target: int) -> int:
        copy = self._state(self.length[last] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while last >= 0 and self.next[last].get(word) == target:
            self.next[last][word] = copy
            last = self.link[last]
        return copy

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        return len(self.length) - 1

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Hit word ranges (end exclusive, merged) and the items whose windows occur."""
        spans: list[list[int]] = []
        names: set[str] = set()
        if not self.ids or len(words) < self.least:
            return spans, names
        ids = np.fromiter(map(self.ids.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        starts, ends = edge[::2], edge[1::2]
        long = ends - starts >= self.least
        for start, end in zip(starts[long].tolist(), ends[long].tolist()):
            self._scan_run(ids[start:end].tolist(), start, spans, names)
        return spans, names

    def _scan_run(self, ids: list[int], at: int, spans: list[list[int]], names: set[str]) -> None:
        state = matched = 0
        edges, link, length, window = self.next, self.link, self.length, self.window
        for at, word in enumerate(ids, at):
            while state and word not in edges[state]:
                state = link[state]
                matched = length[state]
            state = edges[state].get(word, 0)
            matched = matched + 1 if state else 0
            if matched >= window:
                names |= self.found[self.tail[state]]
                _cover(spans, at + 1 - matched, at + 1)
            mark = self.nearest_short[state]
            while mark >= 0:
                for size, name in self.short.get(mark, ()):
                    if size <= matched:
                        names.add(name)
                        _cover(spans, at + 1 - size, at + 1)
                up = self.link[mark]
                mark = self.nearest_short[up] if up >= 0 else -1


def _cover(spans: list[list[int]], start: int, end: int) -> None:
    """Add a range whose end is no smaller than those before."""
    while spans and spans[-1][1] >= start:
        start = min(start, spans.pop()[0])
    spans.append([start, end])


def find_hits(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document: word count, hit words, their ranges and the items (as text, sorted)."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    blocks = _blocks(pick(items, item_id=item_col, text=item_text_col), block_words, window)
    if len(blocks) == 1:
        return _scan(rows, _automaton(blocks[0], window))
    hits = _hits_of_texts(rows.select("text"), blocks, window)
    facts = map_texts(rows.select("doc_id", _digest(F.col("text")).alias("digest"), "text"), _counter, "doc_id bigint, digest string, n_words bigint")
    found = facts.join(hits, "digest", "left")
    span = "aggregate(spans, 0L, (n, s) -> n + s.end - s.start)"
    return found.select(
        "doc_id",
        "n_words",
        F.expr(f"coalesce({span}, 0L)").alias("n_hit"),
        F.coalesce("spans", F.expr(f"cast(array() AS {SPANS})")).alias("spans"),
        F.coalesce("items", F.expr(f"cast(array() AS {NAMES})")).alias("items"),
    )


def _digest(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def _counter():
    return lambda keys, texts: [(keys[0], keys[1], [len(split_alnum(text)) for text in texts])]


def _hits_of_texts(texts: DataFrame, blocks: list[DataFrame], window: int) -> DataFrame:
    """digest, spans (merged) and items (sorted) of every distinct text with a hit in some block."""
    named = texts.filter("text IS NOT NULL").select(_digest(F.col("text")).alias("digest"), "text")
    passes = [written(_hits(named, _automaton(block, window)).dropDuplicates(["digest"])) for block in blocks]
    together = reduce(DataFrame.union, passes).groupBy("digest").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    return written(together.select("digest", _merged_ranges(F.col("spans")).alias("spans"), "items"))


def _merged_ranges(spans: Column) -> Column:
    """Sorted ranges of which those that touch or overlap are one: one place in each text with hits."""

    def runs(places: Column) -> Column:
        # A run starts where the place before is missing, and ends where the next one is.
        starts = F.filter(places, lambda p, at: (at == 0) | (F.get(places, at - 1) < p - 1))
        ends = F.filter(places, lambda p, at: (at == F.size(places) - 1) | (F.get(places, at + 1) > p + 1))
        return F.zip_with(starts, ends, lambda low, high: F.struct(low.alias("start"), (high + 1).alias("end")))

    return let(F.array_sort(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["end"] - 1))))), runs)


def _blocks(items: DataFrame, block_words: int, window: int = WINDOW) -> list[DataFrame]:
    """The distinct items in parts of bounded size, by hash; long ones as overlapping pieces."""
    items = written(_in_pieces(items.distinct(), max(block_words, 1), window))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // (block_words * WORD_BYTES)))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    return [items.filter(part == at) if count > 1 else items for at in range(count)]


def _in_pieces(items: DataFrame, most: int, window: int) -> DataFrame:
    kind = items.schema["item_id"].dataType.simpleString()

    def start():
        def work(keys, texts):
            rows, pieces = [], []
            for at, text in enumerate(texts):
                words = split_alnum(text)
                for low in range(0, max(1, len(words) - window + 1), most):
                    rows.append(at)
                    pieces.append(b" ".join(words[low : low + most + window - 1]))
            yield keys[0].take(pa.array(rows, type=pa.int64())), pieces

        return work

    return map_texts(items.select("item_id", "text"), start, f"item_id {kind}, text string")


def clean(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    most_covered: float = MOST_COVERED,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The documents without the spans that benchmark items cover; all columns stay.

    A document of whose words more than ``most_covered`` are hit goes altogether. A span runs from its
    first word to the end of its last one; what stands around it stays. The hits of all blocks are found
    on the untouched texts and judged and cut together, so the result does not depend on the blocks.
    """
    blocks = _blocks(pick(items, item_id=item_col, text=item_text_col), block_words, window)
    columns = docs.columns
    if len(blocks) == 1:
        shared = _automaton(blocks[0], window)

        def start():
            scan = shared.value.scan
            return lambda texts: _cut([(text, scan(split_alnum(text))[0]) for text in texts], most_covered)

        return rewrite_texts(docs, start, text_col)
    hits = _hits_of_texts(docs.select(field(text_col).alias("text")), blocks, window)
    own, mark = (f"{name}_of_{'_'.join(columns)}" for name in ("row", "hits"))
    named = docs.select(F.struct(*(field(c) for c in columns)).alias(own), _digest(field(text_col)).alias("digest"))
    marked = named.join(hits.select("digest", F.col("spans").alias(mark)), "digest", "left")
    marked = marked.select(*(F.col(own)[c].alias(c) for c in columns), mark)

    def start_marked():
        def work(texts, spans):
            return _cut([(text, [(s["start"], s["end"]) for s in found or ()]) for text, found in zip(texts, spans)], most_covered)

        return work

    cut = rewrite_texts(marked, start_marked, text_col, beside=mark)
    return cut.select(*(field(c) for c in columns))


def _cut(found: list[tuple[bytes, list]], most_covered: float) -> tuple[list[bytes], list[bool]]:
    new, keep = [], []
    for text, spans in found:
        new.append(cut_words(text, spans) if spans else text)
        keep.append(sum(end - start for start, end in spans) <= most_covered * len(split_alnum(text)) if spans else True)
    return new, keep


def _automaton(items: DataFrame, window: int):
    """Broadcast automaton of one block of items, whose size the caller has checked."""
    texts = [(name or "", split_alnum((text or "").encode())) for name, text in items.select(F.col("item_id").cast("string"), "text").collect()]
    return items.sparkSession.sparkContext.broadcast(SuffixAutomaton(texts, window))


def _scan(rows: DataFrame, shared) -> DataFrame:
    def start():
        automaton = shared.value

        def work(keys, texts):
            counts, hits, spans, items = [], [], [], []
            for text in texts:
                words = split_alnum(text)
                ranges, names = automaton.scan(words)
                counts.append(len(words))
                hits.append(sum(high - low for low, high in ranges))
                spans.append([{"start": low, "end": high} for low, high in ranges])
                items.append(sorted(names))
            yield keys[0], counts, hits, spans, items

        return work

    return map_texts(rows, start, HITS)


def _hits(rows: DataFrame, shared) -> DataFrame:
    """digest, spans and items of the texts that this block hits."""

    def start():
        automaton = shared.value

        def work(keys, texts):
            rows, spans, items = [], [], []
            for at, text in enumerate(texts):
                ranges, names = automaton.scan(split_alnum(text))
                if ranges:
                    rows.append(at)
                    spans.append([{"start": low, "end": high} for low, high in ranges])
                    items.append(sorted(names))
            yield keys[0].take(pa.array(rows, type=pa.int64())), spans, items

        return work

    return map_texts(rows, start, f"digest string, spans {SPANS}, items {NAMES}")


def cut_words(text: bytes, spans: list[list[int]]) -> bytes:
    """The text without these word ranges, from each first word's start to the last word's end."""
    places = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    out, at = [], 0
    for low, high in spans:
        out.append(text[at : places[low][0]])
        at = places[high - 1][1]
    out.append(text[at:])
    return b"".join(out)
