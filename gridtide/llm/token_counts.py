"""Token counts by a linear longest-match automaton.

A word is cut greedily: the longest vocabulary token from its start, again from there on, and so on.
The vocabulary is a trie. Each node has a failure link to the node that stands for what is left
of its string once the greedy tokens at its front are taken off, and the number of tokens taken off
(popped) on the way. So a word of n symbols is counted in n steps plus failures, of which there are no
more than tokens; no piece is ever built. A word that no sequence of greedy tokens covers is unknown
and counts as one token; an end mark left over alone is taken for nothing.

Symbols are the bytes of a word, in the vocabulary written as one printable character each. The
vocabulary marks the end of a word by a suffix, which is one symbol of its own, so the same string
inside a word and at its end stay apart. Words are runs without white space, lower-cased. Null
and empty texts have no words. Counts of words are kept while they fit a table of ``KNOWN_WORDS``
entries per task, which is then begun anew; no result depends on it.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import DataFrame

from gridtide.llm.batches import map_texts, pick

KNOWN_WORDS = 50_000
END = 256


class LongestMatch:
    """``tokens`` are sequences of symbols; the symbol END stands for the end of a word."""

    def __init__(self, tokens: Iterable[tuple[int, ...]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        whole = [False]
        parents: list[tuple[int, int]] = [(0, END)]
        for token in (*tokens, (END,)):
            node = 0
            for symbol in token:
                child = self.next[node].get(symbol)
                if child is None:
                    child = self.next[node][symbol] = len(self.next)
                    self.next.append({})
                    whole.append(False)
                    parents.append((node, symbol))
                node = child
            whole[node] = node > 0
        # A bare end of the word that no token takes along is no token.
        bare_end = self.next[0][END]
        # fail -1: nothing can be taken off the front, so a mismatch here has no tokens at all.
        self.fail, self.popped = [-1] * len(whole), [0] * len(whole)
        queue = deque(self.next[0].values())
        while queue:
            node = queue.popleft()
            queue.extend(self.next[node].values())
            if whole[node]:
                self.fail[node], self.popped[node] = 0, int(node != bare_end)
                continue
            parent, symbol = parents[node]
            rest, popped = self.fail[parent], self.popped[parent]
            while rest >= 0 and symbol not in self.next[rest]:
                popped += self.popped[rest]
                rest = self.fail[rest]
            if rest >= 0:
                self.fail[node], self.popped[node] = self.next[rest][symbol], popped

    def count(self, word: Iterable[int]) -> int:
        """Number of greedy tokens; 0 if the word has none."""
        node = total = 0
        edges, fail, popped = self.next, self.fail, self.popped
        for symbol in word:
            while (child := edges[node].get(symbol)) is None:
                if fail[node] < 0:
                    return 0
                total += popped[node]
                node = fail[node]
            node = child
        while node:
            if fail[node] < 0:
                return 0
            total += popped[node]
            node = fail[node]
        return total


@lru_cache(maxsize=2)
def load(data: bytes, suffix: str) -> LongestMatch:
    """Automaton of a tokenizer file's vocabulary; tokens that end in ``suffix`` end a word."""
    byte = printable_bytes()
    tokens = json.loads(data)["model"]["vocab"]
    plain = ((t.removesuffix(suffix), (END,) if t.endswith(suffix) else ()) for t in tokens)
    return LongestMatch((*map(byte.__getitem__, t), *end) for t, end in plain if all(c in byte for c in t))


def printable_bytes() -> dict[str, int]:
    """Character to byte: printable Latin-1 stands for itself, the other bytes follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + at): b for at, b in enumerate(hidden)}


def count_tokens(
    docs: DataFrame, vocabulary: str, suffix: str = "</w>", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown (words without greedy tokens) of every row."""
    with open(vocabulary, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def start():
        automaton = load(shared.value, suffix)
        known: dict[str, int] = {}

        def work(keys, texts):
            words, tokens, unknown = [], [], []
            for text in texts:
                found = text.lower().split() if text else []
                for word in set(found).difference(known):
                    known[word] = automaton.count((*word.encode(), END))
                counts = list(map(known.__getitem__, found))
                missing = counts.count(0)
                words.append(len(counts))
                tokens.append(sum(counts) + missing)
                unknown.append(missing)
                if len(known) > KNOWN_WORDS:
                    known.clear()
            yield keys[0], words, tokens, unknown

        return work

    schema = "doc_id bigint, n_words bigint, n_tokens bigint, n_unknown bigint"
    return map_texts(pick(docs, doc_id=id_col, text=text_col), start, schema, binary=False)
