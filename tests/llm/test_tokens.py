import base64
import hashlib
import json

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from gridtide.llm import byte_bpe, token_counts
from gridtide.llm.queries import BYTE_BPE, WORD_PIECES, byte_bpe_codes, byte_bpe_digest, word_piece_counts


@pytest.fixture(scope="module")
def codec():
    with open(BYTE_BPE, "rb") as file:
        return byte_bpe.load(file.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def tokens():
    with open(BYTE_BPE, "rb") as file:
        return byte_bpe.load_tokens(file.read())


@pytest.fixture(scope="module")
def tiktoken_encode():
    with open(BYTE_BPE, "rb") as file:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, file)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    ).encode_ordinary


def digests(ids, text):
    packed = np.array(ids, dtype="<u4").tobytes()
    return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_tiktoken(spark, small, small_rows, tiktoken_encode):
    expected = sorted((i, *digests(tiktoken_encode(t), t)) for i, t in small_rows)
    assert sorted(tuple(r) for r in byte_bpe_codes(spark, small).collect()) == expected


def test_edges(edge_docs, edge_rows, tiktoken_encode):
    expected = sorted(((i, *digests(tiktoken_encode(t or ""), t or "")) for i, t in edge_rows), key=repr)
    assert sorted((tuple(r) for r in byte_bpe_digest(edge_docs).collect()), key=repr) == expected


def test_empty_table(no_docs):
    assert byte_bpe_digest(no_docs).collect() == []
    assert token_counts.count_tokens(no_docs, WORD_PIECES).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80) | st.text("ab e'st1  \n", max_size=80))
def test_texts_equal_tiktoken(codec, tokens, tiktoken_encode, text):
    text = text.encode("utf-8", "ignore").decode()
    pieces = [p.encode() for p in codec.find(text)]
    ids = np.frombuffer(b"".join(codec.encode_pieces(pieces)), dtype="<u4").tolist()
    assert ids == tiktoken_encode(text)
    assert b"".join(tokens[i] for i in ids) == text.encode()


@pytest.mark.parametrize("size", [511, 512, 513, 5000])
def test_long_pieces(codec, tiktoken_encode, size):
    for text in ("a" * size, ("the" * size)[:size], "".join(chr(97 + i * i % 26) for i in range(size))):
        assert np.frombuffer(codec.encode_pieces([text.encode()])[0], dtype="<u4").tolist() == tiktoken_encode(text)


def test_matrix_equals_heap(codec):
    pieces = [bytes(97 + (i * j) % 7 for i in range(n)) for n in range(2, 60) for j in range(1, 4)]
    assert codec.encode_pieces(pieces) == [codec.ranks[p].to_bytes(4, "little") if p in codec.ranks else codec._by_heap(p) for p in pieces]


@pytest.fixture(scope="module")
def vocabulary():
    with open(WORD_PIECES, "rb") as file:
        data = file.read()
    return set(json.loads(data)["model"]["vocab"]), token_counts.load(data, "</w>")


def greedy(word, tokens):
    shown = {b: c for c, b in token_counts.printable_bytes().items()}
    symbols = [*(shown[b] for b in word.encode()), "</w>"]
    at = count = 0
    while at < len(symbols) and symbols[at:] != ["</w>"]:
        end = next((e for e in range(len(symbols), at, -1) if "".join(symbols[at:e]) in tokens), None)
        if end is None:
            return 0
        at, count = end, count + 1
    return count


@settings(max_examples=300, deadline=None)
@given(st.text("abcdefghijklmnopqrstuvwxyzé漢1'-", min_size=1, max_size=25))
def test_automaton_equals_greedy_cuts(vocabulary, word):
    tokens, automaton = vocabulary
    assert automaton.count((*word.encode(), token_counts.END)) == greedy(word, tokens)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=4), max_size=8), st.text("ab", min_size=1, max_size=12))
def test_small_vocabularies(tokens, word):
    known = set(tokens)
    automaton = token_counts.LongestMatch(tuple(t.encode()) for t in known)
    at = count = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in known), None)
        if end is None:
            count = 0
            break
        at, count = end, count + 1
    assert automaton.count((*word.encode(), token_counts.END)) == count


def test_counts_query(spark, small, small_rows, vocabulary):
    tokens, _ = vocabulary
    expected = []
    for doc_id, text in small_rows[:40]:
        counts = [greedy(w, tokens) for w in text.lower().split()]
        expected.append((doc_id, len(counts), sum(counts) + counts.count(0), counts.count(0)))
    found = {r.doc_id: tuple(r) for r in word_piece_counts(spark, small).collect()}
    assert len(found) == len(small_rows)
    assert [found[e[0]] for e in expected] == expected


def test_counts_edges(edge_docs, edge_rows):
    rows = token_counts.count_tokens(edge_docs, WORD_PIECES).collect()
    assert sorted((r.n_words for r in rows)) == sorted(len((t or "").split()) for _, t in edge_rows)
