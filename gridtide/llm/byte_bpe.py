"""Byte-level BPE encoding and decoding.

Encoding: each match of the split pattern is a piece. The distinct pieces of a slice of texts are put
into padded matrices, one per length class. In every round each row merges its leftmost pair of
lowest rank: ranks of neighbours come from a hash table of pairs, the merged row is compacted by
dropping one cell, and rows without a mergeable pair leave. A piece that is itself a token stays
whole. Pieces above ``LONG_PIECE`` bytes would need as many rounds as they have bytes, so they go
through a heap with the same merge order, which is exact and n log n.

Null texts give no tokens; the vocabulary file is a parameter and goes to the executors by broadcast
(a vocabulary has a fixed size). Repeated pieces are encoded once per task while they fit a table of
``KNOWN_PIECES`` entries, which is then begun anew; no result depends on it.
"""

from __future__ import annotations

import base64
import heapq
from functools import cached_property, lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from gridtide.llm.batches import map_texts, pick

LONG_PIECE = 512
KNOWN_PIECES = 100_000
CELLS = 1 << 18
NONE = np.int64(1 << 40)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Open addressing over (left id, right id); values are the merged token's rank."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << bits, NONE)
        slot, todo = self._home(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == np.uint64(2**64 - 1)
            places, first = np.unique(slot[todo[free]], return_index=True)
            winners = todo[free][first]
            self.keys[places], self.values[places] = keys[winners], values[winners]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULTIPLIER) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; NONE where they do not merge or a side is padding (-1)."""
        shape = left.shape
        left, right = left.ravel(), right.ravel()
        out = np.full(left.shape, NONE)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = (left[todo].astype(np.uint64) << np.uint64(32)) | right[todo].astype(np.uint64)
        slot = self._home(keys)
        while len(todo):
            found = self.keys[slot]
            hit = found == keys
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (found != np.uint64(2**64 - 1))
            todo, keys, slot = todo[on], keys[on], (slot[on] + 1) & self.mask
        return out.reshape(shape)


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.table = PairTable(*(np.array(column, dtype=kind) for column, kind in zip(zip(*self._splits()), (np.uint64, np.int64))))

    def _splits(self):
        """(pair of ids, rank) of every way to cut a token into two tokens."""
        ranks = self.ranks
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    yield left << 32 | right, rank

    @cached_property
    def pairs(self) -> dict[int, int]:
        """The pair table as a dictionary, for one piece at a time."""
        return dict(self._splits())

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Token ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        classes: dict[int, list[int]] = {}
        for at, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[at] = whole.to_bytes(4, "little")
            elif len(piece) > LONG_PIECE:
                out[at] = self._by_heap(piece)
            elif piece:
                classes.setdefault((len(piece) - 1) // 4, []).append(at)
        for step, members in classes.items():
            width = 4 * step + 4
            rows = max(1, CELLS // width)
            for low in range(0, len(members), rows):
                self._by_matrix(pieces, members[low : low + rows], width, out)
        return out

    def _by_matrix(self, pieces: list[bytes], members: list[int], width: int, out: list[bytes]) -> None:
        lengths = np.array([len(pieces[at]) for at in members])
        raw = np.frombuffer(b"".join(pieces[at].ljust(width, b"\0") for at in members), dtype=np.uint8)
        ids = self.byte_ids[raw.reshape(-1, width)]
        ids[np.arange(width) >= lengths[:, None]] = -1
        ranks = self.table.ranks(ids[:, :-1], ids[:, 1:])
        rows = np.array(members)
        while len(rows):
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), dtype=np.int64)
            low = ranks[np.arange(len(rows)), best] if ranks.shape[1] else np.full(len(rows), NONE)
            done = low == NONE
            if done.any():
                ended = ids[done]
                sizes = (ended >= 0).sum(axis=1)
                flat = ended[ended >= 0].astype("<u4").tobytes()
                ends = np.cumsum(sizes) * 4
                for at, end, size in zip(rows[done].tolist(), ends.tolist(), sizes.tolist()):
                    out[at] = flat[end - 4 * size : end]
                on = ~done
                ids, ranks, rows, best, low = ids[on], ranks[on], rows[on], best[on], low[on]
                if not len(rows):
                    return
            count, size = ids.shape
            every = np.arange(count)
            ids[every, best] = low
            keep = np.ones((count, size), dtype=bool)
            keep[every, best + 1] = False
            ids = ids[keep].reshape(count, size - 1)
            keep = np.ones((count, size - 1), dtype=bool)
            keep[every, best] = False
            ranks = ranks[keep].reshape(count, size - 2)
            if size > 2:
                before = np.flatnonzero(best > 0)
                at = best[before] - 1
                ranks[before, at] = self.table.ranks(ids[before, at], ids[before, at + 1])
                after = np.flatnonzero(best < size - 2)
                at = best[after]
                ranks[after, at] = self.table.ranks(ids[after, at], ids[after, at + 1])

    def _by_heap(self, piece: bytes) -> bytes:
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
        count = len(ids)
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        pairs = self.pairs
        heap = [
            (rank, at)
            for at in range(count - 1)
            if (rank := pairs.get(ids[at] << 32 | ids[at + 1])) is not None
        ]
        heapq.heapify(heap)
        while heap:
            rank, at = heapq.heappop(heap)
            right = after[at]
            if ids[at] < 0 or right >= count or pairs.get(ids[at] << 32 | ids[right]) != rank:
                continue
            ids[at], ids[right] = rank, -1
            after[at] = right = after[right]
            if right < count:
                before[right] = at
                new = pairs.get(rank << 32 | ids[right])
                if new is not None:
                    heapq.heappush(heap, (new, at))
            left = before[at]
            if left >= 0:
                new = pairs.get(ids[left] << 32 | rank)
                if new is not None:
                    heapq.heappush(heap, (new, left))
        return np.array([i for i in ids if i >= 0], dtype="<u4").tobytes()


@lru_cache(maxsize=2)
def load(data: bytes, pattern: str) -> Codec:
    """Codec of a rank file's content: a base64 token and its rank on each line."""
    return Codec(read_ranks(data), pattern)


def read_ranks(data: bytes) -> dict[bytes, int]:
    lines = (line.split() for line in data.splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in lines}


@lru_cache(maxsize=2)
def load_tokens(data: bytes) -> dict[int, bytes]:
    return {rank: token for token, rank in read_ranks(data).items()}


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id and ``ids``: the token ids packed as little-endian unsigned 32-bit integers.

    One row per input row; a null or empty text has empty ids.
    """
    with open(ranks_path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def start():
        codec = load(shared.value, pattern)
        known: dict[str, bytes] = {}

        def work(keys, texts):
            pieces = [codec.find(text) if text else [] for text in texts]
            if len(known) > KNOWN_PIECES:
                known.clear()
            new = list({piece for found in pieces for piece in found}.difference(known))
            known.update(zip(new, codec.encode_pieces([piece.encode() for piece in new])))
            get = known.__getitem__
            yield keys[0], [b"".join(map(get, found)) for found in pieces]

        return work

    return map_texts(pick(docs, doc_id=id_col, text=text_col), start, "doc_id bigint, ids binary", binary=False)


def decode(tokens: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, the packed ids and ``decoded``, the bytes they stand for. Unknown ids raise."""
    with open(ranks_path, "rb") as file:
        shared = tokens.sparkSession.sparkContext.broadcast(file.read())

    def start():
        token = load_tokens(shared.value).__getitem__

        def work(keys, packed):
            decoded = [b"".join(map(token, np.frombuffer(ids or b"", dtype="<u4").tolist())) for ids in packed]
            yield keys[0], packed, decoded

        return work

    rows = pick(tokens, doc_id=id_col, ids=ids_col)
    return map_texts(rows, start, "doc_id bigint, ids binary, decoded binary")
