"""Substring dedup: passages that repeat across documents, found level by level.

A window of ``window`` consecutive words is removed where its word sequence also starts in a document
with a smaller doc_id. Levels have lengths that double up to the asked one (13: 7, 13; 50: 7, 13, 25,
50), and only windows that repeat at one level are extended to the next:

- A window of the next level holds several windows of this one. Its smallest by hash (a minimizer,
  the same in every document) stands for it, so about 2 in (growth + 2) windows are looked at. A long
  window can repeat only if its minimizer does, hence no repeat is lost.
- Windows met by one document only are dropped. The rest are the marks of the next level, which looks
  only at windows whose minimizer is marked. When no mark is left, the levels end.
- At the asked length each candidate window goes with its document to the smallest doc_id that has it.
- ``longest_repeats`` goes on from there: two repeated windows side by side are a candidate of twice
  the length, until no candidate survives.

Documents with equal word sequences are one document here, the copy with the smallest doc_id; the
other copies are removed whole (if they hold a window at all). Before any shuffle each task combines:
of windows that repeat within a slice of the input it already knows the answer and sends one row, and
it remembers the most shared of them, up to HOT_KEYS, for its later slices. So a passage that a third of all
documents share arrives as about one row per task, not per document or slice. (Spreading the answer
over a window needs the rows in one place; aggregates and a join back would move all rows twice more.)

Windows are compared by 128-bit hashes at the last level; 64-bit ones at the levels before can only
add candidates. Documents count as equal by a 64-bit hash of their words. Null and empty texts have no
words. A null doc_id is never smaller or larger: such a row keeps all words and removes none.
Rows with equal doc_ids do not remove words from each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from gridtide.llm.batches import map_texts, pick
from gridtide.llm.words import BASE, SECOND_BASE, hashes, minimizers, split, windows
from gridtide.plans.work import written

WINDOW = 13
SHORTEST = 5
_DOCUMENT = "doc_id bigint, n_words bigint, sha string"
_FIRST = f"key bigint, content bigint, at int, sure array<int>, {_DOCUMENT}"
_LEVEL = "key bigint, content bigint, at int, sure array<int>, doc_id bigint"
_LAST = "key bigint, second bigint, doc_id bigint, content bigint, places array<int>, sure boolean"
_KEPT = "doc_id bigint, content bigint, n_removed bigint, spans array<struct<start:int,end:int>>, sha string, kept string"


# A task remembers so many hashes that this many documents of one slice share.
HOT_KEYS, HOT_DOCUMENTS = 1 << 17, 3
_NO_ID = np.iinfo(np.int64).max


def levels(window: int) -> list[int]:
    out = [window]
    while -(-out[0] // 2) >= SHORTEST:
        out.insert(0, -(-out[0] // 2))
    return out


def content_id(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words))


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


class _Hot:
    """Hashes that several documents of one task share, with the smallest doc_id of those so far.

    What is not remembered is only sent and compared like any other row.
    """

    def __init__(self) -> None:
        self.one, self.two = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)
        self.least = np.empty(0, dtype=np.int64)

    def find(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is remembered, and where."""
        if not len(self.one):
            return np.zeros(len(one), dtype=bool), np.zeros(len(one), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.one, one), len(self.one) - 1)
        return (self.one[at] == one) & (self.two[at] == two), at

    def add(self, one: np.ndarray, two: np.ndarray, least: np.ndarray) -> None:
        room = HOT_KEYS - len(self.one)
        if room <= 0 or not len(one):
            return
        every = [np.concatenate(pair) for pair in zip((self.one, self.two, self.least), (one[:room], two[:room], least[:room]))]
        self.one, at = np.unique(every[0], return_index=True)
        self.two, self.least = every[1][at], every[2][at]


class _Anchors:
    """Anchors (hash, content, place) of one slice; repeats within the slice are settled here."""

    def __init__(self) -> None:
        self.hash, self.owner, self.place, self.content = [], [], [], []

    def add(self, content: int, values: np.ndarray, places: np.ndarray) -> None:
        self.owner.append(np.full(len(places), len(self.content)))
        self.content.append(content)
        self.hash.append(values)
        self.place.append(places)

    def settle(self, hot: _Hot):
        """Rows to send (hash, content, place), and per owner the places known to repeat."""
        contents = np.array(self.content, dtype=np.uint64)
        sure: list[list[int]] = [[] for _ in contents]
        if not sum(map(len, self.hash)):
            empty = np.empty(0, dtype=np.uint64)
            return empty, empty, np.empty(0, dtype=np.int64), sure
        value, owner, place = map(np.concatenate, (self.hash, self.owner, self.place))
        order = np.lexsort((owner, value))
        value, owner, place = value[order], owner[order], place[order]
        first = np.concatenate(([True], value[1:] != value[:-1]))
        group = np.cumsum(first) - 1
        shared = np.zeros(group[-1] + 1, dtype=bool)
        shared[group[1:][(group[1:] == group[:-1]) & (owner[1:] != owner[:-1])]] = True
        heads = value[first]
        none = np.zeros(len(heads), dtype=np.uint64)
        before, _ = hot.find(heads, none)
        known = (shared | before)[group]
        often = shared & ~before & (np.bincount(group) >= HOT_DOCUMENTS)
        hot.add(heads[often], none[often], np.zeros(int(often.sum()), dtype=np.int64))
        by_owner = np.argsort(owner[known], kind="stable")
        owners, places = owner[known][by_owner], place[known][by_owner]
        ends = np.searchsorted(owners, np.arange(len(contents) + 1))
        for at in np.unique(owners).tolist():
            sure[at] = places[ends[at] : ends[at + 1]].tolist()
        # Of a hash that an earlier slice has found to repeat, that slice has sent a row.
        send = (~known | first) & ~before[group]
        return value[send], contents[owner[send]], place[send], sure


def _first_level(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """One row per document, and rows for the anchors of the first level."""
    length, longer = lengths[0], lengths[min(1, len(lengths) - 1)]

    def start():
        seen: set[int] = set()
        hot = _Hot()

        def work(keys, texts):
            ids = keys[0].to_pylist()
            anchors, owners = _Anchors(), []
            contents, counts, shas = [], [], []
            for at, text in enumerate(texts):
                words = split(text)
                joined = b" ".join(words)
                contents.append(xxhash.xxh3_64_intdigest(joined))
                counts.append(len(words))
                shas.append(hashlib.sha256(joined).hexdigest())
                if len(words) < lengths[-1] or contents[-1] in seen:
                    continue
                seen.add(contents[-1])
                values = windows(hashes(words), length)
                places = np.unique(minimizers(values, longer - length + 1))
                anchors.add(contents[-1], values[places], places)
                owners.append(at)
            value, content, place, settled = anchors.settle(hot)
            sure = [[] for _ in texts]
            for at, places in zip(owners, settled):
                sure[at] = places
            content_all = np.array(contents, dtype=np.uint64)
            spread = [
                xxhash.xxh3_64_intdigest(b"%d %d %d" % (c, i or 0, at)) for at, (c, i) in enumerate(zip(contents, ids))
            ]
            none = [None] * len(texts)
            spread = _signed(np.array(spread, dtype=np.uint64))
            yield spread, _signed(content_all), none, sure, ids, counts, shas
            none = [None] * len(value)
            yield _signed(value), _signed(content), place.astype(np.int32), none, none, none, none

        return work

    return map_texts(pick(docs, doc_id="doc_id", text="text"), start, _FIRST)


def _candidates(count: int, lengths: list[int], level: int, marks: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Starts of this level's windows whose minimizer of the level before is marked."""
    shorter, length = lengths[level - 1], lengths[level]
    place = minimizers(windows(hashed, shorter), length - shorter + 1)
    if not len(place):
        return place
    marked = np.zeros(count, dtype=bool)
    marked[marks] = True
    return np.flatnonzero(marked[place])


def _next_level(marked: DataFrame, lengths: list[int], level: int) -> DataFrame:
    """Anchors of a level between the first and the last, taken from marked documents."""
    length, longer = lengths[level], lengths[level + 1]

    def start():
        hot = _Hot()

        def work(keys, texts):
            anchors, owners, ids = _Anchors(), [], []
            for doc_id, content, marks, text in _marked(keys, texts):
                hashed = hashes(split(text))
                alive = np.zeros(len(hashed), dtype=bool)
                alive[_candidates(len(hashed), lengths, level, marks, hashed)] = True
                values = windows(hashed, length)
                places = np.unique(minimizers(values, longer - length + 1))
                places = places[alive[places]]
                anchors.add(content, values[places], places)
                owners.append(doc_id)
                ids.append(content)
            value, content, place, sure = anchors.settle(hot)
            none = [None] * len(ids)
            owned = _signed(np.array(ids, dtype=np.uint64))
            yield owned, owned, none, sure, owners
            none = [None] * len(value)
            yield _signed(value), _signed(content), place.astype(np.int32), none, none

        return work

    return map_texts(marked, start, _LEVEL)


def _marked(keys, texts):
    """Rows whose text is the marked one: doc_ids may repeat with other texts."""
    for doc_id, content, marks, text in zip(*(k.to_pylist() for k in keys), texts):
        if content_id(split(text)) == content % 2**64:
            yield doc_id, content % 2**64, np.array(marks, dtype=np.int64), text


def _last_level(marked: DataFrame, lengths: list[int]) -> DataFrame:
    """Rows (window hash, document, places): settled ones, and those to compare across slices."""
    length = lengths[-1]

    def start():
        hot = _Hot()

        def work(keys, texts):
            parts, ids, contents = [], [], []
            for doc_id, content, marks, text in _marked(keys, texts):
                hashed = hashes(split(text))
                place = _candidates(len(hashed), lengths, len(lengths) - 1, marks, hashed) if len(lengths) > 1 else marks
                one, two = windows(hashed, length, BASE)[place], windows(hashed, length, SECOND_BASE)[place]
                parts.append((one, two, np.full(len(place), doc_id), np.full(len(place), len(ids)), place))
                ids.append(doc_id)
                contents.append(content)
            if not parts:
                return
            one, two, doc, owner, place = map(np.concatenate, zip(*parts))
            if not len(one):
                return
            order = np.lexsort((place, owner, doc, two, one))
            one, two, doc, owner, place = one[order], two[order], doc[order], owner[order], place[order]
            fresh = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
            group = np.cumsum(fresh) - 1
            # The smallest doc_id of each window in this task so far.
            least = doc[fresh]
            before, at = hot.find(one[fresh], two[fresh])
            least[before] = np.minimum(least[before], hot.least[at[before]])
            hot.least[at[before]] = least[before]
            often = ~before & (np.bincount(group) >= HOT_DOCUMENTS)
            hot.add(one[fresh][often], two[fresh][often], least[often])
            sure = doc > least[group]
            content = np.array(contents, dtype=np.uint64)
            # Settled: one row per document with all its places.
            pick_ = np.argsort(owner[sure], kind="stable")
            owners, places = owner[sure][pick_], place[sure][pick_]
            starts = np.flatnonzero(np.concatenate(([True], owners[1:] != owners[:-1]))) if len(owners) else np.empty(0, int)
            if len(starts):
                lists = [p.tolist() for p in np.split(places, starts[1:])]
                heads = owners[starts]
                key = [xxhash.xxh3_64_intdigest(b"%d %d" % (ids[o], place_[0])) for o, place_ in zip(heads.tolist(), lists)]
                yield (
                    _signed(np.array(key, dtype=np.uint64)),
                    np.zeros(len(heads), dtype=np.int64),
                    np.array(ids, dtype=np.int64)[heads],
                    _signed(content[heads]),
                    lists,
                    [True] * len(heads),
                )
            # Open: one row per window and document with the smallest doc_id here.
            on = ~sure
            one, two, owner, place = one[on], two[on], owner[on], place[on]
            starts = np.flatnonzero(
                np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (owner[1:] != owner[:-1])))
            )
            heads = owner[starts]
            yield (
                _signed(one[starts]),
                _signed(two[starts]),
                np.array(ids, dtype=np.int64)[heads],
                _signed(content[heads]),
                [p.tolist() for p in np.split(place, starts[1:])],
                [False] * len(starts),
            )

        return work

    return map_texts(marked, start, _LAST)


def _keep(rows: DataFrame, length: int) -> DataFrame:
    """Apply the removals: word ranges removed, their number, and the kept words."""

    def start():
        def work(keys, texts):
            out = []
            for doc_id, content, places, text in _marked(keys, texts):
                words = split(text)
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(gone, places, 1)
                np.add.at(gone, places + length, -1)
                covered = np.cumsum(gone)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
                spans = [{"start": low, "end": high} for low, high in zip(edge[::2].tolist(), edge[1::2].tolist())]
                kept = b" ".join([w for w, c in zip(words, covered.tolist()) if not c])
                signed = int(_signed(np.array([content], dtype=np.uint64))[0])
                out.append((doc_id, signed, int(covered.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            if out:
                yield zip(*out)

        return work

    return map_texts(rows, start, _KEPT)


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_words, n_removed, the removed word ranges, kept_sha256, and ``kept``.

    ``kept`` holds the remaining words where a part was removed; it is null where all words stay and
    empty where none does, so that unchanged texts are not moved. ``spans`` likewise.
    """
    lengths = levels(window)
    facts, least, marked = _up_to_last(pick(docs, doc_id=id_col, text=text_col), lengths)
    rows = _last_level(marked, lengths)
    least_here = F.expr("min(doc_id) OVER (PARTITION BY key, second)")
    later = rows.withColumn("least", least_here).filter("sure OR doc_id > least")
    places = later.groupBy("doc_id", "content").agg(F.flatten(F.collect_list("places")).alias("places"))
    parts = marked.select("doc_id", "content", "text").join(places, ["doc_id", "content"])
    kept = _keep(parts.select("doc_id", "content", "places", "text"), window).dropDuplicates(["doc_id", "content"])
    whole = F.expr(f"doc_id > least AND n_words >= {window}")
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        facts.join(least, "content", "left")
        .join(kept.withColumnRenamed("sha", "kept_sha"), ["doc_id", "content"], "left")
        .select(
            "doc_id",
            "n_words",
            F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
            F.when(whole, F.expr("array(named_struct('start', 0, 'end', cast(n_words as int)))")).otherwise(F.col("spans")).alias("spans"),
            F.when(whole, F.lit(nothing)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
            F.when(whole, F.lit("")).otherwise(F.col("kept")).alias("kept"),
        )
    )


def _up_to_last(docs: DataFrame, lengths: list[int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts of every document, the smallest doc_id of every content, and the documents marked at the
    level before the last with their texts."""
    found = written(_repeated(_first_level(docs, lengths)))
    facts = found.filter("at IS NULL").select("doc_id", "content", "n_words", "sha")
    least = written(facts.filter("doc_id IS NOT NULL").groupBy("content").agg(F.min("doc_id").alias("least")))
    marks = _marks(found).join(least, "content").select(F.col("least").alias("doc_id"), "content", "marks")
    marked = written(docs.join(marks, "doc_id").select("doc_id", "content", "marks", "text"))
    for level in range(1, len(lengths) - 1):
        if marked.isEmpty():
            break
        marked = _remarked(marked, _next_level(marked, lengths, level))
    return facts, least, marked


def _remarked(marked: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents with the marks of the next level; those without any are gone."""
    more = _marks(_repeated(rows))
    return written(marked.drop("marks").join(more, "content").select("doc_id", "content", "marks", "text"))


def longest_repeats(
    docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_words and ``longest``: the largest of window, 2 window, 4 window ... such that a run of
    so many words also stands in a document of other words, 0 where not even ``window`` words do.

    Rows without a doc_id take part only as copies of others. Windows are compared by 64-bit hashes.
    """
    lengths = levels(window)
    facts, _, marked = _up_to_last(pick(docs, doc_id=id_col, text=text_col), lengths)
    level, reached = len(lengths) - 1, []
    while True:
        marked = _remarked(marked, _whole_level(marked, lengths, level, doubled=bool(reached)))
        if marked.isEmpty():
            break
        reached.append(marked.select("content", F.lit(lengths[level]).alias("longest")))
        lengths.append(2 * lengths[level])
        level += 1
    every = facts.select("content", F.lit(0).alias("longest"))
    for part in reached:
        every = every.union(part)
    longest = every.groupBy("content").agg(F.max("longest").alias("longest"))
    return facts.join(longest, "content").select("doc_id", "n_words", "longest")


def _whole_level(marked: DataFrame, lengths: list[int], level: int, doubled: bool) -> DataFrame:
    """All candidate windows of a level. ``doubled``: marks are all repeated windows of half the length."""
    length = lengths[level]

    def start():
        hot = _Hot()

        def work(keys, texts):
            anchors, owners, ids = _Anchors(), [], []
            for doc_id, content, marks, text in _marked(keys, texts):
                hashed = hashes(split(text))
                if doubled:
                    places = marks[np.isin(marks + length // 2, marks)]
                elif level:
                    places = _candidates(len(hashed), lengths, level, marks, hashed)
                else:
                    places = marks
                anchors.add(content, windows(hashed, length)[places], places)
                owners.append(doc_id)
                ids.append(content)
            value, content, place, sure = anchors.settle(hot)
            none = [None] * len(ids)
            owned = _signed(np.array(ids, dtype=np.uint64))
            yield owned, owned, none, sure, owners
            none = [None] * len(value)
            yield _signed(value), _signed(content), place.astype(np.int32), none, none

        return work

    return map_texts(marked, start, _LEVEL)


def _repeated(rows: DataFrame) -> DataFrame:
    """Document rows, and anchor rows whose hash occurs in two or more contents."""
    spread = F.expr("at IS NULL OR min(content) OVER (PARTITION BY key) <> max(content) OVER (PARTITION BY key)")
    return rows.withColumn("keep", spread).filter("keep").drop("keep")


def _marks(found: DataFrame) -> DataFrame:
    """The marked places of each content. Copies give equal places, which combine before the shuffle."""
    open_ = found.filter("at IS NOT NULL").select("content", "at")
    settled = found.filter("at IS NULL").select("content", F.explode("sure").alias("at"))
    return open_.union(settled).groupBy("content").agg(F.collect_set("at").alias("marks"))
