"""A log-structured store of mergeable tables, written by one stream.

Every batch adds one segment: a folder with a table per name that holds what this batch alone contributes,
so a batch writes as much as it changes and never the whole. Now and then the last ``fan`` segments of
one tier are merged into one of the next tier, so that n batches leave about ``fan`` * log(n) segments and
every row is rewritten log(n) times. A segment counts once its marker file is there, which is written
last. A batch that is replayed after a failure adds a second segment of the same range; only one counts.
Merged and unfinished segments are deleted once they have been out of use for the grace time, which
readers have to finish.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from gridtide.sources import storage

PREFIX, DONE = "segment=", "_done"


class Segment(NamedTuple):
    """The batches from ``first`` to ``last``, both included, and when the segment was finished."""

    first: int
    last: int
    path: str
    at: float


def finished(spark: SparkSession, folder: str) -> list[Segment]:
    return [segment for segment, done in _all(spark, folder) if done]


def _all(spark: SparkSession, folder: str) -> list[tuple[Segment, bool]]:
    found = []
    for path, at in storage.children(spark, folder):
        name = path.rsplit("/", 1)[1]
        if not name.startswith(PREFIX):
            continue
        first, last, _ = name.removeprefix(PREFIX).split("-")
        marks = dict(storage.children(spark, path))
        marked = next((t for mark, t in marks.items() if mark.rsplit("/", 1)[1] == DONE), None)
        found.append((Segment(int(first), int(last), path, at if marked is None else marked), marked is not None))
    return found


def visible(segments: list[Segment]) -> list[Segment]:
    """The segments that hold every batch once: of two that overlap the wider, of two alike the first."""
    kept: list[Segment] = []
    for segment in sorted(segments, key=lambda s: (s.first, -s.last, s.path)):
        if not kept or segment.first > kept[-1].last:
            kept.append(segment)
    return kept


def add(spark: SparkSession, folder: str, first: int, last: int, tables: Mapping[str, DataFrame]) -> str:
    path = f"{folder}/{PREFIX}{first:012d}-{last:012d}-{uuid.uuid4().hex}"
    for name, table in tables.items():
        table.write.parquet(f"{path}/{name}")
    storage.create(spark, f"{path}/{DONE}")
    return path


def read(spark: SparkSession, segments: list[Segment], name: str) -> DataFrame:
    """The rows of one table of these segments, unmerged."""
    return spark.read.parquet(*(f"{segment.path}/{name}" for segment in segments))


def compact(spark: SparkSession, folder: str, merges: Mapping[str, Callable[[DataFrame], DataFrame]], fan: int) -> int:
    """Merge the last segments of a tier while there are ``fan`` of them; how many merges that took."""
    done = 0
    while True:
        now = visible(finished(spark, folder))
        tail = 0
        while tail < len(now) and _tier(now[-1 - tail], fan) == _tier(now[-1], fan):
            tail += 1
        if tail < fan:
            return done
        parts = now[-tail:]
        add(spark, folder, parts[0].first, parts[-1].last, {name: merge(read(spark, parts, name)) for name, merge in merges.items()})
        done += 1


def _tier(segment: Segment, fan: int) -> int:
    width, tier = segment.last - segment.first + 1, 0
    while width >= fan:
        width, tier = width // fan, tier + 1
    return tier


def sweep(spark: SparkSession, folder: str, grace_seconds: float) -> list[str]:
    """Delete segments out of use for the grace time: those a wider one replaced, and unfinished ones."""
    found = _all(spark, folder)
    used = visible([segment for segment, done in found if done])
    now, gone = time.time(), []
    for segment, done in found:
        if segment in used:
            continue
        since = segment.at
        if done:
            since = max(since, *(u.at for u in used if u.first <= segment.first and segment.last <= u.last))
        if now - since >= grace_seconds:
            storage.delete(spark, segment.path)
            gone.append(segment.path)
    return gone
