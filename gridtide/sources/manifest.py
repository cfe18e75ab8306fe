"""Tables published by a manifest, for storage without rename.

A published table is a folder of versions (``_data``) and of numbered manifests (``_manifest``). A new
version is written completely under a name of its own; then one small new file, numbered one above
the last, names it. Creating that file is the commit: before it readers see the old version, after it
the new one, and nothing that a reader may be using is ever moved or overwritten. Manifests that a
crash has cut short are skipped. A version stays for the grace time after another has taken its place,
so that whoever has resolved it can finish; unfinished versions go after the same time, which
must therefore be longer than any write.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import SparkSession

from gridtide.sources import storage

DATA, MANIFESTS = "_data", "_manifest"
GRACE_SECONDS = 7 * 24 * 3600


class Manifest(NamedTuple):
    number: int
    version: str
    path: str
    at: float


def _numbers(spark: SparkSession, table: str) -> dict[int, tuple[str, float]]:
    """All manifest files, whole or not, by number."""
    found = {}
    for path, at in storage.children(spark, f"{table.rstrip('/')}/{MANIFESTS}"):
        name = path.rsplit("/", 1)[1]
        if name.isdigit():
            found[int(name)] = (path, at)
    return found


def _whole(spark: SparkSession, number: int, path: str, at: float) -> Manifest | None:
    try:
        content = json.loads(storage.read_text(spark, path))
        return Manifest(number, content["version"], path, at) if content["whole"] is True else None
    except (ValueError, KeyError, TypeError):
        return None


def current(spark: SparkSession, table: str) -> str | None:
    """The folder of the version that the last whole manifest names; None if nothing was published."""
    found = _numbers(spark, table)
    for number in sorted(found, reverse=True):
        manifest = _whole(spark, number, *found[number])
        if manifest:
            return _folder(table, manifest.version)
    return None


def _folder(table: str, version: str) -> str:
    return f"{table.rstrip('/')}/{DATA}/{version}/table"


def publish(
    spark: SparkSession, table: str, write: Callable[[str], None], grace_seconds: float = GRACE_SECONDS
) -> str:
    """Let ``write`` fill a new version of the table, make it the current one, and return its folder.

    Of writers at the same time each commits under a number of its own, and the highest counts.
    """
    plain = [path for path, _ in storage.children(spark, table) if not path.rsplit("/", 1)[1].startswith(("_", "."))]
    if plain:
        raise ValueError(f"{table} holds files that were not published: {plain[0]}")
    version = uuid.uuid4().hex
    write(_folder(table, version))
    text = json.dumps({"version": version, "whole": True})
    number = max(_numbers(spark, table), default=0) + 1
    while not storage.create(spark, f"{table.rstrip('/')}/{MANIFESTS}/{number:012d}", text):
        number += 1
    sweep(spark, table, grace_seconds)
    return _folder(table, version)


def sweep(spark: SparkSession, table: str, grace_seconds: float = GRACE_SECONDS) -> None:
    """Delete versions and manifests that have been out of use for the grace time."""
    found = _numbers(spark, table)
    whole = [m for m in (_whole(spark, number, *found[number]) for number in sorted(found)) if m]
    now = time.time()
    # A manifest is out of use since the next one; the last is in use.
    kept = {m.version for m, after in zip(whole, whole[1:]) if now - after.at < grace_seconds}
    kept |= {m.version for m in whole[-1:]}
    for path, at in storage.children(spark, f"{table.rstrip('/')}/{DATA}"):
        version = path.rsplit("/", 1)[1]
        named = any(m.version == version for m in whole)
        if version not in kept and (named or now - at >= grace_seconds):
            storage.delete(spark, path)
    used = {m.number for m in whole if m.version in kept}
    for number, (path, at) in found.items():
        # Numbers only grow, so the last file stays even if it was cut short.
        if number not in used and number != max(found) and now - at >= grace_seconds:
            storage.delete(spark, path)
