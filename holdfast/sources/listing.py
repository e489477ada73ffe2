"""Listings of real directories as DataFrames: source trees, the content store, and browse trees."""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from holdfast.functions.blake3 import blake3_hex

SOURCE = "sequence long, source_root string, relative_path string, size_bytes long, modified_at_ms long, mount_id long"
STORE = "rel_path_bytes binary, rel_path string, hash string, kind string, size_bytes long, ancestors_valid boolean, io_error string"
TREE = "path string, kind string, target_text string"


def _kind(mode: int) -> str:
    return "symlink" if stat.S_ISLNK(mode) else "directory" if stat.S_ISDIR(mode) else "file" if stat.S_ISREG(mode) else "other"


def _walk(folder: bytes) -> Iterator[tuple[bytes, os.stat_result]]:
    """Entries below a folder in the order of their name bytes, links not followed."""
    for name in sorted(os.listdir(folder)):
        path = os.path.join(folder, name)
        info = os.lstat(path)
        yield path, info
        if stat.S_ISDIR(info.st_mode):
            yield from _walk(path)


def source_listing(spark: SparkSession, root: str) -> DataFrame:
    """Regular files below a root; any error ends the walk, and a path that is not UTF-8 is one."""
    real = os.path.realpath(root)
    files = [(p, i) for p, i in _walk(os.fsencode(real)) if stat.S_ISREG(i.st_mode)]
    rows = [
        (n, real, os.path.relpath(p, os.fsencode(real)).decode("utf-8"), i.st_size, i.st_mtime_ns // 1_000_000 if i.st_mtime_ns >= 0 else None, i.st_dev)
        for n, (p, i) in enumerate(files)
    ]
    return spark.createDataFrame(rows, SOURCE)


def digest_of(path: str, digest: str, chunk: int = 1 << 20) -> tuple[str, int]:
    """Digest and size of a file, read once; links are not followed."""
    with open(os.open(path, os.O_RDONLY | os.O_NOFOLLOW), "rb") as file:
        if digest == "blake3":
            data = file.read()
            return blake3_hex(data), len(data)
        sha, size = hashlib.sha256(), 0
        while data := file.read(chunk):
            sha.update(data)
            size += len(data)
        return sha.hexdigest(), size


def store_listing(spark: SparkSession, store: str) -> DataFrame:
    """Everything below the blob folder; hash for what is laid out as a blob."""
    base = os.fsencode(os.path.join(store, "blobs"))
    rows = []

    def walk(folder: bytes, valid: bool) -> None:
        try:
            names = sorted(os.listdir(folder))
        except OSError:
            rows.append((os.path.relpath(folder, base), None, None, "directory", None, valid, "enumeration-failed"))
            return
        for name in names:
            path = os.path.join(folder, name)
            rel = os.path.relpath(path, base)
            text = rel.decode("utf-8") if _is_utf8(rel) else None
            try:
                info = os.lstat(path)
            except OSError:
                rows.append((rel, text, None, "other", None, valid, "stat-failed"))
                continue
            kind = _kind(info.st_mode)
            parts = (text or "").split("/")
            shards = all(len(p) == 2 and all(c in "0123456789abcdef" for c in p) for p in parts)
            rows.append((rel, text, parts[-1] if len(parts) == 3 else None, kind, info.st_size if kind == "file" else None, valid, None))
            if kind == "directory":
                walk(path, valid and len(parts) <= 2 and shards)

    if os.path.isdir(base):
        walk(base, True)
    return spark.createDataFrame(rows, STORE)


def _is_utf8(name: bytes) -> bool:
    try:
        name.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def tree_listing(spark: SparkSession, root: str) -> DataFrame:
    rows = [(os.fsdecode(p), kind := _kind(i.st_mode), os.readlink(os.fsdecode(p)) if kind == "symlink" else None) for p, i in (_walk(os.fsencode(root)) if os.path.isdir(root) else [])]
    return spark.createDataFrame(rows, TREE)
