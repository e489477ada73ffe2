"""Secret scans with corpus-wide ownership frequency.

Three base detectors mark what looks like a secret by its form.  A fourth looks
for bare tokens: long runs of token characters with mixed kinds, which alone say
little.  All candidate values are hashed and counted by the distinct repositories
and owners that hold them, over the whole corpus: a value that many owners share
is a copied example, one that stays with few is specific to its owner and looks
live.  Bare tokens become spans only where they are owner-specific; base spans
always stay, and are told apart by the counts.

Only hashes, owners and places leave the scan; a widely copied value is reduced
to its distinct repositories in each task before anything is shuffled.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import _text as X
from holdfast.llm._stage import Stages

KINDS = ("assign", "access", "hex", "token")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST, TOKEN_LEAST = 6, 20, 24, 20
#: A value that more owners than this share is a copied example.
MAX_OWNERS = 2
#: Least bits per character of a bare token.
TOKEN_ENTROPY = 3.5

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_KEYWORD = re.compile(rb"passw|secret|token|api_?key", re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.ASCII)


def _class(characters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in characters]] = True
    return table


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HEX, _TOKEN = _class(_DIGITS + "abcdef"), _class(_DIGITS + _LOWER + _UPPER + "+/_.=-")
_CONTINUES = (np.arange(256) & 0xC0) == 0x80


def _runs(member: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of at least `least` member bytes within a row: starts and ends."""
    if not len(member):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(member) + 1, bool)
    cut[offsets] = True
    begins, ends = member.copy(), member.copy()
    begins[1:] &= ~member[:-1] | cut[1:-1]
    ends[:-1] &= ~member[1:] | cut[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    keep = end - start >= least
    return start[keep], end[keep]


def _entropy(value: bytes) -> float:
    counts = np.bincount(np.frombuffer(value, np.uint8))
    share = counts[counts > 0] / len(value)
    return float(-(share * np.log2(share)).sum())


def looks_random(value: bytes) -> bool:
    """A bare token: digits, and letters, of enough entropy."""
    return any(48 <= c <= 57 for c in value) and any(c >= 65 for c in value) and _entropy(value) >= min(TOKEN_ENTROPY, math.log2(len(value)))


def scan_texts(raw: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int, bytes]]]:
    """For each text its candidates (kind's number, start, end in code points, value), by start and kind."""
    rows = len(offsets) - 1
    out: list[list[tuple[int, int, int, bytes]]] = [[] for _ in range(rows)]
    ahead = np.concatenate([[0], np.cumsum(_CONTINUES[raw])])  # bytes that begin no code point

    def add(kind: int, start: int, end: int, value: bytes) -> None:
        row = int(np.searchsorted(offsets, start, side="right")) - 1
        base = offsets[row] - ahead[offsets[row]]
        out[row].append((kind, int(start - ahead[start] - base), int(end - ahead[end] - base), value))

    for start, end in zip(*_runs(_HEX[raw], offsets, HEX_LEAST), strict=True):
        add(2, start, end, raw[start:end].tobytes())
    for start, end in zip(*_runs(_TOKEN[raw], offsets, TOKEN_LEAST), strict=True):
        value = raw[start:end].tobytes()
        if looks_random(value):
            add(3, start, end, value)
    for row in range(rows):
        data = raw[offsets[row] : offsets[row + 1]].tobytes()
        if _KEYWORD.search(data):
            for m in _ASSIGN.finditer(data.decode()):
                if len(m[2]) >= ASSIGN_LEAST:
                    out[row].append((0, m.start(), m.end(), m[2].encode()))
        if b"AKIA" in data:
            for m in _ACCESS.finditer(data.decode()):
                if len(m[0]) >= ACCESS_LEAST:
                    out[row].append((1, m.start(), m.end(), m[0].encode()))
    for spans in out:
        spans.sort(key=lambda s: (s[1], s[0]))
    return out


def _joined(spans) -> str:
    return ",".join(f"{KINDS[s[0]]}:{s[1]}:{s[2]}" for s in spans)


_CANDIDATE = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.binary())])


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = X.utf8(batch.column(1))
        found = []
        for i, j in X.slices(offsets):
            found += scan_texts(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        counts = [[sum(s[0] == k for s in spans) for spans in found] for k in range(3)]
        base = [_joined([s for s in spans if s[0] < 3]) for spans in found]
        spans = [[{"kind": k, "start": a, "end": b, "value": hashlib.blake2b(v, digest_size=16).digest()} for k, a, b, v in row] for row in found]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), batch.column(3), *[pa.array(c, pa.int64()) for c in counts], pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base]), pa.array(spans, pa.list_(_CANDIDATE))],
            ["doc_id", "owner", "repository", "n_assign", "n_access", "n_hex", "base_sha256", "found"],
        )


def secret_scan(spark: SparkSession, docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), max_owners: int = MAX_OWNERS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, max_repositories.

    Spans are kind:start:end in code points, end exclusive, by start and then
    kind, comma-joined; base_sha256 covers those of the kinds assign, access and
    hex.  `spans` has those and the owner-specific bare tokens (kind token).
    n_live counts the candidates whose value at most max_owners owners have,
    n_copied the others; max_repositories is the widest spread of a copied or
    live value here (0 without candidates).  Null text counts as empty; null
    owners and repositories are one owner and one repository.  Repeated rows are
    each reported.  Other columns play no part; no rows give no rows.
    """
    stages = Stages(spark, "secrets")
    repo = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repository])
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), repo.alias("repository"))
    schema = "doc_id long, owner string, repository string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<kind:int,start:bigint,end:bigint,value:binary>>"
    scanned = stages.keep(rows.mapInArrow(_scanned, schema).withColumn("row", F.monotonically_increasing_id()))
    held = scanned.where(F.size("found") > 0).select("row", "owner", "repository", F.explode("found").alias("c")).select("row", "owner", "repository", "c.*")
    # One row for each value and repository before values meet: a value copied everywhere has no more rows than repositories.
    spread = (
        held.select("value", "owner", "repository")
        .distinct()
        .groupBy("value", "owner")
        .agg(F.count("*").alias("repositories"))
        .groupBy("value")
        .agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    )
    judged = held.select("row", "kind", "start", "end", "value").join(spread, "value")
    live = F.col("owners") <= max_owners
    shown = F.when((F.col("kind") < 3) | live, F.struct("start", "kind", "end"))
    by_row = judged.groupBy("row").agg(
        F.sort_array(F.collect_list(shown)).alias("shown"),
        F.sum(live.cast("long")).alias("n_live"),
        F.sum((~live).cast("long")).alias("n_copied"),
        F.max("repositories").alias("max_repositories"),
    )
    label = F.transform("shown", lambda x: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string")))
    written = by_row.select("row", F.array_join(label, ",").alias("spans"), "n_live", "n_copied", "max_repositories")
    out = scanned.drop("found", "owner", "repository").join(written, "row", "left").drop("row")
    return out.na.fill("", ["spans"]).na.fill(0, ["n_live", "n_copied", "max_repositories"])
