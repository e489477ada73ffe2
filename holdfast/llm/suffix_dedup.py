"""Removes text that repeats over 200 bytes, with a distributed difference-cover algorithm.

Windows that may be equal are brought together first.  Of every 51 places in a
row the one whose 150 bytes have the least hash is an anchor, so that each window
of 200 bytes holds an anchor's 150 bytes, and equal windows hold equal ones at
the same place.  An anchor that occurs once is in no repeated window.  The others
are taken with their contexts, 50 bytes on either side, which hold all windows
around them; equal contexts are one string with a count.

The strings of an anchor meet in one partition, where they make one text over
bytes and one symbol for the anchor's 150 bytes.  Its windows are sorted by a
difference cover modulo three: triples at the sampled places (1 and 2) are sorted
and named, and triples of names in turn, until names cover a window; the remaining
suffixes (0) are merged by their first symbol and the name that follows.  Windows
that are neighbours in this order and equal repeat, as do those of strings that
occur more than once.

Per document only the places of its anchors and one 51-bit mask each come back.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import _text as X
from holdfast.llm._stage import Stages

#: Bytes of a window, of an anchor, and on either side of it.
WINDOW, ANCHOR = 200, 150
SIDE = WINDOW - ANCHOR
#: Symbols of a context's string: a side, the anchor, a side; padded to a multiple of three.
STRING = 2 * SIDE + 2
#: Strings sorted at once at most, but those of one anchor together; occurrences summed at once; bits of the filter of repeated anchors.
STRINGS, GATHERED, FILTER_BITS, SEGMENT_BITS = 16_000, 1 << 18, 1 << 27, 1 << 15
_NEVER = X.U64(0xFFFFFFFFFFFFFFFF)


def _reach(values: np.ndarray, width: int, combine, empty) -> np.ndarray:
    """combine over values[i : i + width], beyond the end with `empty`; in doubling steps."""
    out, span = values.copy(), 1
    while span < width:
        step = min(span, width - span)
        ahead = np.full_like(out, empty)
        ahead[:-step or None] = out[step:]
        out = combine(out, ahead)
        span += step
    return out


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of some texts end to end: row, place in all, hash of the 150 bytes."""
    n = len(raw)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, X.U64)
    power, inverse = X._power_tables(n + 1)
    total = np.empty(n + 1, X.U64)
    total[0] = 0
    np.cumsum(X._BYTE[raw] * power[:n], out=total[1:])
    gram = np.full(n, _NEVER, X.U64)
    gram[: n - ANCHOR + 1] = X.mix64((total[ANCHOR:] - total[:-ANCHOR]) * inverse[: n - ANCHOR + 1]) >> X.U64(1)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)  # bytes to the row's end
    gram[left < ANCHOR] = _NEVER
    least = _reach(gram, SIDE + 1, np.minimum, _NEVER)
    least[left < WINDOW] = 0  # no window starts here
    # A place is an anchor if it is the least of some window that holds it: the greatest such least.
    chosen = _reach(least[::-1], SIDE + 1, np.maximum, X.U64(0))[::-1]
    at = np.flatnonzero((chosen == gram) & (left >= ANCHOR))
    return np.searchsorted(offsets, at, side="right") - 1, at, gram[at]


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of anchors with their counts, summed within some texts first."""
    for batch in batches:
        raw, offsets = X.utf8(batch.column(0))
        found = [anchors(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[2] for i, j in X.slices(offsets)]
        hashes, counts = np.unique(np.concatenate(found) if found else np.zeros(0, X.U64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(hashes.astype(np.int64)), pa.array(np.minimum(counts, 2).astype(np.int32))], ["anchor", "n"])


def row_key(doc: int | None, text: bytes) -> bytes:
    """Names a row by what it holds; equal rows share a name and their masks."""
    return xxhash.xxh3_128_digest(b"%d:" % (-1 if doc is None else doc) + text)[:12]


def _contexts(held):
    """key, place, anchor, id, sides (the bytes before and after), before (how many are before)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            all_raw, all_offsets = X.utf8(batch.column(1))
            docs = batch.column(0).to_pylist()
            for i, j in X.slices(all_offsets):
                raw, offsets = all_raw[all_offsets[i] : all_offsets[j]], all_offsets[i : j + 1] - all_offsets[i]
                row, at, hashes = anchors(raw, offsets)
                slot = (hashes & X.U64(FILTER_BITS - 1)).astype(np.int64)
                keep = np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                row, at, hashes = row[keep], at[keep], hashes[keep]
                data, starts = raw.tobytes(), offsets.tolist()
                keys = {r: row_key(docs[i + r], data[starts[r] : starts[r + 1]]) for r in np.unique(row).tolist()}
                sides, before, ids = [], [], []
                gc.disable()  # the loop makes many small objects, none in cycles
                for r, a, h in zip(row.tolist(), at.tolist(), hashes.tolist(), strict=True):
                    low = max(starts[r], a - SIDE)
                    both = data[low:a] + data[a + ANCHOR : min(starts[r + 1], a + WINDOW)]
                    sides.append(both)
                    before.append(a - low)
                    ids.append(xxhash.xxh3_128_digest(b"%d:%d:" % (h, a - low) + both))
                gc.enable()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[r] for r in row.tolist()], pa.binary()), pa.array((at - offsets[row]).astype(np.int64)), pa.array(hashes.astype(np.int64)), pa.array(ids, pa.binary()), pa.array(sides, pa.binary()), pa.array(before, pa.int32())],
                    ["key", "place", "anchor", "id", "sides", "before"],
                )

    return run


def _names(*parts: np.ndarray) -> np.ndarray:
    """Ranks of tuples in their order, equal for equal ones."""
    if len(parts) == 3 and all(int(p.max(initial=0)) < 1 << 21 for p in parts):
        key = (parts[0].astype(np.int64) << 42) | (parts[1].astype(np.int64) << 21) | parts[2]
        return np.unique(key, return_inverse=True)[1].astype(np.int64)
    order = np.lexsort(parts[::-1])
    new = np.zeros(len(order), bool)
    for p in parts:
        new[1:] |= p[order[1:]] != p[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def window_ranks(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ranks of the windows text[s : s + SIDE + 1] for s in starts, by a difference cover modulo three.

    text must reach two windows beyond the last start.  Equal windows get equal ranks where their starts are congruent.
    """
    place = np.arange(len(text))
    sampled = place[place % 3 != 0]
    name = np.zeros(len(text) + 2 * (SIDE + 1), np.int64)  # of sampled places; 0 beyond the end
    ahead = lambda k: np.concatenate([text, np.zeros(k, text.dtype)])[k:]
    name[sampled] = _names(text[sampled], ahead(1)[sampled], ahead(2)[sampled])
    for step in (3, 9):  # names of triples, of triples of triples, of those: 3, 9, 27 symbols
        name[sampled] = _names(name[sampled], name[sampled + step], name[sampled + 2 * step])
    # 27 symbols twice, overlapping, are the 51 of a window; 48 follow the first symbol of a remaining suffix, two more its end.
    out = np.zeros(len(starts), np.int64)
    for residue in (1, 2):
        mine = np.flatnonzero(starts % 3 == residue)
        s = starts[mine]
        out[mine] = _names(name[s], name[s + SIDE + 1 - 27])
    mine = np.flatnonzero(starts % 3 == 0)
    s = starts[mine]
    out[mine] = _names(text[s], name[s + 1], name[s + 1 + 21], text[s + SIDE - 1], text[s + SIDE])
    return out


def whole_masks(before: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All windows of a context that lie in its document: of before bytes in front, and lengths in all."""
    out = np.zeros(len(before), np.int64)
    for k in range(SIDE + 1):  # k places before the anchor, SIDE - k bytes after it
        out |= ((before >= k) & (lengths - before >= SIDE - k)).astype(np.int64) << k
    return out


def repeated_starts(anchor: np.ndarray, sides: list[bytes], before: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For distinct contexts with their counts: a mask of the windows that occur again; bit k starts k places before the anchor."""
    m = len(sides)
    text = np.zeros((m + 2, STRING), np.int64)  # 0 pads; bytes are 1 to 256
    lengths = np.array([len(s) for s in sides], np.int64)
    flat = np.frombuffer(b"".join(sides), np.uint8).astype(np.int64) + 1
    owner = np.repeat(np.arange(m), lengths)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    b = before[owner]
    text[owner, np.where(column < b, SIDE - b + column, SIDE + 1 + column - b)] = flat
    text[:m, SIDE] = 257 + np.unique(anchor, return_inverse=True)[1]
    s = np.arange(SIDE + 1)
    whole = (s[None] >= SIDE - before[:, None]) & (s[None] <= (lengths - before)[:, None])  # windows within the document
    rows, offset = np.nonzero(whole)
    starts = rows * STRING + offset
    ranks = window_ranks(text.reshape(-1), starts)
    # Equal windows start alike in their strings, for they hold the anchor's symbol at one place.
    order = np.lexsort((ranks, offset))
    equal = (ranks[order[1:]] == ranks[order[:-1]]) & (offset[order[1:]] == offset[order[:-1]])
    again = np.zeros(len(starts), bool)
    again[order[1:]] |= equal
    again[order[:-1]] |= equal
    again |= counts[rows] > 1
    out = np.zeros(m, np.int64)
    np.bitwise_or.at(out, rows, again.astype(np.int64) << (SIDE - offset))
    return out


def _summed(rows: pa.Table, counts: list) -> pa.Table:
    """One row for each anchor and context; counts: how n is made."""
    out = rows.group_by(["anchor", "id"], use_threads=False).aggregate([("sides", "first"), ("before", "first"), *counts])
    return out.rename_columns(["anchor", "id", "sides", "before", "n"])


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences to contexts with their counts, summed over many rows before they move."""
    waiting, size = [], 0

    def summed() -> Iterator[pa.RecordBatch]:
        out = _summed(pa.Table.from_batches(waiting), [([], "count_all")])
        yield from out.combine_chunks().to_batches()

    for batch in batches:
        waiting.append(batch)
        size += batch.num_rows
        if size >= GATHERED:
            yield from summed()
            waiting, size = [], 0
    if size:
        yield from summed()


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of anchors to (id, mask), in runs of whole anchors."""

    def judged(rows: pa.Table) -> pa.RecordBatch:
        rows = _summed(rows, [("n", "sum")]).combine_chunks()
        anchor, before, counts = rows["anchor"].to_numpy(), rows["before"].to_numpy().astype(np.int64), rows["n"].to_numpy()
        sides = rows["sides"].to_pylist()
        mask = np.where(counts > 1, whole_masks(before, np.array([len(s) for s in sides], np.int64)), 0)
        # An anchor of one context has no other string to be compared with.
        _, which, contexts = np.unique(anchor, return_inverse=True, return_counts=True)
        several = np.flatnonzero(contexts[which] > 1)
        if len(several):
            mask[several] = repeated_starts(anchor[several], [sides[i] for i in several.tolist()], before[several], counts[several])
        some = np.flatnonzero(mask)
        return pa.RecordBatch.from_arrays([rows["id"].combine_chunks().take(pa.array(some)), pa.array(mask[some])], ["id", "mask"])

    waiting: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        waiting = now if waiting is None else pa.concat_tables([waiting, now])
        while waiting.num_rows > STRINGS:
            anchor = waiting["anchor"].to_numpy()
            cut = int(np.searchsorted(anchor, anchor[STRINGS], side="left")) or int(np.searchsorted(anchor, anchor[0], side="right"))
            if cut == waiting.num_rows:
                break  # one anchor so far: the next batch may have more of it
            yield judged(waiting.slice(0, cut))
            waiting = waiting.slice(cut)
    if waiting is not None and waiting.num_rows:
        yield judged(waiting)


def covered_runs(n: int, places: np.ndarray, masks: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the marked windows cover."""
    bits = (masks[:, None] >> np.arange(SIDE + 1)) & 1
    which, back = np.nonzero(bits)
    starts = np.unique(places[which] - back)
    if not len(starts):
        return []
    gap = np.flatnonzero(starts[1:] > starts[:-1] + WINDOW)
    first = starts[np.concatenate([[0], gap + 1])]
    last = starts[np.concatenate([gap, [len(starts) - 1]])] + WINDOW
    return list(zip(first.tolist(), last.tolist(), strict=True))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
        keys = [row_key(d, t) for d, t in zip(batch.column(0).to_pylist(), texts, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column(0), pa.array([pack(t) for t in texts], pa.binary())], ["key", "doc_id", "data"])


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for data, marks in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = unpack(data)
                values = marks.values
                runs = [] if values is None or not len(values) else covered_runs(len(text), values.field(0).to_numpy(), values.field(1).to_numpy())
                kept, at = [], 0
                for a, b in runs:
                    kept.append(text[at:a])
                    at = b
                rest = b"".join([*kept, text[at:]])
                rows.append((len(text), sum(b - a for a, b in runs), len(runs), hashlib.sha256(rest).hexdigest(), rest))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())[: 5 if with_text else 4]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if with_text else 5])

    return run


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(segment, slots) to (segment, bits)."""
    for batch in batches:
        out = []
        for slots in batch.column(1):
            bits = np.zeros(SEGMENT_BITS, bool)
            bits[slots.values.to_numpy()] = True
            out.append(np.packbits(bits, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["segment", "bits"])


def anchor_filter(repeated: DataFrame) -> bytes:
    """A bit for each repeated anchor's hash modulo FILTER_BITS: 16 MB whatever their number; others it lets through cost time alone."""
    slot = F.col("anchor").bitwiseAND(FILTER_BITS - 1)
    by_segment = repeated.select((slot / SEGMENT_BITS).cast("int").alias("segment"), (slot % SEGMENT_BITS).cast("int").alias("slot")).distinct().groupBy("segment").agg(F.collect_list("slot").alias("slots"))
    table = by_segment.mapInArrow(_segments, "segment int, bits binary").toArrow()
    bits = np.zeros((FILTER_BITS // SEGMENT_BITS, SEGMENT_BITS // 8), np.uint8)
    for segment, data in zip(table["segment"].to_pylist(), table["bits"].to_pylist(), strict=True):
        bits[segment] = np.frombuffer(data, np.uint8)
    return bits.tobytes()


def remove_repeats(spark: SparkSession, docs: DataFrame, text: str = "text", key: str = "doc_id", with_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with_text the bytes that stay.

    A byte is removed if a 200-byte string that covers it starts anywhere else
    as well, in the same document or another, judged on the input.  Texts are
    UTF-8 bytes; null counts as empty; texts below 200 bytes are left whole.
    Strings do not cross documents.  Repeated rows, and rows of one key, are
    documents of their own.  Other columns play no part; no rows give no rows.
    """
    stages = Stages(spark, "repeats")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    repeated = stages.keep(rows.select("text").mapInArrow(_spread, "anchor long, n int").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"))
    held = spark.sparkContext.broadcast(anchor_filter(repeated))
    found = stages.keep(rows.mapInArrow(_contexts(held), "key binary, place long, anchor long, id binary, sides binary, before int"))
    # Equal contexts are counted before they move; those of an anchor then meet in order.
    kind = "anchor long, id binary, sides binary, before int, n long"
    distinct = found.select("anchor", "id", "sides", "before").mapInArrow(_distinct, kind)
    together = distinct.repartition("anchor").sortWithinPartitions("anchor")
    judged = stages.keep(together.mapInArrow(_sorted_runs, "id binary, mask long"))
    marks = found.select("key", "place", "id").join(judged.hint("merge"), "id").groupBy("key").agg(F.collect_set(F.struct("place", "mask")).alias("marks"))
    marks = stages.keep(marks)
    whole = rows.mapInArrow(_packed, "key binary, doc_id long, data binary")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return whole.join(marks.hint("merge"), "key", "left").select("doc_id", "data", "marks").mapInArrow(_cut(with_text), schema)
