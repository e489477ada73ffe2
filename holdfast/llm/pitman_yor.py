"""Scores texts with a hierarchical Pitman-Yor language model.

A token is drawn in the context of the word before it.  Contexts are restaurants
in four levels: one for each distinct word before, as many as the corpus has; that
word's last two bytes (LEAVES of them), its last byte (MIDDLES), and one root for
all; the root's parent is uniform over the vocabulary and one unknown.  A customer
is an occurrence; a dish a word; a table that is opened sends one customer to the
parent.  Words go by 64-bit identities whose last six bits are their leaf.

Texts are cut into windows of some TOKENS tokens, each one message: its distinct words,
and its tokens as places among these.  The pairs (word before, word) of all windows meet
in buckets by word, where they stay together through all sweeps, with the seats of their
words in the three upper levels: a bucket is one message too.  Only the tables of contexts
cross buckets: after each sweep a bucket sends the sums of the contexts that it has, and is
told their totals.  A pair seen once has one table always; the others are seated anew in each
sweep.  Pairs of the most frequent words, `hot_words` at most, are dealt over all buckets by
the word before; the upper levels of these words are with the driver.  All seats are drawn
given the totals of the sweep before, from hashes: a repeated task gives the same seats.
Averages are over the last sweeps, whose customers of the upper levels are kept; a context's
tables and its leaf's probabilities are averaged apart, which keeps sums at one.

Scoring sends each window the scores of its distinct pairs, bucket by bucket.
"""

from __future__ import annotations

import contextlib
import functools
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import _text as X
from holdfast.llm._stage import Stages

MIDDLES, PER_MIDDLE = 8, 8
LEAVES = MIDDLES * PER_MIDDLE
SWEEPS, KEPT = 6, 3
STRENGTH = 1.0
#: Words whose pairs are dealt over all buckets; tokens of a window, and words that _counted gathers; words that are scored at once.
HOT_WORDS, TOKENS, WORDS, STRIP = 64, 1 << 20, 1 << 18, 1 << 13
#: Parts in which the buckets are made, and scored, one part after another; tokens for each bucket.
PASSES, LEAST_BUCKETS, TOKENS_A_BUCKET = 2, 12, 2_000_000
_LOWER_TABLE = bytes(X.LOWER)


def tokens_of(text: bytes) -> list[bytes]:
    """Words lower-cased in A-Z, then the end, which is the empty word."""
    return [*text.translate(_LOWER_TABLE).split(), b""]


def leaf_of(word: bytes) -> int:
    """The restaurant for what follows a word; the empty word stands for the start."""
    return zlib.crc32(word[-1:]) % MIDDLES * PER_MIDDLE + zlib.crc32(word[-2:]) % PER_MIDDLE


class _Numbers(dict):
    """word -> its number, in order of appearance; leaves holds each one's context."""

    def __init__(self):
        super().__init__()
        self.leaves: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.leaves)
        self.leaves.append(leaf_of(word))
        return n


def _contexts(leaf: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The context of each token: that of the token before, at a text's start that of the empty word."""
    out = np.empty(len(ids), np.int64)
    out[1:] = leaf[ids[:-1]]
    out[starts] = leaf_of(b"")
    return out


#: A word's occurrences after one leaf.
_COUNT = np.dtype([("leaf", "u1"), ("n", "<i8")])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, counts by leaf), summed over many texts first: a task gives a word one row, or few."""
    numbers, ids, starts, total = _Numbers(), [], [], 0

    def rows() -> pa.RecordBatch:
        every = np.concatenate(ids)
        leaf = np.array(numbers.leaves)
        keys, n = np.unique(every * LEAVES + _contexts(leaf, every, np.array(starts)), return_counts=True)
        counts = np.empty(len(keys), _COUNT)
        counts["leaf"], counts["n"] = keys % LEAVES, n
        at = np.searchsorted(keys // LEAVES, np.arange(len(numbers) + 1)) * _COUNT.itemsize
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(numbers), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(counts.tobytes())])
        words = pa.array(list(numbers), pa.binary())
        ids.clear(), starts.clear(), numbers.clear(), numbers.leaves.clear()
        return pa.RecordBatch.from_arrays([words, packed.cast(pa.binary())], ["word", "counts"])

    with X.without_cycles():
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                ids.append(np.array([numbers[w] for w in tokens_of(text or b"")], np.int64))
                starts.append(total)
                total += len(ids[-1])
                if total > TOKENS or len(numbers) > WORDS:
                    yield rows()
                    total = 0
        if ids:
            yield rows()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of words to one row a word: word, n, found (leaf and n).  A word may run over several batches."""
    held: tuple[pa.Scalar, np.ndarray] | None = None

    def rows(words: pa.Array, word: np.ndarray, leaf: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        at = np.searchsorted(word, np.arange(len(words) + 1))
        found = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.StructArray.from_arrays([pa.array(leaf.astype(np.int32)), pa.array(n)], ["leaf", "n"]))
        return pa.RecordBatch.from_arrays([words, pa.array(np.bincount(word, n, minlength=len(words)).astype(np.int64)), found], ["word", "n", "found"])

    for batch in batches:
        if not batch.num_rows:
            continue
        words = batch.column(0)
        new = np.ones(batch.num_rows, bool)
        new[1:] = pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)
        number = np.cumsum(new) - 1
        raw, offsets = X.utf8(batch.column(1))
        counts = np.frombuffer(raw.tobytes(), _COUNT)
        total = np.zeros((1, LEAVES), np.int64)
        names = words.take(pa.array(np.flatnonzero(new)))
        key = np.repeat(number, np.diff(offsets) // _COUNT.itemsize) * LEAVES + counts["leaf"]
        n = counts["n"]
        if held is not None:
            before = np.flatnonzero(held[1])
            if held[0] == names[0]:
                key, n = np.concatenate([before, key]), np.concatenate([held[1][before], n])
            else:
                yield rows(pa.array([held[0].as_py()], pa.binary()), np.zeros(len(before), np.int64), before, held[1][before])
        keys, which = np.unique(key, return_inverse=True)
        sums = np.bincount(which, n).astype(np.int64)
        last = len(names) - 1
        cut = int(np.searchsorted(keys, last * LEAVES))
        total[0, keys[cut:] % LEAVES] = sums[cut:]
        held = names[last], total[0]
        if last:
            yield rows(names.slice(0, last), keys[:cut] // LEAVES, keys[:cut] % LEAVES, sums[:cut])
    if held is not None:
        before = np.flatnonzero(held[1])
        yield rows(pa.array([held[0].as_py()], pa.binary()), np.zeros(len(before), np.int64), before, held[1][before])


def _chance(key: np.ndarray, step: int) -> np.ndarray:
    return (X.mix64(key + X.U64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> X.U64(11)) * 2.0**-53


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, key: np.ndarray) -> np.ndarray:
    """Tables of each dish after its customers are seated one by one.

    A new table has the weight `weight`, the old ones together n - discount * tables.
    Stretches of a sixteenth of the customers so far are seated together, their
    number of new tables rounded by chance.
    """
    tables = np.minimum(customers, 1).astype(np.float64)
    seated = tables.copy()
    open_ = np.flatnonzero(customers > 1)
    step = 0
    while len(open_):
        n, t, w = seated[open_], tables[open_], weight[open_]
        stretch = np.minimum(np.maximum(1, n // 16), customers[open_] - n)
        new = stretch * w / (w + n - discount * t)
        tables[open_] = t + np.floor(new) + (_chance(key[open_], step) < new % 1)
        seated[open_] = n + stretch
        open_ = open_[seated[open_] < customers[open_]]
        step += 1
    return np.minimum(tables, customers)


class Totals:
    """Tables (and the leaves' customers) of each restaurant after a sweep."""

    def __init__(self, customers: np.ndarray, leaf: np.ndarray, middle: np.ndarray, root: float, discounts: tuple[float, float], words: int):
        self.c1, self.t1, self.t2, self.t3 = customers, leaf, middle, root
        self.c2, self.c3 = leaf.reshape(MIDDLES, PER_MIDDLE).sum(axis=1), middle.sum()
        self.d1, self.d3 = discounts
        self.uniform = 1 / (words + 1)

    def root(self, c3, t3):
        return (np.maximum(c3 - self.d3 * t3, 0) + (STRENGTH + self.d3 * self.t3) * self.uniform) / (STRENGTH + self.c3)

    def own_middle(self, c2, t2, m):
        return np.maximum(c2 - self.d1 * t2, 0) / (STRENGTH + self.c2[m])

    def to_root(self):
        return (STRENGTH + self.d1 * self.t2) / (STRENGTH + self.c2)

    def to_middle(self):
        return (STRENGTH + self.d1 * self.t1) / (STRENGTH + self.c1)


class Seats:
    """The customers of a batch of words, and their tables sweep by sweep."""

    def __init__(self, batch: pa.RecordBatch):
        """batch: word, n, found (list of leaf and n), and for each sweep so far the customers in the order of found, if they change."""
        found = batch.column(2)
        counts = np.diff(found.offsets.to_numpy())
        flat = found.flatten()
        leaf, c = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy()
        word = np.repeat(np.arange(batch.num_rows), counts)
        order = np.lexsort((leaf, word))
        self.word, self.leaf, self.c1 = word[order], leaf[order], c[order].astype(np.float64)
        middle = self.leaf // PER_MIDDLE
        begins = np.ones(len(self.word), bool)
        begins[1:] = (self.word[1:] != self.word[:-1]) | (middle[1:] != middle[:-1])
        self.group = np.cumsum(begins) - 1
        self.gword, self.gmiddle = self.word[begins], middle[begins]
        self.size = batch.num_rows
        names = X.row_hashes(*X.utf8(batch.column(0)))
        self.k1 = X.mix64(names[self.word] + self.leaf.astype(X.U64))
        self.k2 = X.mix64(names[self.gword] + (self.gmiddle + LEAVES).astype(X.U64))
        self.k3 = X.mix64(names + X.U64(LEAVES + MIDDLES))
        self.later = [np.array(c.flatten(), np.float64)[order] for c in batch.columns[3:]]
        self.t1, self.t2, self.t3 = np.ones(len(self.word)), np.ones(len(self.gword)), np.ones(self.size)
        self.c2, self.c3 = np.bincount(self.group, self.t1, minlength=len(self.gword)), np.bincount(self.gword, self.t2, minlength=self.size)

    def sweep(self, totals: Totals, number: int) -> None:
        salt = X.U64(number * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF)
        p3 = totals.root(self.c3, self.t3)
        p2 = totals.own_middle(self.c2, self.t2, self.gmiddle) + totals.to_root()[self.gmiddle] * p3[self.gword]
        if number < len(self.later):
            self.c1 = self.later[number]
        at = np.flatnonzero(self.c1 > 1)
        self.t1.fill(1)
        self.t1[at] = seat(self.c1[at], (STRENGTH + totals.d1 * totals.t1[self.leaf[at]]) * p2[self.group[at]], totals.d1, self.k1[at] ^ salt)
        self.c2 = np.bincount(self.group, self.t1, minlength=len(self.gword))
        at = np.flatnonzero(self.c2 > 1)
        self.t2.fill(1)
        self.t2[at] = seat(self.c2[at], (STRENGTH + totals.d1 * totals.t2[self.gmiddle[at]]) * p3[self.gword[at]], totals.d1, self.k2[at] ^ salt)
        self.c3 = np.bincount(self.gword, self.t2, minlength=self.size)
        at = np.flatnonzero(self.c3 > 1)
        self.t3.fill(1)
        self.t3[at] = seat(self.c3[at], np.full(len(at), (STRENGTH + totals.d3 * totals.t3) * totals.uniform), totals.d3, self.k3[at] ^ salt)

    def in_leaf(self, totals: Totals) -> np.ndarray:
        """The probability of each word in each of its leaves."""
        p2 = totals.own_middle(self.c2, self.t2, self.gmiddle) + totals.to_root()[self.gmiddle] * totals.root(self.c3, self.t3)[self.gword]
        return np.maximum(self.c1 - totals.d1 * self.t1, 0) / (STRENGTH + totals.c1[self.leaf]) + totals.to_middle()[self.leaf] * p2[self.group]

    def sums(self) -> np.ndarray:
        return np.concatenate([np.bincount(self.leaf, self.t1, minlength=LEAVES), np.bincount(self.gmiddle, self.t2, minlength=MIDDLES), [self.t3.sum()]])


def _swept(history: list[Totals]):
    """The sums of tables after one sweep for each of history."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEAVES + MIDDLES + 1)
        for batch in batches:
            if batch.num_rows:
                seats = Seats(batch)
                for number, totals in enumerate(history):
                    seats.sweep(totals, number)
                total += seats.sums()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["place", "tables"])

    return run


class Predictive:
    """Averaged predictive probabilities; of a word: what it has of its own at each kept sweep."""

    def __init__(self, kept: list[Totals]):
        self.to_middle = np.stack([t.to_middle() for t in kept])  # sweeps x LEAVES
        self.to_root = np.stack([np.repeat(t.to_root(), PER_MIDDLE) for t in kept])
        self.unknown = np.array([t.root(0.0, 0.0) for t in kept])

    def log10(self, words: int, leaf_word, leaf, leaf_own, mid_word, mid, mid_own, root) -> np.ndarray:
        """words x LEAVES: log10 of the probability in each context.  mid_own: entries x sweeps; root: words x sweeps."""
        out = np.zeros((words, LEAVES))
        for s in range(len(self.unknown)):
            middle = np.zeros((words, MIDDLES))
            middle[mid_word, mid] = mid_own[:, s]
            out += self.to_middle[s] * (np.repeat(middle, PER_MIDDLE, axis=1) + self.to_root[s] * root[:, s : s + 1])
        out /= len(self.unknown)
        np.add.at(out, (leaf_word, leaf), leaf_own)
        return np.log10(out).astype(np.float32)

    def log10_unknown(self) -> np.ndarray:
        none = np.zeros(0, np.int64)
        return self.log10(1, none, none, np.zeros(0), none, none, np.zeros((0, len(self.unknown))), self.unknown[None])[0]


def _learnt(history: list[Totals]):
    """(word, n, found, customers by sweep) to (word, n, leaf, leaf_own, mid, mid_own, root): small arrays as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seats, own1, own2, own3 = Seats(batch), 0.0, [], []
            for number in range(SWEEPS):
                seats.sweep(history[number], number)
                if number >= SWEEPS - KEPT:
                    now = history[number + 1]
                    own1 = own1 + np.maximum(seats.c1 - now.d1 * seats.t1, 0) / (STRENGTH + now.c1[seats.leaf]) / KEPT
                    own2.append(now.own_middle(seats.c2, seats.t2, seats.gmiddle))
                    own3.append(now.root(seats.c3, seats.t3))
            at1 = np.searchsorted(seats.word, np.arange(seats.size + 1))
            at2 = np.searchsorted(seats.gword, np.arange(seats.size + 1))
            parts = (
                (seats.leaf.astype(np.uint8), at1, 1),
                (own1.astype(np.float32), at1, 4),
                (seats.gmiddle.astype(np.uint8), at2, 1),
                (np.stack(own2, axis=1).astype(np.float32), at2, 4 * KEPT),
                (np.stack(own3, axis=1).astype(np.float32), np.arange(seats.size + 1), 4 * KEPT),
            )
            columns = [pa.LargeBinaryArray.from_buffers(pa.large_binary(), seats.size, [None, pa.py_buffer((at * width).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary()) for data, at, width in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["word", "n", "leaf", "leaf_own", "mid", "mid_own", "root"])

    return run


def _probabilities(predictive: Predictive, columns: list[pa.Array]) -> np.ndarray:
    """Rows of log10 probabilities from the columns leaf to root of the model."""
    (leaf, at1), (own1, _), (mid, at2), (own2, _), (root, _) = (X.utf8(c) for c in columns)
    words = len(columns[0])
    return predictive.log10(
        words,
        np.repeat(np.arange(words), np.diff(at1)),
        leaf.astype(np.int64),
        np.frombuffer(own1.tobytes(), np.float32),
        np.repeat(np.arange(words), np.diff(at2)),
        mid.astype(np.int64),
        np.frombuffer(own2.tobytes(), np.float32).reshape(-1, KEPT),
        np.frombuffer(root.tobytes(), np.float32).reshape(-1, KEPT),
    )


_ONE = np.array([leaf_of(bytes([b])) for b in range(256)], np.uint64)
_TWO = np.array([leaf_of(bytes([a, b])) for a in range(256) for b in range(256)], np.uint64)
_LOW = X.U64(LEAVES - 1)
END = X.mix64(np.array([7], np.uint64))[0] & ~_LOW | X.U64(leaf_of(b""))


def identities(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The identities of each row's tokens, the end included, and n + 1 places; the last bits are leaf_of."""
    words, at = X.word_hashes(raw, offsets)
    rows = np.arange(len(offsets))
    out = np.full(len(words) + len(offsets) - 1, END, np.uint64)
    if len(words):
        low, n = X.LOWER[raw], len(raw)
        separate, cut = X._SEPARATOR[low], np.zeros(n + 1, bool)
        cut[offsets] = True
        last = ~separate
        last[:-1] &= separate[1:] | cut[1:n]
        end = np.flatnonzero(last)
        alone = cut[end] | separate[end - 1]
        leaf = np.where(alone, _ONE[low[end]], _TWO[low[end - 1].astype(np.int64) << 8 | low[end]])
        out[np.arange(len(words)) + np.repeat(rows[:-1], np.diff(at))] = words & ~_LOW | leaf
    return out, at + rows


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return X.mix64(before * X.U64(0x9E3779B97F4A7C15) + word)


def most_frequent(counted: DataFrame, most: int, name: Column) -> DataFrame:
    """Rows of the greatest n > 0, `most` at most: whole classes of n by its logarithm, and of the next class a share by the hash of `name`."""
    grade = F.floor(F.log2(F.col("n").cast("double")) * 8)
    left, least, share = most, None, 0
    for r in counted.where("n > 0").groupBy(grade.alias("grade")).count().orderBy(F.desc("grade")).collect():  # eight for each doubling of n
        if r["count"] > left:
            share, least = int(900 * left / r["count"]), r["grade"]  # of 1000: below the share that would fit exactly
            break
        left, least, share = left - r["count"], r["grade"], 1000
    if least is None:
        return counted.where("false")
    return counted.where((F.col("n") > 0) & ((grade > least) | ((grade == least) & (F.pmod(name, F.lit(1000)) < share))))


#: What the steps hand on: a part's number (a window's, a bucket's), the one it comes from, and arrays as bytes.
_MESSAGE = "kind string, part long, source long, data binary, value double"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays end to end, integers as narrow as they can be."""
    out = [struct.pack("<H", len(arrays))]
    for a in arrays:
        if a.dtype.kind in "iu" and a.dtype.itemsize > 1 and a.dtype != np.uint64:
            least, most = (int(a.min()), int(a.max())) if len(a) else (0, 0)
            a = a.astype(np.promote_types(np.min_scalar_type(least), np.min_scalar_type(most)))
        out += [struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)), np.ascontiguousarray(a).tobytes()]
    return b"".join(out)


def _unpack(data: bytes) -> list[np.ndarray]:
    (count,), at, out = struct.unpack_from("<H", data), 2, []
    for _ in range(count):
        kind, n = struct.unpack_from("<2sQ", data, at)
        dtype = np.dtype(kind.decode())
        a = np.frombuffer(data, dtype, n, at + 10)
        out.append(a.astype(np.int64) if dtype.kind in "iu" and dtype != np.uint64 else a)
        at += 10 + n * dtype.itemsize
    return out


def _message(rows: list[tuple]) -> pa.Table:
    """rows: kind, part, source, and bytes or a number."""
    kinds, parts, sources, data = zip(*rows, strict=True) if rows else ([], [], [], [])
    held = [[x if isinstance(x, bytes) else None for x in data], [x if isinstance(x, float) else None for x in data]]
    columns = [pa.array(kinds, pa.string()), pa.array(parts, pa.int64()), pa.array(sources, pa.int64()), pa.array(held[0], pa.binary()), pa.array(held[1], pa.float64())]
    return pa.table(columns, names=["kind", "part", "source", "data", "value"])


def _ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and each one's place among them; by hash, as they are too wide for _grouped."""
    coded = pa.array(values).dictionary_encode()
    distinct = coded.dictionary.to_numpy()
    order = np.argsort(distinct)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return distinct[order], place[coded.indices.to_numpy()]


def _grouped(keys: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys in order (0 <= keys < below), where each stood, and whether it is the first of its kind.  Plain sorting of numbers that hold the place too is much faster than argsort."""
    bits = len(keys).bit_length()
    if below.bit_length() + bits < 64:
        both = keys << bits
        both |= np.arange(len(keys))
        both.sort()
        keys, order = both >> bits, both & ((1 << bits) - 1)
    else:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return keys, order, first


def _windows(most: int):
    """(row, doc_id, text, held_out) to a message a window of some TOKENS tokens: its words in order of identity, tokens as places among these, and rows; and its most frequent words."""

    def whole(held: list, first: int) -> pa.RecordBatch:
        ids, sizes, doc, known, held_out = (np.concatenate(x) for x in zip(*held, strict=True))
        vocabulary, tokens = _ranked(ids)
        counts = np.bincount(tokens, minlength=len(vocabulary))
        top = np.argsort(-counts, kind="stable")[:most]
        rows = [("tokens", first, len(ids), _pack(vocabulary, tokens, sizes, doc, known, held_out)), ("top", first, len(ids), _pack(vocabulary[top], counts[top]))]
        held.clear()
        return _message(rows).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, first = [], 0, 0
        for batch in batches:
            raw, offsets = X.utf8(batch.column(2))
            doc = batch.column(1)
            known = doc.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
            doc, learns = doc.fill_null(0).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False).astype(np.uint8)
            for i, j in X.slices(offsets):
                ids, at = identities(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                if not held:
                    first = batch.column(0)[i].as_py()
                held.append((ids, np.diff(at), doc[i:j], known[i:j], learns[i:j]))
                total += len(ids)
                if total > TOKENS:
                    yield whole(held, first)
                    total = 0
        if held:
            yield whole(held, first)

    return run


def _bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    """Ascending with the identity."""
    return ((ids >> X.U64(32)) * X.U64(buckets) >> X.U64(32)).astype(np.int64)


class _Window:
    """The distinct pairs of a window, by bucket, word and word before: word and before (places in the vocabulary), n (occurrences in texts that are learnt from), at (where each bucket starts)."""

    def __init__(self, data: bytes, buckets: int, hot: np.ndarray):
        self.vocabulary, tokens, self.sizes, self.doc, self.known, self.held_out = _unpack(data)
        size = len(self.vocabulary)
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[np.cumsum(self.sizes) - self.sizes] = np.searchsorted(self.vocabulary, END)
        self.tokens = tokens
        before += tokens * size
        keys, self.places, first = _grouped(before, size * size)
        pairs = keys[first]
        del before, keys
        self.pair = np.cumsum(first) - 1  # of the tokens at places
        learns = np.repeat(1 - self.held_out, self.sizes)
        self.n = np.bincount(self.pair, learns[self.places], minlength=len(pairs)).astype(np.int64)
        self.word, self.before = pairs // size, pairs % size
        of = _bucket(self.vocabulary, buckets)
        dealt = np.isin(self.vocabulary, hot)
        bucket = np.where(dealt[self.word], of[self.before], of[self.word])
        self.order = np.argsort(bucket, kind="stable")
        self.at = np.searchsorted(bucket[self.order], np.arange(buckets + 1))


def _paired(buckets: int, hot: np.ndarray, part: int):
    """Windows to the pairs that each has for each bucket of a part: identities of words, the pairs of each, identities of the words before, n."""

    def pairs(_: str, number: int, data: bytes) -> list[tuple]:
        w, rows = _Window(data, buckets, hot), []
        for b in range(part, buckets, PASSES):
            mine = w.order[w.at[b] : w.at[b + 1]]
            if len(mine):
                word = w.word[mine]
                first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                rows.append(("pairs", b, number, _pack(w.vocabulary[word[first]], np.diff(first, append=len(word)), w.vocabulary[w.before[mine]], w.n[mine])))
        return rows

    return _each(pairs)


def _each(run: Callable[[str, int, bytes], list[tuple]]):
    """The rows that run gives for each message: its kind, part and data."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                yield from _message(run(kind, part, data.as_buffer())).to_batches()

    return X.lean(out)


def _by_source(table: pa.Table, kind: str) -> list[tuple[int, bytes]]:
    """(source, data) of the rows of a kind, by source."""
    mine = table.filter(pc.equal(table.column("kind"), kind)).sort_by("source")
    return list(zip(mine.column("source").to_pylist(), [x.as_buffer() for x in mine.column("data")], strict=True))


def _sum(values: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(at, values, minlength=size).astype(np.int64)


def _seats(names: np.ndarray, word: np.ndarray, leaf: np.ndarray, dishes: np.ndarray) -> Seats:
    return Seats(_upper(names, word, leaf, dishes, []))


def _upper(names: np.ndarray, word: np.ndarray, leaf: np.ndarray, dishes: np.ndarray, later: list[np.ndarray]) -> pa.RecordBatch:
    """Words (each with an entry at least) as Seats has them; entries by word and leaf.  Their counts play no part there."""
    at = pa.array(np.searchsorted(word, np.arange(len(names) + 1)).astype(np.int32))
    spelt = pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer((np.arange(len(names) + 1) * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(names).tobytes())])
    found = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([pa.array(leaf.astype(np.int32)), pa.array(dishes)], ["leaf", "n"]))
    return pa.RecordBatch.from_arrays([spelt, pa.array(np.zeros(len(names), np.int64)), found, *[pa.ListArray.from_arrays(at, pa.array(c)) for c in later]], ["word", "n", "found", *[f"c{i}" for i in range(len(later))]])


def _to_contexts(bucket: int, contexts: np.ndarray, shares: int, wanted: np.ndarray, *values: np.ndarray) -> list[tuple]:
    """Messages to the shares of the contexts, which are in order of identity."""
    at, rows = np.searchsorted(_bucket(contexts, shares), np.arange(shares + 1)), []
    for i in range(shares):
        mine = slice(at[i], at[i + 1])
        if at[i] < at[i + 1]:
            rows.append(("ask", i, bucket, _pack(contexts[mine], wanted[mine].astype(np.uint8), *[v[mine] for v in values])))
    return rows


def _summed(table: pa.Table) -> pa.Table:
    """What the buckets ask a share of the contexts: to each, the sums over all buckets for the contexts that it wants."""
    asked = [(b, _unpack(data)) for b, data in _by_source(table, "ask")]
    sizes = [len(x[0]) for _, x in asked]
    names, at = _ranked(np.concatenate([x[0] for _, x in asked]))
    sums = [_sum(np.concatenate(v), at, len(names)) for v in zip(*[x[2:] for _, x in asked], strict=True)]
    rows, ends, share = [], np.cumsum(sizes), table.column("part")[0].as_py()
    for (b, x), end, size in zip(asked, ends, sizes, strict=True):
        mine = at[end - size : end][x[1] > 0]
        if len(mine):
            rows.append(("told", b, share, _pack(*[s[mine] for s in sums])))
    return _message(rows)


def _told(table: pa.Table) -> list[np.ndarray]:
    """The sums for a bucket's wanted contexts, in their order."""
    return [np.concatenate(x) for x in zip(*[_unpack(d) for _, d in _by_source(table, "told")], strict=True)]


def _sums(bucket: int, **values: np.ndarray) -> list[tuple]:
    """Rows that are added up over the buckets for the driver."""
    return [(f"sum {name}", place, bucket, float(value)) for name, x in values.items() for place, value in enumerate(x.tolist()) if value]


def _combined() -> Callable[[pa.Table], pa.Table]:
    """The pairs that all windows have for a bucket, each once, with their counts; and which of them each window has."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("part")[0].as_py()
        blobs = [(source, _unpack(data)) for source, data in _by_source(table, "pairs")]
        del table
        names = np.unique(np.concatenate([x[0] for _, x in blobs]))
        contexts, c = _ranked(np.concatenate([x[2] for _, x in blobs]))
        w = np.concatenate([np.repeat(np.searchsorted(names, x[0]), x[1]) for _, x in blobs])
        keys, order, first = _grouped(w * len(contexts) + c, len(names) * len(contexts))
        of = np.empty(len(keys), np.int64)
        of[order] = np.cumsum(first) - 1
        keys = keys[first]
        n = _sum(np.concatenate([x[3] for _, x in blobs]), of, len(keys))
        w, c = keys // len(contexts), keys % len(contexts)
        sizes = np.cumsum([len(x[3]) for _, x in blobs])
        asked = [np.diff(of[end - len(x[3]) : end], prepend=0) for (_, x), end in zip(blobs, sizes, strict=True)]
        asked_words = [np.searchsorted(names, x[0]) for _, x in blobs]
        windows = np.array([source for source, _ in blobs])
        per_word = np.diff(np.searchsorted(w, np.arange(len(names) + 1)))
        return _message([("pairs", bucket, 0, _pack(names, per_word, contexts, c, n, _sum(n, w, len(names)), windows, *[a for x in zip(asked, asked_words, strict=True) for a in x]))])

    return run


def _begun(shares: int, hot: np.ndarray):
    """A bucket's pairs to its tables before the first sweep, and to what the contexts and the driver must know."""

    def begun(bucket: int, data: bytes) -> list[tuple]:
        names, per_word, contexts, c, n, count, *_ = _unpack(data)
        w, cold = np.repeat(np.arange(len(names)), per_word), ~np.isin(names, hot)
        leaf, rows = (contexts & _LOW).astype(np.int64)[c], []
        # Upper levels: words that are learnt, hot ones with the driver.
        learnt = np.flatnonzero(n > 0)
        keys, order, first = _grouped(w[learnt] * LEAVES + leaf[learnt], len(names) * LEAVES)
        entry_of = np.zeros(len(n), np.int64)
        entry_of[learnt[order]] = np.cumsum(first) - 1
        entry_word, entry_leaf = keys[first] // LEAVES, keys[first] % LEAVES
        dishes = np.bincount(entry_of[learnt], minlength=len(entry_word))
        lone = np.bincount(entry_of[n == 1], minlength=len(entry_word))
        mine = cold[entry_word]
        word, at = np.unique(entry_word[mine], return_inverse=True)
        seats = _seats(names[word], at, entry_leaf[mine], dishes[mine])
        # Pairs that are seated anew: entry is 1 and more; 0 for those of hot words, which go by place.
        many = np.flatnonzero(n > 1)
        seated, seated_c = np.unique(c[many], return_inverse=True)
        where = entry_of[many]
        entry = np.where(mine[where], np.cumsum(mine)[where], 0)
        place = np.where(entry == 0, np.searchsorted(hot, names[w[many]]) * LEAVES + leaf[many], 0)
        tables = [x.astype(np.int64) for x in (seats.t1, seats.t2, seats.t3)]
        rows.append(("state", bucket, 0, _pack(names[word], at, entry_leaf[mine], dishes[mine], lone[mine], seated_c, contexts[seated], n[many], entry, place, np.zeros(len(many), np.int64), *tables)))
        wanted = np.zeros(len(contexts), bool)
        wanted[seated] = True
        seen = np.bincount(c[n > 0], minlength=len(contexts))
        some = seen > 0
        rows += _to_contexts(bucket, contexts[some], shares, wanted[some], seen[some], np.bincount(c[n == 1], minlength=len(contexts))[some])
        hot_at = np.searchsorted(hot, names[entry_word[~mine]]) * LEAVES + entry_leaf[~mine]
        size = len(hot) * LEAVES
        words = len(word)
        leaves_of = np.bincount(at, minlength=words)
        rows += _sums(
            bucket,
            tables=seats.sums(),
            customers=np.bincount(seats.leaf, seats.c1, minlength=LEAVES),
            corpus=np.array([n.sum(), words, (n == 1).sum(), (n == 2).sum(), (dishes[mine] == 1).sum(), (dishes[mine] == 2).sum(), (leaves_of == 1).sum(), (leaves_of == 2).sum()]),
            dishes=np.bincount(hot_at, dishes[~mine], minlength=size),
            lone=np.bincount(hot_at, lone[~mine], minlength=size),
            count=np.bincount(np.searchsorted(hot, names[~cold]), count[~cold], minlength=len(hot)),
        )
        return rows

    return _each(lambda _, bucket, data: begun(bucket, data))


def _swept_bucket(totals: Totals, discount: float, number: int, shares: int, hot: np.ndarray, hot_p: np.ndarray):
    """A bucket's tables after a sweep: of its pairs, given their contexts' tables and their words' probabilities, then of its words in the upper levels."""
    salt = X.U64(number * 0xD1342543DE82EF95 + 0x51ED & 0xFFFFFFFFFFFFFFFF)

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("part")[0].as_py()
        ((_, data),) = _by_source(table, "state")
        names, at, leaf, dishes, lone, c, contexts, n, entry, place, ts, t1, t2, t3, *later = _unpack(data)
        told = _told(table) if len(contexts) else [np.zeros(0, np.int64)] * 2
        del table
        seats = _seats(names, at, leaf, dishes)
        if number:
            single, *later = later
            total = told[0] + single
            seats.c1, seats.t1, seats.t2, seats.t3 = (x.astype(np.float64) for x in (later[-1], t1, t2, t3))
            seats.c2, seats.c3 = np.bincount(seats.group, t1, minlength=len(seats.gword)), np.bincount(seats.gword, t2, minlength=seats.size)
        else:
            total, single = told
        cold = entry > 0
        p, w = np.zeros(len(n)), np.zeros(len(n), np.uint64)
        mine, other = entry[cold] - 1, place[~cold]
        p[cold], w[cold] = seats.in_leaf(totals)[mine], names[at[mine]]
        p[~cold], w[~cold] = hot_p[other], hot[other // LEAVES]
        t = seat(n.astype(np.float64), (STRENGTH + discount * total[c]) * p, discount, pair_keys(contexts[c], w) ^ salt).astype(np.int64)
        if number >= SWEEPS - KEPT:
            ts = ts + t
        customers = lone + _sum(t[cold], mine, len(at))
        seats.later = [None] * number + [customers.astype(np.float64)]
        seats.sweep(totals, number)
        tables = [x.astype(np.int64) for x in (seats.t1, seats.t2, seats.t3)]
        rows = [("state", bucket, 0, _pack(names, at, leaf, dishes, lone, c, contexts, n, entry, place, ts, *tables, single, *later, customers))]
        if number < SWEEPS - 1:
            rows += _to_contexts(bucket, contexts, shares, np.ones(len(contexts), bool), _sum(t, c, len(contexts)))
        rows += _sums(bucket, tables=seats.sums(), customers=np.bincount(seats.leaf, seats.c1, minlength=LEAVES), seated=np.bincount(other, t[~cold], minlength=len(hot_p)))
        return _message(rows)

    return run


def _of_pairs(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """A bucket's pairs, their tables summed over the kept sweeps, and its state."""
    ((_, data),), ((_, state),) = _by_source(table, "pairs"), _by_source(table, "state")
    pairs, state = _unpack(data), _unpack(state)
    ts = pairs[4] * KEPT
    ts[pairs[4] > 1] = state[10]
    return pairs, ts, state


def _last_asked(shares: int):
    """What contexts have of a bucket's pairs: customers, and tables of the kept sweeps, those of pairs that are seated anew from the bucket's state."""

    def asked(kind: str, bucket: int, data: bytes) -> list[tuple]:
        x = _unpack(data)
        if kind == "state":
            c, contexts, ts = x[5], x[6], x[10]
            return _to_contexts(bucket, contexts, shares, np.zeros(len(contexts), bool), np.zeros(len(contexts), np.int64), _sum(ts, c, len(contexts)))
        contexts, c, n = x[2:5]
        return _to_contexts(bucket, contexts, shares, np.ones(len(contexts), bool), _sum(n, c, len(contexts)), KEPT * np.bincount(c[n == 1], minlength=len(contexts)))

    return _each(asked)


def _scored(history: list[Totals], discount: float, hot: np.ndarray, hot_log: np.ndarray, hot_count: np.ndarray):
    """To each window that has pairs in a bucket: their scores, and the counts of their words."""
    predictive = Predictive(history[-KEPT:])

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("part")[0].as_py()
        (words, per_word, contexts, c, n, count, windows, *asked), ts, state = _of_pairs(table)
        customers, tables = _told(table)
        del table
        names, at, leaf, dishes, later = *state[:4], state[15:]
        w, in_leaf = np.repeat(np.arange(len(words)), per_word), (contexts & _LOW).astype(np.int64)[c]
        log_p = predictive.log10_unknown()[in_leaf].astype(np.float64)
        row = np.full(len(words), -1)
        row[np.searchsorted(words, names)] = np.arange(len(names))
        row = row[w]
        for i in range(0, len(names), STRIP):
            some = names[i : i + STRIP]
            first, last = np.searchsorted(at, [i, i + len(some)])
            (model,) = _learnt(history)(iter([_upper(some, at[first:last] - i, leaf[first:last], dishes[first:last], [x[first:last] for x in later])]))
            here = np.flatnonzero((row >= i) & (row < i + len(some)))
            log_p[here] = _probabilities(predictive, [model.column(x) for x in range(2, 7)])[row[here] - i, in_leaf[here]]
        if len(hot):
            place = np.minimum(np.searchsorted(hot, words), len(hot) - 1)
            is_hot = hot[place] == words
            here = np.flatnonzero(is_hot[w])
            log_p[here] = hot_log[place[w[here]], in_leaf[here]]
            count = np.where(is_hot, hot_count[place], count)
        own = np.maximum(n - discount * ts / KEPT, 0)
        score = np.log10((own + (STRENGTH + discount * tables[c] / KEPT) * 10.0**log_p) / (STRENGTH + customers[c])).astype(np.float32)
        return _message([("scores", window, bucket, _pack(score[np.cumsum(places)], count[which])) for window, places, which in zip(windows.tolist(), asked[::2], asked[1::2], strict=True)])

    return run


def _texts_scored(buckets: int, hot: np.ndarray, train: int, size: int):
    """A window and the scores of its pairs to a row for each of its texts."""

    def run(table: pa.Table) -> pa.Table:
        ((_, data),) = _by_source(table, "tokens")
        found = _by_source(table, "scores")
        w = _Window(data, buckets, hot)
        score, count = np.zeros(len(w.word)), np.zeros(len(w.vocabulary), np.int64)
        for b, x in found:
            mine = w.order[w.at[b] : w.at[b + 1]]
            scores, counts = _unpack(x)
            word = w.word[mine]
            score[mine] = scores
            count[word[np.concatenate([[True], word[1:] != word[:-1]])]] = counts
        row = np.repeat(np.arange(len(w.sizes)), w.sizes)
        add = lambda x: np.bincount(row, x, minlength=len(w.sizes))
        base = np.log10((count + 1) / (train + size + 1))
        doc = pa.array(w.doc, mask=w.known == 0)
        of_pairs = np.bincount(row[w.places], score[w.pair], minlength=len(w.sizes))
        sums = [add((count > 0)[w.tokens]).astype(np.int64), add(base[w.tokens]), of_pairs]
        return pa.table([doc, pa.array(w.held_out > 0), pa.array(w.sizes), *map(pa.array, sums)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def score_texts(spark: SparkSession, docs: DataFrame, hot_words: int = HOT_WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Learns from the rows whose crc32(key as text) mod 7 is not 2; a row without a
    key is learnt from.  score is the model's log10 probability of the text, its
    end included; perplexity is 10 ** (-score / n_tokens).  base_score adds
    log10((c + 1) / (N + V + 1)) over tokens.  Null text counts as empty: one
    token, the end.  Repeated rows are learnt from and scored each.  With nothing
    to learn from, every token has probability 1.  Other columns play no part; no
    rows give no rows.
    """
    with _row_by_row(spark):
        out, train = _score(Stages(spark, "language-model"), docs, hot_words, text, key)
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(train).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


@contextlib.contextmanager
def _row_by_row(spark: SparkSession) -> Iterator[None]:
    """Meanwhile tables are read a row at a time, not in vectors of many rows: rows here are some megabytes each."""
    name = "spark.sql.parquet.enableVectorizedReader"
    was = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def _score(stages: Stages, docs: DataFrame, hot_words: int, text: str, key: str) -> tuple[DataFrame, int]:
    """doc_id, held_out, n_tokens, n_known, base_score, score; and the number of tokens that are learnt from."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out.alias("held_out"))
    with_top = stages.keep(rows.mapInArrow(X.lean(_windows(hot_words)), _MESSAGE))
    windows = with_top.where("kind = 'tokens'")

    # Hot words, whose pairs are dealt over all buckets by the word before, and whose upper levels the driver has.
    frequent: dict[int, int] = {}
    tokens = 0
    for r in with_top.where("kind = 'top'").toLocalIterator():
        tokens += r["source"]
        for w, n in zip(*(x.tolist() for x in _unpack(bytes(r["data"]))), strict=True):
            frequent[w] = frequent.get(w, 0) + n
    hot = np.sort(np.array(sorted(frequent, key=lambda w: (-frequent[w], w))[:hot_words], np.uint64))
    buckets = max(LEAST_BUCKETS, -(-tokens // TOKENS_A_BUCKET))
    shares = -(-buckets // 4)

    def every(parts: list[DataFrame]) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, parts)

    def grouped(run, *frames: DataFrame, schema: str = _MESSAGE) -> DataFrame:
        return every(list(frames)).groupBy("part").applyInArrow(run, schema)

    def of(df: DataFrame, kind: str) -> DataFrame:
        return df.where(F.col("kind") == kind)

    def told(df: DataFrame) -> DataFrame:
        return stages.keep(grouped(X.lean_group(_summed), of(df, "ask")))

    def added(df: DataFrame) -> dict[str, np.ndarray]:
        sums = {"tables": np.zeros(LEAVES + MIDDLES + 1), "customers": np.zeros(LEAVES), "corpus": np.zeros(8), "count": np.zeros(len(hot))}
        sums |= {name: np.zeros(len(hot) * LEAVES) for name in ("dishes", "lone", "seated")}
        with stages.clean():
            for r in df.where("value is not null").groupBy("kind", "part").agg(F.sum("value").alias("value")).collect():
                sums[r["kind"][4:]][r["part"]] = r["value"]
        return sums

    def discount(n1: float, n2: float) -> float:
        """Of counts of counts, away from 0 and 1."""
        return min(0.95, max(0.05, n1 / (n1 + 2 * n2) if n1 + n2 else 0.5))

    pairs = [stages.keep(grouped(X.lean_group(_combined()), windows.mapInArrow(_paired(buckets, hot, i), _MESSAGE))) for i in range(PASSES)]
    state = stages.keep(every(pairs).mapInArrow(_begun(shares, hot), _MESSAGE))
    sums = added(state)
    hot_place = np.flatnonzero(sums["dishes"])
    hot_words_seen, hot_at = np.unique(hot_place // LEAVES, return_inverse=True)
    hot_upper = hot[hot_words_seen], hot_at, hot_place % LEAVES, sums["dishes"][hot_place].astype(np.int64)
    hot_seats, hot_later = _seats(*hot_upper), []
    train, size = int(sums["corpus"][0]), int(sums["corpus"][1]) + len(hot_words_seen)
    hot_count = sums["count"].astype(np.int64)
    hot_lone = sums["lone"][hot_place]
    few = [[(x == k).sum() for k in (1, 2)] for x in (hot_upper[3], np.bincount(hot_at))]
    d0, of_leaves, of_words = (discount(*(a + b for a, b in zip(sums["corpus"][i : i + 2].tolist(), x, strict=True))) for i, x in ((2, [0, 0]), (4, few[0]), (6, few[1])))
    answer = told(state)
    history: list[Totals] = []
    for number in range(SWEEPS + 1):
        t = sums["tables"] + hot_seats.sums()
        customers = sums["customers"] + np.bincount(hot_seats.leaf, hot_seats.c1, minlength=LEAVES)
        history.append(Totals(customers, t[:LEAVES], t[LEAVES:-1], t[-1], (of_leaves, of_words), size))
        if number == SWEEPS:
            break
        hot_p = np.zeros(len(hot) * LEAVES)
        hot_p[hot_place] = hot_seats.in_leaf(history[-1])
        after = stages.keep(grouped(X.lean_group(_swept_bucket(history[-1], d0, number, shares, hot, hot_p)), of(state, "state"), answer))
        stages.drop(answer, state)
        state, sums = after, added(after)
        hot_later.append((hot_lone + sums["seated"][hot_place]).astype(np.int64))
        hot_seats.later = [None] * number + [hot_later[-1].astype(np.float64)]
        hot_seats.sweep(history[-1], number)
        if number < SWEEPS - 1:
            answer = told(state)

    predictive = Predictive(history[-KEPT:])
    hot_log = np.repeat(predictive.log10_unknown()[None], len(hot), axis=0)
    if len(hot_words_seen):
        (model,) = _learnt(history)(iter([_upper(*hot_upper, hot_later)]))
        hot_log[hot_words_seen] = _probabilities(predictive, [model.column(x) for x in range(2, 7)])
    seated = of(state, "state")
    answer = told(every(pairs).unionByName(seated).mapInArrow(_last_asked(shares), _MESSAGE))
    scores = []
    for i in range(2 * PASSES):
        mine = every([pairs[i % PASSES], seated, answer]).where(F.col("part") % (2 * PASSES) == i)
        scores.append(stages.keep(grouped(X.lean_group(_scored(history, d0, hot, hot_log, hot_count)), mine)))
        if i >= PASSES:
            stages.drop(pairs[i - PASSES])
    stages.drop(state, answer)
    columns = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    out = stages.keep(grouped(X.lean_group(_texts_scored(buckets, hot, train, size)), windows, *scores, schema=columns))
    stages.drop(with_top, *scores)
    return out, train
