"""Byte-level BPE encoding and decoding over a global table of distinct words.

Words are the matches of the published pattern.  Each task cuts its texts into words
once, and writes them as blocks: the distinct words of some megabytes of text, and
for each text the places of its words among them.  The blocks' words are exploded
with their places, and one shuffle with map-side combining makes the table of all
distinct words, each of which is encoded once.  Decoding joins its ids with the table
of token bytes.  What is made of a word is joined back to the blocks that hold it, and
each text is put together by the places of its words.  No text moves, and the most
frequent word of the corpus has one row for each block.

Texts are first cut at single spaces between other characters, where the pattern
always starts a new match, so that a piece is cut into words once for all its
occurrences in a block.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import _text as X
from holdfast.llm._stage import Stages

#: Pieces of text, and distinct ones, after which a block ends; parts of the blocks, put together one after another.
PIECES, DISTINCT, PARTS = 1 << 21, 1 << 18, 8

#: White space other than the space and the newline; a space between other characters.
_ODD = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_CLEAR = re.compile(r"(?<=\S) (?=\S)")


def pieces_of(text: str) -> list[str]:
    """The pieces of a text in order, without the space each but the first starts with; the first has one put before."""
    clear = not ("  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or _ODD.search(text))
    parts = text.split(" ") if clear else _CLEAR.split(text)
    parts[0] = " " + parts[0]
    return parts


def words_of(piece: str, cut) -> list[str]:
    """The matches of the pattern in a piece.  Letters alone are one, and so is a mark after them: no need to search."""
    if piece.isalpha():
        return [" " + piece]
    if piece[-1:] in ",." and piece[:-1].isalpha():
        return [" " + piece[:-1], piece[-1]]
    return cut(piece[1:] if piece[:1] == " " else " " + piece)


def _ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


@functools.cache
def _encoder(data: bytes) -> tiktoken.Encoding:
    """Each word is encoded by itself: the pattern takes any text as one piece."""
    return tiktoken.Encoding("ranks", pat_str=r"(?s:.)+", mergeable_ranks=_ranks(data), special_tokens={})


class _Numbers(dict):
    """key -> its number, in order of appearance."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def _spread(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """starts[0], ..., starts[0] + counts[0] - 1, starts[1], ..."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(int(ends[-1]) if len(ends) else 0)


def packed(keys: list[int | None], sizes: np.ndarray, places: np.ndarray) -> bytes:
    """The texts of a block: their number, keys (int64), whether these are null, words of each (int32), and the places of these words (uint32, by bytes), compressed."""
    planes = np.ascontiguousarray(places.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return b"".join([np.array([len(keys), *[k or 0 for k in keys]], np.int64).tobytes(), bytes([k is None for k in keys]), sizes.tobytes(), zstandard.compress(planes.tobytes(), 1)])


def unpacked(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    keys, null = np.frombuffer(data, np.int64, n, 8).tolist(), data[8 + 8 * n : 8 + 9 * n]
    planes = np.frombuffer(zstandard.decompress(data[8 + 13 * n :]), np.uint8).reshape(4, -1)
    return [None if none else k for k, none in zip(keys, null, strict=True)], np.frombuffer(data, np.int32, n, 8 + 9 * n), np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


class _Block:
    """Texts cut into pieces, and the distinct pieces so far."""

    def __init__(self):
        self.pieces, self.keys, self.texts, self.size = _Numbers(), [], [], 0

    def add(self, key: int | None, text: str) -> None:
        number = self.pieces.__getitem__
        self.keys.append(key)
        self.texts.append(np.array([number(p) for p in pieces_of(text)], np.int32))
        self.size += len(self.texts[-1])

    def row(self, cut) -> pa.RecordBatch:
        """texts (see packed), words."""
        words, flat, counts = _Numbers(), [], []
        for piece in self.pieces:
            found = words_of(piece, cut)
            counts.append(len(found))
            flat += [words[w] for w in found]
        flat, counts = np.array(flat, np.uint32), np.array(counts, np.int64)
        starts, self.pieces = np.cumsum(counts) - counts, _Numbers()
        for i, pieces in enumerate(self.texts):
            self.texts[i] = flat[_spread(counts[pieces], starts[pieces])]
        sizes, places = np.array([len(t) for t in self.texts], np.int32), np.concatenate(self.texts)
        return pa.RecordBatch.from_arrays([pa.array([packed(self.keys, sizes, places)], pa.binary()), pa.array([list(words)], pa.list_(pa.string()))], ["texts", "words"])


def _blocks(pattern: str, pieces: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, block = regex.compile(pattern).findall, _Block()
        with X.without_cycles():
            for batch in batches:
                texts = batch.column(1)
                for i, key in enumerate(batch.column(0).to_pylist()):
                    block.add(key, texts[i].as_py() or "")
                    if block.size >= pieces or len(block.pieces) >= DISTINCT:
                        yield block.row(cut)
                        block = _Block()
            if block.keys:
                yield block.row(cut)

    return run


def _encoded(ranks):
    """word to (word, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(ranks.value).encode_ordinary
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(w) for w in batch.column(0).to_pylist()], pa.list_(pa.int32()))], ["word", "ids"])

    return run


def encode_words(words: DataFrame, ranks) -> DataFrame:
    """Distinct words with their ids."""
    return words.distinct().mapInArrow(X.lean(_encoded(ranks)), "word string, ids array<int>")


def decode_words(spark: SparkSession, encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(word, bytes) of words with ids: a join with the table of token bytes, which is as large as the vocabulary and goes to every task."""
    tokens = spark.createDataFrame(pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "token": pa.array(list(ranks), pa.binary())}))
    found = encoded.select("word", F.posexplode("ids").alias("at", "id")).join(F.broadcast(tokens), "id")
    parts = found.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("parts"))
    return parts.select("word", F.aggregate("parts", F.lit(b""), lambda x, p: F.concat(x, p["token"])).alias("bytes"))


def _assembled(with_ids: bool):
    """Rows of a block in order, first (place -1) its texts, then what is made of its words, to a row for each text."""

    def rows(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        keys, sizes, places = unpacked(table["bytes"][0].as_py())
        names, tokens = (table[c].slice(1).to_pylist() for c in ("names", "bytes"))
        n = np.array([name.count(" ") + 1 for name in names], np.int64)
        ends = np.cumsum(sizes, dtype=np.int64)
        total = np.concatenate([[0], np.cumsum(n[places])]) if len(places) else np.zeros(1, np.int64)
        counts = total[ends] - total[ends - sizes]
        for i in range(0, len(keys), 1024):  # texts with their ids are given on in parts
            shas, decoded, ids, texts = [], [], [], []
            for a, b in zip((ends - sizes)[i : i + 1024].tolist(), ends[i : i + 1024].tolist(), strict=True):
                mine = places[a:b].tolist()
                decimal, back = " ".join([names[p] for p in mine]).encode(), b"".join([tokens[p] for p in mine])
                shas.append(hashlib.sha256(decimal).hexdigest())
                decoded.append(hashlib.sha256(back).hexdigest())
                if with_ids:
                    ids.append(np.array(decimal.split(), np.int32))
                    texts.append(back.decode("utf-8", "replace"))
            columns = [pa.array(keys[i : i + 1024], pa.int64()), pa.array(counts[i : i + 1024], pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())]
            named = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                named += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, named)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch.column(batch.schema.get_field_index("place")).to_numpy() < 0).tolist()
            for a, b in zip([0, *starts], [*starts, batch.num_rows], strict=True):
                if a in starts and parts and a < b:
                    yield from rows(parts)
                    parts = []
                if a < b:
                    parts.append(batch.slice(a, b - a))
        if parts:
            yield from rows(parts)

    return run


def encode_decode(
    spark: SparkSession, docs: DataFrame, ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN, pieces: int = PIECES, with_ids: bool = False, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, and with_ids the ids and the decoded text.

    ids are those of the rank file, each match of the pattern encoded by itself,
    without special tokens.  Null text counts as empty: no ids.  Rows that repeat
    a key, or have none, are encoded each by itself.  Other columns play no part;
    no rows give no rows.  The rank file is read on the driver.  A task holds one
    block, or one longer text, and what is made of its words.
    """
    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        data = file.read()
    ranks = spark.sparkContext.broadcast(data)
    stages = Stages(spark, "bpe")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    blocks = rows.mapInArrow(X.lean(_blocks(pattern, pieces)), "texts binary, words array<string>")
    blocks = stages.keep(blocks.withColumn("block", F.monotonically_increasing_id()))
    encoded = stages.keep(encode_words(blocks.select(F.explode("words").alias("word")), ranks))
    names = encoded.select("word", F.array_join(F.col("ids").cast("array<string>"), " ").alias("names"))
    itself = F.col("word").cast("binary")
    # Bytes that are the word itself are not carried twice.
    made = stages.keep(names.join(decode_words(spark, encoded, _ranks(data)).hint("merge"), "word").withColumn("bytes", F.when(F.col("bytes") != itself, F.col("bytes"))))
    stages.drop(encoded)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    out = []
    for i in range(PARTS):
        mine = blocks.where(F.pmod(F.xxhash64("block"), F.lit(PARTS)) == i)
        uses = mine.select("block", F.posexplode("words").alias("place", "word")).join(made.hint("merge"), "word").select("block", "place", "names", F.coalesce("bytes", itself).alias("bytes"))
        both = mine.select("block", F.lit(-1).alias("place"), F.lit(None).cast("string").alias("names"), F.col("texts").alias("bytes")).unionByName(uses)
        out.append(stages.keep(both.repartition("block").sortWithinPartitions("block", "place").mapInArrow(X.lean(_assembled(with_ids)), schema)))
    stages.drop(blocks, made)
    return functools.reduce(DataFrame.unionByName, out)
