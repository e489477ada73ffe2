"""MinHash near-dedup with an LSH forest.

Every distinct shingle set has one row with its MinHash signature.  Each tree of
the forest sorts the sets by its own part of the signature.  In that order,
neighbours with the longest common prefixes are candidates: a set is paired with
those that stand up to `window` places before it and share at least `least_depth`
values.  Where few sets share a prefix that means all of them; where many do,
the neighbours share longer prefixes, so that the depth adapts to the region.

Candidates are confirmed on full shingle sets, best estimates first, and
confirmed links are joined into components; other candidates are confirmed where
they would still join two.  In a region with more sets than the window reaches,
sets outside the region's largest component are compared with all sets of the
region in blocks: no partner is out of reach for being one of many.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from holdfast.llm import _text as X
from holdfast.llm._stage import Stages, components

#: Trees, values in each tree's part of the signature, least common values, places before.
TREES, DEPTH, LEAST_DEPTH, WINDOW = 16, 8, 3, 4
#: Confirm candidates whose estimate is at most this far below the threshold: five standard errors of 128 values.
SLACK = 0.18
#: Candidates of each set to confirm before components are looked at for the first time.
FIRST = 2
#: Sets in a block of the comparison in large regions.
BLOCK = 256


def _signatures(k: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers, masks = X.hash_family(TREES * DEPTH, seed)
        for batch in batches:
            raw, offsets = X.utf8(batch.column(1))
            for i, j in X.slices(offsets):
                sets, at = X.shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                least = (X.mix64(X.minhash(sets, at, multipliers, masks)) & X.U64(0xFFFF)).astype(">u2")
                keys = [hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).digest() for a, b in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(at)), pa.array(keys, pa.binary()), pa.array([r.tobytes() for r in least], pa.binary())],
                    ["doc_id", "n", "class", "sig"],
                )

    return run


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each tree and set: the tree, its part of the signature, the set, its size."""
    for batch in batches:
        rows = batch.num_rows
        sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(rows, TREES, DEPTH * 2)
        parts = np.ascontiguousarray(sig.transpose(1, 0, 2)).reshape(-1)
        path = pa.FixedSizeBinaryArray.from_buffers(pa.binary(DEPTH * 2), TREES * rows, [None, pa.py_buffer(parts)]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(TREES, dtype=np.int32), rows)), path, pa.array(np.tile(batch.column(0).to_numpy(), TREES)), pa.array(np.tile(batch.column(1).to_numpy(), TREES))],
            ["tree", "path", "id", "n"],
        )


def _pairs_in_order(percent: int):
    """Candidates among rows in sorted order.

    kind 0: the pair (a, b).  kind 1: a is in a region of more sets than the
    window reaches; `region` is its prefix.  kind 2: the rows at a partition's
    two ends, which meet the next partition's in `region` = the border's number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        here = TaskContext.get().partitionId()
        back: dict[str, np.ndarray] | None = None
        head: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            width = DEPTH * 2
            now = {
                "tree": batch.column(0).to_numpy(),
                "path": np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, width),
                "id": batch.column(2).to_numpy(),
                "n": batch.column(3).to_numpy(),
            }
            fresh = 0
            if back is not None:
                fresh = len(back["id"])
                now = {k: np.concatenate([back[k], v]) for k, v in now.items()}
            yield _candidates(now, fresh, percent)
            if head is None or len(head["id"]) < 2 * WINDOW:
                head = {k: v[: 2 * WINDOW] for k, v in now.items()} if head is None else {k: np.concatenate([v, now[k][fresh:]])[: 2 * WINDOW] for k, v in head.items()}
            back = {k: v[-2 * WINDOW :] for k, v in now.items()}
        if back is not None:
            for edge, border in ((head, here - 1), (back, here)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(edge["id"]), 2, np.int32)), pa.array(edge["id"]), pa.array(edge["n"]), pa.array([b"%d" % border] * len(edge["id"]), pa.binary()), pa.array(edge["tree"].astype(np.int32)), pa.array([p.tobytes() for p in edge["path"]], pa.binary())],
                    ["kind", "a", "b", "region", "tree", "path"],
                )

    return run


def _candidates(rows: dict[str, np.ndarray], fresh: int, percent: int) -> pa.RecordBatch:
    same = 2 * LEAST_DEPTH
    a, b = [], []
    size, count = rows["n"], len(rows["id"])
    for step in range(1, WINDOW + 1):
        if count <= step:
            break
        near = (rows["tree"][step:] == rows["tree"][:-step]) & (rows["path"][step:, :same] == rows["path"][:-step, :same]).all(axis=1)
        near &= np.arange(step, count) >= fresh
        near &= 100 * np.minimum(size[step:], size[:-step]) >= percent * np.maximum(size[step:], size[:-step])
        a.append(rows["id"][:-step][near])
        b.append(rows["id"][step:][near])
    dense, span = np.zeros(count, bool), WINDOW + 1
    if count > span:  # rows with more than WINDOW rows of their prefix on one side
        far = (rows["tree"][span:] == rows["tree"][:-span]) & (rows["path"][span:, :same] == rows["path"][:-span, :same]).all(axis=1)
        dense[span:] |= far
        dense[:-span] |= far
        for step in range(1, span):
            dense[step : count - span + step] |= far
    at = np.flatnonzero(dense)
    left, right = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    regions = [b"%d:" % t + p.tobytes() for t, p in zip(rows["tree"][at], rows["path"][at, :same], strict=True)]
    none = len(left)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([np.zeros(none, np.int32), np.ones(len(at), np.int32)])),
            pa.array(np.concatenate([np.minimum(left, right), rows["id"][at]])),
            pa.array(np.concatenate([np.maximum(left, right), np.zeros(len(at), np.int64)])),
            pa.array([None] * none + regions, pa.binary()),
            pa.array(np.zeros(none + len(at), np.int32)),
            pa.array([None] * (none + len(at)), pa.binary()),
        ],
        ["kind", "a", "b", "region", "tree", "path"],
    )


def _at_border(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tree", "path", "a"]).drop_duplicates(["tree", "a"])
        path = np.frombuffer(b"".join(rows["path"]), np.uint8).reshape(len(rows), -1)
        found = _candidates({"tree": rows["tree"].to_numpy(), "path": path, "id": rows["a"].to_numpy(), "n": rows["b"].to_numpy()}, 0, percent)
        return found.to_pandas()[["kind", "a", "b", "region"]]

    return run


def _estimate(a: pd.Series, b: pd.Series) -> pd.Series:
    x = np.frombuffer(b"".join(a), np.uint16).reshape(len(a), -1)
    y = np.frombuffer(b"".join(b), np.uint16).reshape(len(b), -1)
    return pd.Series((x == y).mean(axis=1))


def _confirm(k: int, percent: int):
    """Keeps pairs (a, b, text, other) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (raw1, at1), (raw2, at2) = X.utf8(batch.column(2)), X.utf8(batch.column(3))
            keep = np.zeros(batch.num_rows, bool)
            for i, j in X.slices(at1 + at2):
                s1, o1 = X.shingle_sets(raw1[at1[i] : at1[j]], at1[i : j + 1] - at1[i], k)
                s2, o2 = X.shingle_sets(raw2[at2[i] : at2[j]], at2[i : j + 1] - at2[i], k)
                for r in range(j - i):
                    keep[i + r] = similar(s1[o1[r] : o1[r + 1]], s2[o2[r] : o2[r + 1]], percent)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _blocks(k: int, percent: int):
    """For a block of queries and a block of members: the confirmed links between their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for row in range(batch.num_rows):  # two blocks in hand at a time
                queries, members, sides = batch.column(0)[row].as_py(), batch.column(1)[row].as_py(), []
                for side in (queries, members):
                    raw, at = X.utf8(pa.array([r["text"] for r in side], pa.string()))
                    sets, o = X.shingle_sets(raw, at, k)
                    sides.append(([r["id"] for r in side], [r["root"] for r in side], np.frombuffer(b"".join(r["sig"] for r in side), np.uint16).reshape(len(side), -1), [sets[a:b] for a, b in zip(o, o[1:], strict=False)]))
                (ids, roots, sigs, sets), (ids2, roots2, sigs2, sets2) = sides
                joined = {}
                for q in range(len(ids)):
                    likely = (sigs2 == sigs[q]).mean(axis=1)
                    for m in np.argsort(-likely):
                        if likely[m] < percent / 100 - SLACK:
                            break
                        pair = (min(roots[q], roots2[m]), max(roots[q], roots2[m]))
                        if pair[0] != pair[1] and pair not in joined and similar(sets[q], sets2[m], percent):
                            joined[pair] = True
                            left.append(pair[0])
                            right.append(pair[1])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def minhash_dedup(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id", seed: int = 1) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    A document's set holds its distinct k-word shingles, or, with fewer words,
    its whole word sequence.  Sets are linked when 100 * intersection >=
    percent * union; component_id is the least key reachable.  Null and empty
    texts have no shingles and are linked with nothing.  Rows that share a key
    are one node.  A row with a null key is linked with nothing: component_id is
    null and it is kept.  Other columns play no part; no rows give no rows.
    """
    stages = Stages(spark, "near-dedup")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = stages.keep(rows.mapInArrow(X.lean(_signatures(k, seed)), "doc_id long, n long, class binary, sig binary"))
    able = signed.where("n > 0 and doc_id is not null")
    # One set of each class goes on; its key is the least.
    first = stages.keep(able.groupBy("class").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.min("n").alias("n"), F.first("sig").alias("sig")))
    found = first.select("id", "n", "sig").mapInArrow(_forest, "tree int, path binary, id long, n long")
    # Ranges of some thousand rows at least, so that no prefix's rows within the window span three of them.
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), first.count() * TREES // 2000))
    ordered = found.repartitionByRange(parts, "tree", "path", "id").sortWithinPartitions("tree", "path", "id")
    marked = stages.keep(ordered.mapInArrow(_pairs_in_order(percent), "kind int, a long, b long, region binary, tree int, path binary"))
    border = marked.where("kind = 2").groupBy("region").applyInPandas(_at_border(percent), "kind int, a long, b long, region binary")
    marks = marked.where("kind < 2").select("kind", "a", "b", "region").unionByName(border)
    pairs = marks.where("kind = 0 and a <> b").select("a", "b").distinct()
    sig = first.select(F.col("id"), "sig")
    estimate = F.pandas_udf(_estimate, "double")
    likely = stages.keep(
        pairs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("x")), "a")
        .join(sig.select(F.col("id").alias("b"), F.col("sig").alias("y")), "b")
        .select("a", "b", estimate("x", "y").alias("likely"))
        .where(F.col("likely") >= percent / 100 - SLACK)
    )
    # The texts of one row of each class that is in question.
    asked = likely.select(F.col("a").alias("id")).union(likely.select("b")).union(marks.where("kind = 1").select("a")).distinct()
    # The same join at every size: what is asked grows with the input.
    texts = stages.keep(rows.join(asked.hint("merge"), rows.doc_id == asked.id, "left_semi").dropDuplicates(["doc_id", "text"]).select(F.col("doc_id").alias("id"), "text"))

    def confirmed(some: DataFrame) -> DataFrame:
        wide = some.join(texts.select(F.col("id").alias("a"), "text").hint("merge"), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("other")).hint("merge"), "b")
        return wide.select("a", "b", "text", "other").mapInArrow(X.lean(_confirm(k, percent)), "a long, b long")

    # The best candidates of each set first; of the others only those that still join two components.
    best = Window.partitionBy("b").orderBy(F.desc("likely"), "a")
    first_links = stages.keep(confirmed(likely.withColumn("place", F.row_number().over(best)).where(F.col("place") <= FIRST)))
    roots = components(stages, first_links)

    def rooted(edges: DataFrame) -> DataFrame:
        r = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        return edges.join(r[0], "a", "left").join(r[1], "b", "left").withColumns({"ra": F.coalesce("ra", "a"), "rb": F.coalesce("rb", "b")})

    links = stages.keep(confirmed(rooted(likely).where("ra <> rb").select("a", "b")))
    # Large regions: whatever is outside the largest component meets all of the region.
    members = marks.where("kind = 1").select("region", F.col("a").alias("node")).distinct().join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = members.groupBy("region", "root").count()
    main = sizes.groupBy("region").agg(F.max(F.struct("count", F.col("root").alias("r"))).alias("m"), F.count("*").alias("roots")).where("roots > 1").select("region", F.col("m.r").alias("main"))
    open_members = stages.keep(members.join(main, "region"))
    if not open_members.isEmpty():
        full = open_members.join(texts.withColumnRenamed("id", "node"), "node").join(sig.withColumnRenamed("id", "node"), "node")
        block = F.struct(F.col("node").alias("id"), "root", "sig", "text")
        slot = F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.ceil(F.col("all") / BLOCK)))
        counts = open_members.groupBy("region").agg(F.count("*").alias("all"))
        placed = full.join(counts, "region").withColumn("slot", slot)
        held = stages.keep(placed.groupBy("region", "slot").agg(F.collect_list(block).alias("members")))
        asking = placed.where("root <> main").groupBy("region", F.col("slot").alias("from")).agg(F.collect_list(block).alias("queries"))
        more = held.join(asking, "region").select("queries", "members").mapInArrow(X.lean(_blocks(k, percent)), "a long, b long")
        links = links.unionByName(stages.keep(more))
    if not links.isEmpty():
        roots = components(stages, first_links.unionByName(links))
    root_of = first.where("copies > 1").select("class", F.col("id").alias("rep"))
    named = signed.join(root_of, "class", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    out = named.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    component = F.coalesce("root", "rep")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
