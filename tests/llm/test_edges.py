"""Nulls, empty and long texts, repeats, empty tables, and columns whose names clash with those inside."""

import pytest
from pyspark.sql import functions as F

from holdfast.llm.bpe import encode_decode
from holdfast.llm.decontaminate import decontaminate, find_contained
from holdfast.llm.exact_dedup import exact_dedup
from holdfast.llm.line_dedup import dedup_lines, removed_lines
from holdfast.llm.minhash_dedup import minhash_dedup
from holdfast.llm.pitman_yor import score_texts
from holdfast.llm.quality import keep_quality, quality_classifier
from holdfast.llm.secrets import secret_scan
from holdfast.llm.sharding import assign_shards
from holdfast.llm.suffix_dedup import remove_repeats

CLASHING = ["id", "row", "key", "n", "kind", "word", "class", "anchor", "line", "line_no", "sig", "rep", "root", "data", "h1", "first", "leaf", "owner", "repository", "slot", "k", "y", "held_out", "score"]
LONG = "lorem ipsum dolor sit amet " * 20_000
ROWS = [(1, "one two three four five six", "en", "s"), (1, "one two three four five six", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (None, "a null key", "en", "s"), (None, None, None, None), (4, LONG, "en", "s"), (5, LONG, "de", "t"), (6, " \n ", "en", "s")]


def labelled(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, None), (3, None, 0), (None, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")


def items(spark):
    return spark.createDataFrame([(1, "two three four five six"), (2, None), (None, "x"), (3, ""), (4, "a")], "item_id long, text string")


OPERATORS = {
    "exact": (lambda s, d: exact_dedup(s, d), True),
    "near": (lambda s, d: minhash_dedup(s, d), True),
    "quality": (lambda s, d: quality_classifier(s, d, labelled(s)), True),
    "keep": (lambda s, d: keep_quality(s, d, labelled(s)), False),
    "contained": (lambda s, d: find_contained(s, d, items(s)), False),
    "decontaminate": (lambda s, d: decontaminate(s, d, items(s)), False),
    "shards": (lambda s, d: assign_shards(d, ["a", "b", "c"], size=101), True),
    "secrets": (lambda s, d: secret_scan(s, d), True),
    "bpe": (lambda s, d: encode_decode(s, d), True),
    "model": (lambda s, d: score_texts(s, d), True),
    "lines": (lambda s, d: removed_lines(s, d), True),
    "line-texts": (lambda s, d: dedup_lines(s, d), True),
    "repeats": (lambda s, d: remove_repeats(s, d), True),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    run, whole = OPERATORS[name]
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(None).cast("string") for c in CLASHING})
    got = run(spark, docs).collect()
    if whole:
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, name):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert OPERATORS[name][0](spark, docs).collect() == []


def test_stated_results(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    near = {(r.doc_id, r.n_shingles): r for r in minhash_dedup(spark, docs).collect()}
    assert near[2, 0].component_id == 2 and near[3, 0].kept and near[None, 0].component_id is None and near[None, 0].kept
    assert near[5, near[4, 5].n_shingles].component_id == 4
    exact = [r for r in exact_dedup(spark, docs).collect()]
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact} >= {(1, 1, 2, True), (2, 3, 3, False), (3, 3, 3, True), (None, 3, 3, False), (None, None, 1, False), (4, 5, 2, False), (5, 5, 2, True)}
    assert {(r.doc_id, r.item_id) for r in find_contained(spark, docs, items(spark)).collect()} == {(1, 1)}
    lines = {r.doc_id: list(r.removed) for r in removed_lines(spark, docs.where("doc_id > 1")).collect()}
    assert lines == {2: [], 3: [], 4: [], 5: [0], 6: []}
