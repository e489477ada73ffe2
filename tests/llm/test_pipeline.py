"""The pipeline against its stages done plainly, in order."""

import base64
import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from holdfast.llm.quality import quality_classifier
from tests.conftest import SF
from tests.llm import brute


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    score = dict(quality_classifier(spark, docs, spark.read.parquet(f"{SF}/labels.parquet")).select("doc_id", "score").toPandas().itertuples(index=False))
    left = {d: t for d, t in docs.select("doc_id", "text").toPandas().itertuples(index=False) if score[d] >= 0.3}
    groups = {}
    for d, t in left.items():
        groups.setdefault((t or "").encode().translate(brute.LOWER), []).append(d)
    left = {max(g): left[max(g)] for g in groups.values()}
    left = {d: left[d] for d, root in brute.components(left, 5).items() if d == root}
    bench = dict(spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").toPandas().itertuples(index=False))
    dirty = {d for d, _ in brute.contained(left, bench)}
    left = {d: t for d, t in left.items() if d not in dirty}
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {d: hashlib.sha256(" ".join(map(str, encoding.encode_ordinary(t or ""))).encode()).hexdigest() for d, t in left.items()}
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert dict(zip(got.doc_id, got.ids_sha256, strict=True)) == want


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "encode"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_the_last_stage_gives_ids(spark):
    docs = spark.createDataFrame([(1, "Token ids, please."), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in corpus_pipeline.encode(spark, docs, SF).collect()}
    assert got[1].decoded == "Token ids, please." and len(got[1].ids) == got[1].n_tokens > 0
    assert hashlib.sha256(" ".join(map(str, got[1].ids)).encode()).hexdigest() == got[1].ids_sha256
    assert not got[2].ids


ODD = "doc_id long, text string, lang string, source string, n_chars long, row long, stays boolean"
SAME, OWN = "one two three four five six seven", "quite another text of its own, with words that are nowhere else"


def test_rows_are_told_apart(spark):
    rows = [(5, SAME), (9, SAME), (5, OWN), (9, SAME), (None, SAME), (None, None), (3, ""), (3, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1, 77, False) for d, t in rows], ODD)
    for stage in (corpus_pipeline.drop_exact_copies, corpus_pipeline.drop_near_copies):
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns
        left = sorted(((r.doc_id, r.text, r.row) for r in got.collect()), key=str)
        if stage is corpus_pipeline.drop_exact_copies:
            assert left == sorted([(9, SAME, 77), (5, OWN, 77), (3, "", 77)], key=str)
        else:
            assert left == sorted([(5, SAME, 77), (5, OWN, 77), (None, None, 77), (3, "", 77), (3, "", 77)], key=str)


def test_stages_without_rows(spark):
    docs = spark.createDataFrame([], ODD)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []
