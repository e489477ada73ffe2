"""Queries against their SQL, functions against plain Python, and the commands over real directories."""

import os
import posixpath
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from holdfast import cli
from holdfast.functions import text as T
from holdfast.functions.blake3 import blake3_hex
from holdfast.operators import imports, tree
from holdfast.plans import catalog
from holdfast.sources.snapshots import Catalog
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(row):
    return tuple(int(x) if isinstance(x, bool) or (isinstance(x, float) and x == int(x)) else x for x in row)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.SQL[name])
    names = sorted(d[0] for d in want.description)
    assert names == sorted(got.columns)
    order = [[d[0] for d in want.description].index(n) for n in names]
    expected = sorted(repr(plain([r[i] for i in order])) for r in want.fetchall())
    assert sorted(repr(plain(r)) for r in got.select(*names).collect()) == expected


def test_digest():
    vectors = {0: "af1349b9f5f9a1a6a0404dea36dcc949", 1: "2d3adedff11b61f14c886e35afa03673", 1024: "42214739f095a406f3fc83deb889744a", 1025: "d00278ae47eb27b34faecf67b4fe263f", 31744: "62b6960e1a44bcc1eb1a611a8d6235b6"}
    for n, start in vectors.items():
        assert blake3_hex(bytes(i % 251 for i in range(n))).startswith(start)


def test_paths(spark):
    rng = random.Random(2)
    paths = ["/" + "/".join(rng.choices(["a", "b", "..", ".", "c"], k=rng.randint(1, 6))) for _ in range(60)]
    rows = spark.createDataFrame([(p, "/" + "/".join(rng.choices("abc", k=rng.randint(1, 4)))) for p in paths], "p string, q string")
    for r in rows.select("p", "q", T.lexical_normalize(F.col("p")).alias("n")).select("*", T.relative_target(F.col("n"), F.col("q")).alias("t")).collect():
        assert r.n == posixpath.normpath(r.p).replace("//", "/")
        assert r.t == posixpath.relpath(r.q, r.n)
    values = [("photo.jpg", "photo_ab.jpg"), ("archive.tar.gz", "archive.tar_ab.gz"), ("README", "README_ab"), (".env", ".env_ab"), ("file.", "file_ab."), ("東京.mov", "東京_ab.mov"), ("a\nb.c", "a\nb_ab.c")]
    for r in spark.createDataFrame(values, "n string, w string").select("w", T.suffixed_name(F.col("n"), F.lit("ab")).alias("g")).collect():
        assert r.g == r.w


def test_prune_equals_the_iterative_rule(spark):
    rng = random.Random(4)
    for _ in range(3):
        folders = ["/t/" + "/".join(rng.choices("ab", k=rng.randint(1, 4))) for _ in range(8)]
        folders = {"/".join(f.split("/")[:i]) for f in folders for i in range(3, len(f.split("/")) + 1)}
        entries = [(f"{f}/{n}", "symlink" if stale else "file", "/s/blobs/x" if stale else None, stale) for f in folders for n in "xy" if rng.random() < 0.5 for stale in [rng.random() < 0.7]]
        existing = spark.createDataFrame(entries + [(f, "directory", None, False) for f in folders], "path string, kind string, target_text string, owned boolean")
        desired = spark.createDataFrame([], "output_path string, target_text string, blob_hash string")
        got = [r[0] for r in tree.directories_to_prune(desired, existing, "/t").collect()]
        above = {"/".join(p.split("/")[:i]) for p, _, _, s in entries if s for i in range(3, len(p.split("/")))}
        alive = {p for p, _, _, s in entries if not s} | folders
        for f in sorted(above, key=lambda f: f.split("/"), reverse=True):
            if not any(posixpath.dirname(p) == f for p in alive):
                alive.discard(f)
        assert got == sorted(above - alive, key=lambda f: f.split("/"), reverse=True)


def test_last_written_time_wins(spark):
    start = spark.createDataFrame([], imports_schema())
    rows = [("/r", "a", "imported", "h", 1, None, 30, 1), ("/r", "a", "known", "h", 1, None, 10, 2)]
    out = imports.upsert_sources(start, spark.createDataFrame(rows, "source_root string, relative_path string, kind string, blob_hash string, size_bytes long, modified_at_ms long, observed_at_ms long, sequence long")).first()
    assert (out.id, out.first_seen_at_ms, out.last_seen_at_ms, out.seen_count) == (1, 30, 10, 2)


def imports_schema():
    from holdfast.schemas import SOURCE_FILES

    return SOURCE_FILES


def test_size_clash_is_an_error(spark):
    blobs = spark.createDataFrame([("h", 1, 1, None)], "hash string, size_bytes long, created_at_ms long, deleted_at_ms long")
    with pytest.raises(Exception, match="size disagreement"):
        imports.insert_blobs(blobs, spark.createDataFrame([("h", 2, 5)], "hash string, size_bytes long, created_at_ms long")).collect()


def test_lifecycle(spark, tmp_path):
    source, store, browse = tmp_path / "src", tmp_path / "store", tmp_path / "tree"
    (source / "Movies").mkdir(parents=True)
    for name, data in {"Movies/clip.mov": b"one", ".env": b"two", "README": b"one"}.items():
        (source / name).write_bytes(data)
    dry = cli.run_import(spark, str(store), str(source), dry_run=True)
    assert dry["blobs_created"] == 2 and not store.exists()
    first = cli.run_import(spark, str(store), str(source), at_ms=10)
    assert (first["files_hashed"], first["blobs_created"], first["blobs_reused"], first["source_records_inserted"]) == (3, 2, 1, 3)
    again = cli.run_import(spark, str(store), str(source), at_ms=20)
    assert (again["files_skipped"], again["files_hashed"], again["bytes_hashed"]) == (3, 0, 0)
    forced = cli.run_import(spark, str(store), str(source), metadata_skip=False, at_ms=30)
    assert (forced["files_hashed"], forced["blobs_created"]) == (3, 0)
    assert {r.seen_count for r in Catalog(spark, str(store)).read()[1].collect()} == {3}
    assert cli.main(["audit", "--store", str(store)], spark) == 0
    report = cli.run_build_tree(spark, str(store), str(browse))
    assert (report["links_created"], report["directories_created"]) == (3, 1)
    assert cli.run_build_tree(spark, str(store), str(browse))["links_unchanged"] == 3
    link = next((browse / "Movies").iterdir())
    assert link.is_symlink() and link.read_bytes() == b"one"
    # One content goes out of use: marked, then swept; its link goes and leaves no folder.
    (source / "Movies/clip.mov").write_bytes(b"other!")
    (source / "README").write_bytes(b"other!")
    cli.run_import(spark, str(store), str(source), at_ms=40)
    marked, _ = cli.run_gc(spark, str(store), at_ms=50)
    assert marked["planned_marks"] == 1
    swept, _ = cli.run_gc(spark, str(store), at_ms=60)
    assert (swept["completed_sweeps"], swept["files_removed"], swept["bytes_reclaimed"]) == (1, 1, 3)
    assert not os.path.exists(cli.files.blob_path(str(store), blake3_hex(b"one")))
    tree_again = cli.run_build_tree(spark, str(store), str(browse))
    assert (tree_again["links_created"], tree_again["stale_links_removed"]) == (2, 2)
    # Corruption is found, and blocks collection.
    victim = cli.files.blob_path(str(store), blake3_hex(b"two"))
    os.chmod(victim, 0o644)
    with open(victim, "wb") as f:
        f.write(b"2222")
    assert cli.main(["audit", "--store", str(store)], spark) == 2
    _, findings = cli.run_audit(spark, str(store))
    assert {c for c, _, _ in findings} == {"HASH_MISMATCH", "SIZE_MISMATCH"}
    assert cli.main(["gc", "--store", str(store)], spark) == 2
    os.unlink(victim)
    assert {c for c, _, _ in cli.run_audit(spark, str(store))[1]} == {"MISSING_BLOB"}
    assert cli.main(["audit", "--store", str(tmp_path / "none")], spark) == 1
    assert cli.main(["import", "--store", str(store), "--source", str(store)], spark) == 1


def test_entry_has_its_names():
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_a_change_of_equal_size_is_an_error(tmp_path):
    from holdfast import store
    from holdfast.sources.listing import digest_of

    source, held = tmp_path / "a.txt", tmp_path / "store"
    held.mkdir()
    source.write_bytes(b"before")
    for kind in ("blake3", "sha256"):
        planned, size = digest_of(str(source), kind)
        source.write_bytes(b"after!")
        with pytest.raises(OSError, match="changed"):
            store.install(str(held), str(source), planned, size, lambda path, kind=kind: digest_of(path, kind)[0])
        source.write_bytes(b"before")
        assert store.install(str(held), str(source), planned, size, lambda path, kind=kind: digest_of(path, kind)[0])
        assert not os.listdir(held / "staging")


def test_new_ids_follow_the_order_of_writing(spark):
    from holdfast.operators.imports import upsert_sources
    from holdfast.schemas import SOURCE_FILES

    keys = ["f", "b", "e", "a", "d", "c"]
    seen = spark.createDataFrame([("/r", k, "imported", "0" * 64, 1, None, 7, n * 10) for n, k in enumerate(keys)], "source_root string, relative_path string, kind string, blob_hash string, size_bytes long, modified_at_ms long, observed_at_ms long, sequence long")
    got = upsert_sources(spark.createDataFrame([], SOURCE_FILES), seen).orderBy("id").collect()
    assert [r.relative_path for r in got] == keys and [r.id for r in got] == [1, 2, 3, 4, 5, 6]


def test_names_in_bytes_are_findings_of_their_own(spark, tmp_path):
    from holdfast.operators import audit
    from holdfast.sources.listing import store_listing

    folder = os.fsencode(str(tmp_path / "blobs" / "ab"))
    os.makedirs(folder)
    for name in (b"\xffa", b"x y", rb"x\x20y", "é \t".encode()):
        with open(os.path.join(folder, name), "wb") as file:
            file.write(b"1")
    entries = audit.classified_entries(store_listing(spark, str(tmp_path)))
    got = {bytes(r.sort_identity): (r.identity, r.details) for r in audit.deduplicated(audit.entry_findings(entries)).collect()}
    reason = "reason=file-at-invalid-depth"
    assert got == {
        b"blobs/ab/\xffa": (r"blobs/ab/\xffa", reason),
        b"blobs/ab/x y": (r"blobs/ab/x\x20y", reason),
        rb"blobs/ab/x\x20y": (r"blobs/ab/x\x20y", reason),
        "blobs/ab/é \t".encode(): (r"blobs/ab/é\xc2\xa0\x09", reason),
    }
