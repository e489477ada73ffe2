"""import, audit, gc and build-tree over real directories.

Exit codes: 0 done or clean; 2 findings (audit, gc); 1 an error.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast import store as files
from holdfast.operators import audit, collection, imports, tree
from holdfast.sources import listing
from holdfast.sources.snapshots import Catalog, written


def now_ms() -> int:
    return time.time_ns() // 1_000_000


def overlapping(*paths: str) -> bool:
    """Whether one of the paths is another or lies below it."""
    real = [os.path.realpath(p) for p in paths]
    return any(a != b and (x == y or x.startswith(y.rstrip("/") + "/")) for a, x in enumerate(real) for b, y in enumerate(real))


def existing_folder(path: str) -> str:
    if os.path.islink(path) or not os.path.isdir(path):
        raise ValueError(f"not a directory: {path}")
    return os.path.realpath(path)


def digested(paths: DataFrame, digest: str) -> DataFrame:
    """paths with actual_hash and actual_size of the files they name, read where the tasks run.

    Spark's own reader of whole files leaves out names that begin with a dot or an underscore.
    """

    def run(parts):
        for part in parts:
            found = [listing.digest_of(p, digest) for p in part["path"]]
            yield part.assign(actual_hash=[h for h, _ in found], actual_size=[n for _, n in found])

    return paths.select("path").mapInPandas(run, "path string, actual_hash string, actual_size long")


def store_files(spark: SparkSession, store: str, digest: str | None) -> tuple[DataFrame, DataFrame]:
    """Classified entries, and the blobs among them with their digest if one is named."""
    entries = written(audit.classified_entries(listing.store_listing(spark, store)), "entries")
    blobs = entries.where("class = 'valid-blob'").select("hash", "kind", "size_bytes", F.concat(F.lit(f"{store}/blobs/"), "rel_path").alias("path"))
    if digest and not blobs.isEmpty():
        blobs = blobs.join(digested(blobs.where("kind = 'file'"), digest), "path", "left")
    else:
        blobs = blobs.withColumns({"actual_hash": F.lit(None).cast("string"), "actual_size": F.lit(None).cast("long")})
    return entries, blobs


def run_import(spark: SparkSession, store: str, source: str, dry_run: bool = False, metadata_skip: bool = True, digest: str = "blake3", at_ms: int | None = None) -> dict:
    if overlapping(store, source):
        raise ValueError("source and store overlap")
    source = existing_folder(source)
    if not dry_run:
        os.makedirs(store, exist_ok=True)
    if not os.path.isdir(store):  # a dry run before the first import
        return _import(spark, store, source, True, metadata_skip, digest, at_ms)
    with files.locked(store, exclusive=not dry_run):
        if not dry_run:
            files.purge_staging(store)
        return _import(spark, os.path.realpath(store), source, dry_run, metadata_skip, digest, at_ms)


def _import(spark, store, source, dry_run, metadata_skip, digest, at_ms) -> dict:
    at_ms = now_ms() if at_ms is None else at_ms
    catalog = Catalog(spark, store)
    blobs, sources = catalog.read()
    _, held = store_files(spark, store, None)
    candidates = listing.source_listing(spark, source)
    classified = written(imports.classify_import(candidates, imports.known_files(sources, blobs), held.select("hash", "kind", "size_bytes"), metadata_skip), "classified")
    todo = classified.where("disposition <> 'skip'").withColumn("path", F.concat("source_root", F.lit("/"), "relative_path")).drop("blob_hash")
    hashed = written(todo.join(digested(todo, digest), "path").withColumn("hash", F.col("actual_hash")), "hashed")
    if hashed.where("actual_size <> size_bytes").count() or hashed.count() != todo.count():
        raise OSError("a source file changed while it was read")
    outcomes = imports.source_outcome(imports.first_occurrences(hashed.select("source_root", "relative_path", "hash", "size_bytes", "sequence", "path"), held), sources)
    report = imports.import_report(classified, outcomes).first().asDict()
    if dry_run:
        return report
    for row in outcomes.where("outcome = 'created'").select("path", "hash", "size_bytes").toLocalIterator():
        files.install(store, row["path"], row["hash"], row["size_bytes"], lambda path: listing.digest_of(path, digest)[0])
    time_ = F.lit(at_ms).cast("long").alias("observed_at_ms")
    seen = hashed.select("source_root", "relative_path", F.lit("imported").alias("kind"), F.col("hash").alias("blob_hash"), "size_bytes", "modified_at_ms", time_, "sequence")
    skipped = classified.where("disposition = 'skip'").select("source_root", "relative_path", F.lit("known").alias("kind"), "blob_hash", "size_bytes", "modified_at_ms", time_, "sequence")
    next_blobs = imports.insert_blobs(blobs, hashed.select("hash", "size_bytes", F.lit(at_ms).cast("long").alias("created_at_ms")))
    next_blobs = imports.resurrect(next_blobs, skipped.select(F.col("blob_hash").alias("hash")))
    catalog.publish(next_blobs, imports.upsert_sources(imports.observe_known(sources, skipped), seen))
    return report


def _raw(blobs: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed snapshots in the untyped form that validation takes."""
    reach = collection.reachability(blobs, sources)
    kind = lambda c, t: F.when(F.col(c).isNull(), "null").otherwise(t)
    b = reach.select(F.col("hash").alias("rowid"), "hash", kind("hash", "text").alias("hash_class"), *[x for c in ("size_bytes", "created_at_ms", "deleted_at_ms") for x in (F.col(c).cast("string").alias(c), kind(c, "integer").alias(f"{c}_class"))], F.when(F.col("referenced"), "1").otherwise("0").alias("referenced"))
    texts, numbers = ("source_root", "relative_path", "blob_hash"), ("size_bytes", "modified_at_ms", "first_seen_at_ms", "last_seen_at_ms", "seen_count")
    s = sources.select(F.col("id").cast("string").alias("rowid"), *[x for c in texts for x in (F.col(c), kind(c, "text").alias(f"{c}_class"))], *[x for c in numbers for x in (F.col(c).cast("string").alias(c), kind(c, "integer").alias(f"{c}_class"))])
    return b, s


def catalog_findings(blobs: DataFrame, sources: DataFrame) -> DataFrame:
    raw_b, raw_s = _raw(blobs, sources)
    checked = audit.checked_blobs(raw_b)
    found = audit.blob_row_findings(checked).unionByName(audit.source_row_findings(raw_s, audit.valid_blobs(checked)))
    return found.unionByName(audit.fk_findings(sources, blobs, "blob_hash", "hash", "source_files", "blobs", F.col("id")))


def run_audit(spark: SparkSession, store: str, digest: str = "blake3") -> tuple[dict, list]:
    store = existing_folder(store)
    with files.locked(store, exclusive=False):
        catalog = Catalog(spark, store)
        if catalog.version() is None:
            raise ValueError("no catalog")
        blobs, sources = catalog.read()
        entries, held = store_files(spark, store, digest)
        raw_b, _ = _raw(blobs, sources)
        valid = audit.valid_blobs(audit.checked_blobs(raw_b))
        found = catalog_findings(blobs, sources).unionByName(audit.entry_findings(entries)).unionByName(audit.reconciliation_findings(audit.reconciled(valid, held)))
        findings = written(audit.deduplicated(found), "findings")
        report = audit.audit_report(raw_b, held, findings).first().asDict()
        return report, [tuple(r) for r in findings.select("category", "identity", "details").orderBy("category", "sort_identity").collect()]


def run_gc(spark: SparkSession, store: str, dry_run: bool = False, digest: str = "blake3", at_ms: int | None = None) -> tuple[dict, list]:
    store = existing_folder(store)
    with files.locked(store, exclusive=not dry_run):
        if not dry_run:
            files.purge_staging(store)
        catalog = Catalog(spark, store)
        if catalog.version() is None:
            raise ValueError("no catalog")
        blobs, sources = catalog.read()
        classes = written(collection.classified(collection.reachability(blobs, sources)), "classes")
        entries, held = store_files(spark, store, digest)
        complete = entries.where("io_error is not null").isEmpty()
        all_entries = entries.where("hash is not null").select("hash", "kind", "io_error")
        found = catalog_findings(blobs, sources).unionByName(audit.entry_findings(entries)).unionByName(collection.missing_findings(classes, all_entries, complete))
        found = found.unionByName(collection.orphan_findings(held, blobs, complete)).unionByName(collection.verify_findings(classes, held))
        findings = [tuple(r) for r in audit.deduplicated(found).select("category", "identity", "details").collect()]
        actions = written(collection.plan(classes, held), "plan")
        report = collection.report(classes, actions).first().asDict()
        if findings or dry_run:
            return report, findings
        swept = actions.where("kind = 'sweep'").orderBy("hash").select("hash", "size_bytes", "sweep_source_state")
        done, stopped = files.sweep(store, (tuple(r) for r in swept.toLocalIterator()))
        if stopped and not done:
            raise OSError(stopped)  # nothing was swept: nothing is kept
        gone = spark.createDataFrame([(h,) for h in done], "hash string")
        catalog.publish(collection.next_blobs(classes, now_ms() if at_ms is None else at_ms, gone), sources)
        if stopped:
            raise OSError(f"incomplete: {stopped}")
        return report | collection.progress(actions).first().asDict(), []


def run_build_tree(spark: SparkSession, store: str, browse_tree: str, dry_run: bool = False, digits: int = 6) -> dict:
    if not 1 <= digits <= 64:
        raise ValueError("hash digits must be from 1 to 64")
    store = existing_folder(store)
    if overlapping(store, browse_tree):
        raise ValueError("store and browse tree overlap")
    root = os.path.realpath(browse_tree)
    with files.locked(store, exclusive=not dry_run):
        catalog = Catalog(spark, store)
        if catalog.version() is None:
            raise ValueError("no catalog")
        blobs, sources = catalog.read()
        _, held = store_files(spark, store, None)
        desired = written(tree.desired_links(tree.live_entries(sources, blobs), root, store, digits), "links")
        for broken, what in ((tree.collisions(desired), "hash-suffix collision"), (tree.invalid_targets(desired, held), "invalid target")):
            if (row := broken.first()) is not None:
                raise ValueError(f"{what}: {row['output_path']}")
        existing = written(tree.owned(listing.tree_listing(spark, root), store), "existing")
        diff = written(tree.link_diff(desired, existing), "diff")
        if (row := diff.where("status like 'blocked%'").first()) is not None:
            raise ValueError(f"{row['status']}: {row['output_path']}")
        stale, made, pruned = tree.stale_links(desired, existing), tree.directories_to_create(desired, existing, root), tree.directories_to_prune(desired, existing, root)
        report = tree.report(diff, stale, made, pruned).first().asDict()
        if not dry_run:
            os.makedirs(root, exist_ok=True)
            folders = [r[0] for r in made.collect()], [r[0] for r in pruned.collect()]
            files.apply_tree(folders[0], (tuple(r) for r in diff.select("output_path", "target_text", "status").toLocalIterator()), [r[0] for r in stale.collect()], folders[1])
        return report


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="holdfast")
    p.add_argument("--output", choices=["human", "jsonl"], default="human")
    p.add_argument("--digest", choices=["blake3", "sha256"], default="blake3")
    commands = p.add_subparsers(dest="command", required=True)
    for name, dry in (("import", True), ("build-tree", True), ("audit", False), ("gc", True)):
        c = commands.add_parser(name)
        c.add_argument("--store", required=True)
        if dry:
            c.add_argument("--dry-run", action="store_true")
    commands.choices["import"].add_argument("--source", required=True)
    commands.choices["import"].add_argument("--no-metadata-skip", action="store_true")
    commands.choices["build-tree"].add_argument("--browse-tree", required=True)
    commands.choices["build-tree"].add_argument("--hash-digits", type=int, default=6)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("holdfast").getOrCreate()
    findings: list = []
    try:
        if args.command == "import":
            report = run_import(spark, args.store, args.source, args.dry_run, not args.no_metadata_skip, args.digest)
        elif args.command == "audit":
            report, findings = run_audit(spark, args.store, args.digest)
        elif args.command == "gc":
            report, findings = run_gc(spark, args.store, args.dry_run, args.digest)
        else:
            report = run_build_tree(spark, args.store, args.browse_tree, args.dry_run, args.hash_digits)
    except Exception as error:
        print(f"error: {str(error).splitlines()[0] if str(error) else type(error).__name__}", file=sys.stderr)
        return 1
    if args.output == "jsonl":
        for category, identity, details in findings:
            print(json.dumps({"schema_version": 1, "command": args.command, "event": "finding", "category": category, "identity": identity, "details": details}))
        print(json.dumps({"schema_version": 1, "command": args.command, "event": "command_summary"} | report))
    else:
        for finding in findings:
            print(*finding)
        for name, value in report.items():
            print(f"{name}: {value}")
    return 2 if findings else 0


if __name__ == "__main__":
    sys.exit(main())
