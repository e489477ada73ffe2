"""The browse tree: desired links from live entries, against the links and directories that exist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions import text as T


def live_entries(source_files: DataFrame, blobs: DataFrame) -> DataFrame:
    """Distinct (relative_path, blob_hash) of live blobs with their size; paths that are not valid are an error."""
    b = blobs.where("deleted_at_ms is null").select(F.col("hash").alias("blob_hash"), F.col("size_bytes").alias("blob_size_bytes"))
    live = source_files.select("relative_path", "blob_hash").join(b, "blob_hash")
    out = live.groupBy("relative_path", "blob_hash").agg(F.any_value("blob_size_bytes").alias("blob_size_bytes"))
    checked = F.when(T.valid_catalog_path(F.col("relative_path")), F.col("relative_path")).otherwise(F.raise_error(F.concat(F.lit("invalid path: "), F.col("relative_path"))))
    return out.withColumn("relative_path", checked)


def desired_links(entries: DataFrame, tree_root: str, store_root: str, digits: int = 6) -> DataFrame:
    """output_path, target_text and blob_hash of each link."""
    out = F.concat(F.lit(tree_root + "/"), T.output_path(F.col("relative_path"), F.col("blob_hash"), digits))
    target = F.concat(F.lit(store_root + "/"), T.shard_path(F.col("blob_hash")))
    placed = entries.select("relative_path", "blob_hash", "blob_size_bytes", out.alias("output_path"), target.alias("target_path"))
    parent = F.regexp_replace("output_path", "/[^/]*$", "")
    return placed.withColumn("target_text", T.relative_target(parent, F.col("target_path")))


def collisions(desired: DataFrame) -> DataFrame:
    """Output paths that several contents want."""
    return desired.groupBy("output_path").agg(F.count("*").alias("wanted"), F.min("blob_hash").alias("first_hash"), F.max("blob_hash").alias("other_hash")).where("wanted > 1")


def invalid_targets(desired: DataFrame, store: DataFrame) -> DataFrame:
    """Links whose blob is not in the store as a file of its size."""
    s = store.select(F.col("hash").alias("blob_hash"), F.col("kind").alias("k"), F.col("size_bytes").alias("s"))
    reason = F.when(F.col("k").isNull(), "missing").when(F.col("k") != "file", "non-regular").when(F.col("s") != F.col("blob_size_bytes"), "size-mismatch")
    return desired.join(s, "blob_hash", "left").withColumn("reason", reason).where("reason is not null").select("output_path", "blob_hash", "reason")


def owned(existing: DataFrame, store_root: str) -> DataFrame:
    """Links whose target, lexically, is in the store's blob folder.  existing: path, kind, target_text."""
    parent = F.regexp_replace("path", "/[^/]*$", "")
    target = F.when(F.startswith("target_text", F.lit("/")), F.col("target_text")).otherwise(F.concat(parent, F.lit("/"), F.col("target_text")))
    here = (F.col("kind") == "symlink") & T.inside(T.lexical_normalize(target), F.lit(f"{store_root}/blobs"))
    return existing.withColumn("owned", F.coalesce(here, F.lit(False)))


def link_diff(desired: DataFrame, existing: DataFrame) -> DataFrame:
    """created, unchanged, replaced, or what blocks the link; existing as from owned()."""
    e = existing.select(F.col("path").alias("output_path"), "kind", F.col("target_text").alias("old_target"), "owned")
    status = (
        F.when(F.col("kind").isNull(), "created")
        .when(F.col("kind") != "symlink", "blocked-by-entry")
        .when(~F.col("owned"), "blocked-by-user-link")
        .when(F.col("old_target") == F.col("target_text"), "unchanged")
        .otherwise("replaced")
    )
    return desired.join(e, "output_path", "left").select("output_path", "target_text", "blob_hash", status.alias("status"))


def stale_links(desired: DataFrame, existing: DataFrame) -> DataFrame:
    return existing.where("owned").join(desired.select(F.col("output_path").alias("path")), "path", "left_anti").select("path")


def _above(df: DataFrame, path: str, root: str) -> DataFrame:
    """The directories between the root and each path."""
    below = F.substring(F.col(path), len(root) + 2, 1 << 20)
    return df.select(F.explode(T.ancestors(below)).alias("directory")).select(F.concat(F.lit(root + "/"), "directory").alias("directory")).distinct()


def directories_to_create(desired: DataFrame, existing: DataFrame, root: str) -> DataFrame:
    """Missing directories, parents first (by path components)."""
    there = existing.where("kind = 'directory'").select(F.col("path").alias("directory"))
    return _above(desired, "output_path", root).join(there, "directory", "left_anti").orderBy(F.split("directory", "/"))


def directories_to_prune(desired: DataFrame, existing: DataFrame, root: str) -> DataFrame:
    """Directories that removing stale links empties, children first.

    A directory above a stale link goes if no other entry stands below it but stale links and such directories: what
    stays, exploded to the directories above it, rules those out at once.
    """
    stale = stale_links(desired, existing)
    candidates = _above(stale, "path", root)
    stays = existing.join(stale, "path", "left_anti").join(candidates.withColumnRenamed("directory", "path"), "path", "left_anti")
    return candidates.join(_above(stays, "path", root), "directory", "left_anti").orderBy(F.split("directory", "/").desc())


def report(diff: DataFrame, stale: DataFrame, created: DataFrame, pruned: DataFrame) -> DataFrame:
    links = diff.agg(F.count("*").alias("desired_links"), *[F.count_if(F.col("status") == s).alias(f"links_{s}") for s in ("created", "unchanged", "replaced")])
    others = [df.agg(F.count("*").alias(n)) for df, n in ((stale, "stale_links_removed"), (created, "directories_created"), (pruned, "directories_pruned"))]
    for one in others:
        links = links.crossJoin(one)  # one row each
    return links
