"""Validity, normalisation and escaping of hashes, paths and identities, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the data model.
HASH_PATTERN = r"\A[0-9a-f]{64}\z"
SHARD_PATTERN = r"\A[0-9a-f]{2}\z"


def valid_hash(c: Column) -> Column:
    return F.coalesce(c.rlike(HASH_PATTERN), F.lit(False))


def valid_catalog_path(p: Column) -> Column:
    """Relative, without backslash, and without empty, '.' or '..' segments."""
    odd = F.exists(F.split(p, "/"), lambda s: s.isin("", ".", ".."))
    return F.coalesce((p != "") & ~F.startswith(p, F.lit("/")) & ~F.contains(p, F.lit("\\")) & ~odd, F.lit(False))


def normalized_relative(p: Column) -> Column:
    """Segments without '.' and empty ones; null where the path is absolute, climbs, or has none."""
    parts = F.filter(F.split(p, "/"), lambda s: ~s.isin("", "."))
    bad = F.startswith(p, F.lit("/")) | F.exists(parts, lambda s: s == "..") | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(parts, "/"))


def shard_path(h: Column) -> Column:
    return F.concat_ws("/", F.lit("blobs"), F.substring(h, 1, 2), F.substring(h, 3, 2), h)


def suffixed_name(name: Column, suffix: Column) -> Column:
    """The suffix before the last extension, where a stem precedes it; else at the end."""
    stem, ext = F.regexp_extract(name, r"(?s)\A(.+)\.([^.]*)\z", 1), F.regexp_extract(name, r"(?s)\A(.+)\.([^.]*)\z", 2)
    return F.when(name.rlike(r"(?s)\A.+\.[^.]*\z"), F.concat(stem, F.lit("_"), suffix, F.lit("."), ext)).otherwise(F.concat(name, F.lit("_"), suffix))


def output_path(p: Column, h: Column, digits: int) -> Column:
    """A relative path whose last segment carries the first digits of the hash."""
    parts = F.split(p, "/")
    name = suffixed_name(F.element_at(parts, -1), F.substring(h, 1, digits))
    return F.array_join(F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(name)), "/")


def lexical_normalize(p: Column) -> Column:
    """An absolute path with '.' dropped and '..' applied to what precedes it; at the root it has no effect."""
    pop = lambda acc: F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
    parts = F.aggregate(
        F.split(p, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", pop(acc)).otherwise(F.concat(acc, F.array(s))),
    )
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def relative_target(from_parent: Column, to_file: Column) -> Column:
    """The path from one absolute directory to an absolute file."""
    a, b = (F.filter(F.split(c, "/"), lambda s: s != "") for c in (from_parent, to_file))
    # Number of leading segments that agree: those before the first place where they differ.
    same = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))), lambda i: F.try_element_at(a, i).eqNullSafe(F.try_element_at(b, i)) & (i <= F.least(F.size(a), F.size(b))))
    first_off = F.array_position(same, False)
    common = F.when(first_off == 0, F.size(same)).otherwise((first_off - 1).cast("int"))
    up = F.repeat(F.lit("../"), F.size(a) - common)
    tail = F.array_join(F.slice(b, common + 1, F.size(b)), "/")
    out = F.concat(up, tail)
    return F.when(out == "", F.lit(".")).when(tail == "", F.regexp_replace(out, "/$", "")).otherwise(out)


def inside(path: Column, folder: Column) -> Column:
    """Component-wise prefix: the folder itself or below it."""
    return (path == folder) | F.startswith(path, F.concat(folder, F.lit("/")))


def paths_overlap(a: Column, b: Column) -> Column:
    return inside(a, b) | inside(b, a)


def _escaped(c: Column, pattern: str) -> Column:
    hexed = lambda ch: F.regexp_replace(F.lower(F.hex(F.encode(ch, "UTF-8"))), "(..)", r"\\x$1")
    return F.array_join(F.transform(F.split(c, ""), lambda ch: F.when(ch.rlike(pattern), hexed(ch)).otherwise(ch)), "")


def escape_identity(c: Column) -> Column:
    """Control characters and white space as \\xHH for each UTF-8 byte."""
    return _escaped(c, r"[\p{Cc}\p{IsWhite_Space}]")


#: One character of UTF-8, or else one byte, where each byte is read as the character of its number.
_UTF8 = r"[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}|[\x80-\xff]"


def byte_text(b: Column) -> Column:
    """Bytes as the characters of their numbers: to be cut and matched as ASCII."""
    return F.decode(b, "ISO-8859-1")


def escape_bytes(b: Column) -> Column:
    """escape_identity for a name in bytes; bytes that are not UTF-8 become \\xHH as well."""

    def shown(one: Column) -> Column:
        raw = F.encode(one, "ISO-8859-1")
        text = raw.cast("string")
        hexed = F.regexp_replace(F.lower(F.hex(raw)), "(..)", r"\\x$1")
        return F.when(~F.is_valid_utf8(text) | text.rlike(r"[\p{Cc}\p{IsWhite_Space}]"), hexed).otherwise(text)

    return F.array_join(F.transform(F.regexp_extract_all(byte_text(b), F.lit(_UTF8), F.lit(0)), shown), "")


def escape_output(c: Column) -> Column:
    """Control characters only, by code point."""
    coded = lambda ch: F.concat(F.lit("\\x"), F.lpad(F.lower(F.hex(F.ascii(ch))), 2, "0"))
    return F.array_join(F.transform(F.split(c, ""), lambda ch: F.when(ch.rlike(r"\p{Cc}"), coded(ch)).otherwise(ch)), "")


def bounded(c: Column, most: int = 256) -> Column:
    return F.substring(c, 1, most)


def normalized_sql(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"\s", "")


def ancestors(p: Column) -> Column:
    """The directories above a relative path, from the top down."""
    parts = F.split(p, "/")
    up = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.transform(up, lambda _, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "/"))


def cas_class(components: Column, kind: Column, ancestors_valid: Column) -> Column:
    """What an entry below the blob folder is: 'valid-directory', 'valid-blob', or why it is neither.  Components are text; null where bytes are not UTF-8."""
    n = F.size(components)
    part = lambda i: F.try_element_at(components, F.lit(i))
    shard = lambda c: F.coalesce(c.rlike(SHARD_PATTERN), F.lit(False))
    name = part(3)
    return (
        F.when(kind == "symlink", "symlink")
        .when(~kind.isin("file", "directory"), "non-regular")
        .when(~ancestors_valid, "malformed-ancestor")
        .when((kind == "directory") & (n <= 2) & F.forall(components, shard), "valid-directory")
        .when((kind == "directory") & (n >= 3), "directory-at-blob-depth")
        .when(kind == "directory", "invalid-shard")
        .when(n != 3, "file-at-invalid-depth")
        .when(~shard(part(1)) | ~shard(part(2)), "invalid-shard")
        .when(~valid_hash(name), "invalid-blob-name")
        .when((part(1) != F.substring(name, 1, 2)) | (part(2) != F.substring(name, 3, 2)), "shard-mismatch")
        .otherwise("valid-blob")
    )
