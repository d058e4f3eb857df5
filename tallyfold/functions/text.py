"""Names of files, one-line forms of maps and lists, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def file_name(path: Column) -> Column:
    return F.substring_index(_slashes(path), "/", -1)


def file_extension(path: Column) -> Column:
    """Without the dot; empty if there is none."""
    return F.regexp_extract(file_name(path), r"\.([^.]*)$", 1)


def proper_name(path: Column) -> Column:
    """The file's name without its extension."""
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def folder_name(path: Column) -> Column:
    return F.substring_index(F.regexp_extract(_slashes(path), r"^(.*)/[^/]*$", 1), "/", -1)


def levels_up(path: Column, n: int) -> Column:
    """The path without its last n parts."""
    return F.regexp_replace(_slashes(path), r"(/[^/]*){%d}$" % n, "")


def map_to_line(m: Column, fields: list[str] | None = None, splitter: str = ": ", separator: str = ", ") -> Column:
    """One line of a map, its keys sorted or as listed."""
    keys = F.array(*[F.lit(x) for x in fields]) if fields else F.sort_array(F.map_keys(m))
    return F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit(splitter), F.coalesce(F.element_at(m, k).cast("string"), F.lit("")))), separator)


def list_to_line(values: Column, splitter: str = ", ") -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), splitter)


def fingerprint(keys: list[Column], values: list[Column]) -> Column:
    """SHA-1 over the SHA-1 of all keys and that of all values, in order. Each stands with its length before it, NULL as a dash, so that no two lists look alike."""
    framed = lambda c: F.coalesce(F.concat(F.char_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    joined = lambda cols: F.sha1(F.concat(*[framed(c.cast("string")) for c in cols]).cast("binary"))
    return F.sha1(F.concat(joined(keys), joined(values)).cast("binary"))


def pick(values: Column, places: Column) -> Column:
    """Elements of an array by a list of 0-based places; NULL outside."""
    return F.transform(places, lambda k: F.get(values, k))


def same_list(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, a.isNull() & b.isNull())
