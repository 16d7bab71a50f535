"""Scalar path expressions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(path: Column) -> Column:
    """``./`` and doubled slashes removed, ``a/../`` folded at any depth, lower case."""
    out = F.regexp_replace(path, r"/(?:\./)+", "/")
    out = F.regexp_replace(out, r"/{2,}", "/")
    return F.lower(F.when(F.contains(out, F.lit("/..")), _folded(out)).otherwise(out))


def _folded(path: Column) -> Column:
    """Each ``..`` drops the last part kept, unless that is the root, a dot or a ``..`` itself."""

    def step(kept: Column, part: Column) -> Column:
        plain = ~F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit("")).isin("", ".", "..")
        return F.when((part == "..") & plain, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(F.concat(kept, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def filename(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def stem(path: Column) -> Column:
    """The file name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(filename(path), r"(?<=.)\.[^.]*$", "")


def parent(path: Column) -> Column:
    return F.lower(F.regexp_replace(path, r"/[^/]*$", ""))


def suffix(path: Column) -> Column:
    """The last suffix with its dot, lower case; empty without one."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def relative(path: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 20)).otherwise(path)


def part(path: Column, from_end: int) -> Column:
    """The ``from_end``-th last part, 1 being the file name."""
    return F.element_at(F.split(path, "/"), -from_end)


def numbered(template: str, n: Column) -> Column:
    return F.format_string(template, n)
