"""Expressions over file paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import values as V


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def suffix_of(name: Column) -> Column:
    """The last dot and what follows it; empty for names that begin or end with their only dot."""
    return F.regexp_extract(name, r"[^.](\.[^.]+)\z", 1)


def with_path_parts(df: DataFrame) -> DataFrame:
    """Adds dir, name, suffix, stem and ext (lower case) of ``path``."""
    name = name_of(F.col("path"))
    df = df.withColumn("dir", dir_of(F.col("path"))).withColumn("name", name).withColumn("suffix", suffix_of(name))
    return df.withColumn("stem", F.expr("substring(name, 1, length(name) - length(suffix))")).withColumn("ext", F.lower("suffix"))


def kind_of(ext: Column) -> Column:
    """The kind of file that an extension (with its dot, lower case) names, else null."""
    out = F.lit(None).cast("string")
    for kind, exts in V.KINDS.items():
        out = F.when(ext.isin(*exts), kind).otherwise(out)
    return out


def pruned(path: Column) -> Column:
    """Whether a hidden or bundle folder, or a hidden name, lies on a relative path."""
    parts = F.split(path, "/")
    bundle = F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.lower(F.regexp_extract(p, r"[^.](\.[^.]+)\z", 1)).isin(*V.BUNDLE))
    return F.exists(parts, lambda p: p.startswith(".")) | bundle


def inside(path: Column, root: Column) -> Column:
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def intended_output(kind: Column, path: Column, chosen: Column) -> Column:
    """The chosen output, or the path with the extension of its kind's target."""
    target = F.when(kind.isin("photo", "heic"), ".webp").otherwise(".mp4")
    return F.coalesce(chosen, F.concat(F.regexp_replace(path, r"(?<=[^./])\.[^./]+\z", ""), target))


def ancestors(path: Column) -> Column:
    """All proper ancestors of a path, longest last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
