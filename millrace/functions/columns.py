"""Helpers on columns and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """The column of exactly this name, whatever dots or blanks it holds."""
    return F.col(quoted(name))


def fresh(df: DataFrame | list[str], *names: str) -> list[str]:
    """Names like the given ones that clash with no column, compared without case."""
    taken = {c.lower() for c in (df if isinstance(df, list) else df.columns)}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def orderable(kind: T.DataType) -> bool:
    """Whether values of this type can be compared for order."""
    if isinstance(kind, (T.MapType, T.VariantType)):
        return False
    if isinstance(kind, T.ArrayType):
        return orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(orderable(f.dataType) for f in kind.fields)
    return True


def plain_path(path: Column) -> Column:
    """A file path without surrounding blanks, doubled or trailing slashes, ``.`` and ``..`` steps.

    Null stays null. ``..`` removes the step before it, however many there are; one that has nothing before it stays in a relative
    path and goes from an absolute one.
    """
    # most paths are plain, and seeing that is far cheaper than walking their steps
    odd = path.contains("//") | path.contains("./") | path.endswith("/") | path.endswith("/.") | path.endswith("/..") | path.startswith(" ") | path.endswith(" ") | (path == ".")
    p = F.trim(path)
    absolute = p.startswith("/")
    steps = F.filter(F.split(p, "/"), lambda s: (s != "") & (s != "."))
    up = F.lit("..")
    walked = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda before, s: F.when(s != up, F.concat(before, F.array(s)))
        .when((F.size(before) > 0) & (F.get(before, F.size(before) - 1) != up), F.slice(before, F.lit(1), F.size(before) - 1))
        .when(absolute, before)
        .otherwise(F.concat(before, F.array(s))),
    )
    return F.when(odd, F.concat(F.when(absolute, "/").otherwise(""), F.array_join(walked, "/"))).otherwise(path)
