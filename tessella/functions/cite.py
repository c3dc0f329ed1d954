"""Citations of the form [path:start-end] in prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INNER = r"\[[^\[\]\n]*+(?:\[[^\]\n]*+\][^\[\]\n]*+)*+\]"
#: A bracket that ends in a file name; brackets within the path, up to one nested, belong to it.
#: Runs of other signs are taken whole, so a long line costs no depth of the matcher's stack.
ANCHORED = rf"\[([^\[\]\n]*+(?:{_INNER}[^\[\]\n]*+)*+)(?<=\.[A-Za-z0-9]{{1,8}}(?::[0-9]{{1,9}}(?:-[0-9]{{1,9}})?)?)\]"
PLAIN = r"\[([^\[\]\n]+)\]"
PATH_LIKE = r"/|\.[A-Za-z0-9]{1,8}(?::[0-9]|$)"
_LINK = r"\[([^\]\n]*)\]\([^)\n]*\)"


def prose(text: Column) -> Column:
    """Text without comments, fences, inline code, and links whose text is no path."""
    t = F.regexp_replace(text, r"(?s)<!--.*?-->", "\n")
    t = F.regexp_replace(t, r"(?s)```.*?```", "\n")
    t = F.regexp_replace(t, r"(?s)~~~.*?~~~", "\n")
    t = F.regexp_replace(t, r"`[^`\n]*`", " ")
    # Links whose text is a path lose only their target; the others go.
    t = F.regexp_replace(t, r"\[(\s*[^\]\n]*/[^\]\n]*|[^\]\n]*\.[A-Za-z0-9]{1,8}(?::[0-9][^\]\n]*)?\s*)\]\([^)\n]*\)", "[$1]")
    return F.regexp_replace(t, _LINK, " ")


def citations(text: Column) -> Column:
    """array<struct<raw,path,start,end>>, each raw form once, anchored ones first."""
    p = prose(text)
    found = F.concat(F.regexp_extract_all(p, F.lit(ANCHORED), F.lit(1)), F.regexp_extract_all(p, F.lit(PLAIN), F.lit(1)))
    raws = F.transform(found, lambda x: F.regexp_replace(F.trim(x), "[.,;]+$", ""))
    raws = F.array_distinct(F.filter(raws, lambda x: x.rlike(PATH_LIKE)))

    def one(raw: Column) -> Column:
        number = lambda g: F.regexp_extract(raw, ":([0-9]+)(?:-([0-9]+))?$", g).try_cast("int")
        return F.struct(
            raw.alias("raw"), F.regexp_replace(raw, ":[0-9]+(-[0-9]+)?$", "").alias("path"),
            number(1).alias("start"), number(2).alias("end"),
        )

    return F.filter(F.transform(raws, one), lambda c: c["path"] != "")
