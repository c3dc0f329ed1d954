"""Paths: globs, kinds of files, languages, tiers and penalties."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.constants import ASSET_LANGUAGES, CONFIG_LANGUAGES, DOC_LANGUAGES, LANGUAGES

PENALISED = r"(?i)(^|/|-|_)(tests?|demo|examples?|sandbox|stub|mock|fixtures?)(/|-|_|$)"
GENERIC = r"(?i)^(stores?|components?|types?|utils?|hooks?|constants?|helpers?|styles?|assets?|queries|state)$"
TAIL = r"(?i)(^|/)(__tests?__|tests?|e2e|docs?|examples?|specs?|fixtures?)(/|$)"
STRUCTURAL_SUMMARY = r"^[0-9]+ file\(s\) in "
TEST_FILE = r"(?i)((^|/)(__tests?__|tests?)/|[._](test|spec)\.[a-z]+$|(^|/)test_[^/]*$|_test\.[a-z]+$)"


def glob_regex(glob: str) -> str:
    """The regular expression of a glob; ** crosses folders, also none, * and ? stay within one."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def globs_regex(globs: list[str]) -> str:
    """One expression for several globs."""
    return "|".join(map(glob_regex, globs))


def matches(path: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Whether a path is included by any glob (or there is none) and excluded by none."""
    ok = F.lit(True)
    if include:
        ok = ok & path.rlike(globs_regex(include))
    if exclude:
        ok = ok & ~path.rlike(globs_regex(exclude))
    return ok


def dirname(path: Column) -> Column:
    """The folder of a path, empty at the top."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    """The last part of a path, without its extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), "(.)\\.[^.]*$", "$1")


def extension(path: Column) -> Column:
    """The extension in lower case, empty if there is none."""
    return F.lower(F.regexp_extract(path, "[^/]\\.([A-Za-z0-9]+)$", 1))


def language(path: Column) -> Column:
    """The language by extension; null if unknown."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, extension(path))


def file_kind(path: Column) -> Column:
    """doc, config, asset or code; the extension decides before the path does."""
    lang = language(path)
    return (
        F.when(lang.isin(*DOC_LANGUAGES), "doc").when(lang.isin(*CONFIG_LANGUAGES), "config").when(lang.isin(*ASSET_LANGUAGES), "asset")
        .when(lang.isNotNull(), "code").when(path.rlike("(?i)(^|/)docs?/"), "doc").otherwise("asset")
    )


def is_test_file(path: Column) -> Column:
    """Whether a file's name or folder says that it holds tests."""
    return path.rlike(TEST_FILE)


def tier(path: Column) -> Column:
    """2 for tests, docs and examples anywhere in the path, 0 for the top or one folder, else 1."""
    return F.when(path.rlike(TAIL), 2).when(~path.contains("/"), 0).otherwise(1).cast("int")


def path_weight(path: Column) -> Column:
    """Penalty of folders that hold tests, demos and the like."""
    return F.when(path.rlike(PENALISED), 0.55).otherwise(1.0)


def generic_weight(path: Column) -> Column:
    """Penalty of folders named for what any project has."""
    return F.when(F.element_at(F.split(path, "/"), -1).rlike(GENERIC), 0.8).otherwise(1.0)
