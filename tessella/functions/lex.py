"""Words: splitting identifiers, stems, folding, synonyms, and tiered matching of a text with query terms.

The word functions are built-in expressions. Matching whole texts goes through Arrow batches: forms
are made once for each distinct token that a worker meets. Nothing here shuffles.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.constants import STOPWORDS, SYNONYMS

_HUMPS = (("([a-z0-9])([A-Z])"), ("([A-Z]+)([A-Z][a-z])"), ("([A-Za-z])([0-9])"), ("([0-9])([A-Za-z])"))
#: Suffix rules in order: pattern and what stays. Groups that took no part are empty.
_SUFFIXES = (
    ("^(.{2,})ies$", r"\1y"),
    ("^(?:(.*(?:s|x|z|ch|sh))es|(.*[^s])s)$", r"\1\2"),
    ("^(.{3,})(?:ing|ed)$", r"\1"),
    ("^(.{4,})e$", r"\1"),
)


def _java(replacement: str) -> str:
    return re.sub(r"\\(\d)", r"$\1", replacement)


def split_identifier(c: Column) -> Column:
    """Parts of an identifier at humps, acronym ends, digits and separators: lower case, each once, in order."""
    for p in _HUMPS:
        c = F.regexp_replace(c, p, "$1 $2")
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^A-Za-z0-9]+"), lambda x: x != ""))


def stem(t: Column) -> Column:
    """A careful stem: plurals, -ing, -ed and a last -e; never of words with digits, never under three letters."""
    r = t
    for pattern, stays in _SUFFIXES:
        r = F.regexp_replace(r, pattern, _java(stays))
    return F.when((F.length(t) < 4) | t.rlike("[0-9]") | (F.length(r) < 3), t).otherwise(r)


@cache
def fold_map() -> dict[int, str]:
    """Every sign that changes: to the letters under its marks, in compatibility form; a mark to nothing. Hangul syllables stay."""
    out = {}
    for code in [*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x110000)]:
        ch = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", ch) if unicodedata.category(x) != "Mn")
        if base != ch:
            out[code] = base
    return out


_BEYOND_ASCII = re.compile("[^\x00-\x7f]+")


def fold_py(s: str) -> str:
    """A text without diacritics, ligatures and other compatibility signs."""
    return s if s.isascii() else _BEYOND_ASCII.sub(lambda m: m.group().translate(fold_map()), s)


#: Bytes of text that are Python strings at once; a longer text is alone.
PART_BYTES = 4 << 20


def parts(b: pa.Array) -> Iterator[pa.Array]:
    """An array of texts in parts of up to `PART_BYTES`, so that a worker's memory doesn't follow the rows of a batch."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(b), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < len(b):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART_BYTES, "right")))
        yield b.slice(at, to - at)
        at = to


def fold(c: Column) -> Column:
    """`fold_py` for columns: texts and queries are folded by the same code."""

    @F.arrow_udf("string")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in texts:
            for part in parts(b):
                yield pa.array([None if t is None else fold_py(t) for t in part.to_pylist()], pa.string())

    return run(c)


def raw_tokens(c: Column) -> Column:
    """Runs of letters, digits and underscores."""
    return F.filter(F.split(c, "[^A-Za-z0-9_]+"), lambda x: x != "")


def token_forms(token: Column) -> Column:
    """All forms under which a token is found: itself, its parts, and the stems of both."""
    parts = F.array_union(F.array(F.lower(token)), split_identifier(token))
    return F.array_union(parts, F.transform(parts, stem))


# Python twins


def split_identifier_py(s: str) -> list[str]:
    """As `split_identifier`, for one string."""
    for p in _HUMPS:
        s = re.sub(p, r"\1 \2", s)
    return list(dict.fromkeys(x.lower() for x in re.split("[^A-Za-z0-9]+", s) if x))


def stem_py(t: str) -> str:
    """As `stem`, for one string."""
    if len(t) < 4 or re.search("[0-9]", t):
        return t
    r = t
    for pattern, stays in _SUFFIXES:
        r = re.sub(pattern, lambda m, s=stays: re.sub(r"\\(\d)", lambda g: m.group(int(g[1])) or "", s), r)
    return r if len(r) >= 3 else t


def token_forms_py(t: str) -> set[str]:
    """As `token_forms`, for one token."""
    parts = {t.lower(), *split_identifier_py(t)}
    return parts | {stem_py(x) for x in parts}


def keywords(s: str) -> list[str]:
    """Words that carry meaning: folded, without stopwords and single signs, each once, in their own case."""
    seen: dict[str, str] = {}
    for t in re.split("[^A-Za-z0-9_]+", fold_py(s)):
        if len(t) > 1 and t.lower() not in STOPWORDS:
            seen.setdefault(t.lower(), t)
    return list(seen.values())


@cache
def synonym_groups() -> dict[str, int]:
    """Word or stem to its group; a later group overwrites an earlier one."""
    out: dict[str, int] = {}
    for n, line in enumerate(SYNONYMS):
        for w in line.split():
            out[w] = out[stem_py(w)] = n
    return out


def synonym_group(token: str) -> int | None:
    """The group of a word, by itself or by its stem."""
    g = synonym_groups()
    return g[token] if token in g else g.get(stem_py(token))


@dataclass(frozen=True)
class Term:
    """A query word with the forms that match it, from strong to weak."""

    raw: str
    exact: str
    forms: tuple[str, ...]
    groups: tuple[int, ...]

    @property
    def synonyms(self) -> list[list[str]]:
        """The words of each of its groups."""
        return [sorted(w for w, n in synonym_groups().items() if n == g) for g in self.groups]


def query_terms(query: str) -> list[Term]:
    """The words of a query, expanded."""
    out = []
    for raw in keywords(query):
        exact = raw.lower()
        parts = [p for p in split_identifier_py(raw) if p != exact and keywords(p)]
        forms = dict.fromkeys(f for f in [stem_py(exact), *parts, *map(stem_py, parts)] if f != exact)
        groups = dict.fromkeys(g for f in [exact, *parts] if (g := synonym_group(f)) is not None)
        out.append(Term(raw, exact, tuple(forms), tuple(groups)))
    return out


# Matching


#: Result of matching: for every term how strongly and how often it is found, and the tokens of the text.
MATCHES = "struct<hits:array<struct<weight:double,count:bigint>>,n_tokens:int>"
#: Distinct tokens whose forms a worker remembers, after which it starts anew.
TOKEN_CACHE = 500_000


class Matcher:
    """Exact 3, form 2, synonym 1.5, part of a word 1, none 0; and by how many tokens."""

    def __init__(self, terms: list[Term]):
        self.terms, self.known = terms, {}
        #: Every way to find a term: (place of the term, weight, words).
        self.ways = [(i, w, frozenset(x)) for i, t in enumerate(terms) for w, own in ((3.0, [[t.exact]]), (2.0, [[f] for f in t.forms]), (1.5, t.synonyms)) for x in own]
        self.cut = re.compile("[A-Za-z0-9_]+").findall
        # A form is a part of its token but for its last sign (stories, story): what holds none of these finds nothing.
        self.may = re.compile("|".join(sorted({re.escape(w[:-1] or w) for _, _, x in self.ways for w in x})) or "(?!)").search

    def found(self, token: str) -> tuple[int, ...]:
        """The ways in which a token finds terms."""
        if len(self.known) >= TOKEN_CACHE:
            self.known.clear()
        if not self.may(token.lower()):
            self.known[token] = ()
            return ()
        forms = token_forms_py(token)
        out = self.known[token] = tuple(n for n, (_, _, words) in enumerate(self.ways) if not words.isdisjoint(forms))
        return out

    def match(self, text: str) -> tuple[list[float], list[int], int]:
        """(weight and count of every term, number of tokens)."""
        folded = fold_py(text)
        tokens, counts = Counter(self.cut(folded)), [0] * len(self.ways)
        known = self.known
        for t, n in tokens.items():
            ways = known.get(t)
            if ways is None:
                ways = self.found(t)
            if ways:
                for way in ways:
                    counts[way] += n
        weight, count, low = [0.0] * len(self.terms), [0] * len(self.terms), None
        for (i, w, _), n in zip(self.ways, counts):
            if n and (w > weight[i] or w == weight[i] and n > count[i]):
                weight[i], count[i] = w, n
        for i, t in enumerate(self.terms):
            if not count[i]:
                low = folded.lower() if low is None else low
                if t.exact in low:
                    weight[i], count[i] = 1.0, 1
        return weight, count, tokens.total()


@lru_cache(maxsize=8)
def matcher(terms: tuple[Term, ...]) -> Matcher:
    """One for each query that this worker has met, so that its tasks share what is known of tokens."""
    return Matcher(list(terms))


def match(text: Column, terms: list[Term]) -> Column:
    """`MATCHES` of a text with the terms; a null text matches nothing and has no number of tokens."""

    @F.arrow_udf(MATCHES)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m, k = matcher(tuple(terms)), len(terms)
        for b in (part for whole in batches for part in parts(whole)):
            weights, counts, sizes = [], [], []
            for t in b.to_pylist():
                w, c, n = ([0.0] * k, [0] * k, None) if t is None else m.match(t)
                weights += w
                counts += c
                sizes.append(n)
            one = pa.StructArray.from_arrays([pa.array(weights, pa.float64()), pa.array(counts, pa.int64())], names=["weight", "count"])
            hits = pa.ListArray.from_arrays(pa.array(range(0, k * len(b) + 1, k) if k else [0] * (len(b) + 1), pa.int32()), one)
            yield pa.StructArray.from_arrays([hits, pa.array(sizes, pa.int32())], names=["hits", "n_tokens"])

    return run(text)


def saturated(weight: Column, count: Column) -> Column:
    """A weight that grows a little with repetition."""
    return weight * F.least(F.lit(1.5), 1 + F.log1p((count - 1).cast("double")) * 0.25)


def length_norm(n_tokens: Column) -> Column:
    """What long texts are divided by."""
    return 1 + F.log(F.greatest(F.lit(1.0), n_tokens / 200))

