"""SQL (as DuckDB reads it) for the word functions, to check the columns against."""

from __future__ import annotations

from tessella.functions.lex import Term


def humps(e: str) -> str:
    for p in ("([a-z0-9])([A-Z])", "([A-Z]+)([A-Z][a-z])", "([A-Za-z])([0-9])", "([0-9])([A-Za-z])"):
        e = rf"regexp_replace({e}, '{p}', '\1 \2', 'g')"
    return e


def split(e: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({humps(e)}), '[^a-z0-9]+'), lambda x: x <> '')"


def first_only(lst: str) -> str:
    return f"list_filter({lst}, lambda x, i: list_position({lst}, x) = i)"


def stem(e: str) -> str:
    r = rf"regexp_replace({e}, '^(.{{2,}})ies$', '\1y')"
    r = rf"regexp_replace({r}, '^(?:(.*(?:s|x|z|ch|sh))es|(.*[^s])s)$', '\1\2')"
    r = rf"regexp_replace({r}, '^(.{{3,}})(?:ing|ed)$', '\1')"
    r = rf"regexp_replace({r}, '^(.{{4,}})e$', '\1')"
    return f"case when length({e}) < 4 or regexp_matches({e}, '[0-9]') or length({r}) < 3 then {e} else {r} end"


def forms(t: str = "t") -> str:
    return f"list_concat([lower({t}), {stem(f'lower({t})')}], list_concat({split(t)}, list_transform({split(t)}, lambda p: {stem('p')})))"


def tokens(e: str) -> str:
    return f"list_filter(regexp_split_to_array(strip_accents({e}), '[^A-Za-z0-9_]+'), lambda x: x <> '')"


def _has(words: list[str]) -> str:
    return f"list_has_any(f, [{', '.join(repr(w) for w in words)}])"


def hits(name: str, source: str, key: str, text: str, terms: list[Term]) -> str:
    """CTEs that end in `name`: key, n (tokens), w0, c0, w1, c1, ... of every row of `source`.

    Forms are made once for each distinct token.
    """
    flags, sums, out = [], [], []
    for i, t in enumerate(terms):
        ways = {f"e{i}": [t.exact]} | {f"f{i}_{j}": [x] for j, x in enumerate(t.forms)} | {f"g{i}_{j}": x for j, x in enumerate(t.synonyms)}
        flags += [f"{_has(words)} as {k}" for k, words in ways.items()]
        sums += [f"count(*) filter ({k}) as {k}" for k in ways]
        f = "greatest(0, " + ", ".join(f"coalesce({k}, 0)" for k in ways if k[0] == "f") + ")" if t.forms else "0"
        g = "greatest(0, " + ", ".join(f"coalesce({k}, 0)" for k in ways if k[0] == "g") + ")" if t.groups else "0"
        inside = f"contains(lower(strip_accents({text})), '{t.exact}')"
        out.append(f"(case when e{i} > 0 then 3.0 when {f} > 0 then 2.0 when {g} > 0 then 1.5 when {inside} then 1.0 else 0.0 end)::double as w{i}")
        out.append(f"(case when e{i} > 0 then e{i} when {f} > 0 then {f} when {g} > 0 then {g} when {inside} then 1 else 0 end)::bigint as c{i}")
    return f"""{name}_t as (select {key} as k, unnest({tokens(text)}) as t from {source}),
    {name}_f as materialized (select t, {forms()} as f from (select distinct t from {name}_t)),
    {name}_h as materialized (select t, {', '.join(flags)} from {name}_f),
    {name}_c as (select k, count(*) as n, {', '.join(sums)} from {name}_t join {name}_h using (t) group by k),
    {name} as materialized (select s.{key}, coalesce(c.n, 0)::bigint as n, {', '.join(out)} from {source} s left join {name}_c c on c.k = s.{key})"""
