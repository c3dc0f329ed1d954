"""Ranked search over modules: lexical scores, seeds, expansion over the graph, and fusion with vectors."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella import constants as C
from tessella.functions import lex, paths, vectors
from tessella.session import durable

RESULT = "slug string, path string, title string, tier int, score double, degree bigint, matched array<string>, files array<string>"


def _joined(*parts: Column) -> Column:
    """Parts with something in them, with spaces between."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), " ")


def with_matches(rows: DataFrame, text: Column, terms: list[lex.Term]) -> DataFrame:
    """`rows` with `hits`, for every term how it matches the text, and `n_tokens`."""
    return rows.withColumn("_found", lex.match(text, terms)).withColumn("hits", F.col("_found.hits")).withColumn("n_tokens", F.col("_found.n_tokens")).drop("_found")


def _total(hits: str, idf: list[float], saturate: bool = False) -> Column:
    one = lambda i: lex.saturated(F.col(hits)[i]["weight"], F.greatest(F.col(hits)[i]["count"], F.lit(1))) if saturate else F.col(hits)[i]["weight"]
    return reduce(lambda a, b: a + b, [one(i) * F.lit(v) for i, v in enumerate(idf)])


def score_texts(rows: DataFrame, text: Column, query: str, saturate: bool = False) -> DataFrame:
    """`rows` with `score` and `matched` for a query, all terms of equal rarity."""
    terms = lex.query_terms(query)
    hit = with_matches(rows, text, terms)
    score = _total("hits", [1.0] * len(terms), saturate)
    score = score / lex.length_norm(F.col("n_tokens")) if saturate else score
    return hit.withColumn("score", score).withColumn("matched", _matched(F.col("hits"), terms)).drop("hits", "n_tokens")


def _matched(hits: Column, terms: list[lex.Term]) -> Column:
    names = F.array(*[F.when(hits[i]["weight"] > 0, F.lit(t.raw)) for i, t in enumerate(terms)])
    return F.filter(names, lambda x: x.isNotNull())


def _label_bonus(labels: Column, joined: str) -> Column:
    """10 where a label is the whole query, 4 where one begins with it."""
    return F.when(F.exists(labels, lambda x: x == joined), 10.0).when(F.exists(labels, lambda x: x.startswith(joined)), 4.0).otherwise(0.0)


def _label(c: Column) -> Column:
    return F.array_join(lex.split_identifier(c), " ")


def document_frequencies(modules: DataFrame, files: DataFrame, query: str, prose: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """(term, df, idf): in how many modules each query term occurs, and its clamped rarity."""
    terms = lex.query_terms(query)
    return _rarity(_module_hits(modules, _file_hits(files, terms, names), terms, prose), terms)


def _rarity(seen: DataFrame, terms: list[lex.Term]) -> DataFrame:
    counts = [F.count_if(F.col("any")[i]).alias(f"df{i}") for i in range(len(terms))]
    one = seen.agg(F.count("*").alias("n"), *counts)
    rows = F.explode(F.array(*[F.struct(F.lit(t.raw).alias("term"), F.col(f"df{i}").alias("df")) for i, t in enumerate(terms)]))
    idf = F.least(F.lit(2.0), F.greatest(F.lit(0.5), 1 + F.log((F.col("n") + 1) / (F.col("r.df") + 1))))
    return one.select("n", rows.alias("r")).select("r.term", "r.df", idf.alias("idf"))


def _file_hits(files: DataFrame, terms: list[lex.Term], names: DataFrame | None) -> DataFrame:
    rows = files.select("rel", "module", "title", "summary", (F.coalesce("deg_in", F.lit(0)) + F.coalesce("deg_out", F.lit(0))).cast("long").alias("degree"))
    if names is None:
        rows = rows.withColumn("names", F.array().cast("array<string>"))
    else:
        rows = rows.join(names.select(F.col("file").alias("rel"), "names"), "rel", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    text = _joined(F.col("rel"), F.col("title"), F.col("summary"), F.array_join("names", " "))
    labels = F.concat(F.array(_label(paths.basename(F.col("rel")))), F.transform("names", _label))
    f = with_matches(rows, text, terms).withColumn("bonus", _label_bonus(labels, " ".join(t.exact for t in terms)))
    return f.select("rel", "module", "degree", F.transform("hits", lambda h: h["weight"]).alias("weights"), "bonus")


def _module_hits(modules: DataFrame, f: DataFrame, terms: list[lex.Term], prose: DataFrame | None) -> DataFrame:
    """One row a module with what matches it: its own words, its prose, any of its files."""
    k = len(terms)
    joined = " ".join(t.exact for t in terms)
    members = f.groupBy(F.col("module").alias("slug")).agg(F.max("bonus").alias("file_bonus"), *[F.max(F.col("weights")[i]).alias(f"_any{i}") for i in range(k)])
    members = members.select("slug", "file_bonus", F.array(*[f"_any{i}" for i in range(k)]).alias("file_any"))
    m = modules.select("slug", "path", "title", "summary", "tier", "deg_in", "deg_out").withColumn("text_summary", F.when(F.col("summary").rlike(paths.STRUCTURAL_SUMMARY), None).otherwise(F.col("summary")))
    m = with_matches(m, _joined(F.col("slug"), F.col("path"), F.col("text_summary")), terms).withColumnRenamed("hits", "module_hits").drop("n_tokens", "text_summary")
    m = m.withColumn("label_bonus", _label_bonus(F.array(_label(F.col("slug")), _label(F.col("path"))), joined))
    if prose is None:
        m = m.withColumn("prose_hits", F.lit(None).cast(m.schema["module_hits"].dataType)).withColumn("prose_tokens", F.lit(None).cast("int"))
    else:
        p = with_matches(prose.select("slug", "text"), F.col("text"), terms).select("slug", F.col("hits").alias("prose_hits"), F.col("n_tokens").alias("prose_tokens"))
        m = m.join(p, "slug", "left")
    all_ = m.join(members, "slug", "left")
    any_ = [
        (F.col("module_hits")[i]["weight"] > 0) | (F.coalesce(F.col("prose_hits")[i]["weight"], F.lit(0.0)) > 0) | (F.coalesce(F.col("file_any")[i], F.lit(0.0)) > 0)
        for i in range(k)
    ]
    return all_.withColumn("any", F.array(*any_))


def score_modules(modules: DataFrame, files: DataFrame, query: str, prose: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """Every module that a query matches, with its score, matched terms and files to open.

    modules: slug, path, title, summary, tier, deg_in, deg_out; files: rel, module, title,
    summary, deg_in, deg_out; prose: slug, text; names: file, names. Texts are matched once, and
    what they match is stored; rarity comes from those rows and returns to the plan as one number
    for each term.
    """
    terms = lex.query_terms(query)
    if not terms:
        return modules.sparkSession.createDataFrame([], RESULT)
    k = len(terms)
    f = durable(_file_hits(files, terms, names))
    s = durable(_module_hits(modules, f, terms, prose))
    rarity = {r["term"]: r["idf"] for r in _rarity(s, terms).collect()}
    idf = [float(rarity[t.raw]) for t in terms]
    top = max(1.0, *idf)
    f = f.withColumn("score", reduce(lambda a, b: a + b, [F.col("weights")[i] * F.lit(v) for i, v in enumerate(idf)]))
    best = f.groupBy(F.col("module").alias("slug")).agg(F.max("score").alias("best"), F.count_if(F.col("score") > 0).alias("n_hits"))
    # The first few of each module are picked in every task before the shuffle; a module of any size sends few rows.
    w = Window.partitionBy("module").orderBy(F.desc("score"), F.desc("degree"), "rel")
    first = f.withColumn("n", F.row_number().over(w)).where(F.col("n") <= C.MAX_FILES)
    first = first.groupBy(F.col("module").alias("slug")).agg(F.array_sort(F.collect_list(F.struct("n", "rel", "score"))).alias("first"))
    s = s.join(best, "slug", "left").join(first, "slug", "left").withColumn("best", F.coalesce("best", F.lit(0.0))).withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))
    s = s.withColumn("first", F.coalesce("first", F.array().cast("array<struct<n:int,rel:string,score:double>>")))
    s = s.withColumn("own", _total("module_hits", idf))
    s = s.withColumn("told", F.coalesce(_total("prose_hits", idf, True) / lex.length_norm(F.col("prose_tokens")), F.lit(0.0)))
    s = s.where((F.col("own") > 0) | (F.col("best") > 0) | (F.col("told") > 0))
    bonus = F.greatest("label_bonus", F.coalesce("file_bonus", F.lit(0.0))) * top
    coverage = F.size(F.filter("any", lambda x: x)) / F.lit(float(k))
    keyword = F.col("own") * C.MODULE_WEIGHT + F.col("told") * C.PROSE_WEIGHT + F.col("best") + F.least(F.col("n_hits"), F.lit(5)) * C.BREADTH_WEIGHT + bonus
    degree = (F.coalesce("deg_in", F.lit(0)) + F.coalesce("deg_out", F.lit(0))).cast("long")
    tail = F.when(F.col("tier") == 2, C.TAIL_WEIGHT).otherwise(1.0)
    total = keyword * tail * paths.path_weight(F.col("path")) * paths.generic_weight(F.col("path")) * (0.4 + 0.6 * coverage * coverage) + F.least(degree, F.lit(5)) * C.DEGREE_WEIGHT
    names_of = F.array(*[F.when(F.col("any")[i], F.lit(t.raw)) for i, t in enumerate(terms)])
    # Without a hit all scores are 0, so the order is by degree.
    shown = F.transform(F.filter("first", lambda x: (F.col("n_hits") == 0) | (x["score"] > 0)), lambda x: x["rel"])
    return s.select(
        "slug", "path", "title", F.col("tier").cast("int").alias("tier"), F.round(total, 3).alias("score"), degree.alias("degree"),
        F.array_sort(F.filter(names_of, lambda x: x.isNotNull())).alias("matched"),
        shown.alias("files"),
    )


ORDER = (F.desc, "score"), (F.desc, "degree"), (F.asc, "slug")


def ranked(scored: DataFrame) -> list[Column]:
    """The order of results; never left to chance."""
    return [f(c) for f, c in ORDER]


def find(modules: DataFrame, files: DataFrame, query: str, k: int = C.TOP_K, **more) -> DataFrame:
    """The k best modules."""
    s = score_modules(modules, files, query, **more)
    return s.orderBy(*ranked(s)).limit(k)


def neighbour_slugs(edges: DataFrame, cap: int = C.MAX_NEIGHBOURS) -> DataFrame:
    """(slug, neighbors): the first modules on either side of an edge."""
    both = edges.select(F.col("src").alias("slug"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("slug"), F.col("src").alias("other")))
    return both.where("slug <> other").groupBy("slug").agg(F.slice(F.array_sort(F.collect_set("other")), 1, cap).alias("neighbors"))


def pick_seeds(scored: DataFrame, query: str) -> DataFrame:
    """(position, slug): up to three best rows within a fifth of the top, then one for each term none of them has.

    Only the best rows and the best row for each term are collected, so the walk over terms in
    order, in which a seed may cover later terms, sees a handful of rows.
    """
    terms = [t.raw for t in lex.query_terms(query)]
    order = ranked(scored)
    head = scored.orderBy(*order).limit(C.MAX_SEEDS).select("slug", "score", "matched").collect()
    w = Window.partitionBy("term").orderBy(*order)
    bearers = scored.select("*", F.explode("matched").alias("term")).withColumn("n", F.row_number().over(w)).where("n = 1").select("term", "slug", "matched").collect()
    first = {r["term"]: r for r in bearers}
    seeds: dict[str, list[str]] = {r["slug"]: r["matched"] for r in head if r["score"] >= C.SEED_RATIO * head[0]["score"]}
    for t in terms:
        if t in first and not any(t in m for m in seeds.values()):
            seeds.setdefault(first[t]["slug"], first[t]["matched"])
    return scored.sparkSession.createDataFrame(list(enumerate(seeds)), "position int, slug string")


def expand(modules: DataFrame, edges: DataFrame, scored: DataFrame, query: str, k: int = C.TOP_K, threshold: float | None = None) -> DataFrame:
    """The k best rows, then seeds found for a term, then modules two steps from a seed: k + 4 rows at most.

    A hub that is no seed is shown but not passed through. The last rows come by depth, the
    seeds' communities first, then by degree.
    """
    from tessella.operators.graph import hub_threshold

    m = modules.select("slug", "path", "title", F.col("tier").cast("int").alias("tier"), (F.coalesce("deg_in", F.lit(0)) + F.coalesce("deg_out", F.lit(0))).cast("long").alias("degree"), *(["community"] if "community" in modules.columns else []))
    if "community" not in modules.columns:
        m = m.withColumn("community", F.lit(None).cast("int"))
    limit = threshold if threshold is not None else hub_threshold(m.select("degree")).collect()[0][0]
    scored = durable(scored)
    seeds = pick_seeds(scored, query)
    top = scored.orderBy(*ranked(scored)).limit(k).withColumn("via", F.lit(None).cast("string"))
    top = top.withColumn("stage", F.lit(0)).withColumn("place", F.row_number().over(Window.orderBy(*ranked(scored))))
    shown = top.select("slug")
    terms = scored.join(F.broadcast(seeds), "slug").join(shown, "slug", "left_anti").withColumn("via", F.lit("term")).withColumn("stage", F.lit(1)).withColumnRenamed("position", "place")
    real = edges.join(m.select(F.col("slug").alias("src")), "src", "left_semi").join(m.select(F.col("slug").alias("dst")), "dst", "left_semi")
    if "dangling" in edges.columns:
        real = real.where(~F.coalesce("dangling", F.lit(False)))
    adjacent = real.select("src", "dst").unionByName(real.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    near = adjacent.join(F.broadcast(seeds.select(F.col("slug").alias("src"))), "src").select(F.col("dst").alias("slug")).distinct()
    near = near.join(F.broadcast(seeds), "slug", "left_anti").withColumn("depth", F.lit(1))
    passing = near.join(m.where(F.col("degree") < limit), "slug", "left_semi").select(F.col("slug").alias("src"))
    far = adjacent.join(passing, "src").select(F.col("dst").alias("slug")).distinct()
    far = far.join(F.broadcast(seeds), "slug", "left_anti").join(near, "slug", "left_anti").withColumn("depth", F.lit(2))
    found = near.unionByName(far).join(shown, "slug", "left_anti").join(m, "slug")
    homes = m.join(F.broadcast(seeds), "slug", "left_semi").where("community is not null").select("community").distinct().withColumn("kin", F.lit(1))
    found = found.join(F.broadcast(homes), "community", "left").withColumn("kin", F.coalesce("kin", F.lit(0)))
    order = ["depth", F.desc("kin"), F.desc("degree"), "slug"]
    found = found.orderBy(*order).limit(k + C.APPENDED_ROWS).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    found = found.withColumn("score", F.lit(0.0)).withColumn("matched", F.array().cast("array<string>")).withColumn("files", F.array().cast("array<string>")).withColumn("via", F.lit("graph")).withColumn("stage", F.lit(2))
    cols = ["slug", "path", "title", "tier", "score", "degree", "matched", "files", "via", "stage", "place"]
    out = top.select(*cols).unionByName(terms.select(*cols)).unionByName(found.select(*cols)).orderBy("stage", "place").limit(k + C.APPENDED_ROWS)
    return out.withColumn("position", F.row_number().over(Window.orderBy("stage", "place"))).drop("stage", "place")


def semantic_ranks(store: DataFrame, query_vector: list[int], pool: int, floor: float = C.NOISE_FLOOR) -> DataFrame:
    """(slug, cosine, semantic_rank) of the nearest modules above the noise floor."""
    q = F.array(*[F.lit(int(x)).cast("tinyint") for x in query_vector])
    near = store.select("slug", vectors.similarity(F.col("v"), q).alias("cosine")).where(F.col("cosine") >= floor)
    near = near.orderBy(F.desc("cosine"), "slug").limit(pool)
    return near.withColumn("semantic_rank", F.row_number().over(Window.orderBy(F.desc("cosine"), "slug")))


def fuse(lexical: DataFrame, semantic: DataFrame, k: int) -> DataFrame:
    """Reciprocal rank fusion of (slug, lexical_rank from 0) and (slug, semantic_rank from 1)."""
    both = lexical.select("slug", "lexical_rank").join(semantic.select("slug", "semantic_rank"), "slug", "full_outer")
    part = lambda rank: F.coalesce(1 / (C.RRF_K + rank), F.lit(0.0))
    fused = part(F.col("lexical_rank") + 1) + part(F.col("semantic_rank"))
    return both.withColumn("fused", F.round(fused, 12)).orderBy(F.desc("fused"), F.coalesce("lexical_rank", F.lit(10**9)), "slug").limit(k)


def find_hybrid(modules: DataFrame, files: DataFrame, query: str, k: int = C.TOP_K, store: DataFrame | None = None, query_vector: list[int] | None = None, store_model: str | None = None, active_model: str | None = None, **more) -> tuple[DataFrame, str | None]:
    """Results of words and vectors together, and a warning where vectors exist but can't be used.

    Without a store it is lexical and silent. Vectors of another model or size are never mixed in.
    """
    scored = score_modules(modules, files, query, **more)
    plain = scored.orderBy(*ranked(scored)).limit(k).withColumn("semantic_rank", F.lit(None).cast("int"))
    if store is None:
        return plain, None
    if query_vector is None:
        return plain, "no encoder for the query: words only"
    if store_model != active_model:
        return plain, f"vectors are of model {store_model}, the query of {active_model}: words only"
    if store.where(F.size("v") == len(query_vector)).isEmpty():
        return plain, "vectors have another size than the query's: words only"
    pool = max(3 * k, C.POOL)
    head = scored.orderBy(*ranked(scored)).limit(pool)
    lexical = head.withColumn("lexical_rank", F.row_number().over(Window.orderBy(*ranked(scored))) - 1)
    live = store.join(modules.select("slug"), "slug", "left_semi")
    fused = fuse(lexical, semantic_ranks(live, query_vector, pool), k)
    m = modules.select("slug", F.col("path").alias("m_path"), F.col("title").alias("m_title"), F.col("tier").cast("int").alias("m_tier"))
    out = fused.join(head, "slug", "left").join(m, "slug")
    return out.select(
        "slug", F.coalesce("path", "m_path").alias("path"), F.coalesce("title", "m_title").alias("title"), F.coalesce("tier", "m_tier").alias("tier"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("degree", F.lit(0).cast("long")).alias("degree"),
        F.coalesce("matched", F.array().cast("array<string>")).alias("matched"), F.coalesce("files", F.array().cast("array<string>")).alias("files"),
        "semantic_rank", "fused", "lexical_rank",
    ).orderBy(F.desc("fused"), F.coalesce("lexical_rank", F.lit(10**9)), "slug").drop("lexical_rank"), None


def embed_text(modules: DataFrame, files: DataFrame, prose: DataFrame | None = None) -> DataFrame:
    """(slug, text, hash) that a module's vector is made of: title, path, slug, summary, member lines, prose."""
    line = F.concat_ws(" — ", "rel", "title", "summary")
    lines = files.groupBy(F.col("module").alias("slug")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rel", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    m = modules.select("slug", "path", "title", "summary").join(lines, "slug", "left")
    m = m.join(prose.select("slug", F.col("text").alias("prose")), "slug", "left") if prose is not None else m.withColumn("prose", F.lit(None).cast("string"))
    text = F.substring(F.concat_ws("\n", "title", "path", "slug", "summary", "lines", "prose"), 1, C.EMBED_CHARS)
    return m.select("slug", text.alias("text")).withColumn("hash", F.sha1("text"))


def stale_vectors(texts: DataFrame, store: DataFrame) -> DataFrame:
    """(slug, why) of modules whose vector is missing or was made of another text."""
    s = store.select("slug", F.col("hash").alias("stored"))
    why = F.when(F.col("stored").isNull(), "missing").otherwise("changed")
    return texts.join(s, "slug", "left").where(F.col("stored").isNull() | (F.col("stored") != F.col("hash"))).select("slug", why.alias("why"))


def _word_vectors(vocabulary: DataFrame, counts: DataFrame, most: int) -> tuple[pa.Table, DataFrame]:
    """The rows (token, weights) of the words in most texts, `most` rows at most; and those of all other words.

    A word without a vector has one row with null weights. vocabulary: token, weights; counts: token, n.
    """
    known = durable(counts.join(vocabulary, "token", "left"))
    least, rows = None, 0
    for n, more in known.groupBy("n").count().orderBy(F.desc("n")).collect():
        rows += more
        if rows > most:
            break
        least = n
    own = F.lit(False) if least is None else F.col("n") >= least
    return known.where(own).select("token", "weights").toArrow(), known.where(~own & F.col("weights").isNotNull()).select("token", "weights")


def encode(texts: DataFrame, vocabulary: DataFrame, part_rows: int = C.VOCABULARY_PART) -> DataFrame:
    """(slug, v): the mean of the word vectors of a text, at length one, quantised. vocabulary: token, weights.

    Of the vocabulary, the words in most texts are broadcast, `part_rows` rows at most, and summed where
    texts are read; any other word is in few texts, and meets its vector in a join. So what passes the
    driver doesn't grow. A text without a known word has no row; rows of one slug are one text.
    """
    rows = texts.select(F.col("slug").cast("string").alias("slug"), "text")
    vocabulary = vocabulary.select("token", "weights").where("token is not null and weights is not null")
    kind = vocabulary.schema["weights"].dataType.simpleString()

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[Counter]]]:
        cut = re.compile("[A-Za-z0-9_]+").findall
        for b in batches:
            at = 0
            for part in lex.parts(b.column(1)):
                yield b.column(0).slice(at, len(part)).to_pylist(), [Counter(cut(lex.fold_py(t or "").lower())) for t in part.to_pylist()]
                at += len(part)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = lambda n: pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["token", "n"])
        n = Counter()
        for _, texts in tokens(batches):
            for found in texts:
                n.update(found.keys())
            if len(n) >= lex.TOKEN_CACHE:
                yield one(n)
                n = Counter()
        yield one(n)

    counts = rows.mapInArrow(counted, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    got, rare = _word_vectors(vocabulary, counts, part_rows)
    place: dict[str, int] = {}
    full = got.filter(got.column("weights").is_valid())
    names = full.column("token").to_pylist()
    for t in names:
        place.setdefault(t, len(place))
    at = np.array([place[t] for t in names], int)
    matrix, times = np.zeros((len(place), len(full.column("weights")[0]) if names else 0)), np.bincount(at, minlength=len(place))
    np.add.at(matrix, at, full.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(names), -1) if names else matrix)
    # Words without a vector that are in most texts have no place, and needn't move either.
    place |= dict.fromkeys(set(got.column("token").to_pylist()) - place.keys(), -1)
    shared = texts.sparkSession.sparkContext.broadcast((place, times, matrix))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, times, matrix = shared.value
        for own, texts in tokens(batches):
            slugs, sums, n = [], [], []
            for slug, found in zip(own, texts):
                known = [(k, c) for t, c in found.items() if (k := place.get(t, -1)) >= 0]
                if known:
                    at, c = (np.array(x) for x in zip(*known))
                    slugs.append(slug)
                    sums.append(c @ matrix[at])
                    n.append(int((c * times[at]).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(slugs, pa.string()), pa.array(sums, pa.list_(pa.float64())), pa.array(n, pa.int64())], names=["slug", "sums", "n"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value[0]
        for own, texts in tokens(batches):
            slugs, words, n = [], [], []
            for slug, found in zip(own, texts):
                for t, c in found.items():
                    if t not in place:
                        slugs.append(slug)
                        words.append(t)
                        n.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(slugs, pa.string()), pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["slug", "token", "n"])

    def vectors_of(column: pa.Array) -> np.ndarray:
        full = column.drop_null()
        return full.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(full), -1)

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, count = None, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            slugs, sums, n, weights = b.column(0).to_pylist(), *(b.column(k) for k in (1, 2, 3))
            n, whole = n.to_numpy(), sums.is_valid().to_numpy(zero_copy_only=False)
            own = [m for m in (vectors_of(sums) if whole.any() else None, vectors_of(weights) * n[~whole, None] if not whole.all() else None) if m is not None]
            rows = np.zeros((len(n), own[0].shape[1]))
            rows[whole], rows[~whole] = own[0] if whole.any() else 0, own[-1] if not whole.all() else 0
            first = [0, *(k for k in range(1, len(slugs)) if slugs[k] != slugs[k - 1])]
            done, means = [], []
            for slug, part, k in zip((slugs[k] for k in first), np.add.reduceat(rows, first), np.add.reduceat(n, first)):
                if total is not None and slug == now:
                    total, count = total + part, count + k
                    continue
                if total is not None:
                    done.append(now)
                    means.append(total / count)
                now, total, count = slug, part, k
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string()), pa.array(means, pa.list_(pa.float64()))], names=["slug", "mean"])
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([total / count], pa.list_(pa.float64()))], names=["slug", "mean"])

    known = rows.mapInArrow(summed, "slug string, sums array<double>, n bigint").withColumn("weights", F.lit(None).cast(kind))
    met = rows.mapInArrow(others, "slug string, token string, n bigint").join(rare, "token").select("slug", F.lit(None).cast("array<double>").alias("sums"), "n", "weights")
    means = known.unionByName(met).repartition("slug").sortWithinPartitions("slug").mapInArrow(mean, "slug string, mean array<double>")
    return means.select("slug", vectors.quantize(vectors.normalised(F.col("mean"))).alias("v"))
