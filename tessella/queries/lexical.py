"""Words, ranking, symbols, vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella import constants as C
from tessella import projection as P
from tessella.functions import lex, vectors
from tessella.operators import search as S
from tessella.operators import symbols as Y
from tessella.queries import query
from tessella.queries import sqltext as T
from tessella.session import durable

TEXT_QUERY = "reserved license tokens"
MODULE_QUERY = "reserved src7 de license"
TERMS, MTERMS = lex.query_terms(TEXT_QUERY), lex.query_terms(MODULE_QUERY)


@query(f"""with p as (select p_partkey, {T.split("p_name || p_brand")} as l from part) select p_partkey, array_to_string({T.first_only("l")}, ' ') as parts from p""")
def split_identifier(spark, sf_dir):
    p = P.table(spark, sf_dir, "part")
    return p.select("p_partkey", F.array_join(lex.split_identifier(F.concat("p_name", "p_brand")), " ").alias("parts"))


@query(f"""with w as (select unnest(list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^a-z0-9_]+'), lambda x: x <> '')) as word from documents)
    select word, {T.stem("word")} as stem, count(*) as n from w group by word""")
def stem_terms(spark, sf_dir):
    w = P.table(spark, sf_dir, "documents").select(F.explode(lex.raw_tokens(F.lower(lex.fold(F.col("text"))))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n")).select("word", lex.stem(F.col("word")).alias("stem"), "n")


@query("select doc_id, sha1(strip_accents(text)) as folded from documents")
def fold_text(spark, sf_dir):
    return P.table(spark, sf_dir, "documents").select("doc_id", F.sha1(lex.fold(F.col("text"))).alias("folded"))


_GROUPS = ", ".join(f"('{w}', {g})" for w, g in sorted(lex.synonym_groups().items()))


@query(f"""with g(word, g) as (values {_GROUPS}), e as (select event_type, count(*) as n from events group by event_type)
    select event_type, n, coalesce((select g from g where word = event_type), (select g from g where word = {T.stem("event_type")}))::integer as synonym_group from e""")
def synonym_expand(spark, sf_dir):
    table = F.create_map(*[F.lit(x) for kv in lex.synonym_groups().items() for x in kv])
    e = P.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    word = F.col("event_type")
    return e.select("event_type", "n", F.coalesce(F.try_element_at(table, word), F.try_element_at(table, lex.stem(word))).alias("synonym_group"))


_HITS = T.hits("m", "documents", "doc_id", "text", TERMS)


@query(f"with {_HITS} select doc_id, n as n_tokens, " + ", ".join(f"c{i} as hits_{t.exact}" for i, t in enumerate(TERMS)) + " from m")
def haystack_counts(spark, sf_dir):
    h = S.with_matches(P.table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"), TERMS)
    return h.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), *[F.col("hits")[i]["count"].alias(f"hits_{t.exact}") for i, t in enumerate(TERMS)])


_SATURATED = " + ".join(f"case when c{i} > 0 then w{i} * least(1.5, 1 + ln(c{i}::double) * 0.25) else 0 end" for i in range(len(TERMS)))
_MATCHED = " || ".join(f"case when w{i} > 0 then ' {t.raw}' else '' end" for i, t in enumerate(TERMS))


@query(f"""with {_HITS}
    select doc_id, round(({_SATURATED}) / (1 + ln(greatest(1.0, n / 200.0))), 6) as score, trim({_MATCHED}) as matched from m""")
def score_haystack(spark, sf_dir):
    s = S.score_texts(P.table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"), TEXT_QUERY, saturate=True)
    return s.select("doc_id", F.round("score", 6).alias("score"), F.array_join("matched", " ").alias("matched"))


def _world(spark, sf_dir):
    f = P.files(spark, sf_dir)
    e = durable(P.copy_edges(f))
    return durable(P.modules(f, e)), P.with_degrees(f.drop("text"), e), e, f


_K = len(MTERMS)
_WORLD = f"{P.FILES}, {P.COPY_EDGES}, {P.FILE_DEGREES}, {P.MODULES}"
_JOINED = " ".join(t.exact for t in MTERMS)
_LABEL = lambda e: f"array_to_string({T.split(e)}, ' ')"
_BONUS = lambda l: f"case when {l} = '{_JOINED}' then 10.0 when starts_with({l}, '{_JOINED}') then 4.0 else 0.0 end"  # noqa: E731, E741
#: Steps of scoring in SQL. Labels have no repeated parts here, so splitting needs no removal of repeats.
_SCORED = f"""{_WORLD},
    ft as (select f.rel, f.module, d.deg_in + d.deg_out as degree, f.rel || ' ' || f.title as hay,
        {_LABEL("regexp_replace(string_split(f.rel, '/')[-1], '[.][^.]*$', '')")} as label from files f join file_degrees d on f.rel = d.rel),
    {T.hits("fx", "ft", "rel", "hay", MTERMS)},
    fw as materialized (select fx.*, module, degree, {_BONUS("label")} as bonus from fx join ft using (rel)),
    mt as (select slug, slug || ' ' || path as hay, {_LABEL("slug")} as l1, {_LABEL("path")} as l2 from modules),
    {T.hits("mx", "mt", "slug", "hay", MTERMS)},
    mw as materialized (select mx.*, greatest({_BONUS("l1")}, {_BONUS("l2")}) as bonus from mx join mt using (slug)),
    any_file as (select module, {", ".join(f"max(w{i}) as w{i}" for i in range(_K))} from fw group by module),
    seen as (select slug, {", ".join(f"(mw.w{i} > 0 or g.w{i} > 0) as a{i}" for i in range(_K))} from mw join any_file g on g.module = mw.slug),
    stats as (select count(*) as n, {", ".join(f"least(2.0, greatest(0.5, 1 + ln((count(*) + 1)::double / (count(*) filter (where a{i}) + 1)))) as idf{i}" for i in range(_K))} from seen),
    fs as (select rel, module, degree, bonus, {" + ".join(f"w{i} * idf{i}" for i in range(_K))} as score from fw, stats),
    agg as (select module as slug, max(score) as best, count(*) filter (where score > 0) as hits, max(bonus) as bonus,
        list(rel order by score desc, degree desc, rel) filter (where score > 0) as hit_files, list(rel order by degree desc, rel) as all_files from fs group by module),
    total as (select m.slug, m.path, m.title, m.tier, (m.deg_in + m.deg_out)::bigint as degree, g.hit_files, g.all_files, {", ".join(f"s.a{i}" for i in range(_K))},
        ({" + ".join(f"w.w{i} * t.idf{i}" for i in range(_K))}) as own, g.best, g.hits, greatest(w.bonus, g.bonus) * greatest(1.0, {", ".join(f"t.idf{i}" for i in range(_K))}) as bonus,
        ({" + ".join(f"s.a{i}::int" for i in range(_K))}) / {float(_K)} as coverage
        from modules m join mw w using (slug) join seen s using (slug) join agg g using (slug), stats t),
    scored as (select slug, path, title, tier, degree, round((own * 2 + best + least(hits, 5) * 0.5 + bonus) * case when tier = 2 then 0.45 else 1.0 end * (0.4 + 0.6 * coverage * coverage) + least(degree, 5) * 0.25, 3) as score,
        list_sort(list_filter([{", ".join(f"case when a{i} then '{t.raw}' end" for i, t in enumerate(MTERMS))}], lambda x: x is not null)) as matched,
        (case when len(hit_files) > 0 then hit_files else all_files end)[1:8] as files from total where own > 0 or best > 0)"""


def _flat(df):
    return df.withColumn("matched", F.array_join("matched", " ")).withColumn("files", F.array_join("files", " "))


@query(f"""with {_SCORED} select slug, path, title, tier, score, degree, array_to_string(matched, ' ') as matched, array_to_string(files, ' ') as files from scored""")
def score_modules(spark, sf_dir):
    m, f, _, _ = _world(spark, sf_dir)
    return _flat(S.score_modules(m, f, MODULE_QUERY))


@query(f"""with {_SCORED} select slug, path, title, tier, score, degree, array_to_string(matched, ' ') as matched, array_to_string(files, ' ') as files from scored order by score desc, degree desc, slug limit 8""")
def find_modules_topk(spark, sf_dir):
    m, f, _, _ = _world(spark, sf_dir)
    return _flat(S.find(m, f, MODULE_QUERY))


@query(f"""with {_SCORED}, t as (select unnest([{", ".join(f"{{'term': '{t.raw}', 'df': (select count(*) from seen where a{i}), 'idf': (select idf{i} from stats)}}" for i, t in enumerate(MTERMS))}], recursive := true))
    select term, df, round(idf, 9) as idf from t""")
def term_df_idf(spark, sf_dir):
    m, f, _, _ = _world(spark, sf_dir)
    return S.document_frequencies(m, f, MODULE_QUERY).withColumn("idf", F.round("idf", 9))


_RANKED = f"{_SCORED}, ranked as (select *, row_number() over (order by score desc, degree desc, slug) as r, max(score) over () as top from scored)"
_SEEDS = f"""{_RANKED}, gap as (select r, slug, matched from ranked where r <= 3 and score >= 0.2 * top)"""


@query(f"with {_SEEDS} select (r - 1)::integer as position, slug from gap union all select (select count(*) from gap)::integer, arg_min(slug, r) from ranked where list_contains(matched, 'license') and not exists (select 1 from gap where list_contains(matched, 'license')) having count(*) > 0")
def find_seeds(spark, sf_dir):
    m, f, _, _ = _world(spark, sf_dir)
    return S.pick_seeds(S.score_modules(m, f, MODULE_QUERY), MODULE_QUERY)


@query()
def find_expand(spark, sf_dir):
    """The rows of a query with what seeds for its terms and the graph add."""
    m, f, e, full = _world(spark, sf_dir)
    from tessella.operators.graph import lift

    return _flat(S.expand(m, lift(e, full.select("rel", "module")), S.score_modules(m, f, MODULE_QUERY), MODULE_QUERY))


@query(f"""with {_WORLD}, b as (select src as a, dst as b from module_edges union select dst, src from module_edges), r as (select a, b, row_number() over (partition by a order by b) as n from b where a <> b)
    select a as slug, string_agg(b, ' ' order by b) as neighbors from r where n <= 8 group by a""")
def module_neighbours(spark, sf_dir):
    from tessella.operators.graph import lift

    f = P.files(spark, sf_dir)
    return S.neighbour_slugs(lift(P.copy_edges(f), f.select("rel", "module"))).withColumn("neighbors", F.array_join("neighbors", " "))


def _defs(spark, sf_dir):
    li, p = P.table(spark, sf_dir, "lineitem"), P.table(spark, sf_dir, "part")
    j = li.select("l_suppkey", "l_partkey", "l_returnflag").join(p.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    return j.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("file"), F.col("p_name").alias("name"), (F.col("l_returnflag") != "R").alias("exported"))


@query("""with d as (select distinct 's' || l_suppkey as file, p_name as name from lineitem join part on l_partkey = p_partkey where l_returnflag <> 'R'),
    r as (select *, row_number() over (partition by file order by name) as n from d) select file, string_agg(name, '|' order by name) as names from r where n <= 60 group by file""")
def exported_names(spark, sf_dir):
    return Y.exported_names(_defs(spark, sf_dir)).withColumn("names", F.array_join("names", "|"))


def _lookup_sql(terms: list[str]) -> str:
    k, joined = len(terms), " ".join(terms)
    idf = ", ".join(f"ln(1 + count(*) / (1.0 + count(*) filter (where contains(flat, '{t}')))) as w{i}" for i, t in enumerate(terms))
    pre = lambda t: f"(starts_with(flat, '{t}') or starts_with(label, '{t}'))"
    tiered = " + ".join(f"case when flat = '{t}' then 1000 * w{i} when {pre(t)} then 100 * w{i} else 0 end" for i, t in enumerate(terms))
    loose = " + ".join(f"case when flat <> '{t}' and not {pre(t)} and contains(flat, '{t}') then w{i} else 0 end + case when len(list_filter(paths, lambda p: contains(p, '{t}'))) > 0 then 0.5 * w{i} else 0 end" for i, t in enumerate(terms))
    share = " + ".join(f"case when contains(flat, '{t}') or {pre(t)} then 1.0 else 0.0 end" for t in terms)
    top = "greatest(" + ", ".join(f"w{i}" for i in range(k)) + ")" if k > 1 else "w0"
    return f"""with n as (select p_name as name, lower(strip_accents(p_name)) as flat, array_to_string({T.split("p_name")}, ' ') as label, list(distinct lower(p_type)) as paths from part group by p_name),
        s as (select {idf} from n),
        c as (select name, case when flat = '{joined}' or label = '{joined}' then 10000 * {top} when {pre(joined)} then 1000 * {top} else 0 end + {loose} + ({tiered}) * (({share}) / {k}.0) * (({share}) / {k}.0) as score from n, s)
        select name, round(score, 6) as score from c where score > 0 order by round(score, 6) desc, length(name), name limit 20"""


@query(_lookup_sql([t.lower() for t in lex.keywords("small gear box")]))
def symbol_lookup(spark, sf_dir):
    defs = P.table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("file"))
    return Y.lookup(defs, "small gear box")


@query("""select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_returnflag = 'R' and l_quantity >= 40)""")
def dead_symbols(spark, sf_dir):
    defs = P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.lit("part").alias("file"))
    refs = P.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity >= 40").select(F.col("l_partkey").alias("name"), F.lit("lineitem").alias("file"))
    return Y.dead(defs, refs).select(F.col("name").alias("p_partkey"))


_Q = "list_transform(embedding, lambda x: greatest(-128, least(127, round_even(x::double * 127, 0)))::integer)"
_E = f"e as (select vec_id, {_Q} as v from embeddings), q as (select v as qv from e order by vec_id limit 1), c as (select vec_id, list_dot_product(v::double[], qv::double[]) / 16129.0 as cosine from e, q)"


def _store(spark, sf_dir):
    e = P.table(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("slug"), vectors.quantize(F.col("embedding")).alias("v"), "vec_id")


@query(f"select vec_id, array_to_string({_Q}, ' ') as v from embeddings")
def vector_quantize(spark, sf_dir):
    return _store(spark, sf_dir).select("vec_id", F.array_join(F.col("v").cast("array<string>"), " ").alias("v"))


def _first(store):
    return list(store.orderBy("vec_id").first()["v"])


@query(f"with {_E} select 'v' || vec_id as slug, cosine, (row_number() over (order by cosine desc, 'v' || vec_id))::integer as semantic_rank from c where cosine >= 0.25 order by cosine desc, slug limit 24")
def vector_topk(spark, sf_dir):
    s = _store(spark, sf_dir)
    return S.semantic_ranks(s, _first(s), C.POOL)


@query(f"""with {_E}, s as (select 'v' || vec_id as slug, row_number() over (order by cosine desc, 'v' || vec_id) as r from c where cosine >= 0.25 qualify r <= 24),
    l as (select 'v' || doc_id as slug, row_number() over (order by n_chars desc, doc_id) - 1 as r from documents qualify r < 24)
    select coalesce(s.slug, l.slug) as slug, round(coalesce(1.0 / (60 + l.r + 1), 0) + coalesce(1.0 / (60 + s.r), 0), 12) as fused, l.r::integer as lexical_rank, s.r::integer as semantic_rank
    from l full outer join s using (slug) order by fused desc, coalesce(l.r, 1000000000), slug limit 8""")
def rrf_fusion(spark, sf_dir):
    s = _store(spark, sf_dir)
    docs = P.table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(C.POOL)
    lexical = docs.select(F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("slug"), (F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")) - 1).alias("lexical_rank"))
    return S.fuse(lexical, S.semantic_ranks(s, _first(s), C.POOL), 8).select("slug", "fused", "lexical_rank", "semantic_rank")


@query(f"""with {_WORLD}, listed as (select module as slug, string_agg(rel || ' — ' || title, chr(10) order by rel) as lines from files group by module)
    select slug, sha1(substr(title || chr(10) || path || chr(10) || slug || chr(10) || members || ' file(s) in ' || path || chr(10) || listed.lines, 1, 4000)) as hash from modules join listed using (slug)""")
def module_embed_text(spark, sf_dir):
    m, f, _, _ = _world(spark, sf_dir)
    return S.embed_text(m, f).select("slug", "hash")


@query(f"""with {P.FILES}, {P.BEFORE} select f.rel as slug, case when b.hash is null then 'missing' else 'changed' end as why from files f left join before b on f.rel = b.rel where b.hash is null or b.hash <> f.hash""")
def stale_vectors(spark, sf_dir):
    texts = P.files(spark, sf_dir).select(F.col("rel").alias("slug"), "hash")
    return S.stale_vectors(texts, P.before(spark, sf_dir).withColumnRenamed("rel", "slug"))


@query()
def encode_texts(spark, sf_dir):
    """Texts as quantised means of word vectors; held against numpy in the tests."""
    docs = P.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("slug"), "text")
    voc = P.table(spark, sf_dir, "embeddings").select(F.col("embedding").alias("weights"), "vec_id")
    words = docs.select(F.explode(F.array_distinct(lex.raw_tokens(F.lower(lex.fold(F.col("text")))))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    n = voc.count()
    voc = words.select("token", F.pmod(F.xxhash64("token"), F.lit(n)).alias("vec_id")).join(voc, "vec_id").select("token", "weights")
    return S.encode(docs, voc).withColumn("v", F.array_join(F.col("v").cast("array<string>"), " "))
