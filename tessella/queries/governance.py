"""Changes, citations, claims, verdicts, prose."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella import projection as P
from tessella.operators import delta as D
from tessella.operators import grounding as G
from tessella.operators import prose as R
from tessella.operators import status as S
from tessella.queries import query


@query(f"""with {P.SPANS}, {P.HUNKS} select h.path as file, h.start, h."end", s.name, s.line, s.end_line,
    row_number() over (partition by h.path, h.start, h."end" order by s.end_line - s.line, s.line desc, s.name)::integer as position
    from hunks h join spans s on h.path = s.file and s.line <= h."end" and s.end_line >= h.start""")
def hunk_symbols_interval(spark, sf_dir):
    return D.hunk_symbols(P.hunks(spark, sf_dir), P.spans(spark, sf_dir))


@query(f"""with {P.SPANS}, {P.HUNKS}, d as (select * from spans where end_line is null)
    select h.path as file, h.start, h."end", d.name, d.line, true as approx from hunks h asof join d on h.path = d.file and h.start >= d.line""")
def hunk_symbol_asof(spark, sf_dir):
    return D.hunk_above(P.hunks(spark, sf_dir), P.spans(spark, sf_dir))


_DIFF = """diff as (select rel as path, case when rel like 'bench/%' then 'deleted' else 'modified' end as status from before)"""


@query(f"""with {P.FILES}, {P.BEFORE}, {_DIFF} select d.path, case when d.status = 'deleted' then 'deleted' when f.hash is null then 'missing' when f.hash <> b.hash then 'changed' end as problem
    from diff d join before b on d.path = b.rel left join files f on f.rel = d.path where d.status = 'deleted' or f.hash is null or f.hash <> b.hash
    union all select rel, 'unindexed' from files where rel not in (select rel from before)""")
def delta_staleness_gate(spark, sf_dir):
    f, b = P.files(spark, sf_dir).select("rel", "hash"), P.before(spark, sf_dir)
    old = b.select(F.col("rel").alias("path"), F.when(F.col("rel").startswith("bench/"), "deleted").otherwise("modified").alias("status"))
    new = f.join(b.select("rel"), "rel", "left_anti").select(F.col("rel").alias("path"), F.lit("added").alias("status"))
    diff = old.unionByName(new).withColumn("old_path", F.lit(None).cast("string"))
    return D.staleness_gate(diff, b, f)


_SIGNALS = f"""{P.FILES}, sig as (select module as slug, count(*) filter (where test_file) > 0 as exported, count(*) % 2 = 1 as test_gap, min(lines) <= 2 as dangling, max(lines) > 60 as surprise,
    count(*)::bigint as dependents, (count(*) // 4)::bigint as dependent_modules, percent_rank() over (order by sum(symbols)) as percentile from files group by module)"""
_BLAST = "case when dependents >= 20 or dependent_modules >= 5 then 'high' when dependents >= 5 or dependent_modules >= 3 then 'medium' end"


@query(f"""with {_SIGNALS}, b as (select *, {_BLAST} as blast, case when percentile >= 0.95 then 'high' when percentile >= 0.8 then 'medium' end as hub from sig),
    s as (select *, (exported::int * 25 + test_gap::int * 20 + dangling::int * 15 + case blast when 'high' then 20 when 'medium' then 10 else 0 end + case hub when 'high' then 20 when 'medium' then 10 else 0 end + surprise::int * 10)::integer as score from b)
    select slug, score, case when score >= 60 then 'HIGH' when score >= 30 then 'MEDIUM' else 'LOW' end as bucket,
    array_to_string(list_filter([case when exported then 'exported symbol changed' end, case when test_gap then 'no test covers it' end, case when dangling then 'dangling import' end,
        case when blast is not null then dependents || ' dependent files across ' || dependent_modules || ' modules (depth 2)' end,
        case hub when 'high' then 'hub module' when 'medium' then 'well-linked module' end, case when surprise then 'surprising link' end], lambda x: x is not null), '; ') as reasons from s""")
def delta_risk(spark, sf_dir):
    from pyspark.sql import Window

    f = P.files(spark, sf_dir)
    g = f.groupBy(F.col("module").alias("slug")).agg(
        (F.count_if("test_file") > 0).alias("exported"), (F.count("*") % 2 == 1).alias("test_gap"), (F.min("lines") <= 2).alias("dangling"), (F.max("lines") > 60).alias("surprise"),
        F.count("*").alias("dependents"), F.floor(F.count("*") / 4).cast("long").alias("dependent_modules"), F.sum("symbols").alias("s"),
    )
    g = g.withColumn("percentile", F.percent_rank().over(Window.orderBy("s"))).drop("s")
    return D.risk(g).withColumn("reasons", F.array_join("reasons", "; "))


@query(f"""with {P.FILES}, {P.BEFORE} select coalesce(b.rel, f.rel) as path, f.module, case when f.rel is null then 'deleted' when b.rel is null then 'unindexed' else 'indexed' end as class from before b full outer join files f on b.rel = f.rel""")
def delta_partition(spark, sf_dir):
    f, b = P.files(spark, sf_dir).select("rel", "module"), P.before(spark, sf_dir).select("rel")
    known = f.join(b, "rel", "left_semi")
    both = b.withColumn("old", F.lit(1)).join(f.select("rel").withColumn("new", F.lit(1)), "rel", "full_outer")
    diff = both.select(F.col("rel").alias("path"), F.when(F.col("new").isNull(), "deleted").otherwise("modified").alias("status"), F.lit(False).alias("binary"))
    out = D.partition(diff, known)
    return out.drop("module").join(f.select(F.col("rel").alias("path"), "module"), "path", "left").select("path", "module", "class")


# In SQL the citations of an answer follow from how it was written.
_CITED = f"""{P.FILES}, cited as (
    select doc_id, rel || ':1' as raw, rel as path, 1 as start, null::integer as "end" from files union all select doc_id, rel || ':' || (lines + 5), rel, (lines + 5)::integer, null from files
    union all select doc_id, 'no/such.txt:3', 'no/such.txt', 3, null from files union all select doc_id, rel || ':1-2', rel, 1, 2 from files
    union all select doc_id, 'Node.js', 'Node.js', null, null from files union all select doc_id, rel, rel, null, null from files)"""


@query(f'with {_CITED} select doc_id, raw, path, start, "end" from cited')
def citation_parse(spark, sf_dir):
    return G.parse(P.answers(spark, sf_dir))


@query(f"""with {_CITED} select c.doc_id, c.raw, c.path, c.start, c."end", case when f.lines is null and contains(c.path, '/') then 'unresolved' when f.lines is null then 'ignored' when c.start > f.lines or c."end" > f.lines then 'unresolved' else 'resolved' end as status,
    case when f.lines is null and contains(c.path, '/') then 'no such file in the index' when c.start > f.lines then 'line ' || c.start || ' out of range (1-' || f.lines || ')'
        when c."end" > f.lines then 'line range ' || c.start || '-' || c."end" || ' out of range (1-' || f.lines || ')' end as reason
    from cited c left join files f on c.path = f.rel""")
def citation_check(spark, sf_dir):
    return G.check(G.parse(P.answers(spark, sf_dir)), P.files(spark, sf_dir))


@query(f"""with {P.FILES}, l as (select doc_id, rel, string_split(text, chr(10)) as x, text from files),
    p as (select doc_id, 'C1' as claim_id, 'It says so [' || rel || ':1]. And [guide](' || rel || ').' as claim, rel || ':1' as citation, rel as path, x[1] as excerpt from l
        union all select doc_id, 'C3', 'Range [' || rel || ':1-2], `[in/line.ts]` [[' || rel || ']]', rel || ':1-2', rel, array_to_string(x[1:2], chr(10)) from l
        union all select doc_id, 'C3', 'Range [' || rel || ':1-2], `[in/line.ts]` [[' || rel || ']]', rel, rel, text from l)
    select doc_id, claim_id, claim, citation, path, sha1(excerpt) as digest from p where trim(excerpt) <> ''""")
def claim_pairs(spark, sf_dir):
    return G.claim_pairs(P.answers(spark, sf_dir), P.files(spark, sf_dir))


def _verdicts(spark, sf_dir):
    y = P.table(spark, sf_dir, "labels").join(P.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    v = F.when(F.col("toxic") == 1, "refuted").when(F.col("quality") == 1, "supported").otherwise("unsupported")
    return y.select(F.concat_ws("-", "source", F.col("quality").cast("string")).alias("claim_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("citation"), v.alias("verdict"), "doc_id")


_VERDICTS = """v as (select source || '-' || quality as claim_id, 'd' || doc_id as citation, case when toxic = 1 then 'refuted' when quality = 1 then 'supported' else 'unsupported' end as verdict, doc_id
    from labels join documents using (doc_id))"""


@query(f"with {_VERDICTS} select claim_id, not bool_or(verdict = 'refuted') and bool_or(verdict in ('supported', 'partial')) as ok, true as judged from v group by claim_id")
def verdict_reduce(spark, sf_dir):
    return G.reduce_verdicts(_verdicts(spark, sf_dir))


@query("""with n as (select count(*) as expected, (select count(*) from labels join documents using (doc_id)) as judged from documents) select expected, judged, judged > 0 and (judged = expected or expected > 40) as ok from n""")
def verdict_coverage(spark, sf_dir):
    d = P.table(spark, sf_dir, "documents").select(F.col("source").alias("claim"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("citation"), F.sha1("text").alias("digest"))
    v = d.join(_verdicts(spark, sf_dir).select("citation", "verdict"), "citation")
    return G.coverage(d, v)


@query(f"with {_VERDICTS} select v.claim_id, v.citation, v.verdict, case when doc_id % 3 = 0 then 'own' else sha1(text) end as digest from v join documents using (doc_id)")
def verdict_backfill(spark, sf_dir):
    v = _verdicts(spark, sf_dir).withColumn("digest", F.when(F.col("doc_id") % 3 == 0, "own").when(F.col("doc_id") % 3 == 1, ""))
    w = v.select("claim_id", "citation", "doc_id").join(P.table(spark, sf_dir, "documents").select("doc_id", F.sha1("text").alias("digest")), "doc_id")
    return G.backfill(v.drop("doc_id"), w)


@query(f"with {P.FILES}, {P.BEFORE} select b.rel as path from before b left join files f using (rel) where f.hash is distinct from b.hash")
def cited_drift(spark, sf_dir):
    b = P.before(spark, sf_dir)
    return G.drifted(b.select(F.col("rel").alias("path")), b, P.files(spark, sf_dir))


_DIGEST = f"""{P.REGIONS}, digests as (select slug, coalesce(sha1(string_agg(key || chr(0) || body, chr(10) order by key || chr(0) || body) filter (where type = 'human' and trim(body) <> '')), '') as digest from regions group by slug)"""


@query(f"with {_DIGEST} select slug, digest from digests")
def prose_digest(spark, sf_dir):
    return R.digest(P.regions(spark, sf_dir), "slug")


@query(f"""with {P.FILES}, {P.BEFORE}, m as (select module, rel from files union all select split_part(rel, '/', 1) || '-' || split_part(rel, '/', 2), rel from before where rel like 'bench/%')
    select module, sha1(string_agg(rel || chr(0) || coalesce(hash, '<deleted>'), chr(10) order by rel)) as source from m left join before using (rel) group by module""")
def prose_source_hash(spark, sf_dir):
    b = P.before(spark, sf_dir)
    gone = b.where(F.col("rel").startswith("bench/")).select(F.array_join(F.slice(F.split("rel", "/"), 1, 2), "-").alias("module"), "rel")
    return R.source_hash(P.files(spark, sf_dir).select("module", "rel").unionByName(gone), b, "module")


_STATE = f"""{_DIGEST}, st as (select d.slug, d.digest, right(d.slug, 1) as tail, case right(d.slug, 1) when '0' then null when '1' then 'other' else d.digest end as old, right(d.slug, 1) = '2' as baselined, right(d.slug, 1) <> '3' as same from digests d)"""
_FRESH = "case when digest = '' then 'none' when old is null then 'unknown' when old <> digest then 'fresh' when baselined then 'unknown' when same then 'fresh' else 'stale' end"


def _fresh(spark, sf_dir):
    d = R.digest(P.regions(spark, sf_dir), "slug").withColumn("tail", F.right("slug", F.lit(1)))
    old = F.when(F.col("tail") == "0", None).when(F.col("tail") == "1", "other").otherwise(F.col("digest"))
    state = R.freshness(F.col("digest"), old, F.lit("x"), F.col("tail") == "2", F.when(F.col("tail") == "3", "y").otherwise("x"))
    return d.select("slug", state.alias("prose"))


@query(f"with {_STATE} select slug, {_FRESH} as prose from st")
def prose_freshness(spark, sf_dir):
    return _fresh(spark, sf_dir)


@query(f"""with {_STATE}, t as (select 'm' || conv_id as slug, count(*) as degree from conversations group by 1), q as (select slug, {_FRESH} as prose, degree, case when degree > 4 then 2 else 1 end as tier from st join t using (slug)),
    r as (select *, case prose when 'stale' then 0 when 'none' then 1 else 2 end as rank from q)
    select slug, prose, degree, tier::integer as tier, rank::integer as rank, (row_number() over (order by rank, tier, degree desc, slug))::integer as position from r""")
def status_queue(spark, sf_dir):
    t = P.table(spark, sf_dir, "conversations").groupBy(F.concat(F.lit("m"), F.col("conv_id").cast("string")).alias("slug")).agg(F.count("*").alias("degree"))
    m = _fresh(spark, sf_dir).join(t, "slug").withColumn("tier", F.when(F.col("degree") > 4, 2).otherwise(1))
    return S.queue(m)


@query(f"with {_STATE}, q as (select {_FRESH} as prose from st) select count(*) as total, count(*) filter (where prose <> 'none') as enriched, count(*) filter (where prose = 'stale') as prose_stale from q")
def status_summary(spark, sf_dir):
    return S.summary(_fresh(spark, sf_dir))


@query(f"""with {P.REGIONS}, spec as (select slug, key, type, case when type = 'gen' then 'new ' || body else '<!-- ui:enrich -->' end as body from regions where key in ('t0', 't1', 't2')),
    e as (select slug, key, body from regions where type = 'human' and key <> 't2'), m as (select slug, key, body || '!' as body from regions where type = 'human' and key in ('t2', 't4', 't6')),
    k as (select slug, key from spec union select slug, key from e union select slug, key from m)
    select k.slug, case when s.type is null and e.body is null then 'migrated-' || k.key else k.key end as key, coalesce(s.type, 'human') as type,
        case when s.type = 'gen' then s.body else coalesce(e.body, m.body, s.body) end as body,
        case when s.type = 'gen' then 'generated' when e.body is not null then 'existing' when m.body is not null then 'migrated' else 'stub' end as origin
    from k left join spec s using (slug, key) left join e using (slug, key) left join m using (slug, key)""")
def region_merge(spark, sf_dir):
    r = P.regions(spark, sf_dir)
    spec = r.where("key in ('t0', 't1', 't2')").withColumn("body", F.when(F.col("type") == "gen", F.concat(F.lit("new "), "body")).otherwise("<!-- ui:enrich -->"))
    human = r.where("type = 'human'").select("slug", "key", "body")
    return R.merge(spec, human.where("key <> 't2'"), human.where("key in ('t2', 't4', 't6')").withColumn("body", F.concat("body", F.lit("!"))))


@query(f"""with {P.REGIONS} select slug, true as ok, count(*) as n_regions, count(*) filter (where type = 'human') as n_human from regions group by slug""")
def region_parse(spark, sf_dir):
    r = P.regions(spark, sf_dir).withColumn("body", F.regexp_replace("body", "[\r]", ""))
    block = F.concat(F.lit("<!-- ui:"), "type", F.lit(" key="), "key", F.lit(" -->\n"), "body", F.lit("\n<!-- /ui:"), "type", F.lit(" key="), "key", F.lit(" -->"))
    text = r.groupBy("slug").agg(F.array_join(F.array_sort(F.collect_list(block)), "\n\n").alias("text"))
    p = text.select("slug", R.regions("text").alias("p"))
    return p.select("slug", "p.ok", F.size("p.regions").cast("long").alias("n_regions"), F.size(F.filter("p.regions", lambda x: x["type"] == "human")).cast("long").alias("n_human"))


@query("""with o as (select distinct 'o' || l_orderkey as g, l_partkey as m from lineitem where l_returnflag = 'R'), n as (select distinct 'n' || l_orderkey as g, l_partkey as m from lineitem where l_linenumber <= 4),
    a as (select g, count(*) as c from o group by g), b as (select g, count(*) as c from n group by g), j as (select n.g as new, o.g as old, count(*) as n from o join n using (m) group by all)
    select new, old, n / (a.c + b.c - n)::double as overlap from j join a on a.g = old join b on b.g = new where n / (a.c + b.c - n)::double >= 0.5""")
def rename_overlaps(spark, sf_dir):
    li = P.table(spark, sf_dir, "lineitem")
    g = lambda p: F.concat(F.lit(p), F.col("l_orderkey").cast("string")).alias("slug")
    old = li.where("l_returnflag = 'R'").select(g("o"), F.col("l_partkey").alias("member"))
    new = li.where("l_linenumber <= 4").select(g("n"), F.col("l_partkey").alias("member"))
    return R.overlaps(old, new)


@query()
def rename_migrations(spark, sf_dir):
    """The greedy walk over overlaps."""
    f = P.files(spark, sf_dir)
    old = f.select(F.concat(F.lit("old-"), "module").alias("slug"), F.col("rel").alias("member"))
    new = f.where("symbols > 3").select("module", F.col("rel").alias("member")).withColumnRenamed("module", "slug")
    return R.migrations(old, new)
