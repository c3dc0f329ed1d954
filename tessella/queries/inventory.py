"""Scans, caps, rollups, differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella import projection as P
from tessella.functions import paths
from tessella.operators import inventory as I
from tessella.queries import query


@query(f"with {P.FILES} select rel, module, size, hash, lines, kind from files")
def file_inventory(spark, sf_dir):
    return P.files(spark, sf_dir).select("rel", "module", "size", "hash", "lines", "kind")


@query(f"""with {P.FILES} select rel, module from files
    where (regexp_matches(rel, '^src1[^/]*/.*[^/]*\\.txt$') or regexp_matches(rel, '^(.*/)?de/[^/]*$')) and not regexp_matches(rel, '^.*/fr/.*$')""")
def glob_filter(spark, sf_dir):
    f = P.files(spark, sf_dir)
    return f.where(paths.matches(F.col("rel"), ["src1*/**/*.txt", "**/de/*"], ["**/fr/**"])).select("rel", "module")


@query(f"with {P.FILES} select rel, size from files where size <= 4096")
def max_bytes_filter(spark, sf_dir):
    return I.cap_bytes(P.files(spark, sf_dir), F.col("size"), 4096).select("rel", "size")


@query(f"""with {P.FILES} select rel, row_number() over (order by rel) as position, (select count(*) from files) > 200 as capped from files qualify position <= 200""")
def max_files_cap(spark, sf_dir):
    return I.cap_files(P.files(spark, sf_dir).select("rel"), 200).select("rel", F.col("position").cast("long").alias("position"), "capped")


@query("select lang, count(*) as n from documents group by lang order by n desc, lang limit 8")
def language_histogram(spark, sf_dir):
    return I.histogram(P.table(spark, sf_dir, "documents"), "lang", 8)


@query(f"""with {P.FILES}, {P.COPY_EDGES}, {P.FILE_DEGREES} select module as slug, count(*) as members, sum(symbols)::bigint as symbols, sum(lines)::bigint as lines,
    sum(deg_in + deg_out)::bigint as degree from files join file_degrees using (rel) group by module""")
def module_rollup(spark, sf_dir):
    f = P.files(spark, sf_dir)
    return I.rollup_modules(P.with_degrees(f.drop("text"), P.copy_edges(f)))


@query(r"""with p as (select p_partkey, lower(replace(p_type, ' ', '/')) || '/' || case p_size % 5 when 0 then 'tests' when 1 then 'utils' when 2 then 'demo-app' when 3 then 'core' else 'docs' end as path from part)
    select p_partkey, path, case when regexp_matches(path, '(?i)(^|/)(__tests?__|tests?|e2e|docs?|examples?|specs?|fixtures?)(/|$)') then 2 when not contains(path, '/') then 0 else 1 end::integer as tier,
    case when regexp_matches(path, '(?i)(^|/|-|_)(tests?|demo|examples?|sandbox|stub|mock|fixtures?)(/|-|_|$)') then 0.55 else 1.0 end::double as path_weight,
    case when regexp_matches(string_split(path, '/')[-1], '(?i)^(stores?|components?|types?|utils?|hooks?|constants?|helpers?|styles?|assets?|queries|state)$') then 0.8 else 1.0 end::double as generic_weight from p""")
def tier_and_penalties(spark, sf_dir):
    leaf = F.element_at(F.array(*map(F.lit, ["tests", "utils", "demo-app", "core", "docs"])), (F.col("p_size") % 5 + 1).cast("int"))
    p = P.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lower(F.replace("p_type", F.lit(" "), F.lit("/"))), F.lit("/"), leaf).alias("path"))
    path = F.col("path")
    return p.select("p_partkey", "path", paths.tier(path).alias("tier"), paths.path_weight(path).alias("path_weight"), paths.generic_weight(path).alias("generic_weight"))


@query(f"""with {P.FILES}, {P.BEFORE} select coalesce(b.rel, n.rel) as rel, case when b.hash is null then 'added' when n.hash is null then 'removed' else 'changed' end as change
    from before b full outer join files n on b.rel = n.rel where b.hash is distinct from n.hash""")
def manifest_diff(spark, sf_dir):
    return I.manifest_diff(P.before(spark, sf_dir), P.files(spark, sf_dir))


@query(f"""with {P.FILES}, {P.BEFORE} select f.rel, case when b.hash = f.hash then 'reuse' else 'extract' end as action from files f left join before b on f.rel = b.rel""")
def incremental_reuse(spark, sf_dir):
    return I.reuse(P.files(spark, sf_dir).select("rel", "hash", "kind", "size"), P.before(spark, sf_dir)).select("rel", "action")


@query("select doc_id from documents where doc_id not in (select doc_id from labels where doc_id is not null)")
def missing_entries(spark, sf_dir):
    return I.without(P.table(spark, sf_dir, "documents").select("doc_id"), P.table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


def _hrefs(spark, sf_dir):
    p = P.table(spark, sf_dir, "pages")
    return p.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("place", "href"))


_HREFS = """hrefs as (select page_id, (i - 1)::integer as place, h[i] as href from (select page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) as h from pages), range(1, 10000) r(i) where i <= len(h))"""


@query(f"with {_HREFS} select page_id, place, href from hrefs")
def page_links(spark, sf_dir):
    return _hrefs(spark, sf_dir)


_REASON = "case when href like '#%' then 'missing-target' when href like '/%' then 'missing-module' when href like '../%' then 'escapes-root' when href like 'http%' then 'external' end"


@query(f"""with {_HREFS}, d as (select {_REASON} as reason from hrefs where href not in (select url from pages where url is not null))
    select coalesce(reason, 'unknown') as reason, count(*) as n from d group by 1""")
def dangling_by_reason(spark, sf_dir):
    urls = P.table(spark, sf_dir, "pages").select(F.col("url").alias("href"))
    h = F.col("href")
    reason = F.when(h.startswith("#"), "missing-target").when(h.startswith("/"), "missing-module").when(h.startswith("../"), "escapes-root").when(h.startswith("http"), "external")
    return I.count_by_reason(I.without(_hrefs(spark, sf_dir), urls, "href").withColumn("reason", reason))


@query("""with r as (select l_suppkey, l_orderkey, l_linenumber, l_quantity, row_number() over (partition by l_suppkey order by l_quantity desc, l_orderkey, l_linenumber) as position,
    greatest(count(*) over (partition by l_suppkey) - 30, 0)::bigint as more from lineitem) select l_suppkey, l_orderkey, l_linenumber, position, more from r where position <= 30""")
def links_cap_overflow(spark, sf_dir):
    li = P.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    out = I.cap_per_group(li, ["l_suppkey"], [F.desc("l_quantity"), "l_orderkey", "l_linenumber"], 30)
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", F.col("position").cast("long").alias("position"), "more")


@query("select o_custkey, o_orderkey, ((row_number() over (partition by o_custkey order by o_orderkey) - 1) // 8)::bigint as batch from orders")
def batches_of_8(spark, sf_dir):
    return I.batches(P.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 8)


@query("""with r as (select source, doc_id, n_chars, sum(n_chars) over (partition by source order by doc_id rows unbounded preceding) as used from documents)
    select source, doc_id, case when used <= 30000 then n_chars else greatest(30000 - (used - n_chars), 0) end::bigint as taken,
    case when used <= 30000 then 'whole' when used - n_chars < 30000 then 'cut' else 'dropped' end as state from r""")
def evidence_budget(spark, sf_dir):
    return I.budget_prefix(P.table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 10_000).drop("n_chars")


@query("select source, sum(ceil(n_chars / 4))::bigint as tokens, count(*) as n, grouping(source)::integer as is_total from documents group by rollup(source)")
def token_meter(spark, sf_dir):
    return I.token_meter(P.table(spark, sf_dir, "documents"), "source", "n_chars")


@query(f"""with {P.FILES} select rel, array_to_string(string_split(text, chr(10))[2:4], chr(10)) as excerpt, lines as total_lines from files""")
def read_line_range(spark, sf_dir):
    return I.line_range(P.files(spark, sf_dir), "text", 2, 4).select("rel", "excerpt", "total_lines")
