"""The registered queries of the ten operators and the pipeline, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontaminate, exact, language, lines, mixing, neardup, secrets, tokens, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return warc.audit(pages, warc.injected(pages))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_common_lines(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [
        op1_secret_scan, op2_warc_fixity, op3_token_counts, op4_near_dedup, op5_exact_dedup,
        op6_language_id, op7_line_dedup, op8_toxicity, op9_decontamination, op10_source_mixing, pipeline,
    ]
    return {f.__name__: f for f in ops}


_RECORD = r"""'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
    || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::varchar, '') || '>' || chr(13) || chr(10) || 'Content-Length: '
    || strlen(coalesce(html, ''))::varchar || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)"""

OP2 = f"""
with b0 as (
    select page_id, url, case when md5(page_id::varchar) < '10' then html || chr(0) else html end as html
    from pages where not coalesce(md5(page_id::varchar) between 'f0' and 'f7z', false)
    union all select page_id, url, html from pages where md5(page_id::varchar) >= 'f8'),
a as (select page_id, strlen({_RECORD}) as length, sha256({_RECORD}) as digest from pages),
b as (select page_id, strlen({_RECORD}) as length, sha256({_RECORD}) as digest from b0),
am as (select *, page_id // 64 as leaf, page_id // 4096 as file,
    sum(length) over (partition by page_id // 4096 order by page_id, digest rows unbounded preceding) - length as off,
    row_number() over (partition by page_id order by digest) as copy from a),
bm as (select *, page_id // 64 as leaf, page_id // 4096 as file, row_number() over (partition by page_id order by digest) as copy from b)
select coalesce(x.page_id, y.page_id) as page_id,
    case when y.digest is null then 'missing' when x.digest is null then 'extra' else 'corrupt' end as status,
    coalesce(x.leaf, y.leaf)::bigint as leaf, coalesce(x.file, y.file)::bigint as file, x.off::bigint as expected_offset,
    x.length::bigint as expected_length, y.length::bigint as actual_length, x.digest as expected_sha256, y.digest as actual_sha256
from am x full outer join bm y on x.page_id = y.page_id and x.copy = y.copy
where x.digest is distinct from y.digest
"""

OP5 = """
select doc_id,
    case when text is null then doc_id else min(doc_id) over (partition by text) end as group_id,
    text is null or row_number() over (partition by text order by doc_id) = 1 as keep
from documents
"""

OP7 = r"""
with parts as (
    select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i
    from documents where text is not null),
lines as (select *, trim(regexp_replace(lower(line), '[ \t\r\f\v]+', ' ', 'g')) as norm from parts),
common as (
    select norm from lines where norm <> '' group by norm
    having count(distinct doc_id) + count(distinct case when doc_id is null then text end) > 10),
once as (select distinct text, line, norm, i from lines),
cleaned as (
    select l.text, coalesce(string_agg(l.line, chr(10) order by l.i) filter (where c.norm is null), '') as new, count(c.norm) as n
    from once l left join common c on l.norm = c.norm group by l.text)
select d.doc_id, case when c.n > 0 then c.new else d.text end as text, d.lang, d.source,
    case when c.n > 0 then length(c.new) else d.n_chars end::bigint as n_chars
from documents d left join cleaned c on d.text = c.text
"""

OP10 = r"""
with t0 as (select doc_id, source, trim(regexp_replace(coalesce(text, ''), '[ \t\r\n]+', ' ', 'g')) as s, md5('mix-1' || coalesce(doc_id::varchar, '')) as key from documents),
t as (select doc_id, source, key, case when s = '' then 0 else length(s) - length(replace(s, ' ', '')) + 1 end::bigint as n_tokens,
    case source when 'src0' then 4.0 when 'src1' then 2.0 when 'src2' then 2.0 else 1.0 end::double as weight from t0),
f as (select *, sum(n_tokens) over (partition by source order by key, doc_id rows unbounded preceding)::double / weight as virtual_finish from t),
r as (select *, sum(n_tokens) over (order by virtual_finish, source nulls first, key, doc_id rows unbounded preceding)::bigint as running_tokens from f)
select doc_id, source, n_tokens, virtual_finish, running_tokens from r
where running_tokens <= (select floor(sum(n_tokens) * 0.5) from t)
"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    out = {"op2_warc_fixity": OP2, "op5_exact_dedup": OP5, "op7_line_dedup": OP7, "op10_source_mixing": OP10}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
