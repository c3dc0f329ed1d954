"""The engine's tables (files, modules, edges, symbols, ...) seen in the test tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file of the module source-language."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), "doc_id", F.lit(".txt"))).alias("rel"),
        F.concat_ws("-", "source", "lang").alias("module"), F.substring_index("text", "\n", 1).alias("title"),
        F.lit(None).cast("string").alias("summary"), F.octet_length("text").cast("long").alias("size"), F.sha1("text").alias("hash"),
        F.size(F.split("text", "\n")).cast("long").alias("lines"), (F.length("text") - F.length(F.replace("text", F.lit("."), F.lit("")))).cast("long").alias("symbols"),
        F.when(F.col("lang") == "de", "doc").otherwise("code").alias("kind"), (F.col("lang") == "es").alias("test_file"), "text",
    )


FILES = """files as (select doc_id, source || '/' || lang || '/d' || doc_id || '.txt' as rel, source || '-' || lang as module,
    string_split(text, chr(10))[1] as title, strlen(text)::bigint as size, sha1(text) as hash,
    len(string_split(text, chr(10)))::bigint as lines, (length(text) - length(replace(text, '.', '')))::bigint as symbols,
    case when lang = 'de' then 'doc' else 'code' end as kind, lang = 'es' as test_file, text from documents)"""


def copy_edges(f: DataFrame) -> DataFrame:
    """An import from every file to the first with the same content."""
    first = f.groupBy("hash").agg(F.min_by("rel", "doc_id").alias("dst"), F.count("*").alias("n")).where("n > 1")
    j = f.select("rel", "hash").join(first, "hash").where("rel <> dst")
    return j.select(F.col("rel").alias("src"), "dst", F.lit("import").alias("kind"), F.lit(1).cast("long").alias("weight"))


COPY_EDGES = """copy_edges as (select f.rel as src, g.dst, 'import' as kind, 1::bigint as weight from files f
    join (select hash, arg_min(rel, doc_id) as dst, count(*) as n from files group by hash having count(*) > 1) g using (hash) where f.rel <> g.dst)"""


def with_degrees(f: DataFrame, edges: DataFrame) -> DataFrame:
    """Files with the degrees their edges give them."""
    from tessella.operators.graph import degrees

    d = degrees(edges).withColumnRenamed("node", "rel")
    return f.join(d, "rel", "left").na.fill(0, ["deg_in", "deg_out"])


FILE_DEGREES = """file_degrees as (select rel, (select count(*) from copy_edges e where e.dst = f.rel)::bigint as deg_in,
    (select count(*) from copy_edges e where e.src = f.rel)::bigint as deg_out from files f)"""


def modules(f: DataFrame, edges: DataFrame) -> DataFrame:
    """Modules of files, with degrees in the lifted graph."""
    from tessella.operators.graph import degrees, lift

    lifted = lift(edges, f.select("rel", "module"))
    d = degrees(lifted).withColumnRenamed("node", "slug")
    m = f.groupBy(F.col("module").alias("slug")).agg(F.count("*").alias("members"), F.sum("symbols").alias("symbols"), F.sum("lines").alias("lines"))
    m = m.join(d, "slug", "left").na.fill(0, ["deg_in", "deg_out"])
    path = F.replace("slug", F.lit("-"), F.lit("/"))
    return m.select(
        "slug", path.alias("path"), F.upper("slug").alias("title"), F.concat(F.col("members").cast("string"), F.lit(" file(s) in "), path).alias("summary"),
        F.when(F.col("slug").endswith("-es"), 2).otherwise(1).cast("int").alias("tier"), "members", "symbols", "lines", "deg_in", "deg_out",
    )


MODULES = """module_edges as (select a.module as src, b.module as dst, e.kind, sum(e.weight)::bigint as weight from copy_edges e
        join files a on e.src = a.rel join files b on e.dst = b.rel where a.module <> b.module group by all),
    modules as (select m.*, replace(slug, '-', '/') as path, upper(slug) as title, case when slug like '%-es' then 2 else 1 end::integer as tier,
        (select count(*) from module_edges e where e.dst = m.slug)::bigint as deg_in, (select count(*) from module_edges e where e.src = m.slug)::bigint as deg_out
        from (select module as slug, count(*) as members, sum(symbols)::bigint as symbols, sum(lines)::bigint as lines from files group by module) m)"""


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to brand, one edge for each return flag, weighted by lines."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    j = li.select("l_suppkey", "l_partkey", "l_returnflag").join(p.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return j.groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.col("p_brand").alias("dst"), F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("weight"))


TRADE = """trade as (select 's' || l_suppkey as src, p_brand as dst, l_returnflag as kind, count(*) as weight
    from lineitem join part on l_partkey = p_partkey group by all)"""


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of event follows which for the same user: a small graph with cycles."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    j = e.select("user_id", "event_type", F.lead("event_type").over(w).alias("next")).where("next is not null")
    return j.groupBy(F.col("event_type").alias("src"), F.col("next").alias("dst")).agg(F.count("*").alias("weight")).withColumn("kind", F.lit("use"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of places: suppliers and customers use nations, nations regions."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    s = table(spark, sf_dir, "supplier").select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst"))
    c = table(spark, sf_dir, "customer").select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst"))
    n = table(spark, sf_dir, "nation").select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst"))
    return s.unionByName(c).unionByName(n).withColumn("kind", F.lit("use")).withColumn("weight", F.lit(1).cast("long"))


LINKS = """links as (select 's' || s_suppkey as src, 'n' || s_nationkey as dst from supplier union all select 'c' || c_custkey, 'n' || c_nationkey from customer
    union all select 'n' || n_nationkey, 'r' || n_regionkey from nation)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of a conversation as a definition with the characters it covers; the assistant's have no end."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("text")).over(w)
    c = c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("file"), F.concat("role", F.lit("_"), F.col("turn").cast("string")).alias("name"), (end - F.length("text") + 1).cast("long").alias("line"), end.cast("long").alias("last"), "role")
    return c.select("file", "name", "line", F.when(F.col("role") != "assistant", F.col("last")).alias("end_line"), (F.col("role") == "user").alias("exported"), "role")


SPANS = """spans as (select 'c' || conv_id as file, role || '_' || turn as name, (e - length(text) + 1)::bigint as line,
    case when role <> 'assistant' then e end::bigint as end_line, role = 'user' as exported, role
    from (select *, sum(length(text)) over (partition by conv_id order by turn rows unbounded preceding) as e from conversations))"""


def hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed characters of every conversation: ten in each block of 150."""
    size = table(spark, sf_dir, "conversations").groupBy(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("path")).agg(F.sum(F.length("text")).alias("n"))
    starts = size.select("path", F.explode(F.sequence(F.lit(5).cast("long"), F.greatest(F.lit(5).cast("long"), F.col("n")), F.lit(150).cast("long"))).alias("start"))
    return starts.select("path", "start", (F.col("start") + 9).alias("end"))


HUNKS = """hunks as (select path, s as start, s + 9 as "end" from (select path, unnest(range(5, greatest(5, n) + 1, 150)) as s
    from (select 'c' || conv_id as path, sum(length(text))::bigint as n from conversations group by conv_id)))"""


def before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel, hash) of an older scan: the labelled documents, toxic ones as they were, and the benchmark, gone since."""
    f, y = files(spark, sf_dir), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    old = f.join(y, "doc_id").select("rel", F.when(F.col("toxic") == 1, F.sha1(F.concat("text", F.lit("!")))).otherwise(F.col("hash")).alias("hash"))
    b = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("bench/b"), F.col("item_id").cast("string"), F.lit(".txt")).alias("rel"), F.sha1("text").alias("hash"))
    return old.unionByName(b)


BEFORE = """before as (select rel, case when toxic = 1 then sha1(text || '!') else hash end as hash from files join labels using (doc_id)
    union all select 'bench/b' || item_id || '.txt', sha1(text) from benchmark)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an answer that cites: a right line, one out of range, a missing file, prose, and code."""
    f = files(spark, sf_dir)
    line = F.concat_ws(
        "", F.lit("# Heading\n\nIt says so ["), "rel", F.lit(":1]. And [guide]("), "rel", F.lit(").\n\n- Too far ["), "rel", F.lit(":"), (F.col("lines") + 5).cast("string"),
        F.lit("], missing [no/such.txt:3] and [Node.js].\n\n```\n[in/code.ts:1]\n```\nRange ["), "rel", F.lit(":1-2], `[in/line.ts]` [["), "rel", F.lit("]]"),
    )
    return f.select("doc_id", line.alias("text"))


ANSWERS = """answers as (select doc_id, '# Heading' || chr(10) || chr(10) || 'It says so [' || rel || ':1]. And [guide](' || rel || ').' || chr(10) || chr(10) || '- Too far [' || rel || ':' || (lines + 5)
    || '], missing [no/such.txt:3] and [Node.js].' || chr(10) || chr(10) || '```' || chr(10) || '[in/code.ts:1]' || chr(10) || '```' || chr(10) || 'Range [' || rel || ':1-2], `[in/line.ts]` [[' || rel || ']]' as text from files)"""


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as regions of an entry: the user's are human, the assistant's generated."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat(F.lit("m"), F.col("conv_id").cast("string")).alias("slug"), F.when(F.col("role") == "user", "human").otherwise("gen").alias("type"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("key"), F.col("text").alias("body"))


REGIONS = """regions as (select 'm' || conv_id as slug, case when role = 'user' then 'human' else 'gen' end as type, 't' || turn as key, text as body from conversations)"""
