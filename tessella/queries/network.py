"""Graphs: lifting, degrees, walks, centrality, communities, tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella import constants as C
from tessella import projection as P
from tessella.operators import graph as G
from tessella.operators import status as S
from tessella.queries import query


def _home(spark, sf_dir):
    s, p = P.table(spark, sf_dir, "supplier"), P.table(spark, sf_dir, "part")
    a = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("rel"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("module"))
    return a.unionByName(p.select(F.col("p_brand").alias("rel"), F.col("p_brand").alias("module")).distinct())


_HOME = "home as (select 's' || s_suppkey as rel, 'n' || s_nationkey as module from supplier union all select distinct p_brand, p_brand from part)"
_LIFTED = f"""{P.TRADE}, {_HOME}, lifted as (select a.module as src, b.module as dst, e.kind, sum(e.weight)::bigint as weight
    from trade e join home a on e.src = a.rel join home b on e.dst = b.rel where a.module <> b.module group by all)"""


def _lifted(spark, sf_dir):
    return G.lift(P.trade_edges(spark, sf_dir), _home(spark, sf_dir))


@query(f"with {_LIFTED} select src, dst, kind, weight from lifted")
def module_edge_lift(spark, sf_dir):
    return _lifted(spark, sf_dir)


_DEGREES = "deg as (select node, sum(i)::bigint as deg_in, sum(o)::bigint as deg_out from (select src as node, 0 as i, 1 as o from {t} union all select dst, 1, 0 from {t}) group by node)"


@query(f"with {P.TRADE}, {_DEGREES.format(t='trade')} select node, deg_in, deg_out from deg")
def degree_in_out(spark, sf_dir):
    return G.degrees(P.trade_edges(spark, sf_dir))


@query(f"with {P.TRADE}, {_DEGREES.format(t='trade')} select greatest(50, quantile_disc(deg_in + deg_out, 0.99))::bigint as threshold from deg")
def hub_threshold(spark, sf_dir):
    d = G.degrees(P.trade_edges(spark, sf_dir))
    return G.hub_threshold(d.select((F.col("deg_in") + F.col("deg_out")).alias("degree")))


@query(f"with {P.TRADE} select distinct dst as node, 'out' as direction, kind, weight, 1::integer as depth from trade where src = 's1' and kind in ('A', 'N')")
def neighbours_by_kind(spark, sf_dir):
    return G.neighbours(P.trade_edges(spark, sf_dir), ["s1"], 1, ["A", "N"])


@query(f"""with {P.LINKS}, {_DEGREES.format(t='links')}, adj as (select src as a, dst as b, 'out' as direction from links union all select dst, src, 'in' from links),
    d1 as (select distinct b as node, direction, 1 as depth from adj where a = 's1' and b <> 's1'),
    d2 as (select distinct adj.b as node, adj.direction, 2 as depth from d1 join deg using (node) join adj on adj.a = d1.node where deg_in + deg_out < 80 and adj.b <> 's1' and adj.b not in (select node from d1)),
    d3 as (select distinct adj.b as node, adj.direction, 3 as depth from (select distinct node from d2) d join deg using (node) join adj on adj.a = d.node where deg_in + deg_out < 80 and adj.b <> 's1' and adj.b not in (select node from d1) and adj.b not in (select node from d2))
    select node, direction, 'use' as kind, 1::bigint as weight, depth::integer as depth from (select * from d1 union all select * from d2 union all select * from d3)""")
def neighbours_hub_gated(spark, sf_dir):
    e = P.links(spark, sf_dir)
    d = G.degrees(e).select("node", (F.col("deg_in") + F.col("deg_out")).alias("degree"))
    return G.neighbours(e, ["s1"], 3, degree=d, threshold=80)


@query(f"""with recursive {P.LINKS}, walk as (select src as node, 1 as depth from links where dst = 'r1' union all select links.src, depth + 1 from walk join links on links.dst = walk.node)
    select node, min(depth)::integer as depth from walk group by node""")
def impact_closure(spark, sf_dir):
    return G.impact(P.links(spark, sf_dir), spark.createDataFrame([("r1",)], "node string"))


@query("""with recursive t as (select distinct event_type as src, lead(event_type) over (partition by user_id order by ts, event_id) as dst from events),
    walk as (select src as node, 1 as depth from t where dst = 'purchase' union select t.src, depth + 1 from walk join t on t.dst = walk.node where depth < 6)
    select node, min(depth)::integer as depth from walk where node <> 'purchase' group by node""")
def impact_on_cycles(spark, sf_dir):
    return G.impact(P.transitions(spark, sf_dir), spark.createDataFrame([("purchase",)], "node string"), kinds=["use"])


def _rank_sql(rounds: int) -> str:
    parts = [f"""{P.LINKS}, nodes as (select src as node from links union select dst from links), o as (select src, count(*) as n from (select distinct src, dst from links) group by src),
        l as (select distinct links.src, links.dst, o.n from links join o using (src)), n as (select count(*) as n from nodes), r0 as (select node, 1.0::double as rank from nodes)"""]
    for i in range(1, rounds + 1):
        parts.append(f"""g{i} as (select l.dst as node, sum(r.rank / l.n) as given from l join r{i - 1} r on r.node = l.src group by 1),
            x{i} as (select coalesce(sum(rank), 0) as lost from r{i - 1} where node not in (select src from o)),
            r{i} as materialized (select node, 0.15 + 0.85 * (coalesce(given, 0) + lost / n.n) as rank from nodes left join g{i} using (node), x{i}, n)""")
    return ", ".join(parts)


@query(f"with {_rank_sql(C.PAGERANK_ROUNDS)} select node, round(rank, 6) as rank from r{C.PAGERANK_ROUNDS}")
def pagerank(spark, sf_dir):
    e = P.links(spark, sf_dir)
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return G.pagerank(nodes, e).select("node", F.round("rank", 6).alias("rank"))


@query("select c_custkey as node, percent_rank() over (order by c_acctbal) as percentile from customer")
def rank_percentile(spark, sf_dir):
    c = P.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.col("c_acctbal").alias("rank"))
    return G.percentile(c).select("node", "percentile")


_COMMUNITY = "com as (select 's' || s_suppkey as node, s_nationkey as community from supplier union all select distinct p_brand, 100 + replace(p_brand, 'Brand#', '')::integer from part)"


def _fixed_communities(spark, sf_dir):
    s, p = P.table(spark, sf_dir, "supplier"), P.table(spark, sf_dir, "part")
    a = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"), F.col("s_nationkey").alias("community"))
    return a.unionByName(p.select(F.col("p_brand").alias("node"), (F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int") + 100).alias("community")).distinct())


@query(f"""with {P.TRADE}, {_COMMUNITY}, j as (select l.*, a.community as c_src, b.community as c_dst, count(*) over (partition by least(a.community, b.community), greatest(a.community, b.community)) as pair_edges
    from trade l join com a on l.src = a.node join com b on l.dst = b.node where a.community <> b.community) select src, dst, kind, weight, c_src, c_dst, pair_edges from j where pair_edges <= 6""")
def surprises(spark, sf_dir):
    return G.surprises(P.trade_edges(spark, sf_dir), _fixed_communities(spark, sf_dir), most=6)


def _tested(spark, sf_dir):
    f = P.files(spark, sf_dir).drop("text")
    e = f.alias("a").where("test_file").select(F.col("rel").alias("src"), F.col("module").alias("m"))
    code = f.where(~F.col("test_file")).groupBy(F.replace("module", F.regexp_extract("module", "-[a-z]+$", 0), F.lit("-es")).alias("m")).agg(F.min("rel").alias("dst"))
    return G.test_map(e.join(code, "m").select("src", "dst"), f), f


_TESTED = f"""{P.FILES}, code as (select regexp_replace(module, '-[a-z]+$', '-es') as m, min(rel) as dst from files where not test_file group by 1),
    tested as (select b.module as slug, string_agg(distinct a.rel, ' ' order by a.rel) as tested_by from files a join code c on a.module = c.m join files b on b.rel = c.dst where a.test_file group by 1)"""


@query(f"with {_TESTED} select slug, tested_by from tested")
def test_map(spark, sf_dir):
    return _tested(spark, sf_dir)[0].withColumn("tested_by", F.array_join("tested_by", " "))


@query(f"with {_TESTED} select module as slug from files group by module having not module like '%-es' and sum(symbols) > 0 and count(*) filter (where kind = 'code' and not test_file) > 0 and module not in (select slug from tested)")
def untested_modules(spark, sf_dir):
    tested, f = _tested(spark, sf_dir)
    m = f.groupBy(F.col("module").alias("slug")).agg(F.sum("symbols").alias("symbols")).withColumn("tier", F.when(F.col("slug").endswith("-es"), 2).otherwise(1))
    return G.untested(m, f, tested).select("slug")


@query(f"with {P.TRADE} select case when i.src is null then 'inferred' else 'extracted' end as confidence, count(*) as n from trade c left join (select distinct src, dst from trade where kind = 'R') i using (src, dst) where c.kind = 'A' group by 1")
def call_confidence(spark, sf_dir):
    t = P.trade_edges(spark, sf_dir)
    return G.call_confidence(t.where("kind = 'A'"), t.where("kind = 'R'"))


def _nodes(e):
    return e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


@query()
def louvain_communities(spark, sf_dir):
    e = _lifted(spark, sf_dir)
    return G.communities(_nodes(e), e)


@query()
def betweenness(spark, sf_dir):
    e = P.transitions(spark, sf_dir).unionByName(P.links(spark, sf_dir).select("src", "dst", "weight", "kind"))
    return G.betweenness(_nodes(e), e).withColumn("betweenness", F.round("betweenness", 6))


def _ranked_modules(spark, sf_dir):
    e = P.links(spark, sf_dir)
    d = G.degrees(e).select(F.col("node").alias("slug"), (F.col("deg_in") + F.col("deg_out")).alias("degree"))
    return d.withColumn("community", F.length("slug")).withColumn("pagerank", F.col("degree").cast("double")).withColumn("betweenness", F.when(F.col("slug").startswith("n"), F.col("degree")).otherwise(0).cast("double"))


_D = f"{P.LINKS}, {_DEGREES.format(t='links')}, m as (select node as slug, deg_in + deg_out as degree, length(node) as community from deg)"


@query(f"with {_D} select slug, degree from m order by degree desc, slug limit 12")
def index_hubs(spark, sf_dir):
    return S.hubs(_ranked_modules(spark, sf_dir), 12).select("slug", "degree")


@query(f"with {_D}, h as (select slug from m order by degree desc, slug limit 12) select slug, degree from m where slug like 'n%' and slug not in (select slug from h) order by degree desc, slug limit 8")
def index_bridges(spark, sf_dir):
    m = _ranked_modules(spark, sf_dir)
    return S.bridges(m, S.hubs(m, 12), 8).select("slug", "degree")


@query(f"with {_D} select community::integer as community, first(slug order by degree desc, slug) as label, count(*) as size from m group by community")
def community_labels(spark, sf_dir):
    return S.labels(_ranked_modules(spark, sf_dir))
