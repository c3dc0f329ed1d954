"""Operations beyond search and governance: windows over events, grouping sets, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella import projection as P
from tessella.queries import query
from tessella.streaming import windows as W


@query("""select time_bucket(interval 1 hour, ts) as window_start, time_bucket(interval 1 hour, ts) + interval 1 hour as window_end, event_type, count(*) as n, sum(round(value * 100)::bigint)::bigint as cents
    from events group by all""")
def ext_tumbling(spark, sf_dir):
    return W.tumbling(P.table(spark, sf_dir, "events"), "1 hour")


@query("""with e as (select *, time_bucket(interval 30 minute, ts) as b from events), x as (select *, b - k * interval 30 minute as s from e, range(2) r(k))
    select s as window_start, s + interval 1 hour as window_end, event_type, count(*) as n, sum(round(value * 100)::bigint)::bigint as cents from x group by all""")
def ext_sliding(spark, sf_dir):
    return W.sliding(P.table(spark, sf_dir, "events"), "1 hour", "30 minutes")


@query("""with e as (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts) + interval 6 hour then 0 else 1 end as new from events),
    s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from e)
    select user_id, min(ts) as session_start, max(ts) + interval 6 hour as session_end, count(*) as n from s group by user_id, k""")
def ext_session(spark, sf_dir):
    return W.sessions(P.table(spark, sf_dir, "events"), "6 hours")


@query("select distinct user_id, event_type from events")
def ext_dedupe(spark, sf_dir):
    return W.deduplicated(P.table(spark, sf_dir, "events").select("user_id", "event_type"), ["user_id", "event_type"])


@query("select o_orderstatus, o_orderpriority, count(*) as n, grouping(o_orderstatus)::integer as g1, grouping(o_orderpriority)::integer as g2 from orders group by cube (o_orderstatus, o_orderpriority)")
def ext_cube(spark, sf_dir):
    o = P.table(spark, sf_dir, "orders")
    return o.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping("o_orderstatus").cast("int").alias("g1"), F.grouping("o_orderpriority").cast("int").alias("g2"))


@query("select l_partkey as k from lineitem where l_returnflag = 'R' intersect select l_partkey from lineitem where l_returnflag = 'A'")
def ext_intersect(spark, sf_dir):
    li = P.table(spark, sf_dir, "lineitem")
    return li.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")).intersect(li.where("l_returnflag = 'A'").select("l_partkey"))


@query("select p_partkey as k from part except select l_partkey from lineitem where l_returnflag = 'A' and l_quantity >= 45")
def ext_except(spark, sf_dir):
    li = P.table(spark, sf_dir, "lineitem").where("l_returnflag = 'A' and l_quantity >= 45")
    return P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).subtract(li.select("l_partkey"))
