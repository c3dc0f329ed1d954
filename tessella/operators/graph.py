"""Typed weighted graphs as edge lists: lifting, degrees, walks, centrality, communities.

Edges have src, dst, kind, weight. Walks keep the frontier and the visited set as stored
tables, one round of joins a step, so lineage stays short on cycles of any length.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella import constants as C
from tessella.operators.ordering import numbered, share_below
from tessella.session import durable


def lift(edges: DataFrame, home: DataFrame) -> DataFrame:
    """Edges between modules from edges between files; home: rel, module. Those within a module go."""
    a, b = home.toDF("src", "src_module"), home.toDF("dst", "dst_module")
    j = edges.join(a, "src").join(b, "dst").where("src_module <> dst_module")
    return j.groupBy(F.col("src_module").alias("src"), F.col("dst_module").alias("dst"), "kind").agg(F.sum("weight").cast("long").alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, deg_in, deg_out): one shuffle, both ends of an edge at once."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.i").alias("deg_in"), F.sum("e.o").alias("deg_out"))


def hub_threshold(degree: DataFrame, column: str = "degree") -> DataFrame:
    """One row: the degree from which a node is a hub."""
    q = F.expr(f"percentile_disc({C.HUB_QUANTILE}) within group (order by {column})")
    return degree.agg(F.greatest(F.lit(C.HUB_LEAST).cast("long"), F.coalesce(q.cast("long"), F.lit(0).cast("long"))).alias("threshold"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge from either end, with its direction as seen from `node`."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit("out").alias("direction"), *rest)
    return out.unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit("in").alias("direction"), *rest))


def neighbours(edges: DataFrame, start: list[str], depth: int = 1, kinds: list[str] | None = None, degree: DataFrame | None = None, threshold: int | None = None) -> DataFrame:
    """(node, direction, kind, weight, depth): links met walking both ways from `start`.

    A node is met at its least depth. Hubs other than the start are shown and not passed.
    """
    if kinds:
        edges = edges.where(F.col("kind").isin(kinds))
    spark = edges.sparkSession
    adjacent = both_ways(edges)
    frontier = spark.createDataFrame([(s,) for s in start], "node string")
    visited, links = frontier, None
    for step in range(1, depth + 1):
        met = adjacent.join(F.broadcast(frontier) if step == 1 else frontier, "node").where("node <> other").join(visited.select(F.col("node").alias("other")), "other", "left_anti")
        met = durable(met.select(F.col("other").alias("node"), "direction", "kind", "weight", F.lit(step).alias("depth")).distinct())
        links = met if links is None else links.unionByName(met)
        frontier = met.select("node").distinct()
        if step == depth or frontier.isEmpty():
            break
        visited = durable(visited.unionByName(frontier))
        if degree is not None and threshold is not None:
            frontier = frontier.join(degree.where(F.col("degree") >= threshold).select("node"), "node", "left_anti")
    return links


def impact(edges: DataFrame, seeds: DataFrame, kinds: list[str] | None = None, max_depth: int | None = None) -> DataFrame:
    """(node, depth) of all that depends on the seeds, directly or not; the seeds themselves stay out."""
    if kinds:
        edges = edges.where(F.col("kind").isin(kinds))
    back = durable(edges.select(F.col("dst").alias("node"), F.col("src").alias("other")).distinct())
    frontier = durable(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    reached, step = frontier, 0
    while max_depth is None or step < max_depth:
        step += 1
        met = frontier.select("node").join(back, "node").select(F.col("other").alias("node")).distinct()
        frontier = durable(met.join(reached, "node", "left_anti").withColumn("depth", F.lit(step)))
        if frontier.isEmpty():
            break
        reached = durable(reached.unionByName(frontier))
    return reached.where("depth > 0")


def impact_each(edges: DataFrame, seeds: DataFrame, kinds: list[str] | None = None, max_depth: int | None = None) -> DataFrame:
    """(slug, node, depth) as `impact` gives for the seeds (slug, node) of every slug: one walk for all of them."""
    if kinds:
        edges = edges.where(F.col("kind").isin(kinds))
    back = durable(edges.select(F.col("dst").alias("node"), F.col("src").alias("other")).distinct())
    frontier = durable(seeds.select("slug", "node").distinct().withColumn("depth", F.lit(0)))
    reached, step = frontier, 0
    while max_depth is None or step < max_depth:
        step += 1
        met = frontier.select("slug", "node").join(back, "node").select("slug", F.col("other").alias("node")).distinct()
        frontier = durable(met.join(reached, ["slug", "node"], "left_anti").withColumn("depth", F.lit(step)))
        if frontier.isEmpty():
            break
        reached = durable(reached.unionByName(frontier))
    return reached.where("depth > 0")


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = C.PAGERANK_ROUNDS, damping: float = C.DAMPING) -> DataFrame:
    """(node, rank), mean one; nodes without links out share theirs among all."""
    n = nodes.count()
    links = edges.select("src", "dst").distinct()
    out = links.groupBy("src").agg(F.count("*").alias("n_out"))
    links = durable(links.join(out, "src"))
    ranks = durable(nodes.select("node").distinct().withColumn("rank", F.lit(1.0)).join(out.select(F.col("src").alias("node"), "n_out"), "node", "left"))
    for _ in range(rounds):
        lost = ranks.where("n_out is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).collect()[0][0]
        given = links.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("n_out")).alias("given"))
        rank = (1 - damping) + damping * (F.coalesce("given", F.lit(0.0)) + F.lit(lost / max(n, 1)))
        ranks = durable(ranks.select("node", "n_out").join(given, "node", "left").select("node", rank.alias("rank"), "n_out"))
    return ranks.select("node", "rank")


def betweenness(nodes: DataFrame, edges: DataFrame, task_links: int = C.TASK_LINKS) -> DataFrame:
    """(node, betweenness) of the directed graph.

    A graph of at most `task_links` links goes to every task, which walks from some of the sources; a
    larger one is walked from all sources at once by joins, level by level. Both are exact.
    """
    links = durable(edges.select("src", "dst").where("src <> dst").distinct())
    if links.limit(task_links + 1).count() > task_links:
        return _betweenness_by_levels(nodes.select("node").distinct(), links)
    adjacent: dict[str, list[str]] = defaultdict(list)
    for r in links.orderBy("src", "dst").toLocalIterator():
        adjacent[r["src"]].append(r["dst"])
    shared = nodes.sparkSession.sparkContext.broadcast(dict(adjacent))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph, total = shared.value, defaultdict(float)
        for b in batches:
            for s in b["node"]:
                order, before, paths, far = [], defaultdict(list), defaultdict(float, {s: 1.0}), {s: 0}
                queue = deque([s])
                while queue:
                    v = queue.popleft()
                    order.append(v)
                    for w in graph.get(v, ()):
                        if w not in far:
                            far[w] = far[v] + 1
                            queue.append(w)
                        if far[w] == far[v] + 1:
                            paths[w] += paths[v]
                            before[w].append(v)
                share = defaultdict(float)
                for w in reversed(order):
                    for v in before[w]:
                        share[v] += paths[v] / paths[w] * (1 + share[w])
                    if w != s:
                        total[w] += share[w]
        yield pd.DataFrame({"node": list(total), "part": list(total.values())})

    parts = nodes.select("node").distinct().repartition("node").mapInPandas(run, "node string, part double")
    sums = parts.groupBy("node").agg(F.sum("part").alias("betweenness"))
    return nodes.select("node").distinct().join(sums, "node", "left").select("node", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def _betweenness_by_levels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Numbers of shortest paths forward, shares of them backward; a level of the walk is a stored table."""
    level = durable(nodes.select(F.col("node").alias("s"), F.col("node").alias("v"), F.lit(1.0).alias("paths")))
    levels, seen = [level], level.select("s", "v")
    while True:
        met = level.join(links, F.col("v") == F.col("src")).groupBy("s", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths"))
        level = durable(met.join(seen, ["s", "v"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
        seen = durable(seen.unionByName(level.select("s", "v")))
    share, total = None, nodes.select("node", F.lit(0.0).alias("part"))
    for depth in range(len(levels) - 1, 0, -1):
        level = levels[depth]
        own = level.withColumn("share", F.lit(0.0)) if share is None else level.join(share, ["s", "v"], "left").na.fill(0.0, ["share"])
        own = durable(own)
        total = total.unionByName(own.select(F.col("v").alias("node"), F.col("share").alias("part")))
        up = own.select("s", F.col("v").alias("dst"), (F.col("share") + 1).alias("gain"), F.col("paths").alias("below")).join(links, "dst")
        before = levels[depth - 1].select("s", F.col("v").alias("src"), "paths")
        share = up.join(before, ["s", "src"]).groupBy("s", F.col("src").alias("v")).agg(F.sum(F.col("paths") / F.col("below") * F.col("gain")).alias("share"))
    return total.groupBy("node").agg(F.sum("part").alias("betweenness"))


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, part): the smallest node of its connected component; labels are halved in distance each round."""
    both = durable(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct())
    label = durable(nodes.select("node", F.col("node").alias("part")).distinct())
    while True:
        near = both.join(label, F.col("dst") == F.col("node")).groupBy(F.col("src").alias("node")).agg(F.min("part").alias("near"))
        low = durable(label.join(near, "node", "left").select("node", "part", F.least("part", F.coalesce("near", "part")).alias("low")))
        jump = low.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        now = durable(low.join(jump, "low").select("node", "part", F.col("lower").alias("next")))
        label = now.select("node", F.col("next").alias("part"))
        if now.where("part <> next").isEmpty():
            return label


def _louvain(weights: dict[str, dict[str, float]], total: float) -> dict[str, tuple[int, str]]:
    """(size, smallest node) of the community of each node, by greedy modularity, nodes in order, levels until nothing moves."""
    members = {v: [v] for v in weights}
    graph = {v: dict(n) for v, n in weights.items()}
    while True:
        degree = {v: sum(n.values()) for v, n in graph.items()}
        home, load, moved = {v: v for v in graph}, dict(degree), False
        again = True
        while again:
            again = False
            for v in sorted(graph):
                links: dict[str, float] = defaultdict(float)
                for w, x in graph[v].items():
                    if w != v:
                        links[home[w]] += x
                load[home[v]] -= degree[v]
                gain = lambda c: links.get(c, 0.0) - load[c] * degree[v] / total  # noqa: B023, E731
                best = home[v]
                for c in sorted(links):
                    if gain(c) > gain(best) + 1e-12:
                        best = c
                if best != home[v]:
                    home[v], again, moved = best, True, True
                load[best] += degree[v]
        if not moved:
            break
        merged: dict[str, dict[str, float]] = {c: defaultdict(float) for c in set(home.values())}
        for v, n in graph.items():
            for w, x in n.items():
                merged[home[v]][home[w]] += x
        joined: dict[str, list[str]] = defaultdict(list)
        for v, own in members.items():
            joined[home[v]] += own
        graph, members = {c: dict(n) for c, n in merged.items()}, dict(joined)
    return {v: (len(own), min(own)) for own in members.values() for v in own}


def communities(nodes: DataFrame, edges: DataFrame, previous: DataFrame | None = None, task_links: int = C.TASK_LINKS) -> DataFrame:
    """(node, community) of the undirected weighted module graph, the largest community first.

    Communities keep the number of the previous one with which they share most nodes. The method is
    sequential within a connected component and knows nothing of others but the weight of the
    whole, so beyond `task_links` links every component is a task of its own; a graph of any size is
    taken, and its largest component must fit a task.
    """
    links = durable(edges.groupBy("src", "dst").agg(F.sum("weight").cast("double").alias("weight")))
    total = float(links.where("src <> dst").agg(F.sum("weight")).collect()[0][0] or 0.0) * 2 or 1.0
    rows = nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0.0).alias("weight")).distinct().unionByName(links)
    if links.limit(task_links + 1).count() > task_links:
        every = rows.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        rows = rows.join(connected(every, links).withColumnRenamed("node", "src"), "src")
    else:
        rows = rows.withColumn("part", F.lit(""))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        graph: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        for s, d, w in pdf.sort_values(["src", "dst"])[["src", "dst", "weight"]].itertuples(index=False):
            if s == d:
                graph[s]
            else:
                graph[s][d] += w
                graph[d][s] += w
        out = _louvain(graph, total)
        return pd.DataFrame({"node": list(out), "size": [x for x, _ in out.values()], "least": [x for _, x in out.values()]})

    found = durable(rows.groupBy("part").applyInPandas(run, "node string, size bigint, least string"))
    order = numbered(found.select("size", "least").distinct(), [F.desc("size"), "least"], "number")
    found = found.join(order.select("least", (F.col("number") - 1).cast("int").alias("community")), "least").select("node", "community")
    if previous is None:
        return found
    found = durable(found)
    shared = found.join(previous.select("node", F.col("community").alias("old")), "node").groupBy("community", "old").agg(F.count("*").alias("n"))
    taken, number = set(), {}
    for r in shared.orderBy(F.desc("n"), "community", "old").collect():
        if r["community"] not in number and r["old"] not in taken:
            number[r["community"]] = r["old"]
            taken.add(r["old"])
    fresh = max([-1, *taken, *[r[0] for r in previous.select(F.max("community")).collect() if r[0] is not None]]) + 1
    for r in found.select("community").distinct().orderBy("community").collect():
        if r[0] not in number:
            number[r[0]], fresh = fresh, fresh + 1
    names = found.sparkSession.createDataFrame(list(number.items()), "community int, now int")
    return found.join(F.broadcast(names), "community").select("node", F.col("now").alias("community"))


def surprises(edges: DataFrame, community: DataFrame, most: int = C.SURPRISE_EDGES) -> DataFrame:
    """Edges between communities that few edges join; pair_edges counts those of the pair."""
    a, b = community.toDF("src", "c_src"), community.toDF("dst", "c_dst")
    j = edges.join(a, "src").join(b, "dst").where("c_src <> c_dst")
    w = Window.partitionBy(F.least("c_src", "c_dst"), F.greatest("c_src", "c_dst"))
    return j.withColumn("pair_edges", F.count("*").over(w)).where(F.col("pair_edges") <= most).select("src", "dst", "kind", "weight", "c_src", "c_dst", "pair_edges")


def test_map(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(slug, tested_by): modules that test files depend on; files: rel, module, test_file."""
    tests = files.where("test_file").select(F.col("rel").alias("src"))
    code = files.where(~F.col("test_file")).select(F.col("rel").alias("dst"), "module")
    hit = edges.join(tests, "src").join(code, "dst")
    return hit.groupBy(F.col("module").alias("slug")).agg(F.array_sort(F.collect_set("src")).alias("tested_by"))


def untested(modules: DataFrame, files: DataFrame, tested: DataFrame) -> DataFrame:
    """Modules worth testing (not tail, with symbols and code that is no test) that no test reaches."""
    code = files.where((F.col("kind") == "code") & ~F.col("test_file")).select(F.col("module").alias("slug")).distinct()
    worth = modules.where((F.col("tier") <= 1) & (F.col("symbols") > 0)).join(code, "slug", "left_semi")
    return worth.join(tested.select("slug"), "slug", "left_anti")


def call_confidence(calls: DataFrame, imports: DataFrame) -> DataFrame:
    """(confidence, n): calls whose file imports the target are extracted, others inferred."""
    i = imports.select("src", "dst").distinct().withColumn("known", F.lit(True))
    j = calls.join(i, ["src", "dst"], "left")
    return j.groupBy(F.when(F.col("known"), "extracted").otherwise("inferred").alias("confidence")).agg(F.count("*").alias("n"))


def percentile(ranks: DataFrame, column: str = "rank") -> DataFrame:
    """Share of nodes strictly below: all equal ranks give 0."""
    return share_below(ranks, column)
