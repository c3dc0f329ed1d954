"""Ranking, graphs, changes, grounding, prose: small cases with known results."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from tessella.operators import delta, graph, grounding, inventory, prose, search, status, symbols

M = "slug string, path string, title string, summary string, tier int, deg_in bigint, deg_out bigint"
FI = "rel string, module string, title string, summary string, deg_in bigint, deg_out bigint"
E = "src string, dst string, kind string, weight bigint"


def world(spark, rows):
    """rows: slug, path, tier, degree, file names."""
    m = spark.createDataFrame([(s, p, s, f"{len(f)} file(s) in `{p}/`", t, d, 0) for s, p, t, d, f in rows], M)
    f = spark.createDataFrame([(f"{p}/{x}", s, x, None, 0, 0) for s, p, t, d, fs in rows for x in fs], FI)
    return m, f


def order(df):
    return [r["slug"] for r in df.collect()]


def test_rare_terms_come_first(spark):
    rows = [(f"alpha{i}", f"src/alpha{i}", 1, 0, [f"alpha{i}.ts"]) for i in range(5)] + [("zeta", "src/zeta", 1, 0, ["zeta.ts"])]
    m, f = world(spark, rows)
    assert order(search.find(m, f, "alpha zeta"))[0] == "zeta"


def test_tests_rank_below_what_they_test(spark):
    m, f = world(spark, [("tests", "src/__tests__", 2, 0, [f"calc{i}.test.ts" for i in range(12)]), ("calc", "src/calc", 1, 0, ["calc.ts"])])
    assert order(search.find(m, f, "calc")) == ["calc", "tests"]


def test_whole_query_and_coverage(spark):
    rows = [(f"w{i}", f"src/w{i}", 1, 0, [f"widget{i}.ts"]) for i in range(5)] + [("amod", "src/amod", 1, 0, ["widgetGadget.ts"])]
    assert order(search.find(*world(spark, rows), "widget gadget"))[0] == "amod"
    rows = [("one", "src/one", 1, 0, ["quartz.ts"]), ("all", "src/all", 1, 0, ["quartz_onyx_jade.ts"])]
    assert order(search.find(*world(spark, rows), "quartz onyx jade"))[0] == "all"


def test_scoring_does_not_depend_on_partitions(spark):
    rows = [(f"m{i}", f"src/m{i}", 1, i, [f"user{i % 3}.ts", "login.ts"]) for i in range(20)]
    m, f = world(spark, rows)
    a = search.find(m, f, "login user").collect()
    assert a == search.find(m.repartition(7), f.orderBy(F.rand(1)).repartition(5), "login user").collect()


def scored(spark, rows):
    return spark.createDataFrame([(s, "p", s, 1, v, 0, m, []) for s, v, m in rows], search.RESULT)


def test_seeds(spark):
    a = scored(spark, [("a", 1.0, ["x"]), ("b", 0.5, ["x"]), ("c", 0.15, ["x"])])
    assert order(search.pick_seeds(a, "xx").orderBy("position")) == ["a", "b"]
    b = scored(spark, [("a", 1.0, []), ("b", 0.9, []), ("c", 0.8, []), ("d", 0.7, [])])
    assert order(search.pick_seeds(b, "xx").orderBy("position")) == ["a", "b", "c"]
    c = scored(spark, [("a", 1.0, ["alpha"]), ("z", 0.05, ["zeta"])])
    assert order(search.pick_seeds(c, "alpha zeta").orderBy("position")) == ["a", "z"]


def modules(spark, rows):
    return spark.createDataFrame([(s, "p", s, 1, d, 0, c) for s, d, c in rows], "slug string, path string, title string, tier int, deg_in bigint, deg_out bigint, community int")


def test_expansion_by_depth_degree_and_hub_gate(spark):
    m = modules(spark, [("smod", 2, None), ("a1mod", 3, None), ("a2mod", 1, None), ("bmod", 1, None)])
    e = spark.createDataFrame([("smod", "a1mod"), ("smod", "a2mod"), ("a1mod", "bmod")], "src string, dst string")
    s = scored(spark, [("smod", 1.0, ["xx"])])
    assert order(search.expand(m, e, s, "xx").orderBy("position")) == ["smod", "a1mod", "a2mod", "bmod"]
    m = modules(spark, [("smod", 2, None), ("hub", 60, None), ("far", 1, None)])
    e = spark.createDataFrame([("smod", "hub"), ("hub", "far")], "src string, dst string")
    assert order(search.expand(m, e, s, "xx").orderBy("position")) == ["smod", "hub"]


def test_expansion_prefers_the_seeds_community_and_is_capped(spark):
    m = modules(spark, [("smod", 2, 7), ("afar", 1, 3), ("zsame", 1, 7)])
    e = spark.createDataFrame([("smod", "afar"), ("smod", "zsame")], "src string, dst string")
    s = scored(spark, [("smod", 1.0, ["xx"])])
    assert order(search.expand(m, e, s, "xx").orderBy("position")) == ["smod", "zsame", "afar"]
    m = modules(spark, [("smod", 7, None)] + [(f"n{i}", 1, None) for i in range(7)])
    e = spark.createDataFrame([("smod", f"n{i}") for i in range(7)], "src string, dst string")
    assert len(search.expand(m, e, s, "xx", k=1).collect()) == 5


def test_hybrid_degrades_with_a_warning(spark):
    m, f = world(spark, [("auth", "src/auth", 1, 0, ["auth.ts"]), ("other", "src/other", 1, 0, ["x.ts"])])
    store = spark.createDataFrame([("other", [127, 0]), ("auth", [0, 127])], "slug string, v array<tinyint>")
    plain, warning = search.find_hybrid(m, f, "auth")
    assert order(plain) == ["auth"] and warning is None
    both, warning = search.find_hybrid(m, f, "auth", store=store, query_vector=[127, 0], store_model="a", active_model="a")
    rows = {r["slug"]: r for r in both.collect()}
    assert warning is None and rows["other"]["semantic_rank"] == 1 and rows["other"]["score"] == 0 and rows["other"]["matched"] == []
    for more in ({"query_vector": None}, {"query_vector": [1, 2], "store_model": "a", "active_model": "b"}, {"query_vector": [1, 2, 3]}):
        got, warning = search.find_hybrid(m, f, "auth", store=store, **more)
        assert warning and order(got) == ["auth"]


def test_encode_is_the_mean_of_word_vectors(spark):
    texts = spark.createDataFrame([("a", "x x y"), ("b", "y z"), ("c", "nothing")], "slug string, text string")
    voc = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "token string, weights array<double>")
    got = {r["slug"]: r["v"] for r in search.encode(texts, voc).collect()}
    n = 5**0.5
    assert got == {"a": [round(127 * 2 / n), round(127 / n)], "b": [0, 127]}


def test_symbol_tiers(spark):
    look = lambda names, q: [r["name"] for r in symbols.lookup(spark.createDataFrame([(n, f) for n, f in names], "name string, file string"), q).collect()]
    assert look([("xmlparser", "a"), ("parseConfig", "a"), ("Parse", "a")], "parse") == ["Parse", "parseConfig", "xmlparser"]
    assert look([("renderAB", "a"), ("renderA", "a")], "render") == ["renderA", "renderAB"]
    assert look([("parse", "a"), ("parser", "a")], "parse") == ["parse"]


def test_encoding_by_parts_of_the_vocabulary(spark):
    """Against plain means; repeated words, repeated tokens of the vocabulary, rows of one slug."""
    import numpy as np

    from tessella.functions import vectors

    rng = np.random.default_rng(4)
    weights = {f"w{i}": rng.normal(size=5) for i in range(30)}
    rows = [(f"t{i % 15}", " ".join(f"w{k}" for k in rng.integers(0, 40, 12)) + (" café" if i == 3 else "")) for i in range(18)] + [("none", "zzz"), ("null", None)]
    texts = spark.createDataFrame(rows, "slug string, text string")
    voc = spark.createDataFrame([(k, v.tolist()) for k, v in weights.items()] + [("w1", weights["w2"].tolist())], "token string, weights array<double>")
    ways = [{r["slug"]: r["v"] for r in search.encode(texts, voc, size).collect()} for size in (100_000, 4)]
    assert ways[0] == ways[1] and len(ways[0]) == 15
    for slug, got in ways[0].items():
        words = [w for s, t in rows if s == slug for w in t.split()]
        own = np.array([weights[w] for w in words if w in weights] + [weights["w2"] for w in words if w == "w1"])
        mean = own.mean(axis=0)
        assert got == [round(x) for x in (mean / np.linalg.norm(mean) * 127).tolist()]


def test_names_are_capped_in_order(spark):
    d = spark.createDataFrame([("f", f"n{i:03}", True) for i in range(71)] + [("f", "hidden", False), ("f", "n000", True)], "file string, name string, exported boolean")
    assert symbols.exported_names(d).collect()[0]["names"] == [f"n{i:03}" for i in range(60)]


def brute_walk(edges, start, depth, hubs=()):
    adj = {}
    for a, b in edges:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    seen, front = {start: 0}, [start]
    for d in range(1, depth + 1):
        front = [w for v in front if v == start or v not in hubs for w in adj.get(v, ())]
        front = [w for w in dict.fromkeys(front) if w not in seen]
        seen |= {w: d for w in front}
    return {k: v for k, v in seen.items() if v}


def test_walks_against_brute_force(spark):
    rng = random.Random(6)
    pairs = {(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(45)}
    e = spark.createDataFrame([(a, b, "import", 1) for a, b in pairs if a != b], E)
    d = graph.degrees(e).select("node", (F.col("deg_in") + F.col("deg_out")).alias("degree"))
    hubs = {r["node"] for r in d.where("degree >= 5").collect()}
    got = {r["node"]: r["depth"] for r in graph.neighbours(e, ["n1"], 3, degree=d, threshold=5).collect()}
    assert got == brute_walk([p for p in pairs if p[0] != p[1]], "n1", 3, hubs)
    back = {}
    for a, b in pairs:
        back.setdefault(b, set()).add(a)
    seen, front = {"n1"}, {"n1"}
    while front:
        front = {w for v in front for w in back.get(v, ())} - seen
        seen |= front
    assert {r["node"] for r in graph.impact(e, spark.createDataFrame([("n1",)], "node string")).collect()} == seen - {"n1"}


def test_pagerank_has_mean_one_and_betweenness_a_bridge(spark):
    e = spark.createDataFrame([("a", "b", "use", 1), ("b", "c", "use", 1), ("c", "d", "use", 1)], E)
    n = spark.createDataFrame([(x,) for x in "abcd"], "node string")
    r = {x["node"]: x["rank"] for x in graph.pagerank(n, e, 20).collect()}
    assert abs(sum(r.values()) - 4) < 1e-9 and r["d"] > r["a"]
    assert {x["node"]: x["betweenness"] for x in graph.betweenness(n, e).collect()} == {"a": 0.0, "b": 2.0, "c": 2.0, "d": 0.0}


def test_betweenness_query_covers_the_whole_graph(spark, sf):
    """Against shortest paths between all pairs, counted one by one."""
    from tessella import projection as P
    from tessella.queries import network

    e = P.transitions(spark, sf).select("src", "dst").union(P.links(spark, sf).select("src", "dst"))
    ahead = {}
    for a, b in e.distinct().collect():
        ahead.setdefault(a, set()).add(b)
        ahead.setdefault(b, set())
    want = dict.fromkeys(ahead, 0.0)
    for s in ahead:
        paths, level, seen = {s: [[s]]}, {s}, {s}
        while level:
            nxt = {w for v in level for w in ahead[v]} - seen
            for w in nxt:
                paths[w] = [p + [w] for v in level if w in ahead[v] for p in paths[v]]
            level, seen = nxt, seen | nxt
        for own in paths.values():
            for p in own:
                for v in p[1:-1]:
                    want[v] += 1 / len(own)
    got = {r["node"]: r["betweenness"] for r in network.betweenness(spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-5 for v in want)
    assert all(got[v] > 0 for v in want if v[0] == "n")


def _random_graph(spark, seed, n=40, m=70):
    import random

    rng = random.Random(seed)
    rows = sorted({(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}", "k", rng.randrange(1, 4)) for _ in range(m)})
    e = spark.createDataFrame(rows, "src string, dst string, kind string, weight bigint")
    return e, spark.createDataFrame([(f"n{i:02}",) for i in range(n)], "node string")


def test_large_graphs_give_what_small_ones_give(spark):
    """Walks by joins and communities by component, against the ways of one task."""
    for seed in (1, 2):
        e, n = _random_graph(spark, seed)
        one = {r["node"]: r["betweenness"] for r in graph.betweenness(n, e).collect()}
        many = {r["node"]: r["betweenness"] for r in graph.betweenness(n, e, 0).collect()}
        assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-9 for k in one) and max(one.values()) > 0
        parts = {r["node"]: r["part"] for r in graph.connected(n, e).collect()}
        for r in e.collect():
            assert parts[r["src"]] == parts[r["dst"]]
        assert all(parts[p] == p <= k for k, p in parts.items())
        few = e.where("src < 'n20' = (dst < 'n20')")
        assert sorted(map(tuple, graph.communities(n, few).collect())) == sorted(map(tuple, graph.communities(n, few, task_links=0).collect()))


def test_one_walk_for_all_seeds_is_a_walk_for_each(spark):
    e, _ = _random_graph(spark, 5)
    seeds = [("a", "n03"), ("a", "n07"), ("b", "n07"), ("c", "none")]
    for depth in (None, 2):
        got = sorted(map(tuple, graph.impact_each(e, spark.createDataFrame(seeds, "slug string, node string"), ["k"], depth).collect()))
        want = []
        for slug in "abc":
            own = spark.createDataFrame([(n,) for s, n in seeds if s == slug], "node string")
            want += [(slug, *r) for r in graph.impact(e, own, ["k"], depth).collect()]
        assert got == sorted(want) and got


def test_communities_of_two_cliques_keep_their_numbers(spark):
    e = [(f"{g}{i}", f"{g}{j}", "use", 1) for g in "ab" for i in range(4) for j in range(i)] + [("a0", "b0", "use", 1)]
    edges, n = spark.createDataFrame(e, E), spark.createDataFrame([(f"{g}{i}",) for g in "ab" for i in range(4)], "node string")
    c = {r["node"]: r["community"] for r in graph.communities(n, edges).collect()}
    assert len({c[f"a{i}"] for i in range(4)}) == 1 and len({c[f"b{i}"] for i in range(4)}) == 1 and c["a0"] != c["b0"]
    before = spark.createDataFrame([(k, 41 if k[0] == "b" else 7) for k in c], "node string, community int")
    now = {r["node"]: r["community"] for r in graph.communities(n, edges, before).collect()}
    assert now["b1"] == 41 and now["a1"] == 7
    odd = graph.surprises(edges, graph.communities(n, edges)).collect()
    assert [(r["src"], r["dst"], r["pair_edges"]) for r in odd] == [("a0", "b0", 1)]


D = "name string, file string, line bigint, end_line bigint, exported boolean"
H = "path string, start bigint, end bigint"


def test_hunks_meet_symbols(spark):
    d = spark.createDataFrame([("alpha", "f", 10, 40, True), ("beta", "f", 12, 15, False), ("gamma", "f", 60, None, True)], D)
    h = spark.createDataFrame([("f", 13, 13), ("f", 65, 66), ("f", 1, 2)], H)
    assert [r["name"] for r in delta.hunk_symbols(h, d).orderBy("position").collect()] == ["beta", "alpha"]
    assert [(r["start"], r["name"], r["approx"]) for r in delta.hunk_above(h, d).collect()] == [(65, "gamma", True)]


def test_risk(spark):
    s = "slug string, exported boolean, test_gap boolean, dangling boolean, surprise boolean, dependents bigint, dependent_modules bigint, percentile double"
    rows = [("a", True, True, True, False, 0, 0, 0.0), ("b", False, True, False, False, 6, 1, 0.0), ("c", True, True, False, False, 0, 0, 0.0), ("d", False, False, False, False, 25, 25, 0.0)]
    got = [(r["slug"], r["score"], r["bucket"]) for r in delta.risk(spark.createDataFrame(rows, s)).collect()]
    assert got[:3] == [("a", 60, "HIGH"), ("c", 45, "MEDIUM"), ("b", 30, "MEDIUM")]
    assert delta.risk(spark.createDataFrame(rows, s)).where("slug = 'd'").collect()[0]["reasons"] == ["25 dependent files across 25 modules (depth 2)"]


def test_equal_ranks_have_percentile_zero(spark):
    r = spark.createDataFrame([(str(i), 1.0) for i in range(10)], "node string, rank double")
    assert {x["percentile"] for x in graph.percentile(r).collect()} == {0.0}


def test_staleness_gate(spark):
    diff = spark.createDataFrame([("a", "modified", None), ("b", "modified", None), ("c", "deleted", None), ("e", "renamed", "old"), ("new", "added", None)], "path string, status string, old_path string")
    rec = spark.createDataFrame([(x, x) for x in ("a", "b", "c", "old", "e")], "rel string, hash string")
    cur = spark.createDataFrame([("a", "a"), ("b", "other"), ("e", "e"), ("new", "n")], "rel string, hash string")
    assert {tuple(r) for r in delta.staleness_gate(diff, rec, cur).collect()} == {("b", "changed"), ("c", "deleted"), ("old", "renamed-from"), ("new", "unindexed")}


def test_citation_check(spark):
    c = spark.createDataFrame([(1, "[src/a.ts:5] [src/a.ts:99] [src/no.ts] [Node.js] [src/a.ts:9-3]")], "doc_id int, text string")
    f = spark.createDataFrame([("src/a.ts", 20)], "rel string, lines int")
    got = {r["raw"]: r["status"] for r in grounding.check(grounding.parse(c), f).collect()}
    assert got == {"src/a.ts:5": "resolved", "src/a.ts:99": "unresolved", "src/no.ts": "unresolved", "Node.js": "ignored", "src/a.ts:9-3": "unresolved"}


def test_claim_pairs(spark):
    """Lines that can be read make a pair; blank lines, lines beyond the end, null and empty texts make none."""
    text = "One [a/x.py:1-2].\n\nTwo none.\n\nThree [a/x.py:2] [a/x.py] [b/y.md:9]"
    answers = spark.createDataFrame([(1, text), (2, None), (3, ""), (None, "n [b/y.md:1-99] [c/z.md]")], "doc_id int, text string")
    sources = spark.createDataFrame([("a/x.py", "l1\r\n\nl3"), ("b/y.md", "t"), ("c/z.md", None), ("c/z.md", " \n ")], "rel string, text string")
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    got = {(r["doc_id"], r["claim_id"], r["citation"], r["digest"]) for r in grounding.claim_pairs(answers, sources).collect()}
    assert got == {(1, "C1", "a/x.py:1-2", sha("l1\n")), (1, "C2", "a/x.py", sha("l1\n\nl3")), (None, "C1", "b/y.md:1-99", sha("t"))}
    assert grounding.claim_pairs(answers.limit(0), sources).count() == 0


def test_verdicts(spark):
    v = spark.createDataFrame([("C1", "supported"), ("C1", "refuted"), ("C2", "unsupported"), ("C3", "partial"), ("C3", "unsupported"), ("C4", None)], "claim_id string, verdict string")
    assert {r["claim_id"]: (r["ok"], r["judged"]) for r in grounding.reduce_verdicts(v).collect()} == {"C1": (False, True), "C2": (False, True), "C3": (True, True), "C4": (True, False)}
    pairs = lambda n: spark.createDataFrame([(f"c{i}", "x", "d") for i in range(n)], "claim string, citation string, digest string")
    ok = lambda p, j: grounding.coverage(pairs(p), pairs(j).withColumn("verdict", F.lit("supported"))).collect()[0]["ok"]
    assert ok(3, 3) and not ok(3, 2) and not ok(3, 0) and ok(45, 40)


def test_regions():
    gen, human = "<!-- ui:gen key=a hash=0f -->\nG\n<!-- /ui:gen key=a -->", "<!-- ui:human key=b -->\n\nH\n\n<!-- /ui:human key=b -->"
    got = prose.parse_regions(f"{gen}\n\nloose\n\n{human}\n")
    assert [(t, k[:6], b) for t, k, b in got] == [("gen", "a", "G"), ("human", "orphan", "loose"), ("human", "b", "H")]
    for bad in ("<!-- ui:gen key=a -->\nx", "<!-- /ui:gen key=a -->", f"<!-- ui:gen key=z -->\n{gen}\n<!-- /ui:gen key=z -->", gen.replace("/ui:gen", "/ui:human")):
        assert prose.parse_regions(bad) is None


def test_freshness(spark):
    rows = [("", None, None, None, "s", "none"), ("d", None, None, None, "s", "unknown"), ("d", "x", "s", None, "s", "fresh"), ("d", "d", "s", True, "s", "unknown"), ("d", "d", "s", None, "s", "fresh"), ("d", "d", "t", None, "s", "stale")]
    df = spark.createDataFrame(rows, "now string, digest string, source string, baselined boolean, live string, want string")
    assert df.where(prose.freshness(*map(F.col, ("now", "digest", "source", "baselined", "live"))) != F.col("want")).count() == 0


def test_carried_pointers(spark):
    now = spark.createDataFrame([("kept", "d", "s2", None), ("moved", "d", "s2", "old"), ("revised", "e", "s2", None), ("new", "n", "s2", None), ("stub", "", "s2", None)], "slug string, digest string, source string, predecessor string")
    before = spark.createDataFrame([("kept", "d", "s1", None), ("old", "d", "s0", True), ("revised", "d", "s1", None)], "slug string, digest string, source string, baselined boolean")
    got = {r["slug"]: (r["source"], r["baselined"]) for r in prose.carry(now, before, False).collect()}
    assert got == {"kept": ("s1", None), "moved": ("s0", True), "revised": ("s2", None), "new": ("s2", None)}


def test_source_hash_moves_with_members(spark):
    h = spark.createDataFrame([("a", "1"), ("b", "2")], "rel string, hash string")
    of = lambda *m: prose.source_hash(spark.createDataFrame([("x", r) for r in m], "slug string, rel string"), h, "slug").collect()[0]["source"]
    assert len({of("a", "b"), of("a"), of("a", "gone"), of("a", "b", "c")}) == 4 and of("a", "b") == of("b", "a")


def test_migration(spark):
    old = spark.createDataFrame([("o1", x) for x in "ab"] + [("o2", x) for x in "xy"], "slug string, member string")
    new = spark.createDataFrame([("n1", x) for x in "abc"] + [("n2", x) for x in "pq"] + [("n3", x) for x in "ab"], "slug string, member string")
    assert [(r["new"], r["old"]) for r in prose.migrations(old, new).collect()] == [("n1", "o1")]


def test_queue_puts_stale_first_and_tail_last(spark):
    m = spark.createDataFrame([("done", "fresh", 1, 9), ("stub", "none", 1, 1), ("tail", "none", 2, 99), ("lie", "stale", 1, 0)], "slug string, prose string, tier int, degree bigint")
    assert order(status.queue(m).orderBy("position")) == ["lie", "stub", "tail", "done"]


def test_caps_say_what_they_left_out(spark):
    f = spark.createDataFrame([(f"f{i}",) for i in range(5)], "rel string")
    got = inventory.cap_files(f, 3).collect()
    assert [r["rel"] for r in got] == ["f0", "f1", "f2"] and all(r["capped"] for r in got)
    assert not any(r["capped"] for r in inventory.cap_files(f, 5).collect())
    parts = spark.createDataFrame([("q", i, 400) for i in range(6)], "g string, i int, n bigint")
    assert [r["state"] for r in inventory.budget_prefix(parts, "g", "i", "n", 250).orderBy("i").collect()] == ["whole", "cut", "dropped", "dropped", "dropped", "dropped"]


def test_reuse_trusts_times_of_code_only(spark):
    s = "rel string, hash string, kind string, size bigint, mtime double"
    f = spark.createDataFrame([("code", "new", "code", 1, 1.0), ("doc", "new", "doc", 1, 1.0), ("same", "x", "doc", 2, 2.0)], s)
    c = spark.createDataFrame([("code", "old", "code", 1, 1.0), ("doc", "old", "doc", 1, 1.0), ("same", "x", "doc", 9, 9.0)], s)
    act = lambda full: {r["rel"]: r["action"] for r in inventory.reuse(f, c, full).collect()}
    assert act(False) == {"code": "reuse", "doc": "extract", "same": "reuse"} and act(True)["code"] == "extract"


def test_encode_broadcasts_no_more_than_asked(spark, monkeypatch):
    """Whatever the size of the vocabulary; words without a vector, in every text, are among them."""
    sent, plain = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda sc, value: sent.append(value) or plain(sc, value))
    texts = spark.createDataFrame([(f"t{i}", f"the of w{i} v{i % 3} v{i % 3}") for i in range(40)] + [(None, "w1 of"), (None, "w2")], "slug string, text string")
    voc = spark.createDataFrame([(f"w{i}", [1.0, 0.0]) for i in range(40)] + [(f"v{i}", [0.0, 1.0]) for i in range(3)], "token string, weights array<float>")
    got = {r["slug"]: r["v"] for r in search.encode(texts, voc, 3).collect()}
    assert sum(len(value[0]) for value in sent) <= 3
    assert got == {f"t{i}": [57, 114] for i in range(40)} | {None: [127, 0]}
    assert {r["slug"]: r["v"] for r in search.encode(texts, voc).collect()} == got


def _join_rows(node) -> list[int]:
    """Rows that the joins of an executed plan gave."""
    name = node.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        below = [node.executedPlan()]
    elif name.endswith("QueryStage"):
        below = [node.plan()]
    else:
        below = [node.children().apply(i) for i in range(node.children().size())]
    own = [node.metrics().apply("numOutputRows").value()] if "Join" in name else []
    return own + [n for x in below for n in _join_rows(x)]


def test_overlaps_move_no_pairs_that_fall_short(spark):
    """60 x 60 groups with one member in common, and one pair of equal ones."""
    rows = lambda p: [(f"{p}{i}", m) for i in range(60) for m in (0, *(100 * i + k + (50 if p == "n" else 0) for k in range(1, 6)))] + [(f"{p}same", f) for f in (7001, 7002)]
    old, new = (spark.createDataFrame(rows(p), "slug string, member bigint") for p in "on")
    found = prose.overlaps(old, new)
    assert [tuple(r) for r in found.collect()] == [("nsame", "osame", 1.0)]
    assert max(_join_rows(found._jdf.queryExecution().executedPlan())) < 60


def test_overlaps_against_all_pairs(spark):
    """Groups of 1 to 150 members, rows twice, members that are null and count, slugs that are null and don't."""
    rng = random.Random(6)
    rows = {"o": [], "n": []}
    for p in "on":
        for i in range(80):
            size = rng.choice([1, 2, 3, 5, 8, 100, 150])
            rows[p] += [(f"{p}{i}", str(m)) for m in rng.sample(range(size + rng.choice([1, 3, 40])), size)]
        rows[p] += rows[p][::3] + [(f"{p}1", None), (f"{p}2", None), (None, "1"), (None, "2")]
    frames = [spark.createDataFrame(rows[p], "slug string, member string") for p in "on"]
    sets = [{s: {m for k, m in rows[p] if k == s} for s, _ in rows[p] if s} for p in "on"]
    for least in (0.2, 0.5, 0.9):
        want = {}
        for o, a in sets[0].items():
            for n, b in sets[1].items():
                if (both := len((a & b) - {None})) and both / (len(a) + len(b) - both) >= least:
                    want[n, o] = both / (len(a) + len(b) - both)
        got = {(r["new"], r["old"]): r["overlap"] for r in prose.overlaps(*frames, least).collect()}
        assert got == want and want
