"""Pages of an index: one entry a module, with generated regions renewed and written ones kept, and an overview."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella import constants as C
from tessella.functions import cite
from tessella.operators import inventory, prose, status
from tessella.operators.graph import untested
from tessella.session import durable
from tessella.sources import artifacts

ORDER = ["header", "business", "code", "links", "tests", "gaps", "gotchas"]
ENTRY = "slug string, key string, type string, body string"


def _list(rows: DataFrame, group: str, line, order: list, cap: int, head: str, key: str) -> DataFrame:
    """A generated region that lists the first rows of each module and says how many more there are."""
    top = inventory.cap_per_group(rows.withColumn("text", line), [group], order, cap)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), "\n")
    body = top.groupBy(F.col(group).alias("slug")).agg(lines.alias("lines"), F.max("more").alias("more"))
    more = F.when(F.col("more") > 0, F.concat(F.lit("\n- … and "), F.col("more").cast("string"), F.lit(" more"))).otherwise("")
    return body.select("slug", F.lit(key).alias("key"), F.lit("gen").alias("type"), F.concat(F.lit(f"## {head}\n\n"), "lines", more).alias("body"))


def spec(t: dict[str, DataFrame]) -> DataFrame:
    """(slug, key, type, body) of every module's regions as they should be, stubs where people write."""
    m, f = t["modules"], t["files"]
    head = F.concat(
        F.lit("# "), "title", F.lit("\n\n`"), "path", F.lit("/` · tier "), F.col("tier").cast("string"), F.lit(" · "), F.size("members").cast("string"), F.lit(" files · "),
        F.col("symbols").cast("string"), F.lit(" symbols · "), F.col("lines").cast("string"), F.lit(" lines · degree "), (F.col("deg_in") + F.col("deg_out")).cast("string"),
    )
    out = m.select("slug", F.lit("header").alias("key"), F.lit("gen").alias("type"), head.alias("body"))
    for key in ("business", "gotchas"):
        out = out.unionByName(m.select("slug", F.lit(key).alias("key"), F.lit("human").alias("type"), F.lit(C.ENRICH_MARKER).alias("body")))
    d = inventory.cap_per_group(t["defs"], ["file"], ["line", "name"], C.CAP_SYMBOLS)
    d = d.groupBy(F.col("file").alias("rel")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda x: x["name"]), ", ").alias("names"), F.max("more").alias("hidden"))
    names = F.concat(F.lit(": "), "names", F.when(F.col("hidden") > 0, F.concat(F.lit(" … and "), F.col("hidden").cast("string"), F.lit(" more"))).otherwise(""))
    code = f.join(d, "rel", "left").withColumn("names", F.coalesce(names, F.lit("")))
    out = out.unionByName(_list(code, "module", F.concat(F.lit("- ["), "rel", F.lit("]"), "names"), ["rel"], 1000, "Code", "code"))
    e = t["module_edges"]
    links = e.select(F.col("src").alias("slug"), F.concat(F.lit("- → "), "dst", F.lit(" ("), "kind", F.lit(", "), F.col("weight").cast("string"), F.lit(")")).alias("line"), "weight")
    links = links.unionByName(e.select(F.col("dst").alias("slug"), F.concat(F.lit("- ← "), "src", F.lit(" ("), "kind", F.lit(", "), F.col("weight").cast("string"), F.lit(")")).alias("line"), "weight"))
    out = out.unionByName(_list(links, "slug", F.col("line"), [F.desc("weight"), "line"], C.CAP_LINKS, "Links", "links"))
    tests = m.select("slug", F.explode("tested_by").alias("rel"))
    out = out.unionByName(_list(tests, "slug", F.concat(F.lit("- ["), "rel", F.lit("]")), ["rel"], C.CAP_TESTED, "Tests", "tests"))
    gaps = t["file_edges"].where("dangling").join(f.select(F.col("rel").alias("src"), "module"), "src")
    return out.unionByName(_list(gaps, "module", F.concat(F.lit("- "), "src", F.lit(" → "), "dst", F.lit(" ("), "reason", F.lit(")")), ["src", "dst"], C.CAP_DANGLING, "Dangling", "gaps"))


def serialise(regions: list[tuple[str, str, str]]) -> str:
    """(type, key, body) as a page; generated regions carry a fingerprint."""
    out = []
    for kind, key, body in regions:
        mark = f" hash={hashlib.sha1(body.encode()).hexdigest()[:8]}" if kind == "gen" else ""
        out.append(f"<!-- ui:{kind} key={key}{mark} -->\n{body}\n<!-- /ui:{kind} key={key} -->")
    return "\n\n".join(out) + "\n"


def _humans(entries: DataFrame) -> DataFrame:
    """(slug, key, body): repeated keys with other bodies get a name by their body."""
    rows = entries.where("ok").select("slug", F.posexplode("regions").alias("n", "r")).where("r.type = 'human'").select("slug", "n", "r.key", "r.body").dropDuplicates(["slug", "key", "body"])
    first = F.row_number().over(Window.partitionBy("slug", "key").orderBy("n")) == 1
    return rows.withColumn("key", F.when(first, F.col("key")).otherwise(F.concat("key", F.lit("-dup-"), F.substring(F.sha1("body"), 1, 8)))).select("slug", "key", "body")


def sync(spark: SparkSession, index: str, tables: dict[str, DataFrame], entries: DataFrame | None, before: DataFrame | None) -> dict[str, list[str]]:
    """Writes all entries and the prose pointers; returns conflicts, migrations and orphans.

    entries: slug, ok, regions as stored; before: slug, members of the last index. A page whose
    fences don't fit is left as it is. A module that is new takes over the words of the gone one
    whose files it has. Pages of gone modules with words in them move to _orphaned, others go.
    """
    m = tables["modules"]
    if entries is None:
        entries = spark.createDataFrame([], "slug string, ok boolean, regions array<struct<type:string,key:string,body:string>>")
    humans, conflicts = _humans(entries), entries.where("not ok").join(m.select("slug"), "slug").select("slug")
    if before is None:
        moved = spark.createDataFrame([], "new string, old string, overlap double")
    else:
        fresh = m.select("slug", F.explode("members").alias("member")).join(entries.select("slug"), "slug", "left_anti")
        gone = before.join(m.select("slug"), "slug", "left_anti").select("slug", F.explode("members").alias("member"))
        moved = prose.migrations(gone, fresh)
    inherited = humans.join(moved.select(F.col("old").alias("slug"), "new"), "slug").select(F.col("new").alias("slug"), "key", "body")
    spread = prose.merge(spec(tables), humans.join(m.select("slug"), "slug", "left_semi"), inherited).join(conflicts, "slug", "left_anti")
    place = F.coalesce(F.array_position(F.array(*map(F.lit, ORDER)), F.col("key")).cast("int"), F.lit(0))
    rank = F.when(place > 0, place).otherwise(len(ORDER) + 1)
    pages = spread.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "key", "type", "body"))).alias("regions"))
    folder = Path(index, "encyclopedia")
    for r in pages.toLocalIterator():
        artifacts.write_if_changed(str(folder / f"{r['slug']}.md"), serialise([(x["type"], x["key"], x["body"]) for x in r["regions"]]))
    orphans = []
    taken = {r["old"] for r in moved.collect()}
    told = {r["slug"] for r in humans.where(prose.enriched(F.col("body"))).select("slug").distinct().collect()}
    for r in entries.select("slug").join(m.select("slug"), "slug", "left_anti").collect():
        page = folder / f"{r['slug']}.md"
        if r["slug"] in told and r["slug"] not in taken:
            (folder / "_orphaned").mkdir(exist_ok=True)
            page.replace(folder / "_orphaned" / page.name)
            orphans.append(r["slug"])
        else:
            page.unlink()
    old = artifacts.read(spark, index, "prose")
    digests = prose.digest(spread, "slug")
    source = prose.source_hash(m.select("slug", F.explode("members").alias("rel")), tables["files"].select("rel", "hash"), "slug")
    now = digests.join(source, "slug").join(moved.select(F.col("new").alias("slug"), F.col("old").alias("predecessor")), "slug", "left")
    empty = spark.createDataFrame([], "slug string, digest string, source string, baselined boolean")
    artifacts.write(durable(prose.carry(now, empty if old is None else old, old is None)), index, "prose")
    return {"conflicts": [r["slug"] for r in conflicts.collect()], "migrated": [f"{r['old']} -> {r['new']}" for r in moved.collect()], "orphaned": sorted(orphans)}


def overview(index: str, tables: dict[str, DataFrame], most: int = 120) -> str:
    """The index page: languages, hubs, bridges, communities, surprises, untested modules, all modules up to a cap."""
    m = tables["modules"].withColumn("degree", F.col("deg_in") + F.col("deg_out"))
    hubs = status.hubs(m, 12)
    tested = m.where(F.size("tested_by") > 0).select("slug")
    total = m.count()
    parts = [
        ("Languages", [f"- {r['lang']}: {r['n']}" for r in inventory.histogram(tables["files"].where("lang is not null"), "lang", 8).collect()]),
        ("Hubs", [f"- {r['slug']} (pr {r['pagerank']:.2f})" for r in hubs.collect()]),
        ("Bridges", [f"- {r['slug']}" for r in status.bridges(m, hubs, 8).collect()]),
        ("Architecture", [f"- {r['label']}: {r['size']} modules" for r in status.labels(m).orderBy(F.desc("size"), "community").limit(12).collect()]),
        ("Surprises", [f"- {r['src']} → {r['dst']} ({r['kind']})" for r in tables["surprises"].orderBy("pair_edges", F.desc("weight"), "src", "dst").limit(8).collect()]),
        ("Untested", [f"- {r['slug']}" for r in untested(m, tables["files"], tested).orderBy(F.desc("degree"), "slug").limit(6).collect()]),
        ("Modules", [f"- [{r['slug']}](encyclopedia/{r['slug']}.md) tier {r['tier']}" for r in m.orderBy("tier", F.desc("degree"), "slug").limit(most).collect()] + ([f"- … and {total - most} more"] if total > most else [])),
    ]
    text = "# Index\n\n" + "\n\n".join(f"## {h}\n\n" + "\n".join(rows) for h, rows in parts if rows) + "\n"
    artifacts.write_if_changed(f"{index}/INDEX.md", text)
    artifacts.write_if_changed(f"{index}/graph.mmd", artifacts.mermaid(tables["modules"], tables["module_edges"]))
    return text


def citations_of_entries(entries: DataFrame) -> DataFrame:
    """(slug, raw, path, start, end) cited in what people wrote."""
    rows = entries.select("slug", F.explode("regions").alias("r")).where((F.col("r.type") == "human") & prose.enriched(F.col("r.body")))
    return rows.select("slug", F.explode(cite.citations(F.col("r.body"))).alias("c")).select("slug", "c.*")
