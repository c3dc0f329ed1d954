"""Reading an index: status, dossiers, evidence for a question, risk of a change, checks."""

from __future__ import annotations

import json
import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella import constants as C
from tessella.operators import delta, graph, grounding, inventory, prose, search, status, symbols
from tessella.schema import TABLES
from tessella.session import durable
from tessella.sources import artifacts, files, git


class Index:
    """The stored tables of an index; `texts` reads the sources they were made of."""

    def __init__(self, spark: SparkSession, path: str, root: str | None = None):
        self.spark, self.path, self.root = spark, path, root

    def table(self, name: str) -> DataFrame:
        """A table, or an error if there is no index of this version."""
        t = artifacts.read(self.spark, self.path, name)
        if t is None:
            raise FileNotFoundError(f"no index at {self.path}: build it first")
        return t

    def texts(self) -> DataFrame:
        """(rel, text, hash) of the sources as they are now."""
        scanned = files.scan(self.spark, self.root).join(self.table("files").select("rel"), "rel", "left_semi")
        return scanned.select("rel", files.decode("content").alias("text"), F.sha1("content").alias("hash"))

    def prose(self) -> DataFrame | None:
        """(slug, text) of entries with prose."""
        entries = self.entries()
        if entries is None:
            return None
        told = entries.select("slug", F.explode("regions").alias("r")).where((F.col("r.type") == "human") & prose.enriched(F.col("r.body")))
        return told.groupBy("slug").agg(F.array_join(F.array_sort(F.collect_list("r.body")), "\n").alias("text"))

    def entries(self) -> DataFrame | None:
        """(slug, ok, regions) of the hand-written entries, if there are any."""
        import os

        folder = f"{self.path}/encyclopedia"
        if not os.path.isdir(folder) or not any(x.endswith(".md") for x in os.listdir(folder)):
            return None
        raw = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
        e = raw.select(F.regexp_extract("path", "([^/]+)\\.md$", 1).alias("slug"), prose.regions(files.decode("content")).alias("p"))
        return e.select("slug", "p.ok", "p.regions")

    def names(self) -> DataFrame:
        """Exported names by file."""
        return symbols.exported_names(self.table("defs"))

    def scored(self, query: str) -> DataFrame:
        """All modules that match."""
        return search.score_modules(self.table("modules"), self.table("files"), query, self.prose(), self.names())

    def embed(self, model: str, force: bool = False) -> dict:
        """Vectors of all modules by a model file (JSON: modelId, dim, vocab, weights); only changed texts are encoded.

        Another model or size, or `force`, encodes all; vectors of vanished modules are dropped.
        """
        with open(model) as file:
            m = json.load(file)
        vocabulary = self.spark.createDataFrame([(m["modelId"], int(m["dim"]), t, [float(x) for x in w]) for t, w in zip(m["vocab"], m["weights"])], TABLES["vocabulary"])
        texts = durable(search.embed_text(self.table("modules"), self.table("files"), self.prose()))
        old = artifacts.read(self.spark, self.path, "vectors")
        pruned = 0 if old is None else old.join(texts, "slug", "left_anti").count()
        same = (F.col("model") == m["modelId"]) & (F.col("dim") == int(m["dim"])) & F.lit(not force)
        none = self.spark.createDataFrame([], TABLES["vectors"])
        kept = durable((none if old is None else old.where(same)).join(texts.select("slug", "hash"), ["slug", "hash"], "left_semi"))
        changed = texts.join(kept.select("slug"), "slug", "left_anti")
        made = search.encode(changed, vocabulary).join(changed.select("slug", "hash"), "slug")
        made = durable(made.select("slug", "hash", "v", F.lit(m["modelId"]).alias("model"), F.lit(int(m["dim"])).alias("dim")))
        artifacts.write(kept.select("slug", "hash", "v", "model", "dim").unionByName(made), self.path, "vectors")
        artifacts.write(vocabulary, self.path, "vocabulary")
        return {"model": m["modelId"], "embedded": made.count(), "reused": kept.count(), "pruned": pruned}

    def hybrid(self, query: str, k: int = C.TOP_K) -> tuple[DataFrame, str | None]:
        """Words and vectors fused, and a warning where there are vectors that can't be used; without vectors, words."""
        store, vocabulary = (artifacts.read(self.spark, self.path, t) for t in ("vectors", "vocabulary"))
        more = {"prose": self.prose(), "names": self.names()}
        modules, rows = self.table("modules"), self.table("files")
        first = None if store is None or vocabulary is None else store.first()
        if first is None:
            return search.find_hybrid(modules, rows, query, k, **more)
        active = vocabulary.first()
        asked = search.encode(self.spark.createDataFrame([("query", query)], "slug string, text string"), vocabulary).first()
        return search.find_hybrid(modules, rows, query, k, store, None if asked is None else list(asked["v"]), first["model"], active["model"], **more)

    def find(self, query: str, k: int = C.TOP_K) -> DataFrame:
        """The best modules: by words and vectors where the index is embedded, else by words and what the graph adds."""
        if artifacts.read(self.spark, self.path, "vectors") is not None:
            found, warning = self.hybrid(query, k)
            if warning is None and "fused" in found.columns:
                rows = found.collect()  # k rows, in order
                return self.spark.createDataFrame([(*r, i + 1) for i, r in enumerate(rows)], found.schema.add("position", "integer"))
            warnings.warn(warning or "index has no vectors: words only", stacklevel=2)
        return search.expand(self.table("modules"), self.table("module_edges"), self.scored(query), query, k)

    def lookup(self, query: str) -> DataFrame:
        """Symbols by name, with definitions and references."""
        d = self.table("defs")
        return symbols.hits(symbols.lookup(d, query), d, self.table("refs"), self.table("files")).orderBy(F.desc_nulls_first("score"), F.length("name"), "name")

    def _edges_of(self, target: str) -> tuple[DataFrame, list[str], DataFrame]:
        """Edges at the target's level (module or file), the start, and the degrees of that level."""
        m = self.table("modules")
        if not m.where(F.col("slug") == target).isEmpty():
            return self.table("module_edges"), [target], m.select(F.col("slug").alias("node"), (F.col("deg_in") + F.col("deg_out")).alias("degree"))
        f = self.table("files")
        if f.where(F.col("rel") == target).isEmpty():
            raise KeyError(target)
        return self.table("file_edges").where("not dangling"), [target], f.select(F.col("rel").alias("node"), (F.col("deg_in") + F.col("deg_out")).alias("degree"))

    def neighbours(self, target: str, depth: int = 1, kinds: list[str] | None = None) -> DataFrame:
        """What is linked with a module or file."""
        edges, start, degree = self._edges_of(target)
        limit = graph.hub_threshold(degree).collect()[0][0]
        return graph.neighbours(edges.select("src", "dst", "kind", "weight"), start, depth, kinds, degree, limit).orderBy("depth", "node", "direction", "kind")

    def impact(self, target: str, depth: int | None = None) -> DataFrame:
        """(rel, module, depth) of files that depend on a file or on any member of a module."""
        f = self.table("files")
        seeds = f.where((F.col("rel") == target) | (F.col("module") == target)).select(F.col("rel").alias("node"))
        if seeds.isEmpty():
            raise KeyError(target)
        hit = graph.impact(self.table("file_edges").where("not dangling"), seeds, ["import", "use", "call"], depth)
        return hit.join(f.select(F.col("rel").alias("node"), "module"), "node").select(F.col("node").alias("rel"), "module", "depth").orderBy("depth", "rel")

    def prose_state(self) -> DataFrame:
        """(slug, prose) of every module: none, unknown, fresh or stale."""
        m, entries = self.table("modules"), self.entries()
        if entries is None:
            return m.select("slug", F.lit("none").alias("prose"))
        rows = entries.select("slug", F.explode("regions").alias("r")).select("slug", "r.*")
        now = prose.digest(rows, "slug")
        members = m.select("slug", F.explode("members").alias("rel"))
        source = prose.source_hash(members, self.table("files").select("rel", "hash"), "slug")
        seen = artifacts.read(self.spark, self.path, "prose")
        if seen is None:
            seen = self.spark.createDataFrame([], "slug string, digest string, source string, baselined boolean")
        old = seen.toDF("slug", "old_digest", "old_source", "old_baselined")
        j = m.select("slug").join(now, "slug", "left").join(source, "slug", "left").join(old, "slug", "left").withColumn("digest", F.coalesce("digest", F.lit("")))
        return j.select("slug", prose.freshness(F.col("digest"), F.col("old_digest"), F.col("old_source"), F.col("old_baselined"), F.col("source")).alias("prose"))

    def status(self) -> DataFrame:
        """Modules in the order of work."""
        m = self.table("modules").select("slug", "tier", (F.col("deg_in") + F.col("deg_out")).alias("degree"))
        return status.queue(m.join(self.prose_state(), "slug"))

    def dossier(self, slug: str) -> DataFrame:
        """(position, rel, excerpt) of a module's key files: exported names and the first lines."""
        key = self.table("files").where(F.col("module") == slug).orderBy(F.desc("symbols"), (F.col("deg_in") + F.col("deg_out")).desc(), "rel").limit(C.KEY_FILES)
        key = key.withColumn("position", F.row_number().over(Window.orderBy(F.desc("symbols"), (F.col("deg_in") + F.col("deg_out")).desc(), "rel"))).select("position", "rel")
        return self._evidence(key)

    def _evidence(self, key: DataFrame) -> DataFrame:
        shown = self.texts().join(F.broadcast(key), "rel").join(self.names().withColumnRenamed("file", "rel"), "rel", "left")
        surface = F.array_join(F.slice(F.coalesce("names", F.array().cast("array<string>")), 1, C.EVIDENCE_SYMBOLS), ", ")
        lines = F.array_join(F.slice(F.split("text", "\r?\n"), 1, C.EVIDENCE_LINES), "\n")
        return shown.select("position", "rel", F.concat(F.lit("exports: "), surface, F.lit("\n"), lines).alias("excerpt"))

    def ask(self, question: str, k: int = C.ASK_K, tokens: int | None = None) -> DataFrame:
        """(position, rel, excerpt, state): the files to read for a question, within a budget."""
        found = self.find(question, k).select("position", F.posexplode("files").alias("n", "rel"))
        first = found.groupBy("rel").agg(F.min(F.struct("position", "n")).alias("at")).orderBy("at").limit(C.ASK_FILES)
        key = first.withColumn("position", F.row_number().over(Window.orderBy("at"))).select("position", "rel")
        e = self._evidence(key).withColumn("length", F.length("excerpt").cast("long")).withColumn("one", F.lit(1))
        if tokens is None:
            return e.select("position", "rel", "excerpt", F.lit("whole").alias("state")).orderBy("position")
        b = inventory.budget_prefix(e, "one", "position", "length", tokens)
        cut = F.regexp_replace(F.substring("excerpt", F.lit(1), F.col("taken").cast("int")), "\n[^\n]*$", "")
        return b.select("position", "rel", F.when(F.col("state") == "cut", cut).when(F.col("state") == "whole", F.col("excerpt")).alias("excerpt"), "state").orderBy("position")

    def delta(self, base: str | None = None, staged: bool = False) -> tuple[DataFrame, DataFrame]:
        """(risk of every changed module, problems that make the index too old for that)."""
        changed, hunks = git.diff(self.spark, self.root, base, staged)
        f, m, defs, edges = self.table("files"), self.table("modules"), self.table("defs"), self.table("file_edges")
        gate = delta.staleness_gate(changed, f.select("rel", "hash"), self.texts().select("rel", "hash"))
        touched = delta.partition(changed, f).where("class = 'indexed'").select("module", F.col("path").alias("node"))
        hit = graph.impact_each(edges.where("not dangling"), touched.withColumnRenamed("module", "slug"), ["import", "use", "call"], C.DELTA_DEPTH)
        hit = hit.join(f.select(F.col("rel").alias("node"), "module"), "node")
        dependents = hit.groupBy("slug").agg(F.count("*").alias("dependents"), F.countDistinct("module").alias("dependent_modules"))
        sig = delta.signals(changed, hunks, f, m, defs, edges, self.table("surprises"), dependents)
        return delta.risk(sig), gate.where("problem <> 'unindexed'")

    def check(self, strict_prose: bool = False) -> dict:
        """Whether the index still tells of the sources: changes, broken edges, prose."""
        scanned = files.scan(self.spark, self.root).select("rel", F.sha1("content").alias("hash"))
        f = self.table("files")
        diff = {r["change"]: r["n"] for r in inventory.manifest_diff(f.select("rel", "hash"), scanned).groupBy("change").agg(F.count("*").alias("n")).collect()}
        ends = self.table("file_edges").where("not dangling").select(F.explode(F.array("src", "dst")).alias("rel"))
        lost = ends.join(f.select("rel"), "rel", "left_anti").distinct().count()
        entries = self.entries()
        broken = 0 if entries is None else entries.where("not ok").count()
        stale = self.prose_state().where("prose = 'stale'").count()
        ok = not diff and not lost and not broken and not (strict_prose and stale)
        return {"ok": ok, **{k: diff.get(k, 0) for k in ("added", "changed", "removed")}, "lost_nodes": lost, "unparseable": broken, "stale_prose": stale}

    def check_answer(self, text: str) -> DataFrame:
        """The citations of an answer and whether they hold."""
        doc = self.spark.createDataFrame([(0, text)], "doc_id int, text string")
        return grounding.check(grounding.parse(doc), self.table("files"))

    def claims(self, text: str, most: int = C.MAX_CLAIMS) -> DataFrame:
        """The worklist of an answer's claims, at most so many pairs in order."""
        doc = self.spark.createDataFrame([(0, text)], "doc_id int, text string")
        pairs = grounding.claim_pairs(doc, self.texts())
        return pairs.orderBy(F.substring("claim_id", 2, 9).cast("int"), "citation").limit(most)

    def apply_verdicts(self, text: str, rows: list[dict]) -> dict:
        """Whether an answer's claims hold under the verdicts: none failed, all judged, every excerpt as it was judged."""
        doc = self.spark.createDataFrame([(0, text)], "doc_id int, text string")
        pairs = grounding.claim_pairs(doc, self.texts())
        fields = ("claim_id", "citation", "verdict", "digest")
        given = self.spark.createDataFrame([tuple(r.get(c) for c in fields) for r in rows], ", ".join(f"{c} string" for c in fields))
        verdicts = grounding.backfill(given, pairs)
        named = verdicts.join(pairs.select("claim_id", "citation", "claim", F.col("digest").alias("live")), ["claim_id", "citation"], "left")
        drift = named.where(~F.col("digest").eqNullSafe(F.col("live"))).count()
        failed = [r["claim_id"] for r in grounding.reduce_verdicts(verdicts).where("not ok").orderBy("claim_id").collect()]
        cover = grounding.coverage(pairs, named).collect()[0]
        return {"ok": not failed and not drift and bool(cover["ok"]), "failed": failed, "drifted": drift, "expected": cover["expected"], "judged": cover["judged"]}

    def read(self, rel: str, start: int = 1, end: int | None = None) -> str:
        """Lines of an indexed file, at most 2 000; paths that leave the root are refused."""
        from pathlib import Path

        root = Path(self.root).resolve()
        p = (root / rel).resolve()
        if not p.is_relative_to(root) or not p.is_file():
            raise KeyError(rel)
        last = min(end or start + C.READ_LINES - 1, start + C.READ_LINES - 1)
        return "\n".join(files.decode_bytes(p.read_bytes()).splitlines()[max(start, 1) - 1 : last])

    def map(self) -> dict[str, DataFrame]:
        """The parts of an index page: languages, hubs, bridges, communities, modules."""
        m = self.table("modules")
        hubs = status.hubs(m, 12)
        return {
            "languages": inventory.histogram(self.table("files").where("lang is not null"), "lang", 8), "hubs": hubs, "bridges": status.bridges(m, hubs, 8),
            "communities": status.labels(m.withColumn("degree", F.col("deg_in") + F.col("deg_out"))).orderBy(F.desc("size"), "community").limit(12), "surprises": self.table("surprises").orderBy("pair_edges", F.desc("weight"), "src", "dst").limit(8),
        }

    def work_batches(self, size: int = C.BATCH) -> DataFrame:
        """Modules to explain, in batches."""
        # Done modules come last in the queue, so those to do are numbered without gaps.
        q = self.status().where("prose in ('none', 'stale')")
        return q.withColumn("batch", F.floor((F.col("position") - 1) / size).cast("long"))
