"""A small tree from scan to answers, and streams."""

from __future__ import annotations

import io
import json

import pytest
from pyspark.sql import functions as F

from tessella import constants as C
from tessella import server
from tessella.cli import run
from tessella.plans.answer import Index
from tessella.plans.build import build, build_all, module_slugs
from tessella.sources import files, git
from tessella.streaming import incremental, windows

TREE = {
    "src/auth/login.ts": 'import { query } from "../db/client";\nexport function loginUser(n: string) {\n  return query(n);\n}\n',
    "src/db/client.ts": "export function query(q: string) {\n  return q;\n}\nexport class Pool {\n  size() { return 1; }\n}\n",
    "tests/login.test.ts": 'import { loginUser } from "../src/auth/login";\nloginUser("x");\nimport { gone } from "./nothing";\n',
    "docs/guide.md": "# Guide\n\nHow to log in.\n\nSee [login](../src/auth/login.ts) and [lost](missing.md).\n",
    "app.py": "from pkg.mod import thing\nimport os\ndef main():\n    thing()\n",
    "pkg/mod.py": "def thing():\n    return 1\n",
}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for rel, text in TREE.items():
        (root / rel).parent.mkdir(parents=True, exist_ok=True)
        (root / rel).write_text(text)
    index = str(tmp_path_factory.mktemp("index"))
    return root, index, build(spark, str(root), index)


def test_edges(built):
    e = {(r["src"], r["dst"], r["kind"], r["reason"]) for r in built[2]["file_edges"].collect()}
    assert {
        ("src/auth/login.ts", "src/db/client.ts", "import", None), ("src/auth/login.ts", "src/db/client.ts", "call", None), ("tests/login.test.ts", "./nothing", "import", "missing-module"),
        ("docs/guide.md", "missing.md", "doc-link", "missing-target"), ("docs/guide.md", "src/auth/login.ts", "doc-link", None), ("app.py", "pkg/mod.py", "import", None),
    } <= e
    assert not any(x[1] == "os" for x in e)


def test_a_second_build_gives_the_same_tables(spark, built):
    root, index, tables = built
    before = {k: sorted(map(str, t.collect())) for k, t in tables.items()}
    again = build(spark, str(root), index)
    assert again.pop("before").count() == len(before["modules"])
    assert {k: sorted(map(str, t.collect())) for k, t in again.items()} == before


def test_answers(spark, built):
    x = Index(spark, built[1], str(built[0]))
    assert x.find("login user").orderBy("position").first()["slug"] == "src-auth"
    assert x.lookup("query").collect()[0]["refs"] == ["src/auth/login.ts"]
    assert [(r["rel"], r["depth"]) for r in x.impact("src/db/client.ts").collect()] == [("src/auth/login.ts", 1), ("tests/login.test.ts", 2)]
    assert {r["node"] for r in x.neighbours("src-auth", kinds=["import"]).collect()} == {"src-db", "tests"}
    assert "exports: Pool, query" in x.dossier("src-db").collect()[0]["excerpt"]
    assert x.ask("query pool", tokens=10).collect()[0]["state"] == "cut"
    assert x.check()["ok"]
    got = {r["raw"]: r["status"] for r in x.check_answer("So [src/auth/login.ts:1-2], not [src/no.ts:1].").collect()}
    assert got == {"src/auth/login.ts:1-2": "resolved", "src/no.ts:1": "unresolved"}
    with pytest.raises(KeyError):
        x.impact("nowhere")
    with pytest.raises(FileNotFoundError):
        Index(spark, "/nonexistent").table("files")


def test_embedding_is_incremental_and_find_uses_it(spark, built, tmp_path):
    import shutil

    index = str(tmp_path / "index")
    shutil.copytree(built[1], index)
    x = Index(spark, index, str(built[0]))
    n = x.table("modules").count()
    words = ["auth", "db", "pkg", "docs", "tests", "root", "login", "client", "guide", "app"]
    model = tmp_path / "model.json"

    def write(name):
        model.write_text(json.dumps({"modelId": name, "dim": 10, "vocab": words, "weights": [[float(i == j) for j in range(10)] for i in range(10)]}))

    write("a")
    assert x.hybrid("auth")[1] is None and "fused" not in x.hybrid("auth")[0].columns
    assert x.embed(str(model)) == {"model": "a", "embedded": n, "reused": 0, "pruned": 0}
    assert x.embed(str(model)) == {"model": "a", "embedded": 0, "reused": n, "pruned": 0}
    assert x.embed(str(model), force=True)["embedded"] == n
    got = x.find("auth login").orderBy("position").collect()
    assert got[0]["slug"] == "src-auth" and got[0]["semantic_rank"] == 1 and got[0]["fused"] > 0
    assert [r["position"] for r in got] == list(range(1, len(got) + 1))
    assert {r["rel"] for r in x.ask("auth login").collect()} >= {"src/auth/login.ts"}
    with pytest.warns(UserWarning, match="words only"):
        assert x.find("query").orderBy("position").first()["slug"] == "src-db"  # no word of the query is in the model
    write("b")
    assert x.embed(str(model))["embedded"] == n
    gone = spark.createDataFrame([("gone", "h", [1] * 10, "b", 10)], "slug string, hash string, v array<tinyint>, model string, dim int")
    from tessella.sources import artifacts

    artifacts.write(spark.createDataFrame(x.table("vectors").collect() + gone.collect(), gone.schema), index, "vectors")
    assert x.embed(str(model)) == {"model": "b", "embedded": 0, "reused": n, "pruned": 1}


def test_an_index_beyond_max_files_says_that_it_is_partial(spark, built, tmp_path):
    with pytest.warns(UserWarning, match="2 files"):
        tables = build(spark, str(built[0]), str(tmp_path / "few"), max_files=4)
    assert [tuple(r) for r in tables["partial"].collect()] == [(4, 2)] and tables["files"].count() == 4
    assert built[2]["partial"].count() == 0


def test_a_changed_file_makes_the_index_stale(spark, built):
    p = built[0] / "pkg/mod.py"
    old = p.read_text()
    p.write_text(old + "# more\n")
    try:
        got = Index(spark, built[1], str(built[0])).check()
        assert not got["ok"] and got["changed"] == 1
    finally:
        p.write_text(old)


def test_command_line(spark, built, capsys):
    assert run(["--index", built[1], "--root", str(built[0]), "symbols", "query"], spark) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["name"] == "query"


def test_entries_keep_what_people_wrote(spark, tmp_path):
    root, index = tmp_path / "r", str(tmp_path / "i")
    for rel, text in TREE.items():
        (root / rel).parent.mkdir(parents=True, exist_ok=True)
        (root / rel).write_text(text)
    build_all(spark, str(root), index)
    page = tmp_path / "i/encyclopedia/src-db.md"
    first = page.read_text()
    assert "- [src/db/client.ts]: query, Pool" in first and C.ENRICH_MARKER in first and (tmp_path / "i/INDEX.md").exists()
    page.write_text(first.replace(C.ENRICH_MARKER, "Talks to the database [src/db/client.ts:1].", 1) + "\nA loose note.\n")
    x = Index(spark, index, str(root))
    build_all(spark, str(root), index)
    again = page.read_text()
    assert "Talks to the database" in again and "A loose note." in again
    state = lambda: {r["slug"]: r["prose"] for r in x.prose_state().collect()}
    assert state()["src-db"] == "fresh" and state()["pkg"] == "none"
    (root / "src/db/client.ts").write_text(TREE["src/db/client.ts"] + "// more\n")
    build_all(spark, str(root), index)
    assert page.read_text().count("Talks to the database") == 1 and state()["src-db"] == "stale"
    assert x.find("database").first()["slug"] == "src-db"
    (root / "src/db").rename(root / "src/store")  # all paths change: no file in common, so the page is an orphan
    told = build_all(spark, str(root), index)
    assert told["orphaned"] == ["src-db"] and "Talks to" in (tmp_path / "i/encyclopedia/_orphaned/src-db.md").read_text()


def test_verdicts_of_an_answer(spark, built):
    x = Index(spark, built[1], str(built[0]))
    text = "It asks the database [src/auth/login.ts:3].\n\nThere is a pool [src/db/client.ts:4]."
    pairs = [r.asDict() for r in x.claims(text).collect()]
    rows = [{"claim_id": p["claim_id"], "citation": p["citation"], "verdict": "supported"} for p in pairs]
    assert len(rows) == 2 and x.apply_verdicts(text, rows)["ok"]
    assert not x.apply_verdicts(text, rows[:1])["ok"]
    assert x.apply_verdicts(text, [rows[0] | {"verdict": "refuted"}, rows[1]])["failed"] == ["C1"]
    assert x.apply_verdicts(text, [rows[0] | {"digest": "old"}, rows[1]])["drifted"] == 1


def test_server(spark, built):
    x = Index(spark, built[1], str(built[0]))
    call = lambda name, **a: {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": a}}
    lines = [json.dumps({"jsonrpc": "2.0", "id": 0, "method": "initialize"}), json.dumps([call("symbols", query="query"), call("read", path="app.py", start=2, end=2)]), "{", json.dumps(call("find")), json.dumps(call("read", path="../x")), json.dumps({"jsonrpc": "2.0", "method": "note"})]
    out = io.StringIO()
    server.serve(x, io.StringIO("\n".join(lines)), out)
    got = [json.loads(r) for r in out.getvalue().splitlines()]
    assert got[0]["result"]["serverInfo"]["name"] == "tessella"
    assert json.loads(got[1][0]["result"]["content"][0]["text"])[0]["refs"] == ["src/auth/login.ts"] and json.loads(got[1][1]["result"]["content"][0]["text"]) == "import os"
    assert got[2]["error"]["code"] == -32700 and "missing argument" in got[3]["error"]["message"] and got[4]["result"]["isError"] and len(got) == 5
    assert "withheld" in server.capped("x" * 2_000_000)


def test_decoding():
    assert files.decode_bytes(b"\xef\xbb\xbfhi") == "hi" and files.decode_bytes("hé".encode("utf-16")) == "hé"
    assert files.decode_bytes(b"caf\xe9") == "café" and files.decode_bytes(b"a\0b") == ""


def test_ignored_files_are_not_scanned(spark, tmp_path):
    for rel in ("keep.py", "out/a.py", "deep/out/b.py", "x.log", "only/here.py", "sub/only/here.py"):
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text("x = 1\n")
    globs = files.ignore_globs("# note\nout/\n*.log\n/only\n")
    assert {r["rel"] for r in files.scan(spark, str(tmp_path), exclude=globs).select("rel").collect()} == {"keep.py", "sub/only/here.py"}


def test_markdown_summary():
    assert files.extract_markdown("# T\n\n- a list\n\nLead-in:\n\nThe point.\n\n## Sub\n\nNo")[:2] == ("T", "The point.")
    assert files.extract_markdown("# T\n\n## Sub\n\ntext")[1] is None


def test_slugs_are_injective(spark):
    f = spark.createDataFrame([("a/b/x",), ("a-b/x",), ("日本/x",), ("x",)], "rel string")
    got = {r["rel"]: r["module"] for r in module_slugs(f).collect()}
    assert len(set(got.values())) == 4 and got["x"] == "root" and got["日本/x"].startswith("module-")


def test_packages_and_aliases(spark):
    f = spark.createDataFrame([("packages/core/src/util.ts",), ("packages/app/main.ts",), ("lib/x/index.ts",)], "rel string")
    p = spark.createDataFrame([("@acme/core", "packages/core")], "name string, dir string")
    i = spark.createDataFrame([("packages/app/main.ts", s, "typescript") for s in ("@acme/core/src/util", "@/x", "react", "../../../out", "@acme/core/none")], "rel string, spec string, lang string")
    got = {r["spec"]: (r["status"], r["dst"] or r["reason"]) for r in files.resolve(i, f, p, {"@/": "lib/"}).collect()}
    assert got == {
        "@acme/core/src/util": ("resolved", "packages/core/src/util.ts"), "@/x": ("resolved", "lib/x/index.ts"), "react": ("external", None),
        "../../../out": ("dangling", "escapes-repo-root"), "@acme/core/none": ("dangling", "missing-package"),
    }


def test_hunks_of_a_diff():
    d = "+++ b/x.py\n@@ -1,2 +3,4 @@\n@@ -9 +12 @@\n@@ -20,3 +19,0 @@\n+++ /dev/null\n@@ -1 +0,0 @@\n"
    assert git.parse_hunks(d) == [("x.py", 3, 6), ("x.py", 12, 12), ("x.py", 19, 19)]


def test_stream_keeps_the_index(spark, tmp_path):
    schema = "rel string, hash string, text string, seq bigint, deleted boolean"
    src, batches = tmp_path / "in", [[("a", "1", "one", 1, False), ("b", "1", "bee", 2, False)], [("a", "2", "two", 3, False), ("b", None, None, 4, True), ("c", "1", "sea", 5, False)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / f"{i}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(src))
        incremental.keep_index(stream, str(tmp_path / "t"), str(tmp_path / "c"), lambda f: f.withColumn("n", F.length("text"))).awaitTermination()
    got = {(r["rel"], r["text"]) for r in incremental.latest(spark, str(tmp_path / "t"), 1).collect()}
    assert got == {("a", "two"), ("c", "sea")}


def test_windows_are_the_same_on_a_stream(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    e.write.parquet(str(tmp_path / "e"))
    s = windows.tumbling(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")), "1 hour")
    q = s.writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(str, spark.table("tumbled").collect())) == sorted(map(str, windows.tumbling(e, "1 hour").collect()))
