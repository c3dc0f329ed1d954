"""Scanning a folder: listing, ignoring, decoding, extracting symbols, imports and prose."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella import constants as C
from tessella.functions import paths

SKIPPED = ["**/.git/**", "**/node_modules/**", "**/__pycache__/**", "**/dist/**", "**/target/**", "**/.venv/**"]


def ignore_globs(text: str, folder: str = "") -> list[str]:
    """The globs of an ignore file (without its negations)."""
    out = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line[0] in "#!":
            continue
        base = f"{folder}/" if folder else ""
        core = line.strip("/")
        anchored = "/" in line.rstrip("/")
        head = base if anchored else f"{base}**/"
        out += [f"{head}{core}/**"] + ([] if line.endswith("/") else [f"{head}{core}"])
    return out


def decode_bytes(b: bytes) -> str:
    """Text of a file: marks of byte order are honoured, what is not UTF-8 is Latin-1, binary is empty."""
    if b[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return b.decode("utf-16", "replace")
    if b"\0" in b:
        return ""
    if b[:3] == b"\xef\xbb\xbf":
        b = b[3:]
    try:
        return b.decode()
    except UnicodeDecodeError:
        return b.decode("latin-1")


@F.pandas_udf(T.StringType())
def decode(content: pd.Series) -> pd.Series:
    """As `decode_bytes`, in Arrow batches."""
    return content.map(lambda b: None if b is None else decode_bytes(bytes(b)))


def scan(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, max_bytes: int = C.MAX_BYTES, out_dir: str | None = None) -> DataFrame:
    """(rel, content, size, mtime) of the files below a folder. The size cap reaches the listing, so larger files aren't read."""
    root = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{re.escape(root)}/", "")
    files = raw.where(F.col("length") <= max_bytes).select(rel.alias("rel"), "content", F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("mtime"))
    files = files.where(paths.matches(F.col("rel"), include, [*SKIPPED, *(exclude or [])]))
    return files.where(~F.col("rel").startswith(f"{out_dir.strip('/')}/")) if out_dir else files


_NAME = r"([A-Za-z_$][\w$]*)"
_DEFS = {
    "js": [
        (rf"^\s*(export\s+)?(?:default\s+)?(?:async\s+)?function\*?\s+{_NAME}", "function"), (rf"^\s*(export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{_NAME}", "class"),
        (rf"^\s*(export\s+)?(?:declare\s+)?(?:interface|type|enum)\s+{_NAME}", "type"), (rf"^(export\s+)?(?:const|let|var)\s+{_NAME}", "variable"),
    ],
    "python": [(rf"^(\s*)(?:async\s+)?def\s+{_NAME}", "function"), (rf"^(\s*)class\s+{_NAME}", "class")],
    "go": [(rf"^()func\s+(?:\([^)]*\)\s*)?{_NAME}", "function"), (rf"^()type\s+{_NAME}", "type")],
    "rust": [(rf"^\s*(pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+{_NAME}", "function"), (rf"^\s*(pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|type|mod)\s+{_NAME}", "type")],
    "java": [(rf"^\s*(public\s+)?(?:\w+\s+)*(?:class|interface|enum|record)\s+{_NAME}", "class"), (rf"^\s+(public\s+)(?:[\w<>\[\],]+\s+)+{_NAME}\s*\(", "method")],
}
_FAMILY = {"typescript": "js", "javascript": "js", "python": "python", "go": "go", "rust": "rust", "java": "java", "kotlin": "java", "csharp": "java", "php": "js", "scala": "java"}
_IMPORTS = {
    "js": r"""(?:from|import|require\(|import\()\s*['"]([^'"\n]+)['"]""", "python": r"^\s*(?:from\s+([.\w]+)\s+import|import\s+([\w.]+))",
    "go": r"""^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"\n]+)"$""", "rust": r"^\s*(?:pub\s+)?(?:use\s+([\w:]+)|mod\s+(\w+);)", "java": r"^\s*(?:import|using)\s+(?:static\s+)?([\w.]+)",
}


def extract_code(text: str, lang: str) -> tuple[list[dict], list[str], list[str]]:
    """Definitions, imports and called names, by the patterns of the language's family."""
    family = _FAMILY.get(lang)
    if family is None:
        return [], [], []
    lines, defs = text.split("\n"), []
    for i, line in enumerate(lines, 1):
        for pattern, kind in _DEFS[family]:
            if m := re.match(pattern, line):
                name = m[2]
                exported = {"python": not name.startswith("_"), "go": name[:1].isupper()}.get(family, bool(m[1]))
                defs.append({"name": name, "line": i, "end_line": _end(lines, i, family), "kind": kind, "exported": exported, "parent": None})
                break
    for d in defs:
        outer = [o for o in defs if o is not d and o["line"] < d["line"] and o["end_line"] and d["end_line"] and o["end_line"] >= d["end_line"]]
        d["parent"] = min(outer, key=lambda o: o["end_line"] - o["line"])["name"] if outer else None
    imports = [next(g for g in m.groups() if g) for m in re.finditer(_IMPORTS[family], text, re.M)]
    own = {d["name"] for d in defs}
    calls = {m for m in re.findall(r"\b([A-Za-z_]\w{2,})\s*\(", text)} - own
    return defs, list(dict.fromkeys(imports)), sorted(calls)


def _end(lines: list[str], start: int, family: str) -> int | None:
    """The last line of a definition: by indentation in Python, else by braces; None if they don't close."""
    if family == "python":
        indent, last = len(lines[start - 1]) - len(lines[start - 1].lstrip()), start
        for j in range(start, len(lines)):
            if lines[j].strip():
                if len(lines[j]) - len(lines[j].lstrip()) <= indent:
                    break
                last = j + 1
        return last
    depth, opened = 0, False
    for j in range(start - 1, len(lines)):
        for ch in lines[j]:
            if ch == "{":
                depth, opened = depth + 1, True
            elif ch == "}":
                depth -= 1
            elif ch == ";" and not opened and depth == 0:
                return j + 1
        if opened and depth <= 0:
            return j + 1
    return None


def extract_markdown(text: str) -> tuple[str | None, str | None, list[str]]:
    """Title, first paragraph under it (no list, no lead-in that ends in a colon), and links."""
    body = re.sub(r"(?s)```.*?```", "", text)
    heading = re.search(r"(?m)^#\s+(.+?)\s*#*$", body)
    title, summary = (heading[1] if heading else None), None
    rest = body[heading.end() :] if heading else body
    for block in re.split(r"\n\s*\n", rest):
        one = " ".join(block.split())
        if not one:
            continue
        if one.startswith("#"):
            break
        if not re.match(r"[-*+>|]|\d+[.)]\s|!\[|\[!\[|<", one) and not one.endswith(":"):
            summary = one
            break
    links = [x.split("#")[0].split(" ")[0] for x in re.findall(r"\[[^\]\n]*\]\(([^)\n]+)\)", body)]
    return title, summary, list(dict.fromkeys(x for x in links if x and not re.match(r"[a-z]+:", x)))


EXTRACTED = "rel string, hash string, kind string, lang string, title string, summary string, lines bigint, size bigint, mtime double, test_file boolean, defs array<struct<name:string,line:int,end_line:int,kind:string,exported:boolean,parent:string>>, imports array<string>, refs array<string>"


def extract(files: DataFrame) -> DataFrame:
    """A record for every scanned file: one pass over the contents, nothing is shuffled."""
    text = decode(F.col("content"))
    f = files.select("rel", "size", "mtime", F.sha1("content").alias("hash"), paths.file_kind(F.col("rel")).alias("kind"), paths.language(F.col("rel")).alias("lang"), paths.is_test_file(F.col("rel")).alias("test_file"), text.alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                title = summary = None
                defs, imports, refs = [], [], []
                if r.lang == "markdown":
                    title, summary, imports = extract_markdown(r.text)
                elif r.kind == "code" and r.lang:
                    defs, imports, refs = extract_code(r.text, r.lang)
                rows.append((r.rel, r.hash, r.kind, r.lang, title or r.rel.rsplit("/", 1)[-1], summary, r.text.count("\n") + (not r.text.endswith("\n")), r.size, r.mtime, r.test_file, defs, imports, refs))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in EXTRACTED.split(", ")])

    return f.mapInPandas(run, EXTRACTED)


def _normal(path: Column) -> Column:
    """A path without . and .. parts; null if it leaves the root."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    step = lambda acc, x: F.when(acc.isNull(), acc).when(x != "..", F.concat(acc, F.array(x))).when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


_ENDINGS = ["", ".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".py", ".rs", ".go", "/index.ts", "/index.tsx", "/index.js", "/__init__.py", "/mod.rs", ".md", ".java", ".kt", ".cs", ".php"]


def resolve(imports: DataFrame, files: DataFrame, packages: DataFrame | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """(src, spec, dst, status, reason) of imports (rel, spec, lang): candidates are exploded and joined with the files.

    packages: name, dir of workspaces and modules; aliases: prefix to folder. The first ending
    that exists wins. Absolute names also match the end of a path.
    """
    spec, folder = F.col("spec"), paths.dirname(F.col("rel"))
    python = F.when(spec.startswith(".."), F.concat(F.repeat(F.lit("../"), F.length(F.regexp_extract(spec, "^(\\.+)", 1)) - 1), F.replace(F.regexp_replace(spec, "^\\.+", ""), F.lit("."), F.lit("/"))))
    python = python.when(spec.startswith("."), F.concat(F.lit("./"), F.replace(F.regexp_replace(spec, "^\\.", ""), F.lit("."), F.lit("/")))).otherwise(F.replace(spec, F.lit("."), F.lit("/")))
    path = (
        F.when(F.col("lang") == "python", python).when(F.col("lang").isin("java", "kotlin", "csharp", "scala"), F.replace(spec, F.lit("."), F.lit("/")))
        .when(F.col("lang") == "rust", F.regexp_replace(F.regexp_replace(spec, "^(crate|self)::", ""), "::", "/")).otherwise(spec)
    )
    i = imports.withColumn("path", F.regexp_replace(path, "\\.(js|jsx|mjs)$", ""))
    for prefix, target in sorted((aliases or {}).items(), key=lambda kv: -len(kv[0])):
        i = i.withColumn("path", F.when(F.col("path").startswith(prefix), F.concat(F.lit(target), F.substring("path", len(prefix) + 1, 10_000))).otherwise(F.col("path")))
    relative = F.col("path").startswith(".") | (F.col("lang") == "markdown")
    i = i.withColumn("relative", relative).withColumn("target", F.when(relative, _normal(F.concat_ws("/", folder, "path"))).otherwise(_normal(F.col("path"))))
    if packages is not None:
        heads = i.where(~F.col("relative")).select("rel", "spec", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/"))).alias("name"))
        own = heads.join(packages, "name").groupBy("rel", "spec").agg(F.max_by(F.concat_ws("/", "dir", F.substr("path", F.length("name") + 2)), F.length("name")).alias("inside"))
        i = i.join(own, ["rel", "spec"], "left").withColumn("local", F.col("inside").isNotNull()).withColumn("target", F.coalesce(_normal(F.col("inside")), "target"))
    else:
        i = i.withColumn("local", F.lit(False))
    cand = i.withColumn("c", F.explode(F.transform(F.sequence(F.lit(0), F.lit(len(_ENDINGS) - 1)), lambda n: F.struct(n.alias("n"), F.concat("target", F.element_at(F.array(*map(F.lit, _ENDINGS)), n + 1)).alias("at")))))
    exact = cand.join(files.select(F.col("rel").alias("dst")), F.col("c.at") == F.col("dst")).groupBy("rel", "spec").agg(F.min_by("dst", "c.n").alias("dst"))
    tails = files.select(F.col("rel").alias("dst"), F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("rel", "/"))), lambda n: F.array_join(F.slice(F.split("rel", "/"), -n, n), "/"))).alias("at"))
    by_end = cand.where(~F.col("relative") & F.col("target").contains("/") & F.col("lang").isin("python", "java", "kotlin", "csharp", "scala", "rust")).join(tails, F.col("c.at") == F.col("at")).groupBy("rel", "spec").agg(F.min_by("dst", F.struct("c.n", F.length("dst"), "dst")).alias("end_dst"))
    j = i.join(exact, ["rel", "spec"], "left").join(by_end, ["rel", "spec"], "left").withColumn("dst", F.coalesce("dst", "end_dst"))
    reason = F.when(F.col("dst").isNotNull(), None).when(F.col("target").isNull(), "escapes-repo-root").when(F.col("lang") == "markdown", "missing-target").when(F.col("relative"), "missing-module").when(F.col("local"), "missing-package")
    status = F.when(F.col("dst").isNotNull(), "resolved").when(reason.isNotNull(), "dangling").otherwise("external")
    return j.select(F.col("rel").alias("src"), "spec", "dst", status.alias("status"), reason.alias("reason"), "lang")
