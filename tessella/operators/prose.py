"""Explanations written by hand: fenced regions, digests, staleness, merging, and moving after a rename."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.constants import ENRICH_MARKER, MIGRATE_OVERLAP

_REGION = T.StructType([T.StructField(n, T.StringType()) for n in ("type", "key", "body")])
_PARSED = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("regions", T.ArrayType(_REGION))])
_OPEN = re.compile(r"<!--\s*ui:(gen|human)\s+key=([\w-]+)(?:\s+hash=[a-f0-9]+)?\s*-->\s*", re.A)
_CLOSE = re.compile(r"<!--\s*/ui:(gen|human)\s+key=([\w-]+)\s*-->\s*", re.A)


def _unpadded(lines: list[str]) -> str:
    full = [i for i, x in enumerate(lines) if x.strip()]
    return "\n".join(lines[full[0] : full[-1] + 1]) if full else ""


def parse_regions(text: str) -> list[tuple[str, str, str]] | None:
    """(type, key, body) in order, text outside fences as a human region named by its hash; None if fences don't fit."""
    out: list[tuple[str, str, str]] = []
    loose: list[str] = []
    inside: tuple[str, str] | None = None
    body: list[str] = []

    def settle() -> None:
        if kept := _unpadded(loose):
            out.append(("human", "orphan-" + hashlib.sha1(kept.encode()).hexdigest()[:8], kept))
        loose.clear()

    for line in re.split("\r?\n", text):
        begin, end = _OPEN.fullmatch(line), _CLOSE.fullmatch(line)
        if inside is None:
            if end:
                return None
            if begin:
                settle()
                inside, body = (begin[1], begin[2]), []
            else:
                loose.append(line)
        elif end:
            if (end[1], end[2]) != inside:
                return None
            out.append((*inside, _unpadded(body)))
            inside = None
        elif begin:
            return None
        else:
            body.append(line)
    if inside is not None:
        return None
    settle()
    return out


@F.pandas_udf(_PARSED)
def regions(text: pd.Series) -> pd.DataFrame:
    """The regions of stored entries: a line-by-line state machine, so it runs in Arrow batches."""
    got = [parse_regions(x) if x is not None else [] for x in text]
    rows = [[{"type": a, "key": b, "body": c} for a, b, c in g or []] for g in got]
    return pd.DataFrame({"ok": [g is not None for g in got], "regions": rows})


def enriched(body: Column) -> Column:
    """Whether a body is prose and no stub."""
    return F.coalesce((F.trim(body) != "") & ~body.contains(ENRICH_MARKER), F.lit(False))


def digest(rows: DataFrame, group: str) -> DataFrame:
    """(group, digest) over the human regions with prose, in order of key; empty if there are none. rows: group, type, key, body."""
    part = F.when((F.col("type") == "human") & enriched(F.col("body")), F.concat("key", F.lit("\0"), "body"))
    parts = F.array_sort(F.collect_list(part))
    return rows.groupBy(group).agg(F.when(F.size(parts) == 0, "").otherwise(F.sha1(F.array_join(parts, "\n"))).alias("digest"))


def source_hash(members: DataFrame, hashes: DataFrame, group: str) -> DataFrame:
    """(group, source) over members in order, a file that is gone counting as such. members: group, rel; hashes: rel, hash."""
    j = members.join(hashes.select("rel", "hash"), "rel", "left")
    parts = F.array_sort(F.collect_list(F.struct("rel", F.concat("rel", F.lit("\0"), F.coalesce("hash", F.lit("<deleted>"))).alias("p"))))
    return j.groupBy(group).agg(F.sha1(F.array_join(F.transform(parts, lambda x: x["p"]), "\n")).alias("source"))


def freshness(digest_now: Column, recorded_digest: Column, recorded_source: Column, baselined: Column, source_now: Column) -> Column:
    """none, unknown, fresh or stale."""
    return (
        F.when(digest_now == "", "none").when(recorded_digest.isNull(), "unknown").when(recorded_digest != digest_now, "fresh")
        .when(F.coalesce(baselined, F.lit(False)), "unknown").when(recorded_source == source_now, "fresh").otherwise("stale")
    )


def carry(now: DataFrame, before: DataFrame, first_build: bool) -> DataFrame:
    """The prose pointers of a new build: (slug, digest, source, baselined).

    now: slug, digest, source, predecessor (or null); before: slug, digest, source, baselined.
    A pointer of unchanged prose is carried over, also through a rename; revised prose points to
    today's source; prose never recorded on the first build is a baseline without evidence.
    """
    b = before.select(F.col("slug").alias("from"), F.col("digest").alias("old_digest"), F.col("source").alias("old_source"), F.col("baselined").alias("old_baselined"))
    j = now.where("digest <> ''").withColumn("from", F.coalesce("predecessor", "slug")).join(b, "from", "left")
    same = F.coalesce(F.col("old_digest") == F.col("digest"), F.lit(False))
    base = F.when(same, F.col("old_baselined")).otherwise(F.lit(True if first_build else None).cast("boolean"))
    return j.select("slug", "digest", F.when(same, F.col("old_source")).otherwise(F.col("source")).alias("source"), base.alias("baselined"))


def merge(spec: DataFrame, existing: DataFrame, migrated: DataFrame) -> DataFrame:
    """(slug, key, type, body, origin) of merged entries. All have slug, key, body; spec also type.

    Generated regions take the new body. Human ones keep the existing body, else that of the
    predecessor, else the stub; those the spec doesn't know are kept at the end.
    """
    e, m = existing.select("slug", "key", F.col("body").alias("e")), migrated.select("slug", "key", F.col("body").alias("m"))
    j = spec.join(e, ["slug", "key"], "full_outer").join(m, ["slug", "key"], "full_outer")
    gen = F.col("type") == "gen"
    body = F.when(gen, F.col("body")).otherwise(F.coalesce("e", "m", "body"))
    origin = F.when(gen, "generated").when(F.col("e").isNotNull(), "existing").when(F.col("m").isNotNull(), "migrated").otherwise("stub")
    extra = F.col("type").isNull()
    named = F.when(extra & F.col("e").isNull() & ~F.col("key").rlike("^(migrated-from-|orphan-)"), F.concat(F.lit("migrated-"), "key")).otherwise(F.col("key"))
    return j.select("slug", named.alias("key"), F.coalesce("type", F.lit("human")).alias("type"), body.alias("body"), origin.alias("origin"))


def _sized(groups: DataFrame, name: str) -> DataFrame:
    """(`name`, member, n_`name`, bits_`name`): members of a group once, the number of them, and 64 bits in which each sets one."""
    own = Window.partitionBy(name)
    bit = F.expr("shiftleft(1L, cast(pmod(xxhash64(member), 64) as int))")
    rows = groups.select(F.col("slug").alias(name), "member").where(F.col(name).isNotNull()).repartition(name).distinct()
    return rows.withColumn(f"n_{name}", F.count("*").over(own)).withColumn(f"bits_{name}", F.bit_or(bit).over(own)).where("member is not null")


def overlaps(old: DataFrame, new: DataFrame, least: float = MIGRATE_OVERLAP) -> DataFrame:
    """(new, old, overlap) of groups that share members by Jaccard. Both: slug, member.

    Only groups with a common member meet: a join on the member, then counting. Where two groups meet, each
    bit that one has and the other lacks is a member not shared; a pair that falls short of `least` even
    if all others are shared leaves the join nowhere, so mostly pairs of the result move.
    """
    missing = lambda x, y: F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(y)))
    share = lambda n: n / (F.col("n_old") + F.col("n_new") - n)
    most = F.least(F.col("n_old") - missing("bits_old", "bits_new"), F.col("n_new") - missing("bits_new", "bits_old"))
    met = _sized(old, "old").join(_sized(new, "new"), "member").where(share(most) >= least)
    both = met.groupBy("new", "old", "n_new", "n_old").agg(F.count("*").alias("n"))
    return both.select("new", "old", share(F.col("n")).alias("overlap")).where(F.col("overlap") >= least)


def migrations(old: DataFrame, new: DataFrame, least: float = MIGRATE_OVERLAP) -> DataFrame:
    """(new, old, overlap): every new group takes, in order of slug, the best gone group that is left."""
    gone = old.join(new.select("slug"), "slug", "left_anti")
    fresh = new.join(old.select("slug"), "slug", "left_anti")
    taken, out = set(), []
    # Every pair shares half of its members, so a group has few; the walk is in order and on the driver.
    for r in overlaps(gone, fresh, least).orderBy("new", F.desc("overlap"), "old").toLocalIterator():
        if r["old"] not in taken and (not out or out[-1][0] != r["new"]):
            taken.add(r["old"])
            out.append((r["new"], r["old"], r["overlap"]))
    return old.sparkSession.createDataFrame(out, "new string, old string, overlap double")
