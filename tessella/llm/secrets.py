"""Operator 1: secret scan by a battery of randomness tests.

Every maximal run of at least `MIN_LENGTH` signs of any encoding alphabet is a candidate: the runs
of all alphabets' signs together, and within each the runs of every single alphabet, so a key
is also seen where it touches a word by _, -, / or +. Each span counts once. Its encoding is inferred (decimal, hex, base32, base36, base62, base64; base36 is tested as base62 too), and it is tested against
"drawn evenly from that alphabet" by chi-squared uniformity, by runs above and below the
alphabet's middle, and by lag-one serial correlation (p_chi2, p_runs, p_serial).

Digits of a card number pass such tests too, so a candidate counts as a secret only if it also
refutes the other hypothesis, "drawn from the signs this corpus is written in": p_text bounds the
chance that signs drawn from the corpus's own frequencies within the encoding would be as
improbable together as the candidate's (Chernoff's bound, so it holds at any length). Over all candidates of the corpus these p-values go through
the Benjamini-Hochberg procedure, weighted by the bits that a candidate of that length and
encoding can carry (weights of mean one): long strings must prove less, short ones more. Of
secrets that lie in one another only the longest is reported.

Defined cases: null or empty text has no candidate; repeated rows are each reported; a string
of any length is tested whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.text import utf8
from tessella.session import durable

MIN_LENGTH = 16
#: Share of false secrets among those reported, and the level of the battery of three tests.
FDR, BATTERY_LEVEL = 0.01, 0.001

ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_SETS = {k: frozenset(v) for k, v in ALPHABETS.items()}
_RUNS = [f"[{re.escape(''.join(v))}]" for v in ALPHABETS.values()]
_INDEX = {k: {c: i for i, c in enumerate(v)} for k, v in ALPHABETS.items()}
SCHEMA = "doc_id {id}, ordinal int, start int, length int, encoding string, p_chi2 double, p_runs double, p_serial double, log10_p_text double, bits double, secret_sha256 string, preview string"


def candidates(text: Column, min_length: int = MIN_LENGTH) -> Column:
    """All maximal runs of encoding signs, in order; `parts` are the candidates within one."""
    return F.regexp_extract_all(text, F.lit(f"[A-Za-z0-9+/_-]{{{min_length},}}"), F.lit(0))


def parts(run: str, min_length: int = MIN_LENGTH) -> list[tuple[int, int]]:
    """(start, end) of the run and of the maximal runs of each alphabet within it, each span once."""
    spans = {m.span() for signs in _RUNS for m in re.finditer(f"{signs}{{{min_length},}}", run)}
    return sorted(spans | {(0, len(run))})


def infer(token: str) -> str:
    """The smallest alphabet that holds every sign; a mixed one is read as base64."""
    signs = set(token)
    return next((k for k, own in _SETS.items() if signs <= own), "base64")


def readings(token: str) -> list[str]:
    """The encodings a candidate is tested in: a short key of one case may refute text as base62 only."""
    enc = infer(token)
    return [enc, "base62"] if enc in ("base36", "BASE36") else [enc]


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi2_tail(x: float, df: int) -> float:
    """Upper tail by the cube-root normal approximation of Wilson and Hilferty."""
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


_TILTS = np.linspace(0.02, 1.0, 50)


def text_model(freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log chances of an encoding's signs in the corpus, and the log moments of Chernoff's bound."""
    q = (freq + 0.5) / (freq + 0.5).sum()
    return np.log(q), np.log((q[None, :] ** (1 - _TILTS[:, None])).sum(axis=1))


def battery(token: str, encoding: str, model: tuple[np.ndarray, np.ndarray]) -> tuple[float, float, float, float]:
    """(p_chi2, p_runs, p_serial, log10 p_text); model: that of the encoding's signs in the corpus."""
    index = _INDEX[encoding]
    x = np.array([index.get(c, 0) for c in token])
    k, n = len(index), len(x)
    obs = np.bincount(x, minlength=k)
    chi2 = float(((obs - n / k) ** 2).sum() * k / n)
    p_chi2 = _chi2_tail(max(chi2, 1e-9), k - 1)
    high = x >= k // 2
    a = int(high.sum())
    b = n - a
    if a and b:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mu = 2 * a * b / n + 1
        var = (mu - 1) * (mu - 2) / (n - 1)
        p_runs = _normal_tail((runs - mu) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    c = x - (k - 1) / 2
    p_serial = _normal_tail(float((c[1:] * c[:-1]).sum()) / ((k * k - 1) / 12 * math.sqrt(n - 1)))
    log_q, moments = model
    log_p = min(0.0, float((_TILTS * log_q[x].sum() + n * moments).min()))
    return p_chi2, p_runs, p_serial, log_p / math.log(10)


def sign_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of the 256 byte values over all texts, summed on executors first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for b in batches:
            data, off = utf8(b.column(0))
            for i in range(int(off[0]), int(off[-1]), 1 << 22):
                total += np.bincount(data[i : min(i + (1 << 22), int(off[-1]))], minlength=256)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], names=["sign", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(count, "sign int, n bigint").groupBy("sign").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(256, np.int64)
    for r in rows:
        out[r["sign"]] = r["n"]
    return out


def tested(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Every candidate of every document with the results of its tests; `run` numbers the rows they come from."""
    counts = sign_counts(docs)
    models = {k: text_model(np.array([counts[ord(c)] for c in v], dtype=float)) for k, v in ALPHABETS.items()}

    def test(t: str, enc: str) -> tuple:
        return len(t), enc, *battery(t, enc, models[enc]), len(t) * math.log2(len(ALPHABETS[enc])), hashlib.sha256(t.encode()).hexdigest(), t[:4] + "…"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[tuple]] = {}
        for b in batches:
            at, out = [], []
            for i, t in enumerate(b.column(3).to_pylist()):
                if t not in seen:
                    if len(seen) > 20_000:
                        seen.clear()
                    seen[t] = [(s, *test(t[s:e], enc)) for s, e in parts(t, min_length) for enc in readings(t[s:e])]
                out += seen[t]
                at += [i] * len(seen[t])
            if out:
                types = [pa.int32(), pa.int32(), pa.string(), *[pa.float64()] * 5, pa.string(), pa.string()]
                row = b.select([0, 1, 2]).take(pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([*row.columns, *(pa.array(v, type=k) for v, k in zip(zip(*out), types))], names=names)

    found = docs.select(F.col("doc_id"), candidates(F.col("text"), min_length).alias("found")).where(F.size("found") > 0)
    rows = found.select(F.monotonically_increasing_id().alias("run"), "doc_id", F.posexplode("found").alias("ordinal", "token"))
    schema = "run bigint, " + SCHEMA.format(id=docs.schema["doc_id"].dataType.simpleString())
    names = [x.split()[0] for x in schema.split(", ")]
    return rows.mapInArrow(run, schema)


def find_secrets(docs: DataFrame, fdr: float = FDR, level: float = BATTERY_LEVEL, min_length: int = MIN_LENGTH) -> DataFrame:
    """One row for each occurrence of a secret: document, place of its run, start in the run, encoding, tests.

    A secret passes every test of the battery at `level` / 3 and is among the discoveries of
    the weighted procedure at `fdr`. Weighted p-values are rounded up to a hundredth of a power
    of ten, so ranks are counted over a table of fixed size and the control stays conservative.
    Secrets within another one are left out after that.
    """
    all_ = durable(tested(docs, min_length))
    mean = all_.agg(F.avg("bits")).collect()[0][0] or 1.0
    step = F.ceil((F.col("log10_p_text") - F.log10(F.col("bits") / F.lit(mean))) * 100).cast("long")
    ranked = all_.withColumn("step", F.greatest(step, F.lit(-100_000)))
    w = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    bins = ranked.groupBy("step").agg(F.count("*").alias("n")).withColumn("rank", F.sum("n").over(w))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    bins = bins.withColumn("m", total).where(F.pow(F.lit(10.0), F.col("step") / 100) <= F.col("rank") / F.col("m") * fdr)
    cut = bins.agg(F.max("step").alias("cut")).collect()[0]["cut"]
    if cut is None:
        return all_.where(F.lit(False)).drop("run")
    even = F.least("p_chi2", "p_runs", "p_serial") >= level / 3
    end = F.col("start") + F.col("length")
    before = Window.partitionBy("run", "ordinal").orderBy("start", F.desc("length"), "encoding").rowsBetween(Window.unboundedPreceding, -1)
    secrets = ranked.where((F.col("step") <= cut) & even).withColumn("reach", F.coalesce(F.max(end).over(before), F.lit(0)))
    return secrets.where(end > F.col("reach")).drop("run", "step", "reach")
