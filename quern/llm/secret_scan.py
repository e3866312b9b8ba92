"""Secret scans: fixed patterns and a battery of randomness tests, by DataFrame functions alone.

Besides assignments, access keys and long hexadecimal strings, tokens of at least 20
characters that mix letters and digits are tested for randomness. The alphabet is
inferred from a token's characters (hexadecimal, lower or upper case with digits,
alphanumeric, base 64), and the tests ask whether the token can be a uniform random
string over it: chi-squared of the character counts and of the share of digits, the
number of runs of letters and digits, and the correlation of neighbouring codes. The
largest normal score gives a Bonferroni-corrected p-value. Over all documents the
Benjamini-Hochberg procedure at level `FDR` finds the tokens that are not random, apart
for each alphabet and length class, as the power of the tests depends on both; a token it
does not find is reported as `random`. The procedure works on a histogram of scores,
whose size is bounded by the numbers of classes and bins.

Cases: null and empty texts have no spans. A token that overlaps a pattern's span is not
reported again. Repeated rows come out once each; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.spans import listed, spans

ASSIGN = r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
_ASSIGN_HEAD = r"""^(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
#: A run is matched whole, so the least length can be part of the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"

FDR = 0.1
#: Scores are counted in bins of this width; all above SCORE_MAX share the last one.
BIN, SCORE_MAX = 0.05, 12.0
_CODES = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/-_"


def base_spans(text: Column) -> dict[str, Column]:
    """The fixed patterns' spans. An assignment is matched first and dropped if its value is short."""
    assign = F.filter(spans(text, ASSIGN), lambda s: F.length(F.regexp_replace(s["match"], F.lit(_ASSIGN_HEAD), F.lit(""))) >= 8)
    return {"assign": assign, "access": spans(text, ACCESS, "AKIA"), "hex": spans(text, HEX)}


def candidates(text: Column) -> Column:
    """Spans of tokens that mix letters and digits."""
    return F.filter(spans(text, TOKEN), lambda s: s["match"].rlike("[0-9]") & s["match"].rlike("[A-Za-z]"))


def alphabet(token: Column) -> Column:
    """Size of the inferred alphabet."""
    return F.when(token.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), 16).when(token.rlike("^(?:[0-9a-z]+|[0-9A-Z]+)$"), 36).when(token.rlike("^[0-9A-Za-z]+$"), 62).otherwise(64)


def length_class(token: Column) -> Column:
    return F.floor(F.log2(F.length(token).cast("double")) * 2).cast("int")


def score(token: Column) -> Column:
    """The largest normal score of the battery: how far the token is from a uniform random string."""
    n, k = F.length(token).cast("double"), alphabet(token).cast("double")
    chars = F.split(token, "(?!^)")
    digits = F.length(F.regexp_replace(token, "[^0-9]", "")).cast("double")
    letters = n - digits

    square = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s + F.pow(n - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0)))
    uniform = (k * square / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    share = 10 / k
    classes = F.abs(digits - n * share) / F.sqrt(n * share * (1 - share))

    turns = F.length(F.regexp_replace(F.regexp_replace(token, "[0-9]+", "0"), "[^0-9]+", "a")).cast("double")
    mean = 2 * digits * letters / n + 1
    runs = F.abs(turns - mean) / F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(0.25)))

    code = F.transform(chars, lambda c: F.call_function("instr", F.lit(_CODES), c).cast("double"))
    middle = F.aggregate(code, F.lit(0.0), lambda s, x: s + x) / n
    dev = F.transform(code, lambda x: x - middle)
    var = F.aggregate(dev, F.lit(0.0), lambda s, x: s + x * x)
    lag = F.aggregate(F.zip_with(F.slice(dev, 1, F.size(dev) - 1), F.slice(dev, 2, F.size(dev) - 1), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    serial = F.when(var > 0, F.abs(lag / F.greatest(var, F.lit(1e-9)) + 1 / n) * F.sqrt(n)).otherwise(SCORE_MAX)
    return F.greatest(uniform, classes, runs, serial)


def p_value(z: float, tests: int = 4) -> float:
    """Two-sided normal tail, corrected for the number of tests."""
    return min(1.0, tests * math.erfc(z / math.sqrt(2)))


def limits(docs: DataFrame, text: str) -> dict[tuple[int, int], float]:
    """Per alphabet and length class the least score that the Benjamini-Hochberg procedure finds not random."""
    tokens = docs.select(F.explode(F.transform(candidates(F.col(text)), lambda s: s["match"])).alias("t"))
    bins = (
        tokens.select(alphabet(F.col("t")).alias("k"), length_class(F.col("t")).alias("size"), F.least(F.floor(score(F.col("t")) / BIN), F.lit(int(SCORE_MAX / BIN))).cast("int").alias("bin"))
        .groupBy("k", "size", "bin")
        .agg(F.count("*").alias("n"))
        .collect()
    )
    groups: dict[tuple[int, int], dict[int, int]] = {}
    for r in bins:
        groups.setdefault((r["k"], r["size"]), {})[r["bin"]] = r["n"]
    out = {}
    for key, counts in groups.items():
        total, above, least = sum(counts.values()), 0, math.inf
        for b in sorted(counts, reverse=True):
            above += counts[b]
            if p_value(b * BIN) <= FDR * above / total:
                least = b * BIN
        out[key] = least
    return out


def random_spans(text: Column, least: dict[tuple[int, int], float], base: list[Column]) -> Column:
    """Spans of the tokens that the procedure leaves as random and no base span touches."""
    known = F.concat(*base)

    def kept(s: Column) -> Column:
        limit = F.lit(0.0)
        t = s["match"]
        for (k, size), z in sorted(least.items()):
            limit = F.when((alphabet(t) == k) & (length_class(t) == size), F.lit(float(min(z, 1e9)))).otherwise(limit)
        binned = F.least(F.floor(score(t) / BIN), F.lit(int(SCORE_MAX / BIN))) * BIN
        return (binned < limit - BIN / 2) & ~F.exists(known, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    return F.filter(candidates(text), kept) if least else F.filter(candidates(text), lambda s: F.lit(False))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, assign, access, hex, random): arrays of spans."""
    src = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    least = limits(src, "t")
    base = base_spans(F.col("t"))
    found = src.select("id", "t", *[c.alias(k) for k, c in base.items()])
    return found.select(F.col("id").alias(doc_id), *base, random_spans(F.col("t"), least, [F.col(k) for k in base]).alias("random"))


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = [(k, F.col(k)) for k in ("assign", "access", "hex")]
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k, _ in base], F.sha2(listed(base, True), 256).alias("base_sha256"), listed([*base, ("random", F.col("random"))], True).alias("spans"))
