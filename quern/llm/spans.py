"""Places of pattern matches in texts, by DataFrame functions alone.

A span is a struct of start and end (code points, end exclusive) and the matched text.
Spark returns matches without their places, so places are summed up from the lengths of
the pieces between matches. Patterns whose group loops Java runs by recursion are written
with lookarounds and bounded loops, so long runs of digits or letters neither exhaust the
stack nor take quadratic time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,end:bigint,match:string>>"


def empty() -> Column:
    return F.array().cast(SPAN)


def spans(text: Column, pattern: str, hint: str | None = None) -> Column:
    """Leftmost non-overlapping matches of a pattern; `hint`, a plain string each match holds, spares the search elsewhere."""
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).cast("long").alias("at"), empty().alias("out"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["piece"])
        end = begin + F.length(pair["match"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), pair["match"].alias("match")))).alias("out"))

    pairs = F.zip_with(matches, F.slice(pieces, 1, F.size(matches)), lambda m, p: F.struct(p.alias("piece"), m.alias("match")))
    found = F.aggregate(pairs, start, step, lambda s: s["out"])
    there = text.rlike(pattern) if hint is None else text.contains(hint) & text.rlike(pattern)
    return F.when(F.coalesce(there, F.lit(False)), found).otherwise(empty())


def listed(kinds: list[tuple[str, Column]], by_start: bool) -> Column:
    """kind:start:end of all spans, comma-joined; sorted by start and then kind as listed, or by kind and then start."""

    def keyed(place: int, kind: str, found: Column) -> Column:
        order = F.lit(place).cast("long")
        return F.transform(found, lambda s: F.struct((s["start"] if by_start else order).alias("a"), (order if by_start else s["start"]).alias("b"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["start"].alias("start")))

    every = F.array_sort(F.concat(*[keyed(i, kind, found) for i, (kind, found) in enumerate(kinds)]))
    return F.array_join(F.transform(every, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def replaced(text: Column, found: Column) -> Column:
    """The text with each span, of structs (start, end, label), replaced by its label; overlapping spans are one, under the first label."""
    merged = F.aggregate(
        F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")))),
        F.array().cast("array<struct<start:bigint,end:bigint,label:string>>"),
        lambda out, s: F.when(
            (F.size(out) > 0) & (s["start"] < F.element_at(out, -1)["end"]),
            F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], s["end"]).alias("end"), F.element_at(out, -1)["label"].alias("label")))),
        ).otherwise(F.concat(out, F.array(s))),
    )
    parts = F.aggregate(
        merged,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda st, s: F.struct(s["end"].alias("at"), F.concat(st["out"], F.array(F.substring(text, st["at"].cast("int") + 1, (s["start"] - st["at"]).cast("int")), s["label"])).alias("out")),
        lambda st: F.concat(st["out"], F.array(F.substring(text, st["at"].cast("int") + 1, F.length(text)))),
    )
    return F.when(F.size(found) > 0, F.array_join(parts, "")).otherwise(text)
