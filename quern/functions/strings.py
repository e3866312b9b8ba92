"""String methods by their frame-library names, as Column functions.

Patterns are Java regular expressions. A missing string gives a missing result, except
where a fill value is given.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"\s"


def lower(s):
    return F.lower(s)


def upper(s):
    return F.upper(s)


casefold = lower


def capitalize(s):
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(s.substr(F.lit(2), F.length(s))))


def swapcase(s):
    return F.array_join(F.transform(F.split(s, ""), lambda c: F.when(c == F.upper(c), F.lower(c)).otherwise(F.upper(c))), "")


def title(s):
    """Upper case for every letter that does not follow a letter, lower case for the others."""
    parts = F.regexp_extract_all(s, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(parts, capitalize), "")


def length(s):
    return F.length(s)


def strip(s, chars: str | None = None):
    return F.trim(s) if chars == " " else F.regexp_replace(s, _edge(chars, "both"), "")


def lstrip(s, chars: str | None = None):
    return F.regexp_replace(s, _edge(chars, "left"), "")


def rstrip(s, chars: str | None = None):
    return F.regexp_replace(s, _edge(chars, "right"), "")


def _edge(chars: str | None, side: str) -> str:
    one = _SPACE if chars is None else "[" + "".join("\\" + c if not c.isalnum() else c for c in chars) + "]"
    return {"left": f"^{one}+", "right": f"{one}+$", "both": f"^{one}+|{one}+$"}[side]


def pad(s, width: int, side: str = "left", fill: str = " "):
    """Pads, and never shortens."""
    n = F.greatest(F.lit(width) - F.length(s), F.lit(0))
    left = {"left": n, "right": F.lit(0), "both": F.floor(n / 2).cast("int")}[side]
    return F.concat(F.repeat(F.lit(fill), left.cast("int")), s, F.repeat(F.lit(fill), (n - left).cast("int")))


def rjust(s, width: int, fill: str = " "):
    return pad(s, width, "left", fill)


def ljust(s, width: int, fill: str = " "):
    return pad(s, width, "right", fill)


def center(s, width: int, fill: str = " "):
    """The odd place goes to the left if the width is odd."""
    n = F.greatest(F.lit(width) - F.length(s), F.lit(0))
    left = F.floor(n / 2) + (n % 2) * (width % 2)
    return F.concat(F.repeat(F.lit(fill), left.cast("int")), s, F.repeat(F.lit(fill), (n - left).cast("int")))


def zfill(s, width: int):
    sign = s.rlike("^[+-]")
    body = F.when(sign, F.substring(s, 2, 1 << 30)).otherwise(s)
    return F.concat(F.when(sign, F.substring(s, 1, 1)).otherwise(""), F.repeat(F.lit("0"), F.greatest(F.lit(width) - F.length(s), F.lit(0)).cast("int")), body)


def contains(s, pattern: str, regex: bool = True, case: bool = True, na: bool | None = None):
    hit = s.rlike(pattern if case else f"(?i){pattern}") if regex else (s.contains(pattern) if case else F.lower(s).contains(pattern.lower()))
    return hit if na is None else F.coalesce(hit, F.lit(na))


def match(s, pattern: str):
    return s.rlike(f"^(?:{pattern})")


def fullmatch(s, pattern: str):
    return s.rlike(f"^(?:{pattern})$")


def count(s, pattern: str):
    return F.regexp_count(s, F.lit(pattern))


def startswith(s, prefix: str):
    return s.startswith(prefix)


def endswith(s, suffix: str):
    return s.endswith(suffix)


def find(s, sub: str):
    """The first place from 0, or -1."""
    return F.instr(s, sub) - 1


index = find


def rfind(s, sub: str):
    """The last place, or -1."""
    at = F.instr(F.reverse(s), sub[::-1])
    return F.when(at > 0, F.length(s) - at - len(sub) + 1).otherwise(-1)


rindex = rfind


def extract(s, pattern: str, group: int = 1):
    """The group of the first match; missing without a match."""
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, group))


def extractall(s, pattern: str, group: int = 1):
    """The group of every match, as an array; explode it for a row each."""
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(group))


def findall(s, pattern: str):
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(0))


def get(s, i: int):
    """The character at a place, from the end if negative; missing outside."""
    at = F.lit(i + 1) if i >= 0 else F.length(s) + i + 1
    return F.when((at >= 1) & (at <= F.length(s)), s.substr(at, F.lit(1)))


def join(s, sep: str):
    return F.array_join(F.split(s, ""), sep)


def partition(s, sep: str):
    """(before, separator, after) of the first occurrence."""
    at = F.instr(s, sep)
    return F.struct(F.when(at > 0, s.substr(F.lit(1), at - 1)).otherwise(s).alias("before"), F.when(at > 0, sep).otherwise("").alias("sep"), F.when(at > 0, s.substr(at + len(sep), F.length(s))).otherwise("").alias("after"))


def rpartition(s, sep: str):
    """(before, separator, after) of the last occurrence."""
    at = rfind(s, sep) + 1
    return F.struct(F.when(at > 0, s.substr(F.lit(1), at - 1)).otherwise("").alias("before"), F.when(at > 0, sep).otherwise("").alias("sep"), F.when(at > 0, s.substr(at + len(sep), F.length(s))).otherwise(s).alias("after"))


def removeprefix(s, prefix: str):
    return F.when(s.startswith(prefix), s.substr(F.lit(len(prefix) + 1), F.length(s))).otherwise(s)


def removesuffix(s, suffix: str):
    return F.when(s.endswith(suffix), s.substr(F.lit(1), F.length(s) - len(suffix))).otherwise(s)


def repeat(s, n: int):
    return F.repeat(s, n)


def replace(s, old: str, new: str, regex: bool = False):
    return F.regexp_replace(s, old, new) if regex else F.replace(s, F.lit(old), F.lit(new))


def slice_(s, start: int = 0, stop: int | None = None):
    """Characters from start to stop; negative places count from the end."""
    n = F.length(s)
    lo = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    hi = n if stop is None else (F.least(F.lit(stop), n) if stop >= 0 else n + stop)
    return s.substr(lo.cast("int") + 1, F.greatest(hi - lo, F.lit(0)).cast("int"))


def slice_replace(s, start: int, stop: int, new: str):
    return F.concat(slice_(s, 0, start), F.lit(new), slice_(s, stop))


def split(s, sep: str | None = None, n: int = -1):
    """Parts as an array; without a separator, runs of white space."""
    if sep is None:
        return F.regexp_extract_all(s, F.lit(r"\S+"), F.lit(0))
    literal = "".join("\\" + c if not c.isalnum() else c for c in sep)
    return F.split(s, literal, n + 1 if n > 0 else -1)


def rsplit(s, sep: str, n: int = -1):
    """Parts from the right, at most n cuts."""
    parts = split(s, sep)
    if n <= 0:
        return parts
    extra = F.greatest(F.size(parts) - n, F.lit(1))
    return F.concat(F.array(F.array_join(F.slice(parts, F.lit(1), extra), sep)), F.slice(parts, extra + 1, F.size(parts)))


def translate(s, table: dict[str, str]):
    return F.translate(s, "".join(table), "".join(table.values()))


def cat(*columns, sep: str = ""):
    """Strings of several columns as one; missing if one is."""
    out = columns[0]
    for c in columns[1:]:
        out = F.concat(out, F.lit(sep), c)
    return out


def encode(s, encoding: str = "UTF-8"):
    return F.encode(s, encoding)


def decode(b, encoding: str = "UTF-8"):
    return F.decode(b, encoding)


def wrap(s, width: int):
    """Words in lines of at most so many characters."""
    return F.aggregate(split(s), F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), lambda st, w: F.when(st["at"] == 0, F.struct(w.alias("out"), F.length(w).alias("at"))).when(st["at"] + 1 + F.length(w) <= width, F.struct(F.concat(st["out"], F.lit(" "), w).alias("out"), (st["at"] + 1 + F.length(w)).alias("at"))).otherwise(F.struct(F.concat(st["out"], F.lit("\n"), w).alias("out"), F.length(w).alias("at"))), lambda st: st["out"])


def isalnum(s):
    return s.rlike(r"^[\p{L}\p{N}]+$")


def isalpha(s):
    return s.rlike(r"^\p{L}+$")


def isdigit(s):
    return s.rlike(r"^\p{Nd}+$")


isdecimal = isdigit


def isnumeric(s):
    return s.rlike(r"^\p{N}+$")


def isspace(s):
    return s.rlike(r"^\s+$")


def islower(s):
    return s.rlike(r"\p{L}") & (s == F.lower(s))


def isupper(s):
    return s.rlike(r"\p{L}") & (s == F.upper(s))


def istitle(s):
    return s.rlike(r"\p{L}") & (s == title(s))


def get_dummies(s: Column, values: list[str], sep: str = "|") -> list[Column]:
    """A 0/1 column for each value among the parts."""
    parts = split(s, sep)
    return [F.coalesce(F.array_contains(parts, v), F.lit(False)).cast("int").alias(v) for v in values]
