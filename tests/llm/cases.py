"""A table of awkward documents, and brute-force versions of what the operators find in them."""

import hashlib
import re

import numpy as np

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, hits int, component long, kept boolean, t string, n int"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def awkward():
    """(doc_id, text, lang, source) with nulls, empty and long texts, copies, near copies, ties and repeated rows."""
    rng = np.random.RandomState(5)
    words = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(words, n))
    base = say(80)
    near = lambda k: " ".join(w if i % 80 != k else f"x{k}" for i, w in enumerate(base.split()))
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, near(7), "en", None), (4, near(40), None, "b"), (5, "", "en", "a"), (6, None, "de", "b"),
        (7, " \t\n", "de", "b"), (8, "one two", "en", "a"), (9, "ONE  two", "en", "a"), (10, "one", None, None), (11, say(20000), "en", "a"),
        (None, base, "en", "a"), (None, None, None, None), (12, say(60), "fr", "c"), (12, None, "fr", "c"), (13, "éé ßß 漢字 \U0001f600 " * 30, "zz", "c"),
        (14, "123 456 !!", "en", "c"), (15, "  \x00 \x0b", "en", "c"), (16, say(30) + " " + base, "en", "a"), (17, base + " " + say(9), "en", "a"), (17, base + " " + say(9), "en", "a"),
    ]
    rows += [(100 + i, near(i), "en", "hot") for i in range(40)]
    return rows


def frame(spark, rows=None):
    rows = awkward() if rows is None else rows
    return spark.createDataFrame([(d, t, g, s, None, 0, "k", 1, 5, False, "t", 3) for d, t, g, s in rows], COLUMNS).repartition(3)


def shingles(text, k):
    w = SPACED.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(rows, k, percent):
    """id -> least id reachable, of rows that link by exact set similarity."""
    sets = [(d, shingles(t, k)) for d, t, *_ in rows if d is not None]
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if x and y and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {d: root(d) for d in up}


_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_EMAIL, _IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD, _PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def secrets(t):
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def personal(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m.start(), m.end()) for m in _EMAIL.finditer(t)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in _CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", m.start(), m.end()) for m in _PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15]


def sha(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
