"""Language identification by compression.

Per language a raw-content zstandard dictionary is filled with sample texts; a text goes
to the language whose dictionary compresses it to the fewest bytes. Texts are lower-cased
and runs of anything but letters become one space. A text is cut into pieces of `PIECE`
bytes that are compressed apart, so every piece leans on the dictionary and the sizes of
all pieces of the whole text are summed.

What is learnt is bounded: of each language at most `SLOTS` texts, chosen by a hash among
all labelled rows, and of each of them a piece of 4 * DICT_BYTES / SLOTS characters that
begins at a place chosen by a hash of the text, or the whole text if it is no longer.

Cases: a null text, or one without a letter, gets `und`, score 0 and rejected; with no
labelled text to learn from, every text gets `und`. A label `und` is a language like any
other. A null id counts as held out (it is never learnt from). Ties go to the language
with the most rows learnt from, then by name. Repeated rows are predicted one by one.
Other columns are ignored, or kept if asked for; a kept column that has the name of an
output is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.lineage import free_names

#: Bytes of sample text in a language's dictionary: the bound of what is learnt and broadcast, per language.
DICT_BYTES = 64 << 10
#: Sample slots per language; each keeps the one text with the least hash.
SLOTS = 96
#: A text is compressed in pieces of so many bytes.
PIECE = 2048
LEVEL = 5
#: Texts of fewer characters are samples only of a language that has no longer ones.
SHORT = 32
_NOT_LETTERS = re.compile(r"[\W\d_]+")
#: A text is rejected if the second best language needs less than this share more bytes.
MIN_MARGIN = 0.004
OUTPUTS = ("lang_pred", "score", "margin", "rejected")


def normalised(text: str | None) -> bytes:
    return _NOT_LETTERS.sub(" ", (text or "").lower()).strip().encode()


def train_dictionaries(labelled: DataFrame, text: str = "text", lang: str = "lang", dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """A bounded dictionary per language from the rows with a label and a text.

    Texts fall into SLOTS by their hash, and a slot keeps a piece of the text with the least
    second hash, one of SHORT characters or more if there is one, so the sample depends on
    the set of texts alone: not on order, copies or partitions. At most SLOTS pieces per
    language reach the driver. The languages come in the order in which ties are resolved.
    """
    t = F.col(text)
    share = max(1, 4 * dict_bytes // SLOTS)
    begin = F.pmod(F.xxhash64("text", F.lit(11)), F.greatest(F.length("text") - share + 1, F.lit(1))) + 1
    rows = (
        labelled.select(F.col(lang).cast("string").alias("lang"), t.cast("string").alias("text"))
        .filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
        .select("lang", F.pmod(F.xxhash64("text"), F.lit(SLOTS)).alias("slot"), (F.length("text") < SHORT).alias("short"), F.xxhash64("text", F.lit(7)).alias("h"), F.col("text").substr(begin.cast("int"), F.lit(share)).alias("sample"))
        .groupBy("lang", "slot")
        .agg(F.min(F.struct("short", "h", "sample")).alias("m"), F.count("*").alias("n"))
        .select("lang", "slot", "m.short", "m.h", "m.sample", "n")
        .orderBy("lang", "h")
        .collect()
    )
    parts: dict[str, list[bytes]] = {}
    count: dict[str, int] = {}
    longer = {r["lang"] for r in rows if not r["short"]}
    for r in rows:
        if not (r["short"] and r["lang"] in longer):
            parts.setdefault(r["lang"], []).append(normalised(r["sample"]))
        count[r["lang"]] = count.get(r["lang"], 0) + r["n"]
    return {k: b" ".join(parts[k])[-dict_bytes:] for k in sorted(parts, key=lambda k: (-count[k], k))}


def size_scores(texts: list[str | None], dictionaries: dict[str, bytes]) -> np.ndarray:
    """Compressed bytes of each text (rows) under each language (columns)."""
    out = np.zeros((len(texts), len(dictionaries)))
    pieces = [[b[i : i + PIECE] for i in range(0, len(b), PIECE)] for b in map(normalised, texts)]
    for j, lang in enumerate(dictionaries):
        d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress
        for i, p in enumerate(pieces):
            out[i, j] = sum(len(compress(x)) for x in p)
    return out


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", keep: list[str] | None = None, min_margin: float = MIN_MARGIN, only_accepted: bool = False) -> DataFrame:
    """The columns `keep` with lang_pred, score (0 to 1), margin and rejected; or, of the accepted rows, those columns alone."""
    keep = list(keep if keep is not None else docs.columns)
    if not only_accepted:
        keep = [c for c in keep if c.lower() not in OUTPUTS]
    names = list(dictionaries)
    n = len(keep)
    whole, lettered = free_names(keep, "text", "letters")
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(whole), F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False)).alias(lettered))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in keep]).schema)
    if not only_accepted:
        schema += ", lang_pred string, score double, margin double, rejected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                texts, letters = batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()
                cols = [batch.column(i) for i in range(n)]
                if names:
                    sizes = size_scores([t if ok else None for t, ok in zip(texts, letters, strict=True)], dictionaries)
                    order = np.argsort(sizes, axis=1, kind="stable")
                    best = np.take_along_axis(sizes, order[:, :1], 1)[:, 0]
                    second = np.take_along_axis(sizes, order[:, 1:2], 1)[:, 0] if len(names) > 1 else best * 2
                    gap = (second - best) / np.maximum(best, 1)
                    heat = 0.004 * best + 2.0
                    score = 1.0 / np.exp(-(sizes - best[:, None]) / heat[:, None]).sum(axis=1)
                    pred = [names[k] if ok else "und" for k, ok in zip(order[:, 0].tolist(), letters, strict=True)]
                else:
                    pred, gap, score = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
                ok = np.array(letters, bool) & bool(names)
                gap, score = np.where(ok, gap, 0.0), np.where(ok, np.clip(score, 0.0, 1.0), 0.0)
                accepted = ok & (gap >= min_margin)
                if only_accepted:
                    yield pa.RecordBatch.from_arrays([c.filter(pa.array(accepted)) for c in cols], names=keep)
                else:
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(pred, pa.string()), pa.array(score), pa.array(gap), pa.array(~accepted)], names=[*keep, *OUTPUTS])

    return src.mapInArrow(run, schema)


def held_out(doc_id: str, mod: int, rest: int):
    """Whether crc32 of the id as text leaves this remainder; a null id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(mod)) == rest, F.lit(True))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learnt from those whose crc32(doc_id) mod 5 is not 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", held_out("doc_id", 5, 0).alias("held_out"))
    dictionaries = train_dictionaries(docs.filter(~F.col("held_out") & F.col("text").isNotNull()))
    return identify(docs.select("doc_id", "held_out", "text"), dictionaries, keep=["doc_id", "held_out"])
