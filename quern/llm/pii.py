"""Personal data: fixed patterns and information-theoretic sanitisation, by DataFrame functions alone.

The matches of the patterns are the protected entities. A term that stands anywhere in the
documents of an entity, with it in at least `SUPPORT` different texts, may give it away. Its
disclosure is the share of the entity's information that the term carries, by counts of
documents in the whole corpus, whole texts and repeated rows included,

    ln(n(entity and term) * N / (n(entity) * n(term))) / ln(N / n(entity))

A term whose disclosure reaches `LIMIT` is a span of kind `term` wherever it stands in a
document that holds the entity. Entities are replaced by their kind and terms by a general
word. Words inside an entity are no terms.

The patterns are matched once, and the spans are stored. Words are placed for those
documents alone that hold an entity of `SUPPORT` texts. By the formula a disclosing term has

    n(entity and term) >= n(term) * (n(entity) / N) ** (1 - LIMIT)

so pairs are made only where both the entity and the term are in that many of the placed
documents, which leaves out no disclosing pair.

Cases: null and empty texts have no spans. Copies of a text count as one for the support.
Repeated rows come out once each; other columns are ignored, or kept as they are by
`sanitise`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.lineage import free_names, refuse_clash, stored
from quern.llm.spans import SPAN, empty, listed, replaced, spans

KINDS = ("email", "ip", "card", "phone")
#: An email starts at the start of a run of its characters, or where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: A whole run of digits with single separators, of 16 to 19 digits.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Words beside an entity that were once the only candidates; it bounds nothing now, and only a test's brute force reads it.
REACH = 5
SUPPORT = 2
LIMIT = 0.9
_WORD = r"[\p{L}\p{M}]{4,}+"


def luhn(digits: Column) -> Column:
    """Whether the digits pass Luhn's check."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda s, i: s + F.when((n - i) % 2 == 0, digits.substr(i, F.lit(1)).cast("int")).otherwise((digits.substr(i, F.lit(1)).cast("int") * 2) % 10 + F.floor(digits.substr(i, F.lit(1)).cast("int") / 5).cast("int")),
    )
    return total % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """The fixed patterns' spans, less those that fail the further tests."""

    def digits(s: Column) -> Column:
        return F.regexp_replace(s["match"], "[^0-9]", "")

    return {
        "email": spans(text, EMAIL, "@"),
        "ip": F.filter(spans(text, IP, "."), lambda s: s["match"].rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.(?!$)|$)){4}$")),
        "card": F.filter(spans(text, CARD), lambda s: luhn(digits(s))),
        "phone": F.filter(spans(text, PHONE, "+"), lambda s: F.length(digits(s)).between(8, 15)),
    }


def _held(found: str, of: tuple[str, ...] = KINDS) -> Column:
    return F.greatest(*[F.size(F.col(found)[k]) for k in of]) > 0


def _stored_spans(docs: DataFrame, doc_id: str, text: str, found: str, only_held: bool = False) -> DataFrame:
    """The documents, stored, with their spans: a column `found` of a key, equal for rows of equal id and text, and the spans of each kind.

    `only_held` leaves out the texts of documents without a span.
    """
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    base = F.struct(F.xxhash64(F.col(f"`{doc_id}`"), t).alias("key"), *[c.alias(k) for k, c in base_spans(t).items()])
    marked = docs.withColumn(found, base)
    return stored(marked.withColumn(text, F.when(_held(found), F.col(f"`{text}`"))) if only_held else marked)


def _marked(found: Column, mark: Column, *more: str) -> Column:
    """The spans as structs of start, end, a constant and further fields."""
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), mark, *[s[x].alias(x) for x in more]))


def _entities(some: DataFrame) -> DataFrame:
    """(key, copy, entity, start, end, texts) of the entities that stand in SUPPORT different texts; from (key, t, spans), a row per document."""
    each = F.concat(*[_marked(F.col(k), F.lit(k).alias("kind"), "match") for k in KINDS])
    rows = some.select("key", F.xxhash64("t").alias("copy"), F.explode(each).alias("s")).select("key", "copy", F.concat_ws(":", "s.kind", F.lower("s.match")).alias("entity"), "s.start", "s.end").distinct()
    shared = rows.groupBy("entity").agg(F.count_distinct("copy").alias("texts")).filter(F.col("texts") >= SUPPORT)
    return rows.join(shared, "entity")


def _words(some: DataFrame, entities: DataFrame) -> DataFrame:
    """(key, term, start, end) of the words outside entities, of the documents that hold some."""
    matches, pieces = F.regexp_extract_all("t", F.lit(_WORD), F.lit(0)), F.split("t", _WORD, -1)
    pairs = F.zip_with(matches, F.slice(pieces, 1, F.size(matches)), lambda m, p: F.struct(F.length(p).alias("gap"), m.alias("match")))
    texts = some.join(entities.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("t").alias("t"))
    words = texts.select("key", F.posexplode(pairs).alias("place", "w")).select("key", "place", "w.gap", "w.match")
    end = F.sum(F.col("gap") + F.length("match")).over(Window.partitionBy("key").orderBy("place"))
    words = words.select("key", end.cast("long").alias("end"), "match").select("key", (F.col("end") - F.length("match")).alias("start"), "end", F.lower("match").alias("term"))
    # Ends of entities come before what starts in the same place, and their starts before words.
    none = F.lit(None).cast("string")
    turns = [
        entities.select("key", F.col("end").alias("at"), F.lit(0).alias("rank"), F.lit(-1).alias("opens"), none.alias("term"), "end"),
        entities.select("key", F.col("start").alias("at"), F.lit(1).alias("rank"), F.lit(1).alias("opens"), none.alias("term"), "end"),
        words.select("key", F.col("start").alias("at"), F.lit(2).alias("rank"), F.lit(0).alias("opens"), "term", "end"),
    ]
    order = Window.partitionBy("key").orderBy("at", "rank", "end").rowsBetween(Window.unboundedPreceding, 0)
    line = turns[0].union(turns[1]).union(turns[2]).withColumn("open", F.sum("opens").over(order))
    return line.filter("rank = 2 AND open = 0").select("key", "term", F.col("at").alias("start"), "end")


def disclosing(docs: DataFrame, some: DataFrame, text: str) -> tuple[DataFrame, DataFrame] | None:
    """(key, entity, term) of the documents with a term that discloses an entity they hold, and (key, term, start, end) of all their words; None if there are none."""
    entities = stored(_entities(some))
    if entities.isEmpty():
        return None
    n = F.lit(float(max(docs.count(), 1)))
    words = stored(_words(some, entities))
    texts = stored(entities.select("key", "copy").distinct().join(some.groupBy("key").agg(F.count("*").alias("times")), "key"), rows=entities.count())
    each = entities.select("key", "entity").distinct().join(texts, "key")
    n_entity = each.groupBy("entity").agg(F.sum("times").alias("n_entity")).filter(F.col("n_entity") < n)
    holds = stored(each.join(n_entity, "entity").select("key", "entity", "n_entity"), rows=entities.count())
    has = stored(words.select("key", "term").distinct().join(texts, "key"), rows=words.count())
    # Counted before the join, so that a word makes a row per task and not one per document.
    every = docs.select(F.explode(F.array_distinct(F.split(F.lower(F.col(f"`{text}`")), r"[^\p{L}\p{M}]+"))).alias("term")).filter(F.length("term") >= 4)
    often = every.groupBy("term").agg(F.count("*").alias("n_term"))
    placed = has.groupBy("term").agg(F.count_distinct("copy").alias("texts"), F.sum("times").alias("n_placed")).filter(F.col("texts") >= SUPPORT)

    def needed(n_entity: Column) -> Column:
        """The documents that a disclosing pair has at least, less what rounding may add."""
        return F.col("n_term") * F.pow(n_entity / n, F.lit(1 - LIMIT)) * (1 - 1e-9)

    terms = placed.join(often, "term", "left").select("term", "n_placed", F.coalesce("n_term", F.lit(0)).alias("n_term"))
    terms = stored(terms.filter(F.col("n_placed") >= needed(F.lit(float(SUPPORT)))), rows=has.count())
    both = has.join(terms, "term").join(holds, "key").filter(F.least("n_placed", "n_entity") >= needed(F.col("n_entity")))
    both = stored(both.select("key", "copy", "times", "entity", "term", "n_entity", "n_term"))
    n_both = both.groupBy("entity", "term", "n_entity", "n_term").agg(F.count_distinct("copy").alias("texts"), F.sum("times").alias("n_both"))
    share = F.log(F.col("n_both") * n / (F.col("n_entity") * F.greatest("n_term", "n_both"))) / F.greatest(F.log(n / F.col("n_entity")), F.lit(1e-9))
    found = n_both.filter((F.col("texts") >= SUPPORT) & (share >= LIMIT)).select("entity", "term")
    return both.select("key", "entity", "term").join(found, ["entity", "term"]), words


def term_spans(docs: DataFrame, marked: DataFrame, text: str, found: str) -> DataFrame:
    """(key, term): the spans of disclosing terms, of the documents that have some; `marked` are the documents with stored spans."""
    some = marked.filter(_held(found)).select(F.col(found)["key"].alias("key"), F.col(f"`{text}`").cast("string").alias("t"), *[F.col(found)[k].alias(k) for k in KINDS])
    given = disclosing(docs, some, text)
    if given is None:
        return docs.sparkSession.createDataFrame([], f"key long, term {SPAN}")
    hit, words = given
    return hit.select("key", "term").distinct().join(words, ["key", "term"]).groupBy("key").agg(F.array_sort(F.collect_set(F.struct(F.col("start"), F.col("end"), F.col("term").alias("match")))).alias("term"))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, email, ip, card, phone, term): arrays of spans."""
    refuse_clash(doc_id, [*KINDS, "term"])
    src = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t"))
    marked = _stored_spans(src, "id", "t", "found", only_held=True)
    terms = term_spans(src, marked, "t", "found")
    clean = marked.select("id", "found.key", *[F.col("found")[k].alias(k) for k in KINDS])
    return clean.join(terms, "key", "left").select(F.col("id").alias(doc_id), *KINDS, F.coalesce("term", empty()).alias("term"))


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The documents, all their columns, with entities and disclosing terms replaced and the number of characters set anew."""
    found, key, term = free_names(docs.columns, "found", "key", "term")
    columns, t = [F.col(f"`{c}`") for c in docs.columns], F.col(f"`{text}`")
    marked = _stored_spans(docs, doc_id, text, found)
    plain = marked.filter(~_held(found)).select(columns)
    terms = term_spans(docs, marked, text, found).select(F.col("key").alias(key), F.col("term").alias(term))
    keyed = marked.filter(_held(found)).withColumn(key, F.col(found)["key"]).join(terms, key, "left")
    label = lambda kind: F.lit(f"[{kind.upper()}]").alias("label")
    hits = F.concat(*[_marked(F.col(found)[k], label(k)) for k in KINDS], _marked(F.coalesce(F.col(term), empty()), label("term")))
    done = keyed.withColumn(text, replaced(t, hits))
    if n_chars in docs.columns:
        done = done.withColumn(n_chars, F.length(t).cast(docs.schema[n_chars].dataType))
    return plain.union(done.select(columns))


def op6_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = [(k, F.col(k)) for k in KINDS]
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(listed(base, False), 256).alias("base_sha256"), listed([*base, ("term", F.col("term"))], False).alias("spans"))
