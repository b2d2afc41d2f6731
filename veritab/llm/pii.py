"""Personal data: base patterns, and information-theoretic sanitisation.

Base patterns give protected entities. A term discloses an entity when their
pointwise mutual information comes near the entity's own information content,
both estimated from the corpus; disclosing terms are removed with the entity.
Both are counted over all documents; how far they are to be trusted depends on
the texts of their own behind them, so copies and near copies are one witness.

DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._packed import WORD_PATTERN, written

# Each pattern may begin where no character of its first class stands before, or where the last match ended; so a run is tried once.
EMAIL = "(?:(?<![A-Za-z0-9._%+-])|\\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?:(?<![0-9])|\\G)[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
CARD = "(?:(?<![0-9])|\\G)[0-9](?:[\\x20-]?+[0-9])++"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
TERM = "term"

#: A term discloses an entity from this share of the entity's information content on.
DISCLOSURE = 0.9
#: A term seen with an entity by k witnesses each time may still stand alone: with this chance its share with the entity is below CHANCE ** (1 / k).
CHANCE = 0.2
#: Entries of the signature that tells copies and near copies from texts of their own.
SIGNATURE = 8
#: Tables up to so many rows may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 100_000

_SPANS = "array<struct<kind:string,start:long,end:long,value:string>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    def total(d: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            n = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
            twice = n * 2
            return acc + F.when(i % 2 == 0, n).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

        return F.when(F.length(d).between(13, 19), F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))

    return F.get(F.transform(F.array(_digits(m)), total), F.lit(0))


def _octets(m: Column) -> Column:
    def small(p: Column) -> Column:
        p = F.regexp_replace(p, "^0+(?=.)", "")
        return F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(F.lit(False))

    return F.forall(F.split(m, "\\."), small)


def _yes(m: Column) -> Column:
    return F.lit(True)


def _phone(m: Column) -> Column:
    return F.length(_digits(m)).between(9, 15)


_BASE = (("email", EMAIL, _yes, "@"), ("ip", IP, _octets, "."), ("card", CARD, _luhn, None), ("phone", PHONE, _phone, "+"))


def _located(text: Column, kind: str, pattern: str, valid) -> Column:
    """Matches that hold, with their place: the pieces between matches and the matches add up to it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPANS).alias("out"))

    def add(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["b"])
        end = start + F.length(pair["m"])
        span = F.array(F.struct(F.lit(kind).alias("kind"), start.cast("long").alias("start"), end.cast("long").alias("end"), pair["m"].alias("value")))
        return F.struct(end.cast("long").alias("at"), F.when(valid(pair["m"]), F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    pairs = F.filter(F.arrays_zip(between.alias("b"), found.alias("m")), lambda x: x["m"].isNotNull())
    return F.aggregate(pairs, zero, add, lambda acc: acc["out"])


def base_spans(docs: DataFrame) -> DataFrame:
    """docs and the array __base: the base matches of each text, kind by kind. Null texts have none."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.withColumn("__text", text)
    t, empty = F.col("__text"), F.array().cast(_SPANS)
    parts = []
    for kind, pattern, valid, sign in _BASE:
        may = F.contains(t, F.lit(sign)) if sign else F.lit(True)
        if kind != "email":
            may = may & t.rlike("[0-9]")
        parts.append(F.when(may, _located(t, kind, pattern, valid)).otherwise(empty))
    return docs.withColumn("__base", F.concat(*parts)).drop("__text")


def _term(word: Column) -> Column:
    """A word without the punctuation around it, in lower case."""
    return F.lower(F.regexp_replace(word, "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$", ""))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD_PATTERN), F.lit(0))


def _own(s: Column) -> Column:
    return F.concat_ws(":", s["kind"], F.lower(s["value"]))


def _pool(s: Column) -> Column:
    """The domain of an address, the first three octets, a card's issuer (6 digits), a number without its last 4 digits."""
    v = F.lower(s["value"])
    of = F.when(s["kind"] == "email", F.substring_index(v, "@", -1)).when(s["kind"] == "ip", F.substring_index(v, ".", 3))
    of = of.when(s["kind"] == "card", F.substring(_digits(v), 1, 6)).otherwise(F.regexp_replace(_digits(v), "....$", ""))
    return F.concat_ws(":", F.concat(s["kind"], F.lit("*")), of)


def _entities(base: Column) -> Column:
    """The distinct entities of a text's base spans, and their pools: most entities stand in a document or two, too few to learn from, so they are judged together as well."""
    return F.array_distinct(F.concat(F.transform(base, _own), F.transform(base, _pool)))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(_words(text), _term))


def _signature(text: Column) -> Column:
    """The least hash of the text's three-word runs under each of SIGNATURE orders."""

    def under(order: int):
        return lambda h: F.xxhash64(F.lit(order), h)

    def least(hashes: Column) -> Column:
        return F.array(*[F.array_min(F.transform(hashes, under(i))) for i in range(SIGNATURE)])

    def hashes(w: Column) -> Column:
        last = F.greatest(F.size(w) - 3, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    words = F.transform(_words(text), _term)
    return F.get(F.transform(F.array(words), lambda w: F.get(F.transform(F.array(hashes(w)), least), F.lit(0))), F.lit(0))


def _texts_with_entities(docs: DataFrame) -> DataFrame:
    """A row for each distinct text with entities: __text_key, copies (rows with it), text and entities."""
    rows = docs.filter(F.size("__base") > 0).select(F.xxhash64("text").alias("__text_key"), "text", _entities(F.col("__base")).alias("entities"))
    return rows.groupBy("__text_key").agg(F.count("*").alias("copies"), F.first("text").alias("text"), F.first("entities").alias("entities"))


def _known(texts: DataFrame) -> DataFrame:
    """entity, n_entity (documents) and n_texts (distinct texts, no fewer than its witnesses)."""
    return texts.select("copies", F.explode("entities").alias("entity")).groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.count("*").alias("n_texts"))


def _in_reach(total: float) -> Column:
    """Whether a term could disclose the entity at all: one that stands with it in every text and nowhere else."""
    return _discloses(total, F.col("n_entity"), F.col("n_entity"), F.col("n_texts"))


def _discloses(total: float, n_both: Column, n_term: Column, witnesses: Column) -> Column:
    content = F.log2(F.lit(total) / F.col("n_entity"))
    shared = F.log2(n_both * F.lit(total) / (F.col("n_entity") * F.greatest(n_term, n_both)))
    # The lower bound of the share is CHANCE ** (1 / witnesses) of the counted one; few witnesses need an entity of much information.
    return (content > 0) & (shared + math.log2(CHANCE) / witnesses >= DISCLOSURE * content)


def reach(docs: DataFrame) -> DataFrame:
    """By kind: entities, those out of reach (no term could disclose them, for want of texts), and those out of reach whose pool is too.

    docs: doc_id and text. A kind with * is one of pools.
    """
    found = written(base_spans(docs))
    texts = _texts_with_entities(found)
    known = written(_known(texts).select("entity", _in_reach(float(docs.count())).alias("__in")))
    spans = found.select(F.explode("__base").alias("s")).select(_own(F.col("s")).alias("entity"), _pool(F.col("s")).alias("pool")).distinct()
    pooled = spans.join(known.select(F.col("entity").alias("pool"), F.col("__in").alias("__pooled")), "pool").drop("pool")
    rows = known.join(pooled, "entity", "left")
    lone = ~F.col("__in") & ~F.coalesce("__pooled", F.lit(False))
    return rows.groupBy(F.substring_index("entity", ":", 1).alias("kind")).agg(F.count("*").alias("entities"), F.count_if(~F.col("__in")).alias("out_of_reach"), F.count_if(lone).alias("without_pool"))


def _joined(rows: DataFrame, small: DataFrame, n: int, on) -> DataFrame:
    return rows.join(F.broadcast(small) if n <= BROADCAST_ROWS else small, on)


def disclosing_terms(docs: DataFrame) -> DataFrame | None:
    """entity and term, where the term discloses the entity; None if there are none.

    docs: text and __base. All counts are of documents, copies included: those
    with the entity, with the term, with both, and all. Copies count once only
    as witnesses. Two texts share an entry of their signatures as often as
    they share runs of words, so the mean number of distinct entries tells how
    many texts of their own stand behind a pair; near copies add little to it.
    """
    total = float(docs.count())
    texts = _texts_with_entities(docs)
    known = written(_known(texts).filter(_in_reach(total)))
    n_known = known.count()
    if not n_known:
        return None
    chosen = _joined(texts.select("__text_key", F.explode("entities").alias("entity")), known, n_known, "entity")
    chosen = chosen.groupBy("__text_key").agg(F.collect_list(F.struct("entity", "n_entity")).alias("known"))
    chosen = written(texts.join(chosen, "__text_key").select("__text_key", "copies", "known", _terms(F.col("text")).alias("terms"), _signature(F.col("text")).alias("signature")))
    pairs = chosen.select("__text_key", "copies", "signature", F.explode("known").alias("k"), "terms").select("__text_key", "copies", "signature", F.col("k.entity").alias("entity"), F.col("k.n_entity").alias("n_entity"), F.explode("terms").alias("term"))
    pairs = pairs.filter((F.length("term") > 0) & ~F.endswith("entity", F.concat(F.lit(":"), F.col("term"))))
    together = pairs.groupBy("entity", "term").agg(F.sum("copies").alias("n_both"), F.count("*").alias("n_texts"), F.first("n_entity").alias("n_entity"))
    together = together.filter(_discloses(total, F.col("n_both"), F.col("n_both"), F.col("n_texts")))
    # A term is at least as frequent as it is in the texts with entities; that alone rules out the common words.
    least = docs.filter(F.size("__base") > 0).select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_least"))
    together = written(together.join(least, "term").filter(_discloses(total, F.col("n_both"), F.col("n_least"), F.col("n_texts"))).drop("n_least"))
    terms = written(together.select("term").distinct())
    rows = terms.count()
    if not rows:
        return None
    spread = _joined(docs.select(F.explode(_terms(F.col("text"))).alias("term")), terms, rows, "term").groupBy("term").agg(F.count("*").alias("n_term"))
    together = written(together.join(spread, "term").filter(_discloses(total, F.col("n_both"), F.col("n_term"), F.col("n_texts"))))
    entries = _joined(pairs.select("entity", "term", "signature"), together.select("entity", "term"), together.count(), ["entity", "term"])
    entries = entries.select("entity", "term", F.posexplode("signature")).groupBy("entity", "term", "pos", "col").agg(F.lit(1).alias("one"))
    witnesses = entries.groupBy("entity", "term").agg((F.count("*") / F.lit(SIGNATURE)).alias("witnesses"))
    out = written(together.join(witnesses, ["entity", "term"]).filter(_discloses(total, F.col("n_both"), F.col("n_term"), F.col("witnesses"))).select("entity", "term"))
    return None if out.isEmpty() else out


def _terms_found(text: Column, terms: Column) -> Column:
    """Places of the words of a text whose term is listed."""
    between, found = F.split(text, WORD_PATTERN, -1), F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPANS).alias("out"))

    def add(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["b"])
        end = start + F.length(pair["m"])
        span = F.array(F.struct(F.lit(TERM).alias("kind"), start.cast("long").alias("start"), end.cast("long").alias("end"), pair["m"].alias("value")))
        return F.struct(end.cast("long").alias("at"), F.when(F.array_contains(terms, _term(pair["m"])), F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    pairs = F.filter(F.arrays_zip(between.alias("b"), found.alias("m")), lambda x: x["m"].isNotNull())
    return F.aggregate(pairs, zero, add, lambda acc: acc["out"])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """docs with two arrays of (kind, start, end, value), in code points, end exclusive: base and spans.

    docs: columns doc_id and text; all columns stay (base and spans are
    replaced). A row for each row; null and empty texts have no spans. base:
    e-mail addresses, IPv4 addresses, card numbers that pass Luhn, and phone
    numbers, leftmost and non-overlapping within a kind. spans: these, then
    the terms that disclose an entity of the same text, outside the base spans.
    """
    # Written: the patterns run once over each text, and every later step reads the columns that it needs.
    found = written(base_spans(docs.withColumn("__key", F.xxhash64("doc_id", "text"))))
    disclosing = disclosing_terms(found)
    out = found.withColumn("base", F.col("__base"))
    if disclosing is None:
        return out.withColumn("spans", F.col("__base")).drop("__key", "__base")
    by_doc = found.filter(F.size("__base") > 0).select("__key", F.explode(_entities(F.col("__base"))).alias("entity")).distinct()
    by_doc = written(_joined(by_doc, disclosing, disclosing.count(), "entity").groupBy("__key").agg(F.collect_set("term").alias("__terms")))
    n_terms = by_doc.agg(F.sum(F.size("__terms") + 1)).first()[0] or 0
    out = out.join(F.broadcast(by_doc) if n_terms <= BROADCAST_ROWS else by_doc, "__key", "left")
    extra = F.when(F.col("__terms").isNotNull(), F.filter(_terms_found(F.col("text"), F.col("__terms")), lambda t: ~F.exists("__base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))).otherwise(F.array().cast(_SPANS))
    return out.withColumn("spans", F.concat("__base", extra)).drop("__key", "__base", "__terms")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span generalised to its kind; of spans that overlap, the one that begins first stands for all."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        piece = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], piece).otherwise(acc["out"]).alias("out"))

    return F.when(F.size(spans) > 0, F.aggregate(ordered, zero, add, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))).otherwise(text)
