"""Answers as typed facts, and the check that each fact is quoted from its own document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fold, number_in, text_of, year_agrees

_TYPES = {"number": T.DoubleType(), "integer": T.LongType(), "text": T.StringType(), "enum": T.StringType(), "bool": T.BooleanType(), "date": T.DateType()}


def facts_schema(specs: dict[str, dict]) -> T.StructType:
    """{fact: {"type", "values"?, "of"?}} as one struct of (value, quote), or arrays of such for lists, and the column of malformed answers."""
    one = lambda kind: T.StructType([T.StructField("value", _TYPES[kind]), T.StructField("quote", T.StringType())])
    fields = [T.StructField(n, T.ArrayType(one(s["of"])) if s["type"] == "list" else one(s["type"])) for n, s in specs.items()]
    return T.StructType([*fields, T.StructField("_malformed", T.StringType())])


def parse_answers(df: DataFrame, specs: dict[str, dict], raw: str = "raw") -> DataFrame:
    """df with facts and invalid: a value of the wrong type or outside its enumeration makes the answer invalid, never unstated."""
    parsed = F.from_json(F.col(raw), facts_schema(specs), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"})
    df = df.withColumn("facts", parsed)
    bad = F.col(raw).isNotNull() & (F.col("facts").isNull() | F.col("facts._malformed").isNotNull())
    for name, spec in specs.items():
        if spec.get("values"):
            value = F.col(f"facts.{name}.value")
            if spec["type"] == "list":
                bad = bad | F.coalesce(F.exists(f"facts.{name}", _outside(spec["values"])), F.lit(False))
            else:
                bad = bad | (value.isNotNull() & ~value.isin(*spec["values"]))
    return df.withColumn("invalid", F.coalesce(bad, F.lit(False)))


def _outside(values):
    return lambda x: F.coalesce(~x["value"].isin(*values), F.lit(False))


def quoted(fact: Column, folded_texts: Column, kind: str) -> Column:
    """Whether a stated fact's quote stands in one text, each text by itself; a number must stand in its quote, a date's year agree with it."""
    quote = fold(fact["quote"])
    ok = fact["value"].isNotNull() & (quote != "") & F.exists(folded_texts, lambda t: F.contains(t, quote))
    if kind in ("number", "integer"):
        ok = ok & number_in(fact["value"].cast("double"), fact["quote"])
    if kind == "date":
        ok = ok & year_agrees(fact["value"], fact["quote"])
    return F.coalesce(ok, F.lit(False))


def check_quotes(df: DataFrame, specs: dict[str, dict], texts: list[str]) -> DataFrame:
    """df with facts whose quotes don't hold cleared; list entries that don't hold are dropped."""
    # Without facts there is nothing to look up, and the texts stay unfolded.
    df = df.withColumn("__texts", F.when(F.col("facts").isNotNull(), F.array(*[fold(F.col(t)) for t in texts])))
    made = []
    for name, spec in specs.items():
        fact = F.col(f"facts.{name}")
        if spec["type"] == "list":
            made.append(F.filter(F.coalesce(fact, F.array().cast(fact_type(df, name))), _holds(spec["of"])).alias(name))
        else:
            made.append(F.when(quoted(fact, F.col("__texts"), spec["type"]), fact).otherwise(F.struct(F.lit(None).cast(_TYPES[spec["type"]]).alias("value"), F.lit("").alias("quote"))).alias(name))
    return df.withColumn("facts", F.struct(*made)).drop("__texts")


def _holds(kind: str):
    return lambda x: quoted(x, F.col("__texts"), kind)


def fact_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema["facts"].dataType[name].dataType


#: Passages up to so many, and of so many characters together, are broadcast; of more, passages and texts are shuffled by anchor.
FEW, FEW_CHARS = 100_000, 32 << 20
#: The most characters of a short passage's first word that are looked up.
PIECE = 64


def contained(texts: DataFrame, passages: DataFrame, text: str = "text", passage: str = "passage", width: int = 6) -> DataFrame:
    """texts joined with the passages that their folded text contains.

    Anchors turn the containment into equi-joins; those of up to FEW passages go
    to the texts, so the runs of the texts are not shuffled. A passage of three words or more is looked up by a run of at most
    `width` of its inner words (its first and last word may be parts of longer
    ones) among the runs of each text; a shorter one by its first word among
    the parts of the text's distinct words that are as long. The run widths and
    lengths that occur are at most `width` and PIECE numbers.
    """
    folded_texts = texts.withColumn("__text", fold(F.col(text)))
    keys = passages.withColumn("__passage", fold(F.col(passage))).filter("__passage <> ''").withColumn("__words", F.split("__passage", " "))
    inner = F.least(F.size("__words") - 2, F.lit(width))
    head = F.left(F.get("__words", F.lit(0)), F.lit(PIECE))
    kinds = keys.select(F.when(inner >= 1, inner).alias("run"), F.when(inner < 1, F.length(head)).alias("piece")).distinct().collect()
    widths, lengths = sorted({r.run for r in kinds if r.run}), sorted({r.piece for r in kinds if r.piece})
    # Marks keep runs and pieces apart.
    anchored = keys.withColumn("__anchor", F.when(inner >= 1, F.xxhash64(F.lit("run"), F.array_join(F.slice("__words", F.lit(2), inner), " "))).otherwise(F.xxhash64(F.lit("piece"), head))).drop("__words")

    def runs(words: Column, w: int) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - w + 1, F.lit(1))), lambda i: F.xxhash64(F.lit("run"), F.array_join(F.slice(words, i, w), " ")))
        return F.when(F.size(words) >= w, windows).otherwise(F.array().cast("array<bigint>"))

    def pieces(words: Column, n: int) -> Column:
        long = F.filter(F.array_distinct(words), lambda w: F.length(w) >= n)
        return F.flatten(F.transform(long, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.xxhash64(F.lit("piece"), F.substring(w, i, F.lit(n))))))

    def anchors(words: Column) -> Column:
        return F.concat(F.array().cast("array<bigint>"), *[runs(words, w) for w in widths], *[pieces(words, n) for n in lengths])

    # The words are bound once a text: inside the lambda itself they would be split anew for each run.
    grams = F.get(F.transform(F.array(F.split("__text", " ")), anchors), F.lit(0))
    probes = folded_texts.withColumn("__anchor", F.explode(F.array_distinct(grams)))
    n, chars = keys.agg(F.count("*"), F.sum(F.length("__passage"))).first()
    few = n <= FEW and (chars or 0) <= FEW_CHARS
    return probes.join(F.broadcast(anchored) if few else anchored, "__anchor").filter(F.contains("__text", F.col("__passage"))).drop("__anchor", "__text", "__passage")


def item_texts(*columns: str) -> Column:
    """The prompt form of an item: a heading and the text of each field, in order."""
    return F.concat_ws("\n\n", *[F.concat(F.lit(f"## {c}\n"), text_of(F.col(c))) for c in columns])
