"""Quality rules: a table of thresholds compiled into one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._packed import WORD_PATTERN

#: Very common words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is it that on for as with are was be this by from or at a an he his she they you not "
    "le la les de des du et un une en est que qui dans pour par sur au aux avec pas "
    "der die das und ist im den von zu mit auf für ein eine dem nicht sich auch es "
    "el los las del y se por con para su al lo como no más o si"
).split()


#: Very common words of further languages in Latin script, without those above and single letters.
OTHER_STOP_WORDS = {
    lang: [w for w in words.split() if len(w) > 1 and w not in STOP_WORDS]
    for lang, words in {
        "it": "il di che è per una sono della nel con non alla dei anche più come gli",
        "pt": "o do da em um uma não os as dos com para mais mas foi ele são na no ao",
        "nl": "het een van en dat niet zijn voor met op aan ook bij maar naar wordt uit",
        "sv": "och att det som en på är av för med till den har inte om ett men var",
        "da": "og at det er som på af for med til den har ikke de et en men blev",
        "no": "og at det er som på av for med til den har ikke de et en men ble",
        "fi": "ja on ei se että oli hän ovat mutta myös joka kun niin kuin sen ole",
        "pl": "i w nie na się z do jest to że jak po co przez dla od są oraz był",
        "cs": "a v se na je že s z do to jako za by ale pro jsou podle byl který",
        "sk": "a v sa na je že s z do to ako za by ale pre sú podľa bol ktorý",
        "hu": "a az és hogy nem is egy ez meg volt csak mint már még de van ha",
        "ro": "și în de la cu nu pe este că o din sunt pentru mai care un se",
        "tr": "ve bir bu da de için ile olarak çok daha olan gibi ne var kadar sonra",
        "hr": "i je u na da se su za od s koji kao ali ili što bio iz nije",
        "ca": "i el la de que en un amb per no és els les una del al més com",
        "id": "yang dan di dengan untuk dari ini itu dalam tidak pada adalah ke akan oleh",
        "vi": "và của là các có được trong cho một không với những người này đã để",
        "sw": "ya na wa kwa ni katika la za hii kuwa cha kama lakini hiyo huo",
    }.items()
}


@dataclass(frozen=True)
class Threshold:
    """A document is rejected where numerator / denominator is below low or above high."""

    name: str
    numerator: str
    denominator: str | None = None
    low: float | None = None
    high: float | None = None


#: The least share of very common words; it holds for texts of the four languages, and of no language that is known.
STOP_SHARE = 0.04

#: The rules of the verdict, over the measures of measures().
RULES = (
    Threshold("length", "n_words", low=50),
    Threshold("repeats", "n_repeat_words", "n_words", high=0.5),
    Threshold("symbols", "n_symbols", "n_words", high=0.3),
    Threshold("exclamations", "n_exclamations", "n_words", high=0.5),
    Threshold("stop_words", "n_stop_words", "n_words", low=STOP_SHARE),
    Threshold("duplicate_lines", "n_dup_lines", "n_lines", high=0.5),
    Threshold("word_length", "word_chars", "n_words", low=2.0, high=15.0),
)


def _covered(hashes: Column) -> Column:
    """Words in windows of three whose hash stands at two places or more."""
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        last = F.size(s) - 1
        twice = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(s, k + 1)["h"] == x["h"])))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def total(at: Column) -> Column:
        return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")), lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["at"])).alias("n"), i.alias("at")), lambda acc: acc["n"].cast("long"))

    return _let(placed, lambda s: _let(places(s), total))


def _let(value: Column, use) -> Column:
    """use(value), with value worked out once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _count(text: Column, others: str) -> Column:
    """Characters left when runs of `others` are taken out."""
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def _other_language(t: Column, w: Column, stop_words: Column) -> Column:
    """Whether few words are of the listed languages and the letters are mostly of another script, or many words of a further language."""
    n = F.size(w)
    others = F.greatest(*[F.size(F.filter(w, _is_one_of(x))) for x in OTHER_STOP_WORDS.values()])
    letters = _count(t, "\\P{L}++")
    script = (letters > 0) & (2 * _count(t, "[\\P{L}\\p{IsLatin}]++") > letters)
    return F.when(stop_words >= STOP_SHARE * n, F.lit(False)).otherwise(script | (others >= STOP_SHARE * n))


def _stop_words(w: Column) -> Column:
    return F.size(F.filter(w, _is_one_of(STOP_WORDS)))


def _is_one_of(words: list[str]):
    return lambda x: F.lower(x).isin(words)


def _hashes(words: Column) -> Column:
    """A hash of each three words in turn."""
    n = F.size(words)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))


def _repeated(hashes: Column) -> Column:
    """Words in repeated windows; documents whose windows all differ need no sort."""
    return F.coalesce(F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _covered(hashes)), F.lit(0)).cast("long")


def measures(text: Column) -> Column:
    """A struct of the counts that rules refer to; a null text has none of anything.

    Words, windows and lines are worked out once, inside: as columns of their
    own, a filter on the verdict would repeat them wherever a rule needs them.
    """

    def of(t: Column, w: Column, lines: Column) -> Column:
        n = F.size(w)
        return F.struct(
            n.cast("long").alias("n_words"),
            (F.length(t) - _count(t, "[^\\x20\\x09-\\x0D]++")).cast("long").alias("word_chars"),
            _count(t, "[^#*$%&|<>]++").alias("n_symbols"),
            _count(t, "[^!]++").alias("n_exclamations"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _stop_words(w).cast("long").alias("n_stop_words"),
            _let(_hashes(w), _repeated).alias("n_repeat_words"),
            _let(_stop_words(w), lambda k: _other_language(t, w, k)).alias("other_language"),
        )

    words = lambda t: F.regexp_extract_all(t, F.lit(WORD_PATTERN), F.lit(0))
    lines = lambda t: F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_PATTERN))
    return _let(F.coalesce(text.cast("string"), F.lit("")), lambda t: _let(words(t), lambda w: _let(lines(t), lambda ls: of(t, w, ls))))


def verdict(measure: Column, rules=RULES) -> Column:
    """True where no rule rejects; a ratio with nothing below rejects nothing."""
    kept = F.lit(True)
    for r in rules:
        value = measure[r.numerator].cast("double")
        if r.denominator is not None:
            value = F.when(measure[r.denominator] != 0, value / measure[r.denominator])
        for bound, bad in ((r.low, lambda v, b: v < b), (r.high, lambda v, b: v > b)):
            if bound is not None:
                rejects = F.coalesce(bad(value, F.lit(float(bound))), F.lit(False))
                kept = kept & ~(rejects & ~measure["other_language"] if r.numerator == "n_stop_words" else rejects)
    return kept


def assessed(text: Column, rules=RULES) -> Column:
    """The measures of a text with base_failed and kept."""

    def judge(m: Column) -> Column:
        failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        return F.struct(*[m[x].alias(x) for x in MEASURES], failed.alias("base_failed"), (~failed & verdict(m, rules)).alias("kept"))

    return _let(measures(text), judge)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_exclamations", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words")


def quality_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    """The measures of every document, base_failed, and kept.

    docs: columns doc_id and text; all columns stay (columns named like a
    measure are replaced). A row for each row. Null or empty texts have no
    words and fail. base_failed: fewer than 50 words, or more than half of
    them in windows of three words that stand twice or more. kept: neither
    base_failed nor rejected by a rule.
    """
    out = docs.withColumn("__assessed", assessed(F.col("text"), rules))
    return out.withColumns({x: F.col(f"__assessed.{x}") for x in (*MEASURES, "base_failed", "kept")}).drop("__assessed")


def good_texts(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of docs that quality_rules keeps, as they are."""
    return docs.filter(assessed(F.col("text"), rules)["kept"])
