"""A directory of boards: entries from JSON files of several shapes, and a search by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.similarity import matching_ratio

# Parts of file names, and the kind of board they stand for.
KINDS = {"greenhouse": "greenhouse", "lever": "lever", "ashby": "ashby", "workday": "workday", "smartrecruiter": "smartrecruiters", "workable": "workable", "recruitee": "recruitee"}
# Where a payload keeps its list, and an entry its slug and name.
WRAPPERS = ("companies", "data", "results", "items", "boards")
SLUG_KEYS = ("slug", "identifier", "token", "board", "board_token", "company_slug", "id", "key", "tenant")
NAME_KEYS = ("name", "company", "company_name", "display_name", "title", "label")
# Words of a legal form, which a key leaves out.
NOISE = ("the", "inc", "ltd", "limited", "llc", "plc", "group", "holdings", "co", "corp", "corporation", "company", "gmbh", "ag", "sa", "nv", "bv", "pjsc", "llp")
# The least score of a hit; scores of equal slugs, names and keys; floors of a slug or name that holds the name asked, if that has four letters; the length from which a ratio is trusted, and the most of a shorter one.
LEAST, SLUG, NAME, KEY, IN_SLUG, IN_NAME, HOLDS, TRUSTED, SHORT = 0.55, 1.0, 0.99, 0.97, 0.85, 0.88, 4, 6, 0.84


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """kind, slug, name, site, host of every JSON file below path. Files whose name tells no kind, or that hold no JSON, give nothing; an entry that stands several times is kept once, with a name if one has it."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("payload"))
    return index(files)


def index(files: DataFrame) -> DataFrame:
    """Entries of files (file, payload)."""
    stem = F.lower(F.element_at(F.split("file", "/"), -1))
    kind = F.coalesce(*[F.when(F.contains(stem, F.lit(part)), F.lit(k)) for part, k in KINDS.items()])
    df = files.withColumn("kind", kind).filter("kind is not null").withColumn("v", F.try_parse_json("payload")).filter("v is not null")
    for _ in range(2):
        df = df.withColumn("v", F.coalesce(*[F.try_variant_get("v", f"$.{w}", "variant") for w in WRAPPERS], F.col("v")))
    as_list = F.try_variant_get("v", "$", "array<variant>")
    as_map = F.try_variant_get("v", "$", "map<string,variant>")
    first = lambda x, keys: F.coalesce(*[F.nullif(F.try_variant_get(x, f"$.{k}", "string"), F.lit("")) for k in keys])
    bare = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))
    obj = lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT"))

    def listed(x: Column) -> Column:
        text = bare(x)
        parts = F.split(text, "\\|")
        triple = (F.size(parts) == 3) & F.forall(parts, lambda p: F.trim(p) != "")
        part = lambda i: F.trim(F.get(parts, F.lit(i)))
        return F.struct(
            F.when(triple, part(0)).when(text.isNotNull(), text).when(obj(x), first(x, SLUG_KEYS)).alias("slug"), F.when(obj(x), first(x, NAME_KEYS)).alias("name"),
            F.when(triple, part(2)).when(obj(x), first(x, ("site",))).alias("site"), F.when(triple, part(1)).when(obj(x), first(x, ("host",))).alias("host"),
        )

    def mapped(e: Column) -> Column:
        x = e["value"]
        nothing = F.lit(None).cast("string")
        return F.struct(e["key"].alias("slug"), F.coalesce(bare(x), F.when(obj(x), first(x, NAME_KEYS))).alias("name"), nothing.alias("site"), nothing.alias("host"))

    lists = df.select("kind", "file", F.posexplode(F.transform(as_list, listed)).alias("at", "e"))
    maps = df.filter(as_list.isNull()).select("kind", "file", F.posexplode(F.transform(F.map_entries(as_map), mapped)).alias("at", "e"))
    found = lists.unionByName(maps).select("kind", "file", "at", "e.*").filter("slug is not null and slug <> ''").fillna("", ["name", "site", "host"])
    best = F.min_by(F.struct("name", "host"), F.struct(F.col("name") == "", "file", "at"))
    return found.groupBy("kind", "slug", "site").agg(best.alias("b")).select("kind", "slug", "b.name", "site", "b.host")


def key(c: Column) -> Column:
    """A name without legal forms, marks and spaces."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", " "), f"\\b({'|'.join(NOISE)})\\b", " "), "[^a-z0-9]+", "")


def score(asked: Column, slug: Column, name: Column) -> Column:
    """How well an entry answers a name: equal slugs, names and keys first, then a matching ratio. A ratio of short texts says little and is held down; an entry that holds what is asked is lifted, not the reverse."""
    a, s, n = key(asked), key(slug), key(name)

    def ratio(x: Column, floor: float) -> Column:
        r = matching_ratio(a, x)
        r = F.when(F.least(F.length(a), F.length(x)) < TRUSTED, F.least(r, F.lit(SHORT))).otherwise(r)
        return F.when((F.length(a) >= HOLDS) & F.contains(x, a), F.greatest(r, F.lit(floor))).otherwise(r)

    exact = F.when(F.lower(F.trim(asked)) == F.lower(slug), SLUG).when((name != "") & (F.lower(F.trim(asked)) == F.lower(name)), NAME).when((a != "") & ((a == s) | (a == n)), KEY)
    return F.coalesce(exact, F.greatest(ratio(s, IN_SLUG), F.when(n != "", ratio(n, IN_NAME)).otherwise(F.lit(0.0))))


def search(entries: DataFrame, names: list[str], most: int = 8) -> DataFrame:
    """asked, kind, slug, name, score: the best entries for each of a few stated names, at least LEAST. One pass over the entries for all names, and the first `most` of each; entries are never compared with each other."""
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "kind", "slug"))
    asked = entries.withColumn("asked", F.explode(F.array(*map(F.lit, dict.fromkeys(names)))))
    hits = asked.withColumn("score", score(F.col("asked"), F.col("slug"), F.col("name"))).filter(F.col("score") >= LEAST)
    return hits.withColumn("__rank", rank).filter(F.col("__rank") <= most).select("asked", "kind", "slug", "name", "score")
