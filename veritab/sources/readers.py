"""Readers of items, recorded answers and board payloads, and sinks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_remote, iso_date, text_of


def unique_ids(df: DataFrame, key: str = "id") -> DataFrame:
    """df; an id that stands twice is an error, not a duplicate to drop. The check is one aggregation."""
    twice = df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key).head(1)
    if twice:
        raise ValueError(f"id {twice[0][0]!r} stands more than once")
    return df


def items(df: DataFrame, key: str, fields: list[str], meta: list[str] = ()) -> DataFrame:
    """id, fields (ordered name and text), meta. A missing column is an error; a null text is empty."""
    made = F.array(*[F.struct(F.lit(f).alias("name"), text_of(F.col(f)).alias("text")) for f in fields])
    extra = F.create_map(*[x for m in meta for x in (F.lit(m), F.col(m).cast("string"))]) if meta else F.lit(None).cast("map<string,string>")
    return df.select(F.col(key).cast("string").alias("id"), made.alias("fields"), extra.alias("meta"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines are skipped; a line that is no JSON fails the read and is named."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def read_folder(spark: SparkSession, path: str, field: str = "text") -> DataFrame:
    """A row for each .txt or .md file: id is the name without its ending."""
    df = spark.read.option("wholetext", True).option("pathGlobFilter", "*.{txt,md}").text(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return df.select(F.regexp_replace(F.url_decode(name), "\\.(txt|md)$", "").alias("id"), F.col("value").alias(field))


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """id, line, raw of recorded answers; line is the place in the file's lines."""
    df = spark.read.text(path)
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return df.filter(F.trim("value") != "").select(F.get_json_object("value", "$.id").alias("id"), place.alias("line"), F.get_json_object("value", "$.raw").alias("raw"))


def write_results(df: DataFrame, path: str, ordinal: str = "ordinal") -> None:
    """One JSON line an item, in the items' order."""
    df.orderBy(ordinal).write.mode("overwrite").json(path)


JOB = "source string, company string, title string, location string, url string, description string, posted date, remote boolean, raw_id string"


@dataclass(frozen=True)
class Board:
    """How a board's payload maps to postings: where its rows stand, and each column's path or paths within a row."""

    rows: str
    raw_id: tuple[str, ...]
    title: tuple[str, ...]
    url: tuple[str, ...]
    location: tuple[str, ...] = ()
    company: tuple[str, ...] = ()
    description: tuple[str, ...] = ()
    posted: tuple[str, ...] = ()
    remote: tuple[str, ...] = ()
    joined_location: bool = False
    spare_location: str = ""
    uk_dates: bool = False


# The fields of each kind of payload.
BOARDS = {
    "greenhouse": Board("$.jobs", ("id",), ("title",), ("absolute_url",), ("location.name",), description=("content",), posted=("first_published", "updated_at")),
    "smartrecruiters": Board("$.content", ("id",), ("name",), ("ref", "id"), ("location.city", "location.country"), description=("jobAd.sections.jobDescription.text",), posted=("releasedDate", "createdOn"), remote=("location.remote",), joined_location=True),
    "lever": Board("$", ("id",), ("text",), ("hostedUrl", "applyUrl"), ("categories.location",), description=("descriptionPlain", "description"), posted=("createdAt",)),
    "ashby": Board("$.jobs", ("id",), ("title",), ("jobUrl", "applyUrl"), ("location",), description=("descriptionPlain", "descriptionHtml"), posted=("publishedAt",), remote=("isRemote",)),
    "workable": Board("$.jobs", ("shortcode", "id"), ("title",), ("url", "shortlink", "application_url"), ("city", "country"), description=("description",), posted=("published_on",), remote=("telecommuting",), joined_location=True),
    "workday": Board("$.jobPostings", ("externalPath",), ("title",), ("externalPath",), ("locationsText",)),
    "adzuna": Board("$.results", ("id",), ("title",), ("redirect_url",), ("location.display_name",), ("company.display_name",), ("description",), ("created",)),
    "reed": Board("$.results", ("jobId",), ("jobTitle",), ("jobUrl",), ("locationName",), ("employerName",), ("jobDescription",), ("date",), uk_dates=True),
    "workable_search": Board("$.jobs", ("id",), ("title",), ("url",), ("location.city", "location.subregion", "location.countryName"), ("company.title",), ("description", "requirementsSection"), ("created",), ("workplace",), joined_location=True, spare_location="locations[0]"),
    "jooble": Board("$.jobs", ("id",), ("title",), ("link",), ("location",), ("company",), ("snippet",), ("updated",)),
}


def postings(payloads: DataFrame, kind: str, label: Column | None = None) -> DataFrame:
    """Postings of payloads (one JSON text a row, column payload) of a board. Rows without a title or url are left out; count them with rejected()."""
    board = BOARDS[kind]
    rows = F.from_json(F.get_json_object("payload", board.rows), T.ArrayType(T.StringType()))
    df = payloads.select(*[c for c in payloads.columns if c != "payload"], F.explode(rows).alias("__row"))

    def first(paths: tuple[str, ...]) -> Column:
        found = [F.nullif(F.get_json_object("__row", f"$.{p}"), F.lit("")) for p in paths]
        return F.coalesce(*found, F.lit("")) if found else F.lit("")

    place = F.concat_ws(", ", *[F.nullif(F.get_json_object("__row", f"$.{p}"), F.lit("")) for p in board.location]) if board.joined_location else first(board.location)
    if board.spare_location:
        place = F.coalesce(F.nullif(place, F.lit("")), first((board.spare_location,)))
    posted = F.try_to_timestamp(first(board.posted), F.lit("dd/MM/yyyy")).cast("date") if board.uk_dates else iso_date(first(board.posted))
    remote = F.lower(first(board.remote)).isin("true", "1", "remote") | is_remote(place, first(board.title))
    out = df.select(F.lit(kind).alias("source"), F.coalesce(F.nullif(first(board.company), F.lit("")), label if label is not None else F.lit("")).alias("company"), first(board.title).alias("title"), place.alias("location"), first(board.url).alias("url"), first(board.description).alias("description"), posted.alias("posted"), remote.alias("remote"), first(board.raw_id).alias("raw_id"))
    return out.filter("title <> '' and url <> ''")


def sitemap(xml: Column) -> Column:
    """loc and lastmod of a sitemap, well-formed or not."""
    entries = F.regexp_extract_all(xml, F.lit("(?s)<url>(.*?)</url>"), F.lit(1))
    return F.transform(entries, lambda e: F.struct(F.trim(F.regexp_extract(e, "(?s)<loc>(.*?)</loc>", 1)).alias("loc"), F.left(F.trim(F.regexp_extract(e, "(?s)<lastmod>(.*?)</lastmod>", 1)), F.lit(10)).try_cast("date").alias("lastmod")))


def probe(error: Column, skipped: Column, n: Column) -> Column:
    """What a look at a source says."""
    return F.when(error.isNotNull(), "FAIL").when(skipped, "SKIPPED").when(n == 0, "EMPTY").otherwise("OK")
