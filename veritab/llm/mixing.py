"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source should be taken target / source_size times. The
whole part is taken outright; the fraction is rounded dependently: fractional
documents meet, and a random amount of words moves from one side's fractions to
the other's so that one becomes integral. The draw is fair: it keeps each
document's expectation, and the words of both sides together. A large document
meets as many smaller ones as can balance it, each with a share of its mass
that is the same whichever way the draw falls. Documents meet in groups by
hash, largest first; the residual of each group meets others in the levels of a
reduction tree. The last residual of a source is drawn by its own fraction, so
a source misses its target by less than that document's size.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._packed import WORD_PATTERN, written

#: Expected documents of a group, and nodes that a node of the next level takes up.
GROUP_ROWS = 4000
FAN = 256
#: A table of sources up to so many rows may be broadcast; a larger one is shuffled.
BROADCAST_SOURCES = 100_000
_M = (1 << 64) - 1


def _unit(*parts: int) -> float:
    """A number in [0, 1) that depends on nothing but the parts."""
    x = 0
    for p in parts:
        x = (x ^ (p & _M)) + 0x9E3779B97F4A7C15 & _M
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _M
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _M
        x ^= x >> 31
    return (x >> 11) / (1 << 53)


def _pair(i: int, j: int, rows: list, out: list[float], seed: int) -> int:
    """Moves words between the fractions of two documents until one is integral; the one that isn't, or -1."""
    (a, v, _), (b, w, _) = rows[i], rows[j]
    p, q = out[i], out[j]
    up, down = (1 - p) * v, p * v
    gain, loss = min(up, q * w), min(down, (1 - q) * w)
    if _unit(seed, a, b) * (gain + loss) < loss:
        out[i], out[j] = 1.0 if up <= q * w else p + gain / v, 0.0 if q * w <= up else q - gain / w
    else:
        out[i], out[j] = 0.0 if down <= (1 - q) * w else p - loss / v, 1.0 if (1 - q) * w <= down else q + loss / w
    return next((k for k in (i, j) if 0.0 < out[k] < 1.0), -1)


def _settle(i: int, partners: list[tuple[int, float]], rows: list, out: list[float], seed: int) -> None:
    """Makes document i integral; each partner gives or takes the same share of its mass, whichever way it goes."""
    key, size, _ = rows[i]
    p = out[i]
    up = _unit(seed, key, i) < p
    moved = -(1 - p) * size if up else p * size
    total = sum(c for _, c in partners)
    for j, c in partners:
        value = out[j] + c / total * moved / rows[j][1]
        out[j] = 0.0 if value < 1e-12 else 1.0 if value > 1 - 1e-12 else value
    out[i] = 1.0 if up else 0.0


def pivotal(rows: list[tuple[int, int, float]], seed: int) -> list[float]:
    """Rounds fractions; rows: (key, size, fraction), largest first. All results but one at most are 0.0 or 1.0, and each keeps its expectation.

    A partner j can bear a share of i's mass up to what it has to give if i
    rises and room to take if i falls; i meets the following ones until they
    can bear it all. One that all the rest can't bear is set aside; those meet
    in pairs at the end.
    """
    out = [x[2] if x[1] > 0 and 0.0 < x[2] < 1.0 else round(x[2]) * 1.0 for x in rows]
    open_ = [k for k in range(len(rows)) if 0.0 < out[k] < 1.0]
    aside: list[int] = []
    for at, i in enumerate(open_):
        p, size = out[i], rows[i][1]
        if not 0.0 < p < 1.0:
            continue
        partners, borne = [], 0.0
        for j in open_[at + 1 :]:
            q = out[j]
            if 0.0 < q < 1.0:
                share = min(q / (1 - p), (1 - q) / p) * rows[j][1] / size
                partners.append((j, share))
                borne += share
                if borne >= 1.0:
                    break
        if borne >= 1.0:
            _settle(i, partners, rows, out, seed)
        else:
            aside.append(i)
    holder = -1
    for j in aside:
        if 0.0 < out[j] < 1.0:
            holder = j if holder < 0 else _pair(holder, j, rows, out, seed)
    return out


def _numbered(by: DataFrame) -> DataFrame:
    """by with place: its rows' numbers by source (code points, null last); sorted in ranges, so no task takes all sources."""
    ordered = written(by.orderBy(F.col("source").asc_nulls_last()).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    counts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row for each task of the sort
    before, starts = 0, {}
    for r in counts:
        starts[r["part"]] = before
        before += r["n"]
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), part) if starts else F.lit(0)
    return ordered.withColumn("place", (offset + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("__id")


def targets(slim: DataFrame, weights=(1, 2, 3), cap: float = 3.0) -> DataFrame:
    """source, source_size, n_docs, place (by code point, null last) and target: weighted shares of the total that stop at cap times a source's size, the excess reshared."""
    by = slim.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("n_docs"))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("place") % len(weights) + 1).cast("int"))
    by = written(_numbered(by).withColumn("weight", weight).withColumn("limit", F.lit(float(cap)) * F.col("source_size")))
    level, full = 0.0, -1
    while True:
        # Sums of whole numbers: the same in any order.
        stops = F.col("limit") <= F.lit(level) * F.col("weight")
        total, stopped, weighs, n = by.agg(F.sum("source_size"), F.sum(F.when(stops, F.col("limit"))), F.sum(F.when(~stops, F.col("weight"))), F.count_if(stops)).first()
        if n == full or not weighs:
            break
        level, full = (float(total) - (stopped or 0.0)) / weighs, n
    target = F.col("limit") if full >= 0 and not weighs else F.least(F.lit(level) * F.col("weight"), F.col("limit"))
    return by.select("source", "source_size", "n_docs", "place", F.coalesce(target.cast("double"), F.lit(0.0)).alias("target"))


_SCHEMA = "key long, doc_id long, source string, size long, source_size long, target double, whole long, p double, place int, node long"


def _round(seed: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("key", "ascending")])
        rows = list(zip(table["key"].to_pylist(), table["size"].to_pylist(), table["p"].to_pylist(), strict=True))
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(pivotal(rows, seed), pa.float64()))

    return run


def mix_sources(docs: DataFrame, weights=(1, 2, 3), cap: float = 3.0, seed: int = 11) -> DataFrame:
    """How often each document is taken so that sources share the words by weight.

    docs: columns doc_id, text and source; others are ignored. A row for each
    row: doc_id, key (a hash of doc_id and text), source, size (words; null
    text: 0), source_size, target (words of its source), copies and taken
    (copies x size). Documents without words have whole copies only. Rows that
    are equal throughout are rounded each by itself. Reruns agree: every
    draw is a hash of the two documents that meet.
    """
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    slim = written(docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size")))
    by = written(targets(slim, weights, cap))
    most, sources = by.agg(F.max("n_docs"), F.count("*")).first()
    most = most or 0
    joined = slim.alias("d").join((F.broadcast(by) if sources <= BROADCAST_SOURCES else by).alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate + 1e-12)
    salts = F.ceil(F.col("n_docs") / F.lit(GROUP_ROWS)).cast("long")
    frame = joined.select("key", "doc_id", "d.source", "size", "source_size", "target", whole.cast("long").alias("whole"), F.greatest(rate - whole, F.lit(0.0)).alias("p"), F.col("place").cast("int").alias("place"), F.pmod("key", salts).alias("node"))
    done, level = [], 0
    nodes = max(1, math.ceil(most / GROUP_ROWS))
    while True:
        frame = written(frame.groupBy("place", "node").applyInArrow(_round(seed + level), _SCHEMA))
        level += 1
        if nodes <= 1:
            break
        settled = (F.col("p") <= 0) | (F.col("p") >= 1)
        done.append(frame.filter(settled))
        frame, nodes = frame.filter(~settled).withColumn("node", F.floor(F.col("node") / FAN)), math.ceil(nodes / FAN)
    done.append(frame)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    # One document a source at most is left with a fraction: it is drawn by that.
    draw = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.col("whole") + (draw < F.col("p")).cast("long")
    return out.select("doc_id", "key", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def take(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """Each document of docs as often as mix_sources(docs) says; equal rows are counted through."""
    nth = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(F.lit(0)))
    left = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    left = left.withColumn("__nth", nth("__key"))
    right = mixed.select(F.col("key").alias("__key"), F.col("copies").alias("__copies")).withColumn("__nth", F.row_number().over(Window.partitionBy("__key").orderBy("__copies")))
    out = left.join(right, ["__key", "__nth"]).filter("__copies > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(docs.columns)
