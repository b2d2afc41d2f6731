"""Nearest neighbours by collision counting over single projections.

The index is built once and written: vectors are dealt to blocks by ranges of
two projections, and each block stores one sorted array for each of PROJECTIONS
random lines. In its own block a query's window on each array is centred at the
query and widens step by step with the radius R (virtual rehashing: the same
arrays serve every R). A vector that falls into the windows of enough arrays is
verified by its distance; when the k nearest verified ones lie within R, their
largest distance is the query's radius everywhere else. The query then visits
only blocks whose ranges lie under that radius, and in each counts collisions
in windows of that one radius.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._packed import written

PROJECTIONS = 48
#: Window width at radius 1, and the share of projections on which a vector must collide.
WIDTH = 2.4
THRESHOLD = 0.62
NEED = math.ceil(THRESHOLD * PROJECTIONS)
GROWTH = 1.25
#: Numbers in a block's vectors, and vectors of a block at most; queries that one task takes to a block.
BLOCK_NUMBERS, BLOCK_ROWS, QUERY_ROWS = 1 << 19, 4096, 2048
#: Vectors of a block from whose distances a query's first radius is guessed.
GUESS = 256
#: Tables up to so many rows may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 100_000
SEED = 7

_KEYS = ["dim", "slab", "sub", "part"]
_PLACED = "row long, vec_id long, dim int, asks boolean, embedding {}, p0 double, p1 double"
_INDEX = "dim int, slab int, sub int, part int, low0 double, high0 double, low1 double, high1 double, rows binary, ids binary, vectors binary, values binary, order binary, queries array<struct<row:long,query_id:long,radius:double,p0:double,p1:double,vector:binary>>"
_FOUND = "query long, query_id long, row long, vec_id long, score double"


def _lines(dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, PROJECTIONS))


def _project(vectors: np.ndarray, lines: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num(vectors @ lines, nan=0.0)


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances; scaled before squaring where squares would leave the range of doubles."""
    with np.errstate(over="ignore", invalid="ignore"):
        gap = vectors - query
        out = np.sqrt((gap**2).sum(1))
        odd = np.flatnonzero(~np.isfinite(out) | (out < 1e-140))
        if len(odd):
            most = np.abs(gap[odd]).max(1)
            fits = np.isfinite(most) & (most > 0)
            odd, most = odd[fits], most[fits]
            out[odd] = most * np.sqrt(((gap[odd] / most[:, None]) ** 2).sum(1))
    return out


class Block:
    """The sorted arrays of some vectors: values[j] ascends, and order[j] names their vectors."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, values: np.ndarray, order: np.ndarray) -> None:
        self.rows, self.ids, self.vectors, self.values, self.order = rows, ids, vectors, values, order
        #: Projections of one vector, computed in batches of other shapes, differ in their last bits.
        self.slack = float(np.abs(values[:, [0, -1]]).max()) * (1e-6 if values.dtype == np.float32 else 1e-12)

    @classmethod
    def of(cls, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> Block:
        placed = _project(vectors, _lines(vectors.shape[1])).T
        order = np.argsort(placed, axis=1, kind="stable")
        values = np.take_along_axis(placed, order, 1)
        small = np.abs(values[:, [0, -1]]).max() < 1e30
        return cls(rows, ids, vectors, values.astype(np.float32 if small else np.float64), order.astype(np.uint16))

    def windows(self, at: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Where each array's window of a query begins and ends."""
        half = radius * WIDTH / 2 + self.slack
        low = np.array([v.searchsorted(x, "left") for v, x in zip(self.values, at - half, strict=True)])
        return low, np.array([v.searchsorted(x, "right") for v, x in zip(self.values, at + half, strict=True)])

    def collisions(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """On how many arrays each vector lies in the window; counted by what lies outside where that is less."""
        n = len(self.rows)
        outside = 2 * int((high - low).sum()) > n * PROJECTIONS
        parts = [x for o, a, b in zip(self.order, low, high, strict=True) for x in ((o[:a], o[b:]) if outside else (o[a:b],))]
        counts = np.bincount(np.concatenate(parts), minlength=n)
        return PROJECTIONS - counts if outside else counts

    def best(self, row: int, query: np.ndarray, colliding: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest of the colliding vectors, verified, and their distances; ties go to the smaller vec_id."""
        near = colliding[self.rows[colliding] != row]
        far = distances(self.vectors[near], query)
        if len(near) > 4 * k:
            keep = far <= np.partition(far, k - 1)[k - 1]
            near, far = near[keep], far[keep]
        first = np.lexsort((self.rows[near], self.ids[near], far))[:k]
        return near[first], far[first]

    def home_radius(self, row: int, query: np.ndarray, at: np.ndarray, k: int) -> float:
        """The distance of the k-th vector found in the query's own block, by growing windows; infinite if there are fewer."""
        n = len(self.rows)
        if n <= k:
            return math.inf
        guess = distances(self.vectors[:: max(1, n // GUESS)], query)
        radius = float(np.partition(guess, k)[k]) / 2 if len(guess) > k else 0.0
        low, high = self.windows(at, radius)
        counts = self.collisions(low, high)
        while True:
            found, far = self.best(row, query, np.flatnonzero(counts >= NEED), k)
            if len(found) == k and far[-1] <= radius:
                return float(far[-1])
            if int((high - low).sum()) == n * PROJECTIONS:
                return float(far[-1]) if len(found) == k else math.inf
            radius = radius * GROWTH if radius > 0 else float(np.ptp(self.values, axis=1).max()) / n + self.slack
            wider_low, wider_high = self.windows(at, radius)
            grown = [x for o, a, b, c, d in zip(self.order, wider_low, low, high, wider_high, strict=True) for x in (o[a:b], o[c:d])]
            counts += np.bincount(np.concatenate(grown), minlength=n)
            low, high = wider_low, wider_high

    def search(self, row: int, query: np.ndarray, at: np.ndarray, radius: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest within the radius that collide under it."""
        low, high = self.windows(at, radius)
        if int((high > low).sum()) < NEED:
            return np.zeros(0, np.int64), np.zeros(0)
        found, far = self.best(row, query, np.flatnonzero(self.collisions(low, high) >= NEED), k)
        return found[far <= radius], far[far <= radius]


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(-1, dim)


def _place(batches):
    """Adds the two projections that blocks are ranges of; their lines have length 1, so they move no more than the vector does."""
    for batch in batches:
        dims = batch.column("dim").to_numpy(zero_copy_only=False)
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim))
            lines = _lines(int(dim))[:, :2]
            placed = _project(_matrix(part.column("embedding"), int(dim)).astype(np.float64), lines / np.linalg.norm(lines, axis=0))
            yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, placed.T.copy())], names=[*part.schema.names, "p0", "p1"])


def _build(k: int):
    def run(table: pa.Table) -> pa.Table:
        """One row: a block's arrays, and its queries with their radius."""
        table = table.sort_by("row")
        dim = table["dim"][0].as_py()
        vectors = _matrix(table["embedding"], dim)
        rows, ids, p0, p1 = (table[c].to_numpy() for c in ("row", "vec_id", "p0", "p1"))
        block = Block.of(rows, ids, vectors.astype(np.float64))
        asks = np.flatnonzero(table["asks"].to_numpy())
        placed = _project(block.vectors[asks], _lines(dim))
        queries = [{"row": int(rows[i]), "query_id": int(ids[i]), "radius": block.home_radius(rows[i], block.vectors[i], at, k), "p0": float(p0[i]), "p1": float(p1[i]), "vector": vectors[i].tobytes()} for i, at in zip(asks, placed, strict=True)]
        key = [table[c][0].as_py() for c in _KEYS]
        packed = [rows.tobytes(), ids.tobytes(), vectors.tobytes(), block.values.tobytes(), block.order.tobytes()]
        types = [*[pa.int32()] * 4, *[pa.float64()] * 4, *[pa.binary()] * 5, pa.list_(pa.struct([("row", pa.int64()), ("query_id", pa.int64()), ("radius", pa.float64()), ("p0", pa.float64()), ("p1", pa.float64()), ("vector", pa.binary())]))]
        names = [*_KEYS, "low0", "high0", "low1", "high1", "rows", "ids", "vectors", "values", "order", "queries"]
        cells = [*key, p0.min(), p0.max(), p1.min(), p1.max(), *packed, queries]
        return pa.table({n: pa.array([x], t) for n, x, t in zip(names, cells, types, strict=True)})

    return run


def _visit(k: int, kind):
    def run(index: pa.Table, visits: pa.Table) -> pa.Table:
        out: list[tuple] = [(np.zeros(0, np.int64),) * 4 + (np.zeros(0),)]
        if len(index) and len(visits):
            rows, ids = (np.frombuffer(index[c][0].as_buffer(), np.int64) for c in ("rows", "ids"))
            dim, n = index["dim"][0].as_py(), len(rows)
            raw = index["values"][0].as_buffer()
            values = np.frombuffer(raw, np.float32 if raw.size == 4 * n * PROJECTIONS else np.float64).reshape(PROJECTIONS, n)
            block = Block(rows, ids, np.frombuffer(index["vectors"][0].as_buffer(), kind).reshape(n, dim).astype(np.float64), values, np.frombuffer(index["order"][0].as_buffer(), np.uint16).reshape(PROJECTIONS, n))
            queries = np.stack([np.frombuffer(x.as_buffer(), kind) for x in visits["vector"]]).astype(np.float64)
            for own, name, radius, query, at in zip(visits["query"].to_pylist(), visits["query_id"].to_pylist(), visits["radius"].to_pylist(), queries, _project(queries, _lines(dim)), strict=True):
                found, far = block.search(own, query, at, radius, k)
                out.append((np.full(len(found), own), np.full(len(found), name), rows[found], ids[found], far))
        return pa.table(dict(zip(("query", "query_id", "row", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return run


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, embedding (floats or doubles, as given) and dim of vectors that are neither null, empty nor zero and hold only finite numbers."""
    e = F.col("embedding")
    good = (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    kind = "array<float>" if dict(embeddings.dtypes)["embedding"] == "array<float>" else "array<double>"
    return embeddings.filter(F.col("vec_id").isNotNull() & e.isNotNull()).filter(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), e.cast(kind).alias("embedding"), F.size(e).alias("dim"))


def _with(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """rows with the columns of a written table that has a row a key."""
    return rows.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on)


def _cuts(rows: DataFrame, keys: list[str], place: str, ranges) -> DataFrame:
    """For each key the quantiles of a projection that cut it into so many ranges; the two ends are not among them."""
    parts = F.when(ranges > 0, F.transform(F.sequence(F.lit(1), F.greatest(ranges, F.lit(1))), lambda i: i / (ranges + 1))).otherwise(F.array().cast("array<double>"))
    some = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx(place, [i / 512 for i in range(513)], 20_000).alias("at"))
    return written(some.select(*keys, F.array_distinct(F.transform(parts, lambda q: F.get("at", F.round(q * 512).cast("int")))).alias("cuts")))


def _range_of(place: str):
    return F.size(F.filter("cuts", lambda c: c < F.col(place)))


def build_index(embeddings: DataFrame, is_query, k: int) -> DataFrame:
    """The written index: a row for each block of nearby vectors, with its sorted arrays and its queries' radii."""
    kind = dict(usable(embeddings).dtypes)["embedding"]
    rows = usable(embeddings).select(F.monotonically_increasing_id().alias("row"), "vec_id", "dim", F.coalesce(is_query, F.lit(False)).alias("asks"), "embedding")
    # Written, so that a row keeps its number.
    rows = written(rows.mapInArrow(_place, _PLACED.format(kind)))
    most = F.greatest(F.lit(64), F.least(F.lit(BLOCK_ROWS), F.floor(F.lit(BLOCK_NUMBERS) / F.col("dim"))))
    # As many slabs as ranges in a slab, up to 512 each; a cell that holds more is split by hash, so vectors that are all alike are split as well.
    side = F.least(F.lit(512), F.ceil(F.sqrt(F.col("n") / most))).cast("int")
    placed = _with(rows, _cuts(rows, ["dim"], "p0", side - 1), ["dim"]).withColumn("slab", _range_of("p0")).drop("cuts")
    within = F.least(F.lit(512), F.ceil(F.col("n") / most)).cast("int")
    placed = _with(placed, _cuts(placed.select("dim", "slab", "p1"), ["dim", "slab"], "p1", within - 1), ["dim", "slab"]).withColumn("sub", _range_of("p1")).drop("cuts")
    cells = written(placed.groupBy("dim", "slab", "sub").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / (1.25 * most)).cast("int")).drop("n"))
    placed = _with(placed, cells, ["dim", "slab", "sub"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).drop("parts")
    return written(placed.groupBy(*_KEYS).applyInArrow(_build(k), _INDEX))


def nearest(embeddings: DataFrame, is_query, k: int = 10) -> DataFrame:
    """The k nearest vectors found for each query, nearest first.

    embeddings: columns vec_id and embedding; others are ignored. is_query: a
    condition on vec_id. Candidates of a query are all usable rows of its
    length but its own row; other rows with its vec_id are candidates. Returns
    query_id, rank (from 1), vec_id, score (Euclidean distance in double
    precision); ties go to the smaller vec_id. Fewer than k candidates: all of
    them. Vectors that are null, zero or not finite, and rows without vec_id,
    take no part. Rows that repeat a query's vec_id are queries each.
    """
    kind = np.float32 if dict(embeddings.dtypes)["embedding"] == "array<float>" else np.float64
    index = build_index(embeddings, is_query, k)
    blocks = index.select(*_KEYS, "low0", "high0", "low1", "high1")
    queries = index.select("dim", F.explode("queries").alias("q")).select("dim", F.col("q.row").alias("query"), "q.query_id", "q.radius", "q.p0", "q.p1", "q.vector")
    # Slabs of a dim: 512 at most, in one row.
    slabs = written(blocks.groupBy("dim", "slab").agg(F.min("low0").alias("low"), F.max("high0").alias("high")).groupBy("dim").agg(F.collect_list(F.struct("slab", "low", "high")).alias("slabs")))
    # A hair wider than the radius: projections are rounded.
    reach = F.col("radius") * 1.000001 + 1e-9 * (1 + F.greatest(F.abs("p0"), F.abs("p1")))

    def under(place, low, high):
        return (low <= F.col(place) + reach) & (high >= F.col(place) - reach)

    routed = _with(queries, slabs, ["dim"]).withColumn("s", F.explode(F.filter("slabs", lambda s: under("p0", s["low"], s["high"])))).withColumn("slab", F.col("s.slab")).drop("s", "slabs")
    visits = routed.join(blocks, ["dim", "slab"]).filter(under("p0", F.col("low0"), F.col("high0")) & under("p1", F.col("low1"), F.col("high1")))
    visits = written(visits.select(*_KEYS, "query", "query_id", "radius", "vector"))
    turns = written(visits.groupBy(*_KEYS).agg(F.ceil(F.count("*") / F.lit(QUERY_ROWS)).cast("int").alias("turns")))
    asked = _with(visits, turns, _KEYS).withColumn("turn", F.pmod(F.xxhash64("query"), F.col("turns")).cast("int")).drop("turns")
    given = _with(index.drop("queries"), turns, _KEYS).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).drop("turns", "low0", "high0", "low1", "high1")
    keys = [*_KEYS, "turn"]
    near = given.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_visit(k, kind), _FOUND)
    order = Window.partitionBy("query").orderBy("score", "vec_id", "row")
    return near.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
