"""Words, shingles and packed messages shared by the corpus operators.

Corpus-wide lookups (does this shingle occur elsewhere, how often, where
first) go out as one row for each pair of a *chunk* (a hash share of the
documents) and a *bucket* (a range of hash values), with the hashes in one
binary column. A shuffle then moves a few bytes a word and no row a word;
each chunk sends a hash once, however often it holds it, so a hash that a
third of all rows share is still one entry a chunk. The answer is positional:
one byte for each entry of the message, grouped back by chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of `[^\x20\x09-\x0D]+`.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
BLOCK_BYTES = 1 << 20
NO_ID = np.iinfo(np.int64).max

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_MULT = 0xD1342543DE82EF95
_INVERSE = pow(_MULT, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_table() -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 257, dtype=np.uint64) * _U(_ODD))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, end to end, and the n + 1 offsets between them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Tokeniser:
    """Splits packed texts into words and hashes each word to 64 bits."""

    def __init__(self, lower: bool = False) -> None:
        self.is_word = np.ones(256, bool)
        self.is_word[[0x20, *range(0x09, 0x0E)]] = False
        self.table = _byte_table()
        if lower:
            self.table[65:91] = self.table[97:123]
        self.pow = _powers(_MULT, BLOCK_BYTES + 1)
        self.inv = _powers(_INVERSE, BLOCK_BYTES + 1)

    def _block(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of the words; no word crosses a cut."""
        if len(data) + 1 > len(self.pow):
            self.pow, self.inv = _powers(_MULT, len(data) + 1), _powers(_INVERSE, len(data) + 1)
        word = self.is_word[data]
        before = np.empty(len(word) + 1, bool)
        before[0], before[1:] = False, word
        first = word & ~before[:-1]
        inner = cuts[(cuts > 0) & (cuts < len(data))]
        first[inner] = word[inner]
        after = np.empty(len(word) + 1, bool)
        after[-1], after[:-1] = False, word
        last = word & ~after[1:]
        last[inner - 1] = word[inner - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.pow[: len(data)], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * self.inv[starts]
        return starts, ends, mix(hashes + (ends - starts).astype(np.uint64) * _U(_ODD))

    def words(self, column: pa.Array | pa.ChunkedArray) -> "Words":
        data, offsets = text_buffers(column)
        parts, at = [], 0
        with np.errstate(over="ignore"):
            while at < len(offsets) - 1:
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1)
                low = offsets[at]
                s, e, h = self._block(data[low : offsets[to]], offsets[at : to + 1] - low)
                parts.append((s + low, e + low, h))
                at = to
        if not parts:
            parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        starts, ends, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
        return Words(data, offsets, starts, ends, hashes)


class Words:
    """All words of some texts: byte spans, hashes, and where each text's words begin."""

    def __init__(self, data, offsets, starts, ends, hashes) -> None:
        self.data, self.offsets, self.starts, self.ends, self.hashes = data, offsets, starts, ends, hashes
        self.first = np.searchsorted(starts, offsets[:-1]).astype(np.int64)
        self.count = np.diff(np.append(self.first, len(starts)))
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        self.place = np.arange(len(starts)) - np.repeat(self.first, self.count)

    def windows(self, size: int, salt: int = 0x2545F4914F6CDD1D) -> np.ndarray:
        """The hash of each `size` words in turn, by doubling; those that cross texts are of no use."""
        with np.errstate(over="ignore"):
            base = salt | 1
            out, length, power, width = None, 0, self.hashes, 1
            left = size
            while left:
                if left & 1:
                    out = power if out is None else _join(out, length, power, base)
                    length += width
                left >>= 1
                if left:
                    power = _join(power, width, power, base)
                    width *= 2
            return mix(out)

    def whole(self, size: int) -> np.ndarray:
        """Whether the `size` words from each word on are of one text."""
        n = len(self.hashes) - size + 1
        return self.place[:max(n, 0)] + size <= np.repeat(self.count, self.count)[:max(n, 0)]


def _join(a: np.ndarray, width: int, b: np.ndarray, base: int) -> np.ndarray:
    """Window hashes of `width` words, each followed by the window of b that begins where it ends."""
    n = max(0, min(len(a), len(b) - width))
    return a[:n] * _U(pow(base, 2 * width + 1, 1 << 64)) + b[width : width + n]


def bucket_bounds(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among ascending hashes; a bucket is a range of the upper 32 bits."""
    edges = np.array([-(-(b << 32) // buckets) for b in range(buckets)], dtype=np.uint64) << _U(32)
    return np.append(np.searchsorted(sorted_hashes, edges), len(sorted_hashes))


def gaps(keys: np.ndarray) -> bytes:
    """Ascending numbers, as gaps of as many bytes as the largest needs; the first byte says how many."""
    steps = np.diff(keys, prepend=_U(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + byte_planes(steps, width)


def from_gaps(packed: bytes) -> np.ndarray:
    return np.cumsum(from_planes(packed[1:], packed[0]), dtype=np.uint64)


def byte_planes(numbers: np.ndarray, width: int) -> bytes:
    """The lower bytes of numbers: all the lowest ones first, and so on."""
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(packed: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return out.view("<u8").reshape(-1)


def in_bucket(hashes: np.ndarray, bucket: int, buckets: int, bits: int) -> np.ndarray:
    """A bucket's hashes as numbers of about so many bits, in the same order."""
    start = -(-(bucket << 32) // buckets) << 32
    return (hashes - _U(start)) >> _U(max(0, 65 - bits - buckets.bit_length()))


class Distinct:
    """The distinct values of hashes, ascending, and the way back."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.order = np.argsort(hashes, kind="stable")
        ordered = hashes[self.order]
        new = np.ones(len(ordered), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        self.at = np.flatnonzero(new)
        self.values = ordered[self.at]
        self.rank = np.cumsum(new) - 1
        self.counts = np.diff(np.append(self.at, len(ordered)))

    def spread(self, per_value: np.ndarray) -> np.ndarray:
        """A value's property, for each of the hashes as given."""
        out = np.empty(len(self.order), per_value.dtype)
        out[self.order] = per_value[self.rank]
        return out

    def any(self, flags: np.ndarray) -> np.ndarray:
        return np.logical_or.reduceat(flags[self.order], self.at) if len(self.at) else np.zeros(0, bool)


def runs(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.flatnonzero(new)


#: Bytes of input, as Spark estimates them, that a chunk is meant to hold; and the most chunks, as numbers of groups are 32-bit.
CHUNK_BYTES, MOST_CHUNKS = 32 << 20, 1 << 20


def shares(docs: DataFrame, times: int = 4) -> tuple[int, int]:
    """Numbers of chunks and buckets: they follow the cluster's own number of shuffle partitions, and the input's size where that asks for more, so that a task's memory doesn't grow with the input.

    There is at most a message for each entry, however many chunks and buckets
    there are.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 60:  # else unknown
        n = max(n, min(MOST_CHUNKS // times, -(-size // CHUNK_BYTES)))
    return times * n, n


def chunked(docs: DataFrame, chunks: int, *columns: str) -> DataFrame:
    """id, text and a hash share of the documents. Rows of one id meet; rows without id are dealt by text."""
    key = F.coalesce(F.xxhash64("doc_id"), F.lit(0)) if "doc_id" not in docs.columns else F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    return docs.select(F.pmod(key, F.lit(chunks)).cast("int").alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *columns)


def in_order(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """A chunk's documents by id (null last), then text, and the ids, null as the largest number."""
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    ids = table["doc_id"].fill_null(int(NO_ID)).to_numpy().astype(np.int64)
    return table, ids


def spark_hash(numbers: np.ndarray) -> np.ndarray:
    """Spark's hash of ints (Murmur3 of four bytes, seed 42), by which its exchanges deal rows."""
    def turn(x, by):
        return (x << np.uint32(by)) | (x >> np.uint32(32 - by))

    with np.errstate(over="ignore"):
        h = np.uint32(42) ^ (turn(numbers.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593))
        h = (turn(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)) ^ np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


_slots: dict[int, np.ndarray] = {}


def slots(buckets: int) -> np.ndarray:
    """A key for each bucket, such that an exchange of as many partitions gives each bucket one of its own; bucket numbers themselves would share some and leave others empty."""
    if buckets in _slots:
        return _slots[buckets]
    out, at = np.full(buckets, -1, np.int64), 0
    while (out < 0).any():
        tried = np.arange(at, at + 8 * buckets)
        place = spark_hash(tried).astype(np.int64) % buckets
        left = out < 0
        first, where = np.unique(place, return_index=True)
        out[first] = np.where(left[first], tried[where], out[first])
        at += 8 * buckets
    _slots[buckets] = out.astype(np.int32)
    return _slots[buckets]


def message(rows: dict, schema: pa.Schema, buckets: int = 0) -> pa.Table:
    if buckets:
        rows = rows | {"slot": slots(buckets)[np.array(rows["bucket"], np.int64)]}
    return pa.table({f.name: pa.array(rows[f.name], f.type) for f in schema}, schema=schema)


_own_dir: list[str] = []
#: The folders of tables written for the operators of this session.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share. Where that is unset, a local one if all of Spark runs in one process, as in tests; else an error."""
    import tempfile
    import uuid

    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_dir:
            _own_dir.append("file://" + tempfile.mkdtemp(prefix="veritab-"))
        top = _own_dir[0]
    path = f"{top.rstrip('/')}/veritab-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends here and a lost executor costs nothing before it."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made() -> int:
    """How many tables written() has made so far."""
    return len(_made)


def discard(spark: SparkSession, after: int, keep: tuple[str, ...] = ()) -> int:
    """Deletes the tables made since made() was `after`, but those to keep; the number deleted. What was made from them lazily must have been written before."""
    gone = [p for p in _made[after:] if p not in keep]
    for path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _made[after:] = [p for p in _made[after:] if p in keep]
    return len(gone)
