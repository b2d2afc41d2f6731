"""N-gram Jaccard join by T-occurrence search.

Two sets of which one is large can only be similar if they share at least T =
ceil(0.8 n) shingles. Sets are searched in inverted lists, DivideSkip: the
longest lists, up to T - 1, are set aside; the short ones are merged, and only
documents that occur in enough of them are looked up in the long ones, by
binary search, longest last, as long as they can still reach T.

Over a corpus, three steps come first. Shingles' list lengths are found by
packed messages (see _packed), equal sets counting once: a shingle with one
set can't be shared, and a document with fewer than T shared shingles has no
partner. The remaining documents post their rarest shingles; documents that
meet there, directly or through others, form clusters. Clusters are searched
whole, large ones in tiles of two blocks. One that is larger still, as chains of
shared passages make, is searched by the posted shingles themselves: a set goes
to the cells of its own, so its copies are bounded by its own length and not by
the cluster's; a pair that meets in several cells counts in the first.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._packed import Distinct, Tokeniser, Words, bucket_bounds, byte_planes, chunked, from_gaps, from_planes, gaps, in_bucket, in_order, message, mix, runs, shares, written
from .components import components, with_group

WORDS, PERCENT = 5, 80
#: Documents of a tile's block, and of a task that searches small clusters.
BLOCK = 1024
#: Blocks from which on a cluster is searched by cells, and cells to a block.
GROUPED, CELLS = 32, 64
#: Weight of the long lists' share; the larger, the fewer lists are set aside.
MU = 0.01

_U = np.uint64
_ASK = pa.schema([("slot", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("sets", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("length", pa.binary())])
_ASK_SQL, _ANSWER_SQL = "slot int, bucket int, chunk int, keys binary, sets binary", "chunk int, bucket int, length binary"
_SETS = "doc_id long, text_key long, n long, v long, shared array<long>, rare int"
_LINKS = "v long, root long, links long"


def needed(n):
    """The least overlap of a set of n shingles with any partner."""
    return -(-PERCENT * n // 100)


class Sets:
    """The shingle sets of some documents, end to end: each ascending, without repeats."""

    def __init__(self, words: Words) -> None:
        whole = words.whole(WORDS)
        hashes, doc = words.windows(WORDS)[whole], words.doc[: len(whole)][whole]
        short = np.flatnonzero((words.count > 0) & (words.count < WORDS))
        if len(short):
            few = [self._sequence(words.hashes[words.first[d] : words.first[d] + words.count[d]]) for d in short]
            hashes, doc = np.append(hashes, np.array(few, np.uint64)), np.append(doc, short)
        order = np.lexsort((hashes, doc))
        hashes, doc = hashes[order], doc[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
        self.hashes, self.doc = hashes[new], doc[new]
        self.size = np.bincount(self.doc, minlength=len(words.count)).astype(np.int64)
        self.first = np.cumsum(np.append(0, self.size))
        with np.errstate(over="ignore"):
            sums = np.append(_U(0), np.cumsum(mix(self.hashes ^ _U(0x5851F42D4C957F2D))))
            self.digest = mix((sums[self.first[1:]] - sums[self.first[:-1]]) ^ (self.size.astype(np.uint64) << _U(32)))

    @staticmethod
    def _sequence(hashes: np.ndarray) -> int:
        value = len(hashes)
        for h in hashes.tolist():
            value = (value * 0xD1342543DE82EF95 + h) & ((1 << 64) - 1)
        return value


#: Bits of a shingle's hash within its bucket, and bytes of a set's mark, that are sent. Shingles taken for one another are told apart later; marks must tell sets apart.
KEY_BITS, MARK_BYTES = 32, 6


def _pack_marks(which: np.ndarray, marks: np.ndarray) -> bytes:
    """The mark of each entry's set: which - 1 is its place among marks, 0 stands for several. As a table of the marks in use and two bytes an entry, where that is shorter."""
    used = np.flatnonzero(np.bincount(which, minlength=len(marks) + 1))
    full = np.append(_U(0), marks)
    if len(used) < 1 << 16 and MARK_BYTES * len(used) + 5 < (MARK_BYTES - 2) * len(which):
        place = np.zeros(len(full), np.uint64)
        place[used] = np.arange(len(used))
        return b"\1" + struct.pack("<I", len(used)) + byte_planes(full[used], MARK_BYTES) + byte_planes(place[which], 2)
    return b"\0" + byte_planes(full[which], MARK_BYTES)


def _marks(packed: bytes) -> np.ndarray:
    if packed[:1] == b"\0":
        return from_planes(packed[1:], MARK_BYTES)
    end = 5 + MARK_BYTES * struct.unpack("<I", packed[1:5])[0]
    return from_planes(packed[5:end], MARK_BYTES)[from_planes(packed[end:], 2)]


def _send(table: pa.Table, buckets: int) -> pa.Table:
    """keys: the shingles' hashes; sets: the mark of the only set that has it in this chunk, 0 for several."""
    table, _ = in_order(table)
    sets = Sets(Tokeniser(lower=True).words(table["text"]))
    marks, rank = np.unique(np.maximum(sets.digest >> _U(64 - 8 * MARK_BYTES), _U(1)), return_inverse=True)
    distinct = Distinct(sets.hashes)
    ordered = rank[sets.doc][distinct.order]
    low, high = (f.reduceat(ordered, distinct.at) if len(ordered) else ordered for f in (np.minimum, np.maximum))
    only = np.where(low == high, low + 1, 0)
    cuts = bucket_bounds(distinct.values, buckets)
    used = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
    keys = [gaps(in_bucket(distinct.values[cuts[b] : cuts[b + 1]], b, buckets, KEY_BITS)) for b in used]
    packed = [_pack_marks(only[cuts[b] : cuts[b + 1]], marks) for b in used]
    return message({"bucket": used, "chunk": [table["chunk"][0].as_py()] * len(used), "keys": keys, "sets": packed}, _ASK, buckets)


def _lengths(table: pa.Table) -> pa.Table:
    """For each shingle, 0 if a single set has it, else a measure of its list's length, up to 255: chunks that have it, twice those with several sets."""
    parts = [from_gaps(x.as_py()) for x in table["keys"]]
    cuts = np.cumsum([0, *map(len, parts)])
    keys, sets = np.concatenate(parts), np.concatenate([_marks(x.as_py()) for x in table["sets"]])
    order = np.argsort(keys, kind="stable")
    ordered = sets[order]
    at = runs(keys[order])
    low, high = np.minimum.reduceat(ordered, at), np.maximum.reduceat(ordered, at)
    length = np.add.reduceat(1 + (ordered == 0).astype(np.int64), at)
    kinds = np.where((low == high) & (low > 0), 0, np.clip(length, 2, 255)).astype(np.uint8)
    out = np.empty(len(keys), np.uint8)
    out[order] = np.repeat(kinds, np.diff(np.append(at, len(keys))))
    return message({"chunk": table["chunk"], "bucket": table["bucket"], "length": [out[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]}, _ANSWER)


def _survivors(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Every document with its set's size and digest; where enough shingles are shared, these, rarest first, and how many are its rare ones."""
    docs, _ = in_order(docs)
    sets = Sets(Tokeniser(lower=True).words(docs["text"]))
    distinct = Distinct(sets.hashes)
    rows = sorted(zip(answers["bucket"].to_pylist(), answers["length"].to_pylist(), strict=True))
    length = distinct.spread(np.frombuffer(b"".join(x for _, x in rows), np.uint8)) if len(sets.hashes) else np.zeros(0, np.uint8)
    count = np.bincount(sets.doc[length > 0], minlength=len(sets.size))
    stays = (sets.size > 0) & (count >= needed(sets.size))
    told: set[int] = set()
    shared: list = []
    for d in range(len(sets.size)):
        if not stays[d] or int(sets.digest[d]) in told:
            shared.append(None)
            continue
        told.add(int(sets.digest[d]))
        part = slice(sets.first[d], sets.first[d + 1])
        hashes, kinds = sets.hashes[part], length[part]
        order = np.argsort(kinds, kind="stable")
        shared.append(hashes[order[np.searchsorted(kinds[order], 1) :]].view(np.int64))
    rare = np.maximum(count - needed(sets.size) + 1, 0)
    return pa.table({"doc_id": docs["doc_id"], "text_key": docs["text_key"], "n": pa.array(sets.size), "v": pa.array(sets.digest.view(np.int64)), "shared": pa.array(shared, pa.list_(pa.int64())), "rare": pa.array(rare, pa.int32())})


def divide_skip(size: np.ndarray, shared: list[np.ndarray], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """All pairs (x, y) of similar sets. size: whole sizes; shared: the shingles that other sets may have as well. side: only pairs of different sides."""
    if len(shared) < 2:
        return []
    doc = np.repeat(np.arange(len(shared)), [len(s) for s in shared])
    _, ids = np.unique(np.concatenate(shared), return_inverse=True)
    by = np.argsort(ids, kind="stable")
    lists, posted = np.cumsum(np.append(0, np.bincount(ids))), doc[by]
    lengths = np.diff(lists)
    first = np.cumsum(np.append(0, [len(s) for s in shared]))
    pairs = []
    for x in range(len(shared)):
        own = ids[first[x] : first[x + 1]]
        own = own[lengths[own] > 1]
        least = int(needed(size[x]))
        if len(own) < least:
            continue
        own = own[np.argsort(lengths[own], kind="stable")]
        aside = min(least - 1, int(least / (MU * math.log2(lengths[own[-1]] + 1) + 1)))
        short, long = own[: len(own) - aside], own[len(own) - aside :]
        met, count = np.unique(np.concatenate([posted[lists[s] : lists[s + 1]] for s in short]), return_counts=True)
        good = (met > x) & (count >= least - aside) & (100 * size[met] >= PERCENT * size[x]) & (100 * size[x] >= PERCENT * size[met])
        if side is not None:
            good &= side[met] != side[x]
        met, count = met[good], count[good]
        # Each partner's own least overlap is known from here on.
        least_of = -(-PERCENT * (size[met] + size[x]) // (100 + PERCENT))
        for k, s in enumerate(long):
            if not len(met):
                break
            postings = posted[lists[s] : lists[s + 1]]
            place = np.searchsorted(postings, met)
            count = count + (postings[np.minimum(place, len(postings) - 1)] == met)
            can = count + (len(long) - k - 1) >= least_of
            if not can.all():
                met, count, least_of = met[can], count[can], least_of[can]
        pairs.extend((x, int(y)) for y, c in zip(met, count, strict=True) if 100 * c >= PERCENT * (size[x] + size[y] - c))
    return pairs


def _search(table: pa.Table) -> pa.Table:
    """Searches the clusters and tiles of a task; a row for each document with links there: a tree edge, and links counted with copies."""
    names = ("root", "g", "i", "j")
    table = table.sort_by([(c, "ascending") for c in (*names, "v")])
    key = np.stack([table[c].to_numpy() for c in names])
    cuts = np.append(np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0))), key.shape[1])
    out: list[tuple[int, int, int]] = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = table.slice(a, b - a)
        v, size, copies, block, rare = (part[c].to_numpy() for c in ("v", "n", "copies", "block", "rare"))
        groups, own = int(part["groups"][0].as_py()), int(key[1, a])
        flat = part["shared"].combine_chunks()
        values, offsets = flat.values.to_numpy(), flat.offsets.to_numpy()
        shared = [values[x:y] for x, y in zip(offsets, offsets[1:], strict=False)]
        parent = list(range(len(v)))

        def find(x: int, parent=parent) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        def first_meeting(x: int, y: int, shared=shared, rare=rare, groups=groups, own=own) -> bool:
            return not groups or int(np.intersect1d(shared[x][: rare[x]] % groups, shared[y][: rare[y]] % groups).min()) == own

        links = np.zeros(len(v), np.int64)
        for x, y in divide_skip(size, shared, None if key[2, a] == key[3, a] else block):
            if not first_meeting(x, y):
                continue
            links[x] += copies[y]
            links[y] += copies[x]
            p, q = find(x), find(y)
            parent[max(p, q)] = min(p, q)
        out.extend((int(v[x]), int(v[find(x)]), int(links[x])) for x in np.flatnonzero(links))
    return pa.table({n: pa.array([x[k] for x in out], pa.int64()) for k, n in enumerate(("v", "root", "links"))})


def similar_sets(docs: DataFrame) -> DataFrame:
    """Links documents whose sets of five-word shingles are similar to 0.8 or more.

    docs: columns doc_id and text; others are ignored. A row for each row:
    doc_id, n_shingles, component_id (the smallest doc_id reachable by links),
    n_links (documents linked with this one, copies included), text_key (a hash
    of the text) and component_key (one for all rows of a component, also for
    those without doc_id; null for empty sets). Texts are
    lower-cased (A-Z). With fewer than five words the whole sequence is the one
    shingle; without words, or null, the set is empty and linked with nothing.
    Rows of the same doc_id are documents each. Rows without doc_id link as
    others do but name no component; one of such rows alone has none (null).
    """
    chunks, buckets = shares(docs)
    texts = chunked(docs, chunks, F.xxhash64("text").alias("text_key"))
    asked = texts.groupBy("chunk").applyInArrow(lambda t: _send(t, buckets), _ASK_SQL)
    answers = asked.groupBy("slot").applyInArrow(_lengths, _ANSWER_SQL)
    rows = written(texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_survivors, _SETS))
    classes = rows.filter("n > 0").groupBy("v").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    sets = rows.filter("shared is not null").groupBy("v", "n").agg(F.first("shared").alias("shared"), F.first("rare").alias("rare"))
    sets = written(sets.join(classes.select("v", "copies"), "v"))
    posted = sets.select("v", F.explode(F.slice("shared", 1, F.col("rare"))).alias("shingle"))
    lists = posted.groupBy("shingle").agg(F.min("v").alias("m"), F.count("*").alias("c")).filter("c > 1").select("shingle", "m")
    clusters = components(posted.join(lists, "shingle").select(F.col("v").alias("a"), F.col("m").alias("b")))
    clusters = written(clusters.unionByName(clusters.select(F.col("root").alias("node"), "root").distinct()))
    clusters = with_group(clusters, clusters.count(), "root", F.col("node"), F.count("*"), F.sum, "__n")
    clusters = written(clusters.select(F.col("node").alias("v"), "root", F.ceil(F.col("__n") / F.lit(BLOCK)).cast("int").alias("blocks")))
    none = F.lit(0).cast("long")
    cells = clusters.filter(F.col("blocks") <= GROUPED).select("v", "root", none.alias("g"), none.alias("groups"), "blocks")
    large = clusters.filter(F.col("blocks") > GROUPED).withColumn("groups", F.col("blocks").cast("long") * CELLS).drop("blocks")
    n_cells = sets.count()
    if not large.isEmpty():
        at = posted.join(large.hint("merge"), "v").select("v", "root", F.pmod("shingle", F.col("groups")).alias("g"), "groups").distinct()
        at = written(at.withColumn("cell", F.xxhash64("root", "g")))
        n_cells += at.count()
        at = with_group(at, n_cells, "cell", F.col("v"), F.count("*"), F.sum, "__n").filter("__n > 1")
        cells = cells.unionByName(at.select("v", "root", "g", "groups", F.ceil(F.col("__n") / F.lit(BLOCK)).cast("int").alias("blocks")))
    tasks = max(1, n_cells // BLOCK)
    placed = sets.join(written(cells).hint("merge"), "v").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root", "g"), F.lit(tasks))).otherwise(F.xxhash64("root", "g", "i", "j"))
    found = written(placed.select(task.alias("task"), "root", "g", "groups", "i", "j", "block", "v", "n", "copies", "rare", "shared").groupBy("task").applyInArrow(_search, _LINKS))
    labels = components(found.select(F.col("v").alias("a"), F.col("root").alias("b")))
    labels = labels.unionByName(labels.select(F.col("root").alias("node"), "root").distinct())
    labels = written(labels.join(classes.select(F.col("v").alias("node"), "least").hint("merge"), "node"))
    named = with_group(labels, labels.count(), "root", F.col("node"), F.min("least"), F.min, "component")
    linked = found.groupBy("v").agg(F.sum("links").alias("links"))
    each = classes.join(written(named.select(F.col("node").alias("v"), "component", "root")).hint("merge"), "v", "left").join(linked.hint("merge"), "v", "left")
    # Written, so that the last join has an exchange on either side and Spark can split the rows of a large group of copies.
    each = written(each.select("v", F.coalesce("root", "v").alias("root"), F.coalesce("component", "least").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    out = rows.select("doc_id", "text_key", "n", F.when(F.col("n") > 0, F.col("v")).alias("v")).join(each.hint("merge"), "v", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "text_key", F.col("root").alias("component_key"))
