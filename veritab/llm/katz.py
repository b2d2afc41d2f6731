"""Language-model scores by Katz backoff.

Counts of words and word pairs are discounted by Good-Turing; what a context's
seen words give up goes to the unseen ones in proportion to their own
probability, by a backoff weight that makes each context's probabilities sum to
one exactly. All words that training lacks are one type. A token is looked up
with its context, and recursively without, where the pair was never seen.

The tables are partitioned by hash: words with their counts, pairs with their
counts, contexts with their backoff weights. They are built and read by packed
messages (see _packed), in three rounds: each chunk of documents asks for its
distinct words, then its distinct pairs; a pair's first chunk reports what the
pair takes from its context, and contexts' weights come back.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._packed import Distinct, Tokeniser, bucket_bounds, chunked, from_gaps, gaps, in_bucket, in_order, message, mix, runs, shares

#: Counts above this are taken as they are.
RELIABLE = 5

_U = np.uint64
#: The hashes of the end of a text and of what stands before its first word.
END, BEGIN = _U(0x1B873593CC9E2D51), _U(0x85EBCA6BC2B2AE35)
_ASK = pa.schema([("slot", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.int32()), ("step", pa.int32()), ("bucket", pa.int32()), ("values", pa.binary()), ("first", pa.binary()), ("totals", pa.binary())])
_ASK_SQL, _ANSWER_SQL = "slot int, bucket int, chunk int, keys binary, counts binary", "chunk int, step int, bucket int, values binary, first binary, totals binary"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: N, V and the numbers of types that occur 1, 2, ... RELIABLE + 1 times.
_TOTALS = f"<{RELIABLE + 3}q"


def discounts(often: list[int]) -> np.ndarray:
    """What is left of a count r of 1 to RELIABLE, as a share; often[r - 1] types occur r times.

    Good-Turing by Katz's formula; where that gives no share between 0 and 1
    (counts too few or uneven), r is lowered by n1 / (n1 + 2 n2), or a half.
    """
    n = np.array(often, float)
    out = np.ones(RELIABLE + 1)
    r = np.arange(1, RELIABLE + 1)
    if (n > 0).all() and (ratio := (RELIABLE + 1) * n[RELIABLE] / n[0]) < 1:
        out[1:] = ((r + 1) * n[1:] / n[:-1] / r - ratio) / (1 - ratio)
        if ((out[1:] > 0) & (out[1:] < 1)).all():
            return out
    less = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    out[1:] = (r - less) / r
    return out


class Unigrams:
    """P(word) from its count."""

    def __init__(self, totals: np.ndarray) -> None:
        self.tokens, self.types = int(totals[0]), int(totals[1])
        self.discount = discounts(totals[2:].tolist())
        given = float(sum((1 - self.discount[r]) * r * totals[1 + r] for r in range(1, RELIABLE + 1)))
        #: All words may be frequent; one token more then stands for the unknown.
        self.over = self.tokens + (given <= 0)
        self.unknown = (given if given > 0 else 1.0) / max(1, self.over)

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        share = self.discount[np.where(counts > RELIABLE, 0, counts)]
        return np.where(counts > 0, share * counts / max(1, self.over), self.unknown)


class Stream:
    """The tokens of a chunk: words and an end for each text, with what stands before each."""

    def __init__(self, docs: pa.Table) -> None:
        self.docs, _ = in_order(docs)
        words = Tokeniser(lower=True).words(self.docs["text"])
        n = len(words.count)
        ends = words.first + words.count + np.arange(n)
        self.tokens = np.empty(len(words.hashes) + n, np.uint64)
        inner = np.arange(len(words.hashes)) + words.doc
        self.tokens[inner], self.tokens[ends] = words.hashes, END
        before = np.empty(len(self.tokens) + 1, np.uint64)
        before[1:] = self.tokens
        before[words.first + np.arange(n)] = BEGIN
        self.before = before[:-1]
        self.doc = np.repeat(np.arange(n), words.count + 1)
        self.trains = ~self.docs["held_out"].to_numpy()
        both = np.concatenate([self.tokens, np.full(n, BEGIN)])
        weight = np.concatenate([self.trains[self.doc], self.trains])
        self.words = Distinct(both)
        rank = np.empty(len(both), np.int64)
        rank[self.words.order] = self.words.rank
        #: Places of tokens among the distinct words; of contexts likewise.
        self.token_at = rank[: len(self.tokens)]
        self.before_at = np.append(0, self.token_at[:-1])
        self.before_at[words.first + np.arange(n)] = rank[-1] if n else 0
        self.word_counts = np.bincount(rank[weight], minlength=len(self.words.values)).astype(np.uint32)

    def pairs(self) -> Distinct:
        with np.errstate(over="ignore"):
            return Distinct(mix(self.before * _U(0x9E3779B97F4A7C15) + self.tokens))


def _asks(chunk: int, hashes: np.ndarray, buckets: int, pack_keys, keys: np.ndarray, pack_counts, counts: np.ndarray) -> pa.Table:
    cuts = bucket_bounds(hashes, buckets)
    used = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
    return message({"bucket": used, "chunk": [chunk] * len(used), "keys": [pack_keys(b, keys[cuts[b] : cuts[b + 1]]) for b in used], "counts": [pack_counts(counts[cuts[b] : cuts[b + 1]]) for b in used]}, _ASK, buckets)


def _plain(bucket: int, values: np.ndarray) -> bytes:
    return values.tobytes()


def _ask_words(docs: pa.Table, buckets: int) -> pa.Table:
    s = Stream(docs)
    return _asks(docs["chunk"][0].as_py(), s.words.values, buckets, _plain, s.words.values, _planes, s.word_counts)


def _planes(counts: np.ndarray) -> bytes:
    """32-bit numbers, all their lowest bytes first, and so on: mostly small ones then compress to a byte each."""
    return np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _whole(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, where each key begins, and its counts' sum."""
    order = np.argsort(keys, kind="stable")
    at = runs(keys[order])
    return order, at, np.add.reduceat(counts[order].astype(np.int64), at)


def _answer(table: pa.Table, step: int, cuts: np.ndarray, pack, totals: list[int], chunks: int, first=None) -> pa.Table:
    """Values go back to who asked, pack(a, b) for those from a to b; totals go to every chunk."""
    bucket = table["bucket"][0].as_py()
    asked = {c: (pack(a, b), struct.pack("<I", b - a) + np.packbits(first[a:b]).tobytes() if first is not None else b"") for c, a, b in zip(table["chunk"].to_pylist(), cuts, cuts[1:], strict=False)}
    every = range(chunks)
    values, firsts = zip(*(asked.get(c, (b"", b"")) for c in every), strict=True)
    return message({"chunk": list(every), "step": [step] * chunks, "bucket": [bucket] * chunks, "values": list(values), "first": list(firsts), "totals": [struct.pack(_TOTALS, *totals)] * chunks}, _ANSWER)


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All parts end to end, and the cuts between them."""
    return np.concatenate(parts), np.cumsum([0, *map(len, parts)])


def _often(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, RELIABLE + 2), minlength=RELIABLE + 3)[1 : RELIABLE + 2].tolist()


def _count_words(table: pa.Table, chunks: int) -> pa.Table:
    keys, cuts = _joined([np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()])
    order, at, sums = _summed(keys, np.concatenate([_whole(x) for x in table["counts"].to_pylist()]))
    own = sums[keys[order][at] != BEGIN]
    out = np.empty(len(keys), np.uint32)
    out[order] = np.repeat(sums, np.diff(np.append(at, len(keys))))
    return _answer(table, 1, cuts, lambda a, b: _planes(out[a:b]), [int(own.sum()), int((own > 0).sum()), *_often(own)], chunks)


def _count_pairs(table: pa.Table, chunks: int) -> pa.Table:
    """Each pair's count, and whether this chunk is the first that has it."""
    table = table.sort_by("chunk")
    keys, cuts = _joined([from_gaps(x) for x in table["keys"].to_pylist()])
    order, at, sums = _summed(keys, np.concatenate([_whole(x) for x in table["counts"].to_pylist()]))
    out, first = np.empty(len(keys), np.uint32), np.zeros(len(keys), bool)
    out[order] = np.repeat(sums, np.diff(np.append(at, len(keys))))
    first[order[at]] = True
    return _answer(table, 2, cuts, lambda a, b: _planes(out[a:b]), [0, 0, *_often(sums)], chunks, first)


class Answers:
    """What a chunk has been told so far."""

    def __init__(self, table: pa.Table) -> None:
        self.rows = sorted(zip(*(table[c].to_pylist() for c in ("step", "bucket", "values", "first", "totals")), strict=True))

    def counts(self, step: int) -> np.ndarray:
        return np.concatenate([_whole(v) for s, _, v, _, _ in self.rows if s == step]).astype(np.int64)

    def flags(self, step: int) -> np.ndarray:
        return np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8, offset=4), count=struct.unpack("<I", f[:4])[0]) for s, _, _, f, _ in self.rows if s == step and f]).astype(bool)

    def weights(self) -> np.ndarray:
        return np.frombuffer(b"".join(v for s, _, v, _, _ in self.rows if s == 3), np.float64)

    def totals(self, step: int) -> np.ndarray:
        return np.array([struct.unpack(_TOTALS, t) for s, _, _, _, t in self.rows if s == step], np.int64).sum(0)


def _ask_pairs(docs: pa.Table, buckets: int) -> pa.Table:
    s = Stream(docs)
    pairs = s.pairs()
    counts = np.add.reduceat(s.trains[s.doc][pairs.order].astype(np.uint32), pairs.at).astype(np.uint32)
    return _asks(docs["chunk"][0].as_py(), pairs.values, buckets, lambda b, x: gaps(in_bucket(x, b, buckets, 64)), pairs.values, _planes, counts)


def _report_contexts(docs: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """For each distinct word as a context, over the pairs this chunk reports: what discounting frees of their counts, and their words' own probability."""
    if not len(docs):
        return _ASK.empty_table()
    s, told = Stream(docs), Answers(answers)
    pairs = s.pairs()
    count = told.counts(2)
    place = pairs.order[pairs.at]
    unigram = Unigrams(told.totals(1))
    share = discounts(told.totals(2)[2:].tolist())
    seen = told.flags(2) & (count > 0)
    context, word, count = s.before_at[place][seen], s.token_at[place][seen], count[seen]
    freed = np.where(count > RELIABLE, 0.0, (1 - share[np.where(count > RELIABLE, 0, count)]) * count)
    size = len(s.words.values)
    freed = np.bincount(context, freed, size)
    taken = np.bincount(context, unigram(told.counts(1))[word], size)
    # A weight is asked for, by the sign, where the chunk has a pair that was never seen.
    asks = np.bincount(s.before_at[place][told.counts(2) == 0], minlength=size) > 0
    return _asks(docs["chunk"][0].as_py(), s.words.values, buckets, _plain, np.where(asks, -freed, freed), np.ndarray.tobytes, taken)


def _weigh_contexts(asked: pa.Table, reports: pa.Table, chunks: int) -> pa.Table:
    """The backoff weights asked for; and, for all contexts, whether discounting frees nothing of theirs: one more count then stands for the unseen."""
    if not len(asked):
        return _ANSWER.empty_table()
    asked, reports = asked.sort_by("chunk"), reports.sort_by("chunk")
    keys, cuts = _joined([np.frombuffer(x, np.uint64) for x in asked["keys"].to_pylist()])
    order, at, sums = _summed(keys, np.concatenate([_whole(x) for x in asked["counts"].to_pylist()]))
    reported, taken = (np.frombuffer(b"".join(reports[c].to_pylist()), np.float64) for c in ("keys", "counts"))
    freed, taken = (np.add.reduceat(x[order], at) for x in (np.abs(reported), taken))
    total = np.maximum(sums, 1)
    none = (sums > 0) & (freed <= 0)
    weight = np.where(none, 1 / (total + 1), freed / total) / np.maximum(1 - taken, 1e-300)
    out, bare = np.empty(len(keys), np.float64), np.empty(len(keys), bool)
    sizes = np.diff(np.append(at, len(keys)))
    out[order], bare[order] = np.repeat(weight, sizes), np.repeat(none, sizes)
    wanted = np.signbit(reported)
    return _answer(asked, 3, cuts, lambda a, b: out[a:b][wanted[a:b]].tobytes(), [0] * (RELIABLE + 3), chunks, bare)


def _score(docs: pa.Table, answers: pa.Table) -> pa.Table:
    if not len(docs):
        return pa.table({n: pa.array([], t) for n, t in (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})
    s, told = Stream(docs), Answers(answers)
    unigram, share = Unigrams(told.totals(1)), discounts(told.totals(2)[2:].tolist())
    counts = told.counts(1)
    token, context = counts[s.token_at], counts[s.before_at]
    pair = s.pairs().spread(told.counts(2))
    weight = np.zeros(len(s.words.values))
    weight[np.bincount(s.before_at[pair == 0], minlength=len(weight)) > 0] = told.weights()
    over = np.maximum(context + told.flags(3)[s.before_at], 1)
    seen = share[np.where(pair > RELIABLE, 0, pair)] * pair / over
    lower = unigram(token)
    p = np.where(pair > 0, seen, np.where(context > 0, weight[s.before_at], 1.0) * lower)
    n = len(s.docs)
    base = np.log10((token + 1) / (unigram.tokens + unigram.types + 1))
    sums = lambda x: np.bincount(s.doc, x, n)
    return pa.table({"doc_id": s.docs["doc_id"], "held_out": s.docs["held_out"], "n_tokens": pa.array(np.bincount(s.doc, minlength=n), pa.int64()), "n_known": pa.array(sums(token > 0).astype(np.int64)), "train_tokens": pa.array(np.full(n, unigram.tokens)), "base_score": pa.array(sums(base)), "score": pa.array(sums(np.log10(p)))})


def score(docs: DataFrame, divisor: int = 7, remainder: int = 2) -> DataFrame:
    """log10 probability of every text, and that of an add-one unigram model.

    docs: columns doc_id and text; others are ignored. A row for each row:
    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. The
    model learns from texts whose crc32(doc_id as text) mod divisor is not
    the remainder, and from those without doc_id; repeated rows count each.
    A null text is empty and has one token, its end. If nothing is learned,
    all words are of the one unknown type, whose probability is 1.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % divisor == remainder, F.lit(False))
    chunks, buckets = shares(docs, 2)
    texts = chunked(docs.withColumn("held_out", held), chunks, "held_out")
    by_chunk = texts.groupBy("chunk")
    words = by_chunk.applyInArrow(lambda t: _ask_words(t, buckets), _ASK_SQL)
    one = words.groupBy("slot").applyInArrow(lambda t: _count_words(t, chunks), _ANSWER_SQL).repartition(buckets, "chunk")
    pairs = by_chunk.applyInArrow(lambda t: _ask_pairs(t, buckets), _ASK_SQL)
    two = one.unionByName(pairs.groupBy("slot").applyInArrow(lambda t: _count_pairs(t, chunks), _ANSWER_SQL)).repartition(buckets, "chunk")
    reports = by_chunk.cogroup(two.groupBy("chunk")).applyInArrow(lambda d, a: _report_contexts(d, a, buckets), _ASK_SQL)
    weights = words.groupBy("slot").cogroup(reports.groupBy("slot")).applyInArrow(lambda w, r: _weigh_contexts(w, r, chunks), _ANSWER_SQL)
    return by_chunk.cogroup(two.unionByName(weights).groupBy("chunk")).applyInArrow(_score, _SCORES)
