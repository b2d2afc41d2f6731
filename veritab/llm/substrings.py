"""Substring dedup by fixed-block anchors.

The index holds each document's non-overlapping blocks of BLOCK words; it is
probed with every rolling window of BLOCK words. A block that a window at
another place hits is an anchor. A repeat of SPAN words holds a whole block
wherever the blocks lie (SPAN >= 2 BLOCK - 1), so a window of SPAN words can
only be a repeat if every block inside it is an anchor. Anchors are extended to
the left and right: the SPAN-word windows around them are compared with all
others of the same words, and the earliest occurrence stays. Confirmed windows
that overlap make up the maximal repeats.

Index, probes and windows travel as packed messages (see _packed): a chunk of
documents sends each distinct hash once, and gets an answer back for it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._packed import Distinct, Tokeniser, Words, bucket_bounds, chunked, in_order, message, runs, shares

SPAN, BLOCK = 20, 10

_U = np.uint64
_ASK = pa.schema([("slot", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("more", pa.binary()), ("ids", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.int32()), ("step", pa.int32()), ("bucket", pa.int32()), ("flags", pa.binary())])
_ASK_SQL, _ANSWER_SQL = "slot int, bucket int, chunk int, keys binary, more binary, ids binary", "chunk int, step int, bucket int, flags binary"
_FOUND = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:long,end:long>>"


def _probes(words: Words) -> tuple[Distinct, np.ndarray]:
    """The distinct rolling windows of BLOCK words, and which windows lie within a text."""
    whole = words.whole(BLOCK)
    return Distinct(words.windows(BLOCK)[whole]), whole


def _send_probes(table: pa.Table, buckets: int) -> pa.Table:
    """key: lower half of the hash; more: bit 0, a block of the index; bit 1, at two places or more."""
    table, _ = in_order(table)
    words = Tokeniser().words(table["text"])
    probes, whole = _probes(words)
    at = probes.any((words.place[: len(whole)] % BLOCK == 0)[whole])
    more = at.astype(np.uint8) | ((probes.counts > 1).astype(np.uint8) << np.uint8(1))
    return _messages(table["chunk"][0].as_py(), probes.values, buckets, [probes.values.astype(np.uint32), more, None])


def _messages(chunk: int, hashes: np.ndarray, buckets: int, columns: list) -> pa.Table:
    cuts = bucket_bounds(hashes, buckets)
    used = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
    packed = [[b"" if c is None else c[cuts[b] : cuts[b + 1]].tobytes() for b in used] for c in columns]
    return message({"bucket": used, "chunk": [chunk] * len(used), "keys": packed[0], "more": packed[1], "ids": packed[2]}, _ASK, buckets)


def _column(table: pa.Table, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """All rows' packed numbers, end to end, and the row cuts."""
    parts = [np.frombuffer(x.as_buffer(), kind) for x in table[name]]
    return np.concatenate(parts), np.cumsum([0, *map(len, parts)])


def _answers(table: pa.Table, step: int, flags: np.ndarray, cuts: np.ndarray) -> pa.Table:
    return message({"chunk": table["chunk"], "step": [step] * len(table), "bucket": table["bucket"], "flags": [flags[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]}, _ANSWER)


def _match_blocks(table: pa.Table) -> pa.Table:
    """For each probe, whether it hits: its words are a block of the index, and stand at another place as well."""
    keys, cuts = _column(table, "keys", np.uint32)
    more, _ = _column(table, "more", np.uint8)
    order = np.argsort(keys, kind="stable")
    at = runs(keys[order])
    sizes = np.diff(np.append(at, len(keys)))
    either = np.bitwise_or.reduceat(more[order], at)
    hits = np.empty(len(keys), np.uint8)
    hits[order] = np.repeat((either & 1 > 0) & ((sizes > 1) | (either & 2 > 0)), sizes)
    return _answers(table, 1, hits, cuts)


def _gather(answers: pa.Table, step: int) -> np.ndarray:
    """A chunk's answers of one step, in the order of its distinct hashes."""
    rows = sorted((b, f) for b, s, f in zip(answers["bucket"].to_pylist(), answers["step"].to_pylist(), answers["flags"].to_pylist(), strict=True) if s == step)
    return np.frombuffer(b"".join(f for _, f in rows), np.uint8)


def _anchors(words: Words, hits: np.ndarray) -> np.ndarray:
    """Of each word, whether a block of its text's begins there; and of those, whether it is an anchor."""
    probes, whole = _probes(words)
    block = np.zeros(len(words.hashes) + 1, bool)
    anchor = block.copy()
    block[: len(whole)] = whole & (words.place[: len(whole)] % BLOCK == 0)
    anchor[np.flatnonzero(whole)] = probes.spread(hits) > 0
    return np.stack([block, block & anchor])


def _extended(words: Words, hits: np.ndarray) -> tuple[np.ndarray, Distinct, np.ndarray]:
    """Anchors extended to windows of SPAN words all of whose blocks are anchors: where they begin, their distinct hashes, and the first place of each."""
    blocks, anchors = (np.concatenate([[0], np.cumsum(x)]) for x in _anchors(words, hits))
    starts = np.flatnonzero(words.whole(SPAN))
    ends = starts + SPAN - BLOCK + 1
    inside = anchors[ends] - anchors[starts]
    starts = starts[(inside > 0) & (inside == blocks[ends] - blocks[starts])]
    windows = Distinct(words.windows(SPAN)[starts] if len(starts) else np.zeros(0, np.uint64))
    return starts, windows, starts[windows.order[windows.at]]


def _send_windows(docs: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """key: the whole hash; more: 32 bits of another; ids: the id of the chunk's first document with it."""
    if not len(docs):
        return _ASK.empty_table()
    docs, ids = in_order(docs)
    words = Tokeniser().words(docs["text"])
    _, windows, first = _extended(words, _gather(answers, 1))
    other = words.windows(SPAN, 0x9FB21C651E98DF25)[first].astype(np.uint32) if len(first) else np.zeros(0, np.uint32)
    return _messages(docs["chunk"][0].as_py(), windows.values, buckets, [windows.values, other, ids[words.doc[first]]])


def _first_places(table: pa.Table) -> pa.Table:
    """For each window: 1 if no other chunk has it in an earlier document."""
    keys, cuts = _column(table, "keys", np.uint64)
    other, _ = _column(table, "more", np.uint32)
    ids, _ = _column(table, "ids", np.int64)
    chunk = np.repeat(np.array(table["chunk"].to_pylist()), np.diff(cuts))
    order = np.lexsort((chunk, ids, other, keys))
    k, o = keys[order], other[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    flags = np.empty(len(k), np.uint8)
    flags[order] = new
    return _answers(table, 2, flags, cuts)


def _remove(docs: pa.Table, answers: pa.Table) -> pa.Table:
    docs, _ = in_order(docs)
    words = Tokeniser().words(docs["text"])
    starts, windows, first = _extended(words, _gather(answers, 1))
    again = np.ones(len(starts), bool)
    again[windows.order[windows.at]] = False
    earlier = windows.spread(_gather(answers, 2) == 0) if len(starts) else np.zeros(0, bool)
    begins = starts[again | earlier]
    edge = np.zeros(len(words.hashes) + SPAN + 1, np.int64)
    np.add.at(edge, begins, 1)
    np.add.at(edge, begins + SPAN, -1)
    gone = np.cumsum(edge)[: len(words.hashes)] > 0
    # Words stay with one separator after each; the last one's of a text is cut off.
    keep = ~gone
    size = np.where(keep, words.ends - words.starts, 0)
    out = np.full(int(size.sum() + keep.sum()), 32, np.uint8)
    to = np.concatenate([[0], np.cumsum(np.where(keep, size + 1, 0))])
    out[np.arange(int(size.sum())) + np.repeat(np.cumsum(keep) - keep, size)] = words.data[np.repeat(words.starts - np.concatenate([[0], np.cumsum(size)])[:-1], size) + np.arange(int(size.sum()))]
    low, high = to[words.first], to[words.first + words.count]
    removed = np.concatenate([[0], np.cumsum(gone)])
    removed = removed[words.first + words.count] - removed[words.first]
    turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])) != 0)
    spans: list[list[dict]] = [[] for _ in range(len(words.count))]
    for a, b in zip(turn[::2], turn[1::2], strict=True):
        d = words.doc[a]
        while b > words.first[d] + words.count[d]:  # a repeat that ends one text and begins the next
            end = words.first[d] + words.count[d]
            spans[d].append({"start": int(words.place[a]), "end": int(words.count[d])})
            a, d = end, words.doc[end]
        spans[d].append({"start": int(words.place[a]), "end": int(words.place[b - 1]) + 1})
    kept = [out[a : max(a, b - 1)].tobytes() for a, b in zip(low, high, strict=True)]
    return pa.table({"doc_id": docs["doc_id"], "n_words": pa.array(words.count, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Removes each word covered by a window of SPAN words that also starts earlier.

    docs: columns doc_id and text; others are ignored. A row for each row:
    doc_id, n_words, n_removed, kept (the words left, joined by one space) and
    spans (maximal repeats that were removed, in words, end exclusive).
    Earlier: in a document of smaller id, or before in the same document.
    Rows of the same id are in the order of their texts, so of equal rows the
    first keeps its words. Documents without id come last, in an order that
    their texts alone decide: by the chunk that a hash of the text deals them
    to, then by text; so which of them is the earlier may change with the number
    of chunks, but never that exactly one keeps its words. Windows are judged
    on the input. Null or empty texts have no words.
    """
    chunks, buckets = shares(docs)
    texts = chunked(docs, chunks)
    probes = texts.groupBy("chunk").applyInArrow(lambda t: _send_probes(t, buckets), _ASK_SQL)
    hits = probes.groupBy("slot").applyInArrow(_match_blocks, _ANSWER_SQL).repartition(buckets, "chunk")
    windows = texts.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(lambda d, a: _send_windows(d, a, buckets), _ASK_SQL)
    firsts = windows.groupBy("slot").applyInArrow(_first_places, _ANSWER_SQL)
    return texts.groupBy("chunk").cogroup(hits.unionByName(firsts).groupBy("chunk")).applyInArrow(_remove, _FOUND)


def digest(kept) -> "F.Column":
    return F.sha2(F.col(kept), 256)
