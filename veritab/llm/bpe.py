"""Byte-level BPE by monoid tree reduction.

A text falls into pieces (the matches of a pattern), which are encoded each by
itself. A piece is encoded as a tree down to single bytes: both halves
recursively, then the neighbours are joined. A join re-encodes a window around the boundary and
doubles it until the tokens outside it provably stay: a token sequence is the
encoding of its bytes exactly when each neighbouring pair is, so it is enough
that the pair at either edge of the window encodes to itself. Decoding
concatenates up the same kind of tree.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Windows up to so many bytes are re-encoded by looking through all neighbours, longer ones by a heap; the encodings of parts of a piece up to so many are kept.
SHORT, KEPT = 32, 6
#: Entries of a generation of a task's memo of encoded units, of which the last two are kept; and of its memos of parts and of pairs, which then start anew.
MEMO, PARTS, PAIRS = 130_000, 120_000, 300_000
#: Bytes of text in an output batch.
OUT_BYTES = 4 << 20


def load_ranks(raw: bytes) -> dict[bytes, int]:
    """The lines of a rank file: a token in base64, and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


class Codec:
    """Encodes and decodes pieces and texts with given ranks and pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks = ranks
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.pieces: Callable[[str], list[str]] = regex.compile(pattern).findall
        #: A space between two white-space characters, or at the end after one: there, text can't be cut before a space.
        self.odd_space = regex.compile(r"\s (?!\S)").search
        self.pairs: dict[tuple[int, int], list[int]] = {}
        #: The leaves of every tree: single bytes.
        self.bytes = {bytes([i]): [ranks[bytes([i])]] for i in range(256) if bytes([i]) in ranks}
        self.parts: dict[bytes, list[int]] = dict(self.bytes)
        #: Each id, packed.
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.token))]
        self.plain, self.spaced = _Memo(self, ""), _Memo(self, " ")

    def free(self) -> None:
        """Empties the memos. They refer to the codec and it to them, so they would else stay until the collector comes round, in a worker that goes on to other tasks."""
        for memo in (self.plain, self.spaced):
            memo.before.clear()
            memo.clear()
        for table in (self.pairs, self.parts, self.ranks, self.token, self.packed):
            table.clear()

    def merge(self, piece: bytes) -> list[int]:
        """The definition: the neighbouring parts whose union has the lowest rank merge, leftmost first, until none has one."""
        n, ranks = len(piece), self.ranks
        if n <= SHORT:
            return self.merge_short(piece)
        end = list(range(1, n + 1))
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(rank, i) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            rank, i = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or ranks.get(piece[i : end[j]]) != rank:
                continue
            end[i], after[i], alive[j] = end[j], after[j], False
            if after[i] < n:
                before[after[i]] = i
                if (new := ranks.get(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (new, i))
            if (k := before[i]) >= 0 and (new := ranks.get(piece[k : end[i]])) is not None:
                heapq.heappush(heap, (new, k))
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def merge_short(self, piece: bytes) -> list[int]:
        """merge(), by looking through all neighbours each time."""
        rank, none = self.ranks.get, len(self.token)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = [rank(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], none)
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], none)
        return list(map(self.ranks.__getitem__, parts))

    def window(self, left: int, right: int) -> list[int]:
        """The encoding of the bytes of two tokens."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            found = self.pairs[left, right] = self.merge(self.token[left] + self.token[right])
        return found

    def stays(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens encode to themselves."""
        return self.window(left, right) == [left, right]

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of two neighbours from their own encodings."""
        if not a or not b:
            return a or b
        left, right = a[-1], b[0]
        inner = self.pairs.get((left, right)) or self.window(left, right)
        if inner[0] == left and len(inner) == 2:
            # The boundary stays, and so does all else: every pair of neighbours encodes to itself.
            return a + b
        width = 1
        while True:
            low, high = len(a) - width, width
            if (low <= 0 or self.stays(a[low - 1], inner[0])) and (high >= len(b) or self.stays(inner[-1], b[high])):
                return a[: max(0, low)] + inner + b[high:]
            width *= 2
            inner = self.merge(b"".join(map(self.token.__getitem__, a[max(0, len(a) - width) :] + b[:width])))

    def tree(self, piece: bytes) -> list[int]:
        found = self.parts.get(piece)
        if found is None:
            if not piece:
                return []
            half = len(piece) >> 1
            found = self.join(self.tree(piece[:half]), self.tree(piece[half:]))
            if len(piece) <= KEPT:
                if len(self.parts) > PARTS:
                    self.parts = dict(self.bytes)
                self.parts[piece] = found
        return found

    def piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return self.tree(piece) if whole is None else [whole]

    def unit(self, text: str) -> bytes:
        """The ids of a text, piece by piece, as little-endian unsigned 32-bit integers."""
        return b"".join(self.packed[i] for p in self.pieces(text) for i in self.piece(p.encode()))

    def encode(self, text: str) -> bytes:
        """As unit(). Where no space stands between white space, each space begins a piece, so the units between spaces are encoded once each."""
        if not text:
            return b""
        if self.odd_space(text):
            return self.unit(text)
        first, *rest = text.split(" ")
        return (self.plain[first] if first else b"") + b"".join(map(self.spaced.__getitem__, rest))

    def decode(self, ids: bytes | np.ndarray) -> bytes:
        """The bytes of ids, concatenated up a tree."""
        ids = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else ids
        if len(ids) <= 4096:
            return b"".join(map(self.token.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


#: Marks that end a word; each is a token.
_MARKS = frozenset(".,;:!?)")


class _Memo(dict):
    """Encoded units of a text; lead stands before each."""

    def __init__(self, codec: Codec, lead: str) -> None:
        self.codec, self.lead = codec, lead
        self.before: dict[str, bytes] = {}

    def __missing__(self, unit: str) -> bytes:
        found = self.before.get(unit) or self.encoded(unit)
        if len(unit) <= 64:
            if len(self) >= MEMO:
                self.before = dict(self)
                self.clear()
            self[unit] = found
        return found

    def encoded(self, unit: str) -> bytes:
        codec = self.codec
        # Letters alone are one piece, and so is one mark after them. Beyond the Latin blocks two versions of Unicode may disagree on what a letter is.
        if max(unit) >= "\u0250":
            found = codec.unit(self.lead + unit)
        elif unit.isalpha():
            found = b"".join(map(codec.packed.__getitem__, codec.piece((self.lead + unit).encode())))
        elif unit[-1:] in _MARKS and unit[:-1].isalpha():
            found = self[unit[:-1]] + codec.packed[codec.ranks[unit[-1].encode()]]
        else:
            found = codec.unit(self.lead + unit)
        return found


_SCHEMA = "doc_id long, n_tokens long, ids binary, decoded binary"


def encode_decode(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Encodes every text and decodes its ids again.

    docs: columns doc_id and text; others are ignored. A row for each row, in
    any order, repeated rows too: doc_id (null stays null), n_tokens, ids
    (little-endian unsigned 32-bit integers, packed) and decoded (bytes). A
    null or empty text has no tokens. The rank file is read on the driver and
    broadcast: a vocabulary's size does not follow the data.
    """
    with open(rank_file, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(load_ranks(raw.value), pattern)
        out: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids = [x[1] for x in out]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([x[2] for x in out], pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

        try:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids = codec.encode(text.as_py() or "")
                    out.append((doc_id, ids, codec.decode(ids)))
                    size += 5 * len(ids)
                    if size > OUT_BYTES:
                        yield flush()
                        out.clear()
                        size = 0
            if out:
                yield flush()
        finally:
            codec.free()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SCHEMA)


def unpack(ids: bytes) -> list[int]:
    """The ids of the packed column."""
    return np.frombuffer(ids, "<u4").tolist()
