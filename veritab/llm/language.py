"""Language identification by multilingual mixture inference.

A document is a mixture of languages. Expectation-maximisation finds each
language's share from the likelihoods of the document's byte trigrams; sets of
the likeliest 1, 2, ... languages compete by likelihood less a penalty for
each language, and the winner's largest share names the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._packed import BLOCK_BYTES, runs, text_buffers

#: Trigrams are hashed to so many features; the model is 4 bytes x features x languages.
FEATURES = 1 << 15
MAX_LANGUAGES = 512
SMOOTHING = 0.5
ROUNDS = 12
#: Trigrams overlap, so each character's evidence counts about three times over; the penalty does as well.
OVERLAP = 3.0


def _byte_classes() -> np.ndarray:
    """Letters lower-cased, bytes of other scripts as they are, all else a space."""
    table = np.full(256, 32, np.uint32)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


_CLASSES = _byte_classes()


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, feature) pairs, ascending, and how often each occurs."""
    norm = _CLASSES[data]
    if len(norm) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (norm[:-2] << np.uint32(16)) | (norm[1:-1] << np.uint32(8)) | norm[2:]
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
    good = (doc[:-2] == doc[2:]) & (code != 0x202020)
    feature = ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.uint64)
    key = np.sort(((doc[:-2] << np.uint64(15)) | feature)[good])
    at = runs(key)
    return (key[at] >> np.uint64(15)).astype(np.int64), (key[at] & np.uint64(FEATURES - 1)).astype(np.int64), np.diff(np.append(at, len(key)))


def _blocks(column, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of documents of about so many bytes, at least one document each."""
    data, offsets = text_buffers(column)
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + width, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def _padded(name: str = "text"):
    return F.concat(F.lit(" "), F.coalesce(F.col(name).cast("string"), F.lit("")), F.lit(" ")).alias("text")


def train(labelled: DataFrame) -> dict[str, np.ndarray]:
    """log P(trigram | language) from every row of labelled (text, lang); rows without lang are ignored."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for at, to, data, offsets in _blocks(batch.column(1), BLOCK_BYTES):
                doc, feature, n = _grams(data, offsets)
                names = {x: i for i, x in enumerate(dict.fromkeys(langs[at:to]))}
                which = np.array([names[x] for x in langs[at:to]])[doc] if len(doc) else doc
                table = np.bincount(which * FEATURES + feature, n, len(names) * FEATURES).reshape(len(names), FEATURES)
                for x, i in names.items():
                    sums[x] = sums[x] + table[i] if x in sums else table[i]
        for lang, row in sums.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(row[at].astype(np.int64))], names=["lang", "feature", "n"])

    rows = labelled.filter(F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), _padded())
    counts = rows.mapInArrow(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    table = counts.toArrow()  # at most features x languages rows
    langs = sorted(set(table["lang"].to_pylist()))
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"{len(langs)} languages; the model is broadcast, so {MAX_LANGUAGES} at most")
    place = {x: i for i, x in enumerate(langs)}
    n = np.full((len(langs), FEATURES), SMOOTHING)
    if langs:
        np.add.at(n, (np.array([place[x] for x in table["lang"].to_pylist()]), table["feature"].to_numpy()), table["n"].to_numpy())
    return dict(zip(langs, np.log(n / n.sum(1, keepdims=True)), strict=True))


def _em(doc: np.ndarray, first: np.ndarray, n: np.ndarray, likely: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the languages in each document, and its log-likelihood under them. Languages with no share get none."""
    rank = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(doc))))
    total = np.add.reduceat(n, first)[:, None]
    for _ in range(rounds):
        part = likely * share[rank]
        part *= (n / part.sum(1))[:, None]
        share = np.add.reduceat(part, first, axis=0) / total
    return share, np.add.reduceat(n * np.log((likely * share[rank]).sum(1)), first)


def _ceiling(doc: np.ndarray, first: np.ndarray, n: np.ndarray, likely: np.ndarray, share: np.ndarray, reached: np.ndarray) -> np.ndarray:
    """What no shares can exceed in log-likelihood: it is concave in them, so from any point it rises by less than its steepest slope there."""
    rank = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(doc))))
    slope = np.add.reduceat(likely * (n / (likely * share[rank]).sum(1))[:, None], first, axis=0).max(1)
    return reached + np.maximum(slope - np.add.reduceat(n, first), 0.0)


def infer(data: np.ndarray, offsets: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of each document's main language, and its share."""
    docs, langs = len(offsets) - 1, model.shape[0]
    best, score = np.zeros(docs, np.int64), np.zeros(docs)
    doc, feature, n = _grams(data, offsets)
    if not len(doc):
        return best, score
    first = runs(doc)
    which, n = doc[first], n.astype(float)
    log = model.T[feature]
    single = np.add.reduceat(n[:, None] * log, first, axis=0)
    rank = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(doc))))
    likely = np.exp(log - log.max(1, keepdims=True))
    shift = np.add.reduceat(n * log.max(1), first)
    share = np.full((len(first), langs), 1.0 / langs)
    best[which], score[which] = single.argmax(1), 1.0
    if langs == 1:
        return best, score
    share, full = _em(doc, first, n, likely, share, ROUNDS)
    full = _ceiling(doc, first, n, likely, share, full)
    cost = 0.5 * OVERLAP * np.log(np.add.reduceat(n, first))
    reached = single.max(1)
    order = np.argsort(-share, axis=1, kind="stable")
    # No set is likelier than the best shares of all languages, so most documents are settled by their first, and no size is tried that its penalty rules out.
    for size in range(2, langs + 1):
        open_ = full + shift - (size - 1) * cost > reached
        if not open_.any():
            break
        rows = open_[rank]
        near = np.zeros_like(share)
        np.put_along_axis(near, order[:, :size], np.take_along_axis(share, order[:, :size], 1), 1)
        near = (near + 1e-9 * (near > 0))[open_]
        near /= near.sum(1, keepdims=True)
        small = runs(rank[rows])
        found, value = _em(doc[rows], small, n[rows], likely[rows], near, ROUNDS)
        value += shift[open_] - (size - 1) * cost[open_]
        won = value > reached[open_]
        at = np.flatnonzero(open_)[won]
        reached[at], best[which[at]], score[which[at]] = value[won], found[won].argmax(1), found[won].max(1)
    return best, np.minimum(score, 1.0)


def identify(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """The main language of every text and its share of the text.

    docs: columns doc_id and text; others are ignored. A row for each row:
    doc_id, lang_pred, score. `und` with score 0 if text is null or has no
    letter, or nothing was learned. Whole texts count.
    """
    langs = list(model)
    shared = docs.sparkSession.sparkContext.broadcast((langs, np.array(list(model.values())) if langs else np.zeros((0, FEATURES))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = shared.value
        letter = np.zeros(256, bool)
        letter[65:91] = letter[97:123] = True
        for batch in batches:
            lang, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            for at, to, data, offsets in _blocks(batch.column(1), BLOCK_BYTES // max(1, len(langs) // 4)):
                if not langs:
                    break
                sums = np.append(0, np.cumsum(letter[data]))
                ascii_letters = sums[offsets[1:]] > sums[offsets[:-1]]
                has = np.array([bool(a) or any(c.isalpha() for c in data[x:y].tobytes().decode()) for a, x, y in zip(ascii_letters, offsets, offsets[1:], strict=False)], bool)
                best, part = infer(data, offsets, table)
                lang[at:to] = np.where(has, np.array(langs, object)[best], "und")
                score[at:to] = np.where(has, part, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _padded()).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(divisor: int, remainder: int):
    """Whether crc32(doc_id as text) mod divisor is the remainder; false without doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % divisor == remainder, F.lit(False))
