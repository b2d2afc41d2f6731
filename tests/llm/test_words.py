"""The tokeniser and the packing against plain Python."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veritab.llm import jaccard, katz, substrings
from veritab.llm._packed import Distinct, Tokeniser, bucket_bounds, from_gaps, gaps, in_bucket, slots, spark_hash


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\n\x0b\x1cßé🙂", max_size=30)), max_size=8))
def test_words(texts):
    found = Tokeniser().words(pa.array(texts, pa.string()))
    plain = [(t or "").encode().split() for t in texts]
    assert found.count.tolist() == [len(x) for x in plain]
    assert [found.data[a:b].tobytes() for a, b in zip(found.starts, found.ends, strict=True)] == [w for x in plain for w in x]
    by = {}
    for h, w in zip(found.hashes.tolist(), (w for x in plain for w in x), strict=True):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)


def test_windows_depend_on_words_alone():
    t = Tokeniser()
    a, b = t.words(pa.array(["z a b c d e f g"])), t.words(pa.array(["y y y", "a b c d e f g"]))
    for size in (1, 2, 3, 5, 7):
        assert a.windows(size)[1] == b.windows(size)[3]
    assert t.words(pa.array(["a"] * 3)).whole(2).tolist() == [False, False]


def test_packing_round_trips():
    rng = np.random.default_rng(1)
    hashes = np.sort(rng.integers(0, 1 << 64, 5000, np.uint64))
    cuts = bucket_bounds(hashes, 7)
    assert cuts[0] == 0 and cuts[-1] == len(hashes)
    keys = [from_gaps(gaps(in_bucket(hashes[cuts[b] : cuts[b + 1]], b, 7, 64))) for b in range(7)]
    assert all((np.diff(k.astype(float)) >= 0).all() for k in keys) and sum(map(len, keys)) == len(hashes)
    assert all((k + np.uint64(-(-(b << 32) // 7) << 32) == hashes[cuts[b] : cuts[b + 1]]).all() for b, k in enumerate(keys))
    assert all(int(from_gaps(gaps(in_bucket(hashes[cuts[b] : cuts[b + 1]], b, 7, 32))).max()) < 1 << 33 for b in range(7))
    counts = rng.integers(0, 1 << 20, 100).astype(np.uint32)
    assert (katz._whole(katz._planes(counts)) == counts).all()
    d = Distinct(np.array([3, 1, 3, 2], np.uint64))
    assert d.values.tolist() == [1, 2, 3] and d.spread(np.array([10, 20, 30])).tolist() == [30, 10, 30, 20]


def test_repeats_need_the_index(spark, monkeypatch):
    """Without blocks in the index nothing hits and nothing is found."""
    passage = " ".join(f"w{i}" for i in range(45))
    df = spark.createDataFrame([(1, f"a b c {passage} d"), (2, f"x {passage} y z")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substrings.remove_repeats(df).collect()} == {1: 0, 2: 45}
    send = substrings._messages
    monkeypatch.setattr(substrings, "_messages", lambda chunk, hashes, buckets, columns: send(chunk, hashes, buckets, [c if c is None or c.dtype != np.uint8 else c & np.uint8(2) for c in columns]))
    assert {r.doc_id: r.n_removed for r in substrings.remove_repeats(df).collect()} == {1: 0, 2: 0}


def test_a_block_that_misses_ends_a_repeat():
    """Of 40 words, blocks begin at 0, 10, 20 and 30; that at 20 hits nothing: windows that hold it whole are no candidates."""
    words = Tokeniser().words(pa.array([" ".join(f"w{i}" for i in range(40))]))
    probes, _ = substrings._probes(words)
    hits = np.ones(31, np.uint8)
    hits[20] = 0
    starts = substrings._extended(words, hits[probes.order])[0]
    assert set(starts.tolist()) == {s for s in range(21) if not s <= 20 <= s + 10}


@pytest.mark.parametrize("n", [1, 2, 12, 211])
def test_each_bucket_has_a_partition_of_its_own(spark, n):
    keys = slots(n)
    assert sorted(spark_hash(keys).astype(np.int64) % n) == list(range(n))
    got = spark.createDataFrame([(int(k),) for k in keys], "k int").select(F.hash("k").alias("h")).collect()
    assert [r.h for r in got] == spark_hash(keys).tolist()


def test_tables_go_when_they_are_no_longer_needed(spark, monkeypatch):
    from veritab.llm import _packed

    before = _packed.made()
    first, second = (_packed.written(spark.range(3)) for _ in range(2))
    kept = _packed._made[-1]
    assert _packed.made() == before + 2 and _packed.discard(spark, before, (kept,)) == 1
    assert second.count() == 3 and _packed.made() == before + 1
    monkeypatch.setattr(type(spark.sparkContext), "master", "spark://host:7077", raising=False)
    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError, match="share"):
            _packed.shared_dir(spark)


def test_marks_round_trip():
    rng = np.random.default_rng(3)
    marks = np.sort(rng.integers(1, 1 << 48, 300, np.uint64))
    for n in (0, 1, 50, 5000):
        which = rng.integers(0, len(marks) + 1, n)
        packed = jaccard._pack_marks(which, marks)
        assert (jaccard._marks(packed) == np.append(np.uint64(0), marks)[which]).all()
        assert len(packed) <= 1 + 6 * n
