"""Operators on documents against brute force, on rows of every awkward kind, and on none."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tests.conftest import SF
from pyspark.sql import functions as F

from veritab.llm.components import with_group
from veritab.llm import bpe, jaccard, katz, language, mixing, pii, quality, substrings

from .conftest import docs_of

LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return docs_of(spark, corpus).cache()


def split(text):
    return (text or "").encode().split()


def test_repeats(docs, corpus):
    seen, want = set(), []
    for i, t in sorted(((i, t or "") for i, t, _, _ in corpus), key=lambda x: x):
        w, gone = split(t), set()
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            gone |= set(range(k, k + 20)) if key in seen else set()
            seen.add(key)
        want.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    rows = substrings.remove_repeats(docs).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows) == sorted(want)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in rows)


def test_katz(docs, corpus):
    uni, bi, starts = collections.Counter(), collections.Counter(), 0
    texts = [(i, [w.decode() for w in split((t or "").translate(LOWER))] + [""]) for i, t, _, _ in corpus]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    for i, w in texts:
        if not held(i):
            uni.update(w)
            bi.update(zip(["<"] + w, w, strict=False))
            starts += 1
    often = lambda c: [sum(v == r for v in c.values()) for r in range(1, 7)]
    d1, d2, n = katz.discounts(often(uni)), katz.discounts(often(bi)), sum(uni.values())
    share = lambda d, c: 1.0 if c > 5 else d[c]
    unknown = sum((1 - share(d1, c)) * c for c in uni.values()) / n
    one = lambda w: share(d1, uni[w]) * uni[w] / n if uni[w] else unknown
    freed, taken = collections.Counter(), collections.Counter()
    for (h, w), c in bi.items():
        freed[h] += (1 - share(d2, c)) * c
        taken[h] += one(w)

    def p(h, w):
        total = starts if h == "<" else uni[h] * (h != "")
        if not total:
            return one(w)
        over = total + (freed[h] <= 0)
        if bi[h, w]:
            return share(d2, bi[h, w]) * bi[h, w] / over
        return (freed[h] / total if freed[h] > 0 else 1 / over) / (1 - taken[h]) * one(w)

    for h in list(uni)[:20]:
        assert sum(p(h, w) for w in uni) + p(h, "?") == pytest.approx(1, abs=1e-9)
    want = sorted((i, held(i), len(w), sum(x in uni for x in w), n, round(sum(math.log10((uni[x] + 1) / (n + len(uni) + 1)) for x in w), 6), round(sum(math.log10(p(h, x)) for h, x in zip(["<"] + w, w, strict=False)), 6)) for i, w in texts)
    got = sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in katz.score(docs).collect())
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=2e-6)


def test_discounts():
    assert (katz.discounts([0] * 6)[1:] < 1).all() and (katz.discounts([100, 50, 30, 20, 15, 12])[1:] < 1).all()
    assert katz.Unigrams(np.array([0] * 8))(np.array([0]))[0] == 1.0


@pytest.fixture(scope="module")
def codec():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return bpe.Codec(bpe.load_ranks(f.read()), P.PATTERN)


def test_bpe(docs, corpus, codec):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rows = bpe.encode_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    want = sorted((i, own.encode_ordinary(t or ""), (t or "").encode()) for i, t, _, _ in corpus)
    assert sorted((r.doc_id, bpe.unpack(r.ids), bytes(r.decoded)) for r in rows) == want
    for t in ["a" * 3000, "ab" * 900, " \n  x\t\t y  ", "'s 'll<|endoftext|>", "\x1c \x85 é中🙂 1½", "  ", " \n", "x \n y"]:
        assert bpe.unpack(codec.encode(t)) == own.encode_ordinary(t)


def test_bpe_tree_goes_down_to_bytes(codec):
    """A word of n bytes that is no token takes n - 1 joins, unless a part was met before; all re-encode a window."""
    joins, join = [], codec.join
    codec.parts = dict(codec.bytes)
    codec.join = lambda a, b: joins.append((a, b)) or join(a, b)
    try:
        assert codec.piece(b" qzxvwkjq") == codec.merge(b" qzxvwkjq")
        assert len(joins) == 8 and all(a and b for a, b in joins)
        codec.piece("é中🙂½".encode())
        assert len(joins) > 8
    finally:
        del codec.join


def test_bpe_tree_is_the_definition(codec):
    import random

    rng = random.Random(3)
    for _ in range(150):
        piece = "".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 200))).encode()
        assert codec.tree(piece) == codec.merge(piece)
    assert all(codec.tree(t) == [i] for i, t in enumerate(codec.token[:50256]) if i % 50 == 0)


def test_jaccard(docs, corpus):
    def shingles(t):
        w = split((t or "").translate(LOWER))
        return frozenset(zip(w, w[1:], w[2:], w[3:], w[4:], strict=False)) if len(w) > 4 else frozenset([tuple(w)] if w else [])

    sets = [(i, shingles(t)) for i, t, _, _ in corpus]
    parent, degree = list(range(len(sets))), [0] * len(sets)

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and 100 * len(a & b) >= 80 * len(a | b):
                degree[x] += 1
                degree[y] += 1
                parent[find(x)] = find(y)
    least = collections.defaultdict(lambda: 1 << 60)
    for x, (i, _) in enumerate(sets):
        least[find(x)] = min(least[find(x)], i)
    want = sorted((i, len(s), least[find(x)], degree[x]) for x, (i, s) in enumerate(sets))
    rows = jaccard.similar_sets(docs).collect()
    assert sorted(tuple(r)[:4] for r in rows) == want
    # One component_key a component, none for empty sets.
    assert len({r.component_key for r in rows if r.n_shingles}) == len({find(x) for x, (_, s) in enumerate(sets) if s}) and all(r.component_key is None for r in rows if not r.n_shingles)


def test_divide_skip_finds_every_pair():
    rng = np.random.default_rng(2)
    sets = [np.setdiff1d(np.arange(40), rng.integers(0, 40, rng.integers(1, 9))) for _ in range(80)]
    size = np.array([len(s) for s in sets])
    want = {(x, y) for x in range(80) for y in range(x + 1, 80) if 100 * (o := len(np.intersect1d(sets[x], sets[y]))) >= 80 * (size[x] + size[y] - o)}
    assert set(jaccard.divide_skip(size, sets)) == want and want
    side = np.arange(80) % 2
    assert set(jaccard.divide_skip(size, sets, side)) == {(x, y) for x, y in want if side[x] != side[y]}


def test_large_clusters_are_searched_in_tiles(spark, docs, monkeypatch):
    four = lambda: sorted(tuple(r)[:4] for r in jaccard.similar_sets(docs).collect())
    whole = four()
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    assert four() == whole
    monkeypatch.setattr(jaccard, "GROUPED", 1)
    assert four() == whole


def test_a_percolating_cluster_is_searched_by_cells(spark, monkeypatch):
    """A chain of documents that share passages, most of them not similar; each set goes to the cells of its own posted shingles only."""
    import random

    rng = random.Random(7)
    passages = [[f"p{i}w{k}" for k in range(30)] for i in range(81)]
    texts = [" ".join(passages[i] + passages[i + 1]) for i in range(80)]
    texts += [t.replace(t.split()[-1 - rng.randrange(2)], "changed") for t in texts[::5]]
    df = docs_of(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    four = lambda: sorted(tuple(r)[:4] for r in jaccard.similar_sets(df).collect())
    whole = four()
    assert sum(r[3] > 0 for r in whole) == 32 and len({r[2] for r in whole}) == 80
    seen = []
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "GROUPED", 0)
    monkeypatch.setattr(jaccard, "with_group", lambda rows, *a: seen.append(rows.columns) or with_group(rows, *a))
    assert four() == whole and ["v", "root", "g", "groups", "cell"] in seen


def test_mixing(docs, corpus):
    rows = mixing.mix_sources(docs).collect()
    size = collections.Counter()
    for _, t, _, s in corpus:
        size[s] += len(split(t))
    order = sorted(size, key=lambda s: (s is None, s))
    weight, free, total = {s: i % 3 + 1.0 for i, s in enumerate(order)}, set(order), float(sum(size.values()))
    target = {}
    while True:
        share = {s: (total - sum(target.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 3 * size[s]}
        target |= {s: 3.0 * size[s] for s in full}
        free -= full
        if not full:
            target |= {s: share[s] for s in free}
            break
    taken = collections.Counter()
    for r in rows:
        assert r.size == len(split(next(t for i, t, _, s in corpus if i == r.doc_id and s == r.source))) and r.taken <= 3 * r.size and r.taken == r.copies * r.size
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source]
        taken[r.source] += r.taken
    assert len(rows) == len(corpus)
    for s in order:
        assert abs(taken[s] - target[s]) <= max(r.size for r in rows if r.source == s)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(docs.repartition(3)).collect()))


def test_pivotal_keeps_words():
    rng = np.random.default_rng(4)
    sizes = sorted(rng.integers(1, 300, 400).tolist(), reverse=True)
    for seed in range(50):
        out = mixing.pivotal([(k, s, 0.3) for k, s in enumerate(sizes)], seed)
        assert sum(0 < x < 1 for x in out) <= 1
        assert sum(s * x for s, x in zip(sizes, out, strict=True)) == pytest.approx(0.3 * sum(sizes))


@pytest.mark.parametrize("rows", [[(100, 0.3), (40, 0.3), (40, 0.3), (40, 0.3)], [(500, 0.3)] + [(60, 0.3)] * 8, [(100, 0.5), (60, 0.2), (60, 0.5), (60, 0.5), (60, 0.8)], [(90, 0.05), (50, 0.9), (50, 0.4), (30, 0.7), (30, 0.1), (7, 0.6), (3, 0.2)], [(10, 0.4)] * 12, [(20, 0.75)]])
def test_pivotal_keeps_every_expectation(rows):
    """Over many seeds each document is taken as often as its fraction says, the last residual drawn by its own."""
    n, hits = 6000, np.zeros(len(rows))
    for seed in range(n):
        hits += mixing.pivotal([(k, s, p) for k, (s, p) in enumerate(rows)], seed)
    for h, (_, p) in zip(hits / n, rows, strict=True):
        assert abs(h - p) < 4.5 * math.sqrt(p * (1 - p) / n)


def test_sources_come_near_their_targets(spark):
    """A source misses by less than one document; all sources together by 2 %."""
    rows = mixing.mix_sources(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect()
    assert rows and all(abs(r.taken - r.target) < r.most for r in rows)
    assert sum(abs(r.taken - r.target) for r in rows) <= 0.02 * sum(r.target for r in rows)


def test_many_sources_are_numbered_in_order(spark):
    names = [f"{chr(97 + i % 26)}{i:05d}" for i in range(2000)] + [None, "é", "Z"]
    got = mixing.targets(spark.createDataFrame([(x, 1 + i % 7) for i, x in enumerate(names)], "source string, size long").repartition(7)).collect()
    assert {r.source: r.place for r in got} == {x: i for i, x in enumerate(sorted(names, key=lambda x: (x is None, x)))}
    assert sum(r.target for r in got) == pytest.approx(sum(r.source_size for r in got)) and all(r.target <= 3 * r.source_size for r in got)


def test_take(spark, docs):
    mixed = mixing.mix_sources(docs)
    want = collections.Counter({r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.sum("copies").alias("n")).collect() if r.n})
    got = mixing.take(docs, mixed)
    assert got.columns == docs.columns
    assert collections.Counter(r.doc_id for r in got.collect()) == want


def test_language(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(table.filter(~language.held_out(3, 1)))
    rows = language.identify(table.withColumn("held", language.held_out(3, 1)), model).join(table, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in rows)
    en, fr = (" ".join(r.text for r in rows if r.lang == x)[:3000] for x in ("en", "fr"))
    odd = docs_of(spark, [(1, None, None, None), (2, "", "en", "a"), (3, "123 !?", "en", "a"), (4, "中文", "en", "a"), (5, en + fr[:1500], None, None)])
    got = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[4].lang_pred in model
    assert got[5].lang_pred == "en" and 0.5 < got[5].score < 0.85
    assert {r.lang_pred for r in language.identify(odd, language.train(odd.limit(0))).collect()} == {"und"}


def test_a_text_may_mix_more_than_four_languages():
    parts = [(" ".join([x * 3, x + y, y * 2 + x]) + " ") * 40 for x, y in ("ab", "cd", "ef", "gh", "ij", "kl")]
    n = np.full((6, language.FEATURES), language.SMOOTHING)
    for i, t in enumerate(parts):
        _, feature, k = language._grams(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))
        np.add.at(n[i], feature, k)
    data = "".join(parts).encode()
    _, share = language.infer(np.frombuffer(data, np.uint8), np.array([0, len(data)]), np.log(n / n.sum(1, keepdims=True)))
    assert share[0] == pytest.approx(1 / 6, abs=0.02)


def test_language_shares_against_plain_em(spark):
    """The mixture of two languages, by EM over dictionaries, and the penalised choice between one and two."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(table)
    langs, logs = list(model), np.array(list(model.values()))
    texts = [r.text for r in table.filter("lang is not null and length(text) > 400").orderBy("doc_id").limit(12).collect()]
    texts = [f" {a[:300]} {b[:200]} " for a, b in itertools.pairwise(texts)] + [f" {x[:250]} " for x in texts]

    def plain(text):
        raw = [c.lower() if c.isascii() and c.isalpha() else c if ord(c) > 127 else " " for c in text]
        raw = "".join(raw).encode()
        grams = collections.Counter(raw[i : i + 3] for i in range(len(raw) - 2) if raw[i : i + 3] != b"   ")
        place = {g: ((int.from_bytes(g, "big") * 2654435761) & 0xFFFFFFFF) >> 17 for g in grams}
        p = {g: [math.exp(x) for x in logs[:, place[g]]] for g in grams}
        total = sum(grams.values())

        def em(share):
            for _ in range(language.ROUNDS):
                new = [0.0] * len(langs)
                for g, n in grams.items():
                    mass = sum(s * x for s, x in zip(share, p[g], strict=True))
                    for k, s in enumerate(share):
                        new[k] += n * s * p[g][k] / mass
                share = [x / total for x in new]
            return share, sum(n * math.log(sum(s * x for s, x in zip(share, p[g], strict=True))) for g, n in grams.items())

        cost = 0.5 * language.OVERLAP * math.log(total)
        single = [sum(n * math.log(p[g][k]) for g, n in grams.items()) for k in range(len(langs))]
        best, name, score = max(single), single.index(max(single)), 1.0
        share, _ = em([1 / len(langs)] * len(langs))
        order = sorted(range(len(langs)), key=lambda k: -share[k])
        for size in range(2, len(langs) + 1):
            near = [share[k] + 1e-9 if k in order[:size] and share[k] > 0 else 0.0 for k in range(len(langs))]
            got, value = em([x / sum(near) for x in near])
            if value - (size - 1) * cost > best:
                best, name, score = value - (size - 1) * cost, got.index(max(got)), max(got)
        return langs[name], score

    rows = language.identify(docs_of(spark, [(i, t, None, None) for i, t in enumerate(texts)]), model).collect()
    for r in rows:
        lang, score = plain(f" {texts[r.doc_id]} ")
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-6)


def found(t):
    out = []
    digits = lambda m: re.sub("[^0-9]", "", m)
    luhn = lambda d: sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for k, c in enumerate(reversed(d))) % 10 == 0
    for kind, pattern, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ):
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, t) if ok(m[0])]
    return ",".join(out)


def test_pii(spark, docs):
    texts = [
        None, "", "a@b.c x.y%z@q-r.s.t. é🙂 a@b.c%x@d.e", "1.2.3.4.5 256.1.1.1 001.2.3.0004 1.2.3", "4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111", "+1 (319) 555-5132 +12 +1.2.3 call +44 20 7946 0958.",
        "4111 1111 1111 1111 1234 5678 9", "x" * 50000 + "@a.b", "9" * 20000, "@@ a@ @b.c a@b", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
    ]
    rows = pii.find_personal_data(docs_of(spark, [(i, t, None, None) for i, t in enumerate(texts)])).select("doc_id", pii.joined(F.col("base")).alias("b"), pii.joined(F.col("spans")).alias("s")).collect()
    assert {r.doc_id: r.b for r in rows} == {i: found(t or "") for i, t in enumerate(texts)}
    assert all(r.s == r.b for r in rows)
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def test_pii_terms_that_disclose(spark, corpus):
    told = [(1000 + i, f"{a} Zorblax, wrote {i} to jo@ex.org about {b} the thing", None, None) for i, (a, b) in enumerate([("so", "w1"), ("then", "w2"), ("later", "w3"), ("once", "w4")])]
    # Copies of one mention are one witness: kim's terms stay.
    copies = [(2000 + i, "quixly kim@ex.org sits here", None, None) for i in range(5)]
    df = docs_of(spark, [(i, t, a, b) for i, t, a, b in corpus] + told + copies + [(3000 + i, "the thing about it wrote to", None, None) for i in range(300)])
    out = {r.doc_id: r for r in pii.find_personal_data(df).withColumn("clean", pii.sanitised(F.col("text"), F.col("spans"))).collect() if r.doc_id >= 1000}
    for i in range(4):
        assert [s.value for s in out[1000 + i].spans if s.kind == "term"] == ["Zorblax,"]
    assert out[1000].clean == "so [TERM] wrote 0 to [EMAIL] about w1 the thing"
    assert [s.kind for s in out[2000].spans] == ["email"] and not out[3000].spans


def sundry(rng, n):
    return " ".join(f"v{rng.randrange(10**7)}" for _ in range(n))


def test_pii_terms_against_brute_force(spark):
    """Every pair of an entity and a term, by the definition over all documents; only the signatures are the operator's."""
    import random

    rng = random.Random(12)
    mails = [f"u{i}@ex{i % 3}.org" for i in range(6)]
    texts = [None, ""]
    for _ in range(160):
        m = rng.choice(mails)
        texts.append(" ".join([sundry(rng, 6), rng.choice([f"alias{m[1]}", f"Alias{m[1]},", "none"]), m, sundry(rng, 6)]))
    texts += texts[2:12] * 4 + [sundry(rng, 12) + rng.choice(["", " alias1", " none"]) for _ in range(900)]
    df = docs_of(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    found = pii.base_spans(df)
    rows = found.select("doc_id", "text", "__base", pii._entities(F.col("__base")).alias("e"), pii._signature(F.col("text")).alias("s")).collect()
    term = lambda w: re.sub(r"^[\W_]+|[\W_]+$", "", w).lower()
    with_term, with_entity = collections.defaultdict(set), collections.defaultdict(set)
    for r in rows:
        for w in (r.text or "").split():
            with_term[term(w)].add(r.doc_id)
        for e in r.e:
            with_entity[e].add(r.doc_id)
    by = {r.doc_id: r for r in rows}
    want = set()
    for e, docs_e in with_entity.items():
        content = math.log2(len(texts) / len(docs_e))
        for t, docs_t in with_term.items():
            both = docs_e & docs_t
            if both and t and not e.endswith(":" + t):
                entries = {(k, h) for i in both for k, h in enumerate(by[i].s)}
                shared = math.log2(len(both) * len(texts) / (len(docs_e) * len(docs_t)))
                if content > 0 and shared + math.log2(pii.CHANCE) / (len(entries) / pii.SIGNATURE) >= pii.DISCLOSURE * content:
                    want.add((e, t))
    got = pii.disclosing_terms(found)
    assert want and {(r.entity, r.term) for r in got.collect()} == want


def test_pii_copies_and_signatures_keep_terms(spark):
    import random

    rng = random.Random(9)
    # Six texts in five copies each, and six with the same words around the address.
    told = [f"{sundry(rng, 12)} Zorblax said jo@ex.org {sundry(rng, 12)}" for _ in range(6)]
    signed = [f"{sundry(rng, 30)} Quandry regards from bo@ey.org sent at home" for _ in range(6)]
    rows = [t for t in told for _ in range(5)] + signed + [sundry(rng, 9) + " said sent at home regards from" for _ in range(2000)]
    out = pii.find_personal_data(docs_of(spark, [(i, t, None, None) for i, t in enumerate(rows)])).collect()
    terms = {r.doc_id: [s.value for s in r.spans if s.kind == "term"] for r in out}
    assert all(terms[i] == ["Zorblax"] for i in range(30)) and all(terms[i] == ["Quandry"] for i in range(30, 36))
    assert not any(terms[i] for i in range(36, len(rows)))


def test_pii_judges_rare_entities(spark):
    import random

    rng = random.Random(10)
    # An address in two texts; and addresses of a domain in one text each.
    twice = [f"{sundry(rng, 15)} Zorblax said jo@ex.org {sundry(rng, 15)}" for _ in range(2)]
    once = [f"{sundry(rng, 15)} Quandry said p{i}@ey.org {sundry(rng, 15)}" for i in range(5)]
    df = docs_of(spark, [(i, t, None, None) for i, t in enumerate([*twice, *once])])
    many = spark.range(100, 20100).selectExpr("id doc_id", "concat('so it said ', id) text")
    df = df.select("doc_id", "text").unionByName(many)
    out = {r.doc_id: [s.value for s in r.spans if s.kind == "term"] for r in pii.find_personal_data(df).filter("doc_id < 100").collect()}
    assert out == {i: ["Zorblax"] if i < 2 else ["Quandry"] for i in range(7)}
    got = {r.kind: (r.entities, r.out_of_reach, r.without_pool) for r in pii.reach(df).collect()}
    assert got == {"email": (6, 5, 0), "email*": (2, 0, 0)}


def test_quality(spark, docs, corpus):
    rows = quality.quality_rules(docs).collect()
    want = []
    for i, t, _, _ in corpus:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        many = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j for k, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if many[x] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if x.split()]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows]
    assert sorted(got) == sorted(want)
    assert not any(r.kept and r.base_failed for r in rows)
    assert sorted(r.doc_id for r in quality.good_texts(docs).collect()) == sorted(r.doc_id for r in rows if r.kept)


def test_quality_keeps_other_languages(spark):
    import random

    rng = random.Random(12)
    of = lambda letters, extra: " ".join(rng.choice(extra) if extra and k % 5 == 0 else "".join(rng.choice(letters) for _ in range(6)) for k in range(120))
    texts = [of("абвгдежзик", []), of("αβγδεζηθικ", []), of("abcdefghij", ["się", "jest", "przez"]), of("abcdefghij", [])]
    rows = quality.quality_rules(docs_of(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()
    assert {r.doc_id: r.kept for r in rows} == {0: True, 1: True, 2: True, 3: False}


def test_quality_verdicts_agree_with_labels(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    rows = quality.quality_rules(table).collect()
    assert all(r.kept or r.base_failed for r in rows if r.quality == 1)
    assert sum(r.kept for r in rows if r.quality == 0) <= 0.05 * sum(r.quality == 0 for r in rows)


@pytest.mark.parametrize("op", [substrings.remove_repeats, katz.score, jaccard.similar_sets, mixing.mix_sources, quality.quality_rules, pii.find_personal_data])
def test_empty_tables(spark, docs, op):
    assert op(docs.limit(0)).count() == 0


@pytest.mark.parametrize("op", [substrings.remove_repeats, katz.score, jaccard.similar_sets, mixing.mix_sources])
def test_rows_without_id(spark, op):
    df = docs_of(spark, [(None, "a b c", None, None), (None, "a b c", None, "x"), (None, None, None, None), (7, "a b c", None, "x")])
    rows = op(df).collect()
    assert len(rows) == 4 and sum(r.doc_id is None for r in rows) == 3


def test_rows_without_id_of_the_row_operators(spark):
    """Operators that judge each row by itself: rows without id, equal rows, null and empty texts."""
    df = docs_of(spark, [(None, "Call +1 (319) 555-5132 now", None, None), (None, "Call +1 (319) 555-5132 now", None, "x"), (None, None, None, None), (7, "", None, "x"), (7, "  ", "en", "x")])
    model = language.train(docs_of(spark, [(1, "the cat sat on the mat", "en", "a"), (2, "le chat est sur la table", "fr", "a")]))
    made = {
        "bpe": bpe.encode_decode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).select("doc_id", F.col("n_tokens").cast("string").alias("x")),
        "language": language.identify(df, model).select("doc_id", F.col("lang_pred").alias("x")),
        "pii": pii.find_personal_data(df).select("doc_id", F.size("base").cast("string").alias("x")),
        "quality": quality.quality_rules(df).select("doc_id", F.col("n_words").cast("string").alias("x")),
    }
    for name, out in made.items():
        rows = out.collect()
        assert sorted((r.doc_id is None for r in rows)) == [False, False, True, True, True], name
        assert len({r.x for r in rows}) >= 2, name


def test_empty_tables_of_the_row_operators(spark, docs):
    none = docs.limit(0)
    assert bpe.encode_decode(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    assert language.identify(none, language.train(none)).count() == 0 and language.train(none) == {}


def test_repeats_digest(docs):
    r = substrings.remove_repeats(docs).select("kept", substrings.digest("kept").alias("d")).first()
    assert r.d == hashlib.sha256(r.kept.encode()).hexdigest()
