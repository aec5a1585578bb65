"""SimHash classes, ranked search and importance resampling against brute force, on messy and on empty tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.messy import docs, prose, texts
from tracelake.llm import bytewords, lexical, resample, simhash

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
PIECES = st.lists(st.one_of(st.none(), st.text(alphabet="aB\n \t\x1c,7é", max_size=40)), max_size=8)


def words(text):
    return (text or "").encode().translate(LOWER).split()


def terms(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER))


@settings(max_examples=80, deadline=None)
@given(PIECES, st.integers(1, 9))
def test_words_and_terms_whatever_the_parts(batch, part):
    kept, bytewords.PART = bytewords.PART, part
    try:
        for text in batch:
            data = (text or "").encode()
            assert [w for p in bytewords.word_parts(data, bytewords.WORDS) for w in p] == words(text)
            assert [w for p in bytewords.word_parts(data, bytewords.TERMS) for w in p] == terms(text)
    finally:
        bytewords.PART = kept


def expected_print(text, k=4):
    own = words(text)
    shingles = [b" ".join(own[i : i + k]) for i in range(len(own) - k + 1)] or ([b" ".join(own)] if own else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("part", [50, 1 << 22])
def test_fingerprints_of_texts_in_parts(monkeypatch, part):
    monkeypatch.setattr(bytewords, "PART", part)
    for n in (0, 1, 3, 4, 5, 60, 3000):
        text = prose(n, n).upper()
        assert simhash.fingerprint(text.encode()) == expected_print(text)
    assert simhash.fingerprint(None) == 0 and simhash.fingerprint(b" \n") == 0


def components(vertices, near):
    found = {v: v for v in vertices}

    def root(v):
        while found[v] != v:
            v = found[v]
        return v

    ordered = sorted(vertices)
    for k, a in enumerate(ordered):
        for b in ordered[k + 1 :]:
            if near(a, b) and root(a) != root(b):
                found[max(root(a), root(b))] = min(root(a), root(b))
    return {v: root(v) for v in vertices}


def family(seed, centres, each, flips):
    draw = random.Random(seed)
    out = set()
    for _ in range(centres):
        centre = draw.getrandbits(64)
        for _ in range(each):
            value = centre
            for _ in range(draw.randrange(flips)):
                value ^= 1 << draw.randrange(64)
            out.add(value)
    return sorted(out)


@pytest.mark.parametrize("radius", [0, 1, 3, 4])
def test_forests_connect_what_all_pairs_do(radius, monkeypatch):
    monkeypatch.setattr(simhash, "CELLS", 64)
    points = np.array(family(radius, 4, 40, 8), dtype=np.uint64)
    ones = np.bitwise_count(points)
    for p in np.unique(ones).tolist():
        for q in range(p, p + radius + 1):
            left, right = points[ones == p], points[ones == q]
            a, b = simhash.forest(left, None if p == q else right, radius)
            members = {*left.tolist(), *right.tolist()}
            joined = {frozenset(x) for x in zip(a.tolist(), b.tolist(), strict=True)}
            sides = {int(x): int(np.bitwise_count(np.uint64(x))) for x in members}
            expected = components(members, lambda x, y: (x ^ y).bit_count() <= radius and {sides[x], sides[y]} == {p, q})  # noqa: B023
            linked = components(members, lambda x, y: frozenset((x, y)) in joined)  # noqa: B023
            assert linked == expected and len(a) == len(members) - len(set(expected.values()))


@pytest.mark.parametrize("tile", [8, 1 << 16])
def test_links_over_many_tiles(spark, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", tile)
    points = family(7, 5, 30, 9)
    signed = [int(np.uint64(p).view(np.int64)) for p in points]
    found = simhash.links(spark.createDataFrame([(p, 0) for p in signed], "print long, v long"), 4).collect()
    joined = {frozenset((r.a % 2**64, r.b % 2**64)) for r in found}
    assert components(points, lambda x, y: frozenset((x, y)) in joined) == components(points, lambda x, y: (x ^ y).bit_count() <= 4)


def expected_copies(rows):
    rows = [(i, expected_print(t)) for i, t in rows if i is not None]
    names = components({p for _, p in rows}, lambda a, b: (a ^ b).bit_count() <= 4)
    first = {}
    for i, p in rows:
        first[names[p]] = min(i, first.get(names[p], i))
    return sorted((i, f"{p:016x}", first[names[p]]) for i, p in rows)


def test_near_copies_of_messy_rows(spark):
    rows = texts() + [(200 + k, f"{prose(50, 300)} {prose(60 + k, 1)}") for k in range(20)]
    assert sorted(map(tuple, simhash.near_copies(docs(spark, rows)).collect())) == expected_copies(rows)
    assert simhash.near_copies(docs(spark, [])).count() == 0


def test_near_copies_of_the_test_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert sorted(map(tuple, simhash.near_copies(table).collect())) == expected_copies([tuple(r) for r in table.collect()])


def expected_ranks(rows, items, k=50):
    counted = [(i, collections.Counter(terms(t)), len(terms(t))) for i, t in rows]
    n_docs, n_terms = sum(n > 0 for _, _, n in counted), sum(n for _, _, n in counted)
    df = collections.Counter(t for _, c, _ in counted for t in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(terms(t))
    out = []
    for item, own in asked.items():
        scores = []
        for i, c, n in counted:
            m = 50 + (50 * n * n_docs) // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0 and i is not None:
                scores.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("documents", "items", "leaf"), [(8192, 1 << 18, 8), (5, 60, 1)])
def test_ranks_of_messy_rows(spark, monkeypatch, documents, items, leaf):
    monkeypatch.setattr(lexical, "DOCUMENTS", documents)
    monkeypatch.setattr(lexical, "ITEMS", items)
    monkeypatch.setattr(lexical, "LEAF", leaf)
    rows = texts()
    queries = [(1, prose(2, 9)), (2, None), (3, ""), (4, "é漢字, W7 w7 w9"), (4, "w11!"), (None, "w1"), (5, "nowhere"), (6, prose(7, 40, 50_000)), (7, prose(1, 80))]
    found = lexical.ranked(docs(spark, rows), docs(spark, queries), k=6, item_col="doc_id")
    assert sorted(map(tuple, found.collect())) == expected_ranks(rows, queries, 6)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]


def test_ranks_of_empty_tables(spark):
    assert lexical.ranked(docs(spark, []), docs(spark, [(1, "w1")]), item_col="doc_id").count() == 0
    assert lexical.ranked(docs(spark, [(1, "w1")]), docs(spark, []), item_col="doc_id").count() == 0


def test_bounds_hold_and_prune():
    draw = random.Random(3)
    width, rows, rare = 400, [], [[draw.randrange(50, 400) for _ in range(30)] for _ in range(40)]
    for k in range(2000):
        rows.append(sorted({*[draw.randrange(50) for _ in range(20)], *draw.sample(rare[k % 40], 20)}))
    sparse = lexical.Sparse(np.cumsum([0, *map(len, rows)]), np.concatenate(rows), np.array([draw.randrange(1, 900_000) for r in rows for _ in r], dtype=np.int64))
    items = [lexical.Item(np.array(own), np.array([30 if t < 50 else 9000 for t in own])) for own in (sorted({*rare[k][:15], *range(10)}) for k in range(40))]
    searcher = lexical.Searcher(items, width, 10)
    searcher.search(np.arange(2000), sparse)
    for item, best in zip(items, searcher.best, strict=True):
        weights = np.zeros(width, dtype=np.int64)
        weights[item.term] = item.weight
        scores = sparse.dot(weights)
        order = np.lexsort((np.arange(2000), -scores))[:10]
        assert best.docs.tolist() == order.tolist() and best.scores.tolist() == scores[order].tolist()
    assert searcher.scored < 0.25 * 2000 * len(items)


def expected_sample(rows, target, longest=1, buckets=10_000, percent=10, least=20, seed=2024):
    def features(text):
        own = terms(text)
        return [b" ".join(own[i : i + n]) for n in range(1, longest + 1) for i in range(len(own) - n + 1)]

    bucket = lambda f: zlib.crc32(f) % buckets
    s, t = (collections.Counter(bucket(f) for x in side for f in features(x)) for side in ([t for _, t in rows], target))
    ns, nt = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log(float(t[b] + 1) * float(ns + buckets) / (float(s[b] + 1) * float(nt + buckets)))) for b in s}
    out, fit = [], []
    for k, (i, text) in enumerate(rows):
        own = features(text)
        weight, score = sum(gain[bucket(f)] for f in own), None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if len(terms(text)) >= least:
                fit.append((-score, i, -len(own), k))
        out.append([i, len(own), weight, score, None])
    for rank, (*_, k) in enumerate(sorted(fit)[: len(fit) * percent // 100], 1):
        out[k][4] = rank
    return sorted(map(repr, map(tuple, out)))


@pytest.mark.parametrize(("longest", "percent", "hot"), [(1, 10, 1000), (1, 60, 5), (3, 30, 5), (25, 50, 1000)])
def test_sample_of_messy_rows(spark, monkeypatch, longest, percent, hot):
    monkeypatch.setattr(resample, "HOT", hot)
    rows = texts() + [(300 + k, f"{prose(3, 12)}\n{prose(70 + k, 15)}\n\n , \n{prose(3, 12)}\nw1\nw2\nw3") for k in range(25)] + [(None, "x y z")]
    target = [prose(80, 30), None, "", "w1\nw2 w3"]
    found = resample.resampled(docs(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, longest=longest)
    assert sorted(repr(tuple(r)) for r in found.collect()) == expected_sample(rows, target, longest, percent=percent)


def test_sample_of_empty_tables(spark):
    nothing = spark.createDataFrame([], "text string")
    assert resample.resampled(docs(spark, []), nothing).count() == 0
    found = resample.resampled(docs(spark, [(1, None), (2, prose(1, 30))]), nothing, percent=100).collect()
    assert sorted((r.doc_id, r.n_features, r.rank) for r in found) == [(1, 0, None), (2, 30, 1)]
