"""Operators over whole texts against brute force, on messy and on empty tables."""

import collections
import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.messy import docs, prose, texts
from tracelake.llm import components, lm_score, near_dedup, shards, substring_dedup, textarrays
from tracelake.llm.components import connected_components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text, lower=False):
    data = (text or "").encode()
    return (data.translate(LOWER) if lower else data).split()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\n\x0b\x85 é", max_size=30)), max_size=12))
def test_words_are_runs_of_anything_but_ascii_space(batch):
    hashes, first = textarrays.text_words(pa.array(batch, pa.string()))
    flat = [w for t in batch for w in words(t)]
    assert np.diff(first).tolist() == [len(words(t)) for t in batch]
    seen = {}
    assert all(seen.setdefault(w, h) == h for w, h in zip(flat, hashes.tolist(), strict=True)) and len(set(seen.values())) == len(seen)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_packing_is_exact(values):
    array = np.array(values, dtype=np.uint64)
    assert textarrays.unpack(textarrays.pack(array)).tolist() == values and textarrays.unsqueeze(textarrays.squeeze(array)).tolist() == values
    assert textarrays.unpack_sorted(textarrays.pack_sorted(np.sort(array))).tolist() == sorted(values)
    cuts = textarrays.bucket_cuts(np.sort(array), 7)
    assert cuts[0] == 0 and cuts[-1] == len(values) and (np.diff(cuts) >= 0).all()


def test_blocks_of_a_huge_text_hash_alike(monkeypatch):
    text = pa.array([prose(1, 3000)])
    whole = textarrays.text_words(text)[0]
    monkeypatch.setattr(textarrays, "BLOCK", 500)
    assert np.array_equal(whole, textarrays.text_words(text)[0])


def expected_scores(rows, alpha=0.4, least=2):
    split = [(i, [w for w in words(t, True)]) for i, t in rows]
    counts = collections.Counter(tuple(w[k : k + n]) for _, w in split for n in (1, 2, 3) for k in range(len(w) - n + 1))
    total = sum(len(w) for _, w in split)

    def score(w, i):
        longest = min(i + 1, 3)
        for n in range(longest, 1, -1):
            gram = tuple(w[i - n + 1 : i + 1])
            if counts[gram] >= least:
                return math.log(counts[gram] / counts[gram[:-1]]) + (longest - n) * math.log(alpha)
        return math.log(counts[(w[i],)] / total) + (longest - 1) * math.log(alpha)

    return sorted((i is None, i or 0, len(w), round(sum(score(w, k) for k in range(len(w))), 6)) for i, w in split)


@pytest.mark.parametrize("shard", [400, 10**7])
def test_lm_scores(spark, monkeypatch, shard):
    monkeypatch.setattr(lm_score, "SHARD", shard)
    rows = texts()
    found = lm_score.stupid_backoff(docs(spark, rows)).collect()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], round(r["log_score"], 6)) for r in found)
    want = expected_scores(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want] and max(w[2] for w in want) == 20_000
    assert all(g[3] == w[3] or g[2] > 1000 and math.isclose(g[3], w[3], rel_tol=1e-11) for g, w in zip(got, want, strict=True))
    assert all((r["mean_log_score"] is None) == (r["n_words"] == 0) for r in found)


def expected_removal(rows, window=13):
    split = [(i, words(t)) for i, t in rows]
    owner = {}
    for i, w in split:
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                owner[key] = min(i, owner.get(key, i))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and owner[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i is None, i or 0, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out)


@pytest.mark.parametrize("shard", [300, 10**7])
def test_substring_dedup(spark, monkeypatch, shard):
    whole = shards.sharded
    monkeypatch.setattr(substring_dedup, "sharded", lambda *a, **k: whole(*a, **k | {"shard_bytes": shard}))
    found = substring_dedup.remove_repeats(docs(spark, texts()))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept"]) for r in found.collect())
    assert got == expected_removal(texts())
    row = found.where("doc_id = 11").first()
    assert [tuple(s) for s in row["spans"]] == [(20, 80)] and row["row"]["path"] == "p"


def test_layout_is_kept_where_nothing_goes(spark):
    found = substring_dedup.remove_repeats(docs(spark, [(1, "a  b\n c")]), layout=True).first()
    assert (found["kept"], found["n_removed"]) == ("a  b\n c", 0)


def expected_groups(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = words(t, True)
        if i is not None:
            sets[i] = frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    name = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * len(sets[a] | sets[b]):
                    name[a] = name[b] = min(name[a], name[b])
    return sorted((i, len(s), name[i], name[i] == i) for i, s in sets.items())


@pytest.mark.parametrize(("k", "percent", "share"), [(3, 85, near_dedup.SHARE), (3, 85, 12), (5, 80, 2)])  # all, some and no fingerprints are hot
def test_near_duplicates(spark, monkeypatch, k, percent, share):
    monkeypatch.setattr(near_dedup, "SHARE", share)
    found = near_dedup.near_duplicates(docs(spark, texts()), k=k, percent=percent)
    assert sorted(map(tuple, found.collect())) == expected_groups(texts(), k, percent)


def test_a_family_around_the_threshold(spark):
    base = prose(20, 120, 10_000).split()
    rows = []
    for n in range(60):
        own = list(base)
        for j in range(n % 9):
            own[(n * 31 + j * 13) % 120] = f"edit{n}x{j}"
        rows.append((n, " ".join(own)))
    found = near_dedup.near_duplicates(docs(spark, rows), k=3, percent=85)
    assert sorted(map(tuple, found.collect())) == expected_groups(rows, 3, 85)


def test_a_family_of_all_similarities(spark):
    """200 texts that are 0.5 to 0.95 alike, as their shared part is longer or shorter; reports the share of links found."""
    base, rows = prose(40, 150, 10_000).split(), []
    for n in range(200):
        own, pick = list(base), random.Random(n)
        for at in pick.sample(range(0, 150), pick.choice((1, 2, 4, 6, 9, 14))):
            own[at] = f"edit{n}x{at}"
        rows.append((n, " ".join(own)))
    found = near_dedup.near_duplicates(docs(spark, rows), k=3, percent=85)
    got = {r["doc_id"]: r["component_id"] for r in found.collect()}
    sets = [set(zip(w, w[1:], w[2:], strict=False)) for w in (t.split() for _, t in rows)]
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(200) for b in range(a)}
    links = [p for p, s in alike.items() if s >= 0.85]
    assert min(alike.values()) < 0.55 and max(alike.values()) > 0.93 and len(links) > 50
    assert sum(got[a] == got[b] for a, b in links) / len(links) == 1.0
    assert got == smallest(range(200), links)


def smallest(names, links):
    """The smallest name that each can reach."""
    up = {v: v for v in names}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        up[high] = low
    return {v: root(v) for v in up}


def boilerplate(families, size):
    """Families of texts below the threshold with each other, each with one pair above it."""
    rows = []
    for f in range(families):
        base, pick = prose(500 + f, 150, 10_000).split(), random.Random(f)
        for n in range(size):
            own = list(base)
            one, other = n == size // 3, n == size // 2
            for at in (3, 6) if one else (9, 12) if other else pick.sample(range(15, 147, 3), 4):
                own[at] = f"edit{f}x{n}x{at}"
            rows.append((f * size + n, " ".join(own)))
    return rows


def rows_of_joins(frame):
    """The rows that each join of a frame's plan has made, once it has run."""
    frame.collect()
    todo, made = [frame._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if "Join" in name:
            made.append(node.metrics().apply("numOutputRows").value())
        below = node.executedPlan() if name == "AdaptiveSparkPlan" else node.plan() if "QueryStage" in name else None
        todo += [below] if below is not None else [node.children().apply(k) for k in range(node.children().size())]
    return made


def test_stars_make_no_more_rows_than_buckets_have_members(spark):
    members = spark.range(600).select(F.col("id").alias("v"), F.lit(100).alias("n"), F.explode(F.sequence(F.lit(1), F.lit(20))).alias("bucket"))
    labels = spark.range(600).select(F.col("id").alias("v"), F.col("id").alias("component"))
    stars = near_dedup._further_stars(members, labels, 0, 85)
    made = rows_of_joins(stars)
    pairs = {tuple(r) for r in stars.collect()}
    centres = {v for v in range(600) if sum(v in p for p in pairs) == 599}
    assert len(made) >= 2 and max(made) <= 600 * 20 and 1 < len(centres) <= near_dedup.DRAWN and all(a in centres or b in centres for a, b in pairs)


def test_pairs_are_ruled_out_by_maps_before_sets_are_sent(spark):
    base, rows = textarrays.mix(np.arange(1, 2001, dtype=np.uint64)), []
    for v in range(40):  # the second of each two has lost a tenth of the first; others share half of their members
        half = textarrays.mix(np.arange(10_000 * (v // 2 + 1), 10_000 * (v // 2 + 1) + 1000, dtype=np.uint64))
        rows.append((v, np.sort(np.concatenate([base[:1000], half]))[: 2000 - 200 * (v % 2)].view(np.int64).tolist()))
    sets = spark.createDataFrame(rows, "v long, shingles array<long>")
    every = spark.createDataFrame([(a, b) for b in range(40) for a in range(b)], "a long, b long")
    left = near_dedup.not_ruled_out(every, near_dedup.parity_maps(sets), 85)
    likely = sorted(map(tuple, left.collect()))
    assert sorted(map(tuple, near_dedup.confirmed(every, sets, 85).collect())) == sorted(map(tuple, near_dedup.confirmed(left, sets, 85).collect())) == [(v, v + 1) for v in range(0, 40, 2)]
    assert len(likely) < 40


def test_a_pair_among_many_related_texts(spark):
    rows = boilerplate(5, 800)
    found = near_dedup.near_duplicates(docs(spark, rows), k=3, percent=85)
    linked = {r["doc_id"]: r["component_id"] for r in found.collect() if not r["kept"]}
    shingles = [near_dedup.shingle_sets(pa.array([t]), 3)[0] for _, t in rows]
    for f in range(5):
        a, b = f * 800 + 266, f * 800 + 400
        both = len(np.intersect1d(shingles[a], shingles[b]))
        assert 100 * both >= 85 * (len(shingles[a]) + len(shingles[b]) - both) and linked.get(b) == linked.get(a, a)


def test_a_round_of_a_family_compares_about_a_pair_a_member(spark, monkeypatch):
    """150 related texts, of which few are linked: rounds after the first stars compare one pair a member, and groups are those of all pairs."""
    asked, rule = [], near_dedup.not_ruled_out
    monkeypatch.setattr(near_dedup, "not_ruled_out", lambda pairs, *rest: (asked.append(pairs.count()), rule(pairs, *rest))[1])
    rows = boilerplate(1, 150)
    found = near_dedup.near_duplicates(docs(spark, rows), k=3, percent=85)
    sets = [frozenset(zip(w, w[1:], w[2:], strict=False)) for w in (t.split() for _, t in rows)]
    links = [(a, b) for a in range(150) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == smallest(range(150), links)
    assert len(asked) > 1 and 0 < max(asked[1:]) <= 150


def test_spanning_pairs_connect_what_all_pairs_do(spark):
    pick = np.random.default_rng(5)
    component = pick.integers(0, 40, 300) // 2 * 2
    a, b = pick.integers(0, 300, (2, 900))
    across = (component[a] != component[b]) & (component[a] % 4 == component[b] % 4)
    a, b = a[across], b[across]
    ca, cb = component[a], component[b]
    links = lambda x, y: smallest(set(component.tolist()), zip(x.tolist(), y.tolist(), strict=True))
    every = links(ca, cb)
    for turn in range(3):
        kept = near_dedup.spanning(a, b, ca, cb, turn)
        assert links(ca[kept], cb[kept]) == every and len(kept) == len(every) - len(set(every.values()))
    assert len(near_dedup.spanning(a[:0], b[:0], ca[:0], cb[:0], 0)) == 0
    found = spark.createDataFrame([(1, 2, 0, 9), (3, 4, 0, 9), (5, 6, 0, 8)], "a long, b long, ca long, cb long")
    assert {tuple(r)[0] in (1, 3) for r in near_dedup.one_for_each_two(found, 0).collect()} == {True, False} and near_dedup.one_for_each_two(found, 0).count() == 2


def test_parity_maps_rule_out_no_link():
    pick = np.random.default_rng(3)
    pool = textarrays.mix(np.arange(1, 400, dtype=np.uint64))
    sets = [np.sort(pick.choice(pool[: int(m)], int(m * 0.95), replace=False)) for m in pick.integers(20, 300, 150)]
    v, n = np.arange(150), np.array([len(s) for s in sets])
    component, side = v % 40, v % 2
    common = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    near = 100 * common >= 80 * (n[:, None] + n[None, :] - common)
    for sides in (side, side * 0):
        a, b = near_dedup.unlike_ruled_out(sides, v, n, component, [near_dedup.parity_map(s) for s in sets], 80)
        got = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
        may = {(x, y) for x in range(150) for y in range(x) if component[x] != component[y] and (sides[x] != sides[y] or not sides.any())}
        may = {(y, x) for x, y in may}
        assert len(got) == len(a) and {p for p in may if near[p]} <= got <= may and len(got) < len(may) / 2


def test_signatures_agree_about_as_often_as_sets():
    one = np.sort(textarrays.mix(np.arange(400, dtype=np.uint64)))
    other = np.sort(textarrays.mix(np.arange(60, 460, dtype=np.uint64)))
    agree = (near_dedup.bands([one], 1) == near_dedup.bands([other], 1)).mean()
    assert abs(agree - 340 / 460) < 0.1
    few = near_dedup.bands([one[:3]], 1)
    assert len(np.unique(few)) == near_dedup.BINS  # every bin is filled, and bands differ by their number


@pytest.mark.parametrize("shape", ["path", "shuffled", "star", "random"])
def test_components(spark, shape):
    pick = random.Random(7)
    names = list(range(1, 1001))
    if shape == "shuffled":
        pick.shuffle(names)
    pairs = {
        "path": [(names[k], names[k + 1]) for k in range(999)],
        "shuffled": [(names[k], names[k + 1]) for k in range(999)],
        "star": [(500, k) for k in range(1, 1001)],
        "random": [(pick.randrange(300), pick.randrange(300)) for _ in range(200)],
    }[shape] + [(5000, 5001), (7000, 7000), (5001, 5000), (None, 3)]
    turns = []
    hooked = components._hooked
    components._hooked = lambda links, turn: (turns.append(turn), hooked(links, turn))[1]
    try:
        got = dict(map(tuple, connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    finally:
        components._hooked = hooked
    want = smallest({v for p in pairs if p[0] is not None for v in p}, [p for p in pairs if p[0] is not None])
    assert got == want and len(turns) < 12


def test_empty_tables(spark):
    none = docs(spark, [])
    assert lm_score.stupid_backoff(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0


def test_kept_hash_of_the_query(spark):
    from tracelake.llm.queries import op10_substring_dedup

    row = op10_substring_dedup(spark, "/root/testdata/sf0.001").orderBy("doc_id").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id = 0").first()["text"]
    assert (row["n_removed"], row["kept_sha256"]) == (0, hashlib.sha256(b" ".join(text.encode().split())).hexdigest())
