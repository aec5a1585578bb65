"""Vector search and classifiers against brute force and held-out labels; the whole pipeline."""

import collections
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.messy import docs, prose, texts
from tracelake.llm import ann, labelled, quality, queries, toxicity

DATA = "/root/testdata/sf0.001"


def exact_top(rows, k):
    usable = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v):
            usable[i] = max(usable.get(i, v), v)
    out = []
    for q in usable:
        if q % 5 == 0:
            scored = sorted((-(np.array(usable[q]) * np.array(v)).sum(), i) for i, v in usable.items() if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale", [False, True])
def test_all_neighbours_of_a_small_table(spark, monkeypatch, scale):
    monkeypatch.setattr(ann, "TARGET", 1.0)
    monkeypatch.setattr(ann, "BLOCK", 16)
    draw = np.random.default_rng(1)
    rows = [(n, (draw.normal(size=8) * (1 + 3 * scale * (n % 3))).tolist()) for n in range(90)]
    rows = [(n, (np.array(v) / (1 if scale else np.linalg.norm(v))).tolist()) for n, v in rows]
    rows += [(100 + n, rows[3][1]) for n in range(30)]  # ties
    rows += [(200, None), (205, [0.0] * 8), (210, [float("nan")] * 8), (215, [1.0, None] * 4), (220, [1.0] * 5), (None, [1.0] * 8), (5, rows[5][1]), (225, [float("inf")] * 8), (230, [])]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cell int, v string")
    got = sorted(map(tuple, ann.nearest(table, F.col("vec_id") % 5 == 0, k=10).collect()))
    want = exact_top(rows, 10)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-12)
    assert ann.nearest(table.where("false"), F.col("vec_id") % 5 == 0).count() == 0
    assert ann.nearest(table.where("vec_id = 5"), F.col("vec_id") % 5 == 0).count() == 0


def test_every_query_is_filled_up(spark):
    """With the production target: few vectors, and lone vectors beside tight clusters."""
    draw = np.random.default_rng(9)
    few = [(n, draw.normal(size=8).tolist()) for n in range(21)]
    centres = np.eye(8)[:3]
    tight = [(n, (centres[n % 3] + 0.01 * draw.normal(size=8)).tolist()) for n in range(1, 240) if n % 40] + [(40 * n, (-np.eye(8)[3 + n % 5]).tolist()) for n in range(6)]
    for rows in (few, tight):
        table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        found = ann.nearest(table, F.col("vec_id") % 20 == 0).groupBy("query_id").agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("d"), F.max("rank").alias("r")).collect()
        assert len(found) == sum(n % 20 == 0 for n, _ in rows) and {(x["n"], x["d"], x["r"]) for x in found} == {(20, 20, 20)}


def test_hadamard_keeps_lengths_and_cells_are_the_nearest_axes():
    x = np.random.default_rng(2).normal(size=(20, 6))
    for turned in ann.rotations(x, 8, 5):
        assert np.allclose((turned**2).sum(axis=1), (x**2).sum(axis=1))
    for layout in ann.LAYOUTS:
        cells, all_ = ann.cells(x, 8, layout), ann.probes(x, 8, layout, layout.cells_in_table(8))
        assert np.array_equal(cells, ann.probes(x, 8, layout, 3)[:, :, 0]) and np.array_equal(all_[:, :, :9], ann.probes(x, 8, layout, 9))
        assert all(len(np.unique(row)) == layout.tables * layout.cells_in_table(8) for row in all_.reshape(len(x), -1))
        place = [min(int(np.flatnonzero(all_[n, t] == cells[(n + 1) % 20, t])[0]) for t in range(layout.tables)) + 1 for n in range(20)]
        assert ann.probes_to(x, np.roll(x, -1, axis=0), 8, layout).tolist() == place


def test_few_pairs_of_clustered_vectors_are_compared(spark, monkeypatch):
    draw = np.random.default_rng(6)
    centres = draw.normal(size=(150, 32))
    x = np.repeat(centres, 40, axis=0) + 0.2 * draw.normal(size=(6000, 32))
    table = spark.createDataFrame([(n, v) for n, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    chosen, keep = [], ann._chosen
    monkeypatch.setattr(ann, "SEND", 2)  # as in a table a hundred times as large, where comparisons weigh more
    monkeypatch.setattr(ann, "_chosen", lambda *a: chosen.append(keep(*a)) or chosen[-1])
    found = ann.nearest(table, F.col("vec_id") % 20 == 0).toPandas().groupby("query_id")["vec_id"].apply(set)
    x = x.astype(np.float32).astype(float)
    hits, ((layout, count),) = [], chosen
    for q in range(0, 6000, 20):
        score = x @ x[q]
        score[q] = -np.inf
        hits.append(len(set(np.argsort(-score)[:20].tolist()) & found[q]) / 20)
    long = np.concatenate([x, np.sqrt(np.maximum(0, (x**2).sum(axis=1).max() - (x**2).sum(axis=1)))[:, None]], axis=1)
    home, visited = ann.cells(long, 64, layout), ann.probes(x[::20], 64, layout, count)
    share = np.mean([np.any([np.isin(home[:, t], v[t]) for t in range(layout.tables)], axis=0).mean() for v in visited])
    assert np.mean(hits) >= 0.9 and share < 0.2, (np.mean(hits), share, layout, count)


def test_recall_of_the_query(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas()
    matrix, ids = np.stack(table["embedding"].map(lambda v: np.asarray(v, dtype=float))), table["vec_id"].to_numpy()
    found = queries.op5_nearest_neighbours(spark, DATA).toPandas().groupby("query_id")["vec_id"].apply(set)
    hits = []
    for k in np.flatnonzero(ids % 20 == 0):
        score = matrix @ matrix[k]
        score[k] = -9
        hits.append(len(set(ids[np.lexsort((ids, -score))[:20]]) & found[ids[k]]) / 20)
    assert np.mean(hits) >= 0.9 and len(found) == len(hits)


def test_statistics_of_messy_texts():
    import pyarrow as pa

    x = pd.DataFrame(quality.statistics(pa.array([None, "", "Ab c\nAb c\n\n#", "x" * 50])), columns=quality.FEATURES)
    assert (x.iloc[:2] == 0).all().all()
    row = x.iloc[2]
    assert np.isclose(row["upper"], 2 / 12) and np.isclose(row["newline"], 3 / 12) and np.isclose(row["distinct_words"], 3 / 5) and np.isclose(row["top_line"], 2 / 3)
    assert x.iloc[3]["long_words"] == 1


def test_trees_learn_and_flat_traversal_matches_a_walk():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(800, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] < -0.5)).astype(float)
    forest = quality.fit(x[:600], y[:600], trees=40)
    got = forest.scores(x[600:])
    assert ((got > 0.5) == y[600:]).mean() > 0.93

    def walk(row):
        total = forest.start
        for feature, limit, leaf in zip(forest.feature, forest.limit, forest.leaf, strict=True):
            node = 0
            while node < len(limit):
                node = 2 * node + 1 + int(row[feature[node]] > limit[node])
            total += leaf[node - len(limit)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(got[:50], [walk(r) for r in x[600:650]])
    assert np.allclose(quality.fit(x[:5], np.ones(5)).scores(x[:2]), 6 / 7)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def slow_boosting(x, y, trees, depth, rate, bins, ridge, least):
    """The same trees by loops over rows, features and limits; margins of the rows that they were fitted on."""
    edges = [[np.quantile(x[:, f], k / bins) for k in range(1, bins)] for f in range(x.shape[1])]
    binned = [[sum(e < v for e in edges[f]) for f, v in enumerate(row)] for row in x]
    margin = [np.log(y.mean() / (1 - y.mean()))] * len(y)
    for _ in range(trees):
        p = [1 / (1 + np.exp(-m)) for m in margin]
        groups = [list(range(len(y)))]
        for _ in range(depth):
            split = []
            for rows in groups:
                g, h = sum(y[i] - p[i] for i in rows), sum(p[i] * (1 - p[i]) for i in rows)
                best = (1e-9, None)
                for f in range(x.shape[1]):
                    for b in range(bins - 1):
                        left = [i for i in rows if binned[i][f] <= b]
                        gl, hl = sum(y[i] - p[i] for i in left), sum(p[i] * (1 - p[i]) for i in left)
                        if hl >= least and h - hl >= least:
                            gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                            if gain > best[0] + 1e-12:
                                best = (gain, (f, b))
                f, b = best[1] or (0, bins)
                split += [[i for i in rows if binned[i][f] <= b], [i for i in rows if binned[i][f] > b]]
            groups = split
        for rows in groups:
            value = rate * sum(y[i] - p[i] for i in rows) / (sum(p[i] * (1 - p[i]) for i in rows) + ridge)
            for i in rows:
                margin[i] += value
    return np.array(margin)


@pytest.mark.parametrize("seed", [1, 2])
def test_boosting_is_that_of_a_slow_form(seed):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(90, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.3 * draw.normal(size=90) > 0.3).astype(np.float64)
    how = {"trees": 5, "depth": 2, "rate": 0.3, "bins": 7, "ridge": 1.0, "least": 2.0}
    assert np.allclose(quality.fit(x, y, **how).scores(x), 1 / (1 + np.exp(-slow_boosting(x, y, **how))), atol=1e-9)


def test_very_long_texts_are_judged_whole():
    parts = [prose(70, 100_000, 900), prose(71, 100_000, 900).upper()]
    long, both = "\n".join(parts), quality.statistics(pa.array(["\n".join(parts), *parts]))
    names = dict(zip(quality.FEATURES, both.T, strict=True))
    n = [len(p.encode()) for p in parts]
    assert np.isclose(names["lower"][0] * len(long), names["lower"][1] * n[0] + names["lower"][2] * n[1])
    assert np.isclose(names["upper"][0] * len(long), names["upper"][2] * n[1])
    assert np.isclose(names["log_words"][0], np.log1p(200_000)) and np.isclose(names["log_lines"][0], np.log1p(2))
    own = next(iter(toxicity.feature_sets(pa.array([long]))))
    rare = np.setdiff1d(own, next(iter(toxicity.feature_sets(pa.array([parts[0]])))))  # what only the end of the text has
    model = toxicity.Linear(rare[:50], np.ones(50), -49.5)
    assert model.scores(pa.array([long, parts[0]])).round(3).tolist() == [0.622, 0.0]


def test_held_out_rows_are_never_learned_from(spark):
    ids = list(range(200))
    frame = docs(spark, [(i, f"t{i}") for i in ids])
    drawn = labelled.sample(frame, labels(spark, [(i, 1, 0) for i in ids] + [(None, 1, 1), (3, None, 2)]), "quality", 10_000)
    assert {r["body"] for r in drawn.collect()} == {f"t{i}" for i in ids if zlib.crc32(str(i).encode()) % 5}
    few = labelled.sample(frame, labels(spark, [(i, 1, 0) for i in ids]), "quality", 40).count()
    assert 15 <= few <= 70


@pytest.mark.parametrize(("operator", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_learn(spark, operator, label):
    rows, marks = [], []
    for n in range(240):
        bad = n % 3 == 0
        text = prose(1000 + n, 60, 5000)
        if bad:
            text = text.upper().replace(" ", "### ") + " scumbag"
        rows.append((n, text))
        marks.append((n, int(not bad), int(bad)))
    frame = docs(spark, [*rows, (None, None), (500, ""), (501, rows[0][1]), (501, rows[0][1])])
    got = operator.score(frame, labels(spark, marks)).toPandas()
    assert len(got) == 244 and got["score"].between(0, 1).all() and not got[got["doc_id"].isna()]["held_out"].any()
    truth = {i: (q if label == "quality" else t) for i, q, t in marks}
    out = got[got["held_out"] & got["doc_id"].isin(truth)]
    assert len(out) > 20 and (out["predicted"] == out["doc_id"].map(truth)).mean() > 0.95
    assert operator.score(frame.where("false"), labels(spark, marks)).count() == 0
    blind = operator.score(frame, labels(spark, [])).toPandas()
    assert len(blind) == 244 and np.allclose(blind["score"], 0.5)


@pytest.mark.parametrize(("name", "label", "recall", "precision"), [("op6_quality", "quality", 0.97, 0.97), ("op7_toxicity", "toxic", 0.8, 0.9)])
def test_held_out_recall_and_precision(spark, name, label, recall, precision):
    folder = "/root/testdata/sf0.1"
    scored = queries.QUERIES[name](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").toPandas()
    told, true = scored["predicted"] == 1, scored[label] == 1
    assert (told & true).sum() / true.sum() >= recall and (told & true).sum() / told.sum() >= precision


def test_toxic_rows_go_with_all_columns_kept(spark):
    rows = [(n, prose(n, 50, 5000) + (" scumbag" if n % 4 == 0 else "")) for n in range(200)]
    frame = docs(spark, rows)
    kept = toxicity.accepted(frame, labels(spark, [(n, 1, int(n % 4 == 0)) for n in range(200)]))
    assert kept.columns == frame.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {n for n in range(200) if n % 4}


def test_pipeline(spark):
    import corpus_pipeline as P

    frame = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [name for name, _ in P.STAGES] == ["toxicity", "near dedup", "substring dedup", "decontamination", "sentencepiece"] and P.ORACLE_SQL is None
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, frame, DATA).checkpoint()
        assert after.columns == frame.columns and after.dtypes == frame.dtypes, name
        assert 0 < after.count() <= frame.count() and after.join(frame, "doc_id", "left_anti").isEmpty()
        frame = after
    last = P.encode(spark, frame, DATA)
    assert last.count() == frame.count() and last.where("not same").isEmpty()
    assert P.run(spark, DATA).select("doc_id", "n_ids").exceptAll(last.select("doc_id", "n_ids")).isEmpty()


def test_pipeline_on_messy_rows(spark):
    import corpus_pipeline as P

    rows = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.drop_near_copies(spark, rows, DATA)
    assert {r["doc_id"] for r in kept.collect()} >= {1, 5, 6, 7, None} and kept.where("doc_id in (2, 3, 4, 9)").isEmpty()
    cut = P.cut_repeats(spark, kept, DATA)
    assert cut.count() == kept.count() and cut.where("n_chars <> length(text)").isEmpty()
    assert P.drop_leaks(spark, cut, DATA).count() == cut.count()
    for _, stage in P.STAGES:
        assert stage(spark, rows.where("false"), DATA).count() == 0


def test_the_whole_pipeline_of_messy_rows(spark, tmp_path):
    import corpus_pipeline as P

    rows = texts() + [(400 + k, prose(500 + k, 40, 3000)) for k in range(60)]
    leak = prose(900, 30, 9000)
    rows += [(500, f"{prose(901, 20)} {leak} {prose(902, 20)}"), (501, f"{leak.upper()}"), (502, None), (None, "")]
    rows += [(600 + k, f"{prose(700 + k, 25, 3000)} vile{k % 3} filth muck vile{k % 3} filth muck") for k in range(40)]
    columns = "doc_id long, text string, lang string, source string, n_chars long, score double, row string"
    spark.createDataFrame([(i, t, "en", None, len(t or ""), 0.5, "r") for i, t in rows], columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(600 <= i < 700)) for i, _ in rows if i is not None and i >= 400] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, None), (None, "x y"), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = P.run(spark, str(tmp_path)).collect()
    kept = collections.Counter(r["doc_id"] for r in found)
    assert set(kept) >= {1, 5, 6, 7, 14, 502, None, *range(400, 460)} and not set(kept) & {2, 3, 4, 9, 500, 501, *range(600, 640)}
    assert kept[None] == 3 and all(r["same"] for r in found if r["n_ids"] is not None) and {r["doc_id"] for r in found if r["n_ids"] is None} == {5, 502, None}


def features_of(text):
    """(n-gram, level) by counting."""
    data = text.encode().lower()  # A-Z only
    times = collections.Counter(data[k : k + n] for n in toxicity.LENGTHS for k in range(len(data) - n + 1))
    return {(g, k) for g, n in times.items() for k, least in enumerate(toxicity.LEVELS) if n >= least}


def test_features_are_ngrams_by_how_often_they_occur():
    batch = ["abababab", "", None, "Größe größe GRÖSSE", prose(3, 40), "x" * 30]
    found = [set(s.tolist()) for s in toxicity.feature_sets(pa.array(batch))]
    want = [features_of(t or "") for t in batch]
    for got, expected in zip(found, want, strict=True):
        assert len(got) == len(expected)
    for text, got in zip(batch, found, strict=True):
        for other, also in zip(batch, found, strict=True):
            assert len(got & also) == len(features_of(text or "") & features_of(other or ""))


def test_the_features_chosen_and_their_ratios(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "CHOSEN", 40)
    monkeypatch.setattr(toxicity, "PART", 500)
    rows = [(n, prose(900 + n, 8, 60) + (" scumbag" if n % 3 == 0 else "")) for n in range(60)]
    marks = [(n, 1, int(n % 3 == 0)) for n, _ in rows]
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda x, y, ratio, prior, **_: (seen.setdefault(len(y), ratio), (np.ones(x.shape[1]), 0.0))[1])
    model = toxicity.learn(docs(spark, rows), labels(spark, marks))
    used = [(t, y) for (n, t), (_, _, y) in zip(rows, marks, strict=True) if zlib.crc32(str(n).encode()) % 5]
    count = {label: collections.Counter(f for t, y in used if y == label for f in features_of(t)) for label in (0, 1)}
    n1, n0 = sum(y for _, y in used), sum(1 - y for _, y in used)

    def tells(f):
        a, b = count[1][f], count[0][f]
        cells = ((a, a + b, n1), (b, a + b, n0), (n1 - a, n1 + n0 - a - b, n1), (n0 - b, n1 + n0 - a - b, n0))
        return sum(n * np.log(n * (n1 + n0) / (row * column)) for n, row, column in cells if n)

    both = {f: tells(f) for f in set(count[0]) | set(count[1]) if count[0][f] + count[1][f] >= toxicity.SUPPORT}
    least = sorted(both.values())[-40]
    known = np.concatenate(list(toxicity.feature_sets(pa.array([t for t, _ in used]))))
    assert len(model.chosen) == 40 and np.isin(model.chosen, known).all()
    ratio = sorted(round(float(np.log((count[1][f] + 1) * (n0 + 2) / ((count[0][f] + 1) * (n1 + 2)))), 9) for f, g in both.items() if g > least + 1e-6)
    got = sorted(round(float(r), 9) for r in seen[len(used)])
    assert not collections.Counter(ratio) - collections.Counter(got)


def test_scores_are_those_of_a_slow_sum():
    draw = np.random.default_rng(4)
    batch = [prose(n, 30, 40) for n in range(20)] + ["", None, "w1 " * 50]
    all_ = np.unique(np.concatenate(list(toxicity.feature_sets(pa.array(batch)))))
    chosen = np.sort(draw.choice(all_, 200, replace=False))
    model = toxicity.Linear(chosen, draw.normal(size=200), -0.3)
    want = [model.bias + model.weight[np.isin(chosen, own)].sum() for own in toxicity.feature_sets(pa.array(batch))]
    assert np.allclose(model.scores(pa.array(batch)), 1 / (1 + np.exp(-np.array(want))))


def test_the_cut_has_the_fewest_errors():
    draw = np.random.default_rng(5)
    for _ in range(50):
        margin, y = np.round(draw.normal(size=30), 1), (draw.random(30) < 0.3).astype(float)
        if 0 < y.sum() < 30:
            errors = lambda cut: ((margin >= cut) != (y == 1)).sum()  # noqa: E731, B023
            assert errors(toxicity.best_cut(margin, y)) == min(errors(m) for m in [*margin, 99])
    assert toxicity.best_cut(np.zeros(3), np.ones(3)) == 0.0


def test_the_model_does_not_depend_on_partitions(spark):
    rows = [(n, prose(300 + n, 30, 500) + (" scumbag" if n % 4 == 0 else "")) for n in range(120)]
    marks = labels(spark, [(n, 1, int(n % 4 == 0)) for n, _ in rows])
    one, other = (toxicity.learn(docs(spark, rows).repartition(k), marks) for k in (1, 7))
    assert np.array_equal(one.chosen, other.chosen) and np.allclose(one.weight, other.weight) and np.isclose(one.bias, other.bias)


def test_an_ngram_spread_thinly_over_the_sample_is_learned(spark):
    rows = [(n, f"{prose(700 + n, 12)} zzqqx" if n % 20 == 0 else prose(700 + n, 12)) for n in range(80)]
    marks = labels(spark, [(n, 1, int(n % 20 == 0)) for n, _ in rows])
    model = toxicity.learn(docs(spark, rows), marks)
    (word,) = toxicity.feature_sets(pa.array(["zzqqx"]))
    assert len(word) == 3 and np.isin(word, model.chosen).all()
