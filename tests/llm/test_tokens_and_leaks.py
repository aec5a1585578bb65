"""Token counts, the codec, decontamination and licences."""

import random
import re
import textwrap

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tests.llm.messy import docs, prose, texts
from tracelake.llm import decontaminate, license_texts, licenses, sentencepiece_codec, token_count
from tracelake.llm.queries import PIECES, RANKS


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece_codec.read_pieces(PIECES)


def greedy(word, vocabulary):
    left, count = b" " + word, 0
    while left:
        n = next((n for n in range(len(left), 0, -1) if left[:n] in vocabulary and (count == 0 or not left.startswith(b" "))), 0)
        if not n:
            return 1
        left, count = left[n:], count + 1
    return count


def test_counts_are_those_of_greedy_matching(spark):
    vocabulary = set(token_count.read_ranks(RANKS))
    found = {(r["doc_id"], r["n_words"], r["n_tokens"]) for r in token_count.token_counts(docs(spark, texts()), RANKS).collect()}
    split = [(i, (t or "").encode().split()) for i, t in texts()]
    assert found == {(i, len(w), sum(greedy(x, vocabulary) for x in w)) for i, w in split}
    assert token_count.token_counts(docs(spark, []), RANKS).count() == 0


def test_small_vocabularies_and_unknown_words():
    automaton = token_count.LongestMatch([b" a", b" ab", b"abc", b"bcd", b"b", b"c", b"d", b" abcdx"])
    vocabulary = {b" a", b" ab", b"abc", b"bcd", b"b", b"c", b"d", b" abcdx"}
    for word in (b"a", b"ab", b"abcd", b"abcdb", b"aabc", b"abcdy", b"z", b"abab"):
        assert automaton.count(word) == greedy(word, vocabulary), word


def viterbi(text, codec, pieces):
    known = {p: (k, s) for k, (p, s, kind) in enumerate(pieces) if kind == "piece"}
    best = [(0.0, [])] + [None] * len(text)
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + codec.longest) + 1):
            part = text[i:j]
            if part in known:
                step = (best[i][0] + known[part][1], best[i][1] + [known[part][0]])
            elif j == i + 1:
                step = (best[i][0] + codec.unknown, best[i][1] + [codec.bytes_ids[b] for b in part.encode()])
            else:
                continue
            if best[j] is None or step[0] >= best[j][0]:
                best[j] = step
    return best[-1][1]


def test_streaming_viterbi_is_exact(pieces):
    codec = sentencepiece_codec.Codec(pieces)
    for text in ("▁Hello▁world", "▁▁▁x", "▁日本語😀", prose(1, 90).replace(" ", "▁"), "▁" + "abcdefgh" * 60, "▁" + "a" * 700, "▁\n\t\x00"):
        assert codec.viterbi(text) == viterbi(text, codec, pieces), text[:20]
    codec.cut_at_spaces = False  # the whole text through the window gives what its segments give
    other = sentencepiece_codec.Codec(pieces)
    assert codec.encode(prose(2, 200), {}).tolist() == other.encode(prose(2, 200), {}).tolist()


def test_round_trips(spark, pieces):
    frame = docs(spark, [*texts(), (50, " leading"), (51, "▁"), (52, "a▁ ▁b"), (53, "\r\n x  y ")])
    rows = sentencepiece_codec.round_trips(frame, PIECES, keep_ids=True).collect()
    assert {r["same"] for r in rows if r["n_ids"] is not None} == {True} and sum(r["n_ids"] is None for r in rows) == 2
    assert [r["n_ids"] for r in rows if r["doc_id"] == 6] == [0] and all(len(r["ids"]) == r["n_ids"] for r in rows if r["ids"] is not None)
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(frame, PIECES), PIECES)
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in back.collect()) == sorted((r["doc_id"] or 0, r["text"] or "") for r in frame.collect())
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = sentencepiece_codec.Codec(pieces).encode("plain words here", {})
    assert model.decode(ids.tolist()) == "plain words here"
    assert sentencepiece_codec.round_trips(docs(spark, []), PIECES).count() == 0


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_leaks_are_found_in_any_order(spark):
    item = prose(30, 40, 10_000).split()
    half = item[20:] + item[:20]
    noisy = [w.upper() + "!" for w in item]
    rows = [(1, f"{prose(31, 30)} {' '.join(item)} {prose(32, 30)}"), (2, f"{prose(33, 9)} {' '.join(half)}"), (3, " ".join(noisy)), (4, " ".join(item[:20])), (5, prose(34, 60)), (6, None), (7, ""), (None, " ".join(item))]
    rows += [(8, " ".join(item)), (8, " ".join(item[:35])), (9, "short item")]
    found = decontaminate.tiled_pairs(docs(spark, rows), items(spark, [(1, " ".join(item)), (2, "Short, item"), (3, None), (4, "..."), (None, "x")]))
    got = {(r["doc_id"], r["item_id"]): (r["n_item"], r["n_covered"], r["n_tiles"]) for r in found.collect()}
    assert got == {(1, 1): (40, 40, 1), (2, 1): (40, 40, 2), (3, 1): (40, 40, 1), (8, 1): (40, 40, 1), (9, 2): (2, 2, 1)}
    assert decontaminate.tiled_pairs(docs(spark, []), items(spark, [(1, "a b c d e")])).count() == 0
    assert decontaminate.tiled_pairs(docs(spark, rows), items(spark, [])).count() == 0


def test_leaks_in_very_long_texts(spark):
    item = prose(35, 40, 10_000).split()
    long = f"{prose(36, 60_000, 50_000)} {' '.join(item[20:])} {prose(37, 60_000, 50_000)} {' '.join(item[:20])} {prose(38, 60_000, 50_000)}"
    found = decontaminate.tiled_pairs(docs(spark, [(1, long), (2, prose(39, 100_000, 50_000))]), items(spark, [(1, " ".join(item))]))
    assert [(r["doc_id"], r["item_id"], r["n_covered"], r["n_tiles"]) for r in found.collect()] == [(1, 1, 40, 2)]


def phrases(draw, count):
    """Texts of phrases, some of which are in most texts."""
    hot, rare = [prose(700 + n, 7, 10_000) for n in range(4)], [prose(800 + n, 9, 10_000) for n in range(40)]
    return [" ".join(draw.choice(hot if draw.random() < 0.6 else rare) for _ in range(draw.randint(1, 6))) for _ in range(count)]


@pytest.mark.parametrize("salt_rows", (1, 50_000))
def test_pairs_are_those_of_tiling_every_pair(spark, monkeypatch, salt_rows):
    monkeypatch.setattr(decontaminate, "SALT_ROWS", salt_rows)
    draw = random.Random(5)
    texts_, asked = phrases(draw, 300), [*phrases(draw, 40), prose(700, 7, 10_000), prose(701, 3, 10_000)]
    found = decontaminate.tiled_pairs(docs(spark, list(enumerate(texts_))), items(spark, [*enumerate(asked), (0, asked[0])]))
    got = {(r["doc_id"], r["item_id"]): (r["n_item"], r["n_covered"]) for r in found.collect()}
    hashes = lambda texts: [decontaminate.tokens(pa.array([t]))[0] for t in texts]
    want = {}
    for i, item in enumerate(hashes(asked)):
        for d, doc in enumerate(hashes(texts_)):
            covered = sum(t[2] for t in decontaminate.tiles(item, doc, min(5, len(item))))
            if 100 * covered >= 80 * len(item):
                want[(d, i)] = (len(item), covered)
    assert got == want and len(want) > 300


def test_hot_phrases_do_not_name_items(spark):
    hot, own = prose(900, 20, 10_000), [prose(910 + n, 20, 10_000) for n in range(30)]
    texts_ = [(n, f"{hot} {own[n] if n < 30 else prose(950 + n, 20, 10_000)}") for n in range(60)]
    asked = items(spark, [(n, f"{hot} {own[n]}") for n in range(30)])
    seeds = decontaminate.seeds_of(asked, "item_id", "text", 5)
    counts = seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("n_docs"))
    kept = decontaminate.telling_seeds(seeds.join(counts, "seed"), 80)
    assert kept.join(counts, "seed").where("n_docs > 1").count() == 0 and kept.select("item").distinct().count() == 30
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.tiled_pairs(docs(spark, texts_), asked).collect()} == {(n, n) for n in range(30)}


def slow_tiles(item, doc, shortest):
    used_i, used_d, covered = set(), set(), 0
    while True:
        best = max(((length, -i, -j) for i in range(len(item)) for j in range(len(doc)) if (length := run(item, doc, i, j, used_i, used_d)) >= shortest), default=None)
        if best is None:
            return covered
        length, i, j = best[0], -best[1], -best[2]
        used_i.update(range(i, i + length))
        used_d.update(range(j, j + length))
        covered += length


def run(item, doc, i, j, used_i, used_d):
    n = 0
    while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and i + n not in used_i and j + n not in used_d:
        n += 1
    return n


@pytest.mark.parametrize("seed", range(25))
def test_tiling_covers_what_the_slow_form_covers(seed):
    draw = np.random.default_rng(seed)
    item, doc = draw.integers(0, 4, 30).astype(np.uint64), draw.integers(0, 4, 60).astype(np.uint64)
    found = decontaminate.tiles(item, doc, 3)
    assert sum(t[2] for t in found) == slow_tiles(item.tolist(), doc.tolist(), 3)
    assert all(item[i : i + n].tolist() == doc[j : j + n].tolist() for i, j, n in found)


def test_licences(spark):
    header = "# Licensed under the Apache License, Version 2.0\n"
    rows = [
        (1, "a/b/code.py", header + prose(1, 50)), (2, "a/LICENSE", "Released under the MIT License."), (3, "a/b/c/x.py", prose(2, 30)), (4, "z/y.py", prose(3, 30)),
        (5, "a/b/none.py", None), (6, None, prose(4, 5)), (7, "a/b/c/GPL", "This work is licensed under the GNU General Public License, version 3."), (8, "q.py", "we license nothing of this kind, says the long line of text here"), (9, "a/b/c/x.py", ""),
    ]
    files = spark.createDataFrame([(i, p, t, "own", 1.0, "d") for i, p, t in rows], "doc_id long, file string, text string, origin string, cosine double, dir string")
    got = {r["doc_id"]: (r["license"], r["origin"], r["from_dir"]) for r in licenses.scan(files, F.col("file")).collect()}
    assert got == {
        1: ("Apache-2.0", "own", None), 2: ("MIT", "own", None), 3: ("GPL-3.0", "inherited", "a/b/c"), 4: (None, "none", None), 5: ("MIT", "inherited", "a"), 6: (None, "none", None),
        7: ("GPL-3.0", "own", None), 8: (None, "none", None), 9: ("GPL-3.0", "inherited", "a/b/c"),
    }
    assert licenses.scan(files.where("false"), F.col("file")).count() == 0


def test_licence_files_and_wrapped_headers(spark):
    mit = "MIT License\n\nCopyright (c) 2020 Some Body\n\n" + textwrap.fill(dict(license_texts.TEXTS)["MIT"].split("(c)")[1].strip(), 70)
    wrapped = "# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy of the MPL was not distributed with this\n# file, You can obtain one at http://mozilla.org/MPL/2.0/.\n"
    rows = [
        (1, "a/LICENSE", mit), (2, "a/x.py", prose(2, 300)), (3, "b/x.py", wrapped + prose(3, 300)), (4, "c/one.js", f"{prose(4, 300)} Licensed under the Apache License, Version 2.0 {prose(5, 300)}"),
        (5, "d/LICENSE", " ".join(mit.split())), (6, "d/y.py", prose(6, 20)), (7, "b/y.py", prose(7, 300)), (8, "e/GPL", dict(license_texts.TEXTS)["GPL-3.0"]), (9, "e/z.py", prose(8, 20)),
    ]
    files = spark.createDataFrame(rows, "doc_id long, file string, text string")
    got = {r["doc_id"]: (r["license"], r["origin"], r["from_dir"]) for r in licenses.scan(files, F.col("file")).collect()}
    assert got == {
        1: ("MIT", "own", None), 2: ("MIT", "inherited", "a"), 3: ("MPL-2.0", "own", None), 4: ("Apache-2.0", "own", None), 5: ("MIT", "own", None), 6: ("MIT", "inherited", "d"),
        7: (None, "none", None), 8: ("GPL-3.0", "own", None), 9: ("GPL-3.0", "inherited", "e"),
    }


def test_document_counts_are_over_all_files(spark):
    files = docs(spark, texts())
    total, counts = licenses.document_counts(files, "text", ["one", "two", "zzz"])
    assert (total, counts) == (len(texts()), {"one": 2, "two": 2, "zzz": 0})


NOTICES = [
    ("SPDX-License-Identifier: MPL-2.0", "MPL-2.0"),
    ("// SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"),
    ("# SPDX-License-Identifier: (mit OR Apache-2.0+)", "(MIT OR Apache-2.0)"),
    ("/* SPDX-License-Identifier: BSD-2-Clause */", "BSD-2-Clause"),
    ("SPDX-License-Identifier: Zlib", "Zlib"),
    ("SPDX-License-Identifier:", None),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", "AGPL-3.0"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version.", "GPL-2.0"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "GPL-3.0"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 4", None),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License version 2", None),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", "LGPL-2.1"),
    ("Licensed under the GNU Lesser General Public License, version 3", "LGPL-3.0"),
    ("Licensed under the Apache License, Version 1.1", "Apache-1.1"),
    ("Licensed under the Apache License, Version 1.0", None),
    ("Licensed under the Apache License, Version 2.0", "Apache-2.0"),
    ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
    ("Licensed under CC BY 3.0.", None),
    ("Licensed under CC BY-ND 4.0", "CC-BY-ND-4.0"),
    ("Licensed under CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided", "ISC"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ("Licensed under the BSD 2-Clause License", "BSD-2-Clause"),
    ("Licensed under the BSD 4-Clause License", None),
    ("Licensed under the Example License, version 7", None),
]


def test_notices_are_named_right_or_not_at_all(spark):
    rows = [(k, f"d{k}/x", text) for k, (text, _) in enumerate(NOTICES)] + [(1000 + k, f"p{k}/x", prose(k, 30)) for k in range(300)]
    files = spark.createDataFrame(rows, "doc_id long, file string, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.scan(files, F.col("file")).where("doc_id < 1000").collect()}
    assert [(text, got[k]) for k, (text, _) in enumerate(NOTICES)] == NOTICES


def test_full_texts_are_told_apart(spark):
    head = "Copyright (c) 2021 Some Body. All rights reserved.\n\n"
    rows = [(k, f"d{k}/LICENSE", head + textwrap.fill(text, 70)) for k, (_, text) in enumerate(licenses.TEXTS)]
    rows += [(100 + k, f"h{k}/x.c", f"{head}{textwrap.fill(dict(licenses.TEXTS)[name], 60)}\n{prose(k, 4000)}") for k, name in enumerate(("BSD-2-Clause", "BSD-3-Clause", "ISC"))]
    files = spark.createDataFrame(rows, "doc_id long, file string, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.scan(files, F.col("file")).collect()}
    assert [got[k] for k in range(len(licenses.TEXTS))] == [name for name, _ in licenses.TEXTS]
    assert [got[100 + k] for k in range(3)] == ["BSD-2-Clause", "BSD-3-Clause", "ISC"]


def slow_scan(rows, least=0.6, share=0.5):
    """Licences by plain loops over dictionaries."""
    bags = [licenses.terms(t or "") for _, _, t in rows]
    vocabulary = sorted({t for _, text in (*licenses.TEMPLATES, *licenses.TEXTS) for t in licenses.terms(text)})
    matcher = licenses.Matcher(len(rows), {t: sum(t in set(bag) for bag in bags) for t in vocabulary})
    full = [(name, matcher._vector(licenses.terms(text))) for name, text in licenses.TEXTS]

    def cosine(words, template):
        vector = matcher._vector(words)
        return round(sum(x * vector.get(t, 0.0) for t, x in template.items()), 9)

    def window(bag, cue):
        spans, marks = [], licenses.marks_of(bag)
        for (name, text), (_, template, facts) in zip(licenses.TEMPLATES, matcher.templates, strict=True):
            n = len(licenses.terms(text))
            at = [(max(0, start), min(start + n, len(bag))) for start in range(cue - n + 1, cue + 1)]
            best, a, b = min((-cosine(bag[a:b], template), a, b) for a, b in at)
            if facts.fit(marks, a, b):
                spans.append((best, name, a, b))
        return min(spans, default=(0.0, "", 0, 0))

    own = []
    for (_, _, text), bag in zip(rows, bags, strict=True):
        hits, at, tags = [], 0, []
        for line in re.split("(?<=[\n\r])", text or ""):
            words = licenses.terms(line)
            if set(words) & set(licenses.CUES):
                best, name = matcher.best(line)
                tags += [licenses.tagged(line)] if licenses.tagged(line) else []
                hits.append((best, name, at, at + len(words)) if not licenses.tagged(line) else (-1.0, licenses.tagged(line), at, at + len(words)))
            at += len(words)
        hits += [window(bag, k) for k, word in enumerate(bag) if word in licenses.CUES]
        good = [h for h in hits if -h[0] >= least]
        found, covered = min((h[:2] for h in good), default=(0.0, None)), {k for h in good for k in range(h[2], h[3])}
        is_file = bool(good) and len(covered) >= share * len(bag)
        if tags:
            found = -1.0, tags[0]
        elif set(bag) & set(licenses.CUES):
            whole = min((-cosine(bag, template), name) for name, template in full)
            if -whole[0] >= licenses.WHOLE:
                found, is_file = whole, True
        own.append((-found[0], found[1], is_file))
    by_dir = {}
    for (_, path, _), (cos, name, is_file) in zip(rows, own, strict=True):
        if is_file and path is not None:
            by_dir.setdefault(path.rpartition("/")[0], []).append((-cos, path, name))
    out = []
    for (i, path, _), (_, name, _) in zip(rows, own, strict=True):
        above = path.rpartition("/")[0] if path is not None else ""
        while name is None and path is not None and above and above not in by_dir:
            above = above.rpartition("/")[0]
        inherits = name is None and path is not None and above in by_dir
        out.append((i, path, min(by_dir[above])[2] if inherits else name, "own" if name else "inherited" if inherits else "none", above if inherits else None))
    return out


@pytest.mark.parametrize("broadcast", [licenses.BROADCAST, 0])
def test_licences_are_those_of_a_slow_scan(spark, monkeypatch, broadcast):
    monkeypatch.setattr(licenses, "BROADCAST", broadcast)
    draw, notices = random.Random(5), [text for _, text in licenses.TEMPLATES]
    rows = [(k, f"{draw.choice('abc')}/{draw.choice('xy')}/f{k}", prose(k, 40)) for k in range(30)]
    for k in range(30, 60):  # notices cut short, wrapped and put into prose
        words = draw.choice(notices).split()
        words = words[draw.randrange(3) :] if len(words) > 6 else words
        words[draw.randrange(len(words))] += draw.choice(["", "\n", "\n# "])
        rows.append((k, f"{draw.choice('abc')}/{draw.choice('xyz')}/f{k}", f"{prose(k, draw.randrange(20))} {' '.join(words)} {prose(k, draw.randrange(20))}"))
    rows += [(70, "d/LICENSE", notices[0]), (71, "d/COPYING", "Licensed under the MIT License"), (72, "d/e/f/x", prose(72, 9)), (73, "d/LICENSE-2", notices[0]), (74, "d/LICENSE-2", notices[0])]
    rows += [(75, "e/x", None), (76, None, notices[0]), (None, "e/y", ""), (72, "d/e/f/x", prose(72, 9)), (72, "d/e/f/x", prose(72, 9)), (77, "top", notices[5]), (78, "q/r/s/t", "no words of this kind")]
    rows += [(79, "long/a", prose(79, 20_000, 5_000) + " " + notices[2]), (80, "long/b", dict(license_texts.TEXTS)["MIT"] * 3), (81, "long/c/d", "x")]
    files = spark.createDataFrame([(i, p, t, 1, "s") for i, p, t in rows], "doc_id long, file string, text string, salt int, near string")
    got = [tuple(r) for r in licenses.scan(files, F.col("file")).select("doc_id", "path", "license", "origin", "from_dir").collect()]
    assert sorted(got, key=repr) == sorted(slow_scan(rows), key=repr)
