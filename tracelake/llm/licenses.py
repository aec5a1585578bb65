"""Licences of files: cosine of TF-IDF vectors to templates, and inheritance from the nearest directory above."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontaminate import _FOLD, tokens
from .license_texts import TEXTS as GIVEN
from .textarrays import slices, text_bytes, word_hashes, word_spans

# Usual wordings of licence notices, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("ISC", "Licensed under the ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License version 3"),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License version 2.1"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0"),
    ("EPL-2.0", "Licensed under the Eclipse Public License, version 2.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Unlicense", "Released under the Unlicense"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
)
# Words that tell licences apart wherever they stand in a notice, and words before the number of a version.
TELLING = frozenset(
    "affero agpl apache artistic boost bsd cc cc0 commons creative eclipse gnu gpl isc lesser lgpl library mit mozilla mpl nc nd noderivatives noderivs noncommercial sa sharealike unencumbered unlicense zlib".split()
)
LEADS = frozenset("attribution bsd by cc0 gpl licence license lgpl mpl nc nd noderivatives noncommercial sa sharealike v version".split())
#: A version may follow this many terms after the part of a notice that is like a template.
AHEAD = 16
#: Two conditions of the BSD licences, the second one only of the longer, and how many terms after their first sentence they may be.
CONDITIONS, REACH = ("reproduce", "endorse"), 250
#: A tag, and the expression of identifiers after it.
TAG = re.compile(r"SPDX-License-Identifier:[ \t]*(\(*[A-Za-z0-9][A-Za-z0-9.+-]*\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*[A-Za-z0-9][A-Za-z0-9.+-]*\)*)*)", re.IGNORECASE)
#: Full texts; the Affero licence's is that of the GPL under its own name.
TEXTS = (*GIVEN, ("AGPL-3.0", dict(GIVEN)["GPL-3.0"].replace("GNU General Public License", "GNU Affero General Public License")))
#: A whole text this close to a full licence text is a licence file.
WHOLE = 0.85
#: The most bytes of inherited licences that are broadcast; how many copies of each there are beyond that.
BROADCAST, SALTS = 8 << 20, 16
#: What is near one of these tokens is compared.
CUES = ("license", "licensed", "licence", "licenced", "spdx", "permission", "redistribution", "cc0", "copyright", "unencumbered", "unlicense")


def terms(text: str) -> list[str]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters, as tokens() cuts them."""
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.translate({c: c + 32 for c in range(65, 91)}))


def document_counts(files: DataFrame, text_col: str, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """How many files there are, and in how many of them each term of a fixed vocabulary occurs."""
    wanted = _hashes(vocabulary)
    order = np.argsort(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, counts = 0, np.zeros(len(vocabulary), dtype=np.int64)
        for batch in batches:
            total += batch.num_rows
            for low, high in slices(batch["body"]):
                hashes, first = tokens(batch["body"].slice(low, high - low))
                at, k = _find(hashes, wanted, order)
                text = np.searchsorted(first, at, side="right") - 1
                counts += np.bincount(np.unique(text * len(vocabulary) + k) % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(vocabulary), dtype=np.int32)), pa.array(np.append(total, counts))], names=["term", "n"])

    rows = files.select(F.col(f"`{text_col}`").alias("body")).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # one row a term
    counts = {x["term"]: x["n"] for x in rows}
    return counts.get(-1, 0), {t: counts.get(k, 0) for k, t in enumerate(vocabulary)}


def _hashes(words: list[str]) -> np.ndarray:
    return tokens(pa.array(words, pa.string()))[0]


def _find(hashes: np.ndarray, wanted: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of wanted hashes, and which they are."""
    lead = np.zeros(1 << 16, dtype=bool)
    lead[(wanted >> np.uint64(48)).astype(np.int64)] = True
    at = np.flatnonzero(lead[(hashes >> np.uint64(48)).astype(np.int64)])
    place = np.minimum(np.searchsorted(wanted[order], hashes[at]), len(wanted) - 1)
    hit = wanted[order][place] == hashes[at]
    return at[hit], order[place[hit]]


def tagged(line: str) -> str | None:
    """The identifier or expression of an SPDX tag, as it is but for "-only", "-or-later" and "+", which this scan doesn't tell apart."""
    found = TAG.search(line)
    if not found:
        return None
    names = {name.lower(): name for name, _ in TEMPLATES}
    plain = lambda m: names.get(x.lower(), x) if (x := re.sub(r"(-only|-or-later|\+)$", "", m[0], flags=re.IGNORECASE)) else m[0]
    return re.sub(r"[A-Za-z0-9][A-Za-z0-9.+-]*", plain, " ".join(found[1].split()))


def marks_of(words: list[str]) -> list[str | None]:
    """Of each term, itself if it tells licences apart or is about versions; "library" only tells in "GNU Library"."""
    plain = [w[1:] if len(w) == 2 and w[0] == "v" and w[1].isdigit() else w for w in words]
    return [w if w in MARKS and (w != "library" or k and plain[k - 1] == "gnu") else None for k, w in enumerate(plain)]


MARKS = TELLING | LEADS | {"clause", *"0123456789"}


class Facts(NamedTuple):
    """What a notice must say to be one of a licence."""

    words: frozenset[str]
    version: tuple[str, str] | None

    @staticmethod
    def of(marks: list[str | None]) -> Facts:
        return Facts(frozenset(m for m in marks if m in TELLING), version_of(marks))

    def fit(self, marks: list[str | None], a: int, b: int) -> bool:
        """Whether terms a to b have no other telling words, and with those after them the same ones and the same version."""
        own, ahead = {m for m in marks[a:b] if m in TELLING}, marks[a : b + AHEAD]
        return own <= self.words <= set(ahead) and (self.version is None or version_of(ahead) == self.version)


def version_of(marks: list[str | None]) -> tuple[str, str] | None:
    """The first version: a digit after a leading word or before "clause", and the digit after it (0 if none)."""
    digit = lambda k: k < len(marks) and (marks[k] or " ").isdigit()
    for k, mark in enumerate(marks):
        if digit(k) and (k and marks[k - 1] in LEADS or marks[k + 1 : k + 2] == ["clause"]):
            return mark, marks[k + 1] if digit(k + 1) else "0"
    return None


class Matcher:
    """Cosines of a line's TF-IDF vector to the templates'; a term outside the templates counts as one that no file has."""

    def __init__(self, files: int, counts: dict[str, int], templates=TEMPLATES):
        self.weight = {t: math.log((1 + files) / (1 + n)) + 1 for t, n in counts.items()}
        self.rare = math.log(1 + files) + 1
        self.templates = [(name, self._vector(terms(text)), Facts.of(marks_of(terms(text)))) for name, text in templates]

    def _vector(self, words: list[str]) -> dict[str, float]:
        vector = {t: n * self.weight.get(t, self.rare) for t, n in Counter(words).items()}
        length = math.sqrt(sum(x * x for x in vector.values())) or 1.0
        return {t: x / length for t, x in vector.items()}

    def best(self, line: str) -> tuple[float, str]:
        """The highest cosine (negative) to a template that the line doesn't contradict, and the licence; ties go to the first name in alphabetical order."""
        words = terms(line)
        vector, marks = self._vector(words), marks_of(words)
        cosines = [(-round(sum(x * vector.get(t, 0.0) for t, x in template.items()), 9), name) for name, template, facts in self.templates if facts.fit(marks, 0, len(marks))]
        return min(cosines, default=(0.0, ""))


class Windows:
    """The same cosines for windows of tokens, given as hashes, and for whole texts."""

    def __init__(self, matcher: Matcher, templates=TEMPLATES, full=TEXTS):
        known = sorted(matcher.weight)
        hashes = _hashes(known)
        order = np.argsort(hashes)
        self.rare, self.hashes = matcher.rare, hashes[order]
        self.weight = np.array([matcher.weight[known[k]] for k in order])
        self.names, self.lengths = [name for name, _ in templates], np.array([len(terms(text)) for _, text in templates])
        vectors, self.facts = [vector for _, vector, _ in matcher.templates], [facts for *_, facts in matcher.templates]
        # a last column stands for all other terms
        self.templates = np.array([[vector.get(known[k], 0.0) for k in order] + [0.0] for vector in vectors])
        self.full_names = [name for name, _ in full]
        self.full = np.array([[v.get(known[k], 0.0) for k in order] + [0.0] for v in (matcher._vector(terms(text)) for _, text in full)])
        self.longest = int(self.lengths.max())
        marks = sorted({*MARKS, *[f"v{n}" for n in range(10)]})
        self.marks = dict(zip(_hashes(marks).tolist(), marks, strict=True))

    def _terms(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's column and weight."""
        place = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        hit = self.hashes[place] == own
        return np.where(hit, place, len(self.hashes)), np.where(hit, self.weight[place], self.rare)

    def reach(self, cue: int, size: int) -> tuple[int, int]:
        """The terms that windows around a cue, and what follows them, may hold."""
        return max(0, cue - self.longest), min(size, cue + self.longest + AHEAD)

    def around(self, own: np.ndarray, cue: int, least: float) -> tuple[float, str, int, int] | None:
        """The highest cosine of a window of as many tokens as the template has (fewer only at the text's ends) that holds the cue and contradicts nothing;
        the licence; the window. None if no cosine reaches ``least``."""
        column, weight = self._terms(own)
        # the terms of a template that are there at all bound its cosine
        hopeful = np.flatnonzero(np.sqrt((self.templates[:, np.unique(column)] ** 2).sum(axis=1)) >= least - 1e-6)
        if not len(hopeful):
            return None
        size, at = len(own), cue
        squares = np.zeros((size + 1, size + 1))
        squares[1:, 1:] = ((own[:, None] == own[None, :]) * weight[:, None] * weight[None, :]).cumsum(axis=0).cumsum(axis=1)
        dots = np.zeros((len(hopeful), size + 1))
        dots[:, 1:] = np.cumsum(self.templates[hopeful][:, column] * weight, axis=1)
        found, marks = [], marks_of([self.marks.get(h, "") for h in own.tolist()])
        for row, t in enumerate(hopeful.tolist()):
            length = int(self.lengths[t])
            starts = np.arange(at - length + 1, at + 1)
            a, b = np.maximum(starts, 0), np.minimum(starts + length, size)
            norm = np.sqrt(squares[b, b] - squares[a, b] - squares[b, a] + squares[a, a])
            cosine = np.round((dots[row, b] - dots[row, a]) / np.maximum(norm, 1e-12), 9)
            k = int(np.argmax(cosine))
            if cosine[k] >= least and self.facts[t].fit(marks, int(a[k]), int(b[k])):
                found.append((-float(cosine[k]), self.names[t], int(a[k]), int(b[k])))
        if not found:
            return None
        cosine, name, a, b = min(found)
        return -cosine, name, a, b

    def whole(self, own: np.ndarray) -> tuple[float, str]:
        """The highest cosine of the whole text to a full licence text, and the licence."""
        distinct, n = np.unique(own, return_counts=True)
        column, weight = self._terms(distinct)
        vector = n * weight
        cosines = np.round(self.full[:, column] @ vector / max(float(np.sqrt((vector**2).sum())), 1e-12), 9).tolist()
        cosine, name = min((-c, name) for c, name in zip(cosines, self.full_names, strict=True))
        return -cosine, name


def scan(files: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", least: float = 0.6, share: float = 0.5) -> DataFrame:
    """The licence of each file: its own, or that of the nearest directory above which has one.

    An SPDX tag is taken as it is; of several, the first. Else, around each cue word of a whole text, its line and all windows of consecutive tokens as long as a template, across line breaks, are compared with the
    templates, by the cosine of sparse TF-IDF vectors whose document counts come from all files. What contradicts a licence's name, its qualifiers or its version is no notice of it, however near.
    The best of them (of equal ones the first by the licence's name) gives the file its own licence if its cosine
    reaches ``least``. The sentence that the BSD licences share is one of BSD-2-Clause if of the later conditions only the second follows, else of BSD-3-Clause. A text with a cue word is also compared as a whole with the full licence texts; from a cosine of WHOLE on it has that licence and is a
    licence file. So is a file in which matching lines and windows hold ``share`` of its tokens or more. A licence file's
    licence is its directory's (of several, the one with the highest cosine, then the smallest path). A
    file without a licence of its own inherits by a join of its directories, from the deepest up, with those that have one.

    A text of any length is compared as a whole, in one task.

    One row per input row: ``doc_id``, ``path``, ``license`` (null if none), ``origin`` ("own", "inherited" or "none"), ``cosine`` (of the own line, else null),
    ``from_dir`` (of an inherited licence). Null or empty texts have no licence of their own; a file with a null path inherits nothing. A null id stays null. Rows that
    repeat are answered each. An empty table gives no rows. Other columns are ignored.
    """
    vocabulary = sorted({t for _, text in (*TEMPLATES, *TEXTS) for t in terms(text)})
    whole = files.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), path.alias("path"), F.col(f"`{text_col}`").alias("body"))
    total, counts = document_counts(files, text_col, vocabulary)
    cues, conditions = _hashes(list(CUES)), _hashes(list(CONDITIONS))
    cue_order = np.argsort(cues)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, known = Matcher(total, counts), {}
        windows, near = Windows(matcher), {}
        for batch in batches:
            for low, high in slices(batch["body"]):
                part = batch.slice(low, high - low)
                data, at = text_bytes(part["body"])
                starts, ends, first = word_spans(_FOLD[data], at)
                hashes = word_hashes(_FOLD[data], starts, ends)
                place = np.sort(_find(hashes, cues, cue_order)[0])
                breaks = np.unique(np.concatenate([np.flatnonzero((data == 10) | (data == 13)) + 1, at]))
                rows = np.searchsorted(first, place, side="right") - 1
                names, cosines, is_file = [None] * len(part), [0.0] * len(part), [False] * len(part)
                for row in np.unique(rows).tolist():
                    begin, end = int(first[row]), int(first[row + 1])
                    own, inside = hashes[begin:end], np.zeros(end - begin, dtype=bool)
                    mine = place[rows == row]
                    hits, tag = [], None
                    for k in np.unique(np.searchsorted(breaks, starts[mine], side="right")).tolist():
                        a, b = int(breaks[k - 1]), int(breaks[k]) if k < len(breaks) else len(data)
                        line = data[a:b].tobytes().decode("utf-8", errors="replace")
                        if line not in known:
                            if len(known) > 100_000:
                                known.clear()
                            known[line] = (*matcher.best(line), tagged(line))
                        cosine, name, says = known[line]
                        hits.append((-cosine if says is None else 1.0, says or name, int(np.searchsorted(starts, a)) - begin, int(np.searchsorted(starts, b)) - begin))
                        tag = tag or says
                    for cue in (mine - begin).tolist():
                        low_, high_ = windows.reach(cue, len(own))
                        key = (cue - low_, own[low_:high_].tobytes())
                        if key not in near:
                            if len(near) > 20_000:
                                near.clear()
                            near[key] = windows.around(own[low_:high_], cue - low_, least)
                        if near[key] is not None:
                            cosine, name, a, b = near[key]
                            hits.append((cosine, name, low_ + a, low_ + b))
                    for cosine, name, a, b in hits:
                        if cosine >= least:
                            if name == "BSD-3-Clause" and np.isin(conditions, own[b : b + REACH]).tolist() == [True, False]:
                                name = "BSD-2-Clause"
                            inside[a:b] = True
                            if (-cosine, name) < (-cosines[row], names[row] or ""):
                                cosines[row], names[row] = cosine, name
                    is_file[row] = bool(inside.sum() >= share * len(own)) if names[row] else False
                    cosine, name = windows.whole(own) if tag is None else (0.0, "")
                    if tag is not None:
                        cosines[row], names[row] = 1.0, tag
                    elif cosine >= WHOLE:
                        cosines[row], names[row], is_file[row] = cosine, name, True
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["path"], pa.array(names, pa.string()), pa.array([c if n else None for c, n in zip(cosines, names, strict=True)], pa.float64()), pa.array(is_file)],
                    names=["doc_id", "path", "own", "cosine", "is_file"],
                )

    own = whole.mapInArrow(match, "doc_id long, path string, own string, cosine double, is_file boolean")
    own = own.withColumn("dir", F.regexp_extract("path", "^(.*)/[^/]*$", 1)).checkpoint()
    by_dir = own.where("is_file and path is not null").groupBy("dir").agg(F.min_by("own", F.struct(-F.col("cosine"), "path", "own")).alias("license"))
    dirs = own.where("own is null and path is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("up")).distinct()
    nearest = above.join(by_dir.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by(F.struct("license", "up"), F.length("up")).alias("near")).checkpoint()
    found = with_nearest(own, nearest)
    inherited = F.col("own").isNull() & F.col("path").isNotNull() & F.col("near").isNotNull()
    origin = F.when(F.col("own").isNotNull(), "own").when(inherited, "inherited").otherwise("none")
    return found.select("doc_id", "path", F.coalesce("own", F.when(inherited, F.col("near.license"))).alias("license"), origin.alias("origin"), "cosine", F.when(inherited, F.col("near.up")).alias("from_dir"))


def with_nearest(own: DataFrame, nearest: DataFrame) -> DataFrame:
    """Files with what their directory inherits. A directory may hold most of the files, so they aren't dealt by it alone.

    ``nearest``, whose size is measured, is broadcast up to BROADCAST bytes. Beyond that each directory's row is repeated SALTS times, and its files are dealt
    over the copies.
    """
    size = nearest.agg(F.sum(F.octet_length("dir") + F.octet_length("near.up") + F.octet_length("near.license") + 100)).first()[0] or 0
    if size <= BROADCAST:
        return own.join(F.broadcast(nearest), "dir", "left")
    salts = nearest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return own.withColumn("salt", F.pmod(F.xxhash64("doc_id", "path"), F.lit(SALTS)).cast("int")).join(salts, ["dir", "salt"], "left").drop("salt")
