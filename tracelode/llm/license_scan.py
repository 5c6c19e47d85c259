"""License scans: rolling word k-grams meet template positions, votes by diagonal, neighbouring diagonals merged, spans verified."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import release, stored
from .textops import LOWER, batches, flat, mix, owners, rolling, span_hash, spans

#: What is no letter, digit or byte of a wider character stands between words.
APART = np.ones(256, bool)
APART[48:58] = APART[65:91] = APART[97:123] = APART[128:] = False
#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Wordings of public licenses and of the notices that name them, by label. Notices of one label may be several.
TEMPLATES: list[tuple[str, str]] = [
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
]

GRAM = 3
SHIFT = 3  # words put in or left out that neighbouring diagonals may differ by
GAP = 12  # words of a template that may be missing between two votes of one span
LEAST = 0.8  # share of a span's words, in the text and in the template, that must be equal
LONG = 20  # equal words that are enough of a long template
MOST_GRAMS = 1 << 20  # of all templates, that are broadcast; beyond, they are joined by a shuffle
_BITS = 1 << 23


def _words(text: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, starts and ends of words, each text's first word, and the words' hashes."""
    data, at = flat(text)
    low = LOWER[data]
    starts, ends, first = spans(APART[data], at)
    return low.tobytes(), starts, ends, first, span_hash(low, starts, ends)


def template_words(templates: list[tuple[str, str]]) -> list[list[bytes]]:
    raw, starts, ends, first, _ = _words(pa.array([t for _, t in templates], pa.string()))
    each = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
    return [each[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def _grams(text: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, word) of all k words in a row."""
    _, _, _, first, h = _words(text)
    whose = owners(first, len(h))
    begin = np.flatnonzero(first[1:][whose] - np.arange(len(h)) >= k) if len(h) else np.zeros(0, np.int64)
    return rolling(h, k)[begin], whose[begin], begin - first[whose[begin]]


def template_positions(spark: SparkSession, templates: list[tuple[str, str]], k: int) -> tuple[DataFrame, np.ndarray]:
    """(gram, template, tpos) of all templates, and their distinct hashes."""
    gram, t, pos = _grams(pa.array([x for _, x in templates], pa.string()), k)
    rows = list(zip(gram.view(np.int64).tolist(), t.tolist(), pos.tolist()))
    return spark.createDataFrame(rows, "gram long, template int, tpos int"), np.unique(gram)


def _bitmap(gram: np.ndarray) -> np.ndarray:
    bits = np.zeros(_BITS, bool)
    bits[(gram >> np.uint64(41)).astype(np.int64)] = True
    return bits


_SCAN = "kind int, rid binary, doc_id long, n_words long, n_base long, first_word long, last_word long, base string, island int, pos int, gram long, words string"


def _scan(known: np.ndarray, phrases: dict[str, str], k: int):
    """Kind 0: a row of its own for each document, with what the phrases give. Kind 1: a gram that the templates may hold. Kind 2: the words about such grams."""
    labels = sorted(set(phrases.values()))
    listed = template_words([("", p) for p in phrases])

    def phrase_places(raw: bytes, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, number of the label) of each place of a phrase; hashes first, then the words themselves."""
        left = first[1:][owners(first, len(h))] - np.arange(len(h)) if len(h) else np.zeros(0, np.int64)
        at, label = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for words, name in zip(listed, phrases.values()):
            low = np.frombuffer(b" ".join(words), np.uint8)
            s, e, _ = spans(APART[low], np.array([0, len(low)]))
            want = span_hash(low, s, e)
            found = np.flatnonzero((h == want[0]) & (left >= len(words)))
            for i in range(1, len(words)):
                found = found[h[found + i] == want[i]]
            same = [x for x in found.tolist() if all(raw[starts[x + i] : ends[x + i]] == w for i, w in enumerate(words))]
            at.append(np.array(same, np.int64))
            label.append(np.full(len(same), labels.index(name)))
        return np.concatenate(at), np.concatenate(label)

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        bits = _bitmap(known)
        for part in batches(parts):
            text = part.column("text")
            raw, starts, ends, first, h = _words(text)
            at, label = phrase_places(raw, starts, ends, first, h)
            whose = owners(first, len(h))
            n = len(text)
            lo, hi = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            np.minimum.at(lo, whose[at], at - first[whose[at]])
            np.maximum.at(hi, whose[at], at - first[whose[at]])
            n_base = np.bincount(whose[at], minlength=n)
            base: list[set[str]] = [set() for _ in range(n)]
            for i, x in zip(whose[at].tolist(), label.tolist()):
                base[i].add(labels[x])
            rid = [hashlib.blake2b(repr(i).encode() + b"\0" + t.encode(), digest_size=16).digest() for i, t in zip(part.column("doc_id").to_pylist(), text.to_pylist())]
            none = lambda m, kind: pa.nulls(m, kind)
            yield pa.record_batch(
                [pa.array(np.zeros(n, np.int32)), pa.array(rid, pa.binary()), part.column("doc_id"), pa.array(np.diff(first)), pa.array(n_base), pa.array(lo, mask=hi < 0), pa.array(hi, mask=hi < 0), pa.array([",".join(sorted(b)) for b in base], pa.string()), none(n, pa.int32()), none(n, pa.int32()), none(n, pa.int64()), none(n, pa.string())],
                names=[x.split()[0] for x in _SCAN.split(", ")],
            )
            begin = np.flatnonzero(first[1:][whose] - np.arange(len(h)) >= k) if len(h) else np.zeros(0, np.int64)
            gram = rolling(h, k)[begin]
            hit = bits[(gram >> np.uint64(41)).astype(np.int64)]  # most grams stand in no template: a filter at the scan, and the join decides
            gram, begin = gram[hit], begin[hit]
            if not len(begin):
                continue
            doc = whose[begin]
            new = np.concatenate([[True], (np.diff(begin) > GAP + k) | (np.diff(doc) > 0)])
            island = begin[new][np.cumsum(new) - 1]
            end = np.append(begin[np.flatnonzero(new)[1:] - 1], begin[-1])
            end = np.minimum(end + k, first[1:][doc[new]])
            words = [b" ".join(raw[starts[x] : ends[x]] for x in range(a, b)).decode() for a, b in zip(begin[new].tolist(), end.tolist())]
            m, names = len(begin), [x.split()[0] for x in _SCAN.split(", ")]

            def rows(kind: int, at_doc: np.ndarray, where: np.ndarray, extra: tuple) -> pa.RecordBatch:
                size = len(at_doc)
                long = [none(size, pa.int64()) for _ in range(5)]
                return pa.record_batch([pa.array(np.full(size, kind, np.int32)), pa.array([rid[i] for i in at_doc.tolist()], pa.binary()), *long, none(size, pa.string()), pa.array((where - first[at_doc]).astype(np.int32)), *extra], names=names)

            yield rows(1, doc, island, (pa.array((begin - first[doc]).astype(np.int32)), pa.array(gram.view(np.int64)), none(m, pa.string())))
            yield rows(2, doc[new], begin[new], (none(len(words), pa.int32()), none(len(words), pa.int64()), pa.array(words, pa.string())))

    return scan


def merged(diagonals: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Rows (diagonal, first and last template word with a vote) of one island and template, as chains: those whose diagonals differ by SHIFT at most and that are GAP template words apart at most."""
    chains: list[list[tuple[int, int, int]]] = []
    for row in sorted(diagonals, key=lambda x: (x[1], x[2], x[0])):
        for chain in chains:
            if any(abs(row[0] - d) <= SHIFT for d, _, _ in chain) and row[1] - max(b for _, _, b in chain) <= GAP:
                chain.append(row)
                break
        else:
            chains.append([row])
    return chains


def verified(words: list[str], template: list[str], chain: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """(equal words, words of the text, words of the template) of a chain's span, word by word; words are those of an island and diagonals are relative to it."""
    pairs = set()
    lo, hi = min(x[1] for x in chain), max(x[2] for x in chain) + GRAM
    for d, _, _ in chain:
        for t in range(max(0, lo - SHIFT), min(len(template), hi + SHIFT)):
            if 0 <= t + d < len(words) and words[t + d] == template[t]:
                pairs.add((t, t + d))
    # one to one and in order: the longest increasing run of text words over template words
    tails: list[int] = []
    back: dict[tuple[int, int], tuple[int, int] | None] = {}
    ends: list[tuple[int, int]] = []
    for t, w in sorted(pairs, key=lambda x: (x[0], -x[1])):
        at = int(np.searchsorted(tails, w))
        back[t, w] = ends[at - 1] if at else None
        if at == len(tails):
            tails.append(w)
            ends.append((t, w))
        else:
            tails[at], ends[at] = w, (t, w)
    if not ends:
        return 0, 0, 0
    last = ends[-1]
    first = last
    while back[first] is not None:
        first = back[first]
    return len(ends), last[1] - first[1] + 1, last[0] - first[0] + 1


def _verify(templates: list[tuple[str, str]]):
    listed = [[w.decode() for w in t] for t in template_words(templates)]

    def verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by text, island and template, the island's words first."""
        now: tuple | None = None
        words: list[str] = []
        held: list[tuple[int, int, int]] = []
        out: list[tuple[bytes, str, float]] = []

        def judge() -> None:
            if now is None or now[2] < 0:
                return
            template = listed[now[2]]
            for chain in merged(held):
                same, own, other = verified(words, template, chain)
                if same >= LEAST * max(own, other) and same >= min(LEAST * len(template), LONG):
                    out.append((now[0], templates[now[2]][0], same / len(template)))

        for part in parts:
            for rid, island, template, diagonal, lo, hi, text in zip(*(part.column(c).to_pylist() for c in ("rid", "island", "template", "diagonal", "lo", "hi", "words"))):
                if (rid, island, template) != now:
                    judge()
                    now, held = (rid, island, template), []
                if template < 0:
                    words = text.split(" ")
                else:
                    held.append((diagonal - island, lo, hi))
            if len(out) > 10_000:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.string(), pa.float64()))], names=["rid", "label", "share"])
                out = []
        judge()
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.string(), pa.float64()))], names=["rid", "label", "share"])

    return verify


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, broadcast_up_to: int = MOST_GRAMS) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A text is lower-cased (A-Z) and cut into words of letters, digits and wider characters. Phrases give the base columns.
    For the method every GRAM words in a row are hashed; a bitmap of the templates' hashes rules most of them out where they are read, and Spark
    joins the rest to the positions of templates that hold them. Votes are summed by text, island (grams less than GAP words apart), template and diagonal
    (word less template word); diagonals that differ by SHIFT at most are merged, and the words of such a span are held against the template's, in order.
    A span counts if LEAST of its words, in the text and in the template, are equal, and if those are LEAST of the template or LONG words.
    labels are those of such spans and of the phrases. score: the largest share of a template that a span holds, at least 0.5 if a phrase stands
    there, 0 without either.

    Templates are a parameter; their positions are broadcast up to `broadcast_up_to` of them, and joined by a shuffle beyond.
    Only rows about matching grams leave the scan with their words. Equal rows (doc_id and text) are worked out once and all returned.
    Null texts are empty: no words, no labels ("" for both), score 0. Rows without a doc_id are scanned like others. No rows: no rows. Other columns are ignored.
    """
    positions, known = template_positions(docs.sparkSession, templates, GRAM)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(plain.mapInArrow(_scan(known, phrases, GRAM), _SCAN), "license-scan")
    grams = rows.where("kind = 1").select("rid", "island", "pos", "gram")
    met = grams.join(F.broadcast(positions) if len(known) <= broadcast_up_to else positions, "gram")
    votes = met.groupBy("rid", "island", "template", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.min("tpos").alias("lo"), F.max("tpos").alias("hi"))
    none = F.lit(None)
    voted = votes.select("rid", "island", "template", "diagonal", "lo", "hi", none.cast("string").alias("words"))
    islands = rows.where("kind = 2").select("rid", "island", F.lit(-1).alias("template"), none.cast("int").alias("diagonal"), none.cast("int").alias("lo"), none.cast("int").alias("hi"), "words").dropDuplicates(["rid", "island"])
    both = voted.unionByName(islands).repartition("rid").sortWithinPartitions("rid", "island", "template", "diagonal")
    spans_ = both.mapInArrow(_verify(templates), "rid binary, label string, share double")
    found = stored(spans_.groupBy(F.col("rid").alias("rid1")).agg(F.collect_set("label").alias("more"), F.max("share").alias("share")), "license-labels")
    base = F.filter(F.split("base", ","), lambda x: x != "")
    out = rows.where("kind = 0").join(found, F.col("rid") == F.col("rid1"), "left")
    labels = F.array_sort(F.array_union(base, F.coalesce("more", F.array().cast("array<string>"))))
    score = F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.col("base").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
