"""License scans, in DataFrame functions only on the main path.

A sparse word n-gram logistic regression, trained here on statements made from TEMPLATES, tells the licence family of a
paragraph; an `unknown` class, calibrated by temperature on statements kept aside, takes what is none, and a comparison of
word pairs in their order with the family's templates confirms a prediction.

Paragraphs are blocks between blank lines, however many lines they have. Their words are letters and digits (so hyphens split
identifiers, and 2.0 is a word), and ends of sentences are words too. Paragraphs longer than WINDOW words are read in
overlapping windows. What holds none of the SIGNALS is no candidate: a regular expression passes over such documents and
paragraphs, and every template has one. Features are all n-grams of a candidate, with signals or without.

Unknown is trained on near misses: denied licences, other licences, parts of templates that go on otherwise, and ordinary sentences
with the words of licences.

The model is a constant of the plan: n-grams are looked up by a hash in slots, compared by all its 64 bits, and the rows of
weights that they name are added. Documents stay where they are: no shuffle, nothing to gather.

Result: for each candidate paragraph a row for each family found in its windows, from the window of the highest probability, or one row
of unknown. Null and empty texts have none; a null doc_id is kept as it is. Repeated rows are scanned each for itself.
Empty tables give empty tables. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import random
from functools import lru_cache

import numpy as np
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: family -> statements and sentences of its notices and texts, at most WINDOW // 2 words each.
TEMPLATES = {
    "Apache-2.0": [
        "licensed under the apache license, version 2.0.", "you may not use this file except in compliance with the license. you may obtain a copy of the license at http www.apache.org licenses license 2.0",
        "distributed under the terms of the apache license 2.0.", "released under the apache 2.0 license.", "spdx license identifier: apache 2.0.",
        "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, without warranties or conditions of any kind, either express or implied.",
    ],
    "MIT": [
        "released under the mit license.", "this software is licensed under the mit license.", "licensed under mit.", "spdx license identifier: mit.",
        "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the software), to deal in the software without restriction",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software.",
        "the software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "provided as is, without warranty of any kind.",
        "in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise",
    ],
    "BSD": [
        "licensed under the bsd license.", "released under the 3 clause bsd license.", "distributed under the bsd 2 clause license.", "spdx license identifier: bsd 3 clause.",
        "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution.",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
    ],
    "ISC": ["licensed under the isc license.", "spdx license identifier: isc.", "permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "GPL-2.0": ["licensed under the gnu general public license, version 2.", "under the terms of the gnu general public license version 2 only.", "licensed under the gpl v2.", "licensed under the gplv2.", "spdx license identifier: gpl 2.0 only.", "spdx license identifier: gpl 2.0 or later."],
    "GPL-3.0": [
        "this work is licensed under the gnu general public license, version 3.", "licensed under the gpl version 3 or later.", "licensed under the gplv3.", "spdx license identifier: gpl 3.0 or later.", "spdx license identifier: gpl 3.0 only.",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or at your option any later version.",
        "you should have received a copy of the gnu general public license along with this program.",
    ],
    "LGPL": ["licensed under the gnu lesser general public license.", "under the terms of the gnu lesser general public license version 2.1.", "licensed under the lgpl.", "spdx license identifier: lgpl 2.1 or later.", "this library is free software and you can redistribute it and or modify it under the terms of the gnu lesser general public license"],
    "AGPL": ["licensed under the gnu affero general public license.", "under the terms of the gnu affero general public license version 3.", "licensed under the agpl.", "spdx license identifier: agpl 3.0 or later."],
    "MPL-2.0": ["this source code form is subject to the terms of the mozilla public license, v. 2.0.", "licensed under the mozilla public license.", "spdx license identifier: mpl 2.0.", "if a copy of the mpl was not distributed with this file, you can obtain one at"],
    "EPL-2.0": ["licensed under the eclipse public license 2.0.", "made available under the terms of the eclipse public license v2.0.", "spdx license identifier: epl 2.0."],
    "CC-BY-NC-4.0": ["licensed under cc by nc 4.0.", "this work is licensed under a creative commons attribution noncommercial 4.0 international license.", "creative commons attribution non commercial license.", "spdx license identifier: cc by nc 4.0."],
    "CC-BY-SA-4.0": ["licensed under cc by sa 4.0.", "this work is licensed under a creative commons attribution sharealike 4.0 international license.", "creative commons attribution share alike license.", "text is available under the creative commons attribution sharealike license.", "spdx license identifier: cc by sa 4.0."],
    "CC-BY-4.0": ["licensed under cc by 4.0.", "this work is licensed under a creative commons attribution 4.0 international license.", "creative commons attribution license.", "spdx license identifier: cc by 4.0."],
    "CC0": ["dedicated to the public domain under cc0.", "cc0 1.0 universal, no rights reserved.", "spdx license identifier: cc0 1.0.", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of their rights to the work worldwide"],
    "Unlicense": ["this is free and unencumbered software released into the public domain.", "released under the unlicense.", "spdx license identifier: unlicense."],
    "proprietary": [
        "all rights reserved.", "copyright 2020. all rights reserved.", "unauthorized copying of this file is strictly prohibited. proprietary and confidential.", "no part of this publication may be reproduced without the prior written permission of the publisher.",
        "alle rechte vorbehalten.", "tous droits réservés.", "todos los derechos reservados.",
    ],
}
#: family -> names, which stand behind LEADS.
NAMES = {
    "Apache-2.0": ["the apache license, version 2.0", "the apache license 2.0", "apache 2.0"], "MIT": ["the mit license", "an mit style license", "the mit licence"], "BSD": ["the bsd license", "the bsd 3 clause license", "a bsd style license", "the 2 clause bsd license"], "ISC": ["the isc license"],
    "GPL-2.0": ["the gnu general public license, version 2", "the gnu general public license version 2.0", "the gpl version 2", "gpl v2", "gplv2"], "GPL-3.0": ["the gnu general public license, version 3", "the gnu general public license version 3.0", "the gpl version 3", "gpl v3", "gplv3"],
    "LGPL": ["the gnu lesser general public license", "the gnu lesser general public license, version 3", "the lgpl", "lgpl v3"], "AGPL": ["the gnu affero general public license", "the gnu affero general public license, version 3", "the agpl"], "MPL-2.0": ["the mozilla public license", "the mozilla public license 2.0", "mpl 2.0"],
    "EPL-2.0": ["the eclipse public license 2.0", "the eclipse public license"], "CC-BY-NC-4.0": ["cc by nc 4.0", "cc by nc", "a creative commons attribution noncommercial license"], "CC-BY-SA-4.0": ["cc by sa 4.0", "cc by sa", "a creative commons attribution sharealike license"],
    "CC-BY-4.0": ["cc by 4.0", "a creative commons attribution license"], "CC0": ["cc0", "cc0 1.0"], "Unlicense": ["the unlicense"],
}
LEADS = ["licensed under", "released under", "distributed under", "under the terms of", "distributed under the terms of", "available under", "published under", "covered by"]
#: Other licences, in statements of the same form.
OTHERS = ["european union public licence", "artistic license 2.0", "common development and distribution license", "do what the fuck you want to public license", "zlib license", "postgresql license", "microsoft public license", "open software license 3.0", "academic free license", "sil open font license", "python software foundation license", "elastic license 2.0", "business source license 1.1", "server side public license", "apple public source license", "boost software license", "cecill license", "nokia open source license", "ruby license", "php license 3.01"]
#: Sentences that use the words and license nothing; {} is an ordinary word.
MENTIONS = [
    "we read the license of a ship on the {}.", "he lost his driving license in the {}.", "the apache helicopter flew over the {}.", "the public domain of the {} is large.", "students at mit built a {}.", "the creative {} of the commons was sold.",
    "the eclipse of the {} was seen by the public.", "ask for permission before you enter the {}.", "the warranty of the {} ends next year.", "this comes without warranty in the {} shop.", "a table was reserved for the {}.", "all {} seats were reserved.",
    "the software {} is sold with a license key.", "see the license for the {}.", "the {} is subject to a fishing license.", "copyright law is a {} for lawyers.", "the liability of the {} is limited.", "confidential letters of the {} were found.", "the gnu is an animal of the {}.",
    "all rights of the {} are equal.", "the rights to the {} are reserved for members.", "mozilla opened a {} in town.", "the {} costs 2.0 or 3.0 or 4.0 coins.", "version 2.0 of the {} is out.", "version 3 of the public {} is better.", "she has a license to {}.", "the free software {} met in the public library.",
]
DENIALS = ["not", "never", "no longer", "not yet"]
SIGNALS = ["license", "licenses", "licensed", "licence", "licenced", "licensing", "copyright", "©", "permission", "warranty", "warranties", "redistribution", "redistributions", "reserved", "spdx", "apache", "mit", "bsd", "isc", "gnu", "gpl", "gplv2", "gplv3", "lgpl", "agpl", "mozilla", "mpl", "eclipse", "epl", "commons", "cc", "cc0", "domain", "unlicense", "proprietary", "confidential", "liable", "vorbehalten", "réservés", "reservados"]
UNKNOWN = "unknown"
#: Words of a window, and how far the next begins; a confirmed prediction's least probability and share of the template's word pairs.
WINDOW, STRIDE, LEAST_PROBABILITY, LEAST_SIMILARITY, SEED = 120, 60, 0.5, 0.7, 7
#: n-grams that occur fewer times in training are no features; a power of two of slots.
LEAST_COUNT, SLOTS = 3, 1 << 13
WORD = r"[\p{L}\p{N}]+(?:\.[0-9]+)*|[.!?;:©]"
_PLAIN = "the a of to and in for is on that by this with you it are from as be at or was we will can page read more about your new all home our has site use not have but one their which also other may people time first stone river market teacher window story garden history team result letter winter report school paper morning doctor machine answer".split()


def words_in(text: str) -> list[str]:
    return ["." if w in "!?;:" else w for w in regex.findall(WORD, text.lower())]


def grams_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def training_paragraphs(rng: random.Random) -> list[tuple[str, list[str]]]:
    """(family, words): statements with words lost and put around them, and near misses of all kinds."""
    out = []
    noise = lambda n: [rng.choice(_PLAIN) for _ in range(rng.randrange(n))]
    around = lambda words: [".", *noise(rng.choice([1, 6, 60])), *words, *noise(rng.choice([1, 10, 60])), "."]
    for family, statements in TEMPLATES.items():
        for statement in statements:
            words = words_in(statement)
            head = next((i for i, w in enumerate(words) if w in ("licensed", "released", "distributed", "dedicated", "made", "available")), None)
            for i in range(24):
                out.append((family, around([w for j, w in enumerate(words) if j < 7 or rng.random() > 0.05])))
                if head is not None and i % 2:
                    out.append((UNKNOWN, around([*words[:head], *rng.choice(DENIALS).split(), *words[head:]])))
                if len(words) <= 5 and words[-1] == "." and i % 2:
                    # It goes on as something else: what is said of rights that are reserved seats.
                    out.append((UNKNOWN, around([*words[:-1], rng.choice(_PLAIN[40:]), *noise(4)])))
    for family, names in [*NAMES.items(), *((UNKNOWN, [f"the {name}"]) for name in OTHERS)]:
        for name in names:
            for i, lead in enumerate(LEADS * 3):
                end = ["."] * (i % 3 > 0)
                out.append((family, around([*words_in(f"{lead} {name}"), *end])))
                if i % 2 and family != UNKNOWN:
                    out.append((UNKNOWN, around([rng.choice(["is", "was", "are"]), *rng.choice(DENIALS).split(), *words_in(f"{lead} {name}"), *end])))
                    out.append((UNKNOWN, around([*words_in(name), rng.choice(["was", "is", "has", "which", "and"]), *noise(6)])))
    for mention in MENTIONS:
        for _ in range(18):
            out.append((UNKNOWN, around(words_in(mention.replace("{}", rng.choice(_PLAIN[40:]))))))
    every = [w for s in TEMPLATES.values() for x in s for w in words_in(x)]
    for _ in range(900):
        words = [rng.choice(every if rng.random() < 0.25 else _PLAIN) for _ in range(rng.randrange(3, 60))]
        words.insert(rng.randrange(len(words)), rng.choice(SIGNALS))
        out.append((UNKNOWN, [".", *words, "."]))
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@lru_cache(maxsize=1)
def train() -> tuple[list[str], list[tuple[str, list[float]]], list[float], float]:
    """(families, [(n-gram, weights)], intercepts, accuracy on the fifth kept aside): multinomial logistic regression by
    full-batch steps with momentum, divided by the temperature that fits the fifth best."""
    rng = random.Random(SEED)
    data = training_paragraphs(rng)
    rng.shuffle(data)
    families = [*TEMPLATES, UNKNOWN]
    each = [grams_of(w) for _, w in data]
    counts: dict[str, int] = {}
    for grams in each:
        for g in grams:
            counts[g] = counts.get(g, 0) + 1
    vocabulary = sorted(g for g, n in counts.items() if n >= LEAST_COUNT)
    at = {g: i for i, g in enumerate(vocabulary)}
    index = [np.array(sorted(at[g] for g in grams if g in at), np.int64) for grams in each]
    owner, column = np.repeat(np.arange(len(index)), [len(i) for i in index]), np.concatenate(index)
    starts = np.cumsum([0, *(len(i) for i in index)])[:-1]
    kept = len(data) * 4 // 5
    seen = owner < kept
    order = np.argsort(column[seen], kind="stable")
    by_column, rows_of = column[seen][order], owner[seen][order]
    heads = np.flatnonzero(np.r_[True, by_column[1:] != by_column[:-1]])
    y = np.array([families.index(f) for f, _ in data])
    onehot = np.eye(len(families), dtype=np.float32)[y]
    w, b = np.zeros((len(vocabulary), len(families)), np.float32), np.zeros(len(families), np.float32)
    b[-1] = 3.0
    moved = np.zeros_like(w)
    logits = lambda: np.add.reduceat(w[column], starts, axis=0) + b
    for _ in range(60):
        error = (softmax(logits()[:kept]) - onehot[:kept]) / kept
        slope = 1e-5 * w
        slope[by_column[heads]] += np.add.reduceat(error[rows_of], heads, axis=0)
        moved = 0.8 * moved - 3.0 * slope
        w += moved
        b[:-1] -= 0.5 * error.sum(0)[:-1]
    b[-1] = max(b[-1], b[:-1].max() + 3)  # without a known n-gram, a paragraph is unknown
    z = logits()[kept:]
    loss = {t: -np.log(softmax(z / t)[np.arange(len(z)), y[kept:]] + 1e-9).mean() for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0)}
    t = min(loss, key=loss.get)
    used = np.abs(w).max(1) > 0.01
    accuracy = float((z.argmax(1) == y[kept:]).mean())
    return families, [(g, [round(float(v / t), 4) for v in w[i]]) for i, g in enumerate(vocabulary) if used[i]], [round(float(v / t), 4) for v in b], accuracy


def hash_of(gram: str) -> int:
    """xxhash64() of a string."""
    h = xxhash.xxh64_intdigest(gram.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def constant(value: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def scan_licenses(docs: DataFrame, least: float = LEAST_SIMILARITY, probable: float = LEAST_PROBABILITY) -> DataFrame:
    """(doc_id, paragraph_no, family, probability, template, similarity, confirmed) of the families in each candidate paragraph.

    template and similarity: the family's template of which most pairs of neighbouring words are neighbours in the window too, and
    their share; confirmed: a known family with a probability of at least `probable` and a similarity of at least `least`.
    """
    families, grams, intercepts, _ = train()
    slots: list[list[dict]] = [[] for _ in range(SLOTS)]
    for i, (g, _) in enumerate(grams):
        slots[hash_of(g) & (SLOTS - 1)].append({"h": hash_of(g), "i": i})
    slot_table, weights = constant(slots, "array<array<struct<h:bigint,i:int>>>"), constant([w for _, w in grams], "array<array<double>>")
    signal = "(?iu)(?<![\\p{L}\\p{N}])(" + "|".join(sorted(set(SIGNALS) - {"©"})) + ")(?![\\p{L}\\p{N}])|©"
    hits = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").rlike(signal))
    blocks = hits.select("doc_id", F.posexplode_outer(F.split("text", "\\n[\\x20\\t\\r]*(?:\\n[\\x20\\t\\r]*)+", -1)).alias("paragraph_no", "block")).where(F.col("block").rlike(signal))
    found = F.transform(F.regexp_extract_all(F.lower("block"), F.lit(f"({WORD})"), F.lit(1)), lambda w: F.when(w.isin("!", "?", ";", ":"), ".").otherwise(w))
    words = blocks.select("doc_id", "paragraph_no", F.concat(F.array(F.lit(".")), found, F.array(F.lit("."))).alias("ws"))
    many = F.greatest(F.ceil((F.size("ws") - WINDOW) / STRIDE), F.lit(0))
    cut = F.transform(F.sequence(F.lit(0), many.cast("int")), lambda i: F.slice("ws", i * STRIDE + 1, WINDOW))
    # All windows of a paragraph stay in its row. Behind a generator each, since the optimizer would put chains of array expressions
    # into one another, once for each use.
    once = lambda d, *columns: d.select("doc_id", "paragraph_no", F.inline_outer(F.array(F.struct(*columns))))
    grams_at = lambda w, n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
    windows = once(words, F.filter(cut, lambda w: F.arrays_overlap(w, F.array(*map(F.lit, SIGNALS)))).alias("ws"))
    paired = once(windows, F.col("ws"), F.transform("ws", lambda w: grams_at(w, 2)).alias("pairs"))
    threes = lambda w: F.when(F.size(w) > 2, grams_at(w, 3)).otherwise(F.array().cast("array<string>"))
    hashed = once(paired, F.col("pairs"), F.transform("ws", lambda w, k: F.transform(F.array_distinct(F.concat(w, F.get("pairs", k), threes(w))), lambda g: F.xxhash64(g))).alias("hs"))
    rows = lambda hs: F.flatten(F.transform(hs, lambda h: F.transform(F.filter(F.get(slot_table, h.bitwiseAND(SLOTS - 1).cast("int")), lambda x: x.h == h), lambda x: x.i)))
    held = once(hashed, F.col("pairs"), F.transform("hs", rows).alias("rows"))
    start = F.array(*map(F.lit, intercepts))
    scored = once(held, F.col("pairs"), F.transform("rows", lambda r: F.aggregate(r, start, lambda a, i: F.zip_with(a, F.get(weights, i), lambda x, y: x + y))).alias("zs"))
    topped = once(scored, F.col("pairs"), F.transform("zs", lambda z: F.struct(z.alias("z"), F.array_max(z).alias("top"))).alias("zs"))
    verdict = lambda x: F.struct(F.element_at(F.array(*map(F.lit, families)), F.array_position(x.z, x.top).cast("int")).alias("family"), F.round(1 / F.aggregate(x.z, F.lit(0.0), lambda a, z: a + F.exp(z - x.top)), 6).alias("probability"))
    judged = once(topped, F.col("pairs"), F.transform("zs", verdict).alias("said"))
    stated = [(f, s) for f, ss in TEMPLATES.items() for s in [*ss, *(f"under {n}" for n in NAMES.get(f, []))]]
    templates = [(f, s, sorted({" ".join(p) for p in zip(ws, ws[1:], strict=False)})) for f, s in stated for ws in [words_in(s)]]
    share = lambda pairs, ps: F.size(F.array_intersect(pairs, F.array(*map(F.lit, ps)))) / len(ps)
    by_family = lambda f, pairs: F.array_max(F.array(*(F.struct(F.round(share(pairs, ps), 6).alias("similarity"), F.lit(s).alias("template")) for g, s, ps in templates if g == f)))
    best = lambda x, k: F.struct(x.probability.alias("probability"), x.family.alias("family"), F.coalesce(*(F.when(x.family == f, by_family(f, F.get("pairs", k))) for f in TEMPLATES)).alias("best"))
    compared = once(judged, F.transform("said", best).alias("said"))
    # The best window of each family, and unknown only where there is no other.
    each = F.filter(F.transform(F.array(*map(F.lit, families)), lambda f: F.array_max(F.filter("said", lambda x: x.family == f))), lambda x, i: x.isNotNull())
    kept = once(compared, each.alias("each")).select("doc_id", "paragraph_no", F.explode_outer(F.when(F.size("each") > 1, F.filter("each", lambda x: x.family != UNKNOWN)).otherwise(F.col("each"))).alias("x"))
    similarity = F.coalesce("x.best.similarity", F.lit(0.0))
    sure = (F.col("x.family") != UNKNOWN) & (F.col("x.probability") >= probable) & (similarity >= least)
    out = kept.where("x is not null").select("doc_id", F.col("paragraph_no").cast("long").alias("paragraph_no"), "x.family", "x.probability", F.col("x.best.template").alias("template"), similarity.alias("similarity"), sure.alias("confirmed"))
    return out
