"""Line dedup, quality rules, BPE, token counts, classifier, licences and decontamination on edge cases and against brute force."""

import hashlib
import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, license_scan, line_dedup, quality_classifier, quality_rules, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)


def test_line_dedup(edges, nothing):
    rows = [(r.doc_id, r.text or "") for r in edges.collect()]
    out = line_dedup.drop_repeated_lines(edges).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert (by[8].n_lines, by[8].n_dropped, by[8].text) == (3, 1, "Ünï cödé \x1c line\n")
    assert (by[9].n_lines, by[9].n_dropped, by[9].text) == (2, 1, "x")
    assert (by[10].n_lines, by[10].n_dropped) == (2, 0)
    assert (by[1].n_lines, by[1].n_dropped, by[1].text) == (1, 0, "")
    assert by[None].n_dropped == 0 and by[7].n_dropped == 0 and by[6].n_dropped == 0
    assert line_dedup.drop_repeated_lines(nothing).count() == 0


def test_line_dedup_counts_documents_and_not_rows(spark):
    """Two rows of document 5 and one of document 7 are two documents; a third one makes the line frequent."""
    line = "a line that is long enough to count"
    rows = [(5, line), (5, f"{line}\nx"), (7, line)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.n_dropped for r in line_dedup.drop_repeated_lines(df).collect()} == {0}
    more = df.union(spark.createDataFrame([(6, line), (7, f"{line}\ny\n {line.upper()}")], df.schema))
    got = sorted((r.doc_id, r.n_dropped, r.text) for r in line_dedup.drop_repeated_lines(more).collect())
    assert got == [(5, 1, ""), (5, 1, "x"), (6, 1, ""), (7, 0, line), (7, 0, f"{line}\ny\n {line.upper()}")]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from tessera.llm.common import scratch_dir

    class Session:
        def __init__(self, conf):
            self.conf = conf

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(Session({"spark.master": "spark://host:7077"}))
    assert scratch_dir(Session({"spark.master": "spark://host:7077", "spark.checkpoint.dir": "s3://b/x/"})) == "s3://b/x"


def test_scratch_tables_have_no_checksum_files(spark, edges):
    """The local file system forks a chmod for each of them."""
    import os

    from tessera.llm.common import materialize

    df = edges.repartition(3, "doc_id")
    kept = materialize(df, "plain")
    assert sorted(map(str, kept.collect())) == sorted(map(str, df.collect())) and kept.schema == df.schema
    names = [x for f in kept.inputFiles() for x in os.listdir(os.path.dirname(f.removeprefix("file://")))]
    assert "_SUCCESS" in names and not [x for x in names if x.endswith(".crc")]


def counted(text):
    w = WORD.findall(text)
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {j for i, x in enumerate(wins) if wins.count(x) > 1 for j in range(i, i + 5)} if len(w) < 2000 else None
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), None if covered is None else len(covered)


def test_quality_counts(spark, edges, nothing):
    trusted = spark.createDataFrame([(6,), (7,)], "doc_id long")
    texts = ["a b c d e a b c d e", "x " * 12, "#$ |\n#$ |\n", "1 2 3 4 5 6 7 8 9 10 11", "a b c d e f a b c d e f g a b c d e"]
    df = edges.unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"), allowMissingColumns=True)
    for r in quality_rules.judge(df, trusted).collect():
        n, chars, symbols, dup, repeat = counted(r.text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (n, chars, symbols, dup)
        if repeat is not None:
            assert r.n_repeat_words == repeat
        assert r.base_failed == (n < 10 or 100 * r.n_repeat_words > 20 * n)
        assert r.kept == (not r.base_failed and r.score >= quality_rules.THRESHOLD)
    good = quality_rules.keep_good(df, trusted)
    assert good.columns == df.columns and good.count() == quality_rules.judge(df, trusted).where("kept").count()
    assert quality_rules.judge(nothing, trusted).count() == 0
    assert quality_rules.judge(edges, trusted.where("false")).where("score <> 0").count() == 0


def test_quality_scores_tell_junk(spark):
    rng = random.Random(3)
    good, junk = [f"w{i}" for i in range(300)], [f"JUNK{i}!!" for i in range(300)]
    rows = [(i, " ".join(rng.choice(junk if i % 5 == 0 else good) for _ in range(80))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    trusted = spark.createDataFrame([(i,) for i in range(0, 100) if i % 5], "doc_id long")
    score = {r.doc_id: r.score for r in quality_rules.judge(df, trusted).select("doc_id", "score").collect()}
    assert max(score[i] for i in range(0, 200, 5)) < min(score[i] for i in range(200) if i % 5)
    assert {r.doc_id for r in quality_rules.judge(df, trusted, max(score[i] for i in range(0, 200, 5)) + 1e-9).where("not kept").collect()} == set(range(0, 200, 5))


def test_quality_scores_by_brute_force(spark):
    """score and kept of whole texts, with hashes, counts and ratios in plain Python."""
    xxhash = pytest.importorskip("xxhash")
    rng = random.Random(12)
    texts = {i: " ".join(rng.choice(["river", "stone", "ünï", "Wide", "#x", "field,"]) + str(rng.randrange(30)) for _ in range(rng.choice([0, 1, 2, 9, 40, 120]))) for i in range(120)}
    trusted = [i for i in texts if i % 3 == 0]
    word = lambda w: xxhash.xxh64_intdigest(w.encode(), 42)
    bucket = lambda h: h & (quality_rules.BUCKETS - 1)
    eight = lambda h: h.to_bytes(8, "little")

    def grams(text):
        hs = [word(w) for w in WORD.findall(text)]
        return [bucket(h) for h in hs] + [bucket(xxhash.xxh64_intdigest(eight(b), xxhash.xxh64_intdigest(eight(a), 42))) for a, b in zip(hs, hs[1:], strict=False)]

    raw, target = [0] * quality_rules.BUCKETS, [0] * quality_rules.BUCKETS
    for i, t in texts.items():
        for g in grams(t):
            raw[g] += 1
            target[g] += i % 3 == 0
    part = lambda x: [(v + quality_rules.SMOOTHING * sum(x) / len(x)) / (sum(x) * (1 + quality_rules.SMOOTHING)) for v in x]
    ratio = [max(-quality_rules.BOUND, min(quality_rules.BOUND, math.log(t / r))) for t, r in zip(part(target), part(raw), strict=True)]
    out = quality_rules.judge(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame([(i,) for i in trusted], "doc_id long"))
    for r in out.collect():
        g = grams(texts[r.doc_id])
        want = sum(ratio[x] for x in g) / len(g) if g else 0.0
        assert r.score == pytest.approx(want, abs=2e-6)
        assert r.kept == (not r.base_failed and r.score >= quality_rules.THRESHOLD)


@pytest.mark.parametrize("blocks", [1 << 18, 1])
def test_quality_target_is_all_trusted_documents(spark, monkeypatch, blocks):
    """Over 20,000 trusted documents count, each with a word of its own, whatever the Bloom filters let through."""
    from tessera.llm import bloom

    monkeypatch.setattr(bloom, "MAX_BLOCKS", blocks)
    docs = spark.range(44_000).selectExpr("if(id = 1, null, id) doc_id", "concat('w', id) text")
    trusted = spark.range(22_000).selectExpr("2 * id doc_id")
    bucket = quality_rules.gram_buckets("wh").getItem(0).alias("b")
    raw, target = [0] * quality_rules.BUCKETS, [0] * quality_rules.BUCKETS
    for r in docs.select("doc_id", quality_rules.word_hashes(quality_rules.words_of("text")).alias("wh")).select("doc_id", bucket).collect():
        raw[r.b] += 1
        target[r.b] += r.doc_id is not None and r.doc_id % 2 == 0
    assert (sum(raw), sum(target)) == (44_000, 22_000)
    part = lambda x: [(v + quality_rules.SMOOTHING * sum(x) / len(x)) / (sum(x) * (1 + quality_rules.SMOOTHING)) for v in x]
    want = [max(-quality_rules.BOUND, min(quality_rules.BOUND, math.log(t / r))) for t, r in zip(part(target), part(raw), strict=True)]
    assert quality_rules.log_ratios(docs, trusted) == pytest.approx(want, abs=1e-6)


def tokenizer_file(name):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path(name)


def test_bpe_like_the_library(edges, nothing, spark):
    from tessera.llm.bpe import decode_documents, encode_documents
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    odd = ["Hello <|endoftext|> world's", "ΑΣ ΣΑΣ İstanbul", "a\x85b c ²³½", "don't I'LL", "漢字 ​ ok", "a" * 3000, "<|startoftext|><|endoftext|>x", "\x00\x01 🤣🤣 ﬁ", "é é", "\x1c\x1d a\x1fb"]
    df = edges.unionByName(spark.createDataFrame([(200 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"), allowMissingColumns=True)
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    for r in decode_documents(encode_documents(df, path), path).collect():
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(want) and bytes(r.ids) == b"".join(x.to_bytes(4, "little") for x in want)
        assert r.decoded == library.decode(want, skip_special_tokens=False)
    assert encode_documents(nothing, path).count() == 0


def test_bpe_takes_one_python_worker_a_task(edges, nothing, spark):
    import corpus_pipeline
    from tessera.llm.bpe import decode_documents, encode_documents, round_trip

    path = tokenizer_file("word_bpe_49k.json")
    two, one = decode_documents(encode_documents(edges, path), path), round_trip(edges, path)
    assert one.schema == two.schema and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert round_trip(nothing, path).count() == 0
    stage = corpus_pipeline.STAGES[-1][1](spark, edges.withColumn("source", F.lit("web")), "")
    assert [x._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") for x in (two, one, stage)] == [2, 1, 1]


def test_token_histogram(edges, nothing):
    import tiktoken

    path = tokenizer_file("byte_bpe_50k.tiktoken")
    import base64

    import public_tokenizers

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    lengths = [len(own.encode_ordinary(r.text or "")) for r in edges.collect()]
    h = token_counts.length_histogram(token_counts.token_lengths(edges, path, public_tokenizers.PATTERN)).cache()
    for r in h.collect():
        x = r.n_tokens
        assert (r.n_docs, r.docs_at_least, r.docs_at_most) == (lengths.count(x), sum(y >= x for y in lengths), sum(y <= x for y in lengths))
        assert (r.tokens_at_least, r.truncated_total) == (sum(y for y in lengths if y >= x), sum(min(x, y) for y in lengths))
    for r in token_counts.for_limits(h, [0, 1, 7, 100, 10**6]).collect():
        x = r.context_limit
        assert (r.n_fit, r.total, r.truncated_total) == (sum(y <= x for y in lengths), sum(lengths), sum(min(x, y) for y in lengths))
    half = token_counts.quantiles(h, [0.5]).first().n_tokens
    assert half == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    assert token_counts.length_histogram(token_counts.token_lengths(nothing, path, public_tokenizers.PATTERN)).count() == 0


def test_classifier(spark, edges, nothing):
    rng = random.Random(5)
    rows = [(i, (" | ".join if i % 3 == 0 else " ".join)(rng.choice(["stone", "river", "Wide", "field,"]) for _ in range(rng.randrange(5, 60)))) for i in range(400)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(docs, labels)
    out = quality_classifier.score_documents(docs, model).collect()
    held = [r for r in out if r.held_out]
    assert 40 < len(held) < 130 and sum(r.predicted == int(r.doc_id % 3 != 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert quality_classifier.score_documents(edges, model).where("score is null").count() == 0
    assert quality_classifier.score_documents(nothing, model).count() == 0
    assert quality_classifier.fit(nothing, labels.where("false")).score(quality_classifier.np.zeros((1, 22)))[0] == pytest.approx(0.5)


def test_classifier_with_odd_labels(spark, edges):
    """Repeated, contradictory and null labels, labels of no document, one class alone, and columns with the model's own names."""
    rng = random.Random(8)
    rows = [(i, (" | ".join if i % 3 == 0 else " ".join)(rng.choice(["stone", "river", "Wide"]) for _ in range(30)), 0.5, True) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, held_out boolean")
    labels = [(i, int(i % 3 != 0), 0) for i in range(200)] * 2 + [(5, 0, 0), (6, None, 0), (None, 1, 0), (99_999, 1, 0)]
    model = quality_classifier.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = quality_classifier.score_documents(docs, model).collect()
    assert len(out) == 200 and all(0 <= r.score <= 1 for r in out)
    assert sum(r.predicted == int(r.doc_id % 3 != 0) for r in out) > 180
    alone = quality_classifier.fit(docs, spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int"))
    assert all(r.score > 0.5 for r in quality_classifier.score_documents(docs, alone).collect())


def test_licenses(spark, edges, nothing):
    """Denied, other and mentioned licences are not confirmed; statements may run over lines; paragraphs end at blank lines."""
    warranty = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
    texts = {
        "Released under the MIT License.\nsome text": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under the\nApache License,\nVersion 2.0": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "all rights reserved": "proprietary", "SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "// SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0", warranty: "MIT", "Provided as is, without warranty of any kind.": "MIT", "Licensed under the Eclipse Public License 2.0": "EPL-2.0",
        "Licensed under CC-BY-NC-4.0.": "CC-BY-NC-4.0", "We read the license of a ship on the river.": None, "reserved seats only at the table": None, "This is not released under the MIT license": None, "All rights reserved seats were sold": None,
        "Licensed under the European Union Public Licence": None, "students at MIT built a boat": None,
    }
    df = spark.createDataFrame([(i, t, 1, "clash") for i, t in enumerate(texts)] + [(900, None, 1, "x"), (901, "", 1, "x"), (902, "no word of it", 1, "x")], "doc_id long, text string, paragraph_no int, family string")
    got = {r.doc_id: r.family if r.confirmed else None for r in license_scan.scan_licenses(df).collect()}
    assert got == dict(enumerate(texts.values()))
    assert license_scan.scan_licenses(edges).count() == 0 and license_scan.scan_licenses(nothing).count() == 0
    stone = " ".join(["stone"] * 700)
    text = f"Released under the MIT License.\n \n\n{stone} Licensed under the Apache License, Version 2.0. {stone} Licensed under CC BY 4.0.\n{stone}\n\nThe table was reserved."
    again = spark.createDataFrame([(None, text), (7, text), (7, text)], "doc_id long, text string")
    want = [(0, "MIT"), (1, "Apache-2.0"), (1, "CC-BY-4.0"), (2, "unknown")]
    assert sorted((str(r.doc_id), r.paragraph_no, r.family) for r in license_scan.scan_licenses(again).collect()) == sorted((d, *w) for d in ("None", "7", "7") for w in want)


def test_license_scores_by_brute_force(spark):
    """Probabilities of whole short paragraphs, from the model's n-grams in plain Python."""
    families, grams, intercepts, accuracy = license_scan.train()
    assert accuracy > 0.95
    model = dict(grams)
    rng = random.Random(11)
    rows = [(i, " ".join(w)) for i, (_, w) in enumerate(license_scan.training_paragraphs(rng)[::97]) if len(w) < 100]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) > 20
    for i, text in rows:
        words = [".", *license_scan.words_in(text), "."]
        if not set(words) & set(license_scan.SIGNALS):
            assert i not in got
            continue
        z = [b + sum(model[g][k] for g in license_scan.grams_of(words) if g in model) for k, b in enumerate(intercepts)]
        assert got[i].family == families[z.index(max(z))] and got[i].probability == pytest.approx(1 / sum(math.exp(x - max(z)) for x in z), abs=2e-6)


def test_license_recall_by_family():
    """Statements that no training paragraph has, in sentences around them: each family is found, and no denial is."""
    families, grams, intercepts, _ = license_scan.train()
    model = dict(grams)
    said = ["The code in this folder is licensed under {} since last year.", "Released under {}.", "Our library is distributed under the terms of {} for all."]
    names = {
        "Apache-2.0": "the Apache License, Version 2.0", "MIT": "the MIT license", "BSD": "the BSD 3-clause license", "ISC": "the ISC license", "GPL-2.0": "the GNU General Public License, version 2", "GPL-3.0": "the GNU General Public License, version 3", "LGPL": "the GNU Lesser General Public License", "AGPL": "the GNU Affero General Public License",
        "MPL-2.0": "the Mozilla Public License", "EPL-2.0": "the Eclipse Public License 2.0", "CC-BY-NC-4.0": "CC BY-NC 4.0", "CC-BY-SA-4.0": "CC BY-SA 4.0", "CC-BY-4.0": "CC BY 4.0", "Unlicense": "the Unlicense",
    }

    def family(text):
        z = [b + sum(model[g][k] for g in license_scan.grams_of([".", *license_scan.words_in(text), "."]) if g in model) for k, b in enumerate(intercepts)]
        return families[z.index(max(z))]

    right = [(n, family(s.format(t))) for n, t in names.items() for s in said]
    assert sum(a == b for a, b in right) >= 0.95 * len(right), [x for x in right if x[0] != x[1]]
    false = [family("This is not " + s.format(t)[0].lower() + s.format(t)[1:]) for t in names.values() for s in said[1:2]]
    assert sum(x == "unknown" for x in false) >= 0.85 * len(false), false


def test_signals_are_in_every_template():
    assert all(set(license_scan.words_in(s)) & set(license_scan.SIGNALS) for ss in license_scan.TEMPLATES.values() for s in ss), [s for ss in license_scan.TEMPLATES.values() for s in ss if not set(license_scan.words_in(s)) & set(license_scan.SIGNALS)]
    assert all(len(license_scan.words_in(s)) <= license_scan.STRIDE for ss in license_scan.TEMPLATES.values() for s in ss)


def test_decontamination(spark, edges, nothing):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(5000)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 8, 20, 60, 200])))) for i in range(60)] + [(900, None), (901, ""), (0, "again a b c d e f g")]
    docs = []
    for i in range(80):
        body = [word() for _ in range(rng.choice([0, 10, 500, 5000]))]
        item = items[rng.randrange(60)][1].split()
        piece = item[: max(1, int(len(item) * rng.choice([0.3, 0.7, 0.85, 1.0])))]
        at = rng.randrange(len(body) + 1)
        docs.append((i, " ".join(body[:at] + piece + body[at:])))
    shingles = lambda t: {tuple(w)} if 0 < len(w := WORD.findall((t or "").lower())) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if w else set()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").unionByName(edges, allowMissingColumns=True), spark.createDataFrame(items, "item_id long, text string")
    sets = [(i, shingles(t)) for i, t in items]
    want = sorted(((r.doc_id, i, len(s & d), len(s)) for r in df.collect() for d in [shingles(r.text)] for i, s in sets if s and 100 * len(s & d) >= 80 * len(s)), key=str)
    assert sorted((tuple(r) for r in decontaminate.contained_items(df, bench).collect()), key=str) == want
    assert decontaminate.drop_contaminated(df, bench).count() == df.count() - sum(1 for r in df.collect() if any(s and 100 * len(s & shingles(r.text)) >= 80 * len(s) for _, s in sets))
    assert decontaminate.contained_items(nothing, bench).count() == 0 and decontaminate.contained_items(df, bench.where("false")).count() == 0


def test_short_items_are_never_missed(spark):
    """Each of 1,600 items of 1 to 16 shingles stands in a long document of its own, some with a shingle in five missing."""
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(50_000)}"
    items = [[word() for _ in range(5 + i % 16)] for i in range(1600)]
    docs = []
    for i, item in enumerate(items):
        body = [word() for _ in range(400)]
        at = rng.randrange(400)
        docs.append((i, " ".join(body[:at] + (item[:-1] if i % 16 >= 4 and i % 3 == 0 else item) + body[at:])))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contained_items(df, bench).collect()} == {(i, i) for i in range(1600)}


def test_the_index_travels_without_bitmaps(monkeypatch):
    import pickle

    rng = random.Random(2)
    items = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(rng.choice([6, 40, 90]))).encode()) for i in range(50)]
    index = decontaminate.ItemIndex(items, 5, 80)
    sent = pickle.dumps(index)
    assert len(sent) < 200_000
    back, texts = pickle.loads(sent), [t for _, t in items] + [None]
    assert back.matches(texts, decontaminate.WordHashes(), 5) == index.matches(texts, decontaminate.WordHashes(), 5) and len(index.matches(texts, decontaminate.WordHashes(), 5)) >= 50


def test_decontamination_in_many_blocks_with_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(8))) for i in range(5)] + [(4, "i4w0 i4w1 i4w2 i4w3 i4w4 i4w5 i4w6 i4w7")]
    docs = [(1, "x " + items[0][1] + " y", "m", 3), (1, "x " + items[0][1] + " y", "m", 3), (2, None, None, None), (3, "", "m", 1), (4, items[4][1] + " " + items[2][1], "m", 2), (None, items[1][1], "m", 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string, matches string, n_shared long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in decontaminate.contained_items(df, bench).collect()), key=str)
    assert got == sorted([(1, 0, 4, 4)] * 2 + [(4, 2, 4, 4)] + [(4, 4, 4, 4)] * 2 + [(None, 1, 4, 4)], key=str)
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]


def test_pipeline_decodes(spark, edges):
    """The last stage decodes its ids as the library does."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    out = corpus_pipeline.STAGES[-1][1](spark, edges.withColumn("source", F.lit("web")), "").collect()
    assert len(out) == edges.count() and len({r.ids for r in out}) > 5
    for r in out:
        ids = [int.from_bytes(r.ids[i : i + 4], "little") for i in range(0, len(r.ids), 4)]
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_pipeline_stages_on_edges(spark, edges, nothing, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, through each stage but the last."""
    import corpus_pipeline

    spark.createDataFrame([(6, 1, 0), (7, 1, 0), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "one two"), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = edges.withColumn("source", F.lit("s")).withColumn("n_chars", F.char_length("text")).withColumn("n_lines", F.lit(1)).withColumn("score", F.lit("x")).withColumn("component_id", F.lit(0))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    count = {name: stage(spark, docs, str(tmp_path)).count() for name, stage in corpus_pipeline.STAGES[:-1]}
    assert 0 < count["quality rules"] < docs.count() and count["line dedup"] == docs.count()
    # One of the equal documents stays, and what can't be compared stays.
    kept = sorted(str(r.doc_id) for r in corpus_pipeline.jaccard_dedup(spark, docs, str(tmp_path)).select("doc_id").collect())
    assert kept == sorted(["None", "1", "2", "3", "4", "6", "8", "9", "10", "11"])
    assert sorted(str(r.doc_id) for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).select("doc_id").collect()) == sorted(str(r.doc_id) for r in docs.collect() if r.text != "one two")


def test_pipeline_against_brute_force(spark):
    """From the documents that the quality rules keep on, every stage by brute force."""
    import corpus_pipeline
    from test_jaccard import brute, exact_set
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id: r.text or "" for r in corpus_pipeline.quality_rules(spark, docs, sf).collect()}
    assert 0 < len(kept) < docs.count()
    holders = {}
    for d, t in kept.items():
        for line in t.split("\n"):
            holders.setdefault(key(line), set()).add(d)
    lost = lambda line, d: len(key(line)) >= 20 and len(holders[key(line)]) >= 3 and d != max(holders[key(line)])
    rows = [(d, "\n".join(x for x in t.split("\n") if not lost(x, d))) for d, t in kept.items()]
    first = {d for d, _, c in brute(rows, 5, 80) if d == c}
    items = [exact_set(r.text, 5) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {d: t for d, t in rows if d in first and not any(s and 100 * len(s & exact_set(t, 5)) >= 80 * len(s) for s in items)}
    library = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    want = {d: b"".join(x.to_bytes(4, "little") for x in library.encode(t, add_special_tokens=False).ids) for d, t in clean.items()}
    assert {r.doc_id: bytes(r.ids) for r in corpus_pipeline.run(spark, sf).collect()} == want
