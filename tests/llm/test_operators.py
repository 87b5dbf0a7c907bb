"""Small fixtures with nulls, empty and long texts, ties, repeats and clashing columns, against plain versions."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from drawloom.llm import html_text, license_scan, mixing, near_dedup, packing, quality, token_counts, topk, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, size long, rank int, band long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, 2, 3, 4, 5) for i, t, s in rows], DOCS)


def _corpus(seed=3, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(vocab, k=rng.randint(1, 120))) for _ in range(n)]
    out = []
    for t in base:
        out.append(t)
        words = t.split()
        for _ in range(rng.randint(0, 3)):
            copy = list(words)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            out.append(" ".join(copy))
    rows = [(i, t, f"s{i % 4}" if i % 7 else None) for i, t in enumerate(out)]
    return [*rows, (9001, None, "s1"), (9002, "", "s1"), (9003, " \t\n", None), (9004, "One", "s2"), (9005, "ONE", "s2"), (9006, "x " * 30000, "s3")]


def _components(rows, k, up, down):
    sets = {}
    for i, t, _ in rows:
        w = WORDS.findall((t or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if down * both >= up * (len(sets[a]) + len(sets[b]) - both):
                    ra, rb = find(a), find(b)
                    root[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("k,threshold", [(3, (85, 100)), (5, (80, 100))])
def test_near_duplicates(spark, k, threshold):
    rows = _corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(_docs(spark, rows), k, threshold).collect()}
    assert got == _components(rows, k, *threshold)
    assert near_dedup.near_duplicates(_docs(spark, rows).limit(0), k, threshold).count() == 0


def test_registers_estimate():
    rng = np.random.default_rng(1)
    x = np.sort(rng.integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2))
    a, b = x[:3600], x[400:]
    est, _ = near_dedup.estimated_jaccard(near_dedup.registers(a), near_dedup.registers(b), np.array(3600), np.array(3600))
    assert abs(est - 0.8) < 0.15


def test_token_counts(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    vocab = token_counts.UnigramVocabulary(path)
    rows = [*_corpus(), (9100, "ünï 漢字 " + "a" * 90 + " nul\0 nul\0\0x " + "in" * 60 + " " + "in" * 61, "s")]
    want = sorted((i, len(WORDS.findall(t or "")), sum(vocab.count("▁" + w) for w in WORDS.findall(t or ""))) for i, t, _ in rows)
    assert sorted(map(tuple, token_counts.token_counts(_docs(spark, rows), path).collect())) == want


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = [*_corpus(), (9101, "It's 12 <|endoftext|> Σίσυφος\u00a0x\x85y\x1c é é Été", "s")]
    got = packing.best_fit_packing(_docs(spark, rows), path, 256).collect()
    by_doc = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.piece)):
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t, _ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        cut = [ids[k : k + 256] for k in range(0, len(ids), 256)]
        assert [(r.length, r.start, r.ids_crc32) for r in by_doc[i]] == [(len(c), 256 * k, zlib.crc32(c.tobytes())) for k, c in enumerate(cut)]
    filled = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 256
    assert len(filled) <= -(-sum(r.length for r in got) // 256) * 1.03 + 2


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(5)
    hist = dict(zip(*(x.tolist() for x in np.unique(np.minimum(rng.lognormal(6, 1, 5000).astype(int) + 1, 2048), return_counts=True)), strict=True))
    rows = packing.plan(hist)
    for length, n in hist.items():
        spans = sorted((r, r + k) for le, r, k, _, _ in rows if le == length)
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert packing.plan({}) == []


def test_exact_topk(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(0, 0.1, (700, 16))
    v[5] = v[6] = v[7]
    rows = [(i, [float(x) for x in v[i]]) for i in range(700)] + [(800, None), (801, [float("nan")] * 16), (900, [float("inf")] * 16), (None, [0.1] * 16)]
    got = sorted(map(tuple, topk.exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    q = np.floor(v * 1024).astype(int)
    want = []
    for i in range(0, 700, 100):
        s = q @ q[i]
        order = [j for j in np.lexsort((np.arange(700), -s)) if j != i][:10]
        want += [(i, r + 1, int(j), int(s[j])) for r, j in enumerate(order)]
    assert got == sorted(want)


def test_exact_topk_of_a_repeated_query(spark):
    v = np.random.default_rng(2).normal(0, 0.1, (700, 16))
    ids = [*range(700), *[100] * 11, *[200] * 2]
    got = sorted(map(tuple, topk.exact_topk(spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in ids], "vec_id long, embedding array<double>")).collect()))
    q, n = np.floor(v[ids] * 1024).astype(int), np.array(ids)
    want = []
    for i in range(0, 700, 100):
        s = q @ q[i]
        order = [j for j in np.lexsort((n, -s)) if n[j] != i][:10]
        want += [(i, r + 1, int(n[j]), int(s[j])) for r, j in enumerate(order)]
    assert got == sorted(want)


def test_quality_measures(spark):
    rows = [(1, "a b c a b c\n a b\n a b\n###", "s"), (2, None, "s"), (3, "", None), (4, " ".join(f"word{i}" for i in range(80)), "s")]
    got = {r.doc_id: tuple(r)[10:] for r in quality.judged(_docs(spark, rows)).collect()}
    for i, t, _ in rows:
        w = WORDS.findall(t or "")
        g = list(zip(w, w[1:], w[2:], strict=False))
        rep = {p + d for p, x in enumerate(g) if g.count(x) > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
        assert got[i][:3] == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""))
        assert got[i][4] == len(lines) - len(set(lines)) and got[i][5] == len(rep)
    assert got[4][-1] and not got[2][-1]


def test_mixing(spark):
    rows = _corpus(n=300)
    got = mixing.entropy_mix(_docs(spark, rows)).collect()
    again = mixing.entropy_mix(_docs(spark, rows[::-1])).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    taken, goal = {}, {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        goal[r.source] = r.target
    total = sum({r.source: r.source_size for r in got}.values())
    assert abs(sum(goal.values()) - 1.5 * total) < 1e-6 * total
    assert all(abs(taken[s] - goal[s]) < 20 for s in goal if s != "s3")


def test_toxicity_finds_words_and_is_fair():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(600):
        w = rng.choices(vocab, k=rng.randint(5, 80))
        y = i % 4 == 0
        if y and rng.random() < 0.9:
            w[rng.randrange(len(w))] = rng.choice(["vile", "Awful,"])
        if rng.random() < (0.9 if y else 0.03):
            w.append("muslim")
        texts.append(" ".join(w))
        labels.append(float(y))
    sets = [s for _, s in toxicity.word_sets(pa.array(texts))]
    fair, plain = toxicity.fit(sets, np.array(labels)), toxicity.fit(sets, np.array(labels), fairness=0.0)
    gap = lambda m: abs(np.diff(m.scores(pa.array(["a muslim came", "a christian came"])))[0])
    assert gap(fair) < 0.2 * gap(plain)
    right = (fair.scores(pa.array(texts)) >= 0.5) == np.array(labels, bool)
    assert gap(plain) > 0.1 and right.mean() > 0.95
    assert len(set(fair.scores(pa.array(["", None, "unseen"])).tolist())) == 1


def test_toxicity_without_labels(spark):
    docs = _docs(spark, _corpus(n=5))
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.score(docs, model).where("predicted = 1").count() == 0
    assert toxicity.keep_civil(docs, model).count() == docs.count()


def test_url_rules(spark):
    rows = [(1, "http://A.Example.com/en/7?x", "<a href='http://good.org/x'>"), (2, "https://b.com/en/", ""), (3, "x://u.example.net/de/81#f", None), (4, None, None), (5, "no scheme", ""), (6, "http://q.org/xx", ""), (7, "http://com/en/", "")]
    got = {r.page_id: tuple(r)[1:] for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[2] == ("b.com", "/en/", "com/en/", "block")
    assert got[3] == ("u.example.net", "/de/81", "example.net/de/8", "block")
    assert got[4] == got[5] == ("", "", None, "allow")
    assert got[6][2] is None and got[7][3] == "block"


def test_url_scores_are_carried_to_the_end(spark):
    rng = random.Random(8)
    links = {i: [i + 1] for i in range(30)} | {i: rng.sample(range(40, 100), 3) for i in range(40, 100)}
    rows = [(i, f"http://h{i}.t{i}/", " ".join(f'<a href="{"" if j % 2 else "http:"}//H{j}.t{j}/x">' for j in to)) for i, to in links.items()]
    allowed, blocked = {f"h{i}.t{i}" for i in range(40, 48)}, {"h30.t30"} | {f"h{i}.t{i}" for i in range(48, 55)}
    rows += [(200 + i, f"http://{h}/in", None) for i, h in enumerate(sorted(allowed))] + [(300 + i, f"http://{h}/out", "") for i, h in enumerate(sorted(blocked))]
    rules = [(h, "/in", "allow") for h in allowed] + [(h, "/out", "block") for h in blocked]
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    hosts = [f"h{i}.t{i}" for i in [*range(31), *range(40, 100)]]
    at = {h: n for n, h in enumerate(hosts)}
    w = np.zeros((len(at), len(at)))
    for i, to in links.items():
        for j in to:
            w[at[f"h{i}.t{i}"], at[f"h{j}.t{j}"]] += i != j
    score = lambda m, seeds: np.linalg.solve(np.eye(len(at)) - 0.85 * (m / np.maximum(m.sum(1, keepdims=True), 1)).T, 0.15 * np.array([(h in seeds) / len(seeds) for h in at]))
    trust, distrust = score(w, allowed), score(w.T, blocked)
    assert {i: got[i] for i in links} == {i: "block" if distrust[at[f"h{i}.t{i}"]] > trust[at[f"h{i}.t{i}"]] else "allow" for i in links}
    assert got[0] == "block"


def test_html_labeller_on_unseen_layouts(spark):
    texts = [f"Some words about matter {i}, and more of it." for i in range(50)]
    model = html_text.BlockLabeller()
    model.train(*html_text.labelled_layouts(texts, html_text.TRAIN_PAGES))
    held = list(zip(*html_text.labelled_layouts(texts, 100, seed=5), strict=True))
    logits = model.logits([b for b, _ in held])
    assert np.mean(np.concatenate([(z > 0) == np.array(y) for z, (_, y) in zip(logits, held, strict=True)])) > 0.97
    page = "<nav><ul><li><a href=/>Home</a></ul></nav><script>x<p>no</script><article><h1>A &amp;  B</h1><p>One\n two<p>Three</article><footer>&copy; x</footer>"
    rows = [(1, "u", page), (2, None, None), (3, "u", "")]
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    assert got == {1: ("A & B\nOne two\nThree", 19), 2: ("", 0), 3: ("", 0)}


def test_license_scan(spark):
    rows = [(1, "Some text.\nReleased under the MIT License.", "s"), (2, "This work is licensed under the GNU General Public License, version 3.", "s"), (3, "The license of the driver is under review of the general public.", "s"), (4, None, "s"), (5, "", "s"), (6, "Licensed under the Apache License, Version 2.0.", "s"), (7, "Licensed under CC BY-NC 4.0.", "s")]
    docs = _docs(spark, rows)
    got = {r.doc_id: r.families for r in license_scan.license_of(docs, license_scan.train(spark, docs)).collect()}
    assert got == {1: "MIT", 2: "GPL-3.0", 3: "unknown", 4: "unknown", 5: "unknown", 6: "Apache-2.0", 7: "CC-BY-NC"}


def test_license_held_out_notices(spark):
    """Leads and identifiers of which the model has seen others only, and rows that share an id."""
    rows = [(1, "Provided to you under the terms of the MIT License", "s"), (2, "/* SPDX-License-Identifier: GPL-3.0-or-later */", "s"), (3, "The licence is the MIT license.", "s"), (4, "Shared with all under the Mozilla Public License, version 2.0", "s")]
    rows += [(5, "nothing here", "s"), (5, "Released under the ISC License.", "s"), (5, "Released under the ISC License.", "s"), (6, "He holds a license under the law of the state.", "s"), (7, "word " * 200_000 + "\nReleased under the MIT License.", "s")]
    docs = _docs(spark, rows)
    got = sorted((r.doc_id, r.families, r.n_notices) for r in license_scan.license_of(docs, license_scan.train(spark, docs)).collect())
    assert got == [(1, "MIT", 1), (2, "GPL-3.0", 1), (3, "MIT", 1), (4, "MPL-2.0", 1), (5, "ISC", 1), (5, "ISC", 1), (5, "unknown", 0), (6, "unknown", 0), (7, "MIT", 1)]


def test_license_scan_wrapped(spark):
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell"""
    gpl = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""
    bsd = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:"""
    one = "Released under the MIT License."
    rows = [(1, f"Copyright 2020\n\n{mit}\ncopies of the Software", "s"), (2, f"Some text\n{gpl}\n", "s"), (3, f"/*\n{bsd}\n *\n{gpl}\n */", "s"), (4, f"x\n{mit}\n{bsd}\ny", "s"), (5, f"{one}\n{one}\nmore\n\n{mit}", "s"), (None, one, "s"), (6, mit.split("\n")[0] + "\n\n" + mit.split("\n")[2], "s")]
    docs = _docs(spark, rows)
    got = {r.doc_id: (r.families, r.n_notices) for r in license_scan.license_of(docs, license_scan.train(spark, docs)).collect()}
    assert got == {1: ("MIT", 1), 2: ("GPL-3.0", 1), 3: ("BSD,GPL-3.0", 2), 4: ("BSD,MIT", 2), 5: ("MIT", 3), None: ("MIT", 1), 6: ("unknown", 0)}


def test_hash_sample_is_the_head_of_the_hash_order(spark):
    from pyspark.sql import functions as F

    from drawloom.llm.common import hash_sample

    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("text"), F.lit(1).alias("hash"), F.lit(2).alias("id"), F.lit(3).alias("kept"))
    want = [r.text for r in df.where("text is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(50).collect()]
    assert [r.kept for r in hash_sample(df, "doc_id", 50, F.col("text")).collect()] == want
    assert hash_sample(df, "doc_id", 50000, F.col("text")).count() == df.where("text is not null").count()
    assert hash_sample(df.limit(0), "doc_id", 50, F.col("text")).count() == 0
