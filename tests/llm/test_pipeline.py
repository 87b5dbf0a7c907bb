"""The stages of the pipeline on a small corpus, each against a plain version on its own input, and the whole run."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from test_operators import WORDS, _components
from tokenizers import Tokenizer

import corpus_pipeline
from drawloom.llm.queries import WORD_TOKENIZER

TOXIC = "vile"


def _rows():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(900)]
    rows = []
    for i in range(260):
        words = rng.choices(vocab, k=rng.randint(60, 160))
        if i % 5 == 0:
            words[3] = TOXIC
        if i % 13 == 1:
            words = ["again", "and", "again"] * 30
        if i % 17 == 2:
            words = words[:20]
        rows.append((i, " ".join(words), "en", f"s{i % 3}" if i % 11 else None, len(words)))
    for i in range(0, 60, 4):
        words = rows[i + 2][1].split()
        words[len(words) // 2] = "changed"
        rows.append((1000 + i, " ".join(words), "en", "s1", len(words)))
    return [*rows, (2000, None, None, "s0", 0), (2001, "", "en", None, 0)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = _rows()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(TOXIC in t.split())) for i, t, *_ in rows if t]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_and_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for _, function in corpus_pipeline.STAGES:
        out = corpus_pipeline.stage(function(spark, docs, folder))
        seen.append((docs, out))
        docs = out
    names = [n for n, _ in corpus_pipeline.STAGES]
    steps = {n: ([tuple(r) for r in a.collect()], [tuple(r) for r in b.collect()]) for n, (a, b) in zip(names, seen, strict=True)}
    assert all(b.columns == a.columns for a, b in seen[:-1])

    before, after = steps["toxicity"]
    assert sorted(after, key=str) == sorted((r for r in before if TOXIC not in (r[1] or "").split()), key=str)

    before, after = steps["quality"]
    base = {r[0] for r in before if len(WORDS.findall(r[1] or "")) >= 50 and "again" not in (r[1] or "")}
    kept = {r[0] for r in after}
    assert kept <= base and len(kept) >= 0.9 * len(base)

    before, after = steps["near_dedup"]
    plain = _components([(r[0], r[1], r[3]) for r in before], 5, 80, 100)
    assert sorted(r[0] for r in after) == sorted(i for i, (_, _, first) in plain.items() if first)
    assert len(after) < len(before)

    before, after = steps["mixing"]
    times = Counter(after)
    assert set(times) <= set(before) and max(times.values()) <= 2
    assert abs(sum(len(r[1].split()) for r in after) / sum(len(r[1].split()) for r in before) - 1.5) < 0.05

    before, after = steps["packing"]
    tok = Tokenizer.from_file(WORD_TOKENIZER)
    want = Counter()
    for i, text, *_ in before:
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    at = {c: seen[-1][1].columns.index(c) for c in ("doc_id", "length", "ids_crc32", "sequence_id", "offset")}
    assert Counter((r[at["doc_id"]], r[at["length"]], r[at["ids_crc32"]]) for r in after) == want
    filled = {}
    for r in sorted(after, key=lambda r: r[at["offset"]]):
        assert r[at["offset"]] == filled.get(r[at["sequence_id"]], 0)
        filled[r[at["sequence_id"]]] = r[at["offset"]] + r[at["length"]]
    assert max(filled.values()) <= 2048

    whole = Counter((r.doc_id, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect())
    assert whole == want
