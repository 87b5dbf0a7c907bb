"""The combined automaton against Python's regular expressions, and what it refuses."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import DOCS

from drawloom.llm import secrets

BITS = ["secret", "token", "api_key", "apikey", "ApiKey", "passwd", "PassWord", "pass", "pas", "AKIA", "AK", "ghp_", "eyJ", ".", "=", ":", " ", "  ", '"', "'", "a1b2c3d4", "deadbeef0123", "Z9", "é", "\n"]
BITS += ["-----BEGIN ", "RSA PRIVATE KEY-----", "PRIVATE KEY-----", "xoxb-", "AIza", "_", "-", "/", "+", "0123456789abcdef", "ſ", "K", "0", "f", "A", "漢字", "\x00"]


def plain(text, rules=secrets.RULES):
    out = []
    for k, rule in enumerate(rules):
        out += [(m.start(), m.end(), k) for m in re.finditer(rule.pattern, text) if len(m.group(rule.group)) >= rule.least]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_spans_equal_regular_expressions():
    rng = random.Random(7)
    texts = ["".join(rng.choices(BITS, k=rng.randint(0, 60))) for _ in range(6000)]
    texts += ["eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmN", "secret=token: abcdefghij", "token = =abcdefgh", "api_key:'x'", "AKIAAKIAAKIAAKIA1", "f" * 31 + " " + "f" * 32, "password" * 50 + "=12345678", "tokensecret:" + "q" * 9, "-" * 9 + "BEGIN EC PRIVATE KEY-----"]
    got = list(secrets.batch_spans(pa.array(texts), secrets.automaton(secrets.RULES)))
    assert got == [plain(t) for t in texts]
    assert all(any(k == r for s in got for _, _, k in s) for r in range(len(secrets.RULES)))


def test_long_texts_and_long_runs():
    text = "z" * 300_000 + " token=" + "y" * 300_000 + " é " * 200_000 + "0" * 500_000 + "\n" + "or the thing " * 50_000 + "AKIA" + "Q" * 20
    machine = secrets.automaton(secrets.RULES)
    assert list(secrets.batch_spans(pa.array([text, None, "", text]), machine)) == [plain(text), [], [], plain(text)]


def test_the_automaton_is_minimal_and_refuses_what_it_cannot_follow():
    rules = (secrets.Rule("a", "x[ab]+"), secrets.Rule("b", "(xa|xb)c*", 0, 2))
    machine = secrets.automaton(rules)
    assert len(machine.table) < machine.subsets
    rows = {(int(o), *r) for o, r in zip(machine.output, machine.table.tolist(), strict=True)}
    assert len(rows) == len(machine.table)  # no two states alike
    texts = ["xabxbcc xxac", "xa", "ab xbb c", "xaxbxc"]
    assert list(secrets.batch_spans(pa.array(texts), machine)) == [plain(t, rules) for t in texts]
    with pytest.raises(ValueError, match="go on"):
        secrets.RuleAutomaton((secrets.Rule("a", "a(bc)*"),))
    with pytest.raises(ValueError, match="within"):
        secrets.RuleAutomaton((secrets.Rule("a", "abcd|bc"),))
    for bad in ("a^", "(a", "a*", "é", r"\d", "a)"):
        with pytest.raises(ValueError):
            secrets.RuleAutomaton((secrets.Rule("a", bad),))


def test_expressions_equal_the_engine_on_all_short_texts():
    for pattern in ("a", "ab?a", "[ab]{2,3}", "(a|bb)+", "a{2,}b", "b(a|ab){0,2}a", r"\x61[^]?".replace("[^]?", "b?")):
        for tree, turn in ((secrets.parsed(pattern), 1), (secrets.reversed_tree(secrets.parsed(pattern)), -1)):
            places = secrets.Positions(tree)
            for size in range(1, 7):
                for number in range(2**size):
                    text = "".join("ab"[number >> i & 1] for i in range(size))
                    state = places.begin(ord(text[0]))
                    for c in text[1:]:
                        state = places.step(state, ord(c))
                    assert bool(state & places.last) == bool(re.fullmatch(pattern, text[::turn]))


def test_operator_and_query_columns(spark):
    token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = [(1, f'é token = "{token}" x', "s"), (1, f'é token = "{token}" x', "s"), (2, None, None), (3, "", "s"), (None, "AKIA" + "B" * 12 + " clean words", "t")]
    docs = spark.createDataFrame([(i, t, "en", s, 0, 1, 2, 3, 4, 5) for i, t, s in rows], DOCS).withColumn("secret_spans", F.lit(1)).withColumn("kind", F.lit("k")).withColumn("start", F.lit(2))
    out = secrets.secret_spans(docs)
    assert out.columns == docs.columns and out.count() == 5 and secrets.secret_spans(docs.limit(0)).count() == 0
    got = {r.doc_id: r for r in out.withColumn("clean", secrets.masked(F.col("text"), F.col("secret_spans"))).collect()}
    assert [tuple(s) for s in got[1].secret_spans] == [("assign", 2, 51), ("hex", 11, 51)] and got[1].clean == 'é [assign]" x'
    assert got[2].secret_spans == got[3].secret_spans == [] and got[2].clean == "" and got[None].clean == "[access] clean words"


def test_query_digests(spark, tmp_path):
    from drawloom.llm import queries

    text = f"secret: {'a1' * 20}, AKIA{'C' * 14}, ghp_{'x' * 36}"
    spark.createDataFrame([(5, text), (6, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    r = {r.doc_id: r for r in queries.op13_secrets(spark, str(tmp_path)).collect()}
    spans = plain(text)
    names = [f"{secrets.RULES[k].kind}:{s}:{e}" for s, e, k in spans]
    base = [n for n, (_, _, k) in zip(names, spans, strict=True) if k < 3]
    assert r[5].spans == ",".join(names) and r[5].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and len(names) == 4
    assert (r[5].n_assign, r[5].n_access, r[5].n_hex) == (1, 1, 1) and (r[6].spans, r[6].n_hex) == ("", 0)
    assert r[6].base_sha256 == hashlib.sha256(b"").hexdigest() and np.all([r[i].n_access is not None for i in r])
