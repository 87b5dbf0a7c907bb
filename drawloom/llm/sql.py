"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 85 * (na.n + nb.n - common)),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.doc_id)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.root)::BIGINT AS component_id, d.doc_id = min(r.root) AS kept
FROM documents d JOIN reach r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

OP4 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def _op5() -> str:
    measures = {"symbol_rate": ("n_symbols", "n_words", 50), "dup_line_rate": ("n_dup_lines", "n_lines", 100), "repeat_rate": ("n_repeat_words", "n_words", 100), "upper_rate": ("n_upper", "word_chars", 50), "word_length": ("word_chars", "n_words", 500)}
    rates = ", ".join(f"CAST(floor({a} * 1000 / greatest({b}, 1)) AS BIGINT) AS {m}" for m, (a, b, _) in measures.items())
    spread = "CASE measure " + " ".join(f"WHEN '{m}' THEN {least}" for m, (_, _, least) in measures.items()) + " END"
    long = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, CAST(floor(ln(1 + {m}) * 20) AS INTEGER) AS bucket FROM r WHERE n_words > 0" for m in measures)

    def level(name: str, keys: str) -> str:
        part = f"PARTITION BY {keys}measure"
        return f"""
{name}_c AS (SELECT {keys}measure, bucket, sum(n) AS n FROM sk GROUP BY {keys}measure, bucket),
{name}_u AS (SELECT {keys}measure, bucket, sum(n) OVER ({part}) AS total, sum(n) OVER ({part} ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS upto FROM {name}_c),
{name} AS (SELECT {keys}measure, CAST(max(total) AS DOUBLE) AS n, floor(exp(min(bucket) FILTER (upto * 4 >= total) / 20.0) - 1) AS q1, floor(exp(min(bucket) FILTER (upto * 4 >= total * 3) / 20.0) - 1) AS q3 FROM {name}_u GROUP BY {keys}measure)"""

    drawn = lambda c: f"(o.n * o.{c} + 50 * ((l.n * l.{c} + 50 * a.{c}) / (l.n + 50))) / (o.n + 50)"
    inside = " AND ".join(f"coalesce(bool_and({m} <= hi AND {m} >= lo) FILTER (measure = '{m}'), false)" for m in measures)
    return rf"""
WITH w AS (SELECT *, {WORDS} AS ws, coalesce(text, '') AS t, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(t, '\p{{Lu}}'))::BIGINT AS n_upper FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
r AS (SELECT *, {rates} FROM m),
sk AS (SELECT lang, source, measure, bucket, count(*) AS n FROM ({long}) GROUP BY ALL),
{level("own", "lang, source, ")},{level("bylang", "lang, ")},{level("overall", "")},
d AS (SELECT o.lang, o.source, measure, {drawn("q1")} AS q1, {drawn("q3")} AS q3, {spread} AS least
      FROM own o JOIN bylang l USING (measure) JOIN overall a USING (measure) WHERE l.lang IS NOT DISTINCT FROM o.lang),
f AS (SELECT lang, source, measure, q3 + greatest(q3 - q1, least) * 4 AS hi, CASE WHEN measure = 'word_length' THEN q1 - greatest(q3 - q1, least) * 4 ELSE -1 END AS lo FROM d),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM r)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {inside} AS kept
FROM b LEFT JOIN f ON f.lang IS NOT DISTINCT FROM b.lang AND f.source IS NOT DISTINCT FROM b.source
GROUP BY b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed
"""


def _op12(k: int = 8, rounds: int = 10) -> str:
    """Every round is a pair of materialised tables: who is nearest, and where the centroids go."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, v, d % {k} AS cluster, d // {k} AS distance FROM (
  SELECT any_value(k.vec_id) AS vec_id, any_value(k.v) AS v, min({k} * CAST(list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) + c.c) AS d FROM kept k CROSS JOIN c{r} c GROUP BY k.row))""")
        if r < rounds:
            steps.append(f"""m{r} AS MATERIALIZED (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (
  SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY cluster, i) GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON m.cluster = c.c)""")
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS c, v FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT {k})),
{", ".join(steps)}
SELECT a.vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(a.distance AS BIGINT) AS distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.c = a.cluster
"""


def _op13() -> str:
    """Each kind's matches are marked off by two private characters; the pieces' lengths give their places."""
    kinds = [
        ("assign", "(password|passwd|secret|token|api_?key)", r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8),
        ("access", "", "AKIA[A-Z0-9]+", 16),
        ("hex", "", "[0-9a-f]+", 32),
        ("github", "", "gh[opsur]_[A-Za-z0-9]+", 40),
        ("google", "", "AIza[A-Za-z0-9_-]+", 39),
        ("slack", "", "xox[abprs]-[A-Za-z0-9-]+", 24),
        ("jwt", "", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
        ("private_key", "", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
    ]
    parts, base = [], []
    for rank, (kind, word, rest, least) in enumerate(kinds):
        pattern = f"((?i:{word[1:-1]})){rest}" if word else rest
        quoted = pattern.replace("'", "''")
        value = f"length(regexp_extract(piece[:cut - 1], '{quoted}', 2))" if word else "cut - 1"
        parts.append(f"""SELECT doc_row, {rank} AS rank, '{kind}' AS kind, before AS start, before + cut - 1 AS stop FROM (
  SELECT doc_row, piece, cut, {value} AS counted, coalesce(sum(length(piece) - (cut > 0)::INT) OVER (PARTITION BY doc_row ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
    SELECT doc_row, i, ps[i] AS piece, instr(ps[i], chr(57345)) AS cut FROM (SELECT doc_row, ps, unnest(range(1, len(ps) + 1)) AS i FROM (
      SELECT doc_row, string_split(regexp_replace(t, '{quoted}', chr(57344) || '\\0' || chr(57345), 'g'), chr(57344)) AS ps FROM d)))) WHERE cut > 0 AND counted >= {least}""")
        if rank < 3:
            base.append(kind)
    union = " UNION ALL ".join(parts)
    listed = "string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank)"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in base)
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS doc_row, doc_id, coalesce(text, '') AS t FROM documents), s AS ({union})
SELECT d.doc_id, {counts}, sha256(coalesce({listed} FILTER (rank < 3), '')) AS base_sha256, coalesce({listed}, '') AS spans
FROM d LEFT JOIN s ON s.doc_row = d.doc_row GROUP BY d.doc_row, d.doc_id
"""


ORACLES = {"op1_near_dedup": OP1, "op4_exact_topk": OP4, "op5_quality_rules": _op5(), "op12_centroids": _op12(), "op13_secrets": _op13()}
