"""SQL of the registered queries that SQL can express on whole tables.

Not expressed: trained scores (1, 6, 8), the tokenizer (4) and XXH64 (9).
"""

from __future__ import annotations

from spanlens.llm.license import LEAST, SHINGLE, SLACK, TEMPLATES
from spanlens.llm.mixing import REPEATS, SEED, WEIGHTS
from spanlens.llm.quality import RULES, STOP_WORDS

WORD = r"[^\x20\x09-\x0D]+"

VECTORS = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (
  SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
links AS (
  SELECT a.r AS a, b.r AS b FROM good a JOIN good b ON a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.9),
reach AS (
  SELECT r AS a, r AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT reach.a AS r, min(vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY 1),
n AS (SELECT a AS r, count(*) AS n FROM links GROUP BY 1)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN least ON least.r = v.r LEFT JOIN n ON n.r = v.r
"""

SUBSTRINGS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
w AS (SELECT r, doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS x FROM d),
s AS (SELECT r, doc_id, i, x, CASE WHEN lead(x, 12) OVER o IS NOT NULL THEN md5(concat_ws(' ', x, {", ".join(f"lead(x, {k}) OVER o" for k in range(1, 13))})) END AS h FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
f AS (SELECT h, min(doc_id) AS first FROM s WHERE h IS NOT NULL GROUP BY 1),
m AS (SELECT s.r, i, x, CASE WHEN f.first < s.doc_id THEN 1 ELSE 0 END AS hit FROM s LEFT JOIN f ON f.h = s.h),
g AS (SELECT r, i, x, max(hit) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM m),
k AS (SELECT r, count(*) AS n, sum(gone) AS lost, string_agg(x, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM g GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(lost, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.r = d.r
"""


def rules() -> str:
    """The threshold table as a condition over the same statistics."""
    words = "greatest(n_words, 1)::DOUBLE"
    of = {
        "mean_word_chars": f"word_chars / {words}", "symbols_per_word": f"n_symbols / {words}", "repeat_word_ratio": f"n_repeat_words / {words}",
        "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)::DOUBLE",
    }
    out = []
    for r in RULES:
        x = of.get(r.measure, r.measure)
        own = [f"{x} >= {r.least}::DOUBLE"] * (r.least is not None) + [f"{x} <= {r.most}::DOUBLE"] * (r.most is not None)
        out.append(f"(({' AND '.join(own)}) OR n_words < {r.from_words})" if r.from_words else f"({' AND '.join(own)})")
    return " AND ".join(out)


STOPS = ", ".join(f"'{x}'" for w in STOP_WORDS for x in dict.fromkeys((w, w.capitalize())))
QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
w AS (SELECT r, generate_subscripts(ws, 1) AS i, unnest(ws) AS x FROM d),
s AS (SELECT r, i, x, CASE WHEN lead(x, 4) OVER o IS NOT NULL THEN concat_ws(' ', x, {", ".join(f"lead(x, {k}) OVER o" for k in range(1, 5))}) END AS h FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, x, CASE WHEN h IS NOT NULL AND count(*) OVER (PARTITION BY r, h) > 1 THEN 1 ELSE 0 END AS hit FROM s),
g AS (SELECT r, i, x, max(hit) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS again FROM c),
k AS (SELECT r, count(*) AS n, sum(length(x)) AS chars, sum(again) AS again, count(DISTINCT x) FILTER (x IN ({STOPS})) AS stops FROM g GROUP BY 1),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM d),
m AS (SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(chars, 0)::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(again, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines, coalesce(stops, 0) AS distinct_stop_words FROM d JOIN l ON l.r = d.r LEFT JOIN k ON k.r = d.r),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {rules()} AS kept, n_lines, distinct_stop_words FROM b
"""

MIXING = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size, md5(concat_ws(':', '{SEED}', doc_id::VARCHAR, text)) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS words, [{", ".join(f"{w}::DOUBLE" for w in WEIGHTS)}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT] AS weight FROM d GROUP BY 1),
r AS (
  SELECT 0 AS round, sum(words)::DOUBLE AS total, list({{'s': source, 'n': words, 'w': weight}}) AS live, false AS done FROM s
  UNION ALL
  SELECT round + 1, total - coalesce(list_sum(list_transform(over, lambda x: {REPEATS}::DOUBLE * x.n)), 0), CASE WHEN len(over) = 0 THEN live ELSE list_filter(live, lambda x: NOT (unit * x.w > {REPEATS} * x.n)) END, len(over) = 0
  FROM (SELECT *, list_filter(live, lambda x: unit * x.w > {REPEATS} * x.n) AS over FROM (SELECT *, total / list_sum(list_transform(live, lambda x: x.w)) AS unit FROM r WHERE NOT done AND len(live) > 0))),
e AS (SELECT live, total / list_sum(list_transform(live, lambda x: x.w)) AS unit FROM r ORDER BY round DESC LIMIT 1),
f AS (SELECT x.s AS source, unit * x.w AS target FROM (SELECT unnest(live) AS x, unit FROM e)),
t AS (SELECT s.source, words, coalesce(f.target, {REPEATS}::DOUBLE * words) AS target FROM s LEFT JOIN f ON f.source IS NOT DISTINCT FROM s.source),
q AS (SELECT *, least(round_even(target, 0)::BIGINT, {REPEATS} * words) AS took FROM t),
o AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id) - size AS before FROM d)
SELECT doc_id, size::BIGINT AS size, words AS source_size, target, (CASE WHEN words = 0 THEN 0 ELSE took // words * size + greatest(0, least(size, took % words - before)) END)::BIGINT AS taken
FROM o JOIN q ON q.source IS NOT DISTINCT FROM o.source
"""


def licenses() -> str:
    """Containment of the templates' shingles in windows that begin at one of them; small letters, and words of letters and digits."""
    word = r"[^\x09-\x0D\x20-/:-@\[-`{-~]+"
    low = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rows = ", ".join(f"('{k}', '{v}')" for k, v in TEMPLATES.items())
    wide = list(range(1, SHINGLE + 1))
    run = lambda k: "CASE WHEN lead(x, {0}) OVER o IS NOT NULL THEN concat_ws(' ', x{1}) END".format(k - 1, "".join(f", lead(x, {j}) OVER o" for j in range(1, k))) if k > 1 else "x"
    return f"""
WITH t(name, text) AS (VALUES {rows}),
tw AS (SELECT name, regexp_extract_all({low("text")}, '{word}') AS ws FROM t),
tk AS (SELECT name, ws, len(ws) AS size, least({SHINGLE}, len(ws)) AS k FROM tw),
ts AS (SELECT DISTINCT name, k, CASE WHEN size > k THEN ceil({SLACK}::DOUBLE * (size - k + 1)) ELSE 1 END AS wide, array_to_string(ws[i:i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, size - k + 2)) AS i FROM tk)),
tn AS (SELECT name, count(*) AS need FROM ts GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({low("coalesce(text, '')")}, '{word}') AS ws FROM documents),
w AS (SELECT r, generate_subscripts(ws, 1) AS i, unnest(ws) AS x FROM d),
s AS (SELECT r, i, {", ".join(f"{run(k)} AS s{k}" for k in wide)} FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
h AS ({" UNION ALL ".join(f"SELECT r, i, name, s, wide FROM s JOIN ts ON ts.k = {k} AND ts.s = s.s{k}" for k in wide)}),
c AS (SELECT a.r, a.name, a.i, count(DISTINCT b.s) AS n FROM h a JOIN h b ON b.r = a.r AND b.name = a.name AND b.i BETWEEN a.i AND a.i + a.wide - 1 GROUP BY 1, 2, 3),
m AS (SELECT r, c.name, max(n / need::DOUBLE) AS share FROM c JOIN tn ON tn.name = c.name GROUP BY 1, 2 HAVING max(n / need::DOUBLE) >= {LEAST}::DOUBLE),
g AS (SELECT r, string_agg(name, ',' ORDER BY name) AS licenses, max(share) AS best FROM m GROUP BY 1)
SELECT doc_id, coalesce(licenses, '') AS licenses, best AS best_containment FROM d LEFT JOIN g ON g.r = d.r
"""


ORACLES: dict[str, str] = {"op2_cover_tree": VECTORS, "op3_mixing_flow": MIXING, "op5_substring_lsm": SUBSTRINGS, "op7_license_minhash": licenses(), "op10_quality_rules": QUALITY}
