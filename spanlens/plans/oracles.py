"""SQL counterparts of the registered queries, for an engine that shares no code with Spark."""

from __future__ import annotations

TOKEN = r"[A-Za-z]+|[0-9]|[ \t\n\r\f]+|[^A-Za-z0-9 \t\n\r\f]+"
NUMBER = r"\\frac\s*\{\s*[-+]?[0-9]+(?:\.[0-9]+)?\s*\}\s*\{\s*[-+]?[0-9]+(?:\.[0-9]+)?\s*\}|[-+]?[0-9]+(?:\.[0-9]+)?%?"


def masked(x: str) -> str:
    """The text with what a look-around would exclude overwritten, at the same length."""
    for pattern, by in ((r"([A-Za-z])[-+]", r"\1_"), (r"([A-Za-z])[0-9]", r"\1_"), (r"%([A-Za-z])", r"_\1"), (r"[0-9]([A-Za-z])", r"_\1")):
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


def numbers(source: str, keys: str, text: str) -> str:
    """(keys, num_index, start, end, value) of the numbers in a source's text column."""
    return f"""
    SELECT {keys}, num_index, start, start + length(m) AS "end", substr(t, (start + 1)::BIGINT, length(m)) AS value FROM (
      SELECT {keys}, t, m, num_index, coalesce(sum(length(g)) OVER w, 0) + coalesce(sum(length(m)) OVER (PARTITION BY {keys} ORDER BY num_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM (SELECT {keys}, t, unnest(ms) AS m, unnest(gs[:len(ms)]) AS g, generate_subscripts(ms, 1) - 1 AS num_index FROM (
        SELECT {keys}, {text} AS t, regexp_extract_all({masked(text)}, '{NUMBER}') AS ms, regexp_split_to_array({masked(text)}, '{NUMBER}') AS gs FROM {source}))
      WINDOW w AS (PARTITION BY {keys} ORDER BY num_index))"""


def tokens(source: str, keys: str) -> str:
    return f"""
    SELECT {keys}, pos, token, lag(token) OVER w AS prev, (coalesce(sum(length(token)) OVER (PARTITION BY {keys} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS char_start
    FROM (SELECT {keys}, unnest(ts) AS token, generate_subscripts(ts, 1) - 1 AS pos FROM (SELECT {keys}, regexp_extract_all(text, '{TOKEN}') AS ts FROM {source}))
    WINDOW w AS (PARTITION BY {keys} ORDER BY pos)"""


def bigrams(corpus: str, key: str) -> str:
    """Tables of the trained model."""
    return f"""
    corpus_tokens AS ({tokens(corpus, key)}),
    pair_n AS (SELECT prev, token, count(*) AS n FROM corpus_tokens WHERE prev IS NOT NULL GROUP BY ALL),
    context_n AS (SELECT prev, sum(n) AS cn FROM pair_n GROUP BY ALL),
    vocabulary AS (SELECT count(DISTINCT token) AS v FROM corpus_tokens)"""


def nll(tokens_table: str) -> str:
    return f"""
    SELECT t.*, CASE WHEN t.prev IS NOT NULL THEN -ln((coalesce(n, 0) + 0.5::DOUBLE) / (coalesce(cn, 0) + 0.5::DOUBLE * v)) END AS nll
    FROM {tokens_table} t LEFT JOIN pair_n p ON p.prev = t.prev AND p.token = t.token LEFT JOIN context_n c ON c.prev = t.prev, vocabulary"""


TALK = "talk AS (SELECT concat(conv_id, ':', turn) AS text_id, text FROM conversations)"
ROWS = "docs AS (SELECT doc_id AS row_id, lang AS type, source AS level, text AS a, translate(text, '0123456789', '1234567890') AS b FROM documents WHERE regexp_matches(text, '[0-9]'))"
PAIRS = f"""
  na AS ({numbers("docs", "row_id", "a")}), nb AS ({numbers("docs", "row_id", "b")}),
  ca AS (SELECT row_id, count(*) AS n FROM na GROUP BY 1), cb AS (SELECT row_id, count(*) AS n FROM nb GROUP BY 1),
  all_pairs AS (SELECT na.row_id, na.num_index::INT AS num_index, na.start::INT AS orig_start, na."end"::INT AS orig_end, na.value AS orig_num, nb.start::INT AS pert_start, nb."end"::INT AS pert_end,
    nb.value AS pert_num, regexp_replace(na.value, '\\s+', '', 'g') <> regexp_replace(nb.value, '\\s+', '', 'g') AS changed, ca.n <> cb.n AS count_mismatch, ca.n::INT AS orig_num_count, cb.n::INT AS pert_num_count
    FROM na JOIN nb ON na.row_id = nb.row_id AND na.num_index = nb.num_index JOIN ca ON ca.row_id = na.row_id JOIN cb ON cb.row_id = na.row_id),
  pairs AS (SELECT * FROM all_pairs WHERE changed)"""
RECORDS = f"""
  {ROWS}, {PAIRS}, {bigrams("documents", "doc_id")},
  sided AS (SELECT row_id, 'orig' AS side, 'Problem: ' || a AS text FROM docs WHERE row_id IN (SELECT row_id FROM pairs) UNION ALL SELECT row_id, 'pert', 'Problem: ' || b FROM docs WHERE row_id IN (SELECT row_id FROM pairs)),
  toks AS ({tokens("sided", "row_id, side")}),
  spans AS (SELECT row_id, num_index, 'orig' AS side, orig_start + 9 AS s, orig_end + 9 AS e FROM pairs UNION ALL SELECT row_id, num_index, 'pert', pert_start + 9, pert_end + 9 FROM pairs),
  hit AS (SELECT t.row_id, t.side, t.prev, t.token, num_index FROM toks t JOIN spans x ON t.row_id = x.row_id AND t.side = x.side AND t.char_start < x.e AND x.s < t.char_start + length(t.token)),
  cost AS ({nll("hit")}),
  by_span AS (SELECT row_id, num_index, side, sum(nll) AS s, avg(nll) AS m, count(nll) AS n FROM cost GROUP BY ALL),
  records AS (SELECT p.*, o.s AS orig_sum_nll, q.s AS pert_sum_nll, o.m AS orig_mean_nll, q.m AS pert_mean_nll, o.n::INT AS orig_num_tokens, q.n::INT AS pert_num_tokens
    FROM pairs p JOIN by_span o ON o.row_id = p.row_id AND o.num_index = p.num_index AND o.side = 'orig' JOIN by_span q ON q.row_id = p.row_id AND q.num_index = p.num_index AND q.side = 'pert'
    WHERE o.s IS NOT NULL AND q.s IS NOT NULL)"""


def context_costs(text: str, name: str) -> str:
    return f"""
    {name}_src AS (SELECT row_idx, {text} AS text FROM rows), {name}_tok AS ({tokens(f"{name}_src", "row_idx")}), {name}_nll AS ({nll(f"{name}_tok")}),
    {name} AS (SELECT r.row_idx, coalesce(sum(nll), 0) AS s, count(nll) AS n, coalesce(sum(nll), 0) / greatest(count(nll), 1) AS m FROM rows r LEFT JOIN {name}_nll x ON x.row_idx = r.row_idx GROUP BY 1)"""


def single(x: str) -> str:
    return f"CAST(CAST({x} AS FLOAT) AS DOUBLE)"


def common(x: str) -> str:
    return f"round(avg({x}), 6) AS mean, round(median({x}), 6) AS median, round(min({x}), 6) AS min, round(max({x}), 6) AS max, round(avg(CASE WHEN {x} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS frac_positive"


SAMPLE = "round(coalesce(stddev_samp(score), 0), 6) AS std, round(avg(score) FILTER (score > 0), 6) AS positive_half_mean"
EVENTS = "scores AS (SELECT event_id, event_type, -value AS orig_logp, -(value * (user_id % 7) / 3) AS sub_logp, -value - -(value * (user_id % 7) / 3) AS score FROM events)"
LIST = "list_filter(range(0, greatest(length({t}) - length({s}) + 1, 0)), lambda i: substr({t}, i + 1, length({s})) = {s})"


def found(t: str, s: str) -> str:
    return LIST.format(t=t, s=s)


MARKED = "(SELECT p_partkey, p_name, p_type, split_part(p_name, ' ', 1) AS word, concat('The **', split_part(p_name, ' ', 1), '** of ', p_name, ' in **', p_type, '**.') AS marked FROM part)"
JUDGED = """
  base AS (SELECT p_partkey AS target_id, split_part(p_name, ' ', -1) AS target, instr(p_name, split_part(p_name, ' ', -1)) - 1 + CASE WHEN p_size = 7 THEN 1 ELSE 0 END AS off, concat(p_name, ' is ', lower(p_type)) AS context,
    list_concat(string_split(lower(p_type), ' '), string_split(p_name, ' ')) AS subs, p_size <= 12 AS bare FROM part),
  rows AS (SELECT target_id, target, off, context, bare, unnest(subs) AS sub, target_id * 7 + generate_subscripts(subs, 1) - 1 AS sid FROM base),
  scored AS (SELECT *, CASE WHEN bare THEN 0.0::DOUBLE ELSE ((CASE WHEN sid % 2 = 0 THEN 0 ELSE 1 END) + (CASE WHEN sid % 3 = 0 THEN 0 ELSE 1 END)) / 3.0::DOUBLE END AS score, CASE WHEN bare THEN 0 ELSE 3 END AS num_labels,
    (length(context) - length(replace(context, target, ''))) / length(target) AS times FROM rows),
  judged AS (SELECT *, CASE WHEN substr(context, off + 1, length(target)) <> target THEN 'bad_offset' WHEN NOT regexp_full_match(target, '[A-Za-z]+') THEN 'target_not_one_word' WHEN times <> 1 THEN 'target_repeated'
    WHEN NOT regexp_full_match(sub, '[A-Za-z]+') THEN 'sub_not_one_word' WHEN lower(sub) = lower(target) THEN 'same_as_target' WHEN score < 0.5 THEN 'low_label_score' END AS reason FROM scored)"""
WORDS = """
  src AS (SELECT p_partkey AS row_idx, p_name, split_part(p_name, ' ', 1) AS w, split_part(p_name, ' ', -1) AS l, p_partkey % 3 AS kind FROM part),
  cased AS (SELECT *, CASE WHEN w = upper(w) AND w <> lower(w) THEN upper(l) WHEN left(w, 1) = upper(left(w, 1)) AND left(w, 1) <> lower(left(w, 1)) THEN concat(upper(left(i, 1)), substr(i, 2)) ELSE i END AS sub
    FROM (SELECT *, concat(upper(left(l, 1)), lower(substr(l, 2))) AS i FROM src)),
  placed AS (SELECT *, concat(p_name, '.') AS sentence, length(concat(p_name, '.')) - length(replace(concat(p_name, '.'), w, '')) AS lost FROM cased),
  built AS (SELECT row_idx, CASE WHEN kind = 2 AND lost > length(w) THEN 'target_repeated' WHEN NOT regexp_full_match(w, '[A-Za-z]+') THEN 'target_not_single_word'
      WHEN NOT regexp_full_match(sub, '[A-Za-z]+') THEN 'sub_not_single_word' WHEN lower(w) = lower(sub) THEN 'same_as_target' END AS reason,
    kind = 2 AND lost > length(w) AS nowhere, CASE kind WHEN 0 THEN concat('a ', p_name) WHEN 1 THEN concat('so ', w, ' is ', p_name) ELSE sentence END AS sentence,
    CASE kind WHEN 0 THEN 'a ' WHEN 1 THEN 'so ' ELSE '' END AS prefix, w AS target, CASE kind WHEN 0 THEN substr(p_name, length(w) + 1) WHEN 1 THEN concat(' is ', p_name) ELSE substr(sentence, length(w) + 1) END AS suffix, sub AS substitute FROM placed)"""
PLACE = ", ".join(f"CASE WHEN nowhere THEN NULL ELSE {c} END AS {c}" for c in ("sentence", "prefix", "target", "suffix"))


def word_side(side: str, word: str) -> str:
    return f"""
    {side}_src AS (SELECT row_idx, length(prefix) AS start, concat(prefix, {word}) AS text FROM built WHERE reason IS NULL), {side}_tok AS ({tokens(f"{side}_src", "row_idx")}), {side}_nll AS ({nll(f"{side}_tok")}),
    {side} AS (SELECT s.row_idx, sum(nll) AS cost, count(*)::INT AS k, min(pos) AS first FROM {side}_src s JOIN {side}_nll n ON n.row_idx = s.row_idx AND n.char_start + length(n.token) > s.start GROUP BY ALL)"""


PAIR_ROWS = "SELECT p_partkey AS idx, p_type AS type, p_brand AS level, concat('There are ', p_size, ' of ”', p_name, '”.') AS original_problem"
NO_LEVEL = "CASE WHEN p_brand <> 'Brand#2' THEN p_brand END AS level"
PROGRAMS = f"""{bigrams("(SELECT page_id, html AS text FROM pages)", "page_id")},
      r AS (SELECT page_id, page_id % 7 AS g, html AS a, replace(html, '</html>', '</main>;') AS b, CASE page_id % 7 WHEN 2 THEN '' WHEN 3 THEN '<nowhere>' WHEN 5 THEN left(html, 2) ELSE '</html>' END AS sa,
        CASE page_id % 7 WHEN 4 THEN '<' WHEN 5 THEN left(html, 2) ELSE '</main>;' END AS sb FROM pages),
      l AS (SELECT *, CASE WHEN g = 1 THEN 'missing original_buggy_program or counterfactual_buggy_program' WHEN g = 2 THEN 'missing buggy_span/original_span or counterfactual_span' END AS early,
        CASE WHEN g = 5 THEN 0 WHEN sa <> '' AND len({found("a", "sa")}) = 1 THEN instr(a, sa) - 1 END AS oa, CASE WHEN g = 5 THEN 0 WHEN len({found("b", "sb")}) = 1 THEN instr(b, sb) - 1 END AS ob FROM r),
      m AS (SELECT *, coalesce(early, CASE WHEN oa IS NULL OR ob IS NULL THEN 'could_not_locate_span' END) AS why FROM l),
      sided AS (SELECT page_id, 'o' AS side, a AS text, oa AS s, oa + length(sa) AS e FROM m WHERE why IS NULL UNION ALL SELECT page_id, 'c', b, ob, ob + length(sb) FROM m WHERE why IS NULL),
      toks AS ({tokens("sided", "page_id, side")}), hit AS (SELECT t.* FROM toks t JOIN sided x ON x.page_id = t.page_id AND x.side = t.side AND t.char_start < x.e AND x.s < t.char_start + length(t.token)), cost AS ({nll("hit")}),
      k AS (SELECT page_id, side, sum(nll) AS s, avg(nll) AS mean, count(nll)::INT AS n, string_agg(token, ' ' ORDER BY pos) FILTER (nll IS NOT NULL) AS ts FROM cost GROUP BY ALL)"""


ORACLES: dict[str, str] = {
    "extract_numbers": f"""SELECT "of", id, num_index::INT AS num_index, start::INT AS start, "end"::INT AS "end", value FROM ({numbers("(SELECT 'documents' AS of, doc_id AS id, text AS a FROM documents UNION ALL SELECT 'customer', c_custkey, c_name FROM customer)", '"of", id', "a")})""",
    "number_pairs": f"WITH {ROWS}, {PAIRS} SELECT * FROM pairs",
    "number_pair_counts": f"""WITH docs AS (SELECT doc_id AS row_id, text AS a, replace(text, '1', '') AS b FROM documents WHERE regexp_matches(text, '[0-9]')), {PAIRS}
      SELECT row_id, any_value(orig_num_count) AS orig_num_count, any_value(pert_num_count) AS pert_num_count, count(*) AS pairs, count(*) FILTER (changed) AS changed, any_value(count_mismatch) AS count_mismatch FROM all_pairs GROUP BY 1""",
    "bigram_nll": f"""WITH {TALK}, {bigrams("talk", "text_id")}, t AS ({tokens("talk", "text_id")}), s AS ({nll("t")})
      SELECT text_id, pos::INT AS pos, char_start, char_start + length(token)::INT AS char_end, token, round(nll, 6) AS nll FROM s""",
    "number_span_scores": f"""WITH {RECORDS} SELECT row_id, num_index, orig_num, pert_num, count_mismatch, orig_num_count, pert_num_count, round(orig_sum_nll, 6) AS orig_sum_nll, round(pert_sum_nll, 6) AS pert_sum_nll,
      round(orig_mean_nll, 6) AS orig_mean_nll, round(pert_mean_nll, 6) AS pert_mean_nll, orig_num_tokens, pert_num_tokens, round(pert_sum_nll - orig_sum_nll, 6) AS delta_sum_nll, round(pert_mean_nll - orig_mean_nll, 6) AS delta_mean_nll FROM records""",
    "number_report": f"""WITH {RECORDS} SELECT r.row_id AS idx, d.type, d.level, num_index, orig_num, pert_num, count_mismatch, orig_num_count, pert_num_count, round(orig_sum_nll, 6) AS orig_sum_nll, round(pert_sum_nll, 6) AS pert_sum_nll,
      round(orig_mean_nll, 6) AS orig_mean_nll, round(pert_mean_nll, 6) AS pert_mean_nll, orig_num_tokens, pert_num_tokens, round(pert_sum_nll - orig_sum_nll, 6) AS delta_sum_nll, round(pert_mean_nll - orig_mean_nll, 6) AS delta_mean_nll,
      d.a AS original_problem, d.b AS perturbed_problem FROM records r JOIN docs d ON d.row_id = r.row_id""",
    "number_delta_stats": f"""WITH {RECORDS}, x AS (SELECT coalesce(type, 'None') AS type, coalesce(level, 'None') AS level, {single("pert_sum_nll - orig_sum_nll")} AS x FROM records r JOIN docs d ON d.row_id = r.row_id)
      SELECT CASE WHEN grouping(type) = 1 AND grouping(level) = 1 THEN 'all' WHEN grouping(type) = 0 THEN 'type' ELSE 'level' END AS "grouping", coalesce(type, level) AS key, count(*) AS n, round(avg(x), 4) AS mean,
      round(quantile_disc(x, 0.5), 4) AS median, round(stddev_pop(x), 4) AS std, round(min(x), 4) AS min, round(max(x), 4) AS max, round(avg((x > 0)::INT), 4) AS frac_positive FROM x GROUP BY GROUPING SETS ((), (type), (level))""",
    "context_mean_nll": f"""WITH {TALK}, {bigrams("talk", "text_id")}, rows AS (SELECT text_id AS row_idx, coalesce(text, '') AS sentence, coalesce(replace(text, 'e ', 'a '), '') AS changed FROM talk UNION ALL SELECT concat('b', item_id), text, lower(text) FROM benchmark),
      {context_costs("sentence", "o")}, {context_costs("changed", "s")}
      SELECT o.row_idx, round(o.m, 6) AS orig_context_mean_nll, round(o.s, 6) AS orig_context_sum_nll, o.n AS orig_context_num_tokens, round(s.m, 6) AS sub_context_mean_nll, round(s.s, 6) AS sub_context_sum_nll, s.n AS sub_context_num_tokens,
      round(s.m - o.m, 6) AS context_score, round(-o.m, 6) AS orig_context_avg_logp, round(-s.m, 6) AS sub_context_avg_logp, round(s.m - o.m, 6) AS context_logp_score FROM o JOIN s ON s.row_idx = o.row_idx""",
    "stats_math": f"""WITH x AS (SELECT l_returnflag AS f, l_linestatus AS s, {single("l_extendedprice * (l_discount - 0.05::DOUBLE)")} AS x FROM lineitem)
      SELECT CASE WHEN grouping(f) = 1 AND grouping(s) = 1 THEN 'all' WHEN grouping(f) = 0 THEN 'l_returnflag' ELSE 'l_linestatus' END AS "grouping", coalesce(f, s) AS key, count(*) AS n, round(avg(x), 2) AS mean, round(quantile_disc(x, 0.5), 2) AS median,
      round(stddev_pop(x), 2) AS std, round(min(x), 2) AS min, round(max(x), 2) AS max, round(avg((x > 0)::INT), 2) AS frac_positive FROM x GROUP BY GROUPING SETS ((), (f), (s))""",
    "stats_code": f"""WITH x AS (SELECT l_returnflag, l_quantity * (l_tax - 0.04::DOUBLE) AS x FROM lineitem) SELECT l_returnflag, count(x) AS n, {common("x")}, round(stddev_pop(x), 6) AS std,
      round(avg(x) FILTER (x > 0), 6) AS positive_mean, round(median(x) FILTER (x > 0), 6) AS positive_median FROM x GROUP BY 1""",
    "stats_word": f"""WITH {EVENTS} SELECT event_type, count(score) AS n, {common("score")}, {SAMPLE}, round(avg(orig_logp), 6) AS mean_orig_logp, round(avg(sub_logp), 6) AS mean_sub_logp, round(avg(-orig_logp), 6) AS mean_orig_nll,
      round(avg(-sub_logp), 6) AS mean_sub_nll FROM scores GROUP BY 1""",
    "stats_context": f"""WITH {EVENTS} SELECT event_type, count(score) AS n, {common("score")}, {SAMPLE}, round(avg(-orig_logp), 6) AS mean_orig_context_nll, round(avg(-sub_logp), 6) AS mean_sub_context_nll FROM scores GROUP BY 1""",
    "median_any_size": "SELECT l_returnflag, round(median(l_extendedprice), 6) AS median FROM lineitem GROUP BY 1",
    "tie_ranks": "WITH c AS (SELECT l_quantity AS value, count(*) AS times FROM lineitem GROUP BY 1) SELECT value, times, (sum(times) OVER (ORDER BY value))::DOUBLE - (times - 1) / 2.0::DOUBLE AS rank FROM c",
    "auc_old_new": """WITH c AS (SELECT l_quantity AS v, count(*) FILTER (l_returnflag = 'A') AS p, count(*) FILTER (l_returnflag <> 'A') AS q FROM lineitem GROUP BY 1), d AS (SELECT *, sum(q) OVER (ORDER BY v) - q / 2.0::DOUBLE AS b FROM c)
      SELECT round(sum(p * b) / (sum(p)::DOUBLE * sum(q)::DOUBLE), 9) AS auc FROM d""",
    "cohens_d": """WITH a AS (SELECT count(l_quantity) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT count(l_quantity) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem WHERE l_returnflag <> 'A')
      SELECT round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 9) AS cohens_d FROM a, b""",
    "compare_summary": f"""WITH {EVENTS}, o AS (SELECT count(*) AS n, avg(score) AS m, median(score) AS md, avg(score) FILTER (score > 0) AS ph, var_samp(score) AS v FROM scores WHERE event_id % 2 = 0),
      w AS (SELECT count(*) AS n, avg(score) AS m, var_samp(score) AS v FROM scores WHERE event_id % 2 = 1),
      c AS (SELECT score, count(*) FILTER (event_id % 2 = 0) AS p, count(*) FILTER (event_id % 2 = 1) AS q FROM scores GROUP BY 1), d AS (SELECT *, sum(q) OVER (ORDER BY score) - q / 2.0::DOUBLE AS b FROM c),
      u AS (SELECT sum(p * b) / (sum(p)::DOUBLE * sum(q)::DOUBLE) AS auc FROM d)
      SELECT o.n AS old_n, w.n AS new_n, round(o.m, 6) AS old_mean, round(w.m, 6) AS new_mean, round(o.md, 6) AS old_median, round(o.ph, 6) AS old_positive_half_mean, round(o.m - w.m, 6) AS difference_mean_old_minus_new,
      round(auc, 6) AS auc_old_higher_than_new, round((o.m - w.m) / sqrt(((o.n - 1) * o.v + (w.n - 1) * w.v) / (o.n + w.n - 2)), 6) AS cohens_d_old_minus_new FROM o, w, u""",
    "histogram": """WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), c AS (SELECT least(floor((o_totalprice - lo) / (hi - lo) * 50), 49)::INT AS bin, count(*) AS n FROM orders, b GROUP BY 1)
      SELECT 'o_totalprice' AS series, g.i::INT AS bin, round(lo + g.i * ((hi - lo) / 50.0::DOUBLE), 4) AS low, round(lo + (g.i + 1) * ((hi - lo) / 50.0::DOUBLE), 4) AS high, coalesce(n, 0) AS value FROM b, range(50) AS g(i) LEFT JOIN c ON c.bin = g.i""",
    "histogram_density": """WITH x AS (SELECT 'orig_nll' AS series, value AS x FROM events UNION ALL SELECT 'sub_nll', value * 2 + 1 FROM events), b AS (SELECT series, min(x) AS lo, max(x) AS hi, count(*) AS n FROM x GROUP BY 1),
      c AS (SELECT x.series, least(floor((x - lo) / (hi - lo) * 20), 19)::INT AS bin, count(*) AS c FROM x JOIN b ON b.series = x.series GROUP BY ALL)
      SELECT b.series, g.i::INT AS bin, round(lo + g.i * ((hi - lo) / 20.0::DOUBLE), 6) AS low, round(lo + (g.i + 1) * ((hi - lo) / 20.0::DOUBLE), 6) AS high, round(coalesce(c, 0)::DOUBLE / (n * ((hi - lo) / 20.0::DOUBLE)), 6) AS value
      FROM b CROSS JOIN range(20) AS g(i) LEFT JOIN c ON c.bin = g.i AND c.series = b.series""",
    "axis_means": f"WITH {EVENTS} SELECT round(avg(-orig_logp), 6) AS orig_mean, round(avg(-sub_logp), 6) AS sub_mean, round(avg(-sub_logp) - avg(-orig_logp), 6) AS sub_minus_orig FROM scores",
    "locate_spans": f"""WITH p AS (SELECT page_id, html AS t, regexp_extract_all(html, '[^\n]*\n|[^\n]+') AS ls FROM pages),
      r AS (SELECT page_id, t, ls, 'start' AS hint, '<p>' AS s, NULL AS line, (instr(t, '<p>') - 1)::INT AS st, NULL::INT AS li FROM p UNION ALL SELECT page_id, t, ls, 'index', '<', NULL, 40, 1 FROM p UNION ALL SELECT page_id, t, ls, 'index_only', '>', NULL, NULL, 2 FROM p
        UNION ALL SELECT page_id, t, ls, 'line', 'a', coalesce(string_split(t, chr(10))[2], ''), NULL, NULL FROM p UNION ALL SELECT page_id, t, ls, 'unique', '</html>', NULL, NULL, NULL FROM p UNION ALL SELECT page_id, t, ls, 'repeated', '<', NULL, NULL, -1 FROM p),
      h AS (SELECT *, CASE WHEN li >= 0 AND li < len(ls) THEN coalesce(list_sum(list_transform(ls[:li], lambda x: length(x))), 0) END AS off FROM r),
      o AS (SELECT *, CASE WHEN off IS NOT NULL THEN {found("ls[li + 1]", "s")} END AS lo, CASE WHEN coalesce(line, '') <> '' AND instr(t, line) > 0 THEN {found("line", "s")} END AS xo, {found("t", "s")} AS ao, st - off AS pref FROM h),
      n AS (SELECT page_id, hint, s, CASE WHEN st >= 0 AND st <= length(t) AND substr(t, st + 1, length(s)) = s THEN st END AS a,
        off + CASE WHEN pref IS NULL THEN lo[1] ELSE list_sort(list_transform(lo, lambda x: {{'d': abs(x - pref), 'x': x}}))[1].x END AS b, instr(t, line) - 1 + xo[1] AS c, CASE WHEN len(ao) = 1 THEN ao[1] END AS d FROM o)
      SELECT page_id, hint, coalesce(a, b, c, d)::INT AS start, (coalesce(a, b, c, d) + length(s))::INT AS "end", CASE WHEN a IS NOT NULL THEN 'explicit_start_len' WHEN b IS NOT NULL THEN 'line_index_closest_span' WHEN c IS NOT NULL THEN 'line_text_closest_span'
        WHEN d IS NOT NULL THEN 'full_text_unique_span' ELSE 'not_found_or_ambiguous' END AS mode FROM n""",
    "occurrences": f"""WITH o AS (SELECT page_id, {found("html", "'<p'")} AS l FROM pages) SELECT page_id, (generate_subscripts(l, 1) - 1)::INT AS i, unnest(l)::INT AS start FROM o""",
    "line_offsets": r"""WITH l AS (SELECT doc_id, regexp_extract_all(text, '[^\n\r\v\f\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]*(?:\r\n|[\n\r\v\f\x1c\x1d\x1e\x{85}\x{2028}\x{2029}])|[^\n\r\v\f\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]+') AS ls FROM documents),
      u AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS i, length(unnest(ls)) AS n FROM l)
      SELECT doc_id, i::INT AS line_index, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start, n::INT AS size FROM u""",
    "marked_target": f"SELECT p_partkey, concat('The ', word, ' of ', p_name, ' in **', p_type, '**.') AS sentence, 'The ' AS prefix, word AS target, concat(' of ', p_name, ' in **', p_type, '**.') AS suffix FROM {MARKED}",
    "without_marks": f"SELECT p_partkey, replace(marked, '**', '') AS sentence FROM {MARKED}",
    "find_target": r"""WITH s AS (SELECT p_partkey, concat(p_name, ' or ', lower(p_type)) AS s, [split_part(p_name, ' ', 1), upper(split_part(p_type, ' ', -1)), 'e', 'zzz'] AS ts FROM part), u AS (SELECT p_partkey, s, generate_subscripts(ts, 1) - 1 AS kind, unnest(ts) AS t FROM s),
      n AS (SELECT *, (length(s) - length(replace(s, t, ''))) / length(t) AS e, len(regexp_extract_all(s, concat('(?i)\b', t, '\b'))) AS l FROM u),
      m AS (SELECT *, CASE WHEN e > 0 THEN e ELSE l END AS k, CASE WHEN e > 0 THEN instr(s, t) - 1 ELSE length(regexp_split_to_array(s, concat('(?i)\b', t, '\b'))[1]) END AS a FROM n)
      SELECT p_partkey, kind::INT AS kind, CASE WHEN k = 0 THEN 'target_not_found' WHEN k > 1 THEN 'target_repeated' END AS problem, CASE WHEN k = 1 THEN substr(s, 1, a) END AS prefix, CASE WHEN k = 1 THEN substr(s, a + 1, length(t)) END AS target,
      CASE WHEN k = 1 THEN substr(s, a + length(t) + 1) END AS suffix FROM m""",
    "match_case": f"""WITH s AS (SELECT p_partkey, lower(p_type) AS w, [upper(word), concat(upper(left(word, 1)), lower(substr(word, 2))), lower(word), 'I', 'a1'] AS rs FROM {MARKED}), u AS (SELECT p_partkey, w, generate_subscripts(rs, 1) - 1 AS kind, unnest(rs) AS r FROM s)
      SELECT p_partkey, kind::INT AS kind, CASE WHEN r = upper(r) AND r <> lower(r) THEN upper(w) WHEN left(r, 1) = upper(left(r, 1)) AND left(r, 1) <> lower(left(r, 1)) THEN concat(upper(left(w, 1)), substr(w, 2)) ELSE w END AS word FROM u""",
    "one_word": """WITH s AS (SELECT p_partkey, [concat(' ', split_part(p_name, ' ', 1), chr(9)), p_name, p_brand, ''] AS ws FROM part), u AS (SELECT p_partkey, generate_subscripts(ws, 1) - 1 AS kind, unnest(ws) AS w FROM s)
      SELECT p_partkey, kind::INT AS kind, regexp_full_match(trim(w, concat(' ', chr(9))), '[A-Za-z]+') AS ok FROM u""",
    "distinct_words": """WITH s AS (SELECT p_partkey, list_concat(string_split(p_name, ' '), string_split(upper(p_name), ' '), string_split(p_type, ' '), string_split(p_name, ' ')) AS ws FROM part),
      u AS (SELECT p_partkey, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM s), f AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, lower(w) ORDER BY i) AS k FROM u)
      SELECT p_partkey, concat('["', string_agg(w, '","' ORDER BY i), '"]') AS words FROM f WHERE k = 1 GROUP BY 1""",
    "parse_word_lists": """SELECT p_partkey, kind::INT AS kind, CASE WHEN kind < 3 THEN concat('["', replace(p_name, ' ', '","'), '"]') ELSE '[]' END AS words FROM part, range(5) AS k(kind)""",
    "label_score": """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 0.0::DOUBLE ELSE round(((CASE WHEN quality = 1 THEN 1 ELSE 0 END) + (CASE WHEN toxic = 1 THEN 1 ELSE 0 END) + 1) / 3.0::DOUBLE, 9) END AS score FROM labels""",
    "substitution_join": f"""WITH {JUDGED} SELECT target_id AS source_target_id, sid AS source_substitute_id, context AS clean_sentence, target AS target_clean, sub AS substitute, substr(context, 1, off) AS prefix, substr(context, off + length(target) + 1) AS suffix,
      off::INT AS target_offset, round(score, 6) AS label_score, num_labels::INT AS num_labels FROM judged WHERE reason IS NULL""",
    "reason_counts": f"""WITH {JUDGED} SELECT reason, count(*) AS n FROM (SELECT DISTINCT reason, target_id, 0 AS sid FROM judged WHERE reason IN ('bad_offset', 'target_not_one_word', 'target_repeated') UNION ALL
      SELECT reason, target_id, sid FROM judged WHERE reason IN ('sub_not_one_word', 'same_as_target', 'low_label_score')) GROUP BY 1""",
    "repeated_target_filter": f"""WITH s AS (SELECT p_partkey, concat(p_name, ' ', lower(p_type)) AS s, left(word, 2) AS t FROM {MARKED}) SELECT p_partkey, 1 AS n FROM s WHERE (length(s) - length(replace(s, t, ''))) / length(t) = 1""",
    "filter_marked": f"""WITH u AS (SELECT p_partkey, replace(marked, '**', '') AS c, word, generate_subscripts(string_split(p_name, ' '), 1) AS i, unnest(string_split(p_name, ' ')) AS s FROM {MARKED} WHERE regexp_full_match(word, '[A-Za-z]+')),
      f AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, lower(s) ORDER BY i) AS k FROM u WHERE regexp_full_match(s, '[A-Za-z]+') AND lower(s) <> lower(word)) SELECT p_partkey, c AS clean_sentence, word AS target_clean, s AS substitute FROM f WHERE k = 1""",
    "exact_n_sample": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(concat('42:', o_orderkey)), o_orderkey LIMIT 100",
    "early_stop": """WITH r AS (SELECT event_id AS row_idx, CASE WHEN value < 20 THEN 'low' END AS reason FROM events), k AS (SELECT row_idx FROM r WHERE reason IS NULL ORDER BY row_idx LIMIT 500), l AS (SELECT max(row_idx) AS last, count(*) AS n FROM k)
      SELECT row_idx, reason FROM r, l WHERE n < 500 OR row_idx <= last""",
    "prefix_limit": "SELECT doc_id, lang AS level FROM documents WHERE trim(lang) IN ('en', 'de') ORDER BY doc_id LIMIT 50",
    "word_examples": f"WITH {WORDS} SELECT row_idx, {PLACE}, CASE WHEN nowhere THEN concat(upper(left(split_part(p_name, ' ', -1), 1)), lower(substr(split_part(p_name, ' ', -1), 2))) ELSE substitute END AS substitute, reason FROM built JOIN part ON p_partkey = row_idx",
    "word_scores": f"""WITH {WORDS}, parts AS (SELECT p_partkey, p_name AS text FROM part), {bigrams("parts", "p_partkey")}, {word_side("o", "target")}, {word_side("s", "substitute")},
      j AS (SELECT b.*, o.cost AS oc, s.cost AS sc, o.k AS ok, s.k AS sk, o.first AS off, s.first AS sf FROM built b LEFT JOIN o ON o.row_idx = b.row_idx LEFT JOIN s ON s.row_idx = b.row_idx)
      SELECT row_idx, CASE WHEN NOT nowhere THEN concat(prefix, substitute, suffix) END AS changed_sentence, round(oc, 6) AS orig_nll, round(sc, 6) AS sub_nll, round(-oc - -sc, 6) AS score, ok AS orig_num_tokens, sk AS sub_num_tokens,
      coalesce(reason, CASE WHEN ok <> 1 THEN 'orig_not_one_token' WHEN off = 0 THEN 'orig_no_context_for_first_token' WHEN sk <> 1 THEN 'sub_not_one_token' WHEN sf = 0 THEN 'sub_no_context_for_first_token' END) AS reason FROM j""",
    "code_scores": f"""WITH {bigrams("(SELECT page_id, html AS text FROM pages)", "page_id")},
      r AS (SELECT page_id, page_id % 7 AS g, html AS a, replace(html, '</html>', '</main>;') AS b, CASE page_id % 7 WHEN 2 THEN '' WHEN 3 THEN '<nowhere>' ELSE '</html>' END AS sa, CASE WHEN page_id % 7 = 4 THEN '<' ELSE '</main>;' END AS sb FROM pages),
      l AS (SELECT *, CASE WHEN g = 1 THEN 'missing original_buggy_program or counterfactual_buggy_program' WHEN g = 2 THEN 'missing buggy_span/original_span or counterfactual_span' END AS early,
        CASE WHEN sa <> '' AND len({found("a", "sa")}) = 1 THEN instr(a, sa) - 1 END AS oa, CASE WHEN len({found("b", "sb")}) = 1 THEN instr(b, sb) - 1 END AS ob FROM r),
      m AS (SELECT *, coalesce(early, CASE WHEN oa IS NULL OR ob IS NULL THEN 'could_not_locate_span' END) AS why FROM l),
      sided AS (SELECT page_id, 'o' AS side, a AS text, oa AS s, oa + length(sa) AS e FROM m WHERE why IS NULL UNION ALL SELECT page_id, 'c', b, ob, ob + length(sb) FROM m WHERE why IS NULL),
      toks AS ({tokens("sided", "page_id, side")}), hit AS (SELECT t.* FROM toks t JOIN sided x ON x.page_id = t.page_id AND x.side = t.side AND t.char_start < x.e AND x.s < t.char_start + length(t.token)), cost AS ({nll("hit")}),
      k AS (SELECT page_id, side, sum(nll) AS s, avg(nll) AS mean, count(nll)::INT AS n FROM cost GROUP BY ALL)
      SELECT m.page_id, CASE WHEN early IS NULL THEN oa::INT END AS orig_span_start, CASE WHEN early IS NULL THEN ob::INT END AS cf_span_start, CASE WHEN early IS NOT NULL THEN NULL WHEN oa IS NULL THEN 'not_found_or_ambiguous' ELSE 'full_text_unique_span' END AS orig_loc_mode,
      round(o.s, 6) AS orig_sum_nll, round(c.s, 6) AS cf_sum_nll, round(c.s - o.s, 6) AS delta_sum_nll, round(c.mean - o.mean, 6) AS delta_mean_nll, coalesce(o.n, 0) AS orig_num_tokens, coalesce(c.n, 0) AS cf_num_tokens, coalesce(o.n <> c.n, false) AS token_count_mismatch,
      coalesce(why, CASE WHEN coalesce(o.n, 0) = 0 OR coalesce(c.n, 0) = 0 THEN 'empty_or_unscorable_span' END) AS reason FROM m LEFT JOIN k o ON o.page_id = m.page_id AND o.side = 'o' LEFT JOIN k c ON c.page_id = m.page_id AND c.side = 'c'""",
    "json_records_roundtrip": "SELECT event_id, event_type, value, CASE WHEN user_id % 3 = 0 THEN props END AS props FROM events",
    "csv_roundtrip": """SELECT p_partkey, concat('say "', p_name, '",', chr(10), p_type) AS text, CASE WHEN p_size % 2 <> 0 THEN 'x' END AS flag FROM part""",
    "ordinal_rows": "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS row_idx, n_name FROM nation",
    "span_overlap": f"""WITH t AS ({tokens("(SELECT item_id AS id, text FROM benchmark)", "id")}), s AS (SELECT item_id AS id, unnest(range(0, length(text) + 1, 50)) AS a FROM benchmark)
      SELECT t.id, s.a::INT AS span_start, pos::INT AS pos, char_start, (char_start + length(token))::INT AS char_end, token FROM t JOIN s ON s.id = t.id AND char_start < s.a + 20 AND s.a < char_start + length(token)""",
    "substitution_document": f"""WITH {JUDGED} SELECT target_id::VARCHAR AS target_id, target_id::VARCHAR AS context_id, context, target, off::INT AS "offset", 'NOUN' AS pos, sid::VARCHAR AS sid, sub AS substitute,
      CASE WHEN bare THEN '' ELSE concat(CASE WHEN sid % 2 = 0 THEN 'FALSE' ELSE 'TRUE' END, ',', CASE WHEN sid % 3 = 0 THEN 'FALSE' ELSE 'TRUE' END, ',FALSE') END AS labels FROM rows""",
    "parse_word_shapes": """WITH w AS (SELECT p_partkey, string_split(p_name, ' ')[1] AS a, coalesce(string_split(p_name, ' ')[2], 'x') AS b FROM part)
      SELECT p_partkey, kind::INT AS kind, CASE WHEN kind IN (0, 1, 3) THEN concat('["', a, '"]') WHEN kind = 2 THEN concat('["', a, b, '"]') WHEN kind = 8 THEN concat('["', a, '","', b, a, '"]') ELSE concat('["', a, '","', b, '"]') END AS words FROM w, range(9) AS k(kind)""",
    "dataset_document": f"{PAIR_ROWS}, NULL::VARCHAR AS problem, NULL::VARCHAR AS original_answer, NULL::VARCHAR AS answer FROM part",
    "dataset_lines": f"{PAIR_ROWS.replace('p_brand AS level', NO_LEVEL)}, NULL::VARCHAR AS problem, NULL::VARCHAR AS original_answer, NULL::VARCHAR AS answer FROM part",
    "snapshot_rows": f"{PAIR_ROWS} FROM part",
    "key_fallback": """SELECT p_partkey::VARCHAR AS name, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 3 THEN NULL ELSE p_type END AS span, CASE WHEN p_partkey % 4 IN (1, 2) THEN p_type END AS buggy_span,
      CASE WHEN p_partkey % 4 <> 1 THEN p_name END AS original_span, NULL::INT AS line_index FROM part""",
    "finite_values": """SELECT l_returnflag, count(*) AS n, count(x) AS n_finite, round(sum(x), 6) AS sum, round(min(x), 6) AS min, round(max(x), 6) AS max
      FROM (SELECT l_returnflag, CASE WHEN l_quantity NOT IN (1, 2, 3, 4) THEN l_quantity::DOUBLE END AS x FROM lineitem) GROUP BY 1""",
    "null_contexts": f"""WITH {TALK}, {bigrams("talk", "text_id")}, rows AS (SELECT text_id AS row_idx, CASE WHEN length(text) % 3 = 0 THEN text ELSE '' END AS sentence FROM talk), {context_costs("sentence", "o")}
      SELECT row_idx AS text_id, round(m, 6) AS mean_nll, round(s, 6) AS sum_nll, n AS num_tokens FROM o""",
    "filter_marked_lists": f"""WITH u AS (SELECT p_partkey, replace(marked, '**', '') AS c, word, generate_subscripts(l, 1) AS i, unnest(l) AS s FROM (SELECT *, list_concat(string_split(p_name, ' '), string_split(lower(p_type), ' ')) AS l FROM {MARKED}) WHERE regexp_full_match(word, '[A-Za-z]+')),
      f AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, lower(s) ORDER BY i) AS k FROM u WHERE regexp_full_match(s, '[A-Za-z]+') AND lower(s) <> lower(word))
      SELECT p_partkey, c AS clean_sentence, word AS target_clean, concat('["', string_agg(s, '","' ORDER BY i), '"]') AS acc_subs_oneword, first(s ORDER BY i) AS first_substitute, count(*)::INT AS num_oneword_subs, p_partkey AS source_row_idx FROM f WHERE k = 1 GROUP BY p_partkey, c, word""",
    "code_record_rows": f"""WITH {PROGRAMS}
      SELECT m.page_id::VARCHAR AS name, concat('v', m.page_id) AS variant_id, sa AS buggy_span, '</html>' AS fix_span, sb AS counterfactual_span, NULL::VARCHAR AS buggy_line, NULL::VARCHAR AS counterfactual_line, NULL::VARCHAR AS solution_line,
      oa::INT AS orig_span_start, (oa + length(sa))::INT AS orig_span_end, ob::INT AS cf_span_start, (ob + length(sb))::INT AS cf_span_end, 'full_text_unique_span' AS orig_loc_mode, 'full_text_unique_span' AS cf_loc_mode,
      round(o.s, 6) AS orig_sum_nll, round(c.s, 6) AS cf_sum_nll, round(c.s - o.s, 6) AS delta_sum_nll, round(o.mean, 6) AS orig_mean_nll, round(c.mean, 6) AS cf_mean_nll, round(c.mean - o.mean, 6) AS delta_mean_nll, o.n AS orig_num_tokens, c.n AS cf_num_tokens,
      o.n <> c.n AS token_count_mismatch, o.ts AS orig_tokens, c.ts AS cf_tokens, CASE WHEN m.page_id % 2 = 0 THEN 'tag' END AS mutation_type, a AS original_buggy_program, b AS counterfactual_buggy_program, NULL::VARCHAR AS solution
      FROM m JOIN k o ON o.page_id = m.page_id AND o.side = 'o' JOIN k c ON c.page_id = m.page_id AND c.side = 'c' WHERE why IS NULL AND o.n > 0 AND c.n > 0""",
    "code_skipped_rows": f"""WITH {PROGRAMS}, x AS (SELECT m.*, o.n AS osn, c.s AS cs, coalesce(why, CASE WHEN coalesce(o.n, 0) = 0 OR coalesce(c.n, 0) = 0 THEN 'empty_or_unscorable_span' END) AS reason
        FROM m LEFT JOIN k o ON o.page_id = m.page_id AND o.side = 'o' LEFT JOIN k c ON c.page_id = m.page_id AND c.side = 'c')
      SELECT page_id::VARCHAR AS name, reason, CASE WHEN early IS NOT NULL THEN NULL WHEN g = 5 THEN 'explicit_start_len' WHEN oa IS NULL THEN 'not_found_or_ambiguous' ELSE 'full_text_unique_span' END AS orig_loc_mode,
      CASE WHEN early IS NOT NULL THEN NULL WHEN g = 5 THEN 'explicit_start_len' WHEN ob IS NULL THEN 'not_found_or_ambiguous' ELSE 'full_text_unique_span' END AS cf_loc_mode,
      CASE WHEN reason = 'could_not_locate_span' THEN sa END AS orig_span, CASE WHEN reason = 'could_not_locate_span' THEN sb END AS cf_span, CASE WHEN reason = 'empty_or_unscorable_span' THEN coalesce(osn, 0) END AS orig_scored,
      CASE WHEN reason = 'empty_or_unscorable_span' THEN cs END AS cf_sum_nll FROM x WHERE reason IS NOT NULL""",
    "word_record_rows": f"""WITH {WORDS}, parts AS (SELECT p_partkey, p_name AS text FROM part), {bigrams("parts", "p_partkey")}, {word_side("o", "target")}, {word_side("s", "substitute")}
      SELECT b.row_idx, 'parts' AS dataset, sentence, concat(prefix, substitute, suffix) AS changed_sentence, prefix, suffix, target, substitute, round(-o.cost, 6) AS orig_logp, round(-s.cost, 6) AS sub_logp, round(o.cost, 6) AS orig_nll, round(s.cost, 6) AS sub_nll,
      round(-o.cost - -s.cost, 6) AS score, target AS orig_tokens, substitute AS sub_tokens, o.k AS orig_num_tokens, s.k AS sub_num_tokens FROM built b JOIN o ON o.row_idx = b.row_idx JOIN s ON s.row_idx = b.row_idx
      WHERE b.reason IS NULL AND b.row_idx % 10 < 8 AND o.k = 1 AND s.k = 1 AND o.first > 0 AND s.first > 0""",
    "missing_words": f"WITH {WORDS} SELECT CASE WHEN row_idx % 10 >= 8 THEN 'missing_target_or_substitute' ELSE reason END AS reason, count(*) AS n FROM built GROUP BY 1",
    "nested_stats": f"""WITH x AS (SELECT l_returnflag AS f, l_linestatus AS s, {single("l_quantity")} AS x FROM lineitem)
      SELECT CASE WHEN grouping(f) = 1 AND grouping(s) = 1 THEN 'all' WHEN grouping(f) = 0 THEN 'l_returnflag' ELSE 'l_linestatus' END AS "grouping", coalesce(f, s) AS key, count(*) AS n, round(avg(x), 4) AS mean, round(quantile_disc(x, 0.5), 4) AS median,
      round(stddev_pop(x), 4) AS std, round(min(x), 4) AS min, round(max(x), 4) AS max, round(avg((x > 0)::INT), 4) AS frac_positive FROM x GROUP BY GROUPING SETS ((), (f), (s))""",
    "compare_document": f"""WITH {EVENTS}, o AS (SELECT count(*) AS n, avg(score) AS m, median(score) AS md, var_samp(score) AS v FROM scores WHERE event_type = 'click'),
      w AS (SELECT count(*) AS n, avg(score) AS m, median(score) AS md, var_samp(score) AS v FROM scores WHERE event_type <> 'click'),
      c AS (SELECT score, count(*) FILTER (event_type = 'click') AS p, count(*) FILTER (event_type <> 'click') AS q FROM scores GROUP BY 1), d AS (SELECT *, sum(q) OVER (ORDER BY score) - q / 2.0::DOUBLE AS b FROM c),
      u AS (SELECT sum(p * b) / (sum(p)::DOUBLE * sum(q)::DOUBLE) AS auc FROM d)
      SELECT o.n AS old_n, w.n AS new_n, round(o.m, 6) AS old_mean, round(w.m, 6) AS new_mean, round(o.md, 6) AS old_median, round(w.md, 6) AS new_median, round(o.m - w.m, 6) AS difference_mean_old_minus_new,
      round(auc, 6) AS auc_old_higher_than_new, round((o.m - w.m) / sqrt(((o.n - 1) * o.v + (w.n - 1) * w.v) / (o.n + w.n - 2)), 6) AS cohens_d_old_minus_new FROM o, w, u""",
    "output_paths": """SELECT concat(lower(r_name), e) AS records, concat(lower(r_name), '.summary.json') AS summary, concat(lower(r_name), '.skipped.jsonl') AS skipped FROM region, (VALUES ('.jsonl'), ('.csv'), ('.json'), ('/')) AS x(e)""",
}
# A rounded negative number that comes to zero keeps its sign here, but not in Spark.
ORACLES = {name: sql.replace("round(", "0.0::DOUBLE + round(") for name, sql in ORACLES.items()}
