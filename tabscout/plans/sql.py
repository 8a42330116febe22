"""The queries of this package in DuckDB's SQL."""

from __future__ import annotations

from tabscout import constants as C

_LINE = r"'[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+'"
_LINES = f"regexp_extract_all(coalesce(text, ''), {_LINE})"
_BARE = f"list_transform({_LINES}, lambda l: regexp_replace(l, '[\\r\\n]+$', ''))"
_DATE, _DECIMAL, _LABEL = C.DATE, C.DECIMAL, C.TOTALS_LABEL


def _shape(v: str) -> str:
    return f"CASE WHEN trim({v}) = '' THEN 'empty' WHEN regexp_full_match(trim({v}), '[+-]?\\d+') THEN 'integer' WHEN regexp_full_match(trim({v}), '{_DATE}') THEN 'date' WHEN regexp_full_match(trim({v}), '{_DECIMAL}') THEN 'decimal' ELSE 'text' END"


_ORDER_FIELDS = """o AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS a, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority END AS b, strftime(o_orderdate, '%Y-%m-%d') AS c,
CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) AS d, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%d.%m.%Y') ELSE o_orderstatus END AS e FROM orders)"""

_SCORES = f"""lines AS (SELECT doc_id, {_BARE} AS l FROM documents),
x AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM lines),
y AS (SELECT doc_id, d, len(string_split(regexp_replace(line, '(^|' || regexp_escape(d) || ')"(?:[^"]|"")*(?:"[^' || d || ']*|$)', '\\1', 'g'), d)) AS w, i FROM x, (SELECT unnest([',', ';', chr(9), '|']) AS d)),
z AS (SELECT doc_id, d, w, count(*) AS n, min(i) AS pos FROM y WHERE w > 1 GROUP BY doc_id, d, w),
m AS (SELECT doc_id, d, n, w FROM z QUALIFY row_number() OVER (PARTITION BY doc_id, d ORDER BY n DESC, pos) = 1),
s AS (SELECT k.doc_id, k.d, coalesce(m.n, 0) AS n, coalesce(m.w, 1) AS w FROM (SELECT doc_id, d FROM lines, (SELECT unnest([',', ';', chr(9), '|']) AS d)) k LEFT JOIN m USING (doc_id, d))"""

_NATION = "n AS (SELECT c_nationkey, [',', ';', chr(9), '|'][c_nationkey % 4 + 1] AS d, count(*) AS n FROM customer GROUP BY c_nationkey)"

_RUN = """r AS (SELECT 'f' || CAST(user_id % 60 AS VARCHAR) AS fixture, event_type AS category, event_id AS repeat, user_id % 60 >= 55 AS known, event_id AS i, value, hour(ts) < 12 AS early,
  CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'ModelTimeoutError: status ' ELSE 'ModelInvocationError: status ' END || ['429', '503', '500'][event_id % 3 + 1] END AS error FROM events),
fd AS (SELECT * FROM (VALUES ('delimiter', 5, 2), ('columns', 7, 10), ('footer_lines', 2, 8)) t(field, m, o)),
c AS (SELECT r.*, fd.field, fd.o, r.i % fd.m <> 0 AS hit FROM r, fd)"""
_VOTES = "v AS (SELECT fixture, repeat, field, o, CASE WHEN error IS NOT NULL THEN '<error>' WHEN hit THEN '<match>' ELSE CAST(i % 3 AS VARCHAR) END AS answer FROM {0})"
_STATS = """a AS (SELECT fixture, field, o, answer, count(*) AS n FROM v GROUP BY ALL),
st AS (SELECT fixture, field, o, CAST(sum(n) AS BIGINT) AS n_votes, CAST(sum(CASE WHEN answer = '<match>' THEN n ELSE 0 END) AS BIGINT) AS n_match, max(n) AS top, count(*) AS n_answers FROM a GROUP BY ALL)"""
_VERDICTS = """f AS (SELECT fixture, bool_and(error IS NOT NULL) AS failed FROM {0} GROUP BY fixture),
vd AS (SELECT f.fixture, CASE WHEN f.failed THEN 'error' WHEN count(st.field) = 0 THEN 'unscored' WHEN bool_and(st.n_match * 2 > st.n_votes) THEN 'pass'
  ELSE 'fail: ' || string_agg(st.field, ', ' ORDER BY st.o) FILTER (WHERE st.n_match * 2 <= st.n_votes) END AS verdict, coalesce(bool_or(st.n_answers > 1), false) AS disagrees
  FROM f LEFT JOIN st USING (fixture) GROUP BY f.fixture, f.failed)"""


def _verdicts(condition: str, tag: str) -> str:
    own = (_VOTES.format(f"(SELECT * FROM c WHERE {condition})") + ", " + _STATS + ", " + _VERDICTS.format(f"(SELECT * FROM r WHERE {condition})"))
    return f"{tag} AS (WITH {own} SELECT * FROM vd)"


SQL = {
    "inspect_rendered": f"WITH {_NATION} SELECT CAST(c_nationkey AS BIGINT) AS nation, d AS delimiter, '\"' AS quotechar, true AS has_header, CAST(2 AS BIGINT) AS header_row_index, 'custkey,name,balance,segment' AS columns, CAST(2 AS BIGINT) AS footer_rows_to_skip, 'utf-8' AS encoding, CAST(NULL AS VARCHAR) AS error FROM n",
    "ground_wrong_answers": f"WITH {_NATION} SELECT CAST(c_nationkey AS BIGINT) AS nation, d AS delimiter, CAST(2 AS BIGINT) AS header_row_index, 'custkey,name,balance,segment' AS columns, chr(10) || 'TOTAL' || d || d || CAST(n AS VARCHAR) || d AS footer, 'delimiter,header_row_index,columns' AS changed FROM n",
    "headerless_detect": "SELECT CAST(c_nationkey AS BIGINT) AS nation, false AS has_header, CAST(NULL AS BIGINT) AS header_row_index, 'column_1,column_2,column_3,column_4' AS columns FROM customer GROUP BY c_nationkey HAVING count(*) > 1",
    "inspect_roundtrip_read": "SELECT c_custkey AS custkey, c_name AS name, CAST(CAST(c_acctbal AS DECIMAL(18, 2)) AS VARCHAR) AS balance, c_mktsegment AS segment FROM customer",
    "compare_results": "SELECT field, verdict, (SELECT count(DISTINCT c_nationkey) FROM customer) AS n FROM (VALUES ('encoding', 'matched'), ('delimiter', 'matched'), ('quotechar', 'matched'), ('escapechar', 'matched'), ('doublequote', 'skipped'), ('has_header', 'matched'), ('header_row_index', 'matched'), ('footer_lines', 'matched'), ('footer_rows_to_skip', 'matched'), ('columns', 'matched')) t(field, verdict)",
    "line_count": f"SELECT doc_id, CAST(len({_LINES}) AS BIGINT) AS n_lines FROM documents",
    "line_bounds": f"WITH l AS (SELECT doc_id, text, {_LINES} AS l FROM documents) SELECT doc_id, md5(CASE WHEN len(l) <= 25 THEN text ELSE array_to_string(l[1:15], '') END) AS head_md5, md5(CASE WHEN len(l) <= 25 THEN '-' ELSE array_to_string(l[len(l) - 9:len(l)], '') END) AS tail_md5, CAST(greatest(len(l) - 25, 0) AS BIGINT) AS lines_omitted FROM l",
    "trim_to_last_break": r"SELECT doc_id, CAST(length(CASE WHEN regexp_matches(text, '[\r\n]') THEN regexp_replace(text, '[^\r\n]+\z', '') ELSE text END) AS BIGINT) AS n_chars_kept FROM documents",
    "byte_windows": "WITH s AS (SELECT doc_id, octet_length(encode(text)) AS size FROM documents) SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(least(size, 4096) AS BIGINT) AS head_bytes, CAST(least(greatest(size - 4096, 0), 4096) AS BIGINT) AS tail_bytes, true AS covers_whole_file, 'utf-8' AS encoding FROM s",
    "encoding_canonical": "SELECT * FROM (VALUES ('UTF8', 'utf-8', 1::BIGINT), ('utf-8', 'utf-8', 1), ('latin-1', 'iso8859-1', 1), ('ISO-8859-1', 'iso8859-1', 1), ('cp1252', 'cp1252', 1), ('windows-1252', 'cp1252', 1), ('UTF-16', 'utf-16', 2), ('utf_16_le', 'utf-16-le', 2), ('ascii', 'ascii', 1), ('US-ASCII', 'ascii', 1), ('utf-8-sig', 'utf-8-sig', 1), ('no such codec', NULL, 1)) t(label, codec, unit)",
    "tail_alignment": "WITH t AS (SELECT doc_id, least(4095, greatest(n_chars - 4096, 0)) AS w, CASE doc_id % 3 WHEN 2 THEN 4 ELSE doc_id % 3 + 1 END AS u FROM documents) SELECT doc_id, CAST(w - w % u AS BIGINT) AS window FROM t",
    "utf8_suffix": """WITH d AS (SELECT doc_id, octet_length(encode(text)) AS n, hex(encode(text)) AS h FROM documents), b AS (SELECT doc_id, h, unnest(range(0, n, 1000)) AS at FROM d)
SELECT d.doc_id, CAST(count(b.at) AS BIGINT) AS n_blocks, CAST(count(*) FILTER (WHERE b.at IS NOT NULL AND substr(b.h, 2 * (b.at + 1000) + 1, 1) NOT IN ('8', '9', 'A', 'B')) AS BIGINT) AS n_suffixes FROM d LEFT JOIN b USING (doc_id) GROUP BY d.doc_id""",
    "delimiter_scores": f"WITH {_SCORES} SELECT doc_id, d AS delimiter, CAST(n AS BIGINT) AS agreeing, CAST(w AS BIGINT) AS width FROM s",
    "delimiter_choice": f"""WITH {_SCORES}, o AS (SELECT doc_id, max(CASE WHEN d = ';' THEN n END) AS own, max(CASE WHEN d <> ';' THEN n END) AS best FROM s GROUP BY doc_id),
p AS (SELECT o.*, (SELECT count(*) FROM s WHERE s.doc_id = o.doc_id AND s.d <> ';' AND s.n = o.best) AS winners, (SELECT min(s.d) FROM s WHERE s.doc_id = o.doc_id AND s.d <> ';' AND s.n = o.best) AS winner FROM o)
SELECT p.doc_id, CASE WHEN best >= greatest(2, 1.5 * own) AND winners = 1 THEN winner WHEN NOT contains(d.text, ';') THEN ',' ELSE ';' END AS delimiter FROM p JOIN documents d USING (doc_id)""",
    "split_fields_rfc4180": "SELECT c_custkey, CAST(4 AS BIGINT) AS n, 'say \"' || c_name || '\"' AS f1, c_mktsegment || ', etc.' AS f2, '' AS f3 FROM customer",
    "delimited_lines": f"WITH l AS (SELECT doc_id, unnest({_BARE}) AS line FROM documents) SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN line = '' THEN 0 ELSE len(string_split(line, '|')) END) AS BIGINT) AS n_fields FROM l GROUP BY doc_id",
    "field_shapes": f"WITH {_ORDER_FIELDS}, u AS (SELECT * FROM (UNPIVOT o ON a, b, c, d, e INTO NAME field VALUE value)) SELECT field, {_shape('value')} AS shape, count(*) AS n FROM u GROUP BY ALL",
    "rows_look_alike": f"""WITH {_ORDER_FIELDS}, s AS (SELECT o_orderkey, list_transform([a, b, c, d, e], lambda v: {_shape('v')}) AS f FROM o),
p AS (SELECT o_orderkey, f, lead(f) OVER (PARTITION BY o_orderkey // 64 ORDER BY o_orderkey) AS g FROM s)
SELECT o_orderkey, f = g OR (len(list_filter(range(1, 6), lambda i: f[i] <> g[i] AND f[i] <> 'empty' AND g[i] <> 'empty')) = 0 AND len(list_filter(f, lambda v: v <> 'text')) >= 3 AND len(list_filter(g, lambda v: v <> 'text')) >= 3) AS alike FROM p WHERE g IS NOT NULL""",
    "positional_names": "SELECT n_nationkey, coalesce(array_to_string(list_transform(range(1, n_nationkey % 5 + 1), lambda i: 'column_' || CAST(i AS VARCHAR)), ','), '') AS names FROM nation",
    "totals_labels": f"""WITH t AS (SELECT p_partkey, p_type, CASE WHEN p_partkey % 9 = 0 THEN p_name ELSE ['', 'sub', 'Sub-', 'GRAND ', 'sub - ', chr(39)][p_partkey % 6 + 1] || ['total', 'Totals', 'suma', 'SUM', 'totales', 'net', 'summit'][p_partkey // 6 % 7 + 1]
  || ['', ':', ' general', 'd', ' :', ';'][p_partkey // 42 % 6 + 1] END AS label FROM part)
SELECT p_partkey, regexp_matches(label || ';' || p_type, '(?i)^["'']?\\s*{_LABEL}\\b') AS labelled, regexp_full_match(label, '(?i){_LABEL}(?:\\s+general)?\\s*:?') AS bare FROM t""",
    "quote_evidence": r"""SELECT page_id, contains(html, '\"') AS backslashed, regexp_matches(html, '[^ "\\\r\n]""') AS doubled, regexp_matches(html, '(?m)(?:^| )"[^"\r\n]+"(?: |\r|$)') AS quoted FROM pages""",
    "json_payload": "SELECT event_id, props AS payload, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "dialect_slips": "SELECT * FROM (VALUES (0::BIGINT, chr(9), chr(9), chr(9)), (1, chr(9), chr(9), chr(9)), (2, chr(9), chr(9), chr(9)), (3, ',', ',', ','), (4, ',', chr(10), NULL), (5, 'null', '\"', NULL), (6, 'none', '\"', NULL), (7, '', '\"', NULL), (8, ' ', '\"', NULL), (9, '''', '''', ''''), (10, NULL, '\"', NULL)) t(n, delimiter, quotechar, escapechar)",
    "answer_rule_violations": """WITH a AS (SELECT event_id AS i, CASE WHEN event_id % 5 = 0 THEN ';;' ELSE ',' END AS d, CASE WHEN event_id % 7 = 0 THEN ',' ELSE '"' END AS q, CASE WHEN event_id % 11 = 0 THEN '"' END AS e,
event_id % 2 = 0 AS h, CASE WHEN event_id % 4 = 0 THEN 0 WHEN event_id % 13 = 0 THEN -1 END AS x, value / 100 AS c FROM events)
SELECT i AS event_id, concat_ws(',', CASE WHEN i % 17 = 0 THEN 'columns' END, CASE WHEN NOT coalesce(c BETWEEN 0 AND 1, false) THEN 'confidence_range' END, CASE WHEN length(d) <> 1 THEN 'delimiter_character' END, CASE WHEN d = q OR d IS NOT DISTINCT FROM e THEN 'delimiter_taken' END,
CASE WHEN e = q THEN 'escapechar_taken' END, CASE WHEN h <> (x IS NOT NULL) THEN 'header_index' END, CASE WHEN x < 0 THEN 'header_negative' END) AS broken FROM a""",
    "answers_parsed": """WITH a AS (SELECT event_id AS i, event_id % 10 = 9 AS cut, event_id % 120 AS c FROM events), b AS (SELECT *, NOT cut AND c <= 100 AS ok FROM a)
SELECT i AS event_id, CASE WHEN ok THEN CASE WHEN i % 3 = 0 THEN chr(9) ELSE ';' END END AS delimiter, CASE WHEN ok THEN CAST(CASE WHEN i % 4 = 0 THEN 0 ELSE i % 3 END AS BIGINT) END AS header_row_index, CASE WHEN ok THEN 'a|b' END AS columns,
CASE WHEN ok THEN CASE WHEN c > 1 THEN c / 100 ELSE CAST(c AS DOUBLE) END END AS confidence, CASE WHEN cut THEN 'ResponseParsingError' WHEN NOT ok THEN 'SchemaValidationError' END AS error FROM b""",
    "prompt_sizes": "WITH p AS (SELECT doc_id, length(text) AS n, greatest(448, 32 + 20 * (doc_id % 60)) AS reply FROM documents), q AS (SELECT *, ceil(n / 1.81::DOUBLE) + reply AS need FROM p) SELECT doc_id, CAST(round_even(n / 1.81::DOUBLE, 0) AS BIGINT) AS tokens, CAST(reply AS BIGINT) AS reply, CAST(CASE WHEN need <= 8192 THEN 8192 WHEN need <= 16384 THEN 16384 ELSE 32768 END AS BIGINT) AS context FROM q",
    "dry_run_total": "SELECT count(*) AS files, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(CAST(round_even(length(text) / 1.81::DOUBLE, 0) AS BIGINT)) AS BIGINT) AS tokens FROM documents",
    "usage_tally": "SELECT l_orderkey, CAST(sum(CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity AS BIGINT) END) AS BIGINT) AS tokens, count(*) AS attempts, count(*) FILTER (WHERE l_linenumber > 1) AS retries FROM lineitem GROUP BY l_orderkey",
    "call_budget_prefix": "SELECT c_custkey, used FROM (SELECT c_custkey, CAST(sum((c_nationkey % 2 + 1) * 2) OVER (ORDER BY c_custkey) AS BIGINT) AS used FROM customer) WHERE used <= 1000",
    "rate_window": "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS n_recent FROM events",
    "eval_scores_by": f"WITH {_RUN}, t AS (SELECT fixture, category, repeat, sum(hit::INT) / 3 AS score FROM c WHERE error IS NULL AND NOT known GROUP BY ALL) SELECT coalesce(category, '*') AS category, coalesce(fixture, '*') AS fixture, count(*) AS n, round(avg(score), 6) AS score FROM t GROUP BY GROUPING SETS ((), (category), (fixture))",
    "eval_field_scores": f"WITH {_RUN} SELECT field, round(avg(hit::INT), 6) AS score FROM c WHERE error IS NULL AND NOT known GROUP BY field",
    "eval_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS slowest FROM events GROUP BY event_type",
    "eval_votes": f"WITH {_RUN}, {_VOTES.format('c')}, {_STATS} SELECT fixture, field, n_votes, n_match, n_match * 2 > n_votes AS majority, round(top / n_votes, 6) AS agreement, n_answers FROM st",
    "eval_verdicts": f"WITH {_RUN}, {_VOTES.format('c')}, {_STATS}, {_VERDICTS.format('r')} SELECT fixture, verdict, disagrees FROM vd",
    "eval_verdict_changes": "WITH " + _RUN + ", " + _verdicts("early", "b1") + ", " + _verdicts("NOT early", "b2") + " SELECT fixture, coalesce(b1.verdict, 'not run') AS before, coalesce(b2.verdict, 'not run') AS after FROM b1 FULL JOIN b2 USING (fixture) WHERE coalesce(b1.verdict, 'not run') <> coalesce(b2.verdict, 'not run')",
    "eval_error_classes": f"WITH {_RUN} SELECT split_part(error, ':', 1) AS class, regexp_extract(error, '\\b(429|503)\\b', 1) AS status, count(*) AS n FROM r WHERE error IS NOT NULL GROUP BY ALL",
    "column_recall": """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS fixture, string_split(text, ' ') AS e, list_filter(string_split(text, ' '), lambda v, i: (i - 1) % 3 <> 1) AS a FROM documents),
x AS (SELECT fixture, trim(u, ' ' || chr(10)) AS name, count(*) AS n FROM (SELECT fixture, unnest(e) AS u FROM d) GROUP BY ALL), y AS (SELECT fixture, trim(u, ' ' || chr(10)) AS name, count(*) AS n FROM (SELECT fixture, unnest(a) AS u FROM d) GROUP BY ALL),
s AS (SELECT fixture, sum(least(x.n, y.n)) AS shared FROM x JOIN y USING (fixture, name) GROUP BY fixture)
SELECT fixture, round(coalesce(s.shared, 0) / len(d.e), 6) AS columns_recall, len(d.e) = len(d.a) AS columns_count_match FROM d LEFT JOIN s USING (fixture)""",
    "select_fixtures": "SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') AS fixture, lang AS category FROM documents WHERE lang IN ('de', 'fr') ORDER BY 1 LIMIT 25",
    "unknown_names_anti": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "held_fixtures_semi": "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "replay_join": "SELECT conv_id, role AS model, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k, md5(text) AS text_md5 FROM conversations",
    "metrics_pivot": """WITH e AS (SELECT event_type AS t, count(*) AS n, count(DISTINCT user_id) AS u, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY 1),
m AS (SELECT t, 'lines' AS metric, format('{:,}', n) AS value FROM e UNION ALL SELECT t, 'fixtures', format('{:,}', u) FROM e UNION ALL SELECT t, 'latency p50', printf('%.2f s', p50) FROM e UNION ALL SELECT t, 'latency p95', printf('%.2f s', p95) FROM e
UNION ALL SELECT a.t, 'category: ' || b.t, CASE WHEN a.t = b.t THEN printf('%.1f %%', 100 * a.n / 1e6) ELSE 'n/a' END FROM e a, e b
UNION ALL SELECT t, unnest(['aggregate score', 'majority score', 'columns recall', 'columns count match', 'errored lines', 'known limitation lines', 'prompt tokens (mean)', 'completion tokens (mean)', 'load max', 'calls', 'fallback used', 'retries', 'HTTP 429']), 'n/a' FROM e)
SELECT metric, """ + ", ".join(f"max(value) FILTER (WHERE t = '{k}') AS {k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM m GROUP BY metric",
    "repeat_statistics": f"WITH {_RUN}, {_VOTES.format('c')}, {_STATS}, {_VERDICTS.format('r')}, own AS (SELECT st.* FROM st JOIN vd USING (fixture) WHERE vd.verdict NOT IN ('error', 'unscored') AND CAST(substr(fixture, 2) AS INT) < 55) SELECT field, round(avg((n_match * 2 > n_votes)::INT), 6) AS majority, round(avg(top / n_votes), 6) AS agreement FROM own GROUP BY field",
    "line_scores": f"WITH {_RUN} SELECT CAST(repeat AS INT) AS repeat, CASE WHEN max(error) IS NULL THEN round(sum(hit::INT) / 3, 6) END AS score FROM c GROUP BY repeat",
    "request_ids": r"WITH h AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'id ' || CAST(event_id AS VARCHAR) WHEN event_id % 4 = 1 THEN repeat(event_type, event_id % 40) ELSE props END AS h FROM events) SELECT event_id, regexp_full_match(h, '[\x21-\x7e]{1,128}') AS taken FROM h",
    "escape_is_quote": """WITH a AS (SELECT event_id, event_type, ['"', chr(39)][event_id % 2 + 1] AS q, ['"', chr(39), '~'][event_id % 3 + 1] AS e FROM events)
SELECT event_id, CASE WHEN e <> q THEN e END AS escapechar, e = q AS doublequote, event_type AS footer_first_line, CAST(NULL AS VARCHAR) AS error FROM a""",
    "prompt_texts": f"SELECT doc_id, true AS has_sample, octet_length(encode(text)) > 4096 OR len({_LINES}) > 25 AS has_tail FROM documents",
    "run_loop_budget": "WITH p AS (SELECT lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS fixture, unnest([1, 2]) AS repeat FROM (SELECT DISTINCT c_nationkey FROM customer)) SELECT fixture, repeat, CAST(1 AS BIGINT) AS calls, CAST(1 AS DOUBLE) AS score, CAST(NULL AS VARCHAR) AS error FROM p ORDER BY 1, 2 LIMIT 31",
    "replay_run": "SELECT least(n, 17) AS fixtures, greatest(n - 17, 0) AS skipped, true AS named, CAST(1 AS DOUBLE) AS score FROM (SELECT count(DISTINCT c_nationkey) AS n FROM customer)",
    "summarize_interrupted": f"WITH {_RUN}, l AS (SELECT repeat, fixture, known, max(error) AS error, sum(hit::INT) / 3 AS score FROM c GROUP BY ALL) SELECT true AS incomplete, 'interrupted' AS stopped_early, CAST(60 AS BIGINT) AS planned, count(DISTINCT fixture) AS fixtures, count(*) AS lines, count(*) FILTER (WHERE error IS NOT NULL AND NOT known) AS errored, count(*) FILTER (WHERE error IS NULL AND NOT known) AS scored, round(avg(score) FILTER (WHERE error IS NULL AND NOT known), 6) AS score FROM l",
    "tail_redetect": r"""WITH t AS (SELECT doc_id, regexp_replace(right(regexp_replace(text, '[^\x{00}-\x{FF}]', '?', 'g'), 4096), '^[\x{80}-\x{BF}]{1,3}', '') AS t FROM documents) SELECT doc_id, CASE WHEN regexp_matches(t, '[^\x{00}-\x{7F}]') THEN 'cp1252' ELSE 'utf-8' END AS encoding FROM t""",
    "quote_escaping": r"""WITH q AS (SELECT page_id, contains(html, '\"') AS b, regexp_matches(html, '[^ "\\\r\n]""') AS d, regexp_matches(html, '(?m)(?:^| )"[^"\r\n]+"(?: |\r|$)') AS q FROM pages)
SELECT page_id, CASE WHEN b AND NOT d THEN '\' WHEN (d AND NOT b) OR (NOT b AND NOT d AND q) THEN NULL ELSE '~' END AS escapechar, d AND NOT b AS doublequote FROM q""",
    "one_column_header": f"""WITH l AS (SELECT doc_id, {_BARE}[1:10] AS l FROM documents),
n AS (SELECT doc_id, l, doc_id % 2 = 0 AS h, doc_id % 7 AS i, coalesce(regexp_replace(l[doc_id % 5 + 1], '^\\s+|\\s+$', '', 'g'), 'nowhere') AS name FROM l),
p AS (SELECT *, list_position(list_transform(l, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), name) AS p FROM n),
a AS (SELECT *, CASE WHEN p > 0 THEN p - 1 WHEN h THEN i END AS k FROM p)
SELECT doc_id, coalesce(k < len(l), false) AS has_header, CASE WHEN k < len(l) THEN CAST(k AS BIGINT) END AS header_row_index, CASE WHEN k < len(l) THEN l[k + 1] ELSE 'column_1' END AS name FROM a""",
    "stream_rolling_tail": "WITH d AS (SELECT doc_id, encode(text) AS b, octet_length(encode(text)) AS n, hex(encode(text)) AS h FROM documents) SELECT doc_id, CAST(n AS BIGINT) AS size, md5(unhex(h[1:1024])) AS head_md5, md5(unhex(h[1025:][-512:])) AS tail_md5 FROM d",
}
