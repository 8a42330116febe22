"""The queries of this subpackage, opN_<name>, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscout.llm import chat, decontamination, mixing, pii, quality_classifier, quality_rules, simhash_dedup, substring_dedup, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    names = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), names.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("__spans")
    out = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    counts = [pii.count_of(spans, kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return out.select("doc_id", *counts, F.sha2(pii.listed(pii.base(spans)), 256).alias("base_sha256"), pii.listed(spans).alias("spans"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.records(warc.bundles(table(spark, sf_dir, "pages")))
    return out.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


#: What both turns of conversation -1 say.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    out = chat.formatted(chat.chains(rows.unionByName(extra)))
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    out = out.select("tree", "conversation", chat.read_back(F.col("conversation")).alias("turns"), chat.trained_text(F.col("conversation"), F.col("loss")).alias("trained"))
    return out.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"), F.length("conversation").cast("long").alias("formatted_chars"),
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.components(table(spark, sf_dir, "documents"), width=4, radius=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(quality_classifier.crc(), F.lit(4)) == 2
    out = toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "evidence")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rules(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(quality_classifier.crc(), F.lit(5)) == 0
    out = quality_classifier.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeated(table(spark, sf_dir, "documents"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


#: Words of a text, in DuckDB.
WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NORMAL = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

OP1_SQL = f"""
WITH b AS (SELECT item_id, {_NORMAL} AS w FROM benchmark),
i AS (SELECT item_id, least(len(w), 10) AS k, w FROM b WHERE len(w) > 0),
j AS (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS s FROM i),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS seq FROM j),
d AS (SELECT doc_id, {_NORMAL} AS w FROM documents),
e AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM i)),
m AS (SELECT e.doc_id, e.s, e.k, iw.item_id FROM e JOIN iw ON e.k = iw.k AND array_to_string(e.w[e.s:e.s + e.k - 1], ' ') = iw.seq),
h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM m) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n, string_agg(v, ',' ORDER BY v) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS v FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(g.n, 0) AS BIGINT) AS n_items,
sha256(coalesce(g.names, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN g USING (doc_id)
"""

OP9_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
s AS (SELECT doc_id, i, count(*) OVER o AS k, string_agg(word, ' ') OVER o AS seq FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
m AS (SELECT seq, min(doc_id) AS least FROM s WHERE k = 13 GROUP BY seq),
h AS (SELECT s.doc_id, s.i FROM s JOIN m USING (seq) WHERE s.k = 13 AND s.doc_id > m.least),
f AS (SELECT p.doc_id, p.i, p.word, max(h.i) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS hit FROM p LEFT JOIN h ON h.doc_id = p.doc_id AND h.i = p.i),
g AS (SELECT doc_id, count(*) FILTER (WHERE hit IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE hit IS NULL) AS kept FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(g.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(g.kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""

OP3_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS digest, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN n >= {warc.SMALLEST} AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN n >= {warc.SMALLEST} AND first <> page_id THEN first END AS refers_to FROM f
"""

OP4_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'),
e AS (SELECT *, len(role) + len(role) - len(replace(role, '\\', '')) + (len(role) - len(replace(role, '<|', ''))) // 2 + len(role) - len(replace(role, chr(10), '')) AS r,
  len(text) + len(text) - len(replace(text, '\\', '')) + (len(text) - len(replace(text, '<|', ''))) // 2 AS t FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
CAST(sum(r + t + {len(chat.START) + 1 + len(chat.END)}) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, {WORDS} AS w FROM d),
x AS (SELECT r, w[i:i + 2] AS seq, i FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
y AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, seq) AS n FROM x) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM y) GROUP BY r),
l AS (SELECT r, host, line, list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda v: v <> '') AS lw FROM (SELECT r, host, unnest(string_split(text, chr(10))) AS line FROM d)),
ll AS (SELECT r, host, line, len(lw) AS n, regexp_replace(translate(array_to_string(lw, ' '), '{_UPPER}', '{_LOWER}'), '[0-9]', '0', 'g') AS norm FROM l WHERE len(lw) > 0),
dup AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM ll GROUP BY r),
t AS (SELECT host, text, min(r) AS r FROM d GROUP BY host, text),
h AS (SELECT host, count(*) AS n FROM t GROUP BY host),
o AS (SELECT ll.host, ll.norm, count(DISTINCT ll.r) AS n FROM ll JOIN t USING (r) GROUP BY ll.host, ll.norm),
often AS (SELECT o.host, o.norm FROM o JOIN h USING (host) WHERE o.n > {quality_rules.MOST_DOCUMENTS} AND o.n > h.n * {quality_rules.MOST_SHARE}),
gone AS (SELECT r, sum(n) AS n FROM ll JOIN often USING (host, norm) GROUP BY r),
a AS (SELECT d.r, d.doc_id, len(w.w) AS n_words, coalesce(list_sum(list_transform(w.w, lambda v: length(v))), 0) AS word_chars,
  length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(dup.n_lines, 0) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words, len(w.w) - coalesce(gone.n, 0) AS words_left
  FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r)),
b AS (SELECT *, n_words < {quality_rules.LEAST_WORDS} OR 100 * n_repeat_words > {quality_rules.MOST_REPEATED} * n_words AS base_failed FROM a)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(words_left AS BIGINT) AS words_left, base_failed,
NOT (base_failed OR n_symbols > {quality_rules.MOST_SYMBOLS} * word_chars OR n_dup_lines > {quality_rules.MOST_DUPLICATE_LINES} * n_lines
  OR words_left < {quality_rules.LEAST_LEFT} * n_words OR words_left < {quality_rules.LEAST_WORDS_LEFT}) AS kept
FROM b
"""

OP5_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, [{', '.join(map(str, mixing.WEIGHTS))}][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(mixing.WEIGHTS)} + 1] AS w FROM d GROUP BY source),
f AS (SELECT *, n * {mixing.MOST_EPOCHS} AS most, row_number() OVER (ORDER BY n * {mixing.MOST_EPOCHS} / w, source IS NULL, source) AS k, CAST(sum(n) OVER () AS DOUBLE) * {mixing.SHARE}::DOUBLE AS total, sum(w) OVER () AS all_w FROM s),
o AS (SELECT *, total - CAST(coalesce(sum(most) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS rest, all_w - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open FROM f),
l AS (SELECT *, w * rest >= most * open AS is_full FROM o),
a AS (SELECT rest, open FROM l WHERE NOT is_full ORDER BY k LIMIT 1),
t AS (SELECT l.source, l.n, CASE WHEN l.is_full OR a.open IS NULL THEN CAST(l.most AS DOUBLE) ELSE l.w * a.rest / a.open END AS target FROM l LEFT JOIN a ON true),
p AS (SELECT d.*, t.n AS source_size, t.target, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY CAST('0x' || left(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 15) AS BIGINT), doc_id NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken FROM q
"""

QUERIES = {"op1_decontamination": op1_decontamination, "op2_pii": op2_pii, "op3_warc": op3_warc, "op4_chat": op4_chat, "op5_mixing": op5_mixing, "op6_simhash_dedup": op6_simhash_dedup, "op7_toxicity": op7_toxicity, "op8_quality_rules": op8_quality_rules, "op9_substring_dedup": op9_substring_dedup, "op10_quality_classifier": op10_quality_classifier}
ORACLES = {"op1_decontamination": OP1_SQL, "op3_warc": OP3_SQL, "op4_chat": OP4_SQL, "op5_mixing": OP5_SQL, "op8_quality_rules": OP8_SQL, "op9_substring_dedup": OP9_SQL}
