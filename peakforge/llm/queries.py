"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakforge.llm import chat, classifier, decontam, enrich, lines, mixing, mtree, neardup, quality, substring, tokens, warc, whitening
from peakforge.llm.store import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("times")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents")).drop("band")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_digests(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "n_links", "class_id", F.array_join("removed", ",").alias("removed"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_digests(tokens.write_tokens(table(spark, sf_dir, "documents"), TOKENIZER))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.record_digests(warc.write_warc(table(spark, sf_dir, "pages")))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = turns.unionByName(hard).select("conv_id", "turn", "role", chat.text_parts().alias("parts"))
    return chat.chat_digests(chat.format_chats(rows))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_whiten_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_enrich_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.enrich_sales(table(spark, sf_dir, "sales"), table(spark, sf_dir, "client_changes"))


def op13_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_products(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_mix_sources, op3_minhash_near_dedup, op4_warc, op5_quality_rules, op6_substring_dedup, op7_token_output, op8_line_dedup, op9_chat_formatting, op10_quality_classifier, op11_whiten_embeddings, op12_enrich_sales, op13_top_products)}

_ESCAPED = "length({0}) + length({0}) - length(replace({0}, chr(92), ''))" + "".join(f" + (length({{0}}) - length(replace({{0}}, '{c}', ''))) // {len(c)}" for c in chat.CONTROL)
_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

ORACLE = {
    "op2_mix_sources": rf"""
WITH d AS (
  SELECT doc_id, source, len({_WORDS.format("text")}) AS size, coalesce(text, '') AS t FROM documents
), k AS (
  SELECT doc_id, source, size,
    -ln((CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE)
    / (1.0::DOUBLE / (1.0::DOUBLE + 10.0::DOUBLE * (length(t) - length(translate(t, '#*$%&|<>', ''))) / greatest(size, 1))) AS key
  FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS k FROM d GROUP BY source
), w AS (
  SELECT *, [3, 1, 2][(k - 1) % 3 + 1] AS w, source_size * 2 / [3, 1, 2][(k - 1) % 3 + 1]::DOUBLE AS room FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2) OVER (ORDER BY room, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY room, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), g AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, first_value(level) OVER (ORDER BY (level > room), room, k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * w) AS target FROM l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM g
), r AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS budget,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(k.size) OVER (PARTITION BY k.source, k.key, k.doc_id, k.size) AS tied
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * (epochs + CASE WHEN budget > 0 AND upto - tied / 2.0::DOUBLE <= budget THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
""",
    "op3_minhash_near_dedup": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d
), x AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), edge AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, edge.v FROM reach JOIN edge ON edge.u = reach.r
), c AS (
  SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
""",
    "op4_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x, strlen(coalesce(html, '')) AS n FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS top, row_number() OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST) AS k FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(x, CAST(1 + 10 * (i // 8) AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN top END AS refers_to
FROM g
""",
    "op9_chat_formatting": f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), g AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, encode(role), encode(text))) AS turns_sha256,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, encode(role), encode(text)), '') AS loss,
    CAST(sum({len(chat.START + chat.SEP + chat.END)} + {_ESCAPED.format("role")} + {_ESCAPED.format("text")}) AS BIGINT) AS formatted_chars
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
""",
    "op12_enrich_sales": """
WITH s AS (
  SELECT sale_id, client_id, sold_at, CAST(greatest(0, least(9, (datediff('day', DATE '1970-01-01', CAST(arrived_at AS DATE)) - 19723) * 10 // 152)) AS INT) AS a FROM sales
), k AS (
  SELECT *, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(change_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda x, c: CASE WHEN c >= 0 THEN xor(x, c) ELSE xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END) END) AS crc
  FROM (SELECT DISTINCT * FROM client_changes WHERE valid_at IS NOT NULL) d
), c AS (
  SELECT *, CAST(greatest(0, least(9, (datediff('day', DATE '1970-01-01', CAST(valid_at AS DATE)) + xor(crc, 4294967295::BIGINT) % 4 - 19723) * 10 // 152)) AS INT) AS a FROM k
), w AS (
  SELECT CAST(b AS INT) AS b, (SELECT max(sold_at) FROM s WHERE a < b) - INTERVAL 36 HOUR AS ws, (SELECT max(valid_at) FROM c WHERE a < b) - INTERVAL 36 HOUR AS wc FROM range(0, 10) r(b)
), h AS (
  SELECT b, wc, CASE WHEN ws IS NOT NULL AND wc IS NOT NULL THEN least(ws, wc) END AS h FROM w
), j AS (
  SELECT c.*, coalesce(valid_at < wc, false) AS late, (SELECT min(b) FROM h WHERE h.h >= valid_at) AS done FROM c JOIN h ON h.b = c.a
), v AS (
  SELECT *, row_number() OVER o AS place, min(CASE WHEN done IS NOT NULL THEN greatest(a, done) END) OVER (o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS follower
  FROM j WHERE NOT late AND client_id IS NOT NULL WINDOW o AS (PARTITION BY client_id ORDER BY valid_at, seq NULLS FIRST, change_id NULLS FIRST)
), e AS (
  SELECT row_number() OVER () AS n, sale_id, client_id, sold_at, CASE WHEN sold_at IS NULL THEN a ELSE coalesce((SELECT min(b) FROM h WHERE b >= a AND h.h > sold_at), 10) END AS batch FROM s
), m AS (
  SELECT n, sale_id, batch, count(place) AS n_held, arg_max(struct_pack(i := change_id, x := balance, o := op), place) FILTER (valid_at <= sold_at) AS found
  FROM e LEFT JOIN v ON v.client_id = e.client_id AND v.a <= e.batch AND (follower IS NULL OR greatest(v.a, follower) >= e.batch) GROUP BY n, sale_id, batch
)
SELECT 'sale' AS rec, sale_id AS id, CAST(batch AS BIGINT) AS batch, n_held, found.i AS change_id, CAST(floor(100 * found.x + 0.5::DOUBLE) AS BIGINT) AS balance_cents, found.o AS op FROM m
UNION ALL SELECT 'late', change_id, CAST(a AS BIGINT), NULL, NULL, NULL, NULL FROM j WHERE late
""",
    "op13_top_products": """
WITH v AS (
  SELECT row_number() OVER () AS u, vec_id, list_transform(embedding, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.u, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.u <> c.u
), r AS (
  SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op6_substring_dedup": rf"""
WITH d AS (
  SELECT doc_id, {_WORDS.format("text")} AS w FROM documents
), x AS (
  SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35
), k AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM x
), r AS (
  SELECT doc_id, i FROM k WHERE k IN (SELECT k FROM k GROUP BY k HAVING count(*) > 1)
), gone AS (
  SELECT doc_id, list_sort(list_distinct(flatten(list(range(i, i + 35))))) AS gone FROM r GROUP BY doc_id
), o AS (
  SELECT doc_id, w, coalesce(gone, []) AS gone, list_filter(w, lambda v, j: NOT list_contains(coalesce(gone, []), j)) AS kept FROM d LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM o
""",
    "op8_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents
), f AS (
  SELECT line, min(struct_pack(d := doc_id, l := line_no)) AS first, list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS s FROM l GROUP BY line
), w AS (
  SELECT line, len(s) AS n, unnest(s) AS w FROM f
), rare AS (
  SELECT w, count(*) AS c FROM w GROUP BY w
), p AS (
  SELECT line, n, w FROM (SELECT w.line, w.n, w.w, row_number() OVER (PARTITION BY w.line ORDER BY c, w.w) AS i FROM w JOIN rare USING (w)) WHERE i <= n - ceil(0.8 * n - 1e-9) + 1
), c AS (
  SELECT DISTINCT a.line AS a, b.line AS b FROM p a JOIN p b ON a.w = b.w AND a.line <> b.line AND 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n)
), e AS (
  SELECT c.a, c.b, y.first FROM c JOIN f x ON x.line = c.a JOIN f y ON y.line = c.b
  WHERE 100 * len(list_intersect(x.s, y.s)) >= 80 * (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))
), g AS (
  SELECT f.line, least(f.first, coalesce(min(e.first), f.first)) AS best, count(e.b) AS links FROM f LEFT JOIN e ON e.a = f.line GROUP BY f.line, f.first
), o AS (
  SELECT l.doc_id, l.line_no, links, best, best < struct_pack(d := l.doc_id, l := l.line_no) AS gone FROM l JOIN g USING (line)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_removed, CAST(sum(links) AS BIGINT) AS n_links, min(best.d) AS class_id,
  coalesce(string_agg(CASE WHEN gone THEN CAST(line_no AS VARCHAR) END, ',' ORDER BY line_no), '') AS removed
FROM o GROUP BY doc_id
""",
}
