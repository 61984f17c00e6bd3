"""The registered queries of the corpus operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograde.llm import ball_tree, decontaminate, hard_negatives, html_text, line_dedup, lm_scoring, mixing, ngram_join, prefix_trie, quality_rules, sharding, toxicity, warc
from foliograde.llm.common import read


def op1_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return lm_scoring.scored(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(read(spark, folder, "documents"))


def op3_toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.with_scores(read(spark, folder, "documents"), read(spark, folder, "labels")).select(
        "doc_id", "held_out", "score", "predicted")


def op4_top_products(spark: SparkSession, folder: str) -> DataFrame:
    return ball_tree.top_products(read(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_benchmark_hits(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_warc_captures(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived(read(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_similar_documents(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similar_documents(read(spark, folder, "documents"), size=4, percent=85)


def op8_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.main_text(read(spark, folder, "pages"))


def op9_balanced_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(read(spark, folder, "documents"))


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.without_repeated_lines(read(spark, folder, "documents"))


def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    conv = F.col("conv_id")
    return prefix_trie.conversation_trie(read(spark, folder, "conversations"), conv - conv % 20, F.crc32(conv.cast("string")) % 4)


def op12_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = quality_rules.judged(read(spark, folder, "documents"), read(spark, folder, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                        F.array_join("failed_rules", ",").alias("failed_rules"))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "embeddings")
    folded = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", folded), F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_lm_scores": op1_lm_scores,
    "op2_mix_sources": op2_mix_sources,
    "op3_toxicity_scores": op3_toxicity_scores,
    "op4_top_products": op4_top_products,
    "op5_benchmark_hits": op5_benchmark_hits,
    "op6_warc_captures": op6_warc_captures,
    "op7_similar_documents": op7_similar_documents,
    "op8_main_text": op8_main_text,
    "op9_balanced_shards": op9_balanced_shards,
    "op10_line_dedup": op10_line_dedup,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_quality_rules": op12_quality_rules,
    "op13_hard_negatives": op13_hard_negatives,
}

SQL = {
    "op6_warc_captures": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        q AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
        r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM q)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN last END AS refers_to FROM r""",
    "op4_top_products": """
        WITH v AS (SELECT vec_id, row_number() OVER () AS row_no, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
            FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, q.row_no AS query_no, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.row_no <> c.row_no WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op5_benchmark_hits": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS row_no, regexp_extract_all(translate(coalesce(text, ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS words FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS words FROM benchmark),
        w AS (SELECT DISTINCT item, least(len(words), 10) AS n, array_to_string(words[i:i + least(len(words), 10) - 1], ' ') AS passage
              FROM (SELECT item, words, unnest(generate_series(1, len(words) - least(len(words), 10) + 1)) AS i FROM b WHERE len(words) > 0)),
        spot AS (SELECT row_no, n, i, array_to_string(words[i:i + n - 1], ' ') AS passage
               FROM (SELECT row_no, words, n, unnest(generate_series(1, len(words) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM w) WHERE len(words) >= n)),
        hit AS (SELECT row_no, spot.n, i, item FROM spot JOIN w ON spot.n = w.n AND spot.passage = w.passage),
        covered AS (SELECT row_no, count(DISTINCT k) AS n_hit FROM (SELECT row_no, unnest(generate_series(i, i + n - 1)) AS k FROM hit) GROUP BY row_no),
        items AS (SELECT row_no, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row_no, item FROM hit) GROUP BY row_no)
        SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (row_no) LEFT JOIN items USING (row_no)""",
    "op11_conversation_trie": r"""
        WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
               FROM conversations WHERE conv_id IS NOT NULL),
        byte AS (SELECT CAST(i AS BIGINT) AS i, list_reduce([CAST(i AS BIGINT)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c % 2 = 1
               THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS t FROM range(256) r(i)),
        table256 AS (SELECT list(t ORDER BY i) AS t FROM byte),
        c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
               lambda s: CAST(ascii(s) AS BIGINT)), lambda v, b: xor(v // 256, t[xor(v, b) % 256 + 1])), 4294967295) % 4 AS h
               FROM (SELECT DISTINCT conv_id FROM o), table256),
        rebuilt AS (SELECT c.conv_id, row_number() OVER (PARTITION BY c.conv_id ORDER BY own, p) AS place, role, text FROM c JOIN
               (SELECT c.conv_id, 0 AS own, p, role, text FROM c JOIN o ON o.conv_id = c.base AND o.p <= c.h
                UNION ALL SELECT c.conv_id, 1, p, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND o.p > c.h) x ON x.conv_id = c.conv_id),
        path AS (SELECT conv_id, list(sha256(length(role) || ':' || role || text) ORDER BY place) AS ids, list(text ORDER BY place) AS texts FROM rebuilt GROUP BY conv_id),
        prefix AS (SELECT conv_id, len(ids) AS n, d, sha256(array_to_string(ids[:d], ',')) AS node,
               CASE WHEN d > 0 THEN sha256(array_to_string(ids[:d - 1], ',')) END AS up,
               CASE WHEN d > 0 THEN len(regexp_extract_all(texts[d], '[^\x20\x09-\x0D]+')) ELSE 0 END AS words
               FROM (SELECT c.conv_id, coalesce(ids, []) AS ids, texts, unnest(generate_series(0, len(coalesce(ids, [])))) AS d FROM c LEFT JOIN path USING (conv_id))),
        node AS (SELECT node, any_value(up) AS up, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
               count(*) FILTER (n = d) AS n_ends, coalesce(string_agg(CASE WHEN n = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ends
               FROM prefix GROUP BY node),
        sums AS (SELECT p.node, sum((v.n_convs - 1) * v.words) AS saved, count(*) FILTER (v.n_ends = v.n_convs) AS leaves
               FROM prefix p JOIN node v ON v.conv_id = p.conv_id AND v.d >= p.d GROUP BY p.node),
        kids AS (SELECT up, count(*) AS n FROM node WHERE up IS NOT NULL GROUP BY up)
        SELECT node.conv_id, node.d AS depth, parent.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n, 0) AS n_children,
               leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(node.ends) AS ends_sha256
        FROM node JOIN sums USING (node) LEFT JOIN kids ON kids.up = node.node LEFT JOIN node parent ON parent.node = node.up""",
    "op12_quality_rules": r"""
        WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, lang, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
        gram AS (SELECT row_no, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM
               (SELECT row_no, words, unnest(generate_series(1, len(words) - 2)) AS i FROM w WHERE len(words) >= 3)),
        twice AS (SELECT row_no, i FROM (SELECT row_no, i, count(*) OVER (PARTITION BY row_no, g) AS n FROM gram) WHERE n > 1),
        again AS (SELECT row_no, count(DISTINCT k) AS n FROM (SELECT row_no, unnest([i, i + 1, i + 2]) AS k FROM twice) GROUP BY row_no),
        f AS (SELECT w.row_no, doc_id, lang, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
               len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
               coalesce(again.n, 0) AS n_repeat_words, len(regexp_extract_all(text, '[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]')) AS n_marks,
               len(regexp_extract_all(text, '\p{Lu}')) AS n_capitals FROM w LEFT JOIN again USING (row_no)),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               coalesce(least(1000, word_chars * 1000 // nullif(n_words * 100, 0)), 0) AS long_words FROM f),
        m AS (SELECT row_no, doc_id, lang, base_failed, unnest([
               {'r': 1, 'name': 'symbols', 'v': coalesce(least(1000, n_symbols * 1000 // nullif(word_chars, 0)), 0)},
               {'r': 2, 'name': 'marks', 'v': coalesce(least(1000, n_marks * 1000 // nullif(word_chars, 0)), 0)},
               {'r': 3, 'name': 'capitals', 'v': coalesce(least(1000, n_capitals * 1000 // nullif(word_chars, 0)), 0)},
               {'r': 4, 'name': 'dup_lines', 'v': coalesce(least(1000, n_dup_lines * 1000 // nullif(n_lines, 0)), 0)},
               {'r': 5, 'name': 'repeat_words', 'v': coalesce(least(1000, n_repeat_words * 1000 // nullif(n_words, 0)), 0)},
               {'r': 6, 'name': 'long_words', 'v': long_words}, {'r': 7, 'name': 'short_words', 'v': 1000 - long_words}], recursive := true) FROM b),
        good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
        h AS (SELECT lang, r, v FROM m WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)),
        size AS (SELECT lang, count(*) AS n FROM h WHERE r = 1 GROUP BY lang),
        tail AS (SELECT lang, k, sum(p) OVER (PARTITION BY lang ORDER BY k) AS cdf FROM (SELECT lang, k, exp(lgamma(n + 1)
               - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(0.05 / 7) + (n - k) * ln(1 - 0.05 / 7)) AS p FROM (SELECT lang, n, unnest(generate_series(0, CAST(floor(n * 0.05 / 7) AS BIGINT))) AS k FROM size))),
        allowed AS (SELECT lang, max(k) AS k FROM tail WHERE cdf <= 0.05 / (7 * (SELECT count(*) FROM size)) GROUP BY lang),
        above AS (SELECT lang, r, v, sum(count(*)) OVER (PARTITION BY lang, r ORDER BY v DESC) AS n FROM h GROUP BY lang, r, v),
        cut AS (SELECT above.lang, r, max(v) AS t FROM above JOIN allowed ON above.lang IS NOT DISTINCT FROM allowed.lang WHERE n > k GROUP BY above.lang, r),
        bad AS (SELECT row_no, string_agg(name, ',' ORDER BY m.r) AS failed FROM m JOIN cut ON m.r = cut.r AND m.lang IS NOT DISTINCT FROM cut.lang WHERE v > t GROUP BY row_no)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed IS NULL AS kept,
               coalesce(failed, '') AS failed_rules FROM b LEFT JOIN bad USING (row_no)""",
    "op13_hard_negatives": """
        WITH v AS (SELECT row_number() OVER () AS row_no, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
               WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, a.row_no AS anchor_no, o.vec_id, o.row_no, a.label = o.label AS same, CAST(list_inner_product(a.e, o.e) AS BIGINT) AS score
              FROM v a JOIN v o ON a.row_no <> o.row_no WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, anchor_no, vec_id AS positive_id, row_no AS positive_no, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_no ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_no, positive_no ORDER BY score DESC, vec_id) AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_no) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
        QUALIFY rank <= 5""",
}
