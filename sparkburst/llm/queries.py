"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, language, ngram_join, packing, privacy, quality, repair, sharding, substrings, token_counts, token_files, turn_trie
from .tables import read


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove(read(spark, sf_dir, "documents")).drop("kept")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.train(docs)
    held_out = F.coalesce(language.in_fold(F.col("doc_id")), F.lit(False))
    out = language.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(read(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(read(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(read(spark, sf_dir, "conversations"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents"), size=4, percent=85)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(read(spark, sf_dir, "documents"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"]
    return out.select(*base)


def op9_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = privacy.find(read(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    spans = F.col("spans")
    return out.select(
        "doc_id",
        *[privacy.count_of(spans, k).alias(f"n_{k}") for k in privacy.KINDS[:-1]],
        F.sha2(privacy.listed(privacy.base_spans(spans)).cast("binary"), 256).alias("base_sha256"),
        privacy.listed(spans).alias("spans"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_files.round_trip(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return repair.summary(repair.damage(turns), turns)


def op13_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.trie(read(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_substrings, op2_language, op3_packing, op4_token_counts, op5_sharding, op6_chat, op7_ngram_join, op8_quality, op9_privacy, op10_decontamination, op11_token_files, op12_repair, op13_turn_trie)}


def _crc32(text: str) -> str:
    """SQL for the unsigned crc32 of ASCII text, bit by bit."""
    byte = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ord(substr({text}, i, 1)) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {byte}), 4294967295)"


#: The test tables hold no tool calls; calls are tested against a plain version on fixtures.
ORACLE_SQL: dict[str, str] = {
    "op6_chat": """
        WITH m AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations)
        SELECT conv_id, turn // 64 AS segment, count(*) AS n_messages, CAST(0 AS BIGINT) AS n_calls, CAST(0 AS BIGINT) AS n_valid,
               '{"messages":[' || string_agg('{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":' || CAST(to_json(role) AS VARCHAR) || ',"turn":' || turn || '}', ',' ORDER BY turn, role, text) || ']}' AS chat
        FROM m GROUP BY conv_id, turn // 64
    """,
    "op12_repair": f"""
        WITH RECURSIVE keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
            FROM conversations
        ), kinds AS (SELECT *, {_crc32("key")} % 20 AS kind FROM keyed
        ), hurt AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM kinds CROSS JOIN range(2) AS c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
                   trim(text, ' 	

') AS kept FROM hurt
        ), marked AS (
            SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS last,
                   CASE WHEN kept = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                        WHEN right(kept, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed
        ), counts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                   count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (last IS NOT NULL AND last || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n FROM marked GROUP BY conv_id
        ), steps AS (
            SELECT conv_id, 0 AS pos, {{'c': 0, 'a': ''}} AS s0, {{'c': 1000000000, 'a': ''}} AS s1, {{'c': 1000000000, 'a': ''}} AS s2, {{'c': 1000000000, 'a': ''}} AS s3 FROM counts
            UNION ALL
            SELECT conv_id, pos + 1, {{'c': s0.c + 2, 'a': s0.a || 'D'}},
                   least({{'c': s1.c + 2, 'a': s1.a || 'D'}}, {{'c': s0.c + stay + if(initial = 's', 0, 1000000000), 'a': s0.a || 'K'}}),
                   least({{'c': u.c + 2, 'a': u.a || 'D'}}, {{'c': before_u.c + stay + if(initial = 'u', 0, 1), 'a': before_u.a || if(initial = 'u', 'K', 'R')}}),
                   least({{'c': a.c + 2, 'a': a.a || 'D'}}, {{'c': u.c + stay + if(initial = 'a', 0, 1), 'a': u.a || if(initial = 'a', 'K', 'R')}})
            FROM (
                SELECT *, least(s0, s1, a) AS before_u FROM (
                    SELECT s.*, m.initial, CASE m.fault WHEN '' THEN 0 WHEN 'truncated' THEN 5 ELSE 1000000000 END AS stay,
                           least(s2, {{'c': s0.c + 5, 'a': s0.a || 'I'}}, {{'c': s1.c + 5, 'a': s1.a || 'I'}}, {{'c': s3.c + 5, 'a': s3.a || 'I'}}) AS u,
                           least(s3, {{'c': s2.c + 5, 'a': s2.a || 'I'}}, {{'c': s0.c + 10, 'a': s0.a || 'II'}}, {{'c': s1.c + 10, 'a': s1.a || 'II'}}) AS a
                    FROM steps s JOIN marked m ON m.conv_id IS NOT DISTINCT FROM s.conv_id AND m.pos = s.pos + 1)
            )
        ), best AS (
            SELECT conv_id, least(s0, s3, {{'c': s2.c + 5, 'a': s2.a || 'I'}}, {{'c': s1.c + 10, 'a': s1.a || 'II'}}) AS b
            FROM steps JOIN counts USING (conv_id) WHERE pos = n
        ), edits AS (
            SELECT m.conv_id, m.pos, m.role, m.text, m.initial, substr(b.a, m.pos, 1) AS edit,
                   count(*) FILTER (substr(b.a, m.pos, 1) <> 'D' AND NOT (substr(b.a, m.pos, 1) = 'K' AND m.initial = 's')) OVER (PARTITION BY m.conv_id ORDER BY m.pos) AS nth
            FROM marked m JOIN best b ON m.conv_id IS NOT DISTINCT FROM b.conv_id
        ), lines AS (
            SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN nth % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY pos) AS body
            FROM edits WHERE edit <> 'D' GROUP BY conv_id
        )
        SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, CAST(coalesce(b.b.c, 0) AS BIGINT) AS cost, coalesce(b.b.a, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) i
        LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM i.conv_id
        LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM i.conv_id
    """,  # an insertion is never cheapest: a deletion beside it is
    "op13_turn_trie": f"""
        WITH own AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM conversations WHERE conv_id IS NOT NULL
        ), ids AS (
            SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc32("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM own)
        ), turns AS (
            SELECT i.conv_id, o.pos, o.role, o.text FROM ids i JOIN own o ON o.conv_id = i.base AND o.pos <= i.h
            UNION ALL
            SELECT i.conv_id, o.pos - i.h + least(i.h, coalesce(b.n, 0)), o.role, o.text
            FROM ids i JOIN own o ON o.conv_id = i.conv_id AND o.pos > i.h LEFT JOIN (SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id) b ON b.conv_id = i.base
        ), lists AS (
            SELECT i.conv_id, coalesce(list({{'r': role, 't': text}} ORDER BY pos) FILTER (pos IS NOT NULL), []) AS l FROM ids i LEFT JOIN turns USING (conv_id) GROUP BY i.conv_id
        ), members AS (
            SELECT conv_id, depth, l[:depth] AS prefix, len(l) = depth AS ends FROM (SELECT conv_id, l, unnest(range(len(l) + 1)) AS depth FROM lists)
        ), nodes AS (
            SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
            FROM members GROUP BY depth, prefix
        ), linked AS (
            SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.prefix[:n.depth] = n.prefix) AS n_children
            FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[:n.depth - 1]
        ), below AS (
            SELECT unnest(range(d.depth + 1)) AS depth, d.prefix, d.n_children, CASE WHEN d.depth = 0 THEN 0 ELSE (d.n_convs - 1) * length(d.prefix[d.depth].t) END AS saved FROM linked d
        ), sums AS (
            SELECT depth, prefix[:depth] AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM below GROUP BY depth, prefix[:depth]
        )
        SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256 FROM linked JOIN sums USING (depth, prefix)
    """,
}
