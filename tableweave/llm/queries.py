"""The queries of the numbered operators, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, collocations, filteraudit, jaccard, mixing, neardup, packing, quality, sanitise, tokencount, tokenfile, topk, warc


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_ann_rotated_bits(spark: SparkSession, d: str) -> DataFrame:
    return ann.nearest(table(spark, d, "embeddings"), "id % 20 = 0")


def op2_best_fit_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, d, "documents"))


def op4_source_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.taken_by_document(table(spark, d, "documents"))


def op5_pii_sanitisation(spark: SparkSession, d: str) -> DataFrame:
    return sanitise.personal_data(table(spark, d, "documents"))


def op6_threshold_top_k(spark: SparkSession, d: str) -> DataFrame:
    return topk.top_scores(table(spark, d, "embeddings"), "id % 20 = 0")


def op7_warc_capture_index(spark: SparkSession, d: str) -> DataFrame:
    return warc.page_records(table(spark, d, "pages"))


def op8_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return quality.scored(docs, quality.train(docs, table(spark, d, "labels")))


def op9_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return tokencount.token_counts(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_token_id_output(spark: SparkSession, d: str) -> DataFrame:
    return tokenfile.token_records(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_phrase_collocations(spark: SparkSession, d: str) -> DataFrame:
    return collocations.collocations(table(spark, d, "documents"))


def op12_minhash_neardup(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, d, "documents"), percent=85)


def op13_filter_interaction_audit(spark: SparkSession, d: str) -> DataFrame:
    return filteraudit.audit(table(spark, d, "documents"), table(spark, d, "labels"))


QUERIES = {
    "op1_ann_rotated_bits": op1_ann_rotated_bits,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_source_mix": op4_source_mix,
    "op5_pii_sanitisation": op5_pii_sanitisation,
    "op6_threshold_top_k": op6_threshold_top_k,
    "op7_warc_capture_index": op7_warc_capture_index,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_token_counts": op9_token_counts,
    "op10_token_id_output": op10_token_id_output,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_minhash_neardup": op12_minhash_neardup,
    "op13_filter_interaction_audit": op13_filter_interaction_audit,
}

_WORDS = r"[^\x20\x09-\x0D]+"

def _similar_sql(words: int, more: str = "") -> str:
    return f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w
            FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {words}
                THEN list_transform(range(1, len(w) - {words} + 2), lambda i: array_to_string(w[i:i + {words} - 1], ' '))
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
        ), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
            JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
        ), reach(doc_id, other) AS (
            SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
        )
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id{more} FROM documents d
        LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id) USING (doc_id)"""


ORACLE_SQL = {
    "op3_ngram_jaccard_join": _similar_sql(4),
    "op6_threshold_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scores AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 20 = 0
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scores
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op7_warc_capture_index": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, encode(coalesce(html, '')) AS raw FROM pages),
        f AS (SELECT *, sha1(h) AS hex, min(page_id) OVER (PARTITION BY h) AS first FROM p),
        d AS (SELECT *, array_to_string(list_transform(range(32), lambda i:
            substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '') AS b32
            FROM f)
        SELECT page_id, octet_length(raw)::BIGINT AS payload_bytes, b32 AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to FROM d""",
    "op11_phrase_collocations": r"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
        ), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        f AS (
            SELECT lang, k, phrase, count(*) AS f FROM (
                SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
                FROM w, range(1, 6) AS lengths(k) WHERE len(w) >= k
            ) GROUP BY ALL HAVING count(*) >= 100
        ), n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
        c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
        alone AS (
            SELECT * FROM c WHERE NOT EXISTS (
                SELECT 1 FROM c AS b WHERE b.lang = c.lang AND b.k > c.k AND 100 * b.a >= 100 * c.a
                AND contains(' ' || b.phrase || ' ', ' ' || c.phrase || ' '))
        ), cuts AS (
            SELECT c.lang, c.phrase, c.a, cut, x.f AS l, y.f AS r, n.n, (1000::HUGEINT * c.a * n.n) // (x.f::HUGEINT * y.f) AS score
            FROM (SELECT *, unnest(range(1, k)) AS cut FROM alone) c
            JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:cut], ' ')
            JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:], ' ') JOIN n ON n.lang = c.lang
        ), lowest AS (
            SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM cuts
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest WHERE place = 1
        )
        SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000""",
    "op12_minhash_neardup": _similar_sql(5, ", d.doc_id = c AS kept"),
    "op13_filter_interaction_audit": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '{_WORDS}') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
        g AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        docs AS (
            SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, list_filter([
                CASE WHEN len(w) < 200 THEN 'A' END,
                CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END,
                CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' END,
                CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
                CASE WHEN coalesce(doc_id > first, false) THEN 'E' END], lambda x: x IS NOT NULL) AS failed
            FROM w LEFT JOIN g USING (doc_id)
        ), kinds AS (SELECT part, good, toxic, failed, count(*) AS n FROM docs GROUP BY ALL),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        orders AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
        ), steps AS (SELECT o, s::INTEGER AS s, o[s] AS f, string_split(o[:s - 1], '') AS earlier FROM orders, range(1, 6) AS r(s)),
        outcome AS (
            SELECT part, o, s, f, n, good, toxic, list_contains(failed, f) AS fails, failed = [f] AS alone,
                   list_has_any(failed, earlier) AS gone FROM kinds, steps
        ), counted AS (
            SELECT part, o AS filter_order, s AS step, f,
                sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
                sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
                sum(CASE WHEN fails AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
                sum(CASE WHEN alone THEN n ELSE 0 END)::BIGINT AS unique_fails,
                sum(CASE WHEN fails AND NOT gone AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
                sum(CASE WHEN fails AND NOT gone AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
            FROM outcome GROUP BY ALL
        )
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM counted""",
}
