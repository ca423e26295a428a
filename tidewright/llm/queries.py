"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, extract, minhash, neighbours, packing, pii, quality, sharding, toxicity, warc
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written, normalised and read back."""
    out = warc.archive_pages(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in all documents."""
    return pii.report(table(spark, sf_dir, "documents"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every 50th id."""
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract.extract(table(spark, sf_dir, "pages"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items held by documents, with the edits between item and passage."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on a bounded-load ring of 16 shards."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 16)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicates by 2-word shingles."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q for q in (op1_warc, op2_toxicity, op3_pii, op4_neighbours, op5_extract, op6_decontaminate, op7_sharding, op8_packing, op9_quality, op10_minhash)
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
             d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first_id FROM p)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + (((CAST('0x' || substr(hex, CAST((i // 4) * 5 + 1 AS BIGINT), 5) AS BIGINT)) >> CAST(15 - 5 * (i % 4) AS INT)) & 31), 1)), '') AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM d""",
    "op3_pii": """
        WITH kinds(ord, kind, pattern, seen_from, seen_as) AS (VALUES
            (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+', '', ''),
            (2, 'ip', '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+', '', ''),
            (3, 'card', '[0-9](?:[ -]?[0-9])+', '', ''),
            (4, 'phone', '[+][0-9][ ().0-9-]+[0-9]', '', ''),
            -- characters are replaced one by one so that a word boundary stands for the look-arounds
            (5, 'iban', '\\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\\b', '_', '~'),
            (6, 'ssn', '\\b[0-9]{3}_[0-9]{2}_[0-9]{4}\\b', '-_ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', '_' || repeat('~', 53))),
        texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM documents),
        seen AS (SELECT r, body, ord, kind, pattern, CASE WHEN seen_from = '' THEN body ELSE translate(body, seen_from, seen_as) END AS seen FROM texts, kinds),
        cut AS (SELECT r, body, ord, kind, regexp_extract_all(seen, pattern) AS hits, string_split_regex(seen, pattern) AS gaps FROM seen),
        pieces AS (SELECT r, body, ord, kind, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap FROM cut WHERE len(hits) > 0),
        ends AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY r, ord ORDER BY i) AS stop FROM pieces),
        spans AS (
            SELECT r, ord, kind, CAST(stop - length(hit) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, substr(body, CAST(stop - length(hit) + 1 AS BIGINT), length(hit)) AS hit,
                   regexp_replace(hit, '[^0-9]', '', 'g') AS digits,
                   translate(substr(body, CAST(greatest(stop - length(hit) - 40, 0) + 1 AS BIGINT), CAST(least(stop - length(hit), 40) AS BIGINT)) || chr(10) || substr(body, CAST(stop + 1 AS BIGINT), 40),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS near
            FROM ends),
        good AS (
            SELECT r, ord, start, kind || ':' || start || ':' || stop AS span FROM spans WHERE CASE kind
                WHEN 'email' THEN true
                WHEN 'ip' THEN len(list_filter(string_split(hit, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST('0' || right(x, 3) AS INT) > 255)) = 0
                WHEN 'card' THEN length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length(digits)), lambda j:
                    CAST(substr(digits, length(digits) - j, 1) AS INT) * (1 + j % 2) - CASE WHEN j % 2 = 1 AND substr(digits, length(digits) - j, 1) > '4' THEN 9 ELSE 0 END)) % 10 = 0
                WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
                WHEN 'iban' THEN list_reduce(list_transform(string_split(substr(replace(hit, ' ', ''), 5) || left(hit, 4), ''), lambda c: CAST(instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1 AS BIGINT)),
                    lambda a, c: (a * CASE WHEN c < 10 THEN 10 ELSE 100 END + c) % 97) = 1
                ELSE NOT regexp_matches(hit, '^(?:000|666|9)|-00-|-0000$') AND regexp_matches(near, 'ssn|social|security') END)
        SELECT doc_id, count(*) FILTER (ord = 1) AS n_email, count(*) FILTER (ord = 2) AS n_ip, count(*) FILTER (ord = 3) AS n_card, count(*) FILTER (ord = 4) AS n_phone,
               sha256(coalesce(string_agg(span, ',' ORDER BY ord, start) FILTER (ord <= 4), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY ord, start), '') AS spans
        FROM texts LEFT JOIN good USING (r) GROUP BY r, doc_id""",
    "op10_minhash": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
            FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(words) < 2 THEN words
                   ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS shingles FROM w),
        n AS (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles FROM sets),
        s AS (SELECT s.doc_id, n_shingles, unnest(shingles) AS shingle FROM sets s JOIN n USING (doc_id)),
        links AS MATERIALIZED (
            SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y USING (shingle)
            WHERE x.doc_id <> y.doc_id AND 100 * least(x.n_shingles, y.n_shingles) >= 80 * greatest(x.n_shingles, y.n_shingles)
            GROUP BY x.doc_id, y.doc_id, x.n_shingles, y.n_shingles
            HAVING 100 * count(*) >= 80 * (x.n_shingles + y.n_shingles - count(*))),
        reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        least_id AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
        SELECT n.doc_id, n_shingles, least(n.doc_id, coalesce(m, n.doc_id)) AS component_id, n.doc_id = least(n.doc_id, coalesce(m, n.doc_id)) AS kept
        FROM n LEFT JOIN least_id ON n.doc_id = a""",
}
