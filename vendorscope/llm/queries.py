"""The registered query of each operator, with its DuckDB SQL where SQL can
express it. Every query covers its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vendorscope.llm.bpe import bpe_digests
from vendorscope.llm.collocations import collocations
from vendorscope.llm.common import read_table
from vendorscope.llm.decontam import decontaminate
from vendorscope.llm.embedding_graph import near_duplicates
from vendorscope.llm.exact_dedup import exact_dedup
from vendorscope.llm.jaccard_join import jaccard_components
from vendorscope.llm.langid import identify
from vendorscope.llm.packing import pack
from vendorscope.llm.pitman_yor import score_texts
from vendorscope.llm.token_align import align_tokenizers
from vendorscope.llm.toxicity import toxicity
from vendorscope.llm.url_rules import RULES, judge_urls
from vendorscope.llm.warc import warc_round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


@query("op1_exact_dedup", """
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))


@query("op3_byte_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(read_table(spark, sf_dir, "documents"),
                       public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op4_ngram_jaccard_join")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))


@query("op5_pitman_yor")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read_table(spark, sf_dir, "documents"))


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op7_best_fit_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op8_warc", """
    WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    d AS (SELECT page_id, body, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first_id FROM p)
    SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
           array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               CAST((CAST('0x' || substr(hex, CAST(k // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT)
                     >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
           CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
    FROM d""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(read_table(spark, sf_dir, "pages"))


@query("op9_embedding_near_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


@query("op10_url_rules", f"""
    WITH rules(verdict, host, path) AS (VALUES {', '.join(map(str, RULES))}),
    u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                 coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
                 row_number() OVER () AS n FROM pages)
    SELECT u.page_id, any_value(u.host) AS host, any_value(u.path) AS path,
           arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
           coalesce(arg_max(r.verdict, length(r.host || r.path)), 'allow') AS verdict
    FROM u LEFT JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
    GROUP BY u.n, u.page_id""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"))


@query("op11_decontamination", r"""
    WITH words AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    windows AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, least(len(w), 10) AS m,
                    array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
                FROM words, unnest(range(1, greatest(len(w) - 8, 2))) AS r(i) WHERE len(w) > 0),
    d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM documents),
    spots AS (SELECT k, i, m, array_to_string(w[i:i + m - 1], ' ') AS win
              FROM d, (SELECT DISTINCT m FROM windows) AS sizes, unnest(range(1, len(w) - m + 2)) AS r(i)),
    hits AS (SELECT k, i, spots.m, item FROM spots JOIN windows USING (win)),
    hit_words AS (SELECT k, count(DISTINCT p) AS n FROM hits, unnest(range(i, i + m)) AS r(p) GROUP BY k),
    hit_items AS (SELECT k, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
                  FROM (SELECT DISTINCT k, item FROM hits) GROUP BY k)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit_words.n, 0) AS n_hit,
           coalesce(hit_items.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
           hit_words.n IS NOT NULL AS contaminated
    FROM d LEFT JOIN hit_words USING (k) LEFT JOIN hit_items USING (k)""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("spans")


@query("op12_collocations", r"""
    WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
                    FROM documents),
    numbered AS (SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    words AS (SELECT p, lang, unnest(w) AS w1, unnest(range(len(w))) AS i FROM numbered),
    runs AS (SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM words
             WINDOW o AS (PARTITION BY p ORDER BY i)),
    f1 AS (SELECT lang, w1, count(*) AS a FROM runs GROUP BY ALL),
    f2 AS (SELECT lang, w1, w2, count(*) AS a FROM runs WHERE w2 IS NOT NULL GROUP BY ALL),
    f3 AS (SELECT lang, w1, w2, w3, count(*) AS a FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
    n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f1 GROUP BY lang),
    longer AS (SELECT lang, w1, w2, max(a) AS best FROM
                   (SELECT lang, w1, w2, a FROM f3 UNION ALL SELECT lang, w2, w3, a FROM f3) GROUP BY ALL),
    cuts AS (SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.a, 1 AS k, l.a AS l, r.a AS r
             FROM f2 JOIN f1 AS l ON l.lang = f2.lang AND l.w1 = f2.w1 JOIN f1 AS r ON r.lang = f2.lang AND r.w1 = f2.w2
             LEFT JOIN longer ON longer.lang = f2.lang AND longer.w1 = f2.w1 AND longer.w2 = f2.w2
             WHERE f2.a >= 10 AND (best IS NULL OR 100 * best < 50 * f2.a)
             UNION ALL
             SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.a, 1, l.a, r.a
             FROM f3 JOIN f1 AS l ON l.lang = f3.lang AND l.w1 = f3.w1
             JOIN f2 AS r ON r.lang = f3.lang AND r.w1 = f3.w2 AND r.w2 = f3.w3
             UNION ALL
             SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.a, 2, l.a, r.a
             FROM f3 JOIN f2 AS l ON l.lang = f3.lang AND l.w1 = f3.w1 AND l.w2 = f3.w2
             JOIN f1 AS r ON r.lang = f3.lang AND r.w1 = f3.w3),
    kept AS (SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts
             QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
           phrase, a, l, r, n, score
    FROM kept JOIN n USING (lang) QUALIFY rank <= 2000""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


@query("op13_tokenizer_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                            public_tokenizers.path("piece_bpe_32k.model"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def llm_oracles() -> dict[str, str]:
    return dict(SQL)
