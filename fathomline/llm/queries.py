"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.common import lower_ascii, read
from fathomline.llm.conversation_repair import damaged, repair
from fathomline.llm.decontamination import contaminated
from fathomline.llm.exact_dedup import lsm_dedup
from fathomline.llm.html_text import extract_text
from fathomline.llm.merkle import manifest
from fathomline.llm.ngram_join import similar_components
from fathomline.llm.packing import pack
from fathomline.llm.quality import fit_quality, score_quality
from fathomline.llm.sharding import label_propagation_shards
from fathomline.llm.suffix_dedup import remove_repeats
from fathomline.llm.token_counts import count_tokens
from fathomline.llm.toxicity import fit_toxicity, held_out, score_toxicity
from fathomline.llm.url_filter import judge_urls

URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score and the tagged spans of its text.

    Null and empty texts are scored like any other, without spans; repeated rows
    are scored alike; an empty table of documents gives an empty result.
    """
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    scored = score_toxicity(docs, fit_toxicity(docs, labels.filter(~held_out())))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic_spans")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and class under links of four-word shingles at 85 percent.

    Null and empty texts have an empty set and are their own class, as are
    documents without a link; equal texts share a class. A class is named by its
    smallest doc_id. An empty table gives an empty result.
    """
    return similar_components(read(spark, sf_dir, "documents"), k=4, percent=85)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot under the law of near equal counts.

    Null texts weigh eight bytes and are a group of equal texts like any other;
    repeated rows each get a slot; an empty table gives an empty result.
    """
    placed = label_propagation_shards(read(spark, sf_dir, "documents"))
    return placed.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 1024 tokens.

    Null and empty texts are one piece of the separating id alone; a text longer
    than a sequence is cut into pieces; an empty table gives an empty result.
    """
    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score.

    Null and empty texts are scored by their statistics, all of them 0; repeated
    rows are scored alike; an empty table gives an empty result.
    """
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    scored = score_quality(docs, fit_quality(docs, labels.filter(~held_out())))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes and tokens.

    Null counts as empty and has no token; very long texts are counted whole; an
    empty table gives an empty result.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that share a passage with a benchmark item, and where.

    Null, empty and very short texts match nothing; repeated rows are
    reported once and rows without doc_id not at all; an empty table on either
    side gives an empty result.
    """
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of equal texts and whether it is the one that stays, that of the largest doc_id.

    Null counts as empty, so both are one group; an empty table gives an empty
    result.
    """
    return lsm_dedup(read(spark, sf_dir, "documents"), keep="largest")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes without those that repeat in strings of 400 bytes, and the spans that went.

    Null and texts under 400 bytes stay whole; equal documents of 400 bytes or
    more lose all bytes, in each copy; an empty table gives an empty result.
    """
    return remove_repeats(read(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, longest fitting rule and verdict.

    Null urls and those without "://" have an empty host and path, fit no rule
    and are allowed; repeated pages are each judged; an empty table gives an
    empty result.
    """
    return judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after the stated damage, the cheapest edits that mend it, and the hash of what they give.

    Nulls count as one space; conversations without a row left have zeros, an
    empty audit and the hash of nothing; rows of one turn are taken by role and
    text; an empty table gives an empty result.
    """
    return repair(damaged(read(spark, sf_dir, "conversations")))


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text.

    Null, empty and textless pages give an empty text; broken markup is read as
    browsers do; repeated pages are each read; an empty table gives an empty
    result.
    """
    return extract_text(read(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof in the tree over its source and all sources, and the check of rows of which a fifth is tampered with.

    Nulls are a value of their own; rows without doc_id come first in their
    source and are not tampered with; repeated rows are leaves of their own; an
    empty table gives an empty result.
    """
    docs = read(spark, sf_dir, "documents")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    shown = F.when(hit, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    return manifest(docs, presented=[F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), shown])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_ngram_join": op2_ngram_join,
    "op3_sharding": op3_sharding,
    "op4_packing": op4_packing,
    "op5_quality": op5_quality,
    "op6_token_counts": op6_token_counts,
    "op7_decontamination": op7_decontamination,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_html_text": op12_html_text,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op10_url_filter": r"""
        WITH rules(host, path, verdict) AS (
            VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
        ), parts AS (
            SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages
        ), fits AS (
            SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
                   row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC) AS k
            FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1
    """,
    "op12_html_text": r"""
        WITH parts AS (
            SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>') AS raw FROM pages
        ), plain AS (
            SELECT page_id, url, list_transform(raw, lambda b: trim(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(
                   replace(b, '<br>', ' '), '</?[bi]>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#39;', chr(39)), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks
            FROM parts
        ), joined AS (
            SELECT page_id, url, coalesce(array_to_string(list_filter(blocks, lambda b: b <> ''), chr(10)), '') AS text FROM plain
        )
        SELECT page_id, url, text, length(text) AS n_chars FROM joined
    """,
    "op13_merkle_manifest": """
        WITH RECURSIVE rows_ AS (
            SELECT *, source IS NOT NULL AS named, coalesce(
                xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
                    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda x, _: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT) % 5 = 0,
                false) AS hit
            FROM documents
        ), texts AS (
            SELECT *, CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS shown,
                   coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                   || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
            FROM rows_
        ), leaves AS (
            SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(shown) || ':' || shown, '-')) AS offered
            FROM texts
        ), numbered AS (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS width FROM leaves
        ), inner_ AS (
            SELECT source, 0 AS level, pos, leaf AS node, width FROM numbered
            UNION ALL
            SELECT source, level + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), any_value((width + 15) // 16)
            FROM inner_ WHERE width > 1 GROUP BY source, level, pos // 16
        ), subroots AS (
            SELECT source, level AS high, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS width FROM inner_ WHERE width = 1
        ), outer_ AS (
            SELECT 0 AS level, place AS pos, subroot AS node, width FROM subroots
            UNION ALL
            SELECT level + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), any_value((width + 15) // 16) FROM outer_ WHERE width > 1 GROUP BY level, pos // 16
        ), steps AS (
            SELECT n.doc_id, n.leaf, i.level, coalesce(string_agg(i.node, '' ORDER BY i.pos) FILTER (i.pos < n.pos // (16 ** i.level)::BIGINT), '') AS before_,
                   coalesce(string_agg(i.node, '' ORDER BY i.pos) FILTER (i.pos > n.pos // (16 ** i.level)::BIGINT), '') AS after_
            FROM (SELECT doc_id, leaf, source, pos, width FROM numbered) n
            JOIN (SELECT source, level, pos, node, width, pos // 16 AS run FROM inner_ WHERE width > 1) i ON i.source IS NOT DISTINCT FROM n.source AND i.run = (n.pos // (16 ** i.level)::BIGINT) // 16
            GROUP BY ALL
            UNION ALL
            SELECT n.doc_id, n.leaf, s.high + o.level, coalesce(string_agg(o.node, '' ORDER BY o.pos) FILTER (o.pos < s.place // ((16 ** o.level)::BIGINT)::BIGINT), ''),
                   coalesce(string_agg(o.node, '' ORDER BY o.pos) FILTER (o.pos > s.place // ((16 ** o.level)::BIGINT)::BIGINT), '')
            FROM numbered n JOIN subroots s ON s.source IS NOT DISTINCT FROM n.source
            JOIN (SELECT *, pos // 16 AS run FROM outer_ WHERE width > 1) o ON o.run = (s.place // ((16 ** o.level)::BIGINT)::BIGINT) // 16
            GROUP BY n.doc_id, n.leaf, n.pos, s.high, s.place, o.level
        ), folded AS (
            SELECT doc_id, leaf, source, 0 AS level, offered AS node, '' AS proof FROM numbered
            UNION ALL
            SELECT f.doc_id, f.leaf, f.source, f.level + 1, sha256(s.before_ || f.node || s.after_), f.proof || s.before_ || s.after_
            FROM folded f JOIN steps s ON s.doc_id IS NOT DISTINCT FROM f.doc_id AND s.leaf = f.leaf AND s.level = f.level
        ), done AS (
            SELECT doc_id, leaf, source, arg_max(node, level) AS folded_root, sha256(arg_max(proof, level)) AS proof_sha256 FROM folded GROUP BY doc_id, leaf, source
        )
        SELECT d.doc_id, d.leaf, s.subroot, r.root, d.proof_sha256, d.folded_root, d.folded_root = r.root AS verified
        FROM done d JOIN subroots s ON s.source IS NOT DISTINCT FROM d.source CROSS JOIN (SELECT node AS root FROM outer_ WHERE width = 1) r
    """,
}
