"""The registered query of each training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import archives, bpe, html_text, language, mixing, near_dedup, pii, quality_model, quality_rules, revisits


#: Shares of all words that a mixed corpus is to have, whatever it comes with: no poor text, and a little toxic text to know it by.
DOMAIN_WEIGHTS = {"good": 0.98, "poor": 0.0, "toxic": 0.02}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    # What was just written has to be readable: a member that isn't fails its task, so that Spark tries it elsewhere.
    return archives.media_columns(spark, _table(spark, sf_dir, "documents"), on_error="fail")


def op5_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve_revisits(revisits.captures(_table(spark, sf_dir, "pages")))
    fields = F.transform(F.array_sort(F.map_keys("headers")), lambda k: F.concat(k, F.lit("="), F.element_at("headers", k)))
    return found.withColumn("headers", F.array_join(fields, ";"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(spark, _table(spark, sf_dir, "documents"), k=4, num=80, den=100)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = quality_rules.trusted_ids(_table(spark, sf_dir, "labels"))
    return quality_rules.quality_rules(docs, trusted).drop("text")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_report(_table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = language.split_by_crc(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), 3, 1)
    model = language.train(docs.where("not held_out"))
    return language.split_by_crc(language.identify(docs, model), 3, 1)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return mixing.document_rates(docs, mixing.labelled_domains(_table(spark, sf_dir, "labels")), DOMAIN_WEIGHTS).drop("text")


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = language.split_by_crc(_table(spark, sf_dir, "labels").select("doc_id", "quality"), 4, 2)
    model = quality_model.train(docs, labels.where("not held_out"))
    return language.split_by_crc(quality_model.score(docs, model), 4, 2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op7_pii": op7_pii,
    "op8_bpe": op8_bpe,
    "op9_html_text": op9_html_text,
    "op10_language": op10_language,
    "op2_mixing": op2_mixing,
    "op3_quality_model": op3_quality_model,
    "op4_media": op4_media,
    "op5_revisits": op5_revisits,
    "op6_near_dedup": op6_near_dedup,
}

ORACLES: dict[str, str] = {
    "op5_revisits": r"""
    WITH p AS (
        SELECT page_id AS p, md5(html) AS m, md5('2-' || html) AS m2, page_id * 60 AS start,
               regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest
        FROM pages),
    u AS (
        SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^.*@', ''), '^www[.]', ''), ':(80|443)$', '')
               || regexp_replace(regexp_replace(regexp_replace(regexp_replace(
                    regexp_replace(regexp_replace(rest, '^[^/?]*', ''), '([?&])(ref|utm_[a-z]+|fbclid|gclid)=[^&]*', '\1', 'g'),
                    '&+', '&', 'g'), '[?]&', '?', 'g'), '[?&]+$', ''), '/+$', '') AS canonical
        FROM p),
    full_ AS (
        SELECT canonical, start AS ts, p * 3 AS record_id, '"' || m || '"' AS tag, 'day ' || (p % 30) AS modified, 'day ' || (p % 7) AS date_, m AS digest
        FROM u WHERE p % 5 <> 0
        UNION ALL
        SELECT canonical, start + 172800, p * 3 + 1, '"2-' || m || '"', 'day ' || (p % 30 + 2), NULL, m2 FROM u WHERE p % 3 = 0),
    again AS (
        SELECT canonical, start + (p % 4 + 1) * 86400 AS ts, p * 3 + 2 AS record_id,
               CASE WHEN p % 7 = 0 THEN '"other"' WHEN p % 4 = 1 THEN NULL ELSE 'W/"' || m || '"' END AS tag,
               CASE WHEN p % 8 <> 1 THEN 'day ' || (p % 30) END AS modified, 'day ' || (p % 11) AS expires
        FROM u),
    joined AS (
        SELECT a.*, f.record_id AS base_id, f.tag AS tag0, f.modified AS modified0, f.date_ AS date0, f.digest AS digest0,
               row_number() OVER (PARTITION BY a.record_id ORDER BY f.ts DESC NULLS LAST, f.record_id DESC) AS n
        FROM again a LEFT JOIN full_ f ON a.canonical = f.canonical AND (f.ts < a.ts OR f.ts = a.ts AND f.record_id < a.record_id)),
    judged AS (
        SELECT *, CASE WHEN base_id IS NULL THEN 'no_base'
                       WHEN tag IS NOT NULL AND tag0 IS NOT NULL THEN CASE WHEN regexp_replace(tag, '^W/', '') = tag0 THEN 'resolved' ELSE 'mismatch' END
                       WHEN modified IS NOT NULL AND modified0 IS NOT NULL THEN CASE WHEN modified = modified0 THEN 'resolved' ELSE 'mismatch' END
                       ELSE 'unvalidated' END AS verdict
        FROM joined WHERE n = 1)
    SELECT record_id, canonical, ts, base_id, verdict,
           CASE WHEN verdict = 'resolved'
                THEN 'content-type=text/html' || coalesce(';date=' || date0, '') || ';etag=' || coalesce(tag, tag0) || ';expires=' || expires
                     || ';last-modified=' || coalesce(modified, modified0)
                ELSE 'content-type=none' || coalesce(';etag=' || tag, '') || ';expires=' || expires || coalesce(';last-modified=' || modified, '') END AS headers,
           CASE WHEN verdict = 'resolved' THEN digest0 ELSE md5('') END AS digest
    FROM judged
    """,
}
