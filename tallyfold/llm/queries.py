"""One query for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    filter_audit,
    html_extract,
    kd_shards,
    license_scan,
    line_crf,
    mixing,
    ngram_join,
    packing,
    periodic_runs,
    spotsigs,
    suffix_dedup,
    token_counts,
    token_files,
)
from .common import read_table

#: Folder of the public tokenizer files; None: the installed ``public_tokenizers`` package.
TOKENIZERS: str | None = None


def tokenizer_path(name: str) -> str:
    if TOKENIZERS is not None:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(read_table(spark, sf_dir, "documents"), cap=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op2_wrapper_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_fingerprints(read_table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), limit=4096)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(read_table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs, length=200).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    field = line_crf.train(docs, read_table(spark, sf_dir, "labels"))
    judged = line_crf.quality(docs.select("doc_id", "text"), field)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"
    )


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(read_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(read_table(spark, sf_dir, "documents"), periodic_runs.planted)


def op13_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.kd_shards(read_table(spark, sf_dir, "documents"), 40)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_wrapper_extract": op2_wrapper_extract,
    "op3_spotsigs": op3_spotsigs,
    "op4_token_files": op4_token_files,
    "op5_token_counts": op5_token_counts,
    "op6_license_scan": op6_license_scan,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_retrieval_packing": op8_retrieval_packing,
    "op9_quality_rules": op9_quality_rules,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_filter_audit": op11_filter_audit,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_kd_shards": op13_kd_shards,
}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: DuckDB SQL of the queries that SQL can express.  The others hash, compress, encode, train or round in
#: an order of their own; the tests hold them against brute force.
SQL: dict[str, str] = {
    "op10_ngram_jaccard_join": f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]) END AS s FROM words),
elements AS (SELECT doc_id, len(s) AS n, unnest(s) AS e FROM sets),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, MIN(a.n) AS nx, MIN(b.n) AS ny, COUNT(*) AS c
  FROM elements a JOIN elements b ON a.e = b.e AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common WHERE 100 * c >= 90 * (nx + ny - c)),
reached AS (SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y),
smallest AS (SELECT x, MIN(y) AS component_id FROM reached GROUP BY 1)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, (SELECT COUNT(*) FROM links l WHERE l.x = doc_id) AS n_links
FROM sets JOIN smallest ON x = doc_id""",
    "op11_filter_audit": """
WITH texts AS (
  SELECT doc_id, COALESCE(lang, '') AS part, COALESCE(text, '') AS t, regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, BOOL_OR(quality = 1) AS good, BOOL_OR(toxic = 1) AS toxic FROM labels GROUP BY 1),
flags AS (
  SELECT part, COALESCE(good, FALSE) AS good, COALESCE(toxic, FALSE) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > MIN(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS failed
  FROM texts LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, failed, COUNT(*) AS n, COUNT(*) FILTER (good) AS good, COUNT(*) FILTER (toxic) AS toxic FROM flags GROUP BY 1, 2),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS f, filter_order[1:step - 1] AS before FROM orders, range(1, 6) r(step)),
judged AS (
  SELECT part, filter_order, step, f, failed, n, good, toxic, contains(failed, f) AS fails,
    before <> '' AND regexp_matches(failed, '[' || before || '_]') AS gone
  FROM steps, cells),
counted AS (
  SELECT part, filter_order, step, f, COALESCE(SUM(n) FILTER (NOT gone AND NOT fails), 0) AS kept, COALESCE(SUM(n) FILTER (NOT gone AND fails), 0) AS removed,
    COALESCE(SUM(n) FILTER (gone AND fails), 0) AS redundant, COALESCE(SUM(n) FILTER (failed = f), 0) AS unique_fails,
    COALESCE(SUM(good) FILTER (NOT gone AND fails), 0) AS good_lost, COALESCE(SUM(toxic) FILTER (NOT gone AND fails), 0) AS toxic_lost
  FROM judged GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(SUM(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted""",
}
