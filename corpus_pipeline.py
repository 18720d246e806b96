"""The corpus pipeline: quality rules, near duplicates, repeated strings, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that its predecessor kept, and
returns a frame that is written and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import line_crf, mixing, ngram_join, packing, suffix_dedup
from tallyfold.llm.common import Scratch, code_points, read_table
from tallyfold.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates: five words, four fifths of all shingles in common.
SHINGLE, NUM, DEN = 5, 80, 100
REPEAT_BYTES = 200
CAP = 3


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line labels reject go.

    Null and empty texts fail the base rules.  Repeated rows are judged alike and all stay or go, texts of
    any length by all their lines; other columns go, and an empty table gives an empty one."""
    field = line_crf.train(docs, read_table(spark, sf_dir, "labels"))
    return line_crf.quality(docs.select(*COLUMNS), field).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the smallest id stays.

    Documents without words link with nothing and all stay.  Of rows that share the smallest id one
    stays for each different text, with the smallest source, language and count; a document without an
    id stays where it links with nothing.  Texts are compared by all their words; other columns go, and an
    empty table gives an empty one."""
    joined = ngram_join.jaccard_join(docs, SHINGLE, NUM, DEN)
    keep = joined.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_keep")).distinct()
    kept = docs.select(*COLUMNS).join(keep, F.col("doc_id").eqNullSafe(F.col("_keep"))).select(*COLUMNS)
    return kept.groupBy("doc_id", "text").agg(F.min(F.struct("source", "lang", "n_chars")).alias("_rest")).select("doc_id", "text", "_rest.*").select(*COLUMNS)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that a repeated string of ``REPEAT_BYTES`` covers go; a text without a rest goes too.

    Null and empty texts stay as they are.  Of repeated rows of that many bytes none is left.  Texts of any
    length are cut anywhere; other columns go, and an empty table gives an empty one."""
    cut = suffix_dedup.remove_repeats(docs.select(*COLUMNS), REPEAT_BYTES, with_text=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    kept = cut.filter("n_removed < n_bytes or n_bytes = 0").select("doc_id", text.alias("text"), "lang", "source")
    return kept.withColumn("n_chars", code_points(F.coalesce("text", F.lit("")))).select(*COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, rows that share an id each by itself.

    A document without words or text is taken once.  No row's copies meet: rows keep their number from the
    mix.  Texts of any length stay whole; other columns go, and an empty table gives an empty one."""
    numbered = Scratch(spark, "numbered").save(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")), "rows")
    taken = mixing.mix_sources(numbered, cap=CAP, row="_row").filter("copies > 0").select(F.col("row").alias("_row"), F.col("copies").cast("int").alias("_copies"))
    dealt = numbered.join(taken, "_row")
    return dealt.withColumn("_again", F.explode(F.array_repeat(F.lit(1), F.col("_copies")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens.

    A null or empty text is the end id alone.  Repeated rows are packed one by one, texts of any length
    in pieces; an empty table has no pieces."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("mixing sources to target weights", mixed_sources),
    ("packing", packed),
]

#: None: no stage but the base rules is within SQL's reach; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        after = scratch.save(out, name.replace(" ", "-"))
        scratch.drop(docs)
        docs = after
    return docs
