"""How filters of texts interact: joint failures of all subsets, inverted to survivors and Shapley shares.

A filter marks rows that fail it.  For every subset of the five filters the rows that fail all of it are
counted as sums of products of flags, a part at a time.  All else follows from these 32 numbers by
inclusion and exclusion: survivors of any set of filters, rows that fail one filter only, rows that a
filter would have removed had another not been first, and (from Harsanyi's dividends, the signed joint
failures) what a filter removes summed over all orders.
"""

from __future__ import annotations

import hashlib
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_slices, prepare
from .words import Words, code_points_before, distinct_per_text, utf8

FILTERS = "ABCDE"
N = len(FILTERS)
SUBSETS = range(1 << N)
#: Filters that look at one text; the last one looks at all of them.
LOCAL = N - 1
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 200, 50, 3
SYMBOLS = b"#$%&*|"
#: Ways that rows without an id are dealt, which no label is for.
SALTS = 64

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("fails", pa.int32()), ("digest", pa.binary())])
_DDL = "doc_id long, lang string, fails int, digest binary"

_IS_UPPER = np.zeros(256, bool)
_IS_UPPER[65:91] = True
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def _per_text(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(mask)])
    return upto[off[1:]] - upto[off[:-1]]


def local_failures(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Bits of the filters A to D that each text fails."""
    words = Words(raw, off)
    n = words.per_text
    _, first = distinct_per_text(words.hash, words.first)
    points = np.diff(code_points_before(raw)[off])
    failed = [
        n < LEAST_WORDS, 100 * np.diff(first) < LEAST_DISTINCT * n, 100 * _per_text(_IS_UPPER[raw], off) > MOST_UPPER * points,
        _per_text(_IS_SYMBOL[raw], off) > 0,
    ]
    return sum(f.astype(np.int32) << i for i, f in enumerate(failed))


def _kernel(part: pa.RecordBatch) -> dict:
    raw, off = utf8(pc.fill_null(part.column("text"), ""))
    seen = memoryview(np.ascontiguousarray(raw))
    digests = [hashlib.sha256(seen[a:b]).digest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    return {"doc_id": part.column("doc_id"), "lang": part.column("lang"), "fails": local_failures(raw, off), "digest": digests}


def flagged(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``lang`` (null: empty), ``fails`` (bits of A to D) and the text's ``digest``."""
    prepare(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    return narrow.mapInArrow(by_slices("text", _SCHEMA, _kernel), _DDL)


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows counted by text, part, failures and labels: ``n`` of them, ``later`` of which fail E.

    Copies of a text are summed up before they meet, so a group of copies is a row per part and label."""
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    ).withColumn("_salt", F.lit(0).cast("long"))
    salt = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id() % SALTS).otherwise(0)
    both = flagged(docs).withColumn("_salt", salt).join(marks, ["doc_id", "_salt"], "left").na.fill(0, ["good", "toxic"])
    kind = ["digest", "lang", "fails", "good", "toxic"]
    by_id = both.groupBy("doc_id", "_salt", *kind).agg(F.count("*").alias("n"))  # dealt by the join's keys already
    by_text = by_id.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n")).otherwise(0)).alias("with_id"),
        F.min("doc_id").alias("head"), F.min_by("n", "doc_id").alias("heads"),
    )
    first = F.min("head").over(Window.partitionBy("digest"))  # a row per part and label
    later = F.col("with_id") - F.when(F.col("head") == first, F.col("heads")).otherwise(0)
    return by_text.withColumn("later", later).select("digest", "lang", "fails", "good", "toxic", "n", "later")


def _holds(subset: int, i: int) -> bool:
    return bool(subset >> i & 1)


def joint_failures(counted: DataFrame) -> DataFrame:
    """A row per part: for each of the 32 subsets the rows, good rows and toxic rows that fail all of it."""
    flat = counted.select("lang", *[F.expr(f"cast(shiftright(fails, {i}) & 1 as bigint)").alias(f"f{i}") for i in range(LOCAL)], "good", "toxic", "n", "later")

    def product(subset: int, weight: str | None) -> str:
        factors = ["later" if _holds(subset, LOCAL) else "n", *[f"f{i}" for i in range(LOCAL) if _holds(subset, i)], *([weight] if weight else [])]
        return " * ".join(factors)

    sums = [F.expr(f"sum({product(s, w)})").alias(f"{name}_{s}") for name, w in (("n", None), ("good", "good"), ("toxic", "toxic")) for s in SUBSETS]
    return flat.groupBy(F.col("lang").alias("part")).agg(*sums)


def _signed(name: str, terms: dict[int, int]) -> str:
    """SQL of the sum of the joint failures of subsets, each so many times."""
    return " + ".join(f"{times} * {name}_{subset}" for subset, times in terms.items())


def inverted(joint: DataFrame) -> DataFrame:
    """Per part: survivors of each set of filters (all, good and toxic rows), and each filter's failures,
    failures of it alone, and Shapley sum."""
    size = int.bit_count

    def survivors(name: str) -> Column:
        return F.expr(f"array({', '.join(_signed(name, {s: (-1) ** size(s) for s in SUBSETS if s & p == s}) for p in SUBSETS)})")

    def of_filter(terms) -> Column:
        return F.expr(f"array({', '.join(_signed('n', {s: terms(s) for s in SUBSETS if _holds(s, i)}) for i in range(N))})")

    orders = factorial(N)
    return joint.select(
        "part", survivors("n").alias("kept"), survivors("good").alias("good"), survivors("toxic").alias("toxic"),
        F.array(*[f"n_{1 << i}" for i in range(N)]).alias("fails"),
        of_filter(lambda s: (-1) ** (size(s) - 1)).alias("alone"),
        # a dividend is shared by the filters of its subset alike
        of_filter(lambda s: (-1) ** (size(s) - 1) * orders // size(s)).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part (``lang``), order of the five filters and step.

    Filters, by what fails them (words: runs of anything but ASCII white space): A fewer than 200
    words; B 100 * distinct words < 50 * words; C 100 * letters A-Z > 3 * code points; D any of
    ``#$%&*|``; E the text of a smaller id's row, wherever that row is and whether or not it was removed.

    A null text is empty (fails A), a null ``lang`` is the empty part.  A row without an id is nobody's
    copy and has no label; rows that share a smallest id don't fail E.  Rows repeat as often as they are
    given.  Of several labels of an id one of quality (toxic) 1 is enough.  Only ``doc_id``, ``text``,
    ``lang`` are read, so other columns can have any name.  No rows give no parts.  Very long texts need
    some 100 bytes of a worker's memory for each byte.
    """
    wide = inverted(joint_failures(cells(docs, labels)))
    orders = F.array(*[F.lit("".join(o)) for o in permutations(FILTERS)])
    bit = lambda k: f"shiftleft(1, ascii(substring(filter_order, {k}, 1)) - {ord(FILTERS[0])})"
    before = " + ".join(f"if(step > {k}, {bit(k)}, 0)" for k in range(1, N))
    at = wide.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(N)))).withColumns(
        {"_f": F.expr(f"ascii(substring(filter_order, step, 1)) - {ord(FILTERS[0])}"), "_before": F.expr(before), "_after": F.expr(f"{before} + {bit('step')}")}
    )
    lost = lambda c: F.get(c, F.col("_before")) - F.get(c, F.col("_after"))
    return at.select(
        "part", "filter_order", "step", F.get("kept", F.col("_after")).alias("kept"), lost("kept").alias("removed"),
        (F.get("fails", F.col("_f")) - lost("kept")).alias("redundant"), F.get("alone", F.col("_f")).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("shapley", F.col("_f")).alias("shapley"),
    )
