"""Spot signatures: chains of content words that follow common words, with DataFrame functions only.

A text is lower-cased and everything but letters and digits becomes one space.  At each anchor, a
very common word, the next ``CHAIN`` words that are no anchors themselves give one signature,
``anchor word word``.  A document's fingerprint is the set of its signatures' 32-bit hashes, and two
documents are as alike as the Jaccard similarity of their sets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, code_points, text_or_empty

# Common words of English, French, German and Spanish.
ANCHORS = """
a an and are as at be by for from in is it of on or that the this to was with
au avec dans de des du elle en est et il la le les ne pas par pour que qui se son sur un une
als auf das dem den der die ein eine es für ich ist mit nicht sich sie und von zu
al como con del el esta este lo los las más no para por su sus una y
""".split()

CHAIN = 2



def _any_of(words: list[str]) -> str:
    """A pattern for any of the words, with common beginnings tried once."""
    rest: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        rest.setdefault(w[:1], []).append(w[1:])
    end = "" in rest and rest.pop("")
    kinds = [c + _any_of(r) for c, r in rest.items()]
    body = kinds[0] if len(kinds) == 1 and end is False else "(?:" + "|".join(kinds) + ")" if kinds else ""
    return body + "?" if body and end is not False else body


_ANY = _any_of(ANCHORS)
#: A run of anchors with the content word after it (nothing at the end of a text), and ahead, beyond the
#: next run, the second one.  No run is looked at more than twice, so a text of any anchors takes linear time.
_SPOT = f"(?<= )((?:{_ANY} )++[^ ]*+)(?=(?: (?:{_ANY} )*+([^ ]*+))?)"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hashes(words: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(words, lambda s: F.hash(s))))


def signatures(text: Column) -> Column:
    """Sorted distinct hashes of a text's spot signatures.

    A text without any has one for each three words in a row instead, one of fewer words has all of
    them as its only one, and one without a word its own hash, so that equal texts always are alike."""
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))

    def other(p: Column) -> Column:
        triples = F.regexp_extract_all(p, F.lit("(?<= )(?=([^ ]+ [^ ]+ [^ ]+) )"), F.lit(1))
        words = F.trim(p)
        return _let(triples, lambda t: F.when(F.size(t) > 0, t).otherwise(F.array(F.when(words == "", text).otherwise(words))))

    def chains(run: Column, second: Column) -> Column:
        """Of each different anchor of the run the chain of the two words."""
        return _let(
            F.split(run, " "),
            lambda w: F.transform(F.array_distinct(F.slice(w, 1, F.size(w) - 1)), lambda a: F.concat_ws(" ", a, F.element_at(w, -1), second)),
        )

    def spots(p: Column) -> Column:
        runs, seconds = (F.regexp_extract_all(p, F.lit(_SPOT), F.lit(i)) for i in (1, 2))
        none = F.array().cast("array<string>")
        found = F.flatten(F.zip_with(runs, seconds, lambda r, s: F.when(s == "", none).otherwise(chains(r, s))))
        return _let(found, lambda s: F.when(F.size(s) > 0, s).otherwise(other(p)))

    return _hashes(_let(plain, spots))


def fingerprint(sigs: Column) -> Column:
    """The set as a string: eight hexadecimal digits a signature, ascending."""
    return F.array_join(F.transform(sigs, lambda h: F.lower(F.lpad(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets that aren't empty."""
    same = F.size(F.array_intersect(a, b))
    return same / (F.size(a) + F.size(b) - same)


def near_pairs(sets: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs of different sets (``id_a`` < ``id_b``, ``likeness``) at ``threshold`` or above.

    ``sets`` has ``id`` and ``sigs``; equal sets stand for one, the smallest id.  Sets are partitioned
    by length so that only those of one partition or of neighbouring ones can reach the threshold.
    Within these, sets meet by the rarest ``n - ceil(threshold n) + 1`` signatures, pairs whose lengths
    are too far apart are pruned before anything is compared, and the rest is counted exactly.
    Null or empty sets are in no pair.
    """
    one = sets.filter(F.size("sigs") > 0).groupBy("sigs").agg(F.min("id").alias("id")).withColumn("n", F.size("sigs"))
    each = one.select("id", "n", F.explode("sigs").alias("sig"))
    rarity = each.groupBy("sig").agg(F.count("*").alias("df")).filter("df > 1")
    part = F.floor(F.log("n") / F.lit(-1.0001 * math.log(threshold))).cast("int")
    room = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1
    lone = F.col("n") - F.size("common")
    common = each.join(rarity, "sig").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("common"))
    front = common.withColumn("front", F.slice("common", 1, F.greatest(F.lit(0), room - lone).cast("int")))
    posts = front.select("id", "n", part.alias("part"), F.explode("front").alias("x")).select("id", "n", "part", F.col("x.sig").alias("sig"))
    left = posts.select(F.col("id").alias("a"), F.col("n").alias("na"), "part", "sig")
    right = posts.withColumn("part", F.explode(F.array(F.col("part"), F.col("part") - 1)))
    right = right.select(F.col("id").alias("b"), F.col("n").alias("nb"), "part", "sig")
    close = (F.col("nb") * threshold <= F.col("na") + 1e-9) & (F.col("na") * threshold <= F.col("nb") + 1e-9) & (F.col("a") != F.col("b"))
    pairs = left.join(right, ["part", "sig"]).filter(close)
    pairs = pairs.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()
    sig_a, sig_b = (one.select(F.col("id").alias(f"id_{s}"), F.col("sigs").alias(f"sigs_{s}")) for s in "ab")
    checked = pairs.join(sig_a, "id_a").join(sig_b, "id_b").withColumn("likeness", likeness(F.col("sigs_a"), F.col("sigs_b")))
    return checked.filter(F.col("likeness") >= threshold).select("id_a", "id_b", "likeness")


def _neighbours(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Each row's successor by (``doc_id``, ``mark``), the last one's being the first.

    Rows are ordered by ranges; only each range's first row has to be known to the others."""
    order = [F.col("doc_id").asc_nulls_first(), F.col("mark").asc()]
    ranged = scratch.save(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ordered")
    one = F.struct("doc_id", "mark", "n")
    inner = ranged.withColumn("next", F.lead(one).over(Window.partitionBy("range").orderBy(*order)))
    firsts = ranged.groupBy("range").agg(F.min(one).alias("first"))
    by_range = Window.orderBy("range")
    whole = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("range", F.coalesce(F.lead("first").over(by_range), F.first("first").over(whole)).alias("first"))
    return inner.join(after, "range").withColumn("next", F.coalesce("next", "first")).drop("first", "range")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of edited ones, whose last ``floor(n / 2)`` code points are
    replaced by the first as many (or all) of the next document in ascending ``doc_id``.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored.  A null text counts as empty; an
    empty text's set holds the hash of the empty string, and is as alike as 1 to another's.  A null
    id sorts first; documents that share an id follow each other in the order of their texts' hashes;
    a repeated row is followed by its own copy, but for the last copy.  A table's only document is its
    own successor.  Fingerprints are of whole texts of any length, in time that grows with it.  An empty
    table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "spots")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("mark", F.xxhash64("text"))
    counted = rows.groupBy("doc_id", "mark", code_points(F.col("text")).alias("n")).agg(F.count("*").alias("copies"))
    next_of = scratch.save(_neighbours(counted, scratch), "next")
    if next_of.filter("copies > 1").limit(1).count():
        rows = rows.dropDuplicates(["doc_id", "mark"])
    half = F.floor(F.col("n") / 2).cast("int")
    mine = next_of.select(F.col("doc_id").alias("_d"), F.col("mark").alias("_m"), "n", "copies", F.col("next.doc_id").alias("nd"), F.col("next.mark").alias("nm"))
    theirs = next_of.select(
        F.col("next.doc_id").alias("_d"), F.col("next.mark").alias("_m"), F.col("doc_id").alias("pd"), F.col("mark").alias("pm"), half.alias("need")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("mark") == F.col("_m"))
    head = F.substring(F.col("text"), F.lit(1), (F.col("n") - half).cast("int"))
    # both sides read one shuffle of the texts; signing them twice costs less than moving or keeping the sets
    sigs = signatures(F.col("text"))
    left = rows.join(mine, same).select("doc_id", "mark", "n", "copies", head.alias("head"), sigs.alias("sigs"))
    tail = F.substring(F.col("text"), F.lit(1), F.col("need"))
    right = rows.join(theirs, same).select("pd", "pm", tail.alias("tail"), sigs.alias("next_sigs"))
    both = left.join(right, F.col("doc_id").eqNullSafe(F.col("pd")) & (F.col("mark") == F.col("pm")))
    both = both.withColumn("edited", F.concat("head", "tail"))
    both = both.withColumn("edited_sigs", signatures(F.col("edited")))
    last = both.select(
        "doc_id", F.col("n").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"), likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"), "copies",
    )
    if not next_of.filter("copies > 1").limit(1).count():
        return last.drop("copies")
    # every copy but the last is followed by an equal text
    again = next_of.filter("copies > 1").select(F.col("doc_id").alias("_d"), F.col("mark").alias("_m"), (F.col("copies") - 1).cast("int").alias("more"))
    own = rows.join(again, same)
    n = code_points(F.col("text"))
    own_edit = F.concat(F.substring(F.col("text"), F.lit(1), (n - F.floor(n / 2)).cast("int")), F.substring(F.col("text"), F.lit(1), F.floor(n / 2).cast("int")))
    own = own.select("doc_id", "more", n.alias("n_chars"), own_edit.alias("edited"), signatures(F.col("text")).alias("sigs"), signatures(own_edit).alias("edited_sigs"))
    copies = own.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"), likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        F.lit(1.0).alias("near_next"), F.explode(F.sequence(F.lit(1), F.col("more"))).alias("_i"),
    ).drop("_i")
    return last.drop("copies").unionByName(copies)
