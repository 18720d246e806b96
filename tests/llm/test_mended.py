"""License windows, source weights, repeated ids and survivors."""

import random
from collections import Counter

import corpus_pipeline
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyfold.llm import license_scan, line_crf, mixing

APACHE = "Licensed under the Apache License, Version 2.0."


def _indel(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last if x == y else min(row[j], row[j - 1]) + 1
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=6), st.lists(st.sampled_from(["a", "b", "c", "d", None]), max_size=12))
def test_nearest_is_the_nearest_of_all_stretches(want, have):
    cost, first, last = license_scan.nearest(want, have)
    assert cost == min(_indel(want, have[i:j]) for i in range(len(have) + 1) for j in range(i, len(have) + 1))
    assert cost == _indel(want, have[first:last])


def test_every_planted_notice_is_found():
    scan = license_scan.Scanner()

    def found(text):
        return Counter(f[1] for f in scan.scan(text)[1])

    cues = [f"this line speaks of a license in words that vary {i}" for i in range(400)]
    for n in (1, 20, 100, 400):
        assert found("\n".join([*cues[: n // 2], APACHE, *cues[n // 2 : n]])) == {"Apache-2.0": 1}
    for n in (20, 50, 200):
        assert found("\n".join(f"line {i} {APACHE}" for i in range(n))) == {"Apache-2.0": n}
    r = random.Random(2)
    mit = license_scan.TEMPLATES["MIT"][-1].split()
    changed = []
    for _ in range(200):
        words = list(mit)
        for i in r.sample(range(len(words)), 2):
            words[i] = "changed"
        changed.append(" ".join(words))
    assert found("\n".join(changed)) == {"MIT": 200}


def test_recall_of_planted_wordings():
    """Each wording alone, wrapped, in comments, between other notices and in long prose."""
    scan, r = license_scan.Scanner(), random.Random(5)
    prose = "The river runs past the town and its stones.\n" * 200
    every = [(name, w) for name, ws in license_scan.TEMPLATES.items() for w in ws]
    hit = asked = 0
    for name, wording in every:
        words = wording.split()
        wrapped = "\n".join(" ".join(words[i : i + 7]) for i in range(0, len(words), 7))
        other = r.choice([w for n, w in every if n != name])
        for text in (wording, wrapped, "# " + wrapped.replace("\n", "\n# "), prose + wording + "\n" + prose, other + "\n\n" + wrapped + "\n\n" + other):
            asked += 1
            hit += name in {f[1] for f in scan.scan(text)[1]}
    assert hit >= 0.97 * asked


def test_weights_that_are_missing_zero_or_less(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), f"s{i % 5}") for i in range(400)], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("s0", 1.0), ("s1", 2.0), ("s2", 0.0), ("s3", -4.0)], "source string, weight double")
    got = mixing.mix_sources(docs, weights).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"), F.sum("size").alias("size"), F.max("copies").alias("most")).collect()
    of = {r.source: r for r in got}
    assert all(of[s].target == 0 and of[s].taken == 0 for s in ("s2", "s3", "s4"))
    assert all(abs(of[s].taken - of[s].target) <= 7 and of[s].most <= 3 for s in ("s0", "s1"))
    assert abs(of["s0"].target + of["s1"].target - sum(r["size"] for r in got)) < 1e-6 and of["s1"].target >= of["s0"].target
    nothing = mixing.mix_sources(docs, weights.filter("weight < 0"))
    assert {(r.target, r.taken) for r in nothing.select("target", "taken").distinct().collect()} == {(0.0, 0)}


def test_repeated_ids_give_one_training_text(spark):
    docs = spark.createDataFrame([(1, f"some line {i}\nanother of {i}") for i in range(300)] + [(2, "menu | menu\nmenu")] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    fields = [line_crf.train(d, labels) for d in (docs, docs.repartition(5), docs.groupBy("doc_id").agg(F.min("text").alias("text")))]
    assert all((f.weights == fields[0].weights).all() and (f.moves == fields[0].moves).all() for f in fields)


def test_survivor_is_the_same_in_any_order(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, lang, source, n) for lang, source, n in (("en", "b", 3), ("de", "a", 2), ("en", "a", 1), (None, None, None))]
    docs = spark.createDataFrame([*rows, (2, text, "en", "b", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    first, again = (corpus_pipeline.near_duplicates(spark, d, "").collect() for d in (docs, docs.orderBy(F.desc("source")).repartition(3)))
    assert [tuple(r) for r in first] == [tuple(r) for r in again] and len(first) == 1 and first[0].doc_id == 1


def test_verdict_on_held_out_documents(spark, sf):
    """The field is fitted on one half of the labels; the other half judges it, among documents that pass the base rules."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    field = line_crf.train(docs, labels.filter(half == 0))
    judged = line_crf.quality(docs, field).filter("not base_failed").join(labels.filter(half == 1).select("doc_id", "quality"), "doc_id")
    found = Counter((r.quality, r.kept) for r in judged.select("quality", "kept").collect())
    good, bad = found[1, True] / (found[1, True] + found[1, False]), found[0, False] / max(1, found[0, True] + found[0, False])
    assert good >= 0.95 and (found[0, True] + found[0, False] == 0 or bad >= 0.5)


def test_a_step_of_the_tilts_takes_few_jobs(spark):
    """Plans and jobs of many steps filled the driver's memory on the smallest table."""
    docs = spark.createDataFrame([(i, "w " * (1 + i * i % 97), "abcde"[i % 5]) for i in range(400)], "doc_id long, text string, source string")
    sc, before = spark.sparkContext, []

    class Counted(mixing.Scratch):
        def save(self, df, name):
            if name == "tilts":
                before.append(len(sc.statusTracker().getJobIdsForGroup("tilts")))
            return super().save(df, name)

    plain, mixing.Scratch = mixing.Scratch, Counted
    sc.setJobGroup("tilts", "")
    try:
        assert mixing.mix_sources(docs).count() == 400
    finally:
        mixing.Scratch = plain
        sc.setLocalProperty("spark.jobGroup.id", None)
    steps = [b - a for a, b in zip(before[1:], before[2:], strict=False)]
    assert len(steps) >= 2 and max(steps) <= 4, before
