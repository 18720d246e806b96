"""Filter interactions, periodic runs and k-d shards against brute force, and on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyfold.llm import filter_audit, kd_shards, periodic_runs, queries
from tallyfold.llm.common import Scratch

from ..oracle import rows as ordered
from ..oracle import tables
from .test_llm import ODD, TYPES

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns whose names the operators use themselves.
CLASHES = ("part", "fails", "digest", "n", "size", "shard", "slot", "node", "bin", "_text", "_row", "kept", "step", "good", "start")


@pytest.fixture(scope="module")
def awkward(spark):
    long = (900, " ".join(f"w{i % 700}" for i in range(200_000)), "en", "big", 1)  # about a megabyte
    df = spark.createDataFrame([*ODD, long, (901, "ab " * 3000, None, None, 1), (902, "X # Y", "fr", "b", 1)], TYPES)
    return df.withColumns({c: F.lit("x") for c in CLASHES})


# --- filters


def _failures(rows):
    first = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    for doc_id, text, lang, *_ in rows:
        t = text or ""
        w = WORDS.findall(t)
        f = {"A"} if len(w) < 200 else set()
        f |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        f |= {"D"} if re.search("[#$%&*|]", t) else set()
        f |= {"E"} if doc_id is not None and first[t] < doc_id else set()
        yield doc_id, lang or "", f


def _audit(rows, labels):
    good, toxic = ({d for d, *v in labels if v[i] == 1} for i in (0, 1))
    parts = defaultdict(list)
    for doc_id, lang, f in _failures(rows):
        parts[lang].append((f, doc_id in good, doc_id in toxic))
    out = {}
    for part, docs in parts.items():
        share = Counter()
        for order in permutations("ABCDE"):
            left = docs
            for step, one in enumerate(order, 1):
                gone = [d for d in left if one in d[0]]
                left = [d for d in left if one not in d[0]]
                share[one] += len(gone)
                failing = [d for d in docs if one in d[0]]
                out[part, "".join(order), step] = [
                    len(left), len(gone), len(failing) - len(gone), sum(d[0] == {one} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)
                ]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(share[order[step - 1]])
    return out


def _told(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r.part, r.filter_order, r.step): [r[c] for c in names] for r in df.collect()}


def test_audit_equals_brute_force(spark, awkward):
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (4, 1, 1), (900, 1, None), (902, None, 1), (None, 1, 1), (12345, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = _told(filter_audit.filter_audit(awkward, marks))
    rows = [tuple(r) for r in awkward.select("doc_id", "text", "lang").collect()]
    assert got == _audit(rows, [x for x in labels if x[0] is not None])
    assert len(got) == 600 * len({r[2] or "" for r in rows})


def test_audit_of_random_texts(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["a", "B", "c#", "dd", "EE"], int(rng.integers(0, 400)))) for _ in range(30)]
    rows = [(int(i), texts[int(rng.integers(30))], ["x", "y", None, ""][int(rng.integers(4))]) for i in rng.integers(0, 80, 150)]
    labels = [(i, int(rng.integers(2)), int(rng.integers(2))) for i in range(0, 80, 2)]
    df, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert _told(filter_audit.filter_audit(df, marks)) == _audit(rows, labels)


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(docs, labels).count() == 0


def test_audit_query_equals_its_sql(spark, sf):
    assert ordered(queries.QUERIES["op11_filter_audit"](spark, sf)) == ordered(tables(sf).execute(queries.SQL["op11_filter_audit"]))


# --- runs


def _runs(words, least=6, periods=4):
    n, found = len(words), set()
    for p in range(1, n // periods + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(least, periods * p):
                found.add((i, p, j - i + p))
            i = j + 1
    smallest = lambda s, p, n_: not any(all(words[k] == words[k + q] for k in range(s, s + n_ - q)) for q in range(1, p))
    return sorted(x for x in found if smallest(*x))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=4), st.sampled_from([(6, 4), (2, 2)]))
def test_runs_equal_brute_force(texts, limits):
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    text, start, length, period = periodic_runs.runs(np.array([x for t in texts for x in t], np.uint64), first, *limits)
    for k, t in enumerate(texts):
        m = text == k
        assert sorted(zip(start[m].tolist(), period[m].tolist(), length[m].tolist(), strict=True)) == _runs(t, *limits)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 9), st.integers(0, 20))
def test_planted_repeats(words, period, at):
    at = min(at, len(words))
    words = words[:at] + [words[at + (i - at) % period] if at + (i - at) % period < len(words) else 9 for i in range(at, at + 60)]
    text, start, length, p = periodic_runs.runs(np.array(words, np.uint64), np.array([0, len(words)]))
    assert sorted(zip(start.tolist(), p.tolist(), length.tolist(), strict=True)) == _runs(words)


@settings(max_examples=100, deadline=None)
@given(st.permutations(range(40)))
def test_next_smaller(values):
    want = [next((j for j in range(i + 1, 40) if values[j] < values[i]), 40) for i in range(40)]
    assert periodic_runs.next_smaller(np.array(values, np.int32)).tolist() == want


def _digest(doc_id, text, plant=True):
    w = WORDS.findall(text or "")
    if plant and doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [*w[:a], *[w[a + (i - a) % p] for i in range(a, len(w))]]
    found = _runs(w)
    dropped = {i for s, p, n in found for i in range(s + p, s + n)}
    best = None
    for s, p, n in found:
        if best is None or n * best[1] > best[2] * p:
            best = (s, p, n)
    told = "".join(f"{s},{n},{p}\n" for s, p, n in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in dropped)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    shown = (None,) * 4 if best is None else (best[0], best[2], best[1], 1000 * best[2] // best[1])
    return doc_id, len(found), *shown, sha(told), sha(kept)


def test_runs_of_rows(spark, awkward):
    small = awkward.filter("doc_id is null or doc_id <> 900")
    for repeat in (periodic_runs.planted, None):
        got = [tuple(r) for r in periodic_runs.periodic_runs(small, repeat).collect()]
        want = [_digest(r.doc_id, r.text, repeat is not None) for r in small.select("doc_id", "text").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert periodic_runs.periodic_runs(awkward.filter("doc_id = 900")).first().n_runs == 1  # a megabyte that is one run
    assert periodic_runs.periodic_runs(awkward.limit(0)).count() == 0


def test_runs_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("n_chars < 4000").limit(60).cache()
    got = {r.doc_id: tuple(r) for r in periodic_runs.periodic_runs(docs, periodic_runs.planted).collect()}
    assert got == {r.doc_id: _digest(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
    assert any(v[1] for v in got.values())


# --- shards


def _plain_tree(rows, shards):
    """Shard of each row, from keys that are sorted whole: ``rows`` of (levels, text, own, size)."""
    out = {}

    def part(ids, first, k):
        if k == 1:
            out.update({i: first for i in ids})
            return
        half = k // 2
        if not ids:
            return
        wide = [max(rows[i][0][d] for i in ids) - min(rows[i][0][d] for i in ids) for d in range(len(kd_shards.DIMENSIONS))]
        d = wide.index(max(wide))
        order = sorted(ids, key=lambda i: (rows[i][0][d], rows[i][1], rows[i][2]))
        total = sum(rows[i][3] for i in ids)
        wanted = max(1, (2 * total * half + k) // (2 * k))
        below = 0
        for at, i in enumerate(order):
            if below + rows[i][3] >= wanted:
                at += below + rows[i][3] - wanted < wanted - below
                break
            below += rows[i][3]
        part(order[:at], first, half)
        part(order[at:], first + half, k - half)

    part(list(rows), 0, shards)
    return out


@pytest.mark.parametrize("shards", [1, 3, 8, 40])
def test_shards_equal_a_plain_tree(spark, sf, shards):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = kd_shards.narrow(docs, Scratch(spark, "test")).cache()
    plain = {r.doc_id: ([r[c] for c in kd_shards.DIMENSIONS], r["_text"], r["_own"], r["size"]) for r in rows.collect()}
    tree = kd_shards.grow(rows, shards)
    got = {r.doc_id: r.shard for r in rows.select("doc_id", F.expr(kd_shards.by_leaf(tree)).alias("shard")).collect()}
    assert got == _plain_tree(plain, shards)


def _judge(got, docs, shards):
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs)
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        sizes[r.shard] += r["size"]
        slots[r.shard].append((r.slot, r.doc_id is None, r.doc_id or 0))
    for of in slots.values():
        of.sort()
        assert [s for s, *_ in of] == list(range(len(of))) and [x[1:] for x in of] == sorted(x[1:] for x in of)
    return sizes


def test_shards_of_awkward_rows(spark, awkward):
    docs = awkward.select("doc_id", "text").collect()
    for shards in (1, 4, 40):
        _judge(kd_shards.kd_shards(awkward, shards).collect(), docs, shards)
    assert kd_shards.kd_shards(awkward.limit(0), 40).count() == 0


def test_a_third_of_all_rows_is_one_row(spark):
    rows = [(7, "the same text " * 20, "en", "a")] * 200 + [(i, f"text {i} " * (i % 30 + 1), "en", f"s{i % 5}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    sizes = _judge(kd_shards.kd_shards(docs, 10).collect(), docs.collect(), 10)
    assert max(sizes.values()) - min(sizes.values()) <= 4 * 300  # half a row for each cut above


def test_copies_stay_together_but_for_cuts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    twice = docs.unionByName(docs.withColumns({"doc_id": F.col("doc_id") + 100_000, "source": F.lit("elsewhere")}))
    of = defaultdict(set)
    for r in kd_shards.kd_shards(twice, 8).collect():
        of[r.text_crc32, r["size"]].add(r.shard)
    assert sum(len(s) > 1 for s in of.values()) <= 7
