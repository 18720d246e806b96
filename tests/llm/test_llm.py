"""The training-data operators against brute force, and on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyfold.llm import (
    bpe,
    components,
    html_extract,
    license_scan,
    line_crf,
    mixing,
    ngram_join,
    packing,
    queries,
    spotsigs,
    suffix_dedup,
    token_counts,
    token_files,
    words,
)
from tallyfold.llm.common import Scratch

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
BYTE_BPE, WORD_BPE, PIECES = (queries.tokenizer_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))

_BASE = " ".join(f"word{i} the river of stone{i % 7} and a light" for i in range(60))
#: Nulls everywhere, empty and long texts, ties, repeated rows.
ODD = [
    (1, _BASE, "en", "a", 1),
    (2, _BASE, "en", "a", 1),
    (2, _BASE, "en", "a", 1),
    (3, _BASE.replace("word5 ", "other "), "en", None, None),
    (4, None, None, None, None),
    (5, "", "en", "b", 0),
    (6, " \t\n ", "en", "b", 3),
    (None, "a document without an id, of the few", "en", "b", 9),
    (None, None, None, None, None),
    (7, "x" * 70_000, "en", "c", 70_000),
    (8, "one two", "en", "c", 7),
    (9, "One TWO", "en", "c", 7),
    (10, "Zürich – naïve “quotes” ́ 日本語 \U0001f600 \x85 \xa0 end", "de", "\U0001f600", 30),
    (11, "\n".join(["same line of text, no more"] * 40), "en", "b", 5),
]
TYPES = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """With columns whose names operators use themselves."""
    df = spark.createDataFrame(ODD, TYPES)
    return df.withColumns({c: F.lit("clash") for c in ("k1", "uid", "size", "kept", "n_words", "spans", "ids", "tokens", "key", "copies", "host")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], TYPES)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def as_key(row):
    return [(x is None, str(x)) for x in row]


# --- words


def test_words_and_shingles():
    column = [t or "" for _, t, *_ in ODD]
    raw, off = words.utf8(pa.array(column))
    w = words.Words(raw, off)
    assert w.per_text.tolist() == [len(WORDS.findall(t)) for t in column]
    hashes = [w.hash[a:b].tolist() for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    by_word = {}
    for t, h in zip(column, hashes, strict=True):
        for x, y in zip(WORDS.findall(t), h, strict=True):
            assert by_word.setdefault(x, y) == y
    assert len(set(by_word.values())) == len(by_word)


# --- op1


def brute_targets(sizes, cap):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, fixed, left = {}, set(), sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in fixed]
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] = left * weight[s] / total
        over = [s for s in open_ if target[s] > cap * sizes[s] + 1e-9]
        if not over:
            return target
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
            fixed.add(s)


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_mixing(which, request):
    df = request.getfixturevalue(which)
    rows = mixing.mix_sources(df).collect()
    assert len(rows) == df.count()
    size = Counter()
    for _, t, s in [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]:
        size[s] += len(WORDS.findall(t or ""))
    want = brute_targets(size, 3)
    taken = Counter()
    for r in rows:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source], abs=1e-6)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    largest = defaultdict(int)
    for r in rows:
        largest[r.source] = max(largest[r.source], r.size)
    for s in size:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1
    again = mixing.mix_sources(df.repartition(5)).collect()
    pick = lambda rs: sorted(((r.doc_id, r.source, r.size, r.taken) for r in rs), key=as_key)
    assert pick(again) == pick(rows)


def test_mixing_is_exponential_in_size(docs):
    rows = [r for r in mixing.mix_sources(docs).collect() if 0 < r.rate < 3 and r.size]
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(np.log(r.rate) / r.size)
    assert all(np.ptp(v) < 1e-9 for v in by.values())


# --- op2

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>menu {n}</a></li></ul></nav><div class="ad">buy {n}</div>
<{tag}><h1>Title &amp; more {n}</h1><p>one <b>two</b>
  three {n}<p>caf&eacute; &#x41; {n}<div class="comments"><p>nice {n}</p></div><form>mail {n}</form></{tag}>
<aside>side {n}</aside><div id="cookie-notice">we use cookies</div><footer>foot {n}</footer></body></html>"""


def test_extract(spark):
    rows = []
    for host, tag in (("a.example", "article"), ("b.example", "div"), ("c.example", "section")):
        rows += [(len(rows), f"https://{host}/{n}", PAGE.format(n=n, tag=tag)) for n in range(12)]
    rows += [(100, None, None), (101, "", ""), (102, "odd", "plain text &lt; only"), (103, "https://a.example/0", rows[0][2]), (None, "https://a.example/x", "<p>unclosed <")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "slot", "text", "constant")})
    got = {(r.page_id, r.url): r for r in html_extract.extract(df).collect()}
    assert len(got) == len(rows)
    for i, url, _ in rows[:36]:
        n = url.rsplit("/", 1)[1]
        assert got[i, url].text == f"Title & more {n}\none two three {n}\ncafé A {n}"
        assert got[i, url].n_chars == len(got[i, url].text)
    assert got[100, None].text == "" and got[102, "odd"].text == "plain text < only" and got[103, "https://a.example/0"].text == got[0, "https://a.example/0"].text
    assert html_extract.extract(df.limit(0)).count() == 0


def test_constant_text_is_template(spark):
    rows = [(n, f"https://h/{n}", f"<body><div><p>Follow us today</p><p>story number {n} is {n * n}</p></div></body>") for n in range(20)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {n: f"story number {n} is {n * n}" for n in range(20)}


def test_template_of_few_pages_and_of_two_layouts(spark):
    rows = [(n, f"https://few/{n}", f"<body><div class=x>Follow us today</div><p>story {n}</p></body>") for n in range(2)]
    for n in range(2, 12):
        kind, note = ("a", "first layout") if n < 8 else ("b", "second layout")
        rows.append((n, f"https://two/{n}", f"<body><div class={kind}><div>{note}</div><p>story {n}</p></div></body>"))
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {n: f"story {n}" for n in range(12)}


def test_slot_holds_all_varying_text(spark):
    story, long = "a long story about {n} ", "the same words of the house on each page "
    rows, want = [], {}
    for n in range(6):
        body = (story * 40).format(n=n).strip()
        for k, page, lines in (
            (0, f"<article><h1>Title {n}</h1><p>Lead {n}</p><div class=body><p>{body}</p></div><div><p>End {n}</p></div></article>", [f"Title {n}", f"Lead {n}", body, f"End {n}"]),
            (1, f"<h1>Title {n}</h1><div><p>{body}</p></div>", [f"Title {n}", body]),
            (2, f"<article><p>teaser {n}</p></article><div><p>{body}</p></div>", [f"teaser {n}", body]),
            (3, f"<div class=a><p>{long * 400}</p></div><div class=b><p>{body}</p></div>", [body]),
        ):
            rows.append((10 * k + n, f"https://slot{k}/{n}", f"<body>{page}</body>"))
            want[10 * k + n] = "\n".join(lines)
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want


def test_tree_matching():
    a = ["html", 1, 0, [["a", 1, 5, []], ["b", 1, 1, []], ["c", 1, 2, []]]]
    b = ["html", 1, 0, [["a", 1, 4, []], ["x", 1, 9, []], ["c", 1, 1, []]]]
    assert html_extract._match(a, b, {}) == 3
    out = html_extract.align(a, b)
    assert out[1] == 2 and [(k[0], k[1], k[2]) for k in out[3] if k[0] in "ac"] == [("a", 2, 9), ("c", 2, 3)] and len(out[3]) == 4


def test_real_pages(spark, sf):
    import html as entities

    for r in spark.read.parquet(f"{sf}/pages.parquet").join(html_extract.extract(spark.read.parquet(f"{sf}/pages.parquet")).select("page_id", "text"), "page_id").collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(x for x in parts if x)


def test_names_of_layouts_are_content():
    def text(page):
        return " ".join(t for _, t in html_extract.blocks(html_extract.parse(page)))

    for wrap in ('div class="layout has-sidebar"', 'article class="no-comments"', 'main class="page widget"', 'div class="form-story"', 'div class="with-banner"', 'div class="page-widget"'):
        assert text(f"<body><{wrap}><h1>Title</h1><p>a story of some length</p></{wrap.split()[0]}></body>") == "Title a story of some length"
    assert text('<article><header class="entry-header"><h1>Title</h1></header><div class="post-header">lead</div><p>story</p></article>') == "Title lead story"
    for name in ("ad", "ad-slot", "sidebar-left", "site-footer", "cookie-notice", "box comments"):
        assert text(f'<body><p>story</p><div class="{name}">noise</div></body>') == "story"


def test_hard_pages():
    def text(page):
        return [t for _, t in html_extract.blocks(html_extract.parse(page))]

    assert text("<div>" * 5000 + "deep" + "</div>" * 5000 + "<b>" * 50_000 + "end") == ["deep", "end"]
    assert text('x <a href="un>closed z') == ["x closed z"] and text("<a title=it's>one</a> don't") == ["one don't"]
    assert text('<p title="a hidden gem" data-id="sidebar">one &amp; two<p hidden>three') == ["one & two"]
    assert text("<div class=sidebar>the only text</div>") == ["the only text"]  # names that leave nothing say nothing
    long = "c" * 60
    labels = [html_extract.parse(f"<div class='{long}{x}'>t</div>").kids[0].label for x in "ab"]
    assert labels[0] != labels[1] and all(len(x) < 40 for x in labels)


def test_deep_pages_and_hosts_of_many_shapes(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "FAN_IN", 3)
    rows = [(n, "https://many/", f"<body><div>Follow us</div>{'<div>' * (n % 7)}<section class=s{chr(97 + n % 20)}><p>story {n}</p></section></body>") for n in range(60)]
    rows += [(100 + n, "https://deep/", "<div>" * 2000 + f"deep {n}") for n in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert got == {n: f"story {n}" for n in range(60)} | {100 + n: f"deep {n}" for n in range(3)}
    assert got == {r.page_id: r.text for r in html_extract.extract(df.repartition(7)).collect()}


def test_matching_equals_brute_force():
    rng = np.random.default_rng(8)

    def grow(depth):
        return [str(rng.choice(list("abc"))), 1, 1, [grow(depth - 1) for _ in range(rng.integers(0, 4))] if depth else []]

    def brute(a, b):
        if a[0] != b[0]:
            return 0
        best = [[0] * (len(b[3]) + 1) for _ in range(len(a[3]) + 1)]
        for i, x in enumerate(a[3]):
            for j, y in enumerate(b[3]):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + brute(x, y))
        return best[-1][-1] + 1

    for _ in range(60):
        a, b = grow(3), grow(3)
        a[0] = b[0] = "root"
        assert html_extract._match(a, b, {}) == brute(a, b)
        pages = lambda t: t[1] + sum(map(pages, t[3]))
        assert pages(html_extract.align(a, b)) == pages(a) + pages(b)


# --- op3


def test_spots_of_any_anchors_take_linear_time(spark):
    import time

    for t in ("the " * 250_000 + "stone river", "stone river " + "the " * 250_000, "the stone " * 100_000):
        df = spark.createDataFrame([(1, t)], "doc_id long, text string")
        start = time.perf_counter()
        assert df.select(F.size(spotsigs.signatures(F.col("text"))).alias("n")).first().n >= 1
        assert time.perf_counter() - start < 60


def brute_spots(text):
    w = [x for x in re.sub(r"[\W_]+", " ", text.lower()).split(" ") if x]
    out = set()
    for i, x in enumerate(w):
        if x in set(spotsigs.ANCHORS):
            chain = [y for y in w[i + 1 :] if y not in set(spotsigs.ANCHORS)][: spotsigs.CHAIN]
            if len(chain) == spotsigs.CHAIN:
                out.add((x, *chain))
    return out or {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else {text})


def test_spotsigs(docs):
    rows = sorted((d, t or "") for d, t in texts(docs))
    got = {r.doc_id: r for r in spotsigs.edited_fingerprints(docs).collect()}
    for i, (d, t) in enumerate(rows):
        following, half, r = rows[(i + 1) % len(rows)][1], len(t) // 2, got[d]
        edited = t[: len(t) - half] + following[:half]
        a, b, c = brute_spots(t), brute_spots(edited), brute_spots(following)
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (len(r.fingerprint), len(r.edited_fingerprint)) == (8 * len(a), 8 * len(b))
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b)) and r.near_next == pytest.approx(len(a & c) / len(a | c))


def test_spotsigs_odd(odd, none):
    rows = spotsigs.edited_fingerprints(odd).collect()
    assert len(rows) == len(ODD)
    prints = defaultdict(set)
    for r in rows:
        prints[r.doc_id].add(r.fingerprint)
    assert prints[1] == prints[2] and all(r.fingerprint for r in rows)
    twins = [r.near_next for r in rows if r.doc_id == 2]
    assert 1.0 in twins and len(twins) == 2
    assert spotsigs.edited_fingerprints(none).count() == 0
    one = odd.filter("doc_id = 1")
    assert spotsigs.edited_fingerprints(one).first().near_next == 1.0


def test_spotsigs_pairs(docs):
    sets = docs.select(F.col("doc_id").alias("id"), spotsigs.signatures(F.coalesce("text", F.lit(""))).alias("sigs"))
    rows = {r.id: frozenset(r.sigs) for r in sets.collect()}
    first = {}
    for i in sorted(rows):
        first.setdefault(rows[i], i)
    ids = sorted(first.values())
    want = {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(rows[a] & rows[b]) >= 0.8 * len(rows[a] | rows[b])}
    assert {(r.id_a, r.id_b) for r in spotsigs.near_pairs(sets, 0.8).collect()} == want


def test_native(spark, odd):
    for df in (mixing.mix_sources(odd), spotsigs.edited_fingerprints(odd)):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|InArrow", plan)


# --- op4


@given(st.lists(st.text(alphabet="abcXÉéß'’.,!?;:-_#$1½Ⅷ  \n\t\x0b\x85\xa0 　́日😀Σς|<>", max_size=30), max_size=20))
@settings(max_examples=60, deadline=None)
def test_units_encode_like_texts(parts):
    parts = [*parts, "<|endoftext|> ".join(parts), "  <|startoftext|>".join(parts)]
    for path in (BYTE_BPE, WORD_BPE):
        enc = bpe.encoder(path)
        assert enc.ids(parts) == enc._whole(parts)


def token_rows(df, folder=None):
    return token_files.token_files(df, BYTE_BPE, 0, folder).collect()


def test_token_files(spark, odd, none, tmp_path):
    got = token_rows(odd, f"file://{tmp_path}/t")
    enc = bpe.encoder(BYTE_BPE)
    want = Counter()
    for d, t, *_ in ODD:
        ids = np.append(np.frombuffer(enc._whole([t or ""])[0], "<u4"), np.uint32(0))
        want[d, len(ids), zlib.crc32(ids.astype("<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == np.cumsum([0, *[r.n_tokens for r in order]])[:-1].tolist()
    known = [r.doc_id for r in order]
    assert known[:2] == [None, None] and known[2:] == sorted(known[2:])
    assert (tmp_path / "t").exists() and not [p for p in (tmp_path / "t").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]
    assert token_rows(none) == []


# --- op5


def test_token_counts(odd, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(odd, PIECES, chunk=500, overlap=3).collect())
    want = Counter()
    for d, t, *_ in ODD:
        n = len(sp.encode(t or ""))
        want[d, len((t or "").encode()), n, n > 4096] += 1
    assert got == want and token_counts.token_counts(none, PIECES).count() == 0


@given(st.text(alphabet="ab é日😀\n\t ▁", max_size=400), st.integers(1, 60), st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_splices(text, chunk, overlap):
    counter = token_counts.piece_counter(PIECES)
    assert counter.count([text], chunk, overlap) == [len(counter.sp.encode(text))]


# --- op6


def test_licenses(spark, none):
    rows = [
        (1, "Some text.\nLicensed under the Apache License, Version 2.0.\nMore."),
        (2, "// Permission is hereby granted, free of charge, to any person obtaining a copy\n// of this software and associated documentation files (the \"Software\"), to deal\n"
            "// in the Software without restriction, including without limitation the rights\n// to use, copy, modify, merge, publish, distribute, sublicense, and/or sell\n"
            "// copies of the Software, and to permit persons to whom the Software is\n// furnished to do so, subject to the following conditions:\n//\n"
            "// The above copyright notice and this permission notice shall be included in\n// all copies or substantial portions of the Software."),
        (3, "This work is licensed under the GNU General Public License, version 2."),
        (4, "He asked for permission, and drove without a license."),
        (5, None), (6, ""), (None, "Copyright 2020 Foo. All rights reserved."), (1, "Licensed under CC BY-SA 4.0."),
    ]
    got = license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("x"))).collect()
    named = Counter((r.doc_id, r.license) for r in got)
    assert named == Counter({(1, "Apache-2.0"): 1, (2, "MIT"): 1, (3, "GPL-2.0"): 1, (4, None): 1, (5, None): 1, (6, None): 1, (None, "all-rights-reserved"): 1, (1, "CC-BY-SA-4.0"): 1})
    assert license_scan.license_scan(none).count() == 0


def test_wrapped_notices_are_found_whole():
    later = "This {} is free software: you can redistribute it and/or modify\nit under the terms of the GNU {}General Public License as published by\nthe Free Software Foundation, either version {} of the License, or\n(at your option) any later version.\n"
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.\n"
    apache = "Licensed under the Apache License,\nVersion 2.0.\n"
    scan = license_scan.Scanner()

    def names(text):
        return sorted(f[1] for f in scan.scan(text)[1])

    prose = "The river runs past the town and its stones.\n" * 60
    assert names(prose + later.format("program", "", "3") + prose) == ["GPL-3.0"]
    assert names(later.format("program", "", "2")) == ["GPL-2.0"] and names(later.format("program", "Affero ", "3")) == ["AGPL-3.0"]
    assert names(later.format("library", "Lesser ", "2.1")) == ["LGPL-2.1"] and names(later.format("library", "Lesser ", "3")) == ["LGPL-3.0"]
    assert names(prose + mpl + "\n" + apache + later.format("program", "", "3") + prose) == ["Apache-2.0", "GPL-3.0", "MPL-2.0"]
    assert names("No license here.\n" + prose) == []


def test_each_wording_is_its_own():
    scan = license_scan.Scanner()
    for name, wordings in license_scan.TEMPLATES.items():
        for wording in wordings:
            found = scan.confirm(wording)
            assert found[0] == name and found[3:] == (0, 0)


# --- op7


def brute_repeats(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, data, strict=True):
        hit = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                hit[i : i + length] = True
        kept = bytes(x for x, h in zip(b, hit, strict=False) if not h)
        out.append((d, len(b), len(b) - len(kept), int((hit[:-1] & ~np.roll(hit, 1)[:-1]).sum() if len(b) else 0), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=as_key)


def spans_of(df, **more):
    return sorted((tuple(r) for r in suffix_dedup.remove_repeats(df.select("doc_id", "text"), **more).collect()), key=as_key)


def test_repeats(spark, odd, docs, none):
    assert spans_of(odd) == brute_repeats([(r[0], r[1]) for r in ODD], 200)
    assert spans_of(docs) == brute_repeats(texts(docs), 200)
    assert spans_of(none) == []
    clash = suffix_dedup.remove_repeats(odd, with_text=True)
    assert {"uid", "kept_text", "lang"} <= set(clash.columns) and "k1" not in clash.columns and clash.count() == len(ODD)


def test_hot_anchors_and_pieces(spark, docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", 2)
    monkeypatch.setattr(suffix_dedup, "HEAVY", 0)  # test_repeats deals nearly all anchors by their contexts, this one none
    assert spans_of(docs) == brute_repeats(texts(docs), 200)


@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 3), st.integers(0, 1)), max_size=40), st.integers(1, 9), st.booleans())
@settings(max_examples=200, deadline=None)
def test_meeting_of_runs_streams(runs, step, heavy):
    """Whatever the batches: equal contexts, and one of each context of anchors with several."""
    runs = sorted(runs)
    place = [i << 12 | 3 << 1 | many for i, (_, _, many) in enumerate(runs)]
    columns = [[r[0] for r in runs], [r[1] for r in runs], [0] * len(runs), [0] * len(runs), place, [heavy] * len(runs)]
    table = pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.int32(), pa.int64(), pa.bool_()], strict=True)],
        names=["anchor", "context", "k1", "k2", "place", "heavy"],
    )
    kept, suffix_dedup.KEPT_RUNS = suffix_dedup.KEPT_RUNS, 3
    try:
        parts = [table.slice(a, step) for a in range(0, len(runs), step)]
        got = [r for b in suffix_dedup._meet(200)(iter(parts)) for r in b.to_pylist()]
    finally:
        suffix_dedup.KEPT_RUNS = kept
    groups, contexts = defaultdict(list), defaultdict(set)
    for i, (anchor, context, many) in enumerate(runs):
        groups[anchor, context].append((i, many))
        contexts[anchor].add(context)
    equal, edges = [], []
    for (anchor, _), rows in groups.items():
        again = len(rows) + sum(many for _, many in rows) > 1
        equal += [i for i, many in rows if again and not many]
        edges += [(anchor, rows[0][0], not again)] * (heavy or len(contexts[anchor]) > 1)
    assert sorted(r["a"] for r in got if r["anchor"] is None) == sorted(equal)
    assert sorted((r["anchor"], r["a"], r["needs"]) for r in got if r["anchor"] is not None) == sorted(edges)
    assert all(r["b"] == r["a"] + 3 + 200 for r in got)


@given(st.lists(st.text(alphabet="ab", max_size=120), max_size=8))
@settings(max_examples=80, deadline=None)
def test_refine(parts):
    data = [p.encode() for p in parts]
    raw = np.frombuffer(b"".join(data), "u1")
    off = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype("i8")
    for length in (5, 70):
        seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
        want = [i + length <= len(d) and seen[d[i : i + length]] > 1 for d in data for i in range(len(d))]
        assert suffix_dedup.refine(raw, off, length).tolist() == want


def test_runs_depend_on_content():
    text = (b"abcdefghij" * 3 + bytes(range(97, 122))) * 12
    whole = suffix_dedup.runs(np.frombuffer(text, "u1"), np.array([0, len(text)]), 40, 8)
    cut = text[7:]
    part = suffix_dedup.runs(np.frombuffer(cut, "u1"), np.array([0, len(cut)]), 40, 8)
    at = {s: a for lo, hi, a in zip(whole[1], whole[2], whole[3], strict=True) for s in range(lo, hi + 1)}
    for lo, hi, a in zip(part[1], part[2], part[3], strict=True):
        assert all(at[s + 7] == a for s in range(lo, hi + 1))


# --- op8


def check_packing(df, rows, window):
    enc = bpe.encoder(WORD_BPE)
    want = Counter()
    for _, t in texts(df):
        want[len(np.frombuffer(enc._whole([t or ""])[0], "<u4")) + 1] += 1
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window and (at == window or at & (at - 1) == 0)
    assert sum(r.length for r in rows) == sum(k * n for k, n in want.items())


def test_packing(odd, docs, none):
    for df, size in ((odd, 64), (docs, 4096)):
        rows = packing.pack(df, WORD_BPE, 2, size, shard_tokens=30_000).collect()
        check_packing(df, rows, size)
    enc = bpe.encoder(WORD_BPE)
    parts = defaultdict(list)
    for r in rows:
        parts[r.doc_id].append(r)
    for d, t in texts(docs):
        ids = np.append(np.frombuffer(enc._whole([t or ""])[0], "<u4"), np.uint32(2))
        at = 0
        for r in sorted(parts[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and zlib.crc32(ids[at : at + r.length].astype("<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    assert packing.pack(none, WORD_BPE, 2).count() == 0


def test_neighbours_share_words():
    rng = np.random.default_rng(3)
    topics = [rng.integers(6000 + 500 * k, 6500 + 500 * k, 400) for k in range(4) for _ in range(10)]
    index = packing.Index([t.astype("u2") for t in topics], np.ones(49_408))
    free = np.ones(40, bool)
    free[3] = False
    found = index.neighbours(2, free, 9)
    assert set((found // 10).tolist()) == {0} and 3 not in found


def test_neighbours_are_those_of_all_terms():
    rng = np.random.default_rng(5)
    docs = [np.unique(rng.zipf(1.2, 60) % 8000).astype("u2") for _ in range(120)]  # nearly all ids are frequent ones
    idf = rng.random(49_408) + 0.01
    idf[1] = 0
    index, mean = packing.Index(docs, idf), np.mean([len(d) for d in docs])
    free = np.ones(120, bool)
    for seed in range(100):
        free[seed] = False
        norm = [packing.K1 * (1 - packing.B + packing.B * len(d) / mean) for d in docs]
        score = [sum(idf[t] * (packing.K1 + 1) / (1 + norm[i]) for t in set(d.tolist()) & set(docs[seed].tolist())) if free[i] else 0 for i, d in enumerate(docs)]
        want = sorted((i for i in range(120) if score[i] > 0), key=lambda i: (-score[i], i))[:7]
        assert np.allclose([score[i] for i in index.neighbours(seed, free, 7)], [score[i] for i in want])
    free[:] = True  # documents may come back
    assert len(index.neighbours(0, free, 200)) > 100


def test_pages_of_neighbours_fill_the_window():
    def evens(seed, free):
        return np.array([i for i in range(0, 200, 2) if free[i]][: packing.NEIGHBOURS], "i8")

    pieces = packing.pack_shard([10] * 200, evens, 1000)
    assert {p[0] for p in pieces if p[3] == 0} == set(range(0, 200, 2))


def test_columns_encode_like_texts(monkeypatch):
    rng = np.random.default_rng(9)
    stems = ["".join(rng.choice(list("abcdeéßñ’'.,!#日"), rng.integers(1, 9))) for _ in range(400)]
    texts_ = [" ".join(rng.choice(stems, rng.integers(0, 40))) + rng.choice(["", "\n", "  ", "\x85", "\x1c\xa0x"]) for _ in range(300)] + ["", " ", "a<|endoftext|>b"]
    for units in (1_000_000, 50):  # a memo that is trimmed all the time
        monkeypatch.setattr(bpe, "MEMO_UNITS", units)
        enc = bpe.Encoder(WORD_BPE)
        for part in (texts_[:100], texts_[100:200], texts_[200:-1], texts_):
            ids, n = enc.column(pa.array(part))
            want = enc._whole(part)
            assert ids.tobytes() == b"".join(want) and n.tolist() == [len(w) // 4 for w in want]


# --- op9


def brute_base(text):
    w = WORDS.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality(spark, sf, odd, docs, none):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    field = line_crf.train(docs, labels)
    for df in (odd, docs):
        got = line_crf.quality(df, field)
        rows = got.collect()
        assert len(rows) == df.count() and got.columns.count("kept") == 1
        for r in rows:
            base = brute_base(r.text or "")
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
            assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0])
            assert not (r.base_failed and r.kept)
    judged = {r.doc_id: r for r in line_crf.quality(docs, field).collect()}
    good = [judged[r.doc_id] for r in labels.filter("quality = 1").collect()]
    bad = [judged[r.doc_id] for r in labels.filter("quality = 0").collect()]
    assert all(r.kept for r in good if not r.base_failed)
    assert sum(r.kept for r in bad) <= 0.1 * len(bad)
    assert line_crf.quality(none, field).count() == 0
    assert line_crf.train(docs, labels.limit(0)) is None and line_crf.quality(docs, None).filter("kept").count() > 0


def test_viterbi_is_best():
    rng = np.random.default_rng(1)
    field = line_crf.Field(rng.normal(size=(2, 3)), rng.normal(size=(2, 2)))
    first = np.array([0, 5, 5, 9])
    x = rng.normal(size=(9, 3))
    got = field.viterbi(x, first)
    for a, b in zip(first[:-1], first[1:], strict=True):
        def score(path, a=a):
            s = sum(x[a + i] @ field.weights[p] for i, p in enumerate(path))
            return s + sum(field.moves[p, q] for p, q in zip(path[:-1], path[1:], strict=True))

        paths = [[k >> i & 1 for i in range(b - a)] for k in range(1 << (b - a))]
        assert got[a:b].tolist() == max(paths, key=score)


def test_gradient():
    rng = np.random.default_rng(2)
    field = line_crf.Field(rng.normal(size=(2, 3)), rng.normal(size=(2, 2)))
    first, x, y = np.array([0, 3, 3, 7]), rng.normal(size=(7, 3)), rng.integers(0, 2, 7)

    def likelihood(weights, moves):
        total = 0.0
        for a, b in ((0, 3), (3, 7)):
            def score(path, a=a):
                return sum(x[a + i] @ weights[p] for i, p in enumerate(path)) + sum(moves[p, q] for p, q in zip(path[:-1], path[1:], strict=True))

            paths = [[k >> i & 1 for i in range(b - a)] for k in range(1 << (b - a))]
            total += score(y[a:b].tolist()) - np.logaddexp.reduce([score(p) for p in paths])
        return total

    g, h = field.gradient(x, y, first)
    for at in np.ndindex(2, 3):
        more = field.weights.copy()
        more[at] += 1e-6
        assert g[at] == pytest.approx((likelihood(more, field.moves) - likelihood(field.weights, field.moves)) / 1e-6, abs=1e-4)
    for at in np.ndindex(2, 2):
        more = field.moves.copy()
        more[at] += 1e-6
        assert h[at] == pytest.approx((likelihood(field.weights, more) - likelihood(field.weights, field.moves)) / 1e-6, abs=1e-4)


# --- op10


def brute_join(rows, k, num, den):
    sets = []
    for _, t in rows:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    forest, links, where = components.Forest(len(rows)), [0] * len(rows), defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in where[x])
        for x in s:
            where[x].append(i)
        for j, both in common.items():
            if den * both >= num * (len(s) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                forest.join(i, j)
    name = {}
    for i, (d, _) in enumerate(rows):
        r = forest.find(i)
        if d is not None:
            name[r] = min(d, name.get(r, d))
    return sorted(((d, len(sets[i]), name.get(forest.find(i)) if sets[i] else d, links[i]) for i, (d, _) in enumerate(rows)), key=as_key)


@pytest.mark.parametrize("k, num, den", [(3, 90, 100), (5, 80, 100)])
def test_jaccard_join(odd, docs, none, k, num, den):
    for df in (odd, docs):
        got = sorted((tuple(r) for r in ngram_join.jaccard_join(df, k, num, den).collect()), key=as_key)
        assert got == brute_join(texts(df), k, num, den)
    assert ngram_join.jaccard_join(none, k, num, den).count() == 0


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_jaccard_join_in_small_blocks(spark, monkeypatch, broadcast):
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(150):
        w = list(base)
        for at in rng.integers(0, 90, rng.integers(0, 5)):
            w[at] = f"x{rng.integers(0, 40)}"
        rows.append((i, " ".join(w[: 90 - int(rng.integers(0, 12))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_join(rows, 3, 80, 100)
    for name, value in (("BLOCK_SETS", 20), ("WINDOW", 500)):
        monkeypatch.setattr(ngram_join, name, value)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", broadcast)
    assert sorted((tuple(r) for r in ngram_join.jaccard_join(df, 3, 80, 100).collect()), key=as_key) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (200, 200)] + [(300, x) for x in range(301, 320)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(7), Scratch(spark, "t")).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 1), **dict.fromkeys((100, 101, 102), 100), **dict.fromkeys(range(300, 320), 300)}
    assert components.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


# --- pipeline


def test_pipeline(spark, sf, docs):
    import corpus_pipeline as pipeline

    kept = docs
    counts = [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, kept, sf).cache()
        counts.append(kept.count())
        assert kept.columns == list(pipeline.COLUMNS)
        if name.startswith("n-gram"):
            joined = brute_join(texts(before), 5, 80, 100)
            assert {d for d, _ in texts(kept)} == {d for d, _, c, _ in joined if d == c}
        if name.startswith("suffix"):
            removed = brute_repeats(texts(before), 200)
            whole = {d for d, n, gone, *_ in removed if n and n == gone}
            assert {d for d, _ in texts(kept)} == {d for d, _ in texts(before)} - whole
            assert {hashlib.sha256((t or "").encode()).hexdigest() for _, t in texts(kept)} <= {r[4] for r in removed}
    assert counts[1] < counts[0] and counts[2] < counts[1]
    check_packing(kept, pipeline.STAGES[-1][1](spark, kept, sf).collect(), 4096)


def test_stages_on_odd_rows(spark, sf, odd, none):
    import corpus_pipeline as pipeline

    known = Counter((r.doc_id, r.text) for r in odd.collect())
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0
        rows = stage(spark, odd, sf).collect()
        found = Counter((r.doc_id, r.text) for r in rows) if name != "packing" else Counter()
        if name.startswith("quality") or name.startswith("n-gram"):
            assert not found - known  # rows go, none is changed
        if name.startswith("quality"):
            assert all(len(WORDS.findall(t or "")) >= 50 for _, t in found)
        if name.startswith("n-gram"):
            assert found[4, None] == found[5, ""] == found[1, _BASE] == 1 and not found[2, _BASE]
        if name.startswith("suffix"):
            assert all(found[k] == known[k] for k in ((4, None), (5, ""), (9, "One TWO")))
        if name.startswith("mixing"):
            assert set(found) <= set(known) and all(n <= 3 * known[k] for k, n in found.items()) and found[4, None] == 1
        if name == "packing":
            check_packing(odd, rows, 4096)


@pytest.mark.parametrize("n", range(1, 11))
def test_registered(n):
    assert len([q for q in entry.queries() if q.startswith(f"op{n}_")]) == 1


def test_shared_folder_is_needed_on_a_cluster(spark):
    from types import SimpleNamespace

    from tallyfold.llm import common

    class Conf(dict):
        set = dict.__setitem__

    for master, fails in (("spark://host:7077", True), ("yarn", True), ("local[2]", False)):
        session = SimpleNamespace(conf=Conf(), sparkContext=SimpleNamespace(master=master))
        if fails:
            with pytest.raises(RuntimeError):
                common.shared_root(session)
        else:
            assert common.shared_root(session).startswith("file:")


def test_strings_too_long_for_a_run(docs):
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(docs.select("doc_id", "text"), length=2100)
