"""Main texts by aligned wrappers."""

import numpy as np

from tallyfold.llm import html_extract


# --- op2: aligned nodes decide


def _texts(pages):
    """Texts of one host's pages, without Spark."""
    trees = [html_extract.shape(*html_extract.outline(html_extract.parse(p))) for p in pages]
    out = trees[0]
    for t in trees[1:]:
        out = html_extract.align(out, t)
    wrap = html_extract.wrapper(out)
    return [html_extract.main_text(p, wrap) for p in pages]


STORY = "a long story of the day {n} that goes on for a while {n} and then some more "


def test_varying_blocks_beside_the_article_never_leak():
    names = "comments-section comment-thread related-posts ad-300x250 footer-widgets menu-item sidebar-inner cookie-banner-text nav-main advert-top site-footer-text reader-feedback discussion top-stories zq plain"
    for tag in ("article", "div class=story"):
        for name in names.split():
            end = tag.split()[0]
            pages = [f"<body><{tag}><h1>Title {n}</h1><p>{(STORY * 6).format(n=n)}</p></{end}><div class={name}><p>noise {n} {n * n}</p></div></body>" for n in range(6)]
            assert _texts(pages) == [f"Title {n}\n{(STORY * 6).format(n=n).strip()}" for n in range(6)], (tag, name)


def test_constant_lines_of_articles_stay():
    for tag in ("article", "main", "div class=entry"):
        pages = [f"<body><{tag}><h1>Weekly column</h1><p>{STORY.format(n=n)}</p><p>As always:</p><p>more {n}</p></{tag.split()[0]}><div>All rights reserved</div></body>" for n in range(10)]
        assert _texts(pages) == [f"Weekly column\n{STORY.format(n=n).strip()}\nAs always:\nmore {n}" for n in range(10)]


def test_alignment_decides():
    # Two boxes without names; on some pages the second is longer, and only the host's other pages tell which is the story.
    pages = [f"<body><div class=q><p>{(STORY * (1 if n == 3 else 9)).format(n=n)}</p></div><div class=r><p>{'re %d ' % n * (90 if n == 3 else 2)}</p></div></body>" for n in range(8)]
    want = [(STORY * (1 if n == 3 else 9)).format(n=n).strip() for n in range(8)]
    assert _texts(pages) == want
    alone = [_texts([p])[0] for p in pages]
    assert alone[3] != want[3]
    # The same words are template in one place and content in another.
    pages = [f"<body><div class=top>Our daily note</div><div class=q><p>{STORY.format(n=n)}</p>{'<p>Our daily note</p>' if n == 2 else ''}</div></body>" for n in range(6)]
    assert _texts(pages)[2] == STORY.format(n=2).strip() + "\nOur daily note"


def test_frequent_texts_are_found_in_any_order():
    rng = np.random.default_rng(3)
    for share in (0.85, 1.0, 0.5):
        seen = []
        for n in range(200):
            seen.append(["p", 1, 9, [], sorted([[7, 1, 4]] * (rng.random() < share) + [[100 + 5 * n + k, 1, 5] for k in range(4)])])
        while len(seen) > 1:  # in pairs, as steps do
            seen = [html_extract.align(*seen[i : i + 2]) if i + 1 < len(seen) else seen[i] for i in range(0, len(seen), 2)]
        assert (html_extract.constants(seen[0]) == [7]) == (share > 0.8)


def test_hot_hosts_beyond_the_broadcast(spark, monkeypatch):
    rows = [(n, f"https://{'hot' if n % 3 else f'h{n}'}/{n}", f"<body><div>Follow us today</div><div class=q><p>story {n}</p></div></body>") for n in range(60)]
    rows += [(None, None, None), (61, "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(str, html_extract.extract(df).collect()))
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(html_extract, "HOT_HOSTS", 4)
    assert sorted(map(str, html_extract.extract(df).collect())) == want
    assert sum("text='story" in x for x in want) >= 40
