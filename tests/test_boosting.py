"""Boosted trees against a trainer that looks at every row for every split."""

import math
from statistics import median

import numpy as np
import pytest

from tallyfold.operators import boosting as B


def _slopes(c, y, s):
    if c.objective == "absolute":
        return (0.0 if s == y else math.copysign(1.0, s - y)), 1.0
    if c.objective == "poisson":
        return math.exp(s) - y, math.exp(s + 0.7)
    return math.exp((2 - c.power) * s) - y * math.exp((1 - c.power) * s), (2 - c.power) * math.exp((2 - c.power) * s) - (1 - c.power) * y * math.exp((1 - c.power) * s)


def _above(x, edge):
    """Nulls are above all numbers."""
    return x is None or x > edge


def _best(c, rows, kinds, g, h, idx):
    """The best split of some rows: (gain, feature, rows on the left)."""
    total_g, total_h = sum(g[i] for i in idx), sum(h[i] for i in idx)
    whole = total_g**2 / (total_h + c.ridge)
    best = None

    def judge(f, left, ridge):
        nonlocal best
        right = len(idx) - len(left)
        if len(left) < c.least_rows or right < c.least_rows:
            return
        gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
        if hl < c.least_hessian or total_h - hl < c.least_hessian:
            return
        gain = gl**2 / (hl + ridge) + (total_g - gl) ** 2 / (total_h - hl + ridge) - whole
        if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
            best = gain, f, set(left)

    for f, kind in enumerate(kinds):
        if kind == "number":
            known = sorted({r[f] for r in rows if r[f] is not None})
            for a, b in zip(known, known[1:], strict=False):
                judge(f, [i for i in idx if not _above(rows[i][f], (a + b) / 2)], c.ridge)
            if known:
                judge(f, [i for i in idx if rows[i][f] is not None], c.ridge)
        else:
            of = {}
            for i in idx:
                if rows[i][f] is not None:
                    of.setdefault(rows[i][f], []).append(i)
            used = [k for k in sorted(of) if len(of[k]) >= c.category_smooth]
            used.sort(key=lambda k: sum(g[i] for i in of[k]) / (sum(h[i] for i in of[k]) + c.category_smooth))
            for way in (used, used[::-1]):
                for n in range(1, min(len(way), c.most_categories) + 1):
                    judge(f, [i for k in way[:n] for i in of[k]], c.ridge + c.category_ridge)
    return best


def plain_fit(c, rows, kinds, ys):
    """Scores of the rows after each round."""
    s = [median(ys) if c.objective == "absolute" else math.log(sum(ys) / len(ys))] * len(ys)
    out = []
    for _ in range(c.rounds):
        slopes = [_slopes(c, y, x) for y, x in zip(ys, s, strict=True)]
        g, h = [a for a, _ in slopes], [b for _, b in slopes]
        leaves = [(list(range(len(ys))), None)]
        leaves[0] = (leaves[0][0], _best(c, rows, kinds, g, h, leaves[0][0]))
        while len(leaves) < c.leaves:
            at = max(range(len(leaves)), key=lambda k: leaves[k][1][0] if leaves[k][1] else -1)
            if leaves[at][1] is None:
                break
            idx, (_, _, left) = leaves.pop(at)
            for part in ([i for i in idx if i in left], [i for i in idx if i not in left]):
                leaves.append((part, _best(c, rows, kinds, g, h, part)))
        if len(leaves) == 1:
            break
        for idx, _ in leaves:
            v = median(ys[i] - s[i] for i in idx) if c.objective == "absolute" else -sum(g[i] for i in idx) / (sum(h[i] for i in idx) + c.ridge)
            for i in idx:
                s[i] += c.rate * v
        out.append(list(s))
    return out


def _table(seed, n, ties=False):
    r = np.random.default_rng(seed)
    a, b, k = r.integers(0, 12, n), r.normal(size=n).round(2), r.integers(0, 9, n)
    y = np.maximum(0, np.round(3 + 2 * np.sin(a) + (k % 3) * 4 + b + r.exponential(1, n), 0 if ties else 3))
    return [(None if i % 31 == 0 else float(a[i]), None if i % 37 == 0 else float(b[i]), None if i % 41 == 0 else float(k[i]), float(y[i])) for i in range(n)]


CONFIGS = {
    "absolute": B.BoostConfig(rounds=3, rate=0.3, leaves=7, least_rows=5, category_smooth=3.0, most_categories=4),
    "absolute_ties": B.BoostConfig(rounds=2, rate=0.5, leaves=5, least_rows=8, category_smooth=3.0),
    "poisson": B.BoostConfig("poisson", rounds=2, rate=0.3, leaves=7, least_rows=5, category_smooth=3.0),
    "tweedie": B.BoostConfig("tweedie", 1.3, rounds=3, rate=0.3, leaves=7, least_rows=5, ridge=0.5, category_smooth=3.0, cut_rounds=2),
}


@pytest.mark.parametrize("name", CONFIGS)
def test_equals_a_plain_trainer(spark, name):
    c, rows = CONFIGS[name], _table(len(name), 300, name.endswith("ties"))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a double, b double, k double, sales double").repartition(3)
    model = B.fit_boosted(df, c, ["a", "b", "k"], categorical=["k"])
    want = plain_fit(c, [r[:3] for r in rows], ["number", "number", "category"], [r[3] for r in rows])
    assert len(model.trees[0]) == len(want)
    back = (lambda s: s) if c.objective == "absolute" else math.exp
    got = {r.i: r.sales_hat for r in B.predict_boosted(model, df).collect()}
    assert [got[i] for i in range(len(rows))] == pytest.approx([back(s) for s in want[-1]], rel=1e-9, abs=1e-9)
    # training loss never rises
    y, start = np.array([r[3] for r in rows]), model.start[0]
    losses = [B.deviance(c, y, np.array(s)).sum() for s in [[start] * len(y), *want]]
    assert all(b <= a + 1e-9 for a, b in zip(losses, losses[1:], strict=False))


def test_many_models_equal_each_alone(spark):
    c = B.BoostConfig(rounds=2, rate=0.3, leaves=5, least_rows=5)
    rows = [(i, i % 3 + 4, *r) for i, r in enumerate(_table(5, 240))]
    df = spark.createDataFrame(rows, "i int, h int, a double, b double, k double, sales double")
    both = B.fit_boosted(df, c, ["a", "b"], by="h")
    assert set(both.trees) == {4, 5, 6}
    got = {r.i: r.sales_hat for r in B.predict_boosted(both, df).collect()}
    for h in (4, 5, 6):
        mine = df.filter(df.h == h)
        alone = B.fit_boosted(mine, c, ["a", "b"])
        for r in B.predict_boosted(alone, mine).collect():
            assert got[r.i] == r.sales_hat
    with pytest.raises(Exception, match="no model"):
        B.predict_boosted(both, df.withColumn("h", df.h + 1)).collect()


def test_awkward_training_rows(spark):
    c = B.BoostConfig(rounds=3, leaves=4, least_rows=2)
    kinds = "a double, sales double"
    flat = spark.createDataFrame([(1.0, 5.0)] * 20, kinds)
    model = B.fit_boosted(flat, c, ["a"])  # nothing to split
    assert model.trees[0] == [] and {r.sales_hat for r in B.predict_boosted(model, flat).collect()} == {5.0}
    with pytest.raises(Exception, match="finite target"):
        B.fit_boosted(spark.createDataFrame([(1.0, None), (2.0, 1.0)], kinds), c, ["a"])
    with pytest.raises(ValueError):
        B.fit_boosted(flat.limit(0), c, ["a"])
    nulls = spark.createDataFrame([(None, 9.0), (1.0, 1.0)] * 10, kinds)
    model = B.fit_boosted(nulls, B.BoostConfig(rounds=1, rate=1.0, leaves=2, least_rows=2), ["a"])
    assert {(r.a, r.sales_hat) for r in B.predict_boosted(model, nulls).collect()} == {(None, 9.0), (1.0, 1.0)}
    # a null category, and one that training has not seen, go right
    cats = spark.createDataFrame([(float(i % 2), float(i % 2) * 8) for i in range(40)], kinds)
    model = B.fit_boosted(cats, B.BoostConfig(rounds=1, rate=1.0, leaves=2, least_rows=2, category_ridge=0.0), ["a"], categorical=["a"])
    new = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (7.0, 0.0), (None, 0.0)], kinds)
    hats = [r.sales_hat for r in B.predict_boosted(model, new.coalesce(1)).collect()]
    assert hats[2] == hats[3] and sorted(hats[:2]) == [0.0, 8.0]


def test_edges(spark):
    xs = [float(i % 1000) for i in range(5000)] + [-3.0] * 4000
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    edges, rows = B.bin_edges(df, ["x"], 33)
    e = edges["x"]
    assert rows == 9000 and len(e) <= 31 and list(e) == sorted(e) and -3 < e[0] < 0  # the value that fills bins has its own
    sizes = np.bincount(B.to_bins(np.array(xs), e))[1:]
    assert sizes.max() < 2.5 * 5000 / 31


def test_medians_by_bits():
    xs = np.array([-np.inf, -2.5, -1e-300, -0.0, 0.0, 1e-300, 1.0, 1.0 + 2**-52, np.inf])
    bits = B.ordered_bits(xs)
    assert (np.diff(bits) >= 0).all() and bits[3] == bits[4] and [B.from_bits(b) for b in bits] == [float(x) for x in xs]


def test_variants(spark):
    from tallyfold.operators import models

    df = spark.createDataFrame([(float(i % 2), 3.0 + 2.0 * (i % 2)) for i in range(40)] + [(0.0, -1.0)], "a double, sales double")
    c = B.BoostConfig(rounds=1, rate=1.0, leaves=2, least_rows=2)
    for name, hats in (("raw_l1", {3.0, 5.0}), ("sqrt_l1", {3.0, 5.0}), ("log1p_l1", {3.0, 5.0})):
        model = models.fit_boosted_variant(df, name, c, ["a"])
        assert {round(r.sales_hat, 9) for r in models.predict_boosted_variant(model, df, name).collect()} == hats
    kinds = {name: models.fit_boosted_variant(df, name, c, ["a"]).config for name in ("tweedie_1_1", "tweedie_1_3", "poisson")}
    assert {n: (k.objective, k.power) for n, k in kinds.items()} == {"tweedie_1_1": ("tweedie", 1.1), "tweedie_1_3": ("tweedie", 1.3), "poisson": ("poisson", 1.0)}
