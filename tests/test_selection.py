"""Cross-validation from moments against refits of rows, the permutation floor and boosted quantiles against numpy."""

import itertools
from collections import defaultdict

import numpy as np
import pytest

from panelwright.operators import boosting, selection
from panelwright.operators.models import tree_scores
from panelwright.plans import selection as plans


def lines(spark, sf):
    got = plans.lines(spark, sf).collect()
    return np.array([r.y for r in got]), np.array([[r.quantity, r.discount, r.tax] for r in got]), np.array([r.price for r in got])


def refit(x, y, ridge):
    x = np.column_stack([np.ones(len(x)), x])
    return np.linalg.solve(x.T @ x + ridge * np.diag([0.0] + [1.0] * (x.shape[1] - 1)), x.T @ y)


def loss(b, x, y):
    return np.mean((y - b[0] - x @ b[1:]) ** 2)


def test_subsets_are_distinct_and_purged(spark):
    for n, k, paths, purge in ((6, 2, 100, 0), (6, 2, 7, 1), (20, 4, 30, 2), (3, 3, 10, 0), (0, 2, 10, 1)):
        seasons = spark.createDataFrame([(1990 + 2 * i,) for i in range(n)] * 2 + [(None,)], "season int")
        got = defaultdict(lambda: defaultdict(set))
        for r in selection.season_subsets(seasons, "season", k, paths, purge, seed=4).collect():
            got[r.path][r.side].add((r.season - 1990) // 2)
        tests = [frozenset(v["test"]) for v in got.values()]
        assert len(set(tests)) == len(tests) and all(len(t) == k for t in tests)
        if n <= 16 and k < n:
            assert len(tests) == min(paths, len(list(itertools.combinations(range(n), k))))
        assert n < 17 or 20 <= len(tests) <= paths
        for v in got.values():
            assert v["train"] == {i for i in range(n) if min(abs(i - j) for j in v["test"]) > purge}


def test_path_losses_equal_refits(spark, sf):
    y, x, p = lines(spark, sf)
    seasons = sorted(set(y.tolist()))
    chosen = defaultdict(set)
    for r in selection.season_subsets(spark.createDataFrame([(s,) for s in seasons], "y int"), "y", 2, 10, 1, 5).collect():
        chosen[r.path, r.side].add(r.y)
    got = plans.QUERIES["mx09_cpcv_fits"](spark, sf).collect()
    assert len(got) == 30
    names = ["quantity", "discount", "tax"]
    for r in got:
        own, ridge = plans.VARIANTS[r.variant]
        cols = [names.index(c) for c in own]
        inside, outside = np.isin(y, list(chosen[r.path, "train"])), np.isin(y, list(chosen[r.path, "test"]))
        b = refit(x[inside][:, cols], p[inside], ridge)
        assert (r.inside, r.outside) == pytest.approx((loss(b, x[inside][:, cols], p[inside]), loss(b, x[outside][:, cols], p[outside])), rel=1e-8)


def test_forward_and_grouped_losses_equal_refits_with_gaps_and_nulls(spark):
    draw = np.random.default_rng(2)
    rows = [(g, s, float(a), float(b), float(2 * a - b + draw.normal())) for g in "uv" for s in (2001, 2002, 2004, 2005, 2008) for a, b in draw.normal(size=(12, 2))]
    rows += [("u", None, 1.0, 1.0, 99.0), ("u", 2004, None, 1.0, 99.0), ("w", 2001, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "g string, s int, a double, b double, y double")
    variants = {"both": (["a", "b"], 0.0), "ridge": (["b", "a"], 5.0), "none": ([], 0.0)}
    held = [r for r in rows if r[1] is not None and r[2] is not None]

    def expected(g, train, test, variant):
        own = ["ab".index(c) + 2 for c in variants[variant][0]]
        part = lambda seasons: ([[r[c] for c in own] for r in held if r[0] == g and r[1] in seasons], [r[4] for r in held if r[0] == g and r[1] in seasons])
        (x, y), (tx, ty) = part(train), part(test)
        b = refit(np.array(x).reshape(len(y), -1), np.array(y), variants[variant][1])
        return loss(b, np.array(tx).reshape(len(ty), -1), np.array(ty))

    seasons = [2001, 2002, 2004, 2005, 2008]
    got = selection.forward_losses(df, "s", ["a", "b"], "y", variants, least=2, span=3, keys=["g"]).collect()
    assert {(r.g, r.s, r.variant) for r in got} == {(g, s, v) for g in "uv" for s in seasons[2:] for v in variants}
    for r in got:
        before = [s for s in seasons if s < r.s][-3:]
        assert r.n_train == len(before) and r.outside == pytest.approx(expected(r.g, before, [r.s], r.variant))
    for r in selection.grouped_losses(df, "s", ["a", "b"], "y", variants, folds=2, keys=["g"]).where("g <> 'w'").collect():
        own = seasons[r.fold :: 2]
        assert r.outside == pytest.approx(expected(r.g, [s for s in seasons if s not in own], own, r.variant))
    best = {r.g: r.variant for r in selection.best_variant(selection.forward_losses(df, "s", ["a", "b"], "y", variants, keys=["g"]), ["g"]).collect()}
    assert best["u"] in ("both", "ridge") and best["v"] in ("both", "ridge")
    assert selection.forward_losses(df.limit(0), "s", ["a", "b"], "y", variants).collect() == []


@pytest.mark.parametrize("of", [1, 2, 3, 17, 256, 1000])
def test_permutations_move_every_place_to_another(of):
    place = np.arange(of)
    a, b = (selection.permuted(place, np.full(of, of), rep, 7) for rep in (0, 1))
    assert sorted(a) == sorted(b) == place.tolist()
    assert of < 17 or (a != b).mean() > 0.8
    if of == 1000:
        assert abs(np.corrcoef(a, place)[0, 1]) < 0.12 and abs(np.corrcoef(a, b)[0, 1]) < 0.12


def test_rows_are_numbered_once_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(selection, "NUMBERED", 10)
    df = spark.createDataFrame([(g, i % 90, i % 7) for g, n in (("a", 500), ("b", 3)) for i in range(n)] + [(None, 1, 1)], "g string, i int, v int")
    got = defaultdict(list)
    for r in selection.numbered_by(df, "g", ["i", "v"]).collect():
        got[r.g, r.place_of].append(r.place)
    assert {k: sorted(v) for k, v in got.items() if k[0]} == {("a", 500): list(range(500)), ("b", 3): [0, 1, 2]}


def partial(x, y, controls):
    c = np.column_stack([np.ones(len(x)), *controls])
    rest = lambda v: v - c @ np.linalg.lstsq(c, v, rcond=None)[0]
    return np.corrcoef(rest(x), rest(y))[0, 1]


def test_permutation_floor_equals_numpy(spark, sf):
    """The query's row, from the numbers of the rows and the permutations of their places."""
    line = plans.table(spark, sf, "lineitem").selectExpr("year(l_shipdate) as season", "l_orderkey as o0", "l_linenumber as o1", "l_discount as x", "l_extendedprice as y", "l_quantity as c0")
    rows = selection.numbered_by(line, "season", ["o0", "o1", "x", "y", "c0"]).toPandas()
    floor = []
    for rep in range(10):
        moved = selection.permuted(rows["place"].to_numpy(), rows["place_of"].to_numpy(), rep, 3)
        at = {(s, p): x for s, p, x in zip(rows["season"], rows["place"], rows["x"])}
        shuffled = np.array([at[s, p] for s, p in zip(rows["season"], moved)])
        assert sorted(shuffled) == sorted(rows["x"])
        floor.append(abs(partial(shuffled, rows["y"].to_numpy(), [rows["c0"].to_numpy()])))
    got = plans.QUERIES["mx08_shuffle_null"](spark, sf).first()
    assert got.reps == 10 and got.partial == pytest.approx(partial(rows["x"].to_numpy(), rows["y"].to_numpy(), [rows["c0"].to_numpy()]), abs=1e-9)
    assert (got["mean"], got.p95, got.max) == pytest.approx((np.mean(floor), sorted(floor)[9], max(floor)), abs=1e-9)


def test_a_planted_signal_clears_the_floor_and_odd_panels_have_none(spark):
    draw = np.random.default_rng(5)
    rows = [(s, i, float(x), float(0.5 * x + c + e), float(c), 1.0) for s in range(3) for i, (x, c, e) in enumerate(draw.normal(size=(150, 3)))]
    df = spark.createDataFrame(rows + [(None, 0, 1.0, 1.0, 1.0, 1.0), (1, 0, float("nan"), 1.0, 1.0, 1.0), (1, 0, None, 1.0, 1.0, 1.0)], "s int, i int, x double, y double, c double, one double")
    got = selection.shuffle_null(df, "s", ["i"], "x", "y", ["c"])
    assert (got.first().partial > 0.35) and got.first().max < 0.25 and got.first().reps == 25
    for controls, least in ((["c", "c"], 200), (["one"], 200), (["c"], 10_000)):
        assert tuple(selection.shuffle_null(df, "s", ["i"], "x", "y", controls, least=least).first()) == (None, 0, None, None, None)
    assert selection.shuffle_null(df.limit(0), "s", ["i"], "x", "y", ["c"]).first().reps == 0


def test_permutations_are_undone_and_replicates_meet_in_blocks(spark, monkeypatch):
    for of in (1, 2, 3, 1000):
        place, whole = np.arange(of), np.full(of, of)
        assert (selection.permuted(selection.permuted(place, whole, 2, 9), whole, 2, 9, back=True) == place).all()
    draw = np.random.default_rng(6)
    df = spark.createDataFrame([(s, i, float(x), float(x + e), float(c)) for s in "ab" for i, (x, c, e) in enumerate(draw.normal(size=(300, 3)))], "s string, i int, x double, y double, c double")
    want = selection.shuffle_null(df, "s", ["i"], "x", "y", ["c"], reps=5).first()
    monkeypatch.setattr(selection, "MET", 100)
    monkeypatch.setattr(selection, "SENT", 50)
    assert tuple(selection.shuffle_null(df, "s", ["i"], "x", "y", ["c"], reps=5).first()) == pytest.approx(tuple(want), abs=1e-12)


def grow(x, y, q, trees, depth, rate, bins, least):
    """Boosting by whole columns in numpy."""
    cut = lambda v, p: np.sort(v)[max(0, int(np.ceil(p * len(v))) - 1)]
    known = [x[~np.isnan(x[:, f]), f] for f in range(x.shape[1])]
    edges = [np.array(sorted({e for k in range(1, bins) if (e := cut(v, k / bins)) < v.max()})) for v in known]
    fit, out = np.full(len(y), cut(y, q)), []
    for _ in range(trees):
        g, leaf, tree = np.where(y > fit, q, q - 1), np.zeros(len(y), int), {}
        nodes = [0]
        for _ in range(depth):
            below = []
            for node in nodes:
                own, best = leaf == node, (1e-12, None)
                total, n = g[own].sum(), own.sum()
                for f in range(x.shape[1]):
                    for e in edges[f]:
                        for missing in (True, False) if np.isnan(x[own, f]).any() else (True,):
                            left = own & np.where(np.isnan(x[:, f]), missing, x[:, f] <= e)
                            a, b = left.sum(), n - left.sum()
                            if min(a, b) >= least:
                                gain = g[left].sum() ** 2 / a + (total - g[left].sum()) ** 2 / b - total**2 / n
                                if gain > best[0] * (1 + 1e-9):
                                    best = (gain, left)
                if best[1] is not None:
                    new = leaf.max() + 1
                    leaf[best[1]], leaf[own & ~best[1]] = new, new + 1
                    below += [new, new + 1]
            nodes = below
        for node in set(leaf):
            fit[leaf == node] += rate * cut((y - fit)[leaf == node], q)
    return fit


def test_boosted_quantiles_equal_numpy(spark):
    draw = np.random.default_rng(8)
    x = draw.uniform(0, 10, (400, 3)).round(1)
    x[draw.uniform(size=x.shape) < 0.1] = np.nan
    x[:, 2] = np.where(draw.uniform(size=400) < 0.5, 1.0, 3.0)
    y = (np.nan_to_num(x[:, 0], nan=20.0) * x[:, 2] + draw.exponential(2 + x[:, 2])).round(3)
    df = spark.createDataFrame([(None if np.isnan(a) else float(a), float(b), float(c), float(v)) for (a, b, c), v in zip(x, y)], "a double, b double, c double, y double").repartition(5)
    how = dict(trees=4, depth=2, rate=0.5, bins=16, least=15)
    for q in (0.1, 0.5, 0.9):
        artifact = boosting.fit_boosted_quantile(df, ["a", "b", "c"], "y", q, **how)
        got = tree_scores(artifact["trees"], x, artifact["base"])
        want = grow(x, y, q, **how)
        assert got == pytest.approx(want, abs=1e-9)
        pinball = lambda p, q=q: np.mean(np.maximum(q * (y - p), (q - 1) * (y - p)))
        assert pinball(got) < 0.75 * pinball(np.quantile(y, q))


def test_boosted_quantiles_grow_side_by_side(spark, monkeypatch):
    """Three quantiles write and read no more tables than one, and are what each is alone; rows are scored as numpy does."""
    draw = np.random.default_rng(4)
    x = draw.uniform(0, 9, (300, 2)).round(1)
    x[draw.uniform(size=x.shape) < 0.1] = np.nan
    y = (np.nan_to_num(x[:, 0], nan=15.0) + draw.exponential(3, 300)).round(3)
    df = spark.createDataFrame([(*(None if np.isnan(v) else float(v) for v in r), float(v)) for r, v in zip(x, y)], "a double, b double, y double").repartition(3)
    how, made, settled = dict(trees=3, depth=2, rate=0.5, bins=8, least=15), [], boosting.settled
    monkeypatch.setattr(boosting, "settled", lambda *a: made.append(1) or settled(*a))
    got = boosting.boosted_quantiles(df, df, ["a", "b"], "y", {"high": 0.9, "low": 0.1, "mid": 0.5}, **how)
    assert len(made) == 3 and got.columns == ["a", "b", "y", "low", "mid", "high"]
    want = np.maximum.accumulate(np.stack([grow(x, y, q, **how) for q in (0.1, 0.5, 0.9)], axis=1), axis=1)
    key = lambda r: tuple(-1.0 if v is None or np.isnan(v) else float(v) for v in r)
    assert np.array(sorted(key(r) for r in got.collect())) == pytest.approx(np.array(sorted(key(r) for r in np.column_stack([x, y, want]))), abs=1e-9)
    assert [boosting.fit_boosted_quantile(df, ["a", "b"], "y", q, **how) for q in (0.1, 0.9)] == boosting.fit_boosted_quantiles(df, ["a", "b"], "y", [0.1, 0.9], **how)


def test_boosted_quantiles_of_odd_panels(spark, sf):
    df = spark.createDataFrame([(1.0, None, 5.0), (1.0, None, 7.0), (1.0, None, None)], "a double, b double, y double")
    artifact = boosting.fit_boosted_quantile(df, ["a", "b"], "y", 0.5, least=1)
    assert artifact["base"] == 5.0 and tree_scores(artifact["trees"], np.array([[1.0, np.nan]]), artifact["base"])[0] == pytest.approx(5.0)
    assert boosting.fit_boosted_quantile(df.limit(0), ["a"], "y", 0.5) == {"base": 0.0, "trees": []}
    got = plans.QUERIES["ml16_boosted_quantiles"](spark, sf).collect()
    late = plans.table(spark, sf, "lineitem").where("year(l_shipdate) >= 1997").count()
    assert len(got) == late and all(r.p10 <= r.p50 <= r.p90 for r in got)
    assert 0.03 < np.mean([r.l_extendedprice < r.p10 for r in got]) < 0.2 and 0.8 < np.mean([r.l_extendedprice < r.p90 for r in got]) < 0.97
