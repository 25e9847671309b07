"""Boosted trees against a plain version that grows them node by node."""

import math

import numpy as np
import pytest

from touchline.operators import boosting as bo
from touchline.plans.models import rule_forest

NAMES = ["a", "b", "c", "d"]


def data(n, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 2)
    x[:, 2] = rng.integers(0, 4, n)
    score = np.stack([x[:, 0] + 0.3 * x[:, 1], 0.4 * np.abs(x[:, 1]), -x[:, 0] + 0.2 * x[:, 2]], 1) + rng.gumbel(size=(n, 3))
    return x, score.argmax(1)


def frame(spark, x, y, parts):
    rows = [(i, 86_400 * i, int(k), *map(float, v)) for i, (v, k) in enumerate(zip(x, y, strict=True))]
    out = spark.createDataFrame(rows, "match_id long, at long, outcome int, a double, b double, c double, d double")
    return out.selectExpr("match_id", "timestamp_seconds(at) AS kickoff", "outcome", *NAMES).repartition(parts)


def plain_round(bins, y, margin, s, turn, n_bins, used_rows):
    """Three trees as nested dicts, grown over explicit lists of rows with exact sums."""
    e = [[math.exp(v - max(m)) for v in m] for m in margin.tolist()]
    out = []
    for k in range(3):
        p = bo.probabilities(margin)[:, k]
        assert np.allclose(p, [v[k] / sum(v) for v in e], atol=1e-15)
        g = [round(v) for v in ((p - (y == k)) * bo.UNIT).tolist()]
        h = [round(v) for v in (np.maximum(2 * p * (1 - p), 1e-16) * bo.UNIT).tolist()]
        columns = s.some_columns(3 * turn + k, bins.shape[1])

        def worth(a, b):
            return (a / bo.UNIT) ** 2 / (b / bo.UNIT + s.penalty)

        def grow(rows, depth):
            G, H = sum(g[i] for i in rows), sum(h[i] for i in rows)
            leaf = -G / bo.UNIT / (H / bo.UNIT + s.penalty) * s.step
            best = None
            for f in columns if depth < s.depth else ():
                for cut in range(1, n_bins):
                    left = [i for i in rows if bins[i, f] < cut]
                    a, b = sum(g[i] for i in left), sum(h[i] for i in left)
                    if b / bo.UNIT >= s.min_weight and (H - b) / bo.UNIT >= s.min_weight:
                        gain = worth(a, b) + worth(G - a, H - b) - worth(G, H)
                        if gain > max(bo.GAIN, best[0] if best else 0):
                            best = (gain, f, cut)
            if best is None:
                return {"value": leaf}
            _, f, cut = best
            return {"f": f, "cut": cut, "value": leaf, "low": grow([i for i in rows if bins[i, f] < cut], depth + 1), "high": grow([i for i in rows if bins[i, f] >= cut], depth + 1)}

        out.append(grow(used_rows(k, turn), 0))
    return out


def equal(tree, plain, i=0):
    assert tree.value[i] == pytest.approx(plain["value"], rel=1e-12, abs=1e-15)
    if "f" not in plain:
        assert tree.feature[i] < 0
        return 1
    assert (tree.feature[i], tree.cut[i]) == (plain["f"], plain["cut"])
    return 1 + equal(tree, plain["low"], 2 * i + 1) + equal(tree, plain["high"], 2 * i + 2)


def test_trees_split_by_split(spark, monkeypatch):
    monkeypatch.setattr(bo, "RENEW", 2)
    x, y = data(150)
    s = bo.Settings(trees=3, depth=3, step=0.3, min_weight=2.0, bins=12, patience=0)
    forest = bo.fit(frame(spark, x, y, 3), NAMES, settings=s)
    other = bo.fit(frame(spark, x, y, 7), NAMES, settings=s)
    assert forest.artifact() == other.artifact()
    bins = bo.binned(x, forest.edges)
    assert all((np.sort(np.unique(bins[:, f])) <= len(forest.edges[f])).all() for f in range(4))
    margin, nodes = np.zeros((len(x), 3)), 0
    ids = np.arange(len(x))
    for turn, trees in enumerate(forest.rounds):
        want = plain_round(bins, y, margin, s, turn, max(len(e) for e in forest.edges) + 1, lambda k, t: ids[bo.drawn(ids, s.seed, 3 * t + k, s.rows)].tolist())
        nodes += sum(equal(t, w) for t, w in zip(trees, want, strict=True))
        for k, t in enumerate(trees):
            t.add(bins, margin[:, k])
    assert nodes > 30
    got = {r.match_id: [r.p_home, r.p_draw, r.p_away] for r in bo.predict(forest, frame(spark, x, y, 2)).collect()}
    assert np.abs(np.array([got[i] for i in range(len(x))]) - bo.probabilities(margin)).max() < 1e-12
    back = bo.Forest.of_nodes(NAMES, forest.nodes())
    assert [t.value[t.nodes(bo.binned(x, back.edges), 3)].tolist() for r in back.rounds for t in r] == [t.value[t.nodes(bins, 3)].tolist() for r in forest.rounds for t in r]
    assert bo.Forest.restored(forest.artifact()).artifact() == forest.artifact()
    with pytest.raises(ValueError, match="no boosted trees"):
        bo.Forest.restored({"model": "goals"})


def test_early_stop_looks_at_the_last_rows_only(spark):
    x, y = data(400, 1)
    s = bo.Settings(trees=40, depth=2, step=0.5, min_weight=1.0, bins=16, patience=4)
    forest = bo.fit(frame(spark, x, y, 3), NAMES, settings=s)
    losses = forest.held_losses
    best = int(np.argmin(losses[1:])) + 1
    assert len(forest.rounds) == best < 40 and len(losses) == best + s.patience + 1
    # the trial's loss after its first round, from trees grown of the first four fifths
    first = bo.fit(frame(spark, x[:320], y[:320], 2), NAMES, settings=bo.Settings(**{**s.__dict__, "trees": 1, "patience": 0}))
    assert losses[0] == pytest.approx(math.log(3), abs=1e-8)
    bins = bo.binned(x[320:], first.edges)
    margin = np.zeros((80, 3))
    for k, t in enumerate(first.rounds[0]):
        t.add(bins, margin[:, k])
    near = -np.log(bo.probabilities(margin)[np.arange(80), y[320:]]).mean()
    assert losses[1] == pytest.approx(near, abs=0.05)  # the edges of the bins are of all rows in the trial
    shares = dict(forest.importance())
    assert sum(shares.values()) == pytest.approx(1, abs=1e-3) and max(shares, key=shares.get) == "a"


def test_odd_rows(spark):
    x, y = data(60, 2)
    rows = frame(spark, x, y, 2).selectExpr("match_id", "kickoff", "IF(match_id % 9 = 0, NULL, outcome) AS outcome", "IF(match_id % 5 = 0, NULL, a) AS a", "CAST(NULL AS DOUBLE) AS b", "1.0D AS c", "d", "'x' AS p_home")
    forest = bo.fit(rows, NAMES, settings=bo.Settings(trees=2, min_weight=0.5))
    assert len(forest.rounds) == 2  # too few rows for an early stop
    out = bo.predict(forest, rows).collect()
    assert len(out) == 60 and all(r.p_home + r.p_draw + r.p_away == pytest.approx(1) for r in out)
    assert bo.predict(forest, rows.limit(0)).collect() == []
    with pytest.raises(ValueError, match="no rows"):
        bo.fit(rows.limit(0), NAMES)


def test_rule_forest_is_a_forest():
    assert len(rule_forest().rounds) == 2 and len(rule_forest().nodes()) == 42


def test_trees_beat_a_coin_where_there_is_something_to_learn(spark):
    x, y = data(1500, 3)
    forest = bo.fit(frame(spark, x[:1000], y[:1000], 4), NAMES, settings=bo.Settings(trees=40, step=0.2))
    rows = bo.predict(forest, frame(spark, x[1000:], y[1000:], 4)).collect()
    loss = -np.mean([math.log((r.p_home, r.p_draw, r.p_away)[r.outcome]) for r in rows])
    assert loss < 0.95 < math.log(3)
