"""Learned and simulated results against plain versions of what they claim to be."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import classifiers as cl
from touchline.operators import evaluation as ev
from touchline.operators import goals_model as gm
from touchline.operators import simulation as sim
from touchline.plans.models import FORM, form_rows
from touchline.sources.tables import matches


@pytest.fixture(scope="module")
def games(spark, sf_dir):
    return matches(spark, sf_dir).cache()


def test_logistic_is_at_its_optimum(spark, sf_dir):
    rows = form_rows(spark, sf_dir).where("season < 1998").cache()
    model = cl.fit_logistic(rows, FORM, c=0.3)
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    data = rows.select("match_id", *FORM, "outcome").toPandas()
    x, y = data[FORM].to_numpy(float), data.outcome.to_numpy(int)
    n, rate = len(x), 1 / (0.3 * len(x))

    def loss(w, b):
        z = x @ w.T + b
        z = z - z.max(1, keepdims=True)
        return (np.log(np.exp(z).sum(1)) - z[np.arange(n), y]).mean() + rate / 2 * (w**2).sum()

    z = x @ w.T + b
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    slope = (p - np.eye(3)[y]).T @ x / n + rate * w
    assert np.abs(slope).max() < 5e-3 and np.abs((p - np.eye(3)[y]).mean(0)).max() < 1e-3
    rng = np.random.default_rng(0)
    best = loss(w, b)
    assert all(loss(w + rng.normal(size=w.shape) * s, b + rng.normal(size=3) * s) > best - 1e-6 for s in (1e-3, 1e-2, 1e-1) for _ in range(20))
    got = {r.match_id: (r.p_home, r.p_draw, r.p_away) for r in cl.predict_logistic(model, rows, FORM).collect()}
    assert np.abs(np.array([got[i] for i in data.match_id]) - p).max() < 1e-9
    assert cl.importance(model, FORM, 3) == sorted(((f, round(float(v), 5)) for f, v in zip(FORM, np.abs(w).mean(0), strict=True)), key=lambda t: -t[1])[:3]


def plain_elo(rows):
    ratings, out = {}, {}
    for r in rows:
        x, y = ratings.get(r.home_team, 1500.0), ratings.get(r.away_team, 1500.0)
        e = 1 / (1 + 10 ** (-(x + 60 - y) / 400))
        out[r.match_id] = e
        gap = abs(r.home_goals - r.away_goals)
        k = 20 * (1 if gap < 2 else 1.5 if gap == 2 else (11 + gap) / 8)
        got = 1.0 if r.home_goals > r.away_goals else 0.5 if r.home_goals == r.away_goals else 0.0
        ratings[r.home_team], ratings[r.away_team] = x + k * (got - e), y - k * (got - e)
    return out


def test_walk_forward_sees_earlier_matches_only(spark, games):
    first = 2000
    got = {}
    for r in ev.walk_forward(games, first).collect():
        got.setdefault(r.model, {})[r.match_id] = np.array([r.p_home, r.p_draw, r.p_away])
    played = sorted((r for r in games.where("home_goals is not null").collect()), key=lambda r: (r.kickoff, r.match_id))
    sign = lambda r: 0 if r.home_goals > r.away_goals else 1 if r.home_goals == r.away_goals else 2
    start = {s: min(r.kickoff for r in games.where(f"season = {s}").collect()) for s in (2000, 2001)}
    test = [r for r in played if r.season >= first]
    assert all(set(v) == {r.match_id for r in test} for k, v in got.items() if k != "market")
    elo = plain_elo(played)
    early = [sign(r) for r in played if r.kickoff < start[first]]
    draws = early.count(1) / len(early)
    fits = {s: gm.fit(games.where(F.col("kickoff") < F.lit(start[s])).where("home_goals is not null")) for s in start}
    goals = {r.match_id: np.array([r.p_home, r.p_draw, r.p_away]) for s in start for r in gm.forecasts(games.where(f"season = {s} and home_goals is not null"), fits[s]).collect()}
    for r in test:
        before = [sign(q) for q in played if q.kickoff < start[r.season]]
        assert got["base_rate"][r.match_id] == pytest.approx([before.count(k) / len(before) for k in range(3)])
        assert got["uniform"][r.match_id] == pytest.approx([1 / 3] * 3)
        e = elo[r.match_id]
        assert got["elo"][r.match_id] == pytest.approx([(1 - draws) * e, draws, (1 - draws) * (1 - e)], abs=1e-9)
        assert got["goals"][r.match_id] == pytest.approx(goals[r.match_id], abs=2e-5)
        if r.match_id in got["market"]:
            odds = np.array([1 / r.odds_home, 1 / r.odds_draw, 1 / r.odds_away])
            assert got["market"][r.match_id] == pytest.approx(odds / odds.sum(), abs=1e-4)
    assert len(got["market"]) > 0.9 * len(test)


def test_sweep_is_a_fit_of_each_half_life(spark, games):
    got = {(r.setting, r.match_id): r.p_home for r in ev.sweep(games, 2001, [270.0, 1095.0]).collect()}
    start = games.where("season = 2001").agg(F.min("kickoff")).head()[0]
    test = games.where("season = 2001 and home_goals is not null")
    for h in (270.0, 1095.0):
        params = gm.fit(games.where("home_goals is not null").where(F.col("kickoff") < F.lit(start)), rate=F.log(F.lit(2.0)) / F.lit(h))
        want = {(h, r.match_id): r.p_home for r in gm.forecasts(test, params).collect()}
        assert {k for k in got if k[0] == h} == set(want)
        assert max(abs(got[k] - v) for k, v in want.items()) < 2e-5


def test_backtest_is_each_season_by_itself(spark, games):
    seasons, fits, runs, seed = (1996, 1999), 4, 200, 11
    cuts = games.where(F.col("season").isin(*seasons)).groupBy("season").agg(F.percentile_approx("kickoff", 0.55).alias("as_of")).cache()
    rows = {r.season: r for r in sim.backtest(games, cuts, fits, runs, seed, least=0.6).collect()}
    assert set(rows) == set(seasons)
    for s in seasons:
        one = games.where(f"season = {s}")
        points = {}
        for r in one.collect():
            for t, f, a in ((r.home_team, r.home_goals, r.away_goals), (r.away_team, r.away_goals, r.home_goals)):
                p = points.setdefault(t, [0, 0])
                p[0] += 3 if f > a else f == a
                p[1] += f - a
        champion = rows[s].team
        assert points[champion][0] == max(p[0] for p in points.values())
        as_of = cuts.where(f"season = {s}").head().as_of
        past = games.where("home_goals is not null").where(F.col("kickoff") < F.lit(as_of)).withColumn("season", F.lit(s))
        vectors = gm.bootstrap(past, fits, seed, by=["season"]).withColumnRenamed("replicate", "vector")
        known = one.withColumns({c: F.when(F.col("kickoff") < F.lit(as_of), F.col(c)) for c in ("home_goals", "away_goals")})
        teams = known.select("season", F.explode(F.array("home_team", "away_team")).alias("team"))
        table = sim.summary(sim.final_tables(known, sim.unseen(vectors, teams, seed, ["season"]), runs, seed, by=["season"]), ["season"]).collect()
        order = [r.team for r in sorted(table, key=lambda r: (-r.p_champion, str(r.team)))]
        assert rows[s].title_rank == order.index(champion) + 1
        assert rows[s].p_champion == pytest.approx({r.team: r.p_champion for r in table}[champion])
        assert rows[s].in_first_two == (rows[s].title_rank <= 2)
    hits = sum(r.in_first_two for r in rows.values())
    assert all(r.hits == hits and r.passed == (hits >= 0.6 * 2) for r in rows.values())
