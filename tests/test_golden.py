"""Hand-computed cases, and what must hold whatever the data."""

import datetime as dt
import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions import dates, numbers, text
from touchline.operators import classifiers, entities, evaluation, features, feeds, goals_model, metrics, mutations, ratings, relational, simulation, standings, validation
from touchline.sources import files, sinks
from touchline.sources.keyed import KeyedTable
from touchline.streaming import refresh

GAMES = "season int, match_id long, kickoff timestamp, home_team int, away_team int, home_goals int, away_goals int"


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).head()


def forecasts(spark, rows):
    return spark.createDataFrame([(*p, o) for p, o in rows], "p_home double, p_draw double, p_away double, outcome int")


# ------------------------------------------------------------------ metrics
def test_scores_of_random_forecasts(spark):
    """Groups of unnormalised rows, some with negative parts, against numpy."""
    rng = np.random.default_rng(14)
    raw, outcome, group = rng.gamma(0.6, size=(400, 3)) - 0.02, rng.integers(0, 3, 400), rng.integers(0, 3, 400)
    frame = spark.createDataFrame([(*map(float, p), int(o), int(g)) for p, o, g in zip(raw, outcome, group, strict=True)], "p_home double, p_draw double, p_away double, outcome int, g int")
    p = np.maximum(raw, 0)
    p /= p.sum(1)[:, None]
    happened, cumulative = np.eye(3)[outcome], np.cumsum(p, 1) - np.cumsum(np.eye(3)[outcome], 1)
    top, hits = p.max(1), (p.argmax(1) == outcome).astype(float)
    for r in metrics.evaluate(frame, ["g"]).collect():
        own = group == r.g
        bins, error = np.minimum((top * 10).astype(int), 9), 0.0
        for k in range(10):
            some = own & (bins == k)
            error += abs(hits[some].sum() - top[some].sum()) / own.sum()
        want = {
            "n": own.sum(),
            "log_loss": -np.log(np.maximum(p[own, outcome[own]], 1e-15)).mean(),
            "rps": (cumulative[own, :2] ** 2).sum(1).mean() / 2,
            "brier": ((p - happened)[own] ** 2).sum(1).mean(),
            "accuracy": hits[own].mean(),
            "ece": error,
        }
        assert r.asDict() == pytest.approx({"g": r.g} | {k: float(v) for k, v in want.items()})


def test_a_certain_miss_is_floored(spark):
    sure = forecasts(spark, [((0.0, 1.0, 0.0), 2)])
    assert metrics.evaluate(sure).head().log_loss == pytest.approx(-math.log(1e-15))
    assert sure.select(metrics.log_loss(1e-9).alias("x")).head().x == pytest.approx(-math.log(1e-9))


def test_farther_misses_cost_more_ranked_score_and_no_more_brier_score(spark):
    """All of 0.55 moved one place or two places off: only the ranked score tells them apart."""
    near, far = (metrics.evaluate(forecasts(spark, [(p, 2)])).head() for p in ((0.15, 0.55, 0.3), (0.55, 0.15, 0.3)))
    assert far.rps - near.rps == pytest.approx((0.55**2 - 0.15**2) / 2) and far.brier == pytest.approx(near.brier)


def test_ties_are_broken_by_place_and_for_display_by_side(spark):
    rows = [(0.375, 0.375, 0.25), (0.25, 0.375, 0.375), (0.375, 0.25, 0.375), (0.2, 0.5, 0.3)]
    got = forecasts(spark, [(p, 0) for p in rows]).select(metrics.pick().alias("a"), metrics.pick_for_display().alias("b")).collect()
    assert [tuple(r) for r in got] == [(0, 0), (1, 2), (0, 0), (1, 1)]


def test_edges_of_bins(spark):
    """0.5 and 0.75 lie on edges: left-closed tenths and fifths, right-closed quarters, and certainty in the last bin."""
    frame = forecasts(spark, [((0.5, 0.25, 0.25), 0), ((0.75, 0.125, 0.125), 1), ((1.0, 0.0, 0.0), 0), ((0.25, 0.5, 0.25), 2)])
    right = {r.bin: (r.n, r.predicted, r.observed) for r in metrics.reliability(frame, bins=4).collect()}
    assert right == {2: (2, 0.5, 0.5), 3: (1, 0.75, 0.0), 4: (1, 1.0, 1.0)}
    # tenths: 0.5 twice (one hit), 0.75 missed, 1.0 hit
    assert metrics.calibration_error(frame).head().ece == pytest.approx(0.75 / 4)
    left = {r.bin: r.n for r in metrics.classwise_bins(frame, width=0.25).collect()}
    assert left == {0: 4, 1: 4, 2: 2, 3: 2}


@pytest.mark.parametrize("p,o", [((0.0, 0.0, 0.0), 0), ((0.5, 0.3, 0.2), 3), ((None, 0.3, 0.2), 1)])
def test_bad_forecasts_are_refused(spark, p, o):
    with pytest.raises(Exception, match="forecast needs"):
        metrics.evaluate(forecasts(spark, [(p, o)])).collect()


# ---------------------------------------------------------------- functions
def test_odds(spark):
    lit = lambda *x: tuple(F.lit(v).cast("double") for v in x)
    odds = (1.75, 3.9, 5.25)
    whole = sum(1 / o for o in odds)
    r = one(spark, p=numbers.market_first([lit(1.5, None, 6.1), lit(*odds), lit(9.0, 9.0, 9.0)])).p  # the first complete one
    assert tuple(r) == tuple(round(1 / o / whole, 4) for o in odds)
    assert one(spark, p=numbers.market_first([lit(1.5, None, 6.1)])).p is None
    assert sum(one(spark, p=numbers.rebalanced(lit(1 / 3, 1 / 3, 1 / 3))).p) == pytest.approx(1.0, abs=1e-12)


@pytest.mark.parametrize("days", [1.0, 77.0, 365.25, 4000.0])
def test_decay_rates(days):
    rate = numbers.half_life_to_rate(days)
    assert math.exp(-rate * days) == pytest.approx(0.5) and math.exp(-rate * 2 * days) == pytest.approx(0.25)
    assert numbers.rate_to_half_life(rate) == pytest.approx(days)
    for f in (numbers.half_life_to_rate, numbers.rate_to_half_life):
        for bad in (0, -days):
            with pytest.raises(ValueError):
                f(bad)


@pytest.mark.parametrize("lam,mu,rho", [(0.3, 2.2, 0.08), (2.7, 0.9, -0.09), (1.0, 1.0, 0.0)])
def test_low_score_factor(spark, lam, mu, rho):
    """The four corrections leave the sum over all scores and both sides' expected goals as they were."""
    cell = lambda x, y: one(spark, t=numbers.low_score_factor(F.lit(x), F.lit(y), F.lit(lam), F.lit(mu), F.lit(rho))).t
    chance = lambda n, mean: math.exp(-mean) * mean**n  # noqa: E731  of 0 or 1
    moved = {(x, y): (cell(x, y) - 1) * chance(x, lam) * chance(y, mu) for x in (0, 1) for y in (0, 1)}
    assert sum(moved.values()) == pytest.approx(0, abs=1e-12)
    assert moved[1, 0] + moved[1, 1] == pytest.approx(0, abs=1e-12) == moved[0, 1] + moved[1, 1]
    assert moved[1, 1] == pytest.approx(-rho * chance(1, lam) * chance(1, mu))
    assert cell(2, 0) == cell(0, 2) == cell(5, 3) == 1.0


def test_dates_and_numbers(spark):
    d = {t: one(spark, d=dates.any_date(F.lit(t))).d for t in ("05/08/23", "05/08/2023", "2023-08-05", "05/08/2023 18:30", "31/02/2023", "x", None)}
    assert set(list(d.values())[:4]) == {dt.date(2023, 8, 5)} and list(d.values())[4:] == [None] * 3
    assert [one(spark, c=dates.clock(F.lit(t))).c for t in ("9:05", "21:00:00", "", None, "25:00")] == ["09:05", "21:00", "20:00", "20:00", "20:00"]
    with pytest.raises(Exception, match="zone"):
        one(spark, z=dates.zoned(F.lit("2023-08-05T18:00:00")))
    with pytest.raises(Exception, match="whole number"):
        one(spark, n=numbers.strict_int(F.lit("1.5")))
    assert [one(spark, n=numbers.lenient_int(F.lit(t))).n for t in ("3", " 3.9 ", "x", "", None)] == [3, 3, None, None, None]


def test_text(spark):
    assert one(spark, k=text.name_key(F.lit("Atlético Córdoba C.F."))).k == "atleticocordobacf"
    assert one(spark, n=text.last_number(F.lit("Regular Season - 7"))).n == 7
    assert one(spark, n=text.last_number(F.lit("Final"))).n is None
    assert one(spark, r=text.forced_result(F.lit("A:B:2-1"))).r.away_goals == 1
    assert one(spark, r=text.forced_result(F.lit("A:B:2-x"))).r is None
    assert one(spark, s=text.season_label(F.lit(2008))).s == "2008/9"


@pytest.mark.parametrize("text", [" ", "7,", ",7", "+7", "7.0", "7 8", "0x7", "٣", "7,-8", "00", str(2**31), "5," * 100 + "5"])
def test_id_lists_that_are_refused(text):
    with pytest.raises(ValueError):
        relational.id_list(text)


def test_id_lists():
    assert relational.id_list(" 7 ,8,  9") == [7, 8, 9]
    assert relational.id_list("007,7,7") == [7, 7, 7]  # repeated ids are the caller's business
    assert relational.id_list(str(2**31 - 1)) == [2**31 - 1]
    hundred = ",".join(str(1000 + i) for i in range(100))
    assert len(relational.id_list(hundred)) == 100
    with pytest.raises(ValueError):
        relational.id_list(hundred, most=99)


# ------------------------------------------------------------------- tables
def games(spark, rows, season=1):
    start = dt.datetime(2020, 1, 1)
    return spark.createDataFrame([(season, i, start + dt.timedelta(days=3 * i), h, a, x, y) for i, (h, a, x, y) in enumerate(rows)], GAMES)


def order(spark, rows):
    return [r.team for r in standings.rank(games(spark, rows)).orderBy("position").collect()]


def test_head_to_head_decides_before_goals(spark):
    rows = [(1, 2, 1, 0), (2, 1, 0, 0), (1, 3, 0, 1), (3, 1, 0, 0), (2, 3, 9, 0), (3, 2, 0, 0)]
    # points: 1: 5, 2: 5, 3: 5; among all three the games are the whole table
    assert order(spark, rows)[0] == 2
    rows = [(1, 2, 1, 0), (2, 1, 0, 0), (1, 3, 0, 5), (2, 3, 3, 0), (3, 4, 0, 0), (1, 4, 0, 0), (2, 4, 0, 0)]
    assert order(spark, rows).index(1) < order(spark, rows).index(2)  # equal points, worse goals, better head to head


def test_one_missing_leg_switches_head_to_head_off_for_the_group(spark):
    rows = [(1, 2, 1, 0), (2, 3, 5, 0), (3, 1, 1, 0)]
    assert order(spark, rows) == [2, 1, 3]


def test_equal_teams_are_ordered_as_text(spark):
    assert order(spark, [(2, 10, 1, 1), (10, 2, 1, 1)]) == [10, 2]


def test_teams_without_a_match_are_listed_and_half_scores_refused(spark):
    assert sorted(order(spark, [(1, 2, None, None)])) == [1, 2]
    with pytest.raises(Exception, match="both goal counts"):
        standings.rank(standings.guarded(games(spark, [(1, 2, 1, None)]))).collect()


def test_current_points(spark):
    rows = {r.team: (r.points, r.gd, r.gf) for r in standings.totals(games(spark, [(1, 2, 3, 0), (2, 1, 1, 1)])).collect()}
    assert rows == {1: (4, 3, 4), 2: (1, -3, 1)}


# ----------------------------------------------------------------- features
def sides(spark, rows, sot=None):
    g = games(spark, rows).withColumns({"home_sot": F.lit(None).cast("int"), "away_sot": F.lit(None).cast("int")})
    if sot:
        g = g.withColumns({"home_sot": F.lit(sot[0]), "away_sot": F.lit(sot[1])})
    from touchline.sources.tables import sides

    return sides(g)


def test_second_match_sees_the_first(spark):
    f = {(r.match_id, r.team): r for r in features.team_form(sides(spark, [(1, 2, 2, 0), (1, 3, 0, 0)], (6, 2))).collect()}
    first, second = f[0, 1], f[1, 1]
    assert (first.ppg, first.rest_days, first.matches_played, first.sot_share) == (1.35, 7.0, 0.0, 0.5)
    assert (second.rest_days, second.ppg, second.matches_played, second.sot_share) == (3.0, 3.0, 1.0, 0.75)


def test_venues_are_apart(spark):
    f = {(r.match_id, r.team): r for r in features.venue_form(sides(spark, [(1, 2, 4, 0), (3, 1, 5, 0), (1, 4, 0, 0)])).collect()}
    assert (f[2, 1].ppg_l10, f[2, 1].goals_for_l10, f[2, 1].goals_against_l10) == (3.0, 4.0, 0.0)
    assert (f[1, 1].ppg_l10, f[1, 1].goals_for_l10) == (1.35, 1.14)


def test_later_results_change_no_earlier_feature(spark):
    rows = [(1, 2, 2, 0), (2, 3, 1, 1), (3, 1, 0, 2), (1, 3, 1, 0), (2, 1, 4, 4)]
    changed = rows[:3] + [(1, 3, 9, 9), (2, 1, 0, 7)]
    before, after = ({(r.match_id, r.team): tuple(r[c] for c in features.FORM) for r in features.team_form(sides(spark, x)).collect() if r.match_id <= 3} for x in (rows, changed))
    assert before == after


# ------------------------------------------------------------------- models
def planted(seed=3, n=8, seasons=12):
    rng = np.random.default_rng(seed)
    attack, defence = rng.normal(0, 0.3, n), rng.normal(0, 0.3, n)
    attack -= attack.mean()
    rows = [(h, a, int(rng.poisson(np.exp(attack[h] - defence[a] + 0.25))), int(rng.poisson(np.exp(attack[a] - defence[h])))) for _ in range(seasons) for h in range(n) for a in range(n) if h != a]
    return attack, defence, rows


def test_fit_recovers_planted_strengths(spark):
    attack, defence, rows = planted()
    fit = goals_model.fit(games(spark, rows), rate=F.lit(0.0)).orderBy("team").collect()
    assert np.corrcoef([r.attack for r in fit], attack)[0, 1] > 0.95 and np.corrcoef([r.defence for r in fit], defence)[0, 1] > 0.95
    assert abs(fit[0].home_adv - 0.25) < 0.1 and abs(fit[0].rho) <= goals_model.RHO_BOUND and abs(sum(r.attack for r in fit)) < 1e-9


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(0)
    home, away = np.array([0, 1, 2, 0]), np.array([1, 2, 0, 2])
    f = goals_model.Likelihood(home, away, {c: rng.random(4) * 5 + 1 for c in goals_model.STATS}, 3)
    p = rng.normal(0, 0.2, 8)
    _, grad = f(p)
    for i in range(8):
        e = np.zeros(8)
        e[i] = 1e-6
        assert grad[i] == pytest.approx((f(p + e)[0] - f(p - e)[0]) / 2e-6, rel=1e-4, abs=1e-5)


def test_fits_of_groups_equal_fits_alone(spark):
    _, _, rows = planted(n=4, seasons=3)
    g = games(spark, rows)
    two = g.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).where("k = 1 or match_id % 2 = 0")
    alone = {r.team: r.attack for r in goals_model.fit(g.where("match_id % 2 = 0")).collect()}
    side = {r.team: r.attack for r in goals_model.fit(two, ["k"]).where("k = 2").collect()}
    assert all(alone[t] == pytest.approx(side[t], abs=1e-9) for t in alone)


def test_artifacts_round_trip(spark, tmp_path):
    _, _, rows = planted(n=4, seasons=2)
    fit = goals_model.fit(games(spark, rows))
    artifact = goals_model.to_artifact(fit, version="7")
    sinks.write_artifact(spark, artifact, str(tmp_path / "artifact"))
    back = goals_model.from_artifact(spark, sinks.read_artifact(spark, str(tmp_path / "artifact")))
    assert sorted((r.team, r.attack) for r in back.collect()) == sorted((r.team, r.attack) for r in fit.collect())
    with pytest.raises(ValueError):
        goals_model.from_artifact(spark, {"convention": "other"})


def test_ratings_conserve_their_sum(spark):
    _, _, rows = planted(n=5, seasons=2)
    final = ratings.final_ratings(ratings.rate(games(spark, rows))).collect()
    assert sum(r.rating for r in final) == pytest.approx(1500 * 5)


def test_calibration_tames_overconfidence(spark):
    rng = np.random.default_rng(1)
    rows = [((0.9, 0.05, 0.05), int(rng.choice(3, p=[0.5, 0.3, 0.2]))) for _ in range(300)] + [((0.2, 0.3, 0.5), int(rng.choice(3, p=[0.3, 0.3, 0.4]))) for _ in range(300)]
    f = forecasts(spark, rows)
    after = classifiers.calibrated(f, classifiers.fit_isotonic(f))
    assert metrics.calibration_error(f).head().ece > 0.2 > 0.05 > metrics.calibration_error(after).head().ece
    assert after.where("abs(p_home + p_draw + p_away - 1) > 1e-9").count() == 0


def nearest_increasing(x, y):
    """The increasing curve by its definition: the greatest over beginnings of the least over ends of means."""
    at = sorted(set(x))
    sums = [(sum(b for a, b in zip(x, y, strict=True) if a == v), sum(1 for a in x if a == v)) for v in at]
    mean = lambda i, j: sum(s for s, _ in sums[i : j + 1]) / sum(n for _, n in sums[i : j + 1])
    return at, [max(min(mean(i, j) for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))]


def test_walk_forward_calibration(spark):
    """Each season's curve is that of the seasons before it, and mixtures follow it."""
    rng = np.random.default_rng(16)
    rows = []
    for i in range(240):
        p = np.round(rng.dirichlet([2, 1, 1.5]), 1)
        p[2] = 1 - p[0] - p[1]
        rows.append((("a", "b")[i % 2], i, 2000 + i // 80, int(rng.choice(3)), *map(float, p)))
    frame = spark.createDataFrame(rows, "model string, match_id long, season int, outcome int, p_home double, p_draw double, p_away double").repartition(3)
    got = {(r.match_id, r.shrink): (r.p_home, r.p_draw, r.p_away, r.n_train) for r in evaluation.walk_forward_calibrated(frame, [0.0, 0.4, 1.0]).collect()}
    assert len(got) == 160 * 3
    for m, i, season, _, *p in rows:
        past = [r for r in rows if r[0] == m and r[2] < season]
        if not past:
            continue
        curves = [nearest_increasing([r[4 + k] for r in past], [float(r[3] == k) for r in past]) for k in range(3)]
        for s in (0.0, 0.4, 1.0):
            mixed = [max((1 - s) * p[k] + s * float(np.interp(p[k], *curves[k])), 1e-9) if s else p[k] for k in range(3)]
            assert got[i, s][:3] == pytest.approx([x / sum(mixed) for x in mixed], abs=1e-9) and got[i, s][3] == len(past)
    report = evaluation.calibration_report(frame, [0.4]).collect()
    assert len(report) == 2 * 3 * 2 and all(r.helps and not r.ece_change for r in report if r.shrink == 0)
    assert {r.n for r in report if r.season is None} == {80}


# --------------------------------------------------------------- simulation
def half_season(spark, n=6):
    rng = np.random.default_rng(4)
    rows = [(h, a, *((int(rng.poisson(1.4)), int(rng.poisson(1.1))) if (h * 3 + a) % 2 else (None, None))) for h in range(n) for a in range(n) if h != a]
    g = games(spark, rows)
    p = spark.createDataFrame([(v, t, 0.1 * t - 0.25, 0.02 * v, 0.25, -0.05) for v in (0, 1) for t in range(n)], "vector int, team int, attack double, defence double, home_adv double, rho double")
    return g, p


def test_simulated_tables_equal_ranking_each_run_alone(spark):
    g, p = half_season(spark)
    fast = simulation.final_tables(g, p, 8, 7).select("run", "team", "points", "position").collect()
    whole = simulation.complete(g, simulation.draw(g.where("home_goals is null"), p, 8, 7), 8)
    assert sorted(fast) == sorted(standings.rank(whole, by=("run",)).select("run", "team", "points", "position").collect())
    assert simulation.conserved(whole).where("not kept").count() == 0


def test_chances_sum_to_one_and_forcing_helps(spark):
    g, p = half_season(spark)
    s = simulation.summary(simulation.final_tables(g, p, 60, 7))
    sums = s.agg(F.sum("p_champion").alias("c"), F.sum("p_top4").alias("t"), F.sum("p_relegation").alias("r")).head()
    assert (sums.c, sums.t, sums.r) == (pytest.approx(1, abs=1e-5), pytest.approx(4, abs=1e-5), pytest.approx(3, abs=1e-5))
    forced = g.where("home_goals is null and home_team = 5").select("match_id", F.lit(9).alias("home_goals"), F.lit(0).alias("away_goals"))
    delta = {r.team: r for r in simulation.what_if(g, p, 60, 7, forced).collect()}
    assert delta[5].expected_points_delta > 0 and delta[5].p_champion_delta >= 0
    assert sum(r.p_champion_delta for r in delta.values()) == pytest.approx(0, abs=1e-5)
    assert simulation.unknown_forced(forced.withColumn("match_id", F.col("match_id") + 1000), g).count() == forced.count()


# ---------------------------------------------------------- tables that change
def test_upserts_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, name string, n int")
    new = spark.createDataFrame([(2, "c", None), (3, "d", 4)], "id int, name string, n int")
    once = mutations.upsert(old, new, ["id"])
    assert sorted(once.collect()) == sorted(mutations.upsert(once, new, ["id"]).collect()) == [(1, "a", 1), (2, "c", None), (3, "d", 4)]
    assert mutations.insert_absent(once, new, ["id"]).collect() == []


def test_results_never_rewrite_a_score_unasked(spark):
    kinds = "season int, home_team int, away_team int, home_goals int, away_goals int, home_goals_ht int, away_goals_ht int, status string"
    stored = spark.createDataFrame([(1, 1, 2, 1, 0, 0, 0, "FT"), (1, 2, 1, None, None, None, None, "NS")], kinds)
    new = spark.createDataFrame([(1, 1, 2, 2, 0, 0, 0, "FT"), (1, 2, 1, 3, 3, 1, 1, "FT")], kinds)
    with pytest.raises(ValueError, match="another score"):
        mutations.apply_results(stored, new, ["season", "home_team", "away_team"])
    out = mutations.apply_results(stored, new, ["season", "home_team", "away_team"], allow_score_changes=True)
    assert sorted(r.home_goals for r in out.collect()) == [2, 3]


def test_new_teams_have_dense_ids(spark):
    """Whatever the partitioning is, and whether small partitions are joined."""
    rng = np.random.default_rng(15)
    names = sorted({"".join(rng.choice(list("abcdé Z")) for _ in range(rng.integers(1, 6))) for _ in range(3000)} - {"ab"}, key=lambda n: n.encode())
    raw = spark.createDataFrame([(n,) for n in [*names, *names[::7], "ab", None]], "name string")
    for parts, joined in ((1, "true"), (13, "true"), (13, "false")):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", joined)
        got = entities.new_teams(raw.repartition(parts), spark.createDataFrame([("ab",)], "name string"), 100).collect()
        assert {r.name: r.team_id for r in got} == {n: 100 + i for i, n in enumerate(names)} and len(got) == len(names)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_the_likest_name_is_found():
    """Random names against the quadratic table of common parts."""
    rng = np.random.default_rng(17)
    name = lambda: " ".join("".join(rng.choice(list("abcdeA")) for _ in range(rng.integers(1, 6))) for _ in range(rng.integers(1, 4)))
    known = sorted({name() for _ in range(60)})
    registry = entities.Registry(known)

    def ratio(a, b):
        a, b = entities.in_order(a), entities.in_order(b)
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return 200.0 * row[-1] / (len(a) + len(b))

    found = 0
    for _ in range(150):
        n = name()
        best = max(ratio(n, k) for k in known)
        want = next(k for k in known if ratio(n, k) == best) if best >= 60 else None
        assert registry.likest(n, 60.0) == want, n
        found += want is not None
    assert found > 50 and entities.Registry([]).likest("a", 60.0) is None


def test_survivors_by_matches_then_list_then_id(spark):
    teams = spark.createDataFrame([(1, "Ábc", 5), (2, "abc", 5), (3, "ABC", 4), (4, "x", 1), (5, "X", 1)], "team_id int, name string, matches int")
    listed = spark.createDataFrame([("abc",), ("ABC",)], "name string")
    assert {tuple(r) for r in entities.survivors(teams, listed).collect()} == {(1, 2), (3, 2), (5, 4)}
    assert {tuple(r) for r in entities.survivors(teams).collect()} == {(2, 1), (3, 1), (5, 4)}


def test_names_are_matched(spark):
    raw = spark.createDataFrame([("Real Alta",), ("alta real cf",), ("Zzz",), ("Special",)], "n string")
    known = spark.createDataFrame([("Real Alta",), ("Sporting Baja",)], "n string")
    got = {r.raw_name: (r.canonical, r.how) for r in entities.propose_names(raw, known, overrides={"Special": "Sporting Baja"}).collect()}
    assert got == {"Real Alta": ("Real Alta", "exact"), "alta real cf": ("Real Alta", "fuzzy"), "Zzz": (None, "none"), "Special": ("Sporting Baja", "override")}


def test_fingerprints_ignore_order(spark):
    f = spark.range(500).withColumn("x", F.when(F.col("id") % 7 != 0, F.col("id") * 3))
    a, b = (validation.fingerprint(t, ["id", "x"]).head() for t in (f, f.orderBy(F.col("id").desc()).repartition(5)))
    assert a == b != validation.fingerprint(f.where("id < 499"), ["id", "x"]).head()


# -------------------------------------------------------------------- files
def test_result_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Div,Date,Time,HomeTeam,AwayTeam,FTHG,FTAG,Extra\nX1,05/08/23,18:30,M\xe1laga ,Betis,2,1,z\nX1,06/08/2023,,Betis,Getafe,,,\n,,,,,,,\n".encode("latin-1"))
    rows = files.results(files.result_rows(spark, str(tmp_path / "a.csv"))).orderBy("kickoff").collect()
    assert [(r.home, r.home_goals, r.status, r.kickoff) for r in rows] == [("Málaga", 2, "FT", dt.datetime(2023, 8, 5, 18, 30)), ("Betis", None, "NS", dt.datetime(2023, 8, 6, 20, 0))]


def test_mixed_encodings(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("﻿Córdoba\n".encode())
    (tmp_path / "w.csv").write_bytes("Córdoba–\n".encode("cp1252"))
    assert {r.line for r in files.decoded_lines(spark, str(tmp_path / "*.csv")).collect()} == {"Córdoba", "Córdoba–"}


def test_calendars_are_strict(spark, tmp_path):
    good = tmp_path / "c.csv"
    good.write_text("matchday,kickoff_utc,home,away,time_tbc\n1,2026-08-15T19:00:00Z,A,B,false\n")
    assert files.calendar(spark, str(good)).head().kickoff == dt.datetime(2026, 8, 15, 19)
    for n, bad in enumerate(("matchday,home,away\n1,A,B\n", "matchday,kickoff_utc,home,away,time_tbc\nx,2026-08-15T19:00:00Z,A,B,false\n", "matchday,kickoff_utc,home,away,time_tbc\n1,2026-08-15T19:00:00,A,B,false\n")):
        p = tmp_path / f"bad{n}.csv"
        p.write_text(bad)
        with pytest.raises(Exception):
            files.calendar(spark, str(p)).collect()


def test_json_readers(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"seasons": {"2018/19": [{"position": 1, "team": "A", "points": 87}]}}')
    assert files.reference_tables(spark, str(tmp_path / "t.json")).select("season", "position", "team", "points").collect() == [("2018/19", 1, "A", 87)]
    (tmp_path / "f.json").write_text('{"response": [{"fixture": {"id": 5, "date": "2024-01-01T12:00:00+00:00", "status": {"short": "PEN"}}, "league": {"season": 2023, "round": "Regular Season - 9"}, "teams": {"home": {"name": "A"}, "away": {"name": "B"}}, "goals": {"home": 1, "away": 2}}]}')
    r = files.feed_fixtures(spark, str(tmp_path / "f.json")).head()
    assert (r.match_id, r.matchday, r.status, r.away_goals, r.home_goals_ht) == (5, 9, "FT", 2, None)


def test_feeds_are_merged(spark, tmp_path):
    """Payloads twice: the second brings changes, and a replay of it changes nothing more."""

    def landed(name, items):
        (tmp_path / name).write_text(json.dumps({"response": items}))
        return str(tmp_path / name)

    seasons = [{"year": 2023, "start": "2023-08-01", "end": "bad", "current": False}, {"year": None}, {"year": 2024, "current": True}]
    path = landed("l.json", [{"league": {"id": 7, "name": "Top League", "type": "League"}, "country": {"name": "X"}, "seasons": seasons}, {"league": {"id": 8, "name": "c" * 60, "type": "Cup"}, "country": None}])
    leagues, years = files.feed_leagues(spark, path)
    stored = spark.createDataFrame([(7, "OLD", "old", "Y", 3)], "league_id long, code string, name string, country string, tier int")
    got = feeds.competitions(stored, leagues)
    assert {tuple(r) for r in got.collect()} == {(7, "TOP_LEAGUE", "Top League", "X", 3), (8, "C" * 50, "c" * 60, "Unknown", 2)}
    assert feeds.competitions(got, leagues).exceptAll(got).count() == 0
    none = spark.createDataFrame([(7, 2024, "kept", dt.date(2024, 8, 9), dt.date(2025, 5, 5), False)], "league_id long, start_year int, label string, start_date date, end_date date, is_current boolean")
    got = feeds.seasons(none, years)
    assert {tuple(r) for r in got.collect()} == {(7, 2023, "2023/24", dt.date(2023, 8, 1), dt.date(2023, 12, 31), False), (7, 2024, "kept", dt.date(2024, 8, 9), dt.date(2025, 5, 5), True)}

    path = landed("t.json", [{"team": {"id": 1, "name": "One", "code": "ONE", "founded": 1900, "logo": None}, "venue": {"name": "Park"}}, {"team": {"id": 2, "name": "Two"}, "venue": None}])
    teams = files.feed_teams(spark, path)
    old = spark.createDataFrame([(1, "Uno", "U", 1899, "Old park", "logo")], teams.schema)
    got = feeds.teams(old, teams)
    assert {tuple(r) for r in got.collect()} == {(1, "Uno", "U", 1899, "Park", "logo"), (2, "Two", "", None, None, None)}
    aliases = spark.createDataFrame([(feeds.FEED, "One", 9)], "source string, raw_name string, feed_id long")
    assert {tuple(r) for r in feeds.team_aliases(aliases, teams).collect()} == {(feeds.FEED, "One", 9), (feeds.FEED, "Two", 2)}

    line = lambda t, rank: {"rank": rank, "team": {"id": t}, "points": 9 - rank, "form": "WD", "all": {"played": 4, "win": 2, "draw": 1, "lose": 1, "goals": {"for": 6, "against": 5}}}
    rows = files.feed_standings(spark, landed("s.json", [{"league": {"id": 7, "season": 2024, "standings": [[line(1, 1), line(5, 2)], [line(2, 1)]]}}]))
    at = F.lit("2024-09-01").cast("timestamp")
    log = feeds.standings(mutations.snapshot(rows.limit(0), at), rows, got, at)
    assert {(r.feed_id, r.position, r.as_of_matchday, r.goals_for, r.points) for r in log.collect()} == {(1, 1, 4, 6, 8), (2, 1, 4, 6, 8)}
    assert feeds.standings(log, rows, got, at).count() == 4

    stats = lambda t, goals: {"team": {"id": t}, "league": {"id": 7, "season": 2024}, "games": {"appearences": 3, "rating": "7.25"}, "goals": {"total": goals}, "cards": {"red": 1}}
    path = landed("p.json", [{"player": {"id": 3, "name": None, "birth": {"date": "x"}}, "statistics": [stats(1, 2), stats(77, 1)]}, {"player": {"id": 4, "name": "P", "birth": None}, "statistics": []}])
    players, totals = files.feed_players(spark, path)
    kept = feeds.players(spark.createDataFrame([(4, "kept", None, None, None)], players.schema), players)
    assert {(r.player_id, r.name, r.birth_date) for r in kept.collect()} == {(3, "Unknown", None), (4, "kept", None)}
    first = feeds.player_totals(totals.limit(0), totals, got)
    assert [(r.player_id, r.feed_id, r.goals, r.rating, r.reds, r.shots) for r in first.collect()] == [(3, 1, 2, 7.25, 1, None)]
    again = feeds.player_totals(first, totals.withColumn("goals", F.lit(5)), got)
    assert [(r.goals, r.appearances) for r in again.collect()] == [(5, 3)]


def test_seasons_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "snap")
    table = lambda s, n: spark.createDataFrame([(1, n, s)], "team int, points int, season int")
    for s, n in ((2000, 1), (2001, 2), (2001, 3)):
        sinks.replace_seasons(table(s, n), path)
    assert sorted((r.season, r.points) for r in spark.read.parquet(path).collect()) == [(2000, 1), (2001, 3)]


def test_refresh_stream(spark, tmp_path):
    table, folder = str(tmp_path / "table"), tmp_path / "in"
    folder.mkdir()
    stored = spark.createDataFrame([(1, 1, 2, None, None, None, None, "NS"), (1, 2, 1, None, None, None, None, "NS")], "season int, home_team int, away_team int, home_goals int, away_goals int, home_goals_ht int, away_goals_ht int, status string")
    keyed = KeyedTable(spark, table, refresh.KEY)
    keyed.commit(lambda _: stored)
    head = "season,home_team,away_team,home_goals,away_goals,home_goals_ht,away_goals_ht\n"
    (folder / "a.csv").write_text(head + "1,1,2,3,0,1,0\n")
    for _ in range(2):  # nothing new the second time
        refresh.refresh(spark, str(folder), table, str(tmp_path / "cp")).awaitTermination()
    assert {(r.home_team, r.status, r.home_goals) for r in keyed.read().collect()} == {(1, "FT", 3), (2, "NS", None)}
    (folder / "b.csv").write_text(head + "1,1,2,4,0,1,0\n")
    with pytest.raises(Exception, match="another score"):
        refresh.refresh(spark, str(folder), table, str(tmp_path / "cp")).awaitTermination()
    assert {r.home_goals for r in keyed.read().collect()} == {3, None}
    # a batch of files that contradict each other is refused; allowed, one whole row counts
    (folder / "b.csv").unlink()
    (folder / "c.csv").write_text(head + "1,2,1,2,1,1,0\n")
    (folder / "d.csv").write_text(head + "1,2,1,1,3,0,2\n")
    os.utime(folder / "c.csv", (2e9, 2e9))
    with pytest.raises(Exception, match="two scores"):
        refresh.refresh(spark, str(folder), table, str(tmp_path / "cp2")).awaitTermination()
    refresh.refresh(spark, str(folder), table, str(tmp_path / "cp3"), allow_score_changes=True).awaitTermination()
    assert {(r.home_goals, r.away_goals, r.home_goals_ht, r.away_goals_ht) for r in keyed.read().where("home_team = 2").collect()} == {(2, 1, 1, 0)}


def test_rows_without_a_score_blank_nothing(spark):
    rows = [(1, 1, 2, 2, 0, 1, "2024-01-01", "a"), (1, 1, 2, None, None, None, "2024-01-02", "b"), (1, 2, 1, None, None, None, "2024-01-01", "a")]
    batch = spark.createDataFrame(rows, "season int, home_team int, away_team int, home_goals int, away_goals int, home_goals_ht int, written string, file string")
    got = {(r.home_team, r.home_goals, r.away_goals, r.home_goals_ht) for r in refresh.one_a_fixture(batch, False).collect()}
    assert got == {(1, 2, 0, 1), (2, None, None, None)}


def test_any_number_of_folds(spark):
    """Beyond a thousand of them."""
    start = dt.datetime(2000, 1, 1)
    folds = spark.createDataFrame([(i, start + dt.timedelta(days=i)) for i in range(1500)], "fold int, start timestamp")
    got = ratings.expanding(games(spark, [(1, 2, 1, 0)]).withColumn("kickoff", F.lit(start + dt.timedelta(days=10))), folds)
    assert sorted(r.fold for r in got.collect()) == list(range(11, 1500))


def test_any_number_of_unseen_teams(spark):
    ensemble = spark.createDataFrame([(v, t, 0.1 * t, 0.0, 0.2, 0.0) for v in (0, 1) for t in (1, 2)], "vector int, team int, attack double, defence double, home_adv double, rho double")
    got = simulation.unseen(ensemble, spark.range(1, 1301).select(F.col("id").cast("int").alias("team")), 7)
    assert got.count() == 2600 and got.where("vector = 0 and team > 2 and attack <> 0").count() == 0


def test_scores_have_no_limit(spark):
    """Draws of a lopsided fixture follow the whole distribution, far beyond ten goals."""
    fixture = spark.createDataFrame([(1, 1, 2, None, None)], "match_id long, home_team int, away_team int, home_goals int, away_goals int")
    ensemble = spark.createDataFrame([(0, 1, 2.0, 0.0, 0.5, -0.05), (0, 2, 0.0, 0.0, 0.5, -0.05)], "vector int, team int, attack double, defence double, home_adv double, rho double")
    drawn = simulation.draw(fixture, ensemble, 4000, 5)
    s = drawn.agg(F.avg("home_goals").alias("m"), F.var_pop("home_goals").alias("v"), F.max("home_goals").alias("most"), F.avg("away_goals").alias("a")).head()
    mean = math.exp(2.5)
    assert abs(s.m - mean) < 0.25 and abs(s.v - mean) < 1.5 and s.most > 20 and abs(s.a - 1) < 0.06


def test_low_scores_follow_the_correction():
    """Running sums against the model's own grid."""
    lam, mu, rho = np.array([0.7, 1.9]), np.array([1.2, 0.4]), -0.08
    home, away = simulation.goal_sums(lam, mu, rho)
    for f in range(2):
        pois = lambda m, k: math.exp(-m) * m**k / math.factorial(k)
        grid = np.array([[pois(lam[f], x) * pois(mu[f], y) for y in range(15)] for x in range(15)])
        grid[:2, :2] *= [[1 - lam[f] * mu[f] * rho, 1 + lam[f] * rho], [1 + mu[f] * rho, 1 - rho]]
        p_home = np.diff(home[f], prepend=0)[:15]
        p_away = [np.diff(away[min(x, 2), f], prepend=0)[:15] for x in range(15)]
        assert np.abs(p_home[:, None] * np.array(p_away) - grid).max() < 1e-9


def test_forced_results_are_limited(spark):
    fixtures = spark.range(60).select(F.col("id").alias("match_id"), F.lit(1).alias("season"), F.lit("NS").alias("status"))
    some = lambda n, goals=2: spark.range(n).select(F.col("id").alias("match_id"), F.lit(goals).alias("home_goals"), F.lit(0).alias("away_goals"))
    assert relational.forced_results(some(50), fixtures, 1).count() == 50
    for rows, season, said in ((some(51), 1, "allowed"), (some(3), 2, "wrong season"), (some(3, 21), 1, "bad goals")):
        with pytest.raises(ValueError, match=said):
            relational.forced_results(rows, fixtures, season)


def test_summaries_are_listed_by_title_chance(spark):
    rows = spark.createDataFrame([(1, 0.2), (2, 0.5), (3, 0.2)], "team int, p_champion double")
    names = spark.createDataFrame([(1, "Zed"), (2, "Mid"), (3, "Abe")], "team int, name string")
    assert [r.name for r in simulation.by_title_chance(rows, names).collect()] == ["Mid", "Abe", "Zed"]
