"""Season completions by Monte Carlo.

Runs are dealt to tasks in blocks.  A season and its parameter vectors are small whatever
the number of runs, so each is packed into one row that all blocks are given, and a
task draws and ranks its block's runs as arrays; what leaves it is rows of goals or of tables.

Draws come from a counter: a digest of (seed, run, fixture), so that a draw does not
depend on partitioning, a lost task draws the same again, and two simulations with one seed
differ only in what was changed.  Scores are inverted from the model's distribution without a
limit of goals: the sums go on until what is left is less than a draw can tell.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import goals_model as gm
from . import standings as st

#: Places that count.
TOP4, TOP6, RELEGATED = 4, 6, 3
#: Runs of a block, and the most fixtures of a season and rows of its ensemble that a block is given.
BLOCK, MAX_FIXTURES, MAX_PARAMETERS = 250, 20_000, 1_000_000


def uniform(which: int, *key: Column) -> Column:
    """[0, 1) from a digest of ``key``; ``which`` (0 or 1) picks one of two independent draws."""
    text = F.md5(F.concat_ws("|", *[k.cast("string") for k in key]).cast("binary"))
    return F.conv(F.substring(text, 1 + 13 * which, 13), 16, 10).cast("double") / float(1 << 52)


# ---------------------------------------------------------------- in a task
def uniforms(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both draws of ``uniform`` for each key: the first 104 bits of its digest."""
    raw = np.frombuffer(b"".join(hashlib.md5(k).digest() for k in keys), np.uint8).reshape(-1, 16)
    first = np.ascontiguousarray(raw[:, :8]).view(">u8")[:, 0].astype(np.uint64) >> np.uint64(12)
    second = (np.ascontiguousarray(raw[:, 6:14]).view(">u8")[:, 0].astype(np.uint64) & np.uint64((1 << 60) - 1)) >> np.uint64(8)
    return first / float(1 << 52), second / float(1 << 52)


def goal_sums(lam: np.ndarray, mu: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of home goals (fixture, goals), and of away goals given 0, 1 and more home goals (3, fixture, goals).

    The correction of low scores touches 0 and 1 goals only, so these three cases are all there are.
    """
    most = float(max(lam.max(initial=0.0), mu.max(initial=0.0)))
    size = int(most + 12 * np.sqrt(most) + 20)  # what is beyond is less than 2**-53
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, size)))])
    goals = np.arange(size)
    home, away = (np.exp(goals * np.log(m)[:, None] - m[:, None] - logs) for m in (lam, mu))
    given = np.stack([away, away, away])
    factors = np.stack([[1 - lam * mu * rho, 1 + lam * rho], [1 + mu * rho, np.full(len(lam), 1 - rho)]])
    given[:2, :, :2] *= np.maximum(factors.transpose(0, 2, 1), 0.0)
    share = given.sum(2)
    home[:, 0] *= share[0]
    home[:, 1] *= share[1]
    home[:, 2:] *= share[2][:, None]
    return np.cumsum(home, 1) / home.sum(1)[:, None], np.cumsum(given, 2) / share[:, :, None]


class Season:
    """Fixtures with the running sums of their goals under each vector; null goals are to be drawn."""

    def __init__(self, row: dict):
        self.ids = np.array(row["match_id"], dtype=np.int64)
        n = len(self.ids)
        self.teams, at = np.unique(np.array(row["home_team"] + row["away_team"]), return_inverse=True)
        self.home, self.away = at[:n], at[n:]
        self.goals = [np.array([np.nan if g is None else g for g in row[f"{s}_goals"]], dtype=float) for s in ("home", "away")]
        self.forced = [np.array([np.nan if g is None else g for g in row[f"forced_{s}"]], dtype=float) for s in ("home", "away")]
        self.open = np.flatnonzero(np.isnan(self.goals[0]))
        vectors = np.array(row["vector"])
        self.vectors = np.unique(vectors)
        where = {t: i for i, t in enumerate(self.teams.tolist())}
        place = np.array([where.get(t, -1) for t in row["team"]])
        number = lambda c: np.array([0.0 if x is None else x for x in row[c]], dtype=float)
        held, self.sums = {c: number(c) for c in ("attack", "defence", "home_adv", "rho")}, {}
        h, a = self.home[self.open], self.away[self.open]
        for i, v in enumerate(self.vectors):
            own = vectors == v
            known = own & (place >= 0)
            attack, defence = np.zeros(len(self.teams)), np.zeros(len(self.teams))  # a club without a rating is average
            attack[place[known]], defence[place[known]] = held["attack"][known], held["defence"][known]
            first = np.flatnonzero(own)[0]
            lam, mu = np.exp(attack[h] - defence[a] + held["home_adv"][first]), np.exp(attack[a] - defence[h])
            self.sums[i] = goal_sums(lam, mu, held["rho"][first])

    def draw(self, runs: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Home and away goals (run, fixture) of all fixtures."""
        home, away = (np.repeat(g[None], len(runs), 0) for g in self.goals)
        if len(self.open):
            names = [str(i).encode() for i in self.ids[self.open].tolist()]
            heads = [f"{seed}|{r}|".encode() for r in runs.tolist()]
            u, v = (x.reshape(len(runs), -1) for x in uniforms([h + n for h in heads for n in names]))
            which = (uniforms([h + b"vector" for h in heads])[0] * len(self.vectors)).astype(int)
            col = np.arange(len(self.open))
            for k in np.unique(which):
                some = np.flatnonzero(which == k)
                first, given = self.sums[k]
                size = first.shape[1] - 1
                x = np.minimum((first <= u[some][:, :, None]).sum(2), size)
                y = np.minimum((given[np.minimum(x, 2), col] <= v[some][:, :, None]).sum(2), size)
                home[np.ix_(some, self.open)], away[np.ix_(some, self.open)] = x, y
            for goals, forced in zip((home, away), self.forced, strict=True):
                fixed = self.open[~np.isnan(forced[self.open])]
                goals[:, fixed] = forced[fixed]
        return home, away

    def tables(self, home: np.ndarray, away: np.ndarray) -> dict[str, np.ndarray]:
        """The full table of every run, as arrays (run, team)."""
        runs, n = len(home), len(self.teams)
        at_home, at_away = np.eye(n)[self.home], np.eye(n)[self.away]
        both = lambda h, a: h.astype(float) @ at_home + a.astype(float) @ at_away
        won, level = both(home > away, away > home), both(home == away, home == away)
        gf, ga = both(home, away), both(away, home)
        played = np.broadcast_to(at_home.sum(0) + at_away.sum(0), won.shape)
        points, gd = 3 * won + level, gf - ga

        met = np.zeros((n, n))
        np.add.at(met, (self.home, self.away), 1)
        met = met + met.T
        legs, margin = np.zeros((2, runs, n, n))
        of = lambda x, y: np.where(x > y, 3.0, np.where(x == y, 1.0, 0.0))
        every = slice(None)
        for own, other, x, y in ((self.home, self.away, home, away), (self.away, self.home, away, home)):
            np.add.at(legs, (every, own, other), of(x, y))
            np.add.at(margin, (every, own, other), x - y)
        tied = (points[:, :, None] == points[:, None, :]) & ~np.eye(n, dtype=bool)
        # a group counts only if all its pairs have met twice
        broken = (tied & (met != 2)).any(2)
        broken |= (tied & broken[:, None, :]).any(2)
        counts = tied & ~broken[:, :, None]
        h2h_points, h2h_gd = (legs * counts).sum(2), (margin * counts).sum(2)
        by_name = np.broadcast_to(np.argsort(np.argsort([str(t) for t in self.teams.tolist()])), points.shape)
        order = np.lexsort((by_name, -gf, -gd, -h2h_gd, -h2h_points, -points), axis=-1)
        position = np.empty_like(order)
        np.put_along_axis(position, order, np.broadcast_to(np.arange(1, n + 1), order.shape), axis=-1)
        return {"played": played, "won": won, "drawn": level, "lost": played - won - level, "gf": gf, "ga": ga, "points": points, "gd": gd, "h2h_points": h2h_points, "h2h_gd": h2h_gd, "position": position}


SUMS = ("played", "won", "drawn", "lost", "gf", "ga", "points", "gd", "h2h_points", "h2h_gd", "position")


def _blocks(batches: Iterator[pa.RecordBatch], runs: int, seed: int, by: list[str], tables: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, season = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if season is None or [row[c] for c in by] != held:
                held, season = [row[c] for c in by], Season(row)
            some = np.arange(row["block"] * BLOCK, min(runs, (row["block"] + 1) * BLOCK))
            home, away = season.draw(some, seed)
            if tables:
                out = season.tables(home, away)
                n = len(season.teams)
                columns = {"run": np.repeat(some, n), "team": np.tile(season.teams, len(some)), "teams": np.full(n * len(some), n)} | {c: x.ravel() for c, x in out.items()}
            else:
                col = season.open
                n = len(col)
                whole = lambda x: np.tile(x[col], len(some))  # noqa: B023, E731
                columns = {"run": np.repeat(some, n), "match_id": whole(season.ids), "home_team": whole(season.teams[season.home]), "away_team": whole(season.teams[season.away]), "home_goals": home[:, col].ravel(), "away_goals": away[:, col].ravel()}
            size = len(columns["run"])
            columns |= {c: [x] * size for c, x in zip(by, held, strict=True)}
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name].tolist() if isinstance(columns[f.name], np.ndarray) and columns[f.name].dtype.kind in "UO" else columns[f.name]).cast(f.type) for f in schema], schema=schema)


# ---------------------------------------------------------------- operators
def _simulated(season: DataFrame, ensemble: DataFrame, runs: int, seed: int, forced: DataFrame | None, by: Sequence[str], tables: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    by = list(by)
    fixtures = season.select(*by, "match_id", "home_team", "away_team", "home_goals", "away_goals")
    if forced is None:
        fixtures = fixtures.withColumns({f"forced_{s}": F.lit(None).cast("int") for s in ("home", "away")})
    else:
        fixtures = fixtures.join(forced.select("match_id", F.col("home_goals").alias("forced_home"), F.col("away_goals").alias("forced_away")), "match_id", "left")

    def packed(rows: DataFrame, columns: list[str], keys: list[str], most: int) -> DataFrame:
        one = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("x"))
        many = F.when(F.size("x") > most, F.raise_error(F.lit(f"more than {most} rows of a season or its ensemble")).cast("boolean")).otherwise(F.size("x") > 0)
        return one.where(many).select(*keys, *[F.col(f"x.{c}").alias(c) for c in columns])

    left = packed(fixtures, ["match_id", "home_team", "away_team", "home_goals", "away_goals", "forced_home", "forced_away"], by, MAX_FIXTURES)
    shared = [c for c in by if c in ensemble.columns]
    right = packed(ensemble, ["vector", "team", "attack", "defence", "home_adv", "rho"], shared, MAX_PARAMETERS)
    setup = left.join(right, shared) if shared else left.crossJoin(right)  # one row a season
    blocks = -(-runs // BLOCK)
    spark = season.sparkSession
    dealt = spark.range(0, blocks, 1, min(blocks, max(spark.sparkContext.defaultParallelism, blocks // 64))).withColumnRenamed("id", "block")
    kinds = {f.name: f.dataType.simpleString() for f in season.schema}
    head = "".join(f"{c} {kinds[c]}, " for c in by) + "run int, "
    body = f"team {kinds['home_team']}, teams int, " + ", ".join(f"{c} {'int' if c == 'position' else 'long'}" for c in SUMS) if tables else f"match_id long, home_team {kinds['home_team']}, away_team {kinds['away_team']}, home_goals int, away_goals int"
    schema = spark.createDataFrame([], head + body).schema
    work = dealt.crossJoin(F.broadcast(setup))  # one row a season
    return work.mapInArrow(partial(_blocks, runs=runs, seed=seed, by=by, tables=tables, schema=to_arrow_schema(schema)), schema)


def draw(fixtures: DataFrame, ensemble: DataFrame, runs: int, seed: int, forced: DataFrame | None = None) -> DataFrame:
    """run, match_id, home_team, away_team, home_goals, away_goals of every unplayed fixture.

    ensemble: vector (0, 1, ...), team, attack, defence, home_adv, rho.  forced: match_id,
    home_goals, away_goals; a forced result replaces its draw and leaves all others alone.
    """
    return _simulated(fixtures, ensemble, runs, seed, forced, (), False)


def unknown_forced(forced: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Forced results of no open fixture; must be empty before a simulation."""
    return forced.join(fixtures.where("home_goals is null").select("match_id"), "match_id", "left_anti")


def complete(season: DataFrame, drawn: DataFrame, runs: int) -> DataFrame:
    """All fixtures of every run: the played ones as they are, the others as drawn."""
    played = season.where("home_goals is not null").select(F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"), "match_id", "home_team", "away_team", "home_goals", "away_goals")
    return played.unionByName(drawn)


def final_tables(season: DataFrame, ensemble: DataFrame, runs: int, seed: int, forced: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """by..., run, team, teams (how many there are), position, points and the rest of the full table of every run.

    ``by`` simulates several seasons side by side, each with its own rows of ``ensemble`` where that has the column.
    """
    return _simulated(season, ensemble, runs, seed, forced, by, True)


def summary(tables: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Of each team: chances of places, expected points and the interval that holds 95 % of them; likeliest champions first."""
    share = lambda c: F.bround(F.avg(c.cast("double")), 6)
    low = F.percentile(F.col("points").cast("double"), F.array(F.lit(0.025), F.lit(0.975)))
    out = tables.groupBy(*by, "team").agg(
        share(F.col("position") == 1).alias("p_champion"),
        share(F.col("position") <= TOP4).alias("p_top4"),
        share(F.col("position") <= TOP6).alias("p_top6"),
        share(F.col("position") > F.col("teams") - RELEGATED).alias("p_relegation"),
        F.bround(F.avg("points"), 3).alias("expected_points"),
        low.alias("_ci"),
    )
    return out.select(*by, "team", "p_champion", "p_top4", "p_top6", "p_relegation", "expected_points", F.bround(F.col("_ci")[0], 3).alias("points_low"), F.bround(F.col("_ci")[1], 3).alias("points_high"))


def by_title_chance(summaries: DataFrame, names: DataFrame) -> DataFrame:
    """Summaries with their teams' names (team, name), in order of title chance, then name."""
    return summaries.join(names.select("team", "name"), "team").orderBy(F.col("p_champion").desc(), "name")


def positions(tables: DataFrame, runs: int) -> DataFrame:
    """team, position, p: the distribution of final positions; places that never happened are left out."""
    return tables.groupBy("team", "position").agg((F.count("*") / F.lit(runs)).alias("p"))


def conserved(whole: DataFrame) -> DataFrame:
    """run, draws, points and whether each decided match gave 3 points and each draw 2."""
    h, a = F.col("home_goals"), F.col("away_goals")
    sums = whole.groupBy("run").agg(F.count("*").alias("n"), F.count_if(h == a).alias("draws"), F.sum(st.points(h, a) + st.points(a, h)).alias("points"))
    return sums.withColumn("kept", F.col("points") == 3 * (F.col("n") - F.col("draws")) + 2 * F.col("draws"))


def what_if(season: DataFrame, ensemble: DataFrame, runs: int, seed: int, forced: DataFrame) -> DataFrame:
    """Changes of each team's chances when results are forced, same draws otherwise."""
    from .relational import paired_delta

    base, other = (summary(final_tables(season, ensemble, runs, seed, f)) for f in (None, forced))
    return paired_delta(base, other, "team", ["p_champion", "p_top4", "p_top6", "p_relegation", "expected_points"])


def champion_rank(summaries: DataFrame, champions: DataFrame, by: str = "season") -> DataFrame:
    """How high the actual champion of each season stood by title chance, and whether in the first two."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.col("p_champion").desc(), F.col("team").cast("string")))
    return summaries.withColumn("title_rank", place).join(champions.select(by, F.col("champion").alias("team")), [by, "team"]).select(by, "team", "p_champion", "title_rank", (F.col("title_rank") <= 2).alias("in_first_two"))


def backtest(matches: DataFrame, cuts: DataFrame, fits: int = 100, runs: int = 10_000, seed: int = 42, least: float = 0.8) -> DataFrame:
    """Of each season of ``cuts`` (season, as_of): its champion, how high that stood by title chance at the cut, and the gate.

    Everything is fitted on matches before the cut alone, ``fits`` resamples included; what was played
    by then is kept, the rest is drawn.  The gate asks that in a share of ``least`` of the seasons the
    champion is one of the two likeliest.
    """
    from . import ratings as rt

    played = matches.where("home_goals is not null")
    folds = cuts.select(F.col("season").alias("fold"), F.col("as_of").alias("start"))
    ensemble = gm.bootstrap(rt.expanding(played, folds).drop("season").withColumnRenamed("fold", "season"), fits, seed, by=["season"]).withColumnRenamed("replicate", "vector")
    known = matches.join(F.broadcast(cuts.select("season", "as_of")), "season")  # one row a season
    known = known.withColumns({c: F.when(F.col("kickoff") < F.col("as_of"), F.col(c)) for c in ("home_goals", "away_goals")})
    teams = known.select("season", F.explode(F.array("home_team", "away_team")).alias("team"))
    ensemble = unseen(ensemble, teams, seed, ["season"])
    ranked = champion_rank(summary(final_tables(known, ensemble, runs, seed, by=["season"]), ["season"]), st.rank(played).where("position = 1").select("season", F.col("team").alias("champion")))
    gate = ranked.agg(F.count_if("in_first_two").alias("hits"), F.count("*").alias("seasons"))  # one row
    return ranked.crossJoin(gate).withColumn("passed", F.col("hits") >= least * F.col("seasons"))


def latest_matchday(calendar: DataFrame, matches: DataFrame) -> DataFrame:
    """The last round of a calendar (matchday, home_team, away_team) that has a played match."""
    played = matches.where("home_goals is not null").select("home_team", "away_team")
    return calendar.join(played, ["home_team", "away_team"], "left_semi").agg(F.max("matchday").alias("matchday"))


def verified(distribution: DataFrame, tables: DataFrame) -> DataFrame:
    """One row: teams whose position chances sum to one, and runs and points of the stored tables."""
    sums = distribution.groupBy("team").agg(F.sum("p").alias("p")).agg(F.count("*").alias("teams"), F.count_if(F.abs(F.col("p") - 1) < 1e-6).alias("whole"))
    points = tables.groupBy("run").agg(F.sum("points").alias("points")).agg(F.count("*").alias("runs"), F.min("points").alias("least"), F.max("points").alias("most"))
    return sums.crossJoin(points)  # one row each


def unseen(ensemble: DataFrame, teams: DataFrame, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """The ensemble with teams that a vector lacks: strengths drawn with the vector's own spread."""
    by = list(by)
    spread = ensemble.groupBy(*by, "vector").agg(F.stddev_pop("attack").alias("_a"), F.stddev_pop("defence").alias("_d"), F.first("home_adv").alias("home_adv"), F.first("rho").alias("rho"))
    names = teams.select(*by, "team").distinct()
    every = names.join(spread, by) if by else names.crossJoin(spread)  # one row a vector and team, as the ensemble has
    every = every.join(ensemble.select(*by, "vector", "team"), [*by, "vector", "team"], "left_anti")

    def normal(name: str) -> Column:
        u, v = (uniform(i, F.lit(seed), F.col("vector"), F.col("team"), F.lit(name)) for i in (0, 1))
        return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.pi() * v)

    # the unresampled fit stays as it is: what it has not seen counts as average
    scale = lambda c: F.when(F.col("vector") == 0, 0.0).otherwise(F.col(c))
    new = every.select(*by, "vector", "team", (normal("attack") * scale("_a")).alias("attack"), (normal("defence") * scale("_d")).alias("defence"), "home_adv", "rho")
    return ensemble.select(*by, "vector", "team", "attack", "defence", "home_adv", "rho").unionByName(new)


# ----------------------------------------------------------------- stored runs
def stored(summary_rows: DataFrame, version: str, runs: int, seed: int, at: Column, forced: DataFrame | None = None) -> DataFrame:
    """One row of a log of simulations: version, computed_at, runs, seed, forced (JSON; null for a baseline) and table, the rows of a summary.

    A season's table is one row a club, so the row is small.
    """
    rows = F.array_sort(F.collect_list(F.struct("team", *[c for c in summary_rows.columns if c != "team"]))).alias("table")
    one = summary_rows.agg(rows).select(F.lit(version).alias("version"), at.alias("computed_at"), F.lit(runs).alias("runs"), F.lit(seed).cast("long").alias("seed"), "table")
    if forced is None:
        return one.withColumn("forced", F.lit(None).cast("string"))
    said = forced.agg(F.to_json(F.array_sort(F.collect_list(F.struct("match_id", "home_goals", "away_goals")))).alias("forced"))  # of limited results
    return one.crossJoin(said)  # one row each


def latest_stored(log: DataFrame, version: str) -> DataFrame:
    """The table of a version's last baseline in a log of ``stored`` rows; one whose forced results are null or the text ``null``."""
    base = log.where((F.col("version") == version) & (F.col("forced").isNull() | (F.col("forced") == "null")))
    last = base.agg(F.max_by("table", "computed_at").alias("table"))
    return last.select(F.explode("table").alias("r")).select("r.*")
