"""Keyed tables under crashes, rival writers and replays; fixtures' state in any order of arrival."""

import datetime as dt
import itertools
import os

import pytest

from touchline.sources import sinks
from touchline.sources.keyed import KeyedTable
from touchline.streaming import corrections, refresh

KEY = ["k"]


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k int, v int")


def held(frame):
    return sorted(map(tuple, frame.collect()))


def test_last_commit_of_a_key_counts(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), KEY)
    with pytest.raises(FileNotFoundError):
        t.read()
    assert t.commit(lambda old: rows(spark, (1, 1), (2, 1))) == 1
    assert t.commit(lambda old: rows(spark, (2, None), (3, 5))) == 2
    assert held(t.read()) == [(1, 1), (2, None), (3, 5)]
    assert held(t.read(1)) == [(1, 1), (2, 1)]
    assert t.compact() == 3 and t.compact() is None
    assert held(t.read()) == [(1, 1), (2, None), (3, 5)] == held(t.read(2))
    assert t.commit(lambda old: old.where("k < 0"), "nothing") == 4
    assert len(t.vacuum()) == 2
    assert held(t.read()) == [(1, 1), (2, None), (3, 5)]


def test_a_killed_writer_is_in_nobodys_way(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), KEY)
    t.commit(lambda _: rows(spark, (1, 1)))
    rows(spark, (1, 99)).write.parquet(str(tmp_path / "t/c000000000002-dead"))  # rows, but no log file
    assert held(t.read()) == [(1, 1)]
    (tmp_path / "t/log/000000000002").write_text("")  # and one that was killed while it wrote that
    assert held(t.read()) == [(1, 1)]
    assert t.commit(lambda _: rows(spark, (1, 2))) == 3
    assert held(t.read()) == [(1, 2)]
    assert [n for n in t.vacuum() if "dead" in n]

    def fails(_):
        raise OSError("killed")

    with pytest.raises(OSError):
        t.commit(fails)
    assert held(t.read()) == [(1, 2)]


def test_two_writers(spark, tmp_path):
    path = str(tmp_path / "t")
    one, two = KeyedTable(spark, path, KEY), KeyedTable(spark, path, KEY)
    one.commit(lambda _: rows(spark, (1, 1)))
    asked = []

    def add(old):
        asked.append(held(old))
        if len(asked) == 1:  # the other one comes first
            two.commit(lambda seen: seen.selectExpr("k", "v + 10 AS v"))
        return old.selectExpr("k", "v + 1 AS v")

    assert one.commit(add) == 3
    assert asked == [[(1, 1)], [(1, 11)]]
    assert held(two.read()) == [(1, 12)]


def test_a_named_commit_is_made_once(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), KEY)
    more = lambda old: rows(spark, (1, 1)) if old is None else old.selectExpr("k", "v + 1 AS v")
    assert t.commit(more, "batch#0") == 1
    assert t.commit(more, "batch#0") is None
    assert t.commit(more, "batch#1") == 2
    assert held(t.read()) == [(1, 2)]


def test_what_is_written_follows_the_change(spark, tmp_path):
    path = tmp_path / "t"
    t = KeyedTable(spark, str(path), ["id"])
    t.commit(lambda _: spark.range(200_000).selectExpr("id", "id AS v"))
    size = lambda: sum(f.stat().st_size for f in path.rglob("*.parquet"))
    before = size()
    t.commit(lambda old: old.where("id = 7").selectExpr("id", "v + 1 AS v").coalesce(1))
    assert size() - before < before / 100
    assert t.read().where("id = 7").head().v == 8 and t.read().count() == 200_000


def test_versions_go_on_after_a_crash(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace(spark, rows(spark, (1, 1)), path)
    rows(spark, (1, 2)).write.parquet(f"{path}/v000002")
    (tmp_path / "t/v000002/_SUCCESS").unlink()
    assert held(sinks.current(spark, path)) == [(1, 1)]
    assert held(sinks.replace(spark, rows(spark, (1, 3)), path)) == [(1, 3)]


def test_a_replayed_batch_of_results_is_committed_once(spark, tmp_path):
    stored = "1 AS season, 1 AS home_team, 2 AS away_team, CAST(NULL AS INT) AS home_goals, CAST(NULL AS INT) AS away_goals, CAST(NULL AS INT) AS home_goals_ht, CAST(NULL AS INT) AS away_goals_ht, 'NS' AS status"
    t = KeyedTable(spark, str(tmp_path / "t"), refresh.KEY)
    t.commit(lambda _: spark.sql(f"SELECT {stored}"))
    folder, cp = tmp_path / "in", tmp_path / "cp"
    folder.mkdir()
    (folder / "a.csv").write_text("season,home_team,away_team,home_goals,away_goals,home_goals_ht,away_goals_ht\n1,1,2,3,0,1,0\n")
    refresh.refresh(spark, str(folder), t.path, str(cp)).awaitTermination()
    assert len(t.log()) == 2
    for f in (*cp.glob("commits/[0-9]*"), *cp.glob("commits/.[0-9]*")):  # a crash between the table's commit and the stream's
        f.unlink()
    refresh.refresh(spark, str(folder), t.path, str(cp)).awaitTermination()
    assert len(t.log()) == 2 and t.read().head().home_goals == 3


# ------------------------------------------------------------------ state of fixtures
@pytest.fixture()
def rocks(spark):
    before = {k: spark.conf.get(k) for k in corrections.STORE}
    for k, v in corrections.STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


HEAD = "season,home_team,away_team,kickoff,home_goals,away_goals\n"
FILES = [
    ("a.csv", 1_700_000_000, "1,1,2,2023-11-10 20:00:00,,\n1,2,1,2023-11-11 20:00:00,0,0\n"),
    ("b.csv", 1_700_100_000, "1,1,2,,2,1\n"),
    ("c.csv", 1_700_200_000, "1,1,2,,2,2\n1,3,4,2023-11-12 20:00:00,,\n"),
]


def arrive(spark, tmp, order, at_once):
    folder = tmp / "in"
    folder.mkdir(parents=True)
    t = KeyedTable(spark, str(tmp / "t"), corrections.KEY)
    for group in at_once(order):
        for name, at, text in group:
            (folder / name).write_text(HEAD + text)
            os.utime(folder / name, (at, at))
        corrections.keep(spark, str(folder), t.path, str(tmp / "cp")).awaitTermination()
    return t


def test_any_order_gives_one_table(rocks, tmp_path):
    want = {((1, 1, 2), 2, 2), ((1, 2, 1), 0, 0), ((1, 3, 4), None, None)}
    singly, together = lambda o: [[f] for f in o], lambda o: [o]
    for i, (order, how) in enumerate([(FILES, together), (FILES, singly), (FILES[::-1], singly), ([FILES[1], FILES[2], FILES[0]], singly)]):
        t = arrive(rocks, tmp_path / str(i), order, how)
        assert {((r.season, r.home_team, r.away_team), r.home_goals, r.away_goals) for r in t.read().collect()} == want


def test_state_outlives_a_restart_and_rows_without_a_score_become_overdue(rocks, tmp_path):
    later = [("d.csv", 1_700_000_000 + 500 * 86_400, "1,5,6,2025-03-01 20:00:00,1,0\n"), ("e.csv", 1_700_000_000 + 900 * 86_400, "1,5,6,,1,1\n")]
    t = arrive(rocks, tmp_path, [*FILES, *later], lambda o: [[f] for f in o])  # each file is a start from the checkpoint
    got = {(r.home_team, r.away_team): (r.home_goals, r.overdue, r.change) for r in t.read().collect()}
    assert got[1, 2] == (2, False, 3)  # a fixture, a score, a correction
    assert got[5, 6] == (1, False, 2)
    assert got[3, 4] == (None, True, 1)
    names = [x["name"] for x in t.log()]
    assert len(names) == len(set(names))


def test_order_of_rows_is_total():
    at = dt.datetime(2024, 1, 1)
    some = [(True, at, "a", 1, 0), (True, at, "a", 1, 1), (True, at, "b", 0, 0), (False, at + dt.timedelta(1), "z", None, None), (True, at + dt.timedelta(1), "a", 0, 0)]
    best = {max(p, key=corrections.Fixture.order) for p in itertools.permutations(some)}
    assert best == {some[4]}
