"""Fetching against a server of our own that fails, cuts answers short and changes its files."""

import http.server
import threading

import pytest
from pyspark.sql import functions as F

from touchline.sources import fetched

PAD = "\n" * 200
BODY = "\ufeffDiv,HomeTeam,FTHG\r\nE0, Ärsenal ,2\r\n,,\r\nE0,\"Brighton, H\",0\r\n"


@pytest.fixture()
def server():
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            n = asked[self.path] = asked.get(self.path, 0) + 1
            status, body, short, head = files[self.path.split("?")[0]](n)
            self.send_response(status)
            self.send_header("Content-Length", str(len(body) + short))
            for k, v in head.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    asked, files = {}, {}
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", files, asked
    s.shutdown()


def test_fetching(spark, tmp_path, server):
    base, files, asked = server
    text = (BODY + PAD).encode()
    version = [text]
    files["/ok.csv"] = lambda n: (200, version[0], 0, {fetched.QUOTA: "41"})
    files["/twice.csv"] = lambda n: (503, b"", 0, {}) if n < 3 else (200, (BODY + PAD).encode("cp1252", "ignore"), 0, {})
    files["/half.csv"] = lambda n: (200, text[:250], 90, {})
    files["/small.csv"] = lambda n: (200, b"gone", 0, {})
    urls = [f"{base}/{n}.csv" for n in ("ok", "twice", "half", "small", "ok")] + [None]
    wanted = spark.createDataFrame([(u,) for u in urls], "url string")
    how = dict(path=str(tmp_path / "cache"), pause=0.01)
    got = {r.url.rsplit("/", 1)[1]: bytes(r.content) for r in fetched.fetch(wanted, **how).collect()}
    assert got == {"ok.csv": text, "twice.csv": (BODY + PAD).encode("cp1252", "ignore")}
    assert asked == {"/ok.csv": 1, "/twice.csv": 3, "/half.csv": 3, "/small.csv": 3}
    log = {r.url.rsplit("/", 1)[1]: r for r in fetched.request_log(spark, how["path"]).collect()}
    assert [(log[n].tries, log[n].status, log[n].quota, log[n].bytes) for n in ("ok.csv", "twice.csv", "small.csv")] == [(1, 200, 41, len(text)), (3, 200, None, len(got["twice.csv"])), (3, 200, None, 0)]
    assert log["half.csv"].error.startswith("IncompleteRead") and all(r.seconds >= 0 for r in log.values())

    # the second time only what is missing is asked for; with refresh all, and only what differs is committed
    fetched.fetch(wanted.where("url like '%ok.csv' or url like '%twice.csv'"), **how).collect()
    assert asked["/ok.csv"] == 1 and asked["/twice.csv"] == 3
    version[0] = text.replace(b"2\r", b"5\r")
    again = fetched.fetch(wanted, refresh=True, **how)
    assert asked["/ok.csv"] == 2 and {bytes(r.content) for r in again.collect()} == {version[0], got["twice.csv"]}
    table = fetched.cache(spark, how["path"])
    assert table.read().count() == 2
    assert spark.read.parquet(f"{table.path}/{table.log()[-1]['folder']}").count() == 1

    rows = fetched.result_cells(again, ["HomeTeam", "FTHG", "FTAG"])
    assert sorted((r.url[-6:], r.HomeTeam, r.FTHG, r.FTAG) for r in rows.collect()) == [("ce.csv", "Brighton, H", "0", None), ("ce.csv", "Ärsenal", "2", None), ("ok.csv", "Brighton, H", "0", None), ("ok.csv", "Ärsenal", "5", None)]
    replaced = fetched.result_cells(again, ["HomeTeam"], "utf-8-sig").where("HomeTeam like '%rsenal'")
    assert sorted(r.HomeTeam for r in replaced.collect()) == ["Ärsenal", "�rsenal"]


def test_requests_and_payloads(spark, tmp_path, server):
    base, files, asked = server
    files["/fixtures/events"] = lambda n: (200, b'{"response": [{"time": {"elapsed": 12, "extra": null}, "team": {"id": 5}, "player": {"id": 9}, "assist": {"id": null}, "type": "Goal", "detail": "Header"}, {"time": {"elapsed": 90, "extra": 3}, "type": "Card"}]}', 0, {})
    files["/status"] = lambda n: (200, b'{"response": {"requests": {"current": 12, "limit_day": 100}}}', 0, {})
    files["/bad"] = lambda n: (200, b"no json", 0, {})
    how = dict(path=str(tmp_path / "cache"), pause=0.01, least_bytes=1)
    asks = fetched.feed_requests(spark.createDataFrame([(7,)], "match_id long"), base, "/fixtures/events", fixture="match_id")
    events = fetched.feed_events(fetched.fetch(asks, **how)).orderBy("place").collect()
    assert [(e.minute, e.extra, e.team, e.player, e.assist, e.type, e.detail) for e in events] == [(12, 0, 5, 9, None, "goal", "Header"), (90, 3, None, None, None, "card", None)]
    assert list(asked) == ["/fixtures/events?fixture=7"]
    one = spark.range(1).select("id")
    assert [tuple(r)[1:] for r in fetched.feed_status(fetched.fetch(fetched.feed_requests(one, base, "status"), **how)).collect()] == [(12, 100, 88)]
    assert fetched.feed_events(fetched.fetch(fetched.feed_requests(one, base, "bad"), **how)).collect() == []
    seasons = spark.createDataFrame([(2024,), (1999,)], "start_year int")
    assert sorted(r.url for r in fetched.season_requests(seasons, "http://h/x", ["E0"]).collect()) == ["http://h/x/2425/E0.csv", "http://h/x/9900/E0.csv"]
    numbers = spark.createDataFrame([("E0",), ("XX",), (None,)], "d string").select(fetched.league_number(F.col("d")).alias("n"))
    assert [r.n for r in numbers.collect()] == [39, None, None]
