"""Whole jobs: what a shorter way would leave out."""

import random
import re
from fractions import Fraction

import numpy as np
import pytest
from test_llm_small import components, contamination, docs, items, ordered, shingles, texts, variants  # noqa: F401

from touchline.llm import decontaminate, jaccard_join, secret_scan, url_filter


@pytest.mark.parametrize("limit", [8 << 20, -1])
def test_decontaminate_judges_each_row(docs, items, limit):  # noqa: F811
    rows, frame = items
    want = [x for w, x in zip(contamination(texts(), rows), texts(), strict=True) if not w[5]]
    kept = decontaminate.decontaminate(docs, frame, max_broadcast_bytes=limit)
    assert kept.columns == docs.columns
    assert ordered(kept.select("doc_id", "text").collect()) == ordered(want)
    assert {15, None} <= {i for i, _ in want} and len(want) < len(texts())


def test_keep_one_judges_texts(spark):
    a, b, c = "a b c d e f g", "quite other words that stand here", "and one more text that is alone"
    rows = [(1, a), (1, a), (1, b), (2, a), (2, c), (None, a), (None, a), (3, None), (3, None), (4, "A b c  d e f g"), (5, "x y"), (5, "X y")]
    frame = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, sum int").repartition(3)
    got = jaccard_join.keep_one(frame)
    assert got.columns == frame.columns
    got = [(r.doc_id, r.text and r.text.lower()) for r in got.collect()]
    assert ordered(got) == ordered([(1, a), (1, b), (2, c), (None, a), (None, a), (3, None), (3, None), (5, "x y")])


def rarity(sets):
    """What ``jaccard_join.rarity`` gives of the shingles of ``sets``."""
    counts = np.ones(jaccard_join.CELLS)
    for s in sets:
        np.add.at(counts, jaccard_join.cell(s), 1)
    return np.log(counts / counts.sum()).astype(np.float32)


@pytest.mark.parametrize("ratio", ["0.8", "0.9"])
def test_unrelated_sets_share_no_part(ratio):
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 2**63, 60).astype(np.uint64)
    for n in (100, 500, 1500):
        sets = [np.unique(np.concatenate([passage[: n // 3], rng.integers(0, 2**63, n - min(60, n // 3)).astype(np.uint64)])) for _ in range(60)]
        rare = rarity(sets)
        own = [set(jaccard_join.signature(s, Fraction(ratio), rare).tolist()) for s in sets]
        assert sum(1 for i, a in enumerate(own) for b in own[:i] if a & b) == 0


@pytest.mark.parametrize("ratio", ["0.3", "0.5", "0.8", "0.9"])
def test_linked_sets_share_a_part(ratio):
    rng = np.random.default_rng(2)
    r, cases, linked = Fraction(ratio), [], 0
    common = rng.integers(0, 2**63, 40).astype(np.uint64)
    for _ in range(2500):
        n = int(rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 12, 15, 16, 19, 40, 150]))
        a = np.unique(np.concatenate([rng.choice(common, n // 3), rng.integers(0, 2**63, n - n // 3).astype(np.uint64)]))
        most = int(len(a) * (1 - r) / r)
        gone = int(rng.integers(0, min(most, len(a) - 1) + 1))
        new = int(rng.integers(0, most - gone + 1))
        cases.append((a, np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 2**63, new).astype(np.uint64)]))))
    rare = rarity([s for pair in cases for s in pair])
    for a, b in cases:
        both = len(np.intersect1d(a, b))
        if both and Fraction(both, len(a) + len(b) - both) >= r:
            linked += 1
            assert set(jaccard_join.signature(a, r, rare).tolist()) & set(jaccard_join.signature(b, r, rare).tolist())
    assert linked > 1000


def test_families_do_not_grow_with_unrelated_documents(spark):
    """Ten thousand documents that share common words and passages, and some near copies of them."""
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(300)]
    lines = [" ".join(rng.choice(vocabulary, 25)) for _ in range(20)]
    rows = []
    for i in range(10_000):
        own = " ".join(rng.choice(vocabulary, int(rng.integers(30, 120))))
        rows.append((i, f"{own} {lines[i % 20]} {lines[(i // 20) % 20]}" if i % 2 else own))
    rows += [(20_000 + i, " ".join(["x", *t.split()[1:]])) for i, t in rows[::100]]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    ratio = Fraction("0.8")
    _, _, groups = jaccard_join._join(frame, 5, ratio)
    families = groups.groupBy("family").count()
    assert families.agg({"count": "max"}).head()[0] <= 20
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(frame, 5, "0.8").collect()}
    copies = {20_000 + i: i for i, _ in rows[:10_000:100]}
    assert {i for i, c in got.items() if c != i} == set(copies) and all(got[i] == c for i, c in copies.items())


@pytest.mark.parametrize("k,similarity", [(5, "0.8"), (3, "0.9")])
def test_thousands_of_rows_against_brute_force(spark, monkeypatch, k, similarity):
    """Every link of 6000 texts, large families in blocks; brute force counts overlaps through an index of shingles."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "MAX_BROADCAST_ROWS", 0)
    rows = variants(21, 5000)
    rng = np.random.default_rng(4)
    base = [f"c{i}" for i in range(60)]
    rows += [(9000 + i, " ".join(w if rng.random() > 0.02 else f"d{i}" for w in base[: 50 + i % 11])) for i in range(1000)]
    sets, index, shared = [(i, shingles(t, k)) for i, t in rows], {}, {}
    for n, (_, s) in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(n)
    for holders in index.values():
        for y, b in enumerate(holders):
            for a in holders[:y]:
                shared[a, b] = shared.get((a, b), 0) + 1
    num = int(float(similarity) * 10)
    links = [(a, b) for (a, b), both in shared.items() if 10 * both >= num * (len(sets[a][1]) + len(sets[b][1]) - both)]
    many = np.bincount(np.array(links).ravel(), minlength=len(rows))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    counts = {r.doc_id: r.n_links for r in jaccard_join.link_counts(frame, k, similarity).collect()}
    assert counts == {i: int(n) for (i, _), n in zip(rows, many, strict=True)} and many.max() > 100
    root = components([i for i, _ in rows], [(rows[a][0], rows[b][0]) for a, b in links])
    assert {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(frame, k, similarity).collect()} == root


@pytest.mark.parametrize("block", [128, 3])
def test_every_link_is_counted(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = variants(12, 120) + [(None, "a b c"), (900, None), (901, ""), (902, "a b c"), (902, "a b c"), (903, "A B\tC"), (902, "x y z")]
    sets = [(i, shingles(t, 3)) for i, t in rows]
    want = [(i, len(s), sum(1 for m, (j, t) in enumerate(sets) if m != n and None not in (i, j) and s and t and 10 * len(s & t) >= 8 * len(s | t))) for n, (i, s) in enumerate(sets)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert max(n for _, _, n in want) >= 3
    assert ordered(jaccard_join.link_counts(frame, 3, "0.8").collect()) == ordered(want)
    assert jaccard_join.link_counts(frame.limit(0)).collect() == []


def test_references_are_resolved(spark):
    link, refresh = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    blocked = [link.format("//y.org/es/1"), refresh.format("//y.org/es/1"), link.format("../es/2"), link.format("./../x/../../es/2"), link.format("http://z.info/nothing") + link.format("http://y.org/es/3"), refresh.format("/nothing") + refresh.format("/en/../es/4"), link.format("?id=3"), link.format("page2.html#part")]
    rows = [(i, "http://y.org/a/page" if i != 7 else "http://w.info/b/page", h) for i, h in enumerate(blocked)]
    rows = [(i, f"{u}{i}", h) for i, u, h in rows]
    rows[6] = (6, "http://v.info/c/d?id=2", blocked[6])
    rows += [(20, "http://v.info/c/d?id=3", link.format("http://y.org/es/5")), (21, "http://w.info/b/page2.html", link.format("http://y.org/es/6")), (22, "http://w.info/page2.html", ""), (23, "http://q.info", link.format("x")), (24, "http://q.info/x", link.format("http://y.org/es/7")), (25, "http://q.info/#a", link.format("mailto:a@b.org") + link.format("#top"))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(frame).collect()}
    assert {i: got[i] for i in [*range(8), 20, 21, 23, 24]} == dict.fromkeys([*range(8), 20, 21, 23, 24], "block")
    assert got[22] == got[25] == "allow" and len(got) == len(rows)


def test_verdicts_of_a_graph(spark):
    """Thousands of pages in chains, hubs and pairs, and rules by the hundred, against a plain search."""
    rng = random.Random(5)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "d.org", "x.d.org", "e.net", "xd.org", "org", "q.e.net:80"]
    url = lambda: f"http://{rng.choice(hosts)}/{rng.choice('pqrst')}/{rng.randrange(900)}"
    rules = [(rng.choice(["allow", "block", "block"]), rng.choice([*hosts, "com", "net"]), f"/{rng.choice('pqrst')}/{rng.choice(['', rng.randrange(10), rng.randrange(900)])}") for _ in range(300)]
    rules += [("block", None, "/"), ("block", "d.org", None), (None, "org", "/"), ("other", "org", "/")]
    link = '<link rel="canonical" href="{}">'
    urls = [url() for _ in range(3000)]
    html = {u: "" for u in urls}
    edges = [(a, url()) for a in rng.sample(urls, 700)]
    edges += [(f"http://chain.info/{i}", f"http://chain.info/{i + 1}") for i in range(60)] + [("http://chain.info/60", "http://a.com/p/1")]
    edges += [(u, "http://hub.info/") for u in rng.sample(urls, 150)]
    for a, b in edges:
        html[a] = html.get(a, "") + link.format(b)
    moved = [(url(), url()) for _ in range(200)] + [(None, "http://d.org/"), ("x", "y")]
    pages = [(i, u, html[u]) for i, u in enumerate([*html, *urls[:50]])] + [(-1, None, link.format("http://a.com/")), (-2, "no url", None)]

    def parts(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        return (m[1], m[2]) if m else ("", "")

    def action(u):
        host, path = parts(u)
        fits = [(len(h + p), a == "allow", h + p, a) for a, h, p in rules if a in ("allow", "block") and h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[2:] if fits else (None, None)

    every = [*edges, *(m for m in moved if all(x and "://" in x for x in m))]
    root = components({x for e in every for x in e}, every)
    votes = {}
    for u, r in root.items():
        votes.setdefault(r, set()).add(action(u)[1])
    want = []
    for i, u, _ in pages:
        rule, own = action(u)
        group = votes.get(root.get(u), set())
        want.append((i, *parts(u), rule, own or ("block" if "block" in group and "allow" not in group else "allow")))
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    listed = spark.createDataFrame(rules, "action string, host string, path string")
    got = url_filter.judge_urls(frame, listed, spark.createDataFrame(moved, "src string, dst string"))
    assert ordered(got.collect()) == ordered(want)
    assert {w[4] for w in want if w[3] is None} == {"allow", "block"}
    assert url_filter.judge_urls(frame, listed.limit(0)).where("verdict <> 'allow' or rule is not null").count() == 0


def test_long_built_values_are_found_whole():
    part = "Zx8fQ2pL9v{:04d}"
    for text in (
        's = ""\n' + "".join(f's = s + "{part.format(i)}"\n' for i in range(300)) + "db_password = s\n",
        "s = " + " + ".join(f'"{part.format(i)}"' for i in range(300)) + "\ndb_password = s\n",
        'password = ""\n' + "".join(f'password = password + "{part.format(i)}"\n' for i in range(300)),
    ):
        assert [text[a:b] for a, b in secret_scan.lexed_spans(text)] == [part.format(i) for i in range(300)]
    assert secret_scan.lexed_spans('s = "Zx8fQ2pL9v01"\ns = "other"\npassword = s\n') == []


V, W = "Zx8fQ2pL9v7Kd3", "bN4tR7yU1mC6xE"
SNIPPETS = [
 (V, []),
 (f'db_password = "{V}"',[V]),
 (f'config["db_password"] = "{V}"',[V]),
 (f'password = """{V}\nsecond line"""',[V+"\nsecond line"]),
 (f'user, db_password = "bobby.tables9", "{V}"',[V]),
 (f'db_password, user = "{V}", "bobby.tables9"',[V]),
 (f'secret_key = (\n    "{V}"\n)\nother = "{W}"',[V]),
 (f'db:\n  password:\n    {V}\n  user: x',[V]),
 (f'<password>{V}</password>',[V]),
 (f'<server><db-password> {V} </db-password></server>',[V]),
 (f'<add key="db_password" value="{V}"/>',[V]),
 (f'x = c if a else "{V}"; auth_key = x',[V]),
 (f'db_password = DEFAULT\nDEFAULT = "{V}"\n',[V]),
 (f'db.set("password", "{V}")',[V]),
 (f'connect(host="h", password="{V}")',[V]),
 (f'let apiKey = `{V}`;',[V]),
 (f"private_key: |\n  {V}\n  {W}\nname: x",[f"{V}\n  {W}"]),
 (f'{{"user": "bob", "authKey": "{V}", "n": 3}}',[V]),
 (f'export DB_PWD={V}',[V]),
 (f'auth_key := "{V[:5]}" + "{V[5:]}x"',[V[5:]+"x"]),
 (f'a = "{V}"\nb = a\nc = b\nsecret_key = c',[V]),
 (f'def f():\n    k = "{V}"\n    return k\nk = "{W}"\nauth_key = k\n',[W]),
 (f'k = "{W}"\ndef f():\n    k = "{V}"\n    auth_key = k\n',[V]),
 (f'k = "{W}"\ndef f():\n    auth_key = k\n',[W]),
 (f'function f() {{ const k = "{V}"; auth_key = k; }}\nk = "{W}";',[V]),
 (f'password = os.getenv("{V}")',[]),
 (f'password = str("{V}")',[V]),
 (f'password_field = "{V}"',[]),
 (f'title = "{V}"',[]),
 (f's = "{V}"\ns = "other"\npassword = s\n',[]),
 (f'x = config["{V}"]\npassword = x',[]),
 (f'config["pw"] = "{V}"\nauth_token = config["pw"]',[V]),
 (f'x.y = "{V}"\nauth_token = x.y',[V]),
 (f'String dbPassword = "{V}";',[V]),
 (f'db_password: str = "{V}"',[V]),
 (f'db_password: Optional[str] = "{V}"',[V]),
 (f"secret_key = '{V}'  # it's old\nname = '{W}'",[V]),
 (f'auth_key = "{V}" \\\n  "{W}"\nz = "{W}x"',[V,W]),
 (f'auth_key = ["{V}", "{W}"]',[V,W]),
 (f'auth_key = a ? "{V}" : "{W}";',[V,W]),
 (f'creds = {{"user": "bob"}}\nauth_key = creds',[]),
 (f'; comment\n[db]\ndb_pwd = {V}/+x==\nhost = localhost',[V+"/"]),
 (f'# auth_key = "{V}"',[V]),
 (f'// authKey: "{V}"',[V]),
 (f'ENV AUTH_KEY={V}\nRUN x',[V]),
 (f'auth_key = \n    "{V}"\n',[V]),
 (f'auth_key:\nname: {V}',[]),
 (f'k += "{V}"\nauth_key = k',[V]),
 (f'if password == "{V}": pass',[]),
 (f'password = ""',[]),
 (f"The user's password is secret and the token is a word.",[]),
 (f"a = b = \"{V}\"\nauth_key = a",[V]),
 (f"auth_key = b = \"{V}\"",[V]),
 (f"<e name=\"password\">{V}</e>",[V]),
 (f"auth_key = x ? y : \"{V}\"",[V]),
 (f"{{name: {W}, auth_key: {V}}}",[V]),
]


@pytest.mark.parametrize("text,want", SNIPPETS)
def test_names_and_literals(text, want):
    assert [text[a:b] for a, b in secret_scan.lexed_spans(text)] == want


@pytest.mark.parametrize("many", [1, 3000])
@pytest.mark.parametrize("part", ["x: ", "a=b\n", "password = (", "<a key='password' ", "password = a ? b : ", "def f():\n", "{", '("password", "a1b2c3d4", ', "password = \\\n", "password: |\n", "a = password = ", "'", '"""', "]", "password = f("])
def test_broken_source_is_no_error(part, many):
    secret_scan.spans(part * many + "password")
