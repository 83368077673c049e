import random

from oracle import same

from seqloom.llm import url_filter as u
from seqloom.llm.queries import ORACLE_SQL, QUERIES


def brute(url, rules=u.RULES, blocked=u.BLOCKED):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = lambda r: (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith(r[len(r.split("/", 1)[0]) :])
    best = sorted(((-len(r), r, v) for r, v in rules if fits(r)))
    if best:
        return host, path, best[0][1], best[0][2]
    return host, path, None, "block" if any(fits(b) for b in blocked) else "allow"


URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.net/en/x", "https://a.b.example.net/en", "http://notexample.com/de/1", "http://w.example.com/de/", "http://x.org/fr/?q#f",
    "http://x.net", "http://x.net?/", "http://x.net/#", "ftp://net/", "x://y://net/", "http://spam-farm.example.org/en/1", "http://spam-farm.example.org/fr/1", "http://É.NET/ü/é", "http://net./", "http://.net/\nz", "http://a.net/" + "p" * 100000,
]


def test_urls(spark):
    rows = [(i, x, "e") for i, x in enumerate(URLS)] + [(3, URLS[4], "e"), (None, URLS[4], "e")]
    got = u.judged(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got), key=str) == sorted(((i, *brute(x)) for i, x, _ in rows), key=str)
    assert u.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_collisions_are_told_apart(tmp_path):
    digest = lambda e: len(e) % 3
    rules = [("net/", "block"), ("com/", "allow"), ("a.org/x", "block"), ("b.org/y", "allow"), ("de/", "block")]
    (tmp_path / "i").write_bytes(u.index_bytes(rules, ["fr/"], digest))
    index = u.Index(str(tmp_path / "i"), digest)
    urls = ["http://q.net/", "http://a.com/", "http://a.org/xy", "http://b.org/x", "http://z.fr/", "http://z.es/", "http://z.de/"]
    want = [brute(x, rules, ["fr/"]) for x in urls]
    assert index.judge([w[0] for w in want], [w[1] for w in want]) == [w[2:] for w in want]
    (tmp_path / "e").write_bytes(u.index_bytes([], []))
    assert u.Index(str(tmp_path / "e")).judge(["a.net"], ["/"]) == [(None, "allow")]


def test_a_list_that_is_a_table(spark):
    rng = random.Random(3)
    label = lambda: rng.choice("abcdefghij") + rng.choice("abcdefghij")
    entries = [f"{label()}.{label()}/{rng.choice(['', 'x', 'x/y', 'ü'])}" for _ in range(3000)] + ["zz.zz", "net/", "É.q/"]
    table = spark.createDataFrame([(e, 1) for e in entries] + [(None, 2), (entries[0], 3)], "entry string, other int")
    urls = URLS + [f"http://w.{label()}.{label()}/{rng.choice(['', 'x/y/z', 'xy', 'ü'])}" for _ in range(400)] + ["http://zz.zz", "http://a.zz.zz/q", "http://zz.z/", "http://É.q/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = sorted((i, *brute(x, blocked=entries)) for i, x in enumerate(urls))
    assert {w[4] for w in want if w[3] is None} == {"allow", "block"}
    assert sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in u.judged(pages, blocked=table).collect()) == want
    none = u.judged(pages, blocked=table.filter("false")).collect()
    assert sorted((r["page_id"], r["verdict"]) for r in none) == sorted((i, brute(x, blocked=())[3]) for i, x in enumerate(urls))


def test_parts_of_an_index(spark, tmp_path):
    entries = [f"h{i}.example/p{i % 7}" for i in range(2500)]
    parts = list(u.listed_parts(spark.createDataFrame([(e,) for e in entries], "entry string"), 100))
    assert len(parts) >= 25
    (tmp_path / "i").write_bytes(u.index_bytes(u.RULES, []) + b"".join(parts))
    index = u.Index(str(tmp_path / "i"))
    assert index.judge([e.split("/")[0] for e in entries], ["/" + e.split("/")[1] for e in entries]) == [(None, "block")] * 2500
    assert index.judge(["h1.example", "x.net"], ["/p2", "/"]) == [(None, "allow"), ("net/", "block")]


def test_query_equals_sql(spark):
    same(spark, QUERIES["op1_urls"], ORACLE_SQL["op1_urls"], "/root/testdata/sf0.01")
