import hashlib
import random
import re
import time

import duckdb
from oracle import same

from seqloom.llm import quotes
from seqloom.llm.queries import ORACLE_SQL, QUERIES


def norm(x):
    return re.sub(r"[\s>]+", " ", x.lower()).strip(" ")


def parse(text):
    out = []
    for line in re.split(r"\r?\n", text or ""):
        m = re.match(r"[ \t]{0,3}(?:>[ \t]?){1,1000}", line)
        level, rest = (m[0].count(">"), line[m.end() :]) if m else (0, line)
        out.append((level, rest))
    return out


def own(text):
    if text is None or ">" not in text:
        return text
    return re.sub(r"^\s*\n", "", "\n".join(x for n, x in parse(text) if n == 0)).rstrip(" \t\n\x0b\f\r")


def runs(text):
    found, last = [], None
    for level, line in parse(text):
        if level != last:
            found.append((level, []))
        found[-1][1].append(line)
        last = level
    return found


def units(t):
    """(kind, text) of a passage: itself, its paragraphs, its lines."""
    return [(0, norm(t)), *((1, norm(x)) for x in re.split(r"\n\s*\n", t)), *((2, norm(x)) for x in t.split("\n"))]


def brute(rows):
    """conversations() of (conv, turn, role, text) rows, one message at a time."""
    says, first = {}, {}
    for c, t, _, x in rows:
        if c is None or t is None or x is None:
            continue
        for whole in [own(x), *("\n".join(r) for level, r in runs(x) if level == 0)]:
            for _, u in units(whole):
                if u:
                    says.setdefault((c, u), set()).add(t)
                    first[u] = min(first.get(u, (c, t)), (c, t))
    link = {}
    for c, t, _, x in rows:
        if c is None or t is None or not x:
            continue
        passages = [(level, n, "\n".join(r)) for n, (level, r) in enumerate(runs(x)) if level and norm("\n".join(r))]
        if not passages:
            continue
        near, away = [], []
        for level, n, p in passages:
            for kind, u in units(p):
                if not u:
                    continue
                earlier = [s for s in says.get((c, u), ()) if s < t]
                if earlier:
                    near.append((level, n, kind, -len(u), max(earlier)))
                if u in first and first[u][0] != c:
                    away.append((level, n, kind, -len(u), *first[u]))
        parent = min(near)[-1] if near else None
        link[c, t] = (len(passages), parent, *(min(away)[-2:] if away and not near else (None, None)))
    kids = {}
    for (c, t), v in link.items():
        if v[1] is not None:
            kids.setdefault((c, v[1]), []).append(t)
    out = []
    for c, t, r, x in rows:
        n, parent, sc, st = link.get((c, t), (0, None, None, None))
        top, depth = t, 0
        while link.get((c, top), (0, None))[1] is not None:
            top, depth = link[c, top][1], depth + 1
        order, todo = [], [top]
        while todo:
            now = todo.pop()
            order.append(now)
            todo += sorted(kids.get((c, now), ()), reverse=True)
        out.append((c, t, r, own(x), n, parent, sc, st, top, depth, order.index(t)))
    return sorted(out, key=str)


NAMES = ["conv_id", "turn", "role", "text", "n_quotes", "parent_turn", "source_conv", "source_turn", "thread_turn", "depth", "place"]


def check(spark, rows, block=4):
    table = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, hash string")
    found = quotes.conversations(table, block)
    assert found.columns == NAMES
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows)


def test_small_conversations(spark):
    rows = [
        (1, 0, "user", "Hello there\nhow are you?\n\nSecond part"),
        (1, 1, "assistant", "> hello  THERE\n> how are you?\n\nFine."),
        (1, 2, "user", "> > Hello there\n> > how are you?\n> Fine.\nGood\r\n> second part\r\nyes"),
        (1, 3, "assistant", ">Good yes\n>\n>> Fine.\nok"),
        (1, 4, "user", "> unknown words"),
        (1, 5, None, None), (1, 6, "user", ""), (1, 7, "user", "> "), (1, None, "user", "> Fine.\nx"), (None, 3, "user", "> Fine.\ny"),
        (2, 0, "user", "a > b is no quote\n"), (2, 1, "user", "   > Fine.\nfrom elsewhere"), (2, 1, "user", "twice\n> from elsewhere"), (2, 2, "user", "> twice"),
        (3, 0, "user", "word " * 30000), (3, 9, "user", "> " + "word " * 30000 + "\nlong"),
    ]
    check(spark, [r for r in rows if r[:2] != (2, 1)])
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert quotes.conversations(table).count() == len(rows)
    check(spark, [])


def linked(spark, texts):
    table = spark.createDataFrame([(1, t, "user", x) for t, x in enumerate(texts)], "conv_id long, turn long, role string, text string")
    return {r["turn"]: (r["parent_turn"], r["place"]) for r in quotes.conversations(table).collect()}


def test_partial_and_inline_quotes(spark):
    found = linked(spark, [
        "p1 is one paragraph\nof two lines\n\np2 is another\n\np3 ends it",  # 0
        "> p1 is one paragraph\n> of two lines\n>\n> p2 is another\nr1 to both\n> p3 ends it\nr2 to the end",  # 1: two paragraphs of three
        "> of two lines\nonly that line",  # 2: one line of a paragraph
        ">> p1 is one paragraph\n> r1 to both\n>> p2 is another\n> r2 to the end\nfine",  # 3: an inline reply
        "> r1 to both r2 to the end\nrewrapped",  # 4
        "> only that line\nyes",  # 5
        "> nobody said this\n> only that line\nno",  # 6: a line that somebody said
    ])
    assert {t: p for t, (p, _) in found.items()} == {0: None, 1: 0, 2: 0, 3: 1, 4: 1, 5: 2, 6: 2}
    assert [t for t, _ in sorted(found.items(), key=lambda x: x[1][1])] == [0, 1, 3, 4, 2, 5, 6]


def test_a_long_chain_and_a_wide_thread(spark):
    rows = [(1, 0, "user", "start")] + [(1, t, "user", f"> message {t - 1}\nmessage {t}") for t in range(1, 60)]
    rows += [(2, 0, "user", "root words")] + [(2, t, "user", f"> root words\nanswer {t}") for t in range(1, 60)]
    check(spark, rows, 7)


def test_long_texts_take_little_time(spark):
    rows = [(1, 0, "user", "\n".join(f"> line {i}" for i in range(100_000))), (1, 1, "user", ">" * 100_000 + " x"), (1, 2, "user", "a" + " " * 100_000 + "b > c"), (1, 3, "user", "\n" * 100_000 + "> x")]
    began = time.time()
    assert quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).count() == 4
    assert time.time() - began < 60


def test_derived_replies(spark):
    same(spark, QUERIES["op9_derived_replies"], ORACLE_SQL["op9_derived_replies"], "/root/testdata/sf0.01")
    rows = QUERIES["op9_derived_replies"](spark, "/root/testdata/sf0.01").collect()
    assert sum(r["parent_turn"] is not None for r in rows) > 0.5 * len(rows)


def test_random_conversations(spark):
    rng = random.Random(8)
    rows = []
    for c in range(6):
        said = []
        for t in range(40 if c == 0 else 12):
            text = rng.choice(["yes", "no", "maybe so", "well then"]) + (f" {c} {t}" if rng.random() < 0.5 else "")
            quoted = ""
            if said and rng.random() < 0.7:
                quoted = "".join("> " + x + "\n" for x in rng.choice(said[-20:]).split("\n"))
            rows.append((c, t, "user", quoted + text))
            said.append(quoted + text if rng.random() < 0.5 else text)
    check(spark, rows)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = con.execute(f"SELECT {', '.join(NAMES)} FROM ({ORACLE_SQL['op9_quotes']})").fetchall()
    assert sorted(got, key=str) == brute(rows)


def test_query_equals_sql(spark):
    same(spark, QUERIES["op9_quotes"], ORACLE_SQL["op9_quotes"], "/root/testdata/sf0.01")


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{d}/conversations.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op9_quotes"](spark, d).collect()), key=str) == brute(rows)
    assert len(hashlib.sha256(b"").hexdigest()) == 64
