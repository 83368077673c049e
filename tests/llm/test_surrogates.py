import random
import re
import time

import regex

from seqloom.llm import surrogates as s
from seqloom.llm.queries import QUERIES

PATTERN = regex.compile(s.PATTERN.replace(r" ", " "))


def shape(x):
    return re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "0", x))


def luhn(x):
    d = [int(c) for c in re.sub(r"\D", "", x)][::-1]
    return sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(d)) % 10


def mod97(x):
    x = x.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97


def canon(x):
    return x.lower() if "@" in x else re.sub(r"\D", "", x) if not re.match(r"[A-Z]{2}\d|\d+\.\d+\.", x) else x.replace(" ", "")


def pairs(old, new):
    """(mention, replacement) of a text, with all between them unchanged."""
    gaps, found, at, out = PATTERN.split(old), PATTERN.findall(old), 0, []
    assert new.startswith(gaps[0])
    at = len(gaps[0])
    for m, gap in zip(found, gaps[1:], strict=True):
        end = new.find(gap, at) if gap else len(new)
        # the replacement has the mention's length but for names and addresses
        if "@" not in m and not m[0].isalpha() and not re.match(r"\d+\.", m) or re.match(r"[A-Z]{2}\d", m):
            end = at + len(m)
        out.append((m, new[at:end]))
        assert new[end : end + len(gap)] == gap
        at = end + len(gap)
    assert at == len(new)
    return out


def check_pairs(all_pairs):
    to, back = {}, {}
    for old, new in all_pairs:
        if old[0].isalpha() and "@" not in old and not re.match(r"[A-Z]{2}\d", old):
            continue
        o, n = canon(old), canon(new)
        assert o != n and to.setdefault(o, n) == n and back.setdefault(n, o) == o
        if "@" in old:
            assert new.lower().endswith(".example") and shape(new.split("@")[0]).lower() == shape(old.split("@")[0]).lower()
        elif re.match(r"\d+\.", old):
            assert re.fullmatch(r"\d+\.\d+\.\d+\.\d+", new)
        else:
            assert shape(old) == shape(new)
            if len(o) >= 13 and o.isdigit():
                assert luhn(old) == luhn(new)
    return to


TEXT = "Mr. John Smith <John.Smith@mail.example.com> or JOHN.SMITH@MAIL.EXAMPLE.COM, +1 (017) 555-7713 or +1 017 555 7713; card 4111 1111 1111 1111 and 4111111111111111, 10.1.2.3 8.8.8.8."


def test_formats_and_coreference(spark, docs):
    rows = [
        (1, TEXT),
        (2, "Mr. Smith met Mrs. Anna Smith and Herr Müller; FRAU? Frau ANNA KELLER, Dr. Smith. Господин Иванов, Госпожа Анна Иванова."),
        (2, "Mr. Smith met 123-45-6789"),
        (3, "DE89 3704 0044 0532 0130 00 GB82WEST12345698765432 555-1234"),
        (4, None), (5, ""), (6, "no one here"), (7, "word " * 30000 + " a@b.example.com"), (7, "word " * 30000 + " a@b.example.com"), (None, "é.x@d.org 8.8.8.8"),
    ]
    got = s.replaced(docs(rows).selectExpr("*", "lang AS value", "lang AS kind"), "key")
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "value", "kind", "n_replaced"]
    texts = sorted(((r["doc_id"], r["text"], r["n_chars"], r["n_replaced"]) for r in got.collect()), key=lambda r: (str(r[0]), len(r[1] or "")))
    assert len(texts) == len(rows)
    by = {r[0]: r for r in texts if r[0] != 2}
    assert by[4][1:] == (None, 0, 0) and by[5][1] == "" and by[6][1] == "no one here" and by[6][3] == 0
    new = by[1][1]
    assert by[1][2] == len(new) and by[1][3] == 9
    assert not re.search(r"Smith|SMITH|John|555|4111|8\.8\.8\.8", new)
    m = re.fullmatch(r"Mr\. (\w+) (\w+) <(\S+)> or (\S+), \+1 \((\d{3})\) (\d{3})-(\d{4}) or \+1 (\d{3}) (\d{3}) (\d{4}); card (\d{4} \d{4} \d{4} \d{4}) and (\d{16}), (10\.\d+\.\d+\.\d+) (\d+\.\d+\.\d+\.\d+)\.", new)
    assert m
    assert m[3].lower() == m[4].lower() and m[4] == m[4].upper()
    assert m.groups()[4:7] == m.groups()[7:10]
    assert m[11].replace(" ", "") == m[12] and luhn(m[12]) == 0 and m[12][0] == "4"
    short, long = (r[1] for r in sorted((r for r in texts if r[0] == 2), key=lambda r: len(r[1])))
    smith = m[2]
    assert short.startswith(f"Mr. {smith} met ") and not short.endswith("6789")
    n = re.fullmatch(r"Mr\. (\w+) met Mrs\. (\w+) (\w+) and Herr (\w+); FRAU\? Frau (\w+) (\w+), Dr\. (\w+)\. Господин (\w+), Госпожа (\w+) (\w+)\.", long)
    assert n[1] == n[3] == n[7] == smith and n[2].upper() == n[5] and n[2].endswith("ria") and n[4] != n[6].title()
    assert re.fullmatch(r"[А-Я][а-я]+", n[8]) and n[9].endswith("рина") and n[9] != "Анна"
    iban = re.fullmatch(r"(DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d) (GB\d\d[A-Z]{4}\d{14}) (\d{3}-\d{4})", by[3][1])
    assert mod97(iban[1]) == 1 and mod97(iban[2]) == 1
    assert by[None][1].split()[1] == m[14]
    assert s.replaced(docs([]), "key").count() == 0
    other = {r["doc_id"]: r["text"] for r in s.replaced(docs(rows[:1]), "another key").collect()}
    assert other[1] != new


def test_collisions_are_redrawn(spark):
    rows = [("phone", f"1{i:02d}") for i in range(60)]
    got = s.assigned(spark.createDataFrame(rows, "kind string, canon string"), "k").collect()
    assert len({r["surrogate"] for r in got}) == len(rows) == len(got)
    assert all(r["surrogate"][0] == "1" and len(r["surrogate"]) >= 3 for r in got)
    assert sum(len(r["surrogate"]) == 3 for r in got) > 20
    assert not {r["surrogate"] for r in got} & {c for _, c in rows}


def test_query(spark):
    d = "/root/testdata/sf0.01"
    old = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    seen = []
    for r in QUERIES["op5_surrogates"](spark, d).collect():
        found = pairs(old[r["doc_id"]], r["text"])
        assert len(found) == r["n_replaced"]
        seen += found
    assert len(check_pairs(seen)) > 30


def simple_mentions(text):
    """(kind, canon) of what plain rules find, apart from the module's patterns."""
    out = []
    for w in re.split(r"[\s,;()<>]+", text):
        w = w.rstrip(".")
        if w.count("@") == 1:
            out.append(("email", w.lower()))
        elif re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", w) and all(int(x) < 256 for x in w.split(".")):
            out.append(("ip", w))
        elif re.fullmatch(r"\d{13,19}", w):
            out.append(("number", w))
        elif re.fullmatch(r"\d{3}-\d{2}-\d{4}|\d{3}-\d{4}", w):
            out.append(("number", w.replace("-", "")))
    return out


def test_coreference_and_distinctness_over_kinds(spark, docs):
    rng = random.Random(12)
    given, sur = ["John", "Mary", "Lena", "Igor", "Ana"], ["Smith", "Jones", "Ivers", "Okoye"]
    sex = {"John": "m", "Mary": "f", "Lena": "f", "Igor": "m", "Ana": "f"}
    domains = ["a.example.com", "b.example.com", "mail.org", "x.de"]
    titles = {"m": ["Mr.", "Dr.", "Herr"], "f": ["Mrs.", "Prof.", "Frau"]}
    rows, people = [], []
    for i in range(120):
        g, f = rng.choice(given), rng.choice(sur)
        t = rng.choice(titles[sex[g]])
        words = [f"{t} {g} {f} wrote.", f"{g} said", f"{f} agreed", f"u{rng.randrange(30)}@{rng.choice(domains)}", f"{rng.choice(['10', '192.168', '172.16'])}.{rng.randrange(9)}.{rng.randrange(9)}" + ".7" * 2]
        words[4] = ".".join(words[4].split(".")[:4]) if words[4].count(".") >= 3 else words[4]
        words += [f"{rng.randrange(100, 999)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}", f"{rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}", str(rng.randrange(10**12, 10**16)) + "0"]
        rows.append((i, " ; ".join(words)))
        people.append((t, g, f))
    got = {r["doc_id"]: r["text"] for r in s.replaced(docs(rows), "k").collect()}
    names, values = {}, {}
    for i, text in rows:
        old, new = text.split(" ; "), got[i].split(" ; ")
        assert len(old) == len(new)
        t, g, f = people[i]
        title, a, b, wrote = new[0].split(" ")
        assert (title, wrote) == (t, "wrote.") and new[1] == f"{a} said" and new[2] == f"{b} agreed"
        for x, y in ((g, a), (f, b)):
            assert names.setdefault(x, y) == y
        for x, y in zip(old[3:], new[3:], strict=True):
            if x.count(".") == 3 or "@" in x or x.replace("-", "").isdigit():
                assert len(simple_mentions(x)) == 1
                values.setdefault(simple_mentions(x)[0], set()).add(y.lower() if "@" in y else y.replace("-", ""))
    assert all(names[g].endswith({"m": "rton", "f": "ria"}[sex[g]]) for g in names if g in sex)
    assert all(len(v) == 1 for v in values.values()), "one surrogate for each entity"
    made = [next(iter(v)) for v in values.values()] + [x.lower() for x in names.values()]
    assert len(set(made)) == len(made), "no two entities share one, of whatever kind"
    assert not set(made) & ({c for _, c in values} | {x.lower() for x in names})
    hosts = {}
    for (k, c), v in values.items():
        if k == "email":
            assert hosts.setdefault(c.split("@")[1], next(iter(v)).split("@")[1]) == next(iter(v)).split("@")[1]
    assert len(set(hosts.values())) == len(hosts) == len(domains)


def test_a_name_has_one_surrogate_under_any_title(spark, docs):
    text = "Mr. John Smith. Dr. John Smith. Mr. John. Mrs. Kim Lee. Mr. Kim Lee. Prof. Smith"
    got = s.replaced(docs([(1, text)]), "k").collect()[0]["text"]
    m = re.fullmatch(r"Mr\. (\w+) (\w+)\. Dr\. (\w+) (\w+)\. Mr\. (\w+)\. Mrs\. (\w+) (\w+)\. Mr\. (\w+) (\w+)\. Prof\. (\w+)", got)
    assert m[1] == m[3] == m[5] and m[2] == m[4] == m[10] and m[6] == m[8] and m[7] == m[9] and m[1].endswith("rton") and m[6].endswith("lin")


def test_a_crowded_range_gets_other_addresses(spark):
    rows = [("ip", f"192.168.{i // 256}.{i % 256}") for i in range(40_000)] + [("ip", f"172.16.0.{i}") for i in range(256)] + [("email", f"{c}@x.de") for c in "abcdefghijklmnopqrstuvwxyz"]
    table = spark.createDataFrame(rows, "kind string, canon string").selectExpr("kind", "canon", "'n' AS gender", "'q.example' AS base")
    got = [r["surrogate"] for r in s.assigned(table, "k").collect()]
    assert len(got) == len(set(got)) == len(rows) and not set(got) & {c for _, c in rows}
    assert sum(x.startswith("192.168.") for x in got) > 15_000


def test_texts_without_blanks_take_little_time(spark, docs):
    rows = [(1, "a" * 1_000_000 + " 1@"), (2, "a-" * 100_000 + " Mr Smith"), (3, "1" * 1_000_000), (4, "Mr Smith " + "x" * 1_000_000), (5, "a.b" * 4_000 + "@x.example.com")]
    began = time.time()
    got = {r["doc_id"]: r for r in s.replaced(docs(rows), "k").collect()}
    assert time.time() - began < 60
    assert got[1]["text"] == rows[0][1] and got[2]["n_replaced"] == got[4]["n_replaced"] == got[5]["n_replaced"] == 1
