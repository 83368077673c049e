import hashlib
import itertools
import math
import random
import re
import time
from collections import Counter
from functools import cache

import pyarrow.parquet as pq

from seqloom.llm import secret_scan as s
from seqloom.llm.queries import QUERIES


def brute_base(text):
    text, found = text or "", []
    for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 16:
            found.append((m.start(), 1, f"access:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 32:
            found.append((m.start(), 2, f"hex:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(found)]


@cache
def pairs():
    """How often each letter stands behind another in the words of the list, ^ before the first."""
    return Counter(x for w in s.ranks() for x in zip("^" + w, w, strict=False))


def brute_word(word):
    """The bits of a word by its letter pairs; null if it isn't spelled as one, or has letters of both cases."""
    if not (word.islower() or word.isupper() or word[1:].islower() or word == word.lower()):
        return None
    if any(c > "\x7f" for c in word):
        return min(26, 5 * len(word))
    if len(word) < 5:
        return None
    behind = Counter()
    for (a, _), n in pairs().items():
        behind[a] += n
    low, bits = word.lower(), 0
    for a, b in zip("^" + low, low, strict=False):
        bits -= math.log2((pairs()[a, b] + 0.5) / (behind[a] + 13))
    return min(26, bits) if bits <= (4.9 if len(word) > 8 else 3.7) * len(word) else None


def brute_parts(value, cased):
    """(a, b, bits) of all parts but single characters, each stretch of the value looked at on its own."""
    n, low, ranks = len(value), value.lower(), s.ranks()
    plain = low.translate(s.LEET)
    near = lambda x, y: y in s.NEAR.get(x, ())
    units = lambda k: math.ceil(math.log2(k))
    own = [math.log2(10 if c.isdigit() else 26 if c.isalpha() else 33) for c in value]
    for m in re.finditer(r"[^\W\d_]+", value):
        if (bits := brute_word(m[0])) is not None:
            yield m.start(), m.end(), bits + 1
    for a in range(n):
        for b in range(a + 3, n + 1):
            part, l, size = value[a:b], low[a:b], b - a
            one_case = part.isupper() or part == l or part[1:] == l[1:]
            mixed = 1 + (sum(c.isalpha() for c in part) if cased and not one_case else 0)
            words = sorted((ranks[w], k, sum(x != y for x, y in zip(part, w, strict=True))) for k, w in enumerate((plain[a:b], l)) if w in ranks)
            if words:
                yield a, b, math.log2(words[0][0] + 1) + words[0][2] + mixed
            digits = re.sub(r"[-/._]", "", part)
            if digits.isdigit() and size in (4, 6, 8, 10):
                seps = re.sub(r"\d", "", part)
                year = lambda x: x[:2] in ("19", "20")
                month, day = lambda x: 1 <= int(x) <= 12, lambda x: 1 <= int(x) <= 31
                forms = []
                if size == 4 and not seps:
                    forms.append((year(part), 120))
                if len(digits) == 8:
                    shape = re.sub(r"\d", "0", part)
                    if not seps or len(set(seps)) == 1 and len(seps) == 2 and shape == f"0000{seps[0]}00{seps[0]}00":
                        forms.append((year(digits) and month(digits[4:6]) and day(digits[6:]), 365 * 120))
                    if not seps or len(set(seps)) == 1 and len(seps) == 2 and shape == f"00{seps[0]}00{seps[0]}0000":
                        forms.append((day(digits[:2]) and month(digits[2:4]) and year(digits[4:]), 365 * 120))
                if len(digits) == 6:
                    shape = re.sub(r"\d", "0", part)
                    if not seps or len(set(seps)) == 1 and len(seps) == 2 and shape == f"00{seps[0]}00{seps[0]}00":
                        forms.append((day(digits[:2]) and month(digits[2:4]), 365 * 120))
                for ok, many in forms:
                    if ok:
                        yield a, b, math.log2(many) + mixed
            for p in range(1, 5):
                if size >= max(3, 2 * p) and all(l[i] == l[i - p] for i in range(p, size)):
                    yield a, b, sum(own[a : a + p]) + units(size / p) + mixed
            if all(near(x, y) for x, y in zip(l, l[1:], strict=False)):
                ways = [ord(y) - ord(x) for x, y in zip(l, l[1:], strict=False)]
                turns = 1 + sum(x != y for x, y in zip(ways, ways[1:], strict=False))
                if size > 3:
                    yield a, b, math.log2(47) + units(size) + 1.5 * turns + mixed
                elif s._straight(l):
                    yield a, b, math.log2(47 * 3) + 1.5 * turns + mixed
            steps = {ord(y) - ord(x) for x, y in zip(l, l[1:], strict=False)}
            if len(steps) == 1 and abs(next(iter(steps))) == 1:
                yield a, b, own[a] + units(size) + 1 + mixed


def brute_bits(value, prices=None):
    """The cheapest cut by trying all of them."""
    cased = prices is not None
    prices = prices or [math.log2(10 if c.isdigit() else 26 if c.isalpha() else 33) for c in value]
    parts = {}
    for a, b, bits in [*((i, i + 1, p) for i, p in enumerate(prices)), *brute_parts(value, cased)]:
        parts.setdefault(a, []).append((b, bits))

    @cache
    def go(a):
        return 0 if a == len(value) else min(bits + go(b) for b, bits in parts[a])

    return go(0)


def test_parts_of_runs_are_parts():
    for v in ["abcdefghello", "abcdefghello#hijklmnopassword", "aaaaaaab1990xyz", "19901991", "qwertyuiopassword", "ABCabcABCabc", "aaaaAAAA9876543", "xxxx20240131zzz"]:
        assert abs(s.guess_bits(v) - brute_bits(v)) < 1e-9, v
    assert s.guess_bits("abcdefghello") < 20
    assert not [x for x in s.spans("pwd: abcdefghello#hijklmnopassword")[1] if x[1] == "guess"]


def test_random_mixtures_equal_brute_force():
    rng = random.Random(3)
    bits = ["abcd", "qwer", "POIU", "aaa", "abab", "1990", "31.12.", "20240131", "pass", "Word", "hello", "x", "Q", "7", "#", "zyx", "lkjh", "DCBA", "012"]
    for _ in range(400):
        v = "".join(rng.choice(bits) for _ in range(rng.randint(1, 5)))
        assert abs(s.guess_bits(v) - brute_bits(v)) < 1e-9, v
        prices = [rng.choice((3.0, 5.0, 6.0, math.inf)) for _ in v]
        got, want = s.guess_bits(v, prices), brute_bits(v, prices)
        assert got == want or abs(got - want) < 1e-9, v
        assert s.guess_bits(v, prices, 25.0) == (math.inf if want >= 25 - 1e-9 else got) or abs(want - 25) < 1e-6


def test_long_texts_take_little_time():
    began = time.time()
    for text in ["key " + "a" * 1_000_000, "secret-key: " + "".join(random.Random(1).choices("abcdXYZ019+/", k=1_000_000)), "pass" * 250_000, "x://" * 250_000, "token: " * 100_000]:
        s.spans(text)
    assert time.time() - began < 10
    assert s.guess_bits("a" * 3000) < 20


def test_guess_bits_equals_brute_force():
    for v in ["password1", "qwerty12", "P@ssw0rd99", "aaaaaaa", "abcabcabc", "20240131", "Xk3$9", "zxcvbnm1", "1990-05-17", "z9!Qm2Lx"]:
        assert abs(s.guess_bits(v) - brute_bits(v)) < 1e-9, v
    assert s.guess_bits("") == 0
    assert s.guess_bits("password123456") < 20 < s.guess_bits("qwertyuiop1234") < 35 < 45 < s.guess_bits("kT9#vR2$pLx8Wq")


def test_spans():
    text = "x token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" AKIAABCDEFGHIJKL AKIASHORT\nTOKEN:short api_key='abcdefgh' pasſword=abcdefgh9 toKen=abcdefgh1 token: token: abcdefghij"
    base, found = s.spans(text)
    assert [f"{k}:{a}:{b}" for a, k, b in base] == brute_base(text)
    assert set(base) <= set(found)
    for text, added in [("password is kT9#vR2$pLx8Wq!", "kT9#vR2$pLx8Wq"), ("Authorization: Bearer kT9#vR2$pLx8Wqz", "kT9#vR2$pLx8Wqz"), ("ssh://bob:kT9#vR2$pLx8Wq@host", "kT9#vR2$pLx8Wq"), ("the password is password123", None), ("passphrase: qwertyuiop1234", None)]:
        got = [text[a:b] for a, k, b in s.spans(text)[1] if k == "guess"]
        assert got == ([added] if added else []), text


def test_documents(spark, docs):
    rows = [(1, None), (2, ""), (3, "é token=abcdefgh12 x"), (3, "é token=abcdefgh12 x"), (None, "a" * 32), (4, "b " * 60000 + "secret: 'zzzzzzzzz'"), (5, "pwd=kT9#vR2$pLx8Wq and clean")]
    got = s.scan(docs(rows).selectExpr("*", "lang AS spans")).collect()
    assert sorted(((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got), key=str) == sorted(
        ((d, *(sum(x.startswith(k) for x in brute_base(t)) for k in ("assign", "access", "hex")), hashlib.sha256(",".join(brute_base(t)).encode()).hexdigest()) for d, t in rows), key=str
    )
    clean = s.redact(docs(rows))
    assert clean.columns == docs(rows).columns
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in clean.collect()}
    assert texts[3] == ("é [SECRET] x", 12) and texts[1][0] is None and texts[2][0] == "" and texts[None][0] == "[SECRET]" and texts[5][0] == "pwd=[SECRET] and clean"
    assert s.scan(docs([])).count() == 0 and s.redact(docs([])).count() == 0


def test_query_base_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    want = {r["doc_id"]: brute_base(r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in QUERIES["op7_secrets"](spark, d).collect():
        base = want[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r["spans"].split(",")) | {""}


def brute_strength(value):
    """The cheapest of all cuts and all unions of classes of characters that are guessed one by one."""
    kind = lambda c: "0" if c in "0123456789" else "a" if c in "abcdefghijklmnopqrstuvwxyz" else "A" if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else "#" if c < "\x80" else "é"
    kinds, sizes, best = [kind(c) for c in value], {"0": 10, "a": 26, "A": 26, "#": 33, "é": 200}, math.inf
    last = next((i for i in range(len(value), 0, -1) if kinds[i - 1] != "0"), 0)
    for k in range(len(set(kinds)) + 1):
        for used in itertools.combinations(sorted(set(kinds)), k):
            bits = math.log2(sum(sizes[x] for x in used)) if used else math.inf
            prices = [bits if x in used else math.inf for x in kinds]
            if used == ("a",):
                for i, x in enumerate(kinds):
                    if i >= max(last, len(value) - 4):
                        prices[i] = math.log2(10)
                    elif x == "A" and kinds[i + 1 : i + 3] == ["a", "a"] and (i == 0 or kinds[i - 1] != "A"):
                        prices[i] = bits + 1
            best = min(best, brute_bits(value, prices))
    return best


def brute_spans(text):
    """Base spans and, where a credential can stand, values that take 2 ** 45 guesses; only texts without marks of paths are known here."""
    text, base = text or "", brute_base(text)
    found = [(int(a), int(b), k) for k, a, b in (x.split(":") for x in base)]
    word = r"(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?)"
    places = [m.span(1) for m in re.finditer(word + r"""["']?[ \t]*(?:=>|:=|[:=]|\b[iI][sS]\b)[ \t]*["']?([^\s"'<>]{6,})""", text)]
    places += [m.span(1) for m in re.finditer(r"""\b[bB][eE][aA][rR][eE][rR][ \t]+([^\s"'<>]{6,})""", text)]
    places += [m.span(1) for m in re.finditer(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s/:@]+:([^\s/@]{6,})@", text)]
    for a, b in set(places):
        b = a + len(text[a:b].rstrip(".,;:!?)]}"))
        if b - a >= 6 and not any(x <= a and b <= y for x, y, _ in found) and s.text_bits(text[a:b]) >= 45 and brute_strength(text[a:b]) >= 45:
            found.append((a, b, "guess"))
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(found, key=lambda x: (x[0], s.KINDS.index(x[2]))))


def test_query_spans_equal_brute_force(spark):
    d = "/root/testdata/sf0.01"
    want = {r["doc_id"]: brute_spans(r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r["doc_id"]: r["spans"] for r in QUERIES["op7_secrets"](spark, d).collect()}
    assert got == want and sum(map(bool, want.values())) > 10


def test_text_is_no_secret():
    for text in """The secret is пользователь|secret: 我们的产品很好用，谢谢大家的支持|token: übermäßig|the token is tokenization/segmentation|The secret is understanding-the-customer
token: https://example.com/docs/auth|pwd: 2024-01-15T10:22:33Z|passwd is process.env.DB_PASSWORD|secret: ${DB_PASSWORD}|credentials: getServerSideProps()|access_key is self.session.access_token
the passphrase is Geschwindigkeitsbegrenzung|pwd: anticonstitutionnellement|pwd: 日本語のパスワードです|the token is {{ site.token }}|private key: /etc/ssl/private/server.pem""".replace("\n", "|").split("|"):
        assert not [x for x in s.spans(text)[1] if x[1] == "guess"], text
    for text in ["pwd: wJalrXUtnFEMI/K7MDENG/bPxRfiCYzzEXAMPLEKEY", "bearer eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N", "pwd: kT.9z/Qp7#w", "pwd: парольkT9#vR2$pLx"]:
        assert [x for x in s.spans(text)[1] if x[1] == "guess"], text


def test_words_of_documents_are_no_secrets():
    """Each different longer word of a corpus of invented prose behind "password is", by how often it occurs."""
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text", "lang"]).to_pylist()
    words, false = Counter(), Counter()
    for r in docs:
        words.update((r["lang"], w) for w in re.findall(r"[A-Za-zÀ-ÿ]{6,}", r["text"] or ""))
    for (lang, w), n in words.items():
        false[lang] += n * bool(s.spans(f"the password is {w} here")[1])
    rate = {lang: false[lang] / sum(n for (x, _), n in words.items() if x == lang) for lang in false}
    assert rate["en"] < 0.001 and max(rate["fr"], rate["es"]) < 0.005 and rate["de"] < 0.02


def test_long_repeats_take_little_time():
    began = time.time()
    for v in ("@" * 1_000_000, "ab" * 500_000, "x1" * 10 + "@" * 1_000_000 + "Zq9!", "a.b/" * 200_000):
        s.spans("password: " + v)
    assert time.time() - began < 10
    assert s.strength_bits("@" * 80_000) < 45 < s.strength_bits("@" * 80_000 + "kT9#vR2$pLx")
