"""Secret scan: patterns, and a guess-cost search over values in credential contexts.

The patterns give the base spans. The method adds a span for a value that stands where a
credential would (after a keyword, a bearer header, or in a URL's user part) and that is hard
to guess: a dynamic program finds the cheapest way to cut the value into words of a ranked list,
dates, repeats, keyboard walks and sequences, and brute-force stretches; the cost of a cut is
the sum of the log2 guesses of its parts. Every part of a repeat, walk or sequence is one too. A
brute-force character costs the union of the classes that the cut's brute-force characters use,
so 8 mixed ones of upper and lower case, digits or symbols are 45 bits or more, while one case
and digits (41 bits) cost less than a word of nine letters that is not in the list (42 bits).
Values of at least `min_bits` are secrets. Base spans always stay; an added span that lies
inside another one is left out.

Values that are text are none: a run of letters of one case that is spelled as words are (by the letter pairs of the
vocabulary), or that has letters beyond ASCII, costs a word's bits whatever its length; a value of words, numbers and marks
of a path, a URL or code (`docs/auth`, `os.environ`) is no secret, one of words and hyphens costs its words.

The program takes time in proportion to a value's length (the best start of a run's part is
kept in sliding windows), and ends as soon as no cut under `min_bits` is left.

Nulls: a null text is empty. Every row gives one row, repeated rows too; the result depends on
its text alone. An empty table gives an empty one. Texts of any length are read whole, in time in
proportion to it. Other columns are kept by redact() and left out by scan(), whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import deque
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

KINDS = ("assign", "access", "hex", "guess")
MIN_BITS = 45.0
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run that is long enough is matched from its first digit
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?)["']?[ \t]*(?:=>|:=|[:=]|\bis\b)[ \t]*["']?([^\s"'<>]{6,}+)"""
    r"""|\bbearer[ \t]+([^\s"'<>]{6,}+)""",
    re.I | re.A,
)
#: A scheme's letters before "://", and a user with a password behind it.
SCHEME, USER = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*\Z"), re.compile(r"[^\s/:@]++:([^\s/@]{6,}+)@")
HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "://")
#: Bytes of lower-case hexadecimal digits become "h", all others a blank.
HEX_MAP = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))

# Frequent parts of passwords, the most frequent first.
COMMON = (
    "password 123456 qwerty admin welcome letmein login master secret dragon monkey shadow sunshine princess football baseball "
    "superman batman michael jordan hunter summer winter spring autumn monday friday flower orange purple yellow silver golden "
    "hello world test user root guest default change please computer internet server database system service account private "
    "public access token key pass love angel happy lucky magic star tiger lion eagle falcon ranger soccer hockey killer cookie "
    "coffee cheese banana pepper ginger freedom matrix example sample demo temp null none true false abc xyz foo bar"
).split()
#: The vocabulary whose words, the most frequent first, follow those, and the letters of the shortest.
VOCABULARY, SHORTEST = "word_bpe_49k.json", 5
LEET = str.maketrans("@4301$57!", "aaeoissti")
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
DATE = re.compile(r"(?:19|20)\d\d(?:([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:(?:19|20)\d\d|\d\d)", re.A)
#: The lengths that a date can have.
DATES = (4, 6, 8, 10)
MOMENT = re.compile(r"(?:19|20)\d\d-?\d\d-?\d\d[T_]\d\d:?\d\d(?::?\d\d(?:[.,]\d{1,9})?)?(?:Z|[+-]\d\d:?\d\d)?", re.A)
#: Marks that end a value in scripts without blanks.
STOPS = re.compile("[\u3000-\u3003\u3008-\u3011\uff01\uff08\uff09\uff0c\uff1a\uff1b\uff1f]")
#: Pieces of a name: capitals, a word, digits, letters of other scripts; and marks by which paths, addresses and code are told.
PIECE, MARKS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+(?![^\W\d_a-zA-Z])|\d+|[^\W\d_]+"), set("/.:()[]{}$|\\@#?&=,;")
#: Bits of a word of any language at most, the letters of the shortest, and the bits that its letters have on average at most, of one
#: with fewer than LONGER letters and of others. Of random letters of one case, ten or twelve, one in forty is a word by that.
WORD_BITS, NATURAL, LONGER, SPELLED = 26.0, 5, 9, (3.7, 4.9)


@cache
def ranks() -> dict[str, int]:
    """The rank of each word: the list above, then the whole words of the vocabulary in its order, which is by frequency."""
    import json

    import public_tokenizers

    with open(public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    words = (t.removesuffix("</w>") for t in sorted(vocabulary, key=vocabulary.get) if t.endswith("</w>"))
    words = (w for w in words if len(w) >= SHORTEST and w.isascii() and w.isalpha())
    return {w: i + 1 for i, w in enumerate(dict.fromkeys([*COMMON, *words]))}


@cache
def short_ranks() -> dict[str, int]:
    """ranks() and the words of two to four letters, which count only where they stand alone."""
    import json

    import public_tokenizers

    with open(public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    words = (t.removesuffix("</w>") for t in sorted(vocabulary, key=vocabulary.get) if t.endswith("</w>"))
    return ranks() | {w: i + 1 for i, w in enumerate(w for w in words if w.isascii() and w.isalpha() and len(w) > 1) if len(w) < SHORTEST}


@cache
def spelling() -> dict[str, float]:
    """The bits of a letter behind another, or behind ^ at the start, by the words of the vocabulary."""
    pairs: dict[str, int] = {}
    letters: dict[str, int] = {}
    for w in ranks():
        for a, b in zip("^" + w, w, strict=False):
            pairs[a + b] = pairs.get(a + b, 0) + 1
            letters[a] = letters.get(a, 0) + 1
    own = "abcdefghijklmnopqrstuvwxyz"
    return {a + b: -math.log2((pairs.get(a + b, 0) + 0.5) / (letters.get(a, 0) + 13)) for a in "^" + own for b in own}


def word_bits(word: str) -> float:
    """The bits of a run of letters of one case as a word of some language; infinite if it isn't spelled as one."""
    if not _one_case(word):
        return math.inf
    if not word.isascii():
        return min(WORD_BITS, 5.0 * len(word))
    if len(word) < NATURAL:
        return math.inf
    costs, low = spelling(), word.lower()
    bits = sum(costs[x + y] for x, y in zip("^" + low, low, strict=False))
    return min(WORD_BITS, bits) if bits <= SPELLED[len(word) >= LONGER] * len(word) else math.inf


def text_bits(value: str) -> float:
    """The bits of a value that is words, short numbers and marks; 0 with marks of a path, an address or code, infinite if it is anything else."""
    if MOMENT.fullmatch(value):
        return math.log2(365 * 120 * 86400)
    bits, real, size, rank = 0.0, 0, 0, short_ranks()
    for m in PIECE.finditer(value):
        piece = m[0]
        size += len(piece)
        if piece.isdigit():
            own = math.log2(10) * len(piece) if len(piece) <= 4 else math.inf
        elif found := rank.get(piece.lower()):
            own, real = math.log2(found + 1), real + len(piece) * (len(piece) > 3)
        elif len(piece) <= 2 and piece.isascii():
            own = math.log2(26) * len(piece)
        else:
            own = word_bits(piece)
            real += len(piece)
        bits += own
        if bits == math.inf:
            return bits
    if 2 * real < size or real < NATURAL:
        return math.inf
    return 0.0 if MARKS & set(value) else bits + len(re.findall(r"[\W_]+", value))


@cache
def longest() -> int:
    return max(map(len, ranks()))


def _neighbours() -> dict[str, set[str]]:
    at = {c: (y, x) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
    near = {c: {d for d, (v, u) in at.items() if d != c and abs(v - y) <= 1 and abs(u - x) <= 1} for c, (y, x) in at.items()}
    return near


NEAR = _neighbours()


def _straight(keys: str) -> bool:
    at = [(y, row.index(c)) for c in keys for y, row in enumerate(ROWS) if c in row]
    return len({(v - y, u - x) for (y, x), (v, u) in zip(at, at[1:], strict=False)}) == 1


def _alphabet(c: str) -> int:
    return 10 if "0" <= c <= "9" else 26 if "a" <= c <= "z" or "A" <= c <= "Z" else 33 if c < "\x80" else 200


class _Run:
    """A maximal repeat, walk or sequence, and the cheapest of its parts that ends at each place.

    A part costs what its start says, what its end says, and log2 of its units, rounded up. Parts
    of 2 ** (k - 1) to 2 ** k units start in a window that moves along with the end.
    """

    def __init__(self, start: int, end: int, unit: int, least: int, opens, closes=lambda b: 0.0):
        self.start, self.end, self.unit, self.least, self.opens, self.closes = start, end, unit, least, opens, closes
        classes = range(max(0, (end - start - 1) // unit).bit_length() + 1)
        self.windows = [[k, start, deque(), deque()] for k in classes]

    def cheapest(self, b: int, best: list[float], letters: list[int], floor: int) -> float:
        """The cheapest of best[a] and the part from a to b. Parts from before floor are in mixed case."""
        low = math.inf
        for window in self.windows:
            k, _, pure, mixed = window
            first, last = max(self.start, b - (self.unit << k)), b - max(self.least, (self.unit << k - 1) + 1 if k else 1)
            while window[1] <= last:
                a = window[1]
                price = best[a] + self.opens(a)
                for queue, own in ((pure, price), (mixed, price - letters[a])):
                    while queue and queue[-1][1] >= own:
                        queue.pop()
                    queue.append((a, own))
                window[1] += 1
            for queue, own, more in ((pure, max(first, floor), 0), (mixed, first, letters[b])):
                while queue and queue[0][0] < own:
                    queue.popleft()
                if queue:
                    low = min(low, queue[0][1] + k + more)
        return low + self.closes(b)


def _runs(value: str) -> Iterator[_Run]:
    """The maximal repeats, keyboard walks and sequences of an ASCII value."""
    n, low = len(value), value.lower()
    own = [math.log2(_alphabet(c)) for c in value]
    done: list[tuple[int, int]] = []  # a repeat inside one of a shorter period costs more
    for period in range(1, 5):  # the same 1 to 4 characters again and again
        at = 0
        while at + period < n:
            end = at + period
            while end < n and low[end] == low[end - period]:
                end += 1
            if end - at >= max(3, 2 * period) and not any(a <= at and end <= z for a, z in done):
                done.append((at, end))
                yield _Run(at, end, period, max(3, 2 * period), lambda a, p=period: sum(own[a : a + p]))
            at = end - period + 1
    turns, way = [0] * (n + 1), None  # turns of direction up to each character
    for i in range(1, n):
        now = ord(low[i]) - ord(low[i - 1])
        turns[i] = turns[i - 1] + (way is not None and now != way)
        way = now
    at = 0
    while at < n - 2:  # keys that touch, at a cost for each turn
        end = at + 1
        while end < n and low[end] in NEAR.get(low[end - 1], ()):
            end += 1
        if end - at > 3:
            yield _Run(at, end, 1, 4, lambda a: math.log2(47) + 1.5 - 1.5 * turns[min(a + 1, n)], lambda b: 1.5 * turns[b - 1])
        at = max(end, at + 1)
    at = 0
    while at < n - 2:  # abc, 987
        step, end = ord(low[at + 1]) - ord(low[at]), at + 1
        while end < n and ord(low[end]) - ord(low[end - 1]) == step:
            end += 1
        if abs(step) == 1 and end - at >= 3:
            yield _Run(at, end, 1, 3, lambda a: own[a] + 1)
        at = max(end - 1, at + 1)


def _class(c: str) -> str:
    return "digit" if "0" <= c <= "9" else "lower" if "a" <= c <= "z" else "upper" if "A" <= c <= "Z" else "symbol" if c < "\x80" else "other"


def _one_case(part: str) -> bool:
    return part in (part.lower(), part.upper()) or part[1:] == part[1:].lower()


LETTERS = re.compile(r"[^\W\d_]+")
SIZES = {"digit": 10, "lower": 26, "upper": 26, "symbol": 33, "other": 200}
#: So many digits behind words of one case are a word's ending, not random characters.
ENDING = 4


def strength_bits(value: str, limit: float = math.inf) -> float:
    """guess_bits with brute-force characters charged by the union of their classes, the cheapest of all unions."""
    value, more = shortened(value)
    best, limit = text_bits(value), limit - more
    if best <= 0:
        return best
    classes = [_class(c) for c in value]
    present, n = sorted(set(classes)), len(value)
    ending = n - min(ENDING, n - len(value.rstrip("0123456789")))
    for mask in range(1 << len(present)):
        used = {c for i, c in enumerate(present) if mask >> i & 1}
        bits = math.log2(sum(SIZES[c] for c in used)) if used else math.inf
        prices = [bits if c in used else math.inf for c in classes]
        if used == {"lower"}:
            for i, c in enumerate(classes):
                if i >= ending:
                    prices[i] = math.log2(10)
                elif c == "upper" and classes[i + 1 : i + 3] == ["lower"] * 2 and (not i or classes[i - 1] != "upper"):
                    prices[i] = bits + 1  # a word's capital
        best = min(best, guess_bits(value, prices, min(limit, best)))
    return best + more


#: Units of a repeat that are kept of longer ones, and such repeats.
UNITS = 512
LONG = re.compile(r"(?s)(.{1,4}?)\1{%d,}" % UNITS)


def shortened(value: str) -> tuple[str, float]:
    """value with very long repeats cut to UNITS units, and the bits that their numbers of units take more."""
    more = 0.0

    def cut(m: re.Match[str]) -> str:
        nonlocal more
        more += math.log2(len(m[0]) / len(m[1]) / UNITS)
        return m[1] * UNITS

    return LONG.sub(cut, value), more


def guess_bits(value: str, prices: list[float] | None = None, limit: float = math.inf) -> float:
    """log2 of the guesses that the cheapest segmentation of value takes; infinite if that is limit or more.

    prices: the bits of each character in brute force; those of its own class if not given. With
    prices, a part in mixed case costs a bit for each letter.
    """
    cased = prices is not None
    prices = [math.log2(_alphabet(c)) for c in value] if prices is None else prices
    n, low, rank = len(value), value.lower(), ranks()
    plain = low.translate(LEET)
    fits = len(low) == n
    letters = [0]
    for c in value:
        letters.append(letters[-1] + (cased and c.isalpha()))
    runs = sorted(_runs(value), key=lambda r: r.start) if value.isascii() else []
    reach, active, coming = max(longest(), max(DATES)), [], 0
    spelled = {m.end(): (m.start(), bits) for m in LETTERS.finditer(value) if (bits := word_bits(m[0])) < math.inf}
    far = [0] * (n + 1)  # where runs end that a place is in
    for r in runs:
        far[r.start] = max(far[r.start], r.end)
    far = list(accumulate(far, max))
    best, upper, lower, horizon = [0.0], -1, -1, max(reach, far[0])
    for b in range(1, n + 1):
        while coming < len(runs) and runs[coming].start < b:
            active.append(runs[coming])
            coming += 1
        active = [r for r in active if r.end >= b]
        c = value[b - 1]
        upper, lower = b - 1 if c.isupper() else upper, b - 1 if c.islower() else lower
        floor = min(upper, lower + 1) if cased else -1  # a part from there on is in one case, or has a capital first
        least = best[b - 1] + prices[b - 1]
        if b in spelled:
            a, bits = spelled[b]
            least = min(least, best[a] + bits + 1)
        inside = any(r.start <= b - reach and r.end > b for r in active)  # a repeat or walk all around: its own parts cost less
        for a in () if inside else range(max(0, b - reach), b - 2):
            if best[a] >= least:
                continue
            bits = math.inf
            if fits and (found := min((r for r in (rank.get(low[a:b]), rank.get(plain[a:b])) if r), default=0)):
                word = plain[a:b] if rank.get(plain[a:b]) == found else low[a:b]
                bits = math.log2(found + 1) + sum(x != y for x, y in zip(value[a:b], word, strict=True))
            if b - a in DATES and DATE.fullmatch(value, a, b):
                bits = min(bits, math.log2(365 * 120) if b - a > 4 else math.log2(120))
            if b - a == 3 and value.isascii() and low[b - 1] in NEAR.get(low[b - 2], ()) and low[b - 2] in NEAR.get(low[a], ()) and _straight(low[a:b]):
                turn = ord(low[b - 1]) - ord(low[b - 2]) != ord(low[b - 2]) - ord(low[a])
                bits = min(bits, math.log2(47 * 3) + 1.5 * (1 + turn))  # other three keys touch by chance too often
            if bits < math.inf:
                least = min(least, best[a] + bits + (letters[b] - letters[a] if a < floor else 0) + 1)  # one bit for where a part ends
        for run in active:
            least = min(least, run.cheapest(b, best, letters, floor) + 1)
        best.append(least)
        if least < limit:
            horizon = max(horizon, b + reach, far[b])
        elif b >= horizon:
            return math.inf
    return best[n] if best[n] < limit else math.inf


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the patterns' matches."""
    low, raw = text.lower(), text.encode(errors="surrogatepass")
    found = []
    if any(k in low for k in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if b"h" * 32 in raw.translate(HEX_MAP):
        found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return found


def _urls(text: str) -> Iterator[re.Match[str]]:
    """Matches of USER behind each scheme's "://"."""
    at = text.find("://")
    while at >= 0:
        if SCHEME.search(text, max(0, at - 40), at) and (m := USER.match(text, at + 3)):
            yield m
        at = text.find("://", at + 3)


def spans(text: str, min_bits: float = MIN_BITS) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """Base spans and all spans as (start, kind, end), by start and then by kind as KINDS lists them."""
    key = lambda x: (x[0], KINDS.index(x[1]), x[2])
    base, low = sorted(base_spans(text), key=key), text.lower()
    added = set()
    if any(k in low for k in HINTS):
        seen = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) < 8]
        seen += [m.span(m.lastindex) for m in CONTEXT.finditer(text)]
        seen += [m.span(1) for m in _urls(text)]
        for a, b in seen:
            if m := STOPS.search(text, a, b):
                b = m.start()
            while b > a and text[b - 1] in ".,;:!?)]}":
                b -= 1
            if b - a >= 6:
                added.add((a, "guess", b))
    covered, kept = 0, []
    for x in sorted([*base, *added], key=lambda x: (x[0], -x[2], KINDS.index(x[1]))):
        if x[1] == "guess" and (x[2] <= covered or strength_bits(text[x[0] : x[2]], min_bits) < min_bits):
            continue
        covered = max(covered, x[2])
        if x[1] == "guess":
            kept.append(x)
    return base, sorted([*base, *kept], key=key)


def joined(found: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in found)


def scan(docs: DataFrame, min_bits: float = MIN_BITS) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans) of every document."""
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"]

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            rows = []
            for text in batch.column(1):
                base, found = spans(text.as_py() or "", min_bits)
                counts = [sum(x[1] == k for x in found) for k in KINDS]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(found)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64() if i < 4 else pa.string()) for i, c in enumerate(cols))], names)

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")


def redacted_text(text: str | None, mark: str = "[SECRET]", min_bits: float = MIN_BITS) -> str | None:
    """text with each stretch that spans cover replaced by mark; null stays null."""
    if not text:
        return text
    out, at = [], 0
    for a, _, b in spans(text, min_bits)[1]:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, mark: str = "[SECRET]", min_bits: float = MIN_BITS) -> DataFrame:
    """docs with its secrets replaced in text; n_chars, where it is there, follows the new text."""
    schema = docs.schema

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            old = batch.column("text").to_pylist()
            new = [redacted_text(x, mark, min_bits) for x in old]
            i = batch.schema.get_field_index("text")
            out = batch.set_column(i, batch.schema.field(i), pa.array(new, batch.schema.field(i).type))
            if "n_chars" in batch.schema.names:
                i = batch.schema.get_field_index("n_chars")
                counts = [n if a == b else len(b) for a, b, n in zip(old, new, batch.column(i).to_pylist(), strict=True)]
                out = out.set_column(i, batch.schema.field(i), pa.array(counts, batch.schema.field(i).type))
            yield out

    return docs.mapInArrow(run, schema)
