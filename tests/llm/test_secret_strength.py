import random

from seqloom.llm import secret_scan as s

LETTERS = "abcdefghijklmnopqrstuvwxyz"
MIXED = LETTERS + LETTERS.upper() + "0123456789"


def guessed(text):
    return [text[a:b] for a, k, b in s.spans(text)[1] if k == "guess"]


def test_short_random_values_are_reported():
    for text, value in [
        ("pwd: xK9mQ2vBz", "xK9mQ2vBz"),
        ("postgres://app:Zq7Lw9XcT@db", "Zq7Lw9XcT"),
        ("password: p@9$K!z2", "p@9$K!z2"),
        ("the passphrase is xK9mQ2vB now", "xK9mQ2vB"),
    ]:
        assert guessed(text) == [value], text
        assert s.redacted_text(text) == text.replace(value, "[SECRET]")


def test_most_random_values_of_eight_characters_are_reported():
    rng = random.Random(8)
    for signs, least in [(MIXED, 0.9), (MIXED + "!#$%&*+-_=?^~", 0.95)]:
        values = ["".join(rng.choice(signs) for _ in range(7)) + rng.choice(MIXED) for _ in range(1000)]
        assert sum(s.strength_bits(v) >= s.MIN_BITS for v in values) >= least * len(values)


def test_words_dates_and_walks_are_not_reported():
    for v in "Password1 P@ssw0rd99 Summer2024! Welcome1! letmein2020 Dragon2023 qwertyuiop1234 asdfghjkl1 Zxcvbnm123 1990-05-17 20240131 aaaaaaaaaa abcabcabc required Required Required1 required12 important".split():
        assert guessed(f"pwd: {v}") == [], v


def test_never_below_the_price_by_own_class():
    rng = random.Random(9)
    for _ in range(300):
        v = "".join(rng.choice(MIXED + "!-é") for _ in range(rng.randint(1, 14)))
        assert s.strength_bits(v) >= min(s.text_bits(v), s.guess_bits(v)) - 1e-9
