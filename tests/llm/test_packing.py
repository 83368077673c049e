import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from seqloom.llm import packing
from seqloom.llm.queries import QUERIES

TOK = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


def whole(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizer():
    texts = [None, "", "  \n", "Don't STOP, it's 1234 o'clock!!", "É é é   x y \u0085 z\x1fq", "İstanbul ΣΑΣ ½ ² Ⅷ ß_ẞ", "a<|endoftext|>B <|ENDOFTEXT|> <|startoftext|>", "東京 😀😀 ‍ x", "'s 's's 'LL", "﻿a \x00b", "Ł̧ 가 ᄀ ᅡ"]
    for text, ids in zip(texts, packing.token_ids(pa.array(texts)), strict=True):
        assert ids.tolist() == whole(text), text


def test_ids_of_odd_strings():
    rng = random.Random(6)
    letters = ["İ", "ı", "I", "a", "Z", "é", "e\u0301", "\u0301", "ß", "Σ", "中", "가", "ᄀ", "ᅡ", "ª", "Ⅷ", "½", "²", "٣", "\u200d", "\ufeff", "😀", "\U0002ebf0", "\u1c89"]
    marks = list(packing.MARKS) + list("'_/<|>&%\x00\x1c\x1f\x7f") + ["\u0307", "\u0327", "—", "…", "'s", "'LL", "<|endoftext|>", "0", "7"]
    blanks = [" ", "\n", "\t", "\x0b", "\x85", "\u00a0", "\u3000", "\u2028"]
    texts = ["İ-", "TARİHİ.", "İLİ,", "İ", "(İ)"]
    texts += ["".join(rng.choice(letters if (x := rng.random()) < 0.55 else marks if x < 0.9 else blanks) for _ in range(rng.randint(1, 12))) for _ in range(100_000)]
    want = [e.ids for e in TOK.encode_batch(texts, add_special_tokens=False)]
    for at in range(0, len(texts), 500):
        for i, ids in enumerate(packing.token_ids(pa.array(texts[at : at + 500])), at):
            assert ids.tolist() == want[i], repr(texts[i])


def test_long_words_are_not_kept():
    text = "中" * 3000 + " word"
    assert next(packing.token_ids(pa.array([text, "x"]).slice(0, 1))).tolist() == whole(text)
    assert max(map(len, packing.words_of(packing.TOKENIZER).known)) <= packing.KEPT_LETTERS


def test_words_are_learnt_once_whatever_their_case_and_marks():
    own = packing.words_of(packing.TOKENIZER)
    own.known.clear()
    stems = ["linden", "maple", "érable", "липа"]
    texts = [f"{a}{w}{b}" for w in stems for a in ("", "(", "#", "7") for b in ("", ",", "%%%", ".&&&", "-oak", "@12.org")]
    texts += [t.title() for t in texts if t.isascii()]
    for text, ids in zip(texts, packing.token_ids(pa.array(texts)), strict=True):
        assert ids.tolist() == whole(text), text
    assert len(own.known) == len(stems) + len({"oak", "org", "1", "2", "7", "(", "#", ",", "%%%", ".&&&", "-", "@", "."})


def test_letters_of_two_bytes_and_what_stands_beside_them():
    chars = [chr(c) for c in range(0x80, 0x800)]
    texts = [f"A{c}.{d}b {c}{d}, -{c}-{d}' {c}'S <{d}" for c, d in zip(chars, random.Random(4).sample(chars, len(chars)), strict=True)]
    got = list(packing.token_ids(pa.array(["x", *texts, None]).slice(1, len(texts))))
    for text, ids, e in zip(texts, got, TOK.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == e.ids, repr(text)


def test_fullest_is_optimal():
    rng = random.Random(2)
    for _ in range(200):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(0, 9))]
        room = rng.randint(1, 70)
        best = max(s for n in range(len(lengths) + 1) for c in itertools.combinations(lengths, n) if (s := sum(c)) <= room)
        used = packing.fullest(Counter(lengths), room)
        assert sum(used) == best and not Counter(used) - Counter(lengths)


def packed_well(rows, texts, capacity=packing.CAPACITY):
    """texts: (doc_id, text). Checks each piece, and that bins are gapless and full where they can be."""
    want = []
    for doc, text in texts:
        ids = np.array([*whole(text), 1], "<u4")
        want += [(doc, i, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity])) for i, s in enumerate(range(0, len(ids), capacity))]
    assert sorted([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows], key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins), math.ceil(sum(w[3] for w in want) / capacity)


def test_small_tables(spark, docs):
    rng = random.Random(3)
    texts = [(i, "word " * rng.randint(0, 30)) for i in range(300)] + [(1, None), (1, ""), (1, ""), (None, "x y"), (500, "many " * 999)]
    rows = packing.pack(docs(texts).selectExpr("*", "lang AS part", "lang AS length").repartition(7), capacity=32).collect()
    n, least = packed_well(rows, texts, 32)
    assert n <= least * 1.05 + 1
    assert all(zlib.crc32(np.array(r["ids"], "<u4")) == r["ids_crc32"] for r in rows)
    assert packing.pack(docs([])).collect() == []


def test_query(spark):
    d = "/root/testdata/sf0.001"
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    n, least = packed_well(QUERIES["op8_pack"](spark, d).collect(), texts)
    assert n <= least + 1
