"""Personal data: keyed surrogates of the same type, gender, script and format.

Entities are found by patterns. Each entity has a canonical form (the digits of a number, an
e-mail address in lower case, a part of a name), so that all its mentions, in whatever format
and document, get one surrogate and still refer to the same thing; a mention's own format is
then filled with it. The gender of a given name is what all titles before it say, so that it has
one surrogate under any title; if they differ, its surrogate has neither's ending. An address's
domain is an entity too. Surrogates are drawn from a keyed SHA-256. A surrogate that another entity
of any kind has, or that is some entity's true value, would confuse them, so it is drawn again
until none is left. Every TRIES draws an entity's room grows, by a digit, a letter, a syllable, or
a wider range of addresses, at least tenfold, so that draws succeed in the end.

Names are found behind up to three titles, of up to four words, in scripts with or without case; a hyphen or an apostrophe
parts a name and stays, and so does a single letter. The parts of a document's titled names are
replaced in all of that document, with or without a title; names that have a title nowhere in
their document are not found. A part that is an ordinary word as well (by a cased vocabulary, in which it is frequent
in lower case) stays at the beginning of a sentence, where its capital says nothing.

What is joined and checked is the table of distinct entities, not of mentions. Texts are
searched once; documents with mentions are written with them, the others are only read again.

DataFrame functions only. Nulls: a null text stays null. Equal rows are replaced alike, and empty
tables stay empty. Patterns take time in proportion to a text, also to one without blanks. Other
columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MALE = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Господин", "السيد", "श्री", "מר")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Госпожа", "السيدة", "श्रीमती", "גברת")
TITLES = (*FEMALE, *MALE, "Dr", "Prof", "Doctor", "Doktor", "Professor")


def _one_of(titles: tuple[str, ...]) -> str:
    return "(?:" + "|".join(sorted(titles, key=lambda t: (-len(t), t))) + ")\\.?[ \u00a0]"


_TITLE = r"(?<![\p{L}\p{N}])(?:" + _one_of(TITLES) + "){1,3}"
#: The titles that a mention of a name begins with.
_HEAD = "^(?:" + _one_of(TITLES) + ")+"
_NAME = r"(?:\p{Lu}[\p{L}\p{M}'’-]+|\p{IsHan}{2,4}|[\p{IsKatakana}ー]{2,}|\p{IsHangul}{2,4}|\p{IsArabic}{2,}|\p{IsHebrew}{2,}|[\p{IsDevanagari}]{2,})"
#: What parts a name.
_BORDER = "[ '’-]+"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PATTERNS = (
    r"(?:\G|(?<![\p{L}\p{N}._%+-]))[\p{L}\p{N}._%+-]++@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}",
    r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])",
    _TITLE + _NAME + r"(?: " + _NAME + r"){0,3}",
    r"(?<![0-9.])" + _OCTET + r"(?:\." + _OCTET + r"){3}(?![0-9]|\.[0-9])",
    r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    r"\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])",
    r"(?<![0-9])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    r"(?<![0-9-])[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9-])",
    r"(?<![0-9])[0-9]{13,19}(?![0-9])",
    r"(?<![0-9-])[0-9]{3}-[0-9]{4}(?![0-9-])",
)
PATTERN = "|".join(PATTERNS)
#: Draws of an entity before its surrogate is let grow longer than its own form.
TRIES = 12
#: A text without any of these has no entity.
HINT = r"[0-9@]|" + _TITLE

#: Syllables of the surrogates of names, by script, and the endings of given names by gender.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga ge ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve vo za ze".split(),
    "cyrillic": "ба бе бо ва ве во га да де до ка ке ко ла ле ло ма ме мо на не но па ра ре ро са се со та те то".split(),
    "greek": "βα βε βο γα δα δε κα κε κο λα λε λο μα με μο να νε νο πα ρα ρε ρο σα σε σο τα τε το".split(),
    "han": "安 白 成 达 方 国 海 和 华 家 建 江 杰 金 景 君 立 林 明 宁 平 启 清 荣 山 世 书 泰 文 武 晓 新 兴 修 雅 永 宇 元 泽 志".split(),
    "katakana": "ア イ ウ エ オ カ キ ク ケ コ サ シ ス セ ソ タ チ ツ テ ト ナ ニ ネ ノ ハ ヒ マ ミ モ ヤ ユ ヨ ラ リ ル レ ロ ワ".split(),
    "hangul": "가 강 경 규 기 나 다 대 도 동 라 명 미 민 보 상 서 선 성 세 소 수 승 시 아 연 영 우 원 유 은 인 재 정 주 지 진 태 하 현".split(),
    "arabic": "با بو تا جا حا دا را زا سا شا صا طا عا فا قا كا لا ما نا ها وا يا بي تي جي دي ري سي في كي لي مي ني".split(),
    "hebrew": "בא בו גא גי דא דו הא ור זא חא טל יא כא לא לי מא מי נא ני סא עא פא צא קא רא רי שא תא".split(),
    "devanagari": "का की गा चा जा टा ता दा ना नी पा बा भा मा मी या रा री ला ली वा वी शा सा सी हा".split(),
}
#: The scripts but latin, and how a letter of theirs is told.
SCRIPTS = {"cyrillic": "Cyrillic", "greek": "Greek", "han": "Han", "katakana": "Katakana", "hangul": "Hangul", "arabic": "Arabic", "hebrew": "Hebrew", "devanagari": "Devanagari"}
ENDINGS = {
    ("latin", "f"): "ria", ("latin", "m"): "rton", ("latin", "n"): "lin", ("cyrillic", "f"): "рина", ("cyrillic", "m"): "слав", ("cyrillic", "n"): "нко",
    ("greek", "f"): "ρία", ("greek", "m"): "ρος", ("greek", "n"): "νης",
}


def mentions(text: Column) -> Column:
    """All mentions in a text, in order."""
    none = F.array().cast("array<string>")
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(none)


def kind_of(value: Column) -> Column:
    return (
        F.when(value.contains("@"), "email")
        .when(value.rlike(r"^[A-Z]{2}[0-9]{2}"), "iban")
        .when(value.rlike(r"^\p{L}"), "person")
        .when(value.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "ip")
        .when(value.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(value.startswith("+"), "phone")
        .when(F.length(F.regexp_replace(value, "[^0-9]", "")) >= 13, "card")
        .otherwise("phone")
    )


def _named(value: Column) -> Column:
    """The parts of a mention of a name that are replaced."""
    return F.filter(F.split(F.regexp_replace(value, _HEAD, ""), _BORDER), lambda x: F.length(x) > 1)


def _parts(value: Column) -> Column:
    """What of a mention is an entity, as (kind, canon, gender) structs; a name has one for each part."""
    kind = kind_of(value)
    title = F.regexp_extract(value, _HEAD, 0)
    gender = F.when(title.rlike("(?:^|[ \u00a0])" + _one_of(FEMALE)), "f").when(title.rlike("(?:^|[ \u00a0])" + _one_of(MALE)), "m")
    several = F.regexp_replace(value, _HEAD, "").contains(" ")
    # the gender is that of the title, and for given names alone; a surname has none
    part = lambda x, i: F.struct(F.lit("name").alias("kind"), F.lower(x).alias("canon"), F.when(several & (i == 0), gender).alias("gender"))
    one = lambda canon: F.array(F.struct(kind.alias("kind"), canon.alias("canon"), F.lit(None).cast("string").alias("gender")))
    return (
        F.when(kind == "person", F.transform(_named(value), part))
        .when(kind == "email", one(F.lower(value)))
        .when(kind == "iban", one(F.regexp_replace(value, " ", "")))
        .when(kind == "ip", one(value))
        .otherwise(one(F.regexp_replace(value, "[^0-9]", "")))
    )


def _draw(key: str, *what: Column | str) -> Column:
    """A keyed number of 48 bits."""
    text = F.concat_ws("\x01", F.lit(key), *[F.col(w) if isinstance(w, str) else w for w in what])
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long")


def _shaped(key: str, text: Column, *what: Column | str) -> Column:
    """text with each digit and letter replaced by another of its sort."""

    def one(c: Column, i: Column) -> Column:
        n = _draw(key, *what, i.cast("string"))
        letter = lambda a: F.chr((n % 26 + ord(a)).cast("int"))
        return F.when(c.rlike("[0-9]"), (n % 10).cast("string")).when(c.rlike("[A-Z]"), letter("A")).when(c.rlike(r"\p{L}"), letter("a")).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""
    turned = F.split(F.reverse(digits), "")
    double = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    each = F.transform(turned, lambda c, i: F.when(i % 2 == 1, double(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10


def _mod97(text: Column) -> Column:
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda s, c: (s * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)


def surrogate(key: str) -> tuple[Column, Column]:
    """The surrogate of (kind, canon, gender, base) at this attempt, in canonical form, from a column shaped that
    the second column makes. base: the surrogate of an address's domain."""
    kind, canon, level = F.col("kind"), F.col("canon"), F.expr(f"attempt div {TRIES}")
    shaped = _shaped(key, canon, "kind", "canon", "attempt")
    # when draws keep failing, there may be too few values of this length: it gets longer
    steps = F.slice(F.sequence(F.lit(0), level), 2, 99)
    drawn_more = lambda i: _draw(key, "kind", "canon", "attempt", F.concat(F.lit("more"), i.cast("string")))
    digits = F.array_join(F.transform(steps, lambda i: (drawn_more(i) % 10).cast("string")), "")
    letters = F.array_join(F.transform(steps, lambda i: F.chr((drawn_more(i) % 26 + ord("a")).cast("int"))), "")
    number = F.concat(F.substring(canon, 1, 1), F.expr("substr(shaped, 2)"), digits)
    # the check digit of a card number, so that its sum is that of the number it stands for
    head = F.concat(F.substring(canon, 1, 1), F.expr("substr(shaped, 2, length(shaped) - 2)"), digits)
    card = F.concat(head, F.pmod(_luhn(canon) - _luhn(F.concat(head, F.lit("0"))), F.lit(10)).cast("string"))
    email = F.concat(F.substring_index("shaped", "@", 1), letters, F.lit("@"), F.col("base"))
    domain = F.concat(F.regexp_replace("shaped", r"\.[^.]*$", ""), letters, F.lit(".example"))
    octet = lambda i, base, span: (_draw(key, "kind", "canon", "attempt", F.lit(str(i))) % span + base).cast("string")
    private = F.regexp_extract(canon, r"^(10|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\.", 1)
    ten = F.concat_ws(".", F.lit("10"), octet(1, 0, 256), octet(2, 0, 256), octet(3, 1, 254))
    other = F.concat_ws(".", octet(0, 11, 113), octet(1, 0, 256), octet(2, 0, 256), octet(3, 1, 254))
    # its own private range, then the largest one, then numbers that no address has
    ip = F.when((level == 0) & (private != "") & (private != "10"), F.concat_ws(".", private, octet(2, 0, 256), octet(3, 1, 254)))
    ip = ip.when(level < 2, F.when(private != "", ten).otherwise(other))
    ip = ip.otherwise(F.concat_ws(".", *[F.when(level > i, octet(i, 256, 744)).otherwise(octet(i, 1, 254)) for i in (4, 3, 2, 1)]))
    body = F.concat(F.expr("substr(shaped, 5)"), digits)
    country = F.substring(canon, 1, 2)
    valid = F.lpad((98 - _mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
    right = _mod97(F.concat(F.expr("substr(canon, 5)"), F.substring(canon, 1, 4))) == 1
    iban = F.concat(country, F.when(right, valid).otherwise(F.expr("substr(shaped, 3, 2)")), body)
    script = F.coalesce(*[F.when(canon.rlike(rf"\p{{Is{x}}}"), s) for s, x in SCRIPTS.items()], F.lit("latin"))
    name = None
    for s, syllables in SYLLABLES.items():
        known = F.array(*[F.lit(x) for x in syllables])
        drawn = F.transform(F.sequence(F.lit(0), F.lit(1) + F.col("attempt") % 3 + level), lambda i: F.get(known, (_draw(key, "kind", "canon", "attempt", i.cast("string")) % len(syllables)).cast("int")))  # noqa: B023
        ending = F.element_at(F.create_map(*[F.lit(x) for (t, g), e in ENDINGS.items() if t == s for x in (g, e)]), F.col("gender"))
        made = F.concat(F.array_join(drawn, ""), F.coalesce(ending, F.lit("")))
        name = F.when(script == s, made) if name is None else name.when(script == s, made)
    made = F.when(kind == "email", email).when(kind == "domain", domain).when(kind == "ip", ip).when(kind == "iban", iban).when(kind == "card", card).when(kind == "name", name).otherwise(number)
    return made, shaped


def assigned(entities: DataFrame, key: str) -> DataFrame:
    """Distinct (kind, canon[, gender, base]) with a surrogate that no other has and that is no entity's true value.

    In each round those draw that have none yet; of equal draws the smallest (kind, canon) keeps it.
    """
    made, shaped = surrogate(key)
    missing = {"gender": F.lit("n"), "base": F.lit(None).cast("string")}
    entities = entities.withColumns({c: v for c, v in missing.items() if c not in entities.columns})
    drawn = lambda rows: common.staged(rows.withColumn("shaped", shaped).withColumn("surrogate", made).drop("shaped"), "surrogates")
    pending = drawn(entities.select("kind", "canon", "gender", "base", F.lit(0).alias("attempt")).distinct())
    taken = pending.select(F.col("canon").alias("surrogate"))
    settled: DataFrame | None = None
    while True:
        free = pending.join(taken, "surrogate", "left_anti").groupBy("surrogate").agg(F.min(F.struct("kind", "canon")).alias("first"))
        new = common.staged(free.select("first.kind", "first.canon", "surrogate"), "surrogates-settled")
        settled = new if settled is None else settled.unionByName(new)
        taken = taken.unionByName(new.select("surrogate"))
        left = pending.join(new.select("kind", "canon"), ["kind", "canon"], "left_anti")
        pending = drawn(left.withColumn("attempt", F.col("attempt") + 1))
        if pending.isEmpty():
            return settled


def _filled() -> Column:
    """A mention (value) in its own format with the surrogates of its parts (made, in order)."""
    kind, one = kind_of(F.col("value")), F.get("made", F.lit(0))
    title = F.regexp_extract("value", _HEAD, 0)
    tokens = F.regexp_extract_all(F.regexp_replace("value", _HEAD, ""), F.lit("[^ '’-]+|" + _BORDER), F.lit(0))
    own = lambda x: (F.length(x) > 1) & ~x.rlike(f"^{_BORDER}$")
    case = lambda x, made: F.when((x == F.upper(x)) & (x != F.lower(x)), F.upper(made)).otherwise(F.concat(F.upper(F.substring(made, 1, 1)), made.substr(F.lit(2), F.length(made))))

    def step(acc: Column, x: Column) -> Column:
        return F.struct(F.concat(acc["text"], F.when(own(x), case(x, F.get("made", acc["n"]))).otherwise(x)).alias("text"), (acc["n"] + own(x).cast("int")).alias("n"))

    named = F.concat(title, F.aggregate(tokens, F.struct(F.lit("").alias("text"), F.lit(0).alias("n")), step)["text"])
    marks = F.split("value", "")
    nth = lambda i, pattern: F.length(F.regexp_replace(F.array_join(F.slice(marks, 1, i + 1), ""), pattern, ""))
    rest = one.substr(nth(F.size(marks) - 1, "[^0-9]") + 1, F.length(one))
    digits = F.array_join(F.transform(marks, lambda c, i: F.when(c.rlike("[0-9]"), one.substr(nth(i, "[^0-9]"), F.lit(1))).otherwise(c)), "")
    digits = F.concat(digits, rest)
    iban = F.array_join(F.transform(marks, lambda c, i: F.when(c == " ", c).otherwise(one.substr(nth(i, " "), F.lit(1)))), "")
    email = F.when((F.col("value") == F.upper("value")) & (F.col("value") != F.lower("value")), F.upper(one)).otherwise(one)
    return F.when(kind == "person", named).when(kind == "email", email).when(kind == "iban", iban).when(kind == "ip", one).otherwise(digits)


#: A vocabulary with words in lower case and capitalised, the most frequent first: lines of a word in base64 and its rank.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: How many times the rank of a word in lower case can be that of the capitalised one, for an ordinary word.
COMMON = 4


def ordinary(spark: SparkSession, path: str = VOCABULARY) -> DataFrame:
    """(word) of words that are not much less frequent in lower case than capitalised; at most the vocabulary's size."""
    import public_tokenizers

    field = lambda n: F.split_part("value", F.lit(" "), F.lit(n))
    rows = spark.read.text(f"file://{public_tokenizers.path(path)}").select(F.unbase64(field(1)).cast("string").alias("w"), field(2).cast("int").alias("r"))
    rows = rows.filter(F.col("w").rlike(r"^ \p{L}\p{Ll}+$")).select(F.lower(F.trim("w")).alias("word"), (F.trim("w") == F.lower(F.trim("w"))).alias("low"), "r")
    best = rows.groupBy("word").agg(F.min(F.when(F.col("low"), F.col("r"))).alias("a"), F.min(F.when(~F.col("low"), F.col("r"))).alias("b"))
    return best.filter(F.col("a").isNotNull() & (F.col("b").isNull() | (F.col("a") < F.col("b") * COMMON))).select("word")


def replacements(held: DataFrame, key: str) -> DataFrame:
    """(__sl_id, __sl_filled, __sl_plain): for each row of held (__sl_id, __sl_m) a map from mention to replacement, and the parts of names that are ordinary words."""
    each = held.select("__sl_id", F.explode(F.array_distinct("__sl_m")).alias("value"))
    values = each.select("value").distinct().select("value", F.posexplode(_parts(F.col("value"))).alias("nth", "part"))
    values = common.staged(values.select("value", "nth", "part.*"), "entities")
    said = lambda g: F.max(F.coalesce(F.col("gender") == g, F.lit(False)))
    entities = values.groupBy("kind", "canon").agg(said("m").alias("m"), said("f").alias("f"))
    gender = F.when(F.col("m") & ~F.col("f"), "m").when(F.col("f") & ~F.col("m"), "f").otherwise("n")
    entities = entities.select("kind", "canon", gender.alias("gender"), F.when(F.col("kind") == "email", F.expr("substr(canon, instr(canon, '@') + 1)")).alias("domain"))
    domains = assigned(entities.filter("domain IS NOT NULL").select(F.lit("domain").alias("kind"), F.col("domain").alias("canon")), key)
    domains = domains.select(F.col("canon").alias("domain"), F.col("surrogate").alias("base"))
    given = assigned(entities.join(domains, "domain", "left").select("kind", "canon", "gender", "base"), key)
    given = values.select("value", "nth", "kind", "canon").join(given, ["kind", "canon"])
    plain = F.broadcast(ordinary(held.sparkSession).select(F.col("word").alias("canon"), F.lit(True).alias("plain")))  # a vocabulary, not the input
    given = given.join(plain, "canon", "left")
    given = given.groupBy("value").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "surrogate"))), lambda x: x["surrogate"]).alias("made"), F.collect_set(F.when(F.col("plain") & (F.col("kind") == "name"), F.col("canon"))).alias("plain"))
    given = common.staged(given.select("value", _filled().alias("filled"), "plain"), "replacements")
    return each.join(given, "value").groupBy("__sl_id").agg(F.map_from_entries(F.collect_list(F.struct("value", "filled"))).alias("__sl_filled"), F.flatten(F.collect_list("plain")).alias("__sl_plain"))


#: A text is cut into words and what is between them, and a sentence begins behind some marks.
_TOKENS = r"[\p{L}\p{M}\p{N}]++|[^\p{L}\p{M}\p{N}]++"
_BEGINS = r"(?:[.!?…\n][\"”»)]?\s*[\"“„«(]?|[\"“„«])$"


def _bare_names(filled: Column) -> Column:
    """A map from each part, in lower case, of the titled names of a document to its surrogate, in lower case."""
    names = lambda x: F.transform(_named(x), F.lower)
    people = F.filter(F.map_entries(filled), lambda e: kind_of(e["key"]) == "person")
    pairs = lambda e: F.zip_with(names(e["key"]), names(e["value"]), lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    parts = F.array_sort(F.array_distinct(F.flatten(F.transform(people, pairs))))
    # upper and lower case of a letter can differ in more than case: a part is there once
    parts = F.filter(parts, lambda x, i: (i == 0) | (F.get(parts, i - 1)["k"] != x["k"]))
    return F.map_from_entries(parts)


def _bare(gap: Column, nth: Column, names: Column, plain: Column) -> Column:
    """The tokens of the nth gap between mentions as (old, new) structs, new where names have it and it can be one here."""

    def one(token: Column, before: Column) -> Column:
        made = F.element_at(names, F.lower(token))
        first = F.concat(F.upper(F.substring(made, 1, 1)), made.substr(F.lit(2), F.length(made)))
        cased = F.when((token == F.upper(token)) & (token != F.lower(token)), F.upper(made)).otherwise(first)
        begins = ((before == "") & (nth == 0)) | before.rlike(_BEGINS)
        new = F.when(token.rlike(r"^[\p{Lu}\p{Lo}]") & (F.length(token) > 1) & ~(begins & F.array_contains(plain, F.lower(token))), cased)
        return F.struct(token.alias("old"), new.alias("new"))

    tokens = F.regexp_extract_all(gap, F.lit(_TOKENS), F.lit(0))
    # the last place has what stands before nothing: it gives nulls
    return F.zip_with(tokens, F.concat(F.array(F.lit("")), tokens), one)


def replaced(docs: DataFrame, key: str) -> DataFrame:
    """docs with its entities replaced, n_chars (where it is there) of the new text, and n_replaced."""
    has = F.coalesce(F.col("text").rlike(HINT) & F.col("text").rlike(PATTERN), F.lit(False))
    held = docs.filter(has).withColumns({"__sl_id": F.monotonically_increasing_id(), "__sl_m": mentions(F.col("text")), "__sl_gaps": F.split("text", PATTERN)})
    held = common.staged(held, "mentions")
    clean = docs.filter(~has).withColumn("n_replaced", F.lit(0).cast("long"))
    held = held.join(replacements(held, key), "__sl_id")
    held = held.withColumn("__sl_names", _bare_names(F.col("__sl_filled")))
    cut = F.transform("__sl_gaps", lambda g, i: _bare(g, i, F.col("__sl_names"), F.col("__sl_plain")))
    held = held.withColumn("__sl_cut", F.when(F.size("__sl_names") > 0, cut))
    gaps = F.transform("__sl_cut", lambda c: F.array_join(F.transform(c, lambda t: F.coalesce(t["new"], t["old"])), ""))
    held = held.withColumn("__sl_gaps", F.coalesce(gaps, F.col("__sl_gaps")))
    bare = F.coalesce(F.size(F.filter(F.flatten("__sl_cut"), lambda t: t["new"].isNotNull())), F.lit(0))
    bare = F.when(F.col("__sl_cut").isNull(), 0).otherwise(bare)
    whole = F.transform("__sl_gaps", lambda g, i: F.concat(g, F.coalesce(F.element_at("__sl_filled", F.get("__sl_m", i)), F.lit(""))))
    held = held.withColumns({"text": F.array_join(whole, ""), "n_replaced": (F.size("__sl_m") + bare).cast("long")})
    if "n_chars" in docs.columns:
        held = held.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean.unionByName(held.select(*clean.columns))
