"""The queries of this subpackage, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, common, decontaminate, infill, language_id, license_scan, mixing, packing, quotes, secret_scan, simhash, surrogates, url_filter, variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    ids = F.coalesce(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), F.array().cast("array<string>"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
ORACLE_SQL["op4_decontaminate"] = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rn, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bl AS (SELECT item_id, w, least(len(w), 10) AS l FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, l, array_to_string(list_slice(w, s, s + l - 1), ' ') AS span
       FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM bl)),
dw AS (SELECT rn, l, s, array_to_string(list_slice(w, s, s + l - 1), ' ') AS span
       FROM (SELECT rn, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, (SELECT DISTINCT l FROM bl) WHERE len(w) >= l)),
m AS (SELECT rn, s, l, item_id FROM dw JOIN iw USING (l, span)),
h AS (SELECT rn, count(DISTINCT p) AS n FROM (SELECT rn, unnest(range(s, s + l)) AS p FROM m) GROUP BY rn),
i AS (SELECT rn, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rn, item_id::VARCHAR AS id FROM m) GROUP BY rn)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rn) LEFT JOIN i USING (rn)
"""


@query
def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"), keep_ids=False)


@query
def op6_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded files, what is read back from them, and their resampled PCM as the column pcm: it is stored with the result."""
    return audio.decode(audio.encode(common.table(spark, sf_dir, "documents")))


@query
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(common.table(spark, sf_dir, "documents"))


@query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(common.table(spark, sf_dir, "documents"))


@query
def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(common.table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _fits(rule: str) -> str:
    host, path = rule.split("/", 1)
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}'))"


_RULES = sorted(url_filter.RULES, key=lambda r: (-len(r[0]), r[0]))
ORACLE_SQL["op1_urls"] = f"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{common.UPPER}', '{common.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
j AS (SELECT *, CASE {" ".join(f"WHEN {_fits(r)} THEN '{r}'" for r, _ in _RULES)} END AS rule FROM p)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in _RULES)}
  WHEN {" OR ".join(_fits(b) for b in url_filter.BLOCKED)} THEN 'block' ELSE 'allow' END AS verdict
FROM j
"""


@query
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: source/doc_id div 256/doc_id div 16/doc_id.

    A document that ends with a license statement stands for a license file, one directory up.
    """
    found = license_scan.detected(common.table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    given = F.col("own_passage").isNotNull() & F.endswith(F.rtrim("text"), F.rtrim("own_passage"))
    found = found.withColumn("is_license_file", given).drop("text")
    level = lambda n: F.expr(f"doc_id div {n}").cast("string")
    path = F.concat_ws("/", "source", level(256), F.when(~F.col("is_license_file"), level(16)), F.col("doc_id").cast("string"))
    return license_scan.inherited(found.withColumn("path", path)).select("doc_id", "path", "license", "basis", "score", "license_dir")


_SPLIT = "[^a-z0-9+]+"
ORACLE_SQL["op2_licenses"] = f"""
WITH tpl(i, name, text) AS (VALUES {", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(license_scan.TEMPLATES))}),
tw AS (SELECT i, name, w, count(*) AS tf FROM (SELECT i, name, unnest(string_split_regex(lower(text), '{_SPLIT}')) AS w FROM tpl) WHERE w <> '' GROUP BY ALL),
idf AS (SELECT w, ln((1 + {len(license_scan.TEMPLATES)}) / (1 + count(*))) + 1 AS idf FROM tw GROUP BY w),
tv AS (SELECT i, name, w, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY i)) AS x FROM tw JOIN idf USING (w)),
p AS (SELECT DISTINCT doc_id, passage FROM (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '([.;!?])\\s+', '\\1' || chr(10), 'g'), '[\\r\\n]+')) AS passage FROM documents
  UNION ALL SELECT doc_id, unnest(string_split_regex(text, '{license_scan.BLOCK}')) FROM documents)),
pw AS (SELECT doc_id, passage, w, count(*) AS tf FROM (SELECT doc_id, passage, unnest(string_split_regex(lower(passage), '{_SPLIT}')) AS w FROM p) WHERE w <> '' GROUP BY ALL),
pn AS (SELECT doc_id, passage, sqrt(sum(pow(tf * coalesce(idf, ln(1 + {len(license_scan.TEMPLATES)}) + 1), 2))) AS norm FROM pw LEFT JOIN idf USING (w) GROUP BY ALL),
sc AS (SELECT doc_id, passage, name, round(max(d) / any_value(norm), 6) AS score FROM
  (SELECT doc_id, passage, i, name, sum(tf * idf * x) AS d FROM pw JOIN idf USING (w) JOIN tv USING (w) GROUP BY ALL) JOIN pn USING (doc_id, passage) GROUP BY doc_id, passage, name),
own AS (SELECT doc_id, passage, name, score FROM sc WHERE score >= {license_scan.THRESHOLD} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, name, passage DESC) = 1),
f AS (SELECT d.doc_id, o.name, o.score, coalesce(ends_with(rtrim(d.text), rtrim(o.passage)), false) AS lic, source || '/' || (doc_id // 256) AS up, '/' || (doc_id // 16) AS low FROM documents d LEFT JOIN own o USING (doc_id)),
g AS (SELECT *, up || CASE WHEN lic THEN '' ELSE low END AS dir FROM f),
lf AS (SELECT dir, name, score FROM g WHERE lic QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, dir || '/' || doc_id) = 1),
n AS (SELECT g.*, coalesce(a.dir, b.dir) AS from_dir, coalesce(a.name, b.name) AS from_name, coalesce(a.score, b.score) AS from_score FROM g LEFT JOIN lf a ON a.dir = g.dir LEFT JOIN lf b ON b.dir = g.up)
SELECT doc_id, dir || '/' || doc_id AS path, coalesce(name, from_name) AS license,
  CASE WHEN name IS NOT NULL THEN 'own' WHEN from_name IS NOT NULL THEN 'inherited' ELSE 'none' END AS basis,
  CASE WHEN name IS NOT NULL THEN score ELSE from_score END AS score, CASE WHEN name IS NULL THEN from_dir END AS license_dir
FROM n
"""


@query
def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replaced(common.table(spark, sf_dir, "documents"), "op5").select("doc_id", "text", "n_replaced")


@query
def op9_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(common.table(spark, sf_dir, "conversations"))


@query
def op9_derived_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9_quotes where each message quotes the one before it: the table has no quotes of its own."""
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    earlier = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("_before"))
    reply = F.concat(F.lit("> "), F.replace(F.col("_before"), F.lit("\n"), F.lit("\n> ")), F.lit("\n\n"), F.col("text"))
    rows = rows.join(earlier, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", F.coalesce(reply, "text").alias("text"))
    return quotes.conversations(rows)


_NORM = "trim(regexp_replace(lower({x}), '[\\s>]+', ' ', 'g'))"
_MARK = "'^[ \\t]{0,3}(?:>[ \\t]?){1,1000}'"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_QUOTES = f"""
m AS (SELECT row_number() OVER () AS rn, conv_id, turn, role, text FROM messages),
l AS (SELECT rn, i, l, CASE WHEN regexp_matches(l, {_MARK}) THEN length(regexp_replace(regexp_extract(l, {_MARK}), '[^>]', '', 'g')) ELSE 0 END AS level,
    CASE WHEN regexp_matches(l, {_MARK}) THEN substr(l, length(regexp_extract(l, {_MARK})) + 1) ELSE l END AS rest
  FROM (SELECT rn, unnest(string_split_regex(text, '\\r?\\n')) AS l, generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) AS i FROM m)),
starts AS (SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER (PARTITION BY rn ORDER BY i) THEN 1 ELSE 0 END AS new FROM l),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY rn ORDER BY i) AS nth FROM starts),
bare AS (SELECT rn, string_agg(rest, chr(10) ORDER BY i) AS t FROM l WHERE level = 0 GROUP BY rn),
own AS (SELECT m.*, CASE WHEN m.text IS NULL THEN NULL WHEN NOT contains(m.text, '>') THEN m.text ELSE rtrim(regexp_replace(coalesce(bare.t, ''), '^\\s*\\n', ''), {_SPACE}) END AS plain FROM m LEFT JOIN bare USING (rn)),
passage AS (SELECT rn, nth, any_value(level) AS level, string_agg(rest, chr(10) ORDER BY i) AS t FROM grouped GROUP BY rn, nth
  UNION ALL SELECT rn, -1, 0, plain FROM own WHERE plain IS NOT NULL),
part AS (SELECT rn, nth, level, 0 AS kind, t FROM passage UNION ALL SELECT rn, nth, level, 1, unnest(string_split_regex(t, '\\n\\s*\\n')) FROM passage
  UNION ALL SELECT rn, nth, level, 2, unnest(string_split(t, chr(10))) FROM passage),
unit AS (SELECT conv_id, turn, nth, level, kind, {_NORM.format(x="t")} AS said FROM part JOIN m USING (rn) WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
says AS (SELECT DISTINCT conv_id, turn, said FROM unit WHERE level = 0 AND said <> ''),
asks AS (SELECT conv_id, turn, nth, level, kind, -length(said) AS size, said FROM unit WHERE level > 0 AND said <> ''),
near AS (SELECT a.conv_id, a.turn, a.level, a.nth, a.kind, a.size, a.said, max(s.turn) AS source FROM asks a JOIN says s ON s.conv_id = a.conv_id AND s.said = a.said AND s.turn < a.turn GROUP BY ALL),
first AS (SELECT said, conv_id AS conv, turn AS t FROM says QUALIFY row_number() OVER (PARTITION BY said ORDER BY conv_id, turn) = 1),
away AS (SELECT a.conv_id, a.turn, a.level, a.nth, a.kind, a.size, f.conv, f.t FROM asks a JOIN first f USING (said) WHERE f.conv <> a.conv_id),
n AS (SELECT conv_id, turn, source FROM near QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, nth, kind, size, source) = 1),
w AS (SELECT conv_id, turn, conv, t FROM away QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, nth, kind, size, conv, t) = 1),
link AS (SELECT q.conv_id, q.turn, q.k AS n_quotes, n.source AS parent_turn, CASE WHEN n.source IS NULL THEN w.conv END AS source_conv, CASE WHEN n.source IS NULL THEN w.t END AS source_turn
  FROM (SELECT conv_id, turn, count(*) FILTER (kind = 0) AS k FROM asks GROUP BY ALL) q LEFT JOIN n USING (conv_id, turn) LEFT JOIN w USING (conv_id, turn)),
node AS (SELECT conv_id, turn, parent_turn FROM link WHERE parent_turn IS NOT NULL),
path(conv_id, turn, thread_turn, p) AS (SELECT DISTINCT conv_id, parent_turn, parent_turn, [parent_turn] FROM node WHERE NOT EXISTS (SELECT 1 FROM node x WHERE x.conv_id = node.conv_id AND x.turn = node.parent_turn)
  UNION ALL SELECT node.conv_id, node.turn, thread_turn, list_append(p, node.turn) FROM path JOIN node ON node.conv_id = path.conv_id AND node.parent_turn = path.turn),
thread AS (SELECT conv_id, turn, thread_turn, len(p) - 1 AS depth, row_number() OVER (PARTITION BY conv_id, thread_turn ORDER BY p) - 1 AS place FROM path)
SELECT own.conv_id, own.turn, role, plain AS text, coalesce(n_quotes, 0)::BIGINT AS n_quotes, parent_turn, source_conv, source_turn,
  coalesce(thread_turn, own.turn) AS thread_turn, coalesce(depth, 0)::BIGINT AS depth, coalesce(place, 0)::BIGINT AS place
FROM own LEFT JOIN link USING (conv_id, turn) LEFT JOIN thread USING (conv_id, turn)
"""
ORACLE_SQL["op9_quotes"] = f"WITH RECURSIVE messages AS (SELECT conv_id, turn, role, text FROM conversations), {_QUOTES}"
ORACLE_SQL["op9_derived_replies"] = f"""
WITH RECURSIVE messages AS (SELECT a.conv_id, a.turn, a.role, coalesce('> ' || replace(b.text, chr(10), chr(10) || '> ') || chr(10) || chr(10) || a.text, a.text) AS text
  FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn + 1 = a.turn), {_QUOTES}"""


@query
def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.grouped(variants.counted(variants.runs_with_slips(common.table(spark, sf_dir, "documents"))))


ORACLE_SQL["op11_variants"] = f"""
WITH RECURSIVE tab AS (SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
run AS (SELECT d, w, count(*) AS n FROM (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(text, '{common.UPPER}', '{common.LOWER}'), '[a-zÀ-ÿ]+')) AS w FROM documents) WHERE length(w) >= {variants.LETTERS} GROUP BY d, w),
raw AS (SELECT d, w, n, hex(encode(d || ':' || w)) AS x FROM run),
crc AS (SELECT w, n, xor(4294967295, list_reduce(list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295)) AS h FROM raw, tab),
occ AS (SELECT CASE WHEN h % {variants.SLIPS} = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS w, n FROM crc),
word AS (SELECT w, sum(n)::BIGINT AS n FROM occ WHERE length(w) >= {variants.LETTERS} GROUP BY w HAVING sum(n) >= {variants.OCCURRENCES}),
cut AS (SELECT w, i, substr(w, 1, i) || substr(w, i + 2) AS less FROM (SELECT w, unnest(range(0, length(w))) AS i FROM word)),
pair AS (SELECT a.w AS a, b.w AS b FROM cut a JOIN cut b ON a.less = b.less AND a.i = b.i AND a.w <> b.w
  UNION SELECT cut.w, word.w FROM cut JOIN word ON cut.less = word.w UNION SELECT word.w, cut.w FROM cut JOIN word ON cut.less = word.w),
best AS (SELECT a, count(*) AS n_near, min(struct_pack(m := -word.n, o := b)) AS x FROM pair JOIN word ON word.w = b GROUP BY a),
form AS (SELECT w, n, coalesce(n_near, 0) AS n_near, CASE WHEN -x.m >= n * {variants.FACTOR} THEN x.o END AS form, CASE WHEN -x.m >= n * {variants.FACTOR} THEN -x.m END AS form_n FROM word LEFT JOIN best ON a = w),
up(w, r, form) AS (SELECT w, w, form FROM form UNION ALL SELECT up.w, form.w, form.form FROM up JOIN form ON form.w = up.form)
SELECT form.w AS word, form.form, r AS root, n, n_near, form_n::BIGINT AS form_n FROM form JOIN up ON up.w = form.w AND up.form IS NULL
"""


@query
def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infill.transformed(common.table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


_P, _S, _M = infill.MARKERS
ORACLE_SQL["op12_infill"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{infill.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS u, {", ".join(f"('0x' || substr(x, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))} FROM d),
k AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS k1, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS k2 FROM h),
f AS (SELECT doc_id, text, n, CASE WHEN text = '' OR contains(text, '{_P}') OR contains(text, '{_S}') OR contains(text, '{_M}') OR h3 % 100 >= {infill.RATE} THEN 'plain' WHEN h4 % 100 < {infill.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(list_slice(u, 1, k1), '') AS p, array_to_string(list_slice(u, k1 + 1, k2), '') AS m, array_to_string(list_slice(u, k2 + 1, n), '') AS s FROM k)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{_P}' || p || '{_S}' || s || '{_M}' || m ELSE '{_S}' || s || '{_P}' || p || '{_M}' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM f
"""


@query
def op13_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
