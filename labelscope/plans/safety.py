"""Duplicates, leakage and redaction bound to the driver's tables (inventory G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelscope.operators import dedupe as D
from labelscope.operators import leak as L
from labelscope.operators import leak_scan as S
from labelscope.operators.components import connected_components
from labelscope.plans.binding import posts, query
from labelscope.sources.shared import read_table

_TOKENS = r"list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(title), '[^\p{L}\p{N}\p{M}_\s]', ' ', 'g'), '\s+'), lambda w: w <> '')))"
_GRAMS = r"""list_distinct(list_transform(range(1, length(c) - 1), lambda i: substring(c, i, 3)))"""
_JACCARD = "len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b})))"


@query(f"WITH t AS (SELECT id, {_TOKENS} AS tokens FROM posts) SELECT id, len(tokens)::INT AS n, array_to_string(tokens, ' ') AS tokens FROM t")
def g1_title_tokens(spark, d):
    t = posts(spark, d).select("id", F.array_sort(D.title_tokens("title")).alias("tokens"))
    return t.select("id", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("tokens"))


@query(rf"WITH t AS (SELECT id, trim(regexp_replace(regexp_replace(lower(text), 'https?://\S+', '', 'g'), '\s+', ' ', 'g')) AS c FROM posts) SELECT id, len({_GRAMS})::INT AS n FROM t")
def g2_text_grams(spark, d):
    return posts(spark, d).select("id", F.size(D.text_grams("text")).alias("n"))


_SETS = f"s AS (SELECT id, {_TOKENS} AS t, chips, url, array_to_string(list_sort(chips), chr(1)) AS bag, author, views, likes FROM posts)"
_URL = "u AS (SELECT min(id) OVER (PARTITION BY url) AS src, id AS dst FROM posts), eu AS (SELECT src, dst FROM u WHERE src < dst)"
_CHIP = f"ec AS (SELECT a.id AS src, b.id AS dst FROM s a JOIN s b ON a.bag = b.bag AND a.id < b.id WHERE a.bag IS NOT NULL AND {_JACCARD.format(a='a.t', b='b.t')} >= 0.8)"


@query(f"WITH {_URL} SELECT src, dst FROM eu")
def g4_url_edges(spark, d):
    return D.url_edges(posts(spark, d)).select("src", "dst")


_CLOSE = """both_ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), reach AS (SELECT a, a AS b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY 1)"""


@query(f"WITH /*recursive*/ {_SETS}, {_CHIP}, edges AS (SELECT src, dst FROM ec), {_CLOSE} SELECT node, component FROM comp")
def g3_g5_chip_components(spark, d):
    return connected_components(D.chip_edges(posts(spark, d)))


_TEXT = rf"""c AS MATERIALIZED (SELECT id, {_TOKENS} AS t, trim(regexp_replace(regexp_replace(lower(text), 'https?://\S+', '', 'g'), '\s+', ' ', 'g')) AS c FROM posts WHERE chips IS NULL), g AS MATERIALIZED (SELECT id, t, {_GRAMS} AS g FROM c),
cand AS MATERIALIZED (SELECT a.id AS src, b.id AS dst, a.g AS ga, b.g AS gb FROM g a JOIN g b ON a.id < b.id AND (len(a.t) = 0 AND len(b.t) = 0 OR len(a.t) > 0 AND len(b.t) > 0 AND {_JACCARD.format(a='a.t', b='b.t')} >= 0.8)),
et AS (SELECT src, dst FROM cand WHERE len(ga) + len(gb) = 0 OR {_JACCARD.format(a='ga', b='gb')} >= 0.6)"""


@query(f"WITH /*recursive*/ {_TEXT}, edges AS (SELECT src, dst FROM et), {_CLOSE} SELECT node, component FROM comp")
def g6_g7_c10_text_components(spark, d):
    return connected_components(D.text_edges(posts(spark, d)))


#: All three rules closed together, and of each group the item that stays.
GROUPS = f"""{_SETS}, {_URL}, {_CHIP}, {_TEXT}, tagged AS (SELECT src, dst, 'url' AS rule FROM eu UNION ALL SELECT src, dst, 'chips' FROM ec UNION ALL SELECT src, dst, 'text' FROM et), edges AS (SELECT src, dst FROM tagged), {_CLOSE},
k AS (SELECT component, arg_max(id, views * 1000000 - id) AS keep, count(*) - 1 AS merged, count(DISTINCT author) AS authors, sum(views) AS v, sum(likes) AS l FROM s JOIN comp ON node = id GROUP BY 1)"""


@query(f"""WITH /*recursive*/ {GROUPS}, r AS (SELECT component, array_to_string(list_sort(list(DISTINCT rule)), '+') AS rules FROM tagged JOIN comp ON node = src GROUP BY 1)
SELECT k.component, keep, merged, rules, authors, p.views AS kept_views, CAST(v - p.views AS BIGINT) AS dropped_views, CAST(l - p.likes AS BIGINT) AS dropped_likes FROM k JOIN r USING (component) JOIN s p ON p.id = keep""")
def g8_survivors(spark, d):
    p = posts(spark, d)
    return D.survivors(p, D.all_edges(p))


@query(f"""WITH /*recursive*/ {GROUPS}, b AS (SELECT array_to_string(list_sort(chips), '|') AS bag, coalesce(component, id) AS c FROM s LEFT JOIN comp ON node = id WHERE len(chips) >= 2)
SELECT bag, count(*) AS items, count(DISTINCT b.c) - 1 AS extra FROM b GROUP BY 1 HAVING count(DISTINCT b.c) > 1""")
def g9_loose_sets(spark, d):
    p = posts(spark, d)
    return D.loose_sets(p, connected_components(D.all_edges(p)))


_QUOTES = " || ".join(f"chr({n})" for n in (8216, 8217, 8218, 8219, 8220, 8221, 8222, 8223, 8211, 8212, 8722))
_PLAIN = "repeat(chr(39), 4) || repeat(chr(34), 4) || '---'"
_NORM = r"lower(trim(regexp_replace(regexp_replace(translate(nfc_normalize({x}), " + _QUOTES + ", " + _PLAIN + r"), '[\x{{200b}}-\x{{200d}}\x{{2060}}\x{{feff}}]', '', 'g'), '\s+', ' ', 'g')))"

@query(rf"SELECT doc_id, md5({_NORM.format(x='text')}) AS digest FROM documents", posts=False)
def g10_normalise(spark, d):
    return read_table(spark, d, "documents").select("doc_id", F.md5(L.normalised("text")).alias("digest"))


#: The corpus to protect: benchmark items, their first sentences as titles. An index has text windows of 40 characters every 8 and title windows of 24 every 4.
_OWNERS = rf"own AS MATERIALIZED (SELECT item_id AS owner, {_NORM.format(x='text')} AS text, {_NORM.format(x="split_part(text, '. ', 1)")} AS title FROM benchmark)"
_OF = "SELECT DISTINCT '{kind}' AS kind, owner, substring({kind}, i, {length}) AS shingle FROM (SELECT *, unnest(list_append(range(1, length({kind}) - {length} + 2, {step}), length({kind}) - {length} + 1)) AS i FROM own WHERE length({kind}) >= {length})"
_INDEX = f"""{_OWNERS}, sh AS ({_OF.format(kind='text', length=40, step=8)} UNION ALL {_OF.format(kind='title', length=24, step=4)}),
idx AS MATERIALIZED (SELECT kind, owner, shingle FROM sh JOIN (SELECT kind, shingle FROM sh GROUP BY 1, 2 HAVING count(*) < 3) USING (kind, shingle))"""


def _owners(spark, d):
    return read_table(spark, d, "benchmark").withColumn("title", F.split_part("text", F.lit(". "), F.lit(1)))


def _files(spark, d):
    """Documents and pages as files, named by their table and key."""
    docs, pages = read_table(spark, d, "documents"), read_table(spark, d, "pages")
    named = docs.select(F.concat(F.lit("documents/"), F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string")).alias("file"), F.col("text").alias("raw"))
    return named.unionByName(pages.select(F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("file"), F.col("html").alias("raw")))


@query(f"WITH {_INDEX} SELECT kind, owner, count(*) AS n FROM idx GROUP BY 1, 2", posts=False)
def g11_g12_index(spark, d):
    return S.build_index(_owners(spark, d), "item_id", "text", "title").groupBy("kind", "owner").agg(F.count("*").alias("n"))


#: The references that the tables hold, with & as the last; JSON strings of eight characters and more, decoded where they can be.
_DECODED = "replace(replace(replace({x}, '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', chr(34))"
_DECODED = f"replace(replace(replace({_DECODED}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_UNTAGGED = "regexp_replace({x}, '<[^>]{{0,1000}}[^>]{{0,1000}}>', ' ', 'g')"
_READINGS = rf"""f AS MATERIALIZED (SELECT 'documents/' || coalesce(source, '') || '/' || doc_id AS file, text AS raw FROM documents UNION ALL SELECT 'pages/' || page_id, html FROM pages),
j AS (SELECT file, string_agg(s, chr(10) ORDER BY i) AS strings FROM (SELECT file, i, TRY(json_extract_string(x::JSON, '$')) AS s FROM (SELECT file, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM (SELECT file, regexp_extract_all(raw, '"(?:[^"\\\n]|\\.){{8,}}"') AS xs FROM f))) WHERE s IS NOT NULL GROUP BY 1),
u AS (SELECT file, raw, {_DECODED.format(x='raw')} AS plain, coalesce(strings, '') AS strings FROM f LEFT JOIN j USING (file)),
r AS (SELECT file, unnest([raw, plain, {_UNTAGGED.format(x='plain')}, replace(raw, '""', '"'), strings, {_UNTAGGED.format(x=_DECODED.format(x='strings'))}]) AS x, unnest(range(1, 7)) AS reading FROM u),
v AS MATERIALIZED (SELECT file, t, min(reading) AS reading FROM (SELECT file, {_NORM.format(x='x')} AS t, reading FROM r) GROUP BY 1, 2)"""
_HITS = f"""{_INDEX}, {_READINGS}, met AS (SELECT file, kind, owner, min({{'r': reading, 'o': strpos(t, shingle) - 1, 's': shingle}}) AS m FROM v JOIN idx ON contains(t, shingle) GROUP BY 1, 2, 3),
hits AS MATERIALIZED (SELECT file, kind, owner, ['raw', 'unescaped', 'untagged', 'quotes', 'strings', 'strings_untagged'][m.r] AS reading, CAST(m.o AS INTEGER) AS "offset", m.s AS shingle FROM met)"""


@query(f'WITH {_HITS} SELECT file, kind, owner, reading, "offset", shingle FROM hits', posts=False)
def g13_c11_scan(spark, d):
    return S.scan(_files(spark, d), "file", "raw", S.build_index(_owners(spark, d), "item_id", "text", "title"))


@query(posts=False)
def g14_views(spark, d):
    """All readings of every page; SQL has no way to decode references and strings, so the tests hold it against plain Python."""
    return read_table(spark, d, "pages").select("page_id", F.explode(L.views("html")).alias("v")).select("page_id", "v.view", F.md5("v.text").alias("digest"))


#: Which files may quote how many owners: texts, then titles; 0 is any number.
RULES = ((1, "text", "documents/src1/%", 1), (2, "text", "documents/src1%", 0), (3, "title", "documents/src2%", 1), (4, "title", "documents/src_", 0))
_RULES = ", ".join(map(str, RULES))


@query(f"""WITH {_HITS}, o AS (SELECT file, owner, bool_and(kind = 'title' OR contains(title, shingle)) AS quoted FROM hits JOIN own USING (owner) GROUP BY 1, 2),
n AS (SELECT file, count(*) FILTER (NOT quoted) AS n_text, count(*) FILTER (quoted) AS n_title FROM o GROUP BY 1), rules(position, kind, pattern, cap) AS (VALUES {_RULES}),
c AS (SELECT file, arg_min(cap, position) FILTER (kind = 'text') AS text_cap, arg_min(cap, position) FILTER (kind = 'title') AS title_cap FROM n JOIN rules ON file LIKE pattern GROUP BY 1)
SELECT file, n_text, n_title, CASE WHEN n_text > 0 AND (text_cap = 0 OR n_text <= text_cap) THEN 'text allowed' WHEN n_text > 0 THEN 'text' WHEN title_cap IS NULL THEN 'titles'
  WHEN title_cap = 0 OR n_title <= title_cap THEN 'titles allowed' ELSE 'titles over cap' END AS verdict FROM n LEFT JOIN c USING (file)""", posts=False)
def g15_leak_verdict(spark, d):
    owners = _owners(spark, d)
    hits = S.scan(_files(spark, d), "file", "raw", S.build_index(owners, "item_id", "text", "title"))
    rules = spark.createDataFrame(list(RULES), "position int, kind string, pattern string, cap int")
    return S.verdicts(hits, S.normal_titles(owners, "item_id", "title"), rules)


@query("SELECT conv_id, turn, CASE WHEN text <> '' THEN '[removed]' ELSE text END AS text FROM conversations", posts=False)
def g16_redact(spark, d):
    return L.redact(read_table(spark, d, "conversations"), {"text": "mark", "role": "drop"})


@query("SELECT role, 'text' AS field, CAST(count_if(coalesce(text, '') <> '') AS BIGINT) AS emptied FROM conversations GROUP BY 1", posts=False)
def g17_redaction_report(spark, d):
    return L.redaction_report(read_table(spark, d, "conversations"), {"text": "mark"}, "role")


@query(r"""SELECT source, unnest(['body.text', 'body.note', 'lines.text', 'gone']) AS field, unnest([CAST(count_if(text <> '') AS BIGINT), CAST(count_if(lang <> '') AS BIGINT), CAST(sum(len(list_filter(string_split(text, chr(10)), lambda x: x <> ''))) AS BIGINT), CAST(count(doc_id) AS BIGINT)]) AS emptied FROM documents GROUP BY source""", posts=False)
def g17_nested_report(spark, d):
    """Documents as nested rows: texts inside a struct, in an array of structs, and in a field that is dropped."""
    line = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("text"), F.length(x).alias("n")))
    body = F.struct("text", F.col("lang").alias("note"), F.col("doc_id").alias("n"))
    nested = read_table(spark, d, "documents").select("source", body.alias("body"), line.alias("lines"), F.col("doc_id").cast("string").alias("gone"))
    return L.redaction_report(nested, {"text": "mark", "note": "empty", "gone": "drop"}, "source")


@query(r"""WITH k AS (SELECT doc_id AS id, unnest(['email', 'ip', 'key']) AS kind, unnest([len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')), len(regexp_extract_all(text, '\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b')), len(regexp_extract_all(text, '\b(?:sk|pk|ghp|AKIA)[-_A-Za-z0-9]{12,}\b'))]) AS n FROM documents)
SELECT id, kind, n FROM k WHERE n > 0""", posts=False)
def g18_secret_scan(spark, d):
    return L.secret_scan(read_table(spark, d, "documents"), "doc_id", "text")


@query("""WITH p AS (SELECT DISTINCT text AS probe FROM benchmark WHERE text <> '') SELECT DISTINCT doc_id AS file, probe FROM documents JOIN p ON contains(text, probe) WHERE doc_id % 10 <> 0""", posts=False)
def g19_probe_search(spark, d):
    docs = read_table(spark, d, "documents")
    allowed = docs.where("doc_id % 10 = 0").select(F.col("doc_id").alias("file"))
    return L.probe_search(docs, "doc_id", "text", read_table(spark, d, "benchmark"), "text", allowed)
