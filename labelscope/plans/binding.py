"""How the operators are bound to the driver's tables: items, raters and the query registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.sources.shared import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

EVIDENCE = ("click", "error", "purchase", "signup", "view")
LANGS = ("de", "en", "es", "fr")
CLAIM = r"[0-9]+(?:[.][0-9]+)?"

#: Items: documents, each with the event of five times its id. Doubles are rounded at the edges.
POSTS = """posts AS (
  SELECT d.doc_id AS id, d.source AS author, d.lang, d.text, split_part(d.text, chr(10), 1) AS title, d.n_chars,
    e.ts, CAST(e.ts AS DATE) AS day, CAST(floor(e.value * 100 + 0.5) AS BIGINT) AS views,
    CAST(regexp_extract(e.props, '([0-9]+)', 1) AS BIGINT) AS likes, d.source AS family, e.event_type AS evidence,
    CASE WHEN len(regexp_extract_all(d.text, '[0-9]+(?:[.][0-9]+)?')) > 0 THEN regexp_extract_all(d.text, '[0-9]+(?:[.][0-9]+)?') END AS chips,
    md5(d.text) AS url
  FROM documents d JOIN events e ON e.event_id = d.doc_id * 5
)"""

#: Raters: the given label, a rule on the length, and the other given label turned round.
RATERS = f"""{POSTS}, raters AS (
  SELECT p.id, p.lang, p.evidence, p.family, p.views, p.day, CASE WHEN l.quality = 1 THEN 'good' WHEN l.quality = 0 THEN 'bad' END AS r1,
    CASE WHEN p.n_chars >= 200 THEN 'good' ELSE 'bad' END AS r2, CASE WHEN l.toxic = 0 THEN 'good' WHEN l.toxic = 1 THEN 'bad' END AS r3,
    (p.likes + 1) / 100.0::DOUBLE AS prob
  FROM posts p LEFT JOIN labels l ON l.doc_id = p.id
)"""


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per item. The text column is read only by plans that use it."""
    d, e = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "events")
    found = F.regexp_extract_all("text", F.lit(CLAIM), F.lit(0))
    return d.join(e, e["event_id"] == d["doc_id"] * 5).select(
        F.col("doc_id").alias("id"), F.col("source").alias("author"), "lang", "text", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), "n_chars",
        "ts", F.col("ts").cast("date").alias("day"), F.floor(F.col("value") * 100 + 0.5).cast("bigint").alias("views"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("likes"), F.col("source").alias("family"), F.col("event_type").alias("evidence"),
        F.when(F.size(found) > 0, found).alias("chips"), F.md5("text").alias("url"),
    )


def raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per item with three raters' labels, null where a rater has none, and a stated probability."""
    p, labels = posts(spark, sf_dir), read_table(spark, sf_dir, "labels")
    met = p.join(labels, p["id"] == labels["doc_id"], "left")
    return met.select(
        "id", "lang", "evidence", "family", "views", "day", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").alias("r1"),
        F.when(F.col("n_chars") >= 200, "good").otherwise("bad").alias("r2"), F.when(F.col("toxic") == 0, "good").when(F.col("toxic") == 1, "bad").alias("r3"),
        ((F.col("likes") + 1) / F.lit(100.0)).alias("prob"),
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as tables are written."""
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes))


def query(sql: str | None = None, posts: bool = True, raters: bool = False):
    """Registers a query under its function's name, with its oracle."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            head = RATERS if raters else POSTS if posts else None
            recursive = "RECURSIVE " if "/*recursive*/" in sql else ""
            text = sql.strip()
            ORACLES[f.__name__] = (f"WITH {recursive}{head}" + (", " + text[5:] if text.upper().startswith("WITH ") else "\n" + text)) if head else text
        return f

    return register
