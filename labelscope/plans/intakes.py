"""Readers, manifests and label intake over the driver's tables (inventory A, J). Events are the answers, customers the requests."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from labelscope.plans.binding import query
from labelscope.sources import readers as R
from labelscope.sources.shared import read_table, shared_dir
from labelscope.streaming import intake as J
from labelscope.streaming import stateful as ST

_REQUESTS = "req AS (SELECT DISTINCT user_id AS id FROM events WHERE user_id % 7 <> 0)"
_SPLIT = f"""{_REQUESTS}, r AS (SELECT event_id AS response_id, user_id AS id, event_type AS value, event_type <> 'error' AS ok FROM events), f AS (SELECT id, min(response_id) AS first FROM r WHERE ok AND id IN (SELECT id FROM req) GROUP BY 1),
s AS (SELECT r.*, CASE WHEN r.id NOT IN (SELECT id FROM req) THEN 'stray' WHEN NOT ok THEN 'invalid' WHEN response_id = first THEN 'accepted' ELSE 'duplicate' END AS status FROM r LEFT JOIN f USING (id))"""


def _responses(spark, d):
    e = read_table(spark, d, "events")
    return e.select(F.col("event_id").alias("response_id"), F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("value"), F.col("value").alias("usd"))


def _requests(spark, d):
    return read_table(spark, d, "events").where("user_id % 7 <> 0").select(F.col("user_id").alias("id")).distinct()


@query("""SELECT event_type, count(*) AS rows, CAST(count_if(coalesce(props, '') = '') AS BIGINT) AS empty_props FROM events GROUP BY 1""", posts=False)
def a11_table_manifest(spark, d):
    return R.table_manifest(read_table(spark, d, "events"), "event_type", ["props"])


@query("""WITH c AS (SELECT event_type, string_agg(event_id || ',' || user_id || chr(10), '' ORDER BY event_id) AS body, count(*) AS rows, CAST(count_if(coalesce(props, '') = '') AS BIGINT) AS empty_props FROM events GROUP BY 1),
r AS (SELECT *, list_transform(range(0, greatest(strlen(body), 1), 1000), lambda i: sha256(substring(body, i + 1, 1000))) AS parts FROM c)
SELECT event_type, CAST(strlen(body) AS BIGINT) AS bytes, CAST(len(parts) AS BIGINT) AS ranges, sha256(unhex(array_to_string(parts, ''))) AS sha256, rows, empty_props FROM r""", posts=False)
def a11_file_hashes(spark, d):
    """Events written as a text file for each type, the files hashed by ranges of 1,000 bytes, beside the rows and emptied fields."""
    root = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    e = read_table(spark, d, "events")
    lines = e.select("event_type", "event_id", F.concat_ws(",", "event_id", "user_id").alias("value"))
    lines.repartition("event_type").sortWithinPartitions("event_type", "event_id").select("event_type", "value").write.partitionBy("event_type").text(root)
    hashed = R.tree_hashes(spark, f"{root}/*/*.txt", 1000).withColumn("event_type", F.regexp_extract("path", "event_type=([^/]*)", 1)).drop("path")
    return hashed.join(R.table_manifest(e, "event_type", ["props"]), "event_type")


@query("SELECT 'orders' AS name, CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS total, count(*) AS n FROM orders", posts=False)
def a7_a10_publish(spark, d):
    root = f"{shared_dir(spark)}/published-{uuid.uuid4().hex}"
    orders = read_table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    for version in ("001", "002"):
        R.publish(orders if version == "002" else orders.where("o_orderkey % 2 = 0"), root, "orders", version)
    return R.published(spark, root, "orders").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n")).select(F.lit("orders").alias("name"), "total", "n")


@query("SELECT c_custkey, c_mktsegment, round(c_acctbal, 2) AS c_acctbal FROM customer", posts=False)
def a4_a7_table_csv(spark, d):
    """Customers written as CSV parts and read back with their schema."""
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    table = read_table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.round("c_acctbal", 2).alias("c_acctbal"))
    R.write_table(table, path, format="csv")
    return R.read_table_csv(spark, path, table.schema)


@query("SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS family, toxic = 1 AS toxic FROM labels WHERE quality IS NOT NULL", posts=False)
def a5_label_csv(spark, d):
    """Labels written as a filled sheet, with blanks around values and words for flags, and read back."""
    path = f"{shared_dir(spark)}/sheet-{uuid.uuid4().hex}"
    sheet = read_table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("quality") == 1, " good ").when(F.col("quality") == 0, "bad").otherwise(" ").alias("family"), F.when(F.col("toxic") == 1, "YES").otherwise("no").alias("toxic"))
    R.write_table(sheet, path, format="csv")
    return R.read_label_csv(spark, path, sheet.schema, "family", ["toxic"])


@query("SELECT 'rows' AS part, count(*) AS n FROM events WHERE event_type <> 'error' AND user_id % 5 <> 0 UNION ALL SELECT 'bad', count(*) FROM events WHERE event_type = 'error' OR user_id % 5 = 0", posts=False)
def a3_labels_tolerant(spark, d):
    """Events as lines of JSON, errors cut off in the middle and some without an id: rows and bad lines are told apart."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    line = F.to_json(F.struct(F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("id"), F.col("event_type").alias("family")))
    read_table(spark, d, "events").select(F.when(F.col("event_type") == "error", F.lit('{"id": 1, "fam')).otherwise(line).alias("value")).write.text(path)
    rows, bad = R.read_labels_tolerant(spark, path, StructType([StructField("id", LongType()), StructField("family", StringType())]))
    return rows.agg(F.count("*").alias("n")).select(F.lit("rows").alias("part"), "n").unionByName(bad.agg(F.count("*").alias("n")).select(F.lit("bad").alias("part"), "n"))


@query("SELECT CAST(ts AS DATE)::VARCHAR AS at, event_id AS id, event_type AS family FROM events", posts=False)
def a1_read_feed(spark, d):
    """Events written as feed documents, one a line, each with its meta and cards, and read back."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    path = f"{shared_dir(spark)}/feeds-{uuid.uuid4().hex}"
    each = read_table(spark, d, "events").select(F.col("ts").cast("date").cast("string").alias("at"), F.col("event_id").alias("id"), F.col("event_type").alias("family"))
    each.select(F.to_json(F.struct(F.struct("at").alias("meta"), F.array(F.struct("id", "family", "at")).alias("cards"))).alias("value")).write.text(path)
    card = StructType([StructField("id", LongType()), StructField("family", StringType()), StructField("at", StringType())])
    meta, cards = R.read_feed(spark, path, StructType([StructField("at", StringType())]), card, lines=True)
    return cards.join(meta.distinct(), "at").select("at", "id", "family")


@query("SELECT unnest(['x_n', 'x_users']) AS key, unnest([count(*), count(DISTINCT user_id)])::DOUBLE AS value FROM events", posts=False)
def a8_metrics(spark, d):
    return R.metrics(read_table(spark, d, "events").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users")), "x_")


@query("SELECT user_id AS id, arg_max(event_type, event_id) AS value FROM events GROUP BY 1", posts=False)
def a2_a6_label_batches(spark, d):
    """Events written as JSON batches of users and days, read back with the last file and overrides winning."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    root = f"{shared_dir(spark)}/batches-{uuid.uuid4().hex}"
    last = read_table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("value")).select(F.col("user_id").alias("id"), "value")
    last.where("id % 2 = 0").write.json(f"{root}/a")
    last.select("id", F.when(F.col("id") % 2 == 0, F.col("value")).otherwise("x").alias("value")).write.json(f"{root}/b")
    schema = StructType([StructField("id", LongType()), StructField("value", StringType())])
    return R.read_label_batches(spark, [f"{root}/a", f"{root}/b"], schema, last.where("id % 2 = 1"))


@query(f"WITH {_SPLIT} SELECT response_id, status FROM s", posts=False)
def j2_d14_intake_split(spark, d):
    return J.split(_responses(spark, d), _requests(spark, d), F.col("value") != "error").select("response_id", "status")


@query(f"WITH {_SPLIT} SELECT status, count(*) AS n FROM s GROUP BY 1", posts=False)
def j2_a9_intake_stream(spark, d):
    """The same split as a stream over the event files, its stored tables counted."""
    root = f"{shared_dir(spark)}/intake-{uuid.uuid4().hex}"
    source = spark.readStream.schema(read_table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    responses = source.select(F.col("event_id").alias("response_id"), F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("value"), F.col("value").alias("usd"))
    ST.intake(responses, _requests(spark, d), root, f"{root}/checkpoint", valid=F.col("value") != "error").awaitTermination()
    return J.stored(spark, root, "labels").unionByName(J.stored(spark, root, "quarantine")).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {_SPLIT} SELECT id FROM req WHERE id NOT IN (SELECT id FROM s WHERE status = 'accepted')", posts=False)
def j2_missing(spark, d):
    requests = _requests(spark, d)
    return J.missing(requests, J.split(_responses(spark, d), requests, F.col("value") != "error").where("status = 'accepted'"))


@query("""WITH a AS (SELECT user_id AS id, least(count(*), 4) AS attempt FROM events WHERE event_type = 'error' GROUP BY 1), ok AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 20)
SELECT id, attempt, CASE WHEN attempt < 3 THEN 'retry' ELSE 'error' END AS next FROM a WHERE id NOT IN (SELECT user_id FROM ok) AND id % 10 <> 3""", posts=False)
def j3_j6_requeue(spark, d):
    e = read_table(spark, d, "events").withColumnRenamed("user_id", "id")
    attempts = e.where("event_type = 'error'").groupBy("id").agg(F.least(F.count("*"), F.lit(4)).alias("attempt"))
    errors = e.select("id", F.when(F.col("id") % 10 == 3, "stopped by content-filter").otherwise("timeout").alias("error"))
    return J.requeue(attempts, e.where("event_type = 'purchase' AND value > 20"), J.refusals(errors))


#: A user's first event asks (but for strays), large purchases answer, errors of some users refuse; a day's patience, three rounds.
_ROUNDS = """WITH e AS (SELECT user_id AS id, ts AS tm, CASE WHEN event_id = min(event_id) OVER (PARTITION BY user_id) THEN CASE WHEN user_id % 7 <> 0 THEN 'request' ELSE 'other' END
  WHEN event_type = 'purchase' AND value > 20 THEN 'answered' WHEN event_type = 'error' AND user_id % 3 = 0 THEN 'refused' ELSE 'other' END AS kind FROM events),
r AS (SELECT id, min(tm) AS t0 FROM e WHERE kind = 'request' GROUP BY 1), w AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR AS mark FROM events),
f AS (SELECT id, kind, tm FROM (SELECT e.*, row_number() OVER (PARTITION BY id ORDER BY tm, kind DESC) AS k FROM e JOIN r USING (id) WHERE kind IN ('answered', 'refused') AND tm >= t0) WHERE k = 1),
p AS (SELECT id, k, t0 + INTERVAL 1 DAY * k AS due FROM r, unnest([1, 2, 3]) AS u(k)),
gone AS (SELECT p.id, k, due FROM p LEFT JOIN f USING (id) CROSS JOIN w WHERE coalesce(f.tm >= due, true) AND (coalesce(f.tm >= due, false) OR due < mark)),
o AS (SELECT id, due AS tm, CASE WHEN k = 3 THEN 'error' ELSE 'retry' END AS outcome, least(k + 1, 3) AS attempt FROM gone
  UNION ALL SELECT f.id, f.tm, kind, 1 + (SELECT count(*) FROM p WHERE p.id = f.id AND p.due <= f.tm) FROM f JOIN r USING (id) WHERE f.tm < t0 + INTERVAL 3 DAY)"""


def _in_order(spark, d, parts, name, columns):
    """Events as files of one part each, written one after another, so that a stream takes them in that order."""
    root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    e = read_table(spark, d, "events")
    for i, part in enumerate(parts(e)):
        part.select(*columns).coalesce(1).write.parquet(f"{root}/in/part={i}")
    return root, spark.readStream.schema(e.select(*columns).schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in/part=*")


@query(f"{_ROUNDS} SELECT id, CAST(tm AS VARCHAR) AS at, outcome, CAST(attempt AS INTEGER) AS attempt FROM o", posts=False)
def j3_j6_rounds(spark, d):
    """Requests over three rounds as a stream: retries and outcomes, each with its time and attempt."""
    e = read_table(spark, d, "events")
    asks = e.groupBy("user_id").agg(F.min("event_id").alias("_first"))
    cuts = e.approxQuantile("event_id", [1 / 3, 2 / 3], 0.01)
    ranges = lambda x: [x.where(F.col("event_id") <= cuts[0]), x.where((F.col("event_id") > cuts[0]) & (F.col("event_id") <= cuts[1])), x.where(F.col("event_id") > cuts[1])]
    root, source = _in_order(spark, d, ranges, "rounds", ["event_id", "user_id", "event_type", "value", "ts"])
    met = source.join(asks, "user_id")
    ask = F.when(F.col("user_id") % 7 != 0, "request").otherwise("other")
    kind = F.when(F.col("event_id") == F.col("_first"), ask).when((F.col("event_type") == "purchase") & (F.col("value") > 20), "answered").when((F.col("event_type") == "error") & (F.col("user_id") % 3 == 0), "refused").otherwise("other")
    out = ST.request_rounds(met.select(F.col("user_id").alias("id"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("at")), 86400)
    out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema("id long, at timestamp, outcome string, attempt int").parquet(f"{root}/out")
    return found.withColumn("at", F.col("at").cast("timestamp_ntz").cast("string"))


@query("""WITH c AS (SELECT event_id, coalesce(sum(value) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events)
SELECT event_id, before < 0.4 * (SELECT sum(value) FROM events) AS within FROM c""", posts=False)
def j4_budget_cut(spark, d):
    e = read_table(spark, d, "events")
    cap = e.agg(F.sum("value")).first()[0] or 0.0
    return ST.within_budget(e.select("event_id", "ts", "value"), 0.0, 0.4 * cap, "value", ("ts", "event_id")).select("event_id", "within")


@query("""WITH e AS (SELECT *, event_id % 4 AS part, date_trunc('hour', ts) + INTERVAL 1 HOUR AS ends FROM events),
m AS (SELECT part, max(max(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 10 MINUTE AS mark FROM e GROUP BY 1)
SELECT event_id, coalesce(ends <= mark, false) AS late FROM e JOIN m USING (part)""", posts=False)
def j7_late_rows(spark, d):
    """Events that come in four batches out of order: which are in time and which go to quarantine."""
    root, source = _in_order(spark, d, lambda x: [x.where(F.col("event_id") % 4 == i) for i in range(4)], "late", ["event_id", "ts"])
    ST.split_late(source, root, f"{root}/checkpoint", "ts").awaitTermination()
    stored = lambda name: spark.read.schema("event_id long, ts timestamp_ntz, batch long").parquet(f"{root}/{name}")
    return stored("on_time").select("event_id", F.lit(False).alias("late")).unionByName(stored("late").select("event_id", F.lit(True).alias("late")))


@query("SELECT round(sum(value), 6) AS spent, sum(value) >= 1000 AS stop FROM events", posts=False)
def j4_budget_guard(spark, d):
    return J.budget_guard(read_table(spark, d, "events"), 1000.0, "value")


@query("SELECT event_id, CASE WHEN event_type = 'click' AND value > 5 THEN round(value, 6) END AS value, event_type = 'click' AND NOT (value > 5) AS requeue FROM events", posts=False)
def j5_dependent_field(spark, d):
    e = read_table(spark, d, "events").select("event_id", "event_type", F.when(F.col("value") > 5, F.col("value")).alias("value"))
    return J.dependent_field(e, "event_type", "click", "value").select("event_id", "value", "requeue")


_LEDGER = "SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS start, event_type AS model, count(*) AS calls, CAST(count_if(event_type = 'error') AS BIGINT) AS failed, round(sum(value), 6) AS cost, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1, 2"


@query(_LEDGER, posts=False)
def j7_j8_usage_ledger(spark, d):
    e = read_table(spark, d, "events").withColumn("failed", F.col("event_type") == "error")
    return J.usage_ledger(e, "ts", "event_type", "value", "value").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))
