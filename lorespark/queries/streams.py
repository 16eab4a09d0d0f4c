"""Queries that drain a stream and return what it left."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions import vectors as V
from lorespark.operators import orchestrate as O
from lorespark.queries.base import query
from lorespark.queries.records import BY_RUNTIME, TELEMETRY, WANTED, fsm_sql
from lorespark.session import checkpoint_folder, table
from lorespark.sources import adapters as A
from lorespark.streaming import events as E
from lorespark.streaming import feed, sessions
from lorespark.streaming import jobs as S


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read_stream(spark, f"{sf_dir}/events.parquet")


@query(f"{TELEMETRY} {BY_RUNTIME}")
def stream_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _events(spark, sf_dir).select(F.col("event_type").alias("runtime"), F.round(F.col("value") * 100).cast("long").alias("latency_ms"), F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("tokens"))
    out = S.drain(S.running_telemetry(records), S.overwrite, "complete")
    return out.select("runtime", "n", "tokens", F.round("mean_latency_ms", 6).alias("mean_latency_ms"), F.round("tokens_per_sec", 6).alias("tokens_per_sec"))


@query(f"WITH {A.NODES_SQL} SELECT DISTINCT 'node:' || id AS id, label AS title, confidence FROM nodes WHERE id IN (SELECT 'customer-' || user_id FROM events)")
def stream_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _events(spark, sf_dir).select(F.concat(F.lit("customer-"), F.col("user_id").cast("string")).alias("node_id"))
    nodes = A.nodes(spark, sf_dir)
    out = S.drain(changes, lambda df, n, out: S.append(S.reindex(df, nodes), n, out))
    return out.select("id", "title", "confidence").distinct()


_HOUR = 3_600_000
_GUARD_SQL = f"""WITH RECURSIVE e AS (SELECT event_id AS id, event_id // 3 AS nonce, epoch_ms(ts) AS ts_ms, epoch_ms(ts) + (event_id % 5) * {5 * _HOUR} AS now_ms FROM events),
m AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY nonce ORDER BY now_ms, id) AS k FROM e),
s AS (SELECT DISTINCT nonce, 0::BIGINT AS k, NULL::BIGINT AS accepted, NULL::BIGINT AS id, NULL::VARCHAR AS verdict FROM m UNION ALL
SELECT nonce, k, CASE WHEN v = 'accepted' THEN ts_ms ELSE accepted END, id, v FROM (SELECT m.*, s.accepted, CASE WHEN m.id % 11 = 0 THEN 'bad_signature' WHEN abs(now_ms - ts_ms) > {12 * _HOUR} THEN 'expired' WHEN s.accepted IS NOT NULL AND now_ms - s.accepted <= {12 * _HOUR} THEN 'replayed' ELSE 'accepted' END AS v FROM s JOIN m ON m.nonce = s.nonce AND m.k = s.k + 1))
SELECT id, nonce, verdict FROM s WHERE k > 0"""


@query(_GUARD_SQL)
def stream_replay_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed messages in six batches, three of each nonce, some of them in later batches; every eleventh signature is forged."""
    key = "a shared secret"
    events = table(spark, sf_dir, "events")
    sent = F.unix_millis(F.col("ts").cast("timestamp"))
    messages = events.select(
        F.col("event_id").alias("id"), F.lit("agent").alias("source"), F.col("user_id").alias("destination"), F.col("event_type").alias("msg_type"), F.lit("high").alias("priority"), F.col("props").alias("body"),
        F.lit(None).cast("string").alias("graph_id"), F.lit(None).cast("string").alias("memory_ref"), F.floor(F.col("event_id") / 3).cast("long").alias("nonce"), sent.alias("ts_ms"), (sent + (F.col("event_id") % 5) * 5 * _HOUR).alias("now_ms"),
    )
    messages = S.in_batches(messages, "now_ms", 6)
    text = O.canonical_message(F.col("nonce"), F.col("ts_ms"))
    signature = F.when(F.col("id") % 11 == 0, F.lit("forged")).otherwise(V.hmac_sha256(key)(text))
    signed = messages.withColumn("signature", signature).withColumn("signed", V.signature_ok(key)(text, F.col("signature")))
    verdicts = S.replay_verdicts(signed.select("id", "nonce", "ts_ms", "now_ms", "signed"), 12 * _HOUR)
    return S.drain(verdicts, S.append).select("id", "nonce", "verdict")


@query(fsm_sql())
def stream_task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The life cycles of task_fsm_replay as a stream: the state after each task's last event."""
    wanted = F.element_at(F.array(*[F.lit(w) for w in WANTED]), (F.col("event_id") % 7 + 1).cast("int"))
    events = _events(spark, sf_dir).select(F.col("user_id").cast("long").alias("task"), F.col("event_id").cast("long").alias("seq"), wanted.alias("wanted"))
    out = S.drain(S.state_changes(events), S.append)
    return out.groupBy("task").agg(F.max_by(F.struct("state", "attempts", "rejected"), "seq").alias("s")).select("task", "s.*")


@query(f"""WITH {A.NODES_SQL}, {A.EDGES_SQL}, ends AS (SELECT DISTINCT unnest([src, dst]) AS node FROM edges WHERE dst LIKE 'region-%')
SELECT CASE WHEN kind = 'nation' THEN replace(id, 'nation-', 'atlas-') ELSE 'node:' || id END AS id, id AS node, label AS title, confidence,
  (CASE WHEN id IN (SELECT node FROM ends) THEN 3 WHEN confidence // 2 <> confidence THEN 2 ELSE 1 END)::BIGINT AS version FROM nodes WHERE kind <> 'region'""")
def stream_graph_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions of the whole graph as a feed: all nodes and edges, then other confidences, then no regions; nations have documents already."""
    nodes, edges = A.nodes(spark, sf_dir), A.edges(spark, sf_dir)
    folder = f"{checkpoint_folder(spark).rstrip('/')}/feed-{uuid.uuid4().hex}"
    first = nodes.withColumn("confidence", F.floor(F.col("confidence") / 2).cast("int"))
    last = nodes.where("kind <> 'region'"), edges.where("dst not like 'region-%'")
    none = nodes.where("false"), edges.where("false")
    feed.publish(feed.node_changes(none[0], first).unionByName(feed.edge_changes(none[1], edges)), folder, 1)
    feed.publish(feed.node_changes(first, nodes), folder, 2)
    feed.publish(feed.node_changes(nodes, last[0]).unionByName(feed.edge_changes(edges, last[1])), folder, 3)
    known = nodes.where("kind = 'nation'").select(F.regexp_replace("id", "^nation-", "atlas-").alias("id"), F.col("id").alias("node"))
    return feed.follow_to(feed.follow(spark, folder, 3), known)


@query("""WITH r AS (SELECT conv_id::VARCHAR AS session, turn, CASE WHEN role = 'assistant' THEN 'execution' ELSE 'reflection' END AS doc_type,
  CASE WHEN role = 'assistant' THEN 'answer on ' || role ELSE 'reflection for ' || turn END AS title, coalesce(text, '') AS body,
  CASE WHEN role <> 'assistant' THEN length(coalesce(text, '')) % 101 WHEN length(coalesce(text, '')) % 2 = 0 THEN 100 ELSE 0 END::INTEGER AS confidence FROM conversations WHERE turn IS NOT NULL),
s AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn, doc_type, title, body) AS seq FROM r)
SELECT session || '-' || seq AS id, session, seq, doc_type, title, sha256(body) AS body_sha256, confidence FROM s WHERE turn > 0""")
def stream_session_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session's turns as executions (the assistant's) and reflections, in four runs of one stream; the store knows the first turns' numbers."""
    turns = table(spark, sf_dir, "conversations").where("turn is not null").select(
        F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("at"), "role", F.coalesce("text", F.lit("")).alias("text"), F.col("turn").alias("task"),
    )
    known = turns.where("at <= 0").groupBy("session").agg(F.count("*").alias("seq"))
    rest = turns.where("at > 0")
    folder = f"{checkpoint_folder(spark).rstrip('/')}/sessions-{uuid.uuid4().hex}"
    ends = rest.approxQuantile("at", [0.25, 0.5, 0.75], 0.01)  # three numbers
    log = None
    for low, high in zip([0, *ends], [*ends, float("inf")], strict=True):
        rest.where((F.col("at") > low) & (F.col("at") <= high)).write.mode("append").parquet(f"{folder}/in")
        came = spark.readStream.schema(rest.schema).parquet(f"{folder}/in")
        size = F.length("text")
        runs = came.where("role = 'assistant'").select("session", "at", "task", F.lit("answer").alias("capability"), F.col("role").alias("runtime"), F.col("text").alias("output"), (size % 2 == 0).alias("verified"), F.lit(None).cast("string").alias("agent"))
        notes = came.where("role <> 'assistant'").select("session", "at", "task", F.col("text").alias("hint"), (size % 101).alias("score"))
        log = sessions.record(sessions.executions(runs).unionByName(sessions.reflections(notes)), f"{folder}/session", known)
    return log.select("id", "session", "seq", "doc_type", "title", F.sha2(F.col("body").cast("binary"), 256).alias("body_sha256"), "confidence")


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a time zone's timestamps and their milliseconds."""
    own = table(spark, sf_dir, "events").where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    return own.select("event_id", "user_id", "event_type", "value", "ts", F.unix_millis("ts").alias("at"))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS t_us, value, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS opens FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY t_us ROWS UNBOUNDED PRECEDING) AS k FROM e),
m AS (SELECT user_id, min(t_us) AS first_us, max(t_us) + 21600000000 AS until_us, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k)
SELECT * FROM m WHERE until_us <= ((SELECT max(epoch_us(ts)) // 1000 FROM events) - 3600000) * 1000""")
def stream_user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' sessions, parted by six hours without an event, over eight batches; those that the watermark has closed."""
    came = S.in_batches(_timed(spark, sf_dir), "at", 8)
    out = S.drain(E.user_sessions(came, "6 hours", "1 hour"), S.append)
    return out.select("user_id", F.unix_micros("first").alias("first_us"), F.unix_micros("until").alias("until_us"), "n", F.round("total", 4).alias("total"))


@query("""SELECT p.user_id, p.event_id AS purchase, c.event_id AS click, epoch_us(p.ts) - epoch_us(c.ts) AS after_us FROM events p JOIN events c USING (user_id)
WHERE p.event_type = 'purchase' AND c.event_type = 'click' AND c.ts <= p.ts AND c.ts >= p.ts - INTERVAL 1 DAY""")
def stream_clicks_before_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams in six batches each: every purchase with its user's clicks of the day before it."""
    events = _timed(spark, sf_dir)
    ends = events.approxQuantile("at", [k / 6 for k in range(1, 6)], 0.01)  # the same for both
    bought = S.in_batches(events.where("event_type = 'purchase'"), "at", 6, ends).select("user_id", F.col("event_id").alias("effect_id"), F.col("ts").alias("effect_ts"))
    clicked = S.in_batches(events.where("event_type = 'click'"), "at", 6, ends).select("user_id", F.col("event_id").alias("cause_id"), F.col("ts").alias("cause_ts"))
    out = S.drain(E.within(clicked, bought, 86_400), S.append)
    return out.select("user_id", F.col("effect_id").alias("purchase"), F.col("cause_id").alias("click"), (F.unix_micros("effect_ts") - F.unix_micros("cause_ts")).alias("after_us"))


@query(f"""WITH e AS (SELECT *, epoch_us(ts) // 1000 AS t_ms, epoch_us(ts) // 1000 + CASE WHEN event_id % 7 = 0 THEN {30 * _HOUR} ELSE 0 END AS came FROM events WHERE ts IS NOT NULL),
b AS (SELECT min(came) AS low, max(came) - min(came) AS width FROM e), p AS (SELECT e.*, (SELECT count(*) FROM range(1, 9) r(k) WHERE came > low + (width * k) // 9) AS part FROM e, b),
m AS (SELECT part, max(max(t_ms)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM p GROUP BY part)
SELECT event_type, epoch_ms(date_trunc('hour', ts)) AS hour_ms, coalesce(t_ms < mark - {2 * _HOUR}, false) AS late, count(*) AS n, round(sum(value), 4) AS total FROM p JOIN m USING (part) GROUP BY ALL""")
def stream_late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts by type and lateness, of nine batches; every seventh event comes thirty hours late, and is counted as late where its batch makes it so."""
    events = _timed(spark, sf_dir).withColumn("came", F.col("at") + F.when(F.col("event_id") % 7 == 0, 30 * _HOUR).otherwise(0))
    low, high = events.agg(F.min("came"), F.max("came")).first()
    ends = [low + (high - low) * k // 9 for k in range(1, 9)] if low is not None else None
    folder = f"{checkpoint_folder(spark).rstrip('/')}/lateness-{uuid.uuid4().hex}"
    judged = E.with_lateness(S.in_batches(events, "came", 9, ends), folder, 2 * _HOUR)
    counts = [S.windowed_events(judged.where(F.col("late") == late)).withColumn("late", F.lit(late)) for late in (False, True)]
    return counts[0].unionByName(counts[1]).select("event_type", F.unix_millis("window.start").alias("hour_ms"), "late", "n", F.round("total", 4).alias("total"))
