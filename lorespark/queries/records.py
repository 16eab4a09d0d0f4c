"""Queries over the records of an orchestrator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.operators import orchestrate as O
from lorespark.queries.base import query, sql_trim
from lorespark.queries.text import intent_sql
from lorespark.session import table
from lorespark.sources import adapters as A

TELEMETRY = f"WITH {A.TELEMETRY_SQL}"
BY_RUNTIME = "SELECT runtime, count(*)::BIGINT AS n, sum(tokens)::BIGINT AS tokens, round(avg(latency_ms), 6) AS mean_latency_ms, round(CASE WHEN sum(latency_ms) > 0 THEN sum(tokens) * 1000.0 / sum(latency_ms) ELSE 0 END::DOUBLE, 6) AS tokens_per_sec FROM telemetry GROUP BY runtime"


@query(f"{TELEMETRY} {BY_RUNTIME}")
def telemetry_by_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = O.telemetry_by_runtime(A.telemetry(spark, sf_dir))
    return t.select("runtime", "n", "tokens", F.round("mean_latency_ms", 6).alias("mean_latency_ms"), F.round("tokens_per_sec", 6).alias("tokens_per_sec"))


@query("SELECT date_trunc('day', ts)::DATE AS day, count(*)::BIGINT AS n, count(*) FILTER (event_type = 'error')::BIGINT AS errors FROM events GROUP BY 1")
def audit_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query(f"{TELEMETRY} SELECT seq, runtime, latency_ms, tokens FROM telemetry ORDER BY seq DESC LIMIT 1000")
def retention_newest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.newest(A.telemetry(spark, sf_dir), 1000)


_PRIORITY = "CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'normal' ELSE 'low' END"


@query(
    f"{TELEMETRY}, f AS (SELECT least(50.0 / nullif(round(avg(latency_ms)), 0), 1.0)::DOUBLE AS fit FROM telemetry), o AS (SELECT o_orderkey, {_PRIORITY} AS p, (o_orderkey % 11) / 10.0::DOUBLE AS d, (o_orderkey % 7) / 6.0::DOUBLE AS i FROM orders) "
    "SELECT o_orderkey, round(CASE p WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.5 WHEN 'normal' THEN 0.25 ELSE 0.0 END + 0.30 * d + 0.25 * i + 0.15 * fit + 0.10 * 0.8 + 0.10 * 0.5 + 0.10 * 0.5, 6)::DOUBLE AS score FROM o, f"
)
def scheduler_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = A.telemetry(spark, sf_dir).agg(O.runtime_fit(F.round(F.avg("latency_ms"))).alias("fit"))
    priority = F.when(F.col("o_orderpriority") == "1-URGENT", "critical").when(F.col("o_orderpriority") == "2-HIGH", "high").when(F.col("o_orderpriority") == "3-MEDIUM", "normal").otherwise("low")
    score = O.task_score(priority, deadline=(F.col("o_orderkey") % 11) / 10.0, importance=(F.col("o_orderkey") % 7) / 6.0, runtime_fit=F.col("fit"), confidence=F.lit(0.8), cost_efficiency=F.lit(0.5), energy=F.lit(0.5))
    return table(spark, sf_dir, "orders").crossJoin(F.broadcast(fit)).select("o_orderkey", F.round(score, 6).alias("score"))


_KINDS = ("edge", "npu", "gpu", "cpu", "cloud")


@query("WITH r AS (SELECT s_suppkey AS position, 'rt-' || s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN 'edge' WHEN 1 THEN 'npu' WHEN 2 THEN 'gpu' WHEN 3 THEN 'cpu' ELSE 'cloud' END AS kind, 'cap-' || s_nationkey AS capability FROM supplier) SELECT capability, id AS runtime, kind FROM r QUALIFY row_number() OVER (PARTITION BY capability ORDER BY CASE kind WHEN 'edge' THEN 0 WHEN 'npu' THEN 1 WHEN 'gpu' THEN 2 WHEN 'cpu' THEN 3 ELSE 4 END, position) = 1")
def runtime_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    r = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("position"), F.concat(F.lit("rt-"), F.col("s_suppkey").cast("string")).alias("id"), kind.alias("kind"), F.array(F.concat(F.lit("cap-"), F.col("s_nationkey").cast("string"))).alias("capabilities"))
    return O.select_runtimes(r)


@query("WITH a AS (SELECT c_custkey AS position, 'agent-' || c_custkey AS id, c_mktsegment AS capability FROM customer WHERE c_custkey % 4 > 1) SELECT capability, id AS agent FROM a QUALIFY row_number() OVER (PARTITION BY capability ORDER BY position) = 1")
def agent_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("c_custkey") % 4 == 0, "suspended").when(F.col("c_custkey") % 4 == 1, "terminated").otherwise("ready")
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("position"), F.concat(F.lit("agent-"), F.col("c_custkey").cast("string")).alias("id"), state.alias("state"), F.array("c_mktsegment").alias("capabilities"))
    return O.discover_agents(a)


@query(
    "SELECT c_custkey AS request_id, CASE WHEN c_custkey % 3 = 0 AND c_nationkey = 7 THEN 'deny' WHEN c_custkey % 3 = 1 AND c_nationkey = 9 THEN 'allow' WHEN c_mktsegment = 'BUILDING' AND c_custkey % 3 IN (0, 1) THEN 'allow' WHEN c_mktsegment = 'MACHINERY' THEN 'allow' ELSE 'deny' END AS decision FROM customer"
)
def policy_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.element_at(F.array(F.lit("graph.read"), F.lit("graph.write"), F.lit("memory.read")), (F.col("c_custkey") % 3 + 1).cast("int"))
    requests = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), F.col("c_name").alias("subject"), F.array("c_mktsegment").alias("roles"), action.alias("action"), F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("attributes"))
    grants = spark.createDataFrame([("BUILDING", "graph.*"), ("MACHINERY", "*"), ("NOBODY", "memory.read")], "role string, permission string")
    rules = spark.createDataFrame([("graph.read", "nation", "7", True), ("graph.write", "nation", "9", False)], "action string, attribute_key string, attribute_value string, deny boolean")
    return O.evaluate_policy(requests, grants, rules)


@query("WITH r AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN 20 WHEN " + sql_trim("text") + " = '' THEN 40 WHEN turn % 3 = 0 THEN 70 ELSE 95 END AS score FROM conversations), h AS (SELECT conv_id, score, sum(score + 1) AS w, min(turn) AS f FROM r GROUP BY ALL), b AS (SELECT conv_id, arg_max(score, struct_pack(w := w, f := -f)) AS top, max(w) AS most, sum(w) AS total, count(*)::BIGINT AS n_hints FROM h GROUP BY conv_id), m AS (SELECT conv_id, floor(avg(score))::BIGINT AS score FROM r GROUP BY conv_id) SELECT conv_id, m.score, n_hints, top::BIGINT AS majority_score, round(most / total::DOUBLE, 6) AS agreement FROM m JOIN b USING (conv_id)")
def reflect_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = O.reflect(F.col("role") != "system", F.col("text"), F.when(F.col("turn") % 3 != 0, F.lit("agent")))
    judged = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), r.alias("r")).select("conv_id", "seq", "r.score", "r.hint")
    scores = judged.groupBy("conv_id", "hint").agg(F.max("score").cast("long").alias("majority_score"))
    made = O.consensus(judged, "conv_id")
    return made.join(scores, (made["conv_id"] == scores["conv_id"]) & (made["majority_hint"] == scores["hint"])).select(made["conv_id"], made["score"], "n_hints", "majority_score", F.round("agreement", 6).alias("agreement"))


_PRI = "CASE event_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'normal' ELSE 'low' END"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.element_at(F.array(*[F.lit(p) for p in ("critical", "high", "normal", "low")]), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("destination"), F.col("event_type").alias("capability"), priority.alias("priority"))


@query(f"SELECT event_id AS seq, user_id AS destination, row_number() OVER (PARTITION BY user_id ORDER BY CASE {_PRI} WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'normal' THEN 1 ELSE 0 END DESC, event_id)::INTEGER AS place FROM events")
def inbox_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.inbox_order(_messages(spark, sf_dir)).select("seq", "destination", "place")


@query("WITH n AS (SELECT event_id AS seq, event_type AS capability, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS k FROM events) SELECT seq, capability, 'p' || (k % 3) AS provider FROM n")
def mesh_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir)
    kinds = m.select("capability").distinct()
    providers = kinds.select("capability", F.posexplode(F.array(F.lit("p0"), F.lit("p1"), F.lit("p2"))).alias("position", "id"))
    return O.round_robin(m, providers).select("seq", "capability", "provider")


WANTED = ("queued", "running", "verifying", "completed", "failed", "rollback", "retry")


def fsm_sql() -> str:
    legal = ", ".join(f"'{a}>{b}'" for a, b in O.TASK_MOVES)
    case = " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(WANTED))
    return f"""WITH RECURSIVE e AS (SELECT user_id AS task, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, CASE event_id % 7 {case} END AS w FROM events),
s AS (SELECT DISTINCT task, 0::BIGINT AS k, 'created' AS state, 0 AS attempts, 0 AS rejected FROM e UNION ALL
SELECT s.task, e.k, CASE WHEN s.state || '>' || w IN ({legal}) THEN w ELSE state END, attempts + CASE WHEN w = 'retry' AND s.state || '>' || w IN ({legal}) THEN 1 ELSE 0 END, rejected + CASE WHEN s.state || '>' || w IN ({legal}) THEN 0 ELSE 1 END FROM s JOIN e ON e.task = s.task AND e.k = s.k + 1)
SELECT task, state, attempts, rejected FROM s QUALIFY row_number() OVER (PARTITION BY task ORDER BY k DESC) = 1"""


@query(fsm_sql())
def task_fsm_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.element_at(F.array(*[F.lit(w) for w in WANTED]), (F.col("event_id") % 7 + 1).cast("int"))
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("task"), F.col("event_id").alias("seq"), wanted.alias("wanted"))
    return O.replay_states(events)


@query("WITH RECURSIVE s AS (SELECT DISTINCT l_orderkey AS workflow, l_linenumber AS step FROM lineitem), d AS (SELECT a.workflow, a.step, b.step AS dep FROM s a JOIN s b ON a.workflow = b.workflow AND b.step < a.step AND (a.step % 2 = 0 OR b.step % 2 = 1) AND a.step - b.step <= 2), w AS (SELECT workflow, step, 0 AS level FROM s UNION SELECT d.workflow, d.step, level + 1 FROM w JOIN d ON d.workflow = w.workflow AND d.dep = w.step) SELECT workflow, step, max(level)::INTEGER AS level FROM w GROUP BY ALL")
def dag_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("workflow"), F.col("l_linenumber").alias("step")).distinct()
    other = steps.select("workflow", F.col("step").alias("dep"))
    deps = steps.join(other, "workflow").where((F.col("dep") < F.col("step")) & ((F.col("step") % 2 == 0) | (F.col("dep") % 2 == 1)) & (F.col("step") - F.col("dep") <= 2))
    return O.dag_levels(steps, deps.select("workflow", "step", "dep"))


@query("WITH t AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'queued' END AS state FROM orders), w AS (SELECT a.id FROM t a LEFT JOIN t b ON b.id = a.id - 1 LEFT JOIN t c ON c.id = a.id - 2 WHERE a.state = 'queued' AND coalesce(b.state, 'x') = 'completed' AND coalesce(c.state, 'x') = 'completed') SELECT id FROM w")
def ready_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    deps = F.array((F.col("o_orderkey") - 1).alias("a"), (F.col("o_orderkey") - 2).alias("b"))
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("queued").alias("state"), deps.alias("depends_on"))
    return O.ready_tasks(tasks).select("id")


_STEPS = ", ".join(f"('{c}', {i}, '{d}', '{cap}', '{','.join(map(str, deps))}')" for c, plan in O.PLANS.items() for i, (d, cap, deps) in enumerate(plan))


@query(
    f"WITH c AS (SELECT conv_id, turn, text, {intent_sql('text')} AS class FROM conversations), p(class, step, description, capability, depends_on) AS (VALUES {_STEPS}) "
    "SELECT conv_id, turn, c.class, coalesce(p.step, 0)::INTEGER AS step, coalesce(p.description, c.text) AS description, coalesce(capability, 'reasoning') AS capability, coalesce(depends_on, '') AS depends_on FROM c LEFT JOIN p ON p.class = c.class"
)
def plan_question_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of every turn of every conversation."""
    asked = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("intent_id"), F.col("text").alias("intent"))
    return O.plan_steps(asked).select("intent_id.conv_id", "intent_id.turn", "class", "step", "description", "capability", "depends_on")


@query(f"{TELEMETRY} SELECT count(*)::BIGINT AS records, count(*) FILTER (runtime = 'error')::BIGINT AS errors, sum(tokens)::BIGINT AS tokens, coalesce(round(avg(latency_ms), 6), 0) AS mean_latency_ms FROM telemetry")
def server_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.telemetry(spark, sf_dir)
    return t.agg(F.count("*").alias("records"), F.count_if(F.col("runtime") == "error").alias("errors"), F.sum("tokens").alias("tokens"), F.coalesce(F.round(F.avg("latency_ms"), 6), F.lit(0.0)).alias("mean_latency_ms"))


# -- extensions: not of the model, but common over event tables ----------------


@query("SELECT event_type, CASE WHEN event_type IS NULL THEN NULL ELSE date_trunc('week', ts)::DATE END AS week, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ROLLUP (event_type, date_trunc('week', ts)::DATE)".replace("CASE WHEN event_type IS NULL THEN NULL ELSE date_trunc('week', ts)::DATE END", "date_trunc('week', ts)::DATE"))
def events_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    week = F.to_date(F.date_trunc("week", "ts"))
    return table(spark, sf_dir, "events").withColumn("week", week).rollup("event_type", "week").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
