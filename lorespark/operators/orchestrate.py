"""Relations of an orchestrator: telemetry, audit, policy, selection, messages, life cycles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.text import classify_intent, permits, trim
from lorespark.functions.vectors import cosine
from lorespark.operators.retrieval import embed
from lorespark.session import cut

TARGET_LATENCY_MS = 50

# Steps (description, capability, dependencies) of each class of intent.
PLANS = {
    "research": (("search sources", "retrieval", ()), ("generate embeddings", "embedding", (0,)), ("summarize", "reasoning", (1,)), ("verify citations", "verification", (2,)), ("generate report", "reasoning", (3,))),
    "coding": (("plan implementation", "planning", ()), ("write code", "coding", (0,)), ("verify code", "verification", (1,))),
    "translation": (("translate", "translation", ()),),
    "question": (("retrieve context", "retrieval", ()), ("answer", "reasoning", (0,))),
}

# The legal transitions of tasks and agents.
TASK_MOVES = (
    ("created", "queued"), ("queued", "planning"), ("queued", "running"), ("planning", "running"), ("running", "verifying"), ("running", "failed"),
    ("verifying", "completed"), ("verifying", "failed"), ("failed", "rollback"), ("rollback", "retry"), ("retry", "queued"),
)
AGENT_MOVES = (
    ("installed", "registered"), ("registered", "loaded"), ("loaded", "ready"), ("ready", "running"), ("running", "suspended"),
    ("running", "terminated"), ("suspended", "ready"), ("suspended", "terminated"), ("ready", "terminated"),
)
LOCALITY = {"edge": 0, "npu": 1, "gpu": 2, "cpu": 3, "cloud": 4}


def telemetry_by_runtime(telemetry: DataFrame) -> DataFrame:
    rate = F.when(F.sum("latency_ms") > 0, F.sum("tokens") * 1000.0 / F.nullif(F.sum("latency_ms"), F.lit(0))).otherwise(F.lit(0.0))
    return telemetry.groupBy("runtime").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.avg("latency_ms").alias("mean_latency_ms"), rate.alias("tokens_per_sec"))


def runtime_fit(observed: Column, target: int = TARGET_LATENCY_MS) -> Column:
    """1 up to the target latency, in proportion less beyond; 1 for an unknown one."""
    return F.when(F.coalesce(observed, F.lit(0)) == 0, F.lit(1.0)).otherwise(F.least(F.lit(float(max(target, 1))) / F.nullif(observed, F.lit(0)), F.lit(1.0)))


def task_score(priority: Column, **factors: Column) -> Column:
    """A priority's weight and the weighted factors deadline, importance, runtime_fit, confidence, cost_efficiency, energy."""
    base = F.when(priority == "critical", 1.0).when(priority == "high", 0.5).when(priority == "normal", 0.25).otherwise(0.0)
    weights = {"deadline": 0.30, "importance": 0.25, "runtime_fit": 0.15, "confidence": 0.10, "cost_efficiency": 0.10, "energy": 0.10}
    for name, weight in weights.items():
        base = base + weight * factors[name]
    return base


def newest(records: DataFrame, n: int, order: str = "seq") -> DataFrame:
    """The newest ``n`` records: a top-n, so tasks pass on n rows each."""
    return records.orderBy(F.desc(order)).limit(n)


def select_runtimes(runtimes: DataFrame) -> DataFrame:
    """capability and the runtime that serves it: the nearest kind, then the first registered (``position``)."""
    rank = F.create_map(*[F.lit(x) for kv in LOCALITY.items() for x in kv])
    caps = runtimes.select("id", "kind", "position", F.explode("capabilities").alias("capability"))
    return caps.groupBy("capability").agg(F.min_by(F.struct("id", "kind"), F.struct(rank[F.col("kind")], F.col("position"))).alias("r")).select("capability", F.col("r.id").alias("runtime"), F.col("r.kind").alias("kind"))


def discover_agents(agents: DataFrame) -> DataFrame:
    """capability and the first agent in service (``position``) that has it."""
    caps = agents.where(~F.col("state").isin("suspended", "terminated")).select("id", "position", F.explode("capabilities").alias("capability"))
    return caps.groupBy("capability").agg(F.min_by("id", "position").alias("agent"))


def ready_tasks(tasks: DataFrame) -> DataFrame:
    """Pending tasks (id, state, depends_on) whose dependencies are all completed."""
    done = tasks.where(F.col("state") == "completed").select(F.col("id").alias("dep"))
    waiting = tasks.where(F.col("state") == "queued").select("id", F.explode("depends_on").alias("dep")).join(done, "dep", "left_anti").select("id")
    return tasks.where(F.col("state") == "queued").join(waiting, "id", "left_anti")


def evaluate_policy(requests: DataFrame, grants: DataFrame, rules: DataFrame) -> DataFrame:
    """request_id and decision: an attribute deny wins, then attribute allows and role grants; else denied.

    requests: request_id, subject, roles, action, attributes; grants: role, permission;
    rules: action, attribute_key, attribute_value, deny. Grants are joined by role.
    """
    attributes = requests.select("request_id", "action", F.explode("attributes").alias("attribute_key", "attribute_value"))
    hit = attributes.join(rules, ["action", "attribute_key", "attribute_value"]).groupBy("request_id").agg(F.bool_or("deny").alias("denied"), F.bool_or(~F.col("deny")).alias("allowed"))
    roles = requests.select("request_id", "action", F.explode("roles").alias("role")).join(grants, "role")
    granted = roles.where(permits(F.col("permission"), F.col("action"))).select("request_id").distinct().withColumn("granted", F.lit(True))
    out = requests.join(hit, "request_id", "left").join(granted, "request_id", "left")
    yes = ~F.coalesce("denied", F.lit(False)) & (F.coalesce("allowed", F.lit(False)) | F.coalesce("granted", F.lit(False)))
    return out.select("request_id", F.when(yes, "allow").otherwise("deny").alias("decision"))


def plan_steps(intents: DataFrame) -> DataFrame:
    """intent_id, class, step, description, capability, depends_on: each intent's plan."""
    step = lambda i, d, c, deps: F.struct(F.lit(i).alias("step"), d.alias("description"), F.lit(c).alias("capability"), F.lit(",".join(map(str, deps))).alias("depends_on"))
    plan = F.array(step(0, F.col("intent"), "reasoning", ()))
    for name, steps in PLANS.items():
        plan = F.when(F.col("class") == name, F.array(*[step(i, F.lit(d), c, deps) for i, (d, c, deps) in enumerate(steps)])).otherwise(plan)
    known = intents.withColumn("class", classify_intent(F.col("intent")))
    return known.select("intent_id", "class", F.explode(plan).alias("s")).select("intent_id", "class", "s.*")


def reflect(verified: Column, output: Column, agent: Column) -> Column:
    """Score and hint for a result."""
    made = lambda score, hint: F.struct(F.lit(score).alias("score"), F.lit(hint).alias("hint"))
    return (
        F.when(~verified, made(20, "output failed verification; regenerate with stricter constraints"))
        .when(trim(output) == "", made(40, "verified but empty; tighten the prompt to require content"))
        .when(agent.isNull(), made(70, "no specialized agent matched; register one for this capability"))
        .otherwise(made(95, "result accepted; cache for reuse"))
    )


def consensus(reflections: DataFrame, by: str) -> DataFrame:
    """Per group: floor of the mean score, number of hints, the hint of most weight (score + 1 a vote; ties: first seen) and its share."""
    hints = reflections.groupBy(by, "hint").agg(F.sum(F.col("score") + 1).alias("weight"), F.min("seq").alias("first"))
    best = hints.groupBy(by).agg(F.max_by("hint", F.struct("weight", -F.col("first"))).alias("majority_hint"), F.max("weight").alias("most"), F.sum("weight").alias("total"), F.count("*").alias("n_hints"))
    means = reflections.groupBy(by).agg(F.floor(F.avg("score")).cast("long").alias("score"))
    return means.join(best, by).select(by, "score", "n_hints", "majority_hint", (F.col("most") / F.col("total")).alias("agreement"))


def numbered(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Adds ``n``, the place (from 0) of each row among those of its ``by``, in ``order``.

    A group may hold most of all rows: rows are parted by ranges of (by, order), numbered
    within a part, and each part starts after the counts of the parts before it.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(parts, by, order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy(by, "_part").agg(F.count("*").alias("_size"))  # a row for each part and group
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("_part", by).orderBy(order)) - 1
    placed = ranged.withColumn("_within", within).join(sizes.withColumn("_before", before), [by, "_part"])
    return placed.withColumn("n", F.col("_within") + F.col("_before")).drop("_part", "_within", "_before", "_size")


def canonical_message(nonce: Column, timestamp_ms: Column) -> Column:
    """The text of a message that is signed: id, source, destination, msg_type, priority, body, graph_id, memory_ref, nonce and time."""
    own = [F.col(c).cast("string") for c in ("id", "source", "destination", "msg_type")]
    rest = [F.initcap("priority"), F.col("body"), F.coalesce("graph_id", F.lit("")), F.coalesce("memory_ref", F.lit(""))]
    return F.array_join(F.array(*own, *rest, nonce.cast("string"), timestamp_ms.cast("string")), "|", "")


def inbox_order(messages: DataFrame) -> DataFrame:
    """Adds the place in which a destination receives its messages: by priority, then first in first out.

    One destination's messages are sorted by one task, which spills what does not fit.
    """
    weight = F.when(F.col("priority") == "critical", 3).when(F.col("priority") == "high", 2).when(F.col("priority") == "normal", 1).otherwise(0)
    return messages.withColumn("place", F.row_number().over(Window.partitionBy("destination").orderBy(weight.desc(), "seq")))


def round_robin(messages: DataFrame, providers: DataFrame) -> DataFrame:
    """Adds the provider: the n-th message of a capability goes to provider n modulo their number.

    One capability may have most of the messages; see ``numbered``.
    """
    order = Window.partitionBy("capability").orderBy("position")
    listed = providers.withColumn("k", F.row_number().over(order) - 1).withColumn("size", F.count("*").over(Window.partitionBy("capability")))
    turn = numbered(messages, "capability", "seq").join(listed.select("capability", "size").distinct(), "capability")
    return turn.withColumn("k", F.col("n") % F.col("size")).drop("size").join(listed.select("capability", "k", F.col("id").alias("provider")), ["capability", "k"]).drop("k", "n")


def replay_states(events: DataFrame, moves: tuple = TASK_MOVES, start: str = "created") -> DataFrame:
    """task, state, attempts, rejected: an ordered log (task, seq, wanted) through the legal transitions.

    A task's log is one array of short words; a life cycle's length bounds it. A log
    without end is replayed by the stream of ``lorespark.streaming.jobs.state_changes``.
    """
    legal = F.array(*[F.lit(f"{a}>{b}") for a, b in moves])
    wanted = events.groupBy("task").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "wanted"))), lambda x: x["wanted"]).alias("log"))
    zero = F.struct(F.lit(start).alias("state"), F.lit(0).alias("attempts"), F.lit(0).alias("rejected"))

    def step(s: Column, w: Column) -> Column:
        ok = F.array_contains(legal, F.concat(s["state"], F.lit(">"), w))
        return F.struct(F.when(ok, w).otherwise(s["state"]).alias("state"), (s["attempts"] + F.when(ok & (w == "retry"), 1).otherwise(0)).alias("attempts"), (s["rejected"] + F.when(ok, 0).otherwise(1)).alias("rejected"))

    return wanted.select("task", F.aggregate("log", zero, step).alias("s")).select("task", "s.*")


def recency(age: Column, decay: float = 0.9) -> Column:
    return F.pow(F.lit(min(max(decay, 0.0), 1.0)), F.greatest(age, F.lit(0)))


def recalled(memories: DataFrame, questions: DataFrame) -> DataFrame:
    """Adds ``relevance`` to memories (session, seq, text, ...): the cosine of their and their session's question's embeddings, 0 at least."""
    key = F.struct(F.col("session"), F.col("seq"))
    own = embed(memories.select(key.alias("id"), "text")).select("id.session", "id.seq", "embedding")
    asked = embed(questions.select(F.col("session").alias("id"), F.col("question").alias("text"))).select(F.col("id").alias("session"), F.col("embedding").alias("q"))
    near = own.join(asked, "session").select("session", "seq", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(F.col("embedding"), F.col("q")))), 9).alias("relevance"))
    return memories.drop("text").join(near, ["session", "seq"], "left").withColumn("relevance", F.coalesce("relevance", F.lit(0.0)))


def record(history: DataFrame, new: DataFrame) -> DataFrame:
    """A session history (session, seq, ...) with new records (session, at, ...) behind it, numbered on from each session's last number in the order of ``at``."""
    last = history.groupBy("session").agg(F.max("seq").alias("_last"))
    order = F.row_number().over(Window.partitionBy("session").orderBy("at"))
    made = new.withColumn("_n", order).join(last, "session", "left").withColumn("seq", F.coalesce("_last", F.lit(0)) + F.col("_n"))
    return history.unionByName(made.drop("at", "_n", "_last"))


def recall(memories: DataFrame, k: int, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """The best ``k`` memories of each session (session, seq, importance, relevance): normalised recency, importance and relevance."""
    w = Window.partitionBy("session")
    aged = memories.withColumn("recency", recency(F.max("seq").over(w) - F.col("seq")))
    total = F.lit(0.0)
    for name, weight in zip(("recency", "importance", "relevance"), weights, strict=True):
        low, high = F.min(name).over(w), F.max(name).over(w)
        total = total + weight * F.when(high - low < 1.1920929e-07, F.lit(1.0)).otherwise((F.col(name) - low) / F.nullif(high - low, F.lit(0.0)))
    scored = aged.withColumn("score", F.round(total, 9))
    return scored.withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), "seq"))).where(F.col("place") <= k)


def dag_levels(steps: DataFrame, deps: DataFrame) -> DataFrame:
    """workflow, step, level: the longest path of dependencies before each step.

    A step is placed in the round after its last dependency, so each is placed once; the
    rounds end when no step becomes free. A workflow in which steps are left then has a
    circle (or waits for a step that it does not have): all its levels are null.
    """
    own = steps.select("workflow", "step").distinct()
    waiting = cut(deps.select("workflow", "step", "dep").distinct().join(own, ["workflow", "step"], "left_semi"))
    at = cut(own.join(waiting, ["workflow", "step"], "left_anti").withColumn("level", F.lit(0)))
    placed, level = [at], 0
    while True:
        level += 1
        done = at.select("workflow", F.col("step").alias("dep"))
        freed = waiting.join(done, ["workflow", "dep"], "left_semi").select("workflow", "step").distinct()
        left = cut(waiting.join(done, ["workflow", "dep"], "left_anti"))
        at = cut(freed.join(left, ["workflow", "step"], "left_anti").withColumn("level", F.lit(level)))
        if not at.limit(1).count():
            break
        placed.append(at)
        waiting = left
    levels = reduce(DataFrame.unionAll, placed)
    if not waiting.limit(1).count():
        return levels
    stuck = waiting.select("workflow").distinct()
    return levels.join(stuck, "workflow", "left_anti").unionByName(own.join(stuck, "workflow", "left_semi").withColumn("level", F.lit(None).cast("int")))
