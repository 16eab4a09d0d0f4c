"""Property-graph operators on (nodes, edges) frames; edges may repeat and may dangle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lorespark.session import cut, sized


def add_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """New rows win by id, of several with one id the one of highest confidence, then least label; confidence is at most 100."""
    kept = nodes.join(new.select("id"), "id", "left_anti")
    rest = [c for c in nodes.columns if c != "id"]
    one = new.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("confidence", -F.xxhash64("label"), "label")).alias("n")).select("id", "n.*")
    return kept.unionByName(one.withColumn("confidence", F.least("confidence", F.lit(100)).cast(nodes.schema["confidence"].dataType)).select(*nodes.columns))


def bump_confidence(nodes: DataFrame, seen: DataFrame) -> DataFrame:
    """Raises confidences to those of ``seen`` (id, confidence); none is lowered."""
    best = seen.groupBy("id").agg(F.max("confidence").alias("_seen"))
    return nodes.join(best, "id", "left").withColumn("confidence", F.least(F.greatest("confidence", "_seen"), F.lit(100))).select(*nodes.columns)


def reinforce(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Adds what was found (name, label, kind, confidence) to the nodes, which are known by their lower-cased labels.

    A known node keeps its fields but the larger confidence; an unknown name becomes the
    node "entity:<name>". Adds ``change``: "added", "reinforced" or null.
    """
    best = found.groupBy("name").agg(F.max("confidence").alias("seen"), F.max_by(F.struct("label", "kind"), "confidence").alias("f"))
    known = nodes.withColumn("name", F.lower("label")).join(best.select("name", "seen"), "name", "left")
    confidence = F.least(F.greatest("confidence", "seen"), F.lit(100)).cast(nodes.schema["confidence"].dataType)
    old = known.select(*[confidence.alias(c) if c == "confidence" else F.col(c) for c in nodes.columns], F.when(F.col("seen").isNotNull(), F.lit("reinforced")).alias("change"))
    fresh = best.join(nodes.select(F.lower("label").alias("name")), "name", "left_anti")
    values = {"id": F.concat(F.lit("entity:"), "name"), "kind": F.col("f.kind"), "label": F.col("f.label"), "confidence": F.least("seen", F.lit(100))}
    made = [values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in nodes.schema.fields]
    return old.unionByName(fresh.select(*made, F.lit("added").alias("change")))


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes of ``gone`` (id) and all edges that touch them."""
    ids = gone.select("id").distinct()
    left = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(ids, "id", "left_anti").select(*nodes.columns), left.select(*edges.columns)


def remove_edge(edges: DataFrame, src: str, dst: str, kind: str) -> DataFrame:
    return edges.where(~((F.col("src") == src) & (F.col("dst") == dst) & (F.col("kind") == kind)))


def neighbors(nodes: DataFrame, edges: DataFrame, start: DataFrame, kind: str | None = None) -> DataFrame:
    """src and the target node of every outgoing edge; parallel edges count each, dangling ones don't."""
    if kind is not None:
        edges = edges.where(F.col("kind") == kind)
    out = edges.select("src", F.col("dst").alias("id"), F.col("kind").alias("edge")).join(start.select(F.col("id").alias("src")), "src", "left_semi")
    return out.join(nodes, "id")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge names at either end."""
    named = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return nodes.join(named, "id", "left_anti")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and the number of its edges that lead to a node."""
    live = edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    return nodes.select("id").join(live, "id", "left").select("id", F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def bfs(nodes: DataFrame, edges: DataFrame, start: DataFrame, max_hops: int | None = None) -> DataFrame:
    """id and least number of hops of all nodes that outgoing edges lead to from ``start`` (id); without the start.

    It ends when nothing new is reached, or after ``max_hops`` where that is asked for.
    """
    seen = cut(start.select("id").distinct().withColumn("hops", F.lit(0)))
    frontier = seen
    hop = 0
    while max_hops is None or hop < max_hops:
        hop += 1
        reached = edges.join(frontier.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier = cut(reached.join(seen, "id", "left_anti").withColumn("hops", F.lit(hop)))
        if not frontier.limit(1).count():
            break
        seen = cut(seen.union(frontier))
    return seen.where("hops > 0").join(nodes.select("id"), "id", "left_semi")


LINKS_PER_CELL = 100_000


def in_cells(links: DataFrame, per_cell: int = LINKS_PER_CELL) -> DataFrame:
    """Links (src, dst, n) with ``cell`` and the number of ``cells`` of their source: a hub's links are dealt by target into cells of about ``per_cell``.

    Only the sources of more than ``per_cell`` links travel for that. A source of up to
    ``per_cell`` links has one cell, 0, so its share is sent once.
    """
    degree = links.groupBy("src").agg(F.count("*").alias("d")).where(F.col("d") > per_cell)
    cells = F.coalesce(F.ceil(F.col("d") / per_cell), F.lit(1)).cast("int")
    known = links.join(degree, "src", "left").withColumn("cells", cells).drop("d")
    return known.withColumn("cell", F.pmod(F.xxhash64("dst"), F.col("cells")).cast("int"))


def _rounds(own: DataFrame, terms: DataFrame, ends: DataFrame, links: DataFrame, by: list[str], damping: float, iterations: int) -> DataFrame:
    """The rounds of ``_rank`` over few links, a query a call: ``by``, id and rank of its nodes, and a row without id with its last c and before."""
    known, few = ends.select("id", "out").toArrow(), links.select("src", "dst", "n").toArrow()
    ids = known["id"].combine_chunks()
    at = lambda column: pc.index_in(column.combine_chunks(), ids).to_numpy(zero_copy_only=False).astype(np.int64)
    outs = known["out"].to_numpy().astype(np.float64)  # NaN: no links
    graph = own.sparkSession.sparkContext.broadcast((ids, outs, at(few["src"]), at(few["dst"]), few["n"].to_numpy().astype(np.float64)))

    def run(query: pa.Table) -> pa.Table:
        ids, outs, src, dst, n = graph.value
        named = query["id"].is_valid()
        mine, told = query.filter(named), query.filter(pc.invert(named)).to_pylist()[0]
        node = pc.index_in(mine["id"].combine_chunks(), ids).to_numpy(zero_copy_only=False).astype(np.int64)
        tp, s, seeded = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), bool)
        tp[node], s[node], seeded[node] = mine["tp"].to_numpy(), mine["s"].to_numpy(), True
        rank, held, c, before = tp, seeded, 1.0, 0.0
        for _ in range(iterations):
            mass = rank[np.isnan(outs)].sum() + c * told["tps"] + damping * before * told["ss"]
            c, before = (1 - damping) + damping * mass, c
            sent = rank[src] > 0
            to = dst[sent]
            got = np.bincount(to, (rank[src] / outs[src] * n)[sent], len(ids))
            held = seeded | (np.bincount(to, minlength=len(ids)) > 0)
            rank = c * tp + damping * (got + before * s)
        k = np.flatnonzero(held)
        id_ = pa.concat_arrays([ids.take(pa.array(k)), pa.nulls(1, ids.type)])
        columns = [pa.array([told[b]] * (len(k) + 1), query.schema.field(b).type) for b in by]
        only = lambda v: pa.array([None] * len(k) + [v], pa.float64())
        return pa.table([*columns, id_, pa.array([*rank[k], None], pa.float64()), only(c), only(before)], [*by, "id", "rank", "c", "before"])

    none = F.lit(None)
    rows = own.select(*by, "id", "tp", "s", none.cast("double").alias("tps"), none.cast("double").alias("ss"))
    rows = rows.unionByName(terms.select(*by, none.cast(own.schema["id"].dataType).alias("id"), none.cast("double").alias("tp"), none.cast("double").alias("s"), "tps", "ss"))
    kinds = [*[StructField(b, own.schema[b].dataType) for b in by], StructField("id", own.schema["id"].dataType), *[StructField(x, DoubleType()) for x in ("rank", "c", "before")]]
    return rows.groupBy(*by).applyInArrow(run, StructType(kinds))


def _rank(nodes: DataFrame, edges: DataFrame, teleport: DataFrame, by: list[str], damping: float, iterations: int, per_cell: int = LINKS_PER_CELL) -> DataFrame:
    """The power iteration of both kinds of PageRank, for every query (``by``) at once.

    Links to missing nodes are left out first, so all mass stays in the graph; that of
    nodes without links goes to the teleport. Parallel edges carry a share each.

    A node that no link leads to has the rank c * tp in each round, with one number c for
    the query, so all links of such nodes are summed once (``s`` of their targets) and
    count c * s after that. Nodes that only such links lead to have the rank
    c * tp + damping * before * s, with the c of the round before; of those without links,
    two sums for the query give the mass. The rounds go over the rest alone: the links of
    nodes that have links to them, and both their ends. At most ``per_cell`` of them go to
    the tasks that make a query's rounds in one go (``_rounds``): each round of its own takes
    the driver some five exchanges, and a thread for each. More keep one partitioning by source and
    cell (see ``in_cells``: a hub's share goes to each of its cells, so no task gets all
    links of a hub; kept copies that are lost are read again from their checkpoint), and each
    round is cut off by a checkpoint. The terms are read back from files, as Spark takes a joined
    table's size for the product of both: else every round's estimate is the square of the last one's.
    """
    damping = min(max(damping, 0.0), 1.0)
    live = edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").join(nodes.select(F.col("id").alias("src")), "src", "left_semi")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = cut(live.groupBy("src", "dst").agg(F.count("*").alias("n")))
    sums = every.groupBy(F.col("src").alias("id")).agg(F.sum("n").alias("out"))
    out = cut(sums.join(every.select(F.col("dst").alias("id"), F.lit(True).alias("led")).distinct(), "id", "left"))
    led = out.where("led").select(F.col("id").alias("src"))
    few = led.count() <= per_cell
    dealt = cut(in_cells(every.join(F.broadcast(led) if few else led, "src", "left_semi"), per_cell))
    small = dealt.count() <= per_cell
    inner = cut(dealt.select(F.col("src").alias("id")).unionByName(dealt.select(F.col("dst").alias("id"))).distinct())
    first = teleport.join(out.where("led is null"), "id").select(*by, F.col("id").alias("src"), (F.col("tp") / F.col("out")).alias("share"))
    once = every.join(first, "src").groupBy(*by, F.col("dst").alias("id")).agg(F.sum(F.col("share") * F.col("n")).alias("s"))
    zero = F.lit(0.0)
    base = cut(teleport.select(*by, "id", "tp", zero.alias("s")).unionByName(once.select(*by, "id", zero.alias("tp"), "s")).groupBy(*by, "id").agg(F.sum("tp").alias("tp"), F.sum("s").alias("s")))
    outer, own = base.join(inner, "id", "left_anti"), base.join(inner, "id", "left_semi")
    loose = outer.join(out.select("id"), "id", "left_anti").select(*by, "tp", "s")
    asked = base.select(*by).distinct().select(*by, zero.alias("tp"), zero.alias("s")) if by else base.limit(0).select("tp", "s")
    held = loose.unionByName(asked).groupBy(*by).agg(F.coalesce(F.sum("tp"), zero).alias("tps"), F.coalesce(F.sum("s"), zero).alias("ss"))
    terms = held.select(*by, "tps", "ss", F.lit(1.0).alias("c"), zero.alias("before"))  # one row for each query
    ends = cut(inner.join(out.select("id", "out"), "id", "left").join(dealt.groupBy(F.col("src").alias("id")).agg(F.max("cells").alias("cells")), "id", "left"))
    own = cut(own.join(ends, "id").select(*by, "id", "out", "cells", "tp", "s"))
    if small:
        made = cut(_rounds(own, terms, ends, dealt, by, damping, iterations))
        state, terms = made.where("id is not null"), sized(made.where("id is null").select(*by, "c", "before"))
    else:
        terms = sized(terms)
        links = dealt.drop("cells").join(ends.select(F.col("id").alias("dst"), "out", F.col("cells").alias("dst_cells")), "dst").repartition(parts, "src", "cell").persist()
        state = own.select(*by, "id", "out", "cells", F.col("tp").alias("rank"))  # rows of a rank or a teleport above 0 are kept, no others
        for _ in range(iterations):
            # one number for each query: the mass that stands on nodes without links
            lost = state.groupBy(*by).agg(F.sum(F.when(F.col("out").isNull(), F.col("rank")).otherwise(0.0)).alias("lost"))
            mass = F.coalesce("lost", zero) + F.col("c") * F.col("tps") + damping * F.col("before") * F.col("ss")
            now = terms.join(lost, by, "left") if by else terms.crossJoin(lost)
            terms = sized(now.select(*by, "tps", "ss", ((1 - damping) + damping * mass).alias("c"), F.col("c").alias("before")))
            shares = state.where("out is not null and rank > 0").select(*by, F.col("id").alias("src"), (F.col("rank") / F.col("out")).alias("share"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"))
            sent = shares.join(links, ["src", "cell"]).select(*by, F.col("dst").alias("id"), "out", F.col("dst_cells").alias("cells"), (F.col("share") * F.col("n")).alias("got"), zero.alias("tp"), zero.alias("s"))
            both = sent.unionByName(own.withColumn("got", zero))
            new = both.groupBy(*by, "id").agg(*[F.max(c).alias(c) for c in ("out", "cells")], *[F.sum(c).alias(c) for c in ("got", "tp", "s")])
            new = new.join(F.broadcast(terms), by) if by else new.crossJoin(F.broadcast(terms))
            rank = F.col("c") * F.col("tp") + damping * (F.col("got") + F.col("before") * F.col("s"))
            state = cut(new.select(*by, "id", "out", "cells", rank.alias("rank")))
        links.unpersist()
    rest = outer.join(F.broadcast(terms), by) if by else outer.crossJoin(F.broadcast(terms))
    rank = F.col("c") * F.col("tp") + damping * F.col("before") * F.col("s")
    return state.select(*by, "id", "rank").unionByName(rest.select(*by, "id", rank.alias("rank")))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 20) -> DataFrame:
    """id and rank; the ranks' sum is 1. An empty graph has no ranks."""
    n = nodes.count()
    return _rank(nodes, edges, nodes.select("id", F.lit(1.0 / max(n, 1)).alias("tp")), [], damping, iterations)


def personalized_pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, damping: float = 0.85, iterations: int = 30) -> DataFrame:
    """query_id, id and rank for every query of ``seeds`` (query_id, id), of all nodes with a rank; seeds that are no nodes don't count.

    The mass of nodes without links goes back to the seeds, so a query has rows only for
    what its seeds lead to, not for every node.
    """
    present = seeds.join(nodes.select("id"), "id", "left_semi")
    size = present.groupBy("query_id").agg(F.count("*").alias("n"))
    shares = present.dropDuplicates(["query_id", "id"]).join(size, "query_id").select("query_id", "id", (F.lit(1.0) / F.col("n")).alias("share"))
    return _rank(nodes, edges, shares.withColumnRenamed("share", "tp"), ["query_id"], damping, iterations)


def central_nodes(nodes: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    ranks = pagerank(nodes, edges).withColumn("rank", F.round("rank", 9))
    return ranks.join(nodes, "id").orderBy(F.desc("rank"), "label", "id").limit(n)


def identity(kind: str = "kind", label: str = "label") -> Column:
    """What makes two nodes of different versions the same."""
    return F.concat(F.col(kind), F.lit(":"), F.lower(label))


def merge_nodes(ours: DataFrame, theirs: DataFrame, strategy: str = "higher_confidence") -> DataFrame:
    """identity, kind, label, confidence, date, provenance, conflict and added of the merged version.

    Strategies: "ours", "theirs", "higher_confidence" (theirs only if strictly higher).
    Kind and label are ours where we have them; a conflict is any difference in the rest.
    """
    one = lambda df: df.withColumn("identity", identity()).withColumn("_n", F.row_number().over(Window.partitionBy("identity").orderBy(F.desc("confidence"), "id"))).where("_n = 1")
    o, t = one(ours).alias("o"), one(theirs).alias("t")
    both = o.join(t, F.col("o.identity") == F.col("t.identity"), "full_outer")
    have_o, have_t = F.col("o.identity").isNotNull(), F.col("t.identity").isNotNull()
    pick = {"ours": F.lit(False), "theirs": F.lit(True), "higher_confidence": F.col("t.confidence") > F.col("o.confidence")}[strategy]
    theirs_wins = F.when(have_o & have_t, pick).otherwise(have_t)
    chosen = lambda c: F.when(theirs_wins, F.col(f"t.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    differ = ~(F.col("o.confidence").eqNullSafe(F.col("t.confidence")) & F.col("o.date").eqNullSafe(F.col("t.date")) & F.col("o.provenance").eqNullSafe(F.col("t.provenance")))
    return both.select(
        F.coalesce("o.identity", "t.identity").alias("identity"), F.coalesce("o.kind", "t.kind").alias("kind"), F.coalesce("o.label", "t.label").alias("label"),
        *[chosen(c) for c in ("confidence", "date", "provenance")], (have_o & have_t & differ).alias("conflict"), (~have_o).alias("added"),
    )


def merge_edges(sides: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """src, dst (identities) and kind of all versions' edges between nodes, each once."""
    parts = []
    for nodes, edges in sides:
        named = nodes.select("id", identity().alias("identity"))
        both = edges.join(named.select(F.col("id").alias("src"), F.col("identity").alias("from")), "src").join(named.select(F.col("id").alias("dst"), F.col("identity").alias("to")), "dst")
        parts.append(both.select(F.col("from").alias("src"), F.col("to").alias("dst"), "kind"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def version_log(versions: DataFrame, head: int) -> DataFrame:
    """version_id and depth of a version and all its ancestors (version_id, parent), by doubled pointers: log2(depth) rounds.

    A parent that is no version ends the log; a circle of parents is an error.
    """
    known = versions.select(F.col("version_id").cast("long").alias("version_id"), F.col("parent").cast("long").alias("parent")).dropDuplicates(["version_id"])
    n = known.count()
    up = cut(known.join(known.select(F.col("version_id").alias("parent")), "parent", "left_semi").select(F.col("version_id").alias("at"), F.col("parent").alias("to")))
    seen = cut(known.where(F.col("version_id") == head).select("version_id", F.lit(0).alias("depth")))
    reach = 1
    while True:
        more = seen.join(up, seen["version_id"] == up["at"]).select(F.col("to").alias("version_id"), (F.col("depth") + reach).alias("depth"))
        longer = cut(seen.unionByName(more))
        if longer.count() == seen.count():
            return seen
        if longer.count() > n:
            raise ValueError("the versions' parents form a circle")
        seen, reach = longer, reach * 2
        up = cut(up.alias("a").join(up.alias("b"), F.col("a.to") == F.col("b.at")).select("a.at", "b.to"))


def commit_version(versions: DataFrame, refs: DataFrame, branch: str, version_id: int) -> tuple[DataFrame, DataFrame]:
    """A new version on a branch, whose tip is its parent; the branch (name, version_id) moves to it."""
    tip = refs.where(F.col("name") == branch).agg(F.max("version_id").alias("parent"))
    new = tip.select(F.lit(version_id).cast("long").alias("version_id"), F.col("parent").cast("long").alias("parent"))
    moved = versions.sparkSession.createDataFrame([(branch, version_id)], "name string, version_id long")
    return versions.unionByName(new), refs.where(F.col("name") != branch).unionByName(moved)


def create_branch(refs: DataFrame, name: str, at: str) -> DataFrame:
    """A branch of this name at the tip of another; a branch of that name is moved."""
    return refs.where(F.col("name") != name).unionByName(refs.where(F.col("name") == at).select(F.lit(name).alias("name"), "version_id"))


def checkout(rows: DataFrame, versions: DataFrame, refs: DataFrame, branch: str) -> DataFrame:
    """What a branch's tip holds of versioned rows (id, version_id, ...): of each id the row of the nearest version in its log."""
    tip = refs.where(F.col("name") == branch).agg(F.max("version_id")).first()[0]
    if tip is None:
        return rows.limit(0)
    near = rows.join(version_log(versions, tip), "version_id")
    rest = [c for c in rows.columns if c != "id"]
    return near.groupBy("id").agg(F.min_by(F.struct(*rest), "depth").alias("r")).select("id", "r.*").select(*rows.columns)


def merge_report(merged: DataFrame) -> DataFrame:
    """added, conflicts and total of what ``merge_nodes`` returned: one row."""
    return merged.agg(F.count_if("added").alias("added"), F.count_if("conflict").alias("conflicts"), F.count("*").alias("total"))
