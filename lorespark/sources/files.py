"""Text formats: document files, graph files, workflow and agent definitions, and their writers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions.json_text import json_text, quoted
from lorespark.session import cut


def read_documents(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Documents of a folder of ``<id>.doc`` files; and the paths that are no UTF-8 and were passed over."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.doc").load(folder)
    raw = raw.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("content"))
    good, bad = raw.where("content is not null"), raw.where("content is null").select("path")
    return parse_documents(good.select(F.regexp_extract("path", r"([^/]+)\.doc$", 1).alias("id"), "content")), bad


def parse_documents(contents: DataFrame) -> DataFrame:
    """Documents of files' contents (id, content).

    A file is header lines "key: value" up to the first blank line, then the body as it
    stands. Of lines with one key the last counts. Keys that start with "meta." make the metadata. A malformed embedding is
    null as a whole; a missing confidence is 0.
    """
    at = F.instr("content", "\n\n")
    head = F.when(at > 0, F.substring("content", F.lit(1), at - 1)).otherwise(F.rtrim(F.col("content")))
    body = F.when(at > 0, F.substring("content", at + 2, F.length("content"))).otherwise(F.lit(""))
    lines = F.filter(F.split(head, "\n"), lambda x: F.contains(x, F.lit(": ")) | F.endswith(x, F.lit(":")))
    pair = lambda x: F.struct(unescape(F.substring_index(x, ":", 1)).alias("key"), unescape(F.regexp_replace(x, "^[^:]*: ?", "")).alias("value"))
    pairs = F.col("pairs")  # a column of its own, or each line would be read again for every other one
    fields = F.map_from_entries(F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["key"] == x["key"])))
    df = contents.select("id", F.transform(lines, pair).alias("pairs"), body.alias("body")).select("id", fields.alias("f"), "body")
    numbers = F.transform(F.split(F.col("f")["embedding"], "[, ]+"), lambda x: x.try_cast("float"))
    embedding = F.when(F.exists(numbers, lambda x: x.isNull()), F.lit(None)).otherwise(numbers)
    return df.select(
        "id",
        F.coalesce(F.col("f")["type"], F.lit("note")).alias("doc_type"),
        F.coalesce(F.col("f")["title"], F.lit("")).alias("title"),
        F.col("f")["author"].alias("author"),
        "body",
        F.transform_keys(F.map_filter("f", lambda k, _: F.startswith(k, F.lit("meta."))), lambda k, _: F.regexp_replace(k, r"^meta\.", "")).alias("metadata"),
        embedding.alias("embedding"),
        F.coalesce(F.col("f")["confidence"].try_cast("int"), F.lit(0)).alias("confidence"),
    )


def escape(value: Column, key: bool = False) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\"), "\n", r"\\n"), "\r", r"\\r")
    return F.regexp_replace(out, ":", r"\\c") if key else out


def unescape(value: Column) -> Column:
    """Undoes ``escape``; a backslash before anything else stays."""
    out = F.regexp_replace(value, r"\\\\", "\u0000")
    for code, char in (("n", "\n"), ("r", "\r"), ("c", ":")):
        out = F.regexp_replace(out, r"\\" + code, char)
    return F.regexp_replace(out, "\u0000", r"\\")


def document_files(docs: DataFrame) -> DataFrame:
    """id and the content of each document's file; a null body is an empty one."""
    line = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), escape(c.cast("string"))))
    entries = F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(F.lit("meta."), escape(e["key"], key=True), F.lit(": "), escape(e["value"])))
    vector = F.concat_ws(",", F.transform("embedding", lambda x: x.cast("string")))
    head = [line("type", F.col("doc_type")), line("title", F.col("title")), line("author", F.col("author")), line("confidence", F.col("confidence")), F.when(F.col("embedding").isNotNull(), F.concat(F.lit("embedding: "), vector))]
    return docs.select("id", F.concat(F.concat_ws("\n", *head, entries), F.lit("\n\n"), F.coalesce("body", F.lit(""))).alias("content"))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a tab-separated graph file: N id kind confidence date provenance label; E src dst kind.

    Other lines are passed over; a bad confidence is 0, one above 100 is 100.
    """
    parts = spark.read.text(path).select(F.split("value", "\t").alias("p"))
    some = lambda c: F.when(c != "", c)
    at = lambda i: F.try_element_at("p", F.lit(i))
    nodes = parts.where((at(1) == "N") & (F.size("p") >= 7)).select(
        at(2).alias("id"), F.lower(F.trim(at(3))).alias("kind"), F.concat_ws("\t", F.slice("p", F.lit(7), F.size("p"))).alias("label"),
        F.least(F.coalesce(at(4).try_cast("int"), F.lit(0)), F.lit(100)).alias("confidence"), some(at(5)).alias("date"), some(at(6)).alias("provenance"),
    )
    return nodes, parts.where((at(1) == "E") & (F.size("p") >= 4)).select(at(2).alias("src"), at(3).alias("dst"), at(4).alias("kind"))


def sanitize(value: Column) -> Column:
    return F.translate(F.coalesce(value, F.lit("")), "\t\n\r", "   ")


def graph_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The lines of a graph file in order: nodes by id, then edges by source, target and kind."""
    n = nodes.select(F.lit(0).alias("part"), F.col("id").alias("a"), F.lit("").alias("b"), F.lit("").alias("c"), F.concat_ws("\t", F.lit("N"), sanitize(F.col("id")), sanitize(F.col("kind")), F.col("confidence").cast("string"), sanitize(F.col("date")), sanitize(F.col("provenance")), sanitize(F.col("label"))).alias("value"))
    e = edges.select(F.lit(1).alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("kind").alias("c"), F.concat_ws("\t", F.lit("E"), sanitize(F.col("src")), sanitize(F.col("dst")), sanitize(F.col("kind"))).alias("value"))
    return n.unionByName(e).orderBy("part", "a", "b", "c").select("value")


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Sorted part files; read_graph reads the folder."""
    cut(graph_lines(nodes, edges)).write.mode("overwrite").text(folder)


def json_lines(df: DataFrame) -> DataFrame:
    """value: each row as a JSON object of one line (see functions.json_text). Of columns of one name all are there, in their order."""
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])  # names may hold dots or clash
    fields = [F.concat(F.lit("," if k else ""), quoted(F.lit(f.name)), F.lit(":"), json_text(F.col(f"c{k}"), f.dataType)) for k, f in enumerate(df.schema.fields)]
    return plain.select(F.concat(F.lit("{"), *fields, F.lit("}")).alias("value"))


def write_json(df: DataFrame, folder: str) -> None:
    """Part files of JSON lines, in the row order of ``df``'s partitions."""
    json_lines(df).write.mode("overwrite").text(folder)


def dot_lines(nodes: DataFrame, edges: DataFrame, name: str = "knowledge") -> DataFrame:
    """The body lines of a DOT graph."""
    quote = lambda c: F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"')
    n = nodes.select(F.lit(1).alias("part"), F.col("id").alias("key"), F.format_string('  "%s" [label="%s"];', quote(F.col("id")), quote(F.col("label"))).alias("value"))
    e = edges.select(F.lit(2).alias("part"), F.concat_ws("\t", "src", "dst", "kind").alias("key"), F.format_string('  "%s" -> "%s" [label="%s"];', quote(F.col("src")), quote(F.col("dst")), quote(F.col("kind"))).alias("value"))
    frame = nodes.sparkSession.createDataFrame([(0, "", f"digraph {name} {{"), (3, "", "}")], "part int, key string, value string")
    return frame.unionByName(n).unionByName(e).orderBy("part", "key").select("value")


def workflow_steps(text: str) -> list[tuple[int, str, str, list[str]]]:
    """(index, name, capability, dependencies) of a definition: "workflow: name", then "step n: capability <- a, b"."""
    named, steps = False, []
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        if not line:
            continue
        if m := re.fullmatch(r"workflow:\s*(.*)", line):
            named = bool(m[1].strip())
        elif m := re.fullmatch(r"step\s+([^:]+):\s*([^<]*)(?:<-\s*(.*))?", line):
            name, capability = m[1].strip(), m[2].strip()
            deps = [d.strip() for d in (m[3] or "").split(",") if d.strip()]
            known = {s[1] for s in steps}
            if not capability or name in known or set(deps) - known:
                raise ValueError(f"a bad step: {line}")
            steps.append((len(steps), name, capability, deps))
        else:
            raise ValueError(f"an unknown line: {line}")
    if not named or not steps:
        raise ValueError("a workflow needs a name and a step")
    return steps


def agent_manifest(text: str) -> dict[str, str | list[str]]:
    """Scalars and lists ("[a, b]" or lines with a dash) of an agent's definition; an id is required."""
    out: dict[str, str | list[str]] = {}
    key = ""
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if line.lstrip().startswith("- ") and key:
            held = out.get(key)
            out[key] = [*(held if isinstance(held, list) else []), line.lstrip()[2:].strip()]
        elif ":" in line:
            key, value = (x.strip() for x in line.split(":", 1))
            out[key] = [v.strip() for v in value[1:-1].split(",") if v.strip()] if value.startswith("[") and value.endswith("]") else value.strip("\"'")
    if not out.get("id"):
        raise ValueError("an agent needs an id")
    return out


def form_fields(query: Column) -> Column:
    """A percent-encoded query string as a map; of repeated names the last counts."""
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"), F.coalesce(F.try_url_decode(F.regexp_replace(p, "^[^=]*=?", "")), F.lit("")).alias("v")))
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])))


def flag(value: Column) -> Column:
    """Off for a missing value, an empty one, 0 and false."""
    return ~F.coalesce(value, F.lit("")).isin("", "0", "false")
