"""2. URL filters by a path-template tree. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.llm.frames import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


@dataclass(frozen=True)
class Settings:
    many_children: int = 20  # a node with more literal children than this ...
    rare_pages: int = 5  # ... generalises those with fewer pages
    z: float = 1.96  # branches are merged unless their labels differ by this
    prior_weight: float = 10.0  # of the overall share, in a template's purity
    reject: float = 0.5  # templates of at least this purity are blocked


DEFAULT = Settings()


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first "://" up to /, ?, # or end, A-Z lower-cased. Path: then up to ? or #. Else both are empty."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (of equally long ones the first by name), and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        at, start = text.split("/", 1)
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit("/" + start))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def segment_class(segment: Column) -> Column:
    """Numbers and long hexadecimal segments, with or without an extension, are variable in any case."""
    return (
        F.when(segment.rlike(r"^[0-9]+(\.[A-Za-z]+)?$"), F.lit("{n}"))
        .when(segment.rlike(r"^[0-9a-fA-F]*[0-9][0-9a-fA-F]*$") & (F.length(segment) >= 8), F.lit("{x}"))
        .otherwise(segment)
    )


def parsed_pages(pages: DataFrame) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    segments = F.transform(F.filter(F.split("path", "/"), lambda x: x != ""), segment_class)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")).withColumn("segments", segments)


def template_tree(pages: DataFrame, labels: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """host, segments, template and purity of every distinct generalised path.

    Going down level by level, each node's branches are compared with their siblings:
    in a node of many literal children the rare ones become one wildcard branch, and
    so do branches whose share of bad labels does not differ from that of the node's
    other pages (two-proportion z). A template's purity is its share of bad labels,
    smoothed towards the overall share. It goes on until no node holds two paths any
    more; the rest of a path that is alone in its node is literal. Everything is
    aggregated by key with partial sums; a host with a third of all pages is a matter of
    its distinct paths only.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("page_id"), ((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).cast("int").alias("bad"))
    known = known.where("page_id is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    rows = parsed_pages(pages).join(known, "page_id", "left")
    sums = [F.count("*").alias("n"), F.count("bad").alias("lab"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")]
    todo = cut(rows.groupBy("host", "segments").agg(*sums).withColumn("template", F.lit("")))
    done, level = [], 0
    while todo.limit(1).count():
        level += 1
        here = todo.withColumn("segment", F.try_element_at("segments", F.lit(level)))
        nodes = here.groupBy("host", "template", "segment").agg(*[F.sum(c).alias(f"{c}_b") for c in ("n", "lab", "bad")], F.count("*").alias("paths"))
        deeper = nodes.where("segment is not null")
        parents = deeper.groupBy("host", "template").agg(*[F.sum(f"{c}_b").alias(f"{c}_p") for c in ("n", "lab", "bad")], F.count("*").alias("children"))
        alone = nodes.groupBy("host", "template").agg((F.sum("paths") == 1).alias("alone"))
        branches = deeper.join(parents, ["host", "template"]).join(alone, ["host", "template"])
        rest = F.col("lab_p") - F.col("lab_b")
        share = F.col("bad_p") / F.col("lab_p")
        error = F.sqrt(share * (1 - share) * (1 / F.col("lab_b") + 1 / rest))
        gap = F.col("bad_b") / F.col("lab_b") - (F.col("bad_p") - F.col("bad_b")) / rest
        alike = F.when((F.col("lab_b") == 0) | (rest == 0), F.lit(True)).when(F.col("bad_p").isin(0) | (F.col("bad_p") == F.col("lab_p")), F.lit(True)).otherwise(F.abs(gap) < s.z * error)
        rare = (F.col("children") > s.many_children) & (F.col("n_b") < s.rare_pages)
        merged = (F.col("children") > 1) & (rare | alike)
        step = branches.select("host", "template", "segment", "alone", F.when(merged, F.lit("*")).otherwise(F.col("segment")).alias("step"))
        moved = here.join(step, ["host", "template", "segment"], "left")
        literal = F.concat(F.lit("/"), F.array_join(F.slice("segments", level, F.size("segments")), "/"))
        ended = F.col("step").isNull() | F.col("alone") | (F.size("segments") <= level)
        template = F.when(F.col("step").isNull(), F.col("template")).otherwise(F.concat("template", F.when(F.col("alone"), literal).otherwise(F.concat(F.lit("/"), "step"))))
        moved = cut(moved.select("host", "segments", "n", "lab", "bad", template.alias("template"), ended.alias("ended")))
        done.append(moved.where("ended").drop("ended"))
        todo = moved.where("not ended").drop("ended")
    tree = reduce(DataFrame.unionAll, done) if done else todo
    total = tree.agg(F.sum("bad").alias("bad"), F.sum("lab").alias("lab")).first()
    overall = (total["bad"] / total["lab"]) if total["lab"] else 0.0
    purity = tree.groupBy("host", "template").agg(((F.sum("bad") + s.prior_weight * F.lit(overall)) / (F.sum("lab") + s.prior_weight)).alias("purity"))
    return tree.select("host", "segments", "template").join(purity, ["host", "template"])


def judged_pages(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, s: Settings = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every page.

    The verdict is the longest fitting rule's; where none fits, "block" if the page's
    template is impure. Null urls and urls without "://" have an empty host and path,
    which make a template of their own. Labels are those of the page's id; a null id
    has none. Repeated rows are judged alike; an empty table gives no rows.
    """
    tree = template_tree(pages, labels, s)
    rule, ruled = rule_for(F.col("host"), F.col("path"), rules)
    rows = parsed_pages(pages).join(tree, ["host", "segments"], "left")
    found = F.when(F.col("purity") >= s.reject, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(ruled, found).alias("verdict"), "template", F.round("purity", 6).alias("purity"))
