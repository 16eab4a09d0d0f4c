"""Queries over texts: functions, chunking, extraction, upkeep, checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions import tables
from lorespark.functions import text as T
from lorespark.functions import vectors as V
from lorespark.operators import corpus as C
from lorespark.operators import retrieval as R
from lorespark.operators.session_graph import session_graph
from lorespark.queries.base import NOT_ALNUM, mentions_sql, query, sql_any, sql_stem, sql_tokens, sql_trim
from lorespark.session import checkpoint_folder, cut, table
from lorespark.sources import adapters as A
from lorespark.sources import docfiles

WITH_DOCS = f"WITH {A.DOCUMENTS_SQL}"


@query(f"WITH t AS (SELECT doc_id, {sql_tokens('text')} AS t FROM documents) SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM t")
def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.concat_ws(" ", "t").cast("binary")).alias("digest"))


@query(f"WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '{NOT_ALNUM}+')) AS word FROM documents) SELECT word, {sql_stem('word')} AS stem FROM w WHERE word <> ''")
def text_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), T.NOT_ALNUM + "+")).alias("word")).distinct()
    return words.where("word <> ''").select("word", T.s_stem(F.col("word")).alias("stem"))


@query(f"WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n;]'), lambda x: {sql_trim('x')}), lambda x: x <> '') AS s FROM documents) SELECT doc_id, len(s)::BIGINT AS n, md5(array_to_string(s, '|')) AS digest FROM s")
def text_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.concat_ws("|", "s").cast("binary")).alias("digest"))


_STOP = ", ".join(f"'{w}'" for w in T.KEYWORD_STOP_WORDS)


@query(f"{WITH_DOCS}, w AS (SELECT id, unnest(list_transform(regexp_split_to_array(body, '{NOT_ALNUM}'), lambda x: lower(x))) AS word FROM docs), c AS (SELECT id, word, count(*)::BIGINT AS n FROM w WHERE octet_length(encode(word)) >= 4 AND word NOT IN ({_STOP}) GROUP BY ALL) SELECT id, word, n, row_number() OVER (PARTITION BY id ORDER BY n DESC, word)::INTEGER AS place FROM c QUALIFY place <= 5")
def text_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.keywords(A.documents(spark, sf_dir), 5)


@query(
    f"WITH t AS (SELECT doc_id, {sql_trim('text')} AS t FROM documents), h AS (SELECT doc_id, t, length(regexp_extract(left(t, 120), '(?s)^.*[.!?。]')) AS c FROM t) "
    r"SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE regexp_replace(left(t, CASE WHEN c > 0 AND c >= 60 THEN c ELSE 120 END), '\s+$', '') || '…' END AS summary FROM h"
)
def text_summarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.summarize(F.col("text"), 120).alias("summary"))


@query(f"{WITH_DOCS} SELECT id, title FROM docs WHERE contains(lower(title), 'idiot') OR contains(lower(body), 'idiot')")
def store_scan_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.substring_scan(A.documents(spark, sf_dir), "Idiot").select("id", "title")


@query("WITH s AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY (doc_id % 2) DESC, doc_id DESC) AS n FROM documents) SELECT source, doc_id, n_chars FROM s WHERE n = 1")
def store_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return R.upsert(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "doc_id", "source")


_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, octet_length(encode(w)) + 1), lambda i: ('0x' || substr(hex(encode(w)), (2 * i - 1)::INTEGER, 2))::BIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296)"


@query(f"WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[ \\n]+')) AS w FROM documents) SELECT w AS word, {_FNV} AS hash FROM w WHERE w <> ''")
def fnv32(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "[ \n]+")).alias("word")).distinct().where("word <> ''")
    return words.select("word", V.fnv1a_32(F.col("word")).alias("hash"))


def embed_sql(rows: str, key: str) -> str:
    """s (key, component, v) and norms of the hashing embedder over the texts of ``rows``; each distinct token is hashed once."""
    return f"""t AS (SELECT {key}, unnest(list_transform(list_filter(regexp_split_to_array(text, '{NOT_ALNUM}+'), lambda x: octet_length(encode(x)) > 1), lambda x: lower(x))) AS w FROM {rows}),
h AS MATERIALIZED (SELECT w, {_FNV} AS h FROM (SELECT DISTINCT w FROM t)),
s AS MATERIALIZED (SELECT {key}, (h % 64)::INTEGER AS component, sum(CASE WHEN h >= 2147483648 THEN -1 ELSE 1 END)::DOUBLE AS v FROM t JOIN h USING (w) GROUP BY ALL)"""


@query(f"WITH {embed_sql('documents', 'doc_id')} SELECT doc_id, component, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS value FROM s WHERE v <> 0")
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of all documents, as rows of their components that are not 0."""
    vectors = R.embed(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    rows = vectors.select(F.col("id").alias("doc_id"), F.posexplode("embedding").alias("component", "v"))
    return rows.where("v <> 0").select("doc_id", "component", F.round("v", 6).alias("value"))


@query(f"WITH c AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {sql_trim('x')}), lambda x: x <> '') AS c FROM documents) SELECT doc_id, len(c)::BIGINT AS n, md5(array_to_string(c, '|')) AS digest FROM c")
def chunk_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "documents").select("doc_id", T.paragraphs(F.col("text")).alias("c"))
    return c.select("doc_id", F.size("c").cast("long").alias("n"), F.md5(F.concat_ws("|", "c").cast("binary")).alias("digest"))


@query(
    f"""WITH b AS (SELECT doc_id, list_filter(list_transform(range(1, length(text) + 1, 400), lambda i: substr(text, i::INTEGER, 400)), lambda x: {sql_trim('x')} <> '') AS c FROM documents),
o AS (SELECT doc_id, list_transform(c, lambda x, i: CASE WHEN i = 1 THEN x ELSE right(c[i - 1], 40) || ' ' || x END) AS c FROM b) SELECT doc_id, len(c)::BIGINT AS n, md5(array_to_string(c, '|')) AS digest FROM o"""
)
def chunk_fixed_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "documents").select("doc_id", T.fixed_chunks(F.col("text"), 400).alias("c")).withColumn("c", T.with_overlap(F.col("c"), 40))
    return c.select("doc_id", F.size("c").cast("long").alias("n"), F.md5(F.concat_ws("|", "c").cast("binary")).alias("digest"))


@query()
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_rows(A.documents(spark, sf_dir), "recursive", 800, 80)


@query()
def chunk_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_rows(A.documents(spark, sf_dir), "adaptive", 800)


@query()
def sql_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``chunk_recursive``, by a table function in SQL."""
    tables.register(spark)
    docs = A.documents(spark, sf_dir)
    return spark.sql("SELECT d.id, c.at, c.chunk FROM {docs} d, LATERAL text_chunks(d.body, how => 'recursive', size => 800, overlap => 80) c", docs=docs)


@query(f"WITH c AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {sql_trim('x')}), lambda x: x <> '') AS c FROM documents), u AS (SELECT doc_id, unnest(c) AS chunk, generate_subscripts(c, 1) - 1 AS place FROM c) SELECT doc_id, place::INTEGER AS place, sha256(chunk) AS digest, length(chunk)::INTEGER AS n_chars FROM u")
def sql_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(spark)
    docs = table(spark, sf_dir, "documents")
    return spark.sql("SELECT d.doc_id, c.at AS place, sha2(c.chunk, 256) AS digest, char_length(c.chunk) AS n_chars FROM {docs} d, LATERAL text_chunks(d.text, how => 'paragraph') c", docs=docs)


@query(
    "SELECT l_orderkey AS key, l_linenumber AS line, 0 AS place, l_quantity::BIGINT || ' * 2 = ' || l_quantity::BIGINT * 2 AS equation, true AS holds FROM lineitem "
    "UNION ALL SELECT l_orderkey, l_linenumber, 1, l_linenumber || ' + ' || l_suppkey || ' = ' || l_linenumber + l_suppkey + CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END, l_partkey % 5 <> 0 FROM lineitem"
)
def sql_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both equations that are written for each line."""
    tables.register(spark)
    quantity, line, supplier = F.col("l_quantity").cast("long"), F.col("l_linenumber"), F.col("l_suppkey")
    total = line + supplier + F.when(F.col("l_partkey") % 5 == 0, 1).otherwise(0)
    claims = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.format_string("%d * 2 = %d; %d + %d = %d", quantity, quantity * 2, line, supplier, total).alias("claim"))
    return spark.sql(
        "SELECT l_orderkey AS key, l_linenumber AS line, e.place, e.equation, e.holds FROM (SELECT l_orderkey, l_linenumber, equations_in(claim) AS found FROM {claims}) "
        "LATERAL VIEW OUTER inline(found) e AS place, equation, holds WHERE e.place IS NOT NULL",
        claims=claims,
    )


@query(f"{WITH_DOCS}, k AS (SELECT id, row_number() OVER (PARTITION BY doc_type, title, body ORDER BY confidence DESC, id) AS n FROM docs WHERE confidence >= 20) SELECT id, 'low_confidence' AS reason FROM docs WHERE confidence < 20 UNION ALL SELECT id, 'duplicate' FROM k WHERE n > 1")
def gc_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.garbage(A.documents(spark, sf_dir), min_confidence=20)


@query(f"{WITH_DOCS}, k AS (SELECT id, title, confidence, row_number() OVER (PARTITION BY doc_type, title, body ORDER BY confidence DESC, id) AS n FROM docs) SELECT id, title, confidence FROM k WHERE n = 1")
def gc_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.documents(spark, sf_dir)
    return docs.join(C.garbage(docs), "id", "left_anti").select("id", "title", "confidence")


@query(
    f"{WITH_DOCS}, w AS (SELECT id, unnest(list_transform(regexp_split_to_array(body, '{NOT_ALNUM}'), lambda x: lower(x))) AS word FROM docs WHERE length(body) > 1000), "
    f"c AS (SELECT id, word, count(*) AS n FROM w WHERE octet_length(encode(word)) >= 4 AND word NOT IN ({_STOP}) GROUP BY ALL), "
    "k AS (SELECT id, word, row_number() OVER (PARTITION BY id ORDER BY n DESC, word) AS place FROM c QUALIFY place <= 5), l AS (SELECT id, string_agg(word, ',' ORDER BY place) AS concepts FROM k GROUP BY id), "
    f"x AS (SELECT id, body, {sql_trim('body')} AS t FROM docs), h AS (SELECT id, body, t, length(regexp_extract(left(t, 1000), '(?s)^.*[.!?。]')) AS c FROM x) "
    r"SELECT id, length(body) > 1000 AS due, CASE WHEN length(body) > 1000 THEN coalesce(concepts, '') END AS concepts, CASE WHEN length(body) > 1000 THEN length(body)::VARCHAR END AS original_len, "
    r"md5(CASE WHEN length(body) <= 1000 THEN body WHEN length(t) <= 1000 THEN t ELSE regexp_replace(left(t, CASE WHEN c > 0 AND c >= 500 THEN c ELSE 1000 END), '\s+$', '') || '…' END) AS body FROM h LEFT JOIN l USING (id)"
)
def consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.consolidate(A.documents(spark, sf_dir), 1000)
    return out.select("id", "due", F.col("metadata")["concepts"].alias("concepts"), F.col("metadata")["original_len"].alias("original_len"), F.md5(F.col("body").cast("binary")).alias("body"))


_BODY = "SELECT doc_id, text AS body FROM documents"


@query(f"SELECT conv_id, turn, CASE WHEN {sql_trim('text')} = '' THEN 'fail' ELSE 'pass' END AS status FROM conversations")
def verify_non_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", C.check_non_empty(F.col("text"))["status"].alias("status"))


@query(
    rf"""WITH w AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array({sql_trim('text')}, '\s+'), lambda x: lower(regexp_replace(x, '^{NOT_ALNUM}+|{NOT_ALNUM}+$', '', 'g'))), lambda x: x <> '') AS w FROM documents),
e AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS i FROM w), g AS (SELECT doc_id, i, t, i - row_number() OVER (PARTITION BY doc_id, t ORDER BY i) AS grp FROM e),
r AS (SELECT doc_id, max(n) AS run FROM (SELECT doc_id, t, grp, count(*) AS n FROM g GROUP BY ALL) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_tokens, coalesce(run, 0)::BIGINT AS longest_run, CASE WHEN len(w) = 0 THEN 'skip' WHEN run > 6 THEN 'fail' WHEN len(w) >= 12 AND len(list_distinct(w)) / len(w)::DOUBLE < 0.25 THEN 'fail' ELSE 'pass' END AS status FROM w LEFT JOIN r USING (doc_id)"""
)
def verify_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", C.repetition_words(F.col("text")).alias("w"))
    runs = words.select("doc_id", "w", C.longest_run(F.col("w")).alias("run"))
    return runs.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.col("run").cast("long").alias("longest_run"), C.repetition_verdict(F.col("w"), F.col("run"))["status"].alias("status"))


_CITED = "text || CASE WHEN doc_id % 3 = 0 THEN ' see [' || (doc_id % 5) || ']' || chr(10) || '[' || (doc_id % 4) || '] source' ELSE '' END"


@query(
    rf"""WITH c AS (SELECT doc_id, {_CITED} AS t FROM documents), x AS (SELECT doc_id, list_distinct(regexp_extract_all(t, '\[([0-9]+)\]', 1)) AS refs, list_distinct(regexp_extract_all(t, '(?m)^\s*\[([0-9]+)\]', 1)) AS defs FROM c)
SELECT doc_id, CASE WHEN len(refs) = 0 THEN 'skip' WHEN len(list_filter(refs, lambda r: NOT list_contains(defs, r))) > 0 THEN 'fail' ELSE 'pass' END AS status FROM x"""
)
def verify_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = F.concat("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" see ["), (F.col("doc_id") % 5).cast("string"), F.lit("]\n["), (F.col("doc_id") % 4).cast("string"), F.lit("] source"))).otherwise(F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", C.check_citations(cited)["status"].alias("status"))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'begin private key') THEN 'forbidden content: begin private key' WHEN contains(lower(text), 'password=') THEN 'forbidden content: password=' WHEN contains(lower(text), 'api_key=') THEN 'forbidden content: api_key=' END AS reason FROM documents")
def verify_forbidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", C.check_forbidden(F.col("text"))["reason"].alias("reason"))


@query(
    rf"""WITH t AS (SELECT event_id, {sql_trim('props')} AS t FROM events), b AS (SELECT event_id, t, regexp_replace(regexp_replace(t, '"(?:[^"\\]|\\.)*(?:"|\\?$)', '', 'gs'), '[^\[\]{{}}]', '', 'g') AS b FROM t),
p AS (SELECT event_id, b, unnest(range(1, length(b) + 1)) AS i FROM b WHERE left(t, 1) IN ('{{', '[')), c AS (SELECT event_id, i, substr(b, i::INTEGER, 1) AS c FROM p),
d AS (SELECT *, sum(CASE WHEN c IN ('{{', '[') THEN 1 ELSE -1 END) OVER (PARTITION BY event_id ORDER BY i) AS depth FROM c),
o AS (SELECT *, lag(c) OVER (PARTITION BY event_id, depth + CASE WHEN c IN ('{{', '[') THEN 0 ELSE 1 END ORDER BY i) AS opener FROM d),
e AS (SELECT event_id, first(CASE WHEN depth < 0 THEN 'unbalanced closing delimiter' ELSE 'mismatched closing delimiter' END ORDER BY i) AS reason FROM o WHERE c IN (']', '}}') AND (depth < 0 OR opener <> CASE c WHEN ']' THEN '[' ELSE '{{' END) GROUP BY event_id),
l AS (SELECT event_id, first(depth ORDER BY i DESC) AS depth FROM d GROUP BY event_id),
r AS (SELECT event_id, t, coalesce(reason, CASE WHEN depth > 0 THEN 'unbalanced delimiters' END) AS reason FROM t LEFT JOIN e USING (event_id) LEFT JOIN l USING (event_id))
SELECT event_id, CASE WHEN left(t, 1) NOT IN ('{{', '[') OR t IS NULL THEN 'skip' WHEN reason IS NULL THEN 'pass' ELSE 'fail' END AS status, reason FROM r"""
)
def verify_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", C.check_json(F.col("props")).alias("v")).select("event_id", "v.status", "v.reason")


@query("SELECT CASE WHEN l_orderkey % 7 = 0 THEN 'fail' ELSE 'pass' END AS status, count(*) AS n FROM lineitem GROUP BY ALL")
def verify_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    claim = F.concat(F.col("quantity").cast("string"), F.lit(" * 2 = "), (F.col("quantity") * 2 + F.when(F.col("key") % 7 == 0, 1).otherwise(0)).cast("string"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("long").alias("quantity"))
    return lines.select("key", "line", C.check_arithmetic(claim).alias("v")).groupBy("v.status").agg(F.count("*").alias("n"))


@query()
def verify_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.run_checks(A.documents(spark, sf_dir)).groupBy("check", "status").agg(F.count("*").alias("n"))


_MENTIONS = f"{WITH_DOCS}, {mentions_sql('docs', C.LEADING_STOP_WORDS)}"
_ORGANISATIONS = ", ".join(f"'{w}'" for w in T.ORGANISATION_WORDS)
_RELATION = "CASE " + " ".join(f"WHEN {sql_any('gap', parts)} THEN '{kind}'" for kind, parts in T.RELATION_PARTS) + " ELSE 'related_to' END"


def kind_sql(label: str) -> str:
    return rf"CASE WHEN lower(regexp_replace(regexp_extract({label}, '[^\s]+$'), '^{NOT_ALNUM}+|{NOT_ALNUM}+$', '', 'g')) IN ({_ORGANISATIONS}) THEN 'organization' ELSE 'concept' END"


@query(
    f"{_MENTIONS}, per AS (SELECT id, lower(entity) AS name, count(*) AS n, first(entity ORDER BY sentence, place) AS label FROM mentions GROUP BY ALL), "
    "best AS (SELECT name, first(label ORDER BY id) AS label, max(least(45 + (n - 1) * 15, 100))::INTEGER AS confidence FROM per GROUP BY name) "
    f"SELECT name, label, {kind_sql('label')} AS kind, confidence FROM best"
)
def extract_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.extracted_nodes(C.entity_mentions(A.documents(spark, sf_dir)))


@query(
    f"{_MENTIONS}, m AS (SELECT id, sentence, place, lower(entity) AS name, gap FROM mentions), "
    "near AS (SELECT id, sentence, place, name AS src, lead(name) OVER w AS dst, lead(gap) OVER w AS gap FROM m WINDOW w AS (PARTITION BY id, sentence ORDER BY place)), "
    "f AS (SELECT id, sentence, name, min(place) AS place FROM m GROUP BY ALL), "
    f"everything AS (SELECT id, sentence, 0 AS phase, place, src, dst, {_RELATION} AS kind FROM near WHERE dst IS NOT NULL AND src <> dst "
    "UNION ALL SELECT a.id, a.sentence, 1, 0, a.name, b.name, 'related_to' FROM f a JOIN f b ON a.id = b.id AND a.sentence = b.sentence AND a.place < b.place) "
    "SELECT src, dst, first(kind ORDER BY id, sentence, phase, place) AS kind FROM everything GROUP BY src, dst"
)
def extract_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mentions are written once, as the edges read them several times."""
    return C.extracted_edges(cut(C.entity_mentions(A.documents(spark, sf_dir))))


_SESSIONS = f"""WITH runs AS (SELECT conv_id, turn, role, text, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS call, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS last FROM conversations),
parts AS (SELECT {{'s': conv_id, 'c': call, 't': turn}} AS id, text AS body FROM runs UNION ALL SELECT {{'s': conv_id, 'c': last + 1, 't': turn}}, role || '. ' || text FROM runs),
{mentions_sql('parts', C.LEADING_STOP_WORDS)}"""
_NAMED = f"{_SESSIONS}, per AS (SELECT id.s AS conv_id, id.c AS call, lower(entity) AS name, count(*) AS n, first(entity ORDER BY id.t, sentence, place) AS label FROM mentions GROUP BY ALL)"


@query(
    f"{_NAMED}, best AS (SELECT conv_id, name, min(call) AS call, first(label ORDER BY call) AS label, max(least(45 + (n - 1) * 15, 100))::INTEGER AS confidence, count(*) AS n_calls FROM per GROUP BY ALL) "
    f"SELECT b.conv_id, name, label, {kind_sql('label')} AS kind, confidence, n_calls, CASE WHEN b.call > l.last THEN 'session documents' ELSE 'run:' || coalesce(u.text, '') END AS provenance "
    "FROM best b JOIN (SELECT DISTINCT conv_id, last FROM runs) l ON b.conv_id = l.conv_id LEFT JOIN runs u ON u.conv_id = b.conv_id AND u.call = b.call AND u.role = 'user'"
)
def session_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_graph(A.turns(spark, sf_dir)).nodes.withColumnRenamed("session", "conv_id")


@query(
    f"{_SESSIONS}, m AS (SELECT id, sentence, place, lower(entity) AS name, gap FROM mentions), "
    "near AS (SELECT id, sentence, place, name AS src, lead(name) OVER w AS dst, lead(gap) OVER w AS gap FROM m WINDOW w AS (PARTITION BY id, sentence ORDER BY place)), "
    "f AS (SELECT id, sentence, name, min(place) AS place FROM m GROUP BY ALL), "
    f"everything AS (SELECT id, sentence, 0 AS phase, place, src, dst, {_RELATION} AS kind FROM near WHERE dst IS NOT NULL AND src <> dst "
    "UNION ALL SELECT a.id, a.sentence, 1, 0, a.name, b.name, 'related_to' FROM f a JOIN f b ON a.id = b.id AND a.sentence = b.sentence AND a.place < b.place) "
    "SELECT id.s AS conv_id, src, dst, first(kind ORDER BY id.c, id.t, sentence, phase, place) AS kind FROM everything GROUP BY ALL"
)
def session_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_graph(A.turns(spark, sf_dir)).edges.withColumnRenamed("session", "conv_id")


@query(f"{_NAMED}, k AS (SELECT conv_id, call, call = min(call) OVER (PARTITION BY conv_id, name) AS fresh FROM per) SELECT conv_id, call, count(*) FILTER (fresh) AS added, count(*) FILTER (NOT fresh) AS reinforced FROM k GROUP BY ALL")
def session_graph_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_graph(A.turns(spark, sf_dir)).report().withColumnRenamed("session", "conv_id")


@query()
def index_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes all documents over a store that holds coarser passages of them: its passages with vectors, and the graph's nodes with what became of them."""
    from lorespark.api import Workspace

    docs = A.documents(spark, sf_dir)
    old = C.replace_passages(docs, C.passages(docs, 1600, 0))
    made = Workspace(spark, old, A.nodes(spark, sf_dir), A.edges(spark, sf_dir)).index(800, 80)
    vector = F.md5(F.concat_ws(",", F.transform("embedding", lambda x: F.round(x, 6).cast("string"))).cast("binary"))
    stored = made.documents.where("doc_type = 'chunk'").join(made.vectors, "id")
    rows = stored.select("id", F.lit("passage").alias("kind"), F.col("metadata")["source"].alias("source"), F.sha2("body", 256).alias("digest"), F.size(T.tokens(F.col("body"))).cast("long").alias("n_tokens"), vector.alias("vector"), "confidence", F.lit("added").alias("change"))
    null = F.lit(None).cast("string")
    nodes = made.changes.select("id", "kind", null.alias("source"), F.sha2("label", 256).alias("digest"), F.lit(None).cast("long").alias("n_tokens"), null.alias("vector"), "confidence", "change")
    return rows.unionByName(nodes)


@query(f"{WITH_DOCS} SELECT id, sha256(body) AS digest, left(body, 80) AS snippet FROM docs")
def document_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.documents(spark, sf_dir).select("id", F.sha2("body", 256).alias("digest"), T.snippet(F.col("body")).alias("snippet"))


def intent_sql(text: str) -> str:
    any_ = lambda parts: " OR ".join(f"contains(lower({text}), '{p}')" for p in parts)
    cases = " ".join(f"WHEN {any_(parts)} THEN '{kind}'" for kind, parts in T.INTENT_PARTS)
    return f"CASE {cases} WHEN {sql_trim(text)} LIKE '%?' OR {any_(T.QUESTION_PARTS)} THEN 'question' ELSE 'generic' END"


@query(f"SELECT conv_id, turn, {intent_sql('text')} AS class, CASE WHEN {' OR '.join(f'contains(lower(text), {chr(39)}{p}{chr(39)})' for p in T.RELATIONAL_PARTS)} THEN 2 ELSE 1 END AS max_hops FROM conversations")
def plan_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.classify_intent(F.col("text")).alias("class"), T.max_hops(F.col("text")).alias("max_hops"))


@query("WITH u AS (SELECT page_id, CASE WHEN strpos(url, '?') > 0 THEN regexp_extract(url, '\\?([^#]*)', 1) END AS q FROM pages) SELECT page_id, CASE WHEN q IS NULL THEN NULL ELSE nullif(regexp_extract(q, '(?:^|&)ref=([^&]*)', 1), '') END AS ref FROM u")
def form_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorespark.sources.files import form_fields

    q = F.when(F.contains(F.col("url"), F.lit("?")), F.regexp_extract("url", r"\?([^#]*)", 1))
    return table(spark, sf_dir, "pages").select("page_id", F.nullif(form_fields(q)["ref"], F.lit("")).alias("ref"))


@query("""WITH l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id)
SELECT 'doc-' || d.doc_id AS id, coalesce(source, 'note') AS doc_type, coalesce(left(split_part(text, chr(10), 1), 40), '') AS title, sha256(coalesce(text, '')) AS body_sha256, lang AS language, coalesce(quality * 100, 50)::INTEGER AS confidence
FROM documents d LEFT JOIN l USING (doc_id)""")
def document_file_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written as files and read back; a third of them is deleted between and written again."""
    folder = f"{checkpoint_folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    docs = A.documents(spark, sf_dir).withColumn("embedding", F.lit(None).cast("array<float>"))
    docfiles.save(docs, folder)
    third = docs.where(F.crc32(F.col("id").cast("binary")) % 3 == 0)
    docfiles.delete(third, folder)
    docfiles.save(third, folder)
    got, _ = docfiles.load(spark, folder)
    return got.select("id", "doc_type", "title", F.sha2(F.col("body").cast("binary"), 256).alias("body_sha256"), F.col("metadata")["lang"].alias("language"), "confidence")
