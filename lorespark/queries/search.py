"""Queries of retrieval, ranking and evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.functions.text import tokens
from lorespark.functions.vectors import cosine
from lorespark.operators import orchestrate as O
from lorespark.operators import retrieval as R
from lorespark.operators.index import StoredIndex, fingerprint
from lorespark.operators.scan import nearest
from lorespark.queries.base import query, sql_tokens
from lorespark.queries.text import embed_sql
from lorespark.session import checkpoint_folder, table
from lorespark.sources import adapters as A

QUESTIONS = (
    ("q1", "the idiot and the clown"),
    ("q2", "worthless password email"),
    ("q3", "que la des"),
    ("q4", "nothing matches zzzzzz"),
    ("q5", "which nations depend on europe and the idiot"),
)
_VALUES = "qs(query_id, question) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in QUESTIONS) + ")"


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUESTIONS), "query_id string, question string")


# BM25+ in SQL: terms of the questions, their frequencies in titles (twice) and bodies, and the scores
BM25 = f"""{A.DOCUMENTS_SQL}, {_VALUES},
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({sql_tokens('question')}) AS term FROM qs) GROUP BY ALL),
dt AS MATERIALIZED (SELECT id, {sql_tokens('title')} AS t, {sql_tokens('body')} AS b FROM docs),
st AS (SELECT count(*) AS n, greatest(avg(len(t) + len(b)), 1) AS avgdl FROM dt),
tf AS (SELECT id, dl, term, sum(w) AS tf FROM (SELECT id, len(t) + len(b) AS dl, unnest(t) AS term, 2 AS w FROM dt UNION ALL SELECT id, len(t) + len(b), unnest(b), 1 FROM dt) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT query_id, id, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1.0) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) + 1.0)) AS raw FROM tf JOIN df USING (term) JOIN qt USING (term), st GROUP BY ALL),
kw AS (SELECT query_id, id, title, left(body, 80) AS snippet, round(raw * confidence / 100.0, 9) AS score, 'keyword' AS source FROM bm JOIN docs USING (id) WHERE raw > 0)"""


@query(f"WITH {BM25}, r AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, title, id) AS rank FROM kw) SELECT query_id, id, round(score, 6) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 20")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the stored index of the table, which the first call of a session makes."""
    found = _index(spark, sf_dir).search(questions(spark), 20)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.documents(spark, sf_dir).select("id", F.col("doc_type").alias("source"), "title", "body", "confidence")


def _index(spark: SparkSession, sf_dir: str) -> StoredIndex:
    return StoredIndex.of(spark, fingerprint(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), _indexed(spark, sf_dir))


_RENEWED_DOCS = "docs AS (SELECT * REPLACE (CASE WHEN doc_type = 'src3' THEN title ELSE body END AS body) FROM docs0 WHERE doc_id % 20 <> 0)"


@query(
    f"WITH {BM25.replace(A.DOCUMENTS_SQL, A.DOCUMENTS_SQL.replace('docs AS', 'docs0 AS', 1) + ', ' + _RENEWED_DOCS)}"
    ", r AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, title, id) AS rank FROM kw) SELECT query_id, id, round(score, 6) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 20"
)
def bm25_after_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of all documents of which one source is replaced by its documents' titles and every twentieth document is removed, then compacted."""
    docs = _indexed(spark, sf_dir)
    index = StoredIndex.create(docs, f"{checkpoint_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}")
    index.replace(docs.where("source = 'src3'").withColumn("body", F.col("title")))
    index.remove(A.documents(spark, sf_dir).where("doc_id % 20 = 0").select("id"))
    before = index.search(questions(spark), 20)
    index.compact()
    after = index.search(questions(spark), 20)
    return before.intersect(after).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH t AS (SELECT doc_id, unnest(list_distinct({sql_tokens('text')})) AS term FROM documents) SELECT term, count(*)::BIGINT AS df FROM t GROUP BY term")
def bm25_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))


_COS = "list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


@query(f"WITH q AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q, vec_id, round({_COS.format(a='e', b='embedding')}, 9) AS sim FROM embeddings, q WHERE vec_id <> q) SELECT q AS query_id, vec_id, round(sim, 6) AS sim, row_number() OVER (PARTITION BY q ORDER BY sim DESC, vec_id)::INTEGER AS rank FROM s QUALIFY rank <= 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest others of every vector whose id is divisible by 20, among all."""
    v = A.vectors(spark, sf_dir)
    near = nearest(v.select(F.col("vec_id").alias("id"), "embedding"), v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10, apart=True)
    return near.select("query_id", F.col("id").alias("vec_id"), F.round("sim", 6).alias("sim"), "rank")


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COS.format(a='a.embedding', b='b.embedding')}, 6) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = A.vectors(spark, sf_dir)
    b = v.select(F.col("vec_id").alias("b"), F.col("embedding").alias("eb"), (F.col("vec_id") - 1).alias("a"))
    return v.select(F.col("vec_id").alias("a"), "embedding").join(b, "a").select("a", "b", F.round(cosine(F.col("embedding"), F.col("eb")), 6).alias("sim"))


def _doc_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents' vectors by id, and a vector for each question."""
    v = A.vectors(spark, sf_dir)
    named = v.select(F.concat(F.lit("doc-"), F.col("vec_id").cast("string")).alias("id"), "embedding")
    return named, v.where("vec_id between 1 and 5").select(F.concat(F.lit("q"), F.col("vec_id").cast("string")).alias("query_id"), "embedding")


_VECTOR = f"""vh AS (SELECT 'q' || q.vec_id AS query_id, d.id, d.title, left(body, 80) AS snippet, round({_COS.format(a='q.embedding', b='e.embedding')} * 5.0 * confidence / 100.0, 9) AS score, 'vector' AS source
FROM embeddings e JOIN docs d ON d.id = 'doc-' || e.vec_id, embeddings q WHERE q.vec_id BETWEEN 1 AND 5 AND {_COS.format(a='q.embedding', b='e.embedding')} >= 0.2)"""
_FUSE = """h AS (SELECT *, CASE source WHEN 'keyword' THEN 0 ELSE 1 END AS list FROM kw UNION ALL SELECT *, 1 FROM vh),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, list ORDER BY score DESC, title, id) AS r FROM h),
fu AS (SELECT query_id, id, any_value(title) AS title, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score, arg_max(source, struct_pack(s := score, l := -list)) AS source FROM rk GROUP BY query_id, id)
SELECT query_id, id, source, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, title, id)::INTEGER AS rank FROM fu QUALIFY rank <= 10"""


@query(f"WITH {BM25}, {_VECTOR}, {_FUSE}")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, query_vectors = _doc_vectors(spark, sf_dir)
    fused = R.search(A.documents(spark, sf_dir), questions(spark), 10, vectors=vectors, query_vectors=query_vectors)
    return fused.select("query_id", "id", "source", F.round("score", 6).alias("score"), "rank")


@query()
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources; the last question asks for relations, so the graph is followed."""
    vectors, query_vectors = _doc_vectors(spark, sf_dir)
    return R.search(A.documents(spark, sf_dir), questions(spark), 10, A.nodes(spark, sf_dir), A.edges(spark, sf_dir), vectors, query_vectors)


_ASKED = (("f1", "Idiot"), ("f2", "ON THE"), ("f3", "no such words zzzzzz"), ("f4", "der"))
_ASKED_SQL = "qf(query_id, question) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _ASKED) + f"), qt AS (SELECT query_id, unnest({sql_tokens('question')}) AS term FROM qf)"


@query(f"WITH {A.DOCUMENTS_SQL}, {_ASKED_SQL}, f AS (SELECT query_id, id FROM qf, docs WHERE contains(lower(title), lower(question)) OR contains(lower(body), lower(question)) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY id) <= 5), ft AS (SELECT query_id, unnest({sql_tokens(chr(39) + chr(39) + ' || title || ' + chr(39) + ' ' + chr(39) + ' || body')}) AS term FROM f JOIN docs USING (id)), "
       f"c AS (SELECT query_id, term, count(*) AS tf FROM ft WHERE length(term) > 2 GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT id, unnest({sql_tokens('title || ' + chr(39) + ' ' + chr(39) + ' || body')}) AS term FROM docs) GROUP BY term), "
       "w AS (SELECT query_id, term, round(tf * ln(((SELECT count(*) FROM docs) - df + 0.5) / (df + 0.5) + 1.0), 9) AS weight FROM c JOIN d USING (term) WHERE (query_id, term) NOT IN (SELECT (query_id, term) FROM qt)) "
       "SELECT query_id, term, round(weight, 6) AS weight, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, term)::INTEGER AS place FROM w QUALIFY place <= 5")  # fmt: skip
def prf_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback from the documents that hold the whole question."""
    docs, qs = A.documents(spark, sf_dir), spark.createDataFrame(list(_ASKED), "query_id string, question string")
    feedback = R.feedback_by_text(docs, qs, 5)
    return R.expansion_terms(docs, feedback, qs, 5).select("query_id", "term", F.round("weight", 6).alias("weight"), "place")


_WORDS = sorted({w for g in R.SYNONYMS for w in g})
_SYN = "sy(term, synonym) AS (VALUES " + ", ".join(f"('{w}', '{s}')" for g in R.SYNONYMS for w in g for s in g if w != s) + ")"


@query(
    f"""WITH w AS (SELECT conv_id || '-' || turn AS query_id, text || ' ' || {_WORDS}[1 + (conv_id * 7 + turn) % {len(_WORDS)}] AS question FROM conversations), {_SYN}, tk AS (SELECT query_id, {sql_tokens('question')} AS t FROM w), e AS (SELECT query_id, unnest(t) AS tok, unnest(range(1, len(t) + 1)) AS pos FROM tk),
s AS (SELECT term, synonym FROM sy), stems AS (SELECT DISTINCT ({sql_tokens('term')})[1] AS stem, synonym, ({sql_tokens('synonym')})[1] AS other FROM s),
f AS (SELECT query_id, other, min(struct_pack(a := pos, s := synonym)) AS m FROM e JOIN stems ON tok = stem WHERE (query_id, other) NOT IN (SELECT (query_id, tok) FROM e) GROUP BY ALL)
SELECT query_id, m.s AS term, row_number() OVER (PARTITION BY query_id ORDER BY m.a, m.s)::INTEGER AS place FROM f QUALIFY place <= 10"""
)
def synonym_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of the conversations as a question, each with a word that has synonyms behind it."""
    turns = table(spark, sf_dir, "conversations")
    word = F.element_at(F.array(*[F.lit(w) for w in _WORDS]), (1 + (F.col("conv_id") * 7 + F.col("turn")) % len(_WORDS)).cast("int"))
    asked = turns.select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.concat_ws(" ", "text", word).alias("question"))
    return R.synonym_terms(asked, R.synonym_table(spark), 10)


@query()
def mmr_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = R.search(A.documents(spark, sf_dir), questions(spark), 40)
    return R.mmr(pool.select("query_id", "id", "title", "snippet", "score", "rank"), 0.7, 10)


_RUNS = f"q AS (SELECT vec_id AS q, embedding AS e, label AS l FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q, l, vec_id, label, round({_COS.format(a='e', b='embedding')}, 9) AS sim FROM embeddings, q WHERE vec_id <> q), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, vec_id) AS rank, (label = l)::INTEGER AS rel FROM s), t AS (SELECT q, count(*) AS n FROM s WHERE label = l GROUP BY q), k AS (SELECT *, sum(rel) OVER (PARTITION BY q ORDER BY rank) AS so_far FROM r WHERE rank <= 50)"
_METRICS = "m AS (SELECT q AS query_id, sum(CASE WHEN rank <= 10 THEN rel ELSE 0 END) / 10.0::DOUBLE AS precision, sum(CASE WHEN rank <= 10 THEN rel ELSE 0 END) / any_value(n)::DOUBLE AS recall, coalesce(max(CASE WHEN rel = 1 THEN 1.0::DOUBLE / rank END), 0) AS rr, sum(CASE WHEN rank <= 10 AND rel = 1 THEN 1 / log2(rank + 1) ELSE 0 END) / any_value(list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1)))) AS ndcg, sum(CASE WHEN rel = 1 THEN so_far / rank::DOUBLE ELSE 0 END) / any_value(n) AS ap FROM k JOIN t USING (q) GROUP BY q)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = A.vectors(spark, sf_dir)
    qs = v.where("vec_id % 20 = 0")
    near = nearest(v.select(F.col("vec_id").alias("id"), "embedding"), qs.select(F.col("vec_id").alias("query_id"), "embedding"), 50, apart=True)
    runs = near.select("query_id", "rank", F.col("id").alias("item"))
    return R.class_metrics(runs, qs.select(F.col("vec_id").alias("query_id"), "label"), v.select(F.col("vec_id").alias("item"), "label"), 10)


@query(f"WITH {_RUNS}, {_METRICS} SELECT query_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(rr, 6) AS rr, round(ndcg, 6) AS ndcg, round(ap, 6) AS ap FROM m")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select("query_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "rr", "ndcg", "ap")])


@query(f"WITH {_RUNS}, {_METRICS} SELECT count(*)::BIGINT AS n, round(avg(rr), 6) AS mrr, round(avg(ap), 6) AS map FROM m")
def eval_mrr_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("ap"), 6).alias("map"))


def _memory_sql() -> str:
    norm = lambda c: f"CASE WHEN max({c}) OVER s - min({c}) OVER s < 1.1920929e-07 THEN 1.0 ELSE ({c} - min({c}) OVER s) / (max({c}) OVER s - min({c}) OVER s) END"
    return f"""WITH r AS (SELECT conv_id AS session, turn AS seq, text, role FROM conversations), {embed_sql("r", "session, seq")},
n AS (SELECT session, seq, sqrt(sum(v * v)) AS norm FROM s GROUP BY ALL), f AS (SELECT session, min(seq) AS seq FROM r GROUP BY session),
q AS (SELECT s.session, component, v, norm FROM s JOIN f USING (session, seq) JOIN n USING (session, seq)),
c AS (SELECT s.session, s.seq, sum(s.v * q.v) / any_value(n.norm * q.norm) AS sim FROM s JOIN q ON s.session = q.session AND s.component = q.component JOIN n ON n.session = s.session AND n.seq = s.seq GROUP BY ALL),
m AS (SELECT session, seq, CASE role WHEN 'assistant' THEN 0.9 WHEN 'user' THEN 0.5 ELSE 0.2 END::DOUBLE AS importance, round(greatest(0.0, least(1.0, coalesce(CASE WHEN isfinite(sim) THEN sim END, 0.0))), 9)::DOUBLE AS relevance FROM r LEFT JOIN c USING (session, seq)),
a AS (SELECT *, pow(0.9::DOUBLE, max(seq) OVER (PARTITION BY session) - seq) AS recency FROM m),
x AS (SELECT session, seq, round({norm('recency')} + {norm('importance')} + {norm('relevance')}, 9) AS score FROM a WINDOW s AS (PARTITION BY session))
SELECT session, seq, round(score, 6) AS score, row_number() OVER (PARTITION BY session ORDER BY score DESC, seq)::INTEGER AS place FROM x QUALIFY place <= 3"""


@query(_memory_sql())
def memory_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each session recalls for its first turn, asked as a question: recency, importance and the likeness of hashed embeddings."""
    turns = A.turns(spark, sf_dir).withColumn("importance", F.when(F.col("role") == "assistant", 0.9).when(F.col("role") == "user", 0.5).otherwise(0.2))
    asked = turns.groupBy("session").agg(F.min_by("body", "seq").alias("question"))
    m = O.recalled(turns.select("session", "seq", "importance", F.col("body").alias("text")), asked)
    return O.recall(m, 3).select("session", "seq", F.round("score", 6).alias("score"), "place")


@query("SELECT conv_id AS session, count(*)::BIGINT AS n, max(turn)::BIGINT AS last_seq, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id")
def session_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.turns(spark, sf_dir).groupBy("session").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"), F.max_by("role", "seq").alias("last_role"))
