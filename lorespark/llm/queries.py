"""The queries of this subpackage, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm import cluster, decontaminate, language, near, pack, ppm, quality, runs, shard, substring, toxicity, urls, webp
from lorespark.llm.frames import table

SHARDS = 8


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = shard.sharded_documents(table(spark, sf_dir, "documents"), SHARDS)
    return made.withColumn("grown_shard", F.lit(None).cast("int"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.media_features(webp.stored_media(table(spark, sf_dir, "documents")))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_classes(table(spark, sf_dir, "documents"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=True)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.clustered_vectors(table(spark, sf_dir, "embeddings"))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predicted_languages(table(spark, sf_dir, "documents"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_shard, op2_url_filter, op3_toxicity, op4_media, op5_substring_dedup, op6_near_dedup, op7_lm_score, op8_pack, op9_decontaminate, op10_quality, op11_cluster, op12_language, op13_runs)
    return {f.__name__: f for f in made}


SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws FROM documents),
w AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) i FROM d WHERE len(ws) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) h FROM w),
m AS (SELECT h, min(doc_id) lo FROM h GROUP BY h),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) p FROM h JOIN m USING (h) WHERE lo < doc_id),
k AS (SELECT doc_id, list(p) gone FROM r GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda x, j: NOT list_contains(gone, j)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


def url_sql(s: urls.Settings = urls.DEFAULT, levels: int = 12) -> str:
    """The same tree in SQL, for paths of at most ``levels`` segments: one pair of steps for each level."""
    parts = [
        rf"""p0 AS (SELECT page_id, CASE WHEN coalesce(strpos(url, '://'), 0) > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p1 AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM p0),
p2 AS (SELECT page_id, translate(h, '{urls.UPPER}', '{urls.LOWER}') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM p1),
p3 AS (SELECT *, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE
  WHEN regexp_matches(x, '^[0-9]+(\.[A-Za-z]+)?$') THEN '{{n}}'
  WHEN regexp_matches(x, '^[0-9a-fA-F]*[0-9][0-9a-fA-F]*$') AND length(x) >= 8 THEN '{{x}}' ELSE x END) AS al FROM p2),
pg AS (SELECT page_id, host, path, al AS segments FROM p3),
lb AS (SELECT doc_id AS page_id, max(CASE WHEN coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
t0 AS (SELECT host, segments, count(*) AS n, count(bad) AS lab, coalesce(sum(bad), 0) AS bad, '' AS template FROM pg LEFT JOIN lb USING (page_id) GROUP BY host, segments)"""
    ]
    for k in range(1, levels + 1):
        parts.append(
            f"""h{k} AS MATERIALIZED (SELECT *, segments[{k}] AS segment FROM t{k - 1}),
n{k} AS MATERIALIZED (SELECT host, template, segment, sum(n) AS n_b, sum(lab) AS lab_b, sum(bad) AS bad_b FROM h{k} WHERE segment IS NOT NULL GROUP BY ALL),
q{k} AS MATERIALIZED (SELECT host, template, sum(lab_b) AS lab_p, sum(bad_b) AS bad_p, count(*) AS children FROM n{k} GROUP BY ALL),
s{k} AS MATERIALIZED (SELECT host, template, segment, CASE WHEN children > 1 AND ((children > {s.many_children} AND n_b < {s.rare_pages}) OR CASE
  WHEN lab_b = 0 OR lab_p - lab_b = 0 THEN true WHEN bad_p = 0 OR bad_p = lab_p THEN true
  ELSE abs(bad_b / lab_b::DOUBLE - (bad_p - bad_b) / (lab_p - lab_b)::DOUBLE) < {s.z} * sqrt(bad_p / lab_p::DOUBLE * (1 - bad_p / lab_p::DOUBLE) * (1 / lab_b::DOUBLE + 1 / (lab_p - lab_b)::DOUBLE)) END)
  THEN '*' ELSE segment END AS step FROM n{k} JOIN q{k} USING (host, template)),
t{k} AS MATERIALIZED (SELECT h.host, h.segments, h.n, h.lab, h.bad, CASE WHEN step IS NULL THEN h.template ELSE h.template || '/' || step END AS template
  FROM h{k} h LEFT JOIN s{k} s ON h.host = s.host AND h.template = s.template AND h.segment = s.segment)"""
        )
    rules = sorted(urls.RULES, key=lambda r: -len(r[1]))
    fits = lambda r: f"(host = '{r.split('/', 1)[0]}' OR ends_with(host, '.{r.split('/', 1)[0]}')) AND starts_with(path, '/{r.split('/', 1)[1]}')"
    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in rules)
    ruled = " ".join(f"WHEN {fits(r)} THEN '{v}'" for v, r in rules)
    parts.append(
        f"""tt AS (SELECT host, segments, lab, bad, template FROM t{levels}),
ov AS (SELECT coalesce(sum(bad) / nullif(sum(lab), 0)::DOUBLE, 0.0) AS overall FROM tt),
pu AS (SELECT host, template, (sum(bad) + {s.prior_weight} * any_value(overall)) / (sum(lab) + {s.prior_weight}) AS purity FROM tt, ov GROUP BY host, template)"""
    )
    return "WITH " + ",\n".join(parts) + f"""
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {ruled} WHEN purity >= {s.reject} THEN 'block' ELSE 'allow' END AS verdict, template, round(purity, 6) AS purity
FROM pg JOIN tt USING (host, segments) JOIN pu USING (host, template)"""


def cluster_sql(rounds: int = cluster.ROUNDS) -> str:
    """All rounds, one after the other; every centroid is tried for every vector."""
    near = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    floor = "list_transform(range(1, 65), lambda i: ((s[i] - ((s[i] % n) + n) % n) // n)::BIGINT)"
    sums = ", ".join(f"sum(v[{i}])::BIGINT" for i in range(1, 65))
    parts = [
        """kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{cluster.SEED}:' || vec_id), v) - 1 AS k, v AS c FROM kept QUALIFY k < {cluster.CENTROIDS})",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, v, k AS cluster, {near} AS distance FROM kept, c{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, k) = 1)")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT cluster, count(*) AS n, [{sums}] AS s FROM a{r} GROUP BY cluster)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT k, CASE WHEN n IS NULL THEN c ELSE {floor} END AS c FROM c{r} LEFT JOIN s{r} ON k = cluster)")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, cluster::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON k = cluster"""


# A run is a longest stretch of places with w[i] = w[i + q], and q more words; the checksum is made bit by bit.
RUNS_SQL = r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS o, doc_id::VARCHAR AS name FROM documents),
h AS (SELECT doc_id, o, len(o) AS n, xor(4294967295::BIGINT, list_reduce(list_transform(range(1, length(name) + 1), lambda i: ascii(name[i])::BIGINT),
  lambda c, b: list_reduce(range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::BIGINT), xor(c, b)), 4294967295::BIGINT)) AS h FROM t),
g AS (SELECT *, (h // 10) AS g FROM h), a AS (SELECT *, g % greatest(n, 1) AS a FROM g), p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
d AS MATERIALIZED (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: o[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE o END AS w FROM p),
f AS MATERIALIZED (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS x FROM d),
e AS (SELECT l.doc_id, r.i - l.i AS q, l.i FROM f l JOIN f r ON l.doc_id = r.doc_id AND l.x = r.x AND r.i > l.i AND 4 * (r.i - l.i) <= l.n),
k AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e),
m AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM k GROUP BY doc_id, q, island),
u AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS q FROM m WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
b AS (SELECT doc_id, count(*) AS n_runs, arg_min({'s': start, 'm': length, 'q': q}, {'l': -length, 's': start, 'q': q}) AS top, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS listed FROM u GROUP BY doc_id),
x AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(start + q, start + length)) AS i FROM u) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top.s::BIGINT AS start, top.m::BIGINT AS length, top.q::BIGINT AS period, (1000 * top.m // top.q)::BIGINT AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda y, j: NOT list_contains(gone, j - 1)) END, ' ')) AS collapsed_sha256
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN x USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": url_sql(), "op5_substring_dedup": SUBSTRING_SQL, "op11_cluster": cluster_sql(), "op13_runs": RUNS_SQL}
