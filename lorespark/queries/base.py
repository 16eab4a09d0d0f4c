"""Registry of the library's queries: each a function of (spark, sf_dir) and, where SQL can say it, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# SQL pieces that mirror lorespark.functions.text
NOT_ALNUM = r"[^\p{L}\p{M}\p{N}]"


def sql_stem(w: str) -> str:
    return (
        f"CASE WHEN {w} LIKE '%ies' THEN (CASE WHEN {w} LIKE '%eies' OR {w} LIKE '%aies' THEN {w} ELSE left({w}, length({w}) - 3) || 'y' END) "
        f"WHEN {w} LIKE '%es' THEN (CASE WHEN {w} LIKE '%aes' OR {w} LIKE '%ees' OR {w} LIKE '%oes' THEN {w} ELSE left({w}, length({w}) - 1) END) "
        f"WHEN {w} LIKE '%s' THEN (CASE WHEN {w} LIKE '%us' OR {w} LIKE '%ss' THEN {w} ELSE left({w}, length({w}) - 1) END) ELSE {w} END"
    )


def sql_tokens(text: str) -> str:
    return f"list_filter(list_transform(list_filter(regexp_split_to_array(lower({text}), '{NOT_ALNUM}+'), lambda x: x <> ''), lambda x: {sql_stem('x')}), lambda x: length(x) > 1)"


def sql_trim(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def sql_any(text: str, parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in parts) + ")"


def mentions_sql(rows: str, leading_stop_words: frozenset[str]) -> str:
    """mentions (id, sentence, place, entity, gap) of the bodies of ``rows`` (id, body), by windows over words."""
    stop = ", ".join(f"'{w}'" for w in sorted(leading_stop_words))
    return rf"""ms AS (SELECT id, unnest(s) AS s, generate_subscripts(s, 1) - 1 AS sentence FROM (SELECT id, list_filter(list_transform(regexp_split_to_array(body, '[.!?\n;]'), lambda x: {sql_trim('x')}), lambda x: x <> '') AS s FROM {rows})),
mw AS (SELECT id, sentence, unnest(w) AS w, generate_subscripts(w, 1) AS k FROM (SELECT id, sentence, list_transform(regexp_split_to_array(s, '\s+'), lambda x: regexp_replace(x, '^{NOT_ALNUM}+|{NOT_ALNUM}+$', '', 'g')) AS w FROM ms)),
mf AS (SELECT *, length(w) > 1 AND regexp_matches(w, '^\p{{Lu}}') AS e, sum(CASE WHEN length(w) > 1 AND regexp_matches(w, '^\p{{Lu}}') THEN 0 ELSE 1 END) OVER (PARTITION BY id, sentence ORDER BY k) AS r FROM mw),
mr AS (SELECT id, sentence, r, min(k) FILTER (w NOT IN ({stop})) AS a, max(k) AS b FROM mf WHERE e GROUP BY ALL HAVING a IS NOT NULL),
me AS (SELECT id, sentence, a, b, string_agg(w, ' ' ORDER BY k) AS entity FROM mr JOIN mf USING (id, sentence, r) WHERE e AND k >= a GROUP BY ALL),
mp AS (SELECT *, lag(b) OVER (PARTITION BY id, sentence ORDER BY a) AS before, row_number() OVER (PARTITION BY id, sentence ORDER BY a) - 1 AS place FROM me),
mg AS (SELECT p.id, p.sentence, p.place, string_agg(lower(w), ' ' ORDER BY k) AS gap FROM mp p JOIN mf f ON p.id = f.id AND p.sentence = f.sentence AND k > before AND k < a WHERE NOT e AND w <> '' GROUP BY ALL),
mentions AS (SELECT id, sentence::INTEGER AS sentence, place::INTEGER AS place, entity, coalesce(gap, '') AS gap FROM mp LEFT JOIN mg USING (id, sentence, place))"""
