"""Pieces of DuckDB SQL that mean the same as functions.text and operators."""

from __future__ import annotations

from loomsieve.functions import patterns as P


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(P.STRIP)}, '', 'g')"


def blank(x: str) -> str:
    return f"NOT coalesce(regexp_matches({x}, {q(P.NOT_SPACE)}), false)"


def task(x: str) -> str:
    return f"regexp_replace(lower({strip(x)}), '[ -]+', '_', 'g')"


def general(x: str) -> str:
    return f"regexp_replace({strip(f'nfc_normalize({x})')}, {q(P.SPACE + '+')}, ' ', 'g')"


def hash_form(x: str) -> str:
    return f"lower(regexp_replace(nfc_normalize({x}), {q(P.HASH_DROPPED)}, '', 'g'))"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(P.SPACE + '+')}), lambda w: w <> '')"


def first_words(x: str, n: int) -> str:
    return f"array_to_string(list_slice({words(strip(f'nfc_normalize({x})'))}, 1, {n}), ' ')"


def contains_any(x: str, of: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in of) + ")"


def strip_emoji(x: str) -> str:
    return strip(f"regexp_replace({x}, {q(P.EMOJI_WIDE)}, '', 'g')")


def strip_greeting(x: str) -> str:
    inner = strip(f"regexp_replace({x}, {q(P.GREETING)}, '')")
    inner = strip_emoji(inner)
    return f"CASE WHEN {inner} = '' THEN {x} ELSE {inner} END"


def clean_title(x: str) -> str:
    for w in P.FORBIDDEN_WORDS:
        x = strip(f"replace({x}, {q(w)}, '')")
    return strip(f"regexp_replace({x}, {q(P.SPACE + '+')}, ' ', 'g')")


def n(x: str) -> str:
    """Count of rows that hold."""
    return f"CAST(coalesce(sum(CASE WHEN {x} THEN 1 ELSE 0 END), 0) AS BIGINT)"


def edits(a: str, b: str) -> str:
    """Edit distance in characters (the builtin counts bytes), row by row."""
    row = f"list_transform(range(1, length({b}) + 1), lambda v: [v])"
    inner = f"list_reduce({row}, lambda acc, j: list_append(acc, least(acc[j[1]] + 1, prev[j[1] + 1] + 1, prev[j[1]] + CASE WHEN substring({a}, i[1], 1) = substring({b}, j[1], 1) THEN 0 ELSE 1 END)), i)"
    return f"list_reduce(list_transform(range(1, length({a}) + 1), lambda v: [v]), lambda prev, i: {inner}, range(0, length({b}) + 1))[-1]"


RECORDS = f"""rec AS (SELECT * REPLACE ({task('task_type')} AS task_type) FROM generate_data_v3),
txt AS (SELECT *, CASE WHEN task_type = 'response' THEN coalesce(comment, '') || chr(10) || coalesce(next_question_rephrased, '')
  WHEN task_type IN ('intro', 'first_question', 'ending') THEN coalesce(message, '') WHEN task_type = 'retry' THEN coalesce(retry_message, '')
  WHEN task_type = 'title' THEN coalesce(title, '') ELSE '' END AS text,
  CASE WHEN task_type = 'response' THEN coalesce(comment, '') WHEN task_type IN ('intro', 'first_question', 'ending') THEN coalesce(message, '')
  WHEN task_type = 'retry' THEN coalesce(retry_message, '') WHEN task_type = 'title' THEN coalesce(title, '') ELSE '' END AS quality_text FROM rec)"""

KEPT = f"""{RECORDS},
hashed AS (SELECT *, sha256({hash_form('text')}) AS hash, {general('text')} AS norm FROM txt),
kept AS MATERIALIZED (SELECT * FROM hashed WHERE NOT ({blank('text')}) QUALIFY row_number() OVER (PARTITION BY hash ORDER BY ord) = 1)"""

LINKS = f"""{KEPT},
tok AS (SELECT ord AS id, task_type AS task, {words('norm')} AS w, CASE WHEN task_type = 'retry' THEN 3 ELSE 5 END AS n, CASE WHEN task_type = 'retry' THEN 0.75 ELSE 0.7 END AS t
  FROM kept WHERE task_type IN ('response', 'intro', 'first_question', 'ending', 'retry')),
sh AS (SELECT id, task, t, list_distinct(list_transform(range(1, greatest(len(w) - n + 1, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + n - 1), ' '))) AS s FROM tok WHERE len(w) > 0),
un AS (SELECT id, task, unnest(s) AS x FROM sh),
com AS (SELECT a.task, a.id AS a, b.id AS b, count(*) AS c FROM un a JOIN un b ON a.task = b.task AND a.x = b.x AND a.id < b.id GROUP BY ALL),
jac AS (SELECT com.task, com.a, com.b, com.c / (len(p.s) + len(r.s) - com.c) AS jaccard, p.t FROM com JOIN sh p ON p.id = com.a JOIN sh r ON r.id = com.b),
near AS MATERIALIZED (SELECT task, a, b, jaccard FROM jac WHERE jaccard >= t - 1e-9),
ttl AS (SELECT ord AS id, norm FROM kept WHERE task_type = 'title'),
cnd AS (SELECT p.id AS a, r.id AS b, p.norm AS x, r.norm AS y FROM ttl p JOIN ttl r ON p.id < r.id AND abs(length(p.norm) - length(r.norm)) <= 2 AND levenshtein(p.norm, r.norm) <= 8),
edit AS MATERIALIZED (SELECT a, b, distance FROM (SELECT a, b, {edits('x', 'y')} AS distance FROM cnd) WHERE distance <= 2)"""


def greedy(links: str) -> str:
    """CTEs that end in gone (id): rows removed in order; ``links`` selects a, b."""
    return f"""lk AS (SELECT DISTINCT a, b FROM ({links})),
nb AS MATERIALIZED (SELECT b AS id, list(a) AS before, row_number() OVER (ORDER BY b) AS k FROM lk GROUP BY b),
walk AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS removed
  UNION ALL SELECT nb.k, CASE WHEN len(list_filter(nb.before, lambda x: NOT list_contains(walk.removed, x))) > 0 THEN list_append(walk.removed, nb.id) ELSE walk.removed END
  FROM walk JOIN nb ON nb.k = walk.k + 1),
gone AS (SELECT unnest(removed) AS id FROM walk WHERE k = (SELECT max(k) FROM walk))"""


GONE = f"{LINKS}, {greedy('SELECT a, b FROM near UNION SELECT a, b FROM edit')}"

SPLIT_RECORDS = f"{RECORDS}, spl AS (SELECT *, lower(trim(split)) AS sp, regexp_replace(base_seed_id, {q(P.VERSION_ENDINGS)}, '') AS base FROM txt)"
