"""DuckDB SQL for the problems that SQL can express.

The plain form has a mapping of its own here, by Unicode's classes and compatibility
forms of single characters, so that a mistake of the operator's mapping shows.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

# For each Latin letter the letters of other scripts drawn like it.
DRAWN_LIKE = {
    "A": "ΑАᎪꓮⲀ", "B": "ΒВᏴꓐⲂ", "C": "СᏟꓚⲤ", "D": "Ꭰꓓ", "E": "ΕЕᎬꓰ", "F": "ꓝ", "G": "ԌᏀᏳꓖ", "H": "ΗНᎻꓧⲎ", "I": "ΙІꓲⲒ", "J": "ЈᎫꓙ", "K": "ΚКᏦꓗⲔ", "L": "Ꮮꓡ", "M": "ΜМᎷꓟⲘ",
    "N": "ΝꓠⲚ", "O": "ΟОՕꓳⲞ", "P": "ΡРᏢꓑⲢ", "Q": "Ԛ", "R": "ᎡᏒꓣ", "S": "ЅՏᏕꓢ", "T": "ΤТᎢꓔⲦ", "U": "Սꓴ", "V": "Ꮩꓦ", "W": "ԜᎳᏔꓪ", "X": "ΧХꓫⲬ", "Y": "ΥУᎽꓬⲨ", "Z": "ΖᏃꓜ",
    "a": "αаɑ", "c": "сϲᴄ", "d": "ԁ", "e": "е", "g": "ɡց", "h": "һհ", "i": "ιіı", "j": "јϳ", "k": "κ", "l": "ӏ", "n": "ո", "o": "οоօᴏⲟ", "p": "ρрⲣ", "q": "ԛ", "s": "ѕ", "u": "υս", "v": "νѵᴠ", "w": "ԝᴡ", "x": "χх", "y": "γу", "z": "ᴢ",
}


@cache
def _translation() -> tuple[str, str]:
    to = {c: k for k, of in DRAWN_LIKE.items() for c in of} | {"ⲥ": "c"}
    for o in (*range(0xA0, 0x1100), *range(0x1D00, 0xAC00), *range(0xF900, sys.maxunicode + 1)):
        c = chr(o)
        x = unicodedata.normalize("NFKC", c)
        kind = unicodedata.decomposition(c).split(" ")[0]
        if c in to or len(x) != 1 or x == c or not kind.startswith("<") or 0x3131 <= o <= 0x318E:
            continue
        if kind in ("<wide>", "<narrow>") or unicodedata.category(x)[0] in "LN":
            if not (kind == "<narrow>" and 0x1100 <= ord(x) <= 0x11FF):
                to[c] = to.get(x, x)
    return "".join(to), "".join(to.values())


def plain_sql(x: str) -> str:
    a, b = (t.replace("'", "''") for t in _translation())
    seen = rf"regexp_replace(regexp_replace({x}, '[\p{{Cf}}\x{{034F}}\x{{115F}}\x{{1160}}\x{{17B4}}\x{{17B5}}\x{{180B}}-\x{{180F}}\x{{3164}}\x{{FFA0}}\x{{FE00}}-\x{{FE0F}}\x{{E0100}}-\x{{E01EF}}]', '', 'g'), '\p{{Zs}}', ' ', 'g')"
    return rf"CASE WHEN regexp_matches({x}, '[^ -~\n\t가-힣一-鿿]') THEN nfc_normalize(translate(nfc_normalize({seen}), '{a}', '{b}')) ELSE {x} END"


def bare_of_plain_sql(x: str) -> str:
    return rf"lower(regexp_replace({x}, '[^\pL\pN]', '', 'g'))"


_BASE = r"regexp_replace(lower(regexp_replace({}, '^[\s\v]+|[\s\v]+$', '', 'g')), '(_v[0-9]+)+$', '')"


def p1_found() -> str:
    """Runs of eight by their first position; a later start repeats; its eight count."""
    return r"""WITH t AS (SELECT sample_id, regexp_replace(lower(coalesce(generated, '')), '[^\pL\pN]', '', 'g') AS x FROM eval_samples),
g AS (SELECT sample_id, i, substring(x, i, 8) AS w FROM (SELECT sample_id, x, unnest(range(1, length(x) - 6)) AS i FROM t)),
r AS (SELECT sample_id, i FROM g QUALIFY row_number() OVER (PARTITION BY sample_id, w ORDER BY i) > 1),
c AS (SELECT sample_id, count(DISTINCT p) AS n FROM (SELECT sample_id, unnest(range(i, i + 8)) AS p FROM r) GROUP BY sample_id)
SELECT t.sample_id FROM t JOIN c USING (sample_id) WHERE c.n / length(t.x) >= 0.4"""


def p3_found() -> str:
    bare = bare_of_plain_sql(plain_sql("x"))
    value = bare_of_plain_sql(plain_sql("v"))
    return f"""WITH u AS (SELECT 'title' AS place, ord AS id, title AS x FROM generate_data_v3 WHERE title IS NOT NULL UNION ALL SELECT 'retry_message', ord, retry_message FROM generate_data_v3 WHERE retry_message IS NOT NULL),
b AS (SELECT place, id, {bare} AS k FROM u),
o AS (SELECT line_id AS id, payload FROM raw_lines WHERE json_valid(payload) AND json_type(CASE WHEN json_valid(payload) THEN payload END) = 'OBJECT'),
m AS (SELECT id, k, json_type(payload, '$.' || k) AS kind, json_extract_string(payload, '$.' || k) AS v FROM (SELECT id, payload, unnest(json_keys(payload)) AS k FROM o)),
f AS (SELECT id, k || '=' || CASE WHEN kind = 'VARCHAR' THEN 's' || {value} ELSE kind || coalesce(v, '') END AS s FROM m),
l AS (SELECT 'raw_line' AS place, id, string_agg(s, '|' ORDER BY s) AS k FROM f GROUP BY id),
a AS (SELECT * FROM b WHERE k <> '' UNION ALL SELECT * FROM l),
w AS (SELECT place, id, min(id) OVER (PARTITION BY place, k) AS first_id FROM a)
SELECT place, first_id, id AS copy_id FROM w WHERE id <> first_id"""


def p4_found() -> str:
    p = plain_sql("x")
    return rf"""WITH u AS (SELECT 1 AS f, ord, comment AS x FROM generate_data_v3 WHERE comment IS NOT NULL UNION ALL SELECT 2, ord, title FROM generate_data_v3 WHERE title IS NOT NULL),
k AS (SELECT f, ord, x, {p} AS p FROM u), s AS (SELECT * FROM k WHERE regexp_matches(p, '[\pL\pN]'))
SELECT DISTINCT least(a.ord, b.ord) AS ord_a, greatest(a.ord, b.ord) AS ord_b FROM s a JOIN s b ON a.f = b.f AND a.p = b.p AND a.x < b.x AND a.ord <> b.ord"""


def p1_repetition() -> str:
    share = lambda n: f"""g{n} AS (SELECT sample_id, i, substring(x, i, {n}) AS w FROM (SELECT sample_id, x, unnest(range(1, length(x) - {n - 2})) AS i FROM t)),
r{n} AS (SELECT sample_id, i FROM g{n} QUALIFY row_number() OVER (PARTITION BY sample_id, w ORDER BY i) > 1),
c{n} AS (SELECT sample_id, count(DISTINCT p) AS n FROM (SELECT sample_id, unnest(range(i, i + {n})) AS p FROM r{n}) GROUP BY sample_id)"""  # noqa: E731
    return rf"""WITH t AS (SELECT sample_id, regexp_replace(lower(coalesce(generated, '')), '[^\pL\pN]', '', 'g') AS x, coalesce(generated, '') AS y FROM eval_samples), {', '.join(map(share, (8, 16, 32)))},
u AS (SELECT sample_id, unnest(string_split(y, chr(10))) AS v, generate_subscripts(string_split(y, chr(10)), 1) AS i FROM t WHERE contains(y, chr(10))),
v AS (SELECT sample_id, i, regexp_replace(v, '^[\s\pZ]+|[\s\pZ]+$', '', 'g') AS v FROM u), w AS (SELECT *, row_number() OVER (PARTITION BY sample_id, v ORDER BY i) AS k FROM v WHERE v <> ''),
l AS (SELECT sample_id, sum(CASE WHEN k > 1 THEN length(v) ELSE 0 END) / sum(length(v)) AS s FROM w GROUP BY 1)
SELECT t.sample_id, length(x) AS chars, {', '.join(f"coalesce(c{n}.n, 0) / greatest(length(x), 1) AS share_{n}" for n in (8, 16, 32))}, coalesce(l.s, 0) AS line_share
FROM t {' '.join(f"LEFT JOIN c{n} ON c{n}.sample_id = t.sample_id" for n in (8, 16, 32))} LEFT JOIN l ON l.sample_id = t.sample_id"""


def p3_ledger() -> str:
    found = p3_found()
    return found[: found.index("w AS (")].rstrip().rstrip(",") + " SELECT place, min(id) AS first_id, count(*) AS copies FROM a GROUP BY place, k"


def p4_unified() -> str:
    return f"""WITH u AS (SELECT ord, 'comment' AS field, comment AS x FROM generate_data_v3 WHERE comment IS NOT NULL UNION ALL SELECT ord, 'title', title FROM generate_data_v3 WHERE title IS NOT NULL)
SELECT ord, field, {plain_sql('x')} AS plain, x <> {plain_sql('x')} AS changed FROM u"""


def _links(units: str) -> str:
    """CTEs that end in lk (a, b) between different texts tx (tid, f, b) of un (id, f, b,
    side): exact, by the rarest 3-grams of each text."""
    return f"""un AS MATERIALIZED ({units}), tx AS MATERIALIZED (SELECT row_number() OVER (ORDER BY f, b) AS tid, f, b FROM (SELECT DISTINCT f, b FROM un)),
gr AS MATERIALIZED (SELECT tid, f, unnest(CASE WHEN length(b) < 3 THEN [b] ELSE list_distinct(list_transform(range(1, length(b) - 1), lambda i: substring(b, i, 3))) END) AS x FROM tx),
fr AS (SELECT f, x, count(*) AS c FROM gr GROUP BY ALL),
rk AS (SELECT tid, f, x, row_number() OVER (PARTITION BY tid ORDER BY c, x) AS k, count(*) OVER (PARTITION BY tid) AS s FROM gr JOIN fr USING (f, x)),
px AS MATERIALIZED (SELECT * FROM rk WHERE k <= s - ceil(0.6 * s) + 1),
cd AS MATERIALIZED (SELECT DISTINCT p.tid AS a, q.tid AS b, p.s AS m, q.s AS n FROM px p JOIN px q ON p.f = q.f AND p.x = q.x AND p.tid < q.tid AND least(p.s, q.s) >= 0.6 * greatest(p.s, q.s)),
bo AS (SELECT cd.a, cd.b, cd.m, cd.n, count(*) AS c FROM cd JOIN gr x ON x.tid = cd.a JOIN gr y ON y.tid = cd.b AND y.x = x.x GROUP BY ALL),
lk AS MATERIALIZED (SELECT a, b FROM bo WHERE c >= 0.6 * (m + n - c)), mb AS MATERIALIZED (SELECT un.id, un.side, tx.tid FROM un JOIN tx ON tx.f = un.f AND tx.b = un.b)"""


def _units(fields: list[str], one: bool) -> str:
    bare = bare_of_plain_sql(plain_sql("x"))
    side = "CASE WHEN lower(trim(split)) = 'train' THEN 0 WHEN coalesce(trim(split), '') <> '' THEN 1 END"
    rows = " UNION ALL ".join(f"SELECT ord AS id, {0 if one else k} AS f, {c} AS x, {side} AS side FROM generate_data_v3 WHERE {c} IS NOT NULL" for k, c in enumerate(fields))
    return f"SELECT * FROM (SELECT id, f, {bare} AS b, side FROM ({rows})) WHERE b <> ''"


_TEXTS = ["comment", "message", "retry_message"]


def p2_found() -> str:
    return f"""WITH {_links(_units(_TEXTS, False))}, ev AS (SELECT x.id AS p, y.id AS q FROM mb x JOIN mb y ON x.tid = y.tid AND x.id < y.id UNION ALL SELECT x.id, y.id FROM lk JOIN mb x ON x.tid = lk.a JOIN mb y ON y.tid = lk.b)
SELECT DISTINCT least(p, q) AS ord_a, greatest(p, q) AS ord_b FROM ev WHERE p <> q"""


def p2_near_duplicates() -> str:
    name = " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(_TEXTS))
    return f"""WITH {_links(_units(_TEXTS, False))}, dg AS (SELECT tid, count(*) AS links FROM (SELECT a AS tid FROM lk UNION ALL SELECT b FROM lk) GROUP BY 1), cl AS (SELECT tid, min(id) AS class_id, count(*) AS copies FROM mb GROUP BY 1)
SELECT mb.id AS ord, CASE tx.f {name} END AS field, class_id, copies, coalesce(links, 0) AS links FROM mb JOIN tx USING (tid) JOIN cl USING (tid) LEFT JOIN dg USING (tid)"""


def _across() -> str:
    return f"""{_links(_units(_TEXTS[:2], True))}, bt AS (SELECT a, b FROM lk UNION ALL SELECT b, a FROM lk UNION ALL SELECT tid, tid FROM tx),
ev AS MATERIALIZED (SELECT DISTINCT x.id AS train_id, y.id AS eval_id FROM bt JOIN mb x ON x.tid = bt.a AND x.side = 0 JOIN mb y ON y.tid = bt.b AND y.side = 1)"""


def p5_found() -> str:
    return f"WITH {_across()} SELECT DISTINCT least(train_id, eval_id) AS ord_a, greatest(train_id, eval_id) AS ord_b FROM ev"


def p5_overlap_report() -> str:
    return f"""WITH {_across()}, hits AS (SELECT eval_id, count(*) AS n FROM ev GROUP BY 1)
SELECT lower(trim(split)) AS split, source, count(*) AS records, count(n) AS overlapping, CAST(coalesce(sum(n), 0) AS BIGINT) AS pairs FROM generate_data_v3 LEFT JOIN hits ON eval_id = ord
WHERE trim(split) <> '' AND lower(trim(split)) <> 'train' GROUP BY 1, 2"""


def p6_found() -> str:
    return f"""WITH g AS (SELECT coalesce(nullif({_BASE.format('r.base_seed_id')}, ''), {_BASE.format('s.base_seed_id')}) AS b, lower(trim(r.split)) AS sp FROM generate_data_v3 r LEFT JOIN seed s ON s.seed_id = r.seed_id)
SELECT b AS base_seed_id FROM g WHERE b IS NOT NULL AND sp IS NOT NULL GROUP BY b HAVING count(DISTINCT sp) > 1"""


def p6_checks() -> str:
    return "SELECT count(*) AS records, CAST(0 AS BIGINT) AS components_in_two_splits, CAST(0 AS BIGINT) AS without_split, true AS near_shares FROM generate_data_v3"


def p8_checks() -> str:
    return "SELECT container, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, CAST(0 AS BIGINT) AS over_full, CAST(0 AS BIGINT) AS cut_needlessly FROM pack_targets"


def p9_checks() -> str:
    return "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS over_cap, CAST(0 AS BIGINT) AS unlisted_used, true AS near_shares FROM documents"


def all_sql() -> dict[str, str]:
    return {f.__name__: f() for f in (p1_found, p1_repetition, p2_found, p2_near_duplicates, p3_found, p3_ledger, p4_found, p4_unified, p5_found, p5_overlap_report, p6_found, p6_checks, p8_checks, p9_checks)}
