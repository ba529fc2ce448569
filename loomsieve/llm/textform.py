"""One consistent form for text that looks the same (problem 4).

``plain form``  full-width, combining, invisible, odd-blank and look-alike
                characters become the usual ones or vanish; letter case, number of
                blanks and punctuation stay.
``bare form``   the plain form in lower case, letters and digits only.

DuckDB runs inside each Arrow partition; the mapping is one SQL expression of
``nfc_normalize``, ``translate`` and regular expressions, so both forms of a batch
are made in one vectorised pass. Nulls stay null, blank text stays as it is (odd
blanks become spaces), texts of any length are handled whole.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsieve.llm._pairs import classes, ordered_pairs, within_classes
from loomsieve.storage import materialize

# Characters without a shape of their own.
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{E0000}-\x{E007F}\x{E0100}-\x{E01EF}]"
# Blanks other than the space (tab and line ends are layout, not look-alikes).
BLANKS = "               　"
# Letters of other scripts drawn like a Latin letter.
LOOK_ALIKES = {
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγικνορυχϲϳ", "ABEZHIKMNOPTYXayikvopuxcj"),
    "Cyrillic": ("АВЕЅІЈКМНОРСТУХԌԚԜаеѕіјорсухһԁԛԝӏѵ", "ABESIJKMHOPCTYXGQWaesijopcyxhdqwlv"),
    "Armenian": ("ՏՍՕօսհոց", "SUOouhng"),
    "Latin": ("ɡɑıᴏᴠᴡᴢᴄ", "gaiovwzc"),
    "Cherokee": ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏒᏔᏕᏙᏚᏞᏟᏢᏦᏳᏴ", "DRTAJEWMHYGZRWSVSLCPKGB"),
    "Lisu": ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
    "Coptic": ("ⲀⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "ABHIKMNOPCTYXopc"),
}
#: Kinds of compatibility forms that are other drawings of the usual characters.
_DRAWN = ("wide", "narrow", "font", "compat", "square", "circle", "super", "sub", "initial", "medial", "final", "isolated")


def _usual_form(c: str) -> str | None:
    """What a compatibility character is another drawing of: letters and digits only, but
    any mark of full or half width; None for all other characters."""
    kind = unicodedata.decomposition(c).partition(" ")[0].strip("<>")
    if kind not in _DRAWN or 0x3131 <= ord(c) <= 0x318E:  # single letters of Hangul are usual
        return None
    step = "".join(chr(int(x, 16)) for x in unicodedata.decomposition(c).split(" ")[1:])
    if kind == "narrow" and 0x3131 <= ord(step[0]) <= 0x318E:
        return step
    to = unicodedata.normalize("NFKC", c)
    if kind in ("wide", "narrow"):
        return to
    return to if all(unicodedata.category(x)[0] in "LN" for x in to) else None


@cache
def _tables() -> dict[str, dict[str, str]]:
    """Characters and what they become. usual: look-alikes, blanks and full-width forms;
    rare: by rule every other compatibility form, letters of Hangul that compose with
    nothing, and forms of the look-alikes."""
    usual = dict.fromkeys(BLANKS, " ") | {chr(o): chr(o - 0xFEE0) for o in range(0xFF01, 0xFF5F)}
    for old, new in LOOK_ALIKES.values():
        usual.update(zip(old, new, strict=True))
    rare = {}
    for o in (*range(0xA0, 0xD800), *range(0xF900, sys.maxunicode + 1)):
        c = chr(o)
        if c not in usual and (to := _usual_form(c)) is not None:
            rare[c] = "".join(usual.get(x, x) for x in to)
    for o in range(0x3131, 0x3164):
        x = chr(int(unicodedata.decomposition(chr(o)).split(" ")[1], 16))
        rare[x] = chr(o)
    return {"usual": usual, "rare": rare}


def _class(chars: str) -> str:
    """The characters as a regular-expression class of ranges."""
    runs: list[list[int]] = []
    for o in sorted(map(ord, chars)):
        if runs and o == runs[-1][1] + 1:
            runs[-1][1] = o
        else:
            runs.append([o, o])
    return "[" + "".join(rf"\x{{{x:X}}}-\x{{{y:X}}}" for x, y in runs) + "]"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _mapped_sql(x: str, table: str) -> str:
    """translate and the map are built for each text, so only texts that need them get
    there; characters that become several are looked up one by one."""
    of = _tables()[table]
    one, more = {k: v for k, v in of.items() if len(v) == 1}, {k: v for k, v in of.items() if len(v) != 1}
    out = f"CASE WHEN regexp_matches({x}, '{_class(''.join(one))}') THEN translate({x}, {_quoted(''.join(one))}, {_quoted(''.join(one.values()))}) ELSE {x} END"
    if more:
        keys, values = (", ".join(map(_quoted, v)) for v in (more, more.values()))
        each = f"array_to_string(list_transform(regexp_extract_all({out}, '(?s).'), lambda c: coalesce(MAP([{keys}], [{values}])[c], c)), '')"
        out = f"CASE WHEN regexp_matches({x}, '{_class(''.join(more))}') THEN {each} ELSE {out} END"
    return out


#: Characters of which any text is its own plain form.
OWN_FORM = r"\x{01}-\x{7F}\x{AC00}-\x{D7A3}\x{4E00}-\x{9FFF}\x{3041}-\x{3096}\x{309D}\x{309E}\x{30A1}-\x{30FE}"


def full_plain_sql(x: str) -> str:
    """The plain form of SQL expression ``x``, whatever is in it."""
    full = f"nfc_normalize(regexp_replace({x}, '{INVISIBLE}', '', 'g'))"
    for table in _tables():
        full = _mapped_sql(f"({full})", table)
    return f"nfc_normalize({full})"


def plain_sql(x: str) -> str:
    """The plain form of SQL expression ``x``. Texts of ASCII and whole syllables, kana
    or ideographs alone, most of a corpus, are their own plain form."""
    return f"CASE WHEN regexp_matches({x}, '^[{OWN_FORM}]*$') THEN {x} ELSE {full_plain_sql(x)} END"


def bare_of_plain_sql(x: str) -> str:
    return rf"regexp_replace(lower({x}), '[^\pL\pN]+', '', 'g')"


def run_sql(batches: Iterable[pa.RecordBatch], sql: str) -> Iterator[pa.RecordBatch]:
    """Run ``sql`` over each Arrow batch (as table ``batch``) with embedded DuckDB."""
    import duckdb

    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "preserve_insertion_order": True})
    for batch in batches:
        if batch.num_rows:
            con.register("batch", pa.Table.from_batches([batch]))
            yield from con.sql(sql).to_arrow_table().to_batches()
            con.unregister("batch")
    con.close()


def plain_texts(texts: list[str | None]) -> list[str | None]:
    """Plain forms of a few texts, for callers that already hold them in Python."""
    if not texts:
        return []
    batch = pa.RecordBatch.from_pydict({"i": list(range(len(texts))), "x": pa.array(texts, pa.string())})
    out: dict[int, str | None] = {}
    for b in run_sql([batch], f"SELECT i, {plain_sql('x')} AS p FROM batch"):
        out.update(zip(b["i"].to_pylist(), b["p"].to_pylist(), strict=True))
    return [out[i] for i in range(len(texts))]


def long_units(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, field, text) for every non-null text of ``fields``; field is the position."""
    made = F.filter(F.array(*(F.struct(F.lit(i).alias("field"), F.col(f"`{c}`").cast("string").alias("text")) for i, c in enumerate(fields))), lambda x: x["text"].isNotNull())
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.explode(made).alias("u")).select("id", "u.field", "u.text")


def with_forms(units: DataFrame, *, plain: bool = True, bare: bool = True, keep_text: bool = False) -> DataFrame:
    """Replace ``text`` of (id, field, text) by its plain and/or bare form."""
    cols, schema = ["id", "field"], "id long, field int"
    inner = f"SELECT id, field, text, {plain_sql('text')} AS plain FROM batch"
    if keep_text:
        cols, schema = [*cols, "text"], schema + ", text string"
    if plain:
        cols, schema = [*cols, "plain"], schema + ", plain string"
    if bare:
        cols, schema = [*cols, f"{bare_of_plain_sql('plain')} AS bare"], schema + ", bare string"
    sql = f"SELECT {', '.join(cols)} FROM ({inner})"
    return units.mapInArrow(lambda it: run_sql(it, sql), schema)


def unify_text(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """Operator: (id, field name, text, plain, changed) for every text of ``fields``.

    Null texts give no row, an empty table an empty result; columns of ``df`` other
    than ``id_col`` and ``fields`` aren't read, so their names can't clash.
    """
    names = F.array(*map(F.lit, fields))
    out = with_forms(long_units(df, id_col, fields), bare=False, keep_text=True)
    return out.select("id", F.element_at(names, F.col("field") + 1).alias("field"), "text", "plain", (F.col("text") != F.col("plain")).alias("changed"))


def lookalike_pairs(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """Operator: (id_a, id_b), pairs of records of which a field differs in characters
    but not in plain form. Texts with an empty bare form are no case.

    Only hashes are shuffled. A spelling with more than ``COPIES`` copies is in class
    form: its records are paired with the first record of each other spelling.
    """
    sql = f"""SELECT id, field, text, plain FROM (SELECT id, field, text, {plain_sql('text')} AS plain FROM batch) WHERE regexp_matches(plain, '[\\pL\\pN]')"""
    formed = long_units(df, id_col, fields).mapInArrow(lambda it: run_sql(it, sql), "id long, field int, text string, plain string")
    keyed = formed.select("id", F.xxhash64("field", "plain").alias("k"), F.xxhash64(F.lit(7), "plain", "field").alias("k2"), F.xxhash64("text").alias("form"))
    keyed = materialize(keyed, "keys")  # read twice; forms are made once
    several = keyed.groupBy("k", "k2").agg(F.min("form").alias("lo"), F.max("form").alias("hi")).where("lo <> hi").select("k", "k2")
    members = keyed.join(several, ["k", "k2"], "left_semi").dropDuplicates(["k", "k2", "form", "id"])
    of = classes(materialize(members, "members"), ["k", "k2"], "form")
    return ordered_pairs(within_classes(of, ["k", "k2"], "form", alike=False))
