"""The operators on training text against brute force, and their edge cases."""

import itertools
import json
import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from loomsieve.llm import _pairs, crosssplit, groupsplit, language, ledger, mixing, nearpairs, neardup, packing, pairdefects, queries, repetition, sketches, textform, tokens, versions

LONG = "가나다라 마바사 " * 20_000
CLASH = "id_ long, text string, id string, h string, n string, field string, bin string, source string, tokens string, label string, plain string, salt int, side int"


def ids(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def clashing(spark, rows):
    """Rows (id_, text) with extra columns named like the operators' own."""
    return spark.createDataFrame([(i, t, "x", None, "1", "f", "b", "s", "t", "l", "p", 1, None) for i, t in rows], CLASH)


# ---- 1


def brute_share(t, n=8):
    s = [c for c in (t or "").lower() if c.isalnum()]
    seen, cov = set(), [False] * len(s)
    for i in range(len(s) - n + 1):
        g = tuple(s[i : i + n])
        if g in seen:
            cov[i : i + n] = [True] * n
        seen.add(g)
    return sum(cov) / max(1, len(s))


def test_repetition_matches_brute_force():
    rng = random.Random(1)
    texts = ["".join(rng.choice("가나ab1 .") for _ in range(rng.randint(0, 120))) for _ in range(300)] + ["하" * 30, "abcdefgh" * 5, "", None, "a", "abcdefg", "abcdefgh"]
    got = repetition.repetition_of(texts)["share_8"]
    assert np.allclose(got, [brute_share(t) for t in texts])


def test_repetition_edges(spark):
    rows = [(1, None), (1, None), (2, ""), (3, LONG), (4, "a\nb b\nb b\n"), (None, "abcdefgh" * 4)]
    out = {(r.id, i): r for i, r in enumerate(repetition.repetition_coverage(clashing(spark, rows), "id_", "text").collect())}
    assert len(out) == 6
    by = {k[0]: r for k, r in out.items()}
    assert by[1].share_8 == by[2].share_8 == 0 and by[3].share_8 > 0.99 and by[None].share_8 == 24 / 32
    assert by[4].line_share == pytest.approx(3 / 7)
    assert repetition.repetition_coverage(clashing(spark, []), "id_", "text").count() == 0


# ---- 4


def test_plain_form():
    given = ["ＮＡＰІＧＡ　가방", "é a​b­c", "한", "NAPIGA", None, "", "x y z", "𝐀①ﾊ", "줄\n바꿈\t"]
    assert textform.plain_texts(given) == ["NAPIGA 가방", "é abc", "한", "NAPIGA", None, "", "x y z", "A1ハ", "줄\n바꿈\t"]


def test_forms_of_one_shape_are_equal():
    same = [("か\u3099", "が"), ("ハ\u309a", "パ"), ("ｶﾞ", "ガ"), ("ﾡ", "ㄱ"), ("\u1100", "ㄱ"), ("\u1112\u1161\u11ab", "한"), ("ﬁ", "fi"), ("Ⅳ", "IV"), ("ⅰ", "i"), ("㎏", "kg"), ("①", "1"), ("²", "2"), ("Ꭺ", "A"), ("ꓮ", "A"), ("Ⲁ", "A"), ("Α", "A"), ("\ufe8d", "\u0627"), ("ᵀ", "T")]
    assert textform.plain_texts([x for x, _ in same]) == [y for _, y in same]
    assert textform.plain_texts(["…", "‥", "ㅋㅋ", "㈜"]) == ["…", "‥", "ㅋㅋ", "㈜"]
    long = "가나다 " * 100_000 + "ﬁ"
    assert textform.plain_texts([long]) == [long[:-1] + "fi"]


def test_quick_way_equals_the_whole_mapping():
    ranges = [[int(x, 16) for x in r] for r in (("1", "7F"), ("AC00", "D7A3"), ("4E00", "9FFF"), ("3041", "3096"), ("309D", "309E"), ("30A1", "30FE"))]
    assert textform.OWN_FORM == r"\x{01}-\x{7F}\x{AC00}-\x{D7A3}\x{4E00}-\x{9FFF}\x{3041}-\x{3096}\x{309D}\x{309E}\x{30A1}-\x{30FE}"
    batch = pa.RecordBatch.from_pydict({"x": [chr(o) for lo, hi in ranges for o in range(lo, hi + 1)]})
    for b in textform.run_sql([batch], f"SELECT x, {textform.full_plain_sql('x')} AS p FROM batch"):
        assert b["x"].to_pylist() == b["p"].to_pylist()


def test_lookalike_pairs(spark):
    rows = [(1, "NAPIGA 의자"), (2, "NAPІGA 의자"), (3, "napiga 의자"), (4, "NAPIGA 의자"), (5, None), (6, ""), (7, "​"), (8, " "), (9, "NAPIGA  의자"), (10, LONG), (11, LONG + "​"), (2, "NAPІGA 의자")]
    out = textform.lookalike_pairs(clashing(spark, rows), "id_", ["text"])
    assert ids(out, "id_a", "id_b") == [(1, 2), (2, 4), (10, 11)]
    assert textform.lookalike_pairs(clashing(spark, []), "id_", ["text"]).count() == 0
    unified = textform.unify_text(clashing(spark, rows), "id_", ["text"])
    assert unified.count() == 11 and unified.where("changed").count() == 4


def test_hot_spelling_is_linked_not_squared(spark):
    rows = [(i, "같은 제목") for i in range(300)] + [(1000, "같은 제목")]
    out = ids(textform.lookalike_pairs(clashing(spark, rows), "id_", ["text"]), "id_a", "id_b")
    assert out == [(i, 1000) for i in range(300)]


# ---- 2 and 5


def brute_pairs(texts, least=0.6):
    return {(i, j) for (i, a), (j, b) in itertools.combinations(sorted(texts.items()), 2) if a and b and sketches.likeness(a, b) >= least}


def edited(rng, t):
    s = list(t)
    for _ in range(rng.randint(0, 6)):
        s[rng.randrange(len(s))] = rng.choice("가나다라마바사")
    return "".join(s)


def family(rng, n, size, copies=4):
    out = []
    for _ in range(n):
        t = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz가나다라마바사아자차카타파하") for _ in range(size))
        out += [edited(rng, t) for _ in range(copies)]
    return out


def test_sketch_estimates_likeness():
    rng = random.Random(3)
    texts = family(rng, 40, 90, 2)
    grams, owner = sketches.shingles(texts)
    for sketch in (sketches.fast_sketch(grams, owner, len(texts), 200), sketches.minwise(grams, owner, len(texts), 200)):
        assert sketch.shape == (80, 200)
        err = [np.mean(sketch[i] == sketch[i + 1]) - sketches.likeness(texts[i], texts[i + 1]) for i in range(0, 80, 2)]
        assert abs(np.mean(err)) < 0.02 and np.std(err) < 0.06


def test_short_texts_have_one_shingle():
    grams, owner = sketches.shingles(["", "a", "ab", "abc", "a"])
    assert list(owner) == [1, 2, 3, 4] and grams[0] == grams[3] and len(set(grams.tolist())) == 3


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    texts = dict(enumerate(family(rng, 60, 80)))
    texts |= {1000: texts[0], 1001: texts[0], 1002: None, 1003: "", 1004: "!!", 1005: "ab", 1006: "A b", 1007: LONG, 1008: LONG}
    out = set(ids(neardup.near_duplicate_pairs(clashing(spark, list(texts.items())), "id_", ["text"]), "id_a", "id_b"))
    want = brute_pairs({i: (textform.plain_texts([t])[0] or "").lower() and "".join(filter(str.isalnum, t.lower())) for i, t in texts.items() if t})
    assert out <= want and len(out) >= 0.98 * len(want)
    classes = neardup.near_duplicates(clashing(spark, list(texts.items())), "id_", ["text"])
    by = {r.id: r for r in classes.collect()}
    assert 1002 not in by and by[1000].class_id == 0 and by[1000].copies == 3 and by[1008].class_id == 1007
    assert neardup.near_duplicate_pairs(clashing(spark, []), "id_", ["text"]).count() == 0


@pytest.mark.parametrize(("hot", "local"), [(8, 256), (2048, 4), (8, 4)])
def test_hot_bucket_loses_no_link(spark, monkeypatch, hot, local):
    rng = random.Random(6)
    base = "".join(rng.choice("가나다라마바사아자차카타파하거너더러머버서어저처커터퍼허") for _ in range(90))
    texts = {i: base[:i % 80] + rng.choice("xyz") + base[i % 80 :] + str(i) for i in range(60)}
    texts |= {100 + i: base[:40] + "".join(rng.choice("abcdefghijklmnop") for _ in range(45)) for i in range(40)}
    monkeypatch.setattr(nearpairs, "HOT", hot)
    monkeypatch.setattr(nearpairs, "LOCAL", local)
    monkeypatch.setattr(_pairs, "BLOCK", 16)
    want = brute_pairs(texts)
    assert set(ids(neardup.near_duplicate_pairs(clashing(spark, list(texts.items())), "id_", ["text"]), "id_a", "id_b")) == want
    df = spark.createDataFrame([(i, t, ("train", "val")[i % 2]) for i, t in texts.items()] + [(500, texts[0], "val")], "ord long, a string, split string")
    across = {(i, j) if i % 2 == 0 else (j, i) for i, j in want if i % 2 != j % 2}
    across |= {(0, 500)} | {(i, 500) for a, b in want for i in (a, b) if 0 in (a, b) and i and i % 2 == 0}
    assert set(ids(crosssplit.cross_split_pairs(df, "ord", ["a"]), "train_id", "eval_id")) == across


def test_texts_that_share_a_hash_are_told_apart(spark):
    df = spark.createDataFrame([(1, 5, 50), (2, 5, 51), (3, 5, 50), (4, 6, 60)], "id long, h long, h2 long")
    by = {r.id: r.h for r in nearpairs.settled(df).collect()}
    assert by[1] == by[3] and len(set(by.values())) == 3


def test_hot_copies_are_in_class_form(spark):
    """A text with 200 copies: each is paired with the first; a linked text of three
    copies meets the first of them, and its own first meets all."""
    one, two = "똑같은 문장이 여러 번 나온다", "똑같은 문장이 여러 번 나온다고"
    rows = [(i, one) for i in range(200)] + [(1000 + i, two) for i in range(3)]
    out = set(ids(neardup.near_duplicate_pairs(clashing(spark, rows), "id_", ["text"]), "id_a", "id_b"))
    star = {(0, i) for i in range(1, 200)}
    small = {(1000, 1001), (1000, 1002), (1001, 1002)}
    assert out == star | small | {(0, 1000 + k) for k in range(3)} | {(i, 1000) for i in range(200)}
    by = {r.id: r for r in neardup.near_duplicates(clashing(spark, rows), "id_", ["text"]).collect()}
    assert len(by) == 203 and all(by[i].class_id == 0 and by[i].copies == 200 and by[i].links == 1 for i in range(200))


def test_hot_values_are_joined_in_parts(spark, monkeypatch):
    monkeypatch.setattr(_pairs, "HOT_ROWS", 10)
    rows = spark.createDataFrame([(i, 1 if i % 3 else i) for i in range(300)], "id long, k long")
    hot = _pairs.hot_values(rows, "k")
    of = rows.select("k").distinct().withColumn("v", rows.k * 2)
    assert hot == [1] and ids(_pairs.spread_join(rows, of, ["k"], hot), "id", "v") == [(i, 2 if i % 3 else 2 * i) for i in range(300)]
    assert _pairs.spread_join(rows, of.where("k = 1"), ["k"], hot, "left_semi").count() == 200


def test_layout_variants_are_all_paired(spark):
    words = "the same sentence comes in a hundred layouts of blanks".split()
    texts = ["".join(w + " " * (1 + (i >> j & 1)) for j, w in enumerate(words)) for i in range(100)]
    assert len(set(texts)) == 100
    assert len(ids(neardup.near_duplicate_pairs(clashing(spark, list(enumerate(texts))), "id_", ["text"]), "id_a", "id_b")) == 100 * 99 // 2
    df = spark.createDataFrame([(2 * i + s, t, ("train", "val")[s]) for i, t in enumerate(texts) for s in (0, 1)], "ord long, a string, split string")
    assert crosssplit.cross_split_pairs(df, "ord", ["a"]).count() == 100 * 100


def test_cross_split(spark):
    rng = random.Random(7)
    texts = family(rng, 40, 80, 3)
    rows = [(i, t, ["train", "Val ", "test", None, ""][i % 5], None) for i, t in enumerate(texts)] + [(900, texts[0], "test", None), (901, None, "train", texts[0]), (902, "??", "test", None)]
    df = spark.createDataFrame(rows, "ord long, a string, split string, b string")
    got = set(ids(crosssplit.cross_split_pairs(df, "ord", ["a", "b"]), "train_id", "eval_id"))
    side = {r[0]: (r[2] or "").strip().lower() for r in rows}
    said = {r[0]: r[1] or r[3] for r in rows if (r[1] or r[3]) != "??"}
    want = set()
    for i, j in brute_pairs(said):
        if side[i] and side[j] and (side[i] == "train") != (side[j] == "train"):
            want.add((i, j) if side[i] == "train" else (j, i))
    assert got == want and (0, 900) in got and (901, 900) in got
    report = crosssplit.overlap_report(df.withColumn("source", df.a.substr(1, 0)), crosssplit.cross_split_pairs(df, "ord", ["a", "b"]), "ord").collect()
    assert sum(r.pairs for r in report) == len(want) and {r.split for r in report} == {"val", "test"}
    assert crosssplit.cross_split_pairs(df.limit(0), "ord", ["a", "b"]).count() == 0


def test_overlaps_of_hot_copies_are_all_counted(spark, monkeypatch):
    hot = "the same answer stands in very many records of both splits"
    df = spark.createDataFrame([(i, hot, None, ("train", "val")[i % 2], "s") for i in range(200)], "ord long, a string, b string, split string, source string")
    r = crosssplit.overlap_report(df, crosssplit.overlap_counts(df, "ord", ["a", "b"]), "ord").collect()
    assert [(x.split, x.records, x.overlapping, x.pairs) for x in r] == [("val", 100, 100, 10_000)]
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(4)]
    texts = [None, *base, *(x[:-1] + "z" for x in base), *(x + "q" for x in base)]
    fields = ["a", "b", "c"]
    df = spark.createDataFrame([(i, *(rng.choice(texts) for _ in fields), rng.choice(["train", "val", "test"])) for i in range(300)], "ord long, a string, b string, c string, split string")
    monkeypatch.setattr(_pairs, "COPIES", 10**6)
    for f in (fields[:1], fields[:2], fields):
        want = {x.eval_id: x["count"] for x in crosssplit.cross_split_pairs(df, "ord", f).groupBy("eval_id").count().collect()}
        assert want and {x.eval_id: x.n for x in crosssplit.overlap_counts(df, "ord", f).collect()} == want
    assert crosssplit.overlap_counts(df.limit(0), "ord", fields).count() == 0


# ---- 3


def test_ledger_counts_over_batches(spark):
    a = [(5, "같은 제목!"), (6, "다른 제목"), (7, None), (8, ""), (9, "  ")]
    b = [(1, "같은제목"), (2, "같은\n제목"), (6, "다른 제목")]
    keys = [ledger.text_keys(clashing(spark, x), "id_", ["text"]) for x in (a, b, [])]
    book, all_ = ledger.collapse(spark, keys, buckets=4)
    assert ids(book.rows(), "first_id", "copies") == [(1, 3), (6, 2)]
    assert ids(ledger.copies(book, all_), "place", "first_id", "copy_id") == [("text", 1, 2), ("text", 1, 5)]
    once, _ = ledger.collapse(spark, [ledger.text_keys(clashing(spark, a + b), "id_", ["text"])], buckets=4)
    assert ids(once.rows(), "first_id", "copies") == ids(book.rows(), "first_id", "copies")


def test_small_batches_wait_and_buckets_double(spark, monkeypatch, tmp_path):
    book = ledger.Ledger(spark, f"file://{tmp_path}/book", 2)
    keys = lambda rows: spark.createDataFrame([("t", i, k, k) for i, k in rows], "place string, id long, k1 long, k2 long")
    book.apply(keys([(i, i) for i in range(100)]))
    book.apply(keys([(200, 5), (3, 7)]))
    assert book.state["waiting"] and ids(book.rows().where("copies > 1 OR first_id <> k1"), "k1", "copies", "first_id") == [(5, 2, 5), (7, 2, 3)]
    book.apply(keys([]))
    assert book.store.number == 2
    monkeypatch.setattr(ledger, "FULL", 30)
    book.apply(keys([(300 + i, i) for i in range(60)]))
    assert not book.state["waiting"] and book.state["buckets"] == 4
    again = ledger.Ledger(spark, f"file://{tmp_path}/book")
    want = sorted((i, 1 + (i < 60) + (i in (5, 7)), 3 if i == 7 else i) for i in range(100))
    assert ids(again.rows(), "k1", "copies", "first_id") == want
    # another writer that was first
    stale = ledger.Ledger(spark, f"file://{tmp_path}/book")
    again.apply(keys([(400, 1)]))
    with pytest.raises(RuntimeError):
        stale.apply(keys([(400, 1)]))


def test_ledger_and_components_outlive_a_session(spark, tmp_path):
    """Another process makes both, this one goes on with them."""
    code = f"""
from pyspark.sql import SparkSession
from loomsieve.llm import groupsplit, ledger
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
rows = spark.createDataFrame([(5, "같은 제목!"), (6, "다른 제목")], "i long, text string")
ledger.collapse(spark, [ledger.text_keys(rows, "i", ["text"])], folder="file://{tmp_path}/book")
records = spark.createDataFrame([(1, ["a"], "t", None), (2, ["b", "c"], "t", None)], "id long, keys array<string>, stratum string, split string")
groupsplit.Components(spark, "file://{tmp_path}/parts").add(records, {{"train": 0.5, "test": 0.5}})
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, capture_output=True)
    rows = spark.createDataFrame([(1, "같은제목"), (9, "같은 제목")], "i long, text string")
    book, _ = ledger.collapse(spark, [ledger.text_keys(rows, "i", ["text"])], folder=f"file://{tmp_path}/book")
    assert ids(book.rows(), "first_id", "copies") == [(1, 3), (6, 1)]
    parts = groupsplit.Components(spark, f"file://{tmp_path}/parts")
    old = {r.key: (r.component, r.split) for r in parts.rows().collect()}
    assert set(old) == {"a", "b", "c"} and old["b"] == old["c"] and old["a"][1] != old["b"][1]
    out = parts.add(records(spark, [(3, ["c"], "t", None), (4, ["d", "a"], "t", None), (5, ["e"], "t", None)]), {"train": 0.5, "test": 0.5})
    got = {r.id: (r.split, r.status) for r in out.collect()}
    assert got[3] == (old["b"][1], "kept") and got[4] == (old["a"][1], "kept") and got[5][1] == "new"
    assert {r.key: r.split for r in parts.rows().collect()} == {"a": old["a"][1], "b": old["b"][1], "c": old["b"][1], "d": old["a"][1], "e": got[5][0]}


def test_versions_drop_what_is_old(spark, tmp_path):
    v = versions.Versions(spark, f"file://{tmp_path}/v")
    for i in range(4):
        folder = v.new_folder("x")
        spark.range(i).write.parquet(v.at(folder))
        v.commit({"i": i}, {folder})
    assert len([x for x in tmp_path.joinpath("v").iterdir() if x.name.startswith("x-")]) == 2
    assert versions.Versions(spark, f"file://{tmp_path}/v").state["i"] == 3


def test_json_lines(spark):
    rows = [
        (1, '{"a": "가 나", "n": 1}'), (2, ' {"n":1.0,\n"a":"가나!"}'), (3, '{"a": "가나", "n": 2}'), (4, '{"a": "가나"'), (5, "[1]"), (6, None), (7, ""), (8, '{"a": "\\uac00\\ub098", "n": 1}'),
        (9, '{"a": "가나", "n": NaN}'), (10, '{"a": "가나", "n": true}'), (11, json.dumps({"a": LONG, "n": [1, {"x": "Y"}]})), (12, json.dumps({"n": [1, {"x": "y "}], "a": LONG + "!"})),
    ]
    book, keys = ledger.collapse(spark, [ledger.json_keys(clashing(spark, rows), "id_", "text", "raw_line")], buckets=2)
    assert ids(ledger.copies(book, keys), "first_id", "copy_id") == [(1, 2), (1, 8), (11, 12)]


# ---- 6


def records(spark, rows):
    return spark.createDataFrame(rows, "id long, keys array<string>, stratum string, split string")


TARGETS = {"train": 0.8, "val": 0.1, "test": 0.1}


def test_components_by_pointer_jumping(spark):
    rng = random.Random(8)
    pairs = [(f"k{rng.randrange(400):03}", f"k{rng.randrange(400):03}") for _ in range(260)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(70)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in pairs:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    got = {r.key: r.component for r in groupsplit.connected(spark.createDataFrame(pairs, "u string, v string")).collect()}
    assert got == {x: find(x) for x in parent}


def test_splits_keep_components_and_meet_targets(spark):
    rng = random.Random(9)
    rows = [(i, [f"g{rng.randrange(600)}"], rng.choice(["a", "b", "c", None]), None) for i in range(6000)]
    table, out = groupsplit.assign_splits(records(spark, rows), TARGETS)
    got = out.collect()
    assert len(got) == 6000 and len({(r.component, r.split) for r in got}) == len({r.component for r in got})
    share = {s: sum(r.split == s for r in got) / 6000 for s in TARGETS}
    assert all(abs(share[s] - x) < 0.02 for s, x in TARGETS.items())
    # next batch: old components stay, a new one comes, a merge of different splits is quarantined
    split = {r.component: r.split for r in got}
    one = next(c for c, s in split.items() if s == "train")
    other = next(c for c, s in split.items() if s == "test")
    again, rows2 = groupsplit.assign_splits(records(spark, [(1, [one], "a", None), (2, ["new"], "a", None), (3, [one, other], "b", None)]), TARGETS, table)
    status = {r.id: r.status for r in rows2.collect()}
    assert status == {1: "quarantined", 2: "new", 3: "quarantined"}
    kept = {r.key: r.split for r in again.collect() if r.status == "kept"}
    assert kept == {r.key: r.split for r in table.collect() if r.component not in (one, other)}


def test_split_edges(spark):
    rows = [(1, ["a"], "t", "train"), (1, ["a"], "t", "train"), (2, ["a"], None, None), (3, ["b"], "t", "val"), (4, ["b"], "t", "test"), (5, ["c"], "t", "nosuch")]
    table, out = groupsplit.assign_splits(records(spark, rows), TARGETS)
    by = {r.key: (r.split, r.status) for r in table.collect()}
    assert by["a"] == ("train", "kept") and by["b"][1] == "quarantined" and by["c"][1] == "new" and out.count() == 6
    table, out = groupsplit.assign_splits(records(spark, []), TARGETS)
    assert table.count() == out.count() == 0


def test_present_splits_can_be_noted_only(spark):
    rows = [(i, [f"g{i % 200}"], "t", "train") for i in range(2000)]
    table, out = groupsplit.assign_splits(records(spark, rows), TARGETS, keep_present=False)
    assert abs(out.where("split = 'train'").count() / 2000 - 0.8) < 0.03 and {tuple(r.splits) for r in table.collect()} == {("train",)}


def test_hot_component(spark):
    rows = [(i, ["hot" if i % 3 == 0 else f"g{i}"], "t", None) for i in range(3000)]
    out = groupsplit.assign_splits(records(spark, rows), TARGETS)[1].collect()
    assert len({r.split for r in out if r.component == "hot"}) == 1
    assert abs(sum(r.split == "train" for r in out) / 3000 - 0.8) < 0.02


# ---- 7


@pytest.fixture(scope="module")
def tagger(spark):
    return language.fit_tagger(queries.table(spark, "/root/testdata/sf0.01", "documents"), "doc_id", "text", "lang", queries._codes(spark, "/root/testdata/sf0.01"))


def test_pair_defects(spark, tagger):
    p = "주제: 의자\n현재 질문: 새 의자를 쓰실 때 어떤 점이 걸리셨나요?\n부적절 유형: evasive"
    en = "Current question: What did you like about the new chair when you used it?\nAnswer: The colour of it"
    sound = "의자를 쓰신 경험을 조금만 더 들려주시겠어요."
    rows = [(i, "retry", p, f"{i}번째로 드리는 말씀인데 {sound}", sound) for i in range(40)]
    rows += [
        (100, "retry", p, None, ""), (101, "retry", p, "(없음)", "{}"), (102, "retry", p, "의자를 쓰신 경험을 조금만 더 들려주시겠", '{"comment": "의자를 쓰신 경'), (103, "Retry", p, "죄송하지만 도와드리기 어렵습니다.", "I'm sorry, but I can't help with that request."),
        (104, "retry", p, "Q. 새 의자를 쓰실 때 어떤 점이 걸리셨나요", p.replace("\n", " ")), (105, "retry", p, "My sister told me that the colour of this chair is bright.", sound), (106, "retry", en, "It was nice to hear that you used it after work.", sound),
        (107, "retry", None, sound[:-1], "Das ist nicht so gut und ich würde es nicht wieder kaufen."), (108, None, p, "좋아요 " * 30 + sound, sound), (109, "retry", "", LONG + sound, sound), (109, "retry", "", LONG + sound, sound),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "sid long, task string, prompt_ string, generated string, expected string, id string, said string")
    got = set(ids(pairdefects.defective_pairs(df, "sid", "task", "prompt_", ["generated", "expected"], tagger), "id", "field", "defect"))
    assert got == {
        (100, "generated", "empty"), (100, "expected", "empty"), (101, "generated", "empty"), (101, "expected", "empty"), (102, "generated", "truncated"), (102, "expected", "truncated"), (103, "generated", "refusal"), (103, "expected", "refusal"),
        (104, "generated", "copy"), (104, "expected", "copy"), (105, "generated", "other_language"), (106, "expected", "other_language"), (107, "expected", "other_language"),
    }
    assert pairdefects.defective_pairs(df.limit(0), "sid", "task", "prompt_", ["generated", "expected"], tagger).count() == 0


@pytest.mark.parametrize("n", ["10000", "1"])
def test_evidence_counts_copies_once_in_the_table(spark, tagger, n):
    often = "마을 앞 나무다리 위로 사람들이 천천히 걸어가고 있어요."
    rows = [(i, "intro", "오늘 하루는 어떻게 보내셨나요?", often) for i in range(80)]
    rows += [(90, "intro", "오늘 하루는 어떻게 보내셨나요?", "제가 좋아하는 곳은 마을 앞 나무다리."), (91, "intro", "오늘 하루는 어떻게 보내셨나요?", "우리가 어제 함께 건넌 것은 마을 앞 나무다리"), (92, "intro", "오늘 하루는 어떻게 보내셨나요?", "무지개빛 물결")]
    df = spark.createDataFrame(rows, "sid long, task string, prompt string, said string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
    try:
        assert ids(pairdefects.defective_pairs(df, "sid", "task", "prompt", ["said"], tagger), "id", "defect") == []
        more = df.union(spark.createDataFrame([(100 + i, "intro", None, f"{i}번째 마을 앞 나무다리로 가 주세요.") for i in range(25)], df.schema))
        assert ids(pairdefects.defective_pairs(more, "sid", "task", "prompt", ["said"], tagger), "id", "defect") == [(91, "truncated")]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_neighbours(spark):
    windows = spark.createDataFrame([(False, "고개가", "끄덕여져요", 9, 0), (False, "고개가", "끄덕여", 0, 2), (False, "고개가", "끄덕", 1, 0), (True, "고개가", "끄덕여져요", 5, 0), (False, "고개를", "끄덕여", 3, 3), (False, "", "끄덕여요", 1, 0), (False, "", "가", 1, 1)], "title boolean, w1 string, w2 string, ends long, goes_on long")
    asked = spark.createDataFrame([(False, "고개가", "끄덕여"), (False, "고개가", "끄덕"), (False, "없는", "말"), (False, "", "끄덕"), (True, "고개가", "끄덕여져요")], "title boolean, w1 string, w2 string")
    out = ids(pairdefects.continuations(windows, asked), "title", "w1", "w2", "ends", "goes_on")
    assert out == [(False, "", "끄덕", 0, 1), (False, "고개가", "끄덕", 1, 11), (False, "고개가", "끄덕여", 0, 11), (False, "없는", "말", 0, 0), (True, "고개가", "끄덕여져요", 5, 0)]


def test_short_refusals():
    said = ["Cannot comply.", "Lo siento, no.", "Desculpe, não.", "Xin lỗi, tôi", "Sinto muito, não.", "I must decline.", "Als KI nein.", "죄송합니다, 도와드리기 어렵습니다."]
    assert [x for x in said if not pairdefects.refuses(x)] == []
    assert not pairdefects.refuses("Nesinu 마들렌 이야기를 들려주세요.")


def test_length_limits(spark):
    rows = [(100, True)] * 60 + [(n, False) for n in range(90, 110) for _ in range(3)]
    assert ids(pairdefects.length_limits(spark.createDataFrame(rows, "size int, open boolean")), "size", "limit") == [(100, True)]


# ---- 8 and 9


def test_best_two_fit():
    rng = np.random.default_rng(10)
    for cap in (50, 512):
        sizes = rng.integers(1, cap + 1, 800)
        bins = packing.best_two_fit(sizes, cap)
        fill = np.bincount(bins, weights=sizes)
        assert fill.max() <= cap and fill.min() > 0 and len(fill) <= 1.12 * -(-sizes.sum() // cap)
    # the smallest gives way to two that fill the gap
    assert len(set(packing.best_two_fit(np.array([6, 3, 2, 2]), 10).tolist())) == 2
    assert list(packing.best_two_fit(np.array([], np.int64), 10)) == []


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 50)
    rng = random.Random(11)
    rows = [(i, rng.randint(0, 300)) for i in range(400)] + [(1000, 2500), (1001, None), (3, 7), (1002, 512)]
    sizes = spark.createDataFrame(rows, "id long, tokens long")
    out = packing.pack(sizes, spark.createDataFrame([("s", 512), ("l", 2048), ("none", None), ("zero", 0)], "container string, capacity int")).collect()
    for c, cap in (("s", 512), ("l", 2048)):
        own = [r for r in out if r.container == c]
        assert sum(r.size for r in own) == sum(t or 0 for _, t in rows)
        assert {(r.id, r.piece) for r in own} >= {(i, 0) for i, _ in rows} and len([r for r in own if r.id == 1000]) == -(-2500 // cap)
        fill = {}
        for r in own:
            if r.size:
                fill[r.bin] = fill.get(r.bin, 0) + r.size
            else:
                assert r.bin is None
        assert max(fill.values()) <= cap and len(fill) <= 1.05 * -(-sum(fill.values()) // cap) + 1
    assert {r.container for r in out} == {"s", "l"}
    assert packing.pack(sizes, spark.createDataFrame([], "container string, capacity int")).count() == 0
    empty = packing.pack(sizes.limit(0), spark.createDataFrame([("s", 512)], "container string, capacity int"))
    assert empty.count() == 0


def test_token_sizes(spark):
    rows = [(1, "hello world"), (2, None), (3, ""), (4, LONG), (1, "<|endoftext|>")]
    got = tokens.token_sizes(clashing(spark, rows), "id_", "text", ["source"])
    by = [(r.id, r.tokens) for r in got.collect()]
    assert got.columns == ["id", "source", "tokens"] and by[1][1] == by[2][1] == 0 and 2 <= by[0][1] <= 3 and by[4][1] > 1 and by[3][1] > 1000


def test_mixing(spark):
    rng = random.Random(12)
    rows = [(i, ["big", "small", "tiny", "other", None][i % 5 if i < 300 else 0], rng.randint(1, 900)) for i in range(3000)] + [(9000, "big", 0), (9001, "big", None)]
    sizes = spark.createDataFrame(rows, "id long, source string, tokens long")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 4), ("tiny", 0.1, 2), ("gone", 0.1, 3)], "source string, target_share double, max_repeats int")
    copies, report = mixing.mix(sizes, targets)
    by = {r.source: r for r in report.collect()}
    assert by["gone"].mixed_tokens == 0 and sum(r.actual_share for r in by.values()) == pytest.approx(1)
    assert all(by[s].actual_share == pytest.approx(x / 0.9, rel=0.02) for s, x in (("big", 0.5), ("small", 0.3), ("tiny", 0.1)))
    assert all(by[s].most_repeats <= m for s, m in (("big", 1), ("small", 4), ("tiny", 2)))
    got = copies.collect()
    assert len(got) == len(rows) and all(r.copies == 0 for r in got if r.source in (None, "other") or not r.tokens)
    # a total out of reach: the cap holds, and the report says so
    _, report = mixing.mix(sizes, targets, 1e9)
    assert all(r.most_repeats <= r.max_repeats for r in report.collect())
    copies, report = mixing.mix(sizes.limit(0), targets)
    assert copies.count() == 0 and report.count() == 4 and all(r.mixed_tokens == 0 for r in report.collect())


# ---- 10

CODES = {"ko": "Korean", "en": "English", "de": "German"}
SAID = {
    "ko": ["오늘은 날씨가 좋아서 산책을 나갔어요", "새로 산 의자가 아주 편하고 마음에 들어요", "주말에는 가족과 함께 시장에 다녀왔어요"],
    "en": ["the weather was nice today so we went for a walk", "my new chair is comfortable and I like the colour", "we went to the market with the family at the weekend"],
    "de": ["das Wetter war heute schön und wir sind spazieren gegangen", "mein neuer Stuhl ist bequem und die Farbe gefällt mir", "wir waren am Wochenende mit der Familie auf dem Markt"],
}


def test_label_codes():
    known = language.spellings(CODES)
    assert [language.label_code(x, known) for x in ("ko-KR", "KOR", "한국어", "Korean", "en_GB", "Deutsch", None, "", "??", "und", "fr")] == ["ko", "ko", "ko", "ko", "en", "de", None, None, None, None, "fr"]


def test_one_noisy_label_does_not_move_the_threshold():
    p = np.array([[0.99, 0.01]] * 3000 + [[0.7, 0.3]] * 50)
    target = np.array([1] + [0] * 2999 + [1] * 50)
    assert language._threshold(p, target) == pytest.approx(0.9) and language._threshold(p, np.zeros(3050, int)) == pytest.approx(0.7)


def test_names_in_another_script_are_blank():
    codes, _ = language._prepared(["Luvaru 라디오와 색 조합\nthe chair of 라디오 and so on", ""])
    assert "".join(map(chr, codes)) == "       라디오와 색 조합 the chair of     and so on "


def test_languages(spark):
    rng = random.Random(13)
    rows = []
    for i in range(240):
        lang = list(SAID)[i % 3]
        text = "\n".join(" ".join(rng.sample(x.split(), 5)) for x in rng.choices(SAID[lang], k=3))
        rows.append((i, text, lang if rng.random() > 0.08 else rng.choice(list(SAID))))
    rows += [(900, SAID["ko"][0] + "\n\n" + SAID["en"][1] + "\nOK!", "ko"), (901, None, "ko"), (902, "", None), (903, LONG, "en"), (904, SAID["de"][0].upper(), "German"), (904, SAID["de"][0], "??"), (905, "!!! 12", "ko")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc long, t string, lab string, id string, text string")
    tagger = language.fit_tagger(df, "doc", "t", "lab", CODES)
    tags = language.tag_languages(df, "doc", "t", "lab", CODES, tagger)
    top = [(r.id, r.lang) for r in tags.where("line_no = 0").collect()]
    assert len(top) == len(rows)
    assert np.mean([lang == list(SAID)[i % 3] for i, lang in top if i < 240]) > 0.99
    found = ids(language.mislabelled(tags).where("id >= 900"), "id", "line_no", "lang")
    assert found == [(900, 1, "ko"), (900, 3, "en"), (900, 4, "en"), (903, 0, "ko"), (904, 0, "de")] or found == [(900, 1, "ko"), (900, 3, "en"), (900, 4, "ko"), (903, 0, "ko"), (904, 0, "de")]
    assert {i: x for i, x in top if i in (901, 902, 905)} == {901: None, 902: None, 905: None}
    assert language.tag_languages(df.limit(0), "doc", "t", "lab", CODES, tagger).count() == 0
    nothing = language.fit_tagger(df.limit(0), "doc", "t", "lab", CODES)
    assert {r.lang for r in language.tag_languages(df, "doc", "t", "lab", CODES, nothing).collect()} == {None}
