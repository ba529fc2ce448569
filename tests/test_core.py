"""Operators against plain-Python models and hand-written edge rows."""

import itertools
import json
import os
import random
import subprocess
import sys

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomsieve.functions import stats
from loomsieve.functions import text as T
from loomsieve.operators import chatml, clean, dedup, quality, scoring, seeds, split
from loomsieve.operators.tasks import TASKS
from loomsieve.sources import readers, writers


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normal_forms(spark):
    given_ = ["\n\t 가나　다  ", "가", " a b ", "A.b!", "...", None, "\x1c x\x85", "​"]
    assert column(spark, given_, T.normal_general) == ["가나 다", "가", "a b", "A.b!", "...", None, "x", "​"]
    assert column(spark, given_, T.normal_hash) == ["가나다", "가", "ab", "ab", "", None, "x", "​"]
    assert column(spark, ["", "  　", None, "a"], T.is_blank) == [True, True, True, False]


def test_json_is_strict(spark):
    given_ = ["123", "[1]", "{'a':1}", '{"a":1} x', "NaN", "", None, '{"a":1}']
    assert column(spark, given_, T.is_json) == [True, True, False, False, True, False, None, True]


@pytest.mark.parametrize("n", [3, 5])
def test_shingles(spark, n):
    texts = ["", "a", "a b", "a b c", "a b c d", "a b c d e", "a b c d e f a b c d e f"]
    for t, got in zip(texts, column(spark, texts, lambda c: T.word_shingles(T.words(c), n)), strict=True):
        w = t.split()
        want = {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
        assert set(got) == want and len(got) == len(want)


def test_text_rules(spark):
    assert column(spark, ["안녕하세요! 😊 반가워요", "안녕하세요", "그냥"], T.strip_greeting) == ["반가워요", "안녕하세요", "그냥"]
    assert column(spark, ["설문 조사  제목", "조사"], T.clean_title) == ["제목", ""]
    assert column(spark, ["<think>a\nb</think> 답", "x"], T.strip_think) == ["답", "x"]
    assert column(spark, ["alc_005_v1_v2", "alc_v1x"], T.base_seed) == ["alc_005", "alc_v1x"]
    assert column(spark, ["주제: a\n답: b", ""], lambda c: T.prompt_line(c, 2, "답: ")) == ["b", ""]


def test_exact_dedup_keeps_the_first(spark):
    rows = [(5, "intro", "같은 글!", None), (3, "ending", "같은글", None), (4, "title", None, "다른"), (6, "intro", " ", None), (7, "intro", None, None), (8, "title", None, "...")]
    df = spark.createDataFrame(rows, "ord long, task_type string, message string, title string")
    for c in {"comment", "next_question_rephrased", "retry_message"}:
        df = df.withColumn(c, F.lit(None).cast("string"))
    kept = dedup.exact_first(dedup.prepare(df))
    assert sorted(r.ord for r in kept.collect()) == [3, 4, 8]
    assert dedup.exact_first(dedup.prepare(df.limit(0))).count() == 0


def greedy_model(links):
    gone, before = set(), {}
    for a, b in links:
        before.setdefault(b, set()).add(a)
    for b in sorted(before):
        if before[b] - gone:
            gone.add(b)
    return gone


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.integers(0, 12), st.integers(0, 12)).filter(lambda x: x[0] < x[1]), max_size=25))
def test_greedy_equals_the_sequential_rule(spark, links):
    got = {r.id for r in dedup.greedy_removed(spark.createDataFrame(sorted(links), "a long, b long")).collect()}
    assert got == greedy_model(links)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_edit_links_are_exact(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("가나ab") for _ in range(rng.randint(0, 7))) for _ in range(70)]
    got = {(r.a, r.b): r.distance for r in dedup.edit_links(spark.createDataFrame(list(enumerate(words)), "ord long, x string"), "ord", "x").collect()}
    want = {(i, j): d for i, j in itertools.combinations(range(70), 2) if (d := edits(words[i], words[j])) <= 2}
    assert got == want


def test_jaccard_links_are_exact_and_lsh_finds_most(spark):
    rng = random.Random(4)
    base = [[rng.choice("abcdefghij") + str(rng.randint(0, 30)) for _ in range(60)] for _ in range(25)]
    rows = []
    for i, w in enumerate(base * 3):
        w = list(w)
        if i >= 25:
            w[rng.randrange(60)] = "new"
        rows.append((i, "response" if i % 2 else "retry", " ".join(w)))
    df = spark.createDataFrame(rows, "ord long, task string, norm string")
    got = {(r.a, r.b) for r in dedup.jaccard_links(df, "ord", "task", "norm").collect()}
    want = set()
    for (i, t, x), (j, u, y) in itertools.combinations(rows, 2):
        s = TASKS[t]
        a, b = ({" ".join(v[k : k + s.shingle]) for k in range(len(v) - s.shingle + 1)} for v in (x.split(), y.split()))
        if t == u and len(a & b) / len(a | b) >= s.jaccard:
            want.add((i, j))
    assert got == want
    near = {(r.a, r.b) for r in dedup.lsh_candidates(df.where("task = 'response'"), "ord", "task", "norm").collect()}
    mine = {p for p in want if rows[p[0]][1] == "response"}
    assert len(mine & near) >= 0.8 * len(mine)


def test_lsh_takes_the_shingles_of_the_task(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(0, "retry", " ".join(words)), (1, "retry", "a b c d"), (2, "retry", "a b c d a b"), (3, "title", "x y"), (4, "title", "x y"), (5, None, "x y"), (6, "retry", "a b c d a b c")]
    df = spark.createDataFrame(rows, "ord long, task string, norm string")
    got = {(r.a, r.b) for r in dedup.lsh_candidates(df, "ord", "task", "norm").collect()}
    # 2 and 6 have the same words of three, but not of five
    assert (2, 6) in got and (3, 4) in got


def vectors(spark, n=40, groups=2, seed=3):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, i % groups, rng.normal(size=8).tolist()) for i in range(n)] + [(n, 0, [0.0] * 8), (n + 1, 9, [1.0] * 8)], "id long, g int, v array<float>")


def unit(v):
    v = np.array(v, float)
    return v / (np.linalg.norm(v) or 1)


def test_cosine_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 7)
    df = vectors(spark)
    rows = df.collect()
    got = {(r.a, r.b): r.cosine for r in dedup.cosine_links(df, "g", "id", "v", 0.3).collect()}
    want = {(a.id, b.id): float(unit(a.v) @ unit(b.v)) for a, b in itertools.combinations(rows, 2) if a.g == b.g and unit(a.v) @ unit(b.v) >= 0.3}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    new, old = df.where("id % 2 = 0"), df.where("id % 2 = 1 AND g <> 9")
    near = {r.id: r.nearest for r in dedup.nearest_old(new, old, "g", "id", "v").collect()}
    for a in rows:
        if a.id % 2 == 0:
            best = max((float(unit(a.v) @ unit(b.v)) for b in rows if b.id % 2 == 1 and b.g == a.g and b.g != 9), default=None)
            assert near[a.id] is None if best is None else abs(near[a.id] - best) < 1e-9
    mean = {r.grp: r.cosine for r in quality.intra_group_cosine(df, "g", "v").collect()}
    assert 9 not in mean
    own = [unit(r.v) for r in rows if r.g == 0]
    assert abs(mean[0] - np.mean([a @ b for a, b in itertools.combinations(own, 2)])) < 1e-9


def test_cleaning(spark):
    rows = [
        ("response", "", "사진 보여주세요"), ("response", "이미지", "네"), ("title", "", "설문"), ("title", "", "설문 조사 제목"), ("intro", "", "😊"), ("intro", "", "좋아요😊"), ("first_question", "", "안녕하세요. 질문이에요"),
        ("retry", "", "조사해요"), ("other", "", "사진"), ("ending", "", None),
    ]
    df = spark.createDataFrame(rows, "task_type string, user_text string, answer string")
    out = clean.clean(df)
    assert [r.cleaned for r in out.collect()] == [None, None, None, "제목", "😊", "좋아요", "질문이에요", None, "사진", None]
    by = {r.task_type: (r.deleted, r.modified) for r in clean.accounting(out).collect()}
    assert by == {"response": (2, 0), "title": (1, 1), "intro": (0, 1), "first_question": (0, 1), "retry": (1, 0), "other": (0, 0), "ending": (0, 0)}


def test_issue_lists_and_scores(spark):
    rows = [(1, "response", '{"comment": "좋아요.", "next_question": "사진을 보여주실래요?"}'), (2, "response", "{"), (3, "retry", "했다"), (4, "intro", " "), (5, "response", "[1]"), (6, "response", None), (7, "retry", "좋아요ㅋ"), (8, "retry", "좋아요_")]
    got = {r.id: (r.issues, r.passed) for r in scoring.issues(spark.createDataFrame(rows, "id int, task string, generated string")).collect()}
    assert got[1] == (["PHOTO_REQUEST:사진", "PHOTO_REQUEST:보여주"], False) and got[2] == (["JSON_PARSE_FAIL"], False) and got[3][0] == ["NO_HONORIFIC"] and got[4][0] == got[6][0] == ["EMPTY"]
    assert got[5][0] == ["NO_COMMENT_KEY", "NO_NEXT_Q_KEY", "NO_HONORIFIC_COMMENT"] and got[7][0] == got[8][0] == ["NO_HONORIFIC"]
    score, why = scoring.tone_score(F.col("c"))
    df = spark.createDataFrame([("정말 좋은 말씀이에요.",), ("음",), ("설문 사진 " + "가" * 90,)], "c string").select(score.alias("s"), why.alias("w"))
    assert [(r.s, r.w) for r in df.collect()] == [(5, "양호"), (1, "존댓말 미사용, 공감표현 부족, 너무 짧음"), (1, "존댓말 미사용, 공감표현 부족, 너무 김, 금지어 포함, 부적절 요청 포함")]
    again, _ = scoring.rephrase_score(F.col("g"), F.col("e"), F.lit(""))
    df = spark.createDataFrame([("커피는 어떠세요?", ""), ("커피는 어떠세요?", "커피는 주로 언제 드시나요?"), ("사진 있나요?", "사진 있나요?")], "g string, e string").select(again.alias("s"))
    assert [r.s for r in df.collect()] == [5, 4, 5]
    empty = scoring.response_metrics(spark.createDataFrame([], "generated string")).first()
    assert empty.total_evaluated == 0 and empty.json_parse_rate == 0


@pytest.mark.parametrize("n", [0, 1, 2, 19, 20, 100])
def test_nearest_rank(spark, n):
    values = [float((i * 37) % 101) for i in range(n)]
    got = {r.share: r.value for r in stats.nearest_rank(spark.createDataFrame([(v,) for v in values], "v double"), "v", [0.5, 0.95, 0.99]).collect()}
    s = sorted(values)
    assert got == {q: s[int(n * q)] if n else None for q in (0.5, 0.95, 0.99)}


def test_group_split(spark):
    rows = [(i, None if i % 50 == 0 else f"g{i % 300 if i % 4 else 0}", ["a", "b", "only"][0 if i % 7 else 1]) for i in range(4000)]
    out = split.train_val_test(spark.createDataFrame(rows, "ord long, grp string, t string"), "grp", "t")
    split.assert_no_leakage(out, "grp")
    assert out.count() == 4000 and {r[0] for r in out.select("split").distinct().collect()} == {"train", "val", "test"}
    with pytest.raises(ValueError):
        split.assert_no_leakage(out.withColumn("grp", F.lit("same")), "grp")
    assert split.train_val_test(out.drop("split").limit(0), "grp", "t").count() == 0


def test_messages_round_trip(spark):
    row = dict.fromkeys(["ord", "task_type", "seed_id", "base_seed_id", "persona_id", "occasion_id", "topic", "current_question", "user_answer", "next_question_original", "comment", "next_question_rephrased", "message", "target_audience", "first_question_original", "invalid_type", "retry_message", "original_text", "title"])
    full = row | {"ord": 1, "task_type": "response", "topic": "a", "current_question": "b", "user_answer": "c\nd", "next_question_original": "e", "comment": 'x "y" \\ \n', "next_question_rephrased": "한글"}
    rows = [full, full | {"ord": 2, "comment": " "}, full | {"ord": 3, "task_type": "nope"}, row | {"ord": 4, "task_type": "intro", "topic": "t", "message": "m"}]
    schema = ", ".join(f"{k} {'long' if k == 'ord' else 'string'}" for k in row)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    out = {r.ord: r for r in chatml.to_messages(df, {"response": "s"}).collect()}
    assert set(out) == {1, 4}
    said = out[1].messages[2].content
    assert json.loads(said) == {"comment": 'x "y" \\ \n', "next_question": "한글"} and said == json.dumps(json.loads(said), ensure_ascii=False)
    assert out[4].messages[1].content == "주제: t\n타겟: " and out[1].seed_id == ""
    assert {r.task_type: (r.converted, r.errors) for r in chatml.conversion_errors(df).collect()} == {"response": (1, 1), "nope": (0, 1), "intro": (1, 0)}


def test_replies(spark):
    replies = ['{"items": [{"message": " a "}, {"message": ""}]}', '["b", "ccccc"]', '{"message": "d"}', "7", None]
    df = spark.createDataFrame([(f"s{i}", r) for i, r in enumerate(replies)], "seed_id string, reply string")
    got = sorted((r.seed_id, r.message) for r in seeds.replies_to_records(df, "reply", "message", ["seed_id"], 4).collect())
    assert got == [("s0", "a"), ("s1", "b"), ("s2", "d")]


def test_hash_ordinal_is_dense(spark):
    df = spark.createDataFrame([(f"t{i}",) for i in range(700)], "topic string")
    got = [r.topic for r in seeds.hash_ordinal(df, "topic").orderBy("ordinal").collect()]
    import hashlib

    assert got == sorted((f"t{i}" for i in range(700)), key=lambda x: hashlib.md5(x.encode()).hexdigest())


def test_sources_and_sinks(spark, tmp_path):
    d = str(tmp_path)
    df = spark.createDataFrame([(1, "가"), (2, "나")], "a int, b string")
    writers.jsonl(df, f"{d}/x/train.jsonl")
    with pytest.raises(FileNotFoundError):
        readers.splits(spark, f"{d}/none", "a int, b string")
    got = readers.splits(spark, f"{d}/x", "a int, b string")
    assert sorted((r.a, r.b, r.split) for r in got.collect()) == [(1, "가", "train"), (2, "나", "train")]
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.jsonl(spark, f"{d}/bad.jsonl", "a int").collect()
    (tmp_path / "n.jsonl").write_text('{"a": 7}\n{"a": 5}\n')
    assert [(r.a, r.ord) for r in readers.jsonl(spark, f"{d}/n.jsonl", "a int", "ord").collect()] == [(7, 0), (5, 1)]
    assert [(r.file, r.rows) for r in readers.line_counts(spark, f"{d}/n.jsonl").collect()] == [("n.jsonl", 2)]
    writers.replace_with_backup(df, f"{d}/y")
    writers.replace_with_backup(df.limit(1), f"{d}/y")
    assert spark.read.json(f"{d}/y").count() == 1 and spark.read.json(f"{d}/y_raw").count() == 2
    writers.review_sheet(df, f"{d}/sheet.csv", ("score",))
    assert (tmp_path / "sheet.csv").read_bytes().startswith(b"\xef\xbb\xbfa,b,score")
    metrics = spark.createDataFrame([("m", None, 1.0), ("k", "x", 2.0)], "metric string, key string, value double")
    assert writers.report(metrics, f"{d}/r.json") == json.loads((tmp_path / "r.json").read_text()) == {"m": 1.0, "k": {"x": 2.0}}
    legacy = spark.createDataFrame([("response", [("assistant", '{"comment": "a", "next_question": "b"}')]), ("response", [("assistant", "x  y")])], "task_type string, messages array<struct<role: string, content: string>>")
    assert [r.norm for r in readers.legacy_texts(legacy).collect()] == ["a b", "x y"]


def test_small_pieces(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"id": "p1", "name": "가"}, {"id": "p2", "name": "나"}], ensure_ascii=False))
    assert readers.json_document(spark, f"{tmp_path}/d.json", "id string, name string").count() == 2
    assert readers.config(f"{tmp_path}/d.json")[0]["id"] == "p1"
    cases = readers.rows_of(spark, [("a", 0), ("b", 4)], "x string, i int")
    got = cases.select(T.cyclic_pick(["u", "v", "w"], F.col("i")).alias("c"), T.hashed_pick(["u", "v"], F.col("x"), 1).alias("h")).collect()
    assert [r.c for r in got] == ["u", "v"] and all(r.h in "uv" for r in got)
    curve = spark.createDataFrame([(1, 0.5), (3, 0.7), (2, 0.2)], "step int, loss double")
    assert tuple(stats.last_by(curve, "loss", "step").first()) == (0.2, 0.7)
    assert [(r.step, r.a, r.b) for r in writers.full_outer_curves(curve, curve.where("step < 3").union(spark.createDataFrame([(9, 1.0)], curve.schema))).orderBy("step").collect()][2:] == [(3, "0.7000", "—"), (9, "—", "1.0000")]
    cols = sorted({c for s in TASKS.values() for c in (*s.texts, *(x for _, x in s.prompt))})
    ask = spark.createDataFrame([("retry", *(None for _ in cols)), ], "task_type string, " + ", ".join(f"{c} string" for c in cols))
    out = chatml.request_messages(ask, {"retry": "s"}).first().messages
    assert [m.role for m in out] == ["system", "user"] and out[1].content.endswith("too_short")
    with pytest.raises(Exception, match="unknown task"):
        chatml.request_messages(ask.withColumn("task_type", F.lit("nope")), {}).collect()
    writers.seed_document(spark.createDataFrame([("s", "b")], "seed_id string, base_seed_id string"), f"{tmp_path}/seeds", seeds_per_combo=10)
    assert json.loads((tmp_path / "seeds.header.json").read_text()) == {"seeds_per_combo": 10, "total": 1, "base_topics": 1}
    assert "seed_id" in writers.shown(spark.read.json(f"{tmp_path}/seeds"))


def test_rules(spark):
    m = spark.createDataFrame([("starting_phrase_top1", "a", 0.3), ("starting_phrase_top1", "b", 0.2), ("leakage", "x", 1.0), ("latency_p95", None, 3.0)], "metric string, key string, value double")
    assert {(r.metric, r.key) for r in quality.violations(m).collect()} == {("latency_p95", None), ("leakage", "x"), ("starting_phrase_top1", "a")}
    assert {(r.metric, r.key) for r in quality.violations(m, pilot=True).collect()} == {("latency_p95", None)}
    assert quality.verdict(m).first().status == "FAIL" and quality.verdict(m.limit(0)).first().status == "PASS"


def test_every_rule_is_evaluated(spark):
    from loomsieve.plans import catalogue

    m = spark.createDataFrame([("variation_combos", None, 16.0), ("leakage", "a", 0.0), ("xsim_avg", None, None)], "metric string, key string, value double")
    got = {r.metric: r.status for r in quality.evaluated(m).collect()}
    assert got.pop("variation_combos") == "broken" and got.pop("leakage") == "kept" and set(got.values()) == {"not evaluated"} and len(got) == len(quality.RULES) - 2
    v = quality.verdict(m).first()
    assert v.status == "FAIL" and v.reasons == ["variation_combos[] not >= 30.0"] and v.not_evaluated == sorted(got)
    sf = "/root/testdata/sf0.001"
    rules = catalogue.queries()["go_rules"](spark, sf).collect()
    assert {r.metric for r in rules if r.status == "not evaluated"} == {"human_good", "human_bad"}
    broken = {(r.metric, r.key): r.value for r in rules if r.status == "broken"}
    assert broken["variation_combos", None] == 16 and broken["latency_p95", None] == 145.46 and broken["auto_eval_rate", "comment_length_ok"] == 38.80597
    assert {r.metric for r in rules if r.status == "kept"} >= {"xsim_avg", "xsim_max", "auto_eval_rate"}
    v = catalogue.queries()["go_verdict"](spark, sf).first()
    assert len(v.reasons) == len(broken) and v.not_evaluated == ["human_bad", "human_good"] and "latency_p95[] not < 3.0" in v.reasons


def test_curves_are_of_every_vector(spark, tmp_path):
    from loomsieve.plans import catalogue

    spark.createDataFrame([(2, [1.0], 0), (3, [3.0], 7)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(0,), (1,)], "n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    got = {(r.step, r.in_a, r.b) for r in catalogue.queries()["version_full_outer"](spark, str(tmp_path)).collect()}
    assert got == {(0, True, "1"), (1, False, "1"), (7, True, "—")}


def test_curation_counts_telescope(spark):
    from loomsieve.plans.pipeline import CurationConfig, curate

    rows = [(i, "intro", f"{i % 90} 번째 글은 이렇게 시작해서 저렇게 끝나는 글 {i % 90}", f"g{i % 13}") for i in range(100)]
    df = spark.createDataFrame(rows, "ord long, task_type string, message string, base_seed_id string")
    for c in ("comment", "next_question_rephrased", "retry_message", "title"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    rng = np.random.default_rng(1)
    vecs = spark.createDataFrame([(i, rng.normal(size=6).tolist() if i else [1.0] * 6) for i in range(99)], "ord long, vec array<double>")
    old = spark.createDataFrame([("intro", 1, [1.0] * 6)], "task_type string, ord long, vec array<double>")
    out, counts = curate(df, vecs, old, CurationConfig(cosine=0.8))
    c = {r.stage: (r.kept, r.removed) for r in counts.collect()}
    assert list(c) and c["raw"][0] == 100 and c["exact"] == (90, 10) and c["cross_version"][1] >= 1
    assert out.count() == c["cross_version"][0] == 100 - sum(r for _, r in c.values())


def test_stream_dedup(spark, tmp_path):
    from loomsieve.streaming.dedup import first_in_stream

    cols = "ord long, task_type string, message string, comment string, next_question_rephrased string, retry_message string, title string, created_at timestamp"
    rows = [(1, "intro", "a b", None, None, None, None), (2, "ending", "ab", None, None, None, None), (3, "title", None, None, None, None, "c")]
    import datetime

    now = datetime.datetime(2026, 1, 1)
    spark.createDataFrame([(*r, now) for r in rows], cols).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(cols).parquet(f"{tmp_path}/in")
    q = first_in_stream(stream).writeStream.format("memory").queryName("deduped").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("deduped").count() == 2


def test_core_stands_without_the_subpackage():
    code = "import sys; sys.modules['loomsieve.llm'] = None; import __spark_entry__ as e; assert not any(n.startswith('p1_') for n in e.queries()); assert e.oracle_sql()"
    import pathlib

    subprocess.run([sys.executable, "-c", code], check=True, cwd=pathlib.Path(__file__).parent.parent)


def test_reports(spark):
    from loomsieve.operators import reports

    rows = spark.createDataFrame([("a", True), ("a", None), ("b", True), (None, False)], "c string, ok boolean")
    assert {(r.category, r.passed, r.total, r.all_passed) for r in reports.scenario_counts(rows, "c", "ok").collect()} == {("a", 1, 2, False), ("b", 1, 1, True), (None, 0, 1, False)}
    assert {(r.task, r.overall, r.calls, r.success, r.failures) for r in reports.run_counters(rows, "c", "ok").collect()} == {("a", False, 2, 1, 1), ("b", False, 1, 1, 0), (None, False, 1, 0, 1), (None, True, 4, 2, 2)}
    assert reports.mixed_total(spark.createDataFrame([(3, None), (None, 4), (None, None)], "total long, total_evaluated long")).first().total == 7
    stages = spark.createDataFrame([(2, "x", {"a": 0.2, "b": 0.4}, {"a": 0.5, "b": 0.9}), (3, "x", {"a": 1.0}, {"a": 1.0}), (1, "y", None, None)], "step int, name string, avg_by_task map<string,double>, max_by_task map<string,double>")
    assert [tuple(round(v, 6) for v in r) for r in reports.stage_lookup(stages, "x").collect()] == [(0.3, 0.9)] and reports.stage_lookup(stages, "z").count() == 0
    rates = spark.createDataFrame([(95.0, 94.9)], "p double, q double")
    assert [r.passed for r in reports.threshold_report(rates, [("p", 95.0), ("q", 95.0)]).collect()] == [True, False]


def test_replies_with_several_keys(spark):
    rows = spark.createDataFrame([(1, '[{"c": " x ", "n": "y"}, {"c": "z"}]'), (2, '{"items": [{"c": "p", "n": null}]}'), (3, '{"c": "  ", "n": "q"}'), (4, "{"), (5, None), (6, '["text"]')], "i long, r string")
    from loomsieve.operators import seeds

    assert {tuple(r) for r in seeds.records_of_replies(rows, "r", ["c", "n"], ["i"]).collect()} == {(1, "x", "y"), (2, "p", None)}
    assert {tuple(r) for r in seeds.records_of_replies(rows, "r", ["c", "n"], ["i"], strip=False).collect()} == {(1, " x ", "y"), (2, "p", None), (3, "  ", "q")}


def test_rows_by_place(spark):
    from loomsieve.operators import seeds

    a = spark.createDataFrame([(i,) for i in range(50, 0, -1)], "a long").repartition(4)
    b = spark.createDataFrame([(2 * i,) for i in range(50)], "b long").repartition(3)
    assert sorted((r.place, r.a, r.b) for r in seeds.zip_by_place(a, b, ["a"], ["b"]).collect()) == [(i + 1, i + 1, 2 * i) for i in range(50)]
    with pytest.raises(ValueError):
        seeds.zip_by_place(a, b.limit(9), ["a"], ["b"])


def test_token_lengths(spark):
    from loomsieve.functions import tokens
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("hello world",), ("",), (None,)], "t string")
    got = [r[0] for r in rows.select(tokens.token_length(F.col("t"))).collect()]
    assert got == [len(tokens._tokenizer(tokens.VOCABULARY).encode("hello world")), 0, None] and got[0] > 0


def test_greedy_walk_equals_rounds(spark):
    import random

    from loomsieve.operators import dedup

    rng = random.Random(1)
    links = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(80)} | {(i, i + 1) for i in range(100, 106)}, key=lambda e: (e[1], e[0]))
    gone = set()
    for a, b in links:
        if a not in gone and b not in gone:
            gone.add(b)
    df = spark.createDataFrame(links, "a long, b long")
    for few in (10**6, 30):
        assert {r.id for r in dedup.greedy_removed(df, few).collect()} == gone
    assert dedup.greedy_removed(df.limit(0)).count() == 0


def test_storage(spark, monkeypatch):
    from loomsieve import storage

    df = storage.materialize(spark.range(3))
    path = df.__dict__["_stored"]
    assert df.count() == 3 and os.path.isdir(path.removeprefix("file://"))
    storage.drop(df, spark.range(1))
    assert not os.path.exists(path.removeprefix("file://"))

    class Elsewhere:
        master = "yarn"

        def getConf(self):
            return spark.sparkContext.getConf()

    class Session:
        conf, sparkContext = spark.conf, Elsewhere()

    if spark.sparkContext.getConf().get("spark.checkpoint.dir") is None:
        with pytest.raises(RuntimeError):
            storage.shared_dir(Session())
