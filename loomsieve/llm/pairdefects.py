"""Broken prompt and response pairs (problem 7).

Breaks are found from the whole table. The answers' words are sorted as windows of two
words, and the last words of an answer without a final mark are compared with their
neighbours in that order: where what begins like them goes on inside the word or the
sentence, and hardly ever ends there, the answer is a shortened version of the others'
wording. Where no neighbour begins with its last two words, the last word alone is
compared, and where no neighbour begins with that, words with the same end; a text that
trails off in an ellipsis is broken off unless these say that it ends. Spikes of the length distribution show length limits. Then the rules decide,
one defect for an answer at most, in the order empty, refusal, copy, other_language,
truncated. Languages come from the tagger of problem 10.

A null answer is ``empty``; a null prompt is Korean and can't be copied. Repeated rows
are judged alike; an answer counts once as evidence however often it stands in the
table. Without evidence an answer is not truncated. Texts are read whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsieve.llm import textform
from loomsieve.llm.language import Tagger
from loomsieve.storage import materialize

# Words that stand for no answer (bare form).
NO_ANSWER = {"없음", "응답없음", "답변없음", "무응답", "해당없음", "내용없음", "na", "none", "null", "nil", "nan", "empty", "noanswer", "noresponse", "undefined", "なし", "無", "无", "無回答", "没有", "ninguno", "nenhum", "keine", "không", "нет"}
# Ways to decline a task, by script, and what a text must hold to be searched.
REFUSALS = {
    "[가-힣]": [r"수 없(습니다|어요|네요|음)|도와드리기 어렵|도와 ?드릴 수 없|진행이 불가능|불가능합니다|거절할 수밖에|거절하겠|응답하지 않겠|답변하지 않겠|다룰 수 없어|언어 모델이라|인공지능이라|정책에 맞지 않아|안전상의 이유로"],
    "[\u3040-\u30ff\u4e00-\u9fff]": [
        r"お(答え|手伝い|応え)?(する|が)?(こと)?(は|が)?でき(ません|かねます)|お断り|いたしかねます|言語モデル|回答(は|を)?(控え|差し控え)|対応できません|申し訳(ありません|ございません)",
        r"(无法|不能|不便|拒绝)(为您|帮|协助|回答|提供|完成|满足|处理|回应|写|讨论|继续)|抱歉，|对不起，|语言模型|人工智能模型",
    ],
    "[\u0400-\u04ff]": [r"не (могу|смогу|можем) (помочь|ответить|выполнить|написать|сделать|обсуждать|продолжить|предоставить)|извините,? (но )?я не|вынужден(а)? отказать|языков(ая|ой) модел|к сожалению, я не"],
    # every pattern below has a letter, a blank and a letter in a row, give or take a comma
    r"[A-Za-z\u00c0-\u024f\u1e00-\u1eff],? [A-Za-z\u00c0-\u024f\u1e00-\u1eff]": [
        r"\b(i|we) (must|have to|need to) (decline|refuse)|\b(can ?not|can['’]?t|could not|unable to|won['’]t be able to|not able to|will not|won['’]t) (help|assist|comply|answer|respond|provide|comment|write|fulfil|fulfill|do that|continue|complete|create|discuss|share)|\bas an? (ai|artificial|language model)",
        r"no puedo (ayudar|responder|cumplir|hacer|escribir|atender|contestar|continuar|completar)|lo siento, (pero )?no|debo (rechazar|negarme)|como modelo de|no me es posible|me temo que no",
        r"não posso (ajudar|responder|atender|cumprir|fazer|escrever|continuar|completar)|(desculpe|sinto muito|lamento), (mas )?(não|eu não)|como (um )?modelo de|preciso recusar|não (é|me é) possível",
        r"(kann|darf|möchte|werde) ich (leider |dabei |dir |ihnen |das )*(nicht|keine)|ich (kann|darf) (leider |dabei |ihnen |dir |das |diese |darauf )*(nicht|keine)|tut mir leid|muss ich (leider )?ablehnen|als (ki|sprachmodell)",
        r"(tôi |mình )?không thể (giúp|trả lời|hỗ trợ|thực hiện|viết|đáp ứng|làm|cung cấp|tiếp tục)|xin lỗi,? (nhưng )?tôi|mô hình ngôn ngữ|tôi (xin|phải) từ chối",
    ],
}
_REFUSALS = [(re.compile(k), re.compile("|".join(v), re.IGNORECASE)) for k, v in REFUSALS.items()]


def refuses(text: str) -> bool:
    return any(has.search(text) and said.search(text) for has, said in _REFUSALS)


# Labels of a prompt's lines that hold the question.
QUESTION_LABELS = re.compile(r"^(현재 질문|첫 질문|질문|question|current question|first question|pregunta( actual)?|pergunta( atual)?|(aktuelle )?frage|(текущий )?вопрос|câu hỏi( hiện tại)?|質問|現在の質問|问题|当前问题)\s*[:：]\s*", re.IGNORECASE)
LABEL = re.compile(r"^[^:：\n]{1,30}[:：]\s*")
FINAL = ".?!。？！"
CLOSERS = "\"'”’」』)]}*_~ \t\r\n​"
#: Marks after which a sentence or a part of one is complete.
PAUSES = FINAL + ",，、;；:：~"
#: Windows that must go on for each one that ends, for a text to be taken for broken off.
GOES_ON = 20
#: A length is a limit if it holds this many times the answers of the lengths around it.
SPIKE = 5


def _parts(text: str) -> tuple[str, str, str]:
    """(state, comment, rest): state is text, object or broken for JSON that breaks off."""
    s = text.strip()
    if s and s[0] in "{[":
        try:
            o = json.loads(s)
        except (ValueError, RecursionError):
            return ("broken", s, "") if s[0] == "{" else ("text", s, "")
        if isinstance(o, dict):
            own = [v for v in (o.get("comment"), o.get("next_question")) if isinstance(v, str)] or [v for v in o.values() if isinstance(v, str)]
            return "object", own[0] if isinstance(o.get("comment"), str) or "comment" not in o and own else "", " ".join(own[1:])
        return "object", " ".join(v for v in o if isinstance(v, str)) if isinstance(o, list) else "", ""
    return "text", s, ""


def _tail(said: str) -> tuple[bool, str]:
    """(ends with a final mark, the text without marks at its end)."""
    s = said.rstrip(CLOSERS)
    cut = s.endswith(("…", "..."))
    bare = s.rstrip(FINAL + "…·・,，、" + CLOSERS)
    return s[-1:] in tuple(FINAL) and not cut and bool(s), bare


def _is_copy(bare: str, asked: list[str]) -> bool:
    """The bare answer is one of the bare prompts, give or take a label or a mark."""
    return any(q and (bare == q or len(q) >= 8 and q in bare and len(bare) <= len(q) + max(3, len(q) // 8)) for q in asked)


#: Texts that are their own plain form.
_USUAL = re.compile("[\x01-\x7f가-힣\u4e00-\u9fff\u3041-\u3096\u30a1-\u30ff]*")
_MARKS = re.compile(r"[\W_]+")
_KEYS = re.compile(r'"(comment|next_question)"\s*:')
_AFTER, _PAUSE = PAUSES + "…·" + CLOSERS, frozenset(PAUSES)
_SCHEMA = "id long, field string, defect string, said string, title boolean, open boolean, size int, w1 string, w2 string"
#: A tagger's languages of many texts: code, or None where it is too short or doubtful.
Speaks = Callable[[list[str]], list[str | None]]


def _judged(batches: Iterable[pa.RecordBatch], names: list[str], speaks: Speaks) -> Iterator[pa.RecordBatch]:
    """Rules that need nothing but the row; open: truncated if the evidence says so."""
    for b in batches:
        rows, texts, heard = [], {}, {}
        for sid, task, prompt, answers in zip(b["id"].to_pylist(), b["task"].to_pylist(), b["prompt"].to_pylist(), zip(*(b[n].to_pylist() for n in names), strict=True), strict=True):
            lines = (prompt or "").split("\n")
            question = next((m for x in lines if QUESTION_LABELS.match(x) and (m := QUESTION_LABELS.sub("", x))), None)
            asked = (question or "", prompt or "", "".join(LABEL.sub("", x) for x in lines))
            title = re.sub(r"[\s_-]", "", task or "").lower() == "title"
            wanted = (question or LABEL.sub("", lines[0])) if prompt and prompt.strip() else None
            texts.update(dict.fromkeys(asked))
            heard[wanted] = None
            for name, answer in zip(names, answers, strict=True):
                state, comment, rest = _parts(answer or "")
                spoken = _KEYS.sub(" ", comment) if state == "broken" else f"{comment} {rest}"
                rows.append((sid, name, title, answer or "", state, comment, spoken, asked, wanted))
                texts[answer or ""] = texts[comment] = heard[spoken] = None
        unusual = [t for t in texts if not _USUAL.fullmatch(t)]
        plain = {t: t for t in texts} | dict(zip(unusual, textform.plain_texts(unusual), strict=True))
        bare = {t: _MARKS.sub("", p.lower()) for t, p in plain.items()}
        heard.pop(None, None)
        of = dict(zip(heard, speaks(list(heard)), strict=True)) | {None: "ko"}
        out = []
        for sid, name, title, answer, state, comment, spoken, asked, wanted in rows:
            all_, own, prompts = bare[answer], bare[comment], [bare[t] for t in asked]
            said, defect, open_, words = plain[comment], None, False, ("", None)
            if not all_ or all_ in NO_ANSWER or (state == "object" and (not own or own in NO_ANSWER)):
                defect = "empty"
            elif refuses(said):
                defect = "refusal"
            elif _is_copy(own, prompts) or _is_copy(all_, prompts):
                defect = "copy"
            elif of[spoken] and of[spoken] != (of[wanted] or "ko"):
                defect = "other_language"
            elif state == "broken":
                defect = "truncated"
            else:
                marked, tail = _tail(said)
                open_ = not marked
                if open_ and (last := tail.split()[-2:]):
                    words = ("", *last)[-2:]
            out.append((sid, name, defect, said, title, open_, len(answer), *words))
        types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int32(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [()] * 9, types, strict=True)], names=["id", "field", "defect", "said", "title", "open", "size", "w1", "w2"])


def _windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(title, w1, w2, ends, goes_on): every two words in a row, w2 without the marks
    after it, in how many texts of the batch a part of a sentence ends there and in how
    many it goes on. The end of a text without a mark says neither, but for titles."""
    for b in batches:
        ends: dict[tuple, int] = {}
        goes_on: dict[tuple, int] = {}
        for text, title in zip(b["said"].to_pylist(), b["title"].to_pylist(), strict=True):
            words = text.split()
            here: tuple[set, set] = set(), set()
            before = ""
            for n, w in enumerate(words, 1):
                core = w.rstrip(_AFTER)
                cut = w.endswith(("…", "..."))
                if core and not cut and not _PAUSE.isdisjoint(w[len(core) :]):
                    here[0].add((title, before, core))
                elif core and n < len(words):
                    here[1].add((title, before, core))
                elif core and title and not cut:
                    here[0].add((title, before, core))
                before = w
            for count, found in zip((ends, goes_on), here, strict=True):
                for k in found:
                    count[k] = count.get(k, 0) + 1
        keys = list(dict.fromkeys([*ends, *goes_on]))
        cols = list(zip(*keys, strict=True)) if keys else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.bool_()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array([ends.get(k, 0) for k in keys], pa.int64()), pa.array([goes_on.get(k, 0) for k in keys], pa.int64())], names=["title", "w1", "w2", "ends", "goes_on"])


def _neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one sorted partition of windows and asked-for beginnings (title, w1, w2, ends,
    goes_on, asked): the beginnings with what their neighbours say. All that begins with
    a text follows it in the order."""
    active: list[list] = []
    for b in batches:
        out = []
        for title, w1, w2, ends, goes_on, asked in zip(*(b[c].to_pylist() for c in ("title", "w1", "w2", "ends", "goes_on", "asked")), strict=True):
            while active and not (active[-1][:2] == [title, w1] and w2.startswith(active[-1][2])):
                out.append(active.pop())
            if asked:
                active.append([title, w1, w2, 0, 0])
                continue
            for a in active:
                if a[2] == w2:
                    a[3] += ends
                    a[4] += goes_on
                else:
                    a[4] += ends + goes_on
        yield _evidence(out)
    yield _evidence(active)


def _evidence(rows: list[list]) -> pa.RecordBatch:
    types = (pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int64())
    cols = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["title", "w1", "w2", "ends", "goes_on"])


def continuations(windows: DataFrame, beginnings: DataFrame) -> DataFrame:
    """(title, w1, w2, ends, goes_on) for each of ``beginnings`` (title, w1, w2): in how
    many texts the windows (title, w1, w2, ends, goes_on) that begin with it end, and go
    on, there. Windows with another w1, or where that is '' with another first letter of
    w2, are no neighbours, so partitions by them are sorted on their own."""
    rows = windows.withColumn("asked", F.lit(False)).unionByName(beginnings.select("title", "w1", "w2", F.lit(0).cast("long").alias("ends"), F.lit(0).cast("long").alias("goes_on"), F.lit(True).alias("asked")))
    rows = rows.repartition("title", "w1", F.when(F.col("w1") == "", F.substring("w2", 1, 1)).otherwise("")).sortWithinPartitions("title", "w1", "w2", F.desc("asked"))
    return rows.mapInArrow(_neighbours, "title boolean, w1 string, w2 string, ends long, goes_on long")


def length_limits(judged: DataFrame) -> DataFrame:
    """(size, limit): lengths that hold ``SPIKE`` times the answers of those around, most
    of them without an end."""
    lengths = judged.groupBy("size").agg(F.count("*").alias("n"), F.sum(F.col("open").cast("int")).alias("unended"))
    around = lengths.select(F.explode(F.sequence(F.col("size") - 3, F.col("size") + 3)).alias("size"), F.col("n").alias("m"), F.col("size").alias("at")).where("size <> at")
    near = lengths.join(around, "size", "left").groupBy("size", "n", "unended").agg((F.coalesce(F.sum("m"), F.lit(0)) / 6).alias("around"))
    return near.where((F.col("n") > 20) & (F.col("n") > SPIKE * F.col("around")) & (F.col("unended") * 2 > F.col("n"))).select("size", F.lit(True).alias("limit"))


def defective_pairs(df: DataFrame, id_col: str, task_col: str, prompt_col: str, answer_cols: list[str], tagger: Tagger) -> DataFrame:
    """Operator: (id, field, defect), a row for each defective answer. tagger: of
    ``language.fit_tagger``."""
    shared = df.sparkSession.sparkContext.broadcast(tagger)
    c = lambda x: F.col(f"`{x}`").cast("string")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), c(task_col).alias("task"), c(prompt_col).alias("prompt"), *(c(a).alias(a) for a in answer_cols))
    judged = materialize(rows.mapInArrow(lambda it: _judged(it, answer_cols, shared.value.speaks), _SCHEMA), "judged")
    sound = judged.where("defect IS NULL")
    # copies count once in the whole table, else loops of the corpus would outvote it
    windows = sound.select("said", "title").distinct().mapInArrow(_windows, "title boolean, w1 string, w2 string, ends long, goes_on long")
    windows = materialize(windows.groupBy("title", "w1", "w2").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on")), "windows")
    open_ = sound.where("open")
    asked = open_.where("w2 IS NOT NULL").select("title", "w1", "w2").distinct()
    two = materialize(continuations(windows, asked), "neighbours")
    known = F.col("ends") + F.col("goes_on") > 0
    of_word = windows.groupBy("title", "w2").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on")).withColumn("w1", F.lit(""))
    one = continuations(of_word, two.where(~known).select("title", F.lit("").alias("w1"), "w2").distinct()).select("title", "w2", F.col("ends").alias("ends_1"), F.col("goes_on").alias("goes_on_1"))
    end = F.substring("w2", -2, 2)
    ends_alike = of_word.groupBy("title", end.alias("w3")).agg(F.sum("ends").alias("ends_2"), F.sum("goes_on").alias("goes_on_2"))
    found = open_.withColumn("w3", end).join(two, ["title", "w1", "w2"], "left").join(one, ["title", "w2"], "left").join(ends_alike, ["title", "w3"], "left").join(length_limits(judged), "size", "left")
    broken = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) * GOES_ON < F.col(b))
    trails = F.rtrim("said").rlike(r"(…|\.\.\.)$")
    told = F.coalesce(broken("ends", "goes_on"), broken("ends_1", "goes_on_1"), F.when(trails, True), broken("ends_2", "goes_on_2"), F.lit(False))
    cut = F.coalesce("limit", F.lit(False)) | told
    return judged.where("defect IS NOT NULL").select("id", "field", "defect").union(found.where(cut).select("id", "field", F.lit("truncated").alias("defect")))
