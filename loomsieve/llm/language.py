"""Document and line languages (problem 10).

A line is the average of hashed subword embeddings (runs of one and three characters)
under a linear softmax, trained by stochastic gradient descent in numpy on pieces of
labelled documents: a bounded sample (``Sample``) of each language, drawn by hash over
the whole table and over the whole texts. Labels are noisy, so pieces that a first model
denies are left out of the second. A temperature and a rejection threshold are set on
held-out pieces: the least confidence above which errors are rare enough. After
training, embedding and softmax fold into one table of scores for each hash bucket;
tagging is map-only over whole texts.

Null and blank texts get language null with confidence 0; a line that is too short or
too doubtful to tell takes the language of its document.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomsieve.llm.repetition import _word_chars
from loomsieve.llm.sketches import mix

@dataclass(frozen=True)
class Sample:
    """Bound on the labelled rows to train on: documents of each language and different
    pieces of each; a piece is a line or at most ``chars`` characters of one, from
    anywhere in the text."""

    documents: int = 300
    of_document: int = 4
    chars: int = 200


#: Share of held-out pieces above the rejection threshold that may be misjudged, and the
#: range of the threshold.
ERRORS, LEAST, MOST = 0.002, 0.6, 0.9
BUCKETS, DIM = 1 << 16, 16
#: Letters that a line needs to speak for itself (syllables and ideographs count thrice).
LETTERS = 22
#: Characters that are scored at once.
CHUNK = 400_000

# Three-letter codes and own names of languages.
CODES = {
    "ko": ("kor", "한국어", "조선말"), "en": ("eng",), "ja": ("jpn", "日本語"), "zh": ("zho", "chi", "cmn", "中文", "汉语", "漢語"), "es": ("spa", "español", "espanol", "castellano"),
    "pt": ("por", "português", "portugues"), "de": ("deu", "ger", "deutsch"), "vi": ("vie", "tiếng việt", "tieng viet"), "ru": ("rus", "русский", "русский язык"),
}
# Labels that name no language.
MEANINGLESS = {"", "und", "unknown", "unk", "xx", "xxx", "none", "null", "n/a", "na", "other", "mul", "mis", "zxx", "?", "??", "???", "-", "--"}


def spellings(codes: dict[str, str]) -> dict[str, str]:
    """The code of every way to write a language of ``codes`` (code to name)."""
    known = {v.lower(): k for k, v in codes.items()}
    for code, others in CODES.items():
        known |= {code: code} | dict.fromkeys(others, code)
    return known | {c: c for c in codes}


def label_code(label: str | None, known: dict[str, str]) -> str | None:
    """The code that a label means in whatever spelling; None for missing or
    meaningless ones, the label itself if it names something unknown."""
    if label is None:
        return None
    x = unicodedata.normalize("NFKC", label).strip().lower()
    if x in MEANINGLESS or not any(map(str.isalpha, x)):
        return None
    return known.get(x) or known.get(re.split(r"[-_ (]", x)[0]) or x


@cache
def _scripts() -> np.ndarray:
    """For each code point 0 unless it is a letter, else its script: 1 Latin, 2 Hangul, 3
    kana and ideographs, 4 Cyrillic, 5 any other."""
    out = np.where(_word_chars(), np.uint8(5), np.uint8(0))
    out[48:58] = 0
    for script, ranges in ((1, ((0x41, 0x24F), (0x1E00, 0x1EFF))), (2, ((0x1100, 0x11FF), (0x3131, 0x318E), (0xAC00, 0xD7A3))), (3, ((0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF))), (4, ((0x400, 0x52F),))):
        for lo, hi in ranges:
            out[lo : hi + 1] = np.where(out[lo : hi + 1] > 0, script, 0)
    return out


def _prepared(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in lower case, and the line of each (over all texts;
    a text ends its line). Marks, digits, and letters of another script than most of
    the line's (names and tags) become blanks."""
    codes = np.frombuffer("\n".join(t.lower() for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    line = np.cumsum(codes == 10)
    line[codes == 10] -= 1
    script = _scripts()[codes]
    letters = np.bincount(line * 6 + script, weights=np.where(codes >= 0x1100, 3, 1), minlength=6 * (int(line[-1]) + 1 if len(line) else 0)).reshape(-1, 6)
    letters[:, 0] = 0
    return np.where((script > 0) & (script == letters.argmax(1)[line]), codes, np.uint32(32)), line


def _features(codes: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, line) of every single letter and every run of three characters."""
    c = codes.astype(np.uint64)
    one = np.flatnonzero(codes != 32)
    n = max(0, len(c) - 2)
    three = np.flatnonzero((line[:n] == line[2:]) & (codes[1 : n + 1] != 32)) if n else np.empty(0, np.int64)
    grams = np.concatenate([c[one], c[three] << np.uint64(42) | c[three + 1] << np.uint64(21) | c[three + 2]])
    return (mix(grams) & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate([line[one], line[three]])


class Tagger:
    """The trained model: scores of each bucket, bias, temperature, rejection."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, least: float) -> None:
        self.langs, self.table, self.bias, self.temperature, self.least = langs, table.astype(np.float32), bias, temperature, least

    def _scores(self, codes: np.ndarray, line: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
        bucket, owner = _features(codes, line)
        total, count = np.zeros((lines, len(self.langs))), np.bincount(owner, minlength=lines)
        cuts = np.flatnonzero(np.diff(owner) < 0) + 1  # single letters, then runs of three
        for b, o in zip(np.split(bucket, cuts), np.split(owner, cuts), strict=True):
            if len(o):
                starts = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
                total[o[starts]] += np.add.reduceat(self.table[b], starts, axis=0)
        return total / np.maximum(count, 1)[:, None] + self.bias, count

    def lines_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all lines of all texts: text, logits, letters (weighed)."""
        per = np.fromiter((t.count("\n") + 1 for t in texts), np.int64, len(texts))
        owner = np.repeat(np.arange(len(texts)), per)
        codes, line = _prepared(texts)
        logits, _ = self._scores(codes, line, len(owner))
        weigh = np.where(codes >= 0x1100, 3, 1) * (codes != 32)
        return owner, logits / self.temperature, np.bincount(line, weights=weigh, minlength=len(owner))

    def speaks(self, texts: list[str]) -> list[str | None]:
        """The language of each text taken as one line; None where it is too short or
        too doubtful."""
        out: list[str | None] = []
        lo, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= CHUNK or i + 1 == len(texts):
                _, logits, letters = self.lines_of([x.replace("\n", " ") for x in texts[lo : i + 1]])
                if not self.langs:
                    out += [None] * (i + 1 - lo)
                else:
                    p = _softmax(logits)
                    sure = (letters >= LETTERS) & (p.max(1) >= self.least)
                    out += [self.langs[k] if ok else None for k, ok in zip(p.argmax(1), sure, strict=True)]
                lo, size = i + 1, 0
        return out

    def tag(self, texts: list[str]) -> list[tuple[str | None, float, list[tuple[int, str, float]]]]:
        """(language, confidence, lines) of each text; lines (number, language,
        confidence) of the non-blank ones, empty unless the text is mixed."""
        if not self.langs:
            return [(None, 0.0, []) for _ in texts]
        owner, logits, letters = self.lines_of(texts)
        p = _softmax(logits)
        best, sure = p.argmax(1), p.max(1)
        speaks = (letters >= LETTERS) & (sure >= self.least)
        weight = letters * np.where(speaks, 1.0, 0.05)
        votes = np.zeros((len(texts), len(self.langs)))
        np.add.at(votes, owner, p * weight[:, None])
        said = np.zeros((len(texts), len(self.langs)), bool)
        said[owner[speaks], best[speaks]] = True
        start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        out = []
        for i, t in enumerate(texts):
            if not votes[i].any():
                out.append((None, 0.0, []))
                continue
            main, conf = int(votes[i].argmax()), float(votes[i].max() / votes[i].sum())
            lines = []
            if said[i].sum() > 1:
                for k, x in enumerate(t.split("\n")):
                    if x.strip():
                        j = start[i] + k
                        lines.append((k + 1, self.langs[best[j]] if speaks[j] else self.langs[main], float(sure[j] if speaks[j] else p[j, main])))
            out.append((self.langs[main], conf, lines))
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _fit(texts: list[str], y: np.ndarray, classes: int, seed: int, least_steps: int = 400, rate: float = 8.0) -> tuple[np.ndarray, np.ndarray]:
    """Stochastic gradient descent on embeddings and softmax; the folded table, bias."""
    rng = np.random.default_rng(seed)
    # features start at nothing, so that unseen ones say nothing
    emb, soft, bias = np.zeros((BUCKETS, DIM), np.float32), rng.normal(0, 0.5, (DIM, classes)), np.zeros(classes)
    codes, line = _prepared([t.replace("\n", " ") for t in texts])
    bucket, owner = _features(codes, line)
    n = np.bincount(owner, minlength=len(texts))
    # different features of a text with their counts
    key, count = np.unique(owner * BUCKETS + bucket, return_counts=True)
    owner, bucket = key // BUCKETS, key % BUCKETS
    share = (count / n[owner]).astype(np.float32)[:, None]
    ends = np.searchsorted(owner, np.arange(len(texts) + 1))
    steps, batch = 0, 64
    epochs = max(4, -(-least_steps // max(1, -(-len(texts) // batch))))
    total = epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        mixed = rng.permutation(len(texts))
        for lo in range(0, len(texts), batch):
            rows = [i for i in mixed[lo : lo + batch] if ends[i + 1] > ends[i]]
            if not rows:
                continue
            at = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in rows])
            own, part, many = bucket[at], share[at], np.array([ends[i + 1] - ends[i] for i in rows])
            h = np.add.reduceat(emb[own] * part, np.r_[0, np.cumsum(many)[:-1]], axis=0)
            g = _softmax(h @ soft + bias)
            g[np.arange(len(rows)), y[rows]] -= 1
            g *= rate * (1 - steps / total) / len(rows)
            back = (g @ soft.T).astype(np.float32)
            soft -= h.T @ g * 0.2
            bias -= g.sum(0) * 0.02
            order = np.argsort(own, kind="stable")
            own = own[order]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            emb[own[first]] -= 8 * np.add.reduceat((np.repeat(back, many, axis=0) * part)[order], first, axis=0)
            steps += 1
    return emb @ soft, bias


def train(texts: list[str], labels: list[str], langs: list[str], documents: list[int]) -> Tagger:
    """Fit on pieces; those of every fifth document are held out for temperature and
    rejection. Pieces that a model of the other half of the documents denies, as their
    label is wrong or they are foreign, teach and test nothing."""
    y, of = np.array([langs.index(x) for x in labels]), np.array(documents)
    held, half = of // 2 % 5 == 0, of % 2
    own = lambda tagger, rows: tagger.lines_of([texts[i].replace("\n", " ") for i in rows])[1]
    right = np.zeros(len(y), bool)
    for h in (0, 1):
        learn, judge = np.flatnonzero(half == h), np.flatnonzero(half != h)
        if len(learn) and len(judge):
            model = Tagger(langs, *_fit([texts[i] for i in learn], y[learn], len(langs), 1), 1.0, 0.0)
            right[judge] = own(model, judge).argmax(1) == y[judge]
    keep, test = np.flatnonzero(right & ~held), np.flatnonzero(right & held)
    if not len(keep) or not len(test):
        keep, test = np.arange(len(y)), np.arange(len(y))
    second = Tagger(langs, *_fit([texts[i] for i in keep], y[keep], len(langs), 2), 1.0, 0.0)
    logits, target = own(second, test), y[test]
    best = min((0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.5), key=lambda s: -np.log(_softmax(logits / s)[np.arange(len(target)), target] + 1e-9).mean())
    second.temperature, second.least = best, _threshold(_softmax(logits / best), target)
    return second


def _threshold(p: np.ndarray, target: np.ndarray) -> float:
    """The least confidence at and above which at most ``ERRORS`` of the held-out pieces
    are misjudged; one noisy label doesn't move it to the end of the range."""
    order = np.argsort(-p.max(1), kind="stable")
    wrong = np.cumsum((p.argmax(1) != target)[order])
    sure = p.max(1)[order]
    last = np.r_[sure[1:] < sure[:-1], True] if len(sure) else np.zeros(0, bool)  # of equal ones
    fine = np.flatnonzero((wrong <= ERRORS * np.arange(1, len(wrong) + 1)) & last)
    return float(np.clip(sure[fine[-1]], LEAST, MOST)) if len(fine) else MOST


def fit_tagger(df: DataFrame, id_col: str, text_col: str, label_col: str, codes: dict[str, str], sample: Sample = Sample()) -> Tagger:
    """Train on a sample of the labelled documents of each language of ``codes`` (code to
    name). Without any labelled text the tagger knows no language, and every text has
    language null. Labels are matched where they are read; the driver gets a count for
    each language and the sampled pieces."""
    known = spellings(codes)

    @F.pandas_udf("string")
    def meant(labels: pd.Series) -> pd.Series:
        return labels.map({x: c for x in labels.unique() if (c := label_code(x, known)) in codes})

    docs = df.where(F.col(f"`{label_col}`").isNotNull()).select(meant(F.col(f"`{label_col}`").cast("string")).alias("code"), F.col(f"`{text_col}`").cast("string").alias("text"), F.xxhash64(F.col(f"`{id_col}`"), F.lit(10)).alias("h"))
    n = {r.code: r["count"] for r in docs.where("code IS NOT NULL").groupBy("code").count().collect()}
    if not n:
        return Tagger([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    share = df.sparkSession.createDataFrame([(c, min(1.0, sample.documents / k)) for c, k in n.items()], "code string, share double")
    rows = docs.join(F.broadcast(share), "code").where(F.pmod("h", F.lit(1_000_000)) < F.col("share") * 1_000_000)
    pieces = rows.select("code", "h", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"([^\\n]{{1,{sample.chars}}})")))).alias("piece")).where(F.length("piece") >= 8)
    drawn = F.row_number().over(Window.partitionBy("code", "h").orderBy(F.xxhash64("piece", F.lit(12)), "piece"))
    taken = pieces.withColumn("n", drawn).where(F.col("n") <= sample.of_document).orderBy("code", "h", "n").collect()
    mixed = [taken[i] for i in np.random.default_rng(12).permutation(len(taken))]
    return train([r.piece for r in mixed], [r.code for r in mixed], [c for c in codes if any(r.code == c for r in taken)], [r.h & ((1 << 62) - 1) for r in mixed])


def tag_languages(df: DataFrame, id_col: str, text_col: str, label_col: str, codes: dict[str, str], tagger: Tagger) -> DataFrame:
    """Operator: (id, line_no, lang, confidence, mixed, label_lang). line_no 0 is the
    document; a mixed document has a row for each non-blank line as well. label_lang is
    the code that the given label means, null if missing or meaningless."""
    known = spellings(codes)
    shared = df.sparkSession.sparkContext.broadcast(tagger)

    def tag(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, labels, texts = b["id"].to_pylist(), b["label"].to_pylist(), [t or "" for t in b["text"].to_pylist()]
            rows, lo, size = [], 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= CHUNK or i + 1 == len(texts):
                    for j, (lang, conf, lines) in enumerate(shared.value.tag(texts[lo : i + 1]), lo):
                        said = label_code(labels[j], known)
                        rows.append((ids[j], 0, lang, conf, bool(lines), said))
                        rows += [(ids[j], k, x, c, True, said) for k, x, c in lines]
                    lo, size = i + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.bool_(), pa.string()), strict=True)], names=["id", "line_no", "lang", "confidence", "mixed", "label_lang"])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{label_col}`").cast("string").alias("label"))
    return rows.mapInArrow(tag, "id long, line_no int, lang string, confidence double, mixed boolean, label_lang string")


def mislabelled(tags: DataFrame) -> DataFrame:
    """(id, line_no, lang): documents in one language with a missing or wrong label, and
    all lines of mixed ones."""
    wrong = F.col("label_lang").isNull() | (F.col("label_lang") != F.col("lang"))
    return tags.where(F.col("lang").isNotNull() & F.when(F.col("mixed"), F.col("line_no") > 0).otherwise(wrong)).select("id", "line_no", "lang")
