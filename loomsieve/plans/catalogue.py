"""Every query of the core by name, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomsieve.functions import patterns as P
from loomsieve.functions import stats
from loomsieve.functions import text as T
from loomsieve.functions import tokens
from loomsieve.operators import chatml, clean, dedup, quality, reports, scoring, seeds, split
from loomsieve.operators.tasks import quality_text, task_text, with_clean_task
from loomsieve.plans import sql as Q
from loomsieve.plans.pipeline import curate
from loomsieve.sources.writers import full_outer_curves

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: Thresholds for the test vectors, whose classes are loose.
COSINE, XSIM = 0.30, 0.30
# The kinds of unusable answers.
INVALID_TYPES = ["too_short", "off_topic", "gibberish", "evasive", "reverse_question"]
SYSTEM_PROMPTS = {t: f"task: {t}" for t in P.TASKS}


def _query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "generate_data_v3")


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.prepare(records(spark, sf_dir))


def spl(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_clean_task(records(spark, sf_dir))
    return rows.withColumn("split", F.lower(F.trim("split"))).withColumn("base", T.base_seed(F.col("base_seed_id")))


# ---- text forms -------------------------------------------------------------------


@_query(f"WITH {Q.KEPT} SELECT ord, task_type, text, norm, hash FROM hashed")
def task_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir).select("ord", "task_type", "text", "norm", "hash")


@_query(f"WITH {Q.RECORDS} SELECT ord, {Q.first_words('quality_text', 1)} AS first_word, {Q.first_words('quality_text', 3)} AS first_three FROM txt")
def first_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = quality_text()
    return with_clean_task(records(spark, sf_dir)).select("ord", T.first_words(x, 1).alias("first_word"), T.first_words(x, 3).alias("first_three"))


@_query(f"SELECT ord, regexp_replace(seed_id, {Q.q(P.VERSION_ENDINGS)}, '') AS base, CASE WHEN question_index <= 1 THEN 'early' WHEN question_index <= 4 THEN 'mid' ELSE 'late' END AS stage, split_part(variation_combo, '_', 1) AS style, length(title) <= 15 AS short_title FROM generate_data_v3")
def derived_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("ord", T.base_seed(F.col("seed_id")).alias("base"), T.stage_bucket(F.col("question_index")).alias("stage"), F.split("variation_combo", "_")[0].alias("style"), (F.length("title") <= 15).alias("short_title"))


# ---- dedup ------------------------------------------------------------------------


@_query(f"WITH {Q.KEPT} SELECT task_type, count(*) AS kept FROM kept GROUP BY 1")
def exact_dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_first(prepared(spark, sf_dir)).groupBy("task_type").agg(F.count("*").alias("kept"))


@_query(f"WITH {Q.KEPT} SELECT ord, task_type, hash FROM kept")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_first(prepared(spark, sf_dir)).select("ord", "task_type", "hash")


@_query(f"WITH {Q.LINKS} SELECT task, a, b, round(jaccard, 6) AS jaccard FROM near")
def shingle_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = dedup.jaccard_links(dedup.exact_first(prepared(spark, sf_dir)), "ord", "task_type", "norm")
    return links.withColumn("jaccard", F.round("jaccard", 6))


@_query()
def minhash_lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.lsh_candidates(dedup.exact_first(prepared(spark, sf_dir)), "ord", "task_type", "norm")


@_query(f"WITH {Q.LINKS} SELECT a, b, distance FROM edit")
def levenshtein_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = dedup.exact_first(prepared(spark, sf_dir)).where("task_type = 'title'")
    return dedup.edit_links(titles, "ord", "norm").select("a", "b", F.col("distance").cast("long").alias("distance"))


@_query(f"WITH RECURSIVE {Q.GONE} SELECT id AS ord FROM gone")
def greedy_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates_removed(dedup.materialize(dedup.exact_first(prepared(spark, sf_dir)), "kept")).withColumnRenamed("id", "ord")


@_query(f"""WITH RECURSIVE {Q.GONE}, c AS (SELECT 0 AS step, 'raw' AS stage, task_type, count(*) AS kept FROM hashed GROUP BY task_type
  UNION ALL SELECT 1, 'exact', task_type, count(*) FROM kept GROUP BY task_type
  UNION ALL SELECT 2, 'near', task_type, count(*) FROM kept WHERE ord NOT IN (SELECT id FROM gone) GROUP BY task_type)
SELECT c.step, c.stage, c.task_type, c.kept, coalesce(p.kept, c.kept) - c.kept AS removed FROM c LEFT JOIN c p ON p.step = c.step - 1 AND p.task_type IS NOT DISTINCT FROM c.task_type""")
def dedup_stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = prepared(spark, sf_dir)
    kept = dedup.materialize(dedup.exact_first(raw), "kept")
    near = kept.join(dedup.near_duplicates_removed(kept).withColumnRenamed("id", "ord"), "ord", "left_anti")
    return dedup.stage_counts([("raw", raw), ("exact", kept), ("near", near)])


@_query()
def curated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and near dedup and the split: rows of each split and task. No table holds
    vectors of the records, so the semantic and the cross-version stage are not run."""
    return curate(records(spark, sf_dir))[0].groupBy("split", "task_type").agg(F.count("*").alias("rows"))


# ---- vectors ----------------------------------------------------------------------

_UNIT = "vec AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
_PAIRS = f"{_UNIT}, cp AS (SELECT a.label AS grp, a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS cosine FROM vec a JOIN vec b ON a.label = b.label AND a.vec_id < b.vec_id)"


@_query(f"WITH {_PAIRS} SELECT grp, a, b, round(cosine, 6) AS cosine FROM cp WHERE cosine >= {COSINE}")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = dedup.cosine_links(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", COSINE)
    return links.withColumn("cosine", F.round("cosine", 6))


@_query(f"WITH RECURSIVE {_PAIRS}, {Q.greedy(f'SELECT a, b FROM cp WHERE cosine >= {COSINE}')} SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT id FROM gone)")
def greedy_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    gone = dedup.greedy_removed(dedup.cosine_links(vectors, "label", "vec_id", "embedding", COSINE))
    return vectors.select("vec_id").join(gone.withColumnRenamed("id", "vec_id"), "vec_id", "left_anti")


_XSIM = f"{_UNIT}, xs AS (SELECT a.label AS grp, a.vec_id AS id, max(list_cosine_similarity(a.e, b.e)) AS nearest FROM vec a LEFT JOIN vec b ON a.label = b.label AND b.vec_id % 2 = 1 WHERE a.vec_id % 2 = 0 GROUP BY ALL)"


def _xsim(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    # the two versions of the corpus: even and odd vectors
    return dedup.nearest_old(v.where("vec_id % 2 = 0"), v.where("vec_id % 2 = 1"), "label", "vec_id", "embedding")


@_query(f"WITH {_XSIM} SELECT grp, id, round(nearest, 6) AS nearest, nearest IS NULL OR nearest <= {XSIM} AS kept FROM xs")
def cross_version_xsim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _xsim(spark, sf_dir).select("grp", "id", F.round("nearest", 6).alias("nearest"), (F.col("nearest").isNull() | (F.col("nearest") <= XSIM)).alias("kept"))


@_query(f"WITH {_XSIM} SELECT grp, round(avg(nearest), 6) AS mean, round(max(nearest), 6) AS most, {Q.n(f'nearest > {XSIM}')} AS removed FROM xs GROUP BY grp")
def xsim_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _xsim(spark, sf_dir).groupBy("grp").agg(F.round(F.avg("nearest"), 6).alias("mean"), F.round(F.max("nearest"), 6).alias("most"), F.sum(F.coalesce((F.col("nearest") > XSIM).cast("long"), F.lit(0))).alias("removed"))


@_query(f"WITH {_PAIRS} SELECT grp, CAST((SELECT count(*) FROM embeddings e WHERE e.label = cp.grp) AS BIGINT) AS n, round(avg(cosine), 6) AS cosine FROM cp GROUP BY grp")
def intra_group_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.intra_group_cosine(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return out.withColumn("cosine", F.round("cosine", 6))


# ---- quality ----------------------------------------------------------------------

_START = f"""{Q.RECORDS}, fw AS (SELECT task_type, {Q.first_words('quality_text', 1)} AS w1, {Q.first_words('quality_text', 3)} AS w3 FROM txt),
c1 AS (SELECT task_type, w1, count(*) AS n FROM fw WHERE w1 <> '' GROUP BY ALL), d3 AS (SELECT task_type, count(DISTINCT w3) AS d FROM fw WHERE w1 <> '' GROUP BY ALL),
st AS (SELECT c1.task_type, CAST(sum(n) AS BIGINT) AS rows, max(n) / sum(n) AS top1, any_value(d) / sum(n) AS unique3 FROM c1 JOIN d3 ON c1.task_type IS NOT DISTINCT FROM d3.task_type GROUP BY c1.task_type)"""


@_query(f"WITH {_START} SELECT task_type, rows, round(top1, 6) AS top1, round(unique3, 6) AS unique3 FROM st")
def starting_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.starting_phrases(with_clean_task(records(spark, sf_dir)), quality_text())
    return out.select("task_type", "rows", F.round("top1", 6).alias("top1"), F.round("unique3", 6).alias("unique3"))


_COMBO = "pc AS (SELECT persona_id, occasion_id, count(*) AS n FROM generate_data_v3 WHERE coalesce(persona_id, '') <> '' GROUP BY ALL), cb AS (SELECT count(*) AS combos, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows, coalesce(stddev_pop(n) / avg(n), 0) AS std_ratio FROM pc)"


@_query(f"WITH {_COMBO} SELECT combos, rows, round(std_ratio, 6) AS std_ratio FROM cb")
def combo_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.combo_balance(records(spark, sf_dir), "persona_id", "occasion_id").withColumn("std_ratio", F.round("std_ratio", 6))


@_query(f"WITH {Q.RECORDS} SELECT count(DISTINCT variation_combo) AS combos, count(variation_combo) AS rows FROM txt WHERE task_type = 'response'")
def variation_combos(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_clean_task(records(spark, sf_dir)).where("task_type = 'response'")
    return rows.agg(F.countDistinct("variation_combo").alias("combos"), F.count("variation_combo").alias("rows"))


_RATIO = f"{Q.SPLIT_RECORDS}, tk AS (SELECT unnest([{', '.join(map(Q.q, P.TASKS))}]) AS task_type), al AS (SELECT sp, count(*) AS n FROM spl WHERE sp IS NOT NULL GROUP BY sp), ra AS (SELECT al.sp AS split, tk.task_type, (SELECT count(*) FROM spl WHERE spl.sp = al.sp AND spl.task_type = tk.task_type) / al.n AS ratio FROM al, tk)"


@_query(f"WITH {_RATIO} SELECT split, task_type, round(ratio, 6) AS ratio FROM ra")
def task_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.task_ratios(spl(spark, sf_dir)).withColumn("ratio", F.round("ratio", 6))


@_query(f"WITH {_RATIO} SELECT task_type, round(max(ratio) - min(ratio), 6) AS edge FROM ra GROUP BY task_type")
def task_ratio_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ratio_edges(quality.task_ratios(spl(spark, sf_dir))).withColumn("edge", F.round("edge", 6))


_LEAK = f"{Q.SPLIT_RECORDS}, gs AS (SELECT DISTINCT base, sp FROM spl WHERE base IS NOT NULL), pr AS (SELECT * FROM (VALUES ('train', 'val'), ('train', 'test'), ('val', 'test')) v(split_a, split_b)), lk2 AS (SELECT split_a, split_b, (SELECT count(*) FROM gs x JOIN gs y ON x.base = y.base WHERE x.sp = split_a AND y.sp = split_b) AS shared FROM pr)"


@_query(f"WITH {_LEAK} SELECT split_a, split_b, shared FROM lk2")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.leakage(spl(spark, sf_dir), "base")


@_query(f"WITH {Q.RECORDS} SELECT task_type, count(*) AS rows FROM txt GROUP BY task_type")
def task_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_clean_task(records(spark, sf_dir)).groupBy("task_type").agg(F.count("*").alias("rows"))


@_query("WITH c AS (SELECT base_seed_id, count(*) AS n FROM seed GROUP BY 1) SELECT count(*) AS groups, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM c")
def seed_usage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.usage_stats(table(spark, sf_dir, "seed"), ["base_seed_id"]).withColumn("mean", F.round("mean", 6))


def _long(df: DataFrame, metric: str, key: Column, value: Column) -> DataFrame:
    return df.select(F.lit(metric).alias("metric"), key.cast("string").alias("key"), value.cast("double").alias("value"))


def _sql_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics that the SQL of go_report has."""
    rows = spl(spark, sf_dir)
    none = F.lit(None)
    start, combo = quality.starting_phrases(rows, quality_text()), quality.combo_balance(rows, "persona_id", "occasion_id")
    out = _long(start, "starting_phrase_top1", F.col("task_type"), F.col("top1"))
    for part in (
        _long(start, "first_3words_unique", F.col("task_type"), F.col("unique3")),
        _long(quality.leakage(rows, "base"), "leakage", F.concat_ws("-", "split_a", "split_b"), F.col("shared")),
        _long(quality.ratio_edges(quality.task_ratios(rows)), "task_ratio_edge", F.col("task_type"), F.col("edge")),
        _long(combo, "persona_occasion_combos", none, F.col("combos")),
        _long(combo, "persona_occasion_std_ratio", none, F.col("std_ratio")),
        _long(quality.intra_group_cosine(table(spark, sf_dir, "embeddings"), "label", "embedding").agg(F.avg("cosine").alias("c")), "intra_group_cosine", none, F.col("c")),
    ):
        out = out.union(part)
    return out


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of every rule but the human ratings, which have no table."""
    none = F.lit(None)
    # means and maxima of the groups first, as the original takes them by task
    xsim = _xsim(spark, sf_dir).groupBy("grp").agg(F.avg("nearest").alias("mean"), F.max("nearest").alias("most")).agg(F.avg("mean").alias("mean"), F.max("most").alias("most"))
    rates = scoring.response_metrics(samples(spark, sf_dir).where("task = 'response'")).where("total_evaluated > 0")
    names = [c for c in rates.columns if c != "total_evaluated"]
    rates = rates.selectExpr(f"stack({len(names)}, {', '.join(f"'{c}', CAST({c} AS DOUBLE)" for c in names)}) AS (rate, value)")
    out = _sql_metrics(spark, sf_dir)
    for part in (
        _long(variation_combos(spark, sf_dir), "variation_combos", none, F.col("combos")),
        _long(xsim, "xsim_avg", none, F.col("mean")),
        _long(xsim, "xsim_max", none, F.col("most")),
        _long(rates, "auto_eval_rate", F.col("rate"), F.col("value")),
        _long(stats.nearest_rank(table(spark, sf_dir, "events"), "value", [0.95]), "latency_p95", none, F.col("value")),
    ):
        out = out.union(part)
    return out


@_query()
def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).withColumn("value", F.round("value", 6))


@_query(f"""WITH {_LEAK}, {_START[len(Q.RECORDS) + 2:]}, {_COMBO}, {_RATIO[len(Q.SPLIT_RECORDS) + 2:]}, {_PAIRS},
gc AS (SELECT avg(cosine) AS c FROM cp GROUP BY grp),
m AS (SELECT 'starting_phrase_top1' AS metric, task_type AS key, top1 AS value FROM st UNION ALL SELECT 'first_3words_unique', task_type, unique3 FROM st
  UNION ALL SELECT 'leakage', split_a || '-' || split_b, shared FROM lk2 UNION ALL SELECT 'task_ratio_edge', task_type, max(ratio) - min(ratio) FROM ra GROUP BY task_type
  UNION ALL SELECT 'persona_occasion_combos', NULL, combos FROM cb UNION ALL SELECT 'persona_occasion_std_ratio', NULL, std_ratio FROM cb UNION ALL SELECT 'intra_group_cosine', NULL, avg(c) FROM gc),
ru AS (SELECT * FROM (VALUES {', '.join(f"('{m}', '{op}', CAST({x} AS DOUBLE))" for m, op, x, _ in quality.RULES)}) v(metric, op, lim))
SELECT metric, key, round(value, 6) AS value, op, lim AS "limit" FROM m JOIN ru USING (metric) WHERE NOT (CASE op WHEN '<=' THEN value <= lim WHEN '>=' THEN value >= lim ELSE value < lim END)""")
def go_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The broken ones of the rules that its SQL states (R1-R5, R7, R8); go_rules has all
    rules, go_verdict decides by all."""
    return quality.violations(_sql_metrics(spark, sf_dir)).withColumn("value", F.round("value", 6))


@_query()
def go_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule for each key: kept, broken or not evaluated."""
    return quality.evaluated(_metrics(spark, sf_dir)).withColumn("value", F.round("value", 6))


@_query()
def go_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdict(_metrics(spark, sf_dir))


# ---- splits -----------------------------------------------------------------------


@_query()
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spl(spark, sf_dir).drop("split")
    return split.train_val_test(rows.withColumn("grp", F.coalesce("base", F.col("seed_id"))), "grp", "task_type").select("ord", "grp", "task_type", "split")


# ---- cleaning and messages --------------------------------------------------------


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spl(spark, sf_dir).select("ord", "split", "task_type", F.when(F.col("task_type") == "response", F.concat_ws("\n", "current_question", "next_question_original")).otherwise("").alias("user_text"), F.when(task_text() != "", task_text()).alias("answer"))


def _cleaned_sql() -> str:
    a = "answer"
    photo, forbidden = Q.contains_any(a, P.PHOTO_WORDS), Q.contains_any(a, P.FORBIDDEN_WORDS)
    return f"""{Q.SPLIT_RECORDS},
an AS (SELECT ord, sp AS split, task_type, CASE WHEN task_type = 'response' THEN concat_ws(chr(10), current_question, next_question_original) ELSE '' END AS user_text, nullif(text, '') AS answer FROM spl),
cl AS (SELECT *, CASE WHEN task_type = 'response' AND ({photo} OR {Q.contains_any("coalesce(user_text, '')", P.PHOTO_WORDS)}) THEN NULL
  WHEN task_type = 'title' AND {forbidden} THEN CASE WHEN length({Q.clean_title(a)}) >= 2 THEN {Q.clean_title(a)} END
  WHEN task_type IN ('intro', 'ending') THEN CASE WHEN {Q.strip_emoji(a)} = '' THEN answer ELSE {Q.strip_emoji(a)} END
  WHEN task_type = 'first_question' THEN {Q.strip_greeting(a)}
  WHEN task_type = 'retry' AND ({forbidden} OR {photo}) THEN NULL ELSE answer END AS cleaned FROM an)"""


@_query(f"WITH {_cleaned_sql()} SELECT ord, task_type, cleaned FROM cl")
def clean_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean(_answers(spark, sf_dir)).select("ord", "task_type", "cleaned")


@_query(f"WITH {_cleaned_sql()} SELECT task_type, count(*) AS rows, {Q.n('cleaned IS NULL AND answer IS NOT NULL')} AS deleted, {Q.n('cleaned <> answer')} AS modified FROM cl GROUP BY task_type")
def clean_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.accounting(clean.clean(_answers(spark, sf_dir)))


@_query(f"""WITH {_cleaned_sql()} SELECT split, {Q.n("task_type = 'response' AND " + Q.contains_any('cleaned', P.PHOTO_WORDS))} AS photo, {Q.n("task_type = 'title' AND " + Q.contains_any('cleaned', P.FORBIDDEN_WORDS))} AS forbidden,
{Q.n(f"task_type = 'intro' AND regexp_matches(cleaned, {Q.q(P.EMOJI_WIDE)})")} AS emoji, {Q.n("task_type = 'first_question' AND starts_with(cleaned, '안녕')")} AS greeting FROM cl WHERE cleaned IS NOT NULL GROUP BY split""")
def clean_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.verification(clean.clean(_answers(spark, sf_dir)))


_E = lambda c: f"coalesce({c}, '')"
_CHAT = f"""{Q.RECORDS}, cm AS (SELECT ord, task_type, CASE
  WHEN task_type = 'response' THEN '주제: ' || {_E('topic')} || chr(10) || '현재 질문: ' || {_E('current_question')} || chr(10) || '사용자 응답: ' || {_E('user_answer')} || chr(10) || '다음 질문: ' || {_E('next_question_original')}
  WHEN task_type IN ('intro', 'ending') THEN '주제: ' || {_E('topic')} || chr(10) || '타겟: ' || {_E('target_audience')}
  WHEN task_type = 'first_question' THEN '주제: ' || {_E('topic')} || chr(10) || '첫 질문: ' || {_E('first_question_original')}
  WHEN task_type = 'retry' THEN '주제: ' || {_E('topic')} || chr(10) || '현재 질문: ' || {_E('current_question')} || chr(10) || '부적절 유형: ' || {_E('invalid_type')}
  WHEN task_type = 'title' THEN {_E('original_text')} END AS "user",
  CASE WHEN task_type = 'response' THEN '{{"comment": ' || CAST(to_json({_E('comment')}) AS VARCHAR) || ', "next_question": ' || CAST(to_json({_E('next_question_rephrased')}) AS VARCHAR) || '}}' ELSE quality_text END AS assistant,
  coalesce(NOT ({Q.blank('quality_text')}) AND CASE
  WHEN task_type = 'response' THEN topic IS NOT NULL AND current_question IS NOT NULL AND user_answer IS NOT NULL AND next_question_original IS NOT NULL AND comment IS NOT NULL AND next_question_rephrased IS NOT NULL
  WHEN task_type IN ('intro', 'ending') THEN topic IS NOT NULL WHEN task_type = 'first_question' THEN topic IS NOT NULL AND first_question_original IS NOT NULL
  WHEN task_type = 'retry' THEN topic IS NOT NULL AND current_question IS NOT NULL AND invalid_type IS NOT NULL WHEN task_type = 'title' THEN original_text IS NOT NULL ELSE false END, false) AS ok FROM txt)"""


@_query(f"""WITH {_CHAT} SELECT ord, task_type, 'task: ' || task_type AS system, "user", assistant FROM cm WHERE ok""")
def chatml_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chatml.to_messages(records(spark, sf_dir), SYSTEM_PROMPTS)
    return out.select("ord", "task_type", *(F.col("messages")[i]["content"].alias(n) for i, n in enumerate(("system", "user", "assistant"))))


@_query(f"""WITH {_CHAT} SELECT ord, '<|system|>' || chr(10) || 'task: ' || task_type || chr(10) || '<|user|>' || chr(10) || "user" || chr(10) AS prompt FROM cm WHERE ok""")
def chatml_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chatml.to_messages(records(spark, sf_dir), SYSTEM_PROMPTS).select("ord", chatml.rendered(chatml.without_assistant(F.col("messages"))).alias("prompt"))


@_query(f"WITH {_CHAT} SELECT task_type, {Q.n('ok')} AS converted, {Q.n('NOT ok')} AS errors FROM cm GROUP BY task_type")
def chatml_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chatml.conversion_errors(records(spark, sf_dir))


# ---- scoring ----------------------------------------------------------------------


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_samples").withColumn("task", T.clean_task(F.col("task")))


def _get(c: str, ok: str, key: str) -> str:
    return f"CASE WHEN {ok} THEN coalesce(json_extract_string(CASE WHEN {ok} THEN {c} END, '$.{key}'), '') ELSE '' END"


def _has(key: str) -> str:
    return f"coalesce(list_contains(json_keys(CASE WHEN json_ok THEN g END), '{key}'), false)"


_PARSED = f"""evs AS (SELECT *, {Q.task('task')} AS tk, coalesce(generated, '') AS g, json_valid(coalesce(generated, '')) AS json_ok FROM eval_samples),
ps AS (SELECT *, {_has('comment')} AS has_c, {_has('next_question')} AS has_n, {_get('g', 'json_ok', 'comment')} AS c, {_get('g', 'json_ok', 'next_question')} AS nq FROM evs)"""


@_query(f"""WITH {_PARSED}, r AS (SELECT *, has_c AND has_n AS k FROM ps WHERE tk = 'response') SELECT {', '.join(f"round({Q.n(x)} * 100 / count(*), 6) AS {name}" for name, x in (
    ('json_parse_rate', 'json_ok'), ('keys_present_rate', 'k'), ('comment_length_ok', 'k AND length(c) BETWEEN 10 AND 100'), ('honorific_rate', f"k AND regexp_matches(c, {Q.q(P.HONORIFIC_FULL)})"),
    ('no_emoji_rate', f"k AND NOT regexp_matches(c || nq, {Q.q(P.EMOJI_NARROW)})"), ('no_survey_word_rate', f"k AND NOT {Q.contains_any('(c || nq)', P.FORBIDDEN_WORDS)}")))}, count(*) AS total_evaluated FROM r""")
def response_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.response_metrics(samples(spark, sf_dir).where("task = 'response'"))
    return out.select(*(F.round(c, 6).alias(c) if c != "total_evaluated" else c for c in out.columns))


@_query(f"SELECT {Q.task('task')} AS task, count(*) AS total, round({Q.n(f'NOT ({Q.blank("generated")})')} * 100 / count(*), 6) AS non_empty FROM eval_samples GROUP BY 1")
def non_empty_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.non_empty_rates(samples(spark, sf_dir)).withColumn("non_empty", F.round("non_empty", 6))


def _list(*conds: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {Q.q(t)} END" for c, t in conds) + "], lambda x: x IS NOT NULL)"


_ISSUES = f"""{_PARSED}, iss AS (SELECT sample_id, CASE WHEN {Q.blank('g')} THEN ['EMPTY'] WHEN tk = 'response' AND NOT json_ok THEN ['JSON_PARSE_FAIL']
  WHEN tk = 'response' THEN {_list(('NOT has_c', 'NO_COMMENT_KEY'), ('NOT has_n', 'NO_NEXT_Q_KEY'), (f"NOT regexp_matches(c, {Q.q(P.HONORIFIC_RESPONSE)})", 'NO_HONORIFIC_COMMENT'), *((f"contains(c || nq, '{w}')", f'FORBIDDEN_WORD:{w}') for w in P.FORBIDDEN_WORDS), *((f"contains(nq, '{w}')", f'PHOTO_REQUEST:{w}') for w in P.PHOTO_REQUESTS))}
  WHEN tk = 'retry' THEN {_list((f"NOT regexp_matches(g, {Q.q(P.HONORIFIC_RETRY)})", 'NO_HONORIFIC'))} ELSE [] END AS issues,
  {_list(*((f"contains(c, '{w}')", f'FORCEFUL:{w}') for w in P.FORCEFUL_WORDS))} AS forced, CASE WHEN length(c) > 100 THEN ['COMMENT_TOO_LONG(' || length(c) || ')'] ELSE [] END AS note FROM ps)"""


@_query(f"WITH {_ISSUES} SELECT sample_id, array_to_string(list_concat(list_concat(issues, forced), note), '|') AS issues, len(issues) = 0 AND len(forced) = 0 AS passed FROM iss")
def issue_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.forceful_words(scoring.issues(samples(spark, sf_dir))).select("sample_id", F.array_join("issues", "|").alias("issues"), "passed")


def _scored(conds: list[tuple[str, int, str]], name: str) -> str:
    total = "5" + "".join(f" - CASE WHEN {c} THEN {p} ELSE 0 END" for c, p, _ in conds)
    why = _list(*((c, t) for c, _, t in conds))
    return f"greatest(1, least(5, {total})) AS {name}_score, coalesce(nullif(array_to_string({why}, ', '), ''), '양호') AS {name}_reason"


def _line(n: int, label: str) -> str:
    return f"coalesce(replace(string_split(u, chr(10))[{n}], {Q.q(label)}, ''), '')"


_OVER = f"(len(list_intersect(list_distinct(regexp_extract_all(eq, '{P.KEYWORD}')), list_distinct(regexp_extract_all(gq, '{P.KEYWORD}')))) / len(list_distinct(regexp_extract_all(eq, '{P.KEYWORD}'))))"
_SOME = f"len(regexp_extract_all(eq, '{P.KEYWORD}')) > 0"
_REVIEW = f"""rv0 AS (SELECT sample_id AS id, coalesce(user_input, '') AS u, coalesce(generated, '') AS g, coalesce(expected, '') AS e, json_valid(coalesce(generated, '')) AS go, json_valid(coalesce(expected, '')) AS eo FROM eval_samples WHERE {Q.task('task')} = 'response'),
rv1 AS (SELECT id, {_line(1, '주제: ')} AS topic, {_line(3, '사용자 응답: ')} AS user_answer, {_line(4, '다음 질문: ')} AS oq, CASE WHEN go THEN {_get('g', 'go', 'comment')} ELSE g END AS gc, {_get('g', 'go', 'next_question')} AS gq, CASE WHEN eo THEN {_get('e', 'eo', 'comment')} ELSE e END AS ec, {_get('e', 'eo', 'next_question')} AS eq FROM rv0),
rv AS (SELECT *, {_scored([(f"NOT regexp_matches(gc, {Q.q(P.HONORIFIC_FULL)})", 2, "존댓말 미사용"), (f"NOT {Q.contains_any('gc', P.EMPATHY_WORDS)}", 1, "공감표현 부족"), ("length(gc) < 5", 1, "너무 짧음"), ("length(gc) > 80", 1, "너무 김"), (Q.contains_any('gc', P.TONE_FORBIDDEN), 2, "금지어 포함"), (Q.contains_any('gc', P.PHOTO_REQUESTS), 1, "부적절 요청 포함")], 'tone')},
  {_scored([(f"NOT regexp_matches(gq, {Q.q(P.HONORIFIC_REPHRASE)})", 2, "존댓말 미사용"), ("length(gq) < 5", 2, "너무 짧음"), ("length(gq) > 100", 1, "너무 김"), (f"{_SOME} AND {_OVER} < 0.2", 2, "의미 이탈"), (f"{_SOME} AND {_OVER} >= 0.2 AND {_OVER} < 0.4", 1, "의미 약간 이탈"), ("(" + " OR ".join(f"(contains(gq, '{w}') AND NOT contains(eq || ' ' || oq, '{w}'))" for w in P.PHOTO_WORDS) + ")", 2, "부적절 요청(사진 등)"), (Q.contains_any('gq', P.FORBIDDEN_WORDS), 2, "금지어 포함")], 'rephrase')} FROM rv1)"""


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.review(samples(spark, sf_dir).where("task = 'response'").withColumn("id", F.col("sample_id")))


@_query(f"WITH {_REVIEW} SELECT id, topic, user_answer, gc AS gen_comment, gq AS gen_next_q, ec AS exp_comment, eq AS exp_next_q, tone_score, tone_reason, rephrase_score, rephrase_reason FROM rv")
def review_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviewed(spark, sf_dir)


def _summary_sql(c: str, needed: int) -> str:
    return f"""SELECT '{c}' AS score, count({c}) AS n, round(avg({c}), 6) AS mean, {Q.n(f'{c} >= 4')} AS passed, round({Q.n(f'{c} >= 4')} * 100 / count({c}), 6) AS pass_rate, {Q.n(f'{c} = 5')} AS five, {Q.n(f'{c} = 4')} AS four, {Q.n(f'{c} <= 3')} AS low, CASE WHEN {Q.n(f'{c} >= 4')} * 100 / count({c}) >= {needed} THEN 'PASS' ELSE 'FAIL' END AS status FROM rv"""


@_query(f"WITH {_REVIEW} {_summary_sql('tone_score', 85)} UNION ALL {_summary_sql('rephrase_score', 80)}")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reviewed(spark, sf_dir)
    parts = [scoring.score_summary(rows, c, x).select(F.lit(c).alias("score"), "n", F.round("mean", 6).alias("mean"), "passed", F.round("pass_rate", 6).alias("pass_rate"), "five", "four", "low", "status") for c, x in (("tone_score", 85), ("rephrase_score", 80))]
    return parts[0].union(parts[1])


@_query(f"WITH {_REVIEW}, rs AS (SELECT unnest(string_split(tone_reason, ', ')) AS reason FROM rv) SELECT reason, count(*) AS n FROM rs WHERE reason <> '양호' GROUP BY reason")
def reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.reason_histogram(_reviewed(spark, sf_dir), "tone_reason")


@_query("SELECT event_id, json_valid(props) AS ok, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ok", F.coalesce(T.is_json("props"), F.lit(None)))
    return rows.select("event_id", "ok", F.get_json_object(F.when(F.col("ok"), F.col("props")), "$.k").cast("long").alias("k"))


@_query("WITH s AS (SELECT list_sort(list(value)) AS v, count(value) AS n FROM events WHERE value IS NOT NULL) SELECT share, round(v[CAST(floor(n * share) AS BIGINT) + 1], 6) AS value FROM s, (VALUES (CAST(0.5 AS DOUBLE)), (0.95), (0.99)) p(share)")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.nearest_rank(table(spark, sf_dir, "events"), "value", [0.5, 0.95, 0.99]).withColumn("value", F.round("value", 6))


# ---- seeds and samples ------------------------------------------------------------

_TOPICS = "tp AS (SELECT * FROM seed QUALIFY row_number() OVER (PARTITION BY topic ORDER BY length(seed_id), seed_id) = 1)"


@_query(f"WITH {_TOPICS} SELECT topic, seed_id FROM tp")
def topic_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.canonical_topics(table(spark, sf_dir, "seed")).select("topic", "seed_id")


@_query(f"""WITH {_TOPICS}, od AS (SELECT *, row_number() OVER (ORDER BY md5(topic), topic) - 1 AS o, count(*) OVER () AS total FROM tp),
cb AS (SELECT p.id AS persona_id, o.id AS occasion_id, p.name || ' / ' || o.name AS target_audience, row_number() OVER (ORDER BY p.id, o.id) - 1 AS combo FROM persona p, occasion o),
sl AS (SELECT *, unnest(range(10)) AS slot FROM cb)
SELECT split_part(seed_id, '_', 1) || '_' || sl.persona_id || sl.occasion_id || '_' || lpad(CAST(combo * 10 + slot AS VARCHAR), 4, '0') AS seed_id, regexp_replace(seed_id, {Q.q(P.VERSION_ENDINGS)}, '') AS base_seed_id, sl.persona_id, sl.occasion_id, topic, sl.target_audience, domain
FROM sl JOIN od ON od.o = (combo + 18 * slot) % od.total""")
def seed_cross_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = seeds.canonical_topics(table(spark, sf_dir, "seed")).select("topic", "seed_id", "domain")
    return seeds.expand(topics, table(spark, sf_dir, "persona"), table(spark, sf_dir, "occasion"))


@_query("WITH q AS (SELECT seed_id, unnest(questions) AS q, generate_subscripts(questions, 1) AS i FROM seed), c AS (SELECT seed_id, i, q.content AS x, lead(q.content) OVER (PARTITION BY seed_id ORDER BY i) AS y FROM q) SELECT seed_id, CAST(i - 1 AS INTEGER) AS question_index, x AS current_question, y AS next_question FROM c WHERE y IS NOT NULL")
def next_question_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.question_pairs(table(spark, sf_dir, "seed")).withColumn("question_index", F.col("question_index").cast("int"))


@_query(f"WITH v AS (SELECT unnest([{', '.join(map(Q.q, INVALID_TYPES))}]) AS invalid_type) SELECT seed_id, invalid_type FROM seed, v QUALIFY row_number() OVER (PARTITION BY seed_id ORDER BY md5(seed_id || '|' || invalid_type)) <= 3")
def seed_invalid_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.sampled_values(table(spark, sf_dir, "seed").select("seed_id"), "seed_id", INVALID_TYPES, 3, "invalid_type")


@_query("SELECT seed_id, persona_id, occasion_id FROM seed QUALIFY row_number() OVER (PARTITION BY persona_id, occasion_id ORDER BY seed_id) <= 2")
def pilot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.first_k(table(spark, sf_dir, "seed").select("seed_id", "persona_id", "occasion_id"), ["persona_id", "occasion_id"], ["seed_id"], 2)


@_query("SELECT sample_id, task, expected, generated FROM eval_samples ORDER BY md5('42|' || CAST(sample_id AS VARCHAR)), sample_id LIMIT 30")
def review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review sample of 30 (sampling is the feature)."""
    return seeds.repeatable_sample(table(spark, sf_dir, "eval_samples"), "sample_id", 30).select("sample_id", "task", "expected", "generated")


@_query(f"SELECT sample_id, {Q.task('task')} AS task FROM eval_samples QUALIFY row_number() OVER (PARTITION BY {Q.task('task')} ORDER BY sample_id) <= 5")
def first_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.first_k(samples(spark, sf_dir).select("sample_id", "task"), ["task"], ["sample_id"], 5)


@_query("SELECT s.seed_id, p.name AS persona, o.name AS occasion, s.topic || ' | ' || p.tone || ' | ' || o.tone_mod AS prompt FROM seed s JOIN persona p ON p.id = s.persona_id JOIN occasion o ON o.id = s.occasion_id")
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "seed")
    p = F.broadcast(table(spark, sf_dir, "persona").select(F.col("id").alias("persona_id"), F.col("name").alias("persona"), "tone"))
    o = F.broadcast(table(spark, sf_dir, "occasion").select(F.col("id").alias("occasion_id"), F.col("name").alias("occasion"), "tone_mod"))
    filled = T.render("{topic} | {tone} | {mod}", {"topic": F.col("topic"), "tone": F.col("tone"), "mod": F.col("tone_mod")})
    return s.join(p, "persona_id").join(o, "occasion_id").select("seed_id", "persona", "occasion", filled.alias("prompt"))


@_query("WITH a AS (SELECT label AS step, avg(embedding[1]) AS x FROM embeddings GROUP BY 1), b AS (SELECT n_regionkey AS step, CAST(count(*) AS DOUBLE) AS x FROM nation GROUP BY 1) SELECT coalesce(a.step, b.step) AS step, a.x IS NOT NULL AS in_a, coalesce(CAST(CAST(b.x AS BIGINT) AS VARCHAR), '—') AS b FROM a FULL OUTER JOIN b ON a.step = b.step")
def version_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("step")).agg(F.avg(F.col("embedding")[0]).alias("loss"))
    b = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("step")).agg(F.count("*").cast("double").alias("loss"))
    both = full_outer_curves(a, b)
    return both.select("step", (F.col("a") != "—").alias("in_a"), F.regexp_replace("b", r"\.0+$", "").alias("b"))


@_query("SELECT source, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars, max(length(text)) AS longest, round(avg(length(text)), 6) AS mean FROM documents GROUP BY source")
def document_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.sum(n).cast("long").alias("chars"), F.max(n).cast("long").alias("longest"), F.round(F.avg(n), 6).alias("mean"))


@_query("WITH t AS (SELECT sample_id, run_id, row_number() OVER (PARTITION BY run_id ORDER BY created_at, sample_id) AS place FROM eval_samples) SELECT a.run_id, a.place, a.sample_id AS a, b.sample_id AS b FROM t a JOIN t b ON b.run_id = a.run_id AND b.place = a.place + 1")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows matched by place: each sample of a run with the next."""
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("created_at", "sample_id")).cast("long")
    t = table(spark, sf_dir, "eval_samples").where("run_id IS NOT NULL").select("run_id", "sample_id", place.alias("place"))
    nxt = t.select("run_id", (F.col("place") - 1).alias("place"), F.col("sample_id").alias("b"))
    return t.withColumnRenamed("sample_id", "a").join(nxt, ["run_id", "place"])


# ---- reports ----------------------------------------------------------------------


@_query("SELECT run_id AS category, CAST(sum(CASE WHEN coalesce(json_valid(generated), false) THEN 1 ELSE 0 END) AS BIGINT) AS passed, count(*) AS total, bool_and(coalesce(json_valid(generated), false)) AS all_passed FROM eval_samples GROUP BY 1")
def scenario_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes of each run: answers that are valid JSON."""
    return reports.scenario_counts(table(spark, sf_dir, "eval_samples").withColumn("ok", T.is_json("generated")), "run_id", "ok")


@_query("SELECT event_type AS task, grouping(event_type) = 1 AS overall, count(*) AS calls, CAST(sum(CASE WHEN value > 0 THEN 1 ELSE 0 END) AS BIGINT) AS success, CAST(count(*) - sum(CASE WHEN value > 0 THEN 1 ELSE 0 END) AS BIGINT) AS failures FROM events GROUP BY ROLLUP (event_type)")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.run_counters(table(spark, sf_dir, "events").withColumn("ok", F.col("value") > 0), "event_type", "ok")


@_query(f"WITH c AS (SELECT {Q.task('task')} AS task, count(*) AS n FROM eval_samples GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS total FROM c")
def evaluated_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples over all tasks; response says total_evaluated, the others total."""
    rows, answers = samples(spark, sf_dir), F.col("task").eqNullSafe("response")
    one = scoring.non_empty_rates(rows.where(~answers)).select("total", F.lit(None).cast("long").alias("total_evaluated"))
    return reports.mixed_total(one.union(scoring.response_metrics(rows.where(answers)).select(F.lit(None).cast("long"), "total_evaluated")))


_RATES = "json_parse_rate keys_present_rate comment_length_ok honorific_rate no_emoji_rate no_survey_word_rate".split()
_THRESHOLDS = " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS value, CAST({x} AS DOUBLE) AS needed, {m} >= {x} AS passed FROM rr" for m, x in reports.THRESHOLDS)


@_query(f"WITH rr AS ({_SQL['response_metrics']}) {_THRESHOLDS}")
def threshold_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.threshold_report(response_metrics(spark, sf_dir))


@_query(f"WITH {_XSIM}, g AS (SELECT grp, avg(nearest) AS mean, max(nearest) AS most FROM xs GROUP BY grp) SELECT round(avg(mean), 6) AS overall_avg, round(max(most), 6) AS overall_max FROM g")
def report_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of the cross-version stage, looked up among the stages of a report."""
    by = _xsim(spark, sf_dir).groupBy("grp").agg(F.avg("nearest").alias("mean"), F.max("nearest").alias("most"))
    of = lambda c: F.map_from_entries(F.collect_list(F.struct(F.col("grp").cast("string"), c)))
    none = F.lit(None).cast("map<string, double>")
    xsim = by.agg(of("mean").alias("avg_by_task"), of("most").alias("max_by_task")).select(F.lit(2).alias("step"), F.lit("v3_v2_xsim").alias("name"), "avg_by_task", "max_by_task")
    stages = spark.range(2).select(F.col("id").cast("int").alias("step"), F.lit("near").alias("name"), none.alias("avg_by_task"), none.alias("max_by_task")).union(xsim)
    out = reports.stage_lookup(stages, "v3_v2_xsim")
    return out.select(F.round("overall_avg", 6).alias("overall_avg"), F.round("overall_max", 6).alias("overall_max"))


@_query("""WITH p AS (SELECT count(*) AS n FROM seed GROUP BY persona_id, occasion_id), b AS (SELECT count(*) AS n FROM seed GROUP BY base_seed_id)
SELECT 'combos' AS what, NULL AS key, count(*) AS groups, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM p UNION ALL SELECT 'base topics', NULL, count(*), min(n), max(n), round(avg(n), 6) FROM b
UNION ALL SELECT 'domain', domain, 1, count(*), count(*), CAST(count(*) AS DOUBLE) FROM seed GROUP BY domain""")
def seed_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of persona and occasion combos, usage of base topics, seeds of each domain."""
    rows = table(spark, sf_dir, "seed")
    of = lambda by, what, key: seeds.usage_stats(rows, by).select(F.lit(what).alias("what"), F.lit(key).cast("string").alias("key"), "groups", "least", "most", F.round("mean", 6).alias("mean"))
    n = F.col("n")
    domains = rows.groupBy("domain").agg(F.count("*").alias("n")).select(F.lit("domain").alias("what"), F.col("domain").alias("key"), F.lit(1).cast("long").alias("groups"), n.alias("least"), n.alias("most"), n.cast("double").alias("mean"))
    return of(["persona_id", "occasion_id"], "combos", None).union(of(["base_seed_id"], "base topics", None)).union(domains)


@_query(f"WITH {_PARSED} SELECT sample_id, c AS comment, nq AS next_question FROM ps WHERE tk = 'response' AND has_c AND has_n AND json_type(CASE WHEN json_ok THEN g END) = 'OBJECT'")
def response_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of the response task as records with all their keys."""
    rows = samples(spark, sf_dir).where("task = 'response'")
    out = seeds.records_of_replies(rows, "generated", ["comment", "next_question"], ["sample_id"], strip=False)
    return out.select("sample_id", F.coalesce("comment", F.lit("")).alias("comment"), F.coalesce("next_question", F.lit("")).alias("next_question"))


@_query("WITH a AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) AS place FROM eval_samples), b AS (SELECT sample_id AS other, row_number() OVER (ORDER BY created_at, sample_id) AS place FROM eval_samples) SELECT place, sample_id, other FROM a JOIN b USING (place)")
def zipped_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of as many rows side by side: samples by id and by time."""
    rows = table(spark, sf_dir, "eval_samples")
    other = rows.select(F.col("sample_id").alias("other"), "created_at")
    return seeds.zip_by_place(rows.select("sample_id"), other, ["sample_id"], ["created_at", "other"]).select("place", "sample_id", "other")


@_query()
def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and largest number of tokens of the documents of each source."""
    n = table(spark, sf_dir, "documents").select("source", tokens.token_length(F.col("text")).alias("n"))
    return n.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"), F.max("n").alias("longest"), F.round(F.avg("n"), 6).alias("mean"))


@_query("SELECT count(*) AS records, CAST(0 AS BIGINT) AS groups_in_two_splits, CAST(0 AS BIGINT) AS without_split, true AS near_shares FROM generate_data_v3")
def group_split_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of group_split: every record once, no group in two splits, every record
    with a split, eight tenths in training give or take three hundredths."""
    rows = group_split(spark, sf_dir)
    groups = rows.where("grp IS NOT NULL").groupBy("grp").agg(F.countDistinct("split").alias("n")).agg(F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("groups_in_two_splits"))
    whole = rows.agg(F.count("*").alias("records"), F.coalesce(F.sum(F.col("split").isNull().cast("long")), F.lit(0)).alias("without_split"), (F.abs(F.avg((F.col("split") == "train").cast("double")) - 0.8) < 0.03).alias("near_shares"))
    return whole.select("*", F.lit(1).alias("one")).join(groups.select("*", F.lit(1).alias("one")), "one").select("records", "groups_in_two_splits", "without_split", "near_shares")


_METRICS = f"""{_LEAK}, {_START[len(Q.RECORDS) + 2:]}, {_COMBO}, {_RATIO[len(Q.SPLIT_RECORDS) + 2:]}, {_PAIRS}, {_XSIM[len(_UNIT) + 2:]}, rr AS ({_SQL['response_metrics']}),
gc AS (SELECT avg(cosine) AS c FROM cp GROUP BY grp), xg AS (SELECT avg(nearest) AS mean, max(nearest) AS most FROM xs GROUP BY grp), lt AS (SELECT list_sort(list(value)) AS v, count(value) AS n FROM events WHERE value IS NOT NULL),
m AS (SELECT 'starting_phrase_top1' AS metric, task_type AS key, CAST(top1 AS DOUBLE) AS value FROM st UNION ALL SELECT 'first_3words_unique', task_type, unique3 FROM st
  UNION ALL SELECT 'leakage', split_a || '-' || split_b, shared FROM lk2 UNION ALL SELECT 'task_ratio_edge', task_type, max(ratio) - min(ratio) FROM ra GROUP BY task_type
  UNION ALL SELECT 'persona_occasion_combos', NULL, combos FROM cb UNION ALL SELECT 'persona_occasion_std_ratio', NULL, std_ratio FROM cb UNION ALL SELECT 'intra_group_cosine', NULL, avg(c) FROM gc
  UNION ALL SELECT 'variation_combos', NULL, count(DISTINCT variation_combo) FROM txt WHERE task_type = 'response' UNION ALL SELECT 'xsim_avg', NULL, avg(mean) FROM xg UNION ALL SELECT 'xsim_max', NULL, max(most) FROM xg
  {' '.join(f"UNION ALL SELECT 'auto_eval_rate', '{x}', {x} FROM rr WHERE total_evaluated > 0" for x in _RATES)} UNION ALL SELECT 'latency_p95', NULL, v[CAST(floor(n * 0.95) AS BIGINT) + 1] FROM lt),
ru AS (SELECT * FROM (VALUES {', '.join(f"('{m}', '{op}', CAST({x} AS DOUBLE))" for m, op, x, _ in quality.RULES)}) v(metric, op, lim)),
ev AS (SELECT metric, key, value, op, lim, CASE WHEN value IS NULL THEN 'not evaluated' WHEN (CASE op WHEN '<=' THEN value <= lim WHEN '>=' THEN value >= lim ELSE value < lim END) THEN 'kept' ELSE 'broken' END AS status FROM ru LEFT JOIN m USING (metric))"""
_SQL["quality_metrics"] = f"WITH {_METRICS} SELECT metric, key, round(value, 6) AS value FROM m"
_SQL["go_rules"] = f'WITH {_METRICS} SELECT metric, key, round(value, 6) AS value, op, lim AS "limit", status FROM ev'
_SQL["go_counts"] = f"WITH {_METRICS} SELECT CASE WHEN count(*) FILTER (status = 'broken') = 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) FILTER (status = 'broken') AS broken, count(DISTINCT metric) FILTER (status = 'not evaluated') AS not_evaluated FROM ev"


@_query()
def go_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict with the number of broken rules and of rules nothing is known of."""
    return go_verdict(spark, sf_dir).select("status", F.size("reasons").cast("long").alias("broken"), F.size("not_evaluated").cast("long").alias("not_evaluated"))
