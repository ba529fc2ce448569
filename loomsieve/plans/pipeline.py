"""The whole curation: exact, near, semantic and cross-version dedup, then the split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsieve.operators import dedup, split
from loomsieve.storage import materialize


@dataclass(frozen=True)
class CurationConfig:
    """Thresholds of the stages, the group that splits keep whole, the seed."""

    cosine: float = 0.92
    cross_version: float = 0.95
    group_col: str = "base_seed_id"
    seed: int = 42


def curate(records: DataFrame, vectors: DataFrame | None = None, old_vectors: DataFrame | None = None, config: CurationConfig = CurationConfig()) -> tuple[DataFrame, DataFrame]:
    """(records with split, stage counts).

    vectors (ord, vec) and old_vectors (task_type, ord, vec) turn on the semantic and
    the cross-version stage; records without a vector pass both, as do tasks that the
    old version lacks. Cheap stages come first, each one's result is written once.
    """
    raw = materialize(dedup.prepare(records), "prepared")
    kept = materialize(dedup.exact_first(raw), "exact")
    stages = [("raw", raw), ("exact", kept)]
    near = dedup.near_duplicates_removed(kept)
    kept = materialize(kept.join(near.withColumnRenamed("id", "ord"), "ord", "left_anti"), "near")
    stages.append(("near", kept))
    if vectors is not None:
        with_task = kept.select("ord", "task_type").join(vectors, "ord")
        gone = dedup.greedy_removed(dedup.cosine_links(with_task, "task_type", "ord", "vec", config.cosine))
        kept = materialize(kept.join(gone.withColumnRenamed("id", "ord"), "ord", "left_anti"), "semantic")
        stages.append(("semantic", kept))
        if old_vectors is not None:
            with_task = kept.select("ord", "task_type").join(vectors, "ord")
            nearest = dedup.nearest_old(with_task, old_vectors, "task_type", "ord", "vec").where(F.col("nearest") > config.cross_version)
            kept = materialize(kept.join(nearest.select(F.col("id").alias("ord")), "ord", "left_anti"), "cross_version")
            stages.append(("cross_version", kept))
    out = split.train_val_test(kept.drop("split") if "split" in kept.columns else kept, config.group_col, "task_type", config.seed)
    return split.assert_no_leakage(out, config.group_col), dedup.stage_counts(stages)
