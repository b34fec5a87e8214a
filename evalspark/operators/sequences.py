"""Frames, clips and segments of videos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.draws import hash_index
from evalspark.scaling import group_rank


def check_gaps(df: DataFrame, video: str, frame: str, arrival: list[Column | str]) -> DataFrame:
    """Rows whose frame number runs ahead of the frames that arrived before, plus one."""
    ranked = group_rank(df, [video], arrival, "_r")
    return ranked.where(F.col(frame) > F.col("_r")).drop("_r")


def complete_sequences(df: DataFrame, keys: list[str], min_rows: int) -> DataFrame:
    """Only the groups with at least ``min_rows`` rows."""
    long = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows)
    return df.join(long.select(*keys), keys, "left_semi")


def sample_clip(
    df: DataFrame, video: str, order: list[Column | str], n_frames: int, stride: int, seed: int, start: int | None = None
) -> DataFrame:
    """``n_frames`` frames per video at an even stride from a hashed start.

    The stride shrinks until the clip fits. Videos shorter than ``n_frames`` are left
    out. ``start`` fixes the first frame instead of drawing it.
    """
    ranked = group_rank(df, [video], order, "_r", size="_n").where(F.col("_n") >= n_frames)
    fits = F.floor((F.col("_n") - 1) / F.lit(max(n_frames - 1, 1))).cast("bigint")
    ranked = ranked.withColumn("stride", F.least(F.lit(stride).cast("bigint"), fits))
    span = (n_frames - 1) * F.col("stride") + 1
    first = F.lit(start) if start is not None else hash_index(F.col("_n") - span + 1, seed, F.col(video))
    offset = F.col("_r") - 1 - first
    ranked = ranked.withColumn("_off", offset)
    inside = (F.col("_off") >= 0) & (F.col("_off") % F.col("stride") == 0) & (F.col("_off") < span)
    return (
        ranked.where(inside)
        .withColumn("clip_pos", (F.col("_off") / F.col("stride")).cast("bigint"))
        .drop("_r", "_n", "_off")
    )


def sample_uniform(df: DataFrame, video: str, order: list[Column | str], n_frames: int) -> DataFrame:
    """Every step-th frame with ``step = max(n // n_frames, 1)``, at most ``n_frames`` of them."""
    ranked = group_rank(df, [video], order, "_r", size="_n")
    step = F.greatest(F.floor(F.col("_n") / n_frames), F.lit(1)).cast("bigint")
    index = F.col("_r") - 1
    picked = ranked.withColumn("step", step).where(
        (index % F.col("step") == 0) & (index / F.col("step") < n_frames)
    )
    return picked.withColumn("clip_pos", ((F.col("_r") - 1) / F.col("step")).cast("bigint")).drop("_r", "_n")


def label_mode(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Most frequent label per group; the lowest one wins a tie."""
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min_by(label, F.struct((-F.col("_n")).alias("a"), F.col(label).alias("b")))
    return counts.groupBy(*keys).agg(best.alias(label))


def number_segments(df: DataFrame, video: str, segments: str) -> DataFrame:
    """One row per segment, named ``video`` or ``video_k`` when there are several."""
    rows = df.select("*", F.posexplode(segments).alias("_pos", "segment"))
    several = F.size(segments) > 1
    name = F.when(several, F.concat_ws("_", F.col(video), F.col("_pos") + 1)).otherwise(F.col(video).cast("string"))
    return rows.withColumn("clip_id", name).drop("_pos", segments)


def duration_stats(df: DataFrame, duration: str, segments: str) -> DataFrame:
    """Mean full duration and mean duration of the annotated segments."""
    per_row = df.select(
        F.col(duration).cast("double").alias("_d"),
        F.aggregate(segments, F.lit(0.0), lambda acc, s: acc + s["end_s"] - s["start_s"]).alias("_s"),
        F.size(segments).alias("_n"),
    )
    return per_row.agg(
        F.avg("_d").alias("mean_full_s"), (F.sum("_s") / F.sum("_n")).alias("mean_segment_s")
    )
