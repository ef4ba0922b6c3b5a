"""Image gate: decisions over feature columns that were computed upstream.

Frames: ``tiles(image_id, tile, std, laplacian, tenengrad)``, ``features(image_id, ...)``,
``overlaps(image_id, token_index, field, glare, contiguous, score)``,
``streaks(image_id, area, width, height, text_overlap)``. One aggregate per image each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sharpness_summary(tiles: DataFrame) -> DataFrame:
    """Informative tiles (std >= 10), share of sharp ones, medians, and whether the image is too blurry."""
    good = F.col("std") >= 10
    sharp = good & (F.col("laplacian") >= 35) & (F.col("tenengrad") >= 900)
    out = tiles.groupBy("image_id").agg(
        F.count_if(good).alias("informative_tiles"),
        (F.count_if(sharp) / F.greatest(F.count_if(good), F.lit(1))).alias("sharp_tile_ratio"),
        F.coalesce(F.percentile(F.when(good, F.col("laplacian")), F.lit(0.5)), F.lit(0.0)).alias("median_laplacian"),
        F.avg("laplacian").alias("laplacian"),
        F.avg("tenengrad").alias("tenengrad"),
        F.min("laplacian").alias("coarse_laplacian"),
    )
    blurry = (F.col("laplacian") < 2) & (F.col("tenengrad") < 800) & (F.col("median_laplacian") < 2) & (F.col("coarse_laplacian") < 8) & (F.col("sharp_tile_ratio") < 0.02)
    return out.withColumn("too_blurry", blurry)


def glare_gate(features: DataFrame) -> DataFrame:
    """Severe glare: a large ratio with a large or elongated part, or an extreme ratio or part."""
    large = (F.col("glare_ratio") >= 0.12) & ((F.col("largest_ratio") >= 0.08) | (F.col("elongated_ratio") >= 0.06))
    extreme = (F.col("glare_ratio") >= 0.20) | (F.col("largest_ratio") >= 0.16)
    return features.select("image_id", (large | extreme).alias("severe_glare"))


def component_summary(components: DataFrame) -> DataFrame:
    """Per image: the largest part, and area and number of elongated parts (aspect >= 3.5, ratio >= 0.0008)."""
    aspect = F.greatest("width", "height") / F.greatest(F.least("width", "height"), F.lit(1.0))
    long = (aspect >= 3.5) & (F.col("ratio") >= 0.0008)
    return components.groupBy("image_id").agg(F.max("ratio").alias("largest_ratio"), F.coalesce(F.sum(F.when(long, F.col("ratio"))), F.lit(0.0)).alias("elongated_ratio"), F.count_if(long).alias("n_elongated"))


def overlap_summary(overlaps: DataFrame) -> DataFrame:
    """Per image: glare candidates (>= 0.08), severe ones, triggered ones, and the five worst tokens."""
    candidate = F.col("glare") >= 0.08
    triggered = candidate & (F.col("score").isNull() | (F.col("score") < 0.80))
    worst = F.slice(F.array_sort(F.collect_list(F.when(candidate, F.struct((-F.col("glare")).alias("g"), "token_index")))), 1, 5)
    return overlaps.groupBy("image_id").agg(
        F.count_if(candidate).alias("n_candidates"),
        F.count_if(F.col("glare") >= 0.45).alias("n_severe"),
        F.count_if(triggered).alias("n_triggered"),
        F.array_join(F.transform(worst, lambda x: x["token_index"].cast("string")), ",").alias("worst"),
    )


def field_glare(overlaps: DataFrame) -> DataFrame:
    """Per image and field: the strongest overlaps, and whether any token is covered by a solid highlight."""
    solid = (F.col("glare") >= 0.08) & (F.col("contiguous") >= 0.03)
    readable = F.coalesce(F.col("score") >= 0.98, F.lit(False))
    return overlaps.groupBy("image_id", "field").agg(F.max("glare").alias("glare"), F.max("contiguous").alias("contiguous"), (F.bool_or(solid) & ~F.bool_or(readable)).alias("covered"))


def triggered_message(overlaps: DataFrame) -> DataFrame:
    """The first three covered fields of an image, by name, as one text."""
    covered = field_glare(overlaps).where("covered")
    return covered.groupBy("image_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("field")), 1, 3), "、").alias("message"), F.count("*").alias("n_fields"))


def streak_gate(streaks: DataFrame) -> DataFrame:
    """Several streaks across text: at least four, with a total area of 0.001 or more; and the 20 largest."""
    crossing = (F.col("text_overlap") > 0) & (F.greatest("width", "height") >= 3 * F.greatest(F.least("width", "height"), F.lit(1.0)))
    largest = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("area")).alias("a"), "streak"))), 1, 20)
    out = streaks.groupBy("image_id").agg(F.count_if(crossing).alias("n_streaks"), F.coalesce(F.sum(F.when(crossing, F.col("area"))), F.lit(0.0)).alias("streak_area"), F.array_join(F.transform(largest, lambda x: x["streak"].cast("string")), ",").alias("largest"))
    return out.withColumn("rejected", (F.col("n_streaks") >= 4) & (F.col("streak_area") >= 0.001))


def client_checks(images: DataFrame) -> DataFrame:
    """Issues of an image by its size, brightness, contrast and sharpness, in order."""
    rules = [("small", F.col("short_side") < 600), ("dark", F.col("mean") < 45), ("bright", F.col("mean") > 228), ("flat", F.col("contrast") < 24), ("soft", F.col("sharpness") < 65)]
    return images.select("image_id", F.array_join(F.array_compact(F.array(*[F.when(c, n) for n, c in rules])), ",").alias("issues"))


def text_quality(metrics: DataFrame) -> DataFrame:
    """The first matching reason of a ladder over token metrics: no text, small, low resolution, low scores, fine.

    Metrics count to six places, as they are given out: a mean that is a limit but for
    the order of its sum is that limit.
    """
    m = lambda c: F.round(c, 6)
    reason = (
        F.when(F.col("n_tokens") < 3, "no_text").when(m("median_side") < 8, "too_small").when(m("median_side") < 14, "low_resolution")
        .when((m("low_characters") >= 0.5) | (m("mean_score") < 0.45), "unreadable").when(m("lower_quartile") < 0.25, "partly_unreadable").otherwise("fine")
    )
    return metrics.select("group_id", reason.alias("reason"))
