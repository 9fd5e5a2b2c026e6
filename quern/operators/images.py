"""Image measures over pixel tables (img, y, x, v), and the scores made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(pixels: DataFrame) -> DataFrame:
    """img, v, n."""
    return pixels.groupBy("img", "v").agg(F.count("*").cast("double").alias("n"))


def otsu(pixels: DataFrame) -> DataFrame:
    """img, threshold: the grey value that best separates dark from light, from a histogram and running sums."""
    return otsu_of(histogram(pixels))


def otsu_of(h: DataFrame) -> DataFrame:
    run, all_ = Window.partitionBy("img").orderBy("v"), Window.partitionBy("img")
    c = h.select(
        "img",
        "v",
        F.sum("n").over(run).alias("w0"),
        F.sum(F.col("n") * F.col("v")).over(run).alias("s0"),
        F.sum("n").over(all_).alias("n"),
        F.sum(F.col("n") * F.col("v")).over(all_).alias("s"),
    )
    gap = F.expr("s0 / w0 - (s - s0) / (n - w0)")
    c = c.where("w0 < n").withColumn("between", F.round(F.expr("w0 * (n - w0)") * gap * gap, 4))
    return c.groupBy("img").agg(F.min_by("v", F.struct(-F.col("between"), "v")).alias("threshold"))


def dark_tiles(pixels: DataFrame, height: int, width: int, below: float) -> DataFrame:
    tiles = pixels.groupBy("img", F.floor(F.col("y") / height).alias("ty"), F.floor(F.col("x") / width).alias("tx")).agg(F.avg("v").alias("m"))
    return tiles.groupBy("img").agg(F.count("*").alias("tiles"), F.count_if(F.col("m") < below).alias("dark"))


def contrast(pixels: DataFrame) -> DataFrame:
    """img, entropy of the histogram, contrast: Michelson contrast and entropy, half each, 0 for a black image."""
    return contrast_of(histogram(pixels))


def contrast_of(h: DataFrame) -> DataFrame:
    share = F.col("n") / F.sum("n").over(Window.partitionBy("img"))
    per = h.withColumn("p", share).groupBy("img").agg(
        (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"),
        F.min("v").alias("lo"),
        F.max("v").alias("hi"),
    )
    score = ((F.col("hi") - F.col("lo")) / (F.col("hi") + F.col("lo")).cast("double") * 50 + F.col("entropy") / 8 * 50) * 100
    return per.select("img", "entropy", F.least(F.lit(100.0), F.when(F.col("hi") + F.col("lo") == 0, 0.0).otherwise(score)).alias("contrast"))


def ink_fade(pixels: DataFrame) -> DataFrame:
    """img, fade: how little dark and light differ across Otsu's threshold; 100 where there is none."""
    return fade_of(histogram(pixels))


def fade_of(h: DataFrame) -> DataFrame:
    both = h.join(otsu_of(h), "img", "left")

    def side(dark: bool) -> Column:
        own = lambda x: F.sum(F.when((F.col("v") < F.col("threshold")) == F.lit(dark), x))
        return own(F.col("n") * F.col("v")) / own(F.col("n"))

    gap = both.groupBy("img").agg(side(True).alias("dark"), side(False).alias("light"))
    fade = F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 - (F.col("light") - F.col("dark")) * 0.8))
    return gap.select("img", F.when(F.col("dark").isNull() | F.col("light").isNull(), 100.0).otherwise(fade).alias("fade"))


def laplacian(pixels: DataFrame) -> DataFrame:
    """img, edges: variance of the four neighbours' sum less four times the place, mirrored at the rim."""
    rows, columns = Window.partitionBy("img", "y").orderBy("x"), Window.partitionBy("img", "x").orderBy("y")
    around = [
        F.coalesce(*pair, F.col("v")) for w in (rows, columns) for pair in (
            (F.lag("v").over(w), F.lead("v").over(w)),
            (F.lead("v").over(w), F.lag("v").over(w)),
        )
    ]
    return pixels.select("img", (sum(around[1:], around[0]) - 4 * F.col("v")).alias("edge")).groupBy("img").agg(F.var_pop("edge").alias("edges"))


def blur(pixels: DataFrame) -> DataFrame:
    return laplacian(pixels).withColumn("blur", F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 - F.col("edges") / 10.0)))


def image_difficulty(dark: Column, contrast: Column, noise: Column, fade: Column, blur: Column, skew: Column) -> Column:
    return 0.25 * dark + 0.30 * (100 - contrast) + 0.15 * noise + 0.20 * fade + 0.05 * blur + 0.05 * skew


def condition_score(contrast: Column, paper: Column, tears: Column, texture: Column, stains: Column) -> Column:
    return 0.35 * contrast + 0.20 * paper + 0.25 * tears + 0.10 * texture + 0.10 * stains
