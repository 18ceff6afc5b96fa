"""The result table as points to show and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collection, display_title, html_escaped, search_index, without_parentheses
from ..functions.years import era, interpolated, outward


def points(results: DataFrame, genres: DataFrame, info: DataFrame | None = None, narrow: float = 100, wide: float = 900, opacity=(0.85, 0.10)) -> DataFrame:
    """A row per result (work, source, n_chunks, post_median, lo95, hi95, title) of a known genre (code, genre), ready to show.

    Results without numbers or of no genre go. ``info``: work_id, title, author, genre, tradition, date_estimate, summary, history.
    """
    r = results.select("work", "source", F.col("n_chunks").try_cast("double").alias("n_chunks"), *[F.col(c).try_cast("double").alias(c) for c in ("post_median", "lo95", "hi95")], "title")
    r = r.where("post_median IS NOT NULL AND lo95 IS NOT NULL AND hi95 IS NOT NULL").withColumn("code", collection(F.col("work"), whole=False)).join(F.broadcast(genres.withColumnRenamed("genre", "lane")), "code")
    fields = ("author", "genre", "tradition", "date_estimate", "summary", "history")
    if info is not None:
        r = r.join(info.select(F.col("work_id").alias("work"), F.col("title").alias("info_title"), *fields), "work", "left")
    else:
        r = r.select("*", *[F.lit(None).cast("string").alias(c) for c in ("info_title", *fields)])
    title = F.coalesce(F.nullif(F.trim("info_title"), F.lit("")), F.nullif(F.trim("title"), F.lit("")), F.col("work"))
    band = outward(F.col("lo95"), F.col("hi95"))
    return r.select(
        "work",
        "lane",
        F.col("post_median").alias("x"),
        "lo95",
        "hi95",
        F.greatest(F.lit(5.0), F.least(F.lit(38.0), 5 + 2.4 * F.sqrt("n_chunks"))).alias("size"),
        interpolated(F.col("hi95") - F.col("lo95"), narrow, wide, *opacity).alias("opacity"),
        display_title(F.col("work"), F.col("info_title"), F.col("title")).alias("label"),
        F.concat(F.lit("c. "), era(band.lo), F.lit(" – "), era(band.hi)).alias("likely"),
        F.concat(era(F.col("lo95")), F.lit(" – "), era(F.col("hi95"))).alias("span"),
        F.when(F.col("source") == "anchor", "anchored").otherwise("inferred").alias("how"),
        search_index(title, F.col("work"), without_parentheses(F.coalesce("author", F.lit(""))), F.coalesce("genre", F.lit(""))).alias("search"),
        *[html_escaped(F.col(c)).alias(f"{c}_html") for c in fields],
    )


def jittered(points: DataFrame, lane_no: Column, width: float = 0.34, seed: int = 3) -> DataFrame:
    return points.withColumn("y", lane_no + (F.rand(seed) * 2 - 1) * width)


def found(points: DataFrame, term: str) -> DataFrame:
    """Points whose index has the term; an empty one finds all."""
    return points.where(F.contains("search", F.lower(F.trim(F.lit(term)))))


def found_range(points: DataFrame, term: str, pad: float = 0.05) -> DataFrame:
    """One row: n, and the padded range of x of what a search finds."""
    out = found(points, term).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    room = (F.col("hi") - F.col("lo")) * pad
    return out.select("n", (F.col("lo") - room).alias("x_min"), (F.col("hi") + room).alias("x_max"))


def confident(results: DataFrame, lo: str = "lo95", hi: str = "hi95", below: float = 600) -> DataFrame:
    """Results whose credible interval is narrower than ``below``; those without numbers go."""
    return results.where(F.col(hi).try_cast("double") - F.col(lo).try_cast("double") < below)


def landmarks(results: DataFrame, listed: DataFrame) -> DataFrame:
    """Results of a listed work."""
    return results.join(F.broadcast(listed.select("work").distinct()), "work", "left_semi")
