"""Title matching queries: parts as films, their brand as the year."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinegrade.catalog import tables as T
from cinegrade.functions.similarity import relative_distance
from cinegrade.functions.text import dated_title, strip_title
from cinegrade.operators.joins import merge_titles
from cinegrade.operators.matching import EDIT, RATIO, closest_titles


def _targets(spark, d):
    """Rating records `Red Widget (1978)`, one per brand and name."""
    part = T.table(spark, d, "part")
    title = F.concat(F.initcap("p_name"), F.lit("! (1978)"))
    return part.select(F.col("p_brand").alias("year"), dated_title(title).alias("TITLE")).distinct()


def _subtitles(spark, d):
    """Subtitle names `promo red widget`, one per brand, type and name."""
    name = strip_title(F.concat("p_type", F.lit(" "), "p_name"))
    return T.table(spark, d, "part").select(F.col("p_brand").alias("year"), name.alias("MovieName")).distinct()


def _films(spark, d):
    """Film titles `widget red`, one per brand and name."""
    words = F.split("p_name", " ")
    return T.table(spark, d, "part").select(
        F.col("p_brand").alias("year"), F.concat_ws(" ", words[1], words[0]).alias("film")
    ).distinct()


def closest_title_lev(spark, d):
    best = closest_titles(_targets(spark, d), _subtitles(spark, d), "year", "TITLE", "MovieName", EDIT)
    return best.select("year", "TITLE", "closest", F.round("score", 9).alias("score"))


def closest_title_ratio(spark, d):
    best = closest_titles(_targets(spark, d), _subtitles(spark, d), "year", "TITLE", "MovieName", RATIO)
    return best.select("year", "TITLE", "closest", F.round("score", 9).alias("score"))


def title_distance(spark, d):
    best = closest_titles(_targets(spark, d), _films(spark, d), "year", "TITLE", "film", EDIT)
    distance = relative_distance(F.col("TITLE"), F.col("closest"))
    return best.select("year", "TITLE", "closest", F.round(distance, 9).alias("distance"))


def left_merge(spark, d):
    """Targets with their closest subtitle and film, joined back to both tables."""
    targets, subs, films = _targets(spark, d), _subtitles(spark, d), _films(spark, d)
    named = closest_titles(targets, subs, "year", "TITLE", "MovieName", EDIT)
    named = named.select("year", "TITLE", F.col("closest").alias("MovieName"))
    both = closest_titles(named, films, "year", "TITLE", "film", EDIT)
    both = both.select("year", F.col("TITLE").alias("target"), "MovieName", F.col("closest").alias("film"))
    return merge_titles(
        both,
        subs.withColumn("name_length", F.length("MovieName").cast("long")),
        films.withColumn("film_words", F.size(F.split("film", " ")).cast("long")),
    ).select("year", "target", "MovieName", "film", "name_length", "film_words")


QUERIES = {f.__name__: f for f in (closest_title_lev, closest_title_ratio, title_distance, left_merge)}

_TABLES = """
    t AS (SELECT DISTINCT p_brand AS year, p_name AS target FROM part),
    s AS (SELECT DISTINCT p_brand AS year, lower(p_type || ' ' || p_name) AS cand FROM part),
    f AS (SELECT DISTINCT p_brand AS year, split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) AS cand FROM part)"""
_BEST = """SELECT year, target, arg_max(cand, struct_pack(a := sim, b := cand)) AS closest, max(sim) AS score
    FROM (SELECT t.year, target, cand,
            1 - levenshtein(cand, target)::DOUBLE / greatest(length(cand), length(target)) AS sim
        FROM t JOIN {0} c ON t.year = c.year)
    WHERE sim >= 0.6 GROUP BY year, target"""

ORACLES = {
    "closest_title_lev": f"""
        WITH {_TABLES}, b AS ({_BEST.format('s')})
        SELECT t.year, t.target AS "TITLE", coalesce(closest, '') AS closest, round(score, 9) AS score
        FROM t LEFT JOIN b ON t.year = b.year AND t.target = b.target""",
    "title_distance": f"""
        WITH {_TABLES}, b AS ({_BEST.format('f')})
        SELECT t.year, t.target AS "TITLE", coalesce(closest, '') AS closest,
            round(levenshtein(t.target, coalesce(closest, ''))::DOUBLE / (least(length(t.target), length(coalesce(closest, ''))) + 1), 9) AS distance
        FROM t LEFT JOIN b ON t.year = b.year AND t.target = b.target""",
    "left_merge": f"""
        WITH {_TABLES}, bs AS ({_BEST.format('s')}), bf AS ({_BEST.format('f')})
        SELECT t.year, t.target, coalesce(bs.closest, '') AS "MovieName", coalesce(bf.closest, '') AS film,
            CASE WHEN bs.closest <> '' THEN length(bs.closest) END AS name_length,
            CASE WHEN bf.closest <> '' THEN 2 END::BIGINT AS film_words
        FROM t LEFT JOIN bs ON t.year = bs.year AND t.target = bs.target
        LEFT JOIN bf ON t.year = bf.year AND t.target = bf.target""",
}
