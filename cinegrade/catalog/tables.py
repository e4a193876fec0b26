"""The driver tables in the roles the library expects, and SQL pieces for the same roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegrade.fixed_values import ENGLISH_STOP_WORDS
from cinegrade.functions import html as H
from cinegrade.functions import xml as X
from cinegrade.functions.text import clean_tokens, remove_stop_words
from cinegrade.session import spread
from cinegrade.sources.readers import subtitle_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages", "conversations", "embeddings") else df


def document_path() -> Column:
    return F.concat(F.lit("en/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".xml"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path and text: a document plays a subtitle file."""
    return table(spark, sf_dir, "documents").select("doc_id", document_path().alias("path"), "text")


def tokenised(spark: SparkSession, sf_dir: str, stop_words: bool = True) -> DataFrame:
    """doc_id and cleaned tokens, without stop words unless told otherwise."""
    tokens = clean_tokens(F.col("text"))
    tokens = remove_stop_words(tokens) if stop_words else tokens
    return table(spark, sf_dir, "documents").select("doc_id", tokens.alias("tokens"))


def labelled_tokens(spark: SparkSession, sf_dir: str, labels: DataFrame) -> DataFrame:
    """Labelled documents with their tokens; the join comes first, so only they are tokenised."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id")
    return rows.withColumn("tokens", remove_stop_words(clean_tokens(F.col("text")))).drop("text")


def raw_rating() -> Column:
    """Rating of a label row: toxic decides R and NC-17, quality PG and the out-of-use GP."""
    return (
        F.when((F.col("toxic") == 1) & (F.col("quality") == 1), "R")
        .when(F.col("toxic") == 1, "NC-17")
        .when(F.col("quality") == 1, "PG")
        .otherwise("GP")
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels")
    return rows.select(F.col("doc_id").cast("string").alias("file_id"), raw_rating().alias("rating"))


def subtitle_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as XML. Those of src7 have no sentences, those of src13 are cut off."""
    docs = table(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    words = F.array_remove(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), "")
    meta = F.concat(
        F.lit("<meta><source><genre>"), F.col("lang"), F.lit("</genre><title>"), F.col("source"),
        F.lit("</title><tokens>0</tokens></source><conversion><sentences>"), F.size(lines).cast("string"),
        F.lit("</sentences><tokens>"), F.size(words).cast("string"),
        F.lit("</tokens><corrected>9</corrected></conversion></meta>"),
    )
    xml = F.concat(
        F.lit("<document>"), meta,
        F.when(F.col("source") != "src7", X.sentence_elements(F.col("text"))).otherwise(""),
        F.when(F.col("source") != "src13", "</document>").otherwise(""),
    )
    return docs.select(document_path().alias("path"), xml.alias("xml"))


def subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitle_rows(subtitle_xml(spark, sf_dir))


PAGE_SECTIONS = {
    "alcohol_drugs_smoking": ("nav", ""),
    "violence_gore": ("div", 'class="ad"'),
    "sex_nudity": ("article", ""),
    "frightening_intense_scenes": ("footer", ""),
    "profanity": ("title", ""),
}


def guides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as guide records.

    Pages with `#top` in the address have no section at all, mobile pages an empty one.
    """
    shown = H.visible(F.col("html"))
    top, mobile = F.contains("url", F.lit("#top")), F.contains("url", F.lit("//m."))
    sections = []
    for name, where in PAGE_SECTIONS.items():
        texts = H.stripped_strings(H.inner(shown, *where))
        if name == "violence_gore":
            texts = F.when(mobile, F.array().cast("array<string>")).otherwise(texts)
        sections.append(F.when(~top, texts).alias(name))
    pages = table(spark, sf_dir, "pages")
    return pages.select(F.col("page_id").cast("string").alias("imdb_id"), *sections, "url")


# ---- the same roles in SQL -------------------------------------------------------------

STOP_SQL = "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOP_WORDS) + ")"
TOKENS_SQL = r"list_filter(regexp_extract_all(lower(text), '[\w-]+'), lambda w: length(w) > 1)"
WORDS_SQL = "list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda w: w <> '')"
PATH_SQL = "'en/' || source || '/' || CAST(doc_id AS VARCHAR) || '.xml'"
RATING_SQL = """CASE WHEN toxic = 1 AND quality = 1 THEN 'R' WHEN toxic = 1 THEN 'NC-17'
    WHEN quality = 1 THEN 'PG' ELSE 'GP' END"""
LABELS_SQL = f"SELECT doc_id, CAST(doc_id AS VARCHAR) AS file_id, {RATING_SQL} AS rating FROM labels"
VALID_SQL = f"SELECT * FROM ({LABELS_SQL}) WHERE rating IN ('R', 'PG-13', 'PG', 'G', 'NC-17')"
TERMS_SQL = f"""SELECT doc_id, term, count(*) AS n
    FROM (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM documents)
    WHERE term NOT IN {STOP_SQL} GROUP BY doc_id, term"""


def hash_sql(key: str, seed: int = 0) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT)"


def _decode_sql(x: str) -> str:
    from cinegrade.functions.html import ENTITIES

    for entity, char in ENTITIES.items():
        x = f"replace({x}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return x


def strings_sql(html: str) -> str:
    trimmed = rf"regexp_replace({_decode_sql('t')}, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g')"
    return (
        f"list_filter(list_transform(regexp_split_to_array({html}, '<[^>]*>'), lambda t: {trimmed}), "
        "lambda t: t <> '')"
    )


VISIBLE_SQL = r"regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g')"


def inner_sql(tag: str, attribute: str = "") -> str:
    return f"regexp_extract({VISIBLE_SQL}, '(?is)<{tag}[^>]*{attribute}[^>]*>(.*?)</{tag}>', 1)"


def _section_sql(name: str, where: tuple[str, str]) -> str:
    texts = strings_sql(inner_sql(*where))
    if name == "violence_gore":
        texts = f"CASE WHEN url LIKE '%//m.%' THEN [] ELSE {texts} END"
    return f"CASE WHEN url NOT LIKE '%#top%' THEN {texts} END AS {name}"


GUIDES_SQL = (
    "SELECT CAST(page_id AS VARCHAR) AS imdb_id, url, "
    + ", ".join(_section_sql(n, w) for n, w in PAGE_SECTIONS.items())
    + " FROM pages"
)
LONG_GUIDES_SQL = " UNION ALL ".join(
    f"SELECT imdb_id, '{n}' AS category, {n} AS sentences FROM g WHERE {n} IS NOT NULL" for n in PAGE_SECTIONS
)
