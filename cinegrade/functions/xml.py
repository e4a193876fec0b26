"""Subtitle documents as XML: parse, sentence rows, metadata, and the wrapper for plain text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinegrade.fixed_values import CONVERSION_FIELDS

# Only what is used is named: `txt` holds element text, `_bad` the text of a
# document that is not well-formed.
SUBTITLE_SCHEMA = """
    meta STRUCT<source: MAP<STRING, STRING>, conversion: MAP<STRING, STRING>>,
    s ARRAY<STRUCT<
        _id: STRING,
        time: ARRAY<STRUCT<_value: STRING>>,
        w: ARRAY<STRUCT<txt: STRING>>>>,
    _bad STRING
"""
# The same with each word as a plain string, which is parsed in half the time.
_TEXT_SCHEMA = SUBTITLE_SCHEMA.replace("w: ARRAY<STRUCT<txt: STRING>>", "w: ARRAY<STRING>")
# A `w` whose text is followed by another tag than an end tag.
_NESTED_WORD = r"<w\b[^>]*+>[^<]*+<[^/]"
XML_OPTIONS = {
    "valueTag": "txt",
    "attributePrefix": "_",
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "_bad",
}


def parse_subtitle(xml: Column) -> Column:
    """The document with its words as strings.

    As a string an element keeps the tags inside it, and joins the text around comments. So documents with elements,
    comments, CDATA or instructions that may be inside a word are parsed with words as elements of their own.
    """
    instructions = F.locate("<?", xml, 2) > 0  # one at the start is the declaration
    apart = F.contains(xml, F.lit("<!")) | instructions | xml.rlike(_NESTED_WORD)
    whole = F.get(F.transform(F.array(F.from_xml(xml, SUBTITLE_SCHEMA, XML_OPTIONS)), _words_as_text), 0)
    return F.when(~apart, F.from_xml(xml, _TEXT_SCHEMA, XML_OPTIONS)).otherwise(whole)


def _words_as_text(doc: Column) -> Column:
    def sentence(s: Column) -> Column:
        return F.struct(s["_id"].alias("_id"), s["time"].alias("time"), F.transform(s["w"], lambda w: w["txt"]).alias("w"))

    return F.struct(doc["meta"].alias("meta"), F.transform(doc["s"], sentence).alias("s"), doc["_bad"].alias("_bad"))


def is_corrupted(doc: Column) -> Column:
    """True for a document without sentences, malformed ones included."""
    return doc["s"].isNull()


def sentence_rows(doc: Column, word_field: str | None = None) -> Column:
    """Sentences as (id, times, words); a missing part is an empty array, a missing field ''.

    Words are strings, or hold their text in word_field.
    """

    def texts(children: Column, field: str | None) -> Column:
        values = F.transform(children, lambda c: F.coalesce(c[field] if field else c, F.lit("")))
        return F.coalesce(values, F.array().cast("array<string>"))

    rows = F.transform(
        doc["s"],
        lambda s: F.struct(
            s["_id"].alias("id"),
            texts(s["time"], "_value").alias("times"),
            texts(s["w"], word_field).alias("words"),
        ),
    )
    return F.coalesce(rows, F.array().cast("array<struct<id:string,times:array<string>,words:array<string>>>"))


def metadata(doc: Column) -> Column:
    """All source fields and the known conversion fields; conversion wins on a clash."""
    empty = F.create_map().cast("map<string,string>")
    source = F.coalesce(doc["meta"]["source"], empty)
    conversion = F.coalesce(doc["meta"]["conversion"], empty)
    kept = F.map_filter(conversion, lambda k, _: k.isin(CONVERSION_FIELDS))
    own = F.map_filter(source, lambda k, _: ~F.map_contains_key(kept, k))
    return F.map_concat(own, kept)


def clock_seconds(clock: Column) -> Column:
    """Seconds of a `HH:MM:SS,mmm` time string; null if it is not one."""
    part = lambda i: F.regexp_extract(clock, r"^(\d+):(\d+):(\d+)(?:[,.](\d+))?$", i).try_cast("double")
    fraction = F.coalesce(part(4), F.lit(0.0)) / 1000
    return part(1) * 3600 + part(2) * 60 + part(3) + fraction


def duration_seconds(sentences: Column) -> Column:
    """Time between the first and the last time stamp of a document."""
    times = F.flatten(F.transform(sentences, lambda s: s["times"]))
    return clock_seconds(F.try_element_at(times, F.lit(-1))) - clock_seconds(F.get(times, 0))


def escape_xml(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def sentence_elements(text: Column) -> Column:
    """Plain text as `s` elements: one per line, with its space-separated words as `w`.

    Sentence i starts at second 2 * i of the film.
    """

    def sentence(line: Column, i: Column) -> Column:
        number = (i + 1).cast("string")
        words = F.array_remove(F.split(line, " "), "")
        opening = F.concat(F.lit('<w id="'), number, F.lit("."))
        # what stands between two words is the same in the whole line: only the rest is put together for each
        each = F.transform(words, lambda w, j: F.concat((j + 1).cast("string"), F.lit('">'), w))
        elements = F.concat(opening, F.call_function("array_join", each, F.concat(F.lit("</w>"), opening)), F.lit("</w>"))
        second = i * 2
        clock = F.format_string(
            "%02d:%02d:%02d,000",
            F.floor(second / 3600), F.floor(second / 60) % 60, F.floor(second) % 60,
        )
        return F.concat(
            F.lit('<s id="'), number, F.lit('"><time id="T'), number,
            F.lit('S" value="'), clock, F.lit('"/>'), F.when(F.size(words) > 0, elements).otherwise(""), F.lit("</s>"),
        )

    return F.array_join(F.transform(F.split(escape_xml(text), "\n"), sentence), "")


def wrap_text(text: Column, meta: Column | None = None) -> Column:
    """Plain text as a whole subtitle document."""
    head = F.lit("") if meta is None else meta
    return F.concat(F.lit("<document>"), head, sentence_elements(text), F.lit("</document>"))
