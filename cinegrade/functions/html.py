"""Record extraction from stored web pages with JVM regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinegrade.functions.text import craft_key

# Named entities that are decoded; `&amp;` last, so that nothing decodes twice.
ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ",
    "&copy;": "©", "&reg;": "®", "&middot;": "·", "&ndash;": "–",
    "&mdash;": "—", "&hellip;": "…", "&amp;": "&",
}
_HIDDEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"


def _decode_numeric(text: Column) -> Column:
    """Replace &#233; and &#xE9; by their characters."""
    parts = F.split(text, "&#")

    def decoded(part: Column, i: Column) -> Column:
        number = F.regexp_extract(part, r"^(\d{1,7}|[xX][0-9a-fA-F]{1,6});", 1)
        code = F.when(
            F.lower(F.left(number, F.lit(1))) == "x", F.conv(F.substr(number, F.lit(2)), 16, 10)
        ).otherwise(number).try_cast("int")
        ok = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        rest = F.substr(part, F.length(number) + 2)
        return F.when(i == 0, part).when(ok, F.concat(char, rest)).otherwise(
            F.concat(F.lit("&#"), part)
        )

    return F.array_join(F.transform(parts, decoded), "")


def decode_entities(text: Column) -> Column:
    text = F.when(F.contains(text, F.lit("&#")), _decode_numeric(text)).otherwise(text)
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def visible(html: Column) -> Column:
    """The page without scripts, styles and comments."""
    return F.regexp_replace(html, _HIDDEN, "")


def stripped_strings(html: Column) -> Column:
    """Trimmed, decoded text pieces between tags, empty ones left out."""
    pieces = F.transform(F.split(html, "<[^>]*>"), lambda t: _strip(decode_entities(t)))
    return F.filter(pieces, lambda t: t != "")


def last_wins(entries: Column) -> Column:
    """Map of (key, value) entries in which a later entry replaces an earlier one."""

    def final(placed: Column) -> Column:
        def is_last(entry: Column, i: Column) -> Column:
            return F.coalesce(F.get(placed, i + 1)["key"] != entry["key"], F.lit(True))

        return F.transform(F.filter(placed, is_last), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))

    placed = F.array_sort(F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), i.alias("i"), e["value"].alias("value"))))
    return F.map_from_entries(F.flatten(F.transform(F.array(placed), final)))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s ]+|[\s ]+$", "")


def inner(html: Column, tag: str, attribute: str = "") -> Column:
    """Content of the first element with this tag (and attribute text); '' if there is none."""
    extra = rf"[^>]*{attribute}[^>]*" if attribute else r"(?:\s[^>]*)?"
    return F.regexp_extract(html, rf"(?is)<{tag}{extra}>(.*?)</{tag}>", 1)


def element(html: Column, tag: str, attribute: str = "") -> Column:
    """Content of the first element with this tag, up to the end tag that balances it; '' if there is none.

    An element that is never closed goes to the end.
    """
    extra = rf"[^>]*{attribute}[^>]*" if attribute else r"(?:\s[^>]*)?"
    rest = F.regexp_extract(html, rf"(?is)<{tag}{extra}>(.*)", 1)

    def step(state: Column, piece: Column) -> Column:
        """depth of open elements, and pieces that belong to the content"""
        moved = F.when(piece.rlike(rf"(?i)^</{tag}"), -1).when(piece.rlike(rf"(?i)^<{tag}\b"), 1).otherwise(0)
        depth = F.when(state["depth"] > 0, state["depth"] + moved).otherwise(0)
        return F.struct(depth.alias("depth"), (state["n"] + (depth > 0).cast("int")).alias("n"))

    def content(pieces: Column) -> Column:
        n = F.aggregate(pieces, F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n")), step)["n"]
        return F.array_join(F.slice(pieces, F.lit(1), n), "")

    return F.transform(F.array(F.split(rest, rf"(?i)(?=</?{tag}\b)")), content)[0]


def child_texts(html: Column) -> Column:
    """Text of each element at the top of a fragment, with that of the elements inside it.

    Text beside the elements is left out; an end tag that closes more than was opened ends the fragment.
    """
    void = r"(?is)^<(?:(?:br|hr|img|input|wbr|link|meta)\b|[^>]*/>|[^\w/])"

    def step(state: Column, piece: Column) -> Column:
        text = F.regexp_replace(piece, "^<[^>]*>", "")
        depth, now = state["depth"], F.concat(state["now"], text)
        opens = piece.startswith("<") & ~piece.startswith("</") & ~piece.rlike(void)
        ends = piece.startswith("</") & (depth == 1)

        def to(depth: Column, cells: Column, now: Column) -> Column:
            return F.struct(depth.alias("depth"), cells.alias("cells"), now.alias("now"))

        return (
            F.when(depth < 0, state)
            .when(opens, to(depth + 1, state["cells"], F.when(depth == 0, text).otherwise(now)))
            .when(ends, to(depth - 1, F.array_append(state["cells"], state["now"]), F.lit("")))
            .when(piece.startswith("</"), to(depth - 1, state["cells"], now))
            .otherwise(to(depth, state["cells"], F.when(depth > 0, now).otherwise(F.lit(""))))
        )

    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("cells"), F.lit("").alias("now"))
    return F.aggregate(F.split(html, "(?=<)"), start, step)["cells"]


def _chunks_after(html: Column, opening: str) -> Column:
    """What follows each opening tag, up to the next one."""
    return F.filter(F.split(html, opening), lambda _, i: i > 0)


def result_records(html: Column, marker: str = 'style="width:1000px;"') -> Column:
    """Rows of a result page as maps from header name to cell text.

    Each marked `div` is a row and each element in it a cell, with all text inside; the first row
    holds the header. A page without marked rows gives an empty list.
    """
    chunks = _chunks_after(visible(html), rf"<div [^>]*{marker}[^>]*>")
    rows = F.transform(chunks, lambda c: F.transform(child_texts(c), decode_entities))

    def records(all_rows: Column) -> Column:
        header = F.get(all_rows, 0)
        body = F.slice(all_rows, F.lit(2), F.size(all_rows))

        def record(row: Column) -> Column:
            width = F.least(F.size(header), F.size(row))
            cells = F.arrays_zip(
                F.slice(header, F.lit(1), width).alias("key"), F.slice(row, F.lit(1), width).alias("value")
            )
            return last_wins(cells)

        return F.transform(body, record)

    return F.flatten(F.transform(F.array(rows), records))


def guide_title(html: Column) -> Column:
    return decode_entities(F.regexp_replace(inner(html, "a", 'class="main"'), "<[^>]*>", ""))


def guide_info(html: Column) -> Column:
    """Info boxes of a guide page as a map; the key `mpaa` becomes `mpaa_reason`."""
    boxes = _chunks_after(visible(html), r'<div [^>]*class="info"[^>]*>')

    def plain(fragment: Column) -> Column:
        return decode_entities(F.regexp_replace(fragment, "<[^>]*>", ""))

    def entry(box: Column) -> Column:
        key = craft_key(plain(inner(box, "h5")))
        return F.struct(
            F.when(key == "mpaa", "mpaa_reason").otherwise(key).alias("key"),
            F.lower(plain(element(box, "div"))).alias("value"),
        )

    return last_wins(F.transform(boxes, entry))


def guide_sections(html: Column) -> Column:
    """Comment lists of a guide page, keyed by the section heading.

    Sections are the elements with id swiki.2.<digit>.
    """
    chunks = _chunks_after(visible(html), r'<\w+ [^>]*id="swiki\.2\.\d"[^>]*>')

    def entry(chunk: Column) -> Column:
        heading = decode_entities(F.regexp_replace(inner(chunk, "h3"), "<[^>]*>", ""))
        return F.struct(
            craft_key(heading).alias("key"),
            stripped_strings(element(chunk, "div", 'class="display"')).alias("value"),
        )

    return last_wins(F.transform(chunks, entry))


def certification_map(text: Column) -> Column:
    """`usa:r / uk:15` as a map; a repeated country keeps its last value.

    Only the first colon of an entry separates; entries without a colon are left out.
    """
    entries = F.transform(F.split(text, " / "), lambda e: F.split(F.trim(e), ":", 2))
    named = F.transform(
        F.filter(entries, lambda e: F.size(e) == 2),
        lambda e: F.struct(craft_key(e[0]).alias("key"), e[1].alias("value")),
    )
    return last_wins(named)


def guide_record(html: Column) -> Column:
    """A guide page as one record: title, info boxes, certifications as a map, and comment sections."""
    info = guide_info(html)
    return F.struct(
        guide_title(html).alias("title"),
        F.map_filter(info, lambda k, _: k != "certification").alias("info"),
        certification_map(F.try_element_at(info, F.lit("certification"))).alias("certification"),
        guide_sections(html).alias("sections"),
    )
