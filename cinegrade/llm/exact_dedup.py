"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Each step marks the buckets of its key that hold two rows or more, in a bit table. That of the
prefixes has eight bits a row, so that few buckets are marked by chance, up to MOST_BITS: it is
broadcast, and its size is bounded by that. With far more rows than MOST_BITS chance marks
most buckets, and more rows are hashed in full; results are the same. Rows in a marked bucket go on to the next step; only those that
are left get their full content hashed. Text is never shuffled: the steps are scans, and what
is grouped is a key and a count. Groups of any size are one partial aggregate (largest id,
number). Copies of groups with more than 1 / MOST_LARGE of all rows meet them in a broadcast of fewer
than MOST_LARGE rows; those of smaller groups in a join on the hash.

Defined cases: null text counts as empty; all empty texts are one group; a null id is below
every other id; of rows with the same id and text one is kept; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinegrade.llm.common import hinted, written

PREFIX_CHARS = 256
LENGTH_BITS = 1 << 20
PREFIX_BITS = 1 << 22  # at least
MOST_BITS = 1 << 28  # 68 thousand pages of 600 bytes
MOST_LARGE = 10_000
_WORD = 62  # bits used of a long
_PAGE = 64  # longs of a page


def prefix_bits(n_rows: int) -> int:
    """Buckets of prefixes for so many rows: the power of two from eight times as many on, within bounds."""
    return min(max(1 << (8 * n_rows - 1).bit_length() if n_rows else 0, PREFIX_BITS), MOST_BITS)


def _repeated(rows: DataFrame, key: Column, bits: int) -> DataFrame:
    """(page, masks): the bits of the buckets, key mod `bits`, that hold two rows or more, 64 longs a page."""
    words = (
        rows.groupBy(F.pmod(key, F.lit(bits)).alias("bucket")).count().where("count > 1")
        .selectExpr(f"bucket div {_WORD} AS word", f"shiftleft(1L, CAST(bucket % {_WORD} AS INT)) AS bit")
        .groupBy("word").agg(F.bit_or("bit").alias("mask"))
    )
    places = F.map_from_entries(F.collect_list(F.struct(F.expr(f"CAST(word % {_PAGE} AS INT)"), "mask")))  # 64 at most
    pages = words.groupBy(F.expr(f"word div {_PAGE}").alias("page")).agg(places.alias("places"))
    return pages.select("page", F.expr(f"transform(sequence(0, {_PAGE - 1}), i -> coalesce(element_at(places, i), 0L))").alias("masks"))


def _in_repeated(rows: DataFrame, key: Column, bits: int, marked: DataFrame) -> DataFrame:
    """rows with `held`: is the bucket of the key marked?"""
    bucket = F.pmod(key, F.lit(bits))
    word = F.floor(bucket / F.lit(_WORD))
    joined = rows.withColumns({"at": F.floor(word / F.lit(_PAGE)), "place": (word % _PAGE).cast("int"), "nth": (bucket - word * _WORD).cast("int")})
    joined = joined.join(F.broadcast(marked), joined["at"] == marked["page"], "left")
    held = F.coalesce(F.expr("getbit(get(masks, place), nth) = 1"), F.lit(False))
    return joined.withColumn("held", held).drop("at", "place", "nth", "page", "masks")


def _length() -> Column:
    return F.octet_length("body").cast("long")


def _prefix() -> Column:
    return F.xxhash64(_length(), F.left("body", F.lit(PREFIX_CHARS)))


def hashed_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **carry: Column) -> DataFrame:
    """doc_id, row, content_hash and the carried columns of each row; content_hash, the SHA-256 of the text, is
    null where length or prefix already show that no other row has the text.

    carry: further columns by name, computed from the columns of docs.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"),
                       *(value.alias(name) for name, value in carry.items()))
    lengths = written(_repeated(rows, _length(), LENGTH_BITS), "lengths")
    same_length = _in_repeated(rows, _length(), LENGTH_BITS, lengths)
    bits = prefix_bits(docs.count())
    prefixes = written(_repeated(same_length.where("held"), _prefix(), bits), "prefixes")
    left = _in_repeated(same_length.withColumnRenamed("held", "same_length"), _prefix(), bits, prefixes)
    full = F.when(F.col("same_length") & F.col("held"), F.sha2(F.col("body").cast("binary"), 256))
    return left.select("doc_id", F.monotonically_increasing_id().alias("row"), full.alias("content_hash"), *carry)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **carry: Column) -> DataFrame:
    """Each row with the group of rows that have its text.

    doc_id, keep_id (largest id of the group), group_size, kept, and the carried columns.
    """
    rows = written(hashed_candidates(docs, id_col, text_col, **carry), "hashed")
    several = rows.where("content_hash IS NOT NULL")
    groups = several.groupBy("content_hash").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size"))
    groups = written(groups, "groups")
    bound = rows.count() // MOST_LARGE
    large = F.broadcast(groups.where(F.col("group_size") > bound))  # fewer than MOST_LARGE groups can be so large
    met = several.join(large, "content_hash").unionByName(
        several.join(large, "content_hash", "left_anti").join(groups.where(F.col("group_size") <= bound), "content_hash"))
    found = met.select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), *carry)
    alone = rows.where("content_hash IS NULL").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *carry)
    return alone.unionByName(found)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without exact copies, all columns: of equal texts the row with the largest id stays."""
    full = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    groups = written(exact_groups(docs, id_col, text_col, full=full).where("group_size > 1"), "copies")
    gone = groups.where("NOT kept AND NOT doc_id <=> keep_id").select("doc_id", "full").distinct()
    again = groups.where("doc_id <=> keep_id").groupBy("doc_id", "full").count().where("count > 1").drop("count")
    rows = docs.select(F.struct("*").alias("whole"), F.col(id_col).alias("doc_id"), full.alias("full"))

    def matching(some: DataFrame, other: DataFrame, how: str) -> DataFrame:
        other = hinted(other.select(F.col("doc_id").alias("id"), F.col("full").alias("hash")), 120)
        return some.join(other, some["doc_id"].eqNullSafe(other["id"]) & (some["full"] == other["hash"]), how)

    kept = matching(rows, gone, "left_anti")
    if not again.isEmpty():  # the same id and text twice
        kept = matching(kept, again, "left_anti").unionByName(matching(kept, again, "left_semi").dropDuplicates(["doc_id", "full"]))
    return kept.select("whole.*")
