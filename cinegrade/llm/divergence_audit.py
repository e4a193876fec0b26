"""How far the term use of each source departs from its language's and from that of each other source.

The terms to compare are those in at least `least_docs` documents of a language. They are found by
iceberg prefix refinement: a prefix is in at least as many documents as any term that starts with it.
Level by level the byte prefixes of the terms grow (FIRST_WIDTH bytes, then twice as many each
time); a level counts, for each prefix whose shorter prefix is still alive, the distinct documents of
the language that hold it, and discards it below the threshold. A term that ends within the level's
width counts as complete, and is kept or discarded there. It ends when no longer prefix is alive, after
as many levels as the longest frequent prefix takes. Rare terms never reach a shuffle whole.

Texts are cut into terms once, into one row of distinct terms with their counts for each document. Tasks hold a
bit set of the alive prefixes by hash; its size follows their number up to MAX_BITS. A false
positive is counted like any other and falls at the next threshold, so kept terms are exact at any size.

With V kept terms in a language and N occurrences of them, a term that occurs n times has
p = 1 + floor(10^9 (n + 2) / (N + 2 V)); two such numbers p and q differ by floor((p - q)^2 / (p + q)).
All of it is integer arithmetic. Pairs of sources are summed over blocks of terms and of sources (TERMS x SOURCES
numbers at most in a task), and every block of sources meets every other one as the result needs.

Defined cases: null text, language or source is the empty string; a document without a term still
makes its group occur; a language without kept terms has pairs of value 0 and no terms; a source alone in its
language has no pairs; repeated rows are documents of their own; equal values rank by item in UTF-8
order; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinegrade.llm.common import bitmap, in_bitmap, slices, utf8, written

FIRST_WIDTH = 6
MAX_BITS = 1 << 26
TERMS, SOURCES = 2048, 128
SCALE = 1_000_000_000
GATHERED = 8 << 20  # bytes of documents' terms that a task counts together
_CUT = bytes(c if c > 0x7F or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and of all characters beyond ASCII, A-Z in lower case."""
    return text.translate(_CUT).split()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        counted = [Counter(terms_of(t)) for t in utf8(part.column("text"))]
        terms = pa.array([b" ".join(c) for c in counted], pa.binary())
        times = pa.array([np.fromiter(c.values(), "<i8", len(c)).tobytes() for c in counted], pa.binary())
        yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("source"), terms, times], names=["lang", "source", "terms", "times"])


def cut_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, distinct terms and how often each occurs, for each row of docs.

    Terms hold no space, so one stands between each two; the times are 64-bit numbers. Spark passes both on as they are.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    return docs.select(*named).mapInArrow(_cut, "lang string, source string, terms binary, times binary")


def _coded(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _gathered(batches: Iterator[pa.RecordBatch], most: int = GATHERED) -> Iterator[pa.RecordBatch]:
    """Batches joined until their terms take `most` bytes: the more documents together, the fewer distinct terms each.

    Rows without a term are left out.
    """
    held, n = [], 0
    for batch in batches:
        batch = batch.filter(pc.greater(pc.binary_length(batch.column("terms")), 0))
        held.append(batch)
        n += pc.sum(pc.binary_length(batch.column("terms"))).as_py() or 0
        if n >= most:
            yield pa.concat_batches(held)
            held, n = [], 0
            pa.default_memory_pool().release_unused()
    if held:
        yield pa.concat_batches(held)


def _rows_and_terms(batch: pa.RecordBatch, longer: int = 0) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For each term of each document of more than `longer` bytes: the row and the term's number; and the distinct terms."""
    lists = pc.split_pattern(batch.column("terms"), " ")
    row, flat = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy())), lists.flatten()
    if longer:
        there = pc.greater(pc.binary_length(flat), longer)
        row, flat = row[there.to_numpy(zero_copy_only=False)], flat.filter(there)
    return row, *_coded(flat)


def _distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values in order, by a sort."""
    values = np.sort(values)
    return values[np.flatnonzero(np.diff(values, prepend=-1))]


def _alive(langs: pa.Array, names: pa.Array, keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which keys (number of the language times the number of names, plus that of the name) are in the bit set."""
    distinct = _distinct(keys)
    seeds = [xxhash.xxh64_intdigest(g, 42) for g in langs.cast(pa.binary()).to_pylist()]
    lang, name = np.divmod(distinct, max(len(names), 1))
    hashes = (xxhash.xxh64_intdigest(x, seeds[g]) for g, x in zip(lang.tolist(), names.take(pa.array(name)).to_pylist()))
    alive = in_bitmap(bits, np.fromiter(hashes, np.uint64, len(distinct)))
    return alive[np.searchsorted(distinct, keys)]


def _prefixes(batches: Iterator[pa.RecordBatch], before: int, width: int, bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Documents that hold each prefix of `width` bytes whose first `before` bytes are alive, and each term that ends there."""
    for batch in _gathered(batches):
        row, code, terms = _rows_and_terms(batch, before)
        lang_of_row, langs = _coded(batch.column("lang"))
        size = pc.binary_length(terms).to_numpy(zero_copy_only=False)
        prefix, prefixes = _coded(pc.binary_slice(terms, 0, width))
        item = 2 * prefix + (size <= width)
        if before:
            parent, parents = _coded(pc.binary_slice(terms, 0, before))
            alive = _alive(langs, parents, lang_of_row[row] * max(len(parents), 1) + parent[code], bits)
            row, code = row[alive], code[alive]
        n_items = max(2 * len(prefixes), 1)
        held_row, held = np.divmod(_distinct(row * n_items + item[code]), n_items)  # a document counts once
        key, docs = np.unique(lang_of_row[held_row] * n_items + held, return_counts=True)
        lang, held = np.divmod(key, n_items)
        yield pa.RecordBatch.from_arrays(
            [langs.take(pa.array(lang)), prefixes.take(pa.array(held // 2)), pa.array(held % 2 == 1), pa.array(docs.astype(np.int64))],
            names=["lang", "prefix", "complete", "docs"])


def _occurrences(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each term that may be kept, in each language: the sources that use it, and how often."""
    for batch in _gathered(batches):
        row, code, terms = _rows_and_terms(batch)
        lang_of_row, langs = _coded(batch.column("lang"))
        source_of_row, sources = _coded(batch.column("source"))
        n_terms, n_sources = max(len(terms), 1), max(len(sources), 1)
        key = (lang_of_row[row] * n_terms + code) * n_sources + source_of_row[row]
        order = np.argsort(key)
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        times = np.frombuffer(b"".join(batch.column("times").to_pylist()), "<i8")[order]
        key, times = key[order][first], np.add.reduceat(times, first) if len(first) else times
        pair, source = np.divmod(key, n_sources)
        alive = _alive(langs, terms, pair, bits)
        pair, source, times = pair[alive], source[alive], times[alive]
        starts = np.flatnonzero(np.diff(pair, prepend=-1))
        ends = pa.array(np.append(starts, len(pair)).astype(np.int32))
        lang, term = np.divmod(pair[starts], n_terms)
        yield pa.RecordBatch.from_arrays(
            [langs.take(pa.array(lang)), terms.take(pa.array(term)),
             pa.ListArray.from_arrays(ends, sources.take(pa.array(source))), pa.ListArray.from_arrays(ends, pa.array(times))],
            names=["lang", "term", "sources", "times"])


def term_counts(cut: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, term and occurrences n of the kept terms.

    A term's sources travel in one row, dealt by language and term; there they are added up where they are.
    """
    bits = _bits(kept, "term")
    listed = cut.mapInArrow(lambda b: _occurrences(b, bits), "lang string, term binary, sources array<string>, times array<bigint>")
    listed = listed.repartition("lang", "term").join(kept, ["lang", "term"], "left_semi")  # the bits may let others through
    each = listed.select("lang", "term", F.explode(F.arrays_zip("sources", "times")).alias("at"))
    return each.groupBy("lang", "term", F.col("at.sources").alias("source")).agg(F.sum("at.times").alias("n"))


def _bits(keys: DataFrame, name: str) -> np.ndarray:
    """Bit set of (lang, name), 32 bits for each key up to MAX_BITS."""
    size = 1 << 16
    while size < min(32 * keys.count(), MAX_BITS):
        size *= 2
    return bitmap(keys.select(F.xxhash64("lang", name).alias("key")), "key", size)


def kept_terms(cut: DataFrame, least_docs: int = 10, first_width: int = FIRST_WIDTH) -> DataFrame:
    """(lang, term) of the terms in at least least_docs documents of a language, by refinement of their prefixes."""
    before, width, bits = 0, first_width, None
    complete = []
    while True:
        level = cut.select("lang", "terms").mapInArrow(
            lambda b, before=before, width=width, bits=bits: _prefixes(b, before, width, bits), "lang string, prefix binary, complete boolean, docs bigint")
        level = level.groupBy("lang", "prefix", "complete").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
        level = written(level, f"prefixes-{width}")
        complete.append(level.where("complete").select("lang", F.col("prefix").alias("term")))
        alive = level.where("not complete").select("lang", "prefix")
        if alive.isEmpty():
            break
        before, width, bits = width, 2 * width, _bits(alive, "prefix")
    kept = complete[0]
    for more in complete[1:]:
        kept = kept.unionByName(more)
    return kept


def _share(n: Column | int) -> Column:
    """1 + floor(SCALE (n + 2) / (n_all + 2 n_terms)), exact beyond 64 bits."""
    n = F.lit(n) if isinstance(n, int) else n
    above = F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    below = (F.col("n_all") + 2 * F.col("n_terms")).cast("decimal(20,0)")
    return 1 + F.call_function("div", above, F.when(below > 0, below))


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _paired(cells: pa.Table) -> pa.Table:
    """Sums of the differences of each source of block lo and each of block hi over a chunk's terms."""
    lang, lo, hi = (cells.column(c)[0].as_py() for c in ("lang", "lo", "hi"))
    n_terms = pc.max(cells.column("chunk_terms")).as_py()  # on the rows without a term
    block, p = cells.column("block").to_numpy(), cells.column("p").to_numpy()
    plain = cells.column("term").is_null().to_numpy()
    code = cells.column("term").combine_chunks().dictionary_encode()
    row, rows = code.indices.fill_null(-1).to_numpy(zero_copy_only=False), len(code.dictionary)
    name = np.array(cells.column("source").to_pylist(), dtype=object)
    sides = []
    for side in dict.fromkeys((lo, hi)):
        names, column = np.unique(name[block == side], return_inverse=True)
        bare = np.zeros(len(names), dtype=np.int64)
        bare[column[plain[block == side]]] = p[(block == side) & plain]
        grid = np.tile(bare, (rows + 1, 1))  # the last row stands for the terms that no source of either block has
        there = (block == side) & ~plain
        grid[row[there], column[~plain[block == side]]] = p[there]
        sides.append((names, grid))
    (left, a), (right, b) = sides[0], sides[-1]
    out: list[tuple[str, str, int]] = []
    for k, source in enumerate(left):
        apart = _apart(a[:, k : k + 1], b)
        sums = apart[:-1].sum(axis=0) + (n_terms - rows) * apart[-1]
        for item, value in zip(right, sums.tolist()):
            if source != item:
                out += [(source, item, value)] if lo == hi else [(source, item, value), (item, source, value)]
    columns = list(zip(*out)) or [(), (), ()]
    return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "source": pa.array(columns[0], pa.string()),
                     "item": pa.array(columns[1], pa.string()), "value": pa.array(columns[2], pa.int64())})


def _pairs(groups: DataFrame, cells: DataFrame, kept: DataFrame, terms: int, sources: int) -> DataFrame:
    """(lang, source, item, value) of each two sources of a language.

    groups: lang, source, n_all, n_terms, n_sources. Chunks of terms and blocks of sources are by hash, as
    many as keep them near `terms` and `sources`.
    """
    n_chunks, n_blocks = F.greatest(F.ceil(F.col("n_terms") / terms), F.lit(1)), F.greatest(F.ceil(F.col("n_sources") / sources), F.lit(1))
    chunk = F.pmod(F.xxhash64("term"), n_chunks).alias("chunk")
    block = F.pmod(F.xxhash64("source"), n_blocks).alias("block")
    langs = groups.select("lang", "n_terms").distinct()
    sizes = kept.join(langs, "lang").groupBy("lang", chunk).agg(F.count("*").alias("chunk_terms"))
    chunks = langs.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), n_chunks - 1)).alias("chunk")).join(sizes, ["lang", "chunk"], "left")
    chunks = chunks.select("lang", "chunk", F.coalesce("chunk_terms", F.lit(0)).alias("chunk_terms"))
    plain = groups.select("lang", "source", block, n_blocks.alias("n_blocks"), F.coalesce(_share(0), F.lit(1)).alias("p"))
    plain = plain.join(chunks, "lang").select("lang", "chunk", "chunk_terms", "n_blocks", "block", "source", F.lit(None).cast("binary").alias("term"), "p")
    full = cells.select("lang", chunk, F.lit(None).cast("long").alias("chunk_terms"), n_blocks.alias("n_blocks"), block, "source", "term", "p")
    rows = full.unionByName(plain).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    rows = rows.select("lang", "chunk", "chunk_terms", "block", "source", "term", "p", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    summed = rows.groupBy("lang", "chunk", "lo", "hi").applyInArrow(_paired, "lang string, source string, item string, value bigint")
    return summed.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          first_width: int = FIRST_WIDTH, terms: int = TERMS, sources: int = SOURCES) -> DataFrame:
    """lang, source, part, item, value and rank.

    Part `pair`: the difference to each other source of the language. Part `term`: the `top` terms that a
    source uses more than its language does, by how much their shares differ.
    """
    cut = written(cut_documents(docs, text_col, lang_col, source_col), "cut-documents")
    kept = written(kept_terms(cut, least_docs, first_width), "kept-terms")
    counted = written(term_counts(cut, kept), "term-counts")
    groups = cut.select("lang", "source").distinct()
    n_terms, n_sources = kept.groupBy("lang").agg(F.count("*").alias("n_terms")), groups.groupBy("lang").agg(F.count("*").alias("n_sources"))
    totals = counted.groupBy("lang", "source").agg(F.sum("n").alias("n_all"))
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_all", "n_terms")]
    groups = written(groups.join(totals, ["lang", "source"], "left").join(n_terms, "lang", "left").join(n_sources, "lang").select("lang", "source", *filled, "n_sources"), "groups")
    cells = counted.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n")))

    of_lang = counted.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    langs = groups.groupBy("lang").agg(F.sum("n_all").alias("n_all"), F.first("n_terms").alias("n_terms"))
    of_lang = of_lang.join(langs, "lang").select("lang", "term", _share(F.col("n")).alias("q"))
    apart = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("p") + F.col("q"))
    telling = cells.join(of_lang, ["lang", "term"]).where("p > q").select("lang", "source", F.col("term").cast("string").alias("item"), apart.alias("value"))

    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = _pairs(groups, cells, kept, terms, sources).withColumn("rank", ranked)
    best = telling.withColumn("rank", ranked).where(F.col("rank") <= top)
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return columns(pairs, "pair").unionByName(columns(best, "term"))
