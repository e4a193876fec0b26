"""Exact Jaccard join of word n-gram sets as a metric-space join, and its connected groups.

Sets x and y have Jaccard similarity of at least t exactly if their distance |x ^ y| (symmetric
difference) is at most (1 - t) / (1 + t) * (|x| + |y|). That distance is a metric, and it does not
change when both sets are moved by the same set: |x ^ y| = |(x ^ b) ^ (y ^ b)|.

Pivots and regions. Elements have an order. The pivot of an element e is the family of all sets
whose first element is e; a set's distance to it is the number of its own elements before e, plus
one if it lacks e. A set's home region is that of its first element, at distance 0. By the
triangle inequality a set within distance d of it has its home at distance d at most, so
replicating each set to the regions within the window, which are those of its first
(1 - t) * |x| + 1 elements, brings every linked pair together. Frequent elements come last in the
order, so that regions are small; the order only affects speed.

Regions join their members by size, by the rank of the shared element and by parity
sketches, which are never farther apart than the sets: 512 bits for all, and a bit for each element
or more for larger sets. Regions over REGION sets do so inside a task and give a forest of the pairs left,
those over LEAF give a star. What is left forms candidate groups: linked pairs are inside one group.

Groups of LEAF sets or fewer are compared exactly in one task. Larger groups recurse: the pivot is the
group's consensus set b, the elements of more than half of its sets, and each set x is replaced by
x ^ b, which is small if the group is dense. Sets near the pivot, slack(x) + slack(y) <= 0 with
slack(x) = (1 + t)|x ^ b| - (1 - t)|x|, are linked by the triangle inequality; one star around the set
with the least slack has the same groups as all those links. Linked pairs that are not near share
an element of x ^ b and of y ^ b and meet in that element's region, in windows as above; regions inside
the star need no comparison. Every level takes an element from each set, so the recursion ends.

Equal sets are one class from the start and are never expanded to pairs. What tasks hold is a slice of
texts, a leaf, or a table of bounded size (the list of frequent elements, a bit table of classes).
Elements and classes are 64-bit hashes of words and sets.

Defined cases: null text or text without words has the empty set, which links with nothing; a
text of fewer words than an n-gram has one element, the whole sequence; rows may repeat; a null id
never is a group's smallest; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinegrade.llm.common import Memo, bitmap, hinted, in_bitmap, keep_only, slices, utf8, written
from cinegrade.llm.components import components

LEAF, LEAF_ELEMENTS = 1024, 4_000_000
REGION = 128
HOT_LOCAL, HOT, HOT_LIST = 4, 32, 1 << 20
_CHUNK_ELEMENTS = 2_000_000
_SKETCH = 8  # words of 64 bits
_FIRST = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xBF58476D1CE4E5B9)


@lru_cache(maxsize=1)
def _word_hashes() -> Memo:
    return Memo(lambda word: xxhash.xxh64_intdigest(word))


def shingle_set(text: bytes, words_each: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of a text; A-Z count as a-z."""
    words = text.lower().split()  # ASCII letters only; ASCII white space only
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(_word_hashes().__getitem__, words), np.uint64, len(words))
    width = min(words_each, len(words))
    out = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = (out ^ hashes[k : k + len(out)]) * _FIRST
        out ^= out >> np.uint64(29)
        out *= _SECOND
        out ^= out >> np.uint64(32)
    return np.unique(out)


def _signature(elements: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(elements.tobytes()) - (1 << 63)


def _sketch(elements: np.ndarray, bits: int = 64 * _SKETCH) -> np.ndarray:
    """For each of `bits` buckets (a power of two) whether it holds an odd number of elements."""
    odd = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _fine_sketch(elements: np.ndarray) -> bytes | None:
    """A sketch of as many bits as there are elements, or more; none for sets that the common one serves."""
    return _sketch(elements, 1 << (len(elements) - 1).bit_length()).tobytes() if len(elements) > 64 * _SKETCH else None


def _sketch_distance(a: bytes, b: bytes) -> int:
    """Buckets in which two fine sketches differ; the longer one is folded to the length of the other."""
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    if len(x) > len(y):
        x, y = y, x
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def _close_in_detail(batches: Iterator[pa.RecordBatch], t: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """(u, v) of the pairs whose fine sketches are near enough."""
    for part in slices(batches, 256):
        columns = [part.column(c).to_pylist() for c in ("sketch_u", "sketch_v", "total")]
        keep = pa.array([(t[0] + t[1]) * _sketch_distance(a, b) <= (t[1] - t[0]) * n for a, b, n in zip(*columns)], pa.bool_())
        yield pa.RecordBatch.from_arrays([part.column("u").filter(keep), part.column("v").filter(keep)], names=["u", "v"])


def _signed(elements: np.ndarray) -> np.ndarray:
    return elements.view(np.int64)


_SUMMARY = "doc_id bigint, n bigint, sig bigint, " + ", ".join(f"b{k} bigint" for k in range(_SKETCH)) + ", sketch binary, element bigint, times bigint"


def _summaries(batches: Iterator[pa.RecordBatch], words_each: int) -> Iterator[pa.RecordBatch]:
    """One row for each document, and (element, times) rows for elements frequent among some documents of the task."""
    keep_only(_word_hashes())
    names = [f.split()[0] for f in _SUMMARY.split(", ")]
    seen: set[int] = set()
    held: list[np.ndarray] = []
    size = 0

    def frequent() -> pa.RecordBatch:
        elements, times = np.unique(np.concatenate(held), return_counts=True)
        elements, times = elements[times >= HOT_LOCAL], times[times >= HOT_LOCAL]
        empty = [*[pa.nulls(len(elements), pa.int64())] * (3 + _SKETCH), pa.nulls(len(elements), pa.binary())]
        return pa.RecordBatch.from_arrays([*empty, pa.array(_signed(elements)), pa.array(times)], names=names)

    for part in slices(batches):
        sets = [shingle_set(t, words_each) for t in utf8(part.column("text"))]
        sigs = [_signature(s) if len(s) else None for s in sets]
        sketches = np.stack([_sketch(s) for s in sets])
        none = pa.nulls(len(sets), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.int64()), *(pa.array(c) for c in sketches.T),
             pa.array([_fine_sketch(s) for s in sets], pa.binary()), none, none], names=names)
        for s, sig in zip(sets, sigs):
            if sig is not None and sig not in seen:
                seen.add(sig)
                held.append(s)
                size += len(s)
        if size > _CHUNK_ELEMENTS:
            yield frequent()
            seen, held, size = set(), [], 0
    if held:
        yield frequent()


def _hot_elements(counts: DataFrame) -> np.ndarray:
    """Sorted elements of HOT documents or more, the most frequent ones if they are more than HOT_LIST.

    Any list gives the same links; it only moves elements to the end of the order.
    """
    total = counts.groupBy("element").agg(F.sum("times").alias("times")).where(F.col("times") >= HOT)
    total = written(total.withColumn("step", F.floor(F.log2("times") * 8)), "frequent")
    least, held = 0, 0
    for r in sorted(total.groupBy("step").count().collect(), key=lambda r: -r["step"]):  # some hundred steps at most
        held += r["count"]
        if held > HOT_LIST:
            least = r["step"] + 1
            break
    found = total.where(F.col("step") >= least).select("element").toPandas()["element"]
    return np.sort(found.to_numpy(dtype=np.int64).view(np.uint64))


def _in_sorted(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    if not len(held):
        return np.zeros(len(values), dtype=bool)
    return held[np.minimum(np.searchsorted(held, values), len(held) - 1)] == values


def _regions(batches: Iterator[pa.RecordBatch], words_each: int, missing: tuple[int, int], hot: Broadcast) -> Iterator[pa.RecordBatch]:
    """(element, sig, n, rank, hot) for the elements in each set's window; copies inside a task once.

    missing: numerator and denominator of the share of a set that a linked set may lack.
    """
    keep_only(_word_hashes())
    seen: set[int] = set()
    for part in slices(batches):
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for text in utf8(part.column("text")):
            elements = shingle_set(text, words_each)
            n = len(elements)
            if not n:
                continue
            sig = _signature(elements)
            if sig in seen:
                continue
            if len(seen) < 1_000_000:
                seen.add(sig)
            late = _in_sorted(elements, hot.value)
            window = np.concatenate([elements[~late], elements[late]])[: n * missing[0] // missing[1] + 1]
            rank = np.arange(len(window))
            for column, values in zip(out, (_signed(window), np.full(len(window), sig), np.full(len(window), n), rank, rank >= n - late.sum())):
                column.append(values)
        if out[0]:
            columns = [np.concatenate(c) for c in out]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2].astype(np.int32)), pa.array(columns[3].astype(np.int32)), pa.array(columns[4])],
                names=["element", "sig", "n", "rank", "hot"])


def _sets(batches: Iterator[pa.RecordBatch], words_each: int, wanted: Broadcast) -> Iterator[pa.RecordBatch]:
    """doc_id, sig and elements of documents whose class is, or seems to be, in the bit table."""
    keep_only(_word_hashes())
    for part in slices(batches):
        ids, sigs, out = [], [], []
        for doc_id, text in zip(part.column("doc_id").to_pylist(), utf8(part.column("text"))):
            elements = shingle_set(text, words_each)
            if len(elements):
                sig = _signature(elements)
                if in_bitmap(wanted.value, np.array([sig], dtype=np.int64))[0]:
                    ids.append(doc_id)
                    sigs.append(sig)
                    out.append(_signed(elements))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sigs, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "sig", "elements"])


def _numbered(elements: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in place of elements, the same for equal ones, in half of their memory."""
    order = np.argsort(elements)
    step = np.empty(len(order), dtype=np.int32)
    step[0] = 0
    step[1:] = elements[order[1:]] != elements[order[:-1]]
    out = np.empty(len(order), dtype=np.int32)
    out[order] = np.cumsum(step, out=step)
    return out


def links_within(sizes: np.ndarray, moved: list[np.ndarray], t: tuple[int, int]) -> list[tuple[int, int]]:
    """Positions of linked pairs that join the groups of the sets: at most one fewer than sets.

    sizes: |x|; moved: x ^ b for any one set b.
    """
    order = np.argsort(sizes, kind="stable")
    sizes, moved = sizes[order], [moved[i] for i in order]
    lengths = np.array([len(m) for m in moved])
    ends = np.concatenate([[0], np.cumsum(lengths)])
    numbers = _numbered(np.concatenate(moved)) if ends[-1] else np.empty(0, dtype=np.int32)
    parent = list(range(len(sizes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    flags = np.zeros(int(numbers.max()) + 1 if len(numbers) else 1, dtype=np.int32)
    for i in range(len(sizes) - 1):
        last = int(np.searchsorted(sizes, sizes[i] * t[1] // t[0], side="right"))
        if last <= i + 1:
            continue
        own = numbers[ends[i] : ends[i + 1]]
        flags[own] = 1
        running = np.concatenate([[0], np.cumsum(flags[numbers[ends[i + 1] : ends[last]]], dtype=np.int32)])
        flags[own] = 0
        cuts = ends[i + 1 : last + 1] - ends[i + 1]
        shared = running[cuts[1:]] - running[cuts[:-1]]
        apart = lengths[i] + lengths[i + 1 : last] - 2 * shared
        for j in np.flatnonzero((t[0] + t[1]) * apart <= (t[1] - t[0]) * (sizes[i] + sizes[i + 1 : last])) + i + 1:
            a, b = root(i), root(int(j))
            if a != b:
                parent[a] = b
                out.append((int(order[i]), int(order[j])))
    return out


def _leaf_links(batches: Iterator[pa.RecordBatch], t: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Links inside each group; a group's rows (group, sig, n, elements) follow one another."""
    keep_only()
    group, held = None, []

    def links() -> pa.RecordBatch:
        sigs = [h[0] for h in held]
        found = links_within(np.array([h[1] for h in held], dtype=np.int64), [h[2] for h in held], t)
        return pa.RecordBatch.from_arrays([pa.array([sigs[a] for a, _ in found], pa.int64()), pa.array([sigs[b] for _, b in found], pa.int64())], names=["u", "v"])

    for part in slices(batches, 256):
        values, offsets = part.column("elements").values.to_numpy(), part.column("elements").offsets.to_numpy()
        for i, (g, sig, n) in enumerate(zip(*(part.column(c).to_pylist() for c in ("group", "sig", "n")))):
            if g != group:
                if len(held) > 1:
                    yield links()
                group, held = g, []
            held.append((sig, n, values[offsets[i] : offsets[i + 1]].copy()))
    if len(held) > 1:
        yield links()


def _region_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, sig, n, sketch): at least as many bits as there are elements, and as the common sketch has."""
    for part in slices(batches, 256):
        values, offsets = part.column("elements").values.to_numpy(), part.column("elements").offsets.to_numpy()
        each = (values[a:b].view(np.uint64) for a, b in zip(offsets[:-1], offsets[1:]))
        sketches = [_fine_sketch(e) or _sketch(e).tobytes() for e in each]
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("group", "sig", "n")), pa.array(sketches, pa.binary())], names=["group", "sig", "n", "sketch"])


def _near_in_region(sizes: np.ndarray, starred: np.ndarray, sketches: list[bytes], t: tuple[int, int]) -> np.ndarray:
    """Whether each set may be linked with another one of the region, unless the star links both."""
    common = np.stack([np.bitwise_xor.reduce(np.frombuffer(s, dtype=np.uint64).reshape(-1, _SKETCH), axis=0) for s in sketches])
    kept = np.zeros(len(sizes), dtype=bool)
    for i in range(len(sizes) - 1):
        total = sizes[i] + sizes[i + 1 :]
        apart = np.bitwise_count(common[i] ^ common[i + 1 :]).sum(axis=1, dtype=np.int64)
        near = ((t[0] + t[1]) * apart <= (t[1] - t[0]) * total) & ~(starred[i] & starred[i + 1 :])
        for j in np.flatnonzero(near) + i + 1:
            if not (kept[i] and kept[j]) and (t[0] + t[1]) * _sketch_distance(sketches[i], sketches[j]) <= (t[1] - t[0]) * (sizes[i] + sizes[j]):
                kept[i] = kept[j] = True
    return kept


def _near_rows(batches: Iterator[pa.RecordBatch], t: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """(region, group, sig) of the sets that may be linked inside the region, whose rows follow one another; all of a region over LEAF.

    A region is named after the sets that are left of it: near copies share most of their windows, and those regions are one.
    """
    region, held, passing = None, [], False

    def rows(kept: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([h[k] for h in kept], pa.int64()) for k in range(3)], names=["region", "group", "sig"])

    def near() -> list[tuple]:
        if len(held) < 2 or passing:
            return held if passing else []
        kept = _near_in_region(np.array([h[3] for h in held], dtype=np.int64), np.array([h[4] for h in held], dtype=bool), [h[5] for h in held], t)
        found = sorted((h for h, k in zip(held, kept) if k), key=lambda h: h[2])
        name = xxhash.xxh64_intdigest(np.array([found[0][1], *(h[2] for h in found)], dtype=np.int64).tobytes()) - (1 << 63) if found else 0
        return [(name, h[1], h[2]) for h in found]

    for part in slices(batches):
        for row in zip(*(part.column(c).to_pylist() for c in ("region", "group", "sig", "n", "starred", "sketch"))):
            if row[0] != region:
                yield rows(near())
                region, held, passing = row[0], [], False
            held.append(row)
            if len(held) > LEAF:
                yield rows(held)
                held, passing = [], True
    yield rows(near())


def _joined_leaves(members: DataFrame, t: tuple[int, int]) -> DataFrame:
    ordered = members.select("group", "sig", "n", "elements").repartition("group").sortWithinPartitions("group")
    return ordered.mapInArrow(lambda b: _leaf_links(b, t), "u bigint, v bigint")


def _once(members: DataFrame) -> DataFrame:
    """One row for each (group, sig): rows repeat with their id and text, and copies may all be without an id."""
    key = ["group", "sig"]
    repeats = written(members.groupBy(key).agg(F.count("*").alias("times")).where("times > 1").select(key), "repeats")
    if repeats.isEmpty():
        return members
    repeats = hinted(repeats, 64)
    once = members.join(repeats, key).dropDuplicates(key).unionByName(members.join(repeats, key, "left_anti"))
    return written(once.select(members.columns), "once")


def _split(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of groups that fit in a leaf, and of those that don't."""
    sizes = members.groupBy("group").agg(F.count("*").alias("size"), F.sum(F.size("elements")).alias("total"))
    large = hinted(written(sizes.where((F.col("size") > 8) & ((F.col("size") > LEAF) | (F.col("total") > LEAF_ELEMENTS))), "large"), 64)
    return members.join(large.select("group"), "group", "left_anti"), members.join(large.select("group", "size"), "group")


def _recursed(members: DataFrame, t: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Star links of large groups around their consensus, and the members of the regions below them.

    members: (group, sig, n, elements, size).
    """
    near, far = t[1] + t[0], t[1] - t[0]
    counts = members.select("group", "size", F.explode("elements").alias("e")).groupBy("group", "size", "e").agg(F.count("*").alias("times"))
    consensus = counts.where("2 * times > size").groupBy("group").agg(F.collect_list("e").alias("pivot"))  # at most twice a mean set
    pivot = F.coalesce("pivot", F.expr("array()").cast("array<bigint>"))
    moved = members.join(consensus, "group", "left").select(
        "group", "sig", "n", F.concat(F.array_except("elements", pivot), F.array_except(pivot, F.col("elements"))).alias("elements"))
    moved = written(moved.withColumn("slack", near * F.size("elements") - far * F.col("n")), "moved")
    centre = moved.groupBy("group").agg(F.min(F.struct("slack", "sig")).alias("centre"))
    placed = moved.join(centre, "group").withColumn("starred", F.col("slack") + F.col("centre.slack") <= 0)
    star = placed.where("starred AND sig <> centre.sig").select(F.col("sig").alias("u"), F.col("centre.sig").alias("v"))
    each = placed.select("group", "sig", "n", "starred", F.explode("elements").alias("e"))
    times = each.groupBy("group", "e").agg(F.count("*").alias("times"))
    ranked = each.join(times, ["group", "e"]).withColumn(
        "rank", F.row_number().over(Window.partitionBy("group", "sig").orderBy("times", "e")))
    window = ranked.where(F.col("rank") <= F.floor(far * F.col("n") / t[0]) + 1)
    window = written(window.select("group", "sig", "e", "starred"), "windows")
    shared = window.groupBy("group", "e").agg(F.count("*").alias("size"), F.bool_and("starred").alias("known"))
    shared = shared.where("size > 1 AND NOT known").select("group", "e")
    sketches = moved.select("group", "sig", "n", "elements").mapInArrow(_region_sketches, "group bigint, sig bigint, n bigint, sketch binary")
    met = window.join(shared, ["group", "e"]).join(sketches, ["group", "sig"]).withColumn("region", F.xxhash64("group", "e"))
    met = met.select("region", "group", "sig", "n", "starred", "sketch").repartition("region").sortWithinPartitions("region")
    near_rows = met.mapInArrow(lambda b: _near_rows(b, t), "region bigint, group bigint, sig bigint").distinct()
    below = near_rows.join(moved, ["group", "sig"]).select(F.col("region").alias("group"), "sig", "n", "elements")
    return star, written(below, "below")


def _shared_regions(regions: DataFrame) -> DataFrame:
    """The rows whose element another class has too, or may have: most windows hold elements that are in one set only.

    One pass sorts the rows by element; a hot element, which could be one task's work, passes as it is.
    """
    same = Window.partitionBy("element")
    met = regions.where("NOT hot").withColumns({"low": F.min("sig").over(same), "high": F.max("sig").over(same)}).where("low < high")
    columns = ["element", "sig", "n", "rank"]
    return met.select(columns).unionByName(regions.where("hot").select(columns))


def _forest(n: np.ndarray, rank: np.ndarray, common: np.ndarray, fine: list[bytes | None], t: tuple[int, int]) -> list[tuple[int, int]]:
    """Positions of pairs of a region that may be linked, as many as it takes to hold all such pairs together."""
    order = np.argsort(n, kind="stable")
    n, rank, common = n[order], rank[order], common[order]
    label, out = np.arange(len(n)), []
    for i in range(len(n) - 1):
        last = int(np.searchsorted(n, n[i] * t[1] // t[0], side="right"))
        total, at = n[i] + n[i + 1 : last], slice(i + 1, last)
        left = (t[0] + t[1]) * np.minimum(n[i] - rank[i], n[at] - rank[at]) >= t[0] * total
        left &= label[at] != label[i]
        js = np.flatnonzero(left)
        apart = np.bitwise_count(common[i] ^ common[at][js]).sum(axis=1, dtype=np.int64)
        for j in js[(t[0] + t[1]) * apart <= (t[1] - t[0]) * total[js]] + i + 1:
            if label[i] == label[j]:
                continue
            a, b = fine[order[i]], fine[order[j]]
            if a is None or b is None or (t[0] + t[1]) * _sketch_distance(a, b) <= (t[1] - t[0]) * (n[i] + n[j]):
                label[label == label[j]] = label[i]
                out.append((int(order[i]), int(order[j])))
    return out


def _region_links(batches: Iterator[pa.RecordBatch], t: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """(u, v) of the forest of each region; a region's rows, LEAF at most, follow one another."""
    element, held = None, []

    def links() -> pa.RecordBatch:
        n, rank = (np.array([h[k] for h in held], dtype=np.int64) for k in (2, 3))
        common = np.array([h[5:] for h in held], dtype=np.int64).view(np.uint64)
        found = _forest(n, rank, common, [h[4] for h in held], t)
        return pa.RecordBatch.from_arrays([pa.array([held[pair[k]][1] for pair in found], pa.int64()) for k in range(2)], names=["u", "v"])

    for part in slices(batches):
        for row in zip(*(part.column(c).to_pylist() for c in ("element", "sig", "n", "rank", "sketch", *(f"b{k}" for k in range(_SKETCH))))):
            if row[0] != element:
                if held:
                    yield links()
                element, held = row[0], []
            held.append(row)
    if held:
        yield links()


def _candidate_edges(regions: DataFrame, classes: DataFrame, t: tuple[int, int]) -> DataFrame:
    """Pairs of classes that may be linked, forests of regions over REGION, and stars of those over LEAF."""
    sizes = regions.groupBy("element").agg(F.count("*").alias("size"), F.min("sig").alias("least")).where("size > 1")
    large = hinted(written(sizes.where(F.col("size") > REGION).select("element", "least", "size"), "hot-regions"), 64)
    huge = large.where(F.col("size") > LEAF).select("element", "least")
    stars = regions.join(huge, "element").where("sig <> least").select(F.col("sig").alias("u"), F.col("least").alias("v"))
    wide = regions.join(large.where(F.col("size") <= LEAF).select("element"), "element").select("element", "sig", "n", "rank")
    wide = hinted(written(wide, "wide-regions"), 48)
    wide = wide.join(classes.select("sig", "sketch", *(f"b{k}" for k in range(_SKETCH))), "sig").repartition("element").sortWithinPartitions("element")
    forests = wide.mapInArrow(lambda b: _region_links(b, t), "u bigint, v bigint")
    small = regions.join(large.select("element"), "element", "left_anti")
    a, b = small.alias("a"), small.alias("b")
    fits = F.expr(f"a.element = b.element AND a.sig < b.sig AND {t[0]}L * greatest(a.n, b.n) <= {t[1]}L * least(a.n, b.n)"
                  f" AND {t[0] + t[1]}L * least(a.n - a.rank, b.n - b.rank) >= {t[0]}L * (a.n + b.n)")
    pairs = a.join(b, fits).select(F.col("a.sig").alias("u"), F.col("b.sig").alias("v")).distinct()

    def sketch(end: str) -> DataFrame:
        return classes.select(F.col("sig").alias(end), F.col("n").alias(f"n{end}"), *(F.col(f"b{k}").alias(f"{end}{k}") for k in range(_SKETCH)))

    apart = " + ".join(f"bit_count(u{k} ^ v{k})" for k in range(_SKETCH))
    close = pairs.join(sketch("u"), "u").join(sketch("v"), "v").where(f"{t[0] + t[1]}L * ({apart}) <= {t[1] - t[0]}L * (nu + nv)")
    close = written(close.select("u", "v", (F.col("nu") + F.col("nv")).alias("total"), F.least("nu", "nv").alias("least")), "close")
    fine = classes.where("sketch IS NOT NULL")
    detailed = close.where(F.col("least") > 64 * _SKETCH)
    for end in ("u", "v"):
        detailed = detailed.join(fine.select(F.col("sig").alias(end), F.col("sketch").alias(f"sketch_{end}")), end)
    detailed = detailed.mapInArrow(lambda b: _close_in_detail(b, t), "u bigint, v bigint")
    return close.where(F.col("least") <= 64 * _SKETCH).select("u", "v").unionByName(detailed).unionByName(forests).unionByName(stars)


def jaccard_groups(docs: DataFrame, words_each: int = 5, at_least: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id that links reach) of each row.

    at_least: the similarity of a link as numerator and denominator.
    """
    spark = docs.sparkSession
    t = at_least
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    summary = written(rows.mapInArrow(lambda b: _summaries(b, words_each), _SUMMARY), "summaries")
    own = summary.where("times IS NULL")
    hot = spark.sparkContext.broadcast(_hot_elements(summary.where("times IS NOT NULL")))
    classes = own.where("sig IS NOT NULL").groupBy("sig").agg(
        F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), *(F.min(f"b{k}").alias(f"b{k}") for k in range(_SKETCH)), F.max("sketch").alias("sketch"))
    missing = (t[1] - t[0], t[1])
    regions = rows.mapInArrow(lambda b: _regions(b, words_each, missing, hot), "element bigint, sig bigint, n int, rank int, hot boolean")
    regions = written(_shared_regions(written(regions, "regions")), "shared-regions")
    classes = written(classes, "classes")
    groups = components(_candidate_edges(regions, classes, t))
    groups = written(groups.join(classes.select(F.col("sig").alias("node"), "doc_id", "n"), "node"), "groups")
    n_groups = groups.count()
    bits = 1 << min(max(int(n_groups * 128).bit_length(), 16), 27)  # 16 MB at most
    wanted = spark.sparkContext.broadcast(bitmap(groups, "node", bits))
    found = rows.mapInArrow(lambda b: _sets(b, words_each, wanted), "doc_id bigint, sig bigint, elements array<bigint>")
    g = groups.select(F.col("root").alias("group"), F.col("node").alias("sig"), "n", F.col("doc_id").alias("of"))
    members = found.join(hinted(g, 64), "sig").where("doc_id <=> of").select("group", "sig", "n", "elements")
    leaves, large = _split(_once(written(members, "members")))
    links = written(_joined_leaves(leaves, t), "links")
    while not large.isEmpty():
        star, below = _recursed(large, t)
        leaves, large = _split(below)
        links = links.unionByName(written(star.unionByName(_joined_leaves(leaves, t)), "links"))
    linked = components(links)
    placed = classes.select("sig", "doc_id").join(linked, F.col("sig") == F.col("node"), "left").select("sig", "doc_id", F.coalesce("root", "sig").alias("root"))
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = placed.join(least, "root").select("sig", "component_id")
    empty = own.where("sig IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return own.where("sig IS NOT NULL").join(named, "sig").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(empty)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """docs with one document of each group, the one with the smallest id; all columns."""
    gone = written(jaccard_groups(docs, id_col=id_col, **how).where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct(), "near-copies")
    whole = docs.select(F.struct("*").alias("whole"), F.col(id_col).alias("key"))
    return whole.join(hinted(gone, 24), F.col("key") == F.col("gone"), "left_anti").select("whole.*")
