"""Exact search for close vectors in a tree of pivots that grows with the table.

A node of the tree holds the vectors at home in it and visitors that may be close to one of them. A node
with more than `leaf` of its own takes ARMS pivots far from each other out of CANDIDATES of them. Each vector goes home to its nearest pivot's
child. For each child and each pivot the node keeps the range of angles at which that child's own
vectors see the pivot; since angles obey the triangle inequality, a vector can have a partner within
theta in a child only if it sees every pivot within theta of the child's range. It visits those
children and no others. So each pair of vectors within theta meets in the home leaf of either.

A node is split only where that saves comparisons; where geometry lets the ranges overlap, as for large theta, it
stays a leaf, and its pairs are compared in blocks of bounded size. Work in tasks is on blocks of
2 x BLOCK_MOST vectors at most, however many a leaf holds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cinegrade.session import scratch_path
from cinegrade.sources.writers import save

ARMS = 32
CANDIDATES = 128
LEAF = 32
DEPTH = 12  # the path of a node is a number to the base ARMS
SAVES = 0.8
BLOCK_HOME, BLOCK_ALL = 1024, 4096  # vectors that are compared at a time
BLOCK_MOST = 32_768  # vectors of a leaf's chunk
BLOCKS = 256  # at least so many, if there is work for them
SLACK = 1e-6  # on angles; keeps rounding from losing a pair


def theta_of(max_distance: float) -> float:
    """Angle of a cosine distance."""
    return math.acos(min(1.0, max(-1.0, 1.0 - max_distance))) + SLACK


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for vector in batch.column("vec").to_pylist():
            v = np.array(vector if vector is not None and None not in vector else [], dtype="<f8")
            norm = np.linalg.norm(v)
            rows.append((v / norm).tobytes() if len(v) and np.isfinite(norm) and norm > 0 else None)
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(rows, pa.binary())], names=["key", "u"])


def packed_units(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, u): vectors of length one as little-endian doubles. Null, empty and zero vectors have no direction and are left out."""
    rows = vectors.select(F.col(key).alias("key"), F.col(vec).cast("array<double>").alias("vec"))
    return rows.mapInArrow(_packed, f"key {rows.schema['key'].dataType.simpleString()}, u binary").where("u IS NOT NULL")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors as rows, read where Arrow holds them."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    first, end = np.frombuffer(column.buffers()[1], "<i4")[[column.offset, column.offset + len(column)]]
    return np.frombuffer(column.buffers()[2][first:end], "<f8").reshape(len(column), -1)


def _angled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Angles of each vector to the pivots of its node."""
    for batch in batches:
        u, pivots = _matrix(batch.column("u")), _matrix(batch.column("pivots"))
        cosines = np.einsum("nd,nkd->nk", u, pivots.reshape(len(u), -1, u.shape[1])) if len(u) else np.zeros((0, ARMS))
        angles = np.arccos(np.clip(cosines, -1.0, 1.0))
        keep = batch.select(["key", "u", "node", "home"])
        lists = pa.FixedSizeListArray.from_arrays(pa.array(angles.ravel()), ARMS).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*keep.columns, lists], names=[*keep.schema.names, "angles"])


def _spread(candidates: pa.Table, leaf: int) -> pa.Table:
    """Pivots of a node: each one is the candidate farthest from those before it.

    Three times as many as leaves its own vectors fill, up to ARMS; the first one again in the places that are left.
    """
    candidates = candidates.sort_by("rank")
    u = _matrix(candidates.column("u"))
    chosen, nearest = [0], u @ u[0]
    while len(chosen) < min(ARMS, 3 * -(-candidates.column("own")[0].as_py() // leaf)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, u @ u[chosen[-1]])
    chosen += [0] * (ARMS - len(chosen))
    return pa.table({"node": candidates.column("node")[:1], "pivots": pa.array([u[chosen].tobytes()], pa.binary())})


def _sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("node").agg(F.sum(F.col("home").cast("long")).alias("own"), F.count("*").alias("all"))


def _split(rows: DataFrame, sizes: DataFrame, theta: float, leaf: int) -> DataFrame:
    """Rows of the children (columns parent, key, u, node, home) of every node among rows."""
    kind = rows.schema["key"].dataType.simpleString()
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("key"), "key"))
    candidates = rows.where("home").select("node", "u", rank.alias("rank")).where(F.col("rank") <= CANDIDATES)
    candidates = candidates.join(sizes.select("node", "own"), "node")
    pivots = candidates.groupBy("node").applyInArrow(lambda c: _spread(c, leaf), "node bigint, pivots binary")
    angled = rows.join(pivots, "node").mapInArrow(_angled, f"key {kind}, u binary, node bigint, home boolean, angles array<double>")
    angled = angled.withColumn("arm", F.array_position("angles", F.array_min("angles")).cast("int") - 1)
    angled = save(angled, scratch_path(rows.sparkSession, "angles"))
    see = lambda how: F.array(*[how(F.get("angles", k)) for k in range(ARMS)])
    ranges = angled.where("home").groupBy("node", "arm").agg(see(F.min).alias("low"), see(F.max).alias("high"))
    ranges = ranges.groupBy("node").agg(F.collect_list(F.struct("arm", "low", "high")).alias("ranges"))  # ARMS at most
    holds = lambda flags: F.forall(flags, lambda x: x)
    near = lambda r: (
        holds(F.zip_with("angles", r["low"], lambda a, low: a >= low - theta))
        & holds(F.zip_with("angles", r["high"], lambda a, high: a <= high + theta)))
    arms = F.transform(F.filter("ranges", near), lambda r: r["arm"])
    children = angled.join(ranges, "node").select(
        F.col("node").alias("parent"), "key", "u", "home", F.col("arm").alias("own"), F.explode(arms).alias("arm"))
    return children.select(
        "parent", "key", "u", (F.col("parent") * ARMS + F.col("arm") + 1).alias("node"), (F.col("home") & (F.col("own") == F.col("arm"))).alias("home"))


def tree(units: DataFrame, theta: float, leaf: int = LEAF) -> DataFrame:
    """(key, u, node, home): every vector in its home leaf, and in the leaves that it has to visit."""
    spark = units.sparkSession
    open_rows = save(units.select("key", "u", F.lit(0).cast("long").alias("node"), F.lit(True).alias("home")), scratch_path(spark, "node"))
    done: list[DataFrame] = []
    for _ in range(DEPTH):
        sizes = _sizes(open_rows)
        large = sizes.where(F.col("own") > leaf)
        done.append(open_rows.join(large, "node", "left_anti").select("key", "u", "node", "home"))
        open_rows = open_rows.join(large.select("node"), "node", "left_semi")
        if open_rows.isEmpty():
            return _leaves(done)
        below = save(_split(open_rows, large, theta, leaf), scratch_path(spark, "node"))
        after = below.groupBy("parent", "node").agg(F.sum(F.col("home").cast("long")).alias("own"), F.count("*").alias("all"))
        after = after.groupBy("parent").agg(F.sum(F.col("own") * F.col("all")).alias("after")).withColumnRenamed("parent", "node")
        saves = large.join(after, "node").where(F.col("after") <= SAVES * F.col("own") * F.col("all")).select("node")
        done.append(open_rows.join(saves, "node", "left_anti").select("key", "u", "node", "home"))
        open_rows = below.join(saves.withColumnRenamed("node", "parent"), "parent", "left_semi").select("key", "u", "node", "home")
        open_rows = save(open_rows, scratch_path(spark, "node"))
    return _leaves([*done, open_rows.select("key", "u", "node", "home")])


def _leaves(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    own = whole.where("home").select("node").distinct()  # visitors alone have nobody to meet
    return save(whole.join(own, "node", "left_semi"), scratch_path(whole.sparkSession, "leaves"))


def comparisons(leaves: DataFrame) -> int:
    """Pairs that are compared: of each leaf, its own vectors with all in it."""
    return _sizes(leaves).agg(F.coalesce(F.sum(F.col("own") * F.col("all")), F.lit(0))).first()[0]


def in_chunks(leaves: DataFrame) -> DataFrame:
    """(node, key, u, whole, own, i, j): the vectors of each block (node, i, j), its leaf's own and those they are compared with.

    A leaf is dealt to chunks, and a block is two of them. The chunks grow with the work, up to BLOCK_MOST vectors, so a
    vector travels to some ten blocks and not to one for every thousand vectors. In a leaf without visitors (`whole`)
    two chunks meet once, and a chunk meets itself as one copy.
    """
    sizes = save(_sizes(leaves), scratch_path(leaves.sparkSession, "sizes"))
    work = sizes.agg(F.coalesce(F.sum(F.col("own") * F.col("all")), F.lit(0))).first()[0]
    side = min(BLOCK_MOST, max(BLOCK_HOME, math.isqrt(work // BLOCKS)))
    chunks = lambda n: F.ceil(F.col(n) / side).cast("int")
    whole = F.col("own") == F.col("all")
    sized = leaves.join(sizes.select("node", whole.alias("whole"), chunks("own").alias("homes"), chunks("all").alias("alls")), "node")
    dealt = lambda n: F.pmod(F.xxhash64("key", F.lit(9)), F.col(n)).cast("int")
    to = lambda first, last: F.explode(F.sequence(first, last))
    columns = ["node", "key", "u", "whole"]
    mine = sized.where("home").withColumn("i", dealt("homes"))
    own = mine.select(*columns, F.lit(True).alias("own"), "i", to(F.when(F.col("whole"), F.col("i")).otherwise(0), F.col("alls") - 1).alias("j"))
    other = sized.withColumn("j", dealt("alls")).where("NOT whole OR j > 0")
    every = other.select(*columns, F.lit(False).alias("own"), to(F.lit(0), F.when(F.col("whole"), F.col("j")).otherwise(F.col("homes")) - 1).alias("i"), "j")
    return own.unionByName(every)


def in_blocks(leaves: DataFrame, compare: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool], list[np.ndarray]], names: list[str]) -> DataFrame:
    """What `compare` gives of (keys, units) of all in a leaf against (keys, units) of its own, BLOCK_HOME x BLOCK_ALL at a time.

    compare returns an array of keys a, one of keys b, and doubles for further names. Its last argument tells that
    its vectors meet nowhere else, so that pairs in either order count.
    """
    key_type = leaves.schema["key"].dataType
    arrow_key = to_arrow_type(key_type)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        mine, both = rows.column("own").to_numpy(), rows.column("whole")[0].as_py()
        keys, units = np.array(rows.column("key").to_pylist(), dtype=object if pa.types.is_string(arrow_key) else None), _matrix(rows.column("u"))
        own_keys, own = keys[mine], units[mine]
        alone = both and rows.column("i")[0].as_py() == rows.column("j")[0].as_py()
        if not alone:
            keys, units = keys[~mine], units[~mine]
        for h in range(0, len(own_keys), BLOCK_HOME):
            for k in range(0, len(keys), BLOCK_ALL):
                found = compare(keys[k : k + BLOCK_ALL], units[k : k + BLOCK_ALL], own_keys[h : h + BLOCK_HOME], own[h : h + BLOCK_HOME], both and not alone)
                arrays = [pa.array(found[0], arrow_key), pa.array(found[1], arrow_key), *(pa.array(x, pa.float64()) for x in found[2:])]
                if len(arrays[0]):
                    yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = key_type.simpleString()
    schema = ", ".join([f"{names[0]} {kind}", f"{names[1]} {kind}", *(f"{n} double" for n in names[2:])])
    return in_chunks(leaves).groupBy("node", "i", "j").applyInArrow(block, schema)


def pairs_within(max_distance: float) -> Callable:
    """Each close pair a < b with its distance, in the block of b's home."""

    def compare(keys: np.ndarray, units: np.ndarray, own_keys: np.ndarray, own: np.ndarray, both: bool = False) -> list[np.ndarray]:
        i, j, distance = _close(units, own, max_distance)
        a, b = keys[i], own_keys[j]
        if both:
            swap = a > b
            a, b = np.where(swap, b, a), np.where(swap, a, b)
        kept = a < b
        return [a[kept], b[kept], distance[kept]]

    return compare


def _close(units: np.ndarray, own: np.ndarray, max_distance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (i, j) and distances of what is close; only those near the limit are looked at twice."""
    if not len(units) or not len(own):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    cosines = (units @ own.T).ravel()
    near = np.flatnonzero(cosines >= 1 - max_distance - 1e-9)
    distance = 1 - cosines[near]
    near, distance = near[distance <= max_distance], distance[distance <= max_distance]
    return near // len(own), near % len(own), distance


def links_within(max_distance: float) -> Callable:
    """Links that connect what the close pairs of a block connect, one for each vector at most: stars of its components."""

    def compare(keys: np.ndarray, units: np.ndarray, own_keys: np.ndarray, own: np.ndarray, both: bool = False) -> list[np.ndarray]:
        i, j, _ = _close(units, own, max_distance)
        label = np.arange(len(own_keys))
        seen = np.full(len(keys), len(own_keys))
        while len(i):  # labels of the own vectors fall to the least of what they are connected with
            np.minimum.at(seen, i, label[j])
            lower = label.copy()
            np.minimum.at(lower, j, seen[i])
            if (lower == label).all():
                break
            label = lower
        there = seen < len(own_keys)
        moved = label < np.arange(len(label))
        return [np.concatenate([keys[there], own_keys[moved]]), np.concatenate([own_keys[seen[there]], own_keys[label[moved]]])]

    return compare


def rows_schema(units: DataFrame) -> str:
    return f"key {units.schema['key'].dataType.simpleString()}, u binary"


def signed_bands(batches: Iterator[pa.RecordBatch], bits: int, bands: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Each vector once for every band, at home in the bucket of its signs on the band's hyperplanes."""
    planes = None
    for batch in batches:
        if not batch.num_rows:
            continue
        u = _matrix(batch.column("u"))
        if planes is None:
            planes = np.random.default_rng(seed).normal(size=(u.shape[1], bands * bits))
        signs = (u @ planes > 0).reshape(len(u), bands, bits)
        buckets = (signs @ (1 << np.arange(bits))) + (np.arange(bands) << bits)
        at = pa.array(np.repeat(np.arange(len(u)), bands))
        yield pa.RecordBatch.from_arrays(
            [batch.column("key").take(at), batch.column("u").take(at), pa.array(buckets.ravel().astype(np.int64)), pa.array(np.ones(len(at), dtype=bool))],
            names=["key", "u", "node", "home"])
