"""Token ids as flat binary files with 64-bit offsets, memory-mapped when read.

Rows are range-partitioned by id and each partition becomes one pair of files, through Spark's
own writer: its commit protocol keeps the output whole when executors are lost, and any store
that Spark can write to will do.

  part=ids/part-NNNNN-*   little-endian unsigned integers: the ids of each document, then the end id
  part=index/part-NNNNN-* records of 24 bytes, 64 bit each: document id (signed), offset of its first id in the
                          file of ids (counted in ids), number of ids

The width is two bytes if the vocabulary has at most 65,536 ids, else four. Spark's text writer
puts a line separator behind each row; here the separator is the end id itself, in the width of
the file. Ids and index come from one pass over the text. In an index record the separator gives
the last bytes of the number, so the end id has to be 0 (its bytes are zero).

Where a partition starts in the sequence of all ids is the prefix sum of the partitions' totals,
which is one small row for each file.

Defined cases: null text counts as empty and gives the end id alone; a null document id is
written as the smallest 64-bit integer and read as null; rows with the same id follow one another
in no fixed order, the same in both files; an empty table gives no files and reads as no rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinegrade.llm.common import Memo, slices, space_units, texts

NULL_ID = -(1 << 63)
INDEX = np.dtype([("doc_id", "<i8"), ("start", "<i8"), ("n_tokens", "<i8")])
FILE_BYTES = 256 << 20
_ROW = "part string, place bigint, value binary"


def _rank_order(model: dict) -> dict[bytes, int] | None:
    """Bytes of each token by id, if the ids follow the order of the merges; else None.

    Where the n-th merge makes the n-th id after the single bytes, merging by lowest id is merging
    by the list, so a rank encoder gives the ids of the tokenizer for text without added tokens.
    """
    if model.get("type") != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(printable))}
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(vocab.get(a + b) != 256 + n for n, (a, b) in enumerate(merges)):
        return None
    return {bytes(byte_of[c] for c in token): n for token, n in vocab.items() if n < 256 + len(merges)}


@lru_cache(maxsize=1)
def _encoder(model: str, width: int) -> Callable[[str], bytes]:
    """Bytes of the ids of a text. One encoder for each Python worker.

    A text without added tokens goes whole through the rank encoder, if there is one. Others are cut at
    spaces; only units that hold an added token, or all without a rank encoder, go through the library.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from public_tokenizers import PATTERN
    from tiktoken import Encoding
    from tokenizers import Tokenizer

    tokenizer, parsed, kind = Tokenizer.from_str(model), json.loads(model), f"<u{width}"
    split = parsed.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not parsed.get("normalizer")
    ranks = _rank_order(parsed["model"]) if plain else None
    added = [t["content"] for t in parsed.get("added_tokens", [])]
    if any(" " in a for a in added) or not plain:
        raise ValueError("texts can't be cut at spaces for this tokenizer")
    fast = Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    def by_ranks(text: str) -> bool:
        return fast is not None and not any(a in text for a in added)

    def unit_ids(unit: str) -> bytes:
        if by_ranks(unit):
            return fast.encode_to_numpy(unit).astype(kind).tobytes()
        return np.array(tokenizer.encode(unit, add_special_tokens=False).ids, dtype=kind).tobytes()

    later = Memo(lambda unit: unit_ids(" " + unit), limit=100_000)

    def text_ids(text: str) -> bytes:
        if by_ranks(text):
            return unit_ids(text)
        units = space_units(text)
        return unit_ids(units[0]) + b"".join(map(later.__getitem__, units[1:]))

    return text_ids


def encoded(batches: Iterator[pa.RecordBatch], model: str, width: int) -> Iterator[pa.RecordBatch]:
    """Two rows for each document: its ids, and its index record without the separator's bytes.

    Both carry the document's place in the partition, by which they are sorted: ids may repeat.
    """
    ids_of = _encoder(model, width)
    place, start = 0, 0
    for part in slices(batches, 256):
        doc_ids = part.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8")
        bodies = [ids_of(text) for text in texts(part.column(1))]
        counts = np.array([len(b) // width + 1 for b in bodies], dtype="<i8")
        records = np.empty(len(bodies), dtype=INDEX)
        records["doc_id"], records["n_tokens"] = doc_ids, counts
        records["start"] = start + np.cumsum(counts) - counts
        places = place + np.arange(len(bodies))
        place, start = place + len(bodies), start + int(counts.sum())
        raw, keep = records.tobytes(), INDEX.itemsize - width
        index = [raw[i : i + keep] for i in range(0, len(raw), INDEX.itemsize)]
        kinds = ["ids"] * len(bodies) + ["index"] * len(bodies)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kinds), pa.array(np.concatenate([places, places])), pa.array(bodies + index, pa.binary())],
            names=["part", "place", "value"])


def write_token_files(docs: DataFrame, path: str, model: str, vocab_size: int, end_id: int = 0,
                      id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> int:
    """Write the ids of every text under path, in ascending order of the document ids; the width in bytes.

    model: the tokenizer's JSON. A file takes the texts of about file_bytes bytes; there are two files
    for each core at least, if there are rows enough.
    """
    if end_id != 0:
        raise ValueError("the end id is also the separator of index records and must be 0")
    width = 2 if vocab_size <= 1 << 16 else 4
    ordered = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    text_bytes = ordered.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n_files = max(text_bytes // file_bytes + 1, 2 * docs.sparkSession.sparkContext.defaultParallelism)
    ordered = ordered.repartitionByRange(n_files, "doc_id").sortWithinPartitions("doc_id")
    rows = ordered.mapInArrow(lambda batches: encoded(batches, model, width), _ROW)
    rows = rows.sortWithinPartitions("part", "place").select(F.col("value").cast("string").alias("value"), "part")
    rows.write.partitionBy("part").option("lineSep", "\0" * width).option("compression", "none").text(path)
    return width


_PART = r"part-(\d+)-"


def _files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Name, number and length of the files of a kind; contents are not read."""
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(f"{path}/part={kind}")
    return files.select(F.col("path").alias(f"{kind}_file"), F.regexp_extract("path", _PART, 1).cast("int").alias("file_no"), F.col("length").alias(f"{kind}_bytes"))


def _local(path: str) -> str | None:
    parts = urlsplit(path)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def read_documents(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """doc_id, start, n_tokens and the CRC-32 of the ids as unsigned 32-bit integers, from mapped files."""
    for batch in batches:
        for row in batch.to_pylist():
            ids = np.memmap(_local(row["ids_file"]), dtype=f"<u{width}", mode="r")
            index = np.memmap(_local(row["index_file"]), dtype=INDEX, mode="r")
            yield from _digests(ids, index, row["base"])


def read_contents(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The same from contents that Spark has read, for stores without local paths."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids = np.frombuffer(batch.column("ids_content")[i].as_buffer(), dtype=f"<u{width}")
            index = np.frombuffer(batch.column("index_content")[i].as_buffer(), dtype=INDEX)
            yield from _digests(ids, index, batch.column("base")[i].as_py())


def _digests(ids: np.ndarray, index: np.ndarray, base: int, rows: int = 8192) -> Iterator[pa.RecordBatch]:
    counts = np.asarray(index["n_tokens"]).astype(np.int64)
    starts = np.asarray(index["start"]).astype(np.int64)
    ends = starts + counts
    doc_ids = np.asarray(index["doc_id"]).astype(np.int64)
    for at in range(0, len(counts), rows):
        some = slice(at, at + rows)
        crc = [zlib.crc32(np.ascontiguousarray(ids[a:b], dtype="<u4").data) for a, b in zip(starts[some], ends[some])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc_ids[some], mask=doc_ids[some] == NULL_ID), pa.array(starts[some] + base), pa.array(counts[some]), pa.array(crc, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, path: str, width: int) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document in the files."""
    store = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if not store.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/part=ids")):
        return spark.createDataFrame([], schema)
    pairs = _files(spark, path, "ids").join(_files(spark, path, "index"), "file_no")
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    pairs = pairs.withColumn("base", F.coalesce(F.sum(F.floor(F.col("ids_bytes") / width)).over(before), F.lit(0)))
    if re.match("file:", store.getUri().toString()):  # the store that a path without a scheme stands in, too
        named = pairs.select("ids_file", "index_file", "base").repartition("ids_file")
        return named.mapInArrow(lambda batches: read_documents(batches, width), schema)
    numbered = {kind: spark.read.format("binaryFile").load(f"{path}/part={kind}").select(
        F.regexp_extract("path", _PART, 1).cast("int").alias("file_no"), F.col("content").alias(f"{kind}_content")) for kind in ("ids", "index")}
    whole = pairs.select("file_no", "base").join(numbered["index"], "file_no").join(numbered["ids"], "file_no")
    return whole.mapInArrow(lambda batches: read_contents(batches, width), schema)
