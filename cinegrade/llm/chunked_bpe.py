"""Byte-level BPE over overlapping chunks, and decoding.

Texts of more than CHUNK characters are cut into chunks that overlap by OVERLAP. The chunks are
pre-tokenised independently, wherever they lie. A chunk may begin inside a pre-token, so its first
boundaries can be wrong; but where two neighbours have the same boundary in their overlap they
agree from there on, because a match depends only on what follows it. The first such position is
the cut. A chunk without one (a run of OVERLAP characters without a common boundary) is joined to
the piece before it. The pieces between cuts are encoded in parallel, and the ids of a document
put together in order. Texts of one chunk are encoded where they are read.

Boundaries closer than MARGIN to a chunk's end are not trusted: the patterns look ahead at most
so far. Inside a piece, units that start at a lone space are encoded once and remembered.

Decoding concatenates the bytes of the ids.

Defined cases: null text counts as empty; the empty text has no ids; rows may repeat; an empty
table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinegrade.llm.common import Memo, keep_only, slices, space_units, texts, written

CHUNK, OVERLAP, MARGIN = 32_768, 2_048, 8
_CHUNKS = "row string, doc_id bigint, chunk_no int, body string"


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


@lru_cache(maxsize=2)
def _encoder(raw: bytes, pattern: str) -> tuple[Memo, Memo]:
    from tiktoken import Encoding

    encoding = Encoding("ranks", pat_str=pattern, mergeable_ranks=parse_ranks(raw), special_tokens={})

    def ids(unit: str) -> bytes:
        return np.array(encoding.encode_ordinary(unit), dtype="<i4").tobytes()

    return Memo(ids, limit=1000), Memo(lambda unit: ids(" " + unit))


def encode_text(text: str, raw: bytes, pattern: str) -> bytes:
    """Ids of a text as little-endian 32-bit integers."""
    first, later = _encoder(raw, pattern)
    units = space_units(text)
    return first[units[0]] + b"".join(map(later.__getitem__, units[1:]))


def _encoded(batches: Iterator[pa.RecordBatch], raw: bytes, pattern: str) -> Iterator[pa.RecordBatch]:
    """The last column, texts, turned into `ids`."""
    keep_only(*_encoder(raw, pattern))
    for part in slices(batches, 256):
        ids = [encode_text(t, raw, pattern) for t in texts(part.columns[-1])]
        ends = np.cumsum([0, *map(len, ids)]) // 4
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))
        yield pa.RecordBatch.from_arrays([*part.columns[:-1], listed], names=[*part.schema.names[:-1], "ids"])


def _cut(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Chunks of (row, doc_id, text), one at a time: each begins `chunk` characters after the one before it."""
    for batch in batches:
        for i in range(batch.num_rows):
            row, doc_id, text = (batch.column(k)[i].as_py() for k in range(3))
            for n, start in enumerate(range(0, max(1, len(text) - overlap), chunk)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row]), pa.array([doc_id], pa.int64()), pa.array([n], pa.int32()), pa.array([text[start : start + chunk + overlap]])],
                    names=["row", "doc_id", "chunk_no", "body"])


def boundaries(text: str, pattern: str) -> np.ndarray:
    """Positions where a match of the pattern begins."""
    import regex

    return np.array([m.start() for m in regex.finditer(pattern, text)], dtype=np.int64)


def _edges(batches: Iterator[pa.RecordBatch], pattern: str, chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Boundaries of each chunk in the overlap with the chunk before it and after it, as positions in the text."""
    for part in slices(batches, 16):
        heads, tails = [], []
        for n, text in zip(part.column("chunk_no").to_pylist(), part.column("body").to_pylist()):
            at = boundaries(text, pattern)
            at = at[at < max(0, len(text) - MARGIN)]
            heads.append((at[at <= overlap] + n * chunk).tolist())
            tails.append((at[at >= chunk] + n * chunk).tolist())
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([part.column("row"), part.column("chunk_no"), pa.array(heads, kind), pa.array(tails, kind)],
                                         names=["row", "chunk_no", "head", "tail"])


def stitched(chunks: DataFrame, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """row, chunk_no, piece, parts, skip and size: what each chunk contributes to which piece.

    The cut of a chunk is the first boundary that it shares with its predecessor; a chunk without
    one goes on with its predecessor's piece. parts is the number of chunks of the piece.
    """
    edges = chunks.mapInArrow(lambda b: _edges(b, pattern, chunk, overlap), "row string, chunk_no int, head array<bigint>, tail array<bigint>")
    order = Window.partitionBy("row").orderBy("chunk_no")
    begin = F.col("chunk_no").cast("long") * chunk
    cut = F.when(F.col("chunk_no") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(order))))
    found = edges.select("row", "chunk_no", cut.alias("cut"))
    found = found.withColumn("piece", F.count("cut").over(order)).withColumn("start", F.coalesce("cut", begin))
    found = found.withColumn("end", F.lead("start").over(order))
    parts = F.count("*").over(Window.partitionBy("row", "piece"))
    return found.select("row", "chunk_no", "piece", parts.alias("parts"), (F.col("start") - begin).cast("int").alias("skip"),
                        F.coalesce(F.col("end") - F.col("start"), F.lit(chunk + overlap)).cast("int").alias("size"))


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id and ids (array of integers) of each document.

    ranks: the content of a file of ranks. Of a piece only the chunk's own part is encoded.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    long = F.length("body") > chunk
    short_ids = rows.where(~long).mapInArrow(lambda b: _encoded(b, ranks, pattern), "doc_id bigint, ids array<int>")
    named = rows.where(long).select(F.expr("uuid()").alias("row"), "doc_id", "body")
    chunks = written(named.mapInArrow(lambda b: _cut(b, chunk, overlap), _CHUNKS), "chunks")
    plan = written(stitched(chunks, pattern, chunk, overlap), "pieces")
    pieces = chunks.join(plan, ["row", "chunk_no"]).select(
        "row", "doc_id", "piece", "parts", "chunk_no", F.expr("substring(body, skip + 1, size)").alias("body"))
    whole = pieces.where("parts > 1").groupBy("row", "doc_id", "piece").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "body"))), lambda x: x["body"]), "").alias("body"))
    to_encode = pieces.where("parts = 1").select("row", "doc_id", "piece", "body").unionByName(whole)
    pieces_ids = to_encode.mapInArrow(lambda b: _encoded(b, ranks, pattern), "row string, doc_id bigint, piece bigint, ids array<int>")
    joined = pieces_ids.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("pieces"))
    joined = joined.select("doc_id", F.flatten(F.transform("pieces", lambda x: x["ids"])).alias("ids"))
    return short_ids.unionByName(joined)


def decode(ids: np.ndarray, token_bytes: list[bytes]) -> bytes:
    return b"".join(map(token_bytes.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def _token_bytes(raw: bytes) -> tuple[list[bytes], list[str]]:
    ranks = parse_ranks(raw)
    out = [b""] * (max(ranks.values()) + 1)
    for token, n in ranks.items():
        out[n] = token
    return out, [str(n) for n in range(len(out))]


def decoded(batches: Iterator[pa.RecordBatch], raw: bytes) -> Iterator[pa.RecordBatch]:
    """doc_id, n_tokens, decimal ids joined by commas, and the bytes that the ids stand for."""
    token_bytes, decimal = _token_bytes(raw)
    for part in slices(batches, 128):
        values, ends = part.column("ids").values.to_numpy(), part.column("ids").offsets.to_numpy()
        ids = [values[a:b] for a, b in zip(ends, ends[1:])]
        listed = [",".join(map(decimal.__getitem__, i.tolist())) for i in ids]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()), pa.array(listed), pa.array([decode(i, token_bytes) for i in ids], pa.binary())],
            names=["doc_id", "n_tokens", "listed", "bytes"])


def decode_table(encoded: DataFrame, ranks: bytes) -> DataFrame:
    """doc_id, n_tokens, listed and bytes of each row of encode()."""
    return encoded.mapInArrow(lambda b: decoded(b, ranks), "doc_id bigint, n_tokens bigint, listed string, bytes binary")


def as_arrays(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and ids of each row of encode()."""
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")
