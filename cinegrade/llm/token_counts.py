"""Token counts by whole-token shortcut for piece vocabularies with byte fallback.

Offline, from the vocabulary alone:
- merges only ever make pieces of the vocabulary. If no piece has the space mark behind another
  character, no merge crosses from a character to a space mark, so a text falls into independent
  pre-tokens: a run of space marks with what follows it up to the next run;
- each piece of the form "mark + characters" is encoded alone. Those that come out as one token
  are whole tokens: a pre-token that equals one counts 1 without merging.

The other pre-tokens are merged, each once as long as a bounded memo holds it.

Defined cases: null text counts as empty; the empty text has no tokens; texts of any length are
taken whole; rows may repeat; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegrade.llm.common import Memo, slices, texts

MARK = "▁"
_PRE_TOKEN = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PieceCounter:
    """Token counts of texts under a sentencepiece model (its serialised bytes)."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_proto=model)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.vocab_size())
                  if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i))]
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        plain = "".join(self.library.encode(" a  b ", out_type=str)) == f"{MARK}{MARK}a{MARK}{MARK}b{MARK}"  # spaces are kept, one is put first
        if crossing or not plain:
            raise ValueError("pre-tokens at spaces are not independent under this model")
        self.whole = self._whole_tokens([p[1:] for p in pieces if p[0] == MARK and len(p) > 1 and MARK not in p[1:]])
        self.counts = Memo(self._merged)

    def _whole_tokens(self, candidates: list[str]) -> frozenset[str]:
        """Candidates that, behind one space mark, encode alone as one token."""
        return frozenset(c for c, ids in zip(candidates, self.library.encode(candidates)) if len(ids) == 1)

    def _merged(self, pre_token: str) -> int:
        """Tokens of the mark and the pre-token, whose own first mark the library puts before it."""
        return 1 if pre_token in self.whole else len(self.library.encode(pre_token))

    def count(self, text: str) -> int:
        if not text:
            return 0
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            found = _PRE_TOKEN.findall(MARK + text.replace(" ", MARK))
            return sum(self.counts[p[1:]] if p[0] == MARK and len(p) > 1 else len(self.library.encode("x" + p)) - 1 for p in found)
        return sum(map(self.counts.__getitem__, text.split(" ")))


@lru_cache(maxsize=1)
def _counter(model: bytes) -> PieceCounter:
    return PieceCounter(model)


def _counted(batches: Iterator[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    counter = _counter(model)
    for part in slices(batches):
        counts = np.fromiter(map(counter.count, texts(part.column("text"))), np.int64, part.num_rows)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(counts)], names=["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, model: bytes, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens) of each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(lambda b: _counted(b, model), f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
