"""Repair of damaged conversations by the cheapest edits, found on one automaton of all conversations' endings.

A row of a conversation is a sign: the first letter of its role (s, u, a or another) and its first fault. The
edits are Keep (0), Rerole to user or assistant (1), Delete (2; the only edit of blank and duplicate rows)
and Insert an empty user or assistant row (5); a truncated row that stays costs 5 more. They must
leave role initials of the form (s?(ua)+)?, and of the cheapest edits those stand whose initials come first.

What the rest of a conversation costs depends only on the signs that follow and on the grammar's state (nothing yet,
after s, after u, after a). So conversations share their endings: the distinct sign strings are sorted from the
end, and each ending is a node that is reached once, where the cost to go and the best edit
are found for the four states. Endings whose costs differ by the same amount in all states are one node of the minimised
automaton, of which there are few; the best audit is read off along the path.

Scale. Equal sign strings meet before anything is computed. Rows get their place in a conversation by a sort
over ranges, which may cut a long conversation into pieces; a piece is a byte for each row. Texts are
shuffled once, to be repaired and hashed in order; a task holds one batch of them, and the audit of one conversation.

Defined cases: a null role or text is one space; so is a null id or turn in the checksum that damages; rows
with a null id are one conversation; a null turn comes first. Rows of one turn are ordered by role, by
the first OPENING characters of the text and then by its SHA-256. An empty role has no initial, and is not
kept. Repeated rows are duplicates from the second on. A conversation without rows has zeros and an empty audit. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinegrade.llm.common import slices, written

OPENING = 64
SPACE = " \t\n\x0b\x0c\r"
ROLES = "sua"  # classes 0, 1 and 2; other roles are 3
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
START, AFTER_S, AFTER_U, AFTER_A = range(4)
_AFTER = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_A, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A}
_LEGAL = [4 * ROLES.index(a) + ROLES.index(b) for a, b in ("su", "ua", "au")]
_FIRST_SIGN = ord("A")


def needed(state: int) -> str:
    """Initial of the only role that Rerole or Insert may give in a state."""
    return "a" if state == AFTER_U else "u"


# One node of the automaton: what each state costs, and the first edit from there.

Costs = tuple[int, int, int, int]
END: tuple[Costs, str] = ((0, 10, 5, 0), " II ")


@lru_cache(maxsize=100_000)
def node_before(role: int, fault: int, costs: Costs) -> tuple[Costs, int, str]:
    """Costs and first edits of an ending with one row more, for the costs of the ending after it.

    The least cost is taken out and comes second, so that endings alike in all else are one node.
    """
    stays = 5 if fault == TRUNCATED else 0
    free: list[list[tuple[int, str]]] = []
    for state in range(4):
        options = [(2 + costs[state], "D")]
        if fault not in (BLANK, DUPLICATE):
            after = _AFTER.get((state, ROLES[role])) if role < 3 else None
            if after is not None:
                options.append((stays + costs[after], "K"))
            options.append((1 + stays + costs[_AFTER[state, needed(state)]], "R"))
        free.append(options)
    least = [min(o)[0] for o in free]
    after_insert = [_AFTER[state, needed(state)] for state in range(4)]
    for _ in range(2):  # an inserted user may call for an inserted assistant
        least = [min(least[s], 5 + least[after_insert[s]]) for s in range(4)]
    edits = "".join(min(o for o in [*free[s], (5 + least[after_insert[s]], "I")] if o[0] == least[s])[1] for s in range(4))
    base = min(least)
    return tuple(c - base for c in least), base, edits


class Endings:
    """Path of the current sign string from its end; strings sorted from their ends share what they have in common."""

    def __init__(self) -> None:
        self.tail, self.nodes, self.bases, self.made = b"", [END], [0], 0

    def read(self, signs: bytes) -> tuple[int, str]:
        """Cost and audit of a sign string."""
        tail = signs[::-1]
        shared = next((k for k, (a, b) in enumerate(zip(tail, self.tail)) if a != b), min(len(tail), len(self.tail)))
        del self.nodes[shared + 1 :], self.bases[shared + 1 :]
        for sign in tail[shared:]:
            role, fault = divmod(sign - _FIRST_SIGN, 4)
            costs, base, edits = node_before(role, fault, self.nodes[-1][0])
            self.nodes.append((costs, edits))
            self.bases.append(self.bases[-1] + base)
        self.tail, self.made = tail, self.made + len(tail) - shared
        state, at, audit = START, len(signs), []
        cost = self.nodes[at][0][state] + self.bases[at]
        while (edit := self.nodes[at][1][state]) != " ":
            audit.append(edit)
            if edit == "K":
                state = _AFTER[state, ROLES[(tail[at - 1] - _FIRST_SIGN) // 4]]
            elif edit != "D":
                state = _AFTER[state, needed(state)]
            at -= edit != "I"
        return cost, "".join(audit)


def sign_counts(signs: bytes) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated rows, and neighbours whose initials may not follow each other."""
    numbers = np.frombuffer(signs, dtype=np.uint8) - _FIRST_SIGN
    role, faults = numbers >> 2, np.bincount(numbers & 3, minlength=4)
    illegal = len(role) - 1 - int(np.isin(4 * role[:-1] + role[1:], _LEGAL).sum()) if len(role) else 0
    return int(faults[BLANK]), int(faults[DUPLICATE]), int(faults[TRUNCATED]), illegal


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    endings = Endings()
    for part in slices(batches):
        rows = []
        for signs in part.column("signs").to_pylist():
            data = signs.encode()
            rows.append((signs, *sign_counts(data), *endings.read(data)))
        columns = list(zip(*rows)) or [()] * 7
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.string() if k in (0, 6) else pa.int64()) for k, c in enumerate(columns)],
            names=["signs", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


def audited_signs(signs: DataFrame) -> DataFrame:
    """Counts, cost and audit of each distinct sign string, computed along their shared endings."""
    tails = signs.select("signs").distinct().withColumn("tail", F.reverse("signs"))
    tails = tails.repartitionByRange(F.substring("tail", 1, 200)).sortWithinPartitions("tail").select("signs")
    return tails.mapInArrow(_audited, "signs string, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


# Rows and their signs.

def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of rows, damaged by the checksum of their place: a fifth of them.

    0 drops the row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = (F.crc32(F.concat(named[0], F.lit(":"), named[1]).cast("binary")) % 20).alias("kind")
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("time")).drop("time")


def _filled(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])


def _digest() -> Column:
    return F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)


def placed(rows: DataFrame) -> DataFrame:
    """conv_id, turn, initial, digest, blank and truncated of each row, and its place in the order of all rows.

    Ranges run over all of the order, and copies are dealt over ranges, so neither a long conversation nor a
    row with many copies has to fit one task.
    """
    body = F.rtrim(F.col("text"), F.lit(SPACE))
    flags = rows.select(
        "conv_id", "turn", "role", F.substring("text", 1, OPENING).alias("opening"), _digest().alias("digest"), (body == "").alias("blank"),
        (~F.substring(body, -1, 1).isin(".", "!", "?") & (body != "")).alias("truncated"), F.monotonically_increasing_id().alias("copy"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "opening", "digest"]
    ordered = flags.repartitionByRange(*order, "copy").sortWithinPartitions(*order)
    return ordered.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "digest", "blank", "truncated", F.monotonically_increasing_id().alias("place"))


def signs_of(places: DataFrame) -> DataFrame:
    """conv_id and the signs of its rows in order, a letter for each."""
    firsts = places.where("not blank").groupBy("conv_id", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("truncated"), TRUNCATED).otherwise(0)
    role = F.instr(F.lit(ROLES), F.col("initial")) - 1
    role = F.when((F.col("initial") == "") | (role < 0), 3).otherwise(role)
    rows = places.select("conv_id", "place", "initial", "blank", "truncated").join(firsts, "place", "left")
    rows = rows.select("conv_id", F.shiftright("place", 33).alias("piece"), "place", F.char(_FIRST_SIGN + 4 * role + fault).alias("sign"))
    joined = lambda number, part: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(number, part))), lambda x: x[part]), "").alias("signs")
    pieces = rows.groupBy("conv_id", "piece").agg(joined("place", "sign"))
    return pieces.groupBy("conv_id").agg(joined("piece", "signs"))


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Repaired rows (conv_id, position, role, text, edit) of batches in order, where each conversation's audit comes before its rows."""
    conv, audit, at, state, position = None, "", 0, START, 0

    def inserts(out: list) -> None:
        nonlocal at, state, position
        while audit[at : at + 1] == "I":
            role = {"u": "user", "a": "assistant"}[needed(state)]
            out.append((conv, position, role, "", "I"))
            at, state, position = at + 1, _AFTER[state, needed(state)], position + 1

    for part in slices(batches):
        out: list[tuple] = []
        for key, kind, role, text in zip(*(part.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text"))):
            inserts(out)
            if kind == 0:
                conv, audit, at, state, position = key, text, 0, START, 0
                continue
            edit = audit[at]
            at += 1
            if edit == "D":
                continue
            if edit == "R":
                role = {"u": "user", "a": "assistant"}[needed(state)]
            state = _AFTER[state, role[0]]
            out.append((conv, position, role, text, edit))
            position += 1
        yield out
    out = []
    inserts(out)
    yield out


def _as_rows(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for out in _turns(batches):
        columns = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.int64(), pa.string(), pa.string(), pa.string()))],
                                         names=["conv_id", "position", "role", "text", "edit"])


def _as_hashes(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    conv, running = None, None
    for out in _turns(batches):
        ended = []
        for key, position, role, text, _ in out:
            if position == 0:
                if running is not None:
                    ended.append((conv, running.hexdigest()))
                conv, running = key, hashlib.sha256()
            else:
                running.update(b"\n")
            running.update(f"{role}:{text}".encode())
        columns = list(zip(*ended)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], pa.string())], names=["conv_id", "repaired_sha256"])
    if running is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([running.hexdigest()])], names=["conv_id", "repaired_sha256"])


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, blank, duplicate, truncated, illegal, gaps, cost and audit of each conversation with rows (columns conv_id, turn, role, text)."""
    places = written(placed(_filled(rows)), "places")
    signs = written(signs_of(places), "signs")
    found = signs.join(audited_signs(signs), "signs").drop("signs")
    turns = places.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    return written(beside("conv_id", found, turns), "audits")


def beside(key: str, *tables: DataFrame) -> DataFrame:
    """Columns of tables with at most one row for each key, in one row; a null key is a key."""
    both = tables[0]
    for more in tables[1:]:
        both = both.unionByName(more, allowMissingColumns=True)
    return both.groupBy(key).agg(*[F.max(c).alias(c) for c in both.columns if c != key])


def _in_order(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order, in one partition."""
    numbered = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text")
    heads = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    return heads.unionByName(numbered).repartition("conv_id").sortWithinPartitions(
        "conv_id", "kind", F.asc_nulls_first("turn"), "role", F.substring("text", 1, OPENING), _digest())


def _arrow_type(rows: DataFrame) -> tuple[pa.DataType, str]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema["conv_id"].dataType
    return to_arrow_type(kind), kind.simpleString()


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, position, role, text and edit (K, R or I) of the repaired rows; found has the audits of rows."""
    kind, name = _arrow_type(rows)
    return _in_order(_filled(rows), found).mapInArrow(lambda b: _as_rows(b, kind), f"conv_id {name}, position long, role string, text string, edit string")


def repaired_hashes(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id and SHA-256 of its repaired rows as `role:text` lines, of conversations that keep a row."""
    kind, name = _arrow_type(rows)
    return _in_order(_filled(rows), found).mapInArrow(lambda b: _as_hashes(b, kind), f"conv_id {name}, repaired_sha256 string")


def report(originals: DataFrame, rows: DataFrame) -> DataFrame:
    """For every conv_id of originals: gaps, faults, cost, audit and hash of the repair of its rows."""
    found = audits(rows)
    whole = beside("conv_id", originals.select("conv_id").distinct(), found, repaired_hashes(rows, found))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
