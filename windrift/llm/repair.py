"""Repair of conversations: the cheapest edits that make the roles take turns, from layers that shared prefixes share.

A row is a letter: its role (system, user, assistant or another) and its fault (to be deleted, truncated or none). A conversation's
letters in order are its signature. Signatures are dealt out by ranges and sorted, so a task meets them as the depth-first walk of
a prefix trie: what it keeps is the path to the last signature, one layer a letter, and a new signature computes layers only below the
prefix that it shares with the one before. Terminal nodes emit the answer.

A layer has, for each state of the turn-taking (nothing, after system, after user, after assistant), the least cost of its
prefix, the letters' least way to it as a link to the layer above, and the place of that way among the layer's. Ways of one layer consume the same
rows and end with a row's edit, so none is a beginning of another, and their places settle every later comparison: no strings are kept.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import cache
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import stored

#: A letter of a signature is chr(_FIRST + 3 * role + fault); roles are s, u, a and any other.
ROLES, FAULTS = "sua", ("none", "truncated", "delete")
_FIRST = 65
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Where a role leads from each state: 0 nothing yet, 1 after s, 2 after u, 3 after a. The turns may end in 0 and in 3.
_STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_ENDS = (0, 3)
#: The role that an insertion or a new role gets in each state.
_NEXT = ("u", "u", "a", "u")
#: White space of the texts.
BLANK = " \t\n\x0b\x0c\r"
EMPTY = hashlib.sha256(b"").hexdigest()

#: For each state: cost (-1: cannot be reached) above the layer's least, and place among the layer's ways.
Layer = tuple[tuple[int, int], ...]
#: For each state: the state above and the edits since.
Links = tuple[tuple[int, str], ...]
_ROOT: Layer = ((0, 0), *[(-1, 0)] * 3)


def _moves(letter: int) -> list[list[tuple[str, int, int]]]:
    """For each state: the edits of one row after up to two insertions, the cost and the state they lead to."""
    role, fault = (ROLES + "-")[letter // 3], FAULTS[letter % 3]
    out = []
    for state in range(4):
        moves, at = [], state
        for k in range(3):
            moves.append(("I" * k + "D", INSERT * k + DELETE, at))
            if fault != "delete":
                more = INSERT * k + TRUNCATED * (fault == "truncated")
                if (at, role) in _STEP:
                    moves.append(("I" * k + "K", more + KEEP, _STEP[at, role]))
                moves.append(("I" * k + "R", more + REROLE, _STEP[at, _NEXT[at]]))
            at = _STEP[at, _NEXT[at]]
        out.append(moves)
    return out


_MOVES = [_moves(i) for i in range(12)]


@cache
def next_layer(above: Layer, letter: int) -> tuple[Layer, int, Links]:
    """The layer below, its least cost above that of ``above``, and the links. There are few layers, so each is worked out once in a worker."""
    best: list[tuple[int, int, str, int] | None] = [None] * 4
    for state, (cost, place) in enumerate(above):
        if cost >= 0:
            for edits, more, to in _MOVES[letter][state]:
                way = (cost + more, place, edits, state)
                if best[to] is None or way < best[to]:
                    best[to] = way
    # Edits from one state above differ before either ends, and ways from two states differ in their places.
    order = sorted((b[1], b[2], to) for to, b in enumerate(best) if b is not None)
    places = {to: i for i, (_, _, to) in enumerate(order)}
    least = min(b[0] for b in best if b is not None)
    layer = tuple((-1, 0) if b is None else (b[0] - least, places[to]) for to, b in enumerate(best))
    return layer, least, tuple((0, "") if b is None else (b[3], b[2]) for b in best)


class Trie:
    """The path to the last signature of a sorted run of them: for each letter its layer, cost and links, 24 bytes."""

    def __init__(self):
        self.signature, self.result = "", (0, "")
        self.layers: list[Layer] = [_ROOT]
        self.costs, self.links = array("q", [0]), [()]
        self.made = 0

    def repair(self, signature: str) -> tuple[int, str]:
        """The least cost, and the first of the cheapest edits."""
        if signature != self.signature:
            shared = len(commonprefix((signature, self.signature)))
            del self.layers[shared + 1 :], self.costs[shared + 1 :], self.links[shared + 1 :]
            for c in signature[shared:]:
                layer, more, links = next_layer(self.layers[-1], ord(c) - _FIRST)
                self.layers.append(layer)
                self.costs.append(self.costs[-1] + more)
                self.links.append(links)
            self.made += len(signature) - shared
            self.signature, self.result = signature, self._answer()
        return self.result

    def _answer(self) -> tuple[int, str]:
        ends = []
        for state, (cost, place) in enumerate(self.layers[-1]):
            at = state
            for k in range(3):
                if cost >= 0 and at in _ENDS:
                    ends.append((cost + INSERT * k, place, "I" * k, state))
                at = _STEP[at, _NEXT[at]]
        cost, _, last, state = min(ends)
        out = [last]
        for links in self.links[:0:-1]:
            state, edits = links[state]
            out.append(edits)
        return self.costs[-1] + cost, "".join(reversed(out))


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = Trie()
    for batch in batches:
        found = [trie.repair(s) for s in batch.column("signature").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], names=[*batch.schema.names, "cost", "audit"])


def solve(signatures: DataFrame) -> DataFrame:
    """``signatures`` (signature, ...) with cost and audit. Dealt out by ranges of the signature and a hash of the row, so that one signature may be of any share."""
    order = [F.asc("signature"), F.xxhash64(*[c for c in signatures.columns if c != "signature"]).asc()]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in signatures.schema)
    return signatures.repartitionByRange(*order).sortWithinPartitions("signature").mapInArrow(_repairs, f"{kinds}, cost long, audit string")


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of ``rows`` after the damage, and ``_there``; a dropped row stays with _there false.

    By crc32("conv_id:turn") % 20: 0 drops the row, 1 empties its text, 2 takes its full stops, exclamation and question marks, 3 repeats it
    beside itself, 4 makes its role user. A null id or turn counts as one blank there, and a null role or text is one blank.
    """
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    out = rows.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), kind.alias("_kind"))
    out = out.withColumn("text", F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    out = out.withColumn("role", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")))
    twice = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return out.select("conv_id", "turn", "role", "text", (F.col("_kind") != 0).alias("_there"), twice.alias("_copy")).drop("_copy")


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("_digest").asc()]


def _fault() -> Column:
    """Of a row alone: delete for a blank text, truncated if its last letter is no end of a sentence, else none."""
    last = F.substring(F.rtrim("text", F.lit(BLANK)), -1, 1)
    return F.when(last == "", "delete").when(~last.isin(".", "!", "?"), "truncated").otherwise("none")


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation of rows in order; its letters are gathered, a byte each."""
    names = ["conv_id", "signature", "gaps", "blank", "duplicate", "truncated", "illegal"]
    out, now, started = [], None, False
    letters, counts, lowest, highest, turns, turn, role = bytearray(), {}, None, None, 0, None, None

    def done() -> tuple:
        gaps = highest - lowest + 1 - turns if turns else 0
        return now, letters.decode(), gaps, counts.get("blank", 0), counts.get("duplicate", 0), counts.get("truncated", 0), counts.get("illegal", 0)

    for batch in batches:
        for conv, there, t, r, fault in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "_there", "turn", "_initial", "_fault")), strict=True):
            if not started or conv != now:
                if started:
                    out.append(done())
                now, started = conv, True
                letters, counts, lowest, highest, turns, turn, role = bytearray(), {}, None, None, 0, None, None
            if not there:
                continue
            if t is not None:
                lowest = t if lowest is None else lowest
                turns += t != turn
                highest = turn = t
            if role is not None and role + r not in ("su", "ua", "au"):
                counts["illegal"] = counts.get("illegal", 0) + 1
            role = r
            if fault != "none":
                counts[fault] = counts.get(fault, 0) + 1
            letters.append(_FIRST + 3 * (ROLES.find(r) if r in ROLES and r else 3) + {"none": 0, "truncated": 1}.get(fault, 2))
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], _SCHEMA)
            out = []
    if started:
        yield pa.RecordBatch.from_pylist([dict(zip(names, done(), strict=True))], _SCHEMA)


_SCHEMA = pa.schema([("conv_id", pa.int64()), ("signature", pa.string()), *[(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal")]])


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, signature, gaps, blank, duplicate, truncated and illegal of each conversation of ``rows`` (conv_id, turn, role, text, _there).

    One shuffle by conversation, of digests in place of texts. Equal rows are told by SHA-256. Rows of one turn go by role and digest; a row's first fault counts.
    """
    facts = rows.select("conv_id", "turn", "role", "_there", F.sha2(F.col("text").cast("binary"), 256).alias("_digest"), _fault().alias("_alone"), F.substring("role", 1, 1).alias("_initial"))
    facts = facts.repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "_digest", "_there").orderBy(F.col("turn").asc_nulls_first()))
    fault = F.when(F.col("_alone") == "delete", "blank").when(F.col("_seen") > 1, "duplicate").otherwise(F.col("_alone"))
    facts = facts.withColumn("_seen", seen).withColumn("_fault", fault).sortWithinPartitions("conv_id", *_order())
    return facts.select("conv_id", "_there", F.col("turn").cast("long").alias("turn"), "_initial", "_fault").mapInArrow(_signatures, "conv_id long, signature string, gaps long, blank long, duplicate long, truncated long, illegal long")


def _rewritten(each):
    """Follows each conversation's audit, which comes as its first row, over its rows in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeper = each()
        for batch in batches:
            for conv, audit, turn, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "audit", "turn", "role", "text")), strict=True):
                if audit is not None:
                    yield from keeper.start(conv, audit)
                else:
                    yield from keeper.row(turn, role, text)
            yield from keeper.flush()
        yield from keeper.end()

    return run


class _Turns:
    """The repaired turns of conversations, one after the other."""

    FULL = {"u": "user", "a": "assistant"}

    def __init__(self):
        self.conv, self.audit, self.at, self.state = None, "", 0, 0

    def begin(self, conv, audit: str) -> None:
        self.conv, self.audit, self.at, self.state = conv, audit, 0, 0

    def _turn(self, role: str) -> str:
        self.state = _STEP[self.state, role[0]]
        return role

    def inserted(self) -> Iterator[tuple]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield None, self._turn(self.FULL[_NEXT[self.state]]), "", "I"

    def of(self, turn, role: str, text: str) -> Iterator[tuple]:
        """What comes of one row: insertions before it, then the row unless it is deleted."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            yield turn, self._turn(role), text, "K"
        elif edit == "R":
            yield turn, self._turn(self.FULL[_NEXT[self.state]]), text, "R"


class _Digests(_Turns):
    """The digest of each conversation's ``role:text`` lines, fed turn by turn."""

    def __init__(self):
        super().__init__()
        self.hash, self.first, self.out = None, True, []

    def _feed(self, turns) -> None:
        for _, role, text, _ in turns:
            self.hash.update(b"" if self.first else b"\n")
            self.hash.update(f"{role}:{text}".encode())
            self.first = False

    def _close(self) -> None:
        if self.hash is not None:
            self._feed(self.inserted())
            self.out.append((self.conv, self.hash.hexdigest()))

    def start(self, conv, audit):
        self._close()
        self.begin(conv, audit)
        self.hash, self.first = hashlib.sha256(), True
        return ()

    def row(self, turn, role, text):
        self._feed(self.of(turn, role, text))
        return ()

    def flush(self):
        if self.out:
            out, self.out = self.out, []
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([h for _, h in out], pa.string())], names=["conv_id", "repaired_sha256"])

    def end(self):
        self._close()
        yield from self.flush()


class _Rows(_Turns):
    """The repaired turns as rows, numbered from 0."""

    def __init__(self):
        super().__init__()
        self.number, self.out = 0, []

    def _add(self, turns) -> None:
        for turn, role, text, edit in turns:
            self.out.append((self.conv, self.number, turn, role, text, edit))
            self.number += 1

    def start(self, conv, audit):
        self._add(self.inserted())
        self.begin(conv, audit)
        self.number = 0
        return ()

    def row(self, turn, role, text):
        self._add(self.of(turn, role, text))
        return ()

    def flush(self):
        if self.out:
            out, self.out = self.out, []
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names=["conv_id", "number", "turn", "role", "text", "edit"])

    def end(self):
        self._add(self.inserted())
        yield from self.flush()


def _followed(rows: DataFrame, audits: DataFrame, each, schema: str) -> DataFrame:
    """``rows`` in order of their conversation with its audit before them, through ``each``. The texts are shuffled once; memory is one audit and one batch."""
    null = lambda kind: F.lit(None).cast(kind)
    lines = rows.where("_there").select("conv_id", null("string").alias("audit"), F.col("turn").cast("long").alias("turn"), "role", "text", F.sha2(F.col("text").cast("binary"), 256).alias("_digest"))
    heads = audits.select("conv_id", "audit", null("long").alias("turn"), null("string").alias("role"), null("string").alias("text"), null("string").alias("_digest"))
    both = lines.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull().asc(), *_order())
    return both.select("conv_id", "audit", "turn", "role", "text").mapInArrow(_rewritten(each), schema)


def checked(rows: DataFrame) -> DataFrame:
    """The rows of conversations as ``signatures`` takes them, undamaged; a null role or text is one blank."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), F.lit(True).alias("_there"))


def report(rows: DataFrame) -> DataFrame:
    """conv_id, signature, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation of ``rows`` (``checked`` or ``damaged``).

    The turns that are asked for: nothing at all, or user and assistant in turn, ended by the assistant, after at most one system row. Keeping a row
    costs 0, a new role 2, deleting 3 (blank and repeated rows must go), an empty turn 2, and a truncated row that stays 1 more. Of the
    cheapest edits those whose initials (K, R, D, I) come first in ASCII. Roles count by their first letter. conv_id null is a conversation of its own;
    one without rows has zeros and an empty audit. Only columns named here are read. A conversation's letters pass through one task, a byte a row.
    """
    return solve(signatures(rows))


def repaired_turns(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, number, turn, role, text and edit (K, R or I) of the turns after repair; inserted ones have no turn and an empty text."""
    return _followed(rows, audits, _Rows, "conv_id long, number long, turn long, role string, text string, edit string")


def repaired_digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256, the digest of the repaired ``role:text`` lines. A digest runs over a conversation in order, so one task streams it."""
    return _followed(rows, audits, _Digests, "conv_id long, repaired_sha256 string")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    found = stored(report(rows), "audits")
    digests = repaired_digests(rows, found)
    a, b = found.drop("signature"), digests.withColumnRenamed("conv_id", "_conv")
    return a.join(b, a.conv_id.eqNullSafe(b._conv)).drop("_conv")


QUERIES = {"op12_repair": op12_repair}
ORACLE_SQL: dict[str, str] = {}
