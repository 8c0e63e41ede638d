"""Repair of damaged conversations through a suffix-shared automaton (DAWG).

Every conversation has a signature: one symbol a row for its role and fault.  The edits of
least cost depend on the signature alone, and what remains to be paid from a row on depends
on the rest of the signature alone.  So all signatures of all conversations are minimised
from the end into one automaton: a node is a rest that some signature ends with, whichever
conversations have it.  Each node holds, for each grammar state, the least cost to go and
the first edit of the best audit rest; the others follow at the nodes it leads to.

The automaton is built in shards of sorted reversed signatures.  There the signatures that
share a rest are neighbours, so a shard keeps only the nodes of the signature at hand: what
the next one shares stays, the others are finished and dropped.  Every node of a shard is
worked out once, and only the nodes of a shard's first signature can be in another one, too.

The grammar is ``(s?(ua)+)?`` over role initials.  Edits: ``K``eep 0, ``R``erole to user or
assistant 2, ``D``elete 3 (required for blank and duplicate rows), ``I``nsert an empty user
or assistant row 2; a truncated row that is not deleted adds 1.  Of the audits of least
cost the least in ASCII order counts.

A conversation's rows are streamed in order, in bounded memory but for its signature and audit (one
symbol a row, as in the result); texts are shuffled once, when they are repaired.

Results of odd input: null cells are one space; rows are in order of turn (null first), those of
one turn in order of a digest of role and text; rows without conversation id form one
conversation; a role without a first letter s, u or a (or an empty one) is none of the grammar's;
an empty table gives an empty table; columns other than the four are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import checkpointed, map_arrow, pick

BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: Sub-keys that a signature of many conversations is dealt over.
SALTS = 64
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
#: Symbol of a row that must be deleted; others are the role's letter, a capital where the text is truncated.
GONE, OTHER = "x", "o"

# Grammar states: nothing yet, behind a system row, behind a user row, behind an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: State behind a kept row of each role letter.
_KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: State behind a row that an edit puts there, and the row's role.
_PUT = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}


def damaged(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows after damage by crc32 of ``conv_id:turn``; a dropped row leaves one row that is not ``present``."""
    rows = pick(df, conv_id=(conv_col, "bigint"), turn=(turn_col, "bigint"), role=(role_col, "string"), text=(text_col, "string"))
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.withColumn("fate", F.crc32(F.concat(cell("conv_id"), F.lit(":"), cell("turn")).cast("binary")) % 20)
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate(cell("text"), ENDS, "")).otherwise(cell("text"))
    rows = rows.select(
        "conv_id",
        "turn",
        (F.col("fate") != 0).alias("present"),
        F.when(F.col("fate") == 4, "user").otherwise(cell("role")).alias("role"),
        text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1))).alias("again"),
    )
    return rows.drop("again")


def _order(rows: DataFrame) -> DataFrame:
    """With the digest that orders rows of one turn and tells equal rows."""
    return rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))


def _marks(role: Column, text: Column) -> tuple[Column, Column]:
    """Symbol of the row by itself, and its role initial."""
    said = F.rtrim(text, F.lit(BLANKS))
    initial = F.substring(role, 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit(OTHER))
    ended = F.substring(said, -1, 1).isin(*ENDS)
    return F.when(said == "", GONE).when(ended, letter).otherwise(F.upper(letter)), letter


SIGNATURES = pa.schema(
    [("conv_id", pa.int64()), ("signature", pa.string())]
    + [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal")]
)
_LEGAL = {"su", "ua", "au"}


class _Signature:
    """Signature and counts of one conversation, row by row."""

    def __init__(self, conv_id):
        self.conv_id, self.symbols, self.before = conv_id, [], ""
        self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, symbol: str, letter: str, seen: bool) -> None:
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        if symbol == GONE:
            self.blank += 1
        elif seen:
            symbol = GONE
            self.duplicate += 1
        elif symbol.isupper():
            self.truncated += 1
        self.symbols.append(symbol)
        self.illegal += bool(self.before) and self.before + letter not in _LEGAL
        self.before = letter

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return self.conv_id, "".join(self.symbols), gaps, self.blank, self.duplicate, self.truncated, self.illegal


def signatures(rows: DataFrame) -> DataFrame:
    """One row per conversation, see :data:`SIGNATURES`; texts are judged where they are and not shuffled."""
    symbol, letter = _marks(F.col("role"), F.col("text"))
    small = _order(rows).select("conv_id", "turn", "present", symbol.alias("symbol"), letter.alias("letter"), "digest")
    # One shuffle: both orders below are within a conversation.
    earlier = F.row_number().over(Window.partitionBy("conv_id", "present", "digest").orderBy("turn"))
    small = small.repartition("conv_id").withColumn("seen", earlier > 1).sortWithinPartitions("conv_id", "turn", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            done = []
            for conv_id, present, *row in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "present", "turn", "symbol", "letter", "seen")]):
                if at is None or at.conv_id != conv_id:
                    if at is not None:
                        done.append(at.row())
                    at = _Signature(conv_id)
                if present:
                    at.add(*row)
            if done:
                yield _batch(done, SIGNATURES)
        if at is not None:
            yield _batch([at.row()], SIGNATURES)

    return map_arrow(small.drop("digest"), run, SIGNATURES)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


Node = tuple[tuple[int, ...], tuple[str, ...]]


def _with_inserts(cost: list[int], edit: list[str]) -> Node:
    """Best of each state, inserts included; two in a row only before the last states' own edits."""
    direct = list(zip(cost, edit))
    best = list(direct)
    best[USER] = min(direct[USER], (INSERT_COST + direct[ASSISTANT][0], INSERT))
    best[ASSISTANT] = min(direct[ASSISTANT], (INSERT_COST + direct[USER][0], INSERT))
    for state in (START, SYSTEM):
        best[state] = min(direct[state], (INSERT_COST + best[USER][0], INSERT))
    return tuple(c for c, _ in best), tuple(e for _, e in best)


_NEVER = 1 << 60
#: The node behind the last row: a conversation may end at the start or behind an assistant row.
END: Node = _with_inserts([0, _NEVER, _NEVER, 0], ["", "~", "~", ""])


def node(symbol: str, cost: tuple[int, ...]) -> Node:
    """The node from which ``symbol`` leads to one of these costs to go."""
    letter, cut = symbol.lower(), TRUNCATED_COST * symbol.isupper()
    found = []
    for state in range(4):
        best = (DELETE_COST + cost[state], DELETE)
        if symbol != GONE:
            best = min(best, (REROLE_COST + cut + cost[_PUT[state]], REROLE))
            if letter in _KEPT[state]:
                best = min(best, (cut + cost[_KEPT[state][letter]], KEEP))
        found.append(best)
    return _with_inserts([c for c, _ in found], [e for _, e in found])


def audits(reversed_signatures: Iterable[str]) -> Iterator[tuple[int, str]]:
    """Cost and audit of each signature; reversed signatures that share a beginning should be neighbours.

    ``path[i]`` is the node of the rest of ``i`` symbols, so what two neighbours share is kept.
    """
    path, before, answer = [END], "", None
    for text in reversed_signatures:
        if answer is None or text != before:
            shared, most = 0, min(len(text), len(before))
            while shared < most and text[shared] == before[shared]:
                shared += 1
            del path[shared + 1 :]
            for symbol in text[shared:]:
                path.append(node(symbol, path[-1][0]))
            before, answer = text, _walk(path, text)
        yield answer


def _walk(path: list[Node], text: str) -> tuple[int, str]:
    state, at, edits = START, len(text), []
    while True:
        edit = path[at][1][state]
        if not edit:
            return path[-1][0][START], "".join(edits)
        edits.append(edit)
        if edit in (INSERT, REROLE):
            state = _PUT[state]
        elif edit == KEEP:
            state = _KEPT[state][text[at - 1].lower()]
        at -= edit != INSERT


AUDITS = pa.schema([("signature", pa.string()), ("salt", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])


def best_audits(wanted: DataFrame) -> DataFrame:
    """Cost and audit of every ``(signature, salt)``."""
    rows = wanted.withColumn("_rest", F.reverse("signature"))
    rows = rows.repartitionByRange("_rest", "salt").sortWithinPartitions("_rest", "salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: list[pa.RecordBatch] = []

        def rests() -> Iterator[str]:
            for batch in batches:
                read[:] = [batch]
                yield from batch.column("_rest").to_pylist()

        found = audits(rests())
        done: list[tuple[int, str]] = []
        for answer in found:
            done.append(answer)
            if len(done) == read[0].num_rows:
                cost, audit = zip(*done)
                yield pa.RecordBatch.from_arrays([read[0].column("signature"), read[0].column("salt"), pa.array(cost, pa.int64()), pa.array(audit, pa.string())], schema=AUDITS)
                done = []

    return map_arrow(rows, run, AUDITS)


class _Repair:
    """One conversation's rows, edited as its audit says, into a digest."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.digest, self.first = audit, 0, START, hashlib.sha256(), True

    def _put(self, role: str, text: str) -> None:
        self.digest.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode())
        self.first = False

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == INSERT:
            self.state = _PUT[self.state]
            self._put(_ROLE[self.state], "")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == KEEP:
            self.state = _KEPT[self.state][role[0]]
            self._put(role, text)
        elif edit == REROLE:
            self.state = _PUT[self.state]
            self._put(_ROLE[self.state], text)

    def hexdigest(self) -> str:
        self._inserts()
        if self.at != len(self.audit):
            raise ValueError("An audit longer than its conversation")
        return self.digest.hexdigest()


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
REPAIRED = pa.schema([("conv_id", pa.int64())] + [(n, pa.int64()) for n in COUNTS] + [("audit", pa.string()), ("repaired_sha256", pa.string())])


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Every conversation repaired as planned, see :data:`REPAIRED`; its plan comes before its rows."""
    head = plans.select("conv_id", F.lit(0).alias("kind"), *COUNTS, "audit", *[F.lit(None).cast(t).alias(n) for n, t in (("turn", "bigint"), ("role", "string"), ("text", "string"), ("digest", "binary"))])
    body = _order(rows.where("present")).drop("present").withColumn("kind", F.lit(1))
    both = head.unionByName(body, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, repair = None, None
        for batch in batches:
            done = []
            columns = [batch.column(n).to_pylist() for n in ("kind", "role", "text", "conv_id", *COUNTS, "audit")]
            for kind, role, text, *head in zip(*columns):
                if kind:
                    repair.add(role, text)
                    continue
                if plan is not None:
                    done.append((*plan, repair.hexdigest()))
                plan, repair = head, _Repair(head[-1])
            if done:
                yield _batch(done, REPAIRED)
        if plan is not None:
            yield _batch([(*plan, repair.hexdigest())], REPAIRED)

    return map_arrow(both.drop("turn", "digest"), run, REPAIRED)


def repair(df: DataFrame) -> DataFrame:
    """Damage, faults, cheapest edits and repaired digest of every conversation; see :data:`REPAIRED`."""
    rows = damaged(df)
    found = signatures(rows).withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)))
    found = checkpointed(found)
    plans = found.join(best_audits(found.select("signature", "salt").distinct()), ["signature", "salt"])
    return repaired(rows, plans)
