"""Repair of the order of speakers in conversations by error-correcting Earley parsing.

The grammar of roles is weighted and left-recursive: besides its own productions it has, for
every head, a delete production, and for every role that may be supplied a rerole and an insert
production. All items of the chart therefore start at the first row, so a chart column holds one
completed item a head, whatever the length of the conversation. An item keeps the least
(cost, audit) with which the rows so far can be read as its head: costs are compared as
numbers, audits by rank, as two equally dear readings of the same rows are never a part of one
another. The completed chart, followed back from the cheapest goal, is the audit; each item also
carries the digest of the repaired lines, so texts pass through once and are not kept.

Rows are shuffled once, by conversation; a task reads its conversations row after row in sorted
order (the sort spills), and keeps a reference for each row of the one it is in. A conversation is
not split, as its digest is a hash over all its lines in order.

Defined results: null roles and texts are one space; null conversation ids are one
conversation; null turns come first; rows of one turn are ordered by role, then text; empty and blank texts
are blank rows; a conversation of which no row is left has zeros, an empty audit and the digest of the
empty string; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pluvia.llm.common import SPACE

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
#: What a truncated row costs if it stays.
TRUNCATED_COST = 1
NONE, BLANK, DUPLICATE, TRUNCATED = 0, 1, 2, 3
#: Role initials that may stand side by side.
LEGAL = frozenset({"su", "ua", "au"})


@dataclass(frozen=True)
class Grammar:
    """Left-linear: each production reads head -> before role. supplied: initial -> role that may be
    given to a row or inserted. The first of starts is empty at row 0."""

    productions: tuple[tuple[str, str, str], ...]
    start: str
    goals: tuple[str, ...]
    supplied: tuple[tuple[str, str], ...]

    @property
    def heads(self) -> tuple[str, ...]:
        return tuple(sorted({self.start} | {p[0] for p in self.productions}))


#: (s?(ua)+)?
DIALOGUE = Grammar(
    productions=(("opening", "nothing", "s"), ("asked", "nothing", "u"), ("asked", "opening", "u"), ("asked", "answered", "u"), ("answered", "asked", "a")),
    start="nothing",
    goals=("nothing", "answered"),
    supplied=(("u", "user"), ("a", "assistant")),
)

#: A completed item: head, cost above the cheapest one, rank of its audit.
Item = tuple[str, int, int]


@dataclass(frozen=True)
class Step:
    """How one item of the next column came about: from which item, by which letters of the audit
    (inserts before the row, then what was done with it), and the roles of the lines it adds (None: the row's own)."""

    item: Item
    parent: int
    letters: str
    lines: tuple[str | None, ...]


class Chart:
    """Columns of an Earley chart; what follows from a column and a row's kind is worked out once."""

    def __init__(self, grammar: Grammar = DIALOGUE, size: int = 1 << 16):
        self.grammar = grammar
        self.supplied = dict(grammar.supplied)
        self.advance: Callable = lru_cache(size)(self._advance)
        self.complete: Callable = lru_cache(size)(self._complete)

    @property
    def first(self) -> tuple[Item, ...]:
        return ((self.grammar.start, 0, 0),)

    def _predicted(self, column: tuple[Item, ...]) -> dict[str, tuple]:
        """head -> (cost, rank, letters, parent, lines) of a column, insert productions applied."""
        best = {head: (cost, rank, "", i, ()) for i, (head, cost, rank) in enumerate(column)}
        moved = True
        while moved:
            moved = False
            for head, before, role in self.grammar.productions:
                if role in self.supplied and before in best:
                    cost, rank, letters, parent, lines = best[before]
                    new = (cost + INSERT, rank, letters + "I", parent, (*lines, self.supplied[role]))
                    if head not in best or new[:3] < best[head][:3]:
                        best[head], moved = new, True
        return best

    def _advance(self, column: tuple[Item, ...], initial: str, fault: int) -> tuple[int, tuple[Step, ...]]:
        """(cost that all items share, steps to the next column) for a row."""
        found: dict[str, tuple] = {}

        def offer(head: str, source: tuple, cost: int, letter: str, line: tuple) -> None:
            new = (source[0] + cost, source[1], source[2] + letter, source[3], source[4] + line)
            if head not in found or new[:3] < found[head][:3]:
                found[head] = new

        predicted = self._predicted(column)
        for head, source in predicted.items():
            offer(head, source, DELETE, "D", ())
        if fault not in (BLANK, DUPLICATE):
            extra = TRUNCATED_COST if fault == TRUNCATED else 0
            for head, before, role in self.grammar.productions:
                if before not in predicted:
                    continue
                if initial == role:
                    offer(head, predicted[before], KEEP + extra, "K", (None,))
                if role in self.supplied:
                    offer(head, predicted[before], REROLE + extra, "R", (self.supplied[role],))
        least = min(f[0] for f in found.values())
        order = {key: i for i, key in enumerate(sorted({f[1:3] for f in found.values()}))}
        return least, tuple(Step((h, f[0] - least, order[f[1:3]]), f[3], f[2], f[4]) for h, f in sorted(found.items()))

    def _complete(self, column: tuple[Item, ...]) -> tuple[int, int, str, tuple]:
        """(cost, item, last letters, last lines) of the cheapest goal."""
        cost, _, letters, parent, lines = min(v for h, v in self._predicted(column).items() if h in self.grammar.goals)
        return cost, parent, letters, lines


class _Conversation:
    """What is kept of the conversation being read."""

    def __init__(self, chart: Chart, key: object):
        self.chart, self.key = chart, key
        self.column, self.digests = chart.first, [(hashlib.sha256(), True)]
        self.back: list[tuple[Step, ...]] = []
        self.cost = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.last = None
        self.initial: str | None = None

    def read(self, turn: int | None, role: str, text: str, fault: int) -> None:
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.illegal += 1
        self.initial = initial
        self.blank += fault == BLANK
        self.duplicate += fault == DUPLICATE
        self.truncated += fault == TRUNCATED
        if turn is not None and turn != self.last:
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.last = turn
        shared, steps = self.chart.advance(self.column, initial, fault)
        self.digests = [_extended(self.digests[s.parent], s.lines, role, text) for s in steps]
        self.column = tuple(s.item for s in steps)
        self.cost += shared
        self.back.append(steps)

    def result(self) -> dict:
        more, at, letters, lines = self.chart.complete(self.column)
        digest = _extended(self.digests[at], lines, "", "")[0].hexdigest()
        audit = [letters]
        for steps in reversed(self.back):
            audit.append(steps[at].letters)
            at = steps[at].parent
        return {
            "conv_id": self.key,
            "gaps": self.last - self.least + 1 - self.turns if self.turns else 0,
            "blank": self.blank,
            "duplicate": self.duplicate,
            "truncated": self.truncated,
            "illegal": self.illegal,
            "cost": self.cost + more,
            "audit": "".join(reversed(audit)),
            "repaired_sha256": digest,
        }


def _extended(digest: tuple, lines: tuple[str | None, ...], role: str, text: str) -> tuple:
    """A digest (hash so far, no line yet) with lines added; the given one is left as it is."""
    if not lines:
        return digest
    known, empty = digest[0].copy(), digest[1]
    for i, line in enumerate(lines):
        own = i == len(lines) - 1
        body = f"{role if line is None else line}:{text if own else ''}"
        known.update(("" if empty else "\n").encode() + body.encode())
        empty = False
    return known, empty


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone, copy: rows after the damage that crc32(conv_id:turn) % 20
    tells. Dropped rows stay, marked gone, so that no conversation is lost."""
    kind = F.crc32(F.encode(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]), "UTF-8")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return rows.select(
        "conv_id",
        F.when(kind != 0, F.col("turn").cast("long")).alias("turn"),
        F.when(kind == 0, "").when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.sequence(F.lit(0), (kind == 3).cast("int"))).alias("copy"),
    )


def _fault(bare: Column, again: Column) -> Column:
    last = F.substring(bare, -1, 1)
    return F.when(F.length(bare) == 0, BLANK).when(again > 1, DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(NONE)


def repaired(rows: DataFrame, grammar: Grammar = DIALOGUE) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256. rows: conv_id, turn, role, text, gone, copy (see damaged).

    The window and the sort need the conversation's rows in one place and use the same shuffle.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    again = F.row_number().over(W.partitionBy("conv_id", "gone", "role", "text").orderBy(F.asc_nulls_first("turn"), "copy"))
    found = rows.repartition("conv_id").withColumn("again", again)
    found = found.withColumn("fault", _fault(F.rtrim("text", F.lit(SPACE)), F.col("again"))).drop("again")
    found = found.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "copy")
    schema = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chart, held, out = Chart(grammar), None, []
        shape: pa.Schema | None = None

        def flushed() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pylist(out, schema=shape)
            out.clear()
            return made

        for batch in batches:
            if shape is None:
                longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
                shape = pa.schema([("conv_id", batch.schema.field("conv_id").type), *[(c, pa.int64()) for c in longs], ("audit", pa.string()), ("repaired_sha256", pa.string())])
            for part in (batch.slice(at, 4096) for at in range(0, batch.num_rows, 4096)):
                columns = [part.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "fault")]
                for key, turn, role, text, gone, fault in zip(*columns, strict=True):
                    if held is None or held.key != key:
                        if held is not None:
                            out.append(held.result())
                        held = _Conversation(chart, key)
                    if not gone:
                        held.read(turn, role, text, fault)
                if out:
                    yield flushed()
        if held is not None:
            out.append(held.result())
            yield flushed()

    return found.mapInArrow(run, schema)


def repairs(conversations: DataFrame) -> DataFrame:
    """Damage, then repair, of every conversation."""
    return repaired(damaged(conversations))
