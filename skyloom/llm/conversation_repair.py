"""Conversation structure repair: the cheapest edits that give a conversation the roles ``(s?(ua)+)?``, by A* on the edit lattice.

A row is kept, given another role, or deleted; rows without text may be inserted. A node of the lattice is how many rows are
done and what the roles so far allow next. Its heuristic is a suffix sum over the rows ahead: 4 for each that has to be deleted (blank, or
seen before), 3 for each truncated one, which is charged 3 if it stays and 4 if it goes. That never exceeds
what is left to pay, and never falls by more than an edge costs, so a node is done when it first leaves the queue. Nodes leave by (cost plus
heuristic, audit); of two edits of one cost the audit that is less in ASCII leaves first, and with it its continuations.

A conversation of any length is cut into stretches of ``STRETCH`` rows where it lies in a global order, so that a long one spreads over
tasks. Each stretch is searched from every state that can reach it; costs and audits of the stretches are put together in order,
and what all states share of the audit is set aside at once. Only the digest of the repaired text, one SHA-256 over all of it,
has to pass one conversation through one task; it does so row by row, and nothing of a conversation is held but its audit.

Null roles and texts are one space, as are null ids and turns in the damage key; a null id is a conversation of its own. Rows stand by turn
(nulls first), then by role and by the SHA-256 of the text, so repeated rows stand together. Roles other than system, user and assistant fit
nowhere unless their first letter does. A conversation that lost all rows, or an empty text, gives zeros, an empty audit and
the digest of nothing; an empty table gives an empty result. Extra columns of any name aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Rows of a conversation that are searched at once.
STRETCH = 256

# What edits cost, the part of damage, and the white space of the definition.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
DAMAGE = 20
SPACE = " \t\n\x0b\f\r"

#: What the roles so far allow: nothing yet, a system row, a user row last, an assistant row last. The first and the last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The state after a row of the only role that an insertion or a new role can have.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}

SOUND, GOES, CUT = range(3)


def search(initials: list[str], faults: list[int], start: int = START) -> dict[int, tuple[int, str]]:
    """For each state after the rows the least (cost, audit), by A* from ``start``. faults: SOUND, GOES (blank or duplicate) or CUT (truncated)."""
    n = len(initials)
    ahead = [0] * (n + 1)
    for k in range(n - 1, -1, -1):
        ahead[k] = ahead[k + 1] + (DELETE if faults[k] == GOES else min(TRUNCATED, DELETE) if faults[k] == CUT else 0)
    queue = [(ahead[0], "", 0, start)]
    done: set[tuple[int, int]] = set()
    found: dict[int, tuple[int, str]] = {}
    while queue and len(found) < STATES:
        total, audit, k, state = heappop(queue)
        if (k, state) in done:
            continue
        done.add((k, state))
        if k == n:
            found[state] = (total, audit)
        heappush(queue, (total + INSERT, audit + "I", k, NEXT[state]))
        if k == n:
            continue
        spent = total - ahead[k] + ahead[k + 1]
        heappush(queue, (spent + DELETE, audit + "D", k + 1, state))
        if faults[k] != GOES:
            spent += TRUNCATED if faults[k] == CUT else 0
            heappush(queue, (spent + REROLE, audit + "R", k + 1, NEXT[state]))
            kept = KEEP.get((state, initials[k]))
            if kept is not None:
                heappush(queue, (spent, audit + "K", k + 1, kept))
    return found


# ---------------------------------------------------------------- rows


def _order(turn: str | Column = "turn") -> Column:
    """Turns in order, nulls first."""
    turn = F.col(turn) if isinstance(turn, str) else turn
    return F.struct(turn.isNotNull().alias("given"), turn.alias("turn"))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): rows after damage, n times each; rows that were dropped stay with n = 0."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % DAMAGE
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text"))
    role = F.when(kind == 4, "user").otherwise(text_of("role"))
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("n"))


def _digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def marked(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, h, n, blank, truncated, seen) of rows (conv_id, turn, role, text, n): equal rows of a turn once, with their number.

    seen: an earlier turn has the role and text. Only texts that stand at several turns of a conversation are looked up, and they are
    sent along while they are few.
    """
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    own = rows.select("conv_id", "turn", "role", _digest().alias("h"), "n", (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("truncated"))
    lost = F.col("n") == 0
    blanked = own.select("conv_id", F.when(~lost, F.col("turn")).alias("turn"), F.when(~lost, F.col("role")).otherwise("").alias("role"), F.when(~lost, F.col("h")).otherwise(F.lit(b"")).alias("h"), "n", "blank", "truncated")
    once = blanked.groupBy("conv_id", "turn", "role", "h").agg(F.sum("n").alias("n"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated"))
    once = common.store(once, "turns")
    again = once.filter("n > 0").groupBy("conv_id", "role", "h").agg(F.min(_order()).alias("least"), F.count("*").alias("turns")).filter("turns > 1")
    again = common.store(again.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("h").alias("_h"), "least"), "again")
    found = once.join(common.small(again), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("h") == F.col("_h")), "left")
    return found.select("conv_id", "turn", "role", "h", "n", "blank", "truncated", F.coalesce(_order() > F.col("least"), F.lit(False)).alias("seen"))


# ---------------------------------------------------------------- stretches

_LEGAL = ("su", "ua", "au")


class _Stretch:
    """Rows of a conversation that follow each other: what is counted, and what the search needs."""

    def __init__(self, conv: object, starts: range):
        self.conv, self.starts = conv, starts
        self.initials: list[str] = []
        self.faults: list[int] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.low = self.high = None

    def add(self, initial: str, turn: int | None, blank: bool, duplicate: bool, truncated: bool) -> None:
        if turn is not None:
            self.turns += not self.turns or turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.initials and self.initials[-1] + initial not in _LEGAL:
            self.illegal += 1
        self.initials.append(initial)
        fault = GOES if blank or duplicate else CUT if truncated else SOUND
        self.faults.append(fault)
        self.blank += blank
        self.duplicate += duplicate and not blank
        self.truncated += fault == CUT

    def row(self) -> dict:
        found = {s: search(self.initials, self.faults, s) for s in self.starts}
        edges = [(s, t, *found[s][t]) for s in found for t in found[s]]
        ends = {"first": self.initials[0], "last": self.initials[-1]} if self.initials else {}
        counts = {c: getattr(self, c) for c in ("blank", "duplicate", "truncated", "illegal", "low", "high", "turns")}
        return {"conv_id": self.conv, "rows": len(self.initials), **counts, **ends, "from": [e[0] for e in edges], "to": [e[1] for e in edges], "cost": [e[2] for e in edges], "audit": [e[3] for e in edges]}


_EDGES = "from array<int>, to array<int>, cost array<long>, audit array<string>"
_COUNTS = "rows long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long"


def _table(rows: list[dict], fields: list[pa.Field]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in fields], schema=pa.schema(fields))


def _fields(conv: pa.DataType, ddl: str) -> list[pa.Field]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return [pa.field("conv_id", conv), *[pa.field(n, kinds[t]) for n, t in (x.split() for x in ddl.split(", "))]]


def stretches(found: DataFrame) -> DataFrame:
    """(conv_id, part, no, counts, edges): the stretches of :func:`marked` rows in order, searched.

    The first conversation of a part may go on from the part before, so it is searched from every state; others start at the start.
    """
    placed = found.select("conv_id", "turn", "role", "h", "n", "blank", "truncated", "seen", F.substring("role", 1, 1).alias("initial"))
    keys = ["conv_id", "turn", "role", "h"]
    ordered = placed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ddl = f"part int, no int, {_COUNTS}, {_EDGES}"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, now, fields = TaskContext.get().partitionId(), 0, None, None
        for b in it:
            out = []
            fields = fields or _fields(b.schema.field("conv_id").type, ddl)
            names = ("conv_id", "turn", "initial", "n", "blank", "truncated", "seen")
            for conv, turn, initial, n, blank, truncated, seen in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                if now is None or now.conv != conv:
                    every = now is None
                    if now is not None:
                        out.append(now.row() | {"part": part, "no": no})
                        no += 1
                    now = _Stretch(conv, range(STATES) if every else range(1))
                for k in range(n):
                    if len(now.initials) == STRETCH:
                        out.append(now.row() | {"part": part, "no": no})
                        no += 1
                        now = _Stretch(conv, range(STATES))
                        if len(out) >= 64:
                            yield _table(out, fields)
                            out = []
                    now.add(initial, turn, blank, seen or k > 0, truncated)
            if out:
                yield _table(out, fields)
        if now is not None:
            yield _table([now.row() | {"part": part, "no": no}], fields)

    kind = found.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(run, f"conv_id {kind}, {ddl}")


# ---------------------------------------------------------------- conversations


class _Whole:
    """A conversation, put together from its stretches in order."""

    def __init__(self, conv: object):
        self.conv, self.best, self.shared = conv, {START: (0, "")}, []
        self.counts = dict.fromkeys(("rows", "blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.last, self.low, self.high = None, None, None

    def add(self, r: dict) -> None:
        if self.last is not None and r["rows"] and self.last + r["first"] not in _LEGAL:
            self.counts["illegal"] += 1
        if r["low"] is not None:
            # a turn that two stretches share counts once
            self.counts["turns"] -= self.high is not None and r["low"] == self.high
            self.low, self.high = r["low"] if self.low is None else self.low, r["high"]
        for c in self.counts:
            self.counts[c] += r[c]
        self.last = r["last"] if r["rows"] else self.last
        new: dict[int, tuple[int, str]] = {}
        for a, b, cost, audit in zip(r["from"], r["to"], r["cost"], r["audit"], strict=True):
            if a in self.best:
                way = (self.best[a][0] + cost, self.best[a][1] + audit)
                new[b] = min(new.get(b, way), way)
        # audits of all states begin alike; what they share decides nothing any more
        same = commonprefix([audit for _, audit in new.values()])
        self.shared.append(same)
        self.best = {s: (cost, audit[len(same) :]) for s, (cost, audit) in new.items()}

    def row(self) -> dict:
        cost, audit = min(self.best[s] for s in (START, ASSISTANT) if s in self.best)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.counts["turns"]
        return {"conv_id": self.conv, "gaps": gaps, **{c: self.counts[c] for c in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": "".join(self.shared) + audit}


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def whole(parts: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of :func:`stretches`."""
    kind = parts.schema["conv_id"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fields = None, None
        for b in it:
            fields = fields or _fields(b.schema.field("conv_id").type, _RESULT)
            out = []
            for r in b.to_pylist():
                if now is None or now.conv != r["conv_id"]:
                    if now is not None:
                        out.append(now.row())
                    now = _Whole(r["conv_id"])
                now.add(r)
            yield _table(out, fields)
        if now is not None:
            yield _table([now.row()], fields)

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no").mapInArrow(run, f"conv_id {kind}, {_RESULT}")


class _Repaired:
    """The digest of a conversation's repaired rows, which pass one by one."""

    def __init__(self, header: dict):
        self.header, self.at, self.state, self.sha, self.any = header, 0, START, hashlib.sha256(), False

    def _put(self, role: str, text: str) -> None:
        self.sha.update(("\n" if self.any else "").encode() + role.encode() + b":" + text.encode())
        self.any = True

    def _inserted(self) -> None:
        while self.header["audit"][self.at : self.at + 1] == "I":
            self.state = NEXT[self.state]
            self._put(NAMES[self.state], "")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self._inserted()
        edit = self.header["audit"][self.at]
        self.at += 1
        if edit == "K":
            self.state = KEEP[self.state, role[:1]]
            self._put(role, text)
        elif edit == "R":
            self.state = NEXT[self.state]
            self._put(NAMES[self.state], text)

    def row(self) -> dict:
        self._inserted()
        return self.header | {"repaired_sha256": self.sha.hexdigest()}


def with_digest(found: DataFrame, rows: DataFrame) -> DataFrame:
    """:func:`whole` with repaired_sha256; rows: the damaged ones. A conversation's audit comes first, then its rows in order."""
    kind = found.schema["conv_id"].dataType.simpleString()
    texts = rows.filter("n > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", _digest().alias("h"), "n", "text")
    heads = found.withColumn("kind", F.lit(0))
    both = heads.unionByName(texts, allowMissingColumns=True)
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "h")
    ddl = f"{_RESULT}, repaired_sha256 string"
    header = [f.split()[0] for f in f"conv_id x, {_RESULT}".split(", ")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fields = None, None
        for whole_batch in it:
            fields = fields or _fields(whole_batch.schema.field("conv_id").type, ddl)
            for b in common.lots(iter([whole_batch])):
                out = []
                for r in b.to_pylist():
                    if r["kind"] == 0:
                        if now is not None:
                            out.append(now.row())
                        now = _Repaired({c: r[c] for c in header})
                    else:
                        for _ in range(r["n"]):
                            now.add(r["role"], r["text"])
                yield _table(out, fields)
        if now is not None:
            yield _table([now.row()], fields)

    return ordered.mapInArrow(run, f"conv_id {kind}, {ddl}")


def repair(rows: DataFrame) -> DataFrame:
    """The repair of every conversation of rows (conv_id, turn, role, text, n); a row counts n times, 0 only names its conversation."""
    parts = common.store(stretches(common.store(marked(rows), "conversation-rows")), "stretches")
    return with_digest(whole(parts), rows)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def _widened(key: str, add: str, letter: str) -> str:
    return f"lpad(CAST(CAST({key}[1:12] AS BIGINT) + {add} AS VARCHAR), 12, '0') || {key}[13:] || '{letter}'"


#: Each state's least (cost, audit) as a text that sorts like them, row by row; two insertions at most fit between rows.
_INSERTED = "SELECT {keep}, s0, s1, least(s2, {a}, {b}, {c}) AS s2, least(s3, {d}) AS s3 FROM {of}"


def _insert(name: str, of: str) -> str:
    w = lambda s: _widened(s, "3", "I")
    return f"{name} AS ({_INSERTED.format(keep='*EXCLUDE(s0, s1, s2, s3)', a=w('s0'), b=w('s1'), c=w('s3'), d=w('s2'), of=of)})"


def _step(state: str, moves: list[tuple[str, str, str]]) -> str:
    """least over deleting, and over moves (from, letter, condition)."""
    cut = "(CASE WHEN fault = 'c' THEN 3 ELSE 0 END)"
    ways = [_widened(state, "4", "D")]
    for source, letter, when in moves:
        cost = cut if letter == "K" else f"(3 + {cut})"
        ways.append(f"CASE WHEN fault <> 'x' AND {when} THEN {_widened(source, cost, letter)} END")
    return f"least({', '.join(ways)}) AS {state}"


_AHEAD = ", ".join(
    [
        _step("s0", []),
        _step("s1", [("s0", "K", "i = 's'")]),
        _step("s2", [(s, "K", "i = 'u'") for s in ("s0", "s1", "s3")] + [(s, "R", "true") for s in ("s0", "s1", "s3")]),
        _step("s3", [("s2", "K", "i = 'a'"), ("s2", "R", "true")]),
    ]
)
_BITS = "list_reduce(list_prepend({x}, range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
_CRC = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT)), lambda c, b: {_BITS.format(x='xor(c, b)')}), 4294967295)"

#: The lattice as a recursive walk over rows instead of a queue.
SQL11 = rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
o AS (SELECT *, role[1:1] AS i, row_number() OVER w AS r, lag(role[1:1]) OVER w AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM d
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'none' END AS kind FROM o),
g AS (SELECT conv_id, r, i, CASE kind WHEN 'blank' THEN 'x' WHEN 'duplicate' THEN 'x' WHEN 'truncated' THEN 'c' ELSE 'n' END AS fault FROM f),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(kind = 'blank') AS blank, count_if(kind = 'duplicate') AS duplicate, count_if(kind = 'truncated') AS truncated,
  count_if(before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal, max(r) AS rows FROM f GROUP BY conv_id),
c AS (SELECT DISTINCT conv_id FROM conversations),
walk AS (
  SELECT conv_id, 0::BIGINT AS r, '000000000000' AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM c
  UNION ALL
  (WITH {_insert('i1', 'walk')}, {_insert('i2', 'i1')}
  SELECT i2.conv_id, i2.r + 1 AS r, {_AHEAD} FROM i2 JOIN g ON g.conv_id IS NOT DISTINCT FROM i2.conv_id AND g.r = i2.r + 1)),
e1 AS (SELECT walk.* FROM walk LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM walk.conv_id WHERE walk.r = coalesce(n.rows, 0)), {_insert('e2', 'e1')}, {_insert('e3', 'e2')},
b AS (SELECT conv_id, least(s0, s3) AS best FROM e3),
a AS (SELECT conv_id, CAST(best[1:12] AS BIGINT) AS cost, best[13:] AS audit FROM b),
x AS (SELECT conv_id, p, audit[p] AS edit, len(regexp_replace(audit[1:p], 'I', '', 'g')) AS r, len(regexp_replace(audit[1:p], 'D', '', 'g')) AS q FROM (SELECT *, unnest(range(1, len(audit) + 1)) AS p FROM a)),
y AS (SELECT x.conv_id, p, q, edit, f.role, f.text, coalesce(bool_or(edit = 'K' AND q = 1 AND f.i = 's') OVER (PARTITION BY x.conv_id), false)::INT AS sys FROM x LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM x.conv_id AND f.r = x.r AND x.edit <> 'I' WHERE edit <> 'D'),
z AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (q - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS repaired FROM y GROUP BY conv_id)
SELECT c.conv_id, {', '.join(f'CAST(coalesce({x}, 0) AS BIGINT) AS {x}' for x in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal'))},
  a.cost, a.audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM c JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id
"""
