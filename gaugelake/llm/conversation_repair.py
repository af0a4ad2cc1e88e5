"""Conversation structure repair: cheapest edits by Four-Russians block tables.

Turns are kept (cost 0), get the role user or assistant (1) or are deleted (2; blank turns and
repeats must be), and empty turns can be inserted (5), so that the initials of the roles read
``(s?(ua)+)?``. A truncated turn that stays costs 5 more. What is left of a conversation costs,
from each of four states, one number; less the least of them there are only some dozens of such
vectors. A table gives, for every vector and every block of four turns (nine kinds of turn), the
vector before the block and its cost. Conversations are worked through from their end by
lookups, keeping the vector at each block border; then each block is expanded backward from its
border and the edits are read forward, the least letter first among equally cheap ones.

Spark does the rest. Repeats are found by the earliest turn of every (conversation, role, text).
Turns without their texts are ordered by range partitions, so a conversation of any length is
spread over tasks, and become segments of one byte a turn with counts. Segments and texts of a
conversation then stream through one task in order: it holds one byte a turn, as long as the
audit it returns, and no text but the current one. The digest of a whole conversation is a
sequential function, which is why its texts pass through one task.

Results: a null conv_id is a conversation; null turns come first. Turns of equal number are
ordered by role and a hash of the text. Null roles and texts are one space: a role without
meaning, a blank text. Texts are told apart by 128-bit hashes. Other columns are left out,
whatever their names. Conversations named in ``ids`` without turns have zeros, an empty audit
and the digest of nothing. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelake.llm import common

BLOCK_TURNS = 4
KEEP, RENAME, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

# Kinds of turn: 0 must go; 1 + 2 * initial + truncated for the initials s, u, a and others.
_KINDS = 9
_INITIALS = {"s": 0, "u": 1, "a": 2}
_OTHER = 3
# States: nothing yet, after a system turn, after a user turn, after an assistant turn.
_STATES = 4
_FILL = (2, 2, 3, 2)
_FILL_ROLE = ("user", "user", "assistant", "user")
_KEPT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}
_LAST = ("", "II", "I", "")


def _inserted(costs: list[int]) -> tuple[int, ...]:
    """Costs when turns may be inserted first; two of them reach every state that can be reached."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[_FILL[q]]) for q, c in enumerate(costs)]
    return tuple(costs)


def _ways(kind: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what can be done with a turn, by letter."""
    ways = [("D", DELETE, state)]
    if kind:
        initial, truncated = divmod(kind - 1, 2)
        if (state, initial) in _KEPT:
            ways.append(("K", KEEP + TRUNCATED * truncated, _KEPT[state, initial]))
        ways.append(("R", RENAME + TRUNCATED * truncated, _FILL[state]))
    return ways


class Tables:
    """Vectors of remaining costs (less their least), steps between them, and block steps."""

    def __init__(self):
        start = _inserted([0, 10**6, 10**6, 0])
        self.vectors = [start]
        number = {start: 0}
        steps, costs, self.choices = [], [], []
        at = 0
        while at < len(self.vectors):
            after = self.vectors[at]
            row = []
            for kind in range(_KINDS):
                before = _inserted([min(c + after[to] for _, c, to in _ways(kind, q)) for q in range(_STATES)])
                least = min(before)
                vector = tuple(c - least for c in before)
                if vector not in number:
                    number[vector] = len(self.vectors)
                    self.vectors.append(vector)
                row.append((number[vector], least, [self._choice(kind, q, before, after) for q in range(_STATES)]))
            steps.append([r[0] for r in row])
            costs.append([r[1] for r in row])
            self.choices.append([r[2] for r in row])
            at += 1
        self.steps = steps
        step, cost = np.array(steps), np.array(costs)
        blocks = np.arange(_KINDS**BLOCK_TURNS)
        now = np.repeat(np.arange(len(steps))[:, None], len(blocks), 1)
        total = np.zeros_like(now)
        for place in range(BLOCK_TURNS - 1, -1, -1):
            kind = blocks // _KINDS**place % _KINDS
            total += cost[now, kind]
            now = step[now, kind]
        self.block_step, self.block_cost = now, total
        self.costs = costs

    @staticmethod
    def _choice(kind: int, state: int, before: tuple, after: tuple) -> tuple[str, int]:
        """Letters up to and with the one that uses the turn up, and the state then."""
        letters = ""
        while True:
            for letter, cost, to in sorted([*_ways(kind, state), ("I", INSERT, _FILL[state])]):
                rest = before[to] if letter == "I" else after[to]
                if before[state] == cost + rest:
                    break
            letters, state = letters + letter, to
            if letter != "I":
                return letters, state


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def cheapest(kinds: np.ndarray) -> tuple[int, str]:
    """(cost, edits) for the kinds of turn of one conversation."""
    of = tables()
    whole = len(kinds) // BLOCK_TURNS
    codes = kinds[: whole * BLOCK_TURNS].reshape(whole, BLOCK_TURNS) @ _KINDS ** np.arange(BLOCK_TURNS)
    vector, cost = 0, 0
    for kind in kinds[whole * BLOCK_TURNS :][::-1].tolist():
        cost += of.costs[vector][kind]
        vector = of.steps[vector][kind]
    borders = np.empty(whole + 1, np.int16)
    borders[whole] = vector
    for k in range(whole - 1, -1, -1):
        code = codes[k]
        cost += int(of.block_cost[vector, code])
        vector = of.block_step[vector, code]
        borders[k] = vector
    cost += of.vectors[vector][0]
    state, audit = 0, []
    for k in range(whole + 1):
        block = kinds[k * BLOCK_TURNS : (k + 1) * BLOCK_TURNS].tolist()
        after = [int(borders[k + 1]) if k < whole else 0]
        for kind in block[:0:-1]:
            after.append(of.steps[after[-1]][kind])
        for kind, vector in zip(block, reversed(after), strict=False):
            letters, state = of.choices[vector][kind][state]
            audit.append(letters)
    return cost, "".join(audit) + _LAST[state]


def plain(turns: DataFrame) -> DataFrame:
    """The columns used, without nulls: key, has_turn, turn, role, text and two hashes of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return turns.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("key"),
        F.col("turn").isNotNull().alias("has_turn"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        text.alias("text"),
        F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"),
    )


_ORDER = ["key", "has_turn", "turn", "role", "k1", "k2"]
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
_SEGMENT = (
    "key string, place long, kinds binary, blank long, duplicate long, truncated long, illegal long, turns long, "
    "first_initial int, last_initial int, first_turn long, last_turn long"
)


def _faults(rows: DataFrame) -> DataFrame:
    """One row for equal turns: how many, whether blank, truncated, and seen at an earlier turn."""
    bare = F.expr("trim(TRAILING ' \\t\\n\\u000b\\u000c\\r' FROM text)")
    compact = rows.select(
        *_ORDER, (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated")
    ).groupBy(*_ORDER).agg(F.count("*").alias("n"), F.max("blank").alias("blank"), F.max("truncated").alias("truncated"))
    same = ["key", "role", "k1", "k2"]
    first = compact.groupBy(*same).agg(F.min(F.struct("has_turn", "turn")).alias("first"))
    return compact.join(first, same).select(
        *_ORDER, "n", "blank", "truncated", (F.col("first") != F.struct("has_turn", "turn")).alias("again")
    )


def _segments(batches):
    """Ordered rows of ``_faults`` as one packed row for each conversation and batch."""
    from pyspark import TaskContext

    place = TaskContext.get().partitionId() << 40
    schema = common.schema_of(_SEGMENT)
    for batch in batches:
        if not len(batch):
            continue
        key, has_turn, turn, role, _, _, n, blank, truncated, again = batch.columns
        # Equal keys are neighbours.
        runs = key.dictionary_encode()
        head = np.ones(len(batch), bool)
        head[1:] = np.diff(runs.indices.to_numpy()) != 0
        has_turn, turn, n, blank, truncated, again = (
            c.to_numpy(zero_copy_only=False) for c in (has_turn, turn, n, blank, truncated, again)
        )
        initial = np.array([_INITIALS.get(r[:1], _OTHER) for r in role.to_pylist()], np.int64)
        out = blank | again
        legal = (initial[:-1] + 1 == initial[1:]) & (initial[1:] < _OTHER) | (initial[:-1] == 2) & (initial[1:] == 1)
        illegal = np.zeros(len(batch), np.int64)
        illegal[1:] = ~legal & ~head[1:]
        illegal += n - 1  # equal initials side by side
        new_turn = has_turn & (head | np.concatenate([[True], (turn[1:] != turn[:-1]) | ~has_turn[:-1]]))
        starts = np.flatnonzero(head)
        stops = np.append(starts[1:], len(batch))
        kinds = np.repeat(np.where(out, 0, 1 + 2 * initial + truncated).astype(np.uint8), n)
        ends = np.cumsum(n)
        kinds[np.setdiff1d(np.arange(len(kinds)), ends - n, assume_unique=True)] = 0
        bounds = np.concatenate([[0], ends[stops - 1]])
        summed = [np.add.reduceat(x.astype(np.int64), starts) for x in (
            n * blank, np.where(blank, 0, n - 1 + again), ~out & truncated, illegal, new_turn)]
        dated = np.add.reduceat(has_turn.astype(np.int64), starts)
        first_turn = [int(turn[b - d]) if d else None for b, d in zip(stops.tolist(), dated.tolist(), strict=True)]
        last_turn = [int(turn[b - 1]) if d else None for b, d in zip(stops.tolist(), dated.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([
            key.take(pa.array(starts)), pa.array(place + np.arange(len(starts))),
            pa.array([kinds[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
            *(pa.array(x) for x in summed), pa.array(initial[starts], pa.int32()), pa.array(initial[stops - 1], pa.int32()),
            pa.array(first_turn, pa.int64()), pa.array(last_turn, pa.int64()),
        ], schema=schema)
        place += len(starts)


class _Conversation:
    """Segments of one conversation as they come, then its texts in order."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.first_turn = self.last_turn = self.last_initial = None
        self.kinds: list[bytes] = []
        self.audit = None
        self.cost = self.at = self.state = 0

    def segment(self, s: dict) -> None:
        for name in _COUNTS:
            self.counts[name] += s[name]
        if self.last_initial is not None and (self.last_initial, s["first_initial"]) not in ((0, 1), (1, 2), (2, 1)):
            self.counts["illegal"] += 1
        self.last_initial = s["last_initial"]
        if s["first_turn"] is not None:
            self.counts["turns"] -= self.last_turn == s["first_turn"]
            self.first_turn = s["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = s["last_turn"]
        self.kinds.append(s["kinds"])

    def _solve(self) -> None:
        if self.audit is None:
            self.cost, self.audit = cheapest(np.frombuffer(b"".join(self.kinds), np.uint8).astype(np.int64))
            self.kinds = []

    def _step(self, role: str | None):
        """Edits up to the one that uses a turn up (or to the end), as (letter, role)."""
        while self.at < len(self.audit):
            letter = self.audit[self.at]
            if role is None and letter != "I":
                raise ValueError("more edits than turns")
            self.at += 1
            if letter == "K":
                self.state = _KEPT[self.state, _INITIALS[role[:1]]]
                yield letter, role
            elif letter == "D":
                yield letter, role
            else:
                filled = _FILL_ROLE[self.state]
                self.state = _FILL[self.state]
                yield letter, filled
            if letter != "I":
                return

    def turn(self, role: str, text: str):
        """(letter, role, text) of inserted turns and then of this one."""
        self._solve()
        for letter, new in self._step(role):
            yield letter, new, "" if letter == "I" else text

    def end(self):
        self._solve()
        for letter, new in self._step(None):
            yield letter, new, ""

    def gaps(self) -> int:
        return 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.counts["turns"]


_HEAD, _PACKED, _TEXT = 0, 1, 2
_SEGMENT_FIELDS = [f.split()[0] for f in _SEGMENT.split(", ")][2:]


def _stream(turns: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Per conversation, in order in one partition: its id, its segments, its texts."""
    rows = plain(turns)
    faults = _faults(rows)
    parts = common.partitions_for(turns)
    ranged = faults.repartitionByRange(parts, *_ORDER).sortWithinPartitions(*_ORDER)
    segments = ranged.mapInArrow(_segments, _SEGMENT)
    conv_id = F.col("conv_id").cast("long")
    named = turns.select("conv_id") if ids is None else ids.select("conv_id").unionByName(turns.select("conv_id"))
    heads = named.select(conv_id.alias("conv_id")).distinct().select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("key"), F.lit(_HEAD).alias("part"), "conv_id")
    packed = segments.select("key", F.lit(_PACKED).alias("part"), "place", F.struct(*_SEGMENT_FIELDS).alias("segment"))
    texts = rows.select(F.lit(_TEXT).alias("part"), "text", *_ORDER)
    every = heads.unionByName(packed, True).unionByName(texts, True)
    return every.repartition(parts, "key").sortWithinPartitions("key", "part", "place", *_ORDER[1:]).select(
        "part", "conv_id", "segment", "role", "text")


def _conversations(batches, on_turn, on_end):
    """Drive one ``_Conversation`` after the other; yields what the two functions give."""
    now = None
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(5)]
        for part, conv_id, segment, role, text in zip(*columns, strict=True):
            if part == _HEAD:
                if now is not None:
                    yield from on_end(now)
                now = _Conversation(conv_id)
            elif part == _PACKED:
                now.segment(segment)
            else:
                yield from on_turn(now, now.turn(role, text))
    if now is not None:
        yield from on_end(now)


_REPORT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)
_TURNS = "conv_id long, place long, edit string, role string, text string"


def _batched(rows, schema: pa.Schema, most: int = 4_096):
    out: list[tuple] = []
    for row in rows:
        out.append(row)
        if len(out) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def repair_report(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Per conversation its faults, the cost and letters of the cheapest edits and the SHA-256 of
    what they leave (lines ``role:text``). ``ids`` names conversations that may have no turns."""

    def task(batches):
        digest, empty = hashlib.sha256(), True

        def on_turn(_, edits):
            nonlocal empty
            for letter, role, text in edits:
                if letter != "D":
                    digest.update(("" if empty else "\n").encode() + f"{role}:{text}".encode())
                    empty = False
            return ()

        def on_end(conv):
            nonlocal digest, empty
            on_turn(conv, conv.end())
            yield (conv.conv_id, conv.gaps(), *(conv.counts[c] for c in _COUNTS[:4]), conv.cost, conv.audit, digest.hexdigest())
            digest, empty = hashlib.sha256(), True

        yield from _batched(_conversations(batches, on_turn, on_end), common.schema_of(_REPORT))

    return _stream(turns, ids).mapInArrow(task, _REPORT)


def repaired(turns: DataFrame) -> DataFrame:
    """The repaired conversations: one row a turn left, with its place, edit (K, R or I), role and text."""

    def task(batches):
        place = 0

        def on_turn(conv, edits):
            nonlocal place
            for letter, role, text in edits:
                if letter != "D":
                    yield conv.conv_id, place, letter, role, text
                    place += 1

        def on_end(conv):
            nonlocal place
            yield from on_turn(conv, conv.end())
            place = 0

        yield from _batched(_conversations(batches, on_turn, on_end), common.schema_of(_TURNS))

    return _stream(turns, None).mapInArrow(task, _TURNS)


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with faults by a hash of their place: dropped, emptied, cut, repeated or renamed."""
    space = F.lit(" ")
    name = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    text, role = (F.coalesce(F.col(c).cast("string"), space) for c in ("text", "role"))
    h = F.col("h")
    return (
        conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(name.cast("binary")) % 20).alias("h"))
        .where("h <> 0")
        .select(
            "conv_id", "turn", F.when(h == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(h == 1, "").when(h == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
            F.explode(F.when(h == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
        )
        .drop("copy")
    )


def _sql() -> str:
    """The same by carrying, for each state, the cheapest 'cost audit text' as one string that sorts."""
    none = "999999999"

    def step(value: str, cost: str, letter: str, line: str) -> str:
        """``value`` after an edit; ``line`` is what it leaves, or null."""
        at = f"strpos({value}, chr(1))"
        text = f"substr({value}, {at} + 1)"
        longer = f"{text} || coalesce(case when {text} = '' then '' else chr(2) end || {line}, '')"
        return (f"case when left({value}, 9) = '{none}' then '{none}' else lpad((left({value}, 9)::int + {cost})::varchar, 9, '0') "
                f"|| substr({value}, 10, {at} - 10) || '{letter}' || chr(1) || {longer} end")

    def inserted(v: str) -> str:
        """One round of insertions before a turn or the end."""
        new = []
        for q in range(_STATES):
            ways = [f"{v}.s{q}"] + [
                step(f"{v}.s{p}", str(INSERT), "I", f"'{_FILL_ROLE[p]}:'") for p in range(_STATES) if _FILL[p] == q]
            new.append(f"'s{q}': least({', '.join(ways)})")
        return f"{{{', '.join(new)}}}"

    def turn(v: str, r: str) -> str:
        entries = []
        for q in range(_STATES):
            ways = [step(f"{v}.s{q}", str(DELETE), "D", "null")]
            for (p, initial), to in _KEPT.items():
                if to == q:
                    kept = step(f"{v}.s{p}", f"{r}.late * {TRUNCATED}", "K", f"{r}.role || ':' || {r}.body")
                    ways.append(f"case when {r}.first = '{'sua'[initial]}' and not {r}.out then {kept} else '{none}' end")
            for p in range(_STATES):
                if _FILL[p] == q:
                    named = step(f"{v}.s{p}", f"{r}.late * {TRUNCATED} + {RENAME}", "R", f"'{_FILL_ROLE[p]}:' || {r}.body")
                    ways.append(f"case when not {r}.out then {named} else '{none}' end")
            entries.append(f"'s{q}': least({', '.join(ways)})")
        return f"{{{', '.join(entries)}}}"

    def twice(v: str) -> str:
        """Both rounds, each bound to a name so that the text of one does not repeat in the other."""
        return f"list_transform(list_transform([{v}], lambda y: {inserted('y')}), lambda z: {inserted('z')})[1]"

    start = f"{{'s0': '000000000' || chr(1), 's1': '{none}', 's2': '{none}', 's3': '{none}'}}"
    return rf"""
with named as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as body,
    list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''),
      lambda x: ascii(x)::bigint) as name from conversations),
hashed as (
  select *, xor(4294967295::bigint, list_reduce(name,
    lambda c, x: list_reduce(range(8), lambda d, k: xor(d >> 1, (d & 1) * 3988292384::bigint), xor(c, x)), 4294967295::bigint)) % 20 as h
  from named),
damaged as (
  select conv_id, turn, case when h = 4 then 'user' else role end as role,
    case when h = 1 then '' when h = 2 then regexp_replace(body, '[.!?]', '', 'g') else body end as body,
    unnest(case when h = 3 then [1, 2] else [1] end) as copy
  from hashed where h <> 0),
placed as (
  select *, rtrim(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare, left(role, 1) as first,
    row_number() over (partition by conv_id order by turn nulls first, role, body, copy) as pos from damaged),
seen as (
  select *, bare = '' as blank, row_number() over (partition by conv_id, role, body order by pos) > 1 as again,
    right(bare, 1) not in ('.', '!', '?') as cut, lag(first) over (partition by conv_id order by pos) as before from placed),
told as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank,
    count(*) filter (again and not blank) as duplicate, count(*) filter (cut and not again and not blank) as truncated,
    count(*) filter (before || first not in ('su', 'ua', 'au')) as illegal,
    list({{'role': role, 'body': body, 'first': first, 'out': blank or again, 'late': (cut and not again and not blank)::int}} order by pos) as turns
  from seen group by 1),
solved as (
  select *, list_reduce(turns, lambda v, r: {twice(turn('v', 'r'))}, {twice(start)}) as v from told),
best as (select *, least(v.s0, v.s3) as b from solved)
select c.conv_id, coalesce(b.gaps, 0) as gaps, coalesce(b.blank, 0) as blank, coalesce(b.duplicate, 0) as duplicate,
  coalesce(b.truncated, 0) as truncated, coalesce(b.illegal, 0) as illegal, coalesce(left(b.b, 9)::bigint, 0) as cost,
  coalesce(substr(b.b, 10, strpos(b.b, chr(1)) - 10), '') as audit,
  sha256(coalesce(replace(substr(b.b, strpos(b.b, chr(1)) + 1), chr(2), chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join best b on c.conv_id is not distinct from b.conv_id"""


OP12_SQL = _sql()


def op12_conversation_repair(spark, sf_dir) -> DataFrame:
    conversations = common.read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair_report(damaged(conversations), conversations)
