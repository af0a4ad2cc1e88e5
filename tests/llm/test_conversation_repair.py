import hashlib
import random
import re
import zlib
from functools import cache

import numpy as np

from gaugelake.llm import conversation_repair as op

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_edits(rows):
    """Cheapest edits of (role, must_go, truncated) by trying all, least string among the cheapest."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(i, last, inserted):
        found = []
        if i == len(rows):
            if last in ("", "a"):
                found.append((0, ""))
        else:
            role, must_go, truncated = rows[i]
            options = [("D", 2, "")]
            if not must_go:
                more = 5 * truncated
                options += [("K", more, role[:1] or "-"), ("R", 1 + more, "u"), ("R", 1 + more, "a")]
            for letter, cost, new in options:
                if letter == "D" or new in follows[last]:
                    rest = best(i + 1, new or last, 0)
                    found += [(cost + rest[0], letter + rest[1])] if rest else []
        if inserted < 2:
            for new in "ua":
                if new in follows[last] and (rest := best(i, new, inserted + 1)):
                    found.append((5 + rest[0], "I" + rest[1]))
        return min(found, default=None)

    return best(0, "", 0)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(name.encode()) % 20
        if h == 0:
            continue
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if h == 3 else 1)
    return out


def report(conv, rows):
    """The contract, turn by turn; ``rows`` of one conversation in order."""
    seen, kinds = set(), []
    count = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, _, role, text in rows:
        marks = re.findall(r"[^\x20\x09-\x0D]", text)
        again = (role, text) in seen
        seen.add((role, text))
        fault = "blank" if not marks else "duplicate" if again else "truncated" if marks[-1] not in ".!?" else None
        if fault:
            count[fault] += 1
        kinds.append((role, fault in ("blank", "duplicate"), fault == "truncated"))
    turns = [t for _, t, _, _ in rows if t is not None]
    initials = [r[:1] for _, _, r, _ in rows]
    cost, audit = brute_edits(kinds)
    lines, i, last = [], 0, ""
    for letter in audit:
        if letter == "I":
            role, text = ("assistant" if last == "u" else "user"), ""
        else:
            _, _, role, text = rows[i]
            i += 1
            if letter == "D":
                continue
            if letter == "R":
                role = "assistant" if last == "u" else "user"
        last = role[:1]
        lines.append(f"{role}:{text}")
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
    return (
        conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count["blank"], count["duplicate"], count["truncated"],
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def kind_of(role, must_go, truncated):
    return 0 if must_go else 1 + 2 * {"s": 0, "u": 1, "a": 2}.get(role[:1], 3) + truncated


def random_kinds(rng, most):
    return [
        (rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), rng.random() < 0.15, rng.random() < 0.25)
        for _ in range(rng.randint(0, most))
    ]


def test_cheapest_edits_against_all_edits():
    rng = random.Random(3)
    for most in (1, 2, 3, 4, 5, 9, 14, 30):
        for _ in range(150):
            rows = random_kinds(rng, most)
            got = op.cheapest(np.array([kind_of(*r) for r in rows], np.int64))
            assert got == brute_edits(rows), rows


def test_block_tables_are_small_and_agree_with_steps():
    of = op.tables()
    assert len(of.vectors) < 200 and of.block_step.shape == (len(of.vectors), 9**4)
    rng = random.Random(4)
    for _ in range(500):
        block = [rng.randrange(9) for _ in range(4)]
        code = sum(k * 9**i for i, k in enumerate(block))
        vector = start = rng.randrange(len(of.vectors))
        cost = 0
        for kind in reversed(block):
            cost += of.costs[vector][kind]
            vector = of.steps[vector][kind]
        assert (of.block_step[start, code], of.block_cost[start, code]) == (vector, cost)


def conversations(rng):
    texts = ["Hello there.", "Hello there.", "Is it so?", "no end", "  ", "", None, "Done!\n\t ", "é. ", "Yes.\u00a0", "Off.f", "On.\f\v"]
    rows = []
    for conv in [None, *range(1, 80)]:
        turn = 0
        for _ in range(rng.choice([0, 1, 2, 5, 9])):
            turn += rng.choice([1, 1, 1, 2, 4])
            rows.append((conv, rng.choice([turn] * 8 + [None]) if conv == 5 else turn, rng.choice(
                ["system", "user", "assistant", "user", "assistant", "tool", None, ""]), rng.choice(texts)))
    return rows


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0))


def test_query_rows(spark, tmp_path):
    rng = random.Random(9)
    rows = conversations(rng)
    rows = [r for r in rows if not (r[1] is None and sum(x[:2] == r[:2] for x in rows) > 1)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as part", "'x' as key", "2L as place", "true as has_turn")
    frame.repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: tuple(r) for r in op.op12_conversation_repair(spark, str(tmp_path)).collect()}
    left = damage(rows)
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        assert got[conv] == report(conv, in_order([r for r in left if r[0] == conv]))
    assert any(r not in {x[0] for x in left} for r in got)


def test_long_conversation_over_many_tasks(spark):
    rng = random.Random(10)
    rows = [(1, t // 3 * 2, rng.choice(["user", "assistant", "system"]), f"{rng.choice('abc')}{rng.randrange(300)}" + rng.choice([".", ""])) for t in range(4_000)]
    rows = list(dict.fromkeys(rows)) + [(2, 1, "user", "Hi."), (2, 2, "assistant", "Ho.")]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        out = {r.conv_id: r for r in op.repair_report(spark.createDataFrame(rows, SCHEMA)).collect()}
        turns = sorted(map(tuple, op.repaired(spark.createDataFrame(rows, SCHEMA)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert out[2].audit == "KK" and out[2].cost == 0
    mine = [r for r in rows if r[0] == 1]
    seen, again = set(), 0
    for _, _, role, text in in_order(mine):
        again += (role, text) in seen
        seen.add((role, text))
    assert out[1].duplicate == again and out[1].gaps == max(r[1] for r in mine) + 1 - len({r[1] for r in mine})
    assert len(out[1].audit.replace("I", "")) == len(mine)
    lines = [f"{role}:{text}" for conv, _, _, role, text in turns if conv == 1]
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
    assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == out[1].repaired_sha256


def test_empty_table_and_repeated_rows(spark):
    assert op.repair_report(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, 1, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Ho."), (1, 2, "assistant", "Ho.")]
    out = op.repair_report(spark.createDataFrame(rows, SCHEMA)).first()
    assert (out.duplicate, out.audit, out.cost) == (2, "KDKD", 4)
    assert [r.text for r in op.repaired(spark.createDataFrame(rows, SCHEMA)).orderBy("place").collect()] == ["Hi.", "Ho."]


def test_long_texts(spark):
    rows = [(1, 1, "user", "x" * 3_000_000 + "."), (1, 2, "assistant", "y " * 1_000_000 + "!")]
    out = op.repair_report(spark.createDataFrame(rows, SCHEMA)).first()
    assert out.audit == "KK" and out.repaired_sha256 == hashlib.sha256(f"user:{rows[0][3]}\nassistant:{rows[1][3]}".encode()).hexdigest()
