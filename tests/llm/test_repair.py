"""Conversation repair against a search over all edits."""

import itertools
import random
import re
from hashlib import sha256
from zlib import crc32

import pytest

from paperloom.llm.repair import Repair, damage, repair_conversations, repaired_turns

SCHEMA = "conv_id long, turn long, role string, text string"
EMPTY = sha256(b"").hexdigest()


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        out += [(turn, role, text)] * (2 if fault == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        clean = re.sub("[\x20\x09-\x0d]", "", text)
        out.append("blank" if not clean else "duplicate" if (role, text) in seen else "truncated" if clean[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def best(rows):
    """The cheapest edits by trying all of them, with up to two insertions in each gap."""
    kinds, found = faults(rows), []
    inserts = [(), (("I", "user", ""),), (("I", "assistant", ""),), (("I", "user", ""), ("I", "assistant", "")), (("I", "assistant", ""), ("I", "user", ""))]
    choices = []
    for (_, role, text), kind in zip(rows, kinds, strict=True):
        more = 3 * (kind == "truncated")
        stay = [] if kind in ("blank", "duplicate") else [(more, ("K", role, text)), (3 + more, ("R", "user", text)), (3 + more, ("R", "assistant", text))]
        choices.append([*stay, (4, ("D", None, None))])
    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        for picked in itertools.product(*choices):
            edits = [*gaps[0]]
            for (_, edit), gap in zip(picked, gaps[1:], strict=True):
                edits += [edit, *gap]
            said = [e for e in edits if e[0] != "D"]
            if re.fullmatch("(s?(ua)+)?", "".join(e[1][:1] or "-" for e in said)):
                cost = sum(c for c, _ in picked) + 3 * sum(map(len, gaps))
                found.append((cost, "".join(e[0] for e in edits), sha256("\n".join(f"{r}:{t}" for _, r, t in said).encode()).hexdigest()))
    least = min(found)
    assert len({f for f in found if f[:2] == least[:2]}) == 1  # the audit says what the repaired text is
    return least


def expected(rows):
    """The contract's columns of one conversation, but for its id."""
    rows = damaged(rows)
    kinds = faults(rows)
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, *best(rows))


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS cost", "1 AS n", "2 AS d1", "'f' AS first")
    return {r[0]: tuple(r)[1:] for r in repair_conversations(damage(df), "dropped").collect()}


def test_against_all_edits(spark):
    draw = random.Random(11)
    said = ["Yes.", "No", "yes?", "", " \t", "ok! ", "ok", None, "end. ", "é."]
    rows = []
    for conv in range(90):
        for turn in range(draw.choice([1, 2, 2, 3])):
            rows.append((conv * 7, draw.choice([turn, turn, turn, 0, None, turn * 3]), draw.choice(["user", "assistant", "system", "user", "assistant", None, "tool", ""]), draw.choice(said)))
    rows += [(None, 0, "user", "a."), (None, 1, "assistant", "b.")]
    want = {}
    for conv in {r[0] for r in rows}:
        want[conv] = expected([r for r in rows if r[0] == conv])
    assert run(spark, rows) == want


def test_undamaged_conversation_stays():
    one = Repair()
    for i, (role, text) in enumerate([("system", "s."), ("user", "u?"), ("assistant", "a!")]):
        one.take(i, role, text, False)
    cost, out = one.close()
    assert cost == 0 and "".join(one.audit) == "KKK" and out == [("K", "system", "s."), ("K", "user", "u?"), ("K", "assistant", "a!")]


@pytest.mark.parametrize("odd", [False, True])
def test_long_conversation_settles(odd):
    """Of many rows only a few are held; the result is that of the search without settling."""
    one, out = Repair(), []
    most = 0
    for i in range(4000):
        row = (i, ("user", "assistant")[(i + (odd and i > 2000)) % 2], f"text {i}." if i % 7 else f"text {i}", False)
        out += one.take(*row)
        most = max(most, len(one.held))
    cost, last = one.close()
    out += last
    audit = "".join(one.audit)
    assert most < 200 and len(out) == len(audit)
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for e, r, _ in out if e != "D"))
    assert cost == sum({"K": 0, "R": 3, "D": 4, "I": 3}[e] for e in audit) + 3 * sum(e in "KR" and t[-1] != "." for e, _, t in out)
    assert [t for e, _, t in out if e != "I"] == [f"text {i}." if i % 7 else f"text {i}" for i in range(4000)]


def test_all_rows_missing(spark):
    df = spark.createDataFrame([(5, 0, "user", "Hi.", True), (5, 1, "assistant", "Yes.", True), (6, 0, "user", "Hi.", None)], SCHEMA + ", gone boolean")
    found = {r[0]: tuple(r)[1:] for r in repair_conversations(df, "gone").collect()}
    assert found[5] == (0, 0, 0, 0, 0, 0, "", EMPTY)
    assert found[6][5:7] == (3, "KI")


def test_turns_are_those_of_the_digest(spark):
    rows = [(c, t, ("user", "assistant")[(t + c) % 2], f"{t % 5}{'.' * (t % 3 > 0)}") for c in range(6) for t in range(40)]
    df = damage(spark.createDataFrame(rows, SCHEMA))
    sums = {r.conv_id: r for r in repair_conversations(df, "dropped").collect()}
    turns = sorted(map(tuple, repaired_turns(df, "dropped").collect()))
    for conv, r in sums.items():
        own = [t for t in turns if t[0] == conv]
        assert [t[1] for t in own] == list(range(len(own))) and "".join(t[2] for t in own) == r.audit
        assert sha256("\n".join(f"{t[3]}:{t[4]}" for t in own if t[2] != "D").encode()).hexdigest() == r.repaired_sha256


def test_empty_table(spark):
    assert run(spark, []) == {}
    assert repaired_turns(damage(spark.createDataFrame([], SCHEMA)), "dropped").count() == 0
