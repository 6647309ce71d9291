import random
import re

import pytest

from paperloom.llm.lines import remove_units


def brute(rows, brk, least):
    """First occurrence by (id, null last, order of rows with equal ids doesn't matter here)."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        units, kept, removed, at = (t or "").split(brk), [], [], 0
        for u in units:
            norm = re.sub(r"[\x20\x09-\x0D]+", " ", u.lower()).strip(" ")
            if len(norm.split(" ")) >= least and norm in seen:
                removed.append((at, at + len(u)))
            else:
                kept.append(u)
                if len(norm.split(" ")) >= least:
                    seen.add(norm)
            at += len(u) + len(brk)
        out[i] = (len(units), removed, brk.join(kept))
    return out


@pytest.mark.parametrize("kind, brk", [("line", "\n"), ("paragraph", "\n\n")])
def test_later_occurrences_go(documents, kind, brk):
    rng = random.Random(6)
    pool = [" ".join(rng.choices(["an", "Bé", "cá", "D", "e\tf"], k=rng.randint(1, 6))) for _ in range(30)] + ["", " ", "x"]
    rows = [(i, brk.join(rng.choices(pool, k=rng.randint(0, 12)))) for i in range(80)] + [(500, None), (None, brk.join(pool))]
    got = {r.doc_id: (r.n_units, [tuple(s) for s in r.removed], r.text) for r in remove_units(documents(rows), kind, 3).collect()}
    assert got == brute(rows, brk, 3)


def test_offsets_point_into_the_original(documents):
    unit = "Một hai ba bốn năm sáu bảy tám chín mười"
    rows = [(1, f"a\n{unit}\nb"), (2, f"x\n  {unit.upper()} \ny"), (3, unit)]
    got = {r.doc_id: r for r in remove_units(documents(rows)).collect()}
    assert [rows[1][1][s.start : s.end] for s in got[2].removed] == [f"  {unit.upper()} "] and got[2].text == "x\ny"
    assert got[1].text == rows[0][1] and got[3].text == "" and not got[1].removed


def test_repeated_rows_long_and_empty(documents):
    unit = " ".join(f"w{i}" for i in range(12))
    long = "\n".join(f"{unit} {i}" for i in range(3000)) + f"\n{unit} 7"
    rows = [(1, unit), (1, unit), (2, long), (3, "")]
    got = remove_units(documents(rows)).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 2, 3] and all(r.text == unit for r in got if r.doc_id == 1)
    assert [(r.n_units, len(r.removed)) for r in got if r.doc_id == 2] == [(3001, 1)]
    assert remove_units(documents([])).count() == 0


def test_short_lines_go_by_default(documents):
    rows = [(1, "Released under the MIT License.\n\n}\none two"), (2, "x\n  released under the  MIT license.\n\n \n}"), (3, "One Two"), (4, "")]
    got = {r.doc_id: (len(r.removed), r.text) for r in remove_units(documents(rows)).collect()}
    assert got == {1: (0, rows[0][1]), 2: (2, "x\n\n "), 3: (1, ""), 4: (0, "")}
    assert all(not r.removed for r in remove_units(documents(rows), "line", 10).collect())


def test_documents_of_one_key_are_told_apart(documents):
    """With no bits in the first half of the key: texts of many and of few lines, repeated ids too."""
    rows = [(i, "\n".join(["a b", f"own {i}", *[f"line {k}" for k in range(i % 7)], "a b"])) for i in range(40)] + [(3, "line 5"), (None, "own 1\nnew")]
    whole = sorted(map(str, remove_units(documents(rows)).collect()))
    assert sorted(map(str, remove_units(documents(rows), bits=0).collect())) == whole
