import re

import pytest

from paperloom.llm.mixing import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes: dict, weights=(3, 1, 2), share=1.5, cap=2.0) -> dict:
    """Filling up, one round of resharing after the other."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full, open_ = share * sum(sizes.values()), {}, dict(w)
    while True:
        left = total - sum(full.values())
        level = {s: left * open_[s] / sum(open_.values()) for s in open_}
        above = [s for s in open_ if level[s] > cap * sizes[s] + 1e-9]
        if not above:
            return full | level
        for s in above:
            full[s] = cap * sizes[s]
            del open_[s]


def check(rows, docs):
    sizes = {}
    for r in rows:
        n = len(WORD.findall(r[1] or ""))
        sizes[r[3]] = sizes.get(r[3], 0) + n
    want = targets(sizes)
    got = mix(docs).collect()
    assert len(got) == len(rows)
    taken, largest = {}, {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    for s, t in taken.items():
        assert abs(t - want[s]) <= largest[s], (s, t, want[s])
    return got


def test_targets_and_taken(documents):
    rows = [(i, "w " * (1 + i * i % 37), "en", f"s{min(i % 7, 3)}") for i in range(400)]
    got = check(rows, documents(rows))
    again = {r.doc_id: r.taken for r in mix(documents(rows[::-1])).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_budgets_nest(documents):
    rows = [(i, "w " * (1 + i % 11), "en", f"s{i % 3}") for i in range(300)]
    for r in mix(documents(rows), budgets=(0.1, 0.4, 1.0)).collect():
        assert r.copies == sorted(r.copies)


def test_nulls_empty_and_repeated(documents):
    rows = [(1, "a b c", "en", "x"), (1, "a b c", "en", "x"), (2, None, "en", None), (3, "", None, "x"), (None, "d e", "en", None), (4, "w " * 200_000, "en", "long")]
    got = check(rows, documents(rows))
    assert len({r.taken for r in got if r.doc_id == 1}) == 1 and all(r.taken == 0 for r in got if r.size == 0)


def test_empty_table_and_no_words(documents):
    assert mix(documents([])).count() == 0
    assert [r.taken for r in mix(documents([(1, " \n", "en", "x")])).collect()] == [0]
