import random
from itertools import combinations

from paperloom.llm.decontaminate import LEAST_ITEM, MASKS, SHORT_ITEM, decontaminate, find_overlaps

RNG = random.Random(8)
VOCABULARY = ["".join(RNG.choices("abcdefghij", k=5)) for _ in range(3000)]


def prose(n, rng=RNG):
    return rng.choices(VOCABULARY, k=n)


def items(spark, texts):
    return spark.createDataFrame([(i, t, "w", "s") for i, t in texts], "item_id long, text string, words string, seed string")


def brute(docs, bench, least_words=20, least_equal=0.8):
    """Every diagonal that has a seed hit, compared word by word."""
    out = {}
    for i, d in docs:
        for j, b in bench:
            for shift in range(-len(b) + 1, len(d)):
                a0, b0 = max(shift, 0), max(-shift, 0)
                flags = [x == y for x, y in zip(d[a0:], b[b0:], strict=False)]
                hits = sum(all(flags[p + k] for k, bit in enumerate(m) if bit == "1") for m in MASKS for p in range(len(flags) - len(m) + 1))
                need = min(len(b), least_words)
                if hits and len(flags) >= need:
                    best = max(sum(flags[s : s + need]) for s in range(len(flags) - need + 1)) / need
                    if best >= least_equal:
                        n, first, top = out.get((i, j), (0, 10**9, 0))
                        out[i, j] = (n + hits, min(first, a0), max(top, best))
    return out


def test_substitutions(spark, documents):
    bench = [(j, prose(n)) for j, n in enumerate((12, 25, 40, 60))]
    docs = [(i, prose(60)) for i in range(20)]
    for i, (_, words) in enumerate(bench * 4):
        copy = [w if RNG.random() > 0.04 * i else "other" for w in words]
        docs.append((100 + i, prose(15) + copy + prose(15)))
    docs.append((200, prose(10) + bench[3][1][20:45] + prose(5)))
    docs.append((201, bench[3][1][50:] + prose(40)))
    docs.append((202, bench[1][1] + bench[1][1]))
    got = find_overlaps(documents([(i, " ".join(w)) for i, w in docs]), items(spark, [(j, ", ".join(w).upper()) for j, w in bench]))
    found = {(r.doc_id, r.item_id): (r.seeds, r.first_word, round(r.equal, 6)) for r in got.collect()}
    assert found == {k: (n, f, round(e, 6)) for k, (n, f, e) in brute(docs, bench).items()}
    assert {i for i, _ in found} >= {100, 101, 102, 103, 200, 202} and 201 not in {i for i, _ in found}


def test_edges(spark, documents):
    words = prose(30)
    passage = " ".join(words)
    bench = items(spark, [(1, passage), (1, passage), (2, None), (3, ""), (4, "two words"), (None, " ".join(prose(30)))])
    long = " ".join(prose(60_000)) + " " + passage
    rows = [(1, passage), (1, passage), (2, None), (3, ""), (4, "two words"), (None, f"x {passage}"), (6, long)]
    found = find_overlaps(documents(rows), bench)
    assert sorted((str(r.doc_id), r.item_id) for r in found.collect()) == [("1", 1), ("6", 1), ("None", 1)]
    kept = decontaminate(documents(rows), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4] and kept.columns == documents(rows).columns
    assert kept.filter("doc_id = 3").first().row == "row"
    assert decontaminate(documents([]), bench).count() == 0 and decontaminate(documents(rows), items(spark, [])).count() == len(rows)


def meet(d, b):
    """Whether some diagonal meets the criterion, whatever the masks."""
    need = min(len(b), 20)
    for shift in range(-len(b) + 1, len(d)):
        flags = [x == y for x, y in zip(d[max(shift, 0) :], b[max(-shift, 0) :], strict=False)]
        if any(5 * sum(flags[s : s + need]) >= 4 * need for s in range(len(flags) - need + 1)):
            return True
    return False


def test_masks_miss_no_substitution():
    for n in range(SHORT_ITEM, 21):
        windows = [{p + i for i, bit in enumerate(m) if bit == "1"} for m in MASKS for p in range(n - len(m) + 1)]
        assert all(any(w.isdisjoint(gone) for w in windows) for gone in combinations(range(n), n // 5)), n


def test_every_overlap_is_found(spark, documents):
    """All placements of as many substitutions as the criterion allows, and short items, without a word on seeds."""
    rng = random.Random(88)
    bench = [(n, prose(n, rng)) for n in range(LEAST_ITEM, 17)] + [(20, prose(20, rng)), (33, prose(33, rng))]
    docs = []
    for n, item in bench:
        ways = list(combinations(range(min(n, 20)), min(n, 20) // 5))
        for gone in rng.sample(ways, min(len(ways), 60)):
            docs.append(prose(3, rng) + ["other" if i in gone else w for i, w in enumerate(item[:20])] + prose(2, rng))
        docs.append(item)
        docs.append([*item[:2], "other", "other", "other", *item[5:]])
    docs.append(["one", "two"])
    found = find_overlaps(documents([(i, " ".join(w)) for i, w in enumerate(docs)]), items(spark, [(j, " ".join(w)) for j, w in bench]))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(i, j) for i, d in enumerate(docs) for j, b in bench if meet(d, b)}
