"""Spelling variants against a comparison of all words."""

import itertools
import random
import re
from collections import Counter
from zlib import crc32

from paperloom.llm.spelling import group_variants, trie_pairs


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else max(a, b, key=len)[i + 1 :] == min(a, b, key=len)[i:]


def expected(docs, slip=199):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    about = {w: sorted((v for v in words if near(w, v)), key=lambda v: (-words[v], v)) for w in words}
    form = {w: v[0] if v and words[v[0]] >= 5 * words[w] else None for w, v in about.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n, len(about[w]), words.get(form[w])) for w, n in words.items())


def run(documents, docs, **options):
    return sorted(map(tuple, group_variants(documents(docs), **options).collect()))


def vocabulary(seed, roots, letters, size=(6, 9)):
    """Documents with words and their variants, in frequencies far apart."""
    draw = random.Random(seed)
    words = []
    for _ in range(roots):
        word = "".join(draw.choice(letters) for _ in range(draw.randint(*size)))
        for level in range(3):
            words += [word] * draw.choice([5, 6, 30, 150])
            i, kind = draw.randrange(len(word)), draw.randrange(3)
            word = word[:i] + (draw.choice(letters) if kind else "") + word[i + (kind < 2) :]
    draw.shuffle(words)
    return [(i, " ".join(part)) for i, part in enumerate(itertools.batched(words, 40))]


def test_against_all_words(documents):
    docs = vocabulary(1, 60, "abé") + vocabulary(2, 40, "abcdefgh", (6, 14))
    found = run(documents, docs)
    assert found == expected(docs)
    assert sum(r[1] is not None for r in found) > 20 and any(r[2] not in (r[0], r[1]) for r in found)


def test_large_groups_are_cut(documents):
    """Words of one long prefix, or of one suffix, and groups of two words at most."""
    docs = [(i, t.replace(" ", " samestart")) for i, t in vocabulary(3, 40, "ab")] + [(i, t.replace(" ", "sameend ")) for i, t in vocabulary(4, 40, "ab")]
    assert run(documents, docs, most=2) == run(documents, docs) == expected(docs)


def test_slips(documents):
    docs = [(i, "Überraschung überraschung wonderful WONDERFUL ninety-nine's") for i in range(60)]
    assert run(documents, docs, slip=3) == expected(docs, 3)
    assert [r[0] for r in run(documents, docs, slip=0)] == ["ninety", "wonderful", "Überraschung", "überraschung"]


def test_odd_texts(documents):
    docs = [(1, None), (2, ""), (None, "Straßen straßen strafen " * 6), (None, "straßen " * 30), (3, "Ωstraßen×÷ straĀen Đstrafen! ÿÿÿÿÿÿ " * 5), (3, "Ωstraßen×÷ straĀen Đstrafen! ÿÿÿÿÿÿ " * 5), (4, "x" * 200_000 + " " + "longest word " * 9)]
    assert run(documents, docs) == expected(docs)
    assert run(documents, []) == []


def test_trie_pairs():
    draw = random.Random(5)
    words = sorted({"".join(draw.choice("abc") for _ in range(draw.randint(0, 5))) for _ in range(150)})
    want = sorted((i, j) for i, a in enumerate(words) for j, b in enumerate(words) if near(a, b))
    found = list(trie_pairs(words))
    assert sorted(found) == want
    assert list(trie_pairs([])) == []
