"""Spelling variants against a plain comparison of all words, and the query against its SQL's rule in Python."""

import random
import re
import zlib
from collections import Counter
from itertools import permutations

import pytest

from rasterloom.llm import spelling
from test_operators import LOWER, docs, empty  # noqa: F401

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_forms(n: dict[str, int], ratio=10):
    best, out = {}, []
    for w in n:
        around = [v for v in n if near(w, v)]
        top = min(around, key=lambda v: (-n[v], v), default=None)
        best[w] = (top if top and n[top] >= ratio * n[w] else None, len(around))
    for w, (form, count) in best.items():
        root = w
        while best[root][0]:
            root = best[root][0]
        out.append((w, form, root, n[w], count, n[form] if form else None))
    return sorted(out, key=repr)


def compare(spark, n, **how):
    counts = spark.createDataFrame(list(n.items()), "word string, n long")
    got = spelling.forms(counts, **how)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_forms(n)


@pytest.mark.parametrize("most", [256, 1])
def test_forms(spark, most):
    """Short words of few letters, nearly all near others; also with every key split by the letters left."""
    rng = random.Random(most)
    n = {"".join(rng.choices("abé÷", k=rng.randint(1, 6))): rng.choice([2, 3, 20, 25, 200, 2500, 30000]) for _ in range(400)}
    compare(spark, n, most=most)


def test_anagrams_and_chains(spark):
    """A class of anagrams beyond the bound, with exchanges, additions and removals among them; a chain of forms; ties."""
    some = ["".join(p) for p in permutations("abcdefg")][::9]
    n = {w: 2 for w in some} | {some[0][:6] + "z": 20, some[5] + "s": 400, some[7][1:]: 5, some[9][:6] + "x": 20, some[9][:6] + "y": 20}
    compare(spark, n, most=50)
    chain = {"aaaaaaaa": 2, "aaaaaaab": 20, "aaaaaabb": 200, "aaaaabbb": 2000, "aaaabbbb": 20000, "aaabbbbb": 199999, "zzzzzzz": 2, "Zzzzzzz": 9}
    compare(spark, chain)
    got = {r.word: r.root for r in spelling.forms(spark.createDataFrame(list(chain.items()), "word string, n long")).collect()}
    assert got["aaaaaaaa"] == "aaaabbbb" and got["zzzzzzz"] == "zzzzzzz"


def plain_words(rows, shortest=7, least=2, modulus=31):
    n = Counter()
    for id_, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            if h % modulus == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= shortest and c >= least}


def test_words(spark, docs, empty):  # noqa: F811
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(i, f"Elephants ÀÉÎõü×÷ßs straße{i} internationalisation NAÏVETÉS x\x00elephants, q_abcdefgh " + "Zz" * 40) for i in range(120)]
    rows += [(None, "elephants elephants"), (3, "y" * 200_000), (4, "y" * 200_000), (5, ""), (6, None)]
    more = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    for change, modulus in ((spelling.drop_one(31), 31), (spelling.drop_one(3), 3), (None, 1 << 40)):
        got = {r.word: r.n for r in spelling.words(more, change=change).collect()}
        assert got == plain_words(rows, modulus=modulus)
    assert spelling.words(empty).count() == 0 and spelling.forms(spelling.words(empty)).count() == 0


def test_long_words(spark):
    """Words of 5,000 letters: one exchange and one more letter are found."""
    a = "ÿ" * 5_000
    b, c = a[:2_500] + "x" + a[2_501:], a + "ÿ"
    got = spelling.forms(spark.createDataFrame([(a, 2), (b, 30), (c, 2)], "word string, n long")).collect()
    assert {r.word: (r.form, r.n_near) for r in got} == {a: (b, 2), b: (None, 1), c: (None, 1)}


def test_query(spark):
    from rasterloom.llm.queries import QUERIES, table

    data = "/root/testdata/sf0.001"
    n = plain_words([(r.doc_id, r.text) for r in table(spark, data, "documents").collect()])
    got = QUERIES["op13_spelling_variants"](spark, data)
    words = {r.word: r.n for r in got.collect()}
    assert words == n
