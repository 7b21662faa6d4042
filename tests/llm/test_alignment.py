"""Cross-tokenizer alignment against plain loops over the public tokenizers."""

import hashlib
import json
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from rasterloom.llm import alignment
from rasterloom.llm.queries import tokenizer_file
from test_operators import docs, empty  # noqa: F401

A, B = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")


class Plain:
    """Tokens with their bytes by the libraries themselves; groups and links by sets of byte positions."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        self.a_bytes = {i: bytes(byte[c] for c in t) for t, i in json.load(open(A))["model"]["vocab"].items() if t != "<|endoftext|>"}
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)

    def b_bytes(self, i):
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def __call__(self, text):
        if not text:
            return [], [], "", Counter()
        data = (" " + text).encode()
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        if b"".join(map(self.a_bytes.get, a)) != data or b"".join(map(self.b_bytes, b)) != data:
            return [], [], "", Counter()
        ends_a, ends_b = np.cumsum([len(self.a_bytes[i]) for i in a]).tolist(), np.cumsum([len(self.b_bytes(i)) for i in b]).tolist()
        groups, x, y = [], 0, 0
        for hi in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a.index(hi, x) + 1, ends_b.index(hi, y) + 1
            groups.append(",".join(map(str, a[x:p])) + "|" + ",".join(map(str, b[y:q])))
            x, y = p, q
        owner_a = [k for k, i in enumerate(a) for _ in self.a_bytes[i]]
        owner_b = [k for k, i in enumerate(b) for _ in self.b_bytes(i)]
        return a, b, ";".join(groups), Counter((a[i], b[j]) for i, j in set(zip(owner_a, owner_b)))


@pytest.fixture(scope="module")
def plain():
    return Plain()


TEXTS = st.text(alphabet="ab cde\n\t.é€😀▁<>0x1|éＡ", max_size=50)


@given(st.lists(TEXTS | st.none() | st.sampled_from(["<s>", "a <|endoftext|> b", "<0x0A>", "  x  ", "internationalisation of Zürich", "日本語のテキスト", "\x00a"]), min_size=1, max_size=8))
@settings(max_examples=150, deadline=None)
def test_groups_and_links(texts):
    global _both
    try:
        _both
    except NameError:
        _both = Plain(), alignment.Aligner(open(A, encoding="utf-8").read(), open(B, "rb").read())
    plain, aligner = _both
    n_a, n_b, n_groups, n_links, groups, links = (x.to_pylist() for x in aligner(texts))
    for k, t in enumerate(texts):
        a, b, written, counts = plain(t)
        assert (n_a[k], n_b[k], groups[k]) == (len(a), len(b), written)
        assert n_links[k] == sum(counts.values()) and n_groups[k] == (written.count(";") + 1 if written else 0)
        assert {(x["a"], x["b"]): x["n"] for x in links[k]} == counts
        # a component with i and j members of both sides in a line has i + j - 1 links
        assert n_links[k] == n_a[k] + n_b[k] - n_groups[k]


def test_union_find():
    rng = np.random.default_rng(3)
    for n, m in ((1, 0), (50, 20), (500, 400), (3000, 6000)):
        u, v = rng.integers(0, n, m), rng.integers(0, n, m)
        own = list(range(n))
        for _ in range(n):
            before = own[:]
            for x, y in zip(u.tolist(), v.tolist()):
                own[x] = own[y] = min(own[x], own[y])
            if own == before:
                break
        assert alignment.union_find(n, u, v).tolist() == own
    # a chain in an order that makes paths long
    n = 10_000
    assert not alignment.union_find(n, np.arange(n - 1)[::-1], np.arange(1, n)[::-1]).any()


def expected(plain, rows):
    got = [(i, *plain(t)) for i, t in rows]
    docs = Counter(p for *_, counts in got for p in counts)
    best = {}
    for (a, _), n in docs.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for i, a, b, written, counts in got:
        links = sum(counts.values())
        n_best = sum(n for p, n in counts.items() if docs[p] == best[p[0]])
        out.append((i, len(a), len(b), written.count(";") + 1 if written else 0, links, n_best, sum(n * docs[p] for p, n in counts.items()), written))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [1 << 20, 40, 0])
def test_counts(spark, plain, docs, most):  # noqa: F811
    """With all pairs sent to the tasks, with the most frequent ones, and with none."""
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = alignment.counted(alignment.align(docs, A, B), most)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    order = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert sorted((tuple(r[c] for c in order) for r in got.collect()), key=repr) == expected(plain, rows)


def test_empty_and_clashing(spark, empty):  # noqa: F811
    assert alignment.counted(alignment.align(empty, A, B)).count() == 0
    rows = spark.createDataFrame([(1, "a b", 1, [1])], "doc_id long, text string, _row int, links array<int>")
    (r,) = alignment.counted(alignment.align(rows, A, B)).collect()
    assert (r.doc_id, r.n_a, r.n_b) == (1, 2, 2)


def test_long_texts_in_parts(plain):
    """A text beyond a part, also one without a space, gives the tokens of the whole."""
    pieces = alignment.Pieces(open(B, "rb").read())
    assert pieces.cut
    for text in (" ".join(f"word{i} x  y" for i in range(120_000)), "é" * 3000 + " ".join(f"{i}" for i in range(250_000)), "z" * (1 << 21)):
        assert pieces(text) == pieces.model.encode(text)
    aligner = alignment.Aligner(open(A, encoding="utf-8").read(), open(B, "rb").read())
    text = " ".join(f"word{i} of" for i in range(150_000))
    a, _ = aligner.tokens(text)
    assert a.tolist() == plain.a.encode(" " + text, add_special_tokens=False).ids


def test_query_digest(spark, plain):
    from rasterloom.llm.queries import QUERIES, table

    data = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in table(spark, data, "documents").collect()]
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in expected(plain, rows)]
    got = QUERIES["op12_token_alignment"](spark, data)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
