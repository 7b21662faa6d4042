"""Token ids in files of directly addressable codes, against the tokenizers library and plain lists."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from rasterloom.llm import token_ids
from rasterloom.llm.queries import tokenizer_file
from test_operators import docs, empty  # noqa: F401

FILE = tokenizer_file("byte_bpe_50k.json")


def opened(ids, docs=(), starts=(0,), widths=None):
    data = b"".join(token_ids.coded(np.array(ids, np.uint32), list(docs), np.array(starts), widths))
    return token_ids.Codes(lambda offset, size: data[offset : offset + size]), data


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500), st.sampled_from([None, [32], [1, 31], [3, 5, 24], [8, 8, 16]]))
@settings(max_examples=60, deadline=None)
def test_codes(ids, widths):
    codes, _ = opened(ids, widths=widths)
    assert codes.ids(0, len(ids)).tolist() == ids
    for lo, hi in ((0, 1), (len(ids) // 3, len(ids) // 2), (len(ids) - 1, len(ids))):
        if 0 <= lo <= hi <= len(ids):
            assert codes.ids(lo, hi).tolist() == ids[lo:hi]
    assert [codes[i] for i in range(0, len(ids), 7)] == ids[::7]
    with pytest.raises(IndexError):
        codes[len(ids)]


def test_random_access_reads_little():
    rng = np.random.default_rng(1)
    ids = (rng.pareto(1.0, 200_000) * 20).astype(np.uint32) % 50257
    codes, data = opened(ids)
    read, codes.read = [], lambda o, n, f=codes.read: (read.append(n), f(o, n))[1]
    for i in rng.integers(0, len(ids), 50):
        read.clear()
        assert codes[int(i)] == ids[i] and sum(read) < 80 * len(codes.levels)
    read.clear()
    assert codes.ids(150_000, 150_100).tolist() == ids[150_000:150_100].tolist() and sum(read) < 1500
    assert len(data) < 2 * len(ids)  # below the 16 bits that an id of this vocabulary takes


def test_widths_are_the_best():
    rng = np.random.default_rng(2)
    ids = (rng.pareto(0.7, 5000) * 5).clip(0, 2**20).astype(np.uint32)
    best = len(b"".join(token_ids.coded(ids, [], np.array([0]))))
    for widths in ([21], [8, 13], [4, 4, 13], [7, 7, 7], [1] * 21):
        assert best <= len(b"".join(token_ids.coded(ids, [], np.array([0]), widths))) + 40


def want(rows):
    whole = Tokenizer.from_file(FILE)
    least = 1 << 62
    out, at = [], 0
    # rows of one id stand by a hash of their texts: compared as sets of what follows each id
    for id_, text in sorted(rows, key=lambda r: (least if r[0] is None else r[0],)):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((id_, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    return out, at


def test_files(spark, docs, empty, tmp_path):  # noqa: F811
    long = " ".join(f"w{i}" for i in range(400_000))
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(-5, "a <|endoftext|> b　c"), (10**12, long), (7, "z" * 300_000), (7, "z"), (7, "z")]
    more = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected, total = want(rows)
    for folder, room in ((None, 16 << 20), (f"{tmp_path}/ids", 64)):
        files = token_ids.write(more, FILE, folder=folder, room=room)
        got = sorted(token_ids.digests(files).collect(), key=lambda r: r.start)
        assert sorted((r.n_tokens, r.ids_crc32, str(r.doc_id)) for r in got) == sorted((n, c, str(i)) for i, n, c, _ in expected)
        assert [r.doc_id for r in got] == [i for i, *_ in expected]
        assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
        ids = [i for r in sorted(token_ids.documents(files).collect(), key=lambda r: r.start) for i in r.ids]
        assert len(ids) == total == files.agg({"n_ids": "sum"}).first()[0]
        ask = [0, 1, total - 1, total // 2, total // 2, *range(5, total, total // 40)]
        found = token_ids.lookup(files, spark.createDataFrame([(i,) for i in [*ask, total, None, -1]], "position long")).collect()
        assert sorted(tuple(r) for r in found) == sorted((i, ids[i]) for i in ask)
    assert files.count() > 10
    assert token_ids.digests(token_ids.write(empty, FILE)).count() == 0


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "a b", "x", 3), (None, None, None, None)], "doc_id long, text string, ids string, n_tokens int")
    got = token_ids.documents(token_ids.write(rows.withColumnRenamed("ids", "_hash"), FILE)).collect()
    assert sorted((r.start, r.n_tokens) for r in got) == [(0, 3), (3, 1)]


@given(st.text(alphabet="ab1 \n\t.é", max_size=60), st.integers(1, 20))
@settings(max_examples=200, deadline=None)
def test_parts(text, size):
    cut = list(token_ids.parts(text, size))
    assert "".join(cut) == text
    encoder = token_ids.Encoder(open(FILE, encoding="utf-8").read()) if not hasattr(test_parts, "e") else test_parts.e
    test_parts.e = encoder
    assert b"".join(map(encoder, cut)) == encoder(text)
