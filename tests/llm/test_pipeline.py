"""The pipeline's stages, one after the other, against plain versions on a small table."""

from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from rasterloom.llm import jaccard, mixing

from test_operators import SCHEMA, corpus, slow_groups, words


KEY = "Zq8vKx2LmP9rTw4YbN7cHd3F"


@pytest.fixture(scope="module")
def docs(spark):
    # more rows of one language, so that there is something to learn
    rows = [r for r in corpus() if r[0] is not None] + [(1000 + i, " ".join(f"{'aeiou'[k % 5]}{k}" for k in np.random.default_rng(i).integers(0, 99, 20)), "en", "s1", 9, 0.1, 1) for i in range(20)]
    rows += [(2000 + i, f"once upon a{i} time a key {KEY} was in a text and it had to go {i}", "en", "s2", 9, 0.1, 1) for i in range(3)]
    return spark.createDataFrame(rows, SCHEMA)


def slow_kept(rows) -> Counter:
    """Ids of the rows that stay: of each class the least, and all rows without words."""
    classes = {}
    for r, c in zip(rows, slow_groups([r.text for r in rows])):
        classes.setdefault(c, []).append(r.doc_id)
    return Counter(min(ids, key=lambda i: (i is None, i)) for ids in classes.values())


def test_rows_that_share_an_id(spark):
    """Rows are told apart by their texts: (7, B) and (9, D) stay, though 7 and 9 also name other rows."""
    a, b, c, d = ((" ".join(np.random.default_rng(k).choice(list("abcdefghij"), 40)) for k in range(4)))
    rows = [(1, a), (7, a), (7, b), (9, c), (9, d), (None, d), (None, ""), (None, ""), (3, None)]
    docs = spark.createDataFrame([(*r, "m") for r in rows], "doc_id long, text string, _set string")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(1, a), (7, b), (9, c), (9, d), (None, ""), (None, ""), (3, None)])


def test_stages(spark, docs):
    at, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = at.collect()
        at = stage(spark, at, "")
        if name != "pack_sequences":
            assert at.columns == columns
        after = at.collect()
        if name == "language_id":
            letters = [r for r in before if r.text and any(c.isalpha() for c in r.text)]
            assert Counter(after) <= Counter(letters) and len(after) > 0.6 * len(letters)
        if name == "near_duplicates":
            assert Counter(r.doc_id for r in after) == slow_kept(before) and Counter(after) <= Counter(before)
        if name == "secret_scan":
            assert len(after) == len(before) and [r.doc_id for r in after if KEY in (r.text or "")] == []
            assert Counter(r for r in after if r.doc_id < 2000) == Counter(r for r in before if r.doc_id < 2000)
            assert sum("once upon" in (r.text or "") for r in after if r.doc_id >= 2000) == 3
        if name == "mix_sources":
            want = {(r.doc_id): r.copies for r in mixing.copies(spark.createDataFrame(before, docs.schema)).collect()}
            assert Counter(r.doc_id for r in after) == +Counter(want)
        if name == "pack_sequences":
            assert {r.doc_id for r in after} == {r.doc_id for r in before}


def test_empty_and_clashing_names(spark, docs):
    named = docs.withColumnRenamed("score", "lang_pred").withColumnRenamed("size", "component_id").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, named, "")
        assert out.columns == named.columns and out.count() == 0
    some = docs.limit(8).withColumnRenamed("size", "component_id")
    assert jaccard.classes(some).count() == 8
    assert corpus_pipeline.near_duplicates(spark, some, "").columns == some.columns


def test_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert any(k.startswith(f"op{n}_") for k in names)
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5 and words("A b") == ["a", "b"]
