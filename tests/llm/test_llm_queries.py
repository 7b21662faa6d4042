"""Every registered query over the smallest tables: columns, learning rows, digests, and SQL where there is some."""

import hashlib
import os
import re
import struct
import zlib
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from rasterloom.llm.queries import QUERIES, ORACLE_SQL, table, tokenizer_file

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op2_vector_search": "query_id rank vec_id score",
    "op3_mixing": "doc_id size source_size target taken",
    "op4_toxicity": "doc_id held_out score predicted",
    "op5_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op6_jaccard_join": "doc_id n_shingles component_id",
    "op7_language_id": "doc_id held_out lang_pred score",
    "op8_secret_scans": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op9_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op10_token_counts": "doc_id",
    "op11_token_ids": "doc_id start n_tokens ids_crc32",
    "op12_token_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    "op13_spelling_variants": "word form root n n_near form_n",
}
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r for r in table(spark, DATA, "documents").collect()}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, texts, name):
    out = QUERIES[name](spark, DATA)
    want = COLUMNS[name].split()
    assert out.columns[: len(want)] == want
    rows = out.collect()
    rest = {"op4_toxicity": (4, 2), "op5_lm_scoring": (10, 0), "op7_language_id": (4, 2)}.get(name)
    if name not in ("op2_vector_search", "op9_packing", "op13_spelling_variants"):
        assert Counter(r.doc_id for r in rows) == Counter(list(texts))
    if rest:
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % rest[0] == rest[1]) for r in rows)
    if name == "op1_fingerprints":
        order = sorted(texts, reverse=True)
        for r in rows:
            t, n = texts[r.doc_id].text or "", texts[order[(order.index(r.doc_id) + 1) % len(order)]].text or ""
            edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
            assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            for near, other in ((r.near_edited, edited), (r.near_next, n)):
                # the estimate at the query's own scale, within five standard errors of about half the shingles
                a, b = shingles(t), shingles(other)
                like = len(a & b) / len(a | b) if a | b else 1.0
                assert abs(near - like) <= 5 * (like * (1 - like) / max(1, len(a | b) / 2)) ** 0.5 + 1e-9
    if name == "op2_vector_search":
        ids = {r.vec_id for r in table(spark, DATA, "embeddings").collect()}
        assert Counter(r.query_id for r in rows) == Counter({i: 5 for i in ids if i % 50 == 0})
    if name == "op4_toxicity":
        assert all(r.predicted == (r.score >= 0.3) for r in rows)
    if name == "op5_lm_scoring":
        words = [len((texts[r.doc_id].text or "").replace("\t", " ").split(" ")) for r in rows]
        assert len(words) == len(rows) and all(r.score < 0 and r.n_known <= r.n_tokens for r in rows)
    if name == "op7_language_id":
        known = [r for r in rows if r.held_out and texts[r.doc_id].lang and r.lang_pred != "und"]
        assert sum(r.lang_pred == texts[r.doc_id].lang for r in known) >= 0.9 * len(known)
    if name == "op9_packing":
        assert Counter(r.sequence_id for r in rows if r.offset == 0) == Counter({r.sequence_id for r in rows})
        assert {r.doc_id: r.doc_tokens for r in rows}.keys() == texts.keys()
    if name == "op11_token_ids":
        whole, at = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json")), 0
        for r in sorted(rows, key=lambda r: r.doc_id):
            ids = [*whole.encode(texts[r.doc_id].text or "", add_special_tokens=False).ids, 0]
            assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
            at += len(ids)
    if name in ORACLE_SQL:
        duckdb = pytest.importorskip("duckdb")
        con = duckdb.connect()
        for t in ("documents", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        got = con.execute(ORACLE_SQL[name])
        names = [c[0] for c in got.description]
        plain = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
        assert Counter(plain(r) for r in got.fetchall()) == Counter(plain(r[c] for c in names) for r in rows)


def test_pipeline(spark, texts):
    rows = corpus_pipeline.run(spark, DATA).collect()
    kept = {r.doc_id for r in rows}
    assert kept <= texts.keys() and len(kept) > 0.7 * len({(r.text or "") for r in texts.values()})
    pieces = {}
    for r in rows:
        pieces.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in pieces.values():
        assert sum(n for _, n in s) <= 1024 and all(a + n == b for (a, n), (b, _) in zip(sorted(s), sorted(s)[1:]))
