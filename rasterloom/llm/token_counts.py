"""Token counts by a linear longest-match automaton.

The vocabulary is that of a sentencepiece model, read as word pieces: a word (maximal run of non-space characters) is
matched as the mark U+2581 followed by the word, always taking the longest piece; a character that starts no piece counts
as its UTF-8 bytes (byte fallback). The automaton is the pieces' trie with failure links: where no child goes on, the
link leads to the node of what is left after the pieces that longest match would cut off, whose number is stored with
the link. So a word is read once, from left to right, whatever the lengths of the pieces, and none is built.

Distinct words are counted once in a batch and kept in a bounded table between batches.

Edge cases: a null or blank text has no words and no tokens; repeated rows give repeated results; extra columns are
ignored; a very long word is read in linear time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rasterloom.llm import kernel as K

MARK = "▁"


class Automaton:
    """Greedy longest-match counts for a vocabulary of pieces."""

    def __init__(self, pieces: list[str]):
        self.vocabulary = set(pieces) | {MARK}
        child: list[dict[str, int]] = [{}]
        ends: list[bool] = [False]
        parent: list[tuple[int, str]] = [(0, "")]

        def add(piece: str) -> None:
            node = 0
            for c in piece:
                nxt = child[node].get(c)
                if nxt is None:
                    nxt = child[node][c] = len(child)
                    child.append({})
                    ends.append(False)
                    parent.append((node, c))
                node = nxt
            ends[node] = True

        for p in self.vocabulary:
            add(p)
        #: Tokens that a character at the root stands for, if it is no piece itself.
        self.bytes_of = {c: len(c.encode()) for c in child[0] if not ends[child[0][c]]}
        self.child, self.link, self.popped = child, [0] * len(child), [0] * len(child)
        order = [0]
        for node in order:
            order.extend(child[node].values())
        for node in order[1:]:
            up, c = parent[node]
            if ends[node]:
                self.popped[node] = 1
            elif up == 0:
                self.popped[node] = self.bytes_of[c]
            else:
                at, n = self.link[up], self.popped[up]
                while at and c not in child[at]:
                    n += self.popped[at]
                    at = self.link[at]
                if c in child[at]:
                    self.link[node], self.popped[node] = child[at][c], n
                else:
                    self.link[node], self.popped[node] = 0, n + len(c.encode())

    def count(self, word: str) -> int:
        child, link, popped = self.child, self.link, self.popped
        node, n = child[0][MARK], 0
        for c in word:
            nxt = child[node].get(c)
            while nxt is None:
                if not node:
                    n += len(c.encode())
                    break
                n += popped[node]
                node = link[node]
                nxt = child[node].get(c)
            node = nxt or 0
        while node:
            n += popped[node]
            node = link[node]
        return n


class WordCounter:
    """Counts of words by hash, with a bounded table of those seen before."""

    def __init__(self, automaton: Automaton, most: int = 1 << 20):
        self.automaton, self.most = automaton, most
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __call__(self, raw, start, end, hashes) -> np.ndarray:
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        n = np.zeros(len(keys), np.int64)
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        n[known] = self.values[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            data, count = raw.tobytes(), self.automaton.count
            n[new] = [count(data[a:b].decode()) for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist())]
            if len(self.keys) + len(new) > self.most:
                self.keys, self.values = keys, n
            else:
                k = np.concatenate([self.keys, keys[new]])
                order = np.argsort(k)
                self.keys, self.values = k[order], np.concatenate([self.values, n[new]])[order]
        return n[back]


def pieces_of(model_file: str) -> list[str]:
    """The pieces of a sentencepiece model, without control, unknown and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


def token_counts(docs: DataFrame, pieces: list[str], text: str = "text", id_: str = "doc_id") -> DataFrame:
    """doc_id, n_words and n_tokens of every row. pieces: the vocabulary, sent to the executors once (a fixed size)."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches):
        counter = WordCounter(Automaton(shared.value))
        for b in batches:
            words, tokens = [], []
            for lo, hi, raw, at in K.text_chunks(b.column(1)):
                start, end, first = K.word_bounds(raw, at)
                n = counter(raw, start, end, K.word_hashes(raw, start, end, lower=False)) if len(start) else np.zeros(0, np.int64)
                total = np.concatenate([[0], np.cumsum(n)])
                words.append(np.diff(first))
                tokens.append(total[first[1:]] - total[first[:-1]])
            if words:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(words)), pa.array(np.concatenate(tokens))], ["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
