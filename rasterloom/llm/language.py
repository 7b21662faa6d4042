"""Language identification by a bidirectional gated recurrent network over bytes.

A gated recurrent layer reads the lower-cased (A-Z) bytes of a text from the left, another one from the right; a softmax
over both states labels every position, and a document's probabilities are the mean of its positions'. The network is
trained in numpy by backpropagation through time on the whole texts of a bounded sample of labelled documents, in windows.
A text is read whole, in segments of `segment` bytes that are read in step; each layer begins `lead` bytes before its
segment, so that the states at a segment's edge have seen what is beyond it.

The sample's bound is `per_language` documents of each language (by a hash of the id), with their whole texts.

Edge cases: a null text, or one without a letter, is "und" with score 0, as is every text if nothing could be learned;
labels that are null are not learned from; rows with a null id (whose `held_out` is null) are not learned from; equal texts have equal predictions; extra
columns are kept, columns lang_pred and score replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F, types as T

from rasterloom.llm import kernel as K
from rasterloom.llm.shared import trimmed

LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def held_out(id_, every: int, rest: int):
    """Whether the CRC-32 of the id's digits leaves this rest. A null id has no digits: null, so neither is learned from."""
    return F.crc32(F.col(id_).cast("string")) % every == rest


class Network:
    """Two gated recurrent layers of `width` units and a softmax over `labels`."""

    def __init__(self, labels: list[str], width: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.width = labels, width
        w, n = width, len(labels)
        self.p = {}
        for d in "fb":
            # input weights stand for one-hot bytes; gates: update, reset, candidate
            self.p["x" + d] = rng.normal(0, 0.3, (256, 3 * w)).astype(np.float32)
            self.p["u" + d] = rng.normal(0, 0.5 / np.sqrt(w), (w, 2 * w)).astype(np.float32)
            self.p["c" + d] = rng.normal(0, 0.5 / np.sqrt(w), (w, w)).astype(np.float32)
            self.p["o" + d] = rng.normal(0, 0.3, (w, n)).astype(np.float32)
        self.p["o"] = np.zeros(n, np.float32)

    def layer(self, x: np.ndarray, d: str):
        """States of one direction for bytes x (time, batch), and what the gradient needs."""
        w, (t, b) = self.width, x.shape
        inputs, u, c = self.p["x" + d], self.p["u" + d], self.p["c" + d]
        h, states, tape = np.zeros((b, w), inputs.dtype), np.empty((t, b, w), inputs.dtype), []
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            a = inputs[x[i]]
            g = 0.5 * np.tanh(0.5 * (a[:, : 2 * w] + h @ u)) + 0.5
            z, r = g[:, :w], g[:, w:]
            rh = r * h
            s = np.tanh(a[:, 2 * w :] + rh @ c)
            tape.append((i, h, z, r, rh, s))
            h = h + z * (s - h)
            states[i] = h
        return states, tape

    def states(self, x: np.ndarray, d: str, live: np.ndarray | None = None) -> np.ndarray:
        """The states alone: the same sums as `layer`, on arrays without gaps and in place. Where not live: 0."""
        w, (t, b) = self.width, x.shape
        half, inputs, u = np.float32(0.5), self.p["x" + d], self.p["u" + d]
        xz, xr, xs = (np.ascontiguousarray(inputs[:, k * w : (k + 1) * w] * f) for k, f in enumerate((half, half, np.float32(1))))
        uz, ur, c = np.ascontiguousarray(u[:, :w] * half), np.ascontiguousarray(u[:, w:] * half), self.p["c" + d]
        h, states, tmp = np.zeros((b, w), np.float32), np.empty((t, b, w), np.float32), np.empty((b, w), np.float32)
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            at = x[i]
            z, r, s = np.take(xz, at, axis=0), np.take(xr, at, axis=0), np.take(xs, at, axis=0)
            for g, m in ((z, uz), (r, ur)):
                np.dot(h, m, out=tmp)
                g += tmp
                np.tanh(g, out=g)
                g += 1  # twice the gate
            r *= h
            r *= half
            np.dot(r, c, out=tmp)
            s += tmp
            np.tanh(s, out=s)
            s -= h
            s *= z
            s *= half
            h = np.add(h, s, out=states[i])
            if live is not None and not live[i].all():
                h *= live[i][:, None]
        return states

    def probabilities(self, x: np.ndarray, live: np.ndarray | None = None, lead: int = 0) -> np.ndarray:
        """(labels, time, batch) for bytes x (time, batch), the first and last `lead` of which are read only before and
        after the others; bytes that are not live belong to no text."""
        t = len(x) - 2 * lead
        cut = lambda lo, hi: (x[lo:hi], d, None if live is None or live[lo:hi].all() else live[lo:hi])
        d = "f"
        e = self.p["of"].T @ self.states(*cut(0, lead + t))[lead:].reshape(-1, self.width).T
        d = "b"
        e += self.p["ob"].T @ self.states(*cut(lead, len(x)))[:t].reshape(-1, self.width).T
        e += self.p["o"][:, None]
        np.exp(e, out=e)
        e /= e.sum(axis=0)
        return e.reshape(-1, t, x.shape[1])

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over positions and its gradient. y: label of each window of the batch, weight: its weight."""
        w, (t, b) = self.width, x.shape
        both = {d: self.layer(x, d) for d in "fb"}
        e = sum(both[d][0] @ self.p["o" + d] for d in "fb") + self.p["o"]
        e = np.exp(e - e.max(axis=-1, keepdims=True))
        e /= e.sum(axis=-1, keepdims=True)
        loss = float(-(np.log(e[:, np.arange(b), y] + 1e-9) * weight).mean())
        e[:, np.arange(b), y] -= 1
        e *= (np.broadcast_to(weight, b) / (t * b)).astype(e.dtype)[None, :, None]
        grad = {"o": e.sum(axis=(0, 1))}
        for d in "fb":
            states, tape = both[d]
            grad["o" + d] = np.tensordot(states, e, axes=([0, 1], [0, 1]))
            above = e @ self.p["o" + d].T
            dx, du, dc = np.zeros_like(self.p["x" + d]), np.zeros_like(self.p["u" + d]), np.zeros_like(self.p["c" + d])
            dh = np.zeros((b, w), np.float32)
            for i, h, z, r, rh, s in reversed(tape):
                dh = dh + above[i]
                ds = dh * z * (1 - s * s)
                drh = ds @ self.p["c" + d].T
                dc += rh.T @ ds
                da = np.concatenate([dh * (s - h) * z * (1 - z), drh * h * r * (1 - r)], axis=1)
                du += h.T @ da
                dh = dh * (1 - z) + drh * r + da @ self.p["u" + d].T
                # sums by byte as one product would need a one-hot matrix of the same cost
                np.add.at(dx, x[i], np.concatenate([da, ds], axis=1))
            grad |= {"x" + d: dx, "u" + d: du, "c" + d: dc}
        return loss, grad

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 2, batch: int = 128, rate: float = 0.02, seed: int = 11, weight: np.ndarray | None = None) -> float:
        """Adam over shuffled windows x (count, time); returns the last epoch's mean loss."""
        rng, m, v, step, loss = np.random.default_rng(seed), {}, {}, 0, 0.0
        weight = np.ones(len(x), np.float32) if weight is None else weight
        for _ in range(epochs):
            losses = []
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                loss, grad = self.gradient(x[at].T, y[at], weight[at])
                losses.append(loss)
                step += 1
                for k, g in grad.items():
                    g = np.clip(g, -1, 1)
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            loss = float(np.mean(losses))
        return loss

    def documents(self, col: pa.Array, segment: int = 256, lead: int = 32, limit: int = 1 << 20) -> np.ndarray:
        """Mean probabilities (rows, labels) of each text's positions; 0 for an empty text."""
        out = []
        for lo, hi, raw, at in K.text_chunks(col, limit):
            size = np.diff(at)
            parts = -(-size // segment)
            row = np.repeat(np.arange(hi - lo), parts)
            first = np.concatenate([[0], np.cumsum(parts)])
            start = at[row] + (np.arange(len(row)) - first[row]) * segment
            length = np.minimum(segment, at[row + 1] - start)
            total = np.zeros((len(row), len(self.labels)), np.float32)
            low = K.LOWER[raw]
            # segments go together by rising length, texts of one segment apart, since these have nothing to lead in
            alone = parts[row] == 1
            order = np.lexsort((length, alone))
            edge = len(order) - int(alone.sum())
            for a, b in ((0, edge), (edge, len(order))):
                for k in range(a, b, 1024):
                    own = order[k : min(b, k + 1024)]
                    t, before = int(length[own].max()), 0 if alone[own[0]] else lead
                    at_ = start[own] + np.arange(-before, t + before)[:, None]
                    inside = (at_ >= at[row[own]]) & (at_ < at[row[own] + 1])
                    p = self.probabilities(low[np.clip(at_, 0, len(low) - 1)], inside, before)
                    if length[own].min() < t:
                        p[:, np.arange(t)[:, None] >= length[own]] = 0
                    total[own] = p.sum(axis=1).T
            sums = np.zeros((hi - lo, len(self.labels)))
            np.add.at(sums, row, total)
            out.append(sums / np.maximum(size, 1)[:, None])
        return np.concatenate(out) if out else np.zeros((0, len(self.labels)))


def windows(texts: list[bytes], window: int) -> np.ndarray:
    """All bytes of some texts, lower-cased, in windows of one size; the last one of a text reaches back, or repeats it."""
    out = []
    for text in texts:
        data = K.LOWER[np.frombuffer(text, np.uint8)]
        if len(data) < window:
            data = np.resize(data, window)
        n = len(data) // window
        out.append(data[: n * window].reshape(n, window))
        if len(data) % window:
            out.append(data[None, -window:])
    return np.concatenate(out)


def train(labelled: DataFrame, per_language: int = 40, window: int = 64, **how) -> Network | None:
    """A network for the languages of labelled (doc_id, text, lang); None if there are none.

    The whole texts of per_language documents of each language, those with the smallest hash of the id, come to the
    driver. All windows are learned from, each language's weighing alike.
    """
    rows = labelled.where("lang IS NOT NULL AND doc_id IS NOT NULL AND length(text) > 0").select("lang", "doc_id")
    # each task leaves its first rows of a language before the shuffle; twice the bound, as some may have no letter
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = rows.withColumn("rank", rank).where(F.col("rank") <= 2 * per_language).select("doc_id").distinct()
    texts = labelled.where("lang IS NOT NULL").select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id")
    docs: dict[str, list] = {}
    for r in sorted(texts.collect(), key=lambda r: (r.lang, r.doc_id, r.text)):
        own = docs.setdefault(r.lang, [])
        if len(own) < per_language and LETTER.search(r.text or ""):
            own.append(r.text.encode())
    labels = sorted(k for k in docs if docs[k])
    if not labels:
        return None
    x = [windows(docs[k], window) for k in labels]
    net = Network(labels)
    weight = np.concatenate([np.full(len(w), sum(map(len, x)) / len(x) / len(w), np.float32) for w in x])
    net.fit(np.concatenate(x), np.repeat(np.arange(len(x)), [len(w) for w in x]), weight=weight, **how)
    return net


def identify(docs: DataFrame, net: Network | None, keep_from: float | None = None) -> DataFrame:
    """docs with lang_pred and score in place of columns of these names. The network (some thousand numbers) goes with the
    task. keep_from: only the columns of docs, and only rows of a language with such a score or more."""
    names, at = docs.columns, docs.columns.index("text")
    kept = [i for i, c in enumerate(names) if keep_from is not None or c.lower() not in ("lang_pred", "score")]
    schema = T.StructType([docs.schema.fields[i] for i in kept])
    if keep_from is None:
        schema = T.StructType([*schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for b in batches:
            texts = b.column(at)
            p = net.documents(texts) if net else np.zeros((len(texts), 1))
            best = p.argmax(axis=1)
            plain = [t is not None and net is not None and LETTER.search(t) is not None for t in texts.to_pylist()]
            score = [min(1.0, round(float(v), 6)) if ok else 0.0 for v, ok in zip(p[np.arange(len(p)), best].tolist(), plain)]
            if keep_from is not None:
                yield b.filter(pa.array([ok and s >= keep_from for ok, s in zip(plain, score)], pa.bool_()))
                continue
            lang = [net.labels[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), plain)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array(lang, pa.string()), pa.array(score, pa.float64())], schema.names)

    return docs.mapInArrow(trimmed(run), schema)
