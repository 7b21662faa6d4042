"""Secret scans: sliding-window Shannon entropy over candidate strings, beside fixed patterns.

Fixed patterns (kinds assign, access, hex) are searched leftmost and without overlap; a match that is too short is
dropped after it has used up its place. Candidate strings for entropy are maximal runs of `[A-Za-z0-9+/_=-]` of at least
`least` characters. A window of `window` characters slides over a candidate, and over each maximal run of at least `least`
characters of a narrower class in it, so that a name or path glued to a secret does not raise the secret's limit: each
character class (hex, base 32, letters and digits, base 64) has its own limit, and the entropy is kept by incremental
counts. The windows above the limit join into spans of kind `entropy`. Candidates that look like known harmless strings
(words, numbers, UUIDs, paths, placeholders) are suppressed, and so are runs; of a span, the longest part between separators
is asked whether it is an example, so that a name beside a secret does not hide it. An entropy span may lie inside a fixed one.

Edge cases: a null text counts as empty and has no span; positions are code points, the end exclusive; repeated rows give
repeated results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rasterloom.llm import kernel as K

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HEX = _class(DIGITS + "abcdef")
CANDIDATE = _class(DIGITS + UPPER + LOWER + "+/_=-")
#: Character classes from narrow to wide, and the entropy in bits a character from which a window of 20 is suspect.
CLASSES = [
    ("hex", set((DIGITS + "abcdef").encode()), 3.0),
    ("HEX", set((DIGITS + "ABCDEF").encode()), 3.0),
    ("base32", set((UPPER + "234567=").encode()), 3.6),
    ("alnum", set((DIGITS + UPPER + LOWER).encode()), 3.8),
    ("base64", set((DIGITS + UPPER + LOWER + "+/_=-").encode()), 3.9),
]
RUNS = [(re.compile(b"[" + re.escape(bytes(sorted(chars))) + b"]+"), chars, limit) for _, chars, limit in CLASSES]
#: Harmless strings: UUIDs, words and words joined by separators, plain numbers and dates, paths, placeholders.
ALLOWED = re.compile(
    rb"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"
    rb"|[/=_+-]*(?:[A-Za-z]+[/=_+-]+)*[A-Za-z]+[/=_+-]*"
    rb"|[0-9/=_+-]+"
    rb"|(?:/?[A-Za-z_]+[0-9]{0,4}/)+[A-Za-z_]*[0-9]{0,4}"
    rb"|(?i:your)(?:[_-][A-Za-z0-9]{1,12})+"
)
#: Harmless if within the longest part, between separators, that a span touches.
PHRASE = re.compile(rb"(?i)example|placeholder|changeme|xxxx")
PART = re.compile(rb"[A-Za-z0-9]+")


def runs(mask: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of at least so many true bytes within a row."""
    edge = np.zeros(len(mask) + 1, bool)
    edge[at] = True
    begin, final = mask.copy(), mask.copy()
    begin[1:] &= ~mask[:-1] | edge[1:-1]
    final[:-1] &= ~mask[1:] | edge[1:-1]
    start, end = np.flatnonzero(begin), np.flatnonzero(final) + 1
    long = end - start >= least
    return start[long], end[long]


def hot_windows(s: bytes, limit: float, window: int) -> list[tuple[int, int]]:
    """Joined windows of s whose Shannon entropy, in bits a character, is above limit."""
    w = min(window, len(s))
    part = [0.0] + [k * math.log2(k) for k in range(1, w + 2)]
    count, total, out = dict.fromkeys(s, 0), 0.0, []
    for i, c in enumerate(s):
        k = count[c]
        total += part[k + 1] - part[k]
        count[c] = k + 1
        if i >= w:
            k = count[d := s[i - w]]
            total += part[k - 1] - part[k]
            count[d] = k - 1
        if i >= w - 1 and math.log2(w) - total / w > limit:
            if out and out[-1][1] >= i - w + 1:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((i - w + 1, i + 1))
    return out


def entropy_spans(s: bytes, window: int = 20, allowed: re.Pattern = ALLOWED, least: int = 20) -> list[tuple[int, int]]:
    """Spans of a candidate string that are suspect, none if an allowed form matches the whole of it.

    Each run of a class counts as a candidate of its own, up to the first class that holds the whole string.
    """
    if allowed.fullmatch(s):
        return []
    have, found = set(s), []
    for run, chars, limit in RUNS:
        if have <= chars:
            found += hot_windows(s, limit, window)
            break
        for m in run.finditer(s):
            if m.end() - m.start() >= least and not allowed.fullmatch(m[0]):
                found += [(m.start() + a, m.start() + b) for a, b in hot_windows(m[0], limit, window)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return [x for x in out if not harmless(s, *x)]


def harmless(s: bytes, a: int, b: int) -> bool:
    """Whether the longest part of s that a span touches holds a harmless phrase; one beside it does not count."""
    parts = [m[0] for m in PART.finditer(s) if m.start() < b and m.end() > a]
    return bool(parts) and PHRASE.search(max(parts, key=len)) is not None


def base_spans(data: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the fixed patterns in one text, in bytes; hex is left to `runs`."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(data) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(data) if m.end() - m.start() >= 16]
    return out


def scan_column(col: pa.Array, least: int = 20, window: int = 20) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of every span in every text, in code points, by start and then kind."""
    out: list[list[tuple[int, int, str]]] = []
    for lo, hi, raw, at in K.text_chunks(col):
        found: dict[int, list[tuple[int, int, int]]] = {}
        data = raw.tobytes()
        # a base match starts at one of these words; they cannot cross rows once checked against the row's bytes
        low = data.lower()
        rows = set()
        for word in (b"passw", b"secret", b"token", b"api", b"akia"):
            p = low.find(word)
            while p >= 0:
                r = int(np.searchsorted(at, p, "right")) - 1
                rows.add(r)
                p = low.find(word, int(at[r + 1]))
        for r in rows:
            if spans := base_spans(data[at[r] : at[r + 1]]):
                found.setdefault(r, []).extend(spans)
        for kind, mask, n in ((2, HEX, 32), (3, CANDIDATE, least)):
            start, end = runs(mask[raw], at, n)
            for a, b, r in zip(start.tolist(), end.tolist(), (np.searchsorted(at, start, "right") - 1).tolist()):
                o = int(at[r])
                if kind == 2:
                    found.setdefault(r, []).append((a - o, b - o, 2))
                else:
                    for x, y in entropy_spans(data[a:b], window, least=least):
                        found.setdefault(r, []).append((x + a - o, y + a - o, 3))
        for r in range(hi - lo):
            spans = sorted(found.get(r, ()), key=lambda s: (s[0], s[2], s[1]))
            if spans:
                text = data[at[r] : at[r + 1]]
                if not text.isascii():
                    # code points before a byte: bytes that do not continue a sequence
                    points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
                    spans = [(int(points[a]), int(points[b]), k) for a, b, k in spans]
            out.append([(a, b, KINDS[k]) for a, b, k in spans])
    return out


def digest(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """doc_id and the spans found in each text, as structs."""

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            spans = [[{"kind": k, "start": s, "end": e} for s, e, k in row] for row in scan_column(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint>>")


def scan_digests(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans of each text: see `queries.op8_secret_scans`."""
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    kinds = [*[pa.int64()] * 4, pa.string(), pa.string()]

    def run(batches):
        for b in batches:
            out = []
            for id_, spans in zip(b.column(0).to_pylist(), scan_column(b.column(1))):
                base = [s for s in spans if s[2] != "entropy"]
                n = [sum(s[2] == k for s in base) for k in KINDS[:3]]
                out.append((id_, *n, hashlib.sha256(digest(base).encode()).hexdigest(), digest(spans)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs, with every span of its text replaced by mark (overlapping spans by one); the columns stay as they are.

    A column n_chars, if there is one, is set to the new length of a changed text. A null text stays null.
    """
    schema, at = docs.schema, docs.columns.index(text)
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for b in batches:
            col = b.column(at)
            new, sizes = {}, {}
            for i, spans in enumerate(scan_column(col)):
                if spans:
                    s, done, parts = col[i].as_py(), 0, []
                    for x, y, _ in spans:
                        if y > done:
                            parts += [s[done:x], mark] if x >= done else []
                            done = y
                    new[i] = "".join(parts) + s[done:]
                    sizes[i] = len(new[i])
            if new:
                cols = list(b.columns)
                cols[at] = pa.array([new.get(i, v) for i, v in enumerate(col.to_pylist())], col.type)
                if count is not None:
                    cols[count] = pa.array([sizes.get(i, v) for i, v in enumerate(cols[count].to_pylist())], cols[count].type)
                b = pa.RecordBatch.from_arrays(cols, schema=b.schema)
            yield b

    return docs.mapInArrow(run, schema)
