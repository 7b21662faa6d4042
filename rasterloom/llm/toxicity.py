"""Toxicity: a weighted lexicon, matched by Aho-Corasick on folded text, normalised by length, with exception phrases.

Folding lower-cases, turns look-alike letters of other scripts and full-width forms into Latin ones, digits and signs
that stand for letters into those letters (`1` and `l` into `i`, as both readings occur), and everything that is no
letter into a space, one character each, so that positions stay.

The lexicon is learned from a bounded sample of labelled documents: whole words and beginnings of words that by their
odds mark toxic documents, beyond chance (a binomial test over all that could pass it), whatever the number of labels. Some
mark them by being there; others, which chance makes of clean words too, by being there more often than a text of that
length has them by chance. A beginning is lengthened while nine tenths of its documents stay. An entry's weight is minus the
log of its chance for each character; what its matches in a text tell is k (log k + weight - log length) - k + expected
matches, the deviance of a Poisson count, so that length counts against them. Words and pairs of words that hold an entry
and yet are found in clean documents become exception phrases, as may given ones; a match inside an exception phrase does
not count. A logistic curve fitted to the sample makes a score of the sum over all entries.

Edge cases: a null or empty text has no match; without labels of both kinds every score is 0; equal texts have equal
scores; a whole text is matched, whatever its length; labels of a null id are not learned from (in the query its held_out is
null); extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Letters of other scripts that look like Latin ones, and the Latin ones.
LOOKALIKE = dict(zip("абвгеѕіїјкмнорстухԁһԛԝαβγεικνορτυχω", "abbresiijkmhopctyxdhqwabyeiknoptuxw"))
#: Digits and signs read as letters.
DIGIT_LETTERS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "l": "i"}
FULL_WIDTH = {chr(0xFF01 + i): chr(0x21 + i).lower() for i in range(94)}
ODD = re.compile("[" + "".join(LOOKALIKE) + chr(0xFF01) + "-" + chr(0xFF5E) + "]")
UNODD = str.maketrans(LOOKALIKE | FULL_WIDTH)
SIGNS = re.compile(r"(?<=[^\W\d_])[@$](?=[^\W\d_])")
TABLE = bytes(ord(DIGIT_LETTERS.get(chr(b), chr(b) if chr(b).isalpha() else " ")) if b < 128 else b for b in range(256))
#: Punctuation beyond ASCII that ends a word.
WIDE_SPACE = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0xA1, 0xA9), (0xAB, 0xB4), (0xB6, 0xB9), (0xBB, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7), (0x2000, 0x206F), (0x3000, 0x303F))) + "]")


def fold(text: str) -> str:
    """Folded text with a space before and after."""
    t = text.lower()
    if ODD.search(t):
        t = t.translate(UNODD)
    if "@" in t or "$" in t:
        t = SIGNS.sub(lambda m: "a" if m[0] == "@" else "s", t)
    t = t.encode().translate(TABLE).decode()
    return f" {WIDE_SPACE.sub(' ', t)} "


def telling(k: int, expected: float) -> float:
    """How much k matches tell where so many are expected: half the deviance of a Poisson count, 0 if there are no more."""
    return k * math.log(k / expected) - k + expected if k > expected else 0.0


def untruncated(mean: float) -> float:
    """The mean of a Poisson count whose mean where it is not 0 is given."""
    low, high = 1e-6, mean
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if middle / -math.expm1(-middle) < mean else (low, middle)
    return high


class Lexicon:
    """Entries (with a space where a word must begin or end) and weights, exception phrases and the curve of the score."""

    def __init__(self, entries: dict[str, float], exceptions=(), curve: tuple[float, float] = (0.0, 0.0)):
        self.entries, self.exceptions, self.curve = entries, sorted(exceptions), curve
        self.made = None

    def automaton(self):
        if self.made is None:
            import ahocorasick

            self.made = ahocorasick.Automaton()
            for k in self.entries:
                self.made.add_word(k, (len(k), k))
            for k in self.exceptions:
                self.made.add_word(k, (len(k), None))
            self.made.make_automaton()
        return self.made

    def __getstate__(self):
        return self.__dict__ | {"made": None}

    def matches(self, folded: str) -> list[tuple[int, int, str]]:
        """(start, end, entry) of the entries in a folded text that no exception phrase covers."""
        found, safe = [], []
        for last, (size, entry) in self.automaton().iter(folded):
            (safe if entry is None else found).append((last + 1 - size, last + 1, entry))
        if safe and found:
            found = [m for m in found if not any(a <= m[0] and m[1] <= b for a, b, _ in safe)]
        return found

    def density(self, text: str) -> float:
        """Log of 1 plus what the matches tell at the text's length."""
        if not text or not self.entries:
            return 0.0
        hits = Counter(entry for *_, entry in self.matches(fold(text)))
        return math.log1p(sum(telling(k, len(text) * math.exp(-self.entries[e])) for e, k in hits.items()))

    def score(self, text: str) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, a + b * self.density(text))))) if self.entries else 0.0


def features(folded: str, shortest: int = 2, longest: int = 12) -> set[str]:
    """Beginnings of words and whole words of a folded text."""
    out = set()
    for w in set(folded.split()):
        word = f" {w} "
        out.update(word[: k + 1] for k in range(shortest, min(len(w), longest) + 1))
        out.add(word)
    return out


def tail(k: int, n: int, p: float) -> float:
    """The probability of k or more hits in n trials of probability p."""
    choose = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
    return sum(math.exp(choose(i) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k, n + 1))


def occurrences(folded: list[str], wanted: set[str], longest: int) -> list[Counter]:
    """How often each wanted feature is in each text."""
    out = []
    for t in folded:
        own = Counter()
        for w, n in Counter(t.split()).items():
            word = f" {w} "
            for f in [*(word[: k + 1] for k in range(3, min(len(w), longest) + 1)), word]:
                if f in wanted:
                    own[f] += n
        out.append(own)
    return out


def learn(toxic: list[str], clean: list[str], least: int = 3, chance: float = 0.05, odds: float = 40.0, often: float = 10.0, exceptions=()) -> Lexicon:
    """A lexicon from texts. least: an entry is in so many toxic texts, however many there are. chance: the most probability that any entry is one by chance. odds: the least ratio of the shares of toxic and of clean texts that have an entry; often: that have it more often than by chance."""
    if not toxic or not clean:
        return Lexicon({})
    toxic, clean = sorted(set(toxic)), sorted(set(clean))
    bad, good = [fold(t) for t in toxic], [fold(t) for t in clean]
    in_bad, in_good = (Counter(f for t in texts for f in features(t)) for texts in (bad, good))
    ratio = lambda b, g: (b + 0.5) / (len(bad) + 1) * (len(good) + 1) / (g + 0.5)
    part = len(bad) / (len(bad) + len(good))
    maybe = {f for f, n in in_bad.items() if n >= least and len(f) >= 4 and ratio(n, in_good[f]) >= 3}
    here, there = occurrences(bad, maybe, 12), occurrences(good, maybe, 12)
    total, size, own = Counter(), Counter(), sum(map(len, clean))
    for t, count in zip(clean, there):
        total.update(count)
        size.update(dict.fromkeys(count, len(t)))
    # by chance a beginning is found in texts of its language only: the rate is that of the texts that have it
    rate = {f: untruncated((total[f] + 1) / (in_good[f] + 0.5)) * in_good[f] / size[f] if total[f] else 0.5 / own for f in maybe}
    more = [Counter(f for t, count in zip(texts, counts) for f, k in count.items() if telling(k, rate[f] * len(t)) >= 1.2) for texts, counts in ((toxic, here), (clean, there))]
    limits = chance / max(1, len(in_bad)), chance / max(1, sum(n >= least for n in more[0].values()))
    passes = {}
    for f in maybe:
        by_presence = ratio(in_bad[f], in_good[f]) >= odds and tail(in_bad[f], in_bad[f] + in_good[f], part) <= limits[0]
        b, g = more[0][f], more[1][f]
        if by_presence:
            passes[f] = -math.log((total[f] + 0.5) / own)
        elif b >= least and ratio(b, g) >= often and tail(b, b + g, part) <= limits[1]:
            passes[f] = -math.log(rate[f])
    entries: dict[str, float] = {}
    after: dict[str, list[str]] = {}
    for f in passes:
        after.setdefault(f[:-1], []).append(f)
    for f in sorted(passes, key=lambda f: (len(f), f)):
        if any(f[:k] in entries for k in range(2, len(f))):
            continue
        # a beginning is taken once lengthening it would lose documents
        if max((in_bad[g] for g in after.get(f, ())), default=0) < 0.9 * in_bad[f]:
            entries[f] = passes[f]
    lexicon = Lexicon(entries)
    around = Counter()
    for t in good:
        phrases = set()
        for a, b, entry in lexicon.matches(t):
            if total[entry] > 2 * in_good[entry] or in_good[entry] * len(bad) * 20 > in_bad[entry] * len(good):
                continue  # made by chance in clean words, which are no phrases
            lo, hi = t.rfind(" ", 0, a + 1), t.find(" ", b - 1)
            phrases.add(t[lo : hi + 1])
            phrases.add(t[max(0, t.rfind(" ", 0, lo)) : hi + 1])
        around.update(phrases)
    found_bad = Counter()
    if around:
        probe = Lexicon(dict.fromkeys(around, 1.0))
        for t in bad:
            found_bad.update({t[a:b] for a, b, _ in probe.matches(t)})
    safe = {p for p, n in around.items() if n >= 2 and found_bad[p] * len(good) < n * len(bad)}
    lexicon = Lexicon(entries, safe | {fold(p) for p in exceptions})
    x = np.array([lexicon.density(t) for t in toxic + clean])
    y = np.array([1.0] * len(toxic) + [0.0] * len(clean))
    lexicon.curve = logistic(x, y)
    return lexicon


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[float, float]:
    """Intercept and slope (not negative) by Newton's method, the slope drawn to 0 by a ridge."""
    m, w = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        step = np.linalg.solve(m.T @ (m * (p * (1 - p))[:, None]) + np.diag([1e-6, ridge]), m.T @ (y - p) - np.array([0, ridge]) * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), max(0.0, float(w[1]))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 3000, **how) -> Lexicon:
    """A lexicon from the texts of at most per_class labelled documents of each class, those with the smallest hash.

    The sampled ids (a bounded number) are broadcast, so that documents are read once and not shuffled.
    """
    rows = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), (F.col("toxic") > 0).alias("_toxic")).distinct()
    place = (F.xxhash64("_id") / F.lit(2.0**63) + 1) / 2
    ids = None
    for kind in (True, False):
        part = rows.where(F.col("_toxic") == kind).select("_id", "_toxic", place.alias("_place")).orderBy("_place", "_id").limit(per_class)
        ids = part if ids is None else ids.unionByName(part)
    sample = docs.where("text IS NOT NULL").join(F.broadcast(ids), docs["doc_id"] == F.col("_id")).select("_toxic", "_place", "text").collect()
    by = {k: [r.text for r in sorted(sample, key=lambda r: (r._place, r.text)) if r._toxic == k] for k in (True, False)}
    return learn(by[True], by[False], **how)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and score of every row. The lexicon (bounded by its sample) goes with the task."""

    def run(batches):
        for b in batches:
            scores = [round(lexicon.score(t.as_py() or ""), 9) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")
