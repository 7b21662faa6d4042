"""Spelling variants by anagram hashing.

The key of a word is the sum of the fifth powers of its letters' code points, modulo 2**61: anagrams share it, and words
that differ by one letter added, removed or exchanged have keys that differ by one letter's power or by the difference of two.
An exchange is an equation between two keys, each less one of its word's letters, so all three cases are equality joins:
keys less a letter meet keys less another letter (exchange) and whole keys (removal and, seen from the other word, addition).
No sum of two fifth powers of these letters is another such sum, so two words meet for one pair of letters only. Of words
that meet, the order of letters is verified by the edit distance, which must be 1.

A word sends one row for each of its different letters. Keys that more than `most` rows share (many anagrams) are split by
the order of the letters left, so that of such a class only words with the same rest meet: at most one for each letter of
the alphabet.

Edge cases: a null or empty text has no words; repeated rows count each time; an empty table gives an empty result; extra
columns are ignored; of near words that are equally frequent the smallest in code-point order is the form.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from rasterloom.llm.shared import as_parquet

#: Letters: ASCII ones and U+00C0 to U+00FF.
LETTERS = r"[A-Za-zÀ-ÿ]"
MASK = (1 << 61) - 1


def words(docs: DataFrame, shortest: int = 7, least: int = 2, change: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """word and n of the maximal runs of letters, A to Z lower-cased, that have at least `shortest` letters and occur at least
    `least` times. change: what to count instead of a word of a document, given (doc_id, word); not longer than the word."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{shortest},}}"), 0)).alias("word"))
    runs = runs.select("doc_id", F.translate("word", string.ascii_uppercase, string.ascii_lowercase).alias("word"))
    if change:
        runs = runs.select(change(F.col("doc_id"), F.col("word")).alias("word")).where(F.char_length("word") >= shortest)
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def drop_one(modulus: int) -> Callable[[Column, Column], Column]:
    """A change that deletes a letter of one occurrence in `modulus`: where that divides the crc32 h of `<doc_id>:<word>`, the
    letter h mod length. A null doc_id is written as nothing."""

    def change(id_: Column, word: Column) -> Column:
        h = F.crc32(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
        at = (h % F.char_length(word)).cast("int")
        return F.when(h % modulus == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))).otherwise(word)

    return change


def power(letter: Column) -> Column:
    return F.pow(F.ascii(letter).cast("double"), F.lit(5.0)).cast("long")


def keyed(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of words less each of their different letters (word, n, letter, key, size), and of whole words (letter null)."""
    letters = F.filter(F.split("word", ""), lambda c: c != "")
    key = F.aggregate("_letters", F.lit(0).cast("long"), lambda total, c: (total + power(c)).bitwiseAND(MASK))
    rows = counts.select("word", "n", letters.alias("_letters")).select("word", "n", key.alias("key"), F.size("_letters").alias("size"), F.array_distinct("_letters").alias("_letters"))
    less = rows.select("word", "n", F.explode("_letters").alias("letter"), "key", (F.col("size") - 1).alias("size"))
    less = less.withColumn("key", (F.col("key") - power(F.col("letter"))).bitwiseAND(MASK))
    return less, rows.select("word", "n", F.lit(None).cast("string").alias("letter"), "key", "size")


def rests(word: Column, letter: Column) -> Column:
    """The different strings that a word leaves without one occurrence of a letter; a whole word (no letter) leaves itself."""
    places = F.filter(F.sequence(F.lit(1), F.char_length(word)), lambda i: F.substring(word, i, F.lit(1)) == letter)
    less = F.transform(places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.char_length(word))))
    return F.when(letter.isNull(), F.array(word)).otherwise(F.array_distinct(less))


def near_words(counts: DataFrame, most: int = 256) -> DataFrame:
    """Pairs (word, near, near_n) of words that differ by one letter added, removed or exchanged, in both directions."""
    less, whole = keyed(counts)
    both = less.unionByName(whole)
    crowded = both.groupBy("key", "size").agg(F.count("*").alias("_rows")).where(F.col("_rows") > most).select("key", "size", F.lit(True).alias("_crowded"))

    def split(rows: DataFrame) -> DataFrame:
        rows = rows.join(crowded, ["key", "size"], "left")
        return rows.withColumn("rest", F.explode(F.when(F.col("_crowded"), rests(F.col("word"), F.col("letter"))).otherwise(F.array(F.lit(""))))).drop("_crowded")

    left, right = (split(x).select("key", "size", "rest", *(F.col(c).alias(f"{p}_{c}") for c in ("word", "n", "letter"))) for x, p in ((less, "a"), (both, "b")))
    exchanged = (F.col("a_letter") != F.col("b_letter")) & (F.col("a_word") < F.col("b_word"))
    met = left.join(right, ["key", "size", "rest"]).where((F.col("b_letter").isNull() | exchanged) & (F.levenshtein("a_word", "b_word", 1) == 1))
    # words of a crowded key may meet by several equal rests
    tied = F.col("rest") != ""
    met = met.where(~tied).select("a_word", "a_n", "b_word", "b_n").unionByName(met.where(tied).select("a_word", "a_n", "b_word", "b_n").distinct())
    way = lambda x, y: F.struct(F.col(f"{x}_word").alias("word"), F.col(f"{y}_word").alias("near"), F.col(f"{y}_n").alias("near_n"))
    return met.select(F.inline(F.array(way("a", "b"), way("b", "a"))))


def forms(counts: DataFrame, ratio: int = 10, most: int = 256) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word (written once here).

    form: the most frequent near word, if it has at least ratio times as many occurrences; root: the last of the forms
    that follow from a word. Each form is ratio times as frequent as its word, so there are few: found by doubling steps.
    """
    near = near_words(counts, most).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("_best"))
    enough = -F.col("_best.n") >= ratio * F.col("n")
    rows = counts.join(near, "word", "left").select(
        "word", F.when(enough, F.col("_best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, -F.col("_best.n")).alias("form_n")
    )
    rows = as_parquet(rows, "forms")
    jump = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    top = rows.agg(F.max("n")).first()[0] or 1
    for _ in range(math.ceil(math.log2(1 + math.log(top, ratio)))):
        on = jump.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        jump = as_parquet(jump.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
    return rows.join(jump, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE_SQL = r"""
WITH RECURSIVE rule AS (
  SELECT i, 0 AS k, i AS c FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM rule WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS l FROM rule WHERE k = 8),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), own AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (SELECT *, hex(coalesce(doc_id::VARCHAR, '') || ':' || run) AS x FROM own),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(x) // 2 + 1), lambda i: ('0x' || substr(x, 2 * i - 1, 2))::BIGINT)),
                                 lambda a, b: xor(a >> 8, l[1 + (xor(a, b) & 255)])), 4294967295::BIGINT) AS h
  FROM bytes CROSS JOIN crc_table
), changed AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
), w AS (SELECT word, sum(n)::BIGINT AS n FROM changed WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
less AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM places),
wild AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS rest FROM places),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM wild a JOIN wild b ON a.rest = b.rest AND a.word <> b.word
  UNION ALL SELECT l.word, w.word, w.n FROM less l JOIN w ON l.rest = w.word
  UNION ALL SELECT w.word, l.word, l.n FROM less l JOIN w ON l.rest = w.word
), ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r, count(*) OVER (PARTITION BY word) AS n_near FROM near),
f AS (
  SELECT w.word, CASE WHEN r.near_n >= 10 * w.n THEN r.near END AS form, w.n, coalesce(r.n_near, 0)::BIGINT AS n_near, CASE WHEN r.near_n >= 10 * w.n THEN r.near_n END AS form_n
  FROM w LEFT JOIN ranked r ON w.word = r.word AND r.r = 1
), chain AS (
  SELECT word, word AS at FROM f
  UNION ALL
  SELECT c.word, f.form FROM chain c JOIN f ON c.at = f.word WHERE f.form IS NOT NULL
), ends AS (SELECT c.word, c.at AS root FROM chain c JOIN f ON c.at = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, ends.root, f.n, f.n_near, f.form_n FROM f JOIN ends ON f.word = ends.word
"""
