"""Operator 13: grouping of spelling variants by PartEnum signatures.

A word's letters are a multiset: a binary vector with a place for each occurrence of each letter. One
inserted or deleted letter changes one place and a replaced one two, so words one edit apart lie within
Hamming distance two. The letters are dealt into sections; whatever two places differ, all but two sections
agree, so a word has a signature for each choice of the sections kept (its letters there), and near words
share one at least. Signatures meet in an equi-join, which verifies the edit distance before it emits.

Scale: occurrences are counted with map-side sums, so frequent words don't gather; the join's rows are
short and a signature that many words share is a skewed join, which Spark splits; only verified pairs leave
it. Roots are found by pointer doubling: a form has at least twice the word's count, so chains are short.
Joins are merges: by the size of its file Spark would take the table of words, and its rows by signature, of
which a word has 15, for small enough to broadcast, and gather them on the driver.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = r"[A-Za-zÀ-ÿ]+"
#: All letters that RUN leaves after lower-casing.
LETTERS = _LOWER + "".join(map(chr, range(0xC0, 0x100)))


def runs(df: DataFrame, least: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, word) of each run of at least ``least`` letters, only A-Z lower-cased."""
    run = df.select(F.col(key).alias("doc_id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    run = run.filter(F.octet_length("run") >= least).filter(F.char_length("run") >= least)
    plain = F.octet_length("run") == F.char_length("run")
    return run.select("doc_id", F.when(plain, F.lower("run")).otherwise(F.translate("run", _UPPER, _LOWER)).alias("word"))


def misspelt(run: DataFrame, one_in: int) -> DataFrame:
    """(word): of runs whose crc32 with the document's id is divisible by ``one_in``, a letter is deleted."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
    run = run.withColumn("h", h).withColumn("at", (F.col("h") % F.char_length("word")).cast("int"))
    cut = F.concat(F.expr("substring(word, 1, at)"), F.expr("substring(word, at + 2)"))
    return run.select(F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("word")).alias("word"))


def sections(words: DataFrame, number: int) -> list[str]:
    """The letters dealt into so many sections of about equal weight: by falling frequency, there and back."""
    counts = {r.c: r.n for r in words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").agg(F.count("*").alias("n")).collect()}  # one row a letter
    order = sorted(counts, key=lambda c: (-counts[c], c))
    turn = [*range(number), *reversed(range(number))]
    return ["".join(c for i, c in enumerate(order) if turn[i % len(turn)] == s) for s in range(number)]


def signatures(parts: list[str]) -> Column:
    """Hashes of a word's sorted letters in all but two sections, one for each pair left out."""
    letters = "".join(parts)
    inside = [F.translate("letters", "".join(c for c in letters if c not in p), "") for p in parts]
    kept = lambda out: F.xxhash64(*(F.lit(-1) if i in out else x for i, x in enumerate(inside)))
    return F.array(*(kept(out) for out in combinations(range(len(parts)), 2)))


def near_pairs(words: DataFrame, number: int = 6) -> DataFrame:
    """(a, a_n, b, b_n) of words (word, n), a < b, that differ by one inserted, deleted or replaced letter."""
    # parity: a bit for each letter, set where it stands an odd number of times; an edit flips two at most.
    parity = F.expr("aggregate(split(word, ''), 0L, (s, c) -> s ^ shiftleft(1L, ascii(c) % 64))")
    signed = words.select("word", "n", parity.alias("parity"), F.array_join(F.array_sort(F.split("word", "")), "").alias("letters"))
    signed = signed.select("word", "n", "parity", F.explode(signatures(sections(words, number))).alias("sig"))
    a, b = signed.alias("a"), signed.alias("b")
    alike = F.bit_count(F.col("a.parity").bitwiseXOR(F.col("b.parity"))) <= 2
    near = alike & (F.col("a.word") < F.col("b.word")) & (F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1)
    pairs = a.join(b.hint("merge"), (F.col("a.sig") == F.col("b.sig")) & near)
    return pairs.select(F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"), F.col("b.n").alias("b_n")).distinct()


def forms(words: DataFrame, pairs: DataFrame, times: int = 2) -> DataFrame:
    """(word, n_near, form, form_n) of the words that have near ones: form is the most frequent of these
    (ties: the first in code-point order) if it is at least so many times as frequent, else null."""
    both = F.array(F.struct("a", "a_n", "b", "b_n"), F.struct(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    ways = pairs.select(F.inline(both))
    best = ways.groupBy(F.col("a").alias("word"), F.col("a_n").alias("n")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), "b")).alias("best"))
    best = best.select("word", "n", "n_near", F.col("best.b").alias("form"), (-F.col("best.less")).alias("form_n"))
    fit = F.col("form_n") >= times * F.col("n")
    return best.select("word", "n_near", F.when(fit, F.col("form")).alias("form"), F.when(fit, F.col("form_n")).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """(word, root) of the words with a form: the last that its forms lead to. Each round doubles the steps
    taken; counts double along a chain, so the rounds are six at most."""
    at = written(found.filter("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while at.filter("moved").limit(1).count():
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = written(at.join(on.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
    return at.select("word", "root")


def spelling_variants(df: DataFrame, least: int = 5, times: int = 3, one_in: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of at least ``least`` letters that stand ``times``
    times or more. With ``one_in``, one in so many runs of letters loses a letter first. A null text has no words,
    a null id counts as empty in the choice of runs, each row counts on its own; empty tables give no rows."""
    word = runs(df, least, key, text)
    if one_in:
        word = misspelt(word, one_in).filter(F.char_length("word") >= least)
    words = written(word.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= times), "words")
    found = written(forms(words, near_pairs(words)), "forms")
    out = words.join(found.hint("merge"), "word", "left").join(roots(found).hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir), one_in=97)
