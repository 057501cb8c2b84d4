"""Spelling variants grouped under their more frequent neighbours.

Two words are near if one inserted, deleted or replaced character tells them apart. One such edit touches two of a
word's bigrams at most, so of the three bigrams that are rarest in a common order one is the same in both
words, and the edit lies wholly behind or wholly before it. A word is therefore listed under each of its three
rarest bigrams twice: at its place from the word's start, with all that stands before, and at its place from the
end, with all that follows. Words that meet under such a key, of lengths one apart at most, are verified by
their edit distance. Bigrams that tie with the third are listed as well, since equal bigrams of a word have one rank.

A word's form is its near word of largest count (ties: the smallest in code-point order) if that is at least
twice its own; its root is where its forms lead. Counts double along them, so paths are short: pointer jumping
ends after the logarithm of the logarithm of the largest count.

Defined results: null and empty texts have no words; repeated rows count each; a null id is written as "null" where
it decides on a deletion; other columns are ignored; words of any length are compared whole; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One run in so many loses a character in ``with_slips``.
SLIPS = 97
#: Bigrams that one edit leaves one of: two may be touched.
RAREST = 3
#: Bigrams whose counts are broadcast at most; the letters of the rule make 8,100.
BROADCAST_ROWS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, run): every run of letters of every text, A-Z in lower case."""
    found = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("id"), F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(RUN), F.lit(0))).alias("run"))
    plain = F.length("run") == F.octet_length("run")
    return found.select("id", F.when(plain, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))


def with_slips(found: DataFrame, one_in: int = SLIPS) -> DataFrame:
    """``found`` with ``word``: the run, of which the hash of id and run takes a character away once in ``one_in``."""
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    return found.withColumn("word", F.when(h % one_in == 0, cut).otherwise(F.col("run")))


def counted(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough; counts combine before the shuffle."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _bigrams(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: word.substr(i, F.lit(2)))


def letters(word: Column) -> Column:
    """A bit for each character that occurs, by its code modulo 64; one edit changes two bits at most."""
    return F.aggregate(F.array_distinct(F.split(word, "")), F.lit(0).cast("long"), lambda bits, c: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (F.ascii(c) % 64).cast("int"))))


def keys(words: DataFrame) -> DataFrame:
    """(word, n, size, end, part): ``part`` is a word's text up to the end of a rare bigram (``end`` false), or from its start on."""
    grams = words.select("word", "n", F.posexplode(_bigrams(F.col("word"))).alias("at", "gram"))
    often = materialize(grams.groupBy("gram").agg(F.count("*").alias("often")), "often")
    few = often.count() <= BROADCAST_ROWS
    ranked = grams.join(F.broadcast(often) if few else often.hint("merge"), "gram").groupBy("word", "n").agg(F.sort_array(F.collect_list(F.struct("often", "gram", "at"))).alias("g"))
    rank = lambda x: F.struct(x["often"].alias("often"), x["gram"].alias("gram"))
    rare = ranked.select("word", "n", F.explode(F.filter("g", lambda x: rank(x) <= rank(F.col("g")[RAREST - 1]))).alias("g"))
    word, at = F.col("word"), F.col("g.at")
    listed = F.array(F.struct(F.lit(False).alias("end"), word.substr(F.lit(1), at + 2).alias("part")), F.struct(F.lit(True).alias("end"), word.substr(at + 1, F.length("word")).alias("part")))
    return rare.select("word", "n", F.length("word").alias("size"), F.explode(listed).alias("k")).select("word", "n", "size", "k.end", "k.part").distinct()


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, an, b, bn): each pair of near words once, a < b, with their counts.

    The join is an equi-join also in the lengths, which the right side lists as its own and both next to it, so
    that adaptive execution can split it where a key is frequent; candidates are verified inside it, those whose letters
    differ too much by comparing bits.
    """
    listed = materialize(keys(words).withColumn("bits", letters(F.col("word"))), "keys")
    left = listed.select("end", "part", "size", F.col("word").alias("a"), F.col("n").alias("an"), F.col("bits").alias("abits"))
    sizes = F.explode(F.array(F.col("size") - 1, "size", F.col("size") + 1))
    right = listed.select("end", "part", sizes.alias("size"), F.col("word").alias("b"), F.col("n").alias("bn"), F.col("bits").alias("bbits"))
    alike = (F.bit_count(F.col("abits").bitwiseXOR(F.col("bbits"))) <= 2) & (F.col("a") < F.col("b"))
    met = left.join(right, ["end", "part", "size"]).where(alike & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "an", "b", "bn").distinct()


def roots(links: DataFrame, most: int) -> DataFrame:
    """(word, root) of the words that have a form, by pointer jumping over (word, form); ``most`` is the largest count.

    A count at the start of a path of k forms is at most ``most`` / 2^k, so k is below the logarithm of ``most``.
    """
    steps = math.ceil(math.log2(max(2, math.log2(max(2, most)))))
    up = materialize(links.select("word", F.col("form").alias("root")), "up")
    for _ in range(steps):
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        last, up = up, materialize(up.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "up")
        forget(last)
    return up


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words`` (word, n), whose words are distinct."""
    words = materialize(words.select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("bn").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("an").alias("m")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    formed = words.join(best, "word", "left")
    is_form = -F.col("best.m") >= 2 * F.col("n")
    formed = materialize(formed.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.m")).alias("form_n")), "formed")
    most = formed.agg(F.max("n")).first()[0] or 0
    up = roots(formed.where("form is not null"), most)
    return formed.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def report(docs: DataFrame) -> DataFrame:
    return variants(counted(with_slips(runs(docs))))
