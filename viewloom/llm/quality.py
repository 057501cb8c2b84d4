"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger holds the measurements and one bit per
failed rule. Policies are versions of a bit mask with a tolerated number of failures, so a new
policy or an ablation reads the ledger and never the texts.

Defined results: null or empty text has no words and fails ``few_words``; extra columns are
dropped from the ledger, whose names are fixed; repeated rows give repeated ledger rows; an
empty table gives an empty ledger and ablations of zero rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, held, materialize, words


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  # SQL over the measurements


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]
    tolerated: int = 0


#: The place in this tuple is the rule's bit; append only, so that old ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeat_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbol_heavy", "10 * n_symbols > 3 * n_words"),
    Rule("shouting", "2 * n_exclaims > n_words"),
    Rule("capitals", "n_upper > 20 and 2 * n_upper > word_chars"),
    Rule("long_words", "word_chars - n_unspaced > 40 * n_words"),
    Rule("repeat_lines", "2 * n_dup_lines > n_lines"),
)
POLICIES = (
    Policy("base", ("few_words", "repeat_words")),
    Policy("standard", ("few_words", "repeat_words", "symbol_heavy", "shouting", "capitals", "long_words")),
    Policy("lenient", tuple(r.name for r in RULES), tolerated=1),
)
WINDOW = 5
#: Blocks of scripts that are written without spaces: Thai and Lao, Burmese, Khmer, kana, Chinese characters.
UNSPACED = r"[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}]"


def mask(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    names = [r.name for r in rules]
    return sum(1 << names.index(n) for n in policy.rules)


def _windows(w: Column) -> Column:
    """A 64-bit hash of each run of WINDOW words."""
    at = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])
    return F.when(F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), at)).otherwise(F.array().cast("array<bigint>"))


def measure(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The measurements of each row, in one pass without a shuffle. Filters on them stay above them.

    Words in repeated windows: hashes that occur twice are found by sorting (hash, place), and the
    covered words are counted from the gaps between places, so the work is n log n in a text's words.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    has_word = lambda s: s.rlike(f"[^{SPACE}]")
    out = docs.select(F.col(key), t.alias("_t"), words(F.col(text)).alias("_w"), F.filter(F.split(t, "\n"), has_word).alias("_l"))
    out = out.select(
        key, "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("_t", F.lit("!")).cast("long").alias("n_exclaims"),
        F.length(F.regexp_replace("_t", r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        F.regexp_count("_t", F.lit(UNSPACED)).cast("long").alias("n_unspaced"),
    )
    kept = [c for c in out.columns if c != "_w"]
    out = out.select(*kept, _windows(F.col("_w")).alias("_h"))
    pair = F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    none = F.array().cast("array<struct<x:bigint,i:int>>")
    out = out.select(*kept, F.when(F.size(F.array_distinct("_h")) < F.size("_h"), pair).otherwise(none).alias("_s"))
    twice = F.filter("_s", lambda s, i: (s.x == F.get("_s", i - 1).x) | (s.x == F.get("_s", i + 1).x))
    out = out.select(*kept, F.sort_array(F.transform(twice, lambda s: s.i)).alias("_p"))
    gaps = F.transform("_p", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", j + 1) - p, F.lit(WINDOW))))
    return out.select(*kept, held(F.aggregate(gaps, F.lit(0), lambda a, x: a + x).cast("long")).alias("n_repeat_words"))


def ledger(docs: DataFrame, text: str = "text", key: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measurements and ``fail_bits`` of every row; bit i is set where rules[i] fails."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, text, key).withColumn("fail_bits", bits)


def _passes(bits: Column, bit_mask: int | Column, tolerated: int | Column) -> Column:
    m = F.lit(bit_mask).cast("long") if isinstance(bit_mask, int) else bit_mask
    return F.bit_count(bits.bitwiseAND(m)) <= tolerated


def apply_policy(entries: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with ``kept`` under one policy version."""
    return entries.withColumns({"kept": _passes(F.col("fail_bits"), mask(policy, rules), policy.tolerated), "policy": F.lit(policy.version)})


def ablations(entries: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each policy and rule in it: documents kept with the rule, and without it.

    Rows are first counted by bit pattern, so what follows has at most 2**len(rules) rows.
    """
    names = [r.name for r in rules]
    spark = entries.sparkSession
    cases = [(p.version, n, mask(p, rules), mask(p, rules) & ~(1 << names.index(n)), p.tolerated) for p in policies for n in p.rules]
    table = spark.createDataFrame(cases, "policy string, rule string, with_mask long, without_mask long, tolerated int")
    array = F.array(*[F.struct(*[F.lit(v).cast(t).alias(c) for (c, t), v in zip(table.dtypes, row, strict=True)]) for row in cases])
    counts = entries.groupBy("fail_bits").agg(F.count("*").alias("n"))
    each = counts.select("fail_bits", "n", F.explode(array).alias("c")).select("fail_bits", "n", "c.*")
    kept = lambda m: F.sum(F.when(_passes(F.col("fail_bits"), F.col(m), F.col("tolerated")), F.col("n")).otherwise(0))
    return each.groupBy("policy", "rule").agg(kept("with_mask").alias("kept_with"), kept("without_mask").alias("kept_without"))


def verdicts(docs: DataFrame, policy: Policy = POLICIES[1]) -> DataFrame:
    """One row per document: the base measurements, ``base_failed`` and ``kept``, from a ledger that is written first."""
    out = apply_policy(materialize(ledger(docs), "ledger"), policy)
    base = ~_passes(F.col("fail_bits"), mask(POLICIES[0]), 0)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (F.col("kept") & ~base).alias("kept"), "fail_bits",
    )


def keep_good(docs: DataFrame, policy: Policy = POLICIES[1]) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with all their columns.

    The measurements are taken beside each row, so no join and no shuffle is needed.
    """
    row = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col("text").alias("_text"))
    return apply_policy(ledger(row, "_text", "_row"), policy).where("kept").select("_row.*")
