"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once a document; the ledger keeps one failure bit a rule and the measurements.
Policies are versioned sets of rule bits, so applying another version or an ablation reads the ledger,
not the texts.

Null and empty texts have no words and fail too_few_words. Rows are judged one by one, very long texts
as a whole: ties, repeated rows and null ids pass through unchanged. Only the text and id columns are read, so extra columns with
any names do no harm; an empty table gives an empty ledger.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 8
#: Bit of each rule, in order; never reuse a bit.
RULES = (
    "too_few_words", "repeated_windows", "too_many_words", "short_mean_word", "long_mean_word",
    "symbol_heavy", "duplicate_lines", "bar_table", "shouting", "few_distinct_words",
)
#: Versioned policies: the rules that reject.
POLICIES = {
    "v1": ("too_few_words", "repeated_windows"),
    "v2": ("too_few_words", "repeated_windows", "short_mean_word", "long_mean_word", "symbol_heavy", "duplicate_lines", "few_distinct_words"),
}
DEFAULT_POLICY = "v2"


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << RULES.index(r) for r in set(rules))


def _size(x: Column) -> Column:
    return F.size(x).cast("long")


def _duplicates(found: Column) -> Column:
    return _size(found) - _size(F.array_distinct(found))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id and the measurements the rules read."""
    far = 1 << 30  # start + far must not overflow an int
    step = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    step = step.withColumns({
        "words": F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)),
        "word_text": F.regexp_replace("text", r"[\x20\x09-\x0D]+", ""),
        "lines": F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)),
    })
    step = step.select(
        id_col,
        _size(F.col("words")).alias("n_words"),
        F.length("word_text").cast("long").alias("word_chars"),
        F.length(F.regexp_replace("word_text", r"[^#*$%&|<>]", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("word_text", r"[^|]", "")).cast("long").alias("n_bars"),
        F.length(F.regexp_replace("word_text", r"[^!]", "")).cast("long").alias("n_shouts"),
        _size(F.col("lines")).alias("n_lines"),
        _duplicates(F.col("lines")).alias("n_dup_lines"),
        _size(F.array_distinct("words")).alias("n_distinct"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    for half in (1, 2, 4):  # hashes of runs of 2, 4 and 8 words from those of half their length; a text of fewer words than WINDOW + 1 repeats no window
        step = step.withColumn("h", F.when(F.col("n_words") > WINDOW, F.zip_with("h", F.slice("h", half + 1, far), lambda x, y: F.xxhash64(x, y))))
    step = step.withColumn("windows", F.slice("h", 1, F.greatest(F.col("n_words") - (WINDOW - 1), F.lit(0)).cast("int"))).drop("h")
    step = step.withColumn("repeats", F.coalesce(_size(F.array_distinct("windows")) < _size(F.col("windows")), F.lit(False)))
    # first word of each window that occurs twice or more: neighbours in (hash, place) order
    step = step.withColumn("placed", F.when(F.col("repeats"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    step = step.withColumn("near", F.arrays_zip(F.col("placed").alias("b"), F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.col("placed")).alias("a"), F.slice("placed", 2, far).alias("c")))
    step = step.withColumn("first", F.sort_array(F.transform(F.filter("near", lambda z: z.b.isNotNull() & (z.b.h.eqNullSafe(z.a.h) | z.b.h.eqNullSafe(z.c.h))), lambda z: z.b.i)))
    step = step.withColumn("gaps", F.arrays_zip(F.slice("first", 2, far).alias("next"), F.col("first").alias("at")))
    covered = F.aggregate("gaps", F.lit(0).cast("long"), lambda s, z: s + F.least(F.coalesce(z.next - z.at, F.lit(WINDOW)), F.lit(WINDOW)).cast("long"))
    return step.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.when(F.col("repeats"), covered).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        "n_lines", "n_bars", "n_shouts", "n_distinct",
    )


def _failures() -> dict[str, Column]:
    n, chars = F.col("n_words"), F.col("word_chars")
    return {
        "too_few_words": n < 20,
        "repeated_windows": 100 * F.col("n_repeat_words") > 30 * n,
        "too_many_words": n > 100_000,
        "short_mean_word": chars < 2 * n,
        "long_mean_word": chars > 18 * n,
        "symbol_heavy": 10 * F.col("n_symbols") > n,
        "duplicate_lines": 10 * F.col("n_dup_lines") > 5 * F.col("n_lines"),
        "bar_table": 10 * F.col("n_bars") > n,
        "shouting": 10 * F.col("n_shouts") > n,
        "few_distinct_words": (n >= 50) & (100 * F.col("n_distinct") < 8 * n),
    }


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements and fail_bits: bit k is set where rule RULES[k] fails."""
    failed = _failures()
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(failed[r], F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, r in enumerate(RULES)])
    return measured(docs, id_col, text_col).withColumn("fail_bits", bits)


def apply_policy(found: DataFrame, version: str = DEFAULT_POLICY) -> DataFrame:
    """The ledger with base_failed (policy v1) and kept: no rule of the policy nor of v1 fails."""
    base, chosen = mask(POLICIES["v1"]), mask(POLICIES["v1"]) | mask(POLICIES[version])
    return found.withColumns({"base_failed": F.col("fail_bits").bitwiseAND(F.lit(base)) != 0, "kept": F.col("fail_bits").bitwiseAND(F.lit(chosen)) == 0})


def ablations(found: DataFrame, version: str = DEFAULT_POLICY) -> DataFrame:
    """A row a rule of the policy: documents that fail it, that fail it alone, and that are kept without it.

    The ledger is first counted by distinct bit pattern, at most 2 ** len(RULES) rows."""
    chosen = mask(POLICIES[version])
    patterns = found.groupBy(F.col("fail_bits").bitwiseAND(F.lit(chosen)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit")) for r in POLICIES[version]])).alias("r")
    hit, rest = F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0
    return patterns.select("bits", "n", rules).groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit & rest, F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(rest, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
