"""Quality rules: a table of thresholds that becomes one projection of Spark expressions."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it was on with as be at by this are from or an not have "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine "
    "la que el en y los se del las un por con no una su para es al lo "
    "le les et est du une pas pour qui dans sur au avec ce il plus de"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= measure <= high; a missing bound doesn't bind."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: Fixed values, in ratios per word or line, wide enough for clean prose in the languages above.
RULES = (
    Rule("length", "n_words", low=20),
    Rule("word_length", "mean_word_length", low=2.5, high=12.0),
    Rule("symbols", "symbol_ratio", high=0.3),
    Rule("stop_words", "stop_ratio", low=0.02),
    Rule("exclamation", "exclamation_ratio", high=0.5),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
    Rule("repetition", "repeat_ratio", high=0.3),
)

WINDOW = 8


def measures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id and what the rules measure, by built-in functions alone; each step is one projection over the last.

    Words in repeated windows: every window of eight words gets a 64-bit hash of its words' 64-bit hashes. Only if some
    hash repeats are (hash, place) pairs sorted, equal neighbours kept, and the words under them counted from the gaps of
    their places. That is n log n steps in the words of a text. Two different windows of one text share a hash with a
    chance below one in 10^7 for a million words.
    """
    d = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))
    d = d.select(
        "doc_id", F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')").alias("words"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.expr(r"filter(split(text, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
        F.regexp_count("text", F.lit("!")).cast("long").alias("n_exclamations"),
    )
    hashes = ", ".join(f"h[i + {k}]" for k in range(window))
    d = d.select(
        "doc_id", "n_symbols", "n_exclamations", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?#*$%&|"))).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.expr("transform(words, w -> xxhash64(w))").alias("h"),
    )
    d = d.withColumn("win", F.expr(f"CASE WHEN size(h) < {window} THEN CAST(array() AS array<bigint>) ELSE transform(sequence(0, size(h) - {window}), i -> xxhash64({hashes})) END")).drop("h")
    d = d.withColumn("s", F.expr("CASE WHEN size(array_distinct(win)) = size(win) THEN CAST(array() AS array<struct<h: bigint, i: int>>) ELSE array_sort(transform(win, (x, i) -> struct(x AS h, i AS i))) END")).drop("win")
    d = d.withColumn("at", F.expr("array_sort(transform(filter(s, (x, j) -> (j > 0 AND s[greatest(j - 1, 0)].h = x.h) OR (j + 1 < size(s) AND s[least(j + 1, size(s) - 1)].h = x.h)), x -> x.i))")).drop("s")
    d = d.withColumn("n_repeat_words", F.expr(f"aggregate(transform(at, (p, j) -> least({window}, coalesce(get(at, j + 1), p + {window}) - p)), 0L, (a, x) -> a + x)")).drop("at")
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    return d.select(
        "*", per_word("word_chars").alias("mean_word_length"), per_word("n_symbols").alias("symbol_ratio"), per_word("n_stop_words").alias("stop_ratio"),
        per_word("n_exclamations").alias("exclamation_ratio"), (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_ratio"), per_word("n_repeat_words").alias("repeat_ratio"),
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> F.Column:
    """An array of the names of the rules that a row of measures() fails; empty if it passes all."""
    def failed(r: Rule) -> F.Column:
        out = F.lit(False)
        if r.low is not None:
            out = out | (F.col(r.measure) < F.lit(r.low))
        if r.high is not None:
            out = out | (F.col(r.measure) > F.lit(r.high))
        return F.when(out, F.lit(r.name))

    return F.array_compact(F.array(*[failed(r) for r in rules]))


def judge(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """measures() with failed (names of failed rules), base_failed and kept.

    A null or empty text has no words and fails the length rule. Repeated rows get equal results each. There is no
    shuffle: memory holds one text's arrays at a time, some 40 bytes a word. Other columns aren't read.
    """
    m = measures(docs, id_column, text_column).withColumn("failed", compile_rules(rules))
    m = m.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return m.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
