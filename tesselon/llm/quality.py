"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Counts are exact over whole texts.  Three-word windows are compared by a 64-bit hash of their words.

Defined results.  A null or empty text has no words: every count is 0, ``base_failed`` is true and
``kept`` false.  Very long texts are judged whole; their arrays of words and windows grow with the text.
Repeated rows are judged separately and alike, rows with a null id too.  An empty table gives an empty
result.  Only ``doc_id`` and ``text`` are read, so other columns, whatever their names, play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselon.llm.common import WORD

# Frequent function words of the corpus languages.
STOP_WORDS = (
    "a", "al", "als", "an", "and", "are", "as", "at", "auf", "aux", "be", "by", "con", "das", "de", "del", "dem",
    "den", "der", "des", "die", "du", "ein", "eine", "el", "en", "es", "et", "for", "from", "im", "in", "is", "ist",
    "it", "la", "las", "le", "les", "los", "mit", "nicht", "of", "on", "or", "par", "para", "pas", "por", "pour",
    "que", "qui", "se", "sich", "sur", "that", "the", "this", "to", "un", "una", "und", "une", "von", "was", "with",
    "zu",
)


@dataclass(frozen=True)
class Rule:
    """``low <= measure <= high`` keeps a document; None leaves a side open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


# Thresholds of the default rule table.
RULES = (
    Rule("word_length_mean", "word_chars / n_words", 1.5, 30.0),
    Rule("symbol_ratio", "n_symbols / word_chars", None, 0.03),
    Rule("dup_line_ratio", "n_dup_lines / n_lines", None, 0.4),
    Rule("repeat_word_ratio", "n_repeat_words / n_words", None, 0.4),
    Rule("stop_word_ratio", "n_stop_words / n_words", 0.01, None),
    Rule("upper_ratio", "n_upper / n_letters", None, 0.5),
    Rule("max_word_length", "max_word_chars", None, 1000.0),
)

_SPACE = (" ", "\t", "\n", "\u000b", "\f", "\r")
_SYMBOLS = "#*$%&|<>"


def _without(c: Column, chars) -> Column:
    for x in chars:
        c = F.replace(c, F.lit(x), F.lit(""))
    return c


def measures(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Adds the counts the rules are written in.  Built from staged projections so that each array is made once."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    d = docs.select(*keep, t.alias("_t"))
    d = d.select(
        *keep,
        "_t",
        F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)).alias("_w"),
        F.filter(F.split("_t", "\n", -1), lambda x: F.btrim(x, F.lit("".join(_SPACE))) != "").alias("_l"),
    )
    d = d.select("*", F.size("_w").cast("long").alias("n_words"))
    d = d.select(
        "*",
        F.when(
            F.col("n_words") >= 3,
            F.transform(
                F.slice("_w", 1, F.greatest(F.col("n_words") - 2, F.lit(0)).cast("int")),
                lambda x, i: F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2)),
            ),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("_h"),
    )
    # Only texts in which a window recurs need the sorted pass.
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    d = d.select(
        "*",
        F.when(repeats, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s"),
    )
    d = d.select(
        "*",
        F.sort_array(
            F.transform(
                F.filter(
                    "_s",
                    lambda x, i: (
                        F.coalesce(x["h"] == F.get("_s", i - 1)["h"], F.lit(False))
                        | F.coalesce(x["h"] == F.get("_s", i + 1)["h"], F.lit(False))
                    ),
                ),
                lambda x: x["i"],
            )
        ).alias("_p"),
    )
    covered = F.aggregate(
        F.transform("_p", lambda p, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get("_p", k - 1)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return d.select(
        *keep,
        "n_words",
        F.length(_without(F.col("_t"), _SPACE)).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(_without(F.col("_t"), _SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.coalesce(F.array_max(F.transform("_w", lambda w: F.length(w))), F.lit(0)).cast("long").alias("max_word_chars"),
        F.length(F.regexp_replace("_t", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("_t", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def compile_rules(rules=RULES) -> Column:
    """Names of the rules a row breaks, as one array expression; a ratio over nothing counts as 0."""
    broken = []
    for r in rules:
        num, _, den = (x.strip() for x in r.measure.partition("/"))
        value = F.col(num).cast("double")
        if den:
            value = F.when(F.col(den) > 0, value / F.col(den)).otherwise(F.lit(0.0))
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (value < F.lit(float(r.low)))
        if r.high is not None:
            bad = bad | (value > F.lit(float(r.high)))
        broken.append(F.when(bad, F.lit(r.name)))
    return F.filter(F.array(*broken), lambda x: x.isNotNull())


def quality_rules(docs: DataFrame, rules=RULES, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Per document: the counts, ``base_failed``, the broken rules and ``kept``."""
    m = measures(docs, keep, text).withColumn("base_failed", base_failed()).withColumn("broken_rules", compile_rules(rules))
    return m.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))


def quality_filter(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """The documents that the rules keep, with the columns they came with."""
    # The counter keeps the optimizer from writing the whole rule table into a filter below the projections that it is
    # built from, where every shared count would be computed again at each mention.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text}`").alias("text"))
    judged = quality_rules(whole, rules, ("_row",), "text").select("_row", "kept", F.monotonically_increasing_id().alias("_stay"))
    return judged.filter(F.col("kept") & (F.col("_stay") >= 0)).select("_row.*")
