"""Quality rules: one table of thresholds compiled into one Spark projection.

Every measure is a Spark expression over the text; every rule is a row (measure, least, most). The
table becomes one boolean expression, so all rules of a text are decided in one pass, without a
shuffle and without user functions.

Defined results: a null text has no words and fails; null and repeated ids are judged row by row; an
empty table gives an empty result; other columns are passed through untouched by `judge` and do not
clash, since the working columns carry a reserved prefix. Texts are measured whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import SPACES, let, text_or_empty

MARKS = "#*$%&|<>"
#: Frequent function words of the languages at hand; fixed values.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "that", "is", "with", "for", "on", "as", "was", "are", "by", "at", "a", "it", "be", "have",
    "der", "die", "und", "das", "ist", "den", "mit", "von", "zu", "des", "ein", "auf", "nicht", "im", "eine", "dem",
    "le", "la", "les", "de", "et", "un", "une", "que", "est", "pour", "dans", "par", "sur", "qui", "du", "pas",
    "el", "los", "y", "en", "las", "del", "por", "con", "para", "una", "se", "su",
)

#: A letter of Latin script.
LATIN = "[A-Za-z\u00C0-\u024F]"


@dataclass(frozen=True)
class Threshold:
    """A text passes if the measure lies in [least, most]; a null measure passes."""

    measure: str
    least: float | None = None
    most: float | None = None


#: The production table. Ratios are per word or per line.
THRESHOLDS = (
    Threshold("n_words", 50, None),
    Threshold("mean_word_chars", 2.0, 14.0),
    Threshold("symbols_per_word", None, 0.25),
    Threshold("stop_words", 2, None),
    Threshold("dup_line_share", None, 0.5),
    Threshold("repeat_word_share", None, 0.5),
    Threshold("upper_word_share", None, 0.6),
)


def _word_array(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Number of words that lie in a 3-word window found at least twice.

    Windows are compared as 64-bit hashes of their words' hashes. Only texts with an equal pair go
    through the sort; there each window is compared with its neighbours in hash order, and the
    positions of those found twice are counted as the union of the stretches of three.
    """
    n = F.size(words)

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - 2, F.lit(1))), lambda k: F.xxhash64(F.get(h, k - 1), F.get(h, k), F.get(h, k + 1)))

    def covered(positions: Column) -> Column:
        # Each window counts three words, less what the next one covers too.
        steps = F.zip_with(positions, F.slice(positions, 2, F.greatest(F.size(positions) - 1, F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)

    def among(hashes: Column) -> Column:
        keyed = F.array_sort(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))

        def twice(s: Column) -> Column:
            hit = F.filter(F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["k"])), lambda p: p.isNotNull())
            return let(F.array_sort(hit), lambda p: F.when(F.size(p) > 0, covered(p)).otherwise(0))

        return let(keyed, twice)

    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), windows)
    return F.when(n < 4, F.lit(0)).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(among(h)))).cast("long")


def measures(text: Column) -> Column:
    """A struct of all measures of a text."""
    has_word = f"[^{SPACES}]"

    def of(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(has_word))
        line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.aggregate(words, F.lit(0).cast("long"), lambda acc, w: acc + F.length(w)).alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, MARKS, ""))).cast("long").alias("n_symbols"),
            line_counts.alias("lines"),
            _repeat_words(words).alias("n_repeat_words"),
            let(F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long"), lambda n: F.struct(n.alias("n"), F.when(n < 2, F.size(F.filter(words, lambda w: w.rlike(LATIN)))).alias("latin"))).alias("stop"),
            F.size(F.filter(words, lambda w: w.rlike(r"^[^\p{Ll}]*\p{Lu}{2}[^\p{Ll}]*$"))).cast("long").alias("upper_words"),
        )

    return let(_word_array(text), of)


def compiled(m: Column, thresholds: Sequence[Threshold] = THRESHOLDS) -> Column:
    """The table as one boolean expression over a struct of measures."""
    words = F.when(m["n_words"] > 0, m["n_words"]).cast("double")
    known = {
        "n_words": m["n_words"],
        "mean_word_chars": m["word_chars"] / words,
        "symbols_per_word": m["n_symbols"] / words,
        # The words are those of some languages in Latin script; texts that are mostly in others have no such measure.
        "stop_words": F.when((m["stop"]["n"] >= 2) | (2 * m["stop"]["latin"] >= m["n_words"]), m["stop"]["n"]),
        "dup_line_share": m["lines"]["dup"] / F.when(m["lines"]["n"] > 0, m["lines"]["n"]),
        "repeat_word_share": m["n_repeat_words"] / words,
        "upper_word_share": m["upper_words"] / words,
    }
    out = F.lit(True)
    for t in thresholds:
        value = known[t.measure]
        if t.least is not None:
            out = out & F.coalesce(value >= t.least, F.lit(True))
        if t.most is not None:
            out = out & F.coalesce(value <= t.most, F.lit(True))
    return out


def judge(docs: DataFrame, text_col: str = "text", thresholds: Sequence[Threshold] = THRESHOLDS, name: str = "__quality") -> DataFrame:
    """docs with a struct of the measures, base_failed and kept under `name`."""
    with_measures = docs.withColumn(name, measures(text_or_empty(text_col)))
    m = F.col(name)
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    return with_measures.withColumn(name, F.struct(
        m["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"), m["lines"]["dup"].alias("n_dup_lines"),
        m["n_repeat_words"].alias("n_repeat_words"), m["stop"]["n"].alias("stop_words"), m["upper_words"].alias("upper_words"), failed.alias("base_failed"), (~failed & compiled(m, thresholds)).alias("kept"),
    ))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures and verdict of each document."""
    judged = judge(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    q = "__quality"
    return judged.select("doc_id", *(f"{q}.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "stop_words", "upper_words", "base_failed", "kept")))
