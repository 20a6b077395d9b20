"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Nothing is shuffled and no user function runs; a document's verdict depends on its own text alone, so one
document, however long, is one row of work.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagweave.llm.common import SPACE_RUN, SPACES, hidden, where_computed, words_of

WINDOW = 5

#: Frequent function words of the four languages, lower case.
STOP_WORDS = (
    "the of and to in a is that for was with as on be by at this are or from "
    "de la le les et des en un une que est pour dans du pas sur au avec ce "
    "der die und das den von zu mit sich auf ist im dem nicht ein eine als auch es "
    "el los las del se por con no su para al lo como más y o"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails if the metric is below least or above most. Only documents of at least min_words are judged."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None
    min_words: int = 0

    def fails(self) -> Column:
        m = F.col(self.metric)
        out = F.lit(False)
        if self.least is not None:
            out = out | (m < self.least)
        if self.most is not None:
            out = out | (m > self.most)
        return (F.col("n_words") >= self.min_words) & F.coalesce(out, F.lit(False))


#: Base rules, which every caller gets.
BASE_RULES = (Rule("too_short", "n_words", least=10), Rule("repeats_itself", "repeat_pct", most=20))

#: The method's own rules. Ratios of short texts scatter widely, so those rules wait for enough words or lines.
RULES = (
    Rule("symbols", "symbols_per_word", most=0.3),
    Rule("word_length", "mean_word_length", least=2, most=15, min_words=20),
    Rule("few_stop_words", "stop_word_share", least=0.02, min_words=40),
    Rule("duplicate_lines", "dup_line_share", most=0.5, min_words=40),
)


METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "repeat_pct", "symbols_per_word", "mean_word_length", "stop_word_share", "dup_line_share")


def metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the METRICS. Columns of df that bear the name of a metric are replaced, others passed on, whatever their
    names. A null text has no words and no lines; a ratio to none is null."""
    own = [c for c in df.columns if c.lower() not in METRICS]
    x, name = hidden(df)
    t = F.coalesce(F.col(name[text]), F.lit(""))
    has_word = lambda line: F.btrim(line, F.lit(SPACES)) != ""
    x = x.withColumn("_words", words_of(F.col(name[text]))).withColumn("_lines", F.filter(F.split(t, "\n"), has_word))
    x = x.withColumn("n_words", F.size("_words").cast("long"))
    x = x.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    ahead = [lambda i, k=k: F.get(F.col("_hashes"), i + k) for k in range(1, WINDOW)]
    windows = F.transform(F.slice("_hashes", F.lit(1), F.greatest(F.size("_hashes") - (WINDOW - 1), F.lit(0))), lambda h, i: F.xxhash64(h, *[a(i) for a in ahead]))
    x = x.withColumn("_windows", windows)
    # Most texts repeat no window; only the others are sorted to find which positions do.
    ordered = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    x = x.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), ordered))
    same = lambda a, k: (a["h"] == F.get(F.col("_sorted"), k - 1)["h"]) | (a["h"] == F.get(F.col("_sorted"), k + 1)["h"])
    x = x.withColumn("_at", F.sort_array(F.transform(F.filter("_sorted", same), lambda a: a["i"])))
    covered = F.aggregate(F.transform("_at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_at"), k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)
    x = x.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    x = x.withColumn("word_chars", F.length(F.regexp_replace(t, SPACE_RUN, "")).cast("long"))
    x = x.withColumn("n_symbols", (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long"))
    x = x.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    x = x.withColumn("n_stop_words", F.size(F.filter("_words", lambda w: w.isin(STOP_WORDS))).cast("long"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    x = x.withColumns({
        "repeat_pct": ratio(100 * F.col("n_repeat_words"), F.col("n_words")),
        "symbols_per_word": ratio(F.col("n_symbols"), F.col("n_words")),
        "mean_word_length": ratio(F.col("word_chars"), F.col("n_words")),
        "stop_word_share": ratio(F.col("n_stop_words"), F.col("n_words")),
        "dup_line_share": ratio(F.col("n_dup_lines"), F.size("_lines")),
    })
    return x.select(*[F.col(name[c]).alias(c) for c in own], *METRICS)


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with metrics, base_failed, failed_rules (names) and kept.

    A null or empty text has no words and fails as too short. A word or line is judged by its characters as they
    are, without changing case. Repeated rows are judged alike; an empty table gives an empty result.
    """
    x = metrics(df, text)
    x = x.withColumn("base_failed", F.greatest(*[r.fails() for r in BASE_RULES]))
    x = x.withColumn("failed_rules", F.filter(F.array(*[F.when(r.fails(), F.lit(r.name)) for r in (*BASE_RULES, *rules)]), lambda n: n.isNotNull()))
    return x.withColumn("kept", F.size("failed_rules") == 0)


def keep(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of df that pass every rule, with df's columns. Rows are as in judge()."""
    own = [c for c in df.columns if c != text]
    plain = df.select(F.col(f"`{text}`").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row") if own else F.lit(None).alias("_row"))
    kept = where_computed(judge(plain, "_text", rules), "kept")
    return kept.select(*[F.col("_text").alias(text) if c == text else F.col("_row").getField(c).alias(c) for c in df.columns])
