"""License scans by a positional index of rare tokens.

The index holds, for every licence word, its places in the mandatory phrases of licence texts. A file looks up its
licence words in the order of falling IDF. It can only hold a template's phrases if it has all their words, and then
its highest-IDF words among them are the phrases' own RARE_WORDS rarest; so the file's places of each of these words,
moved back by the word's places in the template, are intersected: what is left are the starts at which all of them
stand at the right distance. There the phrases are verified word by word, and the template counts if the words that
stand at their places carry enough of its weight (IDF). The index is a constant of the program, so it does not grow
with the input.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagweave.llm.common import ascii_lower, hidden
from lagweave.llm.licenses import BASE_PHRASES, TEMPLATES, Template, words_in

WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Highest-IDF words of a template's phrases whose postings are intersected.
RARE_WORDS = 3
#: Share of a template's weight that must stand at its place.
MIN_SCORE = 0.5
RESULTS = ("n_words", "base_hits", "matches", "labels", "score")


def tokens(text: Column) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased; empty for null."""
    # \z, as $ would also take a gap before a final line separator, which is a word character here
    trimmed = F.regexp_replace(F.coalesce(ascii_lower(text), F.lit("")), rf"^{WORD_GAP}|{WORD_GAP}\z", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP))


def targets_of(templates: tuple[Template, ...], phrases, min_score: float) -> list[tuple[str, list[str], list[tuple[int, str]], float, bool]]:
    """(label, words, keys, least score, whether it is a base phrase) of everything that is looked for."""
    base = [(label, words_in(p), list(enumerate(words_in(p))), 1.0, True) for label, p in phrases]
    return base + [(t.label, t.words, t.keys, min_score, False) for t in templates]


def word_idf(words: DataFrame, vocab: list[str]) -> dict[str, float]:
    """IDF of each licence word over all rows of words(_words), smoothed. One row per licence word comes back."""
    found = words.select(F.explode(F.concat(F.array_intersect(F.expr(listing(vocab)), F.col("_words")), F.array(F.lit("")))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    n = {r["w"]: r["n"] for r in found.collect()}
    total = n.get("", 0)  # the empty word stands once in each row
    return {w: math.log((total + 1) / (n.get(w, 0) + 1)) + 1e-6 for w in vocab}


def rarest(keys: list[tuple[int, str]], idf: dict[str, float], rare: int) -> dict[str, list[int]]:
    """The highest-IDF words of the keys with all their places."""
    words = sorted({w for _, w in keys}, key=lambda w: (-idf[w], w))[:rare]
    return {w: [q for q, v in keys if v == w] for w in words}


# The expressions over a template are SQL text, which the driver parses at once; as Column objects, each of their many
# constants would be a call to the JVM. Words hold no quotes, being runs of letters and digits.


def listing(values, kind: str = "string") -> str:
    """A constant array."""
    return f"cast(split('{' '.join(map(str, values))}', ' ') AS array<{kind}>)"


def starts_of(anchors: dict[str, list[int]]) -> str:
    """The starts on which the hits of all anchors agree: their postings intersected by relative position."""
    each = [f"flatten(transform(filter(_hits, h -> h.w = '{w}'), h -> array({', '.join(f'h.i - {q}' for q in at)})))" for w, at in anchors.items()]
    return reduce(lambda a, b: f"array_intersect({a}, {b})", each[1:], f"array_distinct({each[0]})")


def stand_at(start: str, places: list[tuple[int, str]]) -> str:
    """Whether every word stands at its place if the template starts there."""
    wanted = f"arrays_zip({listing([q for q, _ in places], 'int')}, {listing([w for _, w in places])})"
    return f"forall({wanted}, x -> get(_words, {start} + x.`0`) <=> x.`1`)"


def score_at(start: str, words: list[str], idf: dict[str, float]) -> str:
    """Share of the words' weight that stands at its place if the template starts there."""
    weight = listing([idf[w] for w in words], "double")
    return f"aggregate(transform({listing(words)}, (w, q) -> if(get(_words, {start} + q) <=> w, get({weight}, q), 0D)), 0D, (a, b) -> a + b) / {sum(idf[w] for w in words)!r}D"


def matches_of(target, anchors: dict[str, list[int]], idf: dict[str, float]) -> str:
    """(label, start, score) of the places where a target stands."""
    label, words, keys, least, base = target
    stands = f"filter(array_sort({starts_of(anchors)}), s -> {stand_at('s', keys)})"
    found = f"transform({stands}, s -> named_struct('label', '{label}', 'start', cast(s AS bigint), 'score', {'1D' if base else score_at('s', words, idf)}))"
    return f"filter({found}, m -> m.score >= {least - 1e-9!r}D)"


def scan(df: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES, phrases=BASE_PHRASES, rare: int = RARE_WORDS, min_score: float = MIN_SCORE) -> DataFrame:
    """df with n_words, base_hits (label, start), matches (label, start, score), labels and score.

    base_hits are all places of the base phrases. matches are all places where a template's mandatory phrases stand
    and at least min_score of its weight; a start may be negative where a file lacks the template's beginning. labels
    are those of both, distinct and sorted; score is that of the best match, 1 with a base hit, else 0.

    The weights are IDFs over all rows of df, so a match near min_score may depend on the other rows; base hits do not.
    Null and empty texts have no words and no hits. Repeated rows give the same result, an empty table an empty one.
    Columns of df of these names are replaced, all others passed on, whatever their names.

    One pass over the table counts the licence words, a second one looks them up. Places are listed only in files
    that hold an anchor.
    """
    targets = targets_of(templates, phrases, min_score)
    vocab = sorted({w for _, words, _, _, _ in targets for w in words})
    own = [c for c in df.columns if c.lower() not in RESULTS]
    x, name = hidden(df)
    x = x.withColumn("_words", tokens(F.col(name[text])))
    idf = word_idf(x.select("_words"), vocab)
    anchors = [rarest(keys, idf, rare) for _, _, keys, _, _ in targets]

    lookup = sorted({w for a in anchors for w in a})
    listed = F.filter(F.transform("_words", lambda w, i: F.when(w.isin(lookup), F.struct(w.alias("w"), i.alias("i")))), lambda h: h.isNotNull())
    x = x.withColumn("_hits", F.when(F.arrays_overlap(F.col("_words"), F.expr(listing(lookup))), listed))

    none = F.array().cast("array<struct<label:string,start:bigint,score:double>>")
    for column, wanted in (("_base", True), ("_found", False)):
        parts = [matches_of(t, a, idf) for t, a in zip(targets, anchors) if t[4] == wanted]
        found = F.expr(f"flatten(array({', '.join(parts)}))") if parts else none
        x = x.withColumn(column, F.when(F.col("_hits").isNull(), none).otherwise(found))
    both = F.concat("_base", "_found")
    return x.select(
        *[F.col(name[c]).alias(c) for c in own],
        F.size("_words").cast("long").alias("n_words"), F.col("_base").alias("base_hits"), F.col("_found").alias("matches"),
        F.array_sort(F.array_distinct(F.transform(both, lambda m: m["label"]))).alias("labels"),
        F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform(both, lambda m: m["score"])), F.lit(0.0))).alias("score"),
    )
