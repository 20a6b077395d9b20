"""URL filters: rules by host and path, and gradient-boosted trees over lexical features for everything else.

Trees are grown on the driver from a bounded sample of labelled URLs and then compiled to one SQL expression, so
that scoring is a projection. The suffix statistics are part of the fitted model, a table of bounded size.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagweave.llm.common import hidden

RESULTS = ("host", "path", "rule", "score", "verdict")
#: URLs that training reads at most, those with the least hash of each label, half of either label.
TRAIN_ROWS = 20_000
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-._~/?#&=%+:@"


@dataclass(frozen=True)
class UrlRule:
    """verdict for hosts that are `host` or below it, where the path starts with `path`."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, with A-Z lower-cased; empty for null or without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[UrlRule]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, NULL without one; the first listed among equally long ones."""
    text = verdict = None
    for r in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        text = F.when(fits, r.text) if text is None else text.when(fits, r.text)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    return (text, verdict) if rules else (F.lit(None).cast("string"),) * 2


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Lexical features; none of them looks a host up. All are 0 or 1-like for an empty URL, never null."""
    u = F.coalesce(url, F.lit(""))
    n = F.length(u)
    # Rounded, so that a value that is also a threshold of the trees does not depend on the last bit.
    per = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(F.lit(0.0)), 6)
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    low = F.lower(u)
    shares = [(n - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double") / F.greatest(n, F.lit(1)) for c in ALPHABET]
    entropy = F.round(reduce(lambda a, b: a + b, [F.when(p > 0, -p * F.log2(p)).otherwise(0.0) for p in shares]), 6)
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    return {
        "length": n.cast("double"), "host_length": F.length(host).cast("double"), "path_length": F.length(path).cast("double"),
        "depth": count(path, "/[^/]"), "labels": count(host, r"[^.]+"), "host_hyphens": count(host, "-"),
        "digit_ratio": per(count(u, "[0-9]"), n), "host_digit_ratio": per(count(host, "[0-9]"), F.length(host)),
        "entropy": entropy, "parameters": F.when(query == "", 0.0).otherwise(count(query, "&") + 1), "query_length": F.length(query).cast("double"),
        "path_hyphens": count(path, "-"), "vowel_ratio": per(count(host, "[aeiou]"), F.length(host)),
        "insecure": F.startswith(low, F.lit("http://")).cast("double"), "fragment": F.contains(u, F.lit("#")).cast("double"),
    }


@dataclass
class Boosted:
    """trees: nested [feature, threshold, left, right] or leaf values; suffixes: log-odds by suffix (last two labels of a host), others get that of all."""

    names: list[str]
    base: float
    trees: list
    suffixes: dict[str, float]

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @staticmethod
    def from_json(text: str) -> Boosted:
        return Boosted(**json.loads(text))

    def margin(self, x: np.ndarray) -> np.ndarray:
        def walk(t, rows):
            if not isinstance(t, list):
                return np.full(len(rows), t)
            left = x[rows, t[0]] <= t[1]
            out = np.empty(len(rows))
            out[left], out[~left] = walk(t[2], rows[left]), walk(t[3], rows[~left])
            return out

        return self.base + sum((walk(t, np.arange(len(x))) for t in self.trees), np.zeros(len(x)))

    def expression(self, columns: list[str]) -> Column:
        """The margin as nested CASE expressions over the named columns, in the order of names."""

        def case(t):
            return F.when(F.col(columns[t[0]]) <= t[1], case(t[2])).otherwise(case(t[3])) if isinstance(t, list) else F.lit(float(t))

        return reduce(lambda a, b: a + b, [case(t) for t in self.trees], F.lit(float(self.base)))


def grow(x: np.ndarray, y: np.ndarray, names: list[str], suffixes: dict[str, float], rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, least: int = 20, ridge: float = 1.0) -> Boosted:
    """Second-order boosting of the logistic loss, with splits at quantiles. The same rows give the same trees."""
    p0 = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(p0 / (1 - p0)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    margin, trees = np.full(len(y), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)

        def split(rows, level):
            sg, sh = g[rows].sum(), h[rows].sum()
            leaf = float(rate * sg / (sh + ridge))
            best = (1e-6, None, None)
            if level < depth and len(rows) >= 2 * least:
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    c = codes[rows, f]
                    gl, hl, nl = (np.cumsum(np.bincount(c, weights=w, minlength=len(e) + 1))[:-1] for w in (g[rows], h[rows], None))
                    gain = gl**2 / (hl + ridge) + (sg - gl) ** 2 / (sh - hl + ridge) - sg**2 / (sh + ridge)
                    gain[(nl < least) | (len(rows) - nl < least)] = 0
                    if (b := int(gain.argmax())) >= 0 and gain[b] > best[0]:
                        best = (gain[b], f, b)
            if best[1] is None:
                margin[rows] += leaf
                return leaf
            _, f, b = best
            left = codes[rows, f] <= b
            return [f, float(edges[f][b]), split(rows[left], level + 1), split(rows[~left], level + 1)]

        trees.append(split(np.arange(len(y)), 0))
    return Boosted(names, base, trees, suffixes)


def prepared(df: DataFrame, url: str = "url") -> tuple[DataFrame, list[str]]:
    """df with _host, _path, _suffix and the features as _f0, _f1, ...; and the features' names."""
    x = df.withColumn("_host", host_of(F.col(f"`{url}`"))).withColumn("_path", path_of(F.col(f"`{url}`")))
    x = x.withColumn("_suffix", suffix_of(F.col("_host")))
    named = features(F.col(f"`{url}`"), F.col("_host"), F.col("_path"))
    return x.withColumns({f"_f{k}": c for k, c in enumerate(named.values())}), list(named)


def sample_labelled(labelled: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Of either label the rows/2 URLs of least hash: (url, label). Each is a top-k, so neither size nor order of the table matters."""
    distinct = labelled.where(F.col("url").isNotNull() & F.col("label").isin(0, 1)).groupBy("url").agg(F.max("label").alias("label"))
    parts = [distinct.where(F.col("label") == k).orderBy(F.xxhash64("url"), "url").limit(rows // 2) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Boosted:
    """Fits the model from (url, label 0/1), 1 being unwanted. Null URLs and labels are left out."""
    x, names = prepared(sample_labelled(labelled, rows))
    pdf = x.drop("_host", "_path").toPandas().sort_values("url")  # at most `rows` rows
    y = pdf["label"].to_numpy(dtype=float)
    if not len(y):
        return Boosted([*names, "suffix"], -10.0, [], {})
    # Leave-one-out statistics in training, else the feature would repeat the label of rare suffixes.
    prior = y.mean()
    by = pdf.assign(y=y).groupby("_suffix")["y"].agg(["sum", "count"])
    odds = lambda s, n: np.log((s + 20 * prior + 0.5) / (n - s + 20 * (1 - prior) + 0.5))
    at = by.loc[pdf["_suffix"]]
    own = odds(at["sum"].to_numpy() - y, at["count"].to_numpy() - 1)
    suffixes = {str(k): float(v) for k, v in zip(by.index, odds(by["sum"], by["count"]))} | {"": float(odds(0, 0))}
    matrix = np.column_stack([pdf[[f"_f{k}" for k in range(len(names))]].to_numpy(dtype=float), own])
    return grow(matrix, y, [*names, "suffix"], suffixes)


def score(df: DataFrame, model: Boosted, url: str = "url") -> DataFrame:
    """df with host, path and score: the probability that the URL is unwanted.

    Columns of df of these names are replaced, others passed on, whatever their names. A null URL is scored as an
    empty one; repeated rows are scored alike; an empty table gives an empty result.
    """
    own = [c for c in df.columns if c.lower() not in ("host", "path", "score")]
    x, name = hidden(df)
    x, names = prepared(x, name[url])
    default = model.suffixes.get("", 0.0)
    table = [(k, v) for k, v in model.suffixes.items() if k]
    if table:
        known = F.broadcast(df.sparkSession.createDataFrame(table, "_suffix string, _odds double"))  # at most as many rows as training reads
        x = x.join(known, "_suffix", "left")
    else:
        x = x.withColumn("_odds", F.lit(default))
    x = x.withColumn(f"_f{len(names)}", F.coalesce("_odds", F.lit(default)))
    score = 1 / (1 + F.exp(-model.expression([f"_f{k}" for k in range(len(names) + 1)])))
    return x.select(*[F.col(name[c]).alias(c) for c in own], F.col("_host").alias("host"), F.col("_path").alias("path"), score.alias("score"))


def judge(df: DataFrame, rules: list[UrlRule], model: Boosted, url: str = "url", threshold: float = 0.5) -> DataFrame:
    """df with host, path, rule, score and verdict (allow or block): the rule's, else block where score >= threshold.

    A null URL, or one without ://, has empty host and path, fits no rule, and is scored as the text it is (null:
    empty). Repeated rows are judged alike; an empty table gives an empty result; extra columns are passed on, those of
    the five names replaced. URLs may be of any length.
    """
    x = score(df.drop(*[c for c in df.columns if c.lower() in RESULTS]), model, url)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return x.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, own))


def held_out(labelled: DataFrame, group: str, folds: int, rows: int = TRAIN_ROWS) -> list[tuple[int, int, int, int]]:
    """(wanted URLs, of them blocked, unwanted URLs, of them blocked) for each fold, judged by a model that saw no URL
    of the fold's groups. labelled has (url, label) and the group; the groups go by hash to the folds."""
    x = labelled.withColumn("_fold", F.pmod(F.xxhash64(group), F.lit(folds)))
    out = []
    for k in range(folds):
        scored = score(x.where(F.col("_fold") == k), train(x.where(F.col("_fold") != k), rows))
        hit = (F.col("score") >= 0.5).cast("long")
        bad = F.col("label") == 1
        out.append(tuple(int(v or 0) for v in scored.agg(F.sum((~bad).cast("long")), F.sum(F.when(~bad, hit)), F.sum(bad.cast("long")), F.sum(F.when(bad, hit))).first()))
    return out
