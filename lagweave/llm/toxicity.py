"""Toxicity: cumulative-link ordinal regression on sparse word counts.

P(grade > k) = sigmoid(w.x - cut_k) with one weight vector for all thresholds and rising cuts, so the grades share
what they learn. The model is fitted on the driver from a bounded sample of labelled documents, with a vocabulary of
bounded size; scoring is one pass over the texts and shuffles nothing.
"""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lagweave.llm.bpe import chunks, id_type
from lagweave.plans.ship import ship

#: Labelled documents that training reads at most, those of least hash, so the share of toxic ones is that of all.
TRAIN_ROWS = 20_000
#: Words of the model: the VOCABULARY that tell the labels apart best, with at least MIN_DOCS documents of the sample
#: and a log-likelihood ratio of at least MIN_G2.
VOCABULARY = 2000
MIN_DOCS = 5
MIN_G2 = 14.0
#: Toxic documents with this many marker words are of grade 2 and 3.
GRADES = (3, 8)
PUNCTUATION = ".,;:!?|()[]{}\"'`*#$%&<>-_/\\~"


def tokens(text: str) -> list[str]:
    return [w for w in (w.strip(PUNCTUATION) for w in text.lower().split()) if w]


@dataclass
class Ordinal:
    """weights by word, for log(1 + count); cuts rise."""

    weights: dict[str, float]
    cuts: list[float]

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @staticmethod
    def from_json(text: str) -> Ordinal:
        return Ordinal(**json.loads(text))

    def above(self, margin: np.ndarray) -> np.ndarray:
        """P(grade > k) in column k."""
        return 1 / (1 + np.exp(-(np.asarray(margin)[:, None] - np.array(self.cuts)[None, :])))

    def margin(self, counts: dict[str, int]) -> float:
        return float(sum(self.weights[w] * np.log1p(n) for w, n in sorted(counts.items()) if w in self.weights))


@dataclass
class Sample:
    """Documents as sparse rows: value v of word c in document r; grades by document; how many words there are."""

    r: np.ndarray
    c: np.ndarray
    v: np.ndarray
    grades: np.ndarray
    words: int

    def likelihood(self, beta: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
        """Log-likelihood less the ridge on the weights, and its gradient.

        beta holds the weights, then the lowest cut, then the logs of the steps between cuts, so cuts always rise.
        """
        n, k, top = len(self.grades), self.words, len(beta) - self.words
        rows = np.arange(n)
        gaps = np.exp(beta[k + 1 :])
        cuts = beta[k] + np.concatenate([[0.0], np.cumsum(gaps)])
        z = np.bincount(self.r, weights=self.v * beta[self.c], minlength=n)[:n]
        up = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(-(z[:, None] - cuts))), np.zeros((n, 1))], axis=1)  # P(grade >= j)
        p = np.maximum(up[rows, self.grades] - up[rows, self.grades + 1], 1e-9)
        slope = up * (1 - up)
        lo, hi = slope[rows, self.grades], slope[rows, self.grades + 1]
        dz = (lo - hi) / p
        dcut = np.zeros((n, top + 2))
        dcut[rows, self.grades] -= lo / p
        dcut[rows, self.grades + 1] += hi / p
        dcut = dcut[:, 1 : top + 1].sum(axis=0)
        weights = np.bincount(self.c, weights=self.v * dz[self.r], minlength=k) - ridge * beta[:k]
        steps = [gaps[j] * dcut[j + 1 :].sum() for j in range(top - 1)]
        return float(np.log(p).sum() - ridge / 2 * (beta[:k] ** 2).sum()), np.concatenate([weights, [dcut.sum()], steps])


def sparse(rows: list[dict[str, int]], grades: np.ndarray, vocabulary: list[str]) -> Sample:
    index = {w: k for k, w in enumerate(vocabulary)}
    found = [(i, index[w], n) for i, x in enumerate(rows) for w, n in x.items() if w in index]
    r, c, n = (np.array([f[k] for f in found], dtype=int) for k in range(3))
    return Sample(r, c, np.log1p(n.astype(float)), grades, len(vocabulary))


def fit(rows: list[dict[str, int]], grades: np.ndarray, vocabulary: list[str], ridge: float = 0.1, steps: int = 400) -> Ordinal:
    """Maximum likelihood with a ridge on the weights, by full-batch Adam. The same rows give the same model."""
    sample, k = sparse(rows, grades, vocabulary), len(vocabulary)
    top = max(int(grades.max()) if len(grades) else 0, 1)
    beta = np.zeros(k + top)
    m, s = np.zeros_like(beta), np.zeros_like(beta)
    for t in range(1, steps + 1):
        _, grad = sample.likelihood(beta, ridge)
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad * grad
        beta = beta + 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    cuts = beta[k] + np.concatenate([[0.0], np.cumsum(np.exp(beta[k + 1 :]))])
    return Ordinal({w: float(b) for w, b in zip(vocabulary, beta)}, [float(x) for x in cuts])


def sampled_words(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, rows: int) -> DataFrame:
    """(_id, _label, words array<struct<w, n>>) of the sampled labelled documents.

    Near copies often carry the same wrong label, so of documents with the same least hash of three-word shingles only
    the one of least id takes part: a word then needs independent documents behind it.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    order = [F.xxhash64(F.lit("toxicity"), "_id"), F.col("_id")]
    picked = F.broadcast(known.orderBy(*order).limit(rows))
    x = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text")).join(picked, "_id")
    kind = x.schema["_id"].dataType

    ship(docs.sparkSession)
    def run(batches):
        for b in batches:
            split = [tokens(t or "") for t in b.column(1).to_pylist()]
            words = [sorted(Counter(ws).items()) for ws in split]
            family = [min(xxhash.xxh64_intdigest(" ".join(ws[k : k + 3])) for k in range(max(1, len(ws) - 2))) - 2**63 for ws in split]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(family, pa.int64()), pa.array([[{"w": w, "n": n} for w, n in ws] for ws in words], pa.list_(pa.struct([("w", pa.string()), ("n", pa.int32())])))], names=["_id", "_label", "_family", "words"])

    y = x.mapInArrow(run, f"_id {kind.simpleString()}, _label int, _family long, words array<struct<w:string,n:int>>")
    first = F.row_number().over(Window.partitionBy("_family").orderBy("_id")) == 1
    return y.withColumn("_first", first).where("_first").drop("_first", "_family")


def choose_words(sample: DataFrame, size: int = VOCABULARY, least: int = MIN_DOCS) -> DataFrame:
    """(w, g2, marker) of the words that tell the labels apart, by the log-likelihood ratio of their document counts.

    Millions of words are put to the test, so one must pass MIN_G2, far beyond chance; at most `size` are kept.
    """
    counts = sample.select("_label", F.explode("words.w").alias("w")).groupBy("w").agg(F.sum((F.col("_label") == 0).cast("long")).alias("d0"), F.sum((F.col("_label") == 1).cast("long")).alias("d1"))
    n = sample.agg(F.sum((F.col("_label") == 0).cast("long")).alias("n0"), F.sum((F.col("_label") == 1).cast("long")).alias("n1"))
    x = counts.where(F.col("d0") + F.col("d1") >= least).crossJoin(F.broadcast(n))
    rate = (F.col("d0") + F.col("d1")) / (F.col("n0") + F.col("n1"))

    def term(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    g2 = F.lit(0.0)
    for d, m in (("d0", "n0"), ("d1", "n1")):
        g2 = g2 + term(F.col(d), F.col(m) * rate) + F.when(rate < 1, term(F.col(m) - F.col(d), F.col(m) * (1 - rate))).otherwise(0.0)
    marker = F.col("d1") * F.greatest("n0", F.lit(1)) >= 10 * (F.col("d0") + 0.5) * F.greatest("n1", F.lit(1))
    x = x.select("w", F.round(2 * g2, 6).alias("g2"), marker.alias("marker")).where(F.col("g2") >= MIN_G2)
    return x.orderBy(F.col("g2").desc(), "w").limit(size)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS) -> Ordinal:
    """Fits grades 0 to 3 from labels 0/1. A toxic document's grade is 1, 2 or 3 by its count of marker words, those
    that toxic documents have at least ten times as often as others. Null labels and ids are left out."""
    sample = sampled_words(docs, labels, doc_id, text, label, rows).persist()
    chosen = choose_words(sample).collect()  # at most VOCABULARY rows
    vocabulary = sorted(r["w"] for r in chosen)
    markers = {r["w"] for r in chosen if r["marker"]}
    keep = F.filter("words", lambda s: s["w"].isin(vocabulary)) if vocabulary else F.slice("words", 1, 0)
    got = sample.select("_id", "_label", keep.alias("words")).orderBy("_id").collect() if vocabulary else []  # at most `rows` rows of vocabulary words
    sample.unpersist()
    if not got:
        return Ordinal({}, [20.0, 21.0, 22.0])
    counts = [{s["w"]: s["n"] for s in r["words"]} for r in got]
    hits = [sum(n for w, n in c.items() if w in markers) for c in counts]
    grades = np.array([0 if not r["_label"] else 1 + sum(h >= g for g in GRADES) for r, h in zip(got, hits)], dtype=int)
    return fit(counts, grades, vocabulary)


class _Lookup(dict):
    """Raw token -> index of its word in the model, or -1; remembers a bounded number of tokens."""

    def __init__(self, index: dict[str, int]):
        self.index = index

    def __missing__(self, raw: str) -> int:
        k = self.index.get(raw.strip(PUNCTUATION), -1)
        if len(self) < 500_000:
            self[raw] = k
        return k


def score(df: DataFrame, model: Ordinal, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, severity, grade, toxic) per row of df. severity is the expected grade; grade the most likely one;
    toxic whether P(grade > 0) >= threshold. Null and empty texts have no words. Repeated rows are scored alike."""
    words = list(model.weights)
    shared = df.sparkSession.sparkContext.broadcast((np.array([model.weights[w] for w in words]), {w: k for k, w in enumerate(words)}, model))
    x = df.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    kind = x.schema["_id"].dataType

    ship(df.sparkSession)
    def run(batches):
        weights, index, model = shared.value
        lookup = _Lookup(index)
        for ids, texts in chunks(batches, 1_000_000):
            margins = []
            for t in texts:
                found = Counter([k for k in [lookup[w] for w in t.lower().split()] if k >= 0])
                at = np.array(sorted(found), dtype=int)
                margins.append(float(weights[at] @ np.log1p(np.array([found[k] for k in at], dtype=float))) if len(at) else 0.0)
            above = model.above(np.array(margins))
            each = -np.diff(np.concatenate([np.ones((len(ids), 1)), above, np.zeros((len(ids), 1))], axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=id_type(kind)), pa.array(above.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0] >= threshold)], names=["_id", "severity", "grade", "toxic"])

    return x.mapInArrow(run, f"_id {kind.simpleString()}, severity double, grade int, toxic boolean").withColumnRenamed("_id", doc_id)
