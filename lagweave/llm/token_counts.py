"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

The best segmentation of a prefix does not depend on what follows, so all pre-tokens that begin alike share the
forward scores of that beginning: each node of the trie gets its score once, when it is made, from the scores along
its path. A pre-token's count then stands at the node where it ends. A worker's memory is bounded by MAX_NODES, by
REMEMBERED_BYTES and by the pre-tokens of one chunk of text, however many or long the pre-tokens are.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagweave.llm.bpe import chunks, id_type
from lagweave.llm.common import claim, remembers
from lagweave.llm.pretokens import Splitter, foreign_characters, read_ranks
from lagweave.plans.ship import ship

CHUNK_CHARS = 1_000_000
#: Nodes that a trie has at most: a worker starts a new one when it is full. The rest of a word that does not fit any
#: more is scored all the same, on a path that is not kept.
MAX_NODES = 1_500_000
#: Bytes of pre-tokens whose counts a worker remembers.
REMEMBERED_BYTES = 30_000_000


def zipf_scores(ranks: dict[bytes, int]) -> dict[bytes, float]:
    """Log-probabilities by Zipf's law over the ranks of a vocabulary. No model is trained."""
    total = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {t: -math.log(r + 1) - total for t, r in ranks.items()}


class Trie:
    """Nodes by number: children by byte, forward score and token count of the best segmentation of the node's path.

    Of segmentations of equal score the one with fewer tokens counts.
    """

    def __init__(self, scores: dict[bytes, float], room: int = MAX_NODES):
        self.scores, self.room = scores, room
        self.longest = max(map(len, scores))
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        self.score = [0.0]
        self.count = [0]

    @property
    def full(self) -> bool:
        return len(self.score) >= self.room

    def step(self, path: bytes, end: int, scores: list[float], counts: list[int]) -> tuple[float, int]:
        """(score, count) of path[:end] from those of its prefixes."""
        best, least = -math.inf, 0
        piece = self.scores.get
        for j in range(max(0, end - self.longest), end):
            s = piece(path[j:end])
            if s is not None and ((s := scores[j] + s) > best or s == best and counts[j] + 1 < least):
                best, least = s, counts[j] + 1
        return best, least

    def insert(self, word: bytes) -> tuple[float, int]:
        """Score and token count of the word; nodes that it shares with earlier words are not scored again."""
        scores, counts = [0.0], [0]
        node = 0  # -1 beyond the last node that is kept
        for end, b in enumerate(word, 1):
            at = node * 256 + b
            node = self.child.get(at, -1) if node >= 0 else -1
            if node >= 0:
                s, n = self.score[node], self.count[node]
            else:
                s, n = self.step(word, end, scores, counts)
                if at >= 0 and not self.full:
                    node = self.child[at] = len(self.score)
                    self.score.append(s)
                    self.count.append(n)
            scores.append(s)
            counts.append(n)
        return scores[-1], counts[-1]


class Known(dict):
    """word -> (score, count) of the words of a chunk of text, and of earlier ones as far as there is room."""

    def __init__(self):
        self.size = 0

    def learn(self, word: str, trie: Trie) -> None:
        raw = word.encode("utf-8")
        self[word] = trie.insert(raw)
        self.size += len(raw)

    def forget(self) -> None:
        if self.size > REMEMBERED_BYTES:
            self.clear()
            self.size = 0


_TRIES: dict[int, tuple[Trie, Known]] = {}
remembers(_TRIES.clear)


def count_tokens(df: DataFrame, scores: dict[bytes, float], pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_pretokens, n_tokens, log_prob), one row per row of df.

    scores must hold every single byte. A null or empty text has no tokens and log_prob 0. Repeated rows and ids count
    each for itself; other columns of df do not matter.
    """
    if not all(bytes([b]) in scores for b in range(256)):
        raise ValueError("scores must hold every single byte")
    shared = df.sparkSession.sparkContext.broadcast((hash(frozenset(scores.items())), scores, Splitter(pattern, foreign_characters(pattern))))
    x = df.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    kind = x.schema["_id"].dataType

    ship(df.sparkSession)
    def run(batches):
        claim("token_counts")
        key, scores, split = shared.value
        for ids, texts in chunks(batches, CHUNK_CHARS):
            if key not in _TRIES or _TRIES[key][0].full:
                _TRIES.clear()
                _TRIES[key] = (Trie(scores), Known())
            trie, known = _TRIES[key]
            known.forget()
            words = [split(t) for t in texts]
            for w in dict.fromkeys(w for ws in words for w in ws):
                if w not in known:
                    known.learn(w, trie)
            rows = [[known[w] for w in ws] for ws in words]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, type=id_type(kind)), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array([len(r) for r in rows], pa.int64()),
                pa.array([sum([n for _, n in r]) for r in rows], pa.int64()), pa.array([math.fsum([s for s, _ in r]) for r in rows], pa.float64()),
            ], names=["_id", "n_bytes", "n_pretokens", "n_tokens", "log_prob"])

    out = x.mapInArrow(run, f"_id {kind.simpleString()}, n_bytes long, n_pretokens long, n_tokens long, log_prob double")
    return out.withColumnRenamed("_id", doc_id)


def count_with_ranks(df: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """count_tokens with the scores of zipf_scores over the rank file; rows are treated as there."""
    return count_tokens(df, zipf_scores(read_ranks(path)), pattern, doc_id, text)
