"""Byte-level BPE in DuckDB: recursive queries merge, ordered aggregation decodes.

Each Spark partition hands its distinct pre-tokens to a DuckDB of its own. Tokens are rows (word, position, id). A
step of the recursion joins neighbouring tokens with the merge table and contracts, in each word, the leftmost pair of
least rank, until no pair of a word is in the table. Documents are put together from their words afterwards, so what
DuckDB holds is bounded by the words of a few megabytes of text, however long or frequent the texts are.

Words of over ZONE_BYTES would take a step for each of their merges. Two things spare them that, without changing any
result:

- A word is cut where no token of the vocabulary spans the cut, as no merge can cross it. Most pieces are short.
- A piece that stays long is looked at in zones of three times the length of the longest token in it. The least pair (by
  rank, then place) of its own and both neighbouring zones comes to be merged whatever happens elsewhere: a merge that
  takes one of its tokens away, or one that what it becomes would be merged with, has to be made up of pairs within
  reach, all of which come after it. So the least pairs of all zones are contracted in one step. Pairs of equal rank are
  contracted together (of overlapping ones every other) if every merge of the new token has a higher rank
  (merges.settled). Steps then go by the length of tokens, not of words, unless a word is full of equal pairs whose rank
  is not settled: of those, one that has another within reach before it waits for that one.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagweave.llm.common import claim, remembers, trim
from lagweave.llm.pretokens import Splitter, foreign_characters, read_ranks
from lagweave.plans.ship import ship

#: Characters of text whose words go to DuckDB together, bytes of distinct words in one recursive query, which keeps the
#: rows of all its steps, and words that are put together at once. They bound a worker's memory; the ids are the same.
CHUNK_CHARS = 1_000_000
QUERY_BYTES = 100_000
TAKE_WORDS = 50_000
#: Words that a worker remembers between chunks, about.
REMEMBERED = 200_000

# One step contracts the leftmost pair of least rank of each word. `live` words still have work; a word in which no
# pair is in the merge table is given out as it is. Positions stay without gaps, so neighbours are found by a hash join.
ENCODE = """
WITH RECURSIVE state AS (
    SELECT word, pos, tok, true AS live FROM start
  UNION ALL
    SELECT s.word, CASE WHEN s.pos > g.at THEN s.pos - 1 ELSE s.pos END, CASE WHEN s.pos = g.at THEN g.rank ELSE s.tok END, g.at IS NOT NULL
    FROM state s LEFT JOIN (
      SELECT word, CAST(least >> 32 AS INT) AS rank, CAST(least & 4294967295 AS INT) AS at
      FROM (
        SELECT a.word, min((CAST(m.rank AS BIGINT) << 32) + a.pos) AS least
        FROM state a JOIN state b ON b.word = a.word AND b.pos = a.pos + 1 JOIN merges m ON m.l = a.tok AND m.r = b.tok
        WHERE a.live AND b.live GROUP BY a.word
      )
    ) g ON g.word = s.word
    WHERE s.live AND (g.at IS NULL OR s.pos <> g.at + 1)
)
SELECT word, list(tok ORDER BY pos) AS ids FROM state WHERE NOT live GROUP BY word ORDER BY word
"""

# The same for words of over ZONE_BYTES, which would take as many steps as they have merges. `around` is the least pair
# (rank, then place) of a pair's zone and its two neighbours, `head` the first of the run of overlapping pairs of equal rank it is in.
ZONE_BYTES = 64
ENCODE_LONG = """
WITH RECURSIVE state AS (
    SELECT word, pos, tok, width, true AS live FROM start
  UNION ALL
    SELECT word, pos, CASE WHEN taken THEN rank ELSE tok END, width, best IS NOT NULL
    FROM (
      SELECT *, coalesce(lag(taken) OVER (PARTITION BY word ORDER BY pos), false) AS eaten
      FROM (
        SELECT *, coalesce((hit AND settled AND sure AND (idx - head) % 2 = 0) OR key = around, false) AS taken
        FROM (
          SELECT *, first_value(hit) OVER (PARTITION BY word, head ORDER BY idx) AS sure
          FROM (
            SELECT *, coalesce(rank = around >> 32, false) AS hit, max(CASE WHEN fresh THEN idx END) OVER (PARTITION BY word ORDER BY idx) AS head
            FROM (
              SELECT *, rank IS DISTINCT FROM lag(rank) OVER (PARTITION BY word ORDER BY idx) AS fresh, min(rank) OVER (PARTITION BY word) AS best,
                     min(key) OVER (PARTITION BY word ORDER BY pos // width RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS around
              FROM (
                SELECT p.*, m.rank, m.settled, (CAST(m.rank AS BIGINT) << 32) + p.pos AS key
                FROM (SELECT word, pos, tok, width, lead(tok) OVER w AS next, row_number() OVER w AS idx FROM state WHERE live WINDOW w AS (PARTITION BY word ORDER BY pos)) p
                LEFT JOIN merges m ON m.l = p.tok AND m.r = p.next
              )
            )
          )
        )
      )
    ) WHERE NOT eaten
)
SELECT word, list(tok ORDER BY pos) AS ids FROM state WHERE NOT live GROUP BY word ORDER BY word
"""

DECODE = """
SELECT word, string_agg(v.hex, '' ORDER BY pos) AS hex
FROM (SELECT word, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM coded) t JOIN vocab v USING (id)
GROUP BY word ORDER BY word
"""


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """(l, r, rank, settled): every pair of tokens whose bytes together are a token, which is the result of merging them."""
    rows = [(ranks[t[:k]], ranks[t[k:]], rank) for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    l, r, rank = (np.array(c, dtype=np.int32) for c in zip(*rows)) if rows else (np.array([], dtype=np.int32),) * 3
    unsettled = np.union1d(l[rank < l], r[rank < r])
    return pa.table({"l": l, "r": r, "rank": rank, "settled": ~np.isin(rank, unsettled)})


class Spans:
    """Where tokens of the vocabulary stand in a word."""

    def __init__(self, ranks: dict[bytes, int]):
        self.find = ahocorasick.Automaton()
        for t in ranks:
            if len(t) > 1:
                self.find.add_word(t.decode("latin-1"), len(t))
        self.find.make_automaton()

    def longest(self, raw: bytes) -> np.ndarray:
        """Length of the longest token of two bytes or more that ends at each byte, 0 without one."""
        out = np.zeros(len(raw), np.int64)
        last = -1
        for end, n in self.find.iter(raw.decode("latin-1")):
            if end != last:  # the longest comes first
                out[end], last = n, end
        return out

    def pieces(self, word: str) -> list[bytes]:
        """The word's bytes cut wherever no token spans the cut."""
        raw = word.encode("utf-8")
        n = self.longest(raw)
        ends = np.flatnonzero(n)
        depth = np.zeros(len(raw) + 1, np.int64)  # at byte k: tokens that span the cut before it
        np.add.at(depth, ends - n[ends] + 2, 1)
        np.add.at(depth, ends + 1, -1)
        edges = [0, *(np.flatnonzero(np.cumsum(depth)[1 : len(raw)] == 0) + 1).tolist(), len(raw)]
        return [raw[a:b] for a, b in zip(edges[:-1], edges[1:])]


class Words(dict):
    """word (str) or piece of a word (bytes) -> number; a new one gets the next number and waits in `new` to be coded."""

    def __init__(self, items=()):
        super().__init__(items)
        self.new: list[str | bytes] = []

    def __missing__(self, word: str | bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


def _raw(word: str | bytes) -> bytes:
    return word.encode("utf-8") if isinstance(word, str) else word


class Ragged:
    """Arrays of different lengths end to end, addressed by number."""

    def __init__(self, dtype):
        self.flat, self.start, self.length = np.empty(0, dtype), np.empty(0, np.int64), np.empty(0, np.int64)

    def append(self, numbers: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> None:
        more = int(numbers.max()) + 1 - len(self.start)
        if more > 0:
            self.start, self.length = (np.concatenate([a, np.zeros(more, np.int64)]) for a in (self.start, self.length))
        self.start[numbers] = len(self.flat) + np.cumsum(lengths) - lengths
        self.length[numbers] = lengths
        self.flat = np.concatenate([self.flat, flat])

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values end to end, lengths) of the numbered arrays."""
        lengths = self.length[numbers]
        out, done = np.empty(int(lengths.sum()), self.flat.dtype), 0
        for lo in range(0, len(numbers), TAKE_WORDS):  # places take 8 bytes for each value
            n = lengths[lo : lo + TAKE_WORDS]
            at = np.repeat(self.start[numbers[lo : lo + TAKE_WORDS]] - (np.cumsum(n) - n), n)
            at += np.arange(len(at))
            out[done : done + len(at)] = self.flat[at]
            done += len(at)
        return out, lengths


class Coder:
    """A DuckDB with the merge table of one vocabulary, and the words that it has coded."""

    def __init__(self, ranks: dict[bytes, int]):
        # No folder to spill to: what a query takes is bounded by QUERY_BYTES, or by one word that cannot be cut.
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": "", "preserve_insertion_order": False})
        merges = merge_table(ranks)  # noqa: F841  DuckDB reads it by its name
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        vocab = pa.table({"id": pa.array(ranks.values(), pa.int32()), "hex": [t.hex() for t in ranks]})  # noqa: F841
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM vocab")
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.ranks, self.spans = ranks, Spans(ranks)
        self.words, self.ids, self.bytes, self.uses = Words(), Ragged(np.int32), Ragged(np.uint8), np.empty(0, np.int64)

    def learn(self) -> None:
        """Codes the words that wait, in queries of bounded size. A word longer than that makes a query of its own."""
        for long in (False, True):
            batch, size = [], 0
            for w in self.words.new:
                n = len(_raw(w))
                if (n > ZONE_BYTES) != long:
                    continue
                if batch and size + n > QUERY_BYTES:
                    self._learn(batch, ENCODE_LONG if long else ENCODE)
                    batch, size = [], 0
                batch.append(w)
                size += n
            if batch:
                self._learn(batch, ENCODE_LONG if long else ENCODE)
        self.words.new = []

    def _learn(self, words: list[str | bytes], query: str) -> None:
        raw = [_raw(w) for w in words]
        lengths = np.array([len(b) for b in raw])
        width = np.array([len(b) if query is ENCODE else 3 * max(1, int(self.spans.longest(b).max())) for b in raw], dtype=np.int32)
        first = np.cumsum(lengths) - lengths
        start = pa.table({  # noqa: F841
            "word": np.repeat(np.arange(len(raw), dtype=np.int32), lengths),
            "pos": (np.arange(lengths.sum()) - np.repeat(first, lengths)).astype(np.int32),
            "tok": self.byte[np.frombuffer(b"".join(raw), dtype=np.uint8)],
            "width": np.repeat(width, lengths),
        })
        coded = self.db.sql(query).to_arrow_table()  # DECODE reads it
        decoded = [bytes.fromhex(h) for h in self.db.sql(DECODE).to_arrow_table()["hex"].to_pylist()]
        ids = coded["ids"].combine_chunks()
        whole = [len(i) > 1 and isinstance(w, str) and b in self.ranks for i, w, b in zip(ids, words, raw)]
        if any(whole):  # the library takes a word that is a token as it is, though no merges may lead there
            ids = pa.array([[self.ranks[b]] if w else i.as_py() for w, i, b in zip(whole, ids, raw)], pa.list_(pa.int32()))
        numbers = np.array([self.words[w] for w in words])
        self.ids.append(numbers, ids.values.to_numpy(), np.diff(ids.offsets.to_numpy()))
        self.bytes.append(numbers, np.frombuffer(b"".join(decoded), dtype=np.uint8), np.array([len(d) for d in decoded]))

    def forget(self) -> None:
        """Once too many words are remembered, the half that texts used least goes."""
        if len(self.words) <= REMEMBERED:
            return
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: REMEMBERED // 2])
        place = np.full(len(self.words), -1)
        place[kept] = np.arange(len(kept))
        self.words = Words((w, int(place[n])) for w, n in self.words.items() if place[n] >= 0)
        for name in ("ids", "bytes"):
            old: Ragged = getattr(self, name)
            new = Ragged(old.flat.dtype)
            new.append(np.arange(len(kept)), *old.take(kept))
            setattr(self, name, new)
        self.uses = self.uses[kept] // 2

    def cut(self, words: list[str]) -> list[str | bytes]:
        if max(map(len, words), default=0) <= ZONE_BYTES:
            return words
        return [p for w in words for p in (self.spans.pieces(w) if len(w) > ZONE_BYTES else [w])]

    def code(self, split, texts: list[str]) -> tuple[pa.Array, pa.Array]:
        """(ids as lists, decoded as binary) of the texts."""
        self.forget()
        numbers = [np.fromiter(map(self.words.__getitem__, self.cut(split(t))), np.int64) for t in texts]
        self.learn()
        every = np.concatenate(numbers)
        used = np.bincount(every, minlength=len(self.words))
        used[: len(self.uses)] += self.uses
        self.uses = used
        ends = np.cumsum([len(n) for n in numbers])
        out = []
        for ragged in (self.ids, self.bytes):
            flat, lengths = ragged.take(every)
            total = np.concatenate([[0], np.cumsum(lengths)])
            out.append((np.concatenate([[0], total[ends]]).astype(np.int32), flat))
        (ids_at, ids), (bytes_at, body) = out
        trim()
        return pa.ListArray.from_arrays(pa.array(ids_at), pa.array(ids)), pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(bytes_at), pa.py_buffer(np.ascontiguousarray(body))])


_CODERS: dict[int, Coder] = {}
remembers(_CODERS.clear)


def coder(key: int, ranks: dict[bytes, int]) -> Coder:
    """One per worker process and vocabulary."""
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(ranks)
    return _CODERS[key]


def chunks(batches, width: int) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of about `width` characters each, null texts as empty."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            t = t.as_py() or ""
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size >= width:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def encode(df: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded binary), one row per row of df.

    ids are those of the tiktoken library without special tokens; decoded is made from the ids and equals the text's
    UTF-8 bytes. A null or empty text has no ids. Repeated rows and ids are coded each for itself; other columns of
    df do not matter.
    """
    spark = df.sparkSession
    ranks = read_ranks(path)
    shared = spark.sparkContext.broadcast((hash(frozenset(ranks.items())), ranks, Splitter(pattern, foreign_characters(pattern))))
    x = df.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    kind = x.schema["_id"].dataType

    ship(spark)
    def run(batches):
        claim("bpe")
        key, ranks, split = shared.value
        c = coder(key, ranks)
        for ids, texts in chunks(batches, CHUNK_CHARS):
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=id_type(kind)), *c.code(split, texts)], names=["_id", "ids", "decoded"])

    out = x.mapInArrow(run, f"_id {kind.simpleString()}, ids array<int>, decoded binary")
    return out.withColumnRenamed("_id", doc_id)


def id_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
