"""N-gram Jaccard join with parity sketches.

A document is the set of its five-word shingles. Each shingle is XORed into one part of a sketch, so a part differs
between two sketches only if a shingle of the symmetric difference fell there: the number of differing parts is at
most the size of the symmetric difference. Two sets of J >= 0.75 and sizes a <= b differ in at most d = (a + b) / 7
shingles; so of the non-empty parts of either sketch all but d agree, and any d + 1 of them, the least by hash in an
order common to all, hold one that agrees (pigeonhole). These parts are the join keys. Sketches are made per size band,
with more parts for larger sets; a set that may have a partner in the next band is sketched for both.

Sets that share a key are compared by parity sketches of about as many bits as they have shingles, whose Hamming
distance is a lower bound of the symmetric difference, and then exactly. What comes of it are the components of the links, not all pairs: within a
list of sets that share a key a spanning forest of the plausible links is verified as far as it joins components, and
only where a refused pair leaves a list in several components are the other plausible pairs between them verified too. So no link is lost that would join
two components.

Sets and shingles are told apart by 64-bit hashes. That d + 1 non-empty parts exist fails with a chance of less than
1e-12 for a set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lagweave.llm.bpe import id_type
from lagweave.llm.common import claim, cut, cut_in_loop, hidden, maybe_repeated, release, remembers, repeated_bitmap, spread_join
from lagweave.plans.ship import ship

SHINGLE = 5
#: Largest set size of each band. In the first one every shingle is a part of its own.
FIRST_BAND, BAND_RATIO = 64, 16
#: Bits of the smallest sketch.
SKETCH_BITS = 1024
#: Sets of one list that are compared in one task at most, and bytes of their sketches, about; longer lists are compared
#: block against block.
LIST_BLOCK = 16_384
LIST_BYTES = 32_000_000
#: Sets in a row of a list on its way to the lists of the same first set, lists that are open there at once, and the size
#: up to which lists are joined whatever they have in common.
LIST_ROW, OPEN_LISTS, SMALL_LIST = 1024, 8, 64
#: A key's highest bits hold its band.
BAND_BITS = 4
#: Words whose hash a worker remembers.
REMEMBERED = 300_000

# Odd multipliers of the shingle hash, and of the public splitmix64 finaliser.
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_S1, _S2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _S1
    x = (x ^ (x >> np.uint64(27))) * _S2
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()
remembers(_HASHES.clear)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles. Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, which is what
    bytes.lower and bytes.split do. Fewer than five words make one shingle, none make none."""
    words = (text or "").encode("utf-8").lower().split()
    n = len(words)
    if n < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)] if n else [], dtype=np.uint64)
    w = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
    m = n - SHINGLE + 1
    h = w[:m] * _M[0]
    for k in range(1, SHINGLE):
        h += w[k : k + m] * _M[k]
    h = mix(h)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63


def parity(s: np.ndarray) -> bytes:
    """The least power of two of bits that is at least the set's size. Folding a sketch in two gives the next smaller one."""
    bits = max(SKETCH_BITS, 1 << (len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def band_of(n: int) -> int:
    band, top = 0, FIRST_BAND
    while n > top:
        band, top = band + 1, top * BAND_RATIO
    return band


def top_of(band: int) -> int:
    return FIRST_BAND * BAND_RATIO**band


def keys(s: np.ndarray) -> np.ndarray:
    """The join keys of a set: for each band of a possible partner at least as large as it, d + 1 parts of its sketch."""
    n = len(s)
    out = []
    for band in range(band_of(n), band_of(n * 4 // 3) + 1):
        d = (n + min(top_of(band), n * 4 // 3)) // 7
        salt = mix(np.array([band + 1], dtype=np.uint64))
        if band == 0:
            parts = s
        else:
            part = mix(s ^ salt) % np.uint64(top_of(band) // 2)
            order = np.argsort(part)
            part = part[order]
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            parts = np.bitwise_xor.reduceat(s[order], first) ^ mix(part[first])
        parts = mix(parts ^ salt)
        least = np.partition(parts, d)[: d + 1] if len(parts) > d + 1 else parts
        out.append((least >> np.uint64(BAND_BITS)) | np.uint64(band << (64 - BAND_BITS)))
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def block_of(key: int) -> int:
    """Sets that a block of a key's list has at most: none of them is larger than the key's band, nor is its sketch."""
    band = (int(key) >> (64 - BAND_BITS)) & ((1 << BAND_BITS) - 1)
    sketch = max(SKETCH_BITS, 1 << (top_of(band) - 1).bit_length()) // 8
    return min(LIST_BLOCK, max(2, LIST_BYTES // sketch))


def _columns(df: DataFrame, doc_id: str, text: str):
    x = df.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    return x, x.schema["_id"].dataType


def set_table(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, n, sid, sketch) per row; sid 0 and an empty sketch for the empty set."""
    x, kind = _columns(df, doc_id, text)
    ship(df.sparkSession)

    def run(batches):
        claim("shingles")
        for b in batches:
            sets = (shingles(t.as_py()) for t in b.column(1))
            rows = [(len(s), set_id(s), parity(s)) if len(s) else (0, 0, b"") for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(id_type(kind)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["_id", "n", "sid", "sketch"])

    return x.mapInArrow(run, f"_id {kind.simpleString()}, n long, sid long, sketch binary")


def key_table(df: DataFrame, text: str = "text") -> DataFrame:
    """(key, sid): the join keys of every distinct set of a partition."""
    x = df.select(F.col(f"`{text}`").cast("string").alias("_text"))
    ship(df.sparkSession)

    def run(batches):
        claim("shingles")
        seen: set[int] = set()
        for b in batches:
            found, owner, size = [], [], 0

            def flush():
                k = np.concatenate(found).view(np.int64)
                return pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.repeat(np.array(owner, dtype=np.int64), [len(f) for f in found]))], names=["key", "sid"])

            for t in b.column(0):
                s = shingles(t.as_py())
                if not len(s) or (sid := set_id(s)) in seen:
                    continue
                seen.add(sid)
                found.append(keys(s))
                owner.append(sid)
                size += len(found[-1])
                if size >= 200_000:
                    yield flush()
                    found, owner, size = [], [], 0
            if found:
                yield flush()

    return x.mapInArrow(run, "key long, sid long")


def grouped(batches, n_columns: int, block=lambda key: LIST_BLOCK) -> Iterator[tuple]:
    """Columns of each run of equal values in column 0, over batches sorted by it, as numpy arrays (or lists for other types).

    Runs may cross batches. A run of more than block(key) rows comes in several pieces, numbered by the last item.
    """
    held: list[list] = [[] for _ in range(n_columns)]
    piece, current, room = 0, None, 0

    def columns(b):
        return [c.to_numpy(zero_copy_only=False) for c in b.columns[:n_columns]]

    for b in batches:
        if not b.num_rows:
            continue
        cols = columns(b)
        key = cols[0]
        edges = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        for lo, hi in zip(edges[:-1], edges[1:]):
            if current is None or key[lo] != current:
                if held[0]:
                    yield (*[np.concatenate(h) for h in held], piece)
                held, piece, current, room = [[] for _ in range(n_columns)], 0, key[lo], block(key[lo])
            at = lo
            while at < hi:
                upto = min(hi, at + room - sum(map(len, held[0])))
                for h, c in zip(held, cols):
                    h.append(c[at:upto])
                at = upto
                if sum(map(len, held[0])) >= room:
                    yield (*[np.concatenate(h) for h in held], piece)
                    held, piece = [[] for _ in range(n_columns)], piece + 1
    if held[0]:
        yield (*[np.concatenate(h) for h in held], piece)


def shared_lists(key_rows: DataFrame) -> DataFrame:
    """(gid, sid): lists of at least two sets; any two sets that share a key are in one list at least.

    Keys are sorted and streamed, so no list is held whole. Equal lists come of many keys, as near copies share most of
    theirs, and of a large group of near copies nearly as many different ones, each without a few of the group; such lists
    mostly begin with the same set and are joined (see joined_lists), so that a set is not sent on once for each key. A list
    of several blocks becomes a list for each pair of its blocks.
    """
    spark = key_rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ordered = key_rows.repartition(n, "key").sortWithinPartitions("key", "sid")

    def run(batches):
        given: set[int] = set()
        rows: list[tuple] = []
        size = 0
        for key, sids, piece in _pairs_only(batches):
            if len(sids) < 2 and piece < 0:
                continue
            gid = set_id(sids) if piece < 0 else int(key[0])
            if piece < 0:
                if gid in given:
                    continue
                given.add(gid)
                if len(given) > 1_000_000:
                    given.clear()
            step = LIST_ROW if piece < 0 else len(sids)
            for part, at in enumerate(range(0, len(sids), step)):
                rows.append((gid, piece, int(sids[0]), len(sids), part, block_of(key[0]), sids[at : at + step].tolist()))
            size += len(sids)
            if size > 100_000:
                yield _lists(rows)
                rows, size = [], 0
        if rows:
            yield _lists(rows)

    def join(batches):
        found: list[np.ndarray] = []
        for x in joined_lists(_plain_lists(batches)):
            found.append(x)
            if sum(map(len, found)) > 100_000:
                yield _members(found)
                found = []
        if found:
            yield _members(found)

    lists = cut(ordered.mapInArrow(run, "gid long, piece int, hub long, size int, part int, room int, sids array<long>"))
    plain = lists.where("piece < 0").drop("piece").repartition(n, "hub").sortWithinPartitions("hub", F.desc("size"), "gid", "part")
    plain = plain.select("hub", "gid", "part", "room", "sids").mapInArrow(join, "gid long, sid long")
    blocks = lists.where("piece >= 0")
    a, b = (blocks.select(F.col("gid").alias("key"), F.col("piece").alias(f"p{k}"), F.col("sids").alias(f"s{k}")) for k in (0, 1))
    crossed = a.join(b, "key").where("p0 < p1").select(F.xxhash64("key", "p0", "p1").alias("gid"), F.explode(F.concat("s0", "s1")).alias("sid"))
    return plain.unionByName(crossed)


def _plain_lists(batches) -> Iterator[tuple[int, int, np.ndarray]]:
    """(hub, room, sids) of each list, of rows (hub, gid, part, room, sids) sorted by list and part, which may repeat."""
    last, held, room = None, [], 0
    for b in batches:
        for hub, gid, part, r, sids in zip(*(c.to_pylist() for c in b.columns[:4]), b.column(4)):
            if last is not None and (hub, gid) != last[:2]:
                yield last[0], room, np.concatenate(held)
                last, held = None, []
            if last is None:
                room = r
            room = min(room, r)
            if last is None or part != last[2]:
                held.append(sids.values.to_numpy())
                last = (hub, gid, part)
    if last is not None:
        yield last[0], room, np.concatenate(held)


def joined_lists(lists: Iterator[tuple[int, int, np.ndarray]]) -> Iterator[np.ndarray]:
    """Lists that hold each of the given ones, (hub, room, sids) sorted by hub, in one of theirs.

    Lists of one hub are joined while the joined one has room and comparing all its sets with each other costs no more
    than doing so in each list, or is cheap.
    """
    current, held = None, []
    for hub, room, sids in lists:
        if hub != current:
            yield from (x for x, _, _ in held)
            current, held = hub, []
        for k, (x, work, own) in enumerate(held):
            both = np.union1d(x, sids)
            if len(both) <= min(room, own) and len(both) ** 2 <= max(work + len(sids) ** 2, SMALL_LIST**2):
                held[k] = (both, work + len(sids) ** 2, min(room, own))
                break
        else:
            if len(held) == OPEN_LISTS:
                yield held.pop(0)[0]
            held.append((sids, len(sids) ** 2, room))
    yield from (x for x, _, _ in held)


def _members(found: list[np.ndarray]) -> pa.RecordBatch:
    gids = np.repeat(np.array([set_id(x) for x in found], dtype=np.int64), [len(x) for x in found])
    return pa.RecordBatch.from_arrays([pa.array(gids), pa.array(np.concatenate(found), pa.int64())], names=["gid", "sid"])


def _pairs_only(batches):
    """Runs of grouped(), without the many of one row: a batch's lone rows are dropped before its runs are cut.

    Equal rows, as partitions give them of the same set, count once. The last item is -1 for a run that is whole, else the piece's number.
    """

    def slim():
        carry = sent = None
        for b in batches:
            k, s = b.column(0).to_numpy(), b.column(1).to_numpy()
            if carry is not None:
                k, s = np.concatenate([carry[0], k]), np.concatenate([carry[1], s])
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])])[: len(k)]
            if len(k) and sent == (k[0], s[0]):
                new[0] = False
            k, s = k[new], s[new]
            last = int(np.searchsorted(k, k[-1])) if len(k) else 0
            if len(k) - last >= LIST_BLOCK:
                last = len(k)
            carry = (k[last:], s[last:])
            k, s = k[:last], s[:last]
            if len(k):
                # A row is not lone if others of its key have gone before.
                more = sent is not None and sent[0] == k[0]
                sent = (k[-1], s[-1])
                same = k[1:] == k[:-1]
                lone = ~(np.concatenate([[more], same]) | np.concatenate([same, [False]]))
                if not lone.all():
                    yield pa.RecordBatch.from_arrays([pa.array(k[~lone]), pa.array(s[~lone])], names=["key", "sid"])
        if carry is not None and (len(carry[0]) > 1 or (len(carry[0]) and sent is not None and sent[0] == carry[0][0])):
            yield pa.RecordBatch.from_arrays([pa.array(carry[0]), pa.array(carry[1])], names=["key", "sid"])

    before = None
    for x in grouped(slim(), 2, block_of):
        if before is not None:
            whole = before[-1] == 0 and int(x[0][0]) != int(before[0][0])
            yield (before[0], before[1], -1 if whole else before[2])
        before = x
    if before is not None:
        yield (before[0], before[1], -1 if before[-1] == 0 else before[2])


def _lists(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"gid": pa.int64(), "piece": pa.int32(), "hub": pa.int64(), "size": pa.int32(), "part": pa.int32(), "room": pa.int32(), "sids": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], names=list(kinds))


class Sketches:
    """The sizes and sketches of a list's sets. Sets that may be linked have sketches of equal size or of twice the size."""

    def __init__(self, n: np.ndarray, blobs: list[bytes]):
        self.n = n = n.astype(np.int64)
        self.words = np.array([len(b) // 8 for b in blobs])
        self.row = {}
        self.bits = {}
        for w in np.unique(self.words):
            same, twice = (np.flatnonzero(self.words == k * w) for k in (1, 2))
            a, b = (np.frombuffer(b"".join([blobs[i] for i in own]), dtype=np.uint64).reshape(len(own), -1) if len(own) else np.empty((0, k * w), dtype=np.uint64) for own, k in ((same, 1), (twice, 2)))
            self.bits[w] = np.concatenate([a, b[:, :w] ^ b[:, w:]])
            self.row[w] = np.full(len(n), -1)
            self.row[w][np.concatenate([same, twice])] = np.arange(len(same) + len(twice))

    def plausible(self, i: int, js: np.ndarray) -> np.ndarray:
        """Of the rows js those that may be linked to row i, by size and by the lower bound of the symmetric difference."""
        n = self.n
        js = js[100 * np.minimum(n[js], n[i]) >= 75 * np.maximum(n[js], n[i])]
        out = []
        least = np.minimum(self.words[js], self.words[i])
        for w in np.unique(least):
            own = js[least == w]
            bits, row = self.bits[w], self.row[w]
            apart = np.bitwise_count(bits[row[own]] ^ bits[row[i]]).sum(axis=1, dtype=np.int64)
            out.append(own[7 * apart <= n[own] + n[i]])
        return np.concatenate(out) if out else js


def forest(x: Sketches) -> list[tuple[int, int]]:
    """A spanning forest of the graph of plausible links."""
    left, out = np.arange(len(x.n)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = x.plausible(i, left)
            if len(hit):
                out += [(i, int(j)) for j in hit]
                queue += hit.tolist()
                left = left[~np.isin(left, hit, assume_unique=True)]
    return out


def all_plausible(x: Sketches, comp: np.ndarray) -> list[tuple[int, int]]:
    """All plausible links between different components."""
    rows = np.arange(len(x.n))
    return [(i, int(j)) for i in rows for j in x.plausible(i, np.flatnonzero((comp != comp[i]) & (rows > i)))]


def candidate_links(members: DataFrame, every: bool) -> DataFrame:
    """Distinct (a, b), a < b, from (gid, sid, n, sketch, comp): a forest for each list, or every pair across components."""
    spark = members.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    members = members if every else members.withColumn("comp", F.lit(0).cast("long"))
    ordered = members.select("gid", "sid", F.col("n").cast("int").alias("n"), "comp", "sketch").repartition(parts, "gid").sortWithinPartitions("gid")

    def run(batches):
        a, b = [], []
        for gid, sid, n, comp, sketch in _whole(batches):
            x = Sketches(n, list(sketch))
            for i, j in all_plausible(x, comp) if every else forest(x):
                a.append(min(sid[i], sid[j]))
                b.append(max(sid[i], sid[j]))
            if len(a) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return ordered.mapInArrow(run, "a long, b long").distinct()


def _whole(batches):
    """Runs of grouped() put together again: a list has at most two blocks."""
    held = None
    for *cols, _ in grouped(batches, 5):
        if held is not None and held[0][0] == cols[0][0]:
            held = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            continue
        if held is not None:
            yield held
        held = cols
    if held is not None:
        yield held


def verified(df: DataFrame, classes: DataFrame, pairs: DataFrame, doc_id: str, text: str, threshold: int) -> DataFrame:
    """(a, b, linked): 100 * intersection >= threshold * union, from the whole sets of the pairs.

    The sets are made again from the texts of one document of each class; a bitmap of fixed size keeps the others out.
    """
    needed = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(classes.select("sid", "rep"), "sid")
    x, kind = _columns(df, doc_id, text)
    x = maybe_repeated(x, F.col("_id"), repeated_bitmap(needed.withColumn("n", F.lit(2)), F.col("rep")), "_maybe").where("_maybe").drop("_maybe")
    ship(df.sparkSession)

    def sets(batches):
        claim("shingles")
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                own = [shingles(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(id_type(kind)), pa.array([set_id(s) if len(s) else 0 for s in own], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())], names=["_id", "sid", "body"])

    bodies = x.mapInArrow(sets, f"_id {kind.simpleString()}, sid long, body binary")
    bodies = bodies.join(needed, "sid").where(F.col("_id").eqNullSafe(F.col("rep"))).select("sid", "body")
    # Both joins read one shuffle of the bodies; then one body of each pair travels to the other.
    first = pairs.select("a", "b").join(bodies.withColumnsRenamed({"sid": "a", "body": "x"}), "a")
    both = first.join(bodies.withColumnsRenamed({"sid": "b", "body": "y"}), "b").select("a", "b", "x", "y")

    def judge(batches):
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3)):
                s, t = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                same = len(np.intersect1d(s, t, assume_unique=True))
                linked.append(100 * same >= threshold * (len(s) + len(t) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return both.mapInArrow(judge, "a long, b long, linked boolean").distinct()


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(sid, comp) of the sets that links (a, b) touch; comp is the least sid of the component.

    Labels fall to the least among neighbours and then to the label's own label, until none changes. With labels of
    earlier links, only what the new ones join is worked on.
    """
    if labels is not None:
        joined = with_components(links, labels).where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        more = components(joined).select(F.col("sid").alias("comp"), F.col("comp").alias("_to"))
        ends = links.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(labels, "sid", "left_anti").withColumn("comp", F.col("sid"))
        return cut_in_loop(labels.unionByName(ends).join(more, "comp", "left").select("sid", F.coalesce("_to", "comp").alias("comp")))
    both = cut_in_loop(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("sid"), F.least("a", "m").alias("comp"))
    labels = cut_in_loop(labels)
    while True:
        near = both.join(labels.withColumnRenamed("sid", "b"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        low = labels.join(near.withColumnRenamed("a", "sid"), "sid").select("sid", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        jump = labels.select(F.col("sid").alias("comp"), F.col("comp").alias("next"))
        moved = cut_in_loop(low.join(jump, "comp", "left").select("sid", "old", F.least(F.col("comp"), F.coalesce("next", "comp")).alias("comp")))
        labels = moved.select("sid", "comp")
        if moved.where("comp <> old").isEmpty():
            return labels


def with_components(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """pairs (a, b) with ca and cb, the components of their sets; a set without links is a component."""
    for c in "ab":
        pairs = pairs.join(labels.select(F.col("sid").alias(c), F.col("comp").alias(f"c{c}")), c, "left").withColumn(f"c{c}", F.coalesce(f"c{c}", c))
    return pairs


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, links) per row of df.

    component_id is the least id among all documents that links reach, the document's own among them (null ids count
    only where there is no other); links counts the links of its set that were verified. A document without words has
    no shingles, no links, and is its own component. Documents of equal sets are linked. Rows that repeat an id are
    documents of their own. Extra columns do not matter.
    """
    found = _found(df, doc_id, text, threshold)
    return found.select(F.col("_id").alias(doc_id), F.col("n").alias("n_shingles"), "component_id", "links")


def _found(df: DataFrame, doc_id: str, text: str, threshold: int) -> DataFrame:
    """near_duplicates as (_id, n, sid, comp, component_id, links); comp is the least sid of the component, null for the empty set."""
    if threshold != 75:
        raise ValueError("the bounds of this join are those of a threshold of 75 percent")
    rows = cut(set_table(df, doc_id, text))
    classes = rows.where("n > 0").groupBy("sid").agg(F.min("_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("rows"))
    classes = cut(classes)
    lists = shared_lists(key_table(df, text))
    release(df.sparkSession)
    members = cut(lists)
    del lists
    release(df.sparkSession)
    sketched = members.join(classes.select("sid", "n", "sketch"), "sid")

    # A pair's sets are read whole, so only pairs that may join components are verified: first each set's with its
    # least partner, then the others between the components that remain.
    pairs = cut_in_loop(candidate_links(sketched, every=False))
    release(df.sparkSession)
    hooks = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    tested = cut_in_loop(verified(df, classes, hooks, doc_id, text, threshold))
    release(df.sparkSession)
    labels = components(tested.where("linked"))
    release(df.sparkSession)
    rest = cut_in_loop(with_components(pairs.join(tested, ["a", "b"], "left_anti"), labels).where("ca <> cb").select("a", "b"))
    if not rest.isEmpty():
        new = cut_in_loop(verified(df, classes, rest, doc_id, text, threshold))
        release(df.sparkSession)
        tested, labels = tested.unionByName(new), components(new.where("linked"), labels)
    if not tested.where("not linked").isEmpty():
        # Lists with a refused pair whose two sets are still apart: every plausible pair across components.
        again = members.join(labels, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
        apart = with_components(tested.where("not linked"), labels).where("ca <> cb")
        first = members.join(apart.select(F.col("a").alias("sid"), "b"), "sid").select("gid", F.col("b").alias("sid"))
        lists = members.join(first, ["gid", "sid"], "left_semi").select("gid").distinct()
        left = again.join(lists, "gid", "left_semi").join(classes.select("sid", "n", "sketch"), "sid")
        more = cut_in_loop(candidate_links(left, every=True).join(tested, ["a", "b"], "left_anti"))
        release(df.sparkSession)
        if not more.isEmpty():
            new = cut_in_loop(verified(df, classes, more, doc_id, text, threshold))
            release(df.sparkSession)
            tested, labels = tested.unionByName(new), components(new.where("linked"), labels)

    links = tested.where("linked").select(F.explode(F.array("a", "b")).alias("sid")).groupBy("sid").agg(F.count("*").alias("links"))
    release(df.sparkSession)
    named = classes.select("sid", "rep", "rows").join(labels, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    named = cut(named)
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = cut(named.join(least, "comp").join(links, "sid", "left").select("sid", "rows", "comp", "component_id", F.coalesce("links", F.lit(0)).alias("links")))
    some = spread_join(rows.where("n > 0").select("_id", "n", "sid"), named, "sid", "rows").select("_id", "n", "sid", "comp", "component_id", "links")
    none = rows.where("n = 0").select("_id", "n", "sid", F.lit(None).cast("long").alias("comp"), F.col("_id").alias("component_id"), F.lit(0).cast("long").alias("links"))
    return some.unionByName(none)


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df of one document of each component, that of least id. Only texts that may go travel.

    Rows that repeat an id, or have none, are told apart by their sets: of those with the component's least id one of the
    least set stays, and no other row with that id is touched. Rows without words all stay; an empty table gives an empty
    result. All columns are passed on, whatever their names.
    """
    x, name = hidden(df)
    return _dedup(x, name[doc_id], name[text]).toDF(*df.columns)


def _dedup(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    x = cut(_found(df, doc_id, text, 75).select("_id", "n", "sid", "comp", "component_id"))
    first = F.col("_id").eqNullSafe(F.col("component_id"))
    # Of a pair (id, set) _stay says whether all rows stay (2), one of them (1) or none (0).
    heads = x.where(first & (F.col("n") > 0))
    several = cut(heads.groupBy("comp").agg(F.min("sid").alias("_least"), F.count("*").alias("rows")).where("rows > 1"))
    fates = x.where(~first | (F.col("n") == 0)).select("_id", "sid", F.when(F.col("n") == 0, 2).otherwise(0).alias("_stay"))
    one = F.when(F.col("_least").isNull(), 2).when(F.col("sid") == F.col("_least"), 1).otherwise(0)
    fates = fates.unionByName(spread_join(heads, several, "comp", "rows").select("_id", "sid", one.alias("_stay")))
    gone = cut(fates.groupBy("_id").agg(F.min("_stay").alias("_lo"), F.max("_stay").alias("_hi")).where("_lo < 2").select(F.col("_id").alias("_gone"), "_hi"))
    x = maybe_repeated(df.withColumn("_key", F.col(f"`{doc_id}`")), F.col("_key"), repeated_bitmap(gone.withColumn("n", F.lit(2)), F.col("_gone")), "_maybe")
    stay = x.where(~F.col("_maybe"))
    rest = x.where("_maybe").join(gone, F.col("_key").eqNullSafe(F.col("_gone")), "left_anti")
    out = stay.unionByName(rest)
    mixed = gone.where("_hi > 0").select("_gone")
    if not mixed.isEmpty():
        pairs = fates.where("_stay > 0").join(mixed, F.col("_id").eqNullSafe(F.col("_gone")), "left_semi").distinct().select(F.col("_id").alias("_of"), F.col("sid").alias("_set"), "_stay")

        @F.pandas_udf("long")
        def set_of(texts: pd.Series) -> pd.Series:
            claim("shingles")
            sets = map(shingles, texts)
            return pd.Series([set_id(s) if len(s) else 0 for s in sets], dtype="int64")

        some = x.where("_maybe").join(mixed, F.col("_key").eqNullSafe(F.col("_gone")), "left_semi").withColumn("_sid", set_of(F.col(f"`{text}`").cast("string")))
        some = some.join(pairs, F.col("_key").eqNullSafe(F.col("_of")) & (F.col("_sid") == F.col("_set")))
        rank = F.row_number().over(Window.partitionBy("_key", "_sid").orderBy(F.col(f"`{text}`")))
        single = some.where("_stay = 1").withColumn("_rank", rank).where("_rank = 1")
        out = out.unionByName(some.where("_stay = 2").select(out.columns)).unionByName(single.select(out.columns))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])
