"""Operators against brute force, round trips and hard rows."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from lagweave.llm import bpe, exact_dedup, license_scan, line_dedup, mixing, ngram_join, oracles, quality, queries, token_counts, toxicity, url_filter
from lagweave.llm.common import release
from lagweave.llm.pretokens import read_ranks
from tests.oracle import differences

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LONG = " ".join(f"w{k % 997}x{k % 31}" for k in range(30_000))
PASSAGE = " ".join(f"alpha{k}" for k in range(60))
#: ids and texts with nulls, empties, very long texts, ties and repeated rows.
HARD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "one two"), (5, "one two"), (None, "one two"), (6, LONG), (7, LONG + " end"), (8, LONG),
    (9, PASSAGE), (10, PASSAGE.upper()), (11, PASSAGE + " beta"), (12, "a b c d e f g h"), (13, "Ünïcode\u00a0İ K ☃ 12345 ٣٤\n\nx"), (14, "l1 x\nl2 x\nl3 x\nl4 x"), (15, "l0\nl1 x\n\nl2 x\nl3 x\nzz"),
    (16, "Released under the MIT License. CC BY-NC 4.0; under the mit license"), (None, None), (17, "tok " * 300),
]


@pytest.fixture(scope="module")
def hard(spark):
    # an extra column whose name clashes with results
    return spark.createDataFrame([(i, t, f"s{(i or 0) % 3}" if i != 9 else None, -1) for i, t in HARD], "doc_id long, text string, source string, n_words int")


@pytest.fixture(scope="module")
def empty(hard):
    return hard.where("false")


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_sql(spark, sf, name):
    assert differences(spark, queries.QUERIES[name], oracles.ORACLES[name], sf) == ""


def test_exact_dedup(hard, empty):
    got = exact_dedup.mark(hard).collect()
    for r in got:
        same = [i for i, t in HARD if (t or "") == (r["text"] or "")]
        ids = [i for i in same if i is not None]
        assert (r["keep_id"], r["group_size"]) == (max(ids) if ids else None, len(same))
    kept = exact_dedup.dedup(hard)
    assert sorted(kept.columns) == sorted(hard.columns)
    assert sorted(t or "" for t in (r["text"] for r in kept.collect())) == sorted({t or "" for _, t in HARD})
    assert exact_dedup.mark(empty).count() == 0


def brute_quality(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)} if len(w) < 2000 else None
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), None if covered is None else len(covered)


def test_quality(hard, empty, spark, sf):
    for df in (hard, spark.read.parquet(f"{sf}/documents.parquet").limit(150)):
        for r in quality.judge(df).collect():
            n, chars, symbols, dups, repeat = brute_quality(r["text"])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (n, chars, symbols, dups)
            assert repeat is None or r["n_repeat_words"] == repeat
            assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
            assert r["kept"] == (not r["failed_rules"])
    assert quality.keep(hard).columns == hard.columns and quality.keep(empty).count() == 0


def test_quality_keeps_clean(spark, sf):
    judged = quality.judge(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")).persist()
    x = judged.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert x.where("quality = 1 and not kept and not base_failed").count() == 0
    assert x.where("quality = 0 and kept").count() <= 0.1 * x.where("quality = 0").count()


def test_near_duplicates(hard, empty):
    sets = []
    for i, t in HARD:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(HARD)))
    for a in range(len(HARD)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                comp = [comp[b] if c == comp[a] else c for c in comp]
    want = []
    for k, (i, t) in enumerate(HARD):
        ids = [j for (j, _), c in zip(HARD, comp) if c == comp[k] and j is not None]
        want.append((str(i), len(sets[k]), str(min(ids) if ids and sets[k] else i)))
    got = [(str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in ngram_join.near_duplicates(hard).collect()]
    assert sorted(got) == sorted(want)
    assert ngram_join.near_duplicates(empty).count() == 0 and ngram_join.dedup(empty).columns == empty.columns


def test_near_dedup_rows(spark, hard):
    """One row of each group goes on, whatever ids repeat or are null, and rows of other texts with its id stay."""
    a, b, c, d = (" ".join(f"{w}{k}" for k in range(40)) for w in "abcd")
    # a copy's id on another text; null ids as copies, as others and among themselves; a group's least id on several rows; no words
    rows = [(1, a), (2, a + " x"), (2, b), (None, a + " y"), (None, c), (None, c + " x"), (None, c), (None, "lone one"), (7, d), (7, d), (7, d + " z"), (8, d), (7, "other words"), (None, ""), (None, None), (2, ""), (9, "p q r s t"), (9, "P q r s t")]
    got = [(r["doc_id"], r["text"]) for r in ngram_join.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    of_c, of_d, of_p = ([r for r in got if r[1] and r[1].startswith(w)] for w in ("c0 ", "d0 ", ("p q", "P q")))
    assert len(of_c) == len(of_d) == len(of_p) == 1 and of_d[0][0] == 7
    want = [(1, a), (2, b), (None, "lone one"), (7, "other words"), (None, ""), (None, None), (2, "")]
    assert sorted(map(str, got)) == sorted(map(str, want + of_c + of_d + of_p))
    kept = ngram_join.dedup(hard).collect()
    assert len(kept) == len({r["component_id"] for r in ngram_join.near_duplicates(hard).collect()})


def test_parity_keys_meet():
    rng = np.random.default_rng(1)
    for n in (3, 20, 64, 70, 400, 1000, 1400, 3000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            gone = rng.integers(0, max(1, n // 7) + 1)
            more = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**63, n // 8).astype(np.uint64)]))
            same = len(np.intersect1d(a, more))
            if 100 * same >= 75 * (len(a) + len(more) - same):
                assert len(np.intersect1d(ngram_join.keys(a), ngram_join.keys(more)))
                x = ngram_join.Sketches(np.array([len(a), len(more)]), [ngram_join.parity(a), ngram_join.parity(more)])
                assert len(x.plausible(0, np.array([1]))) == 1


def batches_of(rows, sizes):
    at = 0
    for n in sizes:
        part, at = rows[at : at + n], at + n
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in part], pa.int64()) for c in (0, 1)], names=["key", "sid"])


def cuts(rng, n):
    """Sizes of batches of n rows in all."""
    edges = sorted([0, n, *rng.sample(range(n + 1), min(n, rng.randrange(6)))])
    return [b - a for a, b in zip(edges[:-1], edges[1:])]


def test_runs_of_blocks(monkeypatch):
    """Runs around multiples of the block size, however batches cut them."""
    monkeypatch.setattr(ngram_join, "LIST_BLOCK", 4)
    rng = random.Random(5)
    for _ in range(2000):
        runs = {key: rng.choice([1, 1, 2, 3, 4, 5, 8, 9, 13]) for key in rng.sample(range(50), 5)}
        rows = sorted((key, sid) for key, n in runs.items() for sid in range(n))
        got = {}
        for key, sid, piece in ngram_join.grouped(batches_of(rows, cuts(rng, len(rows))), 2):
            assert len(set(key.tolist())) == 1 and piece == len(got.setdefault(int(key[0]), []))
            got[int(key[0])].append(sid.tolist())
        assert {k: sum(v, []) for k, v in got.items()} == {k: list(range(n)) for k, n in runs.items()}


def test_block_edges(monkeypatch):
    """No row of a run of two or more is lost where a block, a batch or the input ends; equal rows count once."""
    monkeypatch.setattr(ngram_join, "LIST_BLOCK", 4)
    rng = random.Random(6)
    for _ in range(2000):
        runs = {key: rng.choice([1, 1, 2, 3, 4, 5, 8, 9, 13]) for key in rng.sample(range(50), 5)}
        rows = sorted((key, sid) for key, n in runs.items() for sid in range(n))
        copies = sorted(rows + [r for r in rows if rng.random() < 0.3])
        lists = {}
        for key, sid, piece in ngram_join._pairs_only(batches_of(copies, cuts(rng, len(copies)))):
            lists.setdefault(int(key[0]), []).append((piece, sid.tolist()))
        assert {k: sum((s for _, s in v), []) for k, v in lists.items()} == {k: list(range(n)) for k, n in runs.items() if n > 1}
        assert all([p for p, _ in v] == ([-1] if len(v) == 1 else list(range(len(v)))) for v in lists.values())


def test_long_lists(spark):
    """Lists of several blocks, followed by others: every two sets meet in a list, and all of a list are linked."""
    n = 40_000
    long = spark.range(n).selectExpr("7L key", "id sid")
    short = spark.range(600).selectExpr("1000 + id div 3 key", "id sid")
    found = {}
    for r in ngram_join.shared_lists(long.unionByName(long.where("sid % 5 = 0")).unionByName(short)).collect():
        found.setdefault(r["gid"], []).append(r["sid"])
    assert all(len(s) == len(set(s)) for s in found.values())
    assert sorted(sorted(s) for s in found.values() if len(s) == 3) == [[k, k + 1, k + 2] for k in range(0, 600, 3)]
    lists_of = {}
    for gid, sids in found.items():
        for sid in sids if len(sids) > 3 else []:
            lists_of.setdefault(sid, set()).add(gid)
    kinds = {frozenset(s) for s in lists_of.values()}
    assert len(lists_of) == n and len(kinds) > 1 and all(a & b for a in kinds for b in kinds)

    sizes = [17_000, 20_000, 33_000, 3, 5, 2]
    members = [spark.range(m).selectExpr(f"{g}L gid", f"{g * 100_000} + id sid", "10 n", "cast(repeat('a', 128) as binary) sketch") for g, m in enumerate(sizes)]
    whole = members[0]
    for m in members[1:]:
        whole = whole.unionByName(m)
    links = ngram_join.candidate_links(whole.coalesce(1), every=False).selectExpr("a div 100000 g", "a", "b div 100000 h", "b").toPandas()
    assert (links.g == links.h).all() and links.groupby("g").size().to_dict() == {g: m - 1 for g, m in enumerate(sizes)}
    assert (links.groupby("g").apply(lambda x: len(set(x.a) | set(x.b)), include_groups=False) == sizes).all()


def test_lists_of_near_copies(spark):
    """A large group of near copies sends each set on a few times, not once for each key; sets that share a key still meet."""
    rng = random.Random(8)
    rows = [(key, sid) for key in range(100) for sid in range(300) if rng.random() < 0.85]
    rows += [(1000 + key, sid) for key in range(40) for sid in rng.sample(range(2000), rng.choice([1, 2, 3, 70, 200]))]
    lists = {}
    for r in ngram_join.shared_lists(spark.createDataFrame(rows, "key long, sid long")).collect():
        lists.setdefault(r["gid"], set()).add(r["sid"])
    sharing = {}
    for key, sid in rows:
        sharing.setdefault(key, set()).add(sid)
    assert all(any(s <= x for x in lists.values()) for s in sharing.values() if len(s) > 1)
    assert sum(len(x) for x in lists.values()) < 0.5 * len(rows)


def test_joined_lists(monkeypatch):
    """Each list is in one of the joined lists of its hub, none is over the room of a list in it, and rows that repeat count once."""
    monkeypatch.setattr(ngram_join, "SMALL_LIST", 4)
    monkeypatch.setattr(ngram_join, "OPEN_LISTS", 2)
    rng = random.Random(9)
    for _ in range(300):
        given = {}
        for gid in range(rng.randrange(1, 30)):
            hub, n = rng.randrange(3), rng.randrange(2, 12)
            given[hub, gid] = (rng.choice([12, 14, 20]), [hub, *sorted(rng.sample(range(3, 25), n - 1))])
        rows = [(hub, gid, part, room, sids[at : at + 3]) for (hub, gid), (room, sids) in sorted(given.items()) for part, at in enumerate(range(0, len(sids), 3)) for _ in range(rng.choice([1, 1, 2]))]
        batches, at = [], 0
        for n in cuts(rng, len(rows)):
            cols = [[r[c] for r in rows[at : at + n]] for c in range(5)]
            batches.append(pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.list_(pa.int64()))], names=["hub", "gid", "part", "room", "sids"]))
            at += n
        whole = list(ngram_join._plain_lists(batches))
        assert [(hub, room, x.tolist()) for hub, room, x in whole] == [(hub, room, sids) for (hub, _), (room, sids) in sorted(given.items())]
        out = [x.tolist() for x in ngram_join.joined_lists(iter(whole))]
        assert all(len(x) == len(set(x)) <= 20 for x in out)
        for room, sids in given.values():
            assert any(set(sids) <= set(x) and len(x) <= room for x in out)


def test_release_is_prompt(spark):
    """What Python has dropped is gone from the JVM when release returns, not when Py4J's thread wakes."""
    jvm = spark.sparkContext._jvm
    for _ in range(5):
        dropped = [jvm.java.util.ArrayList() for _ in range(20)]
        seen = [jvm.java.lang.ref.WeakReference(x) for x in dropped]
        del dropped
        release(spark)
        assert all(x.get() is None for x in seen[:-1])


def test_line_dedup(hard, empty, spark):
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(hard).where("doc_id in (1, 14, 15)").collect()}
    assert got[15]["text"] == "l0\nzz" and got[15]["n_removed"] == 4 and got[14]["n_removed"] == 0 and got[1]["text"] is None
    assert line_dedup.dedup_lines(empty).count() == 0
    assert line_dedup.dedup_lines(hard).count() == len(HARD)


def test_bpe(hard, empty):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    got = bpe.encode(hard, RANKS, public_tokenizers.PATTERN).collect()
    want = [(str(i), tuple(own.encode_ordinary(t or "")), (t or "").encode()) for i, t in HARD]
    assert sorted((str(r["doc_id"]), tuple(r["ids"]), bytes(r["decoded"])) for r in got) == sorted(want)
    assert bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    c, rng = bpe.Coder(read_ranks(RANKS)), random.Random(3)
    texts = ["a" * 700, "".join(rng.choice("abcdé") for _ in range(400)), "ab" * 300, "\x1c\u1680\U0001e7d0", "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(2000))]
    from lagweave.llm.pretokens import Splitter, foreign_characters

    ids, decoded = c.code(Splitter(public_tokenizers.PATTERN, foreign_characters(public_tokenizers.PATTERN)), texts)
    assert ids.to_pylist() == [own.encode_ordinary(t) for t in texts] and decoded.to_pylist() == [t.encode() for t in texts]


def test_token_counts(hard, empty):
    scores = {bytes([b]): -9.0 for b in range(256)} | {b"ab": -3.0, b"abc": -4.5, b"bc": -3.0, b"c": -2.0, b"cab": -3.5}

    def brute(w):
        if not w:
            return [(0.0, 0)]
        return [(scores[w[:k]] + s, n + 1) for k in range(1, len(w) + 1) if w[:k] in scores for s, n in brute(w[k:])]

    trie = token_counts.Trie(scores)
    for w in (b"abcabc", b"abcab", b"cabx", b"abc", b"c", b"bcabca", b"abcabc"):
        s, n = max(brute(w), key=lambda x: (round(x[0], 9), -x[1]))
        assert trie.insert(w)[1] == n and abs(trie.insert(w)[0] - s) < 1e-9
    x = token_counts.count_with_ranks(hard, RANKS, public_tokenizers.PATTERN).collect()
    assert len(x) == len(HARD) and all(r["n_tokens"] == 0 for r in x if r["doc_id"] in (1, 2))
    assert token_counts.count_with_ranks(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_license(hard, empty):
    got = {r["doc_id"]: r for r in license_scan.scan(hard).collect()}
    assert sorted((b["label"], b["start"]) for b in got[16]["base_hits"]) == [("cc-by-nc", 5), ("mit", 1), ("mit", 10)]
    assert got[16]["labels"] == ["cc-by-nc", "mit"] and got[16]["score"] == 1.0 and got[4]["labels"] == [] and got[1]["n_words"] == 0
    assert license_scan.scan(empty).count() == 0


def test_url_filter(spark):
    urls = ["http://A.Org/x", "https://x.example.org/es/1", "ftp://example.org/en/12?q#f", "http://example.org.evil/es/", "no scheme", None, "", "http://b.com/de/1", "http://com/fr/", "a://b://c/d"]
    df = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id int, url string, host string")
    labelled = spark.createDataFrame([(f"http://site{k}.net/page/{k}", 0) for k in range(300)] + [(f"http://win-big-{k}.biz/?a={k}&b=1&c=2", 1) for k in range(300)], "url string, label int")
    model = url_filter.train(labelled)
    got = {r["page_id"]: r for r in url_filter.judge(df, queries.URL_RULES, model).collect()}
    assert [(got[k]["host"], got[k]["path"], got[k]["rule"]) for k in range(len(urls))] == [
        ("a.org", "/x", "org/"), ("x.example.org", "/es/1", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"), ("example.org.evil", "/es/", None), ("", "", None), ("", "", None), ("", "", None),
        ("b.com", "/de/1", "com/de/"), ("com", "/fr/", "com/fr/"), ("b:", "//c/d", None),
    ]
    test = spark.createDataFrame([(f"http://place{k}.net/page/{k}", 0) for k in range(50)] + [(f"http://get-rich-{k}.biz/?a={k}&b=1&c=2", 1) for k in range(50)], "url string, label int")
    scored = url_filter.score(test, url_filter.Boosted.from_json(model.to_json())).select("label", "score").collect()
    assert np.mean([(r["score"] >= 0.5) == (r["label"] == 1) for r in scored]) > 0.95
    assert url_filter.judge(df.where("false"), [], url_filter.train(labelled.where("false"))).count() == 0


def test_url_suffixes(spark):
    """Every suffix of the training sample has its statistic when URLs are scored."""
    labelled = spark.createDataFrame([(f"http://www.place{k}.net/{j}", k % 2) for k in range(1200) for j in range(2)], "url string, label int")
    assert set(url_filter.train(labelled).suffixes) == {f"place{k}.net" for k in range(1200)} | {""}


def test_mixing(hard, empty, spark, sf):
    got = mixing.mix_counts(hard).collect()
    assert len(got) == len(HARD) and all(0 <= r["copies"] <= 3 for r in got)
    again = mixing.mix_counts(hard.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    x = mixing.mix_counts(spark.read.parquet(f"{sf}/documents.parquet")).toPandas()
    g = x.assign(taken=x.copies * x._size).groupby("_source").agg(target=("_target", "first"), taken=("taken", "sum"), largest=("_size", "max"))
    assert ((g.taken - g.target).abs() <= 2 * g.largest).all() and abs(g.target.sum() - x._size.sum()) < 1e-3
    part, left = mixing.settle(np.full(1001, 0.37), np.random.default_rng(0))
    settled = np.delete(part, left) if left >= 0 else part
    assert set(settled) <= {0.0, 1.0} and abs(part.sum() - 0.37 * 1001) < 1e-9
    assert mixing.mix_counts(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert mixing.mix(hard).columns == hard.columns


def test_toxicity(spark, sf, hard, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    assert model.cuts == sorted(model.cuts) and toxicity.Ordinal.from_json(model.to_json()) == model
    x = toxicity.score(docs, model).join(labels.where("doc_id % 2 = 1").select("doc_id", F.col("toxic").alias("y")), "doc_id").toPandas()
    assert x[x.y == 0].toxic.mean() < 0.01 and x[x.y == 1].toxic.mean() > 0.8
    assert x[x.y == 1].severity.mean() > x[x.y == 0].severity.mean() + 1
    assert toxicity.score(hard, model).count() == len(HARD) and toxicity.score(empty, model).count() == 0
    assert toxicity.score(hard, toxicity.train(docs.where("false"), labels)).where("toxic").count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens", "decoded_sha256", F.size("ids").alias("k")).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert out and all(r["n_tokens"] == r["k"] and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in out)
    assert len({texts[r["doc_id"]] for r in out}) == len({r["doc_id"] for r in out})
