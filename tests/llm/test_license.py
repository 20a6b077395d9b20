"""License scans against plain search."""

import math
import random

from lagweave.llm import license_scan, licenses


def brute(texts):
    words = [licenses.WORD.findall((t or "").translate({k: k + 32 for k in range(65, 91)})) for t in texts]
    vocab = {w for t in licenses.TEMPLATES for w in t.words} | {w for _, p in licenses.BASE_PHRASES for w in p.split()}
    idf = {v: math.log((len(texts) + 1) / (sum(v in ws for ws in words) + 1)) + 1e-6 for v in vocab}
    out = []
    for ws in words:
        base = [(label, i) for label, p in licenses.BASE_PHRASES for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
        found = []
        for t in licenses.TEMPLATES:
            for s in [i - t.keys[0][0] for i, w in enumerate(ws) if w == t.keys[0][1]]:
                at = lambda q: ws[s + q] if 0 <= s + q < len(ws) else None
                if all(at(q) == w for q, w in t.keys):
                    score = sum(idf[w] for q, w in enumerate(t.words) if at(q) == w) / sum(idf[w] for w in t.words)
                    if score >= license_scan.MIN_SCORE - 1e-9:
                        found.append((t.label, s, round(score, 6)))
        out.append((len(ws), sorted(base), sorted(found)))
    return out


def test_against_plain_search(spark):
    rng = random.Random(4)
    gaps = [" ", "\n", ", ", "_", "-", "\u0000", "\x7f"]
    odd = ["\u0085", " ", " ", "K", "İ", "é", "Ä", "中"]
    texts = [None, "", " \t", "abc. ", "mit licence. ", "x.\u0085", ". ", " ", "MIT", "under the MIT license\n" * 40, "word " * 2_000 + "CC BY-NC"]
    for t in licenses.TEMPLATES:
        texts += [t.text, "Intro, words. " + t.text.upper() + " more", " ".join(t.text.split()[1:])]
        for _ in range(4):
            ws = t.text.split()
            for _ in range(rng.randrange(1, 1 + len(ws) // 3)):
                ws[rng.randrange(len(ws))] = rng.choice(["the", "license", "mit", "of", *odd])
            texts.append(rng.choice(gaps).join(ws) + rng.choice(gaps) + rng.choice(odd))
    for _ in range(60):
        texts.append(rng.choice(gaps).join(rng.choice(["under", "the", "MIT", "License", "cc", "BY", "nc", "apache", "version", "2", *odd]) for _ in range(rng.randrange(40))))
    df = spark.createDataFrame([(k, t, f"w{k}", k, "h") for k, t in enumerate(texts)], "k int, text string, _words string, score int, _hits string")
    got = {r["k"]: r for r in license_scan.scan(df.repartition(5)).collect()}
    assert len(got) == len(texts)
    for k, (n, base, found) in enumerate(brute(texts)):
        r = got[k]
        assert (r["n_words"], r["_words"], r["_hits"]) == (n, f"w{k}", "h"), repr(texts[k])
        assert sorted((m["label"], m["start"]) for m in r["base_hits"]) == base
        assert sorted((m["label"], m["start"], round(m["score"], 6)) for m in r["matches"]) == found
        assert r["labels"] == sorted({m[0] for m in base + found}) and r["score"] == (1.0 if base else min(1.0, max([m["score"] for m in r["matches"]], default=0.0)))
    assert license_scan.scan(df.where("false")).count() == 0
