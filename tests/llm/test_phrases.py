"""Phrase mining, the Merkle manifest and the quality classifier against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from contactmine.llm import collocations, merkle, quality
from contactmine.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def brute_phrases(rows, least, longest, top, share):
    f = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        for words in pieces(text):
            for k in range(1, longest + 1):
                f["und" if lang is None else lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            if any(100 * b >= share * a and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, _, l, r = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        n = sum(a for p, a in counts.items() if len(p) == 1)
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return out


@pytest.mark.parametrize(("least", "longest", "top", "share"), [(10, 3, 2000, 50), (2, 3, 25, 50), (2, 2, 2000, 50), (2, 4, 2000, 100)])
def test_phrases(spark, least, longest, top, share):
    rng = random.Random(4)
    words = ["a", "B", "c", "été", "ÉTÉ", "d\u00a0e", "\u2003", "x-y", "'s", "i\x1fj", "f" * 300]
    ends = [" ", " ", " ", " ", "\t ", "  ", ". ", ",", "\n", "\r\n", "!?", "\x0b", "; "]
    rows = [(rng.choice(["en", "en", "en", "fr", None, ""]), "".join(w + rng.choice(ends) for w in rng.choices(words, k=rng.randint(0, 60)))) for _ in range(60)]
    rows += [("en", None), (None, ""), ("en", " \t."), ("fr", "same line here. " * 12), ("fr", "same line here. " * 12), ("de", "solo")]
    made = [(i % 5 if i % 9 else None, lang, text, 1, 2, "p") for i, (lang, text) in enumerate(rows)]
    frame = spark.createDataFrame(made, "doc_id long, lang string, text string, w1 int, n int, phrase string")
    got = collocations.collocations(frame, least, longest, top, share).collect()
    assert {tuple(r) for r in got} == brute_phrases(rows, least, longest, top, share) and len(got) == len(set(got))


def test_scores_pass_64_bits(spark):
    a, l, r = 40_000_000_000_000, 90_000_000_000_001, 70_000_000_000_003
    phrases = {2: spark.createDataFrame([(1, 2, a)], "w1 long, w2 long, a long")}
    words = spark.createDataFrame([(1, l), (2, r)], "w long, n long")
    assert collocations._scored(phrases, words, 2).first().score == 1000000 * a * a // (l * r)


def test_relations_of_long_documents(monkeypatch):
    """Rows and slices far smaller than a document lose and repeat nothing."""

    class Every:
        def __contains__(self, key):
            return True

        def among(self, keys):
            return np.ones(len(keys[0]), bool)

    monkeypatch.setattr(collocations, "ROW", 5)
    monkeypatch.setattr(collocations, "SLICE", 16)
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcd") * rng.randint(1, 3) + rng.choice([" ", " ", " ", ". ", "\n"]) for _ in range(n)) for n in (0, 1, 4, 5, 6, 7, 60, 200)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * len(texts), "text": texts})
    relation = list(collocations._occurrences("0", Every(), 4)(iter([batch])))
    keys = collocations._Keys("0", "en", Every())
    for length in (1, 2, 3):
        expected = collections.Counter(
            tuple(keys[w.encode()] for w in words[i:i + length + 1]) for t in texts for words in pieces(t) for i in range(len(words) - length)
        )
        got = collections.Counter(tuple(r.values()) for b in collocations._groups(length)(iter(relation)) for r in b.to_pylist())
        assert got == expected
        relation = list(collocations._extended(length, Every())(iter(relation)))


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, more=0):
        n = None if r.n_chars is None else r.n_chars + more
        return digest(*map(field, (r.doc_id, r.source, r.lang, n, r.text)))

    by = collections.defaultdict(list)
    for r in rows:
        by[r.lang].append(r)
    langs, trees, out = sorted(by, key=lambda x: (x is not None, (x or "").encode())), {}, collections.Counter()
    for lang in langs:
        by[lang].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        trees[lang] = tree([leaf(r) for r in by[lang]])
    top = tree([trees[lang][-1][0] for lang in langs])
    path = lambda levels, i: [(i >> k & 1, x[i >> k ^ 1] if i >> k ^ 1 < len(x) else None) for k, x in enumerate(levels[:-1])]
    for k, lang in enumerate(langs):
        for i, r in enumerate(by[lang]):
            steps = path(trees[lang], i) + path(top, k)
            h = leaf(r, r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0)
            for right, other in steps:
                h = digest(h) if other is None else digest(other, h) if right else digest(h, other)
            proof = digest(*(s for _, s in steps if s))
            out[r.doc_id, leaf(r), trees[lang][-1][0], top[-1][0], proof, h, h == top[-1][0]] += 1
    return out


@pytest.mark.parametrize("span", [1, 3, 8])
def test_manifest(spark, span):
    langs = [None, "en", "", "-", "é", "en", "en"]
    rows = [(i % 7 if i % 11 else None, "s" if i % 3 else None, langs[i % 7], i if i % 4 else None, None if i % 6 == 0 else "t" * (i % 9)) for i in range(60)]
    rows += rows[:20] + [(2**62, "a", "only", 2**63 - 1, "x\x00é" * 50_000), (-3, "", "only two", -1, ""), (5, "", "only two", 0, None)]
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    frame = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS h", "2 AS tree", "3 AS at", "4 AS size", "5 AS block")
    got = merkle.verified(frame, span).collect()
    assert collections.Counter(map(tuple, got)) == brute_manifest(frame.collect())
    assert {r.verified for r in got} == {True, False}


def test_manifest_of_one_row(spark):
    frame = spark.createDataFrame([(7, "s", "en", 3, "abc")], "doc_id long, source string, lang string, n_chars long, text string")
    row = merkle.verified(frame).first()
    assert row.leaf == row.subroot == row.root == digest("1:7", "1:s", "2:en", "1:3", "3:abc") and row.proof_sha256 == digest("")


def test_multiproof_is_least():
    """Without any one of its coordinates a proof can't be made; with them, all can."""
    rng = random.Random(6)
    for size in range(1, 40):
        levels = tree([digest(str(i)) for i in range(size)])
        places = sorted(rng.sample(range(size), rng.randint(1, size)))
        wanted = merkle.missing(places, size)
        fetched = {(level, at): levels[level][at] for level, at in wanted}
        leaves = {i: levels[0][i] for i in places}
        made = merkle.derived(leaves, fetched, size)
        assert made[-1] == {0: levels[-1][0]}
        for i in places:
            assert merkle.fold(levels[0][i], i, size, iter(merkle.siblings(made, i))) == levels[-1][0]
        for left_out in wanted:
            assert merkle.derived(leaves, {k: h for k, h in fetched.items() if k != left_out}, size)[-1] == {}


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    out = QUERIES["op13_quality"](spark, folder).collect()
    assert len(out) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert sum(r.predicted for r in held if truth[r.doc_id]) / sum(truth[r.doc_id] for r in held) > 0.97


def test_quality_equals_plain_discriminant(spark):
    """Means, covariances and densities from all learned rows, written out; labels of held-out rows have no effect."""
    rng = random.Random(1)
    make = lambda bad: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) + (rng.choice(["###", "||"]) if bad else "") for _ in range(rng.randint(5, 90)))
    texts = [(i, make(i % 3 == 0)) for i in range(120)]
    labels = [(i, int(i % 3 != 0)) for i in range(120)] + [(4, 1), (4, 1), (7, 0), (8, None), (9, 5), (None, 0)]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    odd = [(1, texts[1][1]), (None, "no id"), (500, None), (501, ""), (502, "x" * 3_000_000), (503, " \n ")]
    docs = spark.createDataFrame([(*t, "q", 1) for t in texts + odd], "doc_id long, text string, quality string, x int")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int").withColumn("text", F.lit("t"))
    got = quality.quality(docs, frame(labels)).collect()

    made = np.array([quality.statistics(t or "") for _, t in texts + odd])
    known = {i: y for i, y in labels[:120] if not held(i) and i != 7}
    ids = [i for i, _ in texts + odd]
    learned = {y: np.array([x for i, x in zip(ids, made) if known.get(i) == y]) for y in (0, 1)}
    n = sum(map(len, learned.values()))
    within = {y: np.cov(x.T, bias=True) for y, x in learned.items()}
    pooled = sum(len(learned[y]) * within[y] for y in (0, 1)) / n
    density = {}
    for y, x in learned.items():
        c = 0.9 * within[y] + 0.1 * pooled
        c = 0.95 * c + 0.05 * np.diag(np.diag(c)) + 1e-3 * np.eye(len(c))
        away = made - x.mean(axis=0)
        density[y] = np.log(len(x) / n) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(c), away)
    expected = 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))
    order = lambda pairs: sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0, p[1]))
    for (a, score), (b, wanted) in zip(order((r.doc_id, r.score) for r in got), order(zip(ids, expected))):
        assert a == b and abs(score - wanted) < 1e-3
    other = frame([(i, 1 - y if held(i) else y) for i, y in labels[:120]] + labels[120:])
    assert sorted(quality.quality(docs, other).collect(), key=str) == sorted(got, key=str)


def test_quality_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame([(i, "t") for i in range(9)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int")
    assert {(r.score, r.predicted) for r in quality.quality(docs, labels).collect()} == {(0.5, 1)}


def test_statistics_in_slices(monkeypatch):
    text = "Some words, 12 and more.\n" * 400
    whole = quality.statistics(text)
    monkeypatch.setattr(quality, "SLICE", 1000)
    assert np.allclose(quality.statistics(text)[:12], whole[:12])
