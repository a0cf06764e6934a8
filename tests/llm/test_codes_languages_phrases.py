"""Vector codes, language identification and collocations against brute force and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmark.llm import collocations, language_id, textkit, vector_codes

# vector codes

VECTORS = "vec_id long, embedding array<float>, label int, code int, error string, _ints int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "e", 2) for i, v, label in rows], VECTORS)


def brute_codes(rows):
    """The contract by plain loops over whole numbers."""
    kept = [(i, [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1])
    ends = [p * width // 16 for p in range(17)]
    part = lambda v, p: v[ends[p] : ends[p + 1]]
    books = [[part(v, p) for _, v, _ in kept[:64]] for p in range(16)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(2):
        for p in range(16):
            members = {}
            for _, v, _ in kept:
                members.setdefault(near(part(v, p), books[p])[1], []).append(part(v, p))
            for e, found in members.items():
                books[p][e] = [sum(c) // len(found) for c in zip(*found, strict=True)]
    out = []
    for i, v, label in kept:
        found = [near(part(v, p), books[p]) for p in range(16)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    total = Counter()
    for *_, error, label in out:
        total[label] += error
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted(((i, code, error, total[label]) for i, code, error, label in out), key=repr), digest


def coded(df):
    rows, books = vector_codes.compress(df)
    code, error = (c for c in rows.columns if c.rstrip("_") in ("code", "error") and c not in ("code", "error"))
    rows = vector_codes.with_label_error(rows, error=error)
    return sorted(((r["vec_id"], r[code], r[error], r["label_error"]) for r in rows.collect()), key=repr), books, rows.columns


@pytest.mark.parametrize(("seed", "n", "width"), [(1, 200, 32), (2, 90, 16), (3, 70, 21), (4, 10, 48)])
def test_codes_against_brute_force(spark, seed, n, width):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, width).astype(np.float32)], [None, 0, 1][i % 3]) for i in range(n)]
    rows += [(1000, None, 1), (1001, [float("nan")] * width, 1), (1002, [float("inf")] * width, 0), (1003, [None] * width, 0), (5, rows[5][1], 1), (None, rows[6][1], None), (2000, rows[7][1], 0)]
    got, books, columns = coded(vectors(spark, rows).repartition(3))
    want, digest = brute_codes(rows)
    assert got == want and books.sha256() == digest
    assert {"code", "error", "_ints", "label"} <= set(columns) and "embedding" not in columns


def test_codes_of_odd_rows(spark):
    same = [(i, [0.5] * 16, None) for i in range(5)]
    got, books, _ = coded(vectors(spark, same))
    assert got == [(i, "00" * 16, 0, 0) for i in range(5)] and all(x.shape == (5, 1) for x in books.entries)
    got, _, _ = coded(vectors(spark, [*same, (9, [0.5] * 8, 3), (10, [], 3)]))
    assert {(9, None, None, None), (10, None, None, None)} <= set(got) and len(got) == 7
    for nothing in (vectors(spark, same).limit(0), vectors(spark, [(1, None, 1), (2, [None], 1)])):
        rows, books = vector_codes.compress(nothing)
        assert rows.count() == 0 and books is None and [c for c in rows.columns if c != "embedding"] == rows.columns
    huge = [(i, [3e38 if i % 2 else -3e38] * 16, None) for i in range(4)]
    assert [r[2] for r in coded(vectors(spark, huge))[0]] == [0] * 4


def test_pivots_prune_and_change_nothing():
    rng = np.random.default_rng(8)
    values = vector_codes.integers(rng.normal(0, 0.2, (3000, 64)))
    ends = vector_codes.edges(64)
    entries = [values[:64, lo:hi].astype(np.int64) for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
    books = vector_codes.Codebooks(ends, entries, [vector_codes.far_apart(x) for x in entries])
    index, squared, tried = vector_codes.assign(values, vector_codes.pivot_distances(values, books), books)
    for p, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        every = ((values[:, None, lo:hi].astype(np.int64) - entries[p][None]) ** 2).sum(axis=2)
        assert (index[:, p] == every.argmin(axis=1)).all() and (squared[:, p] == every.min(axis=1)).all()
    assert tried < 0.25 * len(values) * 16 * 64


# languages


def sentences(seed, words, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) for _ in range(n))


ENGLISH = "the of and with house water thing other people which there would about these could their".split()
GERMAN = "der die und mit haus wasser ding andere menschen welche dort würde über diese könnte ihre".split()
GREEK = "και το της με σπίτι νερό πράγμα άλλο άνθρωποι οποία εκεί θα για αυτά μπορεί τους".split()


def test_languages_are_told_apart(spark):
    rows = [(i, sentences(i, words), lang, "n") for k, (lang, words) in enumerate((("en", ENGLISH), ("de", GERMAN), ("el", GREEK))) for i in range(100 * k, 100 * k + 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3)
    classifier = language_id.train(docs.filter(~language_id.is_held_out("doc_id")))
    assert classifier.languages == ["de", "el", "en"]
    odd = [(1000, None, "en", ""), (1001, "", None, ""), (1002, "12 + 3 = 15 !!", "de", ""), (1003, "ΚΑΙ ΤΟ ΣΠΊΤΙ", None, ""), (None, "the water of the house", "xx", ""), (1004, sentences(7, GERMAN, 60_000), "en", "")]
    both = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    found = language_id.identify(both, classifier)
    assert found.columns == [*docs.columns, "lang_pred", "score_"]
    got = {r["doc_id"]: (r["lang_pred"], r["score_"]) for r in found.collect()}
    assert all(got[i][0] == lang for i, _, lang, _ in rows)
    assert got[1000] == got[1001] == got[1002] == ("und", 0.0)
    assert got[1003][0] == "el" and got[None][0] == "en" and got[1004][0] == "de"
    assert all(0 <= s <= 1 for _, s in got.values())


def test_scores_against_a_kernel_by_sets(spark):
    """The same classifier from Python sets of runs and a dense solution."""
    rows = [(i, sentences(i, words, 12), lang) for k, (lang, words) in enumerate((("en", ENGLISH), ("de", GERMAN))) for i in range(100 * k, 100 * k + 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def runs(t):
        t = "".join(c.lower() if c.isalpha() else " " for c in f" {t} ")
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    classifier = language_id.train(docs)
    hashed = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    langs = {t: lang for _, t, lang in rows}
    order = sorted(langs, key=lambda t: (langs[t], hashed[t]))  # all are landmarks and all are learned from
    number = lambda r: sum((ord(c) + 1) << (21 * (len(r) - 1 - i)) for i, c in enumerate(r))
    all_ = set().union(*map(runs, order))
    vocabulary = {r for r in all_ if number(r) in set(classifier.vocabulary.run.tolist())}
    assert 0.99 * len(all_) <= len(vocabulary) == len(classifier.vocabulary)
    kernel = lambda a, b: len(a & b & vocabulary) / max(np.sqrt(len(a & vocabulary) * len(b & vocabulary)), 1)
    own = [runs(t) for t in order]
    k = np.array([[kernel(a, b) for b in own] for a in own])
    value, vector = np.linalg.eigh(k)
    some = value > language_id.LEAST_EIGENVALUE * value[-1]
    features = k @ (vector[:, some] / np.sqrt(value[some]))
    wanted = np.array([[langs[t] == x for x in ("de", "en")] for t in order], float)
    ridge = np.linalg.solve(features.T @ features + language_id.RIDGE * len(own) * np.eye(some.sum()), features.T @ wanted)
    new = ["the haus of wasser", "zzz", "which people würde", "a"]
    known = np.array([[kernel(runs(t), b) for b in own] for t in new]) @ (vector[:, some] / np.sqrt(value[some])) @ ridge
    (_, text, begins), = language_id.blocks(pa.array(new))
    assert np.abs(classifier.scores(text, begins) - known).max() < 1e-3


def test_long_texts_are_read_whole(monkeypatch):
    text = sentences(3, [*ENGLISH, *GREEK], 400)
    (whole,) = language_id.gram_sets(pa.array([text]))
    (_, points, begins), = language_id.blocks(pa.array([text, "ab", ""]))
    vocabulary = language_id.Vocabulary.of([whole])
    before = vocabulary.presence(points, begins)
    monkeypatch.setattr(language_id, "POINTS", 17)
    (again,) = language_id.gram_sets(pa.array([text]))
    assert (again == whole).all() and (vocabulary.presence(points, begins) == before).all()
    assert before[0].sum() == len(vocabulary) and before[2].sum() == 1  # the empty text has a blank


def test_languages_of_nothing(spark):
    docs = spark.createDataFrame([(1, "words", None), (2, None, "en"), (3, "12", "de")], "doc_id long, text string, lang string")
    assert language_id.train(docs) is None and language_id.train(docs.limit(0)) is None
    assert [(r["lang_pred"], r["score"]) for r in language_id.identify(docs, None).collect()] == [("und", 0.0)] * 3
    one = language_id.train(spark.createDataFrame([(1, "words", "en"), (2, "words", "en")], docs.schema))
    assert one.languages == ["en"]
    assert [(r["lang_pred"]) for r in language_id.identify(docs, one).orderBy("doc_id").collect()] == ["en", "und", "und"]
    assert [r["h"] for r in docs.select(language_id.is_held_out("doc_id").alias("h")).collect()] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in (1, 2, 3)]


# phrases


def brute_phrases(rows, support, top, max_words=3):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, max_words + 1):
                for i in range(len(words) - size + 1):
                    key = lang, tuple(words[i : i + size])
                    f[key] = f.get(key, 0) + 1
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or a < support:
            continue
        covered = any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and b >= support and 100 * b >= 50 * a for (other, q), b in f.items() if other == lang)
        if not covered:
            score, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -score) for lang, found in out.items() for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1))


def phrase_rows(df, **more):
    return sorted(tuple(r) for r in collocations.collocations(df, **more).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["The", "the", "of", "é", "ab c", "x" * 300, "你好", "#", "a", "b"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\r\n", "! "]
    rows = [("".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 120))), rng.choice(["en", "en", "de", None, "und"])) for _ in range(60)]
    rows += [(None, "en"), ("", "fr"), (" . ", None), ("solo", "it")] + [("New York is new york", "en")] * 12
    docs = spark.createDataFrame([(t, lang, 1) for t, lang in rows], "text string, lang string, n int").repartition(5)
    assert phrase_rows(docs) == brute_phrases(rows, 10, 2000)
    assert phrase_rows(docs, support=3, top=7) == brute_phrases(rows, 3, 7)


def test_phrases_of_small_slices_and_counts(spark, monkeypatch):
    rows = [(sentences(i, ENGLISH[:6], 80), "en") for i in range(20)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    want = brute_phrases(rows, 10, 2000)
    monkeypatch.setattr(collocations, "HELD", 5)
    monkeypatch.setattr(collocations, "PIECE_BYTES", 100)
    assert phrase_rows(docs) == want


def test_shards_lose_nothing(spark):
    """A phrase that meets the support in all is frequent in a shard, however it is spread."""
    docs = spark.createDataFrame([(f"alpha beta gamma {i}", "en") for i in range(10)] + [(f"rare pair {i}", "en") for i in range(9)], "text string, lang string")
    texts = collocations._texts(docs, "text", "lang")
    first = collocations.locally_frequent(texts, 1, [])
    assert {r["phrase"] for r in collocations.frequent_phrases(docs).collect()} == {"", "alpha", "beta", "gamma", "alpha beta", "beta gamma", "alpha beta gamma"}
    bitmap = collocations.bitmap_of(first).value
    keys = np.array([r["key"] for r in first.collect()], np.int64).view(np.uint64)
    assert collocations._has(bitmap, keys).all() and len(bitmap) * 8 == collocations.LEAST_BITS
    other = textkit.mix(np.arange(1, 1001, dtype=np.uint64))
    assert collocations._has(bitmap, other).mean() < 0.05


def test_phrases_of_nothing(spark):
    docs = spark.createDataFrame([(None, None), ("one two", "en")], "text string, lang string")
    assert phrase_rows(docs) == [] and phrase_rows(docs.limit(0)) == []


def test_scores_pass_64_bits(spark):
    frequent = spark.createDataFrame([("en", 1, "a", 6 * 10**9), ("en", 1, "b", 5 * 10**9), ("en", 2, "a b", 4 * 10**9)], "lang string, size int, phrase string, n long")
    (row,) = collocations.scored(frequent).collect()
    assert row["score"] == 10**6 * (4 * 10**9) ** 2 // (6 * 10**9 * 5 * 10**9)
