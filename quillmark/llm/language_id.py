"""Language identification by string kernels: n-gram presence, Nyström landmarks, kernel ridge regression.

A text is the set of its runs of 1 to GRAM code points, lower-cased, with everything that isn't a letter a blank
(the blended spectrum).  The kernel of two texts is the number of runs that both have, divided by the root of
the product of their own numbers.  Runs count if some landmark has them (the VOCABULARY commonest of these).

Landmarks are LANDMARKS distinct texts, an equal number of each language, those of least hash; a landmark has at
most LANDMARK_GRAMS runs, those of least hash.  Nyström: with K the landmarks' kernel, a text's features are its
kernel with the landmarks times K to the power -1/2.  A ridge regression of these on 0 and 1 for each language
(one versus rest) is solved on TRAIN_ROWS distinct texts, again an equal number of each language.  Only these
two bounded samples, of texts that may be learned from, go into the classifier; of the second only kernel values
reach the driver.

All texts are scored whole.  As a score is linear in the kernel, landmarks and regression are multiplied once, to a
matrix of runs by languages; a block of BLOCK texts is a matrix of texts by runs, and their product the scores.
The highest wins (ties: the lesser name); `score` is it, cut to 0..1.

Null texts and texts without a letter are `und`, with score 0; so are all if nothing can be learned.  A language of
equal texts has them once.  A null id counts as held out.  Other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import textkit as tk

GRAM, LANDMARKS, LANDMARK_GRAMS, TRAIN_ROWS, VOCABULARY = 3, 256, 4096, 4096, 1 << 15
#: The weight of the regression's penalty, and the part of the largest eigenvalue below which one counts as 0.
RIDGE, LEAST_EIGENVALUE = 1e-3, 1e-6
#: One row in FOLDS is held out.
FOLDS = 5
#: Texts in a block, code points that are looked up at a time, and bits of the table of runs.
BLOCK, POINTS, SLOT_BITS = 64, 1 << 18, 20
UNKNOWN = "und"
#: Parts of a language whose least hashes are found first.
DEAL = 64

_ODD = np.uint64(0x9E3779B97F4A7C15)
_POINT_BITS = np.uint64(21)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Of each code point its lower-case form if it is a letter, else a blank."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(letters and blanks of a slice of texts, where each text begins), with a blank before and after each text."""
    decoded = letters()[np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    out = np.full(len(decoded) + 2 * (len(at) - 1), 32, np.uint32)
    out[np.arange(len(decoded)) + np.repeat(2 * np.arange(len(at) - 1) + 1, np.diff(at))] = decoded
    return out, at + 2 * np.arange(len(at))


def runs(text: np.ndarray) -> Iterator[np.ndarray]:
    """For each length the runs that begin at each place, as numbers that differ."""
    wide = text.astype(np.uint64) + np.uint64(1)
    for n in range(1, GRAM + 1):
        value = wide[: max(len(wide) - n + 1, 0)]
        for k in range(1, n):
            value = (value << _POINT_BITS) + wide[k : len(wide) - n + 1 + k]
        yield value


@dataclass(frozen=True)
class Vocabulary:
    """Runs and the table that finds them: `slot` gives the place of the one run that has this hash."""

    run: np.ndarray
    slot: np.ndarray

    @staticmethod
    def of(landmarks: list[np.ndarray]) -> Vocabulary:
        """The commonest runs of the landmarks; of those that share a slot the commonest stays."""
        run, n = np.unique(np.concatenate(landmarks), return_counts=True)
        run = run[np.lexsort((run, -n))][:VOCABULARY]
        _, first = np.unique(Vocabulary.hash(run), return_index=True)
        run = run[np.sort(first)]
        slot = np.full(1 << SLOT_BITS, len(run), np.int32)
        slot[Vocabulary.hash(run)] = np.arange(len(run))
        return Vocabulary(np.append(run, np.uint64(0)), slot)

    @staticmethod
    def hash(run: np.ndarray) -> np.ndarray:
        return ((run * _ODD) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.run) - 1

    def presence(self, text: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """[text, run]: 1 where the text has the run.  A text is taken by pieces that overlap, so it may be of any length."""
        out = np.zeros((len(begins) - 1, len(self)), np.float32)
        row = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
        for i in range(0, len(text), POINTS):
            own = row[i : i + POINTS + GRAM - 1]
            for n, value in enumerate(runs(text[i : i + POINTS + GRAM - 1])):
                value = value[:POINTS]
                at = self.slot[self.hash(value)]
                hit = np.flatnonzero((self.run[at] == value) & (own[: len(value)] == own[n : n + len(value)]))
                out[own[hit], at[hit]] = 1
        return out


def blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, letters and blanks, where texts begin) of blocks of at most BLOCK whole texts."""
    for first, data, offsets in tk.text_slices(column):
        for i in range(0, len(offsets) - 1, BLOCK):
            own = offsets[i : i + BLOCK + 1]
            yield first + i, *points(data[own[0] : own[-1]], own - own[0])


def gram_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Of each text its runs, of more than LANDMARK_GRAMS those of least hash."""
    for _, text, begins in blocks(column):
        for a, b in zip(begins[:-1], begins[1:], strict=True):
            found = np.zeros(0, np.uint64)
            for i in range(0, b - a, POINTS):
                piece = text[a + i : min(b, a + i + POINTS + GRAM - 1)]
                found = np.unique(np.concatenate([found, *(x[:POINTS] for x in runs(piece))]))
            yield found if len(found) <= LANDMARK_GRAMS else found[np.argpartition(tk.mix(found), LANDMARK_GRAMS)[:LANDMARK_GRAMS]]


def _unit(presence: np.ndarray) -> np.ndarray:
    """The rows divided by the root of their sums."""
    return presence / np.sqrt(np.maximum(presence.sum(axis=1, keepdims=True), 1))


def has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def is_held_out(id: str) -> Column:
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit(""))) % FOLDS == 0


def sample(rows: DataFrame, count: int) -> DataFrame:
    """(lang, hash) of the distinct texts of least hash: count divided by the number of languages of each, at least one."""
    distinct = rows.select("lang", "hash").distinct()
    languages = max(rows.select("lang").distinct().count(), 1)
    each = max(count // languages, 1)
    # a language is dealt over parts, so that the largest isn't one task's
    for by in (["lang", "part"], ["lang"]):
        distinct = distinct.withColumn("part", F.pmod("hash", F.lit(DEAL))).withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("hash"))).filter(F.col("_n") <= each)
    return distinct.select("lang", "hash")


@dataclass(frozen=True)
class Classifier:
    """languages; vocabulary; weights [run, language]."""

    languages: list[str]
    vocabulary: Vocabulary
    weights: np.ndarray

    def scores(self, text: np.ndarray, begins: np.ndarray) -> np.ndarray:
        return _unit(self.vocabulary.presence(text, begins)) @ self.weights


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Classifier | None:
    """A classifier from all rows given, by its two samples; None if no row has a letter and a language."""
    named = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).filter(F.col("lang").isNotNull() & has_letter("text")).withColumn("hash", F.xxhash64("text"))
    chosen = tk.written(sample(named, TRAIN_ROWS))
    if chosen.isEmpty():
        return None
    # each text once; at most TRAIN_ROWS of them, or one a language
    texts = tk.written(tk.join_few(named, chosen, ["lang", "hash"], "hash").dropDuplicates(["lang", "hash"]))
    marks = texts.join(F.broadcast(sample(chosen, LANDMARKS)), ["lang", "hash"], "left_semi").select("lang", "hash", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.view(np.int64) for x in gram_sets(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["lang", "hash", "runs"])

    table = marks.mapInArrow(sets, "lang string, hash long, runs array<long>").orderBy("lang", "hash").toArrow()
    landmarks = [np.array(x, np.int64).view(np.uint64) for x in table["runs"].to_pylist()]
    vocabulary = Vocabulary.of(landmarks)
    presence = np.zeros((len(landmarks), len(vocabulary)), np.float32)
    order = np.argsort(vocabulary.run[:-1])
    for i, own in enumerate(landmarks):
        at = np.minimum(np.searchsorted(vocabulary.run[:-1], own, sorter=order), len(vocabulary) - 1)
        hit = order[at][vocabulary.run[order[at]] == own]
        presence[i, hit] = 1
    unit = _unit(presence)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, unit.T.copy()))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, unit = shared.value
        for batch in batches:
            for first, text, begins in blocks(batch.column(2)):
                values = _unit(vocabulary.presence(text, begins)) @ unit
                rows = batch.slice(first, len(values))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(list(values), pa.list_(pa.float32()))], names=["lang", "hash", "kernel"])

    rows = texts.select("lang", "hash", "text").mapInArrow(kernel, "lang string, hash long, kernel array<float>").orderBy("lang", "hash").toArrow()
    names = rows["lang"].to_pylist()
    languages = sorted(set(names))
    values, power = np.array(rows["kernel"].to_pylist(), np.float64), np.linalg.eigh((unit @ unit.T).astype(np.float64))
    some = power[0] > LEAST_EIGENVALUE * power[0][-1]
    features = power[1][:, some] / np.sqrt(power[0][some])
    own = values @ features
    wanted = np.array([[x == y for y in languages] for x in names], np.float64)
    ridge = own.T @ own + RIDGE * len(own) * np.eye(own.shape[1])
    dual = features @ np.linalg.solve(ridge, own.T @ wanted)
    return Classifier(languages, vocabulary, (unit.T @ dual).astype(np.float32))


def identify(docs: DataFrame, classifier: Classifier | None, text: str = "text") -> DataFrame:
    """docs with `lang_pred` and `score`."""
    predicted, score = tk.fresh(docs, "lang_pred", "score")
    if classifier is None:
        return docs.withColumns({predicted: F.lit(UNKNOWN), score: F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(column: pa.Array, known: pa.Array) -> pa.Array:
        own = shared.value
        best, value = np.full(len(column), UNKNOWN, object), np.zeros(len(column))
        for first, text, begins in blocks(column):
            scores = own.scores(text, begins).astype(np.float64).round(6)
            top = scores.argmax(axis=1)
            rows = slice(first, first + len(scores))
            best[rows] = np.array(own.languages, object)[top]
            value[rows] = np.clip(scores[np.arange(len(scores)), top], 0, 1)
        none = ~known.to_numpy(zero_copy_only=False)
        best[none], value[none] = UNKNOWN, 0
        return pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(value)], ["lang_pred", "score"])

    (both,) = tk.fresh(docs, "_predicted")
    rows = docs.withColumn(both, predict.asNondeterministic()(F.col(text).cast("string"), has_letter(text)))
    return rows.withColumns({predicted: F.col(f"{both}.lang_pred"), score: F.col(f"{both}.score")}).drop(both)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    tk.small_batches(spark)
    docs = tk.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = docs.filter(~is_held_out("doc_id"))
    found = identify(docs.select("doc_id", "text"), train(learned))
    return found.select("doc_id", is_held_out("doc_id").alias("held_out"), "lang_pred", "score")
