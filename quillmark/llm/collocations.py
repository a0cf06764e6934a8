"""Phrase collocation mining by SON partitioning: mine shards completely, unite, count all candidates exactly.

A text, in lower case A-Z, is cut into pieces at `.,;:!?` and line ends, and pieces into words at blanks and tabs.
A phrase is a run of up to MAX_WORDS words of a piece.  Everything is by language.

Texts are dealt to SHARDS shards by a hash.  A phrase that SUPPORT occurrences have in all has at least its
proportional part, SUPPORT / SHARDS, in one shard, so mining each shard completely at that lowered support finds
all of them.  A shard is mined level by level (words, pairs, triples): a phrase is counted only if its two
phrases one word shorter are frequent somewhere.  What is frequent is kept as a bitmap of hashes, of 16 bits a
phrase and at most MAX_BITS: it lets some phrases through that aren't frequent, and never drops one that is.
Shards are counted together, by their number in the key; a shard is many tasks' work.

A phrase that can't reach SUPPORT with the counts of the shards where it is frequent, and the most that the others may
hide, is no candidate.  The candidates of all shards are then counted in all texts exactly, as strings, and those below SUPPORT dropped.

Null texts are empty, a null language is `und`.  Ties are broken by the phrase.  Copies count as often as they occur.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import textkit as tk

MAX_WORDS, SUPPORT, TOP = 3, 10, 2000
#: Shards, a power of 2: the local support is SUPPORT / SHARDS, rounded up, so the fewer shards, the fewer candidates.
SHARDS = 2
#: A candidate goes if a longer one that holds it has this percentage of its occurrences.
COVERED = 50
SCALE = 1_000_000
#: Bits of a bitmap: 16 for each phrase, and at most 32 MB.
BITS_A_PHRASE, LEAST_BITS, MAX_BITS = 16, 1 << 16, 1 << 28
#: Different phrases that a task holds while it counts; beyond that it sends on what it has.
HELD = 600_000
#: Bytes of texts that are cut into words at a time.
PIECE_BYTES = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_STOP[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_GAP = _BLANK | _STOP
_VALUE = tk.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_VALUE[_GAP] = 0
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _language(lang: str) -> Column:
    return F.coalesce(F.col(lang).cast("string"), F.lit("und"))


class Words:
    """The words of a slice of lower-case texts: start, end, hash, and the piece of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        gap = _GAP[data]
        first = np.ones(len(data), bool)
        first[1:] = gap[:-1]
        first[offsets[:-1][offsets[:-1] < len(data)]] = True
        self.start = np.flatnonzero(first & ~gap)
        last = np.ones(len(data), bool)
        last[:-1] = gap[1:]
        inner = offsets[1:-1]
        last[inner[inner > 0] - 1] = True
        self.end = np.flatnonzero(last & ~gap) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        stops = np.concatenate([[0], np.cumsum(_STOP[data])])[self.start] if len(data) else np.zeros(0, np.int64)
        self.piece = stops + self.row  # both only rise, so it differs between pieces
        if len(self.start):
            power, inverse = tk.powers(len(data))
            self.hash = tk.mix(np.add.reduceat(_VALUE[data] * power[: len(data)], self.start) * inverse[self.start])
        else:
            self.hash = np.zeros(0, np.uint64)

    def phrases(self, size: int, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash with the row's seed, first word) of each run of `size` words in a piece."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.piece[:n] == self.piece[size - 1 :])
        value = self.hash[at] + seed[self.row[at]]
        for k in range(1, size):
            value = tk.mix(value) * _ODD + self.hash[at + k]
        return tk.mix(value), at


def cut_texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, Words]]:
    """(first row, lower-case bytes, words) of slices of whole texts."""
    for first, data, offsets in tk.text_slices(column, PIECE_BYTES):
        data, offsets = _single_blanks(_LOWER[data], offsets)
        yield first, data, Words(data, offsets)


def _seeds(langs: list[str]) -> np.ndarray:
    """A value of each row's language."""
    of = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(langs)}
    return np.array([of[x] for x in langs], np.uint64)


Bitmap = np.ndarray


def _has(bitmap: Bitmap, value: np.ndarray) -> np.ndarray:
    place = value >> np.uint64(64 - int(len(bitmap) * 8).bit_length() + 1)
    return (bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def bitmap_of(keys: DataFrame) -> Broadcast:
    """The bitmap of the column `key`, made by Spark in words of 32 bits, of which at most MAX_BITS / 32 come to the driver."""
    bits = LEAST_BITS
    while bits < min(BITS_A_PHRASE * keys.count(), MAX_BITS):
        bits *= 2
    place = F.shiftrightunsigned("key", 64 - (bits.bit_length() - 1))
    words = keys.select(place.alias("place")).selectExpr("place >> 5 AS word", "shiftleft(1L, int(place & 31)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 32, np.uint32)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return keys.sparkSession.sparkContext.broadcast(out.view(np.uint8))


def _kept(words: Words, size: int, seed: np.ndarray, bitmaps: list[Bitmap]) -> tuple[np.ndarray, np.ndarray]:
    """The phrases of `size` words whose phrases one word shorter are in the bitmap of their size."""
    value, at = words.phrases(size, seed)
    if size == 1 or not len(at):
        return value, at
    shorter, where = words.phrases(size - 1, seed)
    known = np.zeros(len(words.hash) + 1, bool)
    known[where[_has(bitmaps[size - 2], shorter)]] = True
    good = known[at] & known[at + 1]
    return value[good], at[good]


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.col(text).cast("string").alias("text"), _language(lang).alias("lang"))


def local_counts(texts: DataFrame, size: int, bitmaps: list[Broadcast]) -> DataFrame:
    """(key, n): occurrences of phrases in each shard, the shard being the key's last bits."""
    shared = list(bitmaps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size_held = [], 0
        for batch in batches:
            langs, shards = batch.column(1).to_pylist(), batch.column(2).to_numpy()
            seeds = _seeds(langs)
            for first, _, words in cut_texts(batch.column(0)):
                rows = slice(first, first + int(words.row[-1]) + 1 if len(words.row) else first)
                value, at = _kept(words, size, seeds[rows], [b.value for b in shared])
                key = (value & ~np.uint64(SHARDS - 1)) | shards[rows].astype(np.uint64)[words.row[at]]
                held.append(np.unique(key, return_counts=True))
                size_held += len(held[-1][0])
                if size_held > HELD:
                    held = [_summed(held)]
                    size_held = len(held[0][0])
                    if size_held > HELD // 2:
                        yield from _out(held[0])
                        held, size_held = [], 0
        if held:
            yield from _out(_summed(held))

    dealt = texts.select("text", "lang", F.pmod(F.xxhash64("text"), F.lit(SHARDS)).cast("int").alias("shard"))
    return dealt.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(key) else n


def _out(counts: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(counts[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(counts[0][i : i + 100_000].view(np.int64)), pa.array(counts[1][i : i + 100_000].astype(np.int64))], names=["key", "n"])


def locally_frequent(texts: DataFrame, size: int, bitmaps: list[Broadcast], support: int = SUPPORT) -> DataFrame:
    """(key): hashes of the phrases that are frequent in some shard, at the support lowered in proportion.

    In a shard where a phrase isn't frequent it has fewer occurrences than the lowered support; a phrase that can't
    reach the support even so is left out."""
    local = -(-support // SHARDS)
    found = local_counts(texts, size, bitmaps).filter(F.col("n") >= local)
    united = found.groupBy(F.col("key").bitwiseAND(~(SHARDS - 1)).alias("key")).agg(F.sum("n").alias("n"), F.count("*").alias("shards"))
    return tk.written(united.filter(F.col("n") + (SHARDS - F.col("shards")) * (local - 1) >= support).select("key"))


def _single_blanks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A slice with one space in place of each run of blanks, so that a phrase is a run of bytes."""
    blank = _BLANK[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    return np.where(blank, np.uint8(0x20), data)[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes from each start to its end as strings."""
    sizes = end - start
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], sizes)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[place]))


def exact_counts(texts: DataFrame, bitmaps: list[Broadcast]) -> DataFrame:
    """(lang, size, phrase, n): occurrences in all texts of phrases in the bitmaps; size 0 has all words of a language."""
    shared = list(bitmaps)

    def summed(held: list[pa.Table]) -> pa.Table:
        found = pa.concat_tables(held).group_by(["lang", "size", "phrase"]).aggregate([("n", "sum")])
        return found.rename_columns({"n_sum": "n"}).select(["lang", "size", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, int] = {}  # of the task's languages

        def rows(lang: np.ndarray, size: int, phrases: pa.Array, n: np.ndarray) -> pa.Table:
            return pa.table({"lang": pa.array(lang.astype(np.int32)), "size": pa.array(np.full(len(n), size, np.int32)), "phrase": phrases, "n": pa.array(n.astype(np.int64))})

        def out(found: pa.Table) -> Iterator[pa.RecordBatch]:
            names = pa.array(list(numbers), pa.string())
            for part in found.to_batches(100_000):
                yield pa.RecordBatch.from_arrays([names.take(part.column(0)), *part.columns[1:]], names=part.schema.names)

        # words and longer phrases are held apart: words are few, and soon all known
        held: list[list[pa.Table]] = [[] for _ in shared]
        rows_held = [0 for _ in shared]
        for batch in batches:
            langs = batch.column(1).to_pylist()
            seeds = _seeds(langs)
            number = np.array([numbers.setdefault(x, len(numbers)) for x in langs])
            for first, data, words in cut_texts(batch.column(0)):
                if not len(words.row):
                    continue
                own = slice(first, first + int(words.row[-1]) + 1)
                row, n = np.unique(words.row, return_counts=True)
                held[0].append(rows(number[own][row], 0, pa.array([""] * len(row)), n))
                for i, bitmap in enumerate(shared):
                    value, at = _kept(words, i + 1, seeds[own], [b.value for b in shared])
                    at = at[_has(bitmap.value, value)]
                    held[i].append(summed([rows(number[own][words.row[at]], i + 1, _strings(data, words.start[at], words.end[at + i]), np.ones(len(at)))]))
                    rows_held[i] += len(held[i][-1])
                    if rows_held[i] > HELD // 2:
                        held[i] = [summed(held[i])]
                        rows_held[i] = len(held[i][0])
                        if rows_held[i] > HELD // 4:
                            yield from out(held[i][0])
                            held[i], rows_held[i] = [], 0
        for some in held:
            if some:
                yield from out(summed(some))

    return texts.mapInArrow(run, "lang string, size int, phrase string, n long").groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", support: int = SUPPORT, max_words: int = MAX_WORDS) -> DataFrame:
    """(lang, size, phrase, n) of all phrases that occur at least `support` times, exactly, and of all words of a language under size 0."""
    texts = _texts(docs, text, lang)
    bitmaps: list[Broadcast] = []
    for size in range(1, max_words + 1):
        bitmaps.append(bitmap_of(locally_frequent(texts, size, bitmaps, support)))
    return exact_counts(texts, bitmaps).filter((F.col("size") == 0) | (F.col("n") >= support))


def _cut(phrase: str, k: int, size: int) -> tuple[Column, Column]:
    return F.substring_index(phrase, " ", k), F.substring_index(phrase, " ", k - size)


def scored(frequent: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """(lang, size, phrase, a, l, r, score): candidates of two words or more by their lowest-scoring cut.

    Each cut is a row; a word that is part of very many phrases makes a large key, which Spark's skew join splits.
    """
    phrases = frequent.filter("size >= 2").select("lang", "size", "phrase", F.col("n").alias("a"))
    known = tk.written(frequent.filter(f"size between 1 and {max_words - 1}").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")))
    cuts = F.array(*[F.struct(F.lit(size).alias("of"), F.lit(k).alias("k"), left.alias("left"), right.alias("right")) for size in range(2, max_words + 1) for k in range(1, size) for left, right in [_cut("phrase", k, size)]])
    rows = phrases.select("*", F.explode(F.filter(cuts, lambda c: c["of"] == F.col("size"))).alias("cut")).select("lang", "size", "phrase", "a", "cut.k", "cut.left", "cut.right")
    for name, side in (("l", "left"), ("r", "right")):
        rows = rows.withColumnRenamed(side, "part").join(known, ["lang", "part"]).withColumnRenamed("f", name).drop("part")
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    rows = rows.withColumn("above", wide("a") * wide("a") * F.lit(SCALE).cast("decimal(7,0)")).withColumn("below", wide("l") * wide("r"))
    rows = rows.withColumn("score", F.expr("above div below"))
    return rows.groupBy("lang", "size", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("best")).select("lang", "size", "phrase", "best.a", "best.l", "best.r", "best.score")


def uncovered(candidates: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """The candidates without those of which a longer one that holds their words has COVERED percent of the occurrences."""
    inside = F.array(*[F.struct(F.lit(size).alias("of"), F.substring_index(F.substring_index("phrase", " ", at + n), " ", -n).alias("phrase")) for size in range(3, max_words + 1) for n in range(2, size) for at in range(size - n + 1)])
    parts = candidates.filter("size > 2").select("lang", F.col("size").alias("_size"), F.col("a").alias("_a"), F.explode(F.filter(inside, lambda c: c["of"] == F.col("size"))).alias("part"))
    longest = parts.groupBy("lang", F.col("part.phrase").alias("phrase")).agg(F.max("_a").alias("_most"))
    return candidates.join(longest, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("_most") < COVERED * F.col("a"), F.lit(True))).drop("_most")


def top_phrases(candidates: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` of each language with their `rank`: first of each part of a language, then of these."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = candidates.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top).drop("_part")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", support: int = SUPPORT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases."""
    frequent = tk.written(frequent_phrases(docs, text, lang, support))
    words = frequent.filter("size = 0").select("lang", "n")
    best = top_phrases(uncovered(tk.written(scored(frequent))), top)
    return tk.join_few(best, words, ["lang"], "phrase").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    tk.small_batches(spark)
    return collocations(tk.table(spark, sf_dir, "documents").select("text", "lang"))


def op13_sql() -> str:
    """The same for DuckDB, counting all phrases."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, {lower} AS t FROM documents),
  pieces AS (SELECT d, lang, unnest(s) AS piece, generate_subscripts(s, 1) AS p FROM (SELECT d, lang, regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]') AS s FROM docs)),
  words AS (SELECT d, lang, p, unnest(s) AS w, generate_subscripts(s, 1) AS i FROM (SELECT d, lang, p, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS s FROM pieces)),
  runs AS (SELECT lang, w, lead(w) OVER s AS w2, lead(w, 2) OVER s AS w3 FROM words WINDOW s AS (PARTITION BY d, p ORDER BY i)),
  f1 AS (SELECT lang, w AS phrase, count(*) AS f FROM runs GROUP BY ALL),
  f2 AS (SELECT lang, w, w2, w || ' ' || w2 AS phrase, count(*) AS f FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING f >= {SUPPORT}),
  f3 AS (SELECT lang, w, w2, w3, w || ' ' || w2 || ' ' || w3 AS phrase, count(*) AS f FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING f >= {SUPPORT}),
  totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
  cuts AS (SELECT lang, phrase, f AS a, 1 AS k, w AS lp, w2 AS rp FROM f2
    UNION ALL SELECT lang, phrase, f, 1, w, w2 || ' ' || w3 FROM f3 UNION ALL SELECT lang, phrase, f, 2, w || ' ' || w2, w3 FROM f3),
  known AS (SELECT lang, phrase, f FROM f1 UNION ALL SELECT lang, phrase, f FROM f2),
  rated AS (SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, ({SCALE}::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score FROM cuts c JOIN known x ON x.lang = c.lang AND x.phrase = lp JOIN known y ON y.lang = c.lang AND y.phrase = rp),
  best AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
  longer AS (SELECT lang, phrase, max(f) AS most FROM (SELECT lang, w || ' ' || w2 AS phrase, f FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, f FROM f3) GROUP BY ALL),
  left_ AS (SELECT b.* FROM best b LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most < {COVERED} * a),
  ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score::BIGINT AS score FROM left_)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}"""
