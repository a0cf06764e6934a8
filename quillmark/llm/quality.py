"""Quality rules: repetition and length rules, then n-gram perplexity inside a band for each language.

The language model is an interpolated modified Kneser-Ney model of ORDER symbols for each value of `lang`.
A code point below ESCAPE is one symbol, any other is two (its upper and its lower bits), so nothing is
folded but kinds of white space, an n-gram is a whole number of 60 bits, and the model grows with the corpus.
Spark counts in how many distinct texts each n-gram stands (the counts of a task summed before the shuffle),
counts continuations of shorter ones from it, and makes discounts, back-off weights and probabilities by
grouping and joining; no table of n-grams goes through the driver.  The discount of a count of 1 is 1, so
what only one text has lends it no weight: a text isn't judged by itself.

The model holds all orders: of each n-gram its log probability and its back-off weight as a context, by a key that has
a 1 bit before the n-gram's symbols.  A text that the model wasn't made from takes at each symbol the longest n-gram
that is known and the weights of the contexts above it; an unknown symbol takes a share of what all symbols leave.  A
text that it was made from finds all of its longest n-grams, so `apply_rules` and the query use these alone.

A model of at most SHARED_GRAMS n-grams is sent to all tasks as sorted arrays and looked up by binary search.
A larger one stays a table: texts are packed into slices of one language and about SLICE_SYMBOLS symbols,
each slice's distinct n-grams are joined to the model, and what is found comes back to the slice as such
arrays.  Both ways give the same numbers.

The model is of each language's distinct texts that pass the base rules; copies count once.  Texts that fail
have no perplexity.

A text's log perplexity is judged against its language's band: the shortest interval that holds half of
these texts (so that junk of up to half can't set it), widened by FENCE times its length, and more for
texts shorter than FULL_LENGTH, whose means vary more.  A source larger than its language's mean source
counts as one of that size.  A language of fewer than LEAST_TEXTS distinct texts has no band.  All of it
follows from integer counts, so reruns agree.

Null text counts as empty, null lang as the language with the empty name, null source as a source.  Texts
without words fail the base rules.  Other columns are kept by `apply_rules`.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import textkit as tk

if TYPE_CHECKING:  # workers that don't need it don't load it
    import pandas as pd

ORDER, BITS = 5, 12
#: Code points from here on are two symbols.
ESCAPE = 0xE00
MIN_WORDS, WINDOW, MAX_REPEAT = 20, 8, 30
#: N-grams of a model that is sent to all tasks (12 bytes each), and symbols in a slice for a larger one.
SHARED_GRAMS, SLICE_SYMBOLS = 4_000_000, 1 << 23
#: N-grams that a task holds while it counts; beyond that it sends on what it has.
HELD_GRAMS = 1_000_000
#: Lengths of the shortest half that the band reaches beyond it, and the least such length.
FENCE, LEAST_SPREAD = 3.0, 0.02
#: Steps of log perplexity that are counted, and the distinct texts from which a language has a band.
STEP, LEAST_TEXTS = 0.002, 10
#: The parts of a text that a capped source's counts are rounded to.
PARTS = 1000
#: Word characters from which a text's band is no wider than others'.
FULL_LENGTH = 1000

_WHITE = [9, 10, 11, 12, 13, 32]


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, row) of a slice of texts."""
    point = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(starts))[: len(point)]
    point[np.isin(point, _WHITE)] = 32
    wide = point >= ESCAPE
    if not wide.any():
        return point, row
    at = np.arange(len(point)) + np.concatenate([[0], np.cumsum(wide)[:-1]])
    out = np.zeros(len(point) + int(wide.sum()), np.int64)
    out[at] = np.where(wide, ESCAPE + (point >> BITS), point)
    out[at[wide] + 1] = point[wide] & ((1 << BITS) - 1)
    return out, np.repeat(row, 1 + wide)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram that ends at the symbol, row) for every symbol; a text follows white space."""
    symbol, row = symbols(data, offsets)
    pad, rows = ORDER - 1, len(offsets) - 1
    padded = np.full(len(symbol) + pad * rows, 32, np.int64)
    at = np.arange(len(symbol)) + pad * (row + 1)
    padded[at] = symbol
    out = np.zeros(max(len(padded) - pad, 0), np.int64)
    for k in range(ORDER):
        out = (out << BITS) | padded[k : k + len(out)]
    return out[at - pad], row


def _summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    return key[first], np.add.reduceat(count, first) if len(key) else count


def _texts_of(gram: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, in how many rows), of n-grams by row."""
    order = np.argsort(gram, kind="stable")
    gram, row = gram[order], row[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
    gram = gram[new]
    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, int)
    return gram[first], np.diff(np.append(first, len(gram)))


def _language(lang: str) -> Column:
    return F.coalesce(F.col(lang).cast("string"), F.lit(""))


def distinct_texts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, text), each once: only texts that have copies are shuffled, as long as hashes of these are few."""
    rows = docs.select(_language(lang).alias("lang"), F.col(text).alias("text")).withColumn("hash", F.xxhash64("lang", "text"))
    again = tk.cut(rows.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1"))
    if again.count() > tk.BROADCAST_ROWS:
        return rows.select("lang", "text").distinct()
    copied = rows.join(F.broadcast(again), "hash", "left_semi").select("lang", "text").distinct()
    return rows.join(F.broadcast(again), "hash", "left_anti").select("lang", "text").unionByName(copied)


def count_ngrams(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n): the distinct texts of a language, of those that pass the base rules, that have the n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for at, data, offsets in tk.text_slices(batch.column(1)):
                rows = len(offsets) - 1
                w = tk.words(data, offsets)
                good = ~((w.counts < MIN_WORDS) | (100 * _repeated(w, tk.word_hashes(w), rows) > MAX_REPEAT * w.counts))
                gram, row = grams(data, offsets)
                names = np.array(langs[at : at + rows], object)
                for name in dict.fromkeys(names.tolist()):
                    some = (good & (names == name))[row]
                    if some.any():
                        found = _texts_of(gram[some], row[some])
                        held.setdefault(name, []).append(found)
                        size += len(found[0])
            if size > HELD_GRAMS:
                held = {k: [_summed(*map(np.concatenate, zip(*v, strict=True)))] for k, v in held.items()}
                size = sum(len(v[0][0]) for v in held.values())
                if size > HELD_GRAMS:  # what one task may hold
                    yield from out(held)
                    held, size = {}, 0
        yield from out(held)

    def out(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for name, parts in held.items():
            gram, n = _summed(*map(np.concatenate, zip(*parts, strict=True)))
            for i in range(0, len(gram), 100_000):
                part = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram[part]), pa.string()), pa.array(gram[part]), pa.array(n[part].astype(np.int64))], names=["lang", "gram", "n"])

    counted = distinct_texts(docs, text, lang).mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def discounts(level: DataFrame) -> DataFrame:
    """(lang, d2, d3, size): discounts of counts 2, and 3 or more; that of 1 is 1."""
    n1, n2, n3, n4 = (F.count_if(F.col("n") == k) for k in (1, 2, 3, 4))
    few = (n1 == 0) | (n2 == 0) | (n3 == 0)
    y = n1 / (n1 + 2 * n2)
    held = lambda x, k: F.when(few, 0.5).otherwise(F.least(F.greatest(x, F.lit(0.1)), F.lit(0.9 * k)))
    one = lambda x: F.greatest(x, F.lit(1))
    return level.groupBy("lang").agg(held(2 - 3 * y * n3 / one(n2), 2).alias("d2"), held(3 - 4 * y * n4 / one(n3), 3).alias("d3"), F.count("*").alias("size"))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", backoff: bool = True) -> DataFrame:
    """The model: (lang, key, log, off), of each n-gram the log probability of its last symbol after the others (null of a
    context that is no n-gram), and the log weight that it has as a context.  Without back-off only the longest n-grams."""
    return kneser_ney(count_ngrams(docs, text, lang), backoff)


def _mark(order: int) -> int:
    return 1 << (BITS * order)


def kneser_ney(counts: DataFrame, backoff: bool = True) -> DataFrame:
    levels = [tk.cut(counts)]
    for k in range(ORDER - 1, 0, -1):  # how many different symbols stand before each shorter n-gram
        shorter = F.col("gram").bitwiseAND(_mark(k) - 1).alias("gram")
        levels.insert(0, tk.cut(levels[0].select("lang", shorter).groupBy("lang", "gram").agg(F.count("*").alias("n"))))
    below, model = None, None
    for k, level in enumerate(levels, 1):
        rows = tk.join_few(level, discounts(level), ["lang"], "gram").withColumn("context", F.shiftright("gram", BITS))
        off = F.when(F.col("n") == 1, 1.0).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        n1, n2 = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        freed = n1 + n2 * F.first("d2") + (F.count("*") - n1 - n2) * F.first("d3")
        around = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), freed.alias("freed"), F.first("size").alias("_size"))
        if backoff:
            around = tk.cut(around)
            weight = F.ln(F.col("freed") / F.col("total")).cast("float")
            contexts = around.select("lang", (F.col("context") + _mark(k - 1)).alias("key"), weight.alias("off"))
            if below is None:  # a symbol that no text has
                part = around.select("lang", F.lit(_mark(0)).cast("long").alias("key"), F.ln(F.col("freed") / F.col("total") / F.col("_size")).cast("float").alias("log"), F.lit(None).cast("float").alias("off"))
            else:
                part = below.select("lang", (F.col("gram") + _mark(k - 1)).alias("key"), F.ln("p").cast("float").alias("log")).join(contexts, ["lang", "key"], "full_outer")
            model = part if model is None else model.unionByName(part)
        rows = rows.withColumn("off", off).join(around.drop("_size"), ["lang", "context"])
        if below is None:
            lower = 1 / F.col("size")
        else:
            rows = rows.withColumn("shorter", F.col("gram").bitwiseAND(_mark(k - 1) - 1)).join(below.select("lang", F.col("gram").alias("shorter"), F.col("p").alias("lower")), ["lang", "shorter"])
            lower = F.col("lower")
        below = tk.cut(rows.select("lang", "gram", ((F.col("n") - F.col("off")) / F.col("total") + F.col("freed") / F.col("total") * lower).alias("p")))
    longest = below.select("lang", (F.col("gram") + _mark(ORDER)).alias("key"), F.ln("p").cast("float").alias("log"), F.lit(None).cast("float").alias("off"))
    return longest if model is None else model.unionByName(longest)


def _repeated(w: tk.Words, hashes: np.ndarray, rows: int) -> np.ndarray:
    """The words of each row that stand in a window of WINDOW words found twice or more in the row."""
    value, at = tk.window_hashes(hashes, w.row, WINDOW)
    if not len(value):
        return np.zeros(rows, np.int64)
    value = value ^ tk.mix(w.row[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(value)
    same = value[order][1:] == value[order][:-1]
    twice = np.zeros(len(value), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + WINDOW, -1)
    return np.bincount(w.row[np.cumsum(edge[:-1]) > 0], minlength=rows)


_SPACES = " \t\n\x0b\x0c\r"
_SYMBOL_BYTES = np.zeros(256, bool)
_SYMBOL_BYTES[[ord(c) for c in "#*$%&|<>"]] = True


def _duplicate_lines(text: str | None) -> int:
    lines = [x for x in (text or "").split("\n") if x.strip(_SPACES)]
    return len(lines) - len(set(lines))


METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double"
_STRUCT = f"struct<{METRICS.replace(' long', ':long').replace(' double', ':double')}>"

#: A language's keys, sorted, their log probabilities, and their log weights as contexts.
Arrays = tuple[np.ndarray, np.ndarray, np.ndarray]


def _found(key: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each wanted key."""
    at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
    return at, key[at] == wanted


def log_probabilities(gram: np.ndarray, arrays: Arrays) -> np.ndarray:
    """Of each n-gram's last symbol: of the longest n-gram known, with the weights of the contexts above it."""
    key, log, off = arrays
    out = np.zeros(len(gram))
    left = np.arange(len(gram))
    for k in range(ORDER, -1, -1):
        own = gram[left] & (_mark(k) - 1)
        at, known = _found(key, own + _mark(k))
        value = log[at]
        known &= ~np.isnan(value)
        out[left[known]] += value[known]
        if known.all():
            break
        left, own = left[~known], own[~known]
        if k > 1:  # the weight of order 0 is in its own log
            at, known = _found(key, (own >> BITS) + _mark(k - 1))
            out[left[known]] += np.nan_to_num(off[at[known]])
    return out


def _log_perplexity(gram: np.ndarray, arrays: Arrays | None) -> float | None:
    if arrays is None or not len(gram) or not len(arrays[0]):
        return None
    at, known = _found(arrays[0], gram + _mark(ORDER))
    if known.all():  # as in every text that the model was made from
        return -float(arrays[1][at].mean(dtype=np.float64))
    return -float(log_probabilities(gram, arrays).mean(dtype=np.float64)) if len(arrays[2]) else None


def metrics(column: pa.Array, lang: list[str | None], models: dict[str, Arrays]) -> pa.StructArray:
    parts: dict[str, list] = {x.split()[0]: [] for x in METRICS.split(", ")}
    for first, data, offsets in tk.text_slices(column):
        rows = len(offsets) - 1
        w = tk.words(data, offsets)
        by_row = np.repeat(np.arange(rows), np.diff(offsets))
        solid = ~tk._SPACE[data] & ((data & 0xC0) != 0x80)
        repeated = _repeated(w, tk.word_hashes(w), rows)
        parts["n_words"].append(w.counts)
        parts["word_chars"].append(np.bincount(by_row[solid], minlength=rows))
        parts["n_symbols"].append(np.bincount(by_row[_SYMBOL_BYTES[data]], minlength=rows))
        parts["n_repeat_words"].append(repeated)
        gram, row = grams(data, offsets)
        bounds = np.searchsorted(row, np.arange(rows + 1))
        good = (w.counts >= MIN_WORDS) & (100 * repeated <= MAX_REPEAT * w.counts)
        parts["log_perplexity"] += [_log_perplexity(gram[bounds[r] : bounds[r + 1]], models.get(lang[first + r] or "")) if good[r] else None for r in range(rows)]
    parts["n_dup_lines"].append(np.array([_duplicate_lines(x) for x in column.to_pylist()], np.int64))
    perplexity = pa.array(parts.pop("log_perplexity"), pa.float64())
    arrays = {k: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for k, v in parts.items()} | {"log_perplexity": perplexity}
    return pa.StructArray.from_arrays(list(arrays.values()), list(arrays))


def with_metrics(docs: DataFrame, model: DataFrame, text: str = "text", lang: str = "lang", out: str = "quality", shared_grams: int = SHARED_GRAMS) -> DataFrame:
    """docs with a struct `out` of the METRICS.  A model without back-off serves the texts that it was made from only."""
    model = tk.cut(model)
    if model.count() > shared_grams:
        return _by_slices(docs, model, text, lang, out)
    rows = model.orderBy("lang", "key").toArrow().combine_chunks()
    names = rows["lang"].to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)] if len(names) else [0]
    key, log, off = rows["key"].to_numpy(), *(rows[c].to_numpy().astype(np.float32) for c in ("log", "off"))
    off = off if not np.isnan(off).all() else off[:0]  # without back-off
    shared = docs.sparkSession.sparkContext.broadcast({names[a]: (key[a:b], log[a:b], off[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)})

    @F.arrow_udf(_STRUCT)
    def measure(column: pa.Array, lang: pa.Array) -> pa.Array:
        return metrics(column, lang.to_pylist(), shared.value)

    return docs.withColumn(out, measure.asNondeterministic()(F.col(text), F.col(lang).cast("string")))


def _keys(gram: np.ndarray, backoff: bool) -> np.ndarray:
    """The keys that scoring these n-grams may look up."""
    whole = np.unique(gram)
    if not backoff:
        return whole + _mark(ORDER)
    shorter = [np.unique(whole & (_mark(k) - 1)) for k in range(ORDER + 1)]
    contexts = [np.unique(x >> BITS) + _mark(k - 1) for k, x in enumerate(shorter) if k > 1]
    return np.unique(np.concatenate([x + _mark(k) for k, x in enumerate(shorter)] + contexts))


def _by_slices(docs: DataFrame, model: DataFrame, text: str, lang: str, out: str) -> DataFrame:
    """The same by joining each slice's distinct n-grams to the model."""
    place, name = docs.columns.index(text), docs.columns.index(lang)
    backoff = not model.filter(F.col("off").isNotNull()).isEmpty()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        held: dict[str, list] = {}
        size = 0

        def sliced() -> Iterator[pa.RecordBatch]:
            nonlocal n
            for own, tables in held.items():
                rows = pa.Table.from_batches([t for t, _ in tables]).combine_chunks()
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_table(rows)
                wanted = np.unique(np.concatenate([g for _, g in tables]))
                yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + n]), pa.array([own]), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([wanted], pa.list_(pa.int64()))], names=["slice", "lang", "rows", "grams"])
                n += 1

        for batch in batches:
            own = np.array([x or "" for x in batch.column(name).cast(pa.string()).to_pylist()], object)
            for key in dict.fromkeys(own.tolist()):
                rows = batch.filter(pa.array(own == key))
                found = [_keys(grams(data, offsets)[0], backoff) for _, data, offsets in tk.text_slices(rows.column(place))]
                held.setdefault(key, []).append((rows, np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)))
                size += rows.nbytes
            if size > SLICE_SYMBOLS:
                yield from sliced()
                held, size = {}, 0
        yield from sliced()

    packed = tk.cut(docs.mapInArrow(pack, "slice long, lang string, rows binary, grams array<long>"))
    wanted = packed.select("slice", "lang", F.explode("grams").alias("key"))
    found = wanted.join(model, ["lang", "key"]).groupBy("slice").agg(F.collect_list(F.struct("key", "log", "off")).alias("found"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, raw, log in zip(*(batch.column(batch.schema.names.index(c)) for c in ("lang", "rows", "found")), strict=True):
                known = {}
                if log.is_valid and len(log.values):
                    key, value, off = (log.values.field(c).to_numpy(zero_copy_only=False) for c in ("key", "log", "off"))
                    order = np.argsort(key)
                    known = {own.as_py(): (key[order], value[order].astype(np.float32), off[order].astype(np.float32) if backoff else off[:0])}
                for rows in pa.ipc.open_stream(raw.as_buffer()):
                    struct = metrics(rows.column(place), rows.column(name).cast(pa.string()).to_pylist(), known)
                    yield pa.RecordBatch.from_arrays([*rows.columns, struct], names=[*rows.schema.names, out])

    schema = docs.select("*", F.lit(None).cast(_STRUCT).alias(out)).schema
    return packed.join(found, "slice", "left").select("lang", "rows", "found").mapInArrow(score, schema)


def base_failed(q: str = "quality"):
    return (F.col(f"{q}.n_words") < MIN_WORDS) | (100 * F.col(f"{q}.n_repeat_words") > MAX_REPEAT * F.col(f"{q}.n_words"))


def shortest_half(counts: dict[int, int]) -> tuple[int, int]:
    """The ends of the shortest range of keys that has half of the counts: of those, the one that has most."""
    keys = sorted(counts)
    below = np.concatenate([[0], np.cumsum([counts[k] for k in keys])])
    best = None
    for i, low in enumerate(keys):
        j = int(np.searchsorted(2 * (below - below[i]), below[-1]))  # keys[i] to keys[j - 1]
        if j > len(keys):
            break
        found = (keys[j - 1] - low, -(below[j] - below[i]), low)
        best = min(best, found) if best else found
    return best[2], best[2] + best[0]


_BAND = "lang string, low double, high double, reach double"


def bands(scored: DataFrame, lang: str = "lang", text: str = "text", source: str = "source", q: str = "quality") -> DataFrame:
    """(lang, low, high, reach): for each language the shortest half of log perplexity of its distinct texts that
    pass the base rules, and the reach of its band beyond.  `text` may be a column of hashes."""
    place = F.col(source).cast("string") if source in scored.columns else F.lit(None).cast("string")
    rows = scored.filter(~base_failed(q) & F.col(f"{q}.log_perplexity").isNotNull()).select(_language(lang).alias("lang"), F.col(text).alias("text"), place.alias("source"), F.round(F.col(f"{q}.log_perplexity") / STEP).cast("long").alias("step"))
    texts = rows.groupBy("lang", "text").agg(F.min("source").alias("source"), F.min("step").alias("step"))
    counted = tk.cut(texts.groupBy("lang", "source", "step").agg(F.count("*").alias("n")))
    sources = counted.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    langs = sources.groupBy("lang").agg(F.sum("own").alias("all"), F.count("*").alias("sources"))
    capped = sources.join(langs, "lang").select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "all", F.least(F.lit(1.0), F.col("all") / F.col("sources") / F.col("own")).alias("share"))
    shared = counted.join(capped, (F.col("lang") == F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))).filter(F.col("all") >= LEAST_TEXTS)
    steps = shared.groupBy("lang", "step").agg(F.sum(F.ceil(PARTS * F.col("n") * F.col("share"))).alias("n"))

    def half(rows: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd

        # a row for each step of log perplexity, so their number is bounded
        low, high = shortest_half(dict(zip(rows["step"].tolist(), rows["n"].tolist(), strict=True)))
        return pd.DataFrame({"lang": rows["lang"].iloc[:1], "low": (low - 0.5) * STEP, "high": (high + 0.5) * STEP, "reach": FENCE * max((high - low + 1) * STEP, LEAST_SPREAD)})

    return steps.groupBy("lang").applyInPandas(half, _BAND)


def judged(scored: DataFrame, limits: DataFrame, by: str, lang: str = "lang", q: str = "quality", out: str = "kept") -> DataFrame:
    """scored with a boolean `out`: not failed by the base rules, and inside the language's band.  `by` is a column that tells rows apart."""
    key, low, high, reach = tk.fresh(scored, "_language", "_low", "_high", "_reach")
    rows = tk.join_few(scored.withColumn(key, _language(lang)), limits.toDF(key, low, high, reach), [key], by, "left")
    p, wide = F.col(f"{q}.log_perplexity"), F.col(reach) * F.sqrt(F.greatest(F.lit(1.0), F.lit(FULL_LENGTH) / F.greatest(F.col(f"{q}.word_chars"), F.lit(1))))
    inside = F.coalesce((p >= F.col(low) - wide) & (p <= F.col(high) + wide), F.lit(True))
    return rows.withColumn(out, ~base_failed(q) & inside).drop(key, low, high, reach)


def apply_rules(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs that the rules keep."""
    q, hashed, kept = tk.fresh(docs, "_quality", "_text_hash", "_keep")
    scored = with_metrics(docs, train(docs, text, lang, backoff=False), text, lang, q).withColumn(hashed, F.xxhash64(text))
    return judged(scored, bands(scored, lang, hashed, q=q), hashed, lang, q, kept).filter(kept).select(*docs.columns)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    tk.small_batches(spark)
    docs = tk.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    scored = tk.cut(with_metrics(docs, train(docs, backoff=False)).withColumn("_text", F.xxhash64("text")).drop("text"))
    base = [F.col(f"quality.{x}").alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    done = judged(scored, bands(scored, text="_text"), "doc_id")
    return done.select("doc_id", *base, base_failed().alias("base_failed"), "kept", F.exp("quality.log_perplexity").alias("perplexity"))
