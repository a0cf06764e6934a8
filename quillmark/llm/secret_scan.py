"""Secret scans: fixed patterns, and a battery of randomness tests for strings of any other form.

Candidates are runs of LEAST_RANDOM or more letters, digits and `+/_=-`, cut where base spans are, and as
alternatives to a whole run its pieces between each set of separators in SPLITS (so `key=...`, a part of a
path, or what stands beside an access id is tested by itself).  Only runs of digits, of separators or of one
character are left out.  A find that lies inside another find is not listed again.
Their encoding is inferred from the letters used (the smallest of _ENCODINGS that has them all).  Against
"random in this encoding" three tests are made: chi-squared of the alphabet's uniformity, runs above
and below its middle, and serial correlation of neighbours; a candidate that any of them refutes at
BATTERY_LEVEL (divided by the tests) is not random.

Against "letters as the corpus writes them", a candidate's p-value is its probability under pairs of letters,
counted by Spark in all runs too short to be candidates, over its probability as a random string of one of the
encodings.  By Markov's inequality such a ratio is at most p with a probability of at most p if the corpus's
pairs made the string, whatever its length: longer strings have more evidence, and short ones little.  The
p-values of all candidates of the whole corpus are put under Benjamini-Hochberg control, from a histogram of
fixed size; as they are inverse e-values, the control holds for alternatives that overlap, too.

Null and empty texts have no spans.  Each row is judged by itself, so repeated rows repeat results.
Offsets count code points; ends are exclusive.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk

# The patterns that the scan is specified by.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "random")

LEAST_RANDOM = 20
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_RANDOM},}}")
_ONE_KIND = re.compile(r"[0-9]+|(.)\1*|[-_=+/]+")
#: Sets of separators that a run is split at, after those that are parts of them.
SPLITS = ("=", "=/", "=+", "=-", "=_", "=/+", "=-_", "=/+-_")
_PIECES = {x: re.compile(f"[^{re.escape(x)}]{{{LEAST_RANDOM},}}") for x in SPLITS}
_COARSER = {x: [y for y in SPLITS if set(y) < set(x)] for x in SPLITS}
#: The battery's level, and the share of false finds among all that are let through.
BATTERY_LEVEL, FALSE_SHARE = 0.01, 0.001
#: Bins of -log10(p) in the histogram for the control, and their width.
BINS, BIN = 400, 0.05

_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_ENCODINGS = (
    ("hex", _DIGITS + "abcdef"),
    ("hex", _DIGITS + "ABCDEF"),
    ("letters", _LOWER),
    ("letters", _LOWER.upper()),
    ("base32", _LOWER + "234567"),
    ("base32", _LOWER.upper() + "234567"),
    ("base36", _LOWER + _DIGITS),
    ("base36", _LOWER.upper() + _DIGITS),
    ("alnum", _LOWER.upper() + _LOWER + _DIGITS),
    ("base64", _LOWER.upper() + _LOWER + _DIGITS + "+/"),
    ("base64url", _LOWER.upper() + _LOWER + _DIGITS + "-_"),
)
#: Letters that candidates are made of; any other byte is the last class.
_LETTERS = "".join(sorted(_LOWER.upper() + _LOWER + _DIGITS + "+/_=-"))
OTHER = len(_LETTERS)
_CLASS = np.full(256, OTHER, np.int64)
_CLASS[[ord(c) for c in _LETTERS]] = np.arange(OTHER)
#: Pairs that stand for what is known before a corpus is counted.
PRIOR = 200.0
# Letters of running text from the most frequent on, and how often a kind of letter follows another.
_FREQUENT = "etaoinshrdlucmfwypvbgkjqxz"
_FOLLOWS = {"lower": (0.93, 0.01, 0.02, 0.04), "upper": (0.6, 0.33, 0.03, 0.04), "digit": (0.07, 0.05, 0.8, 0.08), "mark": (0.55, 0.2, 0.2, 0.05), "other": (0.7, 0.15, 0.1, 0.05)}


def _prior() -> np.ndarray:
    """The probability of each class but the last after each class."""
    rank = {c: 1 / (i + 2) for i, c in enumerate(_FREQUENT)}
    kind = ["lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "mark" for c in _LETTERS]
    own = np.array([rank.get(c.lower(), 1.0) for c in _LETTERS])
    names = np.array(kind)
    within = np.zeros(OTHER)
    for k in set(kind):
        within[names == k] = own[names == k] / own[names == k].sum()
    share = {k: np.array([_FOLLOWS[k][("lower", "upper", "digit", "mark").index(x)] for x in kind]) for k in _FOLLOWS}
    return np.array([share[k] * within for k in [*kind, "other"]])


def letter_pairs(docs: DataFrame, text: str = "text") -> np.ndarray:
    """log10 of the probability of each letter after each class, from all runs shorter than candidates.

    The driver gets a count of each pair of classes of a task: a number that doesn't depend on the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((OTHER + 1) * OTHER, np.int64)
        for batch in batches:
            for _, data, offsets in tk.text_slices(batch.column(0)):
                own = _CLASS[data]
                inside = own < OTHER
                before = np.full(len(own), OTHER, np.int64)
                before[1:] = own[:-1]
                before[offsets[:-1][offsets[:-1] < len(own)]] = OTHER
                start = np.flatnonzero(inside & (before == OTHER))
                place = np.cumsum(inside)
                if not len(start):
                    continue
                length = np.diff(np.append(place[start] - 1, place[-1]))
                short = np.repeat(length < LEAST_RANDOM, length)
                total += np.bincount((before[inside] * OTHER + own[inside])[short], minlength=len(total))
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[pair])], names=["pair", "n"])

    rows = docs.select(text).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    count = np.zeros((OTHER + 1) * OTHER)
    count[[r["pair"] for r in rows]] = [r["n"] for r in rows]
    count = count.reshape(OTHER + 1, OTHER)
    return np.log10((count + PRIOR * _prior()) / (count.sum(axis=1, keepdims=True) + PRIOR))


def against_text(token: str, pairs: np.ndarray) -> float:
    """The p-value of a string against letters as the corpus writes them."""
    own = _CLASS[np.frombuffer(token.encode(), np.uint8)]
    plain = float(pairs[np.concatenate([[OTHER], own[:-1]]), own].sum())
    fits = [len(alphabet) for _, alphabet in _ENCODINGS if set(token) <= set(alphabet)]
    if not fits:
        return 1.0
    best = -len(token) * math.log10(min(fits))
    random_ = best + math.log10(sum(10 ** (-len(token) * math.log10(x) - best) for x in fits) / len(_ENCODINGS))
    return 10 ** min(0.0, max(plain - random_, -300.0))


def _upper_normal(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _upper_chi(x: float, df: int) -> float:
    """Wilson and Hilferty's normal form of the chi-squared tail."""
    s = 2 / (9 * df)
    return _upper_normal(((x / df) ** (1 / 3) - (1 - s)) / math.sqrt(s))


def judge(token: str) -> tuple[str, float]:
    """(encoding, p of the battery against random)."""
    body = token.rstrip("=")
    if len(body) < 2:
        return "", 0.0
    for name, alphabet in _ENCODINGS:
        at = {c: i for i, c in enumerate(alphabet)}
        if all(c in at for c in body):
            break
    else:
        return "", 0.0
    size, n = len(alphabet), len(body)
    value = np.array([at[c] for c in body])
    counts = np.bincount(value, minlength=size)
    chi = float(((counts - n / size) ** 2).sum() * size / n)
    uniform = _upper_chi(chi, size - 1) if n >= size else _upper_normal((chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n))
    high = value >= size // 2
    a = int(high.sum())
    b = n - a
    if a and b:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * a * b / n
        spread = math.sqrt(max(2 * a * b * (2 * a * b - n) / (n * n * (n - 1)), 1e-9))
        run_p = 2 * _upper_normal(abs(runs - mean) / spread)
    else:
        run_p = 0.0
    x = value - value.mean()
    serial = float((x[1:] * x[:-1]).sum() / max((x * x).sum(), 1e-9))
    serial_p = 2 * _upper_normal(abs(serial + 1 / n) * math.sqrt(n))
    return name, min(1.0, 3 * min(uniform, run_p, serial_p))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if any(k in text.lower() for k in KEYWORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def _alternatives(run: str) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, alternatives around it) of a run without leading `=` and of its pieces; each place once."""
    whole = (0, len(run))
    out: dict[tuple[int, int], set[tuple[int, int]]] = {whole: set()}
    core = run.rstrip("=")
    pieces: dict[str, list[tuple[int, int]]] = {}
    for split in SPLITS if any(c in core for c in SPLITS[-1]) else ():
        # trailing `=` pads the last piece
        pieces[split] = [(m.start(), len(run) if m.end() == len(core) else m.end()) for m in _PIECES[split].finditer(core)]
        starts = {c: [s for s, _ in pieces[c]] for c in _COARSER[split]}
        for piece in pieces[split]:
            around = out.setdefault(piece, set())
            around.add(whole)
            for coarser in _COARSER[split]:
                i = bisect.bisect_right(starts[coarser], piece[0]) - 1
                if i >= 0 and pieces[coarser][i][1] >= piece[1]:
                    around.add(pieces[coarser][i])
            around.discard(piece)
    return [(s, e, list(around)) for (s, e), around in sorted(out.items())]


def random_spans(text: str, taken: list[tuple[str, int, int]], pairs: np.ndarray) -> list[tuple[int, int, float, float]]:
    """(start, end, p against running text, least p of candidates around it) of candidates beside the taken spans.

    p is 1 for those that the battery refutes; the last is above 1 where no candidate is around.
    """
    out = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        at, free = a, []
        for _, s, e in sorted((t for t in taken if t[1] < b and a < t[2]), key=lambda t: t[1]):
            free.append((at, s))
            at = max(at, e)
        for start, end in (*free, (at, b)):
            run = text[start:end].lstrip("=")
            if len(run) < LEAST_RANDOM:
                continue
            start = end - len(run)
            found: dict[tuple[int, int], float] = {}
            alternatives = _alternatives(run)
            for s, e, _ in alternatives:
                if not _ONE_KIND.fullmatch(run, s, e):
                    found[s, e] = against_text(run[s:e].rstrip("="), pairs) if judge(run[s:e])[1] > BATTERY_LEVEL else 1.0
            for s, e, around in alternatives:
                if (s, e) in found:
                    out.append((start + s, start + e, found[s, e], min((found[x] for x in around if x in found), default=2.0)))
    return out


_SPANS = "array<struct<kind:string,start:long,end:long,p:double,outer:double>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64()), ("outer", pa.float64())]))


def _spans_of(text: str | None, pairs: np.ndarray) -> list[dict]:
    """All base spans (p is null) and all candidates with their p-values and the least of those around them."""
    base = base_spans(text) if text else []
    out = [{"kind": k, "start": a, "end": b, "p": None, "outer": None} for k, a, b in base]
    return out + [{"kind": "random", "start": a, "end": b, "p": p, "outer": o} for a, b, p, o in (random_spans(text, base, pairs) if text else [])]


def with_spans(docs: DataFrame, text: str = "text", out: str = "spans", pairs: np.ndarray | None = None) -> DataFrame:
    """docs with the spans of each text, base ones and candidates; pairs: see `letter_pairs`."""
    pairs = letter_pairs(docs, text) if pairs is None else pairs

    @F.arrow_udf(_SPANS)
    def find(column: pa.Array) -> pa.Array:
        return pa.array([_spans_of(x, pairs) for x in column.to_pylist()], _SPAN_TYPE)

    return docs.withColumn(out, find.asNondeterministic()(F.col(text)))


def discovery_level(scanned: DataFrame, spans: str = "spans", share: float = FALSE_SHARE) -> float:
    """The p-value up to which candidates are let through: at most `share` of them false.

    The histogram has BINS bins whatever the corpus; a bin's p-values count as its largest.  Every
    alternative counts as a test, but one that lies inside another find is no find of its own.
    """
    p = F.explode(F.expr(f"filter({spans}, s -> s.kind = 'random')")).alias("s")
    bin_ = lambda p: F.least(F.lit(BINS), F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) / BIN))
    # a find until the candidate around it is one
    pairs = scanned.select(p).select(bin_(F.col("s.p")).alias("bin"), F.when(F.col("s.outer") <= 1, bin_(F.col("s.outer"))).alias("until"))
    rows = pairs.groupBy("bin", "until").count().collect()
    total, gains = sum(r["count"] for r in rows), Counter()
    for r in rows:
        if r["until"] is None or r["until"] < r["bin"]:
            gains[r["bin"]] += r["count"]
            if r["until"] is not None:
                gains[r["until"]] -= r["count"]
    so_far, level = 0, 0.0
    for b in sorted(gains, reverse=True):
        so_far += gains[b]
        most = 10 ** (-b * BIN)
        if most * total <= share * so_far:
            level = most
    return level


def significant(level: float, spans: str = "spans"):
    """Column: the base spans and the outermost candidates under the level, by start and then by kind as listed."""
    keep = F.filter(F.col(spans), lambda s: s["p"].isNull() | ((s["p"] <= level) & (s["outer"] > level)))
    order = F.transform(keep, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(order)


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """docs with every found span replaced by the mask; overlapping spans count as one.

    A column n_chars follows the new text if docs has one.  Spans are found again when they are masked, in one
    Python function, so a task has one worker."""
    pairs = letter_pairs(docs, text)
    (spans,) = tk.fresh(docs, "_spans")
    level = discovery_level(with_spans(docs, text, spans, pairs).select(spans), spans)

    @F.arrow_udf("string")
    def blot(column: pa.Array) -> pa.Array:
        out = []
        for x in column.to_pylist():
            found = sorted((s["start"], s["end"]) for s in _spans_of(x, pairs) if s["p"] is None or (s["p"] <= level < s["outer"]))
            if found:
                parts, at = [], 0
                for start, end in found:
                    if start >= at:
                        parts += [x[at:start], mask]
                    at = max(at, end)
                x = "".join([*parts, x[at:]])
            out.append(x)
        return pa.array(out, pa.string())

    done = docs.withColumn(text, blot.asNondeterministic()(F.col(text)))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    tk.small_batches(spark)
    scanned = tk.cut(with_spans(tk.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    level = discovery_level(scanned)
    found = scanned.select("doc_id", significant(level).alias("all"))
    base = F.filter("all", lambda s: s["kind"] != "random")
    number = lambda k: F.size(F.filter("all", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"))
