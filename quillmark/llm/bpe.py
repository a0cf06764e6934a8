"""BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a piece there is one last token of its encoding.  An automaton over the
vocabulary gives the tokens that end at each position; the last token is the one that encodes
itself and is compatible with the last token of the prefix before it.  Two tokens are compatible if
no merge joins them across their border.  Following the last tokens back from the end gives the ids.

The vocabulary file's own rules are read, not assumed, as far as they are of the kinds used in
`Normal form` below; other kinds are refused.  Scripts whose letters and normal forms haven't changed for many
versions of Unicode are normalised and cut into pieces here; texts with any other code point (`_UNUSUAL`) by the
vocabulary's own normalizer and pre-tokenizer, whose Unicode tables differ from Python's.  Texts are taken whole.  Null text counts as empty;
empty text has no ids.  Special strings of the vocabulary that stand in a text become their ids.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk

#: Chunks that a worker remembers in each of two generations; the older one is dropped when the newer is full.
REMEMBERED = 150_000
#: Stands for the end-of-word mark at the end of a piece.
_END = "\n"
_NEVER = 1 << 60


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    letters = dict(zip(printable, map(chr, printable), strict=True)) | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class Tokenizer:
    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        mark = model["end_of_word_suffix"]
        if model["type"] != "BPE" or not mark or model["byte_fallback"] or model["continuing_subword_prefix"]:
            raise ValueError("the vocabulary must be BPE with an end-of-word suffix")
        self._rules(spec)
        own = lambda s: s[: -len(mark)] + _END if s.endswith(mark) else s
        self.ids = {own(k): v for k, v in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        names = {v: k for k, v in (model["vocab"] | self.special).items()}
        self.names = np.array([names.get(i, "") for i in range(max(names) + 1)], object)
        self._split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        letters = _byte_letters()
        self._to_letters = {b: letters[b] for b in range(256)}
        #: (left, right) to (rank, joined)
        self.merges: dict[tuple[str, str], tuple[int, str]] = {}
        parts: dict[str, tuple[int, str, str]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = map(own, pair.split(" ") if isinstance(pair, str) else pair)
            self.merges.setdefault((a, b), (rank, a + b))
        for (a, b), (rank, joined) in self.merges.items():
            if joined not in parts and self._alone(a, parts) and self._alone(b, parts) and self._apart(a, b, parts, rank):
                parts[joined] = (rank, a, b)
        self._parts = parts
        self._fits: dict[tuple[str, str], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token in self.ids:
            if self._alone(token, parts):
                self.automaton.add_word(token, token)
        self.automaton.make_automaton()
        #: Packed ids of chunks met lately, in two generations.
        self._known: dict[str, bytes] = {}
        self._text, self._own_rules = json.dumps(spec), None
        self._older: dict[str, bytes] = {}

    def _pieces_by_rules(self, text: str) -> list[str]:
        """The pieces of a text in byte letters, by the vocabulary's own rules."""
        if self._own_rules is None:
            import tokenizers

            self._own_rules = tokenizers.Tokenizer.from_str(self._text)
        rules = self._own_rules
        return [piece for piece, _ in rules.pre_tokenizer.pre_tokenize_str(rules.normalizer.normalize_str(text))]

    def _by_rules(self, text: str) -> bytes:
        out = []
        for piece in self._pieces_by_rules(text):
            key = _END + piece  # no chunk has this letter
            found = self._known.get(key)
            if found is None:
                tokens = self.piece_tokens(piece + _END)
                found = struct.pack(f"<{len(tokens)}I", *map(self.ids.__getitem__, tokens))
                self._remember(key, found)
            out.append(found)
        return b"".join(out)

    def _remember(self, key: str, found: bytes) -> None:
        if len(key) <= 64:
            if len(self._known) >= REMEMBERED:
                self._older, self._known = self._known, {}
            self._known[key] = found

    def _rules(self, spec: dict) -> None:
        """Normal form: NFC, runs of white space to one space, lower case; pieces by a pattern; then bytes."""
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        pre = spec["pre_tokenizer"]["pretokenizers"]
        if steps != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in pre] != ["Split", "ByteLevel"] or not pre[0]["invert"] or spec["decoder"] is not None:
            raise ValueError("the vocabulary's rules are of another kind")
        self._piece = regex.compile(pre[0]["pattern"]["Regex"])

    @staticmethod
    def _alone(token: str, parts: dict) -> bool:
        """Whether the token encodes as itself."""
        return len(token) == 1 or token in parts or (len(token) == 2 and token[1] == _END)

    def _spine(self, token: str, right: bool, parts: dict) -> list[tuple[str, int, int]]:
        """The tokens at the left or right edge while `token` is built, last first: (token, rank that makes it, rank that uses it up)."""
        out, used = [], _NEVER
        while True:
            made, a, b = parts.get(token, (-1, "", ""))
            out.append((token, made, used))
            if made < 0:
                return out
            used, token = made, b if right else a

    def _apart(self, left: str, right: str, parts: dict, before: int = _NEVER) -> bool:
        """Whether no merge of a rank below `before` joins the two across their border."""
        a, b = self._spine(left, True, parts), self._spine(right, False, parts)
        i, j = len(a) - 1, len(b) - 1
        while i >= 0 and j >= 0:
            (x, made_x, used_x), (y, made_y, used_y) = a[i], b[j]
            rank = self.merges.get((x, y), (_NEVER,))[0]
            # of two equal merges the one further left comes first
            if rank < before and max(made_x, made_y) <= rank and rank < used_x and rank <= used_y:
                return False
            if used_x <= used_y:
                i -= 1
            else:
                j -= 1
        return True

    def _compatible(self, left: str, right: str) -> bool:
        key = (left, right)
        fits = self._fits.get(key)
        if fits is None:
            if len(self._fits) > 2 * REMEMBERED:
                self._fits.clear()
            fits = self._fits[key] = self._apart(left, right, self._parts)
        return fits

    def piece_tokens(self, piece: str) -> list[str]:
        """The tokens of one piece, given as byte letters and the end mark."""
        last: list[str | None] = [None] * len(piece)
        known = self._fits.get
        for end, token in self.automaton.iter(piece):
            if last[end] is not None:
                continue
            before = end - len(token)
            if before < 0:
                last[end] = token
            elif (left := last[before]) is not None:
                fits = known((left, token))
                if fits is None:
                    fits = self._compatible(left, token)
                if fits:
                    last[end] = token
        out, at = [], len(piece) - 1
        while at >= 0:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def _encoded(self, chunk: str) -> bytes:
        """Packed ids of text without white space."""
        tokens = []
        if chunk.isalpha():
            pieces = [chunk]
        else:
            pieces = self._piece.findall(chunk)
        for piece in pieces:
            letters = piece if piece.isascii() and piece.isprintable() else "".join(map(self._to_letters.__getitem__, piece.encode()))
            tokens += self.piece_tokens(letters + _END)
        return struct.pack(f"<{len(tokens)}I", *map(self.ids.__getitem__, tokens))

    def _chunk(self, chunk: str) -> bytes:
        found = self._known.get(chunk)
        if found is not None:
            return found
        if chunk[-1] in ".," and chunk[:-1].isalpha():  # two pieces, each met more often than both together
            return self._chunk(chunk[:-1]) + self._chunk(chunk[-1])
        found = self._older.get(chunk)
        if found is None:
            found = self._encoded(chunk)
        self._remember(chunk, found)
        return found

    def _plain(self, text: str) -> bytes:
        if not text.isascii() and _UNUSUAL.search(text):
            return self._by_rules(text)
        plain = text.isascii() and not _SEPARATORS.search(text)
        if not text.isascii():
            # letter by letter: no form of a letter depends on its place in the word
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        chunks = text.lower().split() if plain else _WHITE.split(text.lower())
        return b"".join([self._chunk(x) for x in chunks if x])

    def encode(self, text: str) -> bytes:
        """The ids, each in four little-endian bytes."""
        if not (self._split_special and "<|" in text):
            return self._plain(text)
        parts = enumerate(self._split_special.split(text))
        return b"".join([struct.pack("<I", self.special[part]) if i % 2 else self._plain(part) for i, part in parts])

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(self.names[ids].tolist())


#: White space of the pattern `\s` in the vocabulary's rules: Unicode's property, which leaves out 0x1C to 0x1F.
_WHITE = regex.compile(r"\p{White_Space}+")
_SEPARATORS = re.compile("[\x1c-\x1f]")


#: Code points outside the scripts whose tables all versions agree on: Latin, Greek, Cyrillic, general punctuation,
#: currency signs, kana, the first CJK block and Hangul syllables.
_UNUSUAL = re.compile("[^\x00-\u024f\u0300-\u036f\u0391-\u03c9\u0400-\u045f\u2010-\u2027\u2030-\u203a\u20a0-\u20bf\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")


def with_tokens(docs: DataFrame, vocabulary: str, text: str = "text", out: str = "tokens") -> DataFrame:
    """docs with a struct `out` (n_tokens, ids, decoded): ids as binary of little-endian unsigned 32-bit integers."""
    shared = docs.sparkSession.sparkContext.broadcast(_read(vocabulary))

    @F.arrow_udf("struct<n_tokens:long,ids:binary,decoded:string>")
    def run(column: pa.Array) -> pa.Array:
        ids, decoded = _encoded(column, shared)
        return pa.StructArray.from_arrays([pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["n_tokens", "ids", "decoded"])

    return docs.withColumn(out, run.asNondeterministic()(F.col(text)))


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


_loaded: dict[str, Tokenizer] = {}


def _encoded(column: pa.Array, shared) -> tuple[list[bytes], list[str]]:
    spec = shared.value
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = Tokenizer(json.loads(spec))
    tokenizer = _loaded[key]
    ids, decoded = [], []
    for x in column.to_pylist():
        packed = tokenizer.encode(x or "")
        ids.append(packed)
        decoded.append(tokenizer.decode(np.frombuffer(packed, "<u4")))
    return ids, decoded


def token_digests(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, and the SHA-256 of the ids and of the decoded text."""
    shared = docs.sparkSession.sparkContext.broadcast(_read(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, decoded = _encoded(batch.column(1), shared)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded])], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    tk.small_batches(spark)
    return token_digests(tk.table(spark, sf_dir, "documents"), default_vocabulary())
