"""From stored files to sections, chunks and vectors."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from quillmark.functions.scalars import mime_of, normalize_newlines, stem, suffix

MAX_CHUNK, OVERLAP, CHUNK_CEILING = 2000, 200, 500
PAGE_CAP, CHARACTER_CAP = 500, 5_000_000
_HEADING = r"^\s*(#{1,6}) +(\S.*?)\s*$"
_EDGE = r"^\s+|\s+$"


def _trim(c):
    return F.regexp_replace(c, _EDGE, "")


def read_text(files: DataFrame) -> DataFrame:
    """files (path, content) as one section each; `rejected` says why a file has none."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    reason = F.when(text.isNull(), "not_utf8").when(_trim(text) == "", "blank")
    return files.select("path", stem(F.col("path")).alias("title"), F.when(reason.isNull(), text).alias("text"), reason.alias("rejected"))


def markdown_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_number, line, heading, level, section): a section starts at each heading."""
    line = F.posexplode(F.split(normalize_newlines(F.col(text)), "\n")).alias("line_number", "line")
    lines = docs.select(key, line)
    level = F.length(F.regexp_extract("line", _HEADING, 1))
    lines = lines.withColumn("level", F.when(level > 0, level)).withColumn("heading", F.when(level > 0, F.regexp_extract("line", _HEADING, 2)))
    return lines.withColumn("section", F.count("level").over(Window.partitionBy(key).orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)))


section_ids = markdown_lines


#: A heading as a line of a text, its marks and its words; line ends are line feeds only.
_HEADING_LINE = r"(?md)^[ \t\x0B\f]*(#{1,6}) +(\S.*?)[ \t\x0B\f]*$"
#: Put before and behind a heading's words while a row is cut; code points that no text may have.
_BEFORE, _BEHIND = "\ufdd0\ufdd1", "\ufdd2\ufdd3"


def markdown_sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section_index, heading, text): bodies under headings, empty ones left out; fences aren't special.

    A text of nothing but headings is one section, the whole of it; a blank one has none.  A text is cut in its row."""
    clean = normalize_newlines(F.col(text))
    parts = F.split(F.regexp_replace(clean, _HEADING_LINE, f"{_BEFORE}$2{_BEHIND}"), _BEFORE)
    has = lambda x: F.contains(x, F.lit(_BEHIND))
    body = lambda x: _trim(F.when(has(x), F.substring_index(x, _BEHIND, -1)).otherwise(x))
    cut = F.transform(parts, lambda x: F.struct(F.when(has(x), F.substring_index(x, _BEHIND, 1)).alias("heading"), body(x).alias("text")))
    whole = F.filter(F.array(F.struct(F.lit(None).cast("string").alias("heading"), _trim(clean).alias("text"))), lambda x: x["text"] != "")
    rows = docs.select(key, F.filter(cut, lambda x: x["text"] != "").alias("_sections"), whole.alias("_whole"))
    rows = rows.select(key, F.posexplode(F.when(F.size("_sections") > 0, F.col("_sections")).otherwise(F.col("_whole"))).alias("section_index", "_s"))
    return rows.select(key, "section_index", "_s.heading", "_s.text")


def markdown_titles(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "stem") -> DataFrame:
    """(key, title, heading_count): the first heading of level 1, else the file's stem."""
    clean = F.coalesce(normalize_newlines(F.col(text)), F.lit(""))
    first = F.nullif(F.regexp_extract(clean, _HEADING_LINE.replace("(#{1,6})", "(#)"), 2), F.lit(""))
    return docs.select(key, F.coalesce(first, name).alias("title"), F.regexp_count(clean, F.lit(_HEADING_LINE)).cast("long").alias("heading_count"))


def assemble_pages(pages: DataFrame, page_cap: int = PAGE_CAP, character_cap: int = CHARACTER_CAP) -> DataFrame:
    """(document_id, text, n_sections, rejected) from page rows: blank pages dropped, the rest joined by blank lines."""
    clean = pages.withColumn("text", F.btrim(normalize_newlines(F.col("text")), F.lit(" \t\n")))
    parts = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("page_number", "text"))))
    docs = clean.groupBy("document_id").agg(F.count("*").alias("_n"), parts.alias("_p"))
    joined = docs.withColumn("text", F.array_join(F.transform("_p", lambda x: x["text"]), "\n\n")).withColumn("n_sections", F.size("_p"))
    reason = F.when(F.col("_n") > page_cap, "too_many_pages").when(F.col("n_sections") == 0, "no_text").when(F.char_length("text") > character_cap, "too_long")
    return joined.select("document_id", F.when(reason.isNull(), F.col("text")).alias("text"), "n_sections", reason.alias("rejected"))


def page_sections(pages: DataFrame) -> DataFrame:
    """(document_id, section_index, heading, text) of pages with text."""
    clean = pages.withColumn("text", F.btrim(normalize_newlines(F.col("text")), F.lit(" \t\n"))).filter("text <> ''")
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("page_number")) - 1
    return clean.select("document_id", place.alias("section_index"), F.concat(F.lit("Page "), F.col("page_number").cast("string")).alias("heading"), "text")


def assemble_blocks(blocks: DataFrame) -> DataFrame:
    """(document_id, text, n_headings, n_tables) from ordered paragraphs and tables.

    A table's cells are an array of structs (row, cell, text): a merged cell stands in several places under one
    `cell` and counts once in its row; blank cells, and tables of nothing else, are left out."""
    clean = F.filter(F.transform("cells", lambda c: F.struct(c["row"].alias("row"), c["cell"].alias("cell"), F.btrim(normalize_newlines(c["text"]), F.lit(" \t\n")).alias("text"))), lambda c: c["text"] != "")
    # the first of each cell of a row: where its key stands first
    keys = F.transform("_cells", lambda c: F.struct(c["row"], c["cell"]))
    rows = blocks.withColumn("_cells", clean).withColumn("_keys", keys)
    rows = rows.withColumn("_cells", F.filter("_cells", lambda c, i: F.array_position("_keys", F.struct(c["row"], c["cell"])) == i + 1)).drop("_keys")
    lines = F.transform(F.array_distinct(F.transform("_cells", lambda c: c["row"])), lambda r: F.array_join(F.transform(F.filter("_cells", lambda c: c["row"] == r), lambda c: c["text"]), " | "))
    part = F.when(F.col("kind") == "table", F.array_join(lines, "\n")).otherwise(F.btrim("text"))
    rows = rows.withColumn("_part", part)
    parts = F.array_sort(F.collect_list(F.when(F.col("_part") != "", F.struct("block_index", "_part"))))
    heading = (F.col("kind") == "paragraph") & F.lower("style").startswith("heading") & (F.col("_part") != "")
    return rows.groupBy("document_id").agg(F.array_join(F.transform(parts, lambda x: x["_part"]), "\n\n").alias("text"), F.count_if(heading).alias("n_headings"), F.count_if((F.col("kind") == "table") & (F.col("_part") != "")).alias("n_tables"))


_SPACE = re.compile(r"\s*")
_BREAKS = (re.compile(r"\n[^\S\n]*\n\s*"), re.compile(r"\n"), re.compile(r"[.!?]+(?=\s)"), re.compile(r"\s"))


def _break_before(text: str, start: int, limit: int) -> int:
    """The last boundary of the strongest kind inside [start, limit): paragraph, line, sentence, blank; else the limit."""
    for kind, pattern in enumerate(_BREAKS):
        begin = start + 1 if kind == 3 else start
        last = None
        for last in pattern.finditer(text, begin, limit):
            pass
        if last is not None:
            return last.start() if kind == 3 else last.end()
    return limit


def chunk_text(text: str, size: int = MAX_CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """(start, end) of each chunk in code points of the normalised text."""
    n, at = len(text), 0
    while at < n:
        start = _SPACE.match(text, at).end()
        if start >= n:
            return
        end = start + size
        end = n if end >= n else _break_before(text, start, end)
        end = start + len(text[start:end].rstrip())
        if end <= start:
            end = start + len(text[start : start + size].rstrip())
        yield start, end
        if end >= n:
            return
        at = max(end - overlap, start + 1, at + 1)


def chunk_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = MAX_CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_index, content, content_hash, character_count, start_offset, end_offset) of every text.

    Offsets are code points and the search for boundaries looks back, so this runs in Python, by Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, x in zip(pdf[key], pdf[text], strict=True):
                clean = re.sub("\r\n?", "\n", x or "")
                rows += [(k, i, clean[a:b], b - a, a, b) for i, (a, b) in enumerate(chunk_text(clean, size, overlap))]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "content", "character_count", "start_offset", "end_offset"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(key, text).mapInPandas(run, f"{key} {kind}, chunk_index int, content string, character_count int, start_offset int, end_offset int")
    return out.withColumn("content_hash", F.sha2("content", 256))


def route_extractor(files: DataFrame, path: str = "path") -> DataFrame:
    """files with the extractor and MIME type of their extension; unknown ones are rejected."""
    ext = suffix(F.col(path))
    route = F.when(ext == ".txt", "text").when(ext.isin(".md", ".markdown"), "markdown").when(ext == ".docx", "blocks").when(ext == ".pdf", "pages")
    return files.withColumn("extractor", route).withColumn("mime_type", mime_of(ext)).withColumn("rejected", F.when(route.isNull(), "unsupported_format"))


def embedding_backlog(chunks: DataFrame, model: str) -> DataFrame:
    """Chunks without a vector of the model; `broken` if they have only one of vector and model."""
    broken = F.col("embedding").isNull() != F.col("embedding_model").isNull()
    return chunks.filter(F.col("embedding").isNull() | F.col("embedding_model").isNull() | (F.col("embedding_model") != model)).withColumn("broken", broken)


def hash_embedder(dimensions: int) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic stand-in for an embedding service: the bytes of the text's digests, from -1 to 1."""
    import hashlib

    def digests(text: str) -> bytes:
        return b"".join(hashlib.md5(f"{i}:{text}".encode()).digest() for i in range((dimensions + 15) // 16))[:dimensions]

    def embed(texts: list[str]) -> list[list[float]]:
        return [[b / 127.5 - 1 for b in digests(x)] for x in texts]

    return embed


def embed(chunks: DataFrame, fn: Callable[[list[str]], list[list[float]]], dimensions: int, model: str, batch: int = 128) -> DataFrame:
    """(id, embedding, embedding_model) of every chunk; fn gets at most `batch` texts and must answer each with one vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                vectors = fn(part["chunk_text"].tolist())
                if len(vectors) != len(part) or any(len(v) != dimensions for v in vectors):
                    raise ValueError("the embedding function must give one vector of the right dimension for each text")
                yield pd.DataFrame({"id": part["id"], "embedding": vectors, "embedding_model": model})

    return chunks.select("id", "chunk_text").mapInPandas(run, "id long, embedding array<float>, embedding_model string")


def set_embedding(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """chunks with the vectors and models of `vectors` (id, embedding, embedding_model) in place of their own."""
    new = vectors.select("id", F.col("embedding").alias("_e"), F.col("embedding_model").alias("_m"))
    joined = chunks.join(new, "id", "left")
    hit = F.col("_m").isNotNull()
    return joined.withColumn("embedding", F.when(hit, F.col("_e")).otherwise(F.col("embedding"))).withColumn("embedding_model", F.when(hit, F.col("_m")).otherwise(F.col("embedding_model"))).drop("_e", "_m")


def clear_embedding(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    gone = ids.select("id").distinct().withColumn("_gone", F.lit(True))
    joined = chunks.join(gone, "id", "left")
    kept = F.col("_gone").isNull()
    return joined.withColumn("embedding", F.when(kept, F.col("embedding"))).withColumn("embedding_model", F.when(kept, F.col("embedding_model"))).drop("_gone")


def within_chunk_ceiling(documents: DataFrame, chunks: DataFrame, limit: int = CHUNK_CEILING) -> DataFrame:
    """(document_id, n_chunks, accepted) of every document: those without chunks, or with more than the limit, are rejected."""
    n = chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"))
    rows = documents.select(F.col("id").alias("document_id")).join(n, "document_id", "left").fillna(0, ["n_chunks"])
    return rows.withColumn("accepted", F.col("n_chunks").between(1, limit))
