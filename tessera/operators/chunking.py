"""Files into chunks: whole definitions where the language allows, else pieces of bounded size.

Python is parsed by its own parser, brace languages by ``definitions``; a file that neither can read is cut by
separators.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import paths as P
from tessera.functions import text as T
from tessera.operators import definitions

PARSED = ("Python", *definitions.LANGUAGES)
PIECE = "array<struct<text:string,symbol_name:string,symbol_type:string,parent_symbol:string,method:string>>"

#: Bytes of content that a task cuts at a time.
BYTES = 1_000_000


@dataclass(frozen=True)
class Piece:
    text: str
    symbol_name: str = ""
    symbol_type: str = ""
    parent_symbol: str = ""


def _cut(text: str, separator: str) -> list[str]:
    """Parts of ``text``, each but the first beginning with the separator; the empty one cuts everywhere."""
    if not separator:
        return list(text)
    parts = text.split(separator)
    return [p for p in [parts[0], *(separator + p for p in parts[1:])] if p]


def split_text(text: str, separators: list[str], size: int, overlap: int) -> list[str]:
    """Pieces of ``size`` characters at most, cut at the strongest separator the text has; neighbours share up to ``overlap``."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    rest = separators[at + 1 :]
    out: list[str] = []
    row: list[str] = []

    def close() -> None:
        """Merge the short parts gathered so far."""
        held: list[str] = []
        length = 0
        for p in row:
            if held and length + len(p) > size:
                out.append("".join(held))
                while held and (length > overlap or length + len(p) > size):
                    length -= len(held.pop(0))
            held.append(p)
            length += len(p)
        if held:
            out.append("".join(held))
        row.clear()

    for part in _cut(text, separators[at]):
        if len(part) < size:
            row.append(part)
            continue
        close()
        if rest:
            out.extend(split_text(part, rest, size, overlap))
        else:
            out.append(part)
    close()
    return [p for p in (x.strip() for x in out) if p]


def _python(source: str) -> list[definitions.Definition] | None:
    """Definitions of the module; None if it can't be parsed."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return None
    data = source.encode()
    lines = [0]
    for line in data.splitlines(keepends=True):
        lines.append(lines[-1] + len(line))

    def begin(node) -> int:
        first = min([node, *getattr(node, "decorator_list", [])], key=lambda n: n.lineno)
        return lines[first.lineno - 1] + (first.col_offset - 1 if first is not node else first.col_offset)

    def end(node) -> int:
        return lines[node.end_lineno - 1] + node.end_col_offset

    functions = (ast.FunctionDef, ast.AsyncFunctionDef)

    def told(node, parent: bool = False) -> definitions.Definition:
        split = isinstance(node, ast.ClassDef) and not node.decorator_list and not parent
        members = tuple(told(n, True) for n in node.body if isinstance(n, functions)) if split else ()
        kind = "method" if parent else "class" if isinstance(node, ast.ClassDef) else "function"
        return definitions.Definition(kind, node.name, place(begin(node)), place(end(node)), members)

    def place(byte: int) -> int:
        return byte if len(data) == len(source) else len(data[:byte].decode("utf-8", "replace"))

    return [told(n) for n in tree.body if isinstance(n, (*functions, ast.ClassDef))]


def _loose(text: str) -> str:
    """Text between definitions, without the semicolon that may end the one before."""
    return text.lstrip("; \t\r\n").rstrip()


def _pieces(source: str, found: list[definitions.Definition]) -> Iterator[Piece]:
    """Each definition, those with members split into what comes before the first and the members, and the text between them."""
    at = 0
    for d in found:
        if loose := _loose(source[at : d.start]):
            yield Piece(loose)
        at = d.end
        if not d.members:
            yield Piece(source[d.start : d.end].rstrip(), d.name, d.kind)
            continue
        yield Piece(source[d.start : d.members[0].start].rstrip(), d.name, d.kind)
        for m in d.members:
            yield Piece(f"# (method of {d.name})\n{source[m.start : m.end]}", m.name, "method", d.name)
    if loose := _loose(source[at:]):
        yield Piece(loose)


def _braces(source: str, language: str) -> list[definitions.Definition] | None:
    try:
        return definitions.find(source, language)
    except (definitions.Broken, RecursionError):
        return None


def by_definition(source: str, language: str, size: int = 1000) -> list[Piece] | None:
    """Pieces by definition, those over three times ``size`` split again with their symbols; None if the language or text forbids."""
    if language not in PARSED or not source.strip():
        return None
    found = _python(source) if language == "Python" else _braces(source, language)
    if found is None:
        return None
    out = []
    for p in _pieces(source, found):
        if len(p.text) > 3 * size:
            out += [Piece(t, p.symbol_name, p.symbol_type, p.parent_symbol) for t in split_text(p.text, config.DEFAULT_SEPARATORS, size, min(150, size // 4))]
        elif p.text.strip():
            out.append(p)
    return out or None


def chunk(source: str, language: str, size: int = 1000, overlap: int = 150) -> list[tuple]:
    """(text, symbol_name, symbol_type, parent_symbol, method) of a file's chunks."""
    found = by_definition(source, language, size)
    if found is not None:
        return [(p.text, p.symbol_name, p.symbol_type, p.parent_symbol, "ast") for p in found]
    return [(t, "", "", "", "heuristic") for t in split_text(source, config.SEPARATORS.get(language, config.DEFAULT_SEPARATORS), size, overlap)]


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` with about BYTES of content, one file at least, in order."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("content")), 0)).astype(np.int64) + 1)
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + BYTES, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def ingest(files: DataFrame, settings: config.Settings = config.Settings()) -> DataFrame:
    """Chunks of file rows (path, content, size_kb), with the fixed columns of a chunk table.

    A chunk's hash is that of its text without the header; missing symbols are empty strings.
    Files without chunks are left out.
    """
    size, overlap = settings.chunk_size, settings.chunk_overlap

    rows = files.select(F.col("path").alias("source"), "content", "size_kb", P.language_context("path").alias("c"), P.role("path").alias("role"), T.content_hash("content").alias("content_hash"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "content")
    names = ("text", "symbol_name", "symbol_type", "parent_symbol", "method")
    piece = pa.list_(pa.struct([(n, pa.string()) for n in names]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in _parts(b)):
            languages = pc.struct_field(batch.column("c"), "language").to_pylist()
            found = [[dict(zip(names, c)) for c in chunk(t or "", l, size, overlap)] for t, l in zip(batch.column("content").to_pylist(), languages)]
            kept = [n for n in batch.schema.names if n != "content"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(found, piece)], names=[*kept, "pieces"])

    rows = rows.mapInArrow(cut, f"{kinds}, pieces {PIECE}")
    rows = rows.select("*", F.size("pieces").alias("total_chunks"), F.posexplode("pieces").alias("chunk_index", "p")).drop("pieces")
    header = T.chunk_header("source", F.col("c.language"), "role")
    return rows.select(
        "source", "c.language", "c.fence", "c.is_code", "c.is_config", "c.is_markup", F.coalesce("role", F.lit("")).alias("role"), "chunk_index", "total_chunks", "size_kb",
        "content_hash", T.content_hash("p.text").alias("chunk_content_hash"), F.col("p.method").alias("chunk_method"), "p.symbol_name", "p.symbol_type", "p.parent_symbol",
        F.concat(header, F.col("p.text")).alias("page_content"),
    )
