"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Long texts are cut before they reach the library, at places where the pre-splitting pattern always
ends a match; a single piece too long for the library's merge loop is merged here with a heap.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import SparkContext, SparkFiles
from pyspark.sql import DataFrame

from attestra.llm.common import arrow_map

#: Characters after which the next safe boundary is sought.
SEGMENT = 1 << 16
#: Bytes of one piece above which the heap merge replaces the library's loop, whose time grows with the square.
LONG_PIECE = 2048


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tuple[tiktoken.Encoding, dict[bytes, int], regex.Pattern, regex.Pattern]:
    """The library's encoding of a rank file, its ranks, the pattern, and the pattern of safe boundaries."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), ranks, regex.compile(pattern), regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")


def segments(text: str, safe: regex.Pattern, size: int = SEGMENT) -> Iterator[str]:
    """``text`` cut at safe boundaries, each segment the shortest of at least ``size`` characters.

    No match of the pattern holds a white space after another character, or a letter beside a number,
    and white space is all it looks ahead for; so no match crosses such a place, and cutting there
    changes none.
    """
    at = 0
    while len(text) - at > size and (m := safe.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: always the lowest rank first, of equal ranks the leftmost; n log n."""
    n = len(piece)
    end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop or (j := end[i]) >= n or not alive[j]:
            continue
        alive[j], end[i] = False, stop
        if stop < n:
            prev[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


#: A run that could be one long piece: letters, numbers, white space, or anything else.
LONG_RUN = regex.compile(rf"\p{{L}}{{{LONG_PIECE // 4},}}|\p{{N}}{{{LONG_PIECE // 4},}}|\s{{{LONG_PIECE // 4},}}|[^\s\p{{L}}\p{{N}}]{{{LONG_PIECE // 4},}}")

WHITE = regex.compile(r"\s")


def may_hold_long_piece(text: str) -> bool:
    """False for almost every text, by the lengths of its words; else as LONG_RUN says."""
    least = LONG_PIECE // 4
    if len(text) < least:
        return False
    lens = list(map(len, text.split()))
    if lens and max(lens) < least and len(text) - sum(lens) - len(lens) < least:
        return False
    return LONG_RUN.search(text) is not None


def encode_text(text: str, enc: tiktoken.Encoding, ranks: dict[bytes, int], pattern: regex.Pattern, safe: regex.Pattern) -> list[int]:
    """The ids of ``text`` as the library gives them, in time near to linear for any text."""
    if len(text) <= SEGMENT and not may_hold_long_piece(text):
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part in segments(text, safe):
        at = 0
        if may_hold_long_piece(part):
            for m in pattern.finditer(part):
                if m.end() - m.start() >= LONG_PIECE // 4 and len(piece := m[0].encode()) > LONG_PIECE:
                    # What stands before and after a match can go alone, but for a run of white space before
                    # it: followed by text, the last character of the run is a match of its own.
                    cut = m.start() - 1 if m.start() > at and WHITE.match(part, m.start() - 1) else m.start()
                    ids += enc.encode_ordinary(part[at:cut]) + enc.encode_ordinary(part[cut : m.start()])
                    ids += [ranks[piece]] if piece in ranks else merge_long(piece, ranks)
                    at = m.end()
        ids += enc.encode_ordinary(part[at:])
    return ids


def ship(spark, path: str) -> str:
    """Send a rank file to all executors; the name to open it by there."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def _opened(name: str, path: str) -> str:
    try:
        return SparkFiles.get(name) if SparkContext._active_spark_context is None else path
    except Exception:  # a worker of a session that shares the driver's files
        return path


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(<id>, ids binary, n_tokens long, decoded binary)`` per row of ``docs``.

    ``ids`` holds little-endian unsigned 32-bit integers; ``decoded`` the raw bytes that they stand
    for, equal to the text in UTF-8. A null or empty text has no ids and no bytes. Repeated rows and
    null ids are kept as they are, other columns are not read, an empty table gives an empty result.
    Special tokens are never recognised. Each task loads the rank file once; memory holds one Arrow
    batch of texts and its ids.
    """
    name = ship(docs.sparkSession, ranks_path)

    def run(b: pa.RecordBatch):
        enc, ranks, pat, safe = encoding(_opened(name, ranks_path), pattern)
        ids, n, back = [], [], []
        for t in b.column(1).to_pylist():
            got = encode_text(t or "", enc, ranks, pat, safe)
            ids.append(np.array(got, "<u4").tobytes())
            n.append(len(got))
            back.append(enc.decode_bytes(got))
        yield pa.record_batch([b.column(0), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array(back, pa.binary())], ["id", "ids", "n_tokens", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(docs[id_col].alias("id"), docs[text].alias("text")), run, f"id {kind}, ids binary, n_tokens long, decoded binary").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """``(<id>, decoded binary)``: the raw bytes of each list of ids; a null list gives null."""
    name = ship(tokens.sparkSession, ranks_path)

    def run(b: pa.RecordBatch):
        enc = encoding(_opened(name, ranks_path), pattern)[0]
        yield pa.record_batch([b.column(0), pa.array([None if x is None else enc.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in b.column(1).to_pylist()], pa.binary())], ["id", "decoded"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return arrow_map(tokens.select(tokens[id_col].alias("id"), tokens[ids].alias("ids")), run, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)


def token_digests(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(<id>, n_tokens, ids_sha256, decoded_sha256)``; the same rows as ``encode``, digests made where the ids are."""
    name = ship(docs.sparkSession, ranks_path)

    def run(b: pa.RecordBatch):
        enc, ranks, pat, safe = encoding(_opened(name, ranks_path), pattern)
        n, h, d = [], [], []
        for t in b.column(1).to_pylist():
            got = encode_text(t or "", enc, ranks, pat, safe)
            n.append(len(got))
            h.append(hashlib.sha256(np.array(got, "<u4").tobytes()).hexdigest())
            d.append(hashlib.sha256(enc.decode_bytes(got)).hexdigest())
        yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(h), pa.array(d)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(docs[id_col].alias("id"), docs[text].alias("text")), run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
