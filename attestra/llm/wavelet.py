"""Token ids as a wavelet matrix per shard.

A shard file holds the ids of consecutive documents as bit planes, highest bit first; in each plane the
ids whose bit is 0 go before those whose bit is 1, in order, on the way to the next plane. With counts
of ones at block starts beside each plane, a single token is read, an id counted in any range, and its
k-th occurrence found, in steps as many as there are planes.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import struct
import sys
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import SparkContext, SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attestra.llm.common import arrow_map, scratch_dir

#: Fixed values of the format: magic, and bits of a block whose ones are counted.
MAGIC, BLOCK = b"WVMX0001", 512
#: Ids of a shard after which it is closed, at the end of a document.
SHARD_IDS = 1 << 22
#: What a null id counts as.
LEAST = -(1 << 63)
#: Words whose ids a worker remembers. More are encoded where they come; once these are eight times as many
#: as are remembered, it starts anew, so that what it remembers follows the texts.
MEMO = 650_000
#: White space for Python's split that a tokenizer's pattern does not take for such.
NOT_SPACE = "\x1c\x1d\x1e\x1f"
SPACE = re.compile(r"[ \t\r\n]+")
#: What a word may end with and still be encoded as the word and this.
ENDS = frozenset(".,;:!?")
#: A pattern whose matches hold no white space, and kinds of pre-tokenizers and normalizers for which
#: a text's ids are those of its runs between white space, one after the other.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPLITTERS = frozenset({"Whitespace", "WhitespaceSplit", "BertPreTokenizer"})
NORMALIZERS = frozenset({"NFC", "NFKC", "Lowercase", "Replace"})


class WaveletMatrix:
    """Rank, select and access over a sequence of ids below 2**width."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int]):
        self.n, self.zeros = n, zeros
        self.bits = planes  # each of n bits, packed
        self.ranks = []
        for p in planes:
            ones = np.bitwise_count(np.pad(p, (0, -len(p) % (BLOCK // 8))).reshape(-1, BLOCK // 8)).sum(1, dtype=np.int64)
            self.ranks.append(np.append(0, np.cumsum(ones)))

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        width = max(1, int(ids.max(initial=0)).bit_length())
        planes, zeros, a = [], [], ids
        for k in range(width - 1, -1, -1):
            one = (a & a.dtype.type(1 << k)).astype(bool)
            planes.append(np.packbits(one, bitorder="little"))
            low = np.compress(~one, a)
            zeros.append(len(low))
            a = np.concatenate([low, np.compress(one, a)])
        return cls(len(ids), planes, zeros)

    def all(self) -> np.ndarray:
        """Every id in order, by undoing the planes from the last."""
        kind = np.uint16 if len(self.bits) <= 16 else np.uint32
        cur = np.zeros(self.n, kind)
        for k, (p, z) in enumerate(zip(reversed(self.bits), reversed(self.zeros), strict=True)):
            one = np.unpackbits(p, count=self.n, bitorder="little").view(bool)
            out = np.empty_like(cur)
            out[np.flatnonzero(~one)] = cur[:z]
            out[np.flatnonzero(one)] = cur[z:] | kind(1 << k)
            cur = out
        return cur

    def _rank1(self, plane: int, at: int) -> int:
        block, rest = divmod(at, BLOCK)
        if not rest:
            return int(self.ranks[plane][block])
        part = self.bits[plane][block * (BLOCK // 8) : block * (BLOCK // 8) + (rest + 7) // 8]
        return int(self.ranks[plane][block]) + int(np.unpackbits(part, bitorder="little")[:rest].sum())

    def _select(self, plane: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) such bit."""
        ranks = self.ranks[plane] if bit else np.arange(len(self.ranks[plane])) * BLOCK - self.ranks[plane]
        block = int(np.searchsorted(ranks, k, side="right")) - 1
        bits = np.unpackbits(self.bits[plane][block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(ranks[block])])

    def access(self, at: int) -> int:
        if not 0 <= at < self.n:
            raise IndexError(at)
        out = 0
        for i, p in enumerate(self.bits):
            bit = int(p[at // 8]) >> (at % 8) & 1
            out = out << 1 | bit
            at = self.zeros[i] + self._rank1(i, at) if bit else at - self._rank1(i, at)
        return out

    def _descend(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token >> len(self.bits):
            return 0, 0
        for i in range(len(self.bits)):
            a, b = self._rank1(i, lo), self._rank1(i, hi)
            lo, hi = (self.zeros[i] + a, self.zeros[i] + b) if token >> (len(self.bits) - 1 - i) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often ``token`` stands in places from ``lo`` to before ``hi``."""
        lo, hi = self._descend(token, max(0, lo), self.n if hi is None else min(hi, self.n))
        return max(0, hi - lo)

    def find(self, token: int, k: int) -> int:
        """The place of the k-th occurrence (from 0) of ``token``; -1 if there are fewer."""
        lo, hi = self._descend(token, 0, self.n)
        if not 0 <= k < hi - lo:
            return -1
        at = lo + k
        for i in range(len(self.bits) - 1, -1, -1):
            at = self._select(i, 1, at - self.zeros[i]) if token >> (len(self.bits) - 1 - i) & 1 else self._select(i, 0, at)
        return at


def pack_shard(first: int, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard file: header, document ids with a null mask, counts, and each plane compressed by itself."""
    m = WaveletMatrix.build(ids)
    press = zstandard.ZstdCompressor(level=1).compress
    nulls = np.array([d is None for d in doc_ids])
    parts = [press(x) for x in (np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.packbits(nulls).tobytes(), np.asarray(counts, "<i8").tobytes(), *[p.tobytes() for p in m.bits])]
    head = MAGIC + struct.pack("<qqqq", first, len(doc_ids), len(ids), len(m.bits)) + np.array(m.zeros, "<i8").tobytes() + np.array([len(p) for p in parts], "<i8").tobytes()
    body = head + b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


def open_shard(data: bytes) -> tuple[int, list[int | None], np.ndarray, WaveletMatrix]:
    """Place of the first id within its part, document ids, their counts, and the ids; an error if the file is damaged."""
    if data[:8] != MAGIC or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("not a whole shard file")
    first, n_docs, n, width = struct.unpack_from("<qqqq", data, 8)
    zeros = np.frombuffer(data, "<i8", width, 40).tolist()
    lens = np.frombuffer(data, "<i8", width + 3, 40 + 8 * width)
    at, parts = 40 + 8 * (2 * width + 3), []
    for x in lens.tolist():
        parts.append(zstandard.ZstdDecompressor().decompress(data[at : at + x]))
        at += x
    nulls = np.unpackbits(np.frombuffer(parts[1], np.uint8), count=n_docs).astype(bool)
    docs = [None if z else d for d, z in zip(np.frombuffer(parts[0], "<i8").tolist(), nulls.tolist(), strict=True)]
    return first, docs, np.frombuffer(parts[2], "<i8"), WaveletMatrix(n, [np.frombuffer(p, np.uint8) for p in parts[3:]], zeros)


def qualified(spark, path: str) -> str:
    """``path``, made a folder, with scheme and host as Hadoop resolves it: one without a scheme is of the default file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(where)
    return store.makeQualified(where).toString()


def put(uri: str, data: bytes) -> None:
    """Write a file whole or not at all, under a qualified uri; a second attempt of a task writes the same bytes again."""
    if uri.startswith("file:"):
        local = re.sub(r"^file:/+", "/", uri)
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(tmp := f"{local}.{os.getpid()}.tmp", "wb") as f:
            f.write(data)
        os.replace(tmp, local)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(tmp := f"{path}.{uuid.uuid4().hex}.tmp") as f:
        f.write(data)
    store.move(tmp, path)


@functools.lru_cache(maxsize=2)
def _tokenizer(name: str, path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path if SparkContext._active_spark_context is not None else SparkFiles.get(name))


def _flat(step: dict | None, inside: str) -> list[dict]:
    return [] if step is None else [y for x in step[inside] for y in _flat(x, inside)] if step["type"] == "Sequence" else [step]


def splits_at_space(config: dict) -> bool:
    """Whether the tokenizer of ``config`` gives a text the ids of its runs between white space, one after the other."""
    before, cut = _flat(config["normalizer"], "normalizers"), _flat(config["pre_tokenizer"], "pretokenizers")
    plain = all(x["type"] in NORMALIZERS and (x["type"] != "Replace" or (x["pattern"], x["content"]) == ({"Regex": r"\s+"}, " ")) for x in before)
    first = bool(cut) and (cut[0]["type"] in SPLITTERS or (cut[0]["type"] == "Split" and cut[0]["behavior"] == "Removed" and cut[0]["invert"] and cut[0]["pattern"] == {"Regex": WORD_PATTERN}))
    # a later step must not mark the start of what it is given
    marks = any(x["type"] == "Metaspace" or x.get("add_prefix_space") for x in cut)
    named = all(not SPACE.search(x["content"]) and not x["lstrip"] and not x["rstrip"] and not x["single_word"] for x in config["added_tokens"])
    return plain and first and not marks and named


class _Words(dict):
    """The ids of single words as bytes, found when first asked for and remembered for the life of the worker."""

    def __init__(self, tokenizer: Tokenizer, kind: str):
        super().__init__()
        self.tokenizer, self.kind, self.passed = tokenizer, kind, 0
        self.tokenize, self.code = tokenizer.model.tokenize, "H" if kind == "<u2" else "I"
        config = json.loads(tokenizer.to_str())
        steps = [x["type"] for x in _flat(config["normalizer"], "normalizers")]
        #: Whether texts may be encoded run by run; if not, they go to the library whole.
        self.split = splits_at_space(config)
        #: A word of letters below U+0130 is one piece here, and its lower case is its normal form: the model can have it at once.
        self.direct = self.split and "Lowercase" in steps and "ByteLevel" in json.dumps(config["pre_tokenizer"]) and config["model"]["type"] == "BPE"
        #: Strings in a text that the library takes for a token as they stand, in lower case.
        self.named = tuple(x["content"].lower() for x in config["added_tokens"])

    def text(self, t: str) -> bytes:
        """The ids of a whole text, as the library gives them without special tokens at its ends."""
        if not self.split:
            return self.whole(t)
        if self.direct and t.isascii():
            low = t.lower()  # what the tokenizer does to each of these letters; fewer forms to remember
            if not any(x in low for x in self.named):
                t = low
        runs = [w for w in SPACE.split(t) if w] if any(c in t for c in NOT_SPACE) else t.split()
        return b"".join(map(self.__getitem__, runs))

    def whole(self, t: str) -> bytes:
        return self._ids(self.tokenizer.encode(t, add_special_tokens=False).ids)

    def __missing__(self, word: str) -> bytes:
        got = None
        if self.direct:
            core, end = (word[:-1], word[-1]) if word[-1] in ENDS and len(word) > 1 else (word, "")
            if core.isalpha() and (core.isascii() or max(core) < "\u0130"):
                core = core.lower()
                if core == word or (got := self.get(core)) is None:
                    got = self._ids([t.id for t in self.tokenize(core if core.isascii() else core.encode().decode("latin-1").translate(_BYTE_LETTERS))])
                if end:
                    got += self[end]
        if got is None:
            got = self.whole(word)
        if len(self) < MEMO:
            self[word] = got
        else:
            self.passed += 1
            if self.passed > 8 * MEMO:
                self.clear()
                self.passed = 0
        return got

    def _ids(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes() if sys.byteorder == "little" else np.array(ids, self.kind).tobytes()


#: The letters that byte-level vocabularies write bytes with: printable bytes stand for themselves, the others follow from U+0100.
_BYTE_LETTERS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


@functools.lru_cache(maxsize=2)
def _words(name: str, path: str, kind: str) -> _Words:
    return _Words(_tokenizer(name, path), kind)


def encode(docs: DataFrame, tokenizer_path: str, end_id: int, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(id, ids binary, width)`` per row: little-endian ids of the whole text, ``width`` bytes each, then ``end_id``.

    The ids are the library's without special tokens at a text's ends; the string of a special token
    inside a text is that token, as the library has it. Where the tokenizer drops white space and splits
    at it, each distinct run of other characters is encoded by the library once and remembered, and a
    text is the concatenation of its runs; any other tokenizer is given whole texts.
    """
    name = tokenizer_path.rsplit("/", 1)[-1]
    docs.sparkSession.sparkContext.addFile(tokenizer_path)
    kind = "<u2" if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"

    def run(b: pa.RecordBatch):
        words, end = _words(name, tokenizer_path, kind), np.array([end_id], kind).tobytes()
        out = [words.text(t or "") + end for t in b.column(1).to_pylist()]
        yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], ["id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    return arrow_map(rows, run, "id long, ids binary").withColumn("width", F.lit(int(kind[-1])))


def write_shards(tokens: DataFrame, cuts: list[tuple[int, int]], path: str | None = None) -> tuple[str, DataFrame]:
    """Write ``(id, ids, width)`` as shard files in ascending order of id; the folder, and ``(part, ids)`` written per part.

    ``cuts`` are pairs of an id and a hash that split the rows into parts of about the same size; each
    part is sorted by its task and closed into shards of about SHARD_IDS ids, a document never being
    split, however many ids it has. A null id is the least; rows with the same id go in order of their
    tokens, but those of an id with several cuts in order of a hash of these, which spreads them over parts.
    """
    spark = tokens.sparkSession
    path = qualified(spark, path or scratch_dir(spark, "tokens"))
    edges = np.array(sorted(set(cuts)), np.int64).reshape(-1, 2)
    shared = spark.sparkContext.broadcast(edges)

    def place(batches):
        low, high = np.ascontiguousarray(shared.value[:, 0]), np.ascontiguousarray(shared.value[:, 1])
        hot = np.unique(low[high > 0])
        for b in batches:
            ids = b.column(0).fill_null(LEAST).to_numpy(zero_copy_only=False)
            # a row goes after the cuts at its id, but for ids with several cuts, where its hash says which
            part = np.searchsorted(low, ids, side="right")
            tie = np.zeros(len(ids), np.int64)
            mine = np.flatnonzero(np.isin(ids, hot))
            tie[mine] = [zlib.crc32(x) for x in b.column(1).take(pa.array(mine)).to_pylist()]
            for i in np.unique(ids[mine]):
                at = mine[ids[mine] == i]
                part[at] = np.searchsorted(low, i) + np.searchsorted(high[low == i], tie[at], side="right")
            yield pa.record_batch([*b.columns, pa.array(tie), pa.array(part.astype(np.int32))], ["id", "ids", "width", "tie", "part"])

    dealt = tokens.mapInArrow(place, "id long, ids binary, width int, tie long, part int").repartitionById(len(edges) + 1, "part").sortWithinPartitions("part", F.col("id").asc_nulls_first(), "tie", "ids").drop("tie")

    def write(batches):
        _words.cache_clear()  # this worker may have encoded before
        state = {"part": None, "docs": [], "rows": [], "n": 0, "first": 0, "shard": 0}

        def close():
            if state["docs"]:
                ids = np.concatenate(state["rows"])
                put(f"{path}/part-{state['part']:08d}-{state['shard']:06d}.wvm", pack_shard(state["first"], state["docs"], np.array([len(r) for r in state["rows"]]), ids))
                state.update(docs=[], rows=[], first=state["first"] + len(ids), shard=state["shard"] + 1, n=0)

        def total():
            return pa.record_batch([pa.array([state["part"]], pa.int32()), pa.array([state["first"]], pa.int64())], ["part", "ids"])

        for b in batches:
            for d, x, w, p in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if p != state["part"]:
                    if state["part"] is not None:
                        close()
                        yield total()
                    state.update(part=p, first=0, shard=0)
                state["docs"].append(d)
                state["rows"].append(np.frombuffer(x, f"<u{w}"))
                state["n"] += len(x) // w
                if state["n"] >= SHARD_IDS:
                    close()
        if state["part"] is not None:
            close()
            yield total()

    return path, dealt.mapInArrow(write, "part int, ids long")


def order_cuts(docs: DataFrame, parts: int, id_col: str = "doc_id") -> list[tuple[int, int]]:
    """At most ``parts - 1`` pairs of an id and a hash below 2**32, between which the rows fall about evenly.

    An id that several cuts fall on has that many parts of the hash's range.
    """
    if parts < 2:
        return []
    at = docs.agg(F.percentile_approx(F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)), [i / parts for i in range(1, parts)], 10_000)).first()[0]
    cuts = []
    for i, group in itertools.groupby(sorted(at or [])):
        n = len(list(group))
        cuts += [(i, (1 << 32) * j // n) for j in range(n)]
    return cuts


def tokenize_to_files(docs: DataFrame, tokenizer_path: str, end_id: int, text: str = "text", id_col: str = "doc_id", path: str | None = None) -> tuple[str, list[int]]:
    """Encode every row of ``docs`` and write the shard files; the folder, and the place of each part's first id.

    A null or empty text has the end id alone; repeated rows and null ids are written too, in a fixed
    order. A text of more ids than a shard should have is a shard by itself. An empty table writes no
    file. Columns other than the id and the text are not read, whatever their names. One number for each
    part reaches the driver, and the number of parts is that of shuffle partitions.
    """
    spark = docs.sparkSession
    cuts = order_cuts(docs, int(spark.conf.get("spark.sql.shuffle.partitions")), id_col)
    path, totals = write_shards(encode(docs, tokenizer_path, end_id, text, id_col), cuts, path)
    done = {r["part"]: r["ids"] for r in totals.collect()}
    sizes = [done.get(p, 0) for p in range(len(cuts) + 1)]
    return path, np.append(0, np.cumsum(sizes)[:-1]).tolist()


def read_documents(spark, path: str, starts: list[int]) -> DataFrame:
    """``(id, start long, n_tokens long, ids_crc32 long)`` per document, from the shard files alone.

    ``start`` counts the ids of all documents before it. A damaged file is an error, not a gap.
    """
    shared = spark.sparkContext.broadcast(np.array(starts, np.int64))

    def run(batches):
        _words.cache_clear()
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                first, docs, counts, m = open_shard(data)
                ids = m.all().astype("<u4")
                ends = np.cumsum(counts)
                crc = [zlib.crc32(ids[e - c : e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                start = shared.value[int(re.search(r"part-(\d+)-", name)[1])] + first + ends - counts
                yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(start), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    schema = "id long, start long, n_tokens long, ids_crc32 long"
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.wvm").load(path)
    return files.select("path", "content").mapInArrow(run, schema)
