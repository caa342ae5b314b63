"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and the odd cases:
nulls, empty and very long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import base64
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from attestra.llm import byte_bpe, chat_fsm, chunk_dedup, common, decontaminate, ecoc_langid, ngram_join, pu_quality, url_cascade, warc_store, wavelet
from attestra.llm.queries import RULES, op10_url_cascade

DOCS = "doc_id long, text string, id string, key long, part int, n string, words string"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "y", "z") for i, t in rows], DOCS).repartition(3)


def prose(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioubcdfgl") for _ in range(1 + v % 7)) + str(v) for v in (r.randrange(vocabulary) for _ in range(n)))


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "A"), (5, "A"), (None, "Some text here"), (6, "some TEXT here"), (7, "É b"), (8, "é b"), (9, prose(9000, 1)), (10, prose(9000, 1).upper())]


# -- n-gram join


def sets_of(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def classes(rows, k, percent):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [sets_of(t, k) for _, t in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            parent[find(i)] = find(j)
    big = 1 << 62
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, big), big if d is None else d)
    return sorted(((d, len(s), None if least[find(i)] == big else least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def near_rows():
    r = random.Random(5)
    rows = list(ODD)
    for g in range(12):
        base = prose(r.choice([8, 12, 30, 60, 150]), 100 + g).split()
        for c in range(r.choice([1, 3, 25])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(["new", "word", f"u{r.randrange(99)}"])
            if r.random() < 0.3:
                w = w[: -1 - r.randrange(2)]
            rows.append((1000 + 100 * g + c, (" " if c % 2 else "\n").join(w)))
    common_line = prose(40, 77)
    rows += [(5000 + i, common_line + " " + prose(r.choice([3, 10, 60]), 900 + i)) for i in range(40)]
    return rows


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (1, 50), (2, 100)])
def test_near_duplicates(spark, k, percent):
    rows = near_rows()
    got = ngram_join.near_duplicates(docs(spark, rows), k, percent).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == classes(rows, k, percent)


def test_near_duplicates_hot_grams(spark, monkeypatch):
    """N-grams that pass by their buckets, some of them in sets with copies, change no result."""
    rows = near_rows()
    hot = prose(14, 78)
    rows += [(7000 + i, hot + " " + prose(1 + i % 3, 1900 + i // 2)) for i in range(60)] + [(7100 + i, hot) for i in range(9)]
    monkeypatch.setattr(ngram_join, "HOT", 20)
    monkeypatch.setattr(ngram_join, "HOT_SAMPLE", 1)
    monkeypatch.setattr(ngram_join, "TASK_GRAMS", 500)
    monkeypatch.setattr(common, "SLICE_BYTES", 1 << 10)
    frame = docs(spark, rows)
    kinds, n = ngram_join.hot_grams(frame, 3, len(rows), 10**6)
    assert len(kinds) > 20 and n.min() >= 20 and (np.diff(kinds.astype(float)) > 0).all()
    for percent in (50, 90):
        got = ngram_join.near_duplicates(frame, 3, percent).collect()
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == classes(rows, 3, percent)


def test_near_duplicates_chain(spark):
    """Links that no star finds: each text is similar only to its neighbours."""
    w = prose(200, 3, 10**6).split()
    rows = [(i, " ".join(w[2 * i : 2 * i + 60])) for i in range(50)]
    got = ngram_join.near_duplicates(docs(spark, rows), 3, 90)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=str) == classes(rows, 3, 90)


def test_near_duplicates_empty(spark):
    assert ngram_join.near_duplicates(docs(spark, [])).collect() == []


def test_components(spark):
    nodes = spark.range(1, 41).withColumnRenamed("id", "node")
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(40, 35), (35, 33)], "a long, b long")
    got = {r["node"]: r["comp"] for r in common.components(nodes, links, "t").collect()}
    assert got == {i: 1 if i <= 30 else 33 if i in (33, 35, 40) else i for i in range(1, 41)}


# -- WARC


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "same"), (2, None, "same"), (3, "http://b/\r\nX: y", "same"), (4, "u", None), (5, "u", ""), (6, "u", "é" * 100_000), (6, "u", "é" * 100_000), (7, "u", "other"), (None, "u", "other")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, owner string").repartition(3)
    archive = warc_store.write_archive(pages)
    assert archive.payloads(spark).count() == 4
    got = warc_store.reconstruct(archive, spark).collect()
    assert len(got) == len(rows) and all(r["intact"] for r in got)
    by = {}
    for i, _, h in rows:
        by.setdefault((h or "").encode(), []).append(i)
    owner = {k: max((x for x in v if x is not None), default=None) for k, v in by.items()}
    want = sorted([(i, (h or "").encode(), "response" if owner[(h or "").encode()] == i else "revisit", None if owner[(h or "").encode()] == i else owner[(h or "").encode()]) for i, _, h in rows], key=str)
    assert sorted([(r["id"], bytes(r["payload"]), r["record_type"], r["refers_to"]) for r in got], key=str) == want
    for r in got:
        p = bytes(r["payload"])
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(p).digest()).decode() and r["payload_bytes"] == len(p)
        head = bytes(r["header"])
        assert head.startswith(b"WARC/1.1\r\n") and head.endswith(b"\r\n\r\n") and head.count(b"\r\n\r\n") == 1 and b"\nX: y" not in head
    whole = {r["id"]: bytes(r["record"]) for r in warc_store.record_bytes(warc_store.reconstruct(archive, spark)).collect()}
    assert whole[3].split(b"\r\n\r\n", 1)[1] == b"same\r\n\r\n" and whole[1].endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")


def test_warc_least_size_and_empty(spark):
    schema = "page_id long, url string, html string"
    archive = warc_store.write_archive(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], schema), min_bytes=3)
    got = {r["id"]: (r["record_type"], r["refers_to"]) for r in warc_store.reconstruct(archive, spark).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}
    assert warc_store.reconstruct(warc_store.write_archive(spark.createDataFrame([], schema)), spark).collect() == []


def test_warc_string_ids(spark):
    rows = [("a>b%3E", "same"), ("none", "same"), (None, "same"), ("é\r\n", "same"), ("z%", "same"), ("id1", "o"), (None, "p"), (None, "p")]
    pages = spark.createDataFrame([(i, None, h) for i, h in rows], "page_id string, url string, html string")
    got = warc_store.reconstruct(warc_store.write_archive(pages), spark).collect()
    assert sorted(((r["id"], r["record_type"], r["refers_to"]) for r in got), key=str) == sorted([(i, "revisit", "é\r\n") for i, h in rows if h == "same" and i != "é\r\n"] + [("é\r\n", "response", None), ("id1", "response", None), (None, "response", None), (None, "response", None)], key=str)


def test_warc_damage_is_seen(spark):
    archive = warc_store.write_archive(spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (3, "u", "b")], "page_id long, url string, html string"))
    held = [tuple(r) for r in archive.payloads(spark).collect()]
    spark.createDataFrame([(d, o, bytearray(b"c") if o == 2 else p) for d, o, p in held], "digest string, owner long, payload binary").coalesce(1).write.mode("overwrite").parquet(f"{archive.path}/payloads")
    assert {r["id"]: r["intact"] for r in warc_store.reconstruct(archive, spark, with_payload=False).collect()} == {1: False, 2: False, 3: True}


# -- wavelet matrix


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (3000, 2), (5000, 49408), (513, 7)])
def test_wavelet_matrix(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint16)
    first, names, counts, m = wavelet.open_shard(wavelet.pack_shard(12, [5, None], np.array([n, 0]), ids))
    assert (first, names, counts.tolist()) == (12, [5, None], [n, 0])
    assert m.all().tolist() == ids.tolist()
    for at in range(0, n, max(1, n // 50)):
        t = int(ids[at])
        assert m.access(at) == t
        where = np.flatnonzero(ids == t)
        assert m.count(t) == len(where) and m.count(t, at, n) == (where >= at).sum()
        k = int(np.searchsorted(where, at))
        assert m.find(t, k) == at and m.find(t, len(where)) == -1
    assert m.count(1 << 20) == 0


def test_wavelet_damage():
    data = bytearray(wavelet.pack_shard(0, [1], np.array([3]), np.array([1, 2, 3])))
    data[-10] ^= 1
    with pytest.raises(ValueError):
        wavelet.open_shard(bytes(data))


@pytest.mark.parametrize("shard", [1 << 22, 50])
def test_token_files(spark, shard, monkeypatch):
    monkeypatch.setattr(wavelet, "SHARD_IDS", shard)
    rows = [*ODD, (11, "It's <|endoftext|> 1 000 ﬁ   x́ \x1c y 日本語テキスト\r\nZ"), (12, "w" * 5000), (13, "Ab, ab. AB! a1. it's. \x1c\x1f.a,b ,, É. é, ΣΑΣ σας. İ ab")]
    rows += [(14, "a <|endoftext|> b"), (15, "x<|startoftext|>Y é<|endoftext|>"), (16, "A <|ENDOFTEXT|> B <|EndOfText|>"), (17, "<|endoftext|"), (18, "|><|endoftext|><|")]
    rows += [(None, None), (None, "Some"), (13, "twice")]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):  # the second one's ids of a text are not those of its words
        tok = Tokenizer.from_file(public_tokenizers.path(name))
        path, starts = wavelet.tokenize_to_files(docs(spark, rows), public_tokenizers.path(name), 2)
        got = sorted((r["start"], r["n_tokens"], r["ids_crc32"], r["id"]) for r in wavelet.read_documents(spark, path, starts).collect())
        coded = [(i, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for i, t in rows]
        assert sorted(((i, n, c) for _, n, c, i in got), key=str) == sorted(((i, len(x), zlib.crc32(x.tobytes())) for i, x in coded), key=str)
        assert [i for *_, i in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
        assert got[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in itertools.pairwise(got))
    path, starts = wavelet.tokenize_to_files(docs(spark, []), public_tokenizers.path("word_bpe_49k.json"), 2)
    assert wavelet.read_documents(spark, path, starts).collect() == []


def test_token_files_of_one_id(spark):
    """Rows of one id, or of none, are spread over parts, and read back in one order."""
    rows = [(None, prose(9, i)) for i in range(60)] + [(5, prose(9, 100 + i)) for i in range(60)] + [(6, "x")]
    frame = docs(spark, rows)
    assert len(wavelet.order_cuts(frame, 8)) == 7
    path, starts = wavelet.tokenize_to_files(frame, public_tokenizers.path("word_bpe_49k.json"), 2)
    got = sorted((r["start"], r["n_tokens"], r["id"]) for r in wavelet.read_documents(spark, path, starts).collect())
    assert len(starts) == 8 and sum(b > a for a, b in itertools.pairwise(starts)) >= 5
    assert [i for _, _, i in got] == [None] * 60 + [5] * 60 + [6] and all(a + n == b for (a, n, _), (b, _, _) in itertools.pairwise(got))


def test_paths_are_qualified(spark, tmp_path):
    assert wavelet.qualified(spark, f"{tmp_path}/x").startswith("file:/") and (tmp_path / "x").is_dir()
    assert wavelet.qualified(spark, f"file:{tmp_path}/y") == f"file:{tmp_path}/y"


# -- byte-level BPE


def plain_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


LONG = [
    "  ".join(prose(30000, 4).split()) + "   \n\n x",
    "ab" * 3000 + " then 's " + "1" * 4000 + "x" + "!?" * 2500 + " " * 3000 + "end" + "\n" * 2100,
    "é" * 3000 + "日本" * 1500,
    "a " * 40000,
    "word  it's 12ab34 <|endoftext|>",
]


def test_bpe_matches_library(spark):
    plain = plain_encoding()
    rows = ODD + [(100 + i, t) for i, t in enumerate(LONG)]
    got = byte_bpe.encode(docs(spark, rows), RANKS, public_tokenizers.PATTERN).collect()
    want = sorted([(i, np.array(plain.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows], key=str)
    assert sorted([(r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in got], key=str) == want
    assert byte_bpe.token_digests(docs(spark, []), RANKS, public_tokenizers.PATTERN).collect() == []
    back = byte_bpe.decode(spark.createDataFrame([(1, None), (2, bytearray(b""))], "doc_id long, ids binary"), RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((r["doc_id"], r["decoded"]) for r in back) == [(1, None), (2, bytearray(b""))]


def test_segments_are_whole():
    _, _, pattern, safe = byte_bpe.encoding(RANKS, public_tokenizers.PATTERN)
    for t in LONG:
        parts = list(byte_bpe.segments(t, safe, 100))
        assert "".join(parts) == t and [m for p in parts for m in pattern.findall(p)] == pattern.findall(t)


def test_bpe_white_space_before_long_pieces():
    plain, opened = plain_encoding(), byte_bpe.encoding(RANKS, public_tokenizers.PATTERN)
    r = random.Random(6)
    kinds = [" ", "\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", "\u2028", "\u3000"]
    runs = ["x" * 2100, "日本" * 400, "7" * 2100, "=" * 2100, "\u0301" * 1100, "ab1" * 40, "'s", "\n" * 2100]
    texts = ["a" + w + t for w in ("\n\n", "\t\t", " \n", "\n ", "\n", "\r\n\r\n") for t in runs]
    texts += ["".join(r.choice(["", "a", "b."]) + "".join(r.choice(kinds) for _ in range(r.randrange(4))) + r.choice(runs) for _ in range(4)) for _ in range(200)]
    assert [t for t in texts if byte_bpe.encode_text(t, *opened) != plain.encode_ordinary(t)] == []


# -- exact duplicates


def test_exact_duplicates(spark):
    rows = ODD + [(20, "x" * 50_000), (21, "X" * 50_000), (22, "x" * 50_001), (23, prose(9000, 1) + " ")]
    got = chunk_dedup.exact_duplicates(docs(spark, rows)).collect()
    low = lambda t: (t or "").translate(str.maketrans(common.UPPER, common.LOWER))
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    want = []
    for i, t in rows:
        g = groups[low(t)]
        keep = max((x for x in g if x is not None), default=None)
        want.append((i, keep, len(g), i == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got], key=str) == sorted(want, key=str)
    assert max(r["n_chunks"] for r in got) > 3
    assert chunk_dedup.exact_duplicates(docs(spark, [])).collect() == []


def test_chunks_concatenate_and_realign(spark):
    t = prose(5000, 8) + ". " + prose(3000, 9)
    df = spark.createDataFrame([(t,), ("inserted words. " + t,), ("\n" * 40000,)], "t string").select("t", chunk_dedup.chunks(F.col("t")).alias("c")).collect()
    assert all("".join(r["c"]) == r["t"] for r in df)
    assert len(set(df[0]["c"]) & set(df[1]["c"])) >= len(df[0]["c"]) - 3


# -- decontamination


def brute_contamination(rows, items, window=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans(common.UPPER, common.LOWER)))
    out = []
    for i, t in rows:
        w, hit, ids = find(t), set(), set()
        for j, b in items:
            x = find(b)
            for s in range(max(1, len(x) - window + 1)) if x else ():
                g = x[s : s + window]
                for p in range(len(w) - len(g) + 1):
                    if w[p : p + len(g)] == g:
                        hit.update(range(p, p + len(g)))
                        ids |= {str(j)} if j is not None else set()
        out.append((i, len(w), len(hit), sorted(ids)))
    return sorted(out, key=str)


@pytest.mark.parametrize("windows, shingles", [(None, None), (0, None), (0, 0)])
def test_contamination(spark, monkeypatch, windows, shingles):
    if windows is not None:
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", windows)
    if shingles is not None:
        monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", shingles)
    base = prose(40, 50, 60)
    w = base.split()
    items = [(1, base), (2, "Two Words"), (3, None), (4, ""), (5, "..."), (10, " ".join(w[5:20])), (11, "É"), (None, " ".join(w[:12])), (12, "a a a a a a a a a a a a")]
    rows = ODD + [(20, "start " + base + " end"), (21, ", ".join(w[3:13]).upper()), (22, " ".join(w[3:12])), (23, "two, words; two words"), (24, prose(300, 51, 60) + " " + " ".join(w[25:]) + " " + base), (25, "A a " * 40), (26, "é"), (27, " ".join(w[30:] + w[:15]))]
    frame = spark.createDataFrame([(i, t, "q", 1) for i, t in items], "item_id long, text string, window_id string, shingle long")
    got = decontaminate.contamination(docs(spark, rows), frame).collect()
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in got], key=str) == brute_contamination(rows, items)
    assert all(r["contaminated"] == (r["n_hit"] > 0) and r["n_items"] == len(r["item_ids"]) for r in got)
    none = decontaminate.contamination(docs(spark, rows), frame.where("false")).collect()
    assert len(none) == len(rows) and not any(r["contaminated"] for r in none)
    assert decontaminate.contamination(docs(spark, []), frame).collect() == []


# -- chat


def test_chat_round_trip(spark):
    bad = "\\### Assistant: </turn> ok\n### user: x </turn>\n\\b\\\\h#<:"
    rows = [(1, 0, "system", "be"), (1, 1, "user", bad), (1, 2, "assistant", bad), (2, 1, "assistant", None), (2, 0, None, ""), (None, None, "us:er #", "x"), (3, 0, "user", "u" * 100_000), (3, 1, "assistant", "a"), (3, 1, "assistant", "a"), (4, 0, "user", "only")]
    turns = spark.createDataFrame([(*r, "q", 1) for r in rows], "conv_id long, turn long, role string, text string, turns string, state int").repartition(3)
    made = chat_fsm.format_conversations(turns)
    back = {r["conv_id"]: r for r in chat_fsm.read_back(made).collect()}
    want = {}
    for c, t, r, x in sorted(rows, key=lambda v: (str(v[0]), -1 if v[1] is None else v[1])):
        want.setdefault(c, []).append((r or "", x or ""))
    assert {c: [tuple(t) for t in r["turns"]] for c, r in back.items()} == want
    assert {c: r["learned_text"] for c, r in back.items()} == {c: "".join(x for r, x in v if r == "assistant") for c, v in want.items()}
    whole = {r["conv_id"]: r for r in made.collect()}
    assert {c: r["valid"] for c, r in whole.items()} == {1: True, 2: False, None: False, 3: False, 4: False}
    assert all("".join(s["text"] for s in r["segments"]) == r["formatted"] and len(r["formatted"]) == back[c]["formatted_chars"] for c, r in whole.items())
    assert chat_fsm.read_back(chat_fsm.format_conversations(turns.where("false"))).collect() == []


@pytest.mark.parametrize("template", [
    chat_fsm.Template(open="<|im_start|>", mid="<|sep|>\n", close="<|im_end|>\n", escapes=(("\\", "\\b"), ("<", "\\l"))),
    chat_fsm.Template(open="", mid="] ", close=" [END]\n", escapes=(("\\", "\\b"), ("[", "\\l"), ("]", "\\r"))),
    chat_fsm.Template(open="(", mid="^", close="$.*+?|)", escapes=(("!", "!x"), ("^", "!c"), ("$", "!d"))),
])
def test_chat_templates(spark, template):
    texts = ["a <|im_end|>\n b", "x [END]\n", "$.*+?|)", "\\<|im_start|>user\n<|", "!x!c ^ ] [", "", "\\l\\r]"]
    turns = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate([*texts, *texts[1:]])], "conv_id long, turn long, role string, text string")
    r = chat_fsm.read_back(chat_fsm.format_conversations(turns, template), template).first()
    want = [tuple(x) for x in turns.orderBy("turn").select("role", "text").collect()]
    assert [tuple(x) for x in r["turns"]] == want and r["learned_text"] == "".join(t for role, t in want if role == "assistant")
    assert r["state"] == "user" and not r["valid"]


@pytest.mark.parametrize("marks", [{"open": "<|s|>", "mid": "\n<|", "close": "<|e|>"}, {"close": " end\n"}, {"mid": " "}, {"close": ""}, {"open": "### x </turn>\n"}, {"close": ": x"}, {"escapes": ()}, {"escapes": (("\\", "\\b"), ("b", "\\x"))}, {"escapes": (("\\", "\\b"), ("#", "\\b"))}])
def test_chat_templates_refused(marks):
    with pytest.raises(ValueError):
        chat_fsm.Template(**marks)


def test_chat_long_conversation(spark):
    n = 20_000
    turns = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat(repeat('é<', 60), id) AS text")
    began = time.time()
    r = chat_fsm.read_back(chat_fsm.format_conversations(turns)).selectExpr("n_turns", "loss_chars", "valid").first()
    assert tuple(r) == (n, sum(120 + len(str(i)) for i in range(1, n, 2)), True) and time.time() - began < 60


# -- quality


def test_quality_held_out(spark):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        good = i % 5 != 0
        t = prose(r.randrange(20, 200), i, 5000)
        rows.append((i, t.replace("0", ".") if good else " ".join(w + r.choice(["###", "$$$", "%%%"]) for w in t.split())))
        if i % 2 == 0:
            labels.append((i, int(good)))
    rows += [(None, None), (700, ""), (700, ""), (701, "x" * 200_000)]
    lab = spark.createDataFrame([*labels, (2, 1), (4, None), (None, 1)], "doc_id long, quality int")
    got = pu_quality.learn_and_score(docs(spark, rows), lab, lambda i: F.col("id_") % 4 != 2).collect()
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 for x in got)
    held = [(x["score"] >= 0.7) == (x["doc_id"] % 5 != 0) for x in got if x["doc_id"] is not None and x["doc_id"] < 600 and x["doc_id"] % 4 == 2]
    assert sum(held) / len(held) > 0.95
    none = pu_quality.learn_and_score(docs(spark, rows[:5]), lab.where("false"), lambda i: F.lit(True)).collect()
    assert {round(x["score"], 6) for x in none} == {pu_quality.PRIOR}
    assert pu_quality.learn_and_score(docs(spark, []), lab, lambda i: F.lit(True)).collect() == []


def test_quality_equals_one_process(spark):
    """The same risk, minimised over plain arrays."""
    r = random.Random(4)
    rows = [(i, prose(r.randrange(5, 120), i, 3000) + (" ###" * r.randrange(9) if i % 3 == 0 else "")) for i in range(300)]
    lab = [(i, int(i % 3 != 0)) for i in range(0, 300, 2)]
    x = np.array([[*np.array(pu_quality.measures(t), "f4"), 1.0] for _, t in rows])
    pos = np.array([i % 2 == 0 and i % 3 != 0 for i, _ in rows])
    listed = [[float(v) for v in row[:-1]] for row in x]
    half = np.array([r[0] for r in spark.createDataFrame(list(enumerate(listed)), "i int, x array<float>").orderBy("i").select(pu_quality.half_of(F.col("x"))).collect()])
    want = pu_quality.learn(lambda f, fold=None: np.asarray(f(x, pos) if fold is None else f(x[half == fold], pos[half == fold])), x.shape[1])
    assert want.steps and want.risk[1] >= 0
    score = 1 / (1 + np.exp(-(x @ np.array(want.weights))))
    got = {q["doc_id"]: q["score"] for q in pu_quality.learn_and_score(docs(spark, rows), spark.createDataFrame(lab, "doc_id long, quality int"), lambda i: F.lit(True)).collect()}
    assert max(abs(got[i] - s) for (i, _), s in zip(rows, score, strict=True)) < 1e-6


def test_quality_risk_is_least():
    """Newton's weights against many small steps down the written-out objective."""
    r = np.random.default_rng(5)
    x = np.hstack([r.random((400, 4)), np.ones((400, 1))])
    pos = (x[:, 0] + 0.3 * r.random(400) > 0.8) & (r.random(400) < 0.5)
    got = pu_quality.minimise(lambda f: np.asarray(f(x, pos)), 5, 0.3)
    w = np.zeros(5)
    ridge = np.array([pu_quality.RIDGE] * 4 + [0.0])
    for _ in range(20_000):
        z = x @ w
        down = -0.3 * (x[pos] / (1 + np.exp(z[pos]))[:, None]).mean(0) + (x / (1 + np.exp(-z))[:, None]).mean(0) - 0.3 * (x[pos] / (1 + np.exp(-z[pos]))[:, None]).mean(0) + ridge * w
        w -= 0.5 * down
    assert got.risk[1] > 0 and np.abs(x @ w - x @ np.array(got.weights)).max() < 0.02


def test_quality_prior():
    r = np.random.default_rng(1)
    for prior in (0.2, 0.5, 0.8):
        pos = r.random(40_000) < prior
        score = np.where(pos, r.beta(6, 2, len(pos)), r.beta(2, 6, len(pos)))
        known = pos & (r.random(len(pos)) < 0.3)
        z = np.log(score / (1 - score))[:, None]
        assert abs(pu_quality.prior_bound(pu_quality.histogram(z, known, np.ones(1))) - prior) < 0.05
    assert pu_quality.prior_bound(np.zeros(2 * pu_quality.BINS)) == pu_quality.PRIOR


def test_quality_never_below_zero():
    """Positives alone with a prior that is too high: the negatives' part stays at zero or more."""
    x = np.hstack([np.random.default_rng(2).random((500, 3)), np.ones((500, 1))])
    pos = x[:, 0] > 0.3
    got = pu_quality.minimise(lambda f: np.asarray(f(x, pos)), 4, 0.95)
    assert got.steps and got.risk[1] >= 0


# -- language


def test_codewords():
    for k in range(2, 8):
        c = ecoc_langid.codewords(k)
        assert c.shape == (k, 2 ** (k - 1) - 1) and all((a != b).sum() >= 2 ** (k - 2) for a, b in itertools.combinations(c, 2))
    for k in (8, 30, 1300):
        big = ecoc_langid.codewords(k).astype(int)
        apart = (big.shape[1] - big @ big.T) // 2 + big.shape[1] * np.eye(k, dtype=int)
        assert apart.min() >= big.shape[1] / 4 and (abs(big.sum(0)) < k).all()


def test_language_of_many_values(spark):
    """A column of very many values is learned, each value with at least a text."""
    frame = spark.range(3000).selectExpr("concat('l', id % 600) AS lang", "concat('text ', id % 1500, ' ', id % 600) AS text")
    model = ecoc_langid.fit(frame)
    assert len(model.languages) == 600 and len(model.code) == 600


def test_language_equals_one_process(spark):
    """The same classifiers, fitted from the whole matrix and applied by plain loops; repeated rows and ties."""
    kinds = {"en": "the and of with that".split(), "de": "der und nicht für".split(), "fr": "le une pas été".split()}
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(w) for _ in range(r.randrange(1, 9))), k) for i, (k, w) in enumerate(list(kinds.items()) * 8)]
    rows += [(100, rows[0][1], "en"), (100, rows[0][1], "en"), (101, "zzz", None)]
    got = ecoc_langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), keep=("text",)).collect()

    def shares(text):
        data, h = b" " + text.lower().encode() + b" ", {}
        for order in ecoc_langid.ORDERS:
            for i in range(len(data) - order + 1):
                key = 0
                for x in data[i : i + order]:
                    key = (key * 0x01000193 & 0xFFFFFFFF) ^ x
                key = (key ^ key >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
                at = (order - 1) * ecoc_langid.BUCKETS + (key >> 12) % ecoc_langid.BUCKETS
                h[at] = h.get(at, 0) + 1
        n = sum(h.values()) / len(ecoc_langid.ORDERS)
        return {k: v / n for k, v in h.items()}

    texts, names = sorted({(k, t) for _, t, k in rows if k}), sorted(kinds)
    used = sorted({b for _, t, _ in rows for b in shares(t)})
    vector = lambda t: np.array([shares(t).get(b, 0.0) for b in used])
    x, y = np.array([vector(t) for _, t in texts]), np.array([names.index(k) for k, _ in texts])
    many, code = np.bincount(y)[y], ecoc_langid.codewords(3)
    mean = sum(v / n for v, n in zip(x, many, strict=True)) / len(names)
    scale, weight = 1 / np.sqrt(mean + 1e-4), np.sqrt(len(y) / (len(names) * many))[:, None]
    a = (x - mean) * scale * weight
    k = a @ a.T
    w = a.T @ np.linalg.solve(k + np.eye(len(k)) * (0.02 * np.trace(k) / len(k) + 1e-9), weight * code[y]) * scale[:, None]
    for row in got:
        z = np.clip(vector(row["text"]) @ w - mean @ w, -1.5, 1.5)
        loss = np.array([sum(math.log1p(math.exp(-4 * b * m)) for b, m in zip(c, z, strict=True)) for c in code])
        p = np.exp(loss.min() - loss)
        assert row["lang_pred"] == names[int(loss.argmin())] and abs(row["score"] - p.max() / p.sum()) < 1e-3
    assert len(got) == len(rows)


def test_language_held_out(spark):
    kinds = {"en": "the and of with that this from were have".split(), "de": "der und nicht für auch über schön wird eine".split(), "fr": "le une pas été où garçon voilà avec des".split(), "es": "el los niño qué está más una para con".split()}
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(w) for _ in range(r.randrange(5, 40))), k) for i, (k, w) in enumerate(list(kinds.items()) * 60)]
    odd = [(900, None, "en"), (901, "", None), (902, "123 !!", "de"), (903, "THE AND " * 60_000, None), (None, "über nicht", None)]
    frame = spark.createDataFrame([(*x, "q", 0.0) for x in rows + odd], "doc_id long, text string, lang string, lang_pred string, score double").repartition(3)
    got = {x["doc_id"]: x for x in ecoc_langid.identify(frame, F.col("doc_id") % 3 != 0).collect()}
    held = [got[i]["lang_pred"] == k for i, _, k in rows if i % 3 == 0]
    assert sum(held) / len(held) > 0.98
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "en", "de"] and got[900]["ambiguous"] and got[900]["score"] == 0
    assert {x["lang_pred"] for x in ecoc_langid.identify(frame.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert ecoc_langid.identify(frame.where("false")).collect() == []


def test_language_sample_with_copies(spark):
    """A language of few texts with many copies is learned, and a hot text pushes none out."""
    rows = [("de", f"wort {i % 3}") for i in range(900)] + [(k, f"{k} {i}") for k in ("en", "fr") for i in range(400)]
    rows += [("aa", f"hot {i % 40}") for i in range(4000)]
    frame = spark.createDataFrame(rows, "lang string, text string").orderBy("lang")
    assert ecoc_langid.fit(frame, per_language=5).languages == ["aa", "de", "en", "fr"]


# -- urls


def brute_judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0].translate(str.maketrans(common.UPPER, common.LOWER))
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.key), default=None)
    return host, path, best.key if best else None, best.verdict if best else "allow"


def test_urls(spark):
    urls = [None, "", "example.com/en/1", "http://", "http://example.com/en/7", "http://EXAMPLE.com/en/71?x#y", "http://notexample.com/en/7", "https://a.b.example.net/de/8", "ftp://x.net/de/9", "http://x.org#/es/", "http://x.org/es/?://", "http://com/en/", "http://.com/en/", "http://com./en/", "http://x.com/En/", "http://" + "a." * 300 + "com/en/" + "z" * 9000, "http://é.org/es/", "http://example.com", "http://exa\nmple.com/en/7\n"]
    pages = spark.createDataFrame([(i, u, "q", "r") for i, u in enumerate([*urls, urls[4]])] + [(None, urls[4], "q", "r")], "page_id long, url string, host string, key string").repartition(3)
    got = url_cascade.judge(pages, RULES).collect()
    want = [(i, *brute_judge(u)) for i, u in enumerate([*urls, urls[4]])] + [(None, *brute_judge(urls[4]))]
    assert sorted([(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got], key=str) == sorted(want, key=str)
    assert {r["verdict"] for r in url_cascade.judge(pages, []).collect()} == {"allow"}
    assert url_cascade.judge(pages.where("false"), RULES).collect() == []


def test_verdicts_of_the_contract(spark, tmp_path):
    """Each rule's word as the contract has it, not as RULES does."""
    verdicts = {
        "http://a.com/en/1": ("com/en/", "block"),
        "http://www.example.com/en/71": ("example.com/en/7", "allow"),
        "http://example.com/en/8": ("com/en/", "block"),
        "http://a.net/de/9": ("net/de/", "allow"),
        "http://example.net/de/7": ("net/de/", "allow"),
        "http://m.example.net/de/8": ("example.net/de/8", "block"),
        "http://a.org/es/": ("org/es/", "block"),
        "http://a.org/fr/": (None, "allow"),
    }
    spark.createDataFrame(list(enumerate(verdicts)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = op10_url_cascade(spark, str(tmp_path)).collect()
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in got} == dict(enumerate(verdicts.values()))


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("crc32(key) % 7 = 0").unionByName(spark.createDataFrame([(None,), ("k3",), ("k3",)], "key string"))
    cascade = url_cascade.build(listed, universe)
    assert len(cascade.levels) > 2
    wrong = universe.where(cascade.contains(F.col("key")) != ((F.crc32("key") % 7 == 0) | (F.col("key") == "k3")))
    assert wrong.count() == 0


def test_cascade_in_parts(spark, monkeypatch):
    """A list that needs more than one filter may hold is dealt to parts, each of them exact; a list over all bounds is an error."""
    monkeypatch.setattr(url_cascade, "MOST_BITS", 1 << 12)
    universe = spark.range(8000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("crc32(key) % 7 = 0")
    cascade = url_cascade.build(listed, universe)
    assert len(cascade.parts) > 1
    assert universe.where(cascade.contains(F.col("key")) != (F.crc32("key") % 7 == 0)).count() == 0
    monkeypatch.setattr(url_cascade, "ALL_BITS", 1 << 12)
    with pytest.raises(ValueError):
        url_cascade.build(listed, universe)


def test_cascade_of_many_keys(spark):
    universe = spark.range(200_000).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = url_cascade.build(universe.where("crc32(key) % 2 = 0"), universe)
    assert universe.where(cascade.contains(F.col("key")) != (F.crc32("key") % 2 == 0)).count() == 0


# -- pipeline


def test_pipeline_against_brute_force(spark, tmp_path):
    r = random.Random(11)
    item = prose(30, 600)
    rows = [(i, prose(r.randrange(30, 120), 700 + i, 3000)) for i in range(40)]
    rows += [(50 + i, rows[i][1].upper() if i % 2 else rows[i][1]) for i in range(6)]
    for i in range(8):
        w = rows[10 + i][1].split()
        w[r.randrange(len(w))] = "changed"
        rows.append((70 + i, " ".join(w)))
    rows += [(90, rows[30][1] + " " + item), (91, " ".join(item.split()[4:14])), (92, " ".join(item.split()[4:13])), (93, None), (94, ""), (95, "12 34"), (96, "Hi")]
    frame = spark.createDataFrame([(i, t, ["en", "de", None][i % 3], "s", len(t or ""), "q") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    left = [(i, t) for i, t in rows if t and re.search(r"[^\W\d_]", t)]
    last = {}
    for i, t in left:
        last[t.lower()] = max(i, last.get(t.lower(), i))
    left = [(i, t) for i, t in left if last[t.lower()] == i]
    comp = {i: c for i, _, c in classes(left, 5, 80)}
    left = [(i, t) for i, t in left if comp[i] == i]
    hit = {i: h for i, _, h, _ in brute_contamination(left, [(1, item)])}
    left = [(i, t) for i, t in left if not hit[i]]
    plain = plain_encoding()
    want = []
    for i, t in left:
        ids = plain.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(tuple(x) for x in got) == sorted(want)
    assert 30 < len(want) < len(rows) - 10


@pytest.mark.parametrize("from_files", [False, True])
def test_pipeline_stages_decide_by_row(spark, tmp_path, from_files):
    """Several null and repeated ids: one row of each group stays, and no other row goes for having the same id; for tables of files and for other plans."""
    item = prose(30, 600)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    a, b, c, d, e = (prose(60, 800 + i, 10**6) for i in range(5))
    made = lambda rows: spark.createDataFrame([(i, t, "s", "q") for i, t in rows], "doc_id long, text string, row_ string, component_id string").repartition(3)
    frame = (lambda rows: common.written(made(rows), "docs")) if from_files else made
    left = lambda stage, rows: sorted(((r["doc_id"], r["text"]) for r in stage(spark, frame(rows), str(tmp_path)).collect()), key=str)
    rows = [(None, a), (None, a.upper()), (None, a), (None, b), (1, c), (1, c), (1, d), (2, d), (None, d), (None, None)]
    got = left(corpus_pipeline.exact, rows)
    assert [x for x in got if (x[1] or "").lower() != a] == sorted([(None, b), (1, c), (2, d), (None, None)], key=str) and len(got) == 5
    rows = [(None, a + " x"), (None, a), (None, a), (None, b), (1, c), (1, c), (1, d + " x"), (2, d), (None, d), (1, e), (None, None), (None, None)]
    got = left(corpus_pipeline.near, rows)
    assert [x for x in got if not (x[1] or "").startswith(a)] == sorted([(None, b), (1, c), (1, d + " x"), (1, e), (None, None), (None, None)], key=str) and len(got) == 7
    rows = [(None, a + " " + item), (None, b), (None, None), (1, item), (1, c), (1, c), (2, d)]
    assert left(corpus_pipeline.benchmark, rows) == sorted([(None, b), (None, None), (1, c), (1, c), (2, d)], key=str)


def test_pipeline_keys_name_one_row(spark, tmp_path):
    """Rows of several files have keys of their own, also where a join or an explode repeats a file's rows."""
    spark.range(40).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text")).repartition(4).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    twice = spark.range(2).withColumnRenamed("id", "other")
    for some, n in ((docs, 40), (docs.crossJoin(twice), 80), (docs.withColumn("o", F.explode(F.array(F.lit(1), F.lit(2)))), 80), (docs.union(docs), 80)):
        keyed, row = corpus_pipeline._numbered(some)
        assert (keyed.count(), keyed.select(row).distinct().count()) == (n, n)


def test_pipeline_language_with_nothing_to_learn(spark, tmp_path):
    rows = [(1, "Some words here"), (2, None), (3, "12 ..."), (None, "é"), (4, "")]
    for lang in (None, "en"):
        frame = spark.createDataFrame([(i, t, lang, "a", 1, "b", "c", "d", "e", 2) for i, t in rows], "doc_id long, text string, lang string, lang_pred string, score int, ambiguous string, id_ string, text_ string, lang_ string, lettered int")
        got = corpus_pipeline.language(spark, frame, str(tmp_path))
        assert got.columns == frame.columns
        assert sorted(map(tuple, got.collect()), key=str) == sorted([(i, t, lang, "a", 1, "b", "c", "d", "e", 2) for i, t in (rows[0], rows[3])], key=str)


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Empty tables, very long texts and clashing names go through every stage."""
    long = prose(60_000, 901, 10**6)
    rows = [(1, long, "en"), (2, long.upper(), None), (3, long + " end", "de"), (4, None, None), (5, "", "en"), (6, "x" * 300_000, "de"), (None, "Some text", "en"), (None, "Some text", "en")]
    names = "doc_id long, text string, lang string, source string, n_chars long, id string, key long, print long, kept string, component_id long, contaminated string, row_ int, score int"
    frame = spark.createDataFrame([(*r, "s", 1, "a", 1, 2, "b", 3, "c", 4, 5) for r in rows], names)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for at, some in (("whole", frame), ("none", frame.where("false"))):
        some.write.parquet(f"{tmp_path}/{at}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{at}/benchmark.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, some, str(tmp_path)).columns == frame.columns, name
        got = sorted((r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/{at}").collect()), key=str)
        assert got == ([2, 6, None] if at == "whole" else [])
