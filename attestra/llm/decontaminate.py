"""Benchmark decontamination by a prefix-filtered join, with DataFrame functions only.

An item's windows of consecutive words are sets of word shingles that a document must hold whole, so
one shingle of each window is enough to find it: the rarest in the corpus. Documents meet the windows
on that shingle; bounds on place and length follow, and the words of the window are compared one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import LOWER, UPPER, small, written

#: Words of a window, and of a shingle.
WINDOW, SHINGLE = 10, 3
#: Windows up to which the index (some 300 bytes each) is broadcast; beyond it the join shuffles. The
#: shingles alone, of 8 bytes, are broadcast as a filter before that up to a higher bound.
BROADCAST_WINDOWS, BROADCAST_SHINGLES = 100_000, 4_000_000
#: What separates words: every ASCII character but letters and digits.
SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words_of(text: Column) -> Column:
    """The words of a text: runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. Null has none.

    Separators become spaces and the split is at single spaces, which takes an eighth of a regular expression's time.
    """
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + SEPARATORS, LOWER + " " * len(SEPARATORS))
    return F.array_remove(F.split(plain, " "), "")


def _shingle(words: Column, at: Column, m: int) -> Column:
    """A hash of ``m`` words from place ``at`` (from 0); null if they run over the end."""
    return F.when(at + m <= F.size(words), F.xxhash64(F.lit(m), *[F.get(words, at + i) for i in range(m)]))


def windows_of(items: DataFrame, window: int = WINDOW, text: str = "text", id_col: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """Distinct windows ``(window_id, words, len)`` and which items have them, ``(window_id, item_id)``.

    An item of at least ``window`` words has one window at each place; a shorter one is one window as a
    whole; one without words has none. The id of a window is a digest of its words.
    """
    w = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text)).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - window + 1))
    each = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("all", i, window))).alias("words"))
    each = written(each.withColumn("window_id", F.sha2(F.array_join("words", " "), 256)), "windows")
    return each.groupBy("window_id").agg(F.first("words").alias("words")).withColumn("len", F.size("words")), each.select("window_id", "item_id").distinct()


def _positions(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """``(id, print, all, at, shingle)`` for every place and shingle size; ``all`` is the document's words."""
    rows = docs.select("id", "print", words_of(F.col("text")).alias("all"))
    placed = rows.select("id", "print", "all", F.posexplode("all").alias("at", "word"))
    if len(sizes) == 1:
        return placed.withColumn("shingle", _shingle(F.col("all"), F.col("at"), sizes[0])).drop("word")
    return placed.withColumn("shingle", F.explode(F.array(*[_shingle(F.col("all"), F.col("at"), m) for m in sizes]))).drop("word")


def _index(docs: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """``(shingle, offset, window_id, words, len)``: each window under its shingle that is rarest in the documents, ties by hash and place."""
    m = F.least(F.lit(SHINGLE), F.col("len"))
    offsets = F.explode(F.sequence(F.lit(0), F.col("len") - m)).alias("offset")
    per = [windows.where(m == k).select("window_id", offsets, "words", "len").withColumn("shingle", _shingle(F.col("words"), F.col("offset"), k)) for k in sizes]
    shingles = per[0]
    for x in per[1:]:
        shingles = shingles.unionByName(x)
    shingles = written(shingles.drop("words"), "shingles")
    known = shingles.select("shingle").distinct()
    # the documents' side is counted by shingle before it would be shuffled
    seen = _positions(docs, sizes).select("shingle").join(small(known, BROADCAST_WINDOWS * 8), "shingle", "left_semi").groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    # a window with a shingle that no document has occurs nowhere
    rare = shingles.join(seen, "shingle", "left").groupBy("window_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0).cast("long")).alias("df"), F.col("shingle").alias("shingle"), F.col("offset").alias("offset"))).alias("r")).where("r.df > 0")
    return windows.join(rare, "window_id").select(F.col("r.shingle").alias("shingle"), F.col("r.offset").alias("offset"), "window_id", "words", "len")


def _met(docs: DataFrame, index: DataFrame, sizes: list[int], window: int) -> DataFrame:
    """``(id, print, begin, end, window_id)`` for every place where a window of the index occurs.

    With a small index a document's words never leave their task. Beyond the bound the places whose
    shingle the index has are shuffled, each with the words around it that a window over it can cover,
    never with the whole document.
    """
    begin, stop = F.col("at") - F.col("offset"), F.col("at") - F.col("offset") + F.col("len")
    named = ["id", "print", begin.alias("begin"), stop.alias("end"), "window_id"]
    placed = _positions(docs, sizes)
    if index.count() <= BROADCAST_WINDOWS:
        met = placed.join(F.broadcast(index), "shingle").where((begin >= 0) & (stop <= F.size("all")))
        return met.where(F.slice("all", F.greatest(begin, F.lit(0)) + 1, F.col("len")) == F.col("words")).select(*named)
    first = F.greatest(F.col("at") - (window - 1), F.lit(0))
    around = ["id", "print", "at", "shingle", F.size("all").alias("n"), first.alias("first"), F.slice("all", first + 1, 2 * window - 1).alias("around")]
    known = index.select("shingle").distinct()
    if known.count() <= BROADCAST_SHINGLES:
        placed = placed.join(F.broadcast(known), "shingle", "left_semi")
    met = placed.select(*around).join(index, "shingle").where((begin >= 0) & (stop <= F.col("n")))
    return met.where(F.slice("around", F.greatest(begin - F.col("first"), F.lit(0)) + 1, F.col("len")) == F.col("words")).select(*named)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``(<id>, n_words, n_hit, n_items, item_ids array<string>, contaminated)`` per row of ``docs``.

    A word is hit if any occurrence of any item's window covers it; ``n_hit`` counts such words and
    ``item_ids`` lists, sorted as strings, the items with a window that occurs. Null and empty texts
    have no words. Rows that repeat id and text get equal answers; items with equal texts are all
    listed; a null item id is left out of the list. Empty tables give no rows or no hits. Other columns
    are not read.

    The documents' words stay in the task that cuts them if the index of windows is small enough to be
    broadcast; else only places that a shingle of the index names go on, with the words around them. The hits of a document are
    gathered as a set of places, which its length bounds.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text)).alias("print"), F.col(text).alias("text"))
    windows, owners = windows_of(items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")), window)
    windows = written(windows, "distinct")
    sizes = sorted(min(SHINGLE, r["len"]) for r in windows.select(F.least("len", F.lit(SHINGLE)).alias("len")).distinct().collect()) or [SHINGLE]
    index = written(_index(rows, windows, sizes), "index")
    hits = written(_met(rows, index, sizes, window), "hits")
    spans = hits.groupBy("id", "print").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")),
        lambda acc, s: F.struct(F.greatest(acc["to"], s["end"]).alias("to"), (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["to"], s["begin"]))).alias("n")),
    )["n"]
    named = hits.select("id", "print", "window_id").distinct().join(owners, "window_id").where("item_id is not null").select("id", "print", F.col("item_id").cast("string").alias("item")).groupBy("id", "print").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    found = spans.select("id", "print", covered.cast("long").alias("n_hit")).join(named, (spans["id"].eqNullSafe(named["id"])) & (spans["print"].eqNullSafe(named["print"])), "left").select(spans["id"], spans["print"], "n_hit", "item_ids")
    found = written(found, "found")
    base = rows.select("id", "print", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    out = base.join(found, (base["id"].eqNullSafe(found["id"])) & (base["print"].eqNullSafe(found["print"])), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(base["id"].alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), (n_hit > 0).alias("contaminated"))
