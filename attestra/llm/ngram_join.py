"""Grouped prefix join on word n-gram sets under a Jaccard threshold.

A document is the set of its word n-grams. Under one order of all n-grams by rarity, two sets that are
similar enough share an n-gram of their prefixes. Sets with the same prefix and size are one group;
groups meet in an index on prefix n-grams, pairs of groups are filtered by size and position, and only
then expanded to members and verified on the whole sets.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import arrow_map, components, free, give_back, small, written

#: Words of an n-gram, and the least similarity in percent, unless a caller says otherwise.
WORDS, PERCENT = 5, 80
#: Words whose hashes a worker remembers before it forgets them all.
MEMO = 250_000
#: N-grams of all documents for each task and bucket, and the least number of buckets.
TASK_GRAMS, LEAST_BUCKETS = 1 << 20, 256
#: Documents that an n-gram must be in, by estimate, for it to pass by its bucket; one in how many texts the estimate is made on;
#: and the most such n-grams, which are sent to all tasks.
HOT, HOT_SAMPLE, MOST_HOT = 1 << 20, 64, 1 << 20
#: Pivots, of some 80 bytes, up to which they are broadcast.
BROADCAST_PIVOTS = 100_000
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


@functools.cache
def _memo() -> _Memo:
    """One for the life of the worker, as tasks and slices share most words."""
    return _Memo()


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * _M1
    z = (z ^ (z >> np.uint64(27))) * _M2
    return z ^ (z >> np.uint64(31))


def shingle_set(text: str | None, words: int, memo: dict) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's n-grams of words.

    A-Z is lower-cased and words are runs without ASCII white space, which is what bytes.lower and
    bytes.split do. Fewer words than ``words`` make one n-gram; no words make an empty set. Two n-grams
    that differ share a hash with a chance of 2**-64.
    """
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out * _M3 + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def set_key(s: np.ndarray) -> int:
    """64 bits that name a set, as a signed integer; 0 for the empty set."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else 0


def _keys(docs: DataFrame, words: int) -> DataFrame:
    """``(id, n, key)`` per row."""

    def run(b: pa.RecordBatch):
        memo = _memo()
        made = [(len(s), set_key(s)) for s in (shingle_set(t, words, memo) for t in b.column(1).to_pylist())]
        yield pa.record_batch([b.column(0), pa.array([n for n, _ in made], pa.int32()), pa.array([k for _, k in made], pa.int64())], ["id", "n", "key"])

    return arrow_map(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, n int, key long")


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before, with the end."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), len(new))


def _packed(outer: np.ndarray, cut: np.ndarray, sets: np.ndarray, keys: np.ndarray, sizes: np.ndarray, values: list[np.ndarray]) -> list[pa.Array]:
    """One Arrow row for each run of ``outer`` over the runs ``cut``: packed keys, sizes, counts and values."""
    first = outer[cut[:-1]]
    rows = _runs(first)
    starts = cut[rows]
    who = sets[cut[:-1]]
    k, n, c = keys[who].astype("<i8"), sizes[who].astype("<i4"), np.diff(cut).astype("<i4")
    part = lambda a, at: [a[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
    return [pa.array(first[rows[:-1]].astype(np.int64)), *[pa.array(x, pa.binary()) for x in (part(k, rows), part(n, rows), part(c, rows), *[part(v, starts) for v in values])]]


def _joined(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def hot_grams(docs: DataFrame, words: int, texts: int, grams: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams, sorted, that some HOT of the ``texts`` have, and how many have them, by an estimate.

    Which n-grams these are and in what order changes no result, as long as all tasks hold to the same;
    the estimate is made on texts picked by a hash. No more than MOST_HOT come to the driver: the bound
    on documents grows with the number of all ``grams``.
    """
    least = max(HOT, -(-grams // MOST_HOT))
    if texts < least:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def run(b: pa.RecordBatch):
        memo = _memo()
        got = [shingle_set(t, words, memo) for t in b.column(0).to_pylist()]
        kinds, n = np.unique(np.concatenate(got), return_counts=True) if got else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        yield pa.record_batch([pa.array(kinds.view(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])

    some = arrow_map(docs.where(F.pmod(F.xxhash64("text"), F.lit(HOT_SAMPLE)) == 0).select("text").distinct(), run, "gram long, n long")
    rows = some.groupBy("gram").agg((F.sum("n") * HOT_SAMPLE).alias("n")).where(F.col("n") >= least).collect()
    kinds = np.array([r["gram"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(kinds)
    return kinds[order], np.minimum(np.array([r["n"] for r in rows], np.int64), (1 << 31) - 1).astype(np.int32)[order]


def prefixes(docs: DataFrame, words: int, percent: int, texts: int, grams: int) -> DataFrame:
    """``(key, n, u, prefix array<long>)`` for each distinct set that may link with another; ``texts`` and ``grams`` are counts of all rows.

    ``u`` n-grams of the set occur in no other set; they are the rarest and come first in the prefix,
    but need not be told apart, as they meet nothing. ``prefix`` holds the rest of it, rarest first. A
    set whose whole prefix is such n-grams links with nothing and is left out.

    N-grams are dealt to buckets by their leading bits and sent as packed arrays, of 32 bits beyond the
    bucket's; that two may then be taken for one costs a needless candidate at most. A bucket sees each
    set once however many copies it has, counts exact document frequencies, and sends on only n-grams
    of two sets or more. An n-gram that very many sets have, which one bucket could not hold, goes with
    its set at once, with an estimate for its count: any order will do that is the same for all sets.
    The numbers of buckets and tasks grow with the n-grams.
    """
    tasks = max(1, -(-grams // TASK_GRAMS))
    bits = min(24, max(LEAST_BUCKETS - 1, tasks - 1).bit_length())
    tasks = min(tasks, 1 << bits)
    owners = 1 << max(8, bits)
    kinds, often = hot_grams(docs, words, texts, grams)
    # an n-gram is known by its bucket and 32 bits more; those taken for one have one count
    kinds, place = np.unique(kinds >> np.uint64(32 - bits), return_inverse=True)
    most = np.zeros(len(kinds), np.int32)
    np.maximum.at(most, place, often)
    hot = docs.sparkSession.sparkContext.broadcast((kinds, most))

    def to_owners(top, who, low, df, keys, sizes):
        """Rows for the sets' owners of n-grams whose buckets are ``top``."""
        owner = (keys[who] & (owners - 1)).astype(np.int64)
        order = np.lexsort((who, owner, top))
        top, owner, who, low, df = top[order], owner[order], who[order], low[order], df[order]
        cuts = _runs(top)
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            own, *cols = _packed(owner[i:j], _runs(owner[i:j], who[i:j]), who[i:j], keys, sizes, [low[i:j], df[i:j]])
            yield pa.record_batch([pa.array(np.full(len(own), top[i])), *cols, own], ["bucket", "keys", "sizes", "counts", "grams", "df", "owner"])

    def deal(b: pa.RecordBatch):
        memo = _memo()
        sets: dict[int, np.ndarray] = {}
        for t in b.column(0).to_pylist():
            s = shingle_set(t, words, memo)
            if len(s) * (100 - percent) >= percent:
                sets[set_key(s)] = s
        if not sets:
            return
        keys, sizes = np.array(list(sets), np.int64), np.array([len(s) for s in sets.values()])
        grams = np.concatenate(list(sets.values()))
        who = np.repeat(np.arange(len(keys)), sizes)
        kinds, counts = hot.value
        if len(kinds):
            known = grams >> np.uint64(32 - bits)
            at = np.minimum(np.searchsorted(kinds, known), len(kinds) - 1)
            mine = kinds[at] == known
            top, low = (grams[mine] >> np.uint64(64 - bits)).astype(np.int64), ((grams[mine] >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype("<u4")
            for part in to_owners(top, who[mine], low, counts[at[mine]].astype("<i4"), keys, sizes):
                yield part
            grams, who = grams[~mine], who[~mine]
            if not len(grams):
                return
        bucket = (grams >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
        order = np.argsort(bucket, kind="stable")
        bucket, who = bucket[order], who[order]
        low = ((grams[order] >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype("<u4")
        cols = _packed(bucket, _runs(bucket, who), who, keys, sizes, [low])
        yield pa.record_batch([*cols, pa.nulls(len(cols[0]), pa.binary()), pa.nulls(len(cols[0]), pa.int64())], ["bucket", "keys", "sizes", "counts", "grams", "df", "owner"])

    def count(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        keys, sizes, counts, grams = (_joined(t, c, k) for c, k in (("keys", "<i8"), ("sizes", "<i4"), ("counts", "<i4"), ("grams", "<u4")))
        _, firsts = np.unique(keys, return_index=True)
        seen = np.zeros(len(keys), bool)
        seen[firsts] = True
        mine = np.repeat(seen, counts)
        who, grams = np.repeat(np.arange(len(keys)), counts)[mine], grams[mine]
        order = np.argsort(grams)
        grams, who = grams[order], who[order]
        cut = _runs(grams)
        df = np.repeat(np.diff(cut), np.diff(cut))
        many = df > 1
        grams, who, df = grams[many], who[many], df[many].astype("<i4")
        owner = (keys[who] & (owners - 1)).astype(np.int64)
        order = np.lexsort((who, owner))
        owner, who, grams, df = owner[order], who[order], grams[order], df[order]
        cols = _packed(owner, _runs(owner, who), who, keys, sizes, [grams.astype("<u4"), df])
        give_back()
        return pa.table([*cols, pa.array(np.full(len(cols[0]), bucket), pa.int64())], ["owner", "keys", "sizes", "counts", "grams", "df", "bucket"])

    def choose(t: pa.Table) -> pa.Table:
        keys, sizes, counts, grams, df = (_joined(t, c, k) for c, k in (("keys", "<i8"), ("sizes", "<i4"), ("counts", "<i4"), ("grams", "<u4"), ("df", "<i4")))
        runs = np.array([len(x) // 8 for x in t.column("keys").to_pylist()])
        bucket, past = (np.repeat(t.column(c).to_numpy(zero_copy_only=False), runs) for c in ("bucket", "past"))
        # of n-grams that passed by their bucket, a set with copies may have sent those of a bucket more than once
        again = np.flatnonzero(past)
        again = again[np.lexsort((bucket[again], keys[again]))]
        again = again[1:][(keys[again][1:] == keys[again][:-1]) & (bucket[again][1:] == bucket[again][:-1])]
        first = np.ones(len(keys), bool)
        first[again] = False
        mine = np.repeat(first, counts)
        grams, df = grams[mine], df[mine]
        keys, sizes, bucket, counts = keys[first], sizes[first], bucket[first], counts[first]
        gram = (np.repeat(bucket, counts) << 32) | grams.astype(np.int64)
        own, where, inverse = np.unique(keys, return_index=True, return_inverse=True)
        who = np.repeat(inverse, counts)
        order = np.lexsort((gram, df, who))
        who, gram = who[order], gram[order]
        n = sizes[where].astype(np.int64)
        known = np.bincount(who, minlength=len(own))
        u = n - known
        take = n - (percent * n + 99) // 100 + 1 - u
        place = np.arange(len(who)) - np.repeat(np.cumsum(known) - known, known)
        kept = place < np.repeat(take, known)
        some = take > 0
        ends = np.cumsum(np.bincount(who[kept], minlength=len(own))[some])
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(gram[kept]))
        return pa.table([pa.array(own[some]), pa.array(n[some].astype(np.int32)), pa.array(u[some].astype(np.int32)), lists], ["key", "n", "u", "prefix"])

    dealt = arrow_map(docs.select("text"), deal, "bucket long, keys binary, sizes binary, counts binary, grams binary, df binary, owner long")
    if len(kinds):
        dealt = written(dealt, "dealt")
    plain = dealt.where("owner is null").select("bucket", "keys", "sizes", "counts", "grams")
    counted = plain.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(count, "owner long, keys binary, sizes binary, counts binary, grams binary, df binary, bucket long")
    counted = counted.withColumn("past", F.lit(False))
    if len(kinds):
        counted = counted.unionByName(dealt.where("owner is not null").withColumn("past", F.lit(True)))
    return counted.repartition(tasks, "owner").groupBy("owner").applyInArrow(choose, "key long, n int, u int, prefix array<long>")


def _may_overlap(x: str, y: str, percent: int) -> Column:
    """The size bound, and the positional bound at a shared n-gram, for rows with n, u and at (the place, less the u before it).

    Before it two sets share at most the shorter head, without the n-grams that only one set has; after
    it the shorter tail.
    """
    n1, u1, at1, n2, u2, at2 = (F.col(f"{t}.{c}") for t in (x, y) for c in ("n", "u", "at"))
    sizes = 100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)
    reach = F.least(at1, at2) + 1 + F.least(n1 - u1 - at1 - 1, n2 - u2 - at2 - 1)
    return sizes & ((100 + percent) * reach >= percent * (n1 + n2))


def similar_sets(docs: DataFrame, keys: DataFrame, words: int, percent: int) -> DataFrame:
    """``(key, comp)``: for each set that links with another, the smallest key reachable by links.

    First each group's members are compared with the group's first, and each bucket's groups with its
    most central group of the same size band (that with the smallest share of n-grams of its own).
    That takes comparisons in proportion to the index and joins most of a large cluster. Then all
    pairs of groups that pass the filters are expanded to members that are in different components so
    far, and verified: a pair inside one component would change nothing, and all others are checked.
    """
    texts, grams = keys.agg(F.count(F.lit(1)), F.sum("n")).first()
    pre = written(prefixes(docs, words, percent, texts, grams or 0), "prefixes")
    ident = F.when(F.col("u") == 0, F.xxhash64("n", "prefix")).otherwise(F.col("key"))
    named = pre.withColumn("name", ident)
    # a group is named by its smallest member; its prefix is the same for all of them
    # only sets with a shared prefix may be of one group; what a key is joined with is written first, so that Spark can split a hot one
    both = named.where("u = 0").groupBy("name").agg(F.min("key").alias("gid"), F.count(F.lit(1)).alias("size"))
    both = written(both.where("size > 1").select(F.col("name").alias("of"), "gid"), "firsts")
    mine = (F.col("u") == 0) & (F.col("name") == F.col("of"))
    members = written(named.join(small(both), mine, "left").select("key", F.coalesce("gid", "key").alias("gid"), "n", "u", "prefix"), "members")
    index = members.where("key = gid").select("gid", "n", "u", F.posexplode("prefix").alias("at", "gram"))
    busy = written(index.groupBy("gram").agg(F.count(F.lit(1)).alias("entries")).where("entries > 1").select("gram"), "busy")
    index = written(index.join(small(busy), "gram", "left_semi"), "index")
    groups = members.groupBy("gid").agg(F.count(F.lit(1)).alias("size"))
    alive = written(index.select("gid").unionByName(groups.where("size > 1").select("gid")).distinct(), "alive")
    wanted = written(members.join(small(alive), "gid", "left_semi").select("key", "gid", "n"), "wanted")
    sets = written(_fetch(docs, keys, wanted, words), "sets")

    band = F.floor(F.log(F.col("n")) / -math.log(percent / 100)) if percent < 100 else F.col("n")
    banded = index.withColumn("band", band)
    pivots = written(banded.groupBy("gram", "band").agg(F.min(F.struct((F.col("u") / F.col("n")).alias("far"), F.col("gid").alias("gid"), F.col("n").alias("n"), F.col("u").alias("u"), F.col("at").alias("at"))).alias("p")), "pivots")
    star = banded.alias("x").join(small(pivots, BROADCAST_PIVOTS), ["gram", "band"]).where((F.col("gid") != F.col("p.gid")) & _may_overlap("x", "p", percent)).select(F.col("p.gid").alias("a"), F.col("gid").alias("b"))
    inner = wanted.where("key <> gid").select(F.col("gid").alias("a"), F.col("key").alias("b"))
    links = written(_verified(star.distinct().unionByName(inner), sets, percent), "links")
    comps = components(wanted.select(F.col("key").alias("node")), links, "comps")

    placed = wanted.join(comps, wanted["key"] == comps["node"]).select("key", "gid", "n", "comp")
    spread = placed.groupBy("gid").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    spread = written(spread, "spread")
    full = index.join(small(spread), "gid")
    split = written(full.groupBy("gram").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l <> h").select("gram"), "split")
    lists = members.where("key = gid").select("gid", "prefix")
    rest = written(full.join(small(split), "gram", "left_semi").join(lists, "gid"), "rest")
    x, y = rest.alias("x"), rest.alias("y")
    apart = ~((F.col("x.low") == F.col("x.high")) & (F.col("y.low") == F.col("y.high")) & (F.col("x.low") == F.col("y.low")))
    # a pair meets at its first shared n-gram only
    once = F.element_at(F.array_intersect("x.prefix", "y.prefix"), 1) == F.col("x.gram")
    met = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.gid") < F.col("y.gid")) & apart & _may_overlap("x", "y", percent) & once)
    pairs = met.select(F.col("x.gid").alias("g"), F.col("y.gid").alias("h"))
    pairs = written(pairs.unionByName(spread.where("low <> high").select(F.col("gid").alias("g"), F.col("gid").alias("h"))), "pairs")
    if not pairs.limit(1).count():
        return comps.select(F.col("node").alias("key"), "comp")
    p1 = placed.select(F.col("gid").alias("g"), F.col("key").alias("a"), F.col("comp").alias("ca"))
    p2 = placed.select(F.col("gid").alias("h"), F.col("key").alias("b"), F.col("comp").alias("cb"))
    opened = pairs.join(p1, "g").join(p2, "h").where((F.col("ca") != F.col("cb")) & ((F.col("g") != F.col("h")) | (F.col("a") < F.col("b")))).select("a", "b")
    more = written(_verified(opened, sets, percent).join(comps.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a").join(comps.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "more")
    if not more.limit(1).count():
        return comps.select(F.col("node").alias("key"), "comp")
    top = components(more.select(F.col("a").alias("node")).unionByName(more.select(F.col("b").alias("node"))).distinct(), more, "tops")
    free(docs.sparkSession, pre, members, rest, links)
    return comps.join(top.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select(F.col("node").alias("key"), F.coalesce("to", "comp").alias("comp"))


def _fetch(docs: DataFrame, keys: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``(key, n, grams array<long>)`` of the wanted sets, made again from one document of each."""
    one = keys.join(small(wanted.select("key")), "key", "left_semi").groupBy("key").agg(F.min("id").alias("id")).select("id").distinct()
    one = written(one, "fetch")

    def run(b: pa.RecordBatch):
        memo = _memo()
        sets = [shingle_set(t, words, memo) for t in b.column(0).to_pylist()]
        yield pa.record_batch([pa.array([set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["key", "n", "grams"])

    some = docs.join(small(one), docs["id"].eqNullSafe(one["id"]), "left_semi").select("text")
    made = arrow_map(some, run, "key long, n int, grams array<long>")
    return made.join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose whole sets are similar enough."""
    a = sets.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("grams").alias("ga"))
    b = sets.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("gb"))
    both = pairs.join(b, "b").join(a, "a")
    shared = F.size(F.array_intersect("ga", "gb"))
    return both.where((100 + percent) * shared >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(<id>, n_shingles long, component_id)`` per row of ``docs``.

    ``n_shingles`` is the size of the row's set of ``words``-word n-grams; ``component_id`` the smallest
    id reachable over links, itself included; two rows link when 100 * intersection >= percent * union.
    A null or empty text, or one of white space, has an empty set and links with nothing. Repeated rows
    and rows with equal sets are linked; an empty table gives an empty result. A null id counts as
    larger than any other. Texts of any length are read whole. Other columns are not read, whatever their
    names.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    keys = written(_keys(rows, words), "keys")
    comps = similar_sets(rows, keys, words, percent)
    by_set = keys.where("n > 0").groupBy("key").agg(F.min("id").alias("least")).join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    by_set = written(by_set, "bysets")
    named = written(by_set.groupBy("comp").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("sets")).where("sets > 1").select("comp", "component_id"), "named")
    answer = written(by_set.join(small(named), "comp", "left").select("key", F.coalesce("component_id", "least").alias("component_id")), "answer")
    out = keys.join(answer, "key", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
