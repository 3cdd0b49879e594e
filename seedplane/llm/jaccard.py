"""N-gram Jaccard join with adaptive multi-match prefixes, and the groups that its links form.

A document's set is its distinct word shingles (as 64-bit hashes). Documents of one set form a class and
are compared once. All shingles have one global order: rare ones first by hash, then the
frequent ones by their count over all documents (the most frequent ``KEPT`` are told to the tasks, a table
of bounded size; which ones are known changes cost, never results). Two sets whose
similarity reaches the threshold share at least l shingles of their l-prefixes, for any l; each class picks
the l whose longer prefix has the smallest estimated cost, and a pair needs as many shared prefix shingles
as the smaller of its two l before its whole sets are compared.

Groups need not try all pairs. A class that shares enough of its prefix is compared whole with one leader (of
the classes that have the fewest prefix shingles of their own, the one it shares most with); what links is
merged, and what differs in more than ``FAR`` of both sets has no leader. Two
followers of one leader are then told apart by what they differ from it in: near copies differ from their
draft in few shingles, most of them rare, so only pairs that share enough of those are compared. Classes of
different leaders and groups meet in the prefix lists. No link between groups is missed, while a group of
thousands of near copies costs a comparison each, linked or not. Frequent shingles' lists are split by salt.

Edge cases: null, empty and white-space texts have the empty set and link with nothing; fewer words than a
shingle count as one shingle; rows with a null id have no links; repeated rows are one class; rows of one id
with different texts are documents each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, small_batches, written
from .components import components
from .words import ngrams, words_of

WORDS = 4
PERCENT = 85
LEAST = 2
KEPT = 1 << 20
PART = 64
MOST_MATCHES = 16
VERIFY_COST = 8.0
RARE_PARTNERS = 0.02
#: Pairs of one class, and entries of one list, that a task takes at once.
HUB = 4096
LIST = 512
#: So many open followers of a leader are held against each other by size alone first.
CLOSE = 64
#: Rows of pairs (of a few numbers each) that go to all tasks at most.
TOLD = 1 << 17
#: A follower shares at least one in so many of its prefix entries with its leader, and differs from it in at most
#: this part of both sets; who does not has no leader and is met in the prefix lists.
SHARING = 8
FAR = 0.3
FILTER_BITS = 1 << 26


def shingles_of(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    return [np.unique(ngrams(h, words)) for h in words_of(texts)]


def fingerprint(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _texts(batch: pa.RecordBatch, column: int, words: int, size: int = 64) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for start in range(0, batch.num_rows, size):
        part = batch.slice(start, size)
        yield part, shingles_of(part.column(column).to_pylist(), words)


def frequent(rows: DataFrame, words: int, least: int = LEAST, kept: int = KEPT) -> tuple[np.ndarray, np.ndarray, int]:
    """(shingle prefix, count, bits cut off) of the most frequent shingles, as many counts downward as ``kept`` has room for, ``least`` at least.

    All rows' shingles are counted by their leading bits; they travel as sorted, packed runs.
    """
    buckets = 64
    n = rows.count()
    while buckets < n / 2000 and buckets < 1 << 20:
        buckets *= 2
    bits = buckets.bit_length() - 1
    cut = 32 - bits  # a shingle counts by its first bits + 32 bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        held: list[np.ndarray] = []
        size = 0

        def flush():
            x = np.sort(np.concatenate(held)) >> np.uint64(cut)
            ends = np.searchsorted(x >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
            b, blobs = [], []
            for i in range(buckets):
                run_ = (x[ends[i] : ends[i + 1]] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                if len(run_):
                    b.append(i)
                    blobs.append(packer.compress(np.diff(run_, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            for _, sets in _texts(batch, 0, words):
                held += sets
                size += sum(map(len, sets))
                if size > 500_000:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def count(table: pa.Table) -> pa.Table:
        unpacker = zstandard.ZstdDecompressor()
        runs = [np.cumsum(np.ascontiguousarray(np.frombuffer(unpacker.decompress(b), np.uint8).reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.uint32) for b in table["blob"].to_pylist()]
        x, c = np.unique(np.concatenate(runs), return_counts=True)
        x, c = x[c >= least], c[c >= least]
        return pa.table({"t": pa.array(x.astype(np.int64) + (table["bucket"][0].as_py() << 32), pa.int64()), "df": pa.array(c, pa.int64())})

    found = rows.select("text").mapInArrow(run, "bucket int, blob binary").groupBy("bucket").applyInArrow(count, "t long, df long")
    found = written(found, "counts")
    room, lowest = kept, None
    for r in found.groupBy(F.least("df", F.lit(1 << 16)).alias("df")).count().orderBy(F.desc("df")).collect():  # a row per count
        room -= r["count"]
        if room < 0:
            break
        lowest = r["df"]
    most = found.filter(F.col("df") >= lowest if lowest else F.lit(False)).toArrow()
    dropped(found)
    t, df = most["t"].to_numpy(), most["df"].to_numpy()
    order = np.argsort(t)
    return t[order].astype(np.uint64), df[order], cut


def prefix(hashes: np.ndarray, percent: int, heavy: tuple[np.ndarray, np.ndarray, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """(l, the l-prefix in global order, in how many parts each shingle's list is split) of a set."""
    t, df, cut = heavy
    n = len(hashes)
    counts = np.zeros(n, np.int64)
    if len(t) and n:
        x = hashes >> np.uint64(cut)
        at = np.minimum(np.searchsorted(t, x), len(t) - 1)
        counts = np.where(t[at] == x, df[at], 0)
    order = np.lexsort((hashes, counts))
    hashes, counts = hashes[order], counts[order]
    least = -(-percent * n // 100)
    most = min(MOST_MATCHES, least)
    partners = np.cumsum(np.where(counts > 0, counts, RARE_PARTNERS))
    ls = np.arange(1, most + 1)
    lengths = n - least + ls
    cost = lengths + VERIFY_COST * partners[lengths - 1] / ls
    best = int(ls[np.argmin(cost)])
    p = n - least + best
    return best, hashes[:p], np.maximum(1, -(-counts[:p] // PART))


def _signatures(rows: DataFrame, words: int, percent: int, heavy) -> DataFrame:
    """id, n, fp (of the set), l, prefix, parts of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _texts(batch, 1, words):
                signed = [prefix(s, percent, heavy) if len(s) else (0, s, np.zeros(0, np.int64)) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.binary()), pa.array([x[0] for x in signed], pa.int32()),
                        pa.array([x[1].view(np.int64) for x in signed], pa.list_(pa.int64())), pa.array([x[2].astype(np.int32) for x in signed], pa.list_(pa.int32())),
                    ],
                    names=["id", "n", "fp", "l", "prefix", "parts"],
                )

    return rows.mapInArrow(run, "id long, n long, fp binary, l int, prefix array<long>, parts array<int>")


def _sets(rows: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """rep, n, s (the whole set) and any other columns of the classes in wanted (id, fp, rep, ...).

    Rows surely not wanted are left out before the shuffle by a bitmap of fixed size over hashed ids.
    """
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    marks = wanted.select(spot("id").alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).toArrow()
    bitmap = {b: m for b, m in zip(marks["b"].to_pylist(), marks["m"].to_pylist(), strict=True)}
    near = rows.select("id", "text", F.bitmap_bucket_number(spot("id")).alias("b"), F.bitmap_bit_position(spot("id")).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [b in bitmap and bitmap[b][p >> 3] >> (p & 7) & 1 for b, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            batch = batch.filter(pa.array([bool(h) for h in hit], pa.bool_()))
            for part, sets in _texts(batch, 1, words):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([fingerprint(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                    names=["id", "fp", "n", "s"],
                )

    found = near.mapInArrow(run, "id long, fp binary, n long, s array<long>")
    return found.dropDuplicates(["id", "fp"]).join(wanted, ["id", "fp"]).drop("id", "fp")


def _told(few: DataFrame) -> DataFrame:
    """A narrow table for a join: to be told to all tasks if it has at most ``TOLD`` rows."""
    return F.broadcast(few) if few.limit(TOLD + 1).count() <= TOLD else few


def _dealt(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) with a ``part`` and ``parts``: a b of many pairs is dealt over several tasks."""
    often = pairs.groupBy("b").agg(F.ceil(F.count("*") / HUB).cast("int").alias("parts"))
    return pairs.join(often, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))


def _facing(dealt: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b, part, parts, n_a, s_a) with the other set: n_b, s_b."""
    hubs = _told(dealt.select("b", "parts").distinct())
    of_b = sets.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("s").alias("s_b")).join(hubs, "b").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return dealt.join(of_b, ["b", "part"])


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    shared = F.size(F.array_intersect("s_a", "s_b")).cast("long")
    of_a = sets.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("s").alias("s_a"))
    return _facing(_told(_dealt(pairs)).join(of_a, "a"), sets).filter(100 * shared >= percent * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b")


def _possible(percent: int) -> Column:
    """Whether a shared shingle at these places of the two orders leaves room for the overlap that a link needs.

    All common shingles before it are in both prefixes, so they are among the entries that other classes have
    too (``shared`` counts those); with itself and what comes after it on the shorter side they bound the overlap.
    """
    room = F.least("shared_a", "shared_b") + F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    return (100 + percent) * room >= percent * (F.col("n_a") + F.col("n_b"))


def groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) of every row; see the module's text."""
    small_batches(documents.sparkSession, 256)
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = written(_signatures(rows, words, percent, frequent(rows, words)), "signatures")
    full = signed.filter("n > 0 and id is not null")
    classes = written(full.groupBy("fp").agg(F.min("id").alias("id")).withColumn("rep", F.monotonically_increasing_id()), "classes")
    postings = written(_shared(full, classes, percent), "postings")

    led = written(_dealt(_leader_pairs(postings, percent)), "led")
    wanted = _ends(led).join(classes, "rep").join(led.withColumnRenamed("a", "rep"), "rep", "left")
    sets = written(_sets(rows, wanted, words), "sets")
    judged = written(_judged(sets, percent), "judged")
    dropped(led)
    labels = components(judged.filter("linked").select("a", "b"))

    named = judged.select(F.col("a").alias("rep"), F.col("b").alias("cluster"))
    placed = postings.join(named, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    placed = written(placed.withColumns({"cluster": F.coalesce("cluster", "rep"), "group": F.coalesce("label", "rep")}).drop("label"), "placed")
    dropped(postings)
    within = _pairs_within(judged, labels, percent)
    pairs = written(_pairs_across(placed, percent).unionByName(within), "pairs")
    for table in (placed, judged, within):
        dropped(table)
    more = written(_sets(rows, _ends(pairs).join(sets.select("rep"), "rep", "left_anti").join(classes, "rep"), words), "sets")
    links = written(_links(pairs, sets.select(*more.columns).unionByName(more), percent), "links")
    merged = components(links.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))

    of_class = classes.join(merged.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "id", F.coalesce("label", "rep").alias("group"))
    first = of_class.groupBy("group").agg(F.min("id").alias("component_id"))
    found = written(of_class.join(first, "group").select("fp", "component_id"), "groups")
    for table in (sets, labels, pairs, more, links, merged, classes):
        dropped(table)
    out = signed.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("fp")).alias("fp"))
    return out.join(found, "fp", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()


def _shared(full: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The classes' prefix entries (rep, n, l, pos, token, part, parts, shared, lone), without shingles that only one class has in its prefix.

    ``shared`` of the class's entries lie before this one; ``lone`` shingles of its prefix are left out.
    """
    each = full.groupBy("fp").agg(F.min(F.struct("n", "l", "prefix", "parts")).alias("c")).join(classes.select("fp", "rep"), "fp")
    listed = each.select("rep", F.col("c.n").cast("int").alias("n"), "c.l", F.posexplode(F.arrays_zip("c.prefix", "c.parts")).alias("pos", "x")).select("rep", "n", "l", "pos", F.col("x.prefix").alias("token"), F.col("x.parts").alias("parts"))
    salted = listed.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    counted = salted.withColumn("c", F.count("*").over(Window.partitionBy("token", "part")))
    kept = counted.filter("parts > 1 or c > 1").drop("c")
    of_class = Window.partitionBy("rep")
    length = F.col("n") - F.ceil(percent * F.col("n") / 100) + F.col("l")
    return kept.withColumns({"shared": F.row_number().over(of_class.orderBy("pos")) - 1, "lone": (length - F.count("*").over(of_class)).cast("int")})


def _leader_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """Each class (a) with the leader (b) that it shares most prefix entries with, if those are half as many as a link needs and one in ``SHARING`` of its prefix."""
    length = F.col("n") - F.ceil(percent * F.col("n") / 100) + F.col("l")
    # one order of classes for all lists, so that a group has few leaders: those with the fewest shingles of their own
    leaders = postings.groupBy("token").agg(F.min(F.struct("lone", "rep", "l")).alias("x"), F.max("parts").alias("parts"))
    leaders = leaders.select("token", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("x.rep").alias("b"), F.col("x.l").alias("l_b"))
    met = postings.select(F.col("rep").alias("a"), F.col("l").alias("l_a"), length.alias("length"), "token", "part").join(leaders, ["token", "part"]).filter("a <> b")
    pairs = met.groupBy("a", "b").agg(F.count("*").alias("m"), F.min(F.least("l_a", "l_b")).alias("l"), F.max("length").alias("length")).filter(f"2 * m >= l and {SHARING} * m >= length")
    return pairs.groupBy("a").agg(F.max_by("b", F.struct("m", "b")).alias("b"))


def _judged(sets: DataFrame, percent: int) -> DataFrame:
    """a, b, n, n_b, d (what a and its leader differ in), k (its size), excess, linked; of near ones, linked or not.

    Two sets of n and m shingles that differ in k are linked when (100 + percent) k <= (100 - percent) (n + m);
    ``excess`` is a's part of the difference of both sides, (100 + percent) k - (100 - percent) n.
    """
    d = F.concat(F.array_except("s_a", "s_b"), F.array_except("s_b", "s_a"))
    led = sets.filter("b is not null").withColumnsRenamed({"rep": "a", "n": "n_a", "s": "s_a"})
    rows = _facing(led, sets).select("a", "b", F.col("n_a").alias("n"), "n_b", d.alias("d")).withColumn("k", F.size("d").cast("long"))
    excess = (100 + percent) * F.col("k") - (100 - percent) * F.col("n")
    judged = rows.withColumn("excess", excess).withColumn("linked", F.col("excess") <= (100 - percent) * F.col("n_b"))
    return judged.filter(F.col("linked") | (F.col("k") <= FAR * (F.col("n") + F.col("n_b"))))


def _pairs_across(placed: DataFrame, percent: int) -> DataFrame:
    """All pairs of classes of different groups and clusters that share enough prefix entries.

    Two followers of one leader, and a follower with its leader, are left to _pairs_within and _judged.
    """
    largest = lambda c: placed.groupBy("token", c).agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", c)).alias(c), F.count("*").alias("kinds"), F.sum("c").alias("size")).filter("kinds > 1").drop("kinds")
    tops = largest("group").join(largest("cluster").drop("size"), "token")
    tops = tops.select("token", F.when(F.col("group.c") >= F.col("cluster.c"), F.col("group.group")).alias("top_group"), F.col("cluster.cluster").alias("top_cluster"), F.ceil(F.col("size") / LIST).cast("int").alias("parts"))
    live = placed.drop("parts", "part").join(tops, "token").withColumn("minor", F.coalesce(F.col("group") != F.col("top_group"), F.col("cluster") != F.col("top_cluster")))
    side = lambda s: live.select("token", F.col("rep").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "l", "pos", "shared", "group", "cluster", "minor")], "parts")
    few = side("a").filter("minor_a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "minor_a")
    every = side("b").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).drop("parts")
    apart = (F.col("group_a") != F.col("group_b")) & (F.col("cluster_a") != F.col("cluster_b")) & (F.col("cluster_a") != F.col("b")) & (F.col("cluster_b") != F.col("a"))
    met = few.join(every, ["token", "part"]).filter(apart & (~F.col("minor_b") | (F.col("a") < F.col("b"))) & _possible(percent))
    # which of a pair is the minor one differs from token to token
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("l_a", "l_b").alias("l"))
    return met.groupBy("a", "b").agg(F.count("*").alias("m"), F.min("l").alias("l")).filter("m >= l").select("a", "b")


def _pairs_within(judged: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of followers of one leader, of different groups, that what they differ from the leader in allows to be linked.

    With excess e and difference d, followers x and y are linked when 2 (100 + percent) |d_x & d_y| >= e_x + e_y. One
    of them is not linked with the leader, and no follower's excess is below the leader's own, so either knows how
    much of its difference must be common at least, and only that much less of it, rarest first, is looked up.
    """
    step, rest = 2 * (100 + percent), 100 - percent
    rows = judged.withColumns({"own": rest * F.col("n_b"), "top": F.col("excess") + 2 * rest * F.col("n")})
    clusters = rows.groupBy("b").agg(F.min(F.when(~F.col("linked"), F.col("excess"))).alias("low"), F.max(F.when(F.col("linked"), F.col("top"))).alias("high"), F.count_if(~F.col("linked")).alias("open")).filter("open > 0 and (open > 1 or low <= high)")
    # a pair's excesses and tops overlap, as at most all of the smaller difference is common
    near = rows.drop("d").join(clusters, "b")
    alone = near.filter(F.col("open").between(2, CLOSE) & ~F.col("linked")).select("a", "b", "n", "excess", "top")
    others = alone.select("b", *[F.col(c).alias(f"{c}_") for c in ("a", "n", "excess", "top")])
    fit = (F.col("a") != F.col("a_")) & (F.col("excess") <= F.col("top_")) & (F.col("excess_") <= F.col("top")) & (100 * F.least("n", "n_") >= percent * F.greatest("n", "n_"))
    paired = alone.join(others, "b").filter(fit).select("a").distinct().withColumn("paired", F.lit(True))
    open_ = F.coalesce(F.col("excess") <= F.col("high"), F.lit(False)) | (F.col("open") > CLOSE) | F.coalesce("paired", F.lit(False))
    live = near.join(paired, "a", "left").filter(F.when(F.col("linked"), F.col("top") >= F.col("low")).otherwise(open_))
    live = live.join(labels.withColumnRenamed("node", "a"), "a", "left").select("a", "b", F.coalesce("label", "a").alias("group"), "k", "excess", "own", "linked")
    live = written(live, "live")
    each = live.join(judged.select("a", "d"), "a").withColumn("token", F.explode("d")).drop("d")
    # what only one follower differs in is rarest and can't be common: it is counted and left out
    often = each.groupBy("b", "token").agg(F.count("*").alias("c")).filter("c > 1")
    of_one = Window.partitionBy("a")
    placed = each.join(often, ["b", "token"]).withColumn("pos", F.col("k") - F.count("*").over(of_one) + F.row_number().over(of_one.orderBy("c", "token")) - 1).drop("c")
    needed = lambda e: F.greatest(F.lit(1), F.ceil(e / step))
    placed = written(placed.filter(F.col("pos") <= F.col("k") - F.least(needed(F.col("excess") - F.col("own")), needed(F.col("excess") + F.col("own") + 1))), "differences")
    side = lambda s, e: placed.filter(F.col("pos") <= F.col("k") - needed(e)).select(F.col("b").alias("leader"), "token", F.col("a").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("group", "k", "excess", "pos", "linked")])
    asking = side("a", F.col("excess") - F.col("own")).filter("not linked_a")
    room = F.least("pos_a", "pos_b") + F.least(F.col("k_a") - F.col("pos_a"), F.col("k_b") - F.col("pos_b"))
    fits = (F.col("group_a") != F.col("group_b")) & (F.col("linked_b") | (F.col("a") < F.col("b"))) & (step * room >= F.col("excess_a") + F.col("excess_b"))
    met = asking.join(side("b", F.col("excess") + F.col("own") + 1), ["leader", "token"]).filter(fits)
    found = written(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "within")
    dropped(live)
    dropped(placed)
    return found
