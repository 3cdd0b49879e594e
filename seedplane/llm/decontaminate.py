"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

Texts become lower-cased letter-and-digit words, as 64-bit hashes. Fixed masks pick some of the words in a
short span and ignore the others, so a seed survives substitutions at the ignored places. The benchmark's
seeds (hash -> item, offset) are joined with every document's seeds at every position; around each hit, the
item is laid over the document on that diagonal and the equal words are marked. The marks of the best
diagonal and those under the seeds of all diagonals near by are united, so that words put in or left out
do not end a passage. A document overlaps an item when the marked words make up at least ``OVERLAP`` of the
item's words, or when ``PASSAGE`` of any ``WINDOW`` consecutive words of the item are marked.

Documents are cut into blocks with margins as wide as an item segment, so a very long text is many rows and
no row outgrows a block; longer items are cut into segments, whose marks (one bit a word) are read as one row of words. The seeds go to all
tasks only while they number at most ``BROADCAST_SEEDS``; beyond that Spark joins them by shuffle, with rows of
a hash and a place, and the words of a block are written once and read for the hits only. Hits are
reduced to one set of marks per document, item, segment and place before they are shuffled.

Edge cases: null or empty texts overlap with nothing; items shorter than a mask are matched whole, as exact
runs of words; items of fewer than ``LEAST`` words are left out; repeated rows of an id count as that id; an empty table on
either side gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: 1: the word counts, 0: it is ignored.
MASKS = ("1101101", "11100101", "10110011")
SPAN = max(map(len, MASKS))
OVERLAP = 0.6
#: So many equal words in so many consecutive words of an item are a leaked passage, whatever the item's length.
PASSAGE, WINDOW = 13, 20
#: Diagonals at most so many words apart are one passage with insertions or deletions.
NEAR = 64
SEGMENT = 64
#: Items of fewer words are too common to tell a leak by.
LEAST = 3
STRIDE = 256
BROADCAST_SEEDS = 1 << 18


def words_of(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds_at(words: Column, at: Column, size: Column) -> Column:
    """Array of (mask, hash) seeds of the words from position ``at`` (0-based); null where a mask doesn't fit."""
    made = []
    for k, mask in enumerate(MASKS):
        picked = [F.get(words, at + i) for i, c in enumerate(mask) if c == "1"]
        made.append(F.when(at + len(mask) <= size, F.xxhash64(F.lit(k), *picked)))
    # an item too short for a mask: its whole run
    return F.array(*made)


def _short(words: Column, at: Column, n: int) -> Column:
    return F.xxhash64(F.lit(-n), *[F.get(words, at + i) for i in range(n)])


def _segments(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, item_words (how many), step (words from segment to segment), seg, words (of the segment), size.

    Long items are cut evenly, so no segment is a short rest.
    """
    rows = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col).cast("string")).alias("w")).filter(F.size("w") >= LEAST)
    n = F.ceil(F.size("w") / SEGMENT).cast("int")
    rows = rows.select("item_id", F.size("w").alias("item_words"), "w", F.ceil(F.size("w") / n).cast("int").alias("step"), F.explode(F.sequence(F.lit(0), n - 1)).alias("seg"))
    return rows.select("item_id", "item_words", "step", "seg", F.slice("w", F.col("seg") * F.col("step") + 1, F.col("step")).alias("words")).withColumn("size", F.size("words"))


def _seeds(segments: DataFrame) -> DataFrame:
    """h, item_id, seg, offset."""
    each = segments.select("item_id", "seg", "words", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("offset"))
    long = each.select("item_id", "seg", "offset", F.explode(seeds_at(F.col("words"), F.col("offset"), F.col("size"))).alias("h")).filter("h is not null")
    short = segments.filter(F.col("size") < SPAN).select("item_id", "seg", F.lit(0).alias("offset"), _by_length(F.col("words"), F.lit(0), F.col("size")).alias("h"))
    return long.unionByName(short)


def _by_length(words: Column, at: Column, size: Column) -> Column:
    out = F.lit(None).cast("long")
    for n in range(1, SPAN):
        out = F.when(size == n, _short(words, at, n)).otherwise(out)
    return out


def _most_in_a_window(covered: Column, following: Column, step: Column) -> Column:
    """The most covered words in any ``WINDOW`` words of an item that begin in a segment of ``step``; ``following``: the next segment's."""
    ones = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1
    own = lambda i: F.bit_count(F.call_function("shiftrightunsigned", covered, i).bitwiseAND(F.lit((1 << WINDOW) - 1).cast("long")))
    over = lambda i: F.bit_count(following.bitwiseAND(ones(F.greatest(F.lit(0), i + WINDOW - step))))
    return F.array_max(F.transform(F.sequence(F.lit(0), step - 1), lambda i: own(i) + over(i)))


def overlaps(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", overlap: float = OVERLAP, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """doc_id, item_id, matched, item_words, share of every document and item that overlap."""
    segments = _segments(items, item_id_col, item_text_col)
    seeds = _seeds(segments)
    small = seeds.limit(broadcast_seeds + 1).count() <= broadcast_seeds
    near = F.broadcast if small else (lambda df: df)
    lengths = sorted(r[0] for r in segments.filter(F.col("size") < SPAN).select("size").distinct().collect())

    margin = SEGMENT
    rows = documents.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col).cast("string")).alias("w"))
    starts = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.floor((F.size("w") - 1) / STRIDE).cast("int")))
    # outer: else the optimizer infers a filter that splits every text a second time
    blocks = rows.select("doc_id", "w", F.explode_outer(starts).alias("k")).filter("k is not null")
    first = F.greatest(F.lit(0), F.col("k") * STRIDE - margin)
    blocks = blocks.select("doc_id", F.slice("w", first + 1, F.col("k") * STRIDE - first + STRIDE + margin).alias("b"), (F.col("k") * STRIDE - first).alias("lead"), first.alias("base"))
    places = F.sequence(F.col("lead"), F.least(F.col("lead") + STRIDE, F.size("b")) - 1)
    if not small:  # what is shuffled to the seeds is narrow; the words come back for the hits
        blocks = written(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
    spots = blocks.select(*(["doc_id", "b", "base"] if small else ["block", "b"]), F.explode(places).alias("at"))
    kinds = seeds_at(F.col("b"), F.col("at"), F.size("b"))
    if lengths:
        kinds = F.concat(kinds, F.array(*[F.when(F.col("at") + n <= F.size("b"), _short(F.col("b"), F.col("at"), n)) for n in lengths]))
    spots = spots.select(*(["doc_id", "b", "base"] if small else ["block"]), "at", F.explode(kinds).alias("h"))
    hits = spots.join(near(seeds), "h")
    if not small:
        hits = hits.join(blocks.drop("lead"), "block")
    hits = hits.join(near(segments), ["item_id", "seg"])
    start = F.col("at") - F.col("offset")
    cut = F.greatest(F.lit(0), -start)  # words of the segment that lie before the block
    pairs = F.zip_with(F.slice("b", F.greatest(F.lit(0), start) + 1, F.col("size")), F.slice("words", cut + 1, F.col("size")), lambda x, y: (x == y))
    bits = F.transform(pairs, lambda same, i: F.when(same, F.call_function("shiftleft", F.lit(1).cast("long"), i + cut)).otherwise(F.lit(0).cast("long")))
    equal = F.aggregate(bits, F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))
    around = F.call_function("shiftleft", F.lit((1 << SPAN) - 1).cast("long"), F.col("offset"))
    diagonal = F.floor((F.col("base") + start - F.col("seg") * F.col("step")) / NEAR).cast("long")
    # diagonals at most NEAR apart share one of two places; null: the segments' best ones, wherever they are
    laid = hits.select("doc_id", "item_id", "seg", "item_words", "step", equal.alias("equal"), around.alias("around"), F.explode(F.array(diagonal, diagonal + 1, F.lit(None).cast("long"))).alias("place"))
    near_by = F.when(F.col("place").isNotNull(), F.col("equal").bitwiseAND(F.col("around"))).otherwise(F.lit(0).cast("long"))
    best = laid.groupBy("doc_id", "item_id", "place", "seg").agg(F.bit_or(near_by).alias("near"), F.max(F.struct(F.bit_count("equal").alias("n"), "equal")).alias("best"), F.first("item_words").alias("item_words"), F.first("step").alias("step"))
    best = best.withColumn("covered", F.col("near").bitwiseOR(F.col("best.equal")))
    following = Window.partitionBy("doc_id", "item_id", "place").orderBy("seg")
    best = best.withColumn("next", F.when(F.lead("seg").over(following) == F.col("seg") + 1, F.lead("covered").over(following)).otherwise(F.lit(0).cast("long")))
    passage = F.when(F.col("place").isNotNull() & (F.bit_count("covered") + F.bit_count("next") >= PASSAGE), _most_in_a_window(F.col("covered"), F.col("next"), F.col("step"))).otherwise(F.lit(0))
    at_places = best.groupBy("doc_id", "item_id", "place").agg(F.sum(F.bit_count("covered")).cast("long").alias("matched"), F.max(passage).alias("passage"), F.first("item_words").cast("long").alias("item_words"))
    found = at_places.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.first("item_words").alias("item_words"), F.max("passage").alias("passage"))
    found = found.withColumn("share", F.col("matched") / F.col("item_words")).filter((F.col("share") >= overlap) | (F.col("passage") >= PASSAGE))
    return found.drop("passage")


def without_overlaps(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The documents that overlap with no item."""
    found = overlaps(documents, items, id_col, **how).select(F.col("doc_id").alias(id_col)).distinct()
    return documents.join(found, id_col, "left_anti").select(*documents.columns)
