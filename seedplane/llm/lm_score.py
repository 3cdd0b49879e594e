"""LM scores by stupid backoff, computed as joins with n-gram count tables that are partitioned by hash.

Documents are laid in blocks of bounded size. Every block's distinct n-grams of each order, with their
counts, go to the hash partition that owns them; each partition adds up its part of the count table over
the whole corpus and answers every block with the totals of the n-grams it asked for; blocks and answers
meet again, and every document's words are scored and summed. A frequent n-gram is one entry per block,
not a row per occurrence, so no key is hot, and the volume is that of distinct n-grams per block. The blocks are
written once, in buckets, so that only the answers are shuffled to meet them.

The model that scores a document is the corpus without the document itself: its own counts are taken off
the totals, else every n-gram would be known. With c the remaining counts and N the remaining words,
S(w | history) = c(history w) / c(history) if c(history w) > 0, else ``BACKOFF`` times S with a history one
word shorter; at the end of the chain S(w) = c(w) / N if c(w) > 0, else ``BACKOFF`` / (N + 1). The first
words of a text have the histories they have. N-grams are told apart by 64-bit hashes: the
leading bits name the partition, the others are shipped whole.

Edge cases: null, empty and white-space texts have no words and a score of 0 with a null mean; a text shorter
than an n-gram has none of that order; repeated rows are documents each (and predict each other); an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, dropped, small_batches, written
from .words import ngrams, words_of

ORDER = 3
BACKOFF = 0.4
BLOCK_BYTES = 8 << 20


def _pack(x: np.ndarray) -> bytes:
    """Sorted or small unsigned numbers, byte plane by byte plane."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _pack_rising(x: np.ndarray) -> bytes:
    """Rising numbers as their steps: the bits that vary evenly as they are, the few above them compressed."""
    steps = np.diff(x.astype("<u8"), prepend=np.uint64(0))
    bits = max(0, int(steps.astype(float).mean()).bit_length() - 1) if len(x) else 0
    whole, rest = divmod(bits, 8)
    planes = steps.view(np.uint8).reshape(-1, 8)
    odd = ((steps >> np.uint64(8 * whole)) & np.uint64((1 << rest) - 1)).astype(np.uint8)
    odd = np.packbits(np.unpackbits(odd[:, None], axis=1)[:, 8 - rest :])
    return struct.pack("<BI", bits, len(x)) + planes[:, :whole].tobytes() + odd.tobytes() + _pack(steps >> np.uint64(bits))


def _unpack_rising(blob: bytes) -> np.ndarray:
    bits, n = struct.unpack_from("<BI", blob)
    whole, rest = divmod(bits, 8)
    at, end = 5 + n * whole, 5 + n * whole + (n * rest + 7) // 8
    steps = _unpack(blob[end:]) << np.uint64(bits)
    planes = np.zeros((n, 8), np.uint8)
    planes[:, :whole] = np.frombuffer(blob, np.uint8, n * whole, 5).reshape(n, whole)
    steps |= planes.view("<u8").ravel()
    if rest:
        odd = np.zeros((n, 8), np.uint8)
        odd[:, 8 - rest :] = np.unpackbits(np.frombuffer(blob, np.uint8, end - at, at))[: n * rest].reshape(n, rest)
        steps |= np.packbits(odd, axis=1).ravel().astype(np.uint64) << np.uint64(8 * whole)
    return np.cumsum(steps, dtype=np.uint64)


def _blocks(documents: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """block, n_words, blob: documents (id, text) as a compressed Arrow stream."""
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush():
            table = pa.Table.from_batches(held)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as w:
                w.write_table(table)
            n = sum(len(h) for h in words_of(table["text"].to_pylist()))
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([n], pa.int64()), pa.array([zstandard.ZstdCompressor(level=6).compress(sink.getvalue())], pa.binary())], names=["block", "n_words", "blob"])

        for batch in batches:
            lengths = np.cumsum(np.asarray(pa.compute.binary_length(batch.column(1)), np.int64))
            at, done = 0, 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(lengths, done + block_bytes - size, "right")))
                end = min(end, batch.num_rows)
                held.append(batch.slice(at, end - at))
                size += int(lengths[end - 1]) - done
                at, done = end, int(lengths[end - 1])
                if size >= block_bytes or (at < batch.num_rows):
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    import pyarrow.compute  # noqa: F401

    return rows.mapInArrow(run, "block string, n_words long, blob binary")


def _documents(blob: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob, max_output_size=1 << 31)).read_all()
    return table["id"].to_pylist(), words_of(table["text"].to_pylist())


def _grams(docs: list[np.ndarray], order: int) -> list[np.ndarray]:
    """Each document's n-grams of an order; none where the text is shorter."""
    return [ngrams(h, order) if len(h) >= order else np.empty(0, np.uint64) for h in docs]


def score_block(docs: list[np.ndarray], known: list[tuple[np.ndarray, np.ndarray]], total: int, backoff: float) -> list[float]:
    """Sum of ln S of each document; known: per order, for all places of the block in a row, the n-gram's number and its corpus count."""
    out = []
    ends = [np.cumsum([0] + [max(0, len(h) - k) for h in docs]) for k in range(len(known))]
    for at, h in enumerate(docs):
        n = len(h)
        if not n:
            out.append(0.0)
            continue
        rest = max(0, total - n)
        counts = []  # per order: the count, without the document, of the n-gram that starts at each place
        for (number, count), end in zip(known, ends, strict=True):
            g, c = number[end[at] : end[at + 1]], count[end[at] : end[at + 1]]
            order = np.argsort(g, kind="stable")
            same = np.flatnonzero(np.r_[True, np.diff(g[order]) != 0, True]) if len(g) else np.zeros(1, np.int64)
            own = np.empty(len(g), np.int64)
            own[order] = np.repeat(np.diff(same), np.diff(same))
            counts.append(c - own)
        uni = counts[0]
        s = np.log(np.where(uni > 0, uni, backoff) / np.where(uni > 0, max(rest, 1), rest + 1))
        for order in range(2, len(known) + 1):
            c = counts[order - 1]
            if not len(c):
                break
            history = counts[order - 2][: len(c)]
            s[order - 1 :] = np.where(c > 0, np.log(np.maximum(c, 1) / np.maximum(history, 1)), np.log(backoff) + s[order - 1 :])
        out.append(float(s.sum()))
    return out


def scores(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, log_score (sum of ln S), mean_log_score of every row."""
    small_batches(documents.sparkSession)
    blocks = bucketed(_blocks(documents, id_col, text_col, block_bytes), "block", "lm_blocks")
    n_blocks, total = blocks.agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    buckets = 64
    while buckets < n_blocks and buckets < 1 << 20:
        buckets *= 2
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, docs = _documents(blob)
                for k in range(1, order + 1):
                    grams = _grams(docs, k)
                    u, c = np.unique(np.concatenate(grams) if grams else np.empty(0, np.uint64), return_counts=True)
                    ends = np.searchsorted(u >> shift, np.arange(buckets + 1, dtype=np.uint64))
                    rows = [i for i in range(buckets) if ends[i + 1] > ends[i]]
                    low = u & ((np.uint64(1) << shift) - np.uint64(1))
                    keys = [_pack_rising(low[ends[i] : ends[i + 1]]) for i in rows]
                    times = [_pack(c[ends[i] : ends[i + 1]]) for i in rows]
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.string()), pa.array([k] * len(rows), pa.int32()), pa.array(rows, pa.int32()), pa.array(keys, pa.binary()), pa.array(times, pa.binary())], names=["block", "k", "bucket", "grams", "times"])

    def answer(table: pa.Table) -> pa.Table:
        asked = [_unpack_rising(b) for b in table["grams"].to_pylist()]
        times = np.concatenate([_unpack(b) for b in table["times"].to_pylist()])
        _, inverse = np.unique(np.concatenate(asked), return_inverse=True)
        totals = np.bincount(inverse, weights=times.astype(np.float64)).astype(np.uint64)[inverse]
        ends = np.cumsum([0] + [len(a) for a in asked])
        blobs = [_pack(totals[ends[i] : ends[i + 1]]) for i in range(len(asked))]
        return pa.table({"block": table["block"], "k": table["k"], "bucket": table["bucket"], "totals": pa.array(blobs, pa.binary())})

    def score(held: pa.Table, answers: pa.Table) -> pa.Table:
        ids, sums, ns = [], [], []
        for blob in held["blob"].to_pylist():
            names, docs = _documents(blob)
            known = []
            for k in range(1, order + 1):
                mine = answers.filter(pa.compute.equal(answers["k"], k)).sort_by("bucket")["totals"].to_pylist()
                grams = _grams(docs, k)
                _, number = np.unique(np.concatenate(grams) if grams else np.empty(0, np.uint64), return_inverse=True)
                totals = np.concatenate([_unpack(b) for b in mine]).astype(np.int64) if mine else np.empty(0, np.int64)
                known.append((number, totals[number]))
            ids += names
            ns += [len(h) for h in docs]
            sums += score_block(docs, known, total, backoff)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(ns, pa.int64()), "log_score": pa.array(sums, pa.float64())})

    import pyarrow.compute  # noqa: F401

    asked = blocks.select("block", "blob").mapInArrow(ask, "block string, k int, bucket int, grams binary, times binary")
    answers = asked.groupBy("bucket", "k").applyInArrow(answer, "block string, k int, bucket int, totals binary")
    found = written(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "doc_id long, n_words long, log_score double"), "lm-scores")
    dropped(blocks)
    return found.withColumn("mean_log_score", F.col("log_score") / F.nullif(F.col("n_words"), F.lit(0)))


def oracle(order: int = ORDER, backoff: float = BACKOFF) -> str:
    """The same scores as one DuckDB statement over documents (distinct doc_id), rounded to four digits."""
    from .common import UPPER

    grams = ", ".join(f"case when i >= {k} then list_aggregate(w[i - {k - 1}:i], 'string_agg', ' ') end as g{k}" for k in range(1, order + 1))
    hist = ", ".join(f"case when i >= {k} then list_aggregate(w[i - {k - 1}:i - 1], 'string_agg', ' ') end as h{k}" for k in range(2, order + 1))
    tables = ", ".join(f"c{k} as (select g{k} as g, count(*) as c from grams where g{k} is not null group by g{k}), d{k} as (select doc_id, g{k} as g, count(*) as c from grams where g{k} is not null group by doc_id, g{k})" for k in range(1, order + 1))
    joins = " ".join(f"left join c{k} on c{k}.g = x.g{k} left join d{k} on d{k}.g = x.g{k} and d{k}.doc_id = x.doc_id" for k in range(1, order + 1))
    joins += " " + " ".join(f"left join c{k - 1} as ch{k} on ch{k}.g = x.h{k} left join d{k - 1} as dh{k} on dh{k}.g = x.h{k} and dh{k}.doc_id = x.doc_id" for k in range(2, order + 1))
    s = f"case when c1.c - d1.c > 0 then ln((c1.c - d1.c)::double / greatest(n.total - x.n, 1)) else ln({backoff} / (n.total - x.n + 1)) end"
    for k in range(2, order + 1):
        s = f"case when x.g{k} is null then {s} when c{k}.c - d{k}.c > 0 then ln((c{k}.c - d{k}.c)::double / greatest(ch{k}.c - dh{k}.c, 1)) else ln({backoff}) + {s} end"
    return f"""
with docs as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
spots as (select doc_id, w, len(w) as n, unnest(range(1, len(w) + 1)) as i from docs),
grams as (select doc_id, n, i, {grams}, {hist} from spots),
n as (select sum(len(w)) as total from docs),
{tables},
sums as (select x.doc_id, sum({s}) as log_score from grams x cross join n {joins} group by x.doc_id)
select docs.doc_id, len(docs.w)::bigint as n_words, round(coalesce(sums.log_score, 0), 4) as log_score, round(sums.log_score / nullif(len(docs.w), 0), 4) as mean_log_score
from docs left join sums on docs.doc_id = sums.doc_id
"""
