"""Byte-level BPE encoding and decoding by tree concatenation.

A text is cut where the encoder's own rules always cut (before white space that follows something else, and
around special tokens), so the pieces can be encoded anywhere. A piece that has no such place and is longer
than a leaf is unsplit text: its pre-tokens are cut in halves until each part is a leaf, the leaves are
encoded in parallel, and the halves are joined pairwise in a tree. At each join a window of tokens on both
sides is encoded anew and grown until its first token equals the left side's token there and its last one
the right side's; adjacent pairs are then all ones that the encoder itself gives, which makes the joined
sequence the encoder's own result.

Leaves are encoded with tiktoken where the vocabulary file is one that it reads exactly (see ranked()), else
with the tokenizers library. Short texts are encoded where they lie. Long ones (over ``long_chars``) are dealt out leaf by leaf to all
tasks, and only a text's ids come together again, so one giant text does not hold a task for long.

Edge cases: null is the empty text; the empty text has no ids and decodes to the empty text; repeated rows
are encoded each; an empty table gives an empty result; extra columns are ignored unless asked for.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

LEAF = 8_192
LONG = 262_144
BATCH = 256

#: Fixed value: the pattern of byte-level pre-tokens, as the public vocabulary's library publishes it.
PRE_TOKENS = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
SAFE = regex.compile(r"(?<=\S)(?=\s)")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=4)
def ranked(path: str):
    """The vocabulary as tiktoken's ranks, or None unless it is plain byte-level BPE with merges in the order of ids.

    tiktoken joins any neighbours whose text is an entry. That is what the merge list does only if the list makes
    every entry from its own text, which is tried for each of them.
    """
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    plain = plain and spec.get("normalizer") is None and spec.get("post_processor") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    if not plain:
        return None
    import tiktoken

    codes = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte alphabet: printable bytes are themselves
    byte_of = {chr(c): c for c in codes} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in set(codes))}
    marked = {t["content"] for t in spec.get("added_tokens") or ()}
    vocabulary = {name: i for name, i in model["vocab"].items() if name not in marked}
    merged = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
    if -1 in merged or merged != sorted(merged) or sorted(vocabulary.values()) != list(range(len(vocabulary))):
        return None
    encode = tokenizer(path).model.tokenize
    if any(len(encode(name)) != 1 for name in vocabulary):
        return None
    ranks = {bytes(byte_of[c] for c in name): i for name, i in vocabulary.items()}
    return tiktoken.Encoding("ranked", pat_str=PRE_TOKENS.pattern, mergeable_ranks=ranks, special_tokens={})


def encode_batch(path: str, texts: list[str]) -> list[list[int]]:
    """The library's ids of each text; by the same merges in tiktoken, several times faster, where the vocabulary allows."""
    engine, marks = ranked(path), special(path)
    if engine is None:
        return [e.ids for e in tokenizer(path).encode_batch(texts, add_special_tokens=False)]
    return [tokenizer(path).encode(t, add_special_tokens=False).ids if marks and marks.search(t) else engine.encode_ordinary(t) for t in texts]


@lru_cache(maxsize=4)
def special(path: str) -> regex.Pattern | None:
    """The special tokens' strings, which the library finds before anything else."""
    names = [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]
    return regex.compile("|".join(regex.escape(n) for n in sorted(names, key=len, reverse=True))) if names else None


def leaves(path: str, text: str, leaf: int = LEAF) -> Iterator[tuple[str, bool]]:
    """(part, whether it continues the part before as unsplit text) covering the text in order."""
    marks = special(path)
    at = 0
    spans = []
    for m in marks.finditer(text) if marks else ():
        spans += [(at, m.start(), False), (m.start(), m.end(), True)]
        at = m.end()
    spans.append((at, len(text), False))
    for a, b, whole in spans:
        while b - a > leaf and not whole:
            cut = SAFE.search(text, a + max(1, leaf // 2), min(b, a + leaf))
            if cut:
                yield text[a : cut.start()], False
                a = cut.start()
                continue
            beyond = SAFE.search(text, a + leaf, b)
            end = beyond.start() if beyond else b
            yield from _unsplit(text[a:end], leaf)
            a = end
        if b > a:
            yield text[a:b], False


def _unsplit(text: str, leaf: int) -> Iterator[tuple[str, bool]]:
    group: list[str] = []

    def flush():
        tail = len(group)
        while tail and group[tail - 1].isspace():  # together, and no longer before a letter, they would be one pre-token
            tail -= 1
        if tail:
            yield "".join(group[:tail]), False
        for piece in group[tail:]:
            yield piece, False
        group.clear()

    size = 0
    for m in PRE_TOKENS.finditer(text):
        piece = m[0]
        if size + len(piece) > leaf:
            yield from flush()
            size = 0
        if len(piece) > leaf:
            parts = 1 << (-(-len(piece) // leaf) - 1).bit_length()  # halves of halves
            cuts = [len(piece) * i // parts for i in range(parts + 1)]
            for i in range(parts):
                yield piece[cuts[i] : cuts[i + 1]], i > 0
        else:
            group.append(piece)
            size += len(piece)
    yield from flush()


@lru_cache(maxsize=4)
def _pieces(path: str) -> tuple[dict[str, int], list[str]]:
    t = tokenizer(path)
    vocabulary = t.get_vocab(with_added_tokens=False)
    names = [""] * (max(vocabulary.values()) + 1)
    for name, i in vocabulary.items():
        names[i] = name
    return vocabulary, names


@lru_cache(maxsize=4)
def _model(path: str) -> Callable[[str], list[int]]:
    """The merge rules alone, on text in the model's own alphabet (a character for each byte)."""
    model = tokenizer(path).model
    return lambda s: [t.id for t in model.tokenize(s)]


def join(path: str, left: list[int], right: list[int]) -> list[int]:
    """The ids of two neighbouring parts of one pre-token, from the ids of each."""
    if not left or not right:
        return left or right
    names, encode = _pieces(path)[1], _model(path)
    k = 2
    while True:
        a, b = left[-k:], right[:k]
        window = encode("".join(names[i] for i in a + b))
        left_ok = len(a) == len(left) or window[0] == a[0]
        right_ok = len(b) == len(right) or window[-1] == b[-1]
        if left_ok and right_ok:
            return left[: len(left) - len(a)] + window + right[len(b) :]
        k *= 2


def join_tree(path: str, parts: list[list[int]]) -> list[int]:
    while len(parts) > 1:
        parts = [join(path, parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else []


def joined(path: str, parts: list[tuple[bool, list[int]]]) -> list[int]:
    """The ids of a text from those of its leaves (whether it continues the one before, ids) in order."""
    out: list[int] = []
    run: list[list[int]] = []
    for continues, ids in parts:
        if not continues and run:
            out += join_tree(path, run)
            run = []
        run.append(ids)
    return out + join_tree(path, run) if run else out


def encode(path: str, text: str, leaf: int = LEAF) -> list[int]:
    """One text, here and now."""
    if len(text) <= leaf:
        return encode_batch(path, [text])[0]
    parts = list(leaves(path, text, leaf))
    return joined(path, list(zip((c for _, c in parts), encode_batch(path, [t for t, _ in parts]), strict=True)))


def decode(path: str, ids: list[int]) -> str:
    engine = ranked(path)
    if engine is not None:
        try:
            return engine.decode_bytes(ids).decode("utf-8")
        except (KeyError, UnicodeDecodeError):  # special tokens, or ids that no text has
            pass
    return tokenizer(path).decode(ids, skip_special_tokens=False)


def packed(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def _as_ids(path: str, ids: pa.Array, blobs: list[bytes]) -> dict[str, pa.Array]:
    return {"id": ids, "ids": pa.array(blobs, pa.binary())}


def _as_digests(path: str, ids: pa.Array, blobs: list[bytes]) -> dict[str, pa.Array]:
    n, a, b = [], [], []
    for blob in blobs:
        text = decode(path, np.frombuffer(blob, "<u4").tolist())
        n.append(len(blob) // 4)
        a.append(hashlib.sha256(blob).hexdigest())
        b.append(hashlib.sha256(text.encode("utf-8", "replace")).hexdigest())
    return {"doc_id": ids, "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}


IDS, DIGESTS = "id {}, ids binary", "doc_id {}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encoded(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF, long_chars: int = LONG) -> DataFrame:
    """id and ``ids`` (little-endian unsigned 32-bit integers, as binary) of every row.

    Ids need not be unique: rows of long texts carry a mark of their own, the text's digest with the partition and
    how many equal rows came before in it, which is the same in whatever order a task that is run again sees them.
    """
    return _encoded(documents, path, id_col, text_col, leaf, long_chars, _as_ids, IDS)


def digested(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF, long_chars: int = LONG) -> DataFrame:
    """with_digests() of encoded(), by the workers that encode: a second worker a task would hold the vocabulary again."""
    return _encoded(documents, path, id_col, text_col, leaf, long_chars, _as_digests, DIGESTS)


def _encoded(documents: DataFrame, path: str, id_col: str, text_col: str, leaf: int, long_chars: int, finish: Callable[[str, pa.Array, list[bytes]], dict[str, pa.Array]], columns: str) -> DataFrame:
    small_batches(documents.sparkSession)
    rows = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    short, long = rows.filter(F.length("text") <= long_chars), rows.filter(F.length("text") > long_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                parts = [list(leaves(path, t, leaf)) for t in part.column(1).to_pylist()]
                ids = iter(encode_batch(path, [t for p in parts for t, _ in p]))
                blobs = [packed(joined(path, [(c, next(ids)) for _, c in p])) for p in parts]
                yield pa.RecordBatch.from_pydict(finish(path, part.column(0), blobs))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        partition = task.partitionId() if task else 0
        seen: Counter = Counter()
        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                digest = hashlib.md5(text.encode()).hexdigest()
                mark = f"{digest}-{partition}-{seen[i.as_py(), digest]}"
                seen[i.as_py(), digest] += 1
                parts = list(leaves(path, text, leaf))
                for start in range(0, len(parts), 64):
                    some = parts[start : start + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i.as_py()] * len(some), batch.schema.field(0).type), pa.array([mark] * len(some)), pa.array(range(start, start + len(some)), pa.int32()), pa.array([c for _, c in some]), pa.array([t for t, _ in some], pa.string())],
                        names=["id", "mark", "n", "continues", "text"],
                    )

    def encode_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                blobs = [packed(x) for x in encode_batch(path, part.column(4).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(blobs, pa.binary())], names=[*part.schema.names[:4], "ids"])

    def gather(table: pa.Table) -> pa.Table:
        table = table.sort_by("n")
        parts = [(c, np.frombuffer(b, "<u4").tolist()) for c, b in zip(table["continues"].to_pylist(), table["ids"].to_pylist(), strict=True)]
        return pa.table(finish(path, table["id"].slice(0, 1), [packed(joined(path, parts))]))

    whole = short.mapInArrow(run, columns.format(kind))
    dealt = long.mapInArrow(deal, f"id {kind}, mark string, n int, continues boolean, text string").repartition("mark", "n")
    apart = dealt.mapInArrow(encode_leaves, f"id {kind}, mark string, n int, continues boolean, ids binary").groupBy("id", "mark").applyInArrow(gather, columns.format(kind))
    return whole.unionByName(apart)


def with_digests(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 (hex) of what encoded() returns, decoding every row."""
    kind = tokens.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict(_as_digests(path, batch.column(0), batch.column(1).to_pylist()))

    return tokens.mapInArrow(run, DIGESTS.format(kind))
