"""Byte-level BPE by a global shuffle of distinct words.

1. Texts are split into pre-tokens.  A block of documents keeps, for every
   position, a code: the rank of a pre-token that is a token itself, else a number
   in the block's own list of distinct words.  Positions stay in the block's row;
   only distinct words of blocks are shuffled, so that a word that makes up a
   third of all text is one row a block.
2. Words are dealt by a checksum to their owners, a partition each; an owner
   encodes each distinct word once, whatever the number of blocks that have it,
   and returns its ids.  The merges are made here: the adjacent pair of least rank
   first, with a heap, so that a word of any length takes n log n steps.
3. Ids are joined back to their blocks, and documents are put together by
   position.  Decoding joins ids with the table of token bytes, which is bounded
   by the vocabulary and so held by every task.

Blocks are stored once as a bucketed table in the shared warehouse, so that codes
and words of a block always come from the same run of the splitter, and positions
are not shuffled at all.

Defined results: null and empty texts have no ids; rows with a null or repeated
id each get their own result; an empty table gives an empty table; other columns
are not read.  Ids are little-endian unsigned 32-bit numbers in one binary value.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed

#: Text bytes of a block, about; characters of a text from which on its pre-tokens are not listed all at once.
BLOCK_BYTES, LONG = 5 << 20, 1 << 20
_BLOCKS = "block long, doc_ids array<long>, counts array<long>, codes binary, parts array<struct<owner:int,words:binary>>"
_PARTS = pa.list_(pa.struct([("owner", pa.int32()), ("words", pa.binary())]))


def load_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: base64 of a token and its rank, a line each."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word: its adjacent pair of the least rank, the first of equal ones, becomes one, until no pair has a rank."""
    if (rank := ranks.get(word)) is not None:
        return [rank]
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # where the piece that begins at a place ends, and the one before it begins
    pairs = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(pairs)
    while pairs:
        _, begin, end = heapq.heappop(pairs)
        middle = after[begin]
        if not 0 < middle < end or after[middle] != end:
            continue  # one of the two is part of another piece by now
        after[begin], after[middle] = end, -1
        if end < n:
            before[end] = begin
            if (r := ranks.get(word[begin : after[end]])) is not None:
                heapq.heappush(pairs, (r, begin, after[end]))
        if (left := before[begin]) >= 0 and (r := ranks.get(word[left:end])) is not None:
            heapq.heappush(pairs, (r, left, end))
    out, at = [], 0
    while at < n:
        out.append(ranks[word[at : after[at]]])
        at = after[at]
    return out


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    """Byte strings of known order, each with its length, compressed."""
    parts = [x if isinstance(x, bytes) else x.tobytes() for x in arrays]
    return zstandard.compress(np.array([len(x) for x in parts], np.int64).tobytes() + b"".join(parts), 3)


def _unpack(data: bytes, n: int) -> list[bytes]:
    data = zstandard.decompress(data)
    ends = 8 * n + np.cumsum(np.frombuffer(data[: 8 * n], np.int64))
    return [data[a:b] for a, b in zip([8 * n, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def _planes(codes: np.ndarray) -> bytes:
    """Codes with equal bytes of all codes together, which compresses far better."""
    return codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _split(ranks, pattern: str, owners: int):
    """Blocks of documents (id, text): see _BLOCKS; a code of len(ranks) or more is a word of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rx, known = regex.compile(pattern), {}
        for token, rank in ranks.value.items():
            try:
                known[token.decode()] = rank
            except UnicodeDecodeError:
                continue
        first, serial = len(ranks.value), 0
        ids: list[int | None] = []
        counts: list[int] = []
        codes: list[np.ndarray] = []
        own: dict[str, int] = {}
        size = 0

        def block() -> pa.RecordBatch:
            words = [w.encode() for w in own]
            owner = np.array([zlib.crc32(w) % owners for w in words], np.int64)
            order = np.argsort(owner, kind="stable")
            place = np.empty(len(order) + first, np.uint32)
            place[:first] = np.arange(first)
            place[first + order] = first + np.arange(len(order))
            parts = []
            for p, begin in zip(*np.unique(owner[order], return_index=True), strict=True):
                mine = [words[k] for k in order[begin : begin + np.searchsorted(owner[order][begin:], p, side="right")].tolist()]
                parts.append({"owner": int(p), "words": _pack(np.array([len(w) for w in mine], np.uint32), b"".join(mine))})
            every = place[np.concatenate(codes)] if codes else np.zeros(0, np.uint32)
            name = (TaskContext.get().partitionId() << 32) + serial
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([_pack(_planes(every))]), pa.array([parts], _PARTS)],
                ["block", "doc_ids", "counts", "codes", "parts"],
            )

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py() or ""
                out = []
                for w in rx.findall(text) if len(text) < LONG else (m.group() for m in rx.finditer(text)):
                    code = known.get(w)
                    if code is None:
                        code = own.get(w)
                        if code is None:
                            code = own[w] = first + len(own)
                    out.append(code)
                ids.append(doc_id)
                counts.append(len(out))
                codes.append(np.array(out, np.uint32))
                size += len(text)
                if size >= BLOCK_BYTES:
                    yield block()
                    ids, counts, codes, own, size, serial = [], [], [], {}, 0, serial + 1
        if ids:
            yield block()

    return run


def _encode(ranks):
    """Words of blocks, of one owner after the other: each distinct word is encoded once; gives each block's ids in its words' order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, now = ranks.value, None
        done: dict[bytes, bytes] = {}
        for b in batches:
            for block, owner, blob in zip(*b.columns, strict=True):
                block, owner = block.as_py(), owner.as_py()
                if owner != now:
                    now, done = owner, {}
                lengths, joined = _unpack(blob.as_py(), 2)
                ends = np.cumsum(np.frombuffer(lengths, np.uint32)).tolist()
                out = []
                for begin, end in zip([0, *ends], ends, strict=False):
                    word = joined[begin:end]
                    found = done.get(word)
                    if found is None:
                        found = done[word] = np.array(merge(word, vocabulary), "<u4").tobytes()
                    out.append(found)
                packed = _pack(np.array([len(x) >> 2 for x in out], np.uint32), b"".join(out))
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([owner], pa.int32()), pa.array([packed])], ["block", "owner", "ids"])

    return run


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers of ``range(begin[i], begin[i] + count[i])`` for all i, joined."""
    return np.repeat(begin - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


def token_table(ranks: dict[bytes, int]) -> tuple[bytes, np.ndarray]:
    """The bytes of all tokens, joined in the order of their ids, and how many each has."""
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return b"".join(table), np.array([len(x) for x in table], np.int64)


def _decoder(table: tuple[bytes, np.ndarray]):
    """From ids to bytes."""
    data, count = np.frombuffer(table[0], np.uint8), table[1]
    begin = np.cumsum(count) - count
    return lambda ids: data[_ranges(begin[ids], count[ids])].tobytes()


def _assemble(n_ranks: int, table=None):
    """Blocks with their words' ids as ``doc_id, ids``; with a token table also the bytes that the ids decode to."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        doc_ids, blobs, texts = [], [], []
        decoded = _decoder(table.value) if table else None
        parts = sorted(zip(right["owner"].to_pylist(), right["ids"].to_pylist(), strict=True))
        unpacked = [_unpack(x, 2) for _, x in parts]
        own = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x[0], np.uint32).astype(np.int64) for x in unpacked)])
        flat = np.concatenate([np.arange(n_ranks, dtype="<u4"), *(np.frombuffer(x[1], "<u4") for x in unpacked)])
        count = np.concatenate([np.ones(n_ranks, np.int64), own])
        begin = np.cumsum(count) - count
        for k in range(left.num_rows):
            ids, counts = left["doc_ids"][k].as_py(), left["counts"][k].as_py()
            codes, at = _unplanes(_unpack(left["codes"][k].as_py(), 1)[0]), 0
            for doc_id, n in zip(ids, counts, strict=True):
                c = codes[at : at + n]
                at += n
                found = flat[_ranges(begin[c], count[c])]
                doc_ids.append(doc_id)
                blobs.append(found.tobytes())
                if decoded:
                    texts.append(decoded(found))
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.array(blobs, pa.binary())} | ({"decoded": pa.array(texts, pa.binary())} if table else {}))

    return run


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_column: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """``doc_id, ids`` for every row of ``docs``; with ``decoded`` also the bytes that the ids decode to, by the same pass."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(ranks)  # bounded by the vocabulary
    table = spark.sparkContext.broadcast(token_table(ranks)) if decoded else None
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    blocks = bucketed(docs.mapInArrow(_split(held, pattern, owners), _BLOCKS), "block", owners)
    words = blocks.select("block", F.explode("parts").alias("part")).select("block", "part.owner", "part.words")
    dealt = words.repartitionById(owners, F.col("owner")).sortWithinPartitions("owner", "block")
    coded = dealt.mapInArrow(_encode(held), "block long, owner int, ids binary")
    # A block without words of its own still meets its codes.
    out = "doc_id long, ids binary" + ", decoded binary" * decoded
    return blocks.drop("parts").groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(_assemble(len(ranks), table), out)


def decode(ids: Column, ranks: dict[bytes, int], docs: DataFrame) -> Column:
    """The bytes of ids; ``docs`` gives the session."""
    held = docs.sparkSession.sparkContext.broadcast(token_table(ranks))

    @F.arrow_udf("binary")
    def joined(column: pa.Array) -> pa.Array:
        decoded = _decoder(held.value)
        return pa.array([decoded(np.frombuffer(x.as_buffer(), "<u4")) if x.is_valid else b"" for x in column], pa.binary())

    return joined(ids)
