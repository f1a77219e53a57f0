"""Token ids packed into rows of equal length.

Texts become ids of a public tokenizer, each closed by an end mark. A document longer than a row is split without loss:
full rows, then a rest. Within a group, pieces go by falling length to the open row with the least room that suffices (best
fit decreasing); that room is found by walking down a segment tree over room sizes, whose leaves count the open rows.

Each task packs the documents it scans in groups of a bounded number of tokens, so no text is shuffled and memory does
not grow with the input. Rows hold the ids as little-endian 16- or 32-bit words padded to the full length, the cumulated
lengths of the segments, and where position ids start again with the position in the document that a piece begins at.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import textbuf as T
from strandline.sources.shared import importable

VOCABULARY, END_ID, ROW, GROUP = "/opt/tokenizers/byte_bpe_50k.tiktoken", 50256, 2048, 2_000_000
# fixed value: how this vocabulary's tokenizer parts a text
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=1)
def encoder(vocabulary: str):
    """The tokenizer of a vocabulary file, built once in each worker."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(vocabulary), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class RoomTree:
    """Counts of open rows by room; ``best`` finds the least room of at least ``need``."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.width
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, room: int) -> int:
        at = room + self.width
        while at:
            self.count[at] -= 1
            at >>= 1
        return self.rows[room].pop()

    def best(self, need: int) -> int:
        """-1 if no open row has the room."""
        at = need + self.width
        if self.count[at]:
            return need
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                break
            at >>= 1
        else:
            return -1
        while at < self.width:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.width


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Rows of piece numbers. Pieces are taken by falling size, equal ones in their order."""
    tree, rows = RoomTree(capacity), []
    for piece in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        need = sizes[piece]
        room = tree.best(need)
        if room < 0:
            rows.append([])
            row, room = len(rows) - 1, capacity
        else:
            row = tree.take(room)
        rows[row].append(piece)
        if room > need:
            tree.add(room - need, row)
    return rows


def _group(held: list[tuple[int | None, np.ndarray]], row: int, end_id: int, dtype: str) -> Iterator[tuple]:
    pieces = [(doc, start, ids[start : start + row]) for doc, ids in held for start in range(0, len(ids), row)]
    for members in best_fit([len(p) for _, _, p in pieces], row):
        parts = [pieces[i] for i in members]
        ends = np.cumsum([len(p) for _, _, p in parts])
        ids = np.full(row, end_id, dtype)
        ids[: ends[-1]] = np.concatenate([p for _, _, p in parts])
        yield int(ends[-1]), ids.tobytes(), [0, *ends.tolist()], [0, *ends[:-1].tolist()], [d for d, _, _ in parts], [s for _, s, _ in parts]


SCHEMA = "shard int, row_in_shard long, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, piece_starts array<long>"


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, row: int = ROW, group: int = GROUP) -> DataFrame:
    """A row for each packed row of the matrix.

    shard (the task's number) and row_in_shard name it; ids has ``row`` words, of which n_tokens count and the others are
    ``end_id``. Segment j is ids[cu_seqlens[j] : cu_seqlens[j + 1]] of document doc_ids[j], from its token piece_starts[j]
    on. position_resets are the places where position ids start again. A null or empty text is its end mark alone; repeated
    rows are packed as often, null doc_ids stay null. The same files read in the same splits give the same rows.
    """
    importable(docs.sparkSession)
    dtype = "<u2" if end_id < 1 << 16 else "<u4"

    def run(stream):
        from pyspark import TaskContext

        encode, shard, done = encoder(vocabulary).encode_ordinary, TaskContext.get().partitionId(), 0

        def flush(held):
            nonlocal done
            rows = list(_group(held, row, end_id, dtype))
            columns = list(zip(*rows, strict=True))
            out = [pa.array([shard] * len(rows), pa.int32()), pa.array(range(done, done + len(rows)), pa.int64()), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.list_(pa.int32())), pa.array(columns[3], pa.list_(pa.int32())), pa.array(columns[4], pa.list_(pa.int64())), pa.array(columns[5], pa.list_(pa.int64()))]
            done += len(rows)
            return pa.RecordBatch.from_arrays(out, [x.strip().split(" ")[0] for x in SCHEMA.split(",")])

        held, size = [], 0
        for batch in stream:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                held.append((doc, np.array([*encode(text.as_py() or ""), end_id], dtype)))
                size += len(held[-1][1])
                if size >= group:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return docs.select("doc_id", "text").mapInArrow(T.tidy(run), SCHEMA)


def write(packed: DataFrame, path: str) -> None:
    """Writes packed rows; ids as fixed-length binary, one matrix row each, beside lengths and resets."""
    packed.write.mode("overwrite").parquet(path)


def unpack(packed: DataFrame, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids): the tokens of each document put together again, its end mark included. doc_ids must be unique."""
    dtype = "<u2" if end_id < 1 << 16 else "<u4"

    def run(stream):
        for batch in stream:
            out = []
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], dtype)
                out += [(d, s, ids[a:b].astype(np.int32).tolist()) for d, s, a, b in zip(r["doc_ids"], r["piece_starts"], r["cu_seqlens"][:-1], r["cu_seqlens"][1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int32())))], ["doc_id", "start", "part"])

    parts = packed.mapInArrow(T.tidy(run), "doc_id long, start long, part array<int>")
    whole = F.array_sort(F.collect_list(F.struct("start", "part")))
    return parts.groupBy("doc_id").agg(F.flatten(F.transform(whole, lambda x: x["part"])).alias("ids"))
