"""Packing token sequences: shortest-pack-first over the length histogram.

Documents are cut into pieces of at most ``size`` tokens, all but the last of a document full. Only the histogram of the lengths
of pieces, ``size`` rows at most, reaches the driver. There lengths are placed longest first, each into the pack with most room
left, for all packs of one kind at once: what is kept are patterns of lengths and how often each occurs. The patterns give every
length a list of places by rank; a piece's rank among the pieces of its length, counted over salted groups, picks its place.

Null texts count as empty (their end token is packed); rows that repeat an id are documents of their own; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced, written
from .word_bpe import word_bpe

#: Pieces of a salted group, about.
GROUP = 50_000


def pieces(docs: DataFrame, path: str, size: int, end: int, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): a row a piece; with keep_ids also its ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
    last = np.array([end], np.uint32).tobytes()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_bpe(path)
        for batch in sliced(batches, "text"):
            row, start, length, crc, total, kept = [], [], [], [], [], []
            for i, raw in enumerate(own.encode(batch.column(1).to_pylist())):
                raw += last
                for at in range(0, len(raw), 4 * size):
                    piece = raw[at : at + 4 * size]
                    row.append(i)
                    start.append(at // 4)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(len(raw) // 4)
                    if keep_ids:
                        kept.append(np.frombuffer(piece, np.int32))
            cols = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.list_(pa.int32()))] * keep_ids, names)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(each, schema)


def patterns(counts: dict[int, int], size: int) -> list[tuple[int, tuple]]:
    """(how many packs, lengths from the longest on as a linked list (length, rest)) of shortest-pack-first packing."""
    room: dict[int, list[tuple[int, tuple]]] = defaultdict(list)  # packs by the room they have left
    most = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        at = most
        while left and at >= length:
            if not room[at]:
                at -= 1
                continue
            n, pack = room[at].pop()
            some = min(n, left)
            if some < n:
                room[at].append((n - some, pack))
            room[at - length].append((some, (length, pack)))
            left -= some
        if left:
            per = size // length  # packs that hold this length alone, as many as it takes
            full, rest = divmod(left, per)
            pack: tuple = ()
            for k in range(1, per + 1):
                pack = (length, pack)
                if k == rest:
                    room[size - k * length].append((1, pack))
            if full:
                room[size - per * length].append((full, pack))
        most = max((r for r, packs in room.items() if packs), default=0)
    return [x for packs in room.values() for x in packs]


def places(found: list[tuple[int, tuple]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, packs, first sequence, offset); ranks go through the packs, then through repeats in a pack."""
    out: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    rank: dict[int, int] = defaultdict(int)
    sequence = 0
    for n, pack in found:
        lengths = []
        while pack:
            length, pack = pack
            lengths.append(length)
        offset = 0
        at = 0
        while at < len(lengths):
            length, first = lengths[at], at
            while at < len(lengths) and lengths[at] == length:
                at += 1
            out[length].append((rank[length], n, sequence, offset))
            rank[length] += n * (at - first)
            offset += length * (at - first)
        sequence += n
    return {k: np.array(v, np.int64) for k, v in out.items()}


def packed(docs: DataFrame, path: str, size: int = 4096, end: int = 2, keep_ids: bool = False) -> DataFrame:
    """The pieces with (sequence_id, offset): their sequence, and the tokens before them in it."""
    table = written(pieces(docs, path, size, end, keep_ids), "pieces")
    counts = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``size`` rows
    where = table.sparkSession.sparkContext.broadcast(places(patterns(counts, size)))  # bounded by the lengths, not by the rows

    salts = max(1, sum(counts.values()) // GROUP)
    salted = table.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before")).select(*table.columns, "rank")
    at = len(table.columns)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = where.value
        for batch in batches:
            length, rank = np.asarray(batch.column(2)), np.asarray(batch.column(at))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            by = np.argsort(length, kind="stable")
            for rows in np.split(by, np.flatnonzero(np.diff(length[by])) + 1) if len(by) else []:
                own = of[int(length[rows[0]])]
                k = np.searchsorted(own[:, 0], rank[rows], "right") - 1
                inside = rank[rows] - own[k, 0]
                sequence[rows] = own[k, 2] + inside % own[k, 1]
                offset[rows] = own[k, 3] + inside // own[k, 1] * length[rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:at], "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")
