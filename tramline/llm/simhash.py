"""SimHash near-duplicates with pivot distance tables.

Fingerprints that differ in at most two of 64 bits are linked; components of links are the groups. Equal fingerprints are one
node, so copies cost nothing. Of four blocks of 16 bits two at least are equal in linked fingerprints, so pairs are looked for only
among fingerprints equal in two blocks (six keys). Of each fingerprint the Hamming distances to 14 reference fingerprints, the
pivots, are computed once and travel with it; in a bucket they discard pairs by their largest difference, as distances to a pivot
differ by no more than the fingerprints do. What is left is verified on the bits. Pivots alone can't deal out pairs: distances to
any pivot crowd around 32, so cells of them would meet nearly all others. A
key with more than ``hot`` fingerprints is split by two of the four bytes that its blocks leave open, at least two of which are
equal again; then a bucket holds 65,536 fingerprints at the very most. Buckets give spanning trees, never all their pairs.

Null texts count as empty; an empty text has fingerprint zero; rows that repeat an id are documents of their own, those without an id
come last; an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..operators.components import connected_components
from .common import mixed, sliced, written

HOT, PIVOTS = 4096, mixed(np.arange(1, 15, dtype=np.uint64))


def fingerprint(text: bytes, n: int = 3, seed: int = 42) -> int:
    """Unsigned. Majority of the bits of the XXH64 hashes of all n-word shingles; words are what ASCII white space leaves."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= n:
        hashes = np.array([xxh64_intdigest(line, seed)], np.uint64)
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        hashes = np.array([xxh64_intdigest(line[a:b], seed) for a, b in zip(starts[: 1 - n].tolist(), ends[n - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, fp): fp as a signed 64-bit number."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            fp = np.array([fingerprint(t.encode(), n) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(each, f"doc_id {kind}, fp long")


def distances(fp: str) -> list[Column]:
    """far0, far1: the row of the pivot distance table that belongs to a fingerprint, a byte for each of 14 pivots, seven in a number."""
    each = [F.bit_count(F.col(fp).bitwiseXOR(F.lit(int(p)))).cast("long") for p in PIVOTS.view(np.int64)]
    return [reduce(Column.bitwiseOR, (F.shiftleft(x, 8 * i) for i, x in enumerate(each[7 * k : 7 * k + 7]))).alias(f"far{k}") for k in range(2)]


def unpacked(*far: np.ndarray) -> np.ndarray:
    """The table of ``distances``: a row for each fingerprint, a column for each pivot."""
    return np.concatenate([x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :7] for x in far], axis=1).astype(np.int16)


def tree(fp: np.ndarray, far: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the fingerprints (unsigned, distinct) of one bucket that differ in at most ``most`` bits; far: their pivot distances.

    Coordinates of fingerprints that differ in d bits differ by d at most, so pairs with a greater difference are discarded unseen.
    """
    by = np.argsort(far[:, 0], kind="stable")
    fp, far = fp[by], far[by]
    reach = np.searchsorted(far[:, 0], far[:, 0] + most, "right")
    root = list(range(len(fp)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for i in range(len(fp) - 1):
        j = np.arange(i + 1, reach[i])
        for k in range(1, len(PIVOTS)):
            if not len(j):
                break
            j = j[np.abs(far[j, k] - far[i, k]) <= most]
        for x in j[np.bitwise_count(fp[j] ^ fp[i]) <= most].tolist():
            a, b = find(i), find(x)
            if a != b:
                root[b] = a
                links.append((i, x))
    signed = fp.view(np.int64)
    return [(int(signed[a]), int(signed[b])) for a, b in links]


def linked(nodes: DataFrame, hot: int = HOT, most: int = 2) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that join the same groups as all pairs with at most two differing bits would."""
    block: list[Column] = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    keys = F.array(*(F.shiftleft(F.lit(c).cast("long"), 32).bitwiseOR(F.shiftleft(block[i], 16)).bitwiseOR(block[j]) for c, (i, j) in enumerate(combinations(range(4), 2))))
    nodes = nodes.select("fp", *distances("fp"))  # once for each fingerprint, before it goes to its six buckets
    keyed = nodes.select("fp", "far0", "far1", F.explode(keys).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(keyed.join(sizes, "key").select("key", "fp", "far0", "far1", (F.col("n") > hot).alias("hot")), "buckets")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; a bucket's rows may reach over batches."""
        held: list[tuple[np.ndarray, ...]] = []
        at = None

        def closed() -> list[tuple[int, int]]:
            fp, *far = (np.concatenate(x) for x in zip(*held, strict=True))
            return tree(fp.view(np.uint64), unpacked(*far), most)

        for batch in batches:
            key, sub, *values = (np.asarray(batch.column(i)) for i in range(5))
            edges = np.r_[0, np.flatnonzero((key[1:] != key[:-1]) | (sub[1:] != sub[:-1])) + 1, len(key)]
            found: list[tuple[int, int]] = []
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if i < j and held and (key[i], sub[i]) != at:
                    found += closed()
                    held = []
                if i < j:
                    at = (key[i], sub[i])
                    held.append(tuple(x[i:j] for x in values))
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        if held:
            a, b = zip(*got, strict=True) if (got := closed()) else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    pairs = list(combinations(range(4), 2))
    choice = F.shiftrightunsigned("key", 32).cast("int")
    open_ = F.lit(0).cast("long")
    for c, (i, j) in enumerate(pairs):
        x, y = (k for k in range(4) if k not in (i, j))
        open_ = F.when(choice == c, F.shiftleft(block[x], 16).bitwiseOR(block[y])).otherwise(open_)
    byte = [F.shiftrightunsigned("open", 8 * i).bitwiseAND(0xFF) for i in range(4)]
    subs = F.array(*(F.shiftleft(F.lit(c + 1).cast("long"), 16).bitwiseOR(F.shiftleft(byte[i], 8)).bitwiseOR(byte[j]) for c, (i, j) in enumerate(pairs)))
    cool = shared.where("not hot").select("key", F.lit(0).cast("long").alias("sub"), "fp", "far0", "far1")
    split = shared.where("hot").withColumn("open", open_).select("key", F.explode(subs).alias("sub"), "fp", "far0", "far1")
    dealt = cool.unionByName(split).repartition("key", "sub").sortWithinPartitions("key", "sub")
    return dealt.mapInArrow(links, "a long, b long")


def grouped(docs: DataFrame, n: int = 3, hot: int = HOT) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id that links reach."""
    found = written(fingerprints(docs, n), "fingerprints")
    nodes = found.groupBy("fp").agg(F.min("doc_id").alias("first"))
    of = connected_components(linked(nodes.select("fp"), hot), "a", "b")
    labelled = nodes.join(of, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    labelled = written(labelled, "labels")
    first = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    return found.join(labelled.join(first, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    """What the query returns: the fingerprint as 16 lowercase hexadecimal digits."""
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """Of each group the document with the least doc_id stays, of such rows the one with the least hash of its text, of equal rows one. Documents without an id come last."""
    names = docs.columns
    inner = [n if n in ("doc_id", "text") else f"c{i}" for i, n in enumerate(names)]
    plain = docs.toDF(*inner).select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("_d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"))
    keep = grouped(plain.select(F.struct("_d", "_h").alias("doc_id"), "text")).select("component_id.*").distinct()
    return plain.join(keep, ["_d", "_h"], "left_semi").dropDuplicates(["_d", "_h"]).select(*inner).toDF(*names)
