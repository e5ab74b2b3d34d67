"""Exact substring dedup by threshold-bounded interval expansion on Burrows-Wheeler transforms.

A byte goes if a string of ``min_len`` bytes that covers it also starts anywhere else. How the work is split:

1. Every window of ``min_len`` bytes has an anchor, the k-byte substring of least hash in it (the rightmost of equals). Equal
   windows have equal anchors. A run of windows with the same anchor is one string, the *run* (about 1.4 times min_len bytes).
2. Runs are counted by content. All bytes of a run that occurs twice go. Of each content one copy stays for the next step, so a
   group of copies of any size costs one row, and what partial aggregation leaves of it.
3. Different runs around equal anchors are put together, many anchors to a bucket of bounded size, each bucket in one task, which
   builds the transform and expands intervals breadth first, prefix length by prefix length, up to ``min_len``. Neighbours in
   suffix order that are still together there share min_len bytes.
4. Anchors with more than ``hot`` different runs do not fit a bucket. Their windows are counted, one row a window, by the anchor and two
   hashes with different bases, as runs are.

Texts travel compressed; a document's text is shuffled twice, to cut runs from it and to cut the removed bytes out.

Null texts count as empty; texts under ``min_len`` bytes stay whole; rows that repeat an id are documents of their own; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, doc_key, marked, merged, sliced, sliding_min, utf8, written

ANCHOR = 128
#: Different runs of an anchor that still go to a bucket, and bytes of a bucket: a worker takes up to about 100 times as much for it.
HOT, BUCKET_BYTES = 5000, 600_000
#: Bytes of text of which runs, or windows of hot anchors, are made at once; arrays take up to about 100 times as much.
SLICE = 1 << 19
#: Windows whose anchors are looked for at once.
PIECE = 1 << 23


# -- the transform ---------------------------------------------------------------------------------------------------------


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` codes or more, by prefix doubling. codes: positive."""
    n = len(codes)
    bits = int(codes.max()).bit_length()
    take = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for i in range(take):
        key <<= bits
        if i < n:
            key[: n - i] |= codes[i:]
    order = np.argsort(key)
    key, slots, rank, k = key[order], np.arange(n), np.empty(n, np.int64), take
    tied = order
    while True:  # slots: places in the order whose suffixes are still equal to a neighbour; tied: those suffixes
        fresh = np.r_[True, key[1:] != key[:-1]]
        rank[tied] = np.maximum.accumulate(np.where(fresh, slots, 0)) + 1
        more = ~(fresh & np.r_[fresh[1:], True])
        slots, tied = slots[more], tied[more]
        if k >= depth or not len(tied):
            return order
        ahead = tied + k
        key = rank[tied] * (n + 2)
        inside = ahead < n
        key[inside] += rank[ahead[inside]]
        by = np.argsort(key)
        key, tied = key[by], tied[by]
        order[slots] = tied
        k *= 2


class Wavelet:
    """Wavelet matrix of a sequence of small codes; lists the codes inside many intervals at once."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.bits = max(1, (sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        now = seq
        for level in reversed(range(self.bits)):
            bit = (now >> level) & 1
            ones = np.zeros(len(now) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(now) - int(ones[-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.first = np.zeros(sigma, np.int64)
        self.first[np.unique(now)] = np.unique(now, return_index=True)[1]

    def codes_in(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each code in each interval: the code, and how often it stands before the interval's start and end."""
        code = np.zeros(len(lo), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            lo1, hi1 = ones[lo], ones[hi]
            lo0, hi0 = lo - lo1, hi - hi1
            left, right = hi0 > lo0, hi1 > lo1
            lo = np.concatenate([lo0[left], lo1[right] + zeros])
            hi = np.concatenate([hi0[left], hi1[right] + zeros])
            code = np.concatenate([code[left] << 1, (code[right] << 1) | 1])
        return code, lo - self.first[code], hi - self.first[code]


def repeated_starts(data: np.ndarray, offsets: np.ndarray, min_len: int) -> np.ndarray:
    """Positions of ``data`` (strings laid end to end at ``offsets``) where a substring of min_len bytes starts that starts elsewhere too.

    The strings are closed by separators that differ from each other. From the interval of each prefix the intervals of the
    prefixes that one more byte in front makes are found on the transform; the first time that a boundary between neighbours in
    suffix order is met gives their common prefix. Boundaries not met before ``min_len`` have at least that.
    """
    m = len(offsets) - 1
    lengths = np.diff(offsets)
    used, byte = np.unique(data, return_inverse=True)
    n = len(data) + m
    place = np.arange(len(data)) + np.repeat(np.arange(m), lengths)
    codes = np.zeros(n, np.int64)
    seps = offsets[1:] + np.arange(m)
    codes[seps] = np.arange(1, m + 1)
    codes[place] = byte + m + 1
    order = suffix_order(codes, min_len + 1)
    before = codes[order - 1]
    bwt = np.where(before > m, before - m, 0)
    sigma = len(used) + 1
    counts = np.bincount(bwt, minlength=sigma)
    each = np.bincount(byte, minlength=len(used))
    block = np.r_[0, m + np.cumsum(each) - each]  # the first row of each byte's suffixes, from code 1 on
    by_code = np.argsort(bwt, kind="stable")
    follow = np.full(n, -1, np.int64)
    follow[by_code[counts[0] :]] = np.arange(m, n)  # a row's suffix with the byte before it
    wave = Wavelet(bwt.astype(np.uint8 if sigma <= 256 else np.int16), sigma)
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    known[: m + 1] = True
    starts = block[1:]
    ends = starts + each
    known[ends] = True
    lo, hi = np.r_[np.arange(m), starts].astype(np.int64), np.r_[np.arange(1, m + 1), ends].astype(np.int64)
    for _ in range(1, min_len):
        if not len(lo):
            break
        one = hi - lo == 1
        single = follow[lo[one]]
        single = single[single >= 0]
        code, left, right = wave.codes_in(lo[~one], hi[~one])
        keep = code > 0
        code = code[keep]
        lo = np.concatenate([single, block[code] + left[keep]])
        hi = np.concatenate([single + 1, block[code] + right[keep]])
        fresh = ~known[hi]
        lo, hi = lo[fresh], hi[fresh]
        known[hi] = True
    shared = ~known[:n]  # row r starts with the same min_len bytes as row r - 1
    rows = shared | np.r_[shared[1:], False]
    at = np.full(n, -1, np.int64)
    at[place] = np.arange(len(data))
    return np.sort(at[order[rows]])


# -- runs ------------------------------------------------------------------------------------------------------------------


def anchors(data: np.ndarray, min_len: int, k: int, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each k bytes, place of the anchor of each window): the least hash in the window, the rightmost of equals.

    Windows are taken in pieces, as a place in a piece must fit the low 24 bits that break ties.
    """
    grams = Rolling(data).all(k)
    low = np.uint64((1 << 24) - 1)
    width = min_len - k + 1
    found = [np.zeros(0, np.int64)]
    for at in range(0, max(0, len(data) - min_len + 1), piece):
        part = grams[at : at + piece + width - 1]
        keyed = (part & ~low) | (low - np.arange(len(part), dtype=np.uint64))
        found.append(at + (low - (sliding_min(keyed, width) & low)).astype(np.int64))
    return grams, np.concatenate(found)


def runs(data: np.ndarray, offsets: np.ndarray, min_len: int, k: int = ANCHOR) -> dict[str, np.ndarray]:
    """The runs of all texts: row, start, end (in the text), the anchor's hash and two hashes of the run."""
    grams, place = anchors(data, min_len, k)
    lengths = np.diff(offsets)
    count = np.maximum(lengths - min_len + 1, 0)
    row = np.repeat(np.arange(len(lengths)), count)
    window = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(offsets[:-1], count)
    anchor = place[window]
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]) if len(row) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(row)] - 1 if len(first) else first
    s, e, r = window[first], window[last] + min_len, row[first]
    return {"row": r, "start": s - offsets[r], "end": e - offsets[r], "a": grams[anchor[first]].view(np.int64), "s": Rolling(data).of(s, e).view(np.int64), "s2": Rolling(data, 1).of(s, e).view(np.int64)}


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1)
    for batch in sliced(batches, "text"):
        data, off = utf8(batch.column(2))
        raw = data.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([press.compress(raw[i:j]) for i, j in zip(off[:-1], off[1:], strict=True)], pa.binary())], ["_d", "_h", "z"])


def squeezed(docs: DataFrame) -> DataFrame:
    """Each document's key and its text, compressed."""
    return docs.select(*doc_key(), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_squeezed, "_d long, _h long, z binary")


def unsqueezed(col: pa.Array) -> list[bytes]:
    pull = zstandard.ZstdDecompressor()
    return [pull.decompress(x) for x in col.to_pylist()]


def found_runs(docs: DataFrame, min_len: int) -> DataFrame:
    """(_d, _h, start, end, a, s, s2): a row a run."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE):
            got = runs(*utf8(batch.column(2)), min_len)
            row = pa.array(got["row"])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *(pa.array(got[c], pa.int32() if c in ("start", "end") else pa.int64()) for c in ("start", "end", "a", "s", "s2"))], ["_d", "_h", "start", "end", "a", "s", "s2"])

    return docs.select(*doc_key(), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(each, "_d long, _h long, start int, end int, a long, s long, s2 long")


def repeated_spans(docs: DataFrame, packed: DataFrame, min_len: int = 400, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(_d, _h, start, end): byte intervals that repeated strings cover; they overlap, and a union is left to the reader."""
    found = written(found_runs(docs, min_len), "runs")
    kinds = found.groupBy("a", "s", "s2").agg(F.count("*").alias("n"), F.min(F.struct("_d", "_h", "start", "end")).alias("one"))
    kinds = written(kinds.select("a", "s", "s2", "n", "one.*"), "run-kinds")
    copies = found.join(kinds.where("n > 1").select("a", "s", "s2"), ["a", "s", "s2"]).select("_d", "_h", "start", "end")

    anchors = kinds.groupBy("a").agg(F.count("*").alias("kinds"), F.sum(F.col("end") - F.col("start")).alias("bytes")).where("kinds > 1")
    total = anchors.where(F.col("kinds") <= hot).agg(F.sum("bytes")).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    wanted = kinds.join(anchors, "a").groupBy("_d", "_h").agg(F.collect_list(F.struct("start", "end", "a", "n", (F.col("kinds") > hot).alias("hot"))).alias("want"))
    texts = packed.join(wanted, ["_d", "_h"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "z", 1 << 18):
            d, h, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i, (text, want) in enumerate(zip(unsqueezed(batch.column(2)), batch.column(3).to_pylist(), strict=True)):
                out += [(d[i], h[i], x["start"], x["a"], x["n"], text[x["start"] : x["end"]]) for x in want]
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["_d", "_h", "start", "a", "n", "run"])

    schema = "_d long, _h long, start int, a long, n long, run binary"
    cool = texts.select("_d", "_h", "z", F.filter("want", lambda x: ~x["hot"]).alias("want")).where(F.size("want") > 0).mapInArrow(cut, schema)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; a bucket's rows may reach over batches."""
        held: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            b = np.asarray(batch.column(0))
            edges = np.r_[0, np.flatnonzero(b[1:] != b[:-1]) + 1, len(b)] if len(b) else [0]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if held and b[i] != at:
                    yield solved(held)
                    held = []
                at = b[i]
                held.append(batch.slice(i, j - i))
        if held:
            yield solved(held)

    def solved(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        data, off = utf8(t["run"])
        starts = repeated_starts(data, off, min_len)
        row = np.searchsorted(off, starts, "right") - 1
        s = starts - off[row]
        head = np.r_[True, (row[1:] != row[:-1]) | (s[1:] > s[:-1] + min_len)] if len(s) else np.zeros(0, bool)
        first = np.flatnonzero(head)
        last = np.r_[first[1:], len(s)] - 1 if len(first) else first
        r = row[first]
        base = np.asarray(t["start"])[r]
        r = pa.array(r)
        return pa.RecordBatch.from_arrays([t["_d"].combine_chunks().take(r), t["_h"].combine_chunks().take(r), pa.array(base + s[first], pa.int32()), pa.array(base + s[last] + min_len, pa.int32())], ["_d", "_h", "start", "end"])

    dealt = cool.select(F.pmod(F.xxhash64("a"), F.lit(buckets)).alias("bucket"), "*").repartition(max(1, min(buckets, 1 << 20)), "bucket").sortWithinPartitions("bucket")
    expanded = dealt.select("bucket", "_d", "_h", "start", "run").mapInArrow(expand, "_d long, _h long, start int, end int")

    def hot_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(cut(batches), "run", SLICE // 2):
            data, off = utf8(batch.column(5))
            count = np.maximum(np.diff(off) - min_len + 1, 0)
            row = np.repeat(np.arange(len(count)), count)
            inside = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            s = inside + off[row]
            r = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(3).take(r), *(pa.array(Rolling(data, k).of(s, s + min_len).view(np.int64)) for k in range(2)), batch.column(0).take(r), batch.column(1).take(r), pa.array(np.asarray(batch.column(2))[row] + inside, pa.int32()), batch.column(4).take(r)], ["a", "w", "w2", "_d", "_h", "start", "n"])

    warm = texts.select("_d", "_h", "z", F.filter("want", lambda x: x["hot"]).alias("want")).where(F.size("want") > 0)
    windows = warm.mapInArrow(hot_windows, "a long, w long, w2 long, _d long, _h long, start int, n long")
    twice = windows.groupBy("a", "w", "w2").agg(F.sum("n").alias("n")).where("n > 1").select("a", "w", "w2")
    heated = windows.join(twice, ["a", "w", "w2"]).select("_d", "_h", "start", (F.col("start") + min_len).alias("end")) if anchors.where(F.col("kinds") > hot).limit(1).count() else None
    spans = copies.unionByName(expanded)
    return spans.unionByName(heated) if heated is not None else spans


def removed(docs: DataFrame, min_len: int = 400, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, spans): what stays of each text as bytes, and the maximal removed intervals."""
    spans = repeated_spans(docs, squeezed(docs), min_len, hot, bucket_bytes).groupBy("_d", "_h").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = written(spans, "spans")
    ids = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_d")).schema["doc_id"].dataType.simpleString()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "z", 1 << 18):
            out = []
            for text, want in zip(unsqueezed(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                s, e = merged(np.array([x["start"] for x in want or ()], np.int64), np.array([x["end"] for x in want or ()], np.int64))
                edges = np.r_[0, np.column_stack([s, e]).ravel(), len(text)].astype(np.int64)
                kept = b"".join(text[i:j] for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
                out.append((len(text), len(text) - len(kept), len(s), kept, [{"start": i, "end": j} for i, j in zip(s.tolist(), e.tolist(), strict=True)]))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), strict=True))], ["_d", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    rows = marked(docs.select(*doc_key(), F.coalesce("text", F.lit("")).alias("text")), spans)
    press = lambda x: x.select("_d", "_h", "text").mapInArrow(_squeezed, "_d long, _h long, z binary")
    met = press(rows.where("_may")).join(spans, ["_d", "_h"], "left")  # texts without a repeat stay where they are
    out = met.unionByName(press(rows.where("not _may")).withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))).mapInArrow(keep, "_d long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,end:long>>")
    return out.select(F.when(F.col("_d") != -(1 << 63), F.col("_d")).cast(ids).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept", "spans")


def digest(docs: DataFrame, min_len: int = 400) -> DataFrame:
    """What the query returns: the kept bytes as SHA-256."""
    return removed(docs, min_len).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute(texts: list[bytes], min_len: int) -> list[tuple[int, int, int, str]]:
    """The definition, for tests: n_bytes, n_removed, n_spans, kept_sha256 of each text."""
    from collections import Counter

    seen = Counter(t[i : i + min_len] for t in texts for i in range(len(t) - min_len + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - min_len + 1):
            if seen[t[i : i + min_len]] > 1:
                gone[i : i + min_len] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out
