"""Token counts of documents in flat token files that have no index.

A token file is one run of fixed-width ids in which an id of its own ends each document. It is read in blocks that take no heed of
documents. Each block is searched for that id at once, as an array, and says how many tokens stand before its first end, between
ends and after the last; a prefix scan over the blocks of a file joins what a block border cut. The scan has two levels, so that a
file of any length never meets in one task: within chunks of blocks, then over the chunks.

Tokens after a file's last end are a document too, marked as not ended; bytes that make no whole id at a file's end are passed over.
Empty files and empty documents count; rows of null texts have no tokens but an end; rows that repeat are documents each; an empty
table gives an empty result; other columns of the documents may have any name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, sliced
from .word_bpe import word_bpe

BLOCK_BYTES, CHUNK = 1 << 18, 4096


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, size, value) of files under ``path``, split as Spark splits files; value: the bytes up to a byte 10, in order."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))


def blocks_of_files(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, block, tokens) of the flat files under ``path``, of any size; block_bytes: a multiple of an id's width.

    Spark's line reader, which splits files, serves to read bytes: lines and the bytes 10 between them are the file. A first pass adds up
    the bytes before each split; with that each split cuts its bytes at multiples of ``block_bytes``, and only the two blocks at its
    borders are put together from pieces. A file without a byte 10 in 2 GB, which no file of tokens is, would not fit a line.
    """
    own = _lines(spark, path).groupBy("file", "start").agg(F.sum(F.length("value") + 1).alias("n"), F.max("size").alias("size"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    own = own.withColumns({"at": F.coalesce(F.sum("n").over(before), F.lit(0)), "total": F.sum("n").over(Window.partitionBy("file"))})
    # A file need not end with a byte 10; the reader passes over a byte order mark at its beginning.
    own = own.select("file", F.col("start"), F.col("at"), (F.col("size") - F.col("total") > 0).alias("mark"), F.when(F.lead("at").over(Window.partitionBy("file").orderBy("start")).isNull(), F.col("size")).alias("end"))
    own = own.withColumn("at", F.when(F.col("mark") & (F.col("at") > 0), F.col("at") + 3).otherwise(F.col("at")))
    rows = _lines(spark, path).join(F.broadcast(own), ["file", "start"]).select("file", "start", "at", "mark", "end", "value")  # a row a split

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, end, held, chunks = None, 0, None, 0, []

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal at, held, chunks
            data = b"".join(chunks)
            if last and end is not None:
                data = data[: end - at]
            i = 0
            while i < len(data):
                j = min(len(data), i + block_bytes - (at + i) % block_bytes)
                if j == len(data) and not last and (at + j) % block_bytes:
                    break
                yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([(at + i) // block_bytes]), pa.array([at + i]), pa.array([j - i == block_bytes]), pa.array([data[i:j]], pa.binary())], ["file", "block", "at", "whole", "tokens"])
                i = j
            at, chunks, held = at + i, [data[i:]], len(data) - i

        for batch in batches:
            for file, start, begin, mark, stop, value in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if (file, start) != key:
                    if key is not None:
                        yield from blocks(True)
                    key, at, end, chunks, held = (file, start), begin, stop, [], 0
                    if mark and begin == 0:
                        chunks, held = [b"\xef\xbb\xbf"], 3
                chunks += [value, b"\n"]
                held += len(value) + 1
                if held >= 4 * block_bytes:
                    yield from blocks(False)
        if key is not None:
            yield from blocks(True)

    pieces = rows.mapInArrow(cut, "file string, block long, at long, whole boolean, tokens binary")
    rest = pieces.where("not whole").groupBy("file", "block").agg(F.array_sort(F.collect_list(F.struct("at", "tokens"))).alias("x"))  # a block
    rest = rest.select("file", "block", F.aggregate("x", F.lit(b""), lambda a, p: F.concat(a, p["tokens"])).alias("tokens"))
    return pieces.where("whole").select("file", "block", "tokens").unionByName(rest)


def save_tokens(docs: DataFrame, path: str, out: str, end: int) -> None:
    """Flat 16-bit token files of documents under ``out``/kind=tokens, a file a partition: the ids of each document and the end id, nothing else (but a byte 10 behind the last).

    The task that writes a file also says, under ``out``/kind=ids, which document stands at which place of it; both come of one
    evaluation of ``docs``, so they agree however its rows were dealt. Ids beyond 16 bits are an error. The text sink writes bytes as
    they are; they are handed to it in pieces between bytes 10, in the order of seq.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rest, seq, n = word_bpe(path, special=False), b"", 0, 0

        def lines(kind: str, values: list[bytes]) -> pa.RecordBatch:
            nonlocal seq
            seq += len(values)
            return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(kind), len(values)), pa.array(np.arange(seq - len(values), seq)), pa.array(values, pa.binary())], ["kind", "seq", "value"])

        for batch in sliced(batches, "text"):
            parts = [rest]
            for raw in own.encode(batch.column(1).to_pylist()):
                ids = np.append(np.frombuffer(raw, np.uint32), end)
                if ids.max() > 0xFFFF:
                    raise ValueError(f"id {ids.max()} does not fit 16 bits")
                parts.append(ids.astype("<u2").tobytes())
            *whole, rest = b"".join(parts).split(b"\n")
            yield lines("ids", [f"{n + i},{'' if x is None else x}".encode() for i, x in enumerate(batch.column(0).to_pylist())])
            n += len(batch)
            if whole:
                yield lines("tokens", whole)
        if rest:
            yield lines("tokens", [rest])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(each, "kind string, seq long, value binary")
    rows = rows.sortWithinPartitions("kind", "seq").select(F.col("value").cast("string").alias("value"), "kind")
    rows.write.partitionBy("kind").option("lineSep", "\n").text(out)


def numbered(spark: SparkSession, out: str) -> DataFrame:
    """(part, document, doc_id): the place of each document in the files that ``save_tokens`` wrote under ``out``."""
    line = F.split("value", ",", 2)
    rows = spark.read.schema("value string").text(f"{out}/kind=ids")
    return rows.select(_part(F.col("_metadata.file_path")).alias("part"), line[0].cast("long").alias("document"), F.expr("try_cast(split(value, ',', 2)[1] AS long)").alias("doc_id"))


def _part(file: Column) -> Column:
    """The number in a file's name."""
    return F.regexp_extract(file, r"part-(\d+)[^/]*$", 1).cast("long")


def scanned(blocks: DataFrame, end: int, width: int = 2) -> DataFrame:
    """What each block says: n tokens, n_ends, head (tokens before the first end, or all), inner (between ends), last (place behind the last end)."""
    rest = [f for f in blocks.schema if f.name != "tokens"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("tokens")
            rows = []
            for x in batch.column(at):
                raw = x.as_buffer() if x.is_valid else b""
                ids = np.frombuffer(raw, np.dtype(f"<u{width}"), len(raw) // width)
                e = np.flatnonzero(ids == end)
                rows.append((len(ids), len(e), int(e[0]) if len(e) else len(ids), np.diff(e) - 1, int(e[-1]) + 1 if len(e) else None))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns) if i != at), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64()), strict=True))], [*(f.name for f in rest), "n", "n_ends", "head", "inner", "last"])

    return blocks.select(*(f.name for f in rest), "tokens").mapInArrow(each, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest) + ", n long, n_ends long, head long, inner array<long>, last long")


def stitched(found: DataFrame) -> DataFrame:
    """The blocks with their documents' token counts (lengths), the first one's number in the file (first), and what is left open behind the file's last end (open; null but in its last block)."""
    found = found.withColumn("chunk", F.floor(F.col("block") / CHUNK))
    inside = Window.partitionBy("file", "chunk").orderBy("block")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    sum0 = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    found = found.withColumns({"at": sum0("n", earlier), "ends": sum0("n_ends", earlier)})
    found = found.withColumn("closed", F.max(F.col("at") + F.col("last")).over(earlier))
    sums = found.groupBy("file", "chunk").agg(F.sum("n").alias("c_n"), F.sum("n_ends").alias("c_ends"), F.max(F.col("at") + F.col("last")).alias("c_closed"))
    over = Window.partitionBy("file").orderBy("chunk")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"c_at": sum0("c_n", before), "c_first": sum0("c_ends", before)})
    sums = sums.withColumns({"c_before": F.max(F.col("c_at") + F.col("c_closed")).over(before), "final": F.lead("chunk").over(over).isNull()})
    sums = sums.select("file", "chunk", "c_at", "c_first", "c_before", "final")
    out = found.join(sums, ["file", "chunk"])
    since: Column = F.coalesce(F.col("c_at") + F.col("closed"), F.col("c_before"), F.lit(0))
    carry = F.col("c_at") + F.col("at") - since
    is_last = F.col("final") & F.lead("block").over(inside).isNull()
    rest = F.when(F.col("n_ends") > 0, F.col("n") - F.col("last")).otherwise(carry + F.col("n"))
    return out.select(
        *(c for c in found.columns if c not in ("n", "head", "inner", "last", "chunk", "at", "ends", "closed", "n_ends")),
        F.when(F.col("n_ends") > 0, F.concat(F.array(carry + F.col("head")), "inner")).otherwise(F.array().cast("array<bigint>")).alias("lengths"),
        (F.col("c_first") + F.col("ends")).alias("first"),
        F.when(is_last & (rest > 0), rest).alias("open"),
    )


def document_counts(blocks: DataFrame, end: int, width: int = 2) -> DataFrame:
    """(file, document, n_tokens, ended): a row for each document of each file, by its number in the file; ends do not count."""
    blocks = stitched(scanned(blocks.select("file", "block", "tokens"), end, width))
    whole = blocks.select("file", F.posexplode("lengths").alias("i", "n_tokens"), "first").select("file", (F.col("first") + F.col("i")).alias("document"), "n_tokens", F.lit(True).alias("ended"))
    rest = blocks.where("open is not null").select("file", (F.col("first") + F.size("lengths")).alias("document"), F.col("open").alias("n_tokens"), F.lit(False).alias("ended"))
    return whole.unionByName(rest)


def digest(docs: DataFrame, path: str, end: int = 49407, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """What the query returns: (doc_id, n_tokens), counted in flat token files of the documents that are written for it.

    Files carry no ids of documents: a list of places, written by the same tasks, has them. Both are deleted by whoever clears the shared folder.
    """
    spark = docs.sparkSession
    out = f"{shared_dir(spark)}/tramline/tokens-{uuid.uuid4().hex}"
    save_tokens(docs, path, out, end)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/kind=ids")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):  # no rows
        return spark.createDataFrame([], "doc_id long, n_tokens long")
    counts = document_counts(blocks_of_files(spark, f"{out}/kind=tokens", block_bytes), end).where("ended")
    return numbered(spark, out).join(counts.select(_part(F.col("file")).alias("part"), "document", "n_tokens"), ["part", "document"]).select("doc_id", "n_tokens")
