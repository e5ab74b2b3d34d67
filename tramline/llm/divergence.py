"""How far the sources of a language differ in their terms, by dense tiles of counts.

Terms are counted inside the tasks that read the texts and met by (lang, term); those in fewer than ``least_docs`` documents of their
language go. The terms of a language are then dealt into blocks by hash. A block with all sources of the language is a tile: a dense
numpy int64 matrix of counts, a row a source, a column a term. From it come whole-number probabilities, a matrix of the divergences
of all pairs of sources by broadcasting, and for each source a heap of its most telling terms. Matrices of the blocks add up to the
whole one; heaps are merged to a heap a source.

A probability is p = 1 + floor(10^9 * (count + 1) / (N + V)), exact at any size: the division goes digit by digit in base 1000. The
divergence of p from q is floor((p - q)^2 / q). It fits 64 bits: p is at most 10^9 + 1, and its sum over terms at most 10^9 + V.

Null text, lang and source count as ''; each row is a document, so rows that repeat count each; very long texts are counted in pieces;
groups without terms take part with counts of zero; a language without kept terms has divergences of 0 and no terms; ties go by the
item's UTF-8 bytes; an empty table gives an empty result. Other columns may have any name, for only these three are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced, written

LEAST_DOCS, TOP = 3, 200
#: Cells of a tile, where a source then still has ``NARROWEST`` terms; cells of the largest array made of it.
CELLS, NARROWEST, WORK = 1 << 19, 256, 1 << 21
#: Different terms that a task holds before it hands them on; bytes of a text that are split at once.
HELD, PIECE = 400_000, 1 << 22
UNIT = 1_000_000_000

#: Bytes of terms: letters in lower case and all beyond ASCII; the rest parts terms.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_ONE_DOC = 1 << 40


def terms_of(raw: bytes, table: bytes = _TERM, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of about ``piece`` bytes of it; no term is cut."""
    at = 0
    while len(raw) - at > piece:
        part = raw[at : at + piece].translate(table)
        end = part.rfind(b" ") + 1
        while not end:  # a term longer than a piece
            more = raw[at + len(part) : at + 2 * len(part)].translate(table)
            part += more
            end = part.rfind(b" ") + 1 if more else len(part)
        yield part[:end].split()
        at += end
    yield raw[at:].translate(table).split()


def counted(docs: DataFrame, held: int = HELD) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of terms, summed up within a task as far as its memory goes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], dict[bytes, int]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in groups.items():
                packed = np.fromiter(own.values(), np.int64, len(own))
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(lang), n), pa.repeat(pa.scalar(source), n), pa.array(list(own), pa.binary()).cast(pa.string()), pa.array(packed & (_ONE_DOC - 1)), pa.array(packed >> 40)],
                    ["lang", "source", "term", "n", "docs"],
                )
            groups.clear()

        for batch in sliced(batches, "text"):
            langs, sources, texts = (batch.column(i) for i in range(3))
            for lang, source, raw in zip(langs.to_pylist(), sources.to_pylist(), texts.cast(pa.binary()).to_pylist(), strict=True):
                own = groups.setdefault((lang, source), {})
                get = own.get
                if len(raw) <= PIECE:
                    for term, k in Counter(raw.translate(_TERM).split()).items():
                        own[term] = get(term, 0) + k + _ONE_DOC
                else:
                    met: set[bytes] = set()
                    for some in terms_of(raw):
                        for term, k in Counter(some).items():
                            own[term] = get(term, 0) + k + (0 if term in met else _ONE_DOC)
                            met.add(term)
            if sum(map(len, groups.values())) > held:
                yield from out()
        yield from out()

    plain = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return plain.mapInArrow(each, "lang string, source string, term string, n long, docs long")


def kept_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, first) of the terms in ``least_docs`` documents of their language or more; first: true in one row a term."""
    dealt = counted(docs).repartition("lang", "term")  # one shuffle serves the sums and the windows below
    sums = dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    marked = sums.withColumns({"all_docs": F.sum("docs").over(whole), "first": F.min("source").over(whole) == F.col("source")})
    return marked.where(F.col("all_docs") >= least_docs).select("lang", "source", "term", "n", "first")


def probability(count: np.ndarray, total: np.ndarray, v: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 1) / (total + v)), exact for totals to 9 * 10^15."""
    whole = np.maximum(total + v, 1)
    out, rest = np.divmod(count + 1, whole)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
    return out + 1


def pair_matrix(p: np.ndarray, work: int = WORK) -> np.ndarray:
    """Of each row of ``p`` from each: the divergences summed over the columns."""
    rows, cols = p.shape
    out = np.zeros((rows, rows), np.int64)
    step = max(1, work // max(1, rows * cols))
    for i in range(0, rows, step):
        d = p[i : i + step, None, :] - p[None, :, :]
        d *= d
        d //= p[None, :, :]
        out[i : i + step] = d.sum(axis=2)
    return out


def _tile(top: int):
    def tile(t: pa.Table) -> pa.Table:
        head = pc.is_null(t["term"])
        of_groups, of_terms = t.filter(head), t.filter(pc.invert(head))
        sources, total, v = of_groups["source"].combine_chunks(), of_groups["total"].to_numpy(), of_groups["v"][0].as_py()
        terms = pc.unique(of_terms["term"].cast(pa.binary()))
        terms = terms.take(pc.sort_indices(terms))  # by bytes, for ties
        counts = np.zeros((len(sources), len(terms)), np.int64)
        counts[pc.index_in(of_terms["source"], sources).to_numpy(), pc.index_in(of_terms["term"].cast(pa.binary()), terms).to_numpy()] = of_terms["n"].to_numpy()
        p, q = probability(counts, total[:, None], v), probability(counts.sum(axis=0), total.sum(), v)
        gap = p - q
        telling = np.where((counts > 0) & (gap > 0), gap * gap // q, -1)
        heaps = []
        for row in telling:
            some = np.flatnonzero(row >= 0)
            heaps.append(some[np.argsort(-row[some], kind="stable")[:top]])  # ascending terms stay so among equals
        own = np.repeat(np.arange(len(sources)), [len(h) for h in heaps])
        best = np.concatenate(heaps) if heaps else np.zeros(0, np.int64)
        a, b = np.nonzero(~np.eye(len(sources), dtype=bool))
        n = len(a) + len(own)
        return pa.table({
            "lang": pa.repeat(t["lang"][0], n),
            "source": pa.concat_arrays([sources.take(pa.array(a)), sources.take(pa.array(own))]),
            "part": pa.concat_arrays([pa.repeat(pa.scalar("pair"), len(a)), pa.repeat(pa.scalar("term"), len(own))]),
            "item": pa.concat_arrays([sources.take(pa.array(b)), terms.take(pa.array(best)).cast(pa.string())]),
            "value": pa.array(np.concatenate([pair_matrix(p)[a, b], telling[own, best]])),
        })

    return tile


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, cells: int = CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank): the other sources of the language by divergence from them, and the ``top`` terms by divergence from the language.

    part 'pair': item is a source; part 'term': item is a term that the source has more often than its language.
    """
    kept = written(kept_counts(docs, least_docs), "terms")
    groups = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = written(groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").na.fill(0, ["total"]), "groups")
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(kept.where("first").groupBy("lang").agg(F.count("*").alias("v")), "lang", "left").na.fill(0, ["v"])
    width = F.greatest(F.lit(NARROWEST), F.floor(F.lit(cells) / F.col("sources")))
    langs = written(langs.select("lang", "v", F.greatest(F.lit(1), F.ceil(F.col("v") / width)).alias("blocks")), "langs")  # a row a language: Spark broadcasts it by its size
    heads = groups.join(langs, "lang").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", "total", "v", F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("n"))
    cells_of = kept.join(langs, "lang").select("lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "source", F.lit(None).cast("long").alias("total"), F.lit(None).cast("long").alias("v"), "term", "n")
    tiles = heads.unionByName(cells_of).groupBy("lang", "block").applyInArrow(_tile(top), "lang string, source string, part string, item string, value long")
    tiles = written(tiles, "tiles")
    pairs = tiles.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    heaps = tiles.where("part = 'term'").withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(by_value)).unionByName(heaps.select("lang", "source", "part", "item", "value", "rank"))
