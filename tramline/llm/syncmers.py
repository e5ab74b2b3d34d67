"""Document fingerprints from closed syncmers, with DataFrame functions only.

A text of any length is a row of tokens: its words, and of words over 24 characters (and of scripts that do not part words) each
character. A k-mer of k = 5 tokens is a closed syncmer if the least of the hashes of its inner 2-mers is the first or the last of them.
That depends on the k-mer alone, so equal passages have the same syncmers wherever they stand, and ``aligned`` finds by them
where passages of one text stand in another. A fingerprint holds the 32 least distinct
hashes of a text's syncmers; two fingerprints give an unbiased estimate of the Jaccard likeness of their syncmers, exact for sets
of up to 32.

Null texts count as empty. A text of fewer than k tokens has one hash, that of the whole; an empty text none, and two such are alike.
Every row is a document: rows are ordered by id (those without one come first), then by a hash of the text; rows that repeat both
follow each other; a single row is its own successor. An empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, doc_key, written

K, INNER, SKETCH = 5, 2, 32
#: Words of up to 24 characters, or the single characters of longer ones.
TOKEN = r"(?<!\S)\S{1,24}(?!\S)|\S"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def _selected(inner: Column, out: Callable[[Column, Column], Column]) -> Column:
    """out(inner hashes, position) of each closed syncmer."""
    n = K - INNER + 1
    last = F.size(inner) - n
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    edge = lambda i: F.least(inner[i], inner[i + n - 1]) <= F.least(*(inner[i + j] for j in range(1, n - 1)))
    return F.transform(F.filter(places, edge), lambda i: out(inner, i))


def _inner(toks: Column) -> Column:
    """Hashes of the 2-mers of tokens."""
    pairs = lambda h: F.transform(F.when(F.size(h) >= INNER, F.sequence(F.lit(0), F.size(h) - INNER)).otherwise(F.array().cast("array<int>")), lambda i: F.xxhash64(h[i], h[i + 1]))
    return let(F.transform(toks, lambda t: F.xxhash64(t)), pairs)


def _kmer(inner: Column, i: Column) -> Column:
    return F.xxhash64(*(inner[i + j] for j in range(K - INNER + 1)))


def syncmers(text: Column) -> Column:
    """array<struct<place, hash>>: the closed syncmers of a text, by their first token's number; anchors for matching by place."""
    return let(_inner(tokens(text)), lambda inner: _selected(inner, lambda h, i: F.struct(i.alias("place"), _kmer(h, i).alias("hash"))))


def sketch(text: Column) -> Column:
    """array<int>: the fingerprint, ascending."""
    low = lambda x: x.bitwiseAND(0x7FFFFFFF).cast("int")
    whole = F.when(F.size(tokens(text)) > 0, F.array(low(F.xxhash64(text)))).otherwise(F.array().cast("array<int>"))
    own = let(_inner(tokens(text)), lambda inner: F.when(F.size(inner) >= K - INNER + 1, _selected(inner, lambda h, i: low(_kmer(h, i)))))
    return F.slice(F.array_sort(F.array_distinct(F.coalesce(own, whole))), 1, SKETCH)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two fingerprints; 1 for two empty ones."""
    both = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    return let(both, lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)))


def text_of(fp: Column) -> Column:
    """The fingerprint as a string: eight hexadecimal digits for each hash."""
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def in_order(docs: DataFrame) -> DataFrame:
    """(_d, _h, n, copies, p_d, p_h, p_n) of each id and text: how many rows have both, and the predecessor (the first's: the last), without sending texts.

    Ids are dealt by range; neighbours in a range come from a window, those across ranges from one row a range.
    """
    meta = docs.select(*doc_key(), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n")).groupBy("_d", "_h").agg(F.max("n").alias("n"), F.count("*").alias("copies"))
    meta = written(meta.repartitionByRange("_d", "_h").withColumn("part", F.spark_partition_id()), "order")
    inside = Window.partitionBy("part").orderBy("_d", "_h")
    one = F.struct("_d", "_h", "n")
    parts = meta.groupBy("part").agg(F.max(one).alias("last"))
    over = Window.orderBy("part")  # a row a partition
    whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.select("part", F.coalesce(F.lag("last").over(over), F.last("last").over(whole)).alias("before"))
    meta = meta.withColumn("p", F.lag(one).over(inside)).join(F.broadcast(parts), "part").withColumn("p", F.coalesce("p", "before"))
    return meta.select("_d", "_h", "n", "copies", *(F.col(f"p.{c}").alias(f"p{c if c[0] == '_' else '_' + c}") for c in ("_d", "_h", "n")))


def compared(docs: DataFrame) -> DataFrame:
    """(_d, n_chars, edited, fp, next_fp, times): each document, its edited text and its successor's fingerprint; times: rows of which this is true.

    The edited text has the last n_chars // 4 characters replaced by the first as many of the successor's. A text is shuffled to learn
    its neighbours, then what stays of it goes to its own row and what is lent to its predecessor's. Of rows that repeat id and
    text all but the last are followed by their like.
    """
    own = docs.select(*doc_key(), F.coalesce("text", F.lit("")).alias("text")).repartition("_d", "_h").groupBy("_d", "_h").agg(F.max("text").alias("text"))
    own = own.join(in_order(docs), ["_d", "_h"]).withColumn("fp", sketch(F.col("text")))
    quarter = lambda n: F.floor(F.col(n) / 4).cast("int")
    start = lambda n: F.substring("text", F.lit(1), quarter(n))
    none, empty, number = F.lit(None).cast("string"), F.lit(None).cast("array<int>"), F.lit(None).cast("long")
    keeps = F.struct("_d", "_h", "n", "copies", F.substring("text", F.lit(1), F.col("n").cast("int") - quarter("n")).alias("keep"), F.when(F.col("copies") > 1, start("n")).alias("own"), F.col("fp"), none.alias("head"), empty.alias("next_fp"))
    lends = F.struct(F.col("p_d").alias("_d"), F.col("p_h").alias("_h"), number.alias("n"), number.alias("copies"), none.alias("keep"), none.alias("own"), empty.alias("fp"), start("p_n").alias("head"), F.col("fp").alias("next_fp"))
    rows = own.select(F.explode(F.array(keeps, lends)).alias("x")).select("x.*").repartition("_d", "_h")
    rows = rows.groupBy("_d", "_h").agg(*(F.max(c).alias(c) for c in ("n", "copies", "keep", "own", "fp", "head", "next_fp")))
    last = F.struct(F.concat("keep", "head").alias("edited"), F.col("next_fp"), F.lit(1).cast("long").alias("times"))
    rest = F.struct(F.concat("keep", "own").alias("edited"), F.col("fp").alias("next_fp"), (F.col("copies") - 1).alias("times"))
    each = F.explode(F.when(F.col("copies") > 1, F.array(last, rest)).otherwise(F.array(last)))
    return rows.select("_d", "n", "fp", each.alias("x")).select("_d", F.col("n").alias("n_chars"), "x.edited", "fp", "x.next_fp", "x.times")


def digest(docs: DataFrame) -> DataFrame:
    """What the query returns."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    x = compared(docs).withColumn("edited_fp", sketch(F.col("edited")))
    fp, edited = F.col("fp"), F.col("edited_fp")
    x = x.select("_d", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), text_of(fp).alias("fingerprint"), text_of(edited).alias("edited_fingerprint"), likeness(fp, edited).alias("near_edited"), likeness(fp, F.col("next_fp")).alias("near_next"), "times")
    x = x.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("i", "times")
    return x.select(F.when(F.col("_d") != NO_ID, F.col("_d")).cast(kind).alias("doc_id"), *x.columns[1:])


def aligned(a: DataFrame, b: DataFrame, least: int = 3) -> DataFrame:
    """(a_id, b_id, shift, n): where texts of ``a`` and ``b`` (doc_id, text) stand alike: n syncmers, ``least`` or more, at places that differ by ``shift``.

    Only syncmers that stand once in ``b`` are met, so no passage that many texts repeat makes pairs of all of them.
    """
    marks = lambda x, s: x.select(F.col("doc_id").alias(f"{s}_id"), F.explode(syncmers(F.coalesce("text", F.lit("")))).alias("m")).select(f"{s}_id", F.col("m.place").alias(f"{s}_place"), F.col("m.hash").alias("hash"))
    once = marks(b, "b").groupBy("hash").agg(F.count("*").alias("n"), F.min("b_id").alias("b_id"), F.min("b_place").alias("b_place")).where("n = 1").drop("n")
    return marks(a, "a").join(once, "hash").groupBy("a_id", "b_id", (F.col("b_place") - F.col("a_place")).alias("shift")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
