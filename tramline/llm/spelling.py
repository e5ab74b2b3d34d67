"""Spelling variants of words by anagram hashing.

A word's key is the sum of a power of each of its letters, so anagrams share it. Two words that differ by one inserted, deleted or
replaced letter have keys that differ by the value of one letter, or by that of one letter for another's. Each word is therefore
put under its key and under its key less the value of each of its letters: what is then equal differs by one addition, removal or
exchange value, and the join is one of equal keys. Under a key with only one value taken off there are only anagrams; it goes.

The order of the letters is verified without pairs: a word that is left under a key is written without the letter that was taken off,
once for each place of it, and words that agree in this rest and its place differ by a replacement there; a word that equals
the rest differs by a deletion. As they differ by one letter, of which there are 90, at most 90 words can agree in a rest and a place,
so no group grows with the data. Windows over such groups count near words and name the most frequent one, beside itself, of each.

Rests of more than ``LONG`` letters are compared by two 64-bit hashes, so that a word of any length makes rows in proportion to it.

Null texts have no words; a null doc_id counts as an empty one; rows that repeat count each; very long texts are read in pieces that
cut no word; of near words with equal counts the first in code-point order is the form; an empty table gives an empty result. Other
columns may have any name, for only doc_id and text are read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Rolling, powers, sliced, written
from .divergence import terms_of

LEAST_LETTERS, LEAST_COUNT, RATIO, ONE_IN = 7, 2, 10, 31
#: Different words that a task holds before it hands them on; letters of a rest that is compared as it is; the power of the keys.
HELD, LONG, POWER = 500_000, 64, 5

#: Letters of runs in Latin-1, A-Z in lower case; the rest parts runs.
_RUN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def counted(docs: DataFrame, least_letters: int = LEAST_LETTERS, one_in: int = ONE_IN, held: int = HELD) -> DataFrame:
    """(word, n): words of ``least_letters`` and more, one in ``one_in`` runs short of a letter, summed up within a task as far as its memory goes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = {}
        get, crc = found.get, zlib.crc32

        def out() -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in found], pa.string()), pa.array(np.fromiter(found.values(), np.int64, len(found)))], ["word", "n"])
            found.clear()

        for batch in sliced(batches, "text"):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                head = crc(f"{doc_id}:".encode())
                for some in terms_of(text.encode("latin-1", "replace"), _RUN):
                    for word, k in Counter(w for w in some if len(w) >= least_letters).items():
                        h = crc(word if word.isascii() else word.decode("latin-1").encode(), head)
                        if h % one_in == 0:
                            i = h % len(word)
                            word = word[:i] + word[i + 1 :]
                            if len(word) < least_letters:
                                continue
                        found[word] = get(word, 0) + k
            if len(found) > held:
                yield from out()
        yield from out()

    plain = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.mapInArrow(each, "word string, n long")


_VALUE = [c**POWER for c in range(256)]


def keyed(words: DataFrame) -> DataFrame:
    """(key, gone, word, n): each word under its own key (gone 0) and under its key less each of its letters (gone: that letter)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, gone, at = [], [], []
            for i, word in enumerate(batch.column(0).to_pylist()):
                raw = word.encode("latin-1")
                whole = sum(map(_VALUE.__getitem__, raw)) & 0xFFFFFFFFFFFFFFFF
                letters = sorted(set(raw))
                keys.append(whole)
                keys += [(whole - _VALUE[c]) & 0xFFFFFFFFFFFFFFFF for c in letters]
                gone += [0, *letters]
                at += [i] * (1 + len(letters))
            own = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(gone, pa.int32()), batch.column(0).take(own), batch.column(1).take(own)], ["key", "gone", "word", "n"])

    return words.select("word", "n").mapInArrow(each, "key long, gone int, word string, n long")


def _long_rests(raw: bytes) -> tuple[str, list[str]]:
    """Names, by two hashes, of a word and of what is left of it without each of its letters."""
    data, n = np.frombuffer(raw, np.uint8), len(raw)
    sides = []
    for which in (0, 1):
        s = Rolling(data, which).sums
        sides.append((s[n], s[:-1] + (s[n] - s[1:]) * powers(1, which)[1][1]))
    name = lambda size, a, b: f"\0{size}:{int(a):016x}{int(b):016x}"
    return name(n, sides[0][0], sides[1][0]), [name(n - 1, a, b) for a, b in zip(sides[0][1], sides[1][1], strict=True)]


def rests(rows: DataFrame) -> DataFrame:
    """(rest, place, first, word, n): the words without the letter that is gone, for each place of it; a word of its own has place -1.

    first: whether the place is the first of equal letters in a row, so that each different rest of a word has one such row.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest, place, first, at = [], [], [], []
            for i, (gone, word) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if not gone:
                    rest.append(word if len(word) <= LONG else _long_rests(word.encode("latin-1"))[0])
                    place.append(-1)
                    first.append(False)
                    at.append(i)
                    continue
                letter = chr(gone)
                places = [p for p, c in enumerate(word) if c == letter]
                names = None if len(word) - 1 <= LONG else _long_rests(word.encode("latin-1"))[1]
                rest += [word[:p] + word[p + 1 :] for p in places] if names is None else [names[p] for p in places]
                place += places
                first += [p == 0 or word[p - 1] != letter for p in places]
                at += [i] * len(places)
            own = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(rest, pa.string()), pa.array(place, pa.int32()), pa.array(first, pa.bool_()), batch.column(1).take(own), batch.column(2).take(own)], ["rest", "place", "first", "word", "n"])

    return rows.select("gone", "word", "n").mapInArrow(each, "rest string, place int, first boolean, word string, n long")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): how many of ``words`` (word, n; each once) are one letter off, and the one of largest n as (-n, word); words without any are left out."""
    under = Window.partitionBy("key")
    met = keyed(words).withColumn("differ", F.min("gone").over(under) != F.max("gone").over(under)).where("differ")
    itself = F.struct((-F.col("n")).alias("less"), F.col("word").alias("word"))
    found = rests(met).withColumn("itself", itself)
    same, here = Window.partitionBy("rest"), Window.partitionBy("rest", "place")
    ranked = here.orderBy("itself")
    found = found.select(
        "word", "place", "first",
        F.min(F.when(F.col("place") < 0, F.col("itself"))).over(same).alias("shorter"),
        F.count(F.when(F.col("first"), 1)).over(same).alias("n_longer"),
        F.min(F.when(F.col("first"), F.col("itself"))).over(same).alias("longer"),
        (F.count("*").over(here) - 1).alias("n_replaced"),
        F.when(F.row_number().over(ranked) == 1, F.lead("itself").over(ranked)).otherwise(F.first("itself").over(ranked)).alias("replaced"),
    )
    own = F.col("place") < 0
    cut = F.col("first") & F.col("shorter").isNotNull()
    near = F.when(own, F.col("n_longer")).otherwise(F.col("n_replaced") + F.when(cut, 1).otherwise(0))
    best = F.when(own, F.col("longer")).otherwise(F.least("replaced", F.when(cut, F.col("shorter"))))
    found = found.select("word", near.alias("near"), best.alias("best")).where("near > 0")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def rooted(forms: DataFrame, most_n: int, ratio: int = RATIO, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last by pointer doubling. Counts grow by ``ratio`` with each step, which bounds the rounds."""
    out = written(forms.select("word", F.col("form").alias("root")), "roots")
    steps = int(math.log(max(most_n, 1) / least_count, ratio)) + 1 if most_n >= least_count * ratio else 1
    for _ in range(math.ceil(math.log2(steps))):
        ahead = out.select(F.col("word").alias("root"), F.col("root").alias("next"))
        out = written(out.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return out


def variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = RATIO, one_in: int = ONE_IN) -> DataFrame:
    """(word, form, root, n, n_near, form_n): form is the most frequent near word if it has ``ratio`` times the word's count or more, root the last of forms followed."""
    words = written(counted(docs, least_letters, one_in).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count), "words")
    out = words.join(near_words(words), "word", "left")
    has = -F.col("best.less") >= ratio * F.col("n")
    out = written(out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best.word")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")), "forms")
    roots = rooted(out.where("form is not null"), words.agg(F.max("n")).first()[0] or 0, ratio, least_count)
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
