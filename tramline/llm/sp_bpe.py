"""SentencePiece BPE by backtracking, exactly as the library encodes.

The encoding that merging gives is the only sequence of reachable pieces in which every two neighbours, merged again from their
characters, come out as themselves. It is found from left to right: an Aho-Corasick automaton gives the longest piece at each
place; a piece that does not go with its neighbour is replaced by its next shorter prefix; where none goes, the place is marked
as failed in a bitfield and the piece before it is taken back. Characters without a piece become byte pieces.

No piece has a space mark behind another character, nor a letter or digit beside a mark, so texts are cut there and the parts
encoded; equal parts are encoded once per worker while a bounded memory lasts.

Null texts count as empty; an empty text has no ids; rows that repeat, or have no id, are encoded each; an empty table gives an empty
result; other columns may have any name.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

SPACE = "▁"
#: Entries of each of a worker's memories; a full one is emptied.
MEMORY = 300_000


class Memo(dict):
    """A bounded memory of a function."""

    def __init__(self, f, most: int = MEMORY):
        self.f, self.most = f, most

    def __missing__(self, x):
        if len(self) >= self.most:
            self.clear()
        got = self[x] = self.f(x)
        return got


class Codec:
    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(len(model))]
        plain = [i for i in range(len(model)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.rank = {self.pieces[i]: -model.get_score(i) for i in plain}
        self.id = {self.pieces[i]: i for i in plain}
        self.byte = {b: model.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.value = {i: b for b, i in self.byte.items()}
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("a piece has a space mark behind another character; words do not encode apart")
        self.cut = self._cut()
        self.longest = ahocorasick.Automaton()
        reachable = [p for p in self.rank if self.merge(p) == [p]]
        for p in reachable:
            self.longest.add_word(p[::-1], p)
        self.longest.make_automaton()
        known = set(reachable)
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in known), None) for p in known}
        self.right, self.left = {}, {}  # the last, or first, parts of a piece as merging undoes them
        for p in sorted(known, key=len):
            if len(p) == 1:
                self.right[p] = self.left[p] = ((p, -1),)
                continue
            a, b = self.halves(p)
            self.right[p], self.left[p] = ((p, self.rank[p]), *self.right[b]), ((p, self.rank[p]), *self.left[a])
        self.together = Memo(lambda pair: self.fits(*pair))
        self.part = Memo(self._ids_of_part)
        self.text = Memo(lambda ids: self.decode([int(x) for x in ids.split(",") if x]))

    def _cut(self) -> re.Pattern:
        """Cuts a text where no piece reaches across: before space marks, and between letters or digits and the rest.

        Letters that some piece holds beside a mark count among the marks.
        """
        odd: set[str] = set()
        while True:
            word = lambda c: c not in odd and c != "_" and c.isalnum()
            more = {c for p in self.rank for a, b in zip(p, p[1:]) if SPACE not in (a, b) and word(a) != word(b) for c in (a, b) if word(c)}
            if not more:
                break
            odd |= more
        marks = "_" + re.escape("".join(sorted(odd)))
        return re.compile(f"{SPACE}*(?:[^\\W{marks}]+|(?:(?!{SPACE})[\\W{marks}])+)|{SPACE}+")

    def halves(self, p: str) -> tuple[str, str]:
        """The two parts whose merge makes the piece, last of all merges."""
        parts = self.merge(p, p)
        if len(parts) != 2:
            raise ValueError(f"{p!r} is not made of two pieces")
        return parts[0], parts[1]

    def fits(self, a: str, b: str) -> bool:
        """Whether merging a + b gives back a and b: no merge across the border comes before the merges that close it.

        The merges beside the border are undone from the last on; of two with one rank the left one was first.
        """
        one, two, i, j, limit = self.right[a], self.left[b], 0, 0, (float("inf"), 0)
        while True:
            (x, rx), (y, ry) = one[i], two[j]
            r = self.rank.get(x + y)
            if r is not None and (r, 1) < limit:
                return False
            if rx < 0 and ry < 0:
                return True
            if rx > ry:
                limit, i = (rx, 0), i + 1
            else:
                limit, j = (ry, 2), j + 1

    def merge(self, s: str, without: str = "") -> list[str]:
        """Merging as it is defined: the pair of best rank first, the leftmost of equals. without: a piece that is not made."""
        parts = list(s)
        after = list(range(1, len(s) + 1))
        before = list(range(-1, len(s) - 1))
        heap = [(self.rank[p], i, p) for i in range(len(s) - 1) if (p := s[i : i + 2]) in self.rank]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = after[i] if parts[i] else len(s)
            if j >= len(s) or parts[i] + parts[j] != p or p == without:
                continue
            parts[i], parts[j] = p, ""
            after[i] = after[j]
            if after[i] < len(s):
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(s) and (q := parts[a] + parts[b]) in self.rank:
                    heapq.heappush(heap, (self.rank[q], a, q))
        return [p for p in parts if p]

    def pieces_of(self, s: str) -> list[str]:
        """By backtracking. s: of characters that have pieces."""
        if s in self.shorter:
            return [s]
        n = len(s)
        best: list[str | None] = [None] * n
        for end, p in self.longest.iter(s[::-1]):
            i = n - 1 - end
            if best[i] is None or len(p) > len(best[i]):
                best[i] = p
        failed, at, out, now = 0, 0, [], best[0]
        while at < n:
            last = out[-1] if out else None
            while now is not None and (failed >> (at + len(now)) & 1 or last is not None and not self.together[last, now]):
                now = self.shorter[now]
            if now is not None:
                out.append(now)
                at += len(now)
                now = best[at] if at < n else None
            else:
                failed |= 1 << at
                now = self.shorter[out.pop()]
                at -= len(last)
        return out

    def _ids_of_part(self, s: str) -> str:
        out: list[int] = []
        known = ""
        for c in [*s, None]:
            if c is not None and c in self.rank:
                known += c
                continue
            if known:
                out += [self.id[p] for p in self.pieces_of(known)]
                known = ""
            if c is not None:
                out += [self.byte[b] for b in c.encode()]
        return "".join(f"{i}," for i in out)

    def encode_words(self, text: str) -> list[str]:
        """The ids of each part, each id with a comma behind it."""
        return list(map(self.part.__getitem__, self.cut.findall(SPACE + text.replace(" ", SPACE)))) if text else []

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in "".join(self.encode_words(text)).split(",")[:-1]]

    def decode(self, ids: list[int]) -> str:
        """Pieces and bytes as text, with its first space mark kept."""
        out, held = [], b""
        for i in [*ids, -1]:
            if i in self.value:
                held += bytes([self.value[i]])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = b""
            if i >= 0:
                out.append(self.pieces[i].replace(SPACE, " "))
        return "".join(out)

    def decode_words(self, words: list[str]) -> str:
        """Bytes of a character never lie in two words, so words decode apart; the space in front of the first goes."""
        return "".join(map(self.text.__getitem__, words)).removeprefix(" ")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): the ids as decimal numbers joined by commas, and the text that they decode to."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in sliced(batches, "text"):
            words = [own.encode_words(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["".join(w)[:-1] for w in words], pa.string()), pa.array([own.decode_words(w) for w in words], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(each, f"doc_id {kind}, ids string, decoded string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """What the query returns; the hashes are taken in the worker, so that ids and texts do not travel back."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in sliced(batches, "text"):
            rows = []
            for t in batch.column(1).to_pylist():
                words = own.encode_words(t)
                ids = "".join(words)
                rows.append((ids.count(","), sha(ids[:-1]), sha(own.decode_words(words))))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(each, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
