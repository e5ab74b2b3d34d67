"""Personal data in texts: e-mail and IP addresses, card and phone numbers, by weak supervision.

Fixed patterns give the base spans. Looser patterns give candidates: addresses that are spelled out, numbers without a plus, cards that stand beside
other digits, bracketed and version 6 addresses. Labelers vote on every span, base or candidate: expressions over its form, gazetteers
(top-level domains, card issuers, address blocks, dialling prefixes), and its context (words before it, signs beside it, base spans in the document).
Expectation-maximisation over the counts of vote patterns, a kind at a time and over all spans of the corpus, estimates how reliable
each labeler is on either side, and with that how likely each pattern is personal data. These chances train the final classifier of spans, a
logistic model over votes, shapes and words around. A candidate that it accepts is added; base spans stay whatever it says.

The patterns are written so that each runs in time linear in the text. Spans are code points, end exclusive. The number of vote
patterns is bounded by the labelers, the classifier is fitted on ``FIT_SPANS`` spans with the least hashes at most, all else sees every span.

Null texts count as empty; rows that repeat give a row each; very long texts are read whole; of candidates that overlap the likelier one
stays, of equals the earlier, then the longer; an empty table gives an empty result. Other columns may have any name, for only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, written
from .quality import sigmoid

KINDS = ("email", "ip", "card", "phone")
#: Spans that the classifier is fitted on; hashed features a kind; the chance from which a candidate is added; characters of context.
FIT_SPANS, WIDTH, ACCEPT, AROUND = 20_000, 1024, 0.95, 32

# -- base spans: each pattern matches where its plain form does, without going back over what it has read --------------------------

_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_DIGITS_ONLY = re.compile("[^0-9]+")

Span = tuple[int, int, int]  # start, kind, end


def digits(s: str) -> str:
    return _DIGITS_ONLY.sub("", s)


def luhn(number: str) -> bool:
    twice = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    return (sum(map(int, number[-1::-2])) + sum(twice[int(c)] for c in number[-2::-2])) % 10 == 0


def octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def base_spans(text: str) -> list[Span]:
    """In the order of start, then kind."""
    out: list[Span] = []
    if "@" in text:
        low = 0
        for at in re.finditer("@", text):
            m = _AT.match(text, at.start())
            if m:
                before = text[low : at.start()]
                local = len(before) - len(before.rstrip(_LOCAL))
                if local:
                    out.append((at.start() - local, 0, m.end()))
            low = m.end() if m and local else at.end()
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if octets(m[0])]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(number := digits(m[0])) <= 19 and luhn(number):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


# -- candidates ---------------------------------------------------------------------------------------------------------------

_SPELLED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}(?:\s?[\[({<]\s?at\s?[\])}>]\s?|\s?[@＠]\s?|\sat\s(?=[A-Za-z0-9-]{1,63}(?:\s[A-Za-z0-9-]{1,63})?\sdot\s))"
    r"[A-Za-z0-9][A-Za-z0-9-]{0,62}(?:(?:\.|\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s)[A-Za-z0-9][A-Za-z0-9-]{0,62}){0,8}",
    re.IGNORECASE,
)
_HINTS = ("@", "＠", "at)", "at]", "at}", "at>", "at )", "at ]", " dot ")
_BRACKETED = re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\s?[\[({]\s?(?:\.|dot)\s?[\])}]\s?[0-9]{1,3}){3}(?![0-9A-Za-z])", re.IGNORECASE)
_SIX = re.compile(r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])")
_LONG_NUMBER = re.compile(r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}([ ./\u00a0-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ ./\u00a0-])[0-9]{6}\2[0-9]{4,5})(?![0-9A-Za-z])")
_NUMBER = re.compile(r"(?<![0-9A-Za-z+.])(?:\+\s?|00)?\(?[0-9]{1,5}\)?(?:[ ./\u00a0-]\(?[0-9]{2,8}\)?){1,4}(?![0-9A-Za-z])")


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Spans of the looser patterns that meet no base span, each once."""
    found: list[Span] = []
    low = text.lower() if "@" not in text else ""
    if "@" in text or any(h in low for h in _HINTS):
        found += [(m.start(), 0, m.end()) for m in _SPELLED.finditer(text)]
    if _DIGIT.search(text):
        if any(c in text for c in "[({"):
            found += [(m.start(), 1, m.end()) for m in _BRACKETED.finditer(text)]
        if ":" in text:
            found += [(m.start(), 1, m.end()) for m in _SIX.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in _LONG_NUMBER.finditer(text)]
        found += [(m.start(), 3, m.end()) for m in _NUMBER.finditer(text) if 7 <= len(digits(m[0])) <= 15]
    if not found or not base:
        return sorted(set(found))
    ends, starts, reach = [], [], 0
    for s, _, e in base:
        reach = max(reach, e)
        starts.append(s)
        ends.append(reach)
    return sorted({x for x in found if (i := bisect_left(starts, x[2])) == 0 or ends[i - 1] <= x[0]})


# -- labelers: 1 for personal data, -1 against, 0 for no opinion ---------------------------------------------------------------

# Top-level domains, and words that stand before each kind or before other numbers, in five languages.
_TOP_LEVEL = set("com org net edu gov mil int info biz name io co ai app dev me tv eu uk ie us ca au nz de at ch fr be lu nl es pt it pl cz se no dk fi gr jp cn in br mx ar cl za ru ua tr example test invalid".split())
_CUES = {
    "email": "mail email e-mail courriel correo contact write address",
    "ip": "ip ipv4 ipv6 host server addr client login gateway",
    "card": "card visa mastercard amex credit karte kreditkarte carte tarjeta cartao",
    "phone": "phone tel telephone call mobile cell fax whatsapp telefon handy anruf téléphone portable appelez teléfono móvil llame",
}
_OTHER = "order invoice isbn issn version ref id sku no nr date page serial tracking commit bestellung rechnung commande facture pedido factura"
_CUE_OF = {w: kind for kind, words in _CUES.items() for w in words.split()} | dict.fromkeys(_OTHER.split(), "other")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
_DATE = re.compile(r"(?:19|20)[0-9]{2}[ ./-][0-9]{1,2}[ ./-][0-9]{1,2}|[0-9]{1,2}[ ./-][0-9]{1,2}[ ./-](?:19|20)?[0-9]{2}")
_LABELERS = 7
#: How often the labelers are taken to be right before any span is seen, in the order of ``votes``, and how many spans that counts as.
RIGHT, WEIGHT = (0.95, 0.7, 0.95, 0.85, 0.9, 0.75, 0.6), 25.0


def _form(kind: str, s: str) -> tuple[int, int, int]:
    """Votes of two labelers by form and one by gazetteer."""
    d = digits(s)
    if kind == "email":
        domain = re.split(r"[@＠]|[\[({<]\s?at\s?[\])}>]|\sat\s", s, maxsplit=1, flags=re.IGNORECASE)[-1]
        labels = [x for x in re.split(r"[^A-Za-z0-9-]+(?:dot[^A-Za-z0-9-]+)?", domain.strip(), flags=re.IGNORECASE) if x]
        last = labels[-1] if labels else ""
        return 1 if len(labels) > 1 else -1, 1 if len(labels) > 1 and 2 <= len(last) <= 24 and last.isalpha() else -1, 1 if last.lower() in _TOP_LEVEL else -1
    if kind == "ip":
        if ":" in s:
            groups = [g for g in s.split(":") if g]
            return 1 if len(groups) == 8 or "::" in s else -1, 1 if any(c.isdigit() for c in s) else -1, 1 if s[:1] in "23fF" else -1
        parts = [p for p in re.split("[^0-9]+", s) if p]
        fit = len(parts) == 4 and octets(".".join(parts))
        return 1 if fit else -1, -1 if any(len(p) > 1 and p[0] == "0" for p in parts) else 1, 1 if fit and 1 <= int(parts[0]) <= 223 else -1
    if kind == "card":
        issuer = d[:1] == "4" and len(d) in (13, 16, 19) or len(d) == 16 and (51 <= int(d[:2]) <= 55 or 2221 <= int(d[:4]) <= 2720 or d[:4] == "6011" or d[:2] in ("62", "65")) or d[:2] in ("34", "37") and len(d) == 15 or d[:2] in ("36", "38") and len(d) == 14 or d[:2] == "35" and len(d) == 16
        return 1 if len(d) in (15, 16) else 0, 1 if luhn(d) else -1, 1 if issuer else -1
    plain = re.sub(r"^(?:\+\s?|00)", "", s)
    groups = [len(g) for g in re.split("[^0-9]+", plain) if g]
    dialled = plain != s and d.lstrip("0") != ""
    shape = 1 if dialled or groups[-2:] == [3, 4] else -1
    known = 1 if dialled or groups[-3:] == [3, 3, 4] and d[-10] in "23456789" else -1
    if _DATE.fullmatch(s.strip()):
        shape = known = -1
    return shape, 1 if 9 <= len(d) <= 15 else -1, known


def votes(kind: int, s: str, before: str, after: str, is_base: bool, n_base: int) -> str:
    """A sign for each labeler: base pattern, two by form, gazetteer, words before, signs beside, company in the document."""
    name = KINDS[kind]
    # What a span has beyond its kind's usual length tells nothing more.
    shape, check, known = _form(name, s[:256])
    cues = [_CUE_OF[w] for w in _WORD.findall(before.lower())[-4:] if w in _CUE_OF]
    cue = 0 if not cues else 1 if cues[-1] == name else -1
    tight = before[-1:].isalnum() or before[-1:] in ("_", "=", "/", "#") or after[:1].isalnum() or after[:1] in ("_", "=", "/", "@")
    company = 1 if n_base - is_base > 0 else 0
    return "".join("-0+"[v + 1] for v in (1 if is_base else 0, shape, check, known, cue, -1 if tight else 1, company))


def found_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): a row for each document with its base spans and candidates; span: kind, start, end, base, votes, before, body, after."""
    item = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.string()), ("before", pa.string()), ("body", pa.string()), ("after", pa.string())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                more = candidates(text, base)
                row = []
                for is_base, (start, kind, end) in [*((True, x) for x in base), *((False, x) for x in more)]:
                    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
                    body = text[start : min(end, start + 256)]
                    row.append({"kind": kind, "start": start, "end": end, "base": is_base, "votes": votes(kind, body, before, after, is_base, len(base)), "before": before, "body": body, "after": after})
                rows.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(item))], ["doc_id", "spans"])

    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind_of_id = docs.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(each, f"doc_id {kind_of_id}, spans array<struct<kind:int,start:long,end:long,base:boolean,votes:string,before:string,body:string,after:string>>")


# -- label model --------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Reliability:
    """right[y, j]: chance that labeler j, if it votes, votes for personal data when the span is (y = 1) or is not (y = 0)."""

    prior: float
    right: np.ndarray
    loose: float = 0.5  # prior of spans that the base patterns do not match

    def weights(self) -> np.ndarray:
        """Of a linear model that says the same of spans outside the base patterns: of votes against, none and for, a labeler after the other, and at the end the bias."""
        against, up = np.log((1 - self.right[1]) / (1 - self.right[0])), np.log(self.right[1] / self.right[0])
        return np.r_[np.stack([against, 0 * up, up], axis=1).ravel(), np.log(self.loose / (1 - self.loose))]

    def chances(self, v: np.ndarray) -> np.ndarray:
        up = (v > 0) @ np.log(self.right.T) + (v < 0) @ np.log(1 - self.right.T)
        return sigmoid(np.log(self.prior / (1 - self.prior)) + up[:, 1] - up[:, 0])


def signs(patterns: list[str]) -> np.ndarray:
    return np.array([["-0+".index(c) - 1 for c in p] for p in patterns], float).reshape(len(patterns), _LABELERS)


def reliabilities(v: np.ndarray, count: np.ndarray, rounds: int = 200) -> Reliability:
    """Expectation-maximisation over vote patterns and their counts, from ``RIGHT``, which also holds as ``WEIGHT`` spans on either side."""
    good = np.stack([1 - np.array(RIGHT), np.array(RIGHT)])
    p = Reliability(0.5, good).chances(v)
    for _ in range(rounds):
        prior = (p @ count + 1) / (count.sum() + 2)
        side = np.stack([(1 - p) * count, p * count])
        right = (side @ (v > 0) + WEIGHT * good) / (side @ (v != 0) + WEIGHT)
        model = Reliability(float(prior), right)
        new = model.chances(v)
        if len(p) == 0 or np.abs(new - p).max() < 1e-10:
            break
        p = new
    off = v[:, 0] == 0 if len(v) else np.zeros(0, bool)
    return Reliability(model.prior, model.right, float((p[off] @ count[off] + WEIGHT / 2) / (count[off].sum() + WEIGHT)))


# -- final classifier ---------------------------------------------------------------------------------------------------------


def shape(s: str) -> str:
    return re.sub(r"(.)\1+", r"\1", re.sub("[^\\W\\d_]", "a", re.sub("[0-9]", "9", s[:64])))


def features(v: str, before: str, body: str, after: str) -> list[int]:
    """Places of the features of a span that are there: votes but that of the base pattern, its shape, and the words and signs around it."""
    own = [3 * j + "-0+".index(c) for j, c in enumerate(v) if j]
    left, right = _WORD.findall(before.lower())[-2:], _WORD.findall(after.lower())[:1]
    words = [f"s{shape(body)}", f"n{len(digits(body))}", *(f"l{w}" for w in left), *(f"r{w}" for w in right), f"b{shape(before[-1:])}", f"a{shape(after[:1])}"]
    return own + [3 * _LABELERS + zlib.crc32(w.encode()) % (WIDTH - 3 * _LABELERS - 1) for w in words] + [WIDTH - 1]


def fit(rows: list[list[int]], p: np.ndarray, labels: Reliability, steps: int = 300, rate: float = 0.05) -> np.ndarray:
    """Weights of a logistic model of the chances ``p``, held to those of the label model, hashed features to none; so votes that no span of the fit has still count."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([c for r in rows for c in r], np.int64)
    start, ridge = np.zeros(WIDTH), np.full(WIDTH, 3e-2)
    own = labels.weights()
    start[: 3 * _LABELERS], start[-1] = own[:-1], own[-1]
    w, m, s = start.copy(), np.zeros(WIDTH), np.zeros(WIDTH)
    for t in range(1, steps + 1 if len(rows) else 1):
        e = sigmoid(np.bincount(at, w[col], minlength=len(rows))) - p
        g = np.bincount(col, e[at], minlength=WIDTH) / len(rows) + ridge * (w - start)
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return w


def fitted(found: DataFrame, fit_spans: int = FIT_SPANS) -> tuple[dict[int, Reliability], dict[int, np.ndarray]]:
    """The label model of each kind, from all spans, and the classifier of each kind, from ``fit_spans`` of them: those with the least hashes."""
    spans = found.select(F.explode("spans").alias("x")).select("x.*")
    patterns = spans.groupBy("kind", "votes").agg(F.count("*").alias("n")).orderBy("kind", "votes").collect()  # at most 3^7 a kind
    # Hashes under a bound that leaves about twice as many spans as are wanted, so that tasks send no more than that to the driver.
    share = min(1.0, 2 * fit_spans / max(1, sum(r["n"] for r in patterns)))
    some = spans.select("kind", "votes", "before", "body", "after", "start", F.xxhash64("kind", "before", "body", "after", "start").alias("h"))
    some = some.where(F.pmod("h", F.lit(1_000_000)) < int(share * 1_000_000)).orderBy(F.pmod("h", F.lit(1_000_000)), "h", "kind", "start", "body").limit(fit_spans).collect()
    labels, models = {}, {}
    for kind in range(len(KINDS)):
        own = [r for r in patterns if r["kind"] == kind]
        labels[kind] = reliabilities(signs([r["votes"] for r in own]), np.array([r["n"] for r in own], float))
        rows = [r for r in some if r["kind"] == kind]
        p = labels[kind].chances(signs([r["votes"] for r in rows]))
        models[kind] = fit([features(r["votes"], r["before"], r["body"], r["after"]) for r in rows], p, labels[kind])
    return labels, models


def chosen(spans: list[dict], models: dict[int, np.ndarray], accept: float) -> list[Span]:
    """Base spans and the candidates that the classifier accepts, by start and kind."""
    out = [(x["start"], x["kind"], x["end"]) for x in spans if x["base"]]
    scored = []
    for x in spans:
        if not x["base"]:
            p = float(sigmoid(models[x["kind"]][features(x["votes"], x["before"], x["body"], x["after"])].sum()))
            if p >= accept:
                scored.append((-p, x["start"], -x["end"], x["kind"]))
    starts: list[int] = []
    ends: list[int] = []
    for _, start, end, kind in sorted(scored):
        i = bisect_left(starts, start)
        if (i == 0 or ends[i - 1] <= start) and (i == len(starts) or -end <= starts[i]):
            starts.insert(i, start)
            ends.insert(i, -end)
            out.append((start, kind, -end))
    return sorted(out)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def digest(docs: DataFrame, fit_spans: int = FIT_SPANS, accept: float = ACCEPT) -> DataFrame:
    """What the query returns: (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans); the numbers are those of base spans."""
    found = written(found_spans(docs), "private")
    models = docs.sparkSession.sparkContext.broadcast(fitted(found, fit_spans)[1])  # WIDTH numbers a kind

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hashes, texts = [], [], []
            for spans in batch.column(1).to_pylist():
                base = sorted((x["start"], x["kind"], x["end"]) for x in spans if x["base"])
                counts.append([sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))])
                hashes.append(hashlib.sha256(listed(base).encode()).hexdigest())
                texts.append(listed(chosen(spans, models.value, accept)))
            columns = np.array(counts, np.int64).reshape(len(counts), len(KINDS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(columns[:, i]) for i in range(len(KINDS))), pa.array(hashes, pa.string()), pa.array(texts, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind_of_id = docs.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(each, f"doc_id {kind_of_id}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")
