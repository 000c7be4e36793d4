"""Personal data: patterns propose spans, checksums confirm them, context adjusts a score.

Base kinds (email, ip, card, phone) are matched leftmost and without overlap
within their kind; a match that its check rejects is dropped and not tried again
in part.  Two more kinds are proposed by the method: ``iban`` has as many
characters as its country's numbers and a correct mod-97 remainder, ``pan`` is a card number of 13 to 15 digits that passes Luhn
and has a context word near it.  Every span has a score from its pattern, raised
by a matching word and lowered by a contrary one within ``CONTEXT`` characters;
the added kinds need ``THRESHOLD``, base spans stay at any score.

Offsets are code points with an exclusive end.  Each pattern runs in time linear
in the text, also on long runs of one character and very long texts.  A null text counts as empty;
repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .storage import table

CONTEXT = 48
THRESHOLD = 0.6
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "pan")
_PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "pan": 0.4}
_FOR = {
    "email": re.compile(r"mail|contact|write|address", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|login|client", re.I),
    "card": re.compile(r"card|visa|master|credit|debit|payment|karte|tarjeta|carte", re.I),
    "phone": re.compile(r"phone|tel\b|tel\.|call|mobile|fax|telefon", re.I),
    "iban": re.compile(r"iban|account|bank|konto|cuenta|compte", re.I),
    "pan": re.compile(r"card|visa|amex|american express|diners|credit|debit|karte|tarjeta|carte", re.I),
}
_AGAINST = {
    "email": re.compile(r"example|noreply|no-reply", re.I),
    "ip": re.compile(r"version|release|section|chapter", re.I),
    "card": re.compile(r"serial|isbn|order|tracking", re.I),
    "phone": re.compile(r"serial|isbn|order|tracking", re.I),
    "iban": re.compile(r"serial|hash|token", re.I),
    "pan": re.compile(r"serial|isbn|order|tracking|timestamp", re.I),
}

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't begin inside a run of digits: what follows the run decides for each of its starts alike.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
#: How many characters an IBAN of each country has, without spaces.
_IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22,
    "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27,
    "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31,
    "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    plain = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            # The next local part may not reach back over this sign.
            done = at + 1
        at = text.find("@", done)


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _iban_end(text: str, at: int, left: int) -> int:
    """The place after ``left`` more letters and digits, single spaces between them passed over; -1 if they aren't there or the word goes on."""
    while left:
        if text[at : at + 1] == " ":
            at += 1
        c = text[at : at + 1]
        if not ("A" <= c <= "Z" or "0" <= c <= "9"):
            return -1
        at += 1
        left -= 1
    return -1 if text[at : at + 1].isascii() and text[at : at + 1].isalnum() else at


def _proposed(text: str):
    for a, b in _emails(text):
        yield "email", a, b
    for m in _IP.finditer(text):
        if all(map(_byte, m.group().split("."))):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = _digits(m.group())
            if 13 <= len(d) <= 19 and luhn(d):
                yield "card" if len(d) >= 16 else "pan", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m.group())) <= 15:
                yield "phone", m.start(), m.end()
    done = 0
    for m in _IBAN.finditer(text):
        length = _IBAN_LENGTHS.get(m.group()[:2])
        end = _iban_end(text, m.end(), length - 4) if length and m.start() >= done else -1
        if end >= 0 and mod97(text[m.start() : end]):
            yield "iban", m.start(), end
            done = end


def _scored(text: str, kind: str, a: int, b: int) -> float:
    before, after = text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
    score = _PRIOR[kind]
    if _FOR[kind].search(before) or _FOR[kind].search(after):
        score += 0.3
    if _AGAINST[kind].search(before) or _AGAINST[kind].search(after):
        score -= 0.3
    return round(min(1.0, max(0.0, score)), 3)


def find(text: str | None) -> list[Span]:
    """All spans of a text, by kind as in KINDS, then by start."""
    text = text or ""
    spans = [Span(k, a, b, _scored(text, k, a, b)) for k, a, b in _proposed(text)]
    spans = [s for s in spans if s.kind in BASE or s.score >= THRESHOLD]
    return sorted(spans, key=lambda s: (KINDS.index(s.kind), s.start))


def redact(text: str | None) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the earliest, longest."""
    text, out, at = text or "", [], 0
    for s in sorted(find(text), key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"<{s.kind}>"]
            at = s.end
    return "".join(out) + text[at:]


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def span_table(docs: DataFrame) -> DataFrame:
    """doc_id, kind, start, end, score: a row for each span."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, found = [], []
            for i, scalar in enumerate(batch.column(1)):
                own = find(scalar.as_py())
                ids += [i] * len(own)
                found += own
            cols = [batch.column(0).take(pa.array(ids, pa.int64()))]
            cols += [pa.array([s[k] for s in found], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "kind", "start", "end", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, kind string, start long, end long, score double")


def summary(docs: DataFrame) -> DataFrame:
    """One row per document: counts of base kinds, the digest of base spans, all spans, and their scores in the same order."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [find(scalar.as_py()) for scalar in batch.column(1)]
            base = [[s for s in own if s.kind in BASE] for own in rows]
            cols = [batch.column(0)]
            cols += [pa.array([sum(s.kind == k for s in own) for own in base], pa.int64()) for k in BASE]
            cols.append(pa.array([hashlib.sha256(_joined(own).encode()).hexdigest() for own in base], pa.string()))
            cols.append(pa.array([_joined(own) for own in rows], pa.string()))
            cols.append(pa.array([",".join(f"{s.score:.1f}" for s in own) for own in rows], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "scores"])

    fields = ", ".join(f"n_{k} long" for k in BASE)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {fields}, base_sha256 string, spans string, scores string")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(table(spark, sf_dir, "documents"))


QUERIES = {"op3_pii": op3_pii}
ORACLES: dict[str, str] = {}
