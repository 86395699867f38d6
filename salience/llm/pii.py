r"""Personal data in texts: patterns propose spans, checksums confirm them, nearby words adjust their scores.

Base kinds (email, ip, card, phone) are the leftmost non-overlapping matches of their patterns, each kind by itself, less
those that fail their check; they are reported whatever their score. Further kinds come from the method: account numbers
(IBAN, mod 97), identity numbers, short cards and phone numbers without a country code need a checksum or a context word
to reach the threshold. Positions are code points, ends exclusive. A null or empty text has no spans; rows are
independent, so repeated ids give repeated rows, and very long texts are scanned in linear time. Other columns of the
input are not read.

The patterns are written so that no start position scans a run that an earlier one has scanned: an address is looked for
around its at sign, and a run of digits is entered at its first digit only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salience.session import ship

BASE = ["email", "ip", "card", "phone"]
KINDS = BASE + ["iban", "short_card", "local_phone", "identity"]

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+().-])(?<![0-9+] )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_IDENTITY = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

#: Score of a match before context, and words that raise it when they stand within ``REACH`` code points before it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.9, "short_card": 0.4, "local_phone": 0.3, "identity": 0.3}
CONTEXT = {
    "email": ["mail", "contact", "write to", "correo", "courriel"],
    "ip": ["ip", "address", "host", "server", "login"],
    "card": ["card", "visa", "credit", "payment", "karte", "carte", "tarjeta"],
    "phone": ["phone", "call", "tel", "mobile", "fax", "telefon", "appel", "llame"],
    "iban": ["iban", "account", "bank", "konto", "compte", "cuenta"],
    "short_card": ["card", "visa", "amex", "credit", "payment", "karte", "carte", "tarjeta"],
    "local_phone": ["phone", "call", "tel", "mobile", "fax", "telefon", "appel", "llame"],
    "identity": ["ssn", "social security", "identity", "tax id"],
}
RAISE = 0.4
REACH = 40
_NEAR = {kind: re.compile(r"\b(?:" + "|".join(words) + r")", re.I) for kind, words in CONTEXT.items()}

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())])


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The check of an account number: its first four signs go to the end, letters count from 10."""
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            # the part before the sign: the longest run of its letters that no earlier match has taken
            start = at
            low = done
            while start > low and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
                start -= 1
            if start < at:
                yield start, domain.end()
                done = domain.end()
        at = text.find("@", max(at + 1, done))


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers; a match that takes words behind the number is cut at its blanks until the check holds."""
    m = _IBAN.search(text)
    while m:
        start, end = m.span()
        while end > start:
            code = text[start:end].replace(" ", "")
            if 15 <= len(code) <= 34 and mod97(code):
                yield start, end
                break
            end = text.rfind(" ", start, end)
        # a number may begin inside what was rejected
        m = _IBAN.search(text, max(end, start + 4))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Checked matches by kind in the order of ``KINDS``, then by start."""
    if "@" in text:
        for start, end in _emails(text):
            yield "email", start, end
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            yield "ip", m.start(), m.end()
    cards, short = [], []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                (cards if len(digits) >= 16 else short).append((m.start(), m.end()))
    yield from (("card", *span) for span in cards)
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield "phone", m.start(), m.end()
    yield from (("iban", *span) for span in _ibans(text))
    yield from (("short_card", *span) for span in short)
    for m in _LOCAL_PHONE.finditer(text):
        yield "local_phone", m.start(), m.end()
    for m in _IDENTITY.finditer(text):
        yield "identity", m.start(), m.end()


def find(text: str | None, threshold: float = 0.6) -> list[dict]:
    spans = []
    for kind, start, end in proposals(text or ""):
        near = _NEAR[kind].search(text, max(0, start - REACH), start)
        score = min(1.0, PRIOR[kind] + (RAISE if near else 0.0))
        if kind in BASE or score >= threshold:
            spans.append({"kind": kind, "start": start, "end": end, "score": score, "base": kind in BASE})
    return spans


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.6) -> DataFrame:
    """Returns ``id_col`` and ``spans``, one row per input row; narrow, no shuffle."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def scan(batches):
        for batch in batches:
            texts = batch.column("text")
            for at in range(0, len(texts), 1000):
                part = texts.slice(at, 1000)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, 1000), pa.array([find(t, threshold) for t in part.to_pylist()], pa.list_(SPAN))],
                    names=["id", "spans"])

    return chosen.mapInArrow(
        scan, f"id {kind.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint,score:double,base:boolean>>"
    ).withColumnRenamed("id", id_col)
