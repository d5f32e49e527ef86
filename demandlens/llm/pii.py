"""Personal data: patterns propose spans, checksums confirm, nearby words adjust the score.

Offsets are code points, end exclusive; per kind, matches are leftmost and do not overlap.
Base kinds (email, ip, card, phone) are decided by pattern and validator alone and always
stay; added kinds (iban, short_card, national_id, secret) need a score of ``min_score``.

Edge cases: a null text is an empty text (no spans); very long texts are scanned whole, in
time linear in their length; a null id, repeated rows and further columns of the input pass
without effect (only the id and text columns are read); an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "short_card", "national_id", "secret")
CONTEXT_CHARS = 48
MIN_SCORE = 0.6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No match of ip can start inside a run of digits that a search has already passed, so the
# look-behind changes no result and keeps long digit runs linear.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])")
_DIGITS = re.compile(r"[0-9]")

# Prior score of a confirmed span and the whole words that raise it when they stand near it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7,
         "iban": 0.8, "short_card": 0.4, "national_id": 0.4, "secret": 0.3}
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact"), "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"), "phone": ("phone", "telephone", "tel", "call", "mobile"),
    "iban": ("iban", "account", "bank"), "short_card": ("card", "amex", "credit", "payment"),
    "national_id": ("ssn", "social", "security", "national"),
    "secret": ("token", "key", "secret", "password"),
}
CONTEXT_GAIN = 0.35


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ is looked at once: the run of local characters before it (after the last
    match), then the domain.  Equal to a leftmost scan, without its quadratic retries."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if not _DIGITS.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGITS.findall(m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def added_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if not _DIGITS.search(text):
        return out
    out += [("iban", m.start(), m.end()) for m in _IBAN.finditer(text) if mod97(m.group())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 15 and luhn(digits):
                out.append(("short_card", m.start(), m.end()))
    out += [("national_id", m.start(), m.end()) for m in _NATIONAL.finditer(text)]
    out += [("secret", m.start(), m.end()) for m in _SECRET.finditer(text)]
    return out


_CONTEXT = {k: re.compile(r"(?<![A-Za-z0-9])(?:" + "|".join(words) + r")s?(?![A-Za-z0-9])") for k, words in CONTEXT.items()}


def score(text: str, kind: str, start: int, end: int) -> float:
    """The prior of the kind, raised where a whole context word (or its plural) stands within CONTEXT_CHARS before or
    behind the span."""
    near = f"{text[max(0, start - CONTEXT_CHARS):start]} {text[end:end + CONTEXT_CHARS]}".lower()
    return min(1.0, PRIOR[kind] + (CONTEXT_GAIN if _CONTEXT[kind].search(near) else 0.0))


def spans_of(text: str | None, min_score: float = MIN_SCORE) -> list[tuple[str, int, int, float]]:
    """All spans of a text by kind as listed, then start."""
    text = text or ""
    out = [(k, s, e, score(text, k, s, e)) for k, s, e in base_spans(text)]
    for k, s, e in added_spans(text):
        if (x := score(text, k, s, e)) >= min_score:
            out.append((k, s, e, x))
    return out


def redacted(text: str | None, min_score: float = MIN_SCORE) -> str | None:
    """The text with every maximal run of overlapping spans replaced by [KIND] of its first."""
    spans = sorted((s, -e, k) for k, s, e, _ in spans_of(text, min_score))
    if not spans:
        return text
    out, at = [], 0
    for s, neg, k in spans:
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, -neg)
    return "".join(out) + text[at:]


SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             min_score: float = MIN_SCORE) -> DataFrame:
    """(id, spans): one row per input row; spans by kind as listed, then start."""
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()),
                                ("end", pa.int64()), ("score", pa.float64())]))

    def scan(batches):
        for b in batches:
            found = [[dict(zip(("kind", "start", "end", "score"), x)) for x in spans_of(t.as_py(), min_score)]
                     for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kinds)], [id_col, "spans"])

    rows = docs.select(F.col(id_col), F.col(text_col))
    return rows.mapInArrow(scan, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, spans {SPANS}")


def redact_pii(docs: DataFrame, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The same rows and columns with the spans of the text column replaced by tags."""
    schema: StructType = docs.schema
    at = schema.fieldNames().index(text_col)

    def replace(batches):
        for b in batches:
            cols = list(b.columns)
            cols[at] = pa.array([redacted(t.as_py(), min_score) for t in cols[at]], cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(replace, schema)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of the spans of :func:`find_pii`."""
    def line(x):
        return F.concat_ws(":", x["kind"], x["start"], x["end"])

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select(
        id_col,
        *(count(k) for k in BASE_KINDS),
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda x: x["score"])), F.lit(0.0)).alias("max_score"))
