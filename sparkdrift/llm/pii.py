"""Personal data: patterns propose spans, checksums confirm them, nearby words move their score."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from sparkdrift.llm.frames import col, free_name

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "local_phone")
KINDS = BASE_KINDS + ADDED_KINDS

# The look-behinds keep a scan linear on long runs of digits. They change nothing: where a match cannot
# start at the front of such a run, it cannot start inside it either.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL_PART = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])")
DIGITS = re.compile(r"[0-9]")
WORD = re.compile(r"[^\W\d_]+")

#: Score of a proposal before and after its checksum, for each kind.
START = {"email": 0.9, "ip": 0.6, "card": 0.3, "phone": 0.6, "iban": 0.3, "ssn": 0.4, "local_phone": 0.5}
CONFIRMED = {"card": 0.6, "iban": 0.6}
#: Words within REACH characters that speak for a kind, and words that speak against all of them.
REACH = 48
FOR = {
    "email": {"mail", "email", "contact", "write"},
    "ip": {"ip", "host", "server", "address"},
    "card": {"card", "credit", "visa", "mastercard", "payment"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax"},
    "iban": {"iban", "account", "bank", "transfer"},
    "ssn": {"ssn", "social", "security"},
    "local_phone": {"phone", "tel", "telephone", "call", "mobile", "fax"},
}
AGAINST = {"version", "order", "invoice", "isbn", "serial", "example"}
STEP = 0.3
LEAST = 0.7


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    packed = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


def _digits(found: str) -> str:
    return "".join(DIGITS.findall(found))


def _emails(text: str):
    """Leftmost matches of the address pattern, found from each @ so that long words cost no rescans."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL_PART.match(text[start - 1]):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def _base(text: str):
    """(kind, start, end) of the kinds that depend on pattern and checksum alone."""
    if "@" in text:
        for start, end in _emails(text):
            yield "email", start, end
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _digits(m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end()


def _added(text: str):
    for m in IBAN.finditer(text):
        yield "iban", m.start(), m.end(), mod97(m[0])
    if "-" in text:
        for m in SSN.finditer(text):
            yield "ssn", m.start(), m.end(), False
    for m in LOCAL_PHONE.finditer(text):
        yield "local_phone", m.start(), m.end(), False


def score(text: str, kind: str, start: int, end: int, confirmed: bool) -> float:
    """Between 0 and 1: the pattern's own weight, the checksum, and the words around."""
    before, after = text[max(0, start - REACH) : start], text[end : end + REACH]
    near = {w.lower() for w in WORD.findall(before) + WORD.findall(after)}
    value = START[kind] + CONFIRMED.get(kind, 0) * confirmed
    value += STEP * bool(near & FOR[kind]) - STEP * bool(near & AGAINST)
    return round(min(1.0, max(0.0, value)), 6)


def spans_of(text: str | None) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, base) by kind as in KINDS, then start; offsets count code points.

    Base spans stay whatever their score. Added ones need LEAST, and give way to base spans they overlap.
    """
    if not text or not DIGITS.search(text) and "@" not in text:
        return []
    found = [(k, s, e, score(text, k, s, e, True), True) for k, s, e in _base(text)]
    starts = sorted(s for _, s, _, _, _ in found)
    ends = sorted(e for _, _, e, _, _ in found)
    for kind, start, end, confirmed in _added(text):
        value = score(text, kind, start, end, confirmed)
        # As many base spans start before this one's end as end before its start: none overlaps it.
        if value >= LEAST and bisect_left(starts, end) == bisect_right(ends, start):
            found.append((kind, start, end, value, False))
    return sorted(found, key=lambda x: (KINDS.index(x[0]), x[1]))


def masked(text: str, spans) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first one."""
    out, end = [], 0
    for kind, start, stop, *_ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= end:
            out += [text[end:start], f"[{kind.upper()}]"]
        end = max(end, stop)
    return "".join([*out, text[end:]])


SPAN = pa.struct(
    [
        ("kind", pa.string()),
        ("start", pa.int64()),
        ("end", pa.int64()),
        ("score", pa.float64()),
        ("base", pa.bool_()),
    ]
)
SPAN_TYPE = StructType(
    [
        StructField("kind", StringType()),
        StructField("start", LongType()),
        StructField("end", LongType()),
        StructField("score", DoubleType()),
        StructField("base", BooleanType()),
    ]
)


def find_personal_data(docs: DataFrame, text: str = "text", redact: bool = False) -> DataFrame:
    """``docs`` with ``spans``, an array of (kind, start, end, score, base), and masked texts if ``redact``.

    Each row is read by itself, so repeated rows get the same result and nothing is shuffled. Null and empty
    texts have no spans and stay as they are. A column called spans makes the new one spans_.
    """
    name = free_name(docs, "spans")
    schema = StructType([*docs.schema.fields, StructField(name, ArrayType(SPAN_TYPE))])
    place = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(place).to_pylist()
                found = [spans_of(x) for x in texts]
                columns = list(part.columns)
                if redact:
                    new = [masked(x, s) if s else x for x, s in zip(texts, found)]
                    columns[place] = pa.array(new, type=columns[place].type)
                listed = [[dict(zip(("kind", "start", "end", "score", "base"), s)) for s in row] for row in found]
                columns.append(pa.array(listed, type=pa.list_(SPAN)))
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, name])

    return docs.mapInArrow(run, schema)


def span_digest(found: DataFrame, key: str = "doc_id", spans: str = "spans") -> DataFrame:
    """One row per document: counts of the base kinds, a hash of the base spans, and all spans as text."""

    def listed(array):
        return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter(col(spans), lambda s: s["base"])

    def counted(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [counted(kind) for kind in BASE_KINDS]
    digest = F.sha2(listed(base).cast("binary"), 256).alias("base_sha256")
    return found.select(col(key), *counts, digest, listed(col(spans)).alias("spans"))
