import hashlib
import random
import re

from pyspark.sql import functions as F

from sparkdrift.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    """Base spans by the plain patterns."""
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(sum(map(int, str(int(d) * (1 + i % 2)))) for i, d in enumerate(reversed(digits)))
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".") if kind == "ip"),
                "card": 13 <= len(digits) <= 19 and total % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def texts():
    rng = random.Random(8)
    parts = ["a.b@c.de", "x@y", "@", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8.9", "4111 1111 1111 1111", "+1 (242) 555-3475"]
    parts += ["4111-1111-1111-1112", "+", "..", "é", "\n", " ", "-", "a@b.c@d.e", "007", "+44 20 7946 0958", "%", "word", "00001.2.3.4"]
    out = [None, "", "no data", "9" * 5000, "a" * 5000 + "@", "+1" * 500, "1 " * 3000, "a@" * 900, "é" * 3 + "me@x.org"]
    return out + ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(1500)]


def test_base_spans_equal_the_plain_patterns():
    for text in texts():
        assert [s[:3] for s in pii.spans_of(text) if s[4]] == brute(text), text


def test_long_texts_take_linear_time():
    for text in ("a" * 1_000_000, "1" * 1_000_000, "a@" * 300_000, "+1" * 300_000, "1.2.3" * 200_000):
        pii.spans_of(text)


def test_added_kinds_need_checksum_or_context():
    def kinds(text):
        return [s[0] for s in pii.spans_of(text)]

    assert kinds("transfer to IBAN GB82 WEST 1234 5698 7654 32 today") == ["iban"]
    assert kinds("transfer to IBAN GB82 WEST 1234 5698 7654 33 today") == []
    assert kinds("her ssn 536-22-1234") == ["ssn"] and kinds("part 536-22-1234") == []
    assert kinds("call 305 555-7981") == ["local_phone"] and kinds("lot 305 555-7981") == []
    assert kinds("phone +1 305 555-7981") == ["phone"]


def test_query_columns(spark):
    rows = [(i, t) for i, t in enumerate(texts()[:200])] + [(7, "me@x.org"), (7, "me@x.org"), (None, "1.2.3.4")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(3))
    found = pii.find_personal_data(docs, redact=True)
    assert found.columns == ["doc_id", "text", "spans", "spans_"]
    digest = pii.span_digest(found, spans="spans_").collect()
    for (key, text), row in zip(rows, digest):
        base = brute(text)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert row.doc_id == key and row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        counts = [row.n_email, row.n_ip, row.n_card, row.n_phone]
        assert counts == [sum(k == kind for k, _, _ in base) for kind in PLAIN]
        assert set(joined.split(",")) - {""} <= set(row.spans.split(","))
    masked = {r.text for r in found.where("doc_id = 7 or doc_id is null").collect()}
    assert {"[EMAIL]", "[IP]"} <= masked
    assert pii.find_personal_data(docs.limit(0)).collect() == []
