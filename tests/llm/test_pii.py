"""Personal data: base spans against the plain rule, added spans, EM direction, long texts."""

import hashlib
import re

from lectern.llm import pii

RULES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def passes(kind, text):
    d = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return 16 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in twice) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, r in RULES.items() for m in r.finditer(text or "") if passes(k, m[0])]


def test_base_and_added(spark):
    texts = [
        None, "", "a@b.c_d@e.f.g x@y z@q.com. é𝄞 me.too+x@mail-1.example.org,", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.4 1.2.3",
        "card 4111 1111 1111 1111, 4111-1111-1111-1111 41111111111111112 4111  1111 1111 1111", "+1 (555) 010-9999 +49.30.1234567- +1",
        "phone: (212) 555-0188 and ssn 123-45-6789.", "iban DE89 3704 0044 0532 0130 00 here", "write to jane at mail dot com now",
        "9" * 20_000 + " " + "1 2" * 5_000 + "\x01" + "4111\x011111", "a.b" * 9_000 + "@" + "c.d" * 6_000, "1.1.1.1" * 40,
        "4111 1111 1111 1111 4111 1111 1111 1111", "x" * 30_000, "a@b..c d@e.f-", "@@@...", "+12345678901234567890",
    ]
    rows = [(i // 2, t, 1) for i, t in enumerate(texts)]
    got = pii.scan(spark.createDataFrame(rows, "doc_id bigint, text string, spans int")).collect()
    want = []
    for i, t, _ in rows:
        spans = base(t)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        want.append((i, *[sum(x[0] == k for x in spans) for k in RULES], hashlib.sha256(joined.encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == sorted(want)
    every = " ".join(r.spans for r in got)
    assert "local:7:21" in every and "id:30:41" in every and "iban:5:32" in every


def test_empty(spark):
    assert pii.scan(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_em_orders_patterns():
    post = pii.reliabilities([(0, (1, 1, 1, 1, 1), 50), (0, (-1, -1, 0, -1, -1), 50), (0, (1, 0, 0, 0, 1), 10)])
    assert post[0, (1, 1, 1, 1, 1)] > 0.9 > 0.1 > post[0, (-1, -1, 0, -1, -1)]
