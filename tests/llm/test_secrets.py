"""Secrets: base spans against the plain rule, random tokens found, words left alone."""

import hashlib
import random
import re

from lectern.llm import secrets

RULES = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}
KINDS = list(RULES)


def base(text):
    out = []
    for kind, rule in RULES.items():
        for m in rule.finditer(text or ""):
            if {"assign": lambda: len(m[2]) >= 6, "access": lambda: len(m[0]) >= 20, "hex": lambda: len(m[0]) >= 24}[kind]():
                out.append((m.start(), KINDS.index(kind), m.end(), kind))
    return sorted(out)


def test_base_and_random(spark):
    rng = random.Random(7)
    key = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    b64 = secrets.ALPHABETS["base64"]
    texts = [
        None, "", "plain words only", "secret: token: abcdefgh", "Password = 'abc.def=' x", "é𝄞 api_key:" + key(30, b64),
        "AKIA" + key(16, "ABCDEFGH23") + " AKIASHORT", "x" + key(24, "0123456789abcdef") + "y", key(23, "0123456789abcdef"),
        "token=short api-key=abcdefg apikey:=abcdefg", "z" * 50_000 + " " + "0" * 50_000, "A" * 25, "SECRET:\n abcdefgh",
    ] + [f"note {key(40, b64)} end" for _ in range(40)] + [f"{'thatedinghaa' * 3}" for _ in range(40)]
    rows = [(i // 2, t, "clash") for i, t in enumerate(texts)]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id bigint, text string, base string")).collect()
    assert len(got) == len(rows)
    want = []
    for i, t, _ in rows:
        spans = base(t)
        joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
        n = [sum(x[3] == k for x in spans) for k in KINDS]
        want.append((i, *n, hashlib.sha256(joined.encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == sorted(want)
    notes = [r for r in got if r.doc_id > len(texts) // 2 - 46 and "random" in r.spans]
    assert len(notes) >= 34
    assert not any("random" in r.spans for r in got if r.doc_id > (len(texts) - 40) // 2)


def test_empty(spark):
    assert secrets.scan(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
