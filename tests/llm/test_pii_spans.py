from __future__ import annotations

import hashlib
import random
import re
import time

from tastemill.llm import pii_spans as P

# The contract's patterns as they stand.
RAW = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute(text):
    out = []
    for kind, pattern in RAW.items():
        for m in pattern.finditer(text):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_brute_force():
    rnd = random.Random(3)
    bits = ["a", "b.c", "@", "@@", ".", "..", "1", "12", "255", "256", "1.2.3.4", "+", "+1", " ", "-", "(", ")", "é", "x@y.z", "4111 1111 1111 1111", "4111-1111-1111-1111", "0", "%", "_", "\n"]
    for _ in range(20_000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25)))
        assert [s[:3] for s in P.find(text) if s.kind in P.BASE] == brute(text), text


def test_added_kinds_and_context():
    assert [s[:3] for s in P.find("IBAN DE89 3704 0044 0532 0130 00.")] == [("iban", 5, 32)]
    assert P.find("IBAN DE89 3704 0044 0532 0130 01.") == []
    assert [s.kind for s in P.find("amex 378282246310005")] == ["pan"]
    assert P.find("number 378282246310005") == []
    near = P.find("credit card 4111111111111111")[0]
    far = P.find("number 4111111111111111")[0]
    assert near.score > far.score
    assert P.redact("mail a@b.co now") == "mail <email> now"


def test_ibans_end_with_their_country_s_length():
    iban = "DE89 3704 0044 0532 0130 00"
    for text in (f"{iban} BIC COBADEFF", f"{iban}, AB", f"IBAN: {iban.replace(' ', '')} X", f"{iban}\nGB82WEST12345698765432 Z"):
        a = text.index("DE89")
        assert [s[:3] for s in P.find(text) if s.kind == "iban"][0] == ("iban", a, a + len(iban.replace(" ", "") if "DE89370" in text else iban))
    assert [s.start for s in P.find(f"{iban}\nGB82WEST12345698765432 Z") if s.kind == "iban"] == [0, 28]
    assert not [s for s in P.find("DE89 3704 0044 0532 0130 00X") if s.kind == "iban"]
    assert not [s for s in P.find("ZZ89 3704 0044 0532 0130 00") if s.kind == "iban"]


def test_long_runs_take_linear_time():
    began = time.time()
    for text in ("a" * 400_000 + "@", "1" * 400_000, "1." * 200_000, "+" * 400_000, "1 " * 200_000, "a@" * 200_000, "A" * 300_000, "DE89 " * 80_000, "DE89" * 100_000):
        P.find(text)
    assert time.time() - began < 20


def test_rows(spark):
    rows = [(1, "a@b.cd é 1.2.3.4", "p"), (1, "a@b.cd é 1.2.3.4", "p"), (None, None, None), (4, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in P.summary(docs).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = "email:0:6,ip:9:16"
    assert got == {(1, 1, 1, 0, 0, sha(want), want), (None, 0, 0, 0, 0, sha(""), ""), (4, 0, 0, 0, 0, sha(""), "")}
    assert P.summary(docs).count() == 4 and P.summary(docs.limit(0)).count() == 0
    assert P.span_table(docs).count() == 4
