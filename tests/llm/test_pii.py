import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from roadlens.llm.pii import find_spans, luhn, mask_text, masked, mod97, personal_data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card" and not (16 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a_@.1+- ()4é9", max_size=60))
def test_base_spans_like_the_patterns(text):
    assert [x[:3] for x in find_spans(text) if x[4]] == brute(text)


def test_cards_accounts_and_context():
    assert [x[0] for x in find_spans("4111 1111 1111 1111")] == ["card"] and not find_spans("4111 1111 1111 1112")
    assert mod97("DE89370400440532013000")
    assert [(x[0], x[1], x[2]) for x in find_spans("é pay DE89 3704 0044 0532 0130 00 NOW")] == [("iban", 6, 33)]
    assert not find_spans("DE88 3704 0044 0532 0130 00")
    assert [x[0] for x in find_spans("my ssn is 123-45-6789")] == ["ssn"] and not find_spans("part 123-45-6789")
    assert [x[0] for x in find_spans("Tel. 030 1234 5678")] == ["phone"] and not find_spans("see 030 1234 5678")
    assert mask_text("mail a@b.cd, call +49 30 1234567") == "mail [EMAIL], call [PHONE]"
    assert mask_text("0" * 200_000 + "a" * 200_000) == "0" * 200_000 + "a" * 200_000


def test_query(spark):
    texts = ["a@b.c and 10.0.0.1, 4111-1111-1111-1111 +1 (499) 555-6503", None, "", "plain", "plain", "é" * 50 + " x@y.zz"]
    df = spark.createDataFrame([(i % 5, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = personal_data(df).collect()
    assert len(got) == len(texts)
    for r, t in zip(got, texts):
        want = ",".join(f"{k}:{s}:{e}" for k, s, e in brute(t))
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and r["spans"] == want
        assert r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] == len(brute(t))
    assert [r["text"] for r in masked(df).collect()][1:3] == [None, ""]
    assert personal_data(df.limit(0)).count() == 0
