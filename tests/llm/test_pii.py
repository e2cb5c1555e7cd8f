"""Personal data spans against a plain pass with Python's regular expressions, and redaction."""

import hashlib
import re

import pytest
from fixtures import LONG, docs, empty

from ledgerlens.llm import pii

TEXTS = [
    None, "", "a@b.c_d@e.f x@y a.b+c@d-e.co.uk. @ @@ a@b..c ..@x.y", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.04 1.2.3 999999999999999999999.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111 5 55 1-2 -3", "+49 (30) 123-4567 +1 () 2 +12 3+49 30 1234567890 +1234567890123456 +1.2.3.4.5.6.7.8.9",
    "é ñ ü: mail é@x.fr tést@müller.de 日本 a@b.jp 4111 1111 1111 1111", "IBAN DE89 3704 0044 0532 0130 00, GB82WEST12345698765432 XX00 0000 0000 0000",
    "my ssn is 123-45-6789, not 000-12-3456; id 123-45-6789 tel (030) 123-4567 or 030 123-4567", " ".join(f"u{i}@example.org +49 30 {1000000 + i}" for i in range(700)),
    "9" * 5000 + "@x.y " + "a" * 5000 + " 1" * 3000,
]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return sorted(out)


@pytest.fixture(scope="module")
def found(spark):
    df = docs(spark, [(i, t, "en") for i, t in enumerate(TEXTS)])
    return {r.doc_id: r.spans for r in pii.spans(df).collect()}


def test_base_spans(found):
    for i, t in enumerate(TEXTS):
        assert [(s.start, s.rank, s.end, s.kind) for s in found[i] if s["rank"] < 4] == base_spans(t or ""), i


def test_added_spans(found):
    kinds = [(s.kind, TEXTS[7][s.start:s.end]) for s in found[7]]
    assert ("iban", "DE89 3704 0044 0532 0130 00") in kinds and ("iban", "GB82WEST12345698765432") in kinds and len([k for k in kinds if k[0] == "iban"]) == 2
    assert [TEXTS[8][s.start:s.end] for s in found[8] if s.kind == "ssn"] == ["123-45-6789"]
    assert [TEXTS[8][s.start:s.end] for s in found[8] if s.kind == "local"] == ["(030) 123-4567"]
    assert all(0 < s.score <= 1 for spans in found.values() for s in spans)


def test_running_sums_cross_blocks(found):
    assert len(found[9]) == 1400 and TEXTS[9][found[9][-1].start:found[9][-1].end] == "+49 30 1000699"


def test_digest_columns(spark):
    spans = [s for t in TEXTS for s in base_spans(t or "")]
    text = ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in base_spans(TEXTS[2]))
    row = pii.spans(docs(spark, [(1, TEXTS[2], "en")])).select(pii.joined(pii.F.col("spans")).alias("j")).first()
    assert hashlib.sha256(row.j.encode()).hexdigest() == hashlib.sha256(text.encode()).hexdigest() and spans


def test_redact(spark):
    df = docs(spark, [(i, t, "en") for i, t in enumerate(TEXTS)] + [(50, "clean 12 text", "en")])
    out = pii.redact(df)
    assert out.columns == df.columns
    by = {r.doc_id: r for r in out.collect()}
    assert by[0].text is None and by[1].text == "" and by[50].text == "clean 12 text" and by[3]._text == "extra-_text"
    assert by[6].text == "é ñ ü: mail é@x.fr tést@müller.de 日本 [EMAIL] [CARD]"
    assert not any(base_spans(by[i].text or "") for i in range(len(TEXTS)))


def test_awkward_and_empty(spark):
    found = {r.doc_id: len(r.spans) for r in pii.spans(docs(spark)).collect()}  # the long text has some 50,000 card candidates
    assert found[7] == len(base_spans(LONG)) and found[4] == found[5] == 0 and found[1] == 2
    assert [r.text for r in pii.redact(docs(spark)).where("doc_id = 7").collect()] == [LONG]
    assert pii.spans(empty(spark)).count() == 0 and pii.redact(empty(spark)).count() == 0


def test_lists_share_their_context(spark):
    texts = ["Phone: 555-123-4567, 555-987-6543", "ssn 123-45-6789 123-45-6780 123-45-6781; 123-45-6782", "ssn 123-45-6789" + "." * 40 + "123-45-6780",
             "ssn:123-45-6789 " + "1 2 " * 3 + "123-45-6781"]
    by = {r.doc_id: r.spans for r in pii.spans(docs(spark, [(i, t, "en") for i, t in enumerate(texts)]), whole=True).collect()}
    assert [texts[0][s.start:s.end] for s in by[0] if s.kind == "local"] == ["555-123-4567", "555-987-6543"]
    for i, kind, word in ((0, "local", "phone"), (1, "ssn", "ssn"), (2, "ssn", "ssn"), (3, "ssn", "ssn")):
        pattern = next(k.pattern for k in pii.KINDS if k.name == kind)
        want = [m.start() for m in re.finditer(pattern, texts[i]) if word in texts[i][max(0, m.start() - 40):m.start()].lower()]
        assert [s.start for s in by[i] if s.kind == kind] == want
    out = pii.redact(docs(spark, [(0, texts[0], "en")])).first().text
    assert out == "Phone: [LOCAL], [LOCAL]"


def test_iban_before_another_group(spark):
    ibans = ["ES9121000418450200051332", "AT61 1904 3002 3457 3201", "BE68539007547034", "DE89 3704 0044 0532 0130 00"]
    rows = [(i, f"{x} BIC CAIXESBB 1234", "en") for i, x in enumerate(ibans)] + [(9, " ".join(ibans), "en")]
    by = {r.doc_id: [r.text[s.start:s.end] for s in r.spans if s.kind == "iban"] for r in docs(spark, rows, False).join(pii.spans(docs(spark, rows), whole=True), "doc_id").collect()}
    assert [by[i] for i in range(4)] == [[x] for x in ibans] and by[9] == ibans
