import hashlib
import re

from quarry.llm import pii
from quarry.llm.queries import op7_pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [("email", m) for m in EMAIL.finditer(text)]
    found += [("ip", m) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", m) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [("phone", m) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted([(k, m.start(), m.end()) for k, m in found], key=lambda s: (s[1], pii.BASE_KINDS.index(s[0])))


HARD = [
    "a@b@c.de.fg and x.y+z@q-r.com.", "a@b", "@a.b", "..@a.b@c.d@e.f", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4 256.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+49 (0)30 123-456 78 +1+2 +12345678901234567 +1 2", "+1 4111 1111 1111 1111", "12.34.56.78@a.bc", "9" * 400, "1-2-3-4-5", "é@é.com ü@a.b", "😀 a@b.cd 1.2.3.4",
    "http://user:pa55@host.com/x IBAN DE89 3704 0044 0532 0130 00, account: GB82WEST12345698765432", "IBAN DE88 3704 0044 0532 0130 00",
]


def test_hard_texts():
    finder = pii.Finder()
    for text in HARD:
        found = finder.spans(text)
        assert [s for s in found if s[0] in pii.BASE_KINDS] == brute(text), text
    added = [s[0] for s in finder.spans(HARD[-2]) if s[0] in pii.ADDED_KINDS]
    assert added == ["login", "iban", "iban"] and not [s for s in finder.spans(HARD[-1]) if s[0] == "iban"]


def test_whole_table(spark, sf_dir, documents):
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    rows = op7_pii(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r.doc_id])
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.BASE_KINDS]
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))


def test_edges_and_masking(spark, edge_documents):
    found = pii.find_pii(edge_documents)
    assert found.count() == edge_documents.count() and pii.find_pii(edge_documents.where("false")).count() == 0
    assert all(r.pii == [] for r in found.where("text is null or text = ''").collect())
    df = spark.createDataFrame([(1, "mail a@b.cd now"), (2, None), (3, "none")], "doc_id long, text string")
    assert [r.text for r in pii.mask_pii(pii.find_pii(df)).orderBy("doc_id").collect()] == ["mail <email> now", None, "none"]
