"""Personal data against the patterns run plainly, and the kinds that the method adds."""

import hashlib
import random
import re

from pairlens.llm.pii import find_spans, luhn, mod97, pii_report, redact
from pairlens.llm.queries import QUERIES

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")


def digits(s):
    return [int(c) for c in s if c.isdigit()]


def plain_luhn(ds):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(ds))) % 10 == 0


def plain(text):
    text = text or ""
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and plain_luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def base(spans):
    return [s for s in spans if s[0] in KINDS]


def test_query_equals_plain_patterns(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op9_pii"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        want = plain(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert set(f"{k}:{a}:{b}" for k, a, b in want) <= set(r.spans.split(","))


def test_random_texts_equal_plain_patterns():
    rng = random.Random(9)
    parts = ["@", ".", "-", "+", " ", "a", "b.c", "1", "23", "255", "1.2.3.4", "x@y.z", "4539 1488 0343 6467", "+1 (415) 555-0199", "é", "(", ")", "_", "%", "٣"]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert base(find_spans(text)) == plain(text), text


def test_added_kinds():
    assert luhn("4539148803436467") and mod97("DE89370400440532013000")
    kinds = lambda t: [k for k, _, _ in find_spans(t)]
    assert kinds("Konto DE89 3704 0044 0532 0130 00 bitte") == ["iban"]
    assert kinds("Konto DE89 3704 0044 0532 0130 01 bitte") == []
    assert kinds("my social security number is 123-45-6789") == ["ssn"]
    assert kinds("part 123-45-6789 of the invoice") == []
    assert kinds("call (415) 555-0199 now") == ["local_phone"]
    assert kinds('api_key = "24be64439e3e49cf46b2d7c9"') == ["secret"]
    assert redact("mail a@b.cd or +1 415 555 0199!") == "mail [EMAIL] or [PHONE]!"


def test_accounts_side_by_side_and_of_all_countries():
    accounts = lambda t: [t[a:b] for k, a, b in find_spans(t) if k == "iban"]
    assert accounts("DE89370400440532013000 GB29NWBK60161331926819") == ["DE89370400440532013000", "GB29NWBK60161331926819"]
    assert accounts("KD10 42 DE89370400440532013000") == ["DE89370400440532013000"]
    for account in ("CZ6508000000192000145399", "GR1601101250000000012300695", "HU42117730161111101800000000", "RO49AAAA1B31007593840000", "TR330006100519786457841326", "AE070331234567890123456", "SA0380000000608010167519"):
        assert accounts(f"zu {account}.") == [account]
    find_spans("AB12" * 100_000 + " AB12 CD34" * 50_000)


def test_context_on_both_sides():
    kinds = lambda t: [k for k, _, _ in find_spans(t)]
    assert kinds("123-45-6789 is my social security number") == ["ssn"]
    assert kinds("(415) 555-0199 is my phone") == ["local_phone"]
    assert kinds("123-45-6789 is what I have read there") == []


def test_long_texts_take_linear_time():
    for text in ("a" * 400_000 + "@", "1." * 200_000, "1 " * 200_000, "@a." * 100_000, "+1" * 200_000, "(" * 200_000):
        find_spans(text)


def test_odd_rows(spark, odd_docs, no_docs):
    got = {r.doc_id: r for r in pii_report(odd_docs).collect()}
    assert (got[1].spans, got[1].base_sha256) == ("", hashlib.sha256(b"").hexdigest())
    assert got[10].n_email == got[10].n_phone == 1
    assert pii_report(no_docs).collect() == []
