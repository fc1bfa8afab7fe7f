"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby raise or lower the score.

Kinds of the base contract: email, ip, card (Luhn), phone; they stand whatever their context. Kinds
that the method adds: iban (mod 97 confirms), ssn (needs valid parts), local_phone and secret; they
count when their score, moved by the words around them, reaches THRESHOLD. Words for a kind count on
both sides; words against it only before it, where they name what follows.

Nulls: a null or empty text has no spans. Each text is searched whole, in time about linear in its
length. Rows are judged one by one, so ties, repeated rows and other columns do not matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds in their order.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "local_phone", "secret")
LOCAL_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is taken whole at its first digit: later starts in the run cannot match either
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# of no width, so that every start is tried
IBAN = re.compile(r"\b(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}))")
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?i)\b(?:api[_-]?key|secret|token|password|passwd)\b\x20?[=:]\x20?[\"']?([A-Za-z0-9/+_=-]{16,})")
DIGIT = re.compile("[0-9]")
#: Lengths of account numbers by country, of the whole registry.
IBAN_LENGTHS = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 "
    "LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
).split()}
#: Words that speak for a kind, and words that speak against any.
CONTEXT = {
    "iban": ("account", "bank", "iban", "konto", "transfer"),
    "ssn": ("security", "social", "ssn"),
    "local_phone": ("call", "fax", "mobile", "phone", "tel", "telephone"),
    "secret": ("credential", "key", "password", "secret", "token"),
}
AGAINST = ("example", "invoice", "isbn", "part", "serial", "version")
BASE_SCORE = {"iban": 0.8, "ssn": 0.5, "local_phone": 0.5, "secret": 0.7}
THRESHOLD = 0.6
NEARBY = 40  # characters before and behind a span in which context is looked for
WORDS = re.compile("[a-z]+")
LETTERS = LOCAL_CHARS[:52]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of [A-Za-z0-9._%+-]+@domain, leftmost first: each @ is tried once, with the whole run before it."""
    done, at = 0, text.find("@")
    seen = 0  # the run before an @ starts after the @ before it
    while at >= 0:
        begin = max(done, seen)
        start = begin + len(text[begin:at].rstrip(LOCAL_CHARS))
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        seen = at + 1
        at = text.find("@", max(at + 1, done))


def score(kind: str, text: str, start: int, end: int) -> float:
    before = set(WORDS.findall(text[max(0, start - NEARBY) : start].lower()))
    behind = text[end : end + NEARBY]
    if text[end + NEARBY : end + NEARBY + 1].isalpha():  # the last word is cut
        behind = behind.rstrip(LETTERS)
    near = before.union(WORDS.findall(behind.lower()))
    return BASE_SCORE[kind] + 0.3 * any(w in near for w in CONTEXT[kind]) - 0.3 * any(w in before for w in AGAINST)


def added(text: str) -> Iterator[tuple[str, int, int]]:
    done = 0
    for m in IBAN.finditer(text):
        if m.start() < done or (size := IBAN_LENGTHS.get(m[1][:2])) is None:
            continue
        # what was taken may run into a following word: cut to the country's length
        kept, n = 0, 0
        for c in m[1]:
            kept += 1
            n += c != " "
            if n == size:
                break
        account = m[1][:kept].replace(" ", "")
        if len(account) == size and mod97(account):
            done = m.start() + kept
            yield "iban", m.start(), done
    for m in SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield "ssn", *m.span()
    for m in LOCAL_PHONE.finditer(text):
        yield "local_phone", *m.span()
    for m in SECRET.finditer(text):
        if DIGIT.search(m[1]):
            yield "secret", *m.span(1)


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then in the order of KINDS."""
    if not text:
        return []
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
        taken = [(a, b) for _, a, b in out]
        for kind, a, b in added(text):
            # digits of an account may pass for a card: the account holds them whole
            if score(kind, text, a, b) >= THRESHOLD and not any(a < y and x < b and not (kind == "iban" and a <= x and y <= b) for x, y in taken):
                out.append((kind, a, b))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    spans = find_spans(text)
    if not spans:
        return text
    out, done = [], 0
    for kind, a, b in spans:
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def _report(text: str | None) -> tuple:
    spans = find_spans(text)
    counts = [sum(k == kind for k, _, _ in spans) for kind in KINDS[:4]]
    joined = lambda items: ",".join(f"{k}:{a}:{b}" for k, a, b in items)
    base = joined(s for s in spans if s[0] in KINDS[:4])
    return (*counts, hashlib.sha256(base.encode()).hexdigest(), joined(spans))


REPORT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _reports(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_report(t) for t in texts], columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def _redacted(texts: pd.Series) -> pd.Series:
    return texts.map(redact, na_action="ignore")


def pii_report(docs: DataFrame) -> DataFrame:
    """One row for each document: counts and spans."""
    return docs.select("doc_id", F.pandas_udf(_reports, REPORT)("text").alias("r")).select("doc_id", "r.*")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data replaced; n_chars follows the text."""
    df = docs.withColumn(text, F.pandas_udf(_redacted, "string")(text))
    return df.withColumn("n_chars", F.length(text).cast("long")) if "n_chars" in docs.columns else df
