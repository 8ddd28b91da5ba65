"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Kinds in the order of results, word lists and lengths of account numbers by country.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
CONTEXT = {
    "card": "card credit debit visa mastercard amex karte kreditkarte carte tarjeta payment",
    "phone": "phone tel telephone mobile cell fax call telefon handy anruf appel portable teléfono móvil llamar",
    "iban": "iban account bank konto bankverbindung compte cuenta transfer",
    "ssn": "ssn social security",
}
AGAINST = "order version isbn issn serial invoice ticket build release part sku model rechnung facture pedido"
IBAN_LENGTHS = (
    "AD24 AE23 AT20 BE16 BG22 CH21 CY28 CZ24 DE22 DK18 EE20 ES24 FI18 FR27 GB22 GI23 GR27 HR21 HU28 IE22 "
    "IL23 IS26 IT27 LI21 LT20 LU20 LV21 MC27 MT31 NL18 NO15 PL28 PT25 RO24 SA24 SE24 SI19 SK24 SM27 TR26"
)

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails at its start fails at each later digit too, and a match ends with its run: so only starts of runs are tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_PHONE = re.compile(r"(?<![\w+.,-])\(?0[0-9]{1,4}\)?[\x20/-]?[0-9]{3,4}(?:[\x20-]?[0-9]{2,4}){1,2}(?![\w-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![\w-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\w-])")
_NOT_DIGIT = re.compile(r"[^0-9]")
_WORD = re.compile(r"[^\W\d_]+")
_NEAR = {k: frozenset(v.split()) for k, v in CONTEXT.items()}
_FAR = frozenset(AGAINST.split())
_LENGTHS = {x[:2]: int(x[2:]) for x in IBAN_LENGTHS.split()}

SPANS = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern of local part, @ and domain would match, but in linear time: each @ has one run of local characters before it."""
    end, low, at = 0, 0, text.find("@")
    while at >= 0:
        before = text[max(end, low) : at]
        local = len(before) - len(before.rstrip(_LOCAL))
        low = at + 1
        if local and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield at - local, end
        at = text.find("@", at + 1)


def _context(text: str, start: int, end: int, kind: str, reach: int = 40) -> float:
    around = _WORD.findall(text[max(0, start - reach) : start].lower()) + _WORD.findall(text[end : end + reach // 2].lower())
    score = 0.0
    if any(w in _NEAR.get(kind, ()) for w in around):
        score += 0.35
    if any(w in _FAR for w in around):
        score -= 0.35
    return score


def find_spans(text: str | None, threshold: float = 0.5) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, base) by kind, then start; code points, ends exclusive.

    Base spans pass the format and checksum of their kind and stay whatever their score. Others need
    a score of ``threshold``: account numbers that pass mod-97, 13 to 15 digits that pass Luhn,
    national phone numbers and social security numbers with a word near them that tells so.
    """
    if not text:
        return []
    found: list[tuple[str, int, int, float, bool]] = []
    add = lambda kind, s, e, prior, base: found.append((kind, s, e, round(min(1.0, max(0.0, prior + _context(text, s, e, kind))), 4), base))
    for s, e in _emails(text):
        add("email", s, e, 0.95, True)
    digits = any(c in text for c in "0123456789")
    if digits:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                add("ip", *m.span(), 0.8, True)
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                own = _NOT_DIGIT.sub("", m[0])
                if 16 <= len(own) <= 19:
                    if luhn(own):
                        add("card", *m.span(), 0.75, True)
                elif 13 <= len(own) <= 15 and luhn(own):
                    add("card", *m.span(), 0.3, False)
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                add("phone", *m.span(), 0.7, True)
        for m in _LOCAL_PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                add("phone", *m.span(), 0.25, False)
        for m in _IBAN.finditer(text):
            length, taken, end = _LENGTHS.get(m[1], 0), 0, m.start()
            while end < m.end() and taken < length:
                taken += text[end] != " "
                end += 1
            if length and taken == length and mod97(text[m.start() : end].replace(" ", "")):
                add("iban", m.start(), end, 0.9, False)
        for m in _SSN.finditer(text):
            add("ssn", *m.span(), 0.3, False)
    found = [x for x in found if x[4] or x[3] >= threshold]
    base = [(k, s, e) for k, s, e, _, b in found if b]
    found = [x for x in found if x[4] or not any(k == x[0] and s < x[2] and x[1] < e for k, s, e in base)]
    return sorted(found, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def pii_spans(text: Column, threshold: float = 0.5) -> Column:
    """``find_spans`` of each whole text; an empty array for null."""

    @pandas_udf(SPANS)
    def of(texts: pd.Series) -> pd.Series:
        names = ("kind", "start", "end", "score", "base")
        return pd.Series([[dict(zip(names, x)) for x in find_spans(t, threshold)] for t in texts], dtype=object)

    return of(text)


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row: doc_id, counts of base spans by kind, ``base_sha256``, ``spans`` (all, joined) and ``found``, the spans with scores.

    Null and empty texts have none; repeated rows each get a row; other columns are ignored. One
    pass without a shuffle: a text of any length is scanned in time linear in it.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), pii_spans(F.col(text_col), threshold).alias("found"))
    base = F.filter("found", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("found", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return d.select("doc_id", *map(count, KINDS[:4]), F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("found")).alias("spans"), "found")


def mask_text(text: str | None, threshold: float = 0.5) -> str | None:
    """The text with each span, overlapping ones together, replaced by its kind in square brackets."""
    spans = sorted(find_spans(text, threshold), key=lambda x: (x[1], x[2]))
    if not spans:
        return text
    out, at, merged = [], 0, []
    for kind, s, e, *_ in spans:
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([kind, s, e])
    for kind, s, e in merged:
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with personal data masked; all other columns, and null texts, stay as they are."""

    @pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([mask_text(t, threshold) for t in texts], dtype=object)

    return docs.withColumn(text_col, of(F.col(text_col)))
