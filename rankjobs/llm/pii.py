"""Personal data: patterns propose spans, checks confirm them, words nearby move the score.

Kinds and what confirms them:

- ``email``, ``ip`` (parts at most 255), ``card`` (12 to 19 digits, Luhn), ``phone`` (a
  leading ``+`` and 9 to 15 digits): these base kinds are always reported.
- ``iban`` (mod-97) and ``local_phone`` (North American form with valid area and exchange
  codes), ``ssn`` (United States form with valid parts): reported if their score, after
  context, reaches ``THRESHOLD``. An added span never replaces a base one and is left out
  where it lies inside one.

A score starts at the kind's own, rises with a supporting word within ``WINDOW``
characters and falls with a contradicting one. It is reported with every span.

Matching is leftmost and not overlapping within a kind; a match that fails its check is
dropped whole. All scans are linear in the text: where a plain pattern would try each
character of a long run again, the run is taken once and tested after.

Defined results: a null text is empty and has no spans; positions are code points, the
end excluded; an empty table gives an empty result. Other columns are passed through.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "local_phone", "ssn")
KINDS = BASE_KINDS + ADDED_KINDS
THRESHOLD = 0.5
WINDOW = 40

# what a span scores before context; words that raise or lower it by CONTEXT_WEIGHT
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.8, "iban": 0.9, "local_phone": 0.4, "ssn": 0.4}
CONTEXT_WEIGHT = 0.2
SUPPORT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "credit", "visa", "mastercard", "payment", "debit"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "contact"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "local_phone": ("phone", "call", "tel", "mobile", "fax", "contact"),
    "ssn": ("ssn", "social security", "taxpayer"),
}
AGAINST = {
    "ip": ("version", "release", "section"),
    "card": ("order", "serial", "tracking", "isbn"),
    "local_phone": ("order", "serial", "part no"),
    "ssn": ("order", "serial", "part no"),
}

SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
SPANS_ARROW = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
)

LOCAL_PART = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# up to four numbers in a row of dots: shorter rows hold no address and are passed over whole
NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++){0,3}+")
DIGIT_ROW = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
# The lengths of account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22,
    "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31,
    "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
LOCAL_PHONE = re.compile(r"(?<![0-9+().-])\(?([2-9][0-9]{2})\)?[ .-]([2-9][0-9]{2})[ .-][0-9]{4}(?![0-9-])")
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
NOT_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    plain = iban.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    at = text.find("@")
    while at >= 0:
        # the local part: the run before the @ that does not reach into the last match
        head = text[end:at]
        start = end + len(head.rstrip(LOCAL_PART))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        else:
            end = at + 1  # the part before holds no other @, so no match can start there
        at = text.find("@", end)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in NUMBERS.finditer(text):
        if m.end() - m.start() > 6:
            parts = m.group().split(".")
            if len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in parts):
                yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in DIGIT_ROW.finditer(text):
        if m.end() - m.start() >= 12:
            digits = NOT_DIGITS.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= len(NOT_DIGITS.sub("", m.group())) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while m := IBAN.search(text, at):
        start, at = m.span()
        # capital words may follow: the country says where the number ends
        length = IBAN_LENGTHS.get(m.group()[:2])
        end, left = start, length or len(m.group())
        while length and left and end < at:
            left -= text[end] != " "
            end += 1
        if not length:
            end = at
        elif left or text[end : end + 1].isalnum():
            continue
        if mod97(text[start:end]):
            yield start, end
            at = end


def local_phones(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in LOCAL_PHONE.finditer(text) if m.group(1)[1:] != "11" and m.group(2)[1:] != "11")


def ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in SSN.finditer(text):
        area, group, serial = m.groups()
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones, "iban": ibans, "local_phone": local_phones, "ssn": ssns}
HAS_DIGIT = re.compile("[0-9]")


def score(text: str, kind: str, start: int, end: int) -> float:
    around = (text[max(0, start - WINDOW) : start] + "\n" + text[end : end + WINDOW]).lower()

    def near(words: tuple[str, ...]) -> bool:
        return any(re.search(rf"(?<!\w){re.escape(w)}", around) for w in words)

    value = SCORES[kind] + CONTEXT_WEIGHT * near(SUPPORT[kind]) - CONTEXT_WEIGHT * near(AGAINST.get(kind, ()))
    return round(min(1.0, max(0.0, value)), 3)


def spans_of(text: str | None) -> list[dict]:
    """All spans of one text by start, then kind in the order of ``KINDS``."""
    if not text:
        return []
    digits = HAS_DIGIT.search(text) is not None
    found = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if digits:
        for kind in ("ip", "card") + (("phone",) if "+" in text else ()):
            found += [(kind, s, e) for s, e in FINDERS[kind](text)]
    spans = [{"kind": k, "start": s, "end": e, "score": score(text, k, s, e)} for k, s, e in found]
    if digits:
        covered = sorted((s, e) for _, s, e in found)
        starts, reach = [s for s, _ in covered], list(accumulate((e for _, e in covered), max))
        for kind in ADDED_KINDS:
            for start, end in FINDERS[kind](text):
                value = score(text, kind, start, end)
                # base spans that begin no later: how far the longest of them reaches
                before = bisect_right(starts, start)
                if value >= THRESHOLD and not (before and reach[before - 1] >= end):
                    spans.append({"kind": kind, "start": start, "end": end, "score": value})
    spans.sort(key=lambda x: (x["start"], KINDS.index(x["kind"])))
    return spans


def find_personal_data(docs: DataFrame, text_column: str = "text", output: str = "spans") -> DataFrame:
    """``docs`` with an array of spans (kind, start, end, score) for each text."""

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        return pa.array([spans_of(t) for t in texts.to_pylist()], type=SPANS_ARROW)

    return docs.withColumn(output, spans(F.col(f"`{text_column}`")))


def redact(docs: DataFrame, text_column: str = "text", spans_column: str = "spans") -> DataFrame:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""

    @F.arrow_udf("string")
    def replaced(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, found in zip(texts.to_pylist(), spans.to_pylist()):
            parts, end = [], 0
            for x in found or ():
                if x["start"] >= end:
                    parts += [text[end : x["start"]], f"<{x['kind']}>"]
                end = max(end, x["end"])
            out.append(None if text is None else "".join(parts) + text[end:])
        return pa.array(out, type=pa.string())

    return docs.withColumn(text_column, replaced(F.col(f"`{text_column}`"), F.col(f"`{spans_column}`")))
