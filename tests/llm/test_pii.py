from __future__ import annotations

import random
import re

from rankjobs.llm import pii
from tests.llm.conftest import HOSTILE

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text: str) -> list[tuple[str, int, int]]:
    """The base kinds as they are defined."""
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 12 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda x: (x[1], pii.BASE_KINDS.index(x[0])))


def test_base_spans_are_those_of_the_plain_patterns():
    r = random.Random(4)
    pieces = ["a", "b.c", "@", ".", "-", "1", "12", "255", "256", "0009", "+", "(", ")", " ", "  ", "4111111111111111", "x@y.z", "é", "\n", "%"]
    for _ in range(4000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 30)))
        got = [(s["kind"], s["start"], s["end"]) for s in pii.spans_of(text) if s["kind"] in pii.BASE_KINDS]
        assert got == plain(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1 " * 100_000, "a@" * 150_000, "1-" * 150_000):
        pii.spans_of(text)


def test_added_kinds_need_their_checks_and_context():
    kinds = lambda text: [s["kind"] for s in pii.spans_of(text)]
    assert kinds("account GB82 WEST 1234 5698 7654 32 here") == ["iban"]
    assert kinds("account GB83 WEST 1234 5698 7654 32 here") == []
    assert kinds("call me at 415-555-2671") == ["local_phone"]
    assert kinds("part 415-555-2671") == []
    assert kinds("ssn 123-45-6789") == ["ssn"] and kinds("ssn 666-45-6789") == []


def test_context_moves_the_score():
    score = lambda text: pii.spans_of(text)[0]["score"]
    assert score("credit card 4111111111111111") > score("see 4111111111111111") > score("order 4111111111111111")


def test_hostile_rows(hostile, nothing):
    found = {(r["doc_id"], r["text"]): r["spans"] for r in pii.find_personal_data(hostile).collect()}
    assert len(pii.find_personal_data(hostile).collect()) == len(HOSTILE)
    assert found[2, None] == [] and found[3, ""] == []
    assert [s["kind"] for s in found[12, HOSTILE[-1][1]]] == ["email", "phone", "ip"]
    assert pii.find_personal_data(nothing).count() == 0


def test_redaction(hostile):
    row = pii.redact(pii.find_personal_data(hostile)).filter("doc_id = 12").first()
    assert row["text"].startswith("mail <email> call <phone>, from <ip> token")


def test_an_iban_ends_where_its_country_says():
    spans = lambda text: [(x["kind"], text[x["start"] : x["end"]]) for x in pii.spans_of(text) if x["kind"] == "iban"]
    assert spans("account AT61 1904 3002 3457 3201 CALL me") == [("iban", "AT61 1904 3002 3457 3201")]
    assert spans("bank AT61 1904 3002 3457 3201 DE89 3704 0044 0532 0130 00 BY MAIL") == [
        ("iban", "AT61 1904 3002 3457 3201"), ("iban", "DE89 3704 0044 0532 0130 00"),
    ]
    assert spans("bank AT611904300234573201X") == [] and spans("bank AT61 1904 3002 3457 320") == []


def test_dense_texts_take_linear_time():
    import time

    def seconds(n):
        text = "a1@b.cc 415-555-2671 call 123-45-6789 ssn 10.0.0.1 " * (n // 51)
        begin = time.process_time()
        assert len(pii.spans_of(text)) >= n // 51 * 3
        return time.process_time() - begin

    seconds(20_000)
    assert seconds(800_000) < 8 * seconds(200_000) + 0.5
