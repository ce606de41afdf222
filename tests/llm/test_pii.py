from __future__ import annotations

import datetime as dt
import random
import re

import pytest

from orderdesk.llm import pii

KEY = b"a key of the tests"

SAMPLES = {
    "4111 1111 1111 1111": "card", "5500-0000-0000-0004": "card", "4041894974608795": "card", "+1 (988) 555-2485": "phone",
    "212-555-0147": "phone", "2024-02-29": "date", "31.12.1999": "date", "05/06/2010": "date", "12/31/1999": "date", "03/14/2015": "date", "GB82 WEST 1234 5698 7654 32": "iban",
    "42.144.35.254": "ip", "123-45-6789": "ssn", "Joe.42@Mail.example.com": "email",
}


@pytest.mark.parametrize("size", [2, 3, 10, 26, 100, 1000])
def test_permutation_has_no_fixed_point_and_an_inverse(size):
    p = pii.Permutation(size, "x", b"k")
    moved = [p.move(i) for i in range(size)]
    assert sorted(moved) == list(range(size)) and all(i != m for i, m in enumerate(moved))
    assert [p.move(m, True) for m in moved] == list(range(size))
    assert pii.Permutation(1, "x", b"k").move(0) == 0


@pytest.mark.parametrize("value, kind", SAMPLES.items())
def test_values_stay_in_their_format(value, kind):
    text = f"see {value}, then {value} é"
    spans = pii.found(text, KEY)
    assert [(text[a:b], k) for a, b, k, _ in spans] == [(value, kind)] * 2
    new = pii.replaced(text, spans)
    assert value not in new and len({s[3] for s in spans}) == 1
    if kind != "ip":
        assert re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", new))) == \
            re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", text)))
    assert [s[2] for s in pii.found(new, KEY)] == [kind] * 2  # still valid
    assert pii.replaced(new, pii.found(new, KEY, back=True)) == text
    assert pii.found(text, key=b"other")[0][3] != spans[0][3]


def test_invalid_values_are_left_alone():
    for text in ("4111 1111 1111 1112", "30/02/2000", "1.2.3.4.5", "300.1.1.1", "000-12-3456", "GB82 WEST 1234 5698 7654 33",
                 "1111111111111111", "12345678901234567890", "2024-13-01", ""):
        assert pii.found(text, KEY) == []


def test_equal_values_link_across_layouts():
    digits = lambda s: re.sub(r"\D", "", pii.replaced(s, pii.found(s, KEY)))
    assert digits("4111 1111 1111 1111") == digits("4111111111111111") == digits("4111-1111-1111-1111")
    assert digits("212-555-0147") == digits("(212) 555-0147")
    a, b = (pii.replaced(s, pii.found(s, KEY)) for s in ("2010-06-05", "05/06/2010"))
    assert dt.date.fromisoformat(a) == dt.datetime.strptime(b, "%d/%m/%Y").date()


def test_operator(spark, odd, none):
    docs = spark.createDataFrame([(i, f"doc {i} {v}", 0) for i, v in enumerate(SAMPLES)] + [(90, None, 1), (91, "", 1), (91, "", 1)],
                                 "doc_id long, text string, spans int")
    out = pii.pseudonymized(docs, KEY)
    rows = {r.doc_id: r for r in out.collect()}
    for i, (value, kind) in enumerate(SAMPLES.items()):
        assert value not in rows[i].text and [s.kind for s in rows[i]["__spans"]] == [kind]
    assert rows[90].text is None and rows[90]["__spans"] == [] and rows[91].text == ""
    back = pii.pseudonymized(out.drop("__spans"), KEY, restored=True)
    assert sorted(map(str, back.drop("__spans").collect())) == sorted(map(str, docs.collect()))
    assert pii.pseudonymized(odd, KEY).count() == odd.count() and pii.pseudonymized(none, KEY).count() == 0


@pytest.mark.parametrize("value", ["+1 (017) 555-7713", "+1 (117) 055-7713", "+1 017 155 7713", "+44 20 7946 0958", "+44 (0)20 7946 0958", "+442079460958",
                                   "+33 1 23 45 67 89", "+358 9 1234567", "+7 (495) 123-45-67", "(017) 555-7713", "(020) 7946 0958",
                                   "(03) 9123 4567", "(01632) 960983", "2125550147"])
def test_phones_of_any_country(value):
    for after in (", then", " 190.137.223.204", " 4111 1111 1111 1111", " 2024-02-29", " (a)"):
        for key in (KEY, b"other", b"third"):
            text = f"call {value}{after}"
            spans = pii.found(text, key)
            assert (text[spans[0][0]:spans[0][1]], spans[0][2]) == (value, "phone")
            new = pii.replaced(text, spans)
            assert re.sub("[0-9]", "0", new[:len(value) + 5]) == re.sub("[0-9]", "0", text[:len(value) + 5]) and value not in new
            assert [s[2] for s in pii.found(new, key)] == [s[2] for s in spans]
            assert pii.replaced(new, pii.found(new, key, back=True)) == text


def test_phones_keep_their_country_and_link_across_layouts():
    digits = lambda s: re.sub(r"\D", "", pii.replaced(s, pii.found(s, KEY)))
    assert digits("+44 20 7946 0958") == digits("+442079460958") and digits("+44 20 7946 0958").startswith("44")
    assert digits("2125550147") == digits("212-555-0147")
    for text in ("(1999) 100-200", "a6405768150", "6405768150e", "1700000000", "+12 34"):
        assert pii.found(text, KEY) == []


def test_month_first_dates_are_linked_to_their_other_layouts():
    new = {t: pii.replaced(t, pii.found(t, KEY)) for t in ("1999-12-31", "31/12/1999", "12/31/1999", "2015-03-14", "03/14/2015")}
    day = dt.date.fromisoformat
    assert day(new["1999-12-31"]) == dt.datetime.strptime(new["31/12/1999"], "%d/%m/%Y").date() == dt.datetime.strptime(new["12/31/1999"], "%m/%d/%Y").date()
    assert day(new["2015-03-14"]) == dt.datetime.strptime(new["03/14/2015"], "%m/%d/%Y").date()
    moved = {pii._moved_date(d, KEY, False) for d in (dt.date(1900, 1, 1) + dt.timedelta(days=k) for k in range(73049))}
    assert len(moved) == 73049 and min(moved) == dt.date(1900, 1, 1) and max(moved) == dt.date(2099, 12, 31)
    for d in (dt.date(1900, 1, 12), dt.date(1900, 1, 13), dt.date(2099, 12, 31), dt.date(2000, 2, 29), dt.date(1999, 2, 28)):
        assert pii._moved_date(pii._moved_date(d, KEY, False), KEY, True) == d != pii._moved_date(d, KEY, False)


def test_numbers_with_and_without_country_code_are_one():
    digits = lambda s: re.sub(r"\D", "", pii.replaced(s, pii.found(s, KEY)))[-10:]
    for a, b in (("+1 (017) 555-7713", "(017) 555-7713"), ("+1 (212) 555-0147", "(212) 555-0147"), ("+12125550147", "212-555-0147"),
                 ("+1 117 055 7713", "(117) 055-7713")):
        assert digits(a) == digits(b) != re.sub(r"\D", "", b)


def luhn(body):
    """The check digit by trying all ten against the sum of doubled digits."""
    def good(number):
        total = 0
        for i, c in enumerate(number[::-1]):
            total += sum(divmod(int(c) * 2, 10)) if i % 2 else int(c)
        return total % 10 == 0
    return next(str(d) for d in range(10) if good(body + str(d)))


def test_planted_values_are_found_and_nothing_else():
    """Values written by rules of their own among words and look-alikes: their places are known, not searched."""
    rng = random.Random(7)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def value():
        kind = rng.choice(["card", "date", "ssn", "email", "phone", "ip"])
        if kind == "card":
            body = "4" + digits(14)
            whole, sep = body + luhn(body), rng.choice(["", " ", "-"])
            return kind, sep.join(whole[k:k + 4] for k in range(0, 16, 4))
        if kind == "date":
            d = dt.date(1950, 1, 1) + dt.timedelta(days=rng.randrange(30000))
            return kind, d.strftime(rng.choice(["%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y"]))
        if kind == "ssn":
            return kind, f"{rng.randint(100, 665)}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"
        if kind == "email":
            return kind, f"{rng.choice(['ann', 'b.c', 'd_4'])}{digits(2)}@mail.example.org"
        if kind == "phone":
            return kind, rng.choice(["+1 ({}) {}-{}", "({}) {}-{}"]).format(rng.randint(200, 999), rng.randint(200, 999), digits(4))
        return kind, ".".join(str(rng.randint(1, 223)) for _ in range(4))

    decoys = ["v1.2", "12", "3.14159", "page 7", "2001", "x@y", "GB00 AAAA", "99/99/2000", "4111 1111 1111 1112", "§ 12-3", "1,000,000", "10:30"]
    for _ in range(300):
        text, want = "", []
        for _ in range(rng.randint(1, 8)):
            text += rng.choice(["the word ", "é and ", "of: "])
            if rng.random() < 0.5:
                kind, v = value()
                want.append((len(text), len(text) + len(v), kind))
                text += v + rng.choice([", ", "; ", " so "])
            else:
                text += rng.choice(decoys) + rng.choice([", ", "; ", " so "])
        assert [s[:3] for s in pii.found(text, KEY)] == want, text
