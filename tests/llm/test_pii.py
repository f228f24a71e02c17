import re
from datetime import date

import pytest

from fleetwatch.llm import pii

from .conftest import ODD

KEY = b"a secret key"
VALUES = {
    "email": ["x.y12@Mail.example.com", "9@a.io"],
    "card": ["4111111111111111", "4111-1111-1111-1111", "378282246310005"],
    "ssn": ["219-09-9999"], "ip": ["10.0.0.255", "8.8.8.8"], "iban": ["DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819"],
    "date": ["2020-02-29", "29/02/2020", "02/28/2021", "31.12.1999"],
    "phone": ["+1 (663) 555-6869", "663-555-6869", "+44 20 7946 0958", "+1 (163) 055-6869"],
    "secret": ['token = "1eb9c654e721b4f812088970e66a6345cee33dd6'],
}
INVALID = ["4111111111111112", "1234567890123456", "000-12-3456", "256.1.1.1", "1.2.3.4.5", "2021-02-29", "32/01/2020", "DE89 3704 0044 0532 0130 01", "555-123-4567 x".replace("555-1", "155-1"), "12345"]


@pytest.mark.parametrize("kind,value", [(k, v) for k, vs in VALUES.items() for v in vs])
def test_values_change_in_format_and_come_back(kind, value):
    names = pii.Pseudonyms(b"key")
    text = f"an {value}\" and"
    new, found = names.replace(text)
    assert [f[2] for f in found] == [kind] and new != text and len(new) == len(text)
    assert re.sub("[0-9]", "0", new) == re.sub("[0-9]", "0", text) or kind in ("email", "iban", "secret")
    assert names.replace(new, back=True)[0] == text
    assert [f[2] for f in names.replace(new)[1]] == [kind]  # the pseudonym is valid again
    assert pii.Pseudonyms(b"other").replace(text)[0] != new


@pytest.mark.parametrize("value", INVALID)
def test_what_does_not_validate_stays(value):
    assert pii.Pseudonyms(b"test").replace(f"a {value} b")[0] == f"a {value} b"


def test_equal_values_are_linked_over_formats():
    names = pii.Pseudonyms(b"test")
    a, b = names.replace("2020-02-29")[0], names.replace("29.02.2020")[0]
    assert date.fromisoformat(a) == date(*map(int, reversed(b.split("."))))
    digits = lambda s: re.sub("[^0-9]", "", names.replace(s)[0])
    assert digits("4111-1111-1111-1111") == digits("4111111111111111")
    assert digits("+1 (663) 555-6869")[1:] == digits("663-555-6869")


def test_cycle_is_a_permutation_without_fixed_points():
    cycle = pii.Cycle(b"k")
    for size in (2, 3, 10, 97, 256):
        image = [cycle.step("t", x, size) for x in range(size)]
        assert sorted(image) == list(range(size)) and all(x != y for x, y in enumerate(image))
        assert [cycle.step("t", y, size, back=True) for y in image] == list(range(size))
    assert cycle.step("t", 0, 1) == 0


def test_table(docs):
    rows = [(k, t, 1) for k, t in enumerate(ODD)] + [(50, "card 4111111111111111, 4111111111111111.", 2)] * 2
    df = docs(rows, "doc_id long, text string, rest int")
    out = pii.pseudonymise(df, KEY)
    assert out.columns == ["doc_id", "text", "rest", "pii_spans"]
    got = out.collect()
    for r in got:
        if r.doc_id < 50:
            assert r.text == ODD[r.doc_id] and r.pii_spans == []
    a, b = [r for r in got if r.doc_id == 50]
    assert a == b and [tuple(s) for s in a.pii_spans] == [("card", 5, 16), ("card", 23, 16)] and a.text[5:21] == a.text[23:39]
    back = pii.pseudonymise(out.drop("pii_spans"), KEY, back=True, spans=False)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert pii.pseudonymise(docs([]), KEY).count() == 0 and pii.pseudonymise(docs([("q",)], "text string"), KEY).columns == ["text", "pii_spans"]


BEHIND = [(kind, value, behind) for kind, value, behinds in [
    ("iban", "DE89 3704 0044 0532 0130 00", [" BIC COBADEFF", " EUR 500", " 2021", " I paid", " PLEASE PAY THIS TO THE ACCOUNT NOW"]),
    ("iban", "DE89370400440532013000", [" EUR 500", " 12345678", " I paid"]),
    ("iban", "NO9386011117947", [" NOK 20 AND MORE"]),
    ("card", "3782 822463 10005", [" 12/25", " 123", " 1 2 3 4"]),
    ("card", "378282246310005", [" 12/25", " 99"]),
    ("card", "4111 1111 1111 1111", [" 12/25", " 123"]),
    ("card", "41111111 11111111", [" 12/25"]),
    ("phone", "+44 20 7946 0958", [" 12345 67890", " 2021 2022 2023"]),
    ("phone", "+49 30 123456", [" 10115 10117 10119"]),
] for behind in behinds]


@pytest.mark.parametrize("kind,value,behind", BEHIND)
def test_words_and_numbers_behind_a_value(kind, value, behind):
    for key in (b"a", b"b", b"c", b"d", b"e", b"f", b"g", b"h"):
        names = pii.Pseudonyms(key)
        text = f"pay {value}{behind} now"
        new, found = names.replace(text)
        assert [(f[0], f[1], f[2]) for f in found] == [(4, 4 + len(value), kind)] and new.endswith(behind + " now")
        assert names.replace(new, back=True)[0] == text
        assert [f[:3] for f in names.replace(new)[1]] == [f[:3] for f in found]


def test_search_goes_on_behind_a_failed_start():
    names = pii.Pseudonyms(b"test")
    for text, at, value in [("AB12 DE89 3704 0044 0532 0130 00 x", 5, "DE89 3704 0044 0532 0130 00"), ("no 1234 4111 1111 1111 1111", 8, "4111 1111 1111 1111"),
                            ("no 99 3782 822463 10005", 6, "3782 822463 10005")]:
        new, found = names.replace(text)
        assert [(f[0], f[1]) for f in found] == [(at, at + len(value))] and names.replace(new, back=True)[0] == text


FORMS = [("date", v) for v in ["3/7/1985", "1985-3-7", "03/07/85", "3/7/85", "13/7/1985", "7/13/1985", "03.07.85", "3.7.1985", "29/2/00", "1985/12/7"]] \
    + [("secret", v) for v in ["api_key=0123456789abcdef", "password: 0123456789abcdef", "token=abc-DEF-123-xyz-99", "secret = Pa$$w0rd!Pa$$w0rd!", "password: 123456789012"]] \
    + [("email", v) for v in ["jane_@mail.example.com", "j.doe-@a.io", "x+@a.io"]]


@pytest.mark.parametrize("kind,value", FORMS)
def test_short_dates_open_secrets_and_emails(kind, value):
    for key in (b"a", b"b", b"c", b"d"):
        names = pii.Pseudonyms(key)
        for text in (value, f"on {value} and", f"({value}, x"):
            new, found = names.replace(text)
            assert [f[2] for f in found] == [kind] and new != text and len(new) == len(text)
            assert names.replace(new, back=True)[0] == text
            assert [f[:3] for f in names.replace(new)[1]] == [f[:3] for f in found]
            if kind == "date":
                assert re.sub("[0-9]", "0", new) == re.sub("[0-9]", "0", text)


@pytest.mark.parametrize("value", ["1.2.10", "version 1.10.2", "3/7", "32/1/85", "1/2/3/4", "key: short1", "password: nodigitsinthisone", "key: https://example.com/a1"])
def test_what_is_no_short_form_stays(value):
    assert pii.Pseudonyms(b"test").replace(f"a {value} b")[0] == f"a {value} b"


def test_known_kinds_behind_keywords_stay_linked():
    names = pii.Pseudonyms(b"test")
    for value in ("4111111111111111", "GB29NWBK60161331926819", "219-09-9999"):
        assert names.replace(f"key: {value}")[0] == f"key: {names.replace(value)[0]}"


LINKED = [(k, v) for k, vs in VALUES.items() for v in vs] + [("card", "41111111 11111111"), ("card", "378282 2463 10005"), ("phone", "+49 30 123456"), ("phone", "+442079460958"), ("phone", "+353 1 234 5678"), ("iban", "NO93 8601 1117 947")]


@pytest.mark.parametrize("kind,value", LINKED)
def test_pseudonyms_do_not_depend_on_what_follows(kind, value):
    names = pii.Pseudonyms(b"linked")
    close = '"' if kind == "secret" else ""
    alone = names.replace(f"x {value}{close}")[0][2:]
    for k in range(1000):
        for text in (f"x {value}{close} {k:03d}", f"or {value}{close}, {k * 7919 % 100003} or so"):
            new, found = names.replace(text)
            at = text.index(value)
            assert [f[2] for f in found] == [kind] and new[at: at + len(alone)] == alone and new[at + len(alone):] == text[at + len(alone):]
            assert names.replace(new, back=True)[0] == text


def test_notations_of_a_date_are_linked():
    names, read = pii.Pseudonyms(b"dates"), lambda t: tuple(map(int, re.findall("[0-9]+", t)))
    for d, m, y in [(3, 7, 1985), (3, 11, 1985), (11, 7, 2024), (29, 2, 2000), (31, 12, 1931), (9, 9, 1901)]:
        yy, mm, dd = read(names.replace(f"{y}-{m:02d}-{d:02d}")[0])
        for text in [f"{d:02d}.{m:02d}.{y}", f"{d}/{m}/{y}", f"{d:02d}/{m:02d}/{y}", f"{d}.{m}.{y}"]:
            assert read(names.replace(text)[0]) == (dd, mm, yy)
        assert read(names.replace(f"{y}-{m}-{d}")[0]) == (yy, mm, dd)
        if d > 12:
            assert read(names.replace(f"{m}/{d}/{y}")[0]) == (mm, dd, yy)
        if 1930 <= y < 2030:
            assert read(names.replace(f"{d}/{m}/{y % 100:02d}")[0]) == (dd, mm, yy % 100)


def test_notations_of_phones_and_ibans_are_linked():
    names, digits = pii.Pseudonyms(b"phones"), lambda t: re.sub("[^0-9A-Z]", "", t)
    for some in (["+44 20 7946 0958", "+442079460958", "+44-20-7946-0958"], ["+353 1 234 5678", "+35312345678"], ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000"]):
        assert len({digits(names.replace(v)[0]) for v in some}) == 1


def test_without_a_setting_the_key_is_random_and_stays(spark):
    first = pii.session_key(spark)
    assert len(first) == 32 and pii.session_key(spark) == first
    spark.conf.set(pii.KEY_SETTING, "mine")
    try:
        assert pii.session_key(spark) == b"mine"
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_a_column_named_as_the_spans_is_replaced(docs):
    got = pii.pseudonymise(docs([(1, "card 4111111111111111", 5)], "doc_id long, text string, pii_spans int"), KEY)
    assert got.columns == ["doc_id", "text", "pii_spans"] and got.first().pii_spans[0].kind == "card"


def test_table_against_one_text_at_a_time(spark, small):
    """Brute force: every text of a table on its own, all kinds in one pass over the text."""
    names = pii.Pseudonyms(KEY)
    for r in pii.pseudonymise(small.select("doc_id", "text", small["text"].alias("was")), KEY).collect():
        new, found = names.replace(r.was) if r.was else (r.was, [])
        assert r.text == new and [tuple(s) for s in r.pii_spans] == [(k, a, b - a) for a, b, k, _ in found]
