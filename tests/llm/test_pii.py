import re

from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a@.1+- 9(x%é\n", max_size=40))
def test_plain_spans_equal_the_patterns(text):
    assert pii.detect(text) == brute(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "10.0.0.255", "1.2.3.4.5.6.7.8", "+1 (017) 555-7713", "a.b@c-d.example.com", "x@y@z.de", " ", "-", "7", "\n", "é", "256.1.1.1", "4485275742308327"]), max_size=12))
def test_plain_spans_of_joined_parts(parts):
    text = "".join(parts)
    assert pii.detect(text) == brute(text)


def texts(text):
    plain, every = pii.find(text)
    assert all(s in every for s in plain)
    return [(k, text[a:b]) for k, a, b in every]


def test_disguises_map_back_to_the_source():
    assert texts("write to jane.doe (at) example (dot) com now") == [("email", "jane.doe (at) example (dot) com")]
    assert texts("é jane[at]mail.example[dot]org!") == [("email", "jane[at]mail.example[dot]org")]
    assert texts("jane at example dot com, please") == [("email", "jane at example dot com")]
    assert texts("jаne@example.com") == [("email", "jаne@example.com"), ("email", "ne@example.com")]  # a Cyrillic letter inside
    assert texts("call plus four nine one five one two three four five six seven") == [("phone", "plus four nine one five one two three four five six seven")]
    assert texts("１０．０．０．１") == [("ip", "１０．０．０．１")]
    assert texts("4111​111111111111") == [("card", "4111​111111111111")]


def test_ordinary_prose_has_no_finds():
    for text in (None, "", "We met at noon and looked at the dot on the map.", "one two three", "Было в Москве.", "a @ b", "ten (at) most", "seven eight nine ten"):
        assert pii.find(text) == ([], [])


def test_long_runs_are_linear():
    for text in ("9" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "+" + "1-" * 100_000, "at dot " * 30_000, "one " * 50_000):
        pii.find(text)


def test_mask_keeps_the_rest():
    text = "mail a@b.co or 10.0.0.1"
    assert pii.mask(text, pii.find(text)[1]) == "mail <EMAIL> or <IP>"
    assert pii.mask(None, []) is None


def test_rows(spark):
    rows = spark.createDataFrame([(1, "a@b.co", "x"), (1, "a@b.co", "x"), (None, None, None), (2, "", "y")], "doc_id long, text string, spans string")
    got = sorted(pii.identifiers(rows).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [(r.doc_id, r.n_email, r.spans) for r in got] == [(1, 1, "email:0:6"), (1, 1, "email:0:6"), (2, 0, ""), (None, 0, "")]
    assert pii.masked(rows).columns == rows.columns and pii.masked(rows).where("text = '<EMAIL>'").count() == 2
    assert pii.identifiers(rows.limit(0)).count() == 0
