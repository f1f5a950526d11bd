"""Surrogates: kinds, formats, genders, scripts, distinctness and coreference."""

import re

import pytest

from wardlight.llm import surrogates
from wardlight.llm.queries import LLM_QUERIES

MEDIUM = "/root/testdata/sf0.01"
PLAIN = re.compile(r"[\w.+-]+@[\w.-]+\w|(?<![\d.])\d+\.\d+\.\d+\.\d+(?![\d.])|(?<!\d)\d{13,19}(?!\d)|\+\d+ \(\d+\) \d+-\d+")


def luhn(number):
    digits = [int(c) for c in reversed(number)]
    return (sum(digits[::2]) + sum(d * 2 - 9 if d > 4 else d * 2 for d in digits[1::2])) % 10 == 0


def out_of(docs, key="k"):
    return {r.doc_id: (r.text, r.n_entities) for r in surrogates.pseudonymise(docs, key).collect()}


def test_query_keeps_everything_but_entities(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text").collect()}
    rows = LLM_QUERIES["op8_surrogates"](spark, MEDIUM).collect()
    assert len(rows) == len(docs)
    known, originals = {}, {e for t in docs.values() for e in PLAIN.findall(t)}
    for r in rows:
        before, after = PLAIN.findall(docs[r.doc_id]), PLAIN.findall(r.text)
        assert r.n_entities == len(before) == len(after)
        assert PLAIN.split(docs[r.doc_id]) == PLAIN.split(r.text)
        for a, b in zip(before, after):
            assert known.setdefault(a, b) == b
    assert set(known) == originals and len(set(known.values())) == len(known) and not originals & set(known.values())


def test_formats(make):
    text = "card 4111 1111 1111 1111 or 4111111111111111, bad 4111-1111-1111-1112; DE89370400440532013000; 078-05-1120; +49 30 1234567; (555) 123-4567; 192.168.0.7 and 8.8.8.8; Jo.Doe@Mail.Example.org JO.DOE@MAIL.EXAMPLE.ORG"
    new, count = out_of(make([(1, text)]))[1]
    assert count == 11
    spaced, plain = re.search(r"card (\S+ \S+ \S+ \S+) or (\d+)", new).groups()
    assert spaced.replace(" ", "") == plain != "4111111111111111" and plain[0] == "4" and luhn(plain)
    bad = re.search(r"bad (\d{4}-\d{4}-\d{4}-\d{4});", new)[1]
    assert bad[0] == "4" and bad != "4111-1111-1111-1112"
    iban = re.search(r"DE\d{20}", new)[0]
    assert iban != "DE89370400440532013000" and int(iban[4:] + "1314" + iban[2:4]) % 97 == 1
    assert re.search(r"; \d{3}-\d{2}-\d{4}; \+49 \d{2} \d{7}; \(\d{3}\) \d{3}-\d{4};", new)
    assert re.search(r"; 10\.\d+\.\d+\.\d+ and (?!10\.)\d+\.\d+\.\d+\.\d+;", new)
    low, high = new.split()[-2:]
    assert low.upper() == high and low.endswith(".org") and "doe" not in low


def test_neighbouring_entities_stay_apart(make):
    text = "+1 (826) 555-4081 190.137.223.204 4283648832092189 was.91@mail6.example.com 7536784127813050 4845168114407329"
    new, count = out_of(make([(1, text)]))[1]
    assert count == 6 and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} \d+\.\d+\.\d+\.\d+ 4\d{15} \S+@\S+\.com 7\d{15} 4\d{15}", new)
    assert not set(text.split()) & set(new.split()) - {"+1"}


def test_people_keep_title_gender_script_and_identity(make):
    docs = make([(1, "Mr. Jan Berg met Mrs. Eva Berg and Frau KLARA STEIN."), (2, "Then Mr. Berg left Dr. Stein, Господин Иван Петров too.")])
    got = out_of(docs)
    jan, berg, eva, berg2, klara, stein = re.fullmatch(r"Mr\. (\S+) (\S+) met Mrs\. (\S+) (\S+) and Frau (\S+) (\S+)\.", got[1][0]).groups()
    berg3, stein2, ivan, petrov = re.fullmatch(r"Then Mr\. (\S+) left Dr\. (\S+), Господин (\S+) (\S+) too\.", got[2][0]).groups()
    assert berg == berg2 == berg3 != "Berg" and stein.lower() == stein2.lower() and jan != eva
    assert eva.endswith(("a", "elle")) and jan.endswith(("o", "us", "an", "er")) and jan.istitle()
    assert re.fullmatch("[А-Яа-я]+", ivan + petrov) and petrov != "Петров"
    assert (got[1][1], got[2][1]) == (3, 3)


def test_all_names_after_a_title_and_no_possessive(make):
    text = "Mr. Jan Peter Berg saw Frau Anna von Berg, Mr. Berg's car, Mrs. O'Neil-Stein, Prof. Dr. J. Berg. Dr Berg Mrs Stein"
    new, count = out_of(make([(1, text)]))[1]
    pattern = r"Mr\. (\S+) (\S+) (\S+) saw Frau (\S+) von (\S+), Mr\. (\S+)'s car, Mrs\. (\S+), Prof\. Dr\. (\S+) (\S+)\. Dr (\S+) Mrs (\S+)"
    jan, peter, berg, anna, berg2, berg3, oneil, j, berg4, berg5, stein = re.fullmatch(pattern, new).groups()
    assert berg == berg2 == berg3 == berg4 == berg5 != "Berg" and count == 7
    assert not {jan, peter, anna, oneil, j, stein} & {"Jan", "Peter", "Anna", "O'Neil-Stein", "J.", "Stein"}


def test_collisions_are_drawn_again(make):
    # More one-letter names at one host than letters: later draws must find room.
    names = [f"{c}@h.org" for c in "abcdefghijklmnopqrstuvwxyz0123456789"]
    got = out_of(make([(i, n) for i, n in enumerate(names)]))
    assert len({t for t, _ in got.values()}) == len(names) and not {t for t, _ in got.values()} & set(names)


def test_key_and_edges(make):
    docs = make([(1, None, 5), (2, "", 5), (3, "none here", 5), (4, "a@b.org", 5), (4, "a@b.org", 5), (None, "x" * 90000 + " 8.8.8.8", 5)], "doc_id long, text string, n_entities int")
    rows = surrogates.pseudonymise(docs, "k").collect()
    assert len(rows) == 6 and {(r.doc_id, r.n_entities) for r in rows} == {(1, 0), (2, 0), (3, 0), (4, 1), (None, 1)}
    assert out_of(docs, "k")[4] != out_of(docs, "other")[4]
    assert surrogates.pseudonymise(make([]), "k").count() == 0
    with pytest.raises(ValueError):
        surrogates.pseudonymise(docs, "")
