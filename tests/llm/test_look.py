import unicodedata

import pytest

from knotwork.llm import look


@pytest.fixture(scope="module")
def form():
    import duckdb

    con = duckdb.connect()
    sql = look.normalizing_sql()
    return lambda s: con.execute(f"SELECT {sql} FROM (SELECT ?::VARCHAR AS t)", [s]).fetchone()[0]


@pytest.mark.parametrize(
    ("odd", "plain"),
    [
        ("ｆｕｌｌ－ｗｉｄｔｈ１２", "full-width12"),
        ("état", "état"),
        ("a​b­c﻿d️e⁠f᠎g", "abcdefg"),
        ("a b c　d", "a b c d"),
        ("ﬁne ﬂow oﬀ eﬃcient ﬆep", "fine flow off efficient step"),
        ("well‐chosen‑fit − 1", "well-chosen-fit - 1"),
        ("ѕсоре оf Αn օrԁer", "scope of An order"),
        ("K", "K"),
        ("е́", "é"),
        ("αρα\u200b\u0301", "αρά"),
        ("ё", "ë"),
        ("", ""),
        (None, None),
        ("​‍", ""),
    ],
)
def test_equal_looks(form, odd, plain):
    assert form(odd) == (form(plain) if plain else plain)


@pytest.mark.parametrize(("a", "b"), [("Case", "case"), ("naïve", "naive"), ("x²", "x2"), ("a b", "ab"), ("①", "1"), ("it’s", "it's"), ("a\nb", "a b")])
def test_other_looks_stay_apart(form, a, b):
    assert form(a) != form(b)


def test_form_is_stable(form):
    text = "".join(chr(c) for c in range(0x20, 0x3000) if unicodedata.category(chr(c))[0] != "C" and not 0xD800 <= c < 0xE000)
    assert form(form(text)) == form(text)


LECTURES = "lecture_id string, text string, look string"
ROWS = "pair_id string, evidence_spans array<struct<lecture_id:string,span:string>>, span_no string"


def _found(spark, rows, lectures):
    spans = look.spans_of(spark.createDataFrame(rows, ROWS), "t", "pair_id")
    return sorted((tuple(r)[1:] for r in look.disguised(spans, spark.createDataFrame(lectures, LECTURES)).collect()), key=str)


def test_disguised(spark):
    lectures = [("l1", "The dense sample splits.", "x"), ("l1", "The dense sample splits.", "y"), ("l2", None, "z"), ("l3", "Α cópy", ""), (None, "abc", "")]
    rows = [
        ("a", [("l1", "dense sample"), None, ("l1", "dеnse sample"), ("l1", None), (None, "dense")], "1"),
        ("a", [("l1", "dense sample"), None, ("l1", "dеnse sample"), ("l1", None), (None, "dense")], "2"),  # delivered twice
        ("b", [("l1", "Dеnse sample")], ""),  # case
        ("c", [("l1", "dense sample"), ("l1", ""), ("l1", "​"), ("l2", "x"), ("l9", "x")], ""),
        ("d", None, ""),
        ("e", [], ""),
        (None, [("l3", "A cópy")], ""),
        ("f", [("l1", "x" * 200_000)], ""),
    ]
    want = [("a", 2), ("c", 0), (None, 0)]
    assert sorted(_found(spark, rows, lectures), key=str) == sorted(want, key=str)
    assert _found(spark, [], lectures) == [] and _found(spark, rows, []) == []


def test_salted_join_finds_the_same(spark, monkeypatch):
    lectures, rows = [("l1", "The dense sample splits.", "")], [("a", [("l1", "dеnse")], ""), ("b", [("l1", "dense")], ""), ("c", [("l1", "sаmple")], "")]
    broadcast = _found(spark, rows, lectures)
    monkeypatch.setattr(look, "BROADCAST_BYTES", 0)
    assert _found(spark, rows, lectures) == broadcast == [("a", 0), ("c", 0)]


def test_name_clash_is_an_error(spark):
    with pytest.raises(ValueError):
        look.normalized(spark.createDataFrame([("a", "b")], "text string, look string"), "text")


def test_letters_of_other_scripts_by_the_public_table(spark):
    more = look.confusables(spark)
    assert len(more) > 500 and all(len(a) == len(b) == 1 and b.isascii() and b.isalpha() for a, b in more.items())
    df = spark.createDataFrame([("ᎪҽᏢ οf ⲟne ѕtер", "Α ρ Ι І"), (None, None)], "text string, other string")
    rows = look.normalized(df, "text").collect()
    assert [r.look for r in rows] == ["AeP of one step", None]
    again = look.normalized(look.normalized(df, "text").select(look.F.col("look").alias("text")), "text").collect()
    assert [r.look for r in again] == [r.look for r in rows]
    letters = "".join(chr(c) for c in range(0xA1, 0x3000) if unicodedata.category(chr(c))[0] == "L")
    once = look.normalized(spark.createDataFrame([(letters,)], "text string"), "text").first().look
    assert look.normalized(spark.createDataFrame([(once,)], "text string"), "text").first().look == once


def test_a_missing_table_of_confusables_is_an_error(spark, monkeypatch):
    class Checker:
        """Stands for the JVM: no library at all, or one whose skeletons are of no use."""

        def __init__(self, skeleton):
            self._jvm = self.com = self.ibm = self.icu = self.text = self.SpoofChecker = self
            self.skeleton = skeleton

        def Builder(self):
            if self.skeleton is None:
                raise TypeError("'JavaPackage' object is not callable")
            return self

        def build(self):
            return self

        def getSkeleton(self, text):
            return self.skeleton(text)

    monkeypatch.setattr(look, "_known", {})
    for skeleton in (None, lambda text: "a\nb", lambda text: text):
        with pytest.raises(RuntimeError, match="confusables"):
            look.confusables(Checker(skeleton))
        assert look._known == {}
    jvm = type("Session", (), {"_jvm": Checker(None)})()
    df = type("Rows", (), {"columns": ["text"], "sparkSession": jvm})()
    with pytest.raises(RuntimeError, match="confusables"):
        look.normalized(df, "text")
    assert len(look.confusables(spark)) > 500
