"""Names, tokens and blocks as columns. Built-in expressions but for NFKC and casefold, which Spark lacks."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Dashes and apostrophes read as their plain form.
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015"
APOSTROPHES = "\u2018\u2019\u201b`\u00b4"
# Words without weight in lexical overlap.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "their", "this", "to", "uses", "using", "with")
#: Outer wrappers that may be taken off a name: name -> (opening, closing).
WRAPPERS = {"bold": ("**", "**"), "code": ("`", "`"), "dollar": ("$", "$"), "paren_math": (r"\(", r"\)"), "bracket_math": (r"\[", r"\]")}
#: Symbols in spans: LaTeX commands, identifiers with a subscript or call, single capital identifiers.
SYMBOLS = (r"\\[A-Za-z]+", r"[A-Za-z]+(?=_|\()", r"\b[A-Z][A-Z0-9]*\b")
_SPACE = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def nfkc(x: Column) -> Column:
    """Compatibility composition, by an Arrow-batched UDF; null stays null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))

    return run(x)


def casefold(x: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else t.casefold())

    return run(x)


def squeezed(x: Column) -> Column:
    """White space of any kind collapsed to one space, none at the ends."""
    return F.trim(F.regexp_replace(x, _SPACE, " "))


def plain_marks(x: Column) -> Column:
    return F.translate(x, APOSTROPHES + DASHES, "'" * len(APOSTROPHES) + "-" * len(DASHES))


def name_key(x: Column) -> Column:
    """The comparison key of a name: NFKC, plain apostrophes and dashes, single spaces, casefold."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        marks = str.maketrans(dict.fromkeys(APOSTROPHES, "'") | dict.fromkeys(DASHES, "-"))
        made = {t: " ".join(unicodedata.normalize("NFKC", t).translate(marks).split()).casefold() for t in s.dropna().unique()}
        return s.map(made.get)

    return run(x)


def name_key_native(x: Column) -> Column:
    """:func:`name_key` without Python, equal for text that NFKC leaves alone and whose only case fold beyond lower case is ß."""
    return F.replace(F.lower(squeezed(plain_marks(x))), F.lit("ß"), F.lit("ss"))


def name_audit(x: Column, wrappers: Mapping[str, tuple[str, str]] = WRAPPERS) -> Column:
    """``struct<key, operations>``: a name's normal form and the steps that changed it, in order.

    At most one outer wrapper goes, the first in order that leaves something; null and blank names
    give a null struct.
    """

    @F.pandas_udf("key string, operations array<string>")
    def run(s: pd.Series) -> pd.DataFrame:
        apostrophes, dashes = str.maketrans(dict.fromkeys(APOSTROPHES, "'")), str.maketrans(dict.fromkeys(DASHES, "-"))

        def unwrapped(t: str) -> tuple[str, str]:
            for name, (opening, closing) in wrappers.items():
                inner = t[len(opening) : len(t) - len(closing)]
                if t.startswith(opening) and t.endswith(closing) and inner.strip():
                    return inner, f"outer_wrapper_removed:{name}"
            return t, ""

        steps = (  # the names of the steps are fixed values
            (lambda t: unicodedata.normalize("NFKC", t), "unicode_normalization"),
            (lambda t: t.translate(apostrophes), "apostrophe_normalization"),
            (lambda t: t.translate(dashes), "dash_normalization"),
            (str.strip, "trim_whitespace"),
            (unwrapped, None),
            (lambda t: " ".join(t.split()) if t.split() and not (t[0].isspace() or t[-1].isspace()) else _inner_spaces(t), "collapse_whitespace"),
            (str.casefold, "casefold"),
        )

        def one(t: str | None) -> tuple[str | None, list[str] | None]:
            if t is None or not t.strip():
                return None, None
            done = []
            for step, label in steps:
                made = step(t)
                made, label = made if label is None else (made, label)
                if made != t:
                    done.append(label)
                t = made
            return t, done

        rows = [one(t) for t in s]
        return pd.DataFrame({"key": [r[0] for r in rows], "operations": [r[1] for r in rows]})

    return F.when(squeezed(x) != "", run(x))


def _inner_spaces(t: str) -> str:
    """White space collapsed, a single space kept at either end."""
    middle = " ".join(t.split())
    return (" " if t[:1].isspace() else "") + middle + (" " if t[-1:].isspace() else "")


def feature_text(x: Column) -> Column:
    """The key of a text without LaTeX delimiters."""
    return name_key(squeezed(F.regexp_replace(nfkc(x), r"\\[\[\]()]", " ")))


def evidence_text(x: Column) -> Column:
    """NFKC, casefold, single spaces."""
    return squeezed(casefold(nfkc(x)))


def words(x: Column) -> Column:
    """All tokens in order, repeats kept."""
    return F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0))


def token_text(x: Column) -> Column:
    return F.array_join(words(x), " ")


def token_set(x: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Distinct tokens but the stop words."""
    return F.array_except(words(x), F.array(*map(F.lit, stop)))


def lexical_tokens(x: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Distinct tokens but the stop words; all tokens where nothing else is left."""
    kept = token_set(x, stop)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array_distinct(words(x)))


def symbol_tokens(spans: Column, patterns: Sequence[str] = SYMBOLS, stop: Sequence[str] = ()) -> Column:
    """Distinct symbols of an array of spans, lower case, by each pattern."""

    def by(pattern: str) -> Column:
        return F.flatten(F.transform(F.filter(spans, lambda s: s.isNotNull()), lambda s: F.regexp_extract_all(s, F.lit(pattern), F.lit(0))))

    found = [by(p) for p in patterns]
    return F.array_except(F.transform(F.concat(*found), F.lower), F.array(*map(F.lit, stop)).cast("array<string>"))


def name_words(x: Column) -> Column:
    """A name's tokens in order without the possessive s."""
    return F.filter(words(x), lambda t: t != "s")


def initials(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: F.substring(t, 1, 1)), "")


def proper_subset(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) > 0)


def phrase_present(phrase: Column, span: Column) -> Column:
    """Both in :func:`evidence_text` form: the phrase as a substring, else its tokens as whole words in a row."""
    a, b = F.array_join(words(phrase), " "), F.array_join(words(span), " ")
    spaced = lambda t: F.concat(F.lit(" "), t, F.lit(" "))
    return ((phrase != "") & F.contains(span, phrase)) | ((a != "") & F.contains(spaced(b), spaced(a)))


def exact_span(text: Column, span: Column) -> Column:
    """A non-empty span that the text holds as it stands; false where either is null."""
    return F.coalesce(F.contains(text, span) & (span != ""), F.lit(False))


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def blocks(x: Column) -> Column:
    """Paragraphs between blank lines, stripped, empty ones dropped, repeats kept."""
    return F.filter(F.transform(F.split(x, "\n\n"), _stripped), lambda b: b != "")


def body_blocks(x: Column) -> Column:
    """:func:`blocks` of what follows the first line of three dashes; null where there is none."""
    return F.when(F.contains(x, F.lit("\n---\n")), blocks(F.regexp_replace(x, r"(?s)\A.*?\n---\n", "")))


def exact_blocks(x: Column) -> Column:
    """Paragraphs between lines of blanks and tabs, stripped, the first of equal ones only."""
    return F.array_distinct(F.filter(F.transform(F.split(x, r"\n[ \t]*\n"), _stripped), lambda b: b != ""))


def math_blocks(x: Column) -> Column:
    """Paragraphs, where one that is display math as a whole joins the paragraph before it."""
    parts = F.filter(F.transform(F.split(x, r"\n\s*\n+"), _stripped), lambda b: b != "")
    math = lambda b: b.rlike(r"^(?s)(\$\$.*\$\$|\\\[.*\\\])$")

    def joined(done: Column, b: Column) -> Column:
        last = F.concat(F.element_at(done, -1), F.lit("\n\n"), b)
        return F.when(math(b) & (F.size(done) > 0), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(last))).otherwise(F.concat(done, F.array(b)))

    return F.aggregate(parts, F.array().cast("array<string>"), joined)


def lecture_body(x: Column) -> Column:
    """The text after the first line of three dashes, stripped, with one line break; all of it where there is none."""
    return F.concat(_stripped(F.regexp_replace(x, r"(?s)\A(?:.*?\n)??---[ \t]*\n", "")), F.lit("\n"))


def section(x: Column, heading: str) -> Column:
    """The text under a first-level heading until the next one or a line of dashes; null where there is none."""
    found = F.regexp_extract(x, rf"(?ms)^# {heading}[ \t]*\n(.*?)(?=^# |^---[ \t]*$|\z)", 1)
    return F.when(x.rlike(rf"(?m)^# {heading}[ \t]*$"), _stripped(found))
