"""Visually identical text with different characters: one consistent form, by SQL inside Arrow partitions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.session import BROADCAST_BYTES

#: Partitions over which the spans of one lecture spread where texts are too large to broadcast.
SALTS = 32
# Characters without width, as code point ranges.
INVISIBLE = ((0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xE0100, 0xE01EF))
# Hyphens, dashes of hyphen's look and the minus sign.
HYPHENS = "‐‑‒–—―⁃−﹘﹣－"
# Letters of other scripts (and variants) and the Latin letter each looks like.
CYRILLIC = ("аеорсухіјѕԁһԛԝӏѵАВЕКМНОРСТУХІЈЅԌԚԜӀ", "aeopcyxijsdhqwlvABEKMHOPCTYXIJSGQWI")
OTHER = ("օոսցհզɡɑıⅼⅽⅾⅿⅰⅴⅹ", "onughqgailcdmivx")
GREEK = ("ονυιαρϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ovuiapcjABEZHIKMNOPTYXCJ")
# Ligatures and joined letters, and the letters they show.
LIGATURES = {
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st",
    "Ĳ": "IJ", "ĳ": "ij", "Ǉ": "LJ", "ǈ": "Lj", "ǉ": "lj", "Ǌ": "NJ", "ǋ": "Nj", "ǌ": "nj",
}


def compatibility_pairs() -> dict[str, str]:
    """Compatibility characters of the same look that are one character in their plain form.

    By rule, over all of Unicode: full-width, half-width and no-break forms and fonts, whose NFKC
    form is a single character. Superscripts, circled and squared forms look different and stay.
    """
    out = {}
    for c in range(0x80, 0x1FFFF):
        kind = unicodedata.decomposition(chr(c)).partition(" ")[0]
        if kind in ("<wide>", "<narrow>", "<noBreak>", "<font>"):
            plain = unicodedata.normalize("NFKC", chr(c))
            if len(plain) == 1:
                out[chr(c)] = plain
    return out


_known: dict[str, str] = {}


def confusables(spark: SparkSession) -> dict[str, str]:
    """Letters of other scripts and the ASCII letter each looks like, by rule from the public table of confusables.

    The table is that of the ICU library which Spark ships with: two characters look alike if their
    skeletons are equal. A letter gets the ASCII letter of its skeleton, of its own case where there
    are several; Latin letters and modifier letters stay as they are. A JVM without the library is an
    error, as the fixed lists alone would miss cases unseen. Made once in a process.
    """
    if not _known:
        letters = [chr(c) for c in (*range(0x41, 0x7B), *range(0xA1, 0x3400), *range(0xA000, 0xAC00), *range(0xD7B0, 0xD800), *range(0xF900, 0x20000)) if unicodedata.category(chr(c))[0] == "L"]
        try:
            checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
            skeletons = dict(zip(letters, checker.getSkeleton("\n".join(letters)).split("\n"), strict=True))
        except Exception as e:
            raise RuntimeError("the table of confusables cannot be read: look-alike letters need the ICU library (com.ibm.icu) on Spark's class path") from e
        plain: dict[tuple[str, bool], str] = {}
        for x in (x for x in letters if x.isascii()):
            plain.setdefault((skeletons[x], x.isupper()), x)
        found_all: dict[str, str] = {}
        for x in letters:
            if not x.isascii() and not unicodedata.name(x, "LATIN").startswith(("LATIN", "MODIFIER")):
                found = plain.get((skeletons[x], x.isupper())) or plain.get((skeletons[x], not x.isupper()))
                if found:
                    found_all[x] = found
        if not found_all:
            raise RuntimeError("the table of confusables gives no look-alike letter")
        _known.update(found_all)
    return _known


def translation(more: Mapping[str, str] | None = None) -> tuple[str, str]:
    """Two strings of equal length for SQL ``translate``: compatibility forms, spaces, hyphens, look-alikes.

    ``more`` are further look-alikes; the fixed lists come first.
    """
    pairs = compatibility_pairs()
    pairs |= {chr(c): " " for c in range(0x80, 0x3001) if unicodedata.category(chr(c)) == "Zs"}
    pairs |= dict.fromkeys(HYPHENS, "-")
    looks: dict[str, str] = dict(more or {})
    for odd, plain in (CYRILLIC, GREEK, OTHER):
        looks |= dict(zip(odd, plain, strict=True))
    for c in range(0xC0, 0x2000):  # a look-alike under marks, where the plain letter with the same marks is one character
        base, *marks = unicodedata.normalize("NFD", chr(c))
        if marks and base in looks and len(made := unicodedata.normalize("NFC", looks[base] + "".join(marks))) == 1:
            looks[chr(c)] = made
    pairs = {a: looks.get(b, b) for a, b in pairs.items()} | looks
    return "".join(pairs), "".join(pairs.values())


def normalizing_sql(column: str = "t", more: Mapping[str, str] | None = None) -> str:
    """The consistent form of a text as one SQL expression.

    Invisible characters go first, as they may part a letter from its accent; then canonical
    composition, ligatures become their letters and ``translate`` maps one character to one;
    composition again, as an accent may now meet a plain letter. Line breaks and tabs, case, accents
    and all else stay.
    """
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    odd, plain = translation(more)
    classes = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in INVISIBLE)
    text = f"nfc_normalize(regexp_replace({column}, {quote(f'[{classes}]')}, '', 'g'))"
    for ligature, letters in LIGATURES.items():
        text = f"replace({text}, {quote(ligature)}, {quote(letters)})"
    return f"nfc_normalize(translate({text}, {quote(odd)}, {quote(plain)}))"


def normalized(df: DataFrame, text: str, out: str = "look", threads: int = 1) -> DataFrame:
    """``df`` with the consistent form of the string column ``text`` in the column ``out``.

    DuckDB runs the SQL on each Arrow batch as it passes through a task. Null stays null, an empty
    text or one of invisible characters only becomes empty; texts of any length are taken whole;
    every row and every other column passes unchanged. ``out`` must be a new name.
    """
    if out in df.columns:
        raise ValueError(f"there is a column {out} already")
    sql = f"SELECT {normalizing_sql(more=confusables(df.sparkSession))} AS look FROM batch"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(":memory:", config={"threads": threads, "memory_limit": "400MB"})
        at = None
        for b in batches:
            at = b.schema.names.index(text) if at is None else at
            batch = pa.table({"t": b.column(at)})
            con.register("batch", batch)
            looks = con.sql(sql).to_arrow_table().column(0).combine_chunks()
            looks = looks.chunk(0) if isinstance(looks, pa.ChunkedArray) else looks
            con.unregister("batch")
            yield pa.RecordBatch.from_arrays([*b.columns, looks.cast(pa.string())], [*b.schema.names, out])
        con.close()

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def spans_of(df: DataFrame, table_name: str, record_id: str) -> DataFrame:
    """Distinct spans of a table with their place: null records of the array and null parts are no spans."""
    each = df.select(F.col(record_id).alias("record_id"), F.posexplode("evidence_spans").alias("span_no", "s"))
    each = each.filter("s.span IS NOT NULL AND s.lecture_id IS NOT NULL")
    return each.select(F.lit(table_name).alias("table_name"), "record_id", F.col("span_no").cast("long").alias("span_no"), "s.lecture_id", "s.span")


def disguised(spans: DataFrame, lectures: DataFrame) -> DataFrame:
    """Spans that are no substring of their lecture's text but look the same as one.

    Both sides are brought to the consistent form; a span is a case if its form occurs in that of
    its lecture while the stored span does not occur in the stored text. A lecture delivered twice
    counts once per distinct text, and a span that occurs in any of its texts as stored is no case.
    Null texts and spans, unknown lectures, empty spans and spans of invisible characters only are
    no cases. Repeated rows give one case.

    The spans that occur as stored need no second look and leave before Python sees them. The texts
    are broadcast only if their measured size is under ``BROADCAST_BYTES``; else both joins go by
    lecture and salt, so that the spans of one lecture spread over ``SALTS`` partitions.
    """
    size = lectures.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("lecture_id")), F.lit(0))).first()[0]
    texts = normalized(lectures.select("lecture_id", "text").filter("text IS NOT NULL").distinct(), "text", "look_text")
    one = texts.groupBy("lecture_id").agg(F.collect_list(F.struct("text", "look_text")).alias("texts"))
    if 2 * size <= BROADCAST_BYTES:
        one, on = F.broadcast(one), ["lecture_id"]
    else:
        one, on = one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["lecture_id", "salt"]
    spans = spans.withColumn("salt", F.pmod(F.hash("record_id", "span_no"), F.lit(SALTS)))
    joined = spans.join(one, on).drop("salt") if len(on) == 1 else spans.join(one, on)
    rare = joined.filter(~F.exists("texts", lambda t: F.contains(t["text"], F.col("span"))))
    odd = normalized(rare.select("table_name", "record_id", "span_no", *on, "span"), "span", "look_span")
    odd = odd.filter("look_span <> ''").join(one.withColumnRenamed("texts", "texts_"), on)
    same = odd.filter(F.exists("texts_", lambda t: F.contains(t["look_text"], F.col("look_span"))))
    return same.select("table_name", "record_id", "span_no").distinct()
