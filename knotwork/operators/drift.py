"""Schemas that drift between files: tagged-union inference and conversion to the agreed fields."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.functions.jsontree import DEEPEST, dumps, plain, step, text_of, type_of, value_at
from knotwork.functions.records import CONTRACTS, Contract, identifier_in, likeness, name_words, records_of
from knotwork.session import discard, written

UNION = "feed string, batch_id string, tags array<struct<path: string, json_type: string, shape: string>>, id_field string, n_records long"
#: A signature row has ``tags`` and ``n_records``; a clue row has a record's identifier, the hashes of its values, and 1 as ``n_records`` if it lacks a field.
FUSED = UNION + ", record_id string, cells array<struct<path: string, value: long>>"
CHANGES = "feed string, batch_id string, field_path string, change string, json_type string, n_records long"
_TAG = pa.struct([("path", pa.string()), ("json_type", pa.string()), ("shape", pa.string())])
_CELL = pa.struct([("path", pa.string()), ("value", pa.int64())])
_FLUSH = 20_000
#: Placements that a task remembers; the memory is emptied when full, which changes no result.
_REMEMBERED = 50_000
#: Share of the records met in both layouts whose values must agree for a path to stand for a field.
AGREED = 0.5
#: Share of a field's values in place from which a shape is its usual one.
USUAL = 0.5


@dataclass(frozen=True)
class Evidence:
    """What the corpus says of one feed's fields, all of it: sums over every record.

    ``shapes`` has the share of each shape among a field's values in place and in the agreed type;
    ``agreed`` the share of the records, found both with the field in place and with the path, whose
    values agree, and whether these are several values.
    """

    shapes: Mapping[str, Mapping[str, float]] = field(default_factory=dict)
    agreed: Mapping[tuple[str, str], tuple[float, bool]] = field(default_factory=dict)


def shape_of(value: object) -> str:
    """A coarse form of a value; few forms exist, so that records of one layout have one signature."""
    if isinstance(value, list):
        inner = next((x for x in value if x is not None), None)
        return f"[{shape_of(inner) if not isinstance(inner, list) else 'list'}]" if inner is not None else "[]"
    if not isinstance(value, str):
        return type_of(value)
    if re.fullmatch(r"[A-Z]+(_[A-Z]+)*", value):
        return "ENUM"
    if re.fullmatch(r"[A-Za-z]+(_[A-Za-z]+)*_\d+", value):
        return "slug_9"
    if re.fullmatch(r"[A-Za-z]+(_[A-Za-z0-9]+)*_[0-9a-f]+", value):
        return "slug_hex"
    return "text" if re.search(r"\s", value) else "word"


def tags_of(record: dict) -> tuple[tuple[str, str, str], ...]:
    """Every path of a record with its JSON type and shape, objects entered (down to ``DEEPEST`` steps), lists not; sorted."""
    out, stack = [], [(step(k), v, 1) for k, v in record.items()]
    while stack:
        path, value, depth = stack.pop()
        out.append((plain(path), type_of(value), shape_of(value)))
        if isinstance(value, dict) and depth < DEEPEST:
            stack += [(f"{path}.{step(k)}", v, depth + 1) for k, v in value.items()]
    return tuple(sorted(out))


def fingerprint(value: object, contract: Contract) -> int | None:
    """A hash of what a value says, however it is written: a number and its text, one item and a list of it, are alike."""
    if isinstance(value, list) and len(value) == 1:
        value = value[0]
    if value is None or value == [] or value == "":
        return None
    if isinstance(value, int) and not isinstance(value, bool) and contract.numbers:
        value = next(iter(contract.numbers.values())) % value
    text = dumps(value, sort_keys=True) if isinstance(value, list | dict) else text_of(value)
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def contracts_from(schema_fields: DataFrame, contracts: Mapping[str, Contract] = CONTRACTS) -> dict[str, Contract]:
    """The contracts with the agreed fields of ``schema_fields``; a table of fields, not of data, of at most 10,000 rows."""
    rows = schema_fields.select("feed", "field_path", "json_type").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 agreed fields")
    agreed: dict[str, dict[str, str]] = {}
    for r in rows:
        agreed.setdefault(r.feed, {})[r.field_path] = r.json_type
    return {f: replace(c, fields=agreed.get(f, {})) for f, c in contracts.items()}


def fused(files: DataFrame, contracts: Mapping[str, Contract], clues: bool = True) -> DataFrame:
    """One pass over the files: counts per signature, and with ``clues`` the hashed values of each record.

    Every task fuses the records it reads into counts per batch and signature (rows with ``tags``). A
    record's clue row has the values of its agreed fields in place and, where a field is missing, of
    the paths that stand for none.
    """
    known = dict(contracts)

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        cells: list[tuple] = []
        kinds = (pa.string(), pa.string(), pa.list_(_TAG), pa.string(), pa.int64(), pa.string(), pa.list_(_CELL))
        names = [f.split()[0] for f in re.sub("<.*?>", "", FUSED).split(", ")]

        def flush() -> pa.RecordBatch:
            rows = [(f, b, [dict(zip(("path", "json_type", "shape"), t, strict=True)) for t in tags], i, n, None, None) for (f, b, tags, i), n in held.items()]
            rows += [(f, None, None, None, lacking, r, [{"path": p, "value": v} for p, v in c]) for f, r, c, lacking in cells]
            held.clear()
            cells.clear()
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, kinds, strict=True)], names)

        for b in batches:
            for feed, batch, content in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                contract = known.get(feed)
                for rid, id_field, record in records_of(content, contract):
                    tags = tags_of(record)
                    held[feed, batch, tags, plain(id_field)] += 1
                    if clues:
                        at = {p for p, _, _ in tags}
                        paths = [f for f in contract.fields if f in at]
                        lacking = int(len(paths) < len(contract.fields))
                        if lacking:
                            paths += [p for p in at if p not in contract.fields and p not in contract.parents]
                        found = [(p, fingerprint(value_at(record, p), contract)) for p in paths]
                        cells.append((feed, rid, [c for c in found if c[1] is not None], lacking))
                if len(held) + len(cells) >= _FLUSH:
                    yield flush()
        yield flush()

    return files.select("feed", "batch_id", "content").mapInArrow(fuse, FUSED)


def tagged_union(found: DataFrame) -> DataFrame:
    """The fused schema out of :func:`fused`: per batch each distinct set of tagged paths and how many records show it.

    Alternative types of a path stay apart as different tags. Rows grow with batches and layouts, not
    with records; a batch that holds a third of all files sends a few rows per task.
    """
    return found.filter("tags IS NOT NULL").groupBy("feed", "batch_id", "tags", "id_field").agg(F.sum("n_records").alias("n_records"))


def shapes_in_place(union: DataFrame, contracts: Mapping[str, Contract]) -> dict[str, dict[str, dict[str, float]]]:
    """Per feed and agreed field the shapes that its values take in place and in the agreed type, with their shares.

    All of them count; at most fields times shapes rows reach the driver.
    """
    agreed = union.sparkSession.createDataFrame(
        [(f, p, t) for f, c in contracts.items() for p, t in c.fields.items()], "feed string, path string, json_type string"
    )
    seen = union.select("feed", F.explode("tags").alias("t"), "n_records").select("feed", "t.*", "n_records")
    rows = seen.join(F.broadcast(agreed), ["feed", "path", "json_type"]).groupBy("feed", "path", "shape").agg(F.sum("n_records").alias("n")).collect()
    total: Counter = Counter()
    for r in rows:
        total[r.feed, r.path] += r.n
    out: dict[str, dict[str, dict[str, float]]] = {f: {} for f in contracts}
    for r in rows:
        out[r.feed].setdefault(r.path, {})[r.shape] = r.n / total[r.feed, r.path]
    return out


def agreements(found: DataFrame, contracts: Mapping[str, Contract]) -> dict[str, dict[tuple[str, str], tuple[float, bool]]]:
    """Per feed, field and free path: in what share of the records that files show both ways the two values agree,
    and whether several values do.

    A record that one file holds with the field in place and another with an unknown path in its stead
    tells whether the path carries the field's value; only the cells of such records are shuffled. Cells are grouped by record, and by record and
    value, into sets of paths, which the layouts bound, so a record in a third of all files is a few
    sets per task. Pairs that never agree do not reach the driver.
    """
    fields = found.sparkSession.createDataFrame([(f, p) for f, c in contracts.items() for p in c.fields], "feed string, path string")
    rows = found.filter("cells IS NOT NULL").select("feed", "record_id", "cells", F.col("n_records").alias("lacking"))
    both_ways = rows.groupBy("feed", "record_id").agg(F.count("*").alias("n"), F.max("lacking").alias("lacking")).filter("n > 1 AND lacking = 1").select("feed", "record_id")
    clues = rows.join(both_ways, ["feed", "record_id"]).select("feed", "record_id", F.explode("cells").alias("c")).select("feed", "record_id", "c.path", "c.value")
    cells = clues.join(F.broadcast(fields.withColumn("agreed", F.lit(True))), ["feed", "path"], "left")
    both = (F.collect_set(F.when(F.col("agreed"), F.col("path"))).alias("fields"), F.collect_set(F.when(F.col("agreed").isNull(), F.col("path"))).alias("free"))
    pairs = lambda by: cells.groupBy("feed", "record_id", *by).agg(*both).filter("size(fields) > 0 AND size(free) > 0").select("feed", *by, F.explode("fields").alias("field"), "free").select("feed", *by, "field", F.explode("free").alias("path"))
    met = pairs([]).groupBy("feed", "field", "path").agg(F.count("*").alias("n_met"))
    same = pairs(["value"]).groupBy("feed", "field", "path").agg(F.count("*").alias("n_same"), (F.min("value") < F.max("value")).alias("several"))
    out: dict[str, dict[tuple[str, str], tuple[float, bool]]] = {f: {} for f in contracts}
    for r in same.join(met, ["feed", "field", "path"]).collect():
        out[r.feed][r.field, r.path] = (min(1.0, r.n_same / r.n_met), r.several)
    return out


def placed(tags: tuple, id_field: str, contract: Contract, evidence: Evidence) -> dict[str, str]:
    """Agreed field -> the path at which a record of this signature holds its value.

    A field in its place stays there. A missing one is sought among the paths that stand for no
    agreed field, by evidence in this order: values that agree in records which other files show with
    the field in place (several different ones where the names have no word in common); the words of the names (a nested field must share a word of its own, not only
    its parent's), helped by the shape of the value, which counts by its share among the field's
    shapes in place; and last, without words, the only unknown member of the object, if it lacks that
    field only and the shape is the field's usual one. The identifier's field is the one by which the record was recognised.
    """
    kinds = {p: (t, s) for p, t, s in tags}
    out = {f: f for f in contract.fields if f in kinds}
    if contract.identifier in contract.fields and contract.identifier not in out:
        out[contract.identifier] = step(id_field)
    used = set(out.values())
    opaque = tuple(f + "." for f in used)  # inside a value of an agreed field nothing is looked at
    free = [p for p in kinds if p not in used and p not in contract.parents and not p.startswith(opaque)]
    scores = []
    for f, agreed in contract.fields.items():
        if f in out:
            continue
        own = name_words(f.rpartition(".")[2])
        strong = own - {"id", "type"} or own
        usual = evidence.shapes.get(f, {})
        for p in free:
            same, several = evidence.agreed.get((f, p), (0.0, False))
            kind, shape = kinds[p]
            leafy = kind != "object" or agreed == "object" or not any(q.startswith(p + ".") for q in kinds)
            words = name_words(p)
            like = likeness(name_words(f), words)
            if same >= AGREED and (like > 0 or several):
                scores.append((-10 - same - like, f, p))
                continue
            share = max(usual.get(shape, 0.0) if kind == agreed else 0.0, usual.get(shape[1:-1], 0.0) if shape[:1] == "[" else 0.0, usual.get(f"[{shape}]", 0.0))
            if like <= 0 or not strong & words or not (like >= 0.5 or share > 0) or not (leafy or like >= 0.5):
                continue
            if "." in p and p.rpartition(".")[0] in contract.parents and p.rpartition(".")[0] != f.rpartition(".")[0]:
                continue  # in another agreed object it is about that object
            scores.append((-(like + 0.4 * (share > 0) + 0.1 * share), f, p))
    for _, f, p in sorted(scores):
        if f not in out and p not in used:
            out[f] = p
            used.add(p)
    parent = lambda x: x.rpartition(".")[0]
    for f, agreed in contract.fields.items():  # one for one: the only field that an object lacks and its only unknown member of that shape
        if f in out or sum(g not in out and parent(g) == parent(f) for g in contract.fields) > 1:
            continue
        usual = evidence.shapes.get(f, {})
        fits = [p for p in free if p not in used and parent(p) == parent(f) and kinds[p][0] == agreed and usual.get(kinds[p][1], 0.0) >= USUAL]
        if len(fits) == 1:
            out[f] = fits[0]
            used.add(fits[0])
    return out


def changes_of(tags: tuple, id_field: str, contract: Contract, evidence: Evidence) -> list[tuple[str, str, str | None]]:
    """``(field_path, change, JSON type found)`` of one signature against the contract."""
    kinds = {p: t for p, t, _ in tags}
    where = placed(tags, id_field, contract, evidence)
    out: list[tuple[str, str, str | None]] = []
    for f, agreed in contract.fields.items():
        if f not in where:
            out.append((f, "removed", None))
            continue
        kind = kinds.get(where[f])
        if where[f] != f:
            out.append((f, "renamed", kind))
        if kind not in (None, "null", agreed):
            out.append((f, "type_changed", kind))
    used = set(where.values())
    holds = {".".join(p.split(".")[:i]) for p in used for i in range(1, p.count(".") + 1)} | contract.parents
    new = [p for p in kinds if p not in used and p not in holds and not p.startswith(tuple(u + "." for u in used))]
    for p in new:
        if not any(p.startswith(q + ".") for q in new):  # of a new object only its own path
            out.append((p, "added", kinds[p]))
    return out


def changes(union: DataFrame, contracts: Mapping[str, Contract], evidence: Mapping[str, Evidence]) -> DataFrame:
    """Every change per batch with the number of records that show it and the JSON type found.

    Each distinct signature is classified once, whatever the number of its batches; the few, dear rows
    are spread over all cores by a set number of partitions.
    """
    known, usual = dict(contracts), dict(evidence)
    signature = ["feed", "tags", "id_field"]
    schema = union.select(*signature).schema.add("changes", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("field_path", "change", "json_type")])))
    kind = pa.list_(pa.struct([(n, pa.string()) for n in ("field_path", "change", "json_type")]))

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                tags = tuple((t["path"], t["json_type"], t["shape"]) for t in r["tags"])
                made = changes_of(tags, r["id_field"], known[r["feed"]], usual.get(r["feed"], Evidence()))
                out.append([dict(zip(("field_path", "change", "json_type"), c, strict=True)) for c in made])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], [*b.schema.names, "changes"])

    distinct = union.select(*signature).distinct().repartition(union.sparkSession.sparkContext.defaultParallelism, *signature)
    each = union.join(distinct.mapInArrow(classify, schema), signature).select("feed", "batch_id", F.explode("changes").alias("c"), "n_records")
    return each.groupBy("feed", "batch_id", "c.field_path", "c.change", "c.json_type").agg(F.sum("n_records").alias("n_records"))


def infer(files: DataFrame, contracts: Mapping[str, Contract]) -> tuple[DataFrame, dict[str, Evidence]]:
    """The tagged union, written once to the shared folder, and the evidence of all records."""
    found = written(fused(files, contracts), "fused")
    union = written(tagged_union(found), "union")
    shapes, agreed = shapes_in_place(union, contracts), agreements(found, contracts)
    discard(found)
    return union, {f: Evidence(shapes[f], agreed[f]) for f in contracts}


def alternatives(union: DataFrame) -> DataFrame:
    """Per feed and path each alternative type, its records and the first batch in which it appears."""
    seen = union.select("feed", "batch_id", F.explode("tags").alias("t"), "n_records")
    return seen.groupBy("feed", F.col("t.path").alias("field_path"), F.col("t.json_type").alias("json_type")).agg(
        F.sum("n_records").alias("n_records"), F.countDistinct("batch_id").alias("n_batches"), F.min("batch_id").alias("first_batch")
    )


def canonical(value: object, field: str, contract: Contract, agreed: str) -> object:
    """A value in the agreed type; what has no defined conversion gives null (its branch keeps it).

    A number or one-element list becomes the text it stands for, identifiers in their agreed form;
    one value in place of a list becomes a list of it, a joined text is split at `` | `` or commas.
    """
    if value is None:
        return None
    if field == contract.identifier:
        return identifier_in(value, contract)
    if agreed == "string":
        if isinstance(value, list):
            value = value[0] if len(value) == 1 else value
        if isinstance(value, int) and not isinstance(value, bool) and field in contract.numbers:
            return contract.numbers[field] % value
        return text_of(value) if not isinstance(value, list | dict) else None
    if agreed == "array":
        if isinstance(value, str):
            value = [x.strip() for x in re.split(r" \| |,(?=\w+_\d)", value)] if value else []
        items = value if isinstance(value, list) else [value]
        return [None if x is None else x if isinstance(x, str) else dumps(x, sort_keys=True) for x in items]
    return value if type_of(value) == agreed else None


def _flat(path: str) -> str:
    return path.replace(".", "_")


def unified(files: DataFrame, contract: Contract, evidence: Evidence) -> DataFrame:
    """One consistent table of a feed: every record in the agreed fields and types.

    Columns: file_id, batch_id, the agreed fields (dots become underscores; array elements that are
    objects are JSON texts) and ``branches``, a map from each field whose stored value had another
    type to ``type:JSON``, so no alternative is lost.
    """
    of = {"string": T.StringType(), "array": T.ArrayType(T.StringType()), "number": T.DoubleType(), "boolean": T.BooleanType(), "object": T.StringType()}
    arrow = {"string": pa.string(), "array": pa.list_(pa.string()), "number": pa.float64(), "boolean": pa.bool_(), "object": pa.string()}
    schema = T.StructType([T.StructField("file_id", T.LongType()), T.StructField("batch_id", T.StringType())])
    for f, kind in contract.fields.items():
        schema.add(_flat(f), of[kind])
    schema.add("branches", T.MapType(T.StringType(), T.StringType()))
    kinds = [pa.int64(), pa.string(), *(arrow[k] for k in contract.fields.values()), pa.map_(pa.string(), pa.string())]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[tuple, dict[str, str]] = {}
        for b in batches:
            out = []
            for file_id, batch, content in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for _, id_field, record in records_of(content, contract):
                    tags = tags_of(record)
                    if (tags, id_field) not in plans:
                        if len(plans) >= _REMEMBERED:
                            plans.clear()
                        plans[tags, id_field] = placed(tags, id_field, contract, evidence)
                    where = plans[tags, id_field]
                    row, branches = [file_id, batch], []
                    for f, agreed in contract.fields.items():
                        value = value_at(record, where[f]) if f in where else None
                        if value is not None and type_of(value) != agreed:
                            branches.append((f, f"{type_of(value)}:{dumps(value)}"))
                        made = canonical(value, f, contract, agreed)
                        row.append(dumps(made, sort_keys=True) if agreed == "object" and made is not None else made)
                    out.append((*row, branches))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], schema.names)

    return files.filter(F.col("feed") == contract.feed).select("file_id", "batch_id", "content").mapInArrow(convert, schema)
