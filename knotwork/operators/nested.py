"""Deeply nested records to flat tables of parents and children."""

from __future__ import annotations

from collections.abc import Collection, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions.jsontree import DEEPEST, objects_inside, plain, step, string_of, tokens
from knotwork.session import col

TRIPLES = "key string, path string, ordinals array<int>, json_type string, value string"
ROWS = "key string, group string, ordinals array<int>, fields map<string, string>"
REJECTS = "key string, reason string"
_FLUSH = 20_000
_CACHED = 100_000
_LITERALS = {"true": ("boolean", "true"), "false": ("boolean", "false"), "null": ("null", None)}


class _Place:
    """A path with what is known of it; children are made once and kept."""

    __slots__ = ("below", "depth", "kept", "lists", "path", "repeated", "steps")

    def __init__(self, path: str, steps: int, lists: int, depth: int, kept: bool, repeated: bool):
        self.path, self.steps, self.lists, self.depth, self.kept, self.repeated = path, steps, lists, depth, kept, repeated
        self.below: dict[str, _Place | None] = {}


class Walker:
    """Path-ordinal-value triples of JSON texts by a pull parser, which builds no tree.

    ``repeated`` are the paths of lists; with ``dynamic`` a list of objects at any other path is one
    too. ``only`` keeps the triples of those paths, and no other path is followed; ``objects_only``
    those that mark an object.
    """

    def __init__(self, repeated: Collection[str], only: Collection[str] | None = None, objects_only: bool = False, dynamic: bool = False, deepest: int = DEEPEST):
        self.repeated, self.only, self.objects_only, self.dynamic, self.deepest = frozenset(repeated), None if only is None else frozenset(only), objects_only, dynamic, deepest
        self.towards = None if only is None else {p[:i] for p in self.only for i, c in enumerate(p) if c == "."} | self.only | {""}
        self._reset()

    def _reset(self) -> None:
        self.made = 0
        self.root = _Place("", 0, 0, 0, self.only is None or "" in self.only, "" in self.repeated)

    def _child(self, at: _Place, raw: str, lists: int) -> _Place | None:
        name = step(string_of(raw))
        path = plain(f"{at.path}.{name}" if at.steps else name)
        made = None
        if self.towards is None or path in self.towards:
            made = _Place(path, at.steps + 1, lists, at.depth + 1, self.only is None or path in self.only, path in self.repeated)
        at.below[raw] = made
        self.made += 1
        return made

    def triples(self, text: str) -> list[tuple[str, tuple, str, str | None, str]] | None:
        """``(path, ordinals, json_type, value, group)`` in document order; None where the text is not one valid JSON value.

        A repeated path adds one ordinal, the position in the list; one value in place of a list has
        position 0. A list at any other path, one inside a list, and an object deeper than
        ``deepest`` steps are one value, kept as JSON text. Of a member that stands twice in an
        object the last counts. A number is kept as it is written. ``group`` is the deepest list above.
        """
        if self.made > _CACHED:
            self._reset()
        out: list = []
        stack: list[list] = []  # [place, ordinals, next position (lists) or None, members seen, group]
        skipped, opaque = 0, None
        try:
            for kind, name, start, end in tokens(text):
                if skipped:
                    if kind in "{[":
                        skipped += 1
                    elif kind in "}]":
                        skipped -= 1
                        if not skipped and opaque is not None:
                            out.append((*opaque[:3], plain(text[opaque[3] : end]), opaque[4]))
                    continue
                if kind in "}]":
                    stack.pop()
                    continue
                item = False
                if not stack:
                    place, ordinals, group = self.root, (), ""
                else:
                    top = stack[-1]
                    place, ordinals, group = top[0], top[1], top[4]
                    if name is None:
                        item, ordinals = True, (*ordinals, top[2])
                        top[2] += 1
                    else:
                        place = place.below[name] if name in place.below else self._child(place, name, len(ordinals))
                        if place is not None:
                            seen = top[3]
                            if name in seen:
                                first = seen[name]
                                last = min((x for x in seen.values() if x > first), default=len(out))
                                out[first:last] = [None] * (last - first)
                            seen[name] = len(out)
                if place is None:
                    if kind in "{[":
                        skipped, opaque = 1, None
                    continue
                if kind == "[":
                    if not item and (place.repeated or (self.dynamic and objects_inside(text, start))):
                        stack.append([place, ordinals, 0, None, place.path])
                    else:
                        skipped, opaque = 1, (place.path, ordinals, "array", start, group) if place.kept and not self.objects_only else None
                    continue
                if place.repeated and not item:
                    ordinals, group = (*ordinals, 0), place.path
                if kind == "{":
                    if place.depth >= self.deepest:
                        skipped, opaque = 1, (place.path, ordinals, "object", start, group) if place.kept else None
                        continue
                    if place.kept:
                        out.append((place.path, ordinals, "object", None, group))
                    stack.append([place, ordinals, None, {}, group])
                elif place.kept and not self.objects_only:
                    if kind == "s":
                        out.append((place.path, ordinals, "string", plain(string_of(text[start:end])), group))
                    elif kind == "n":
                        out.append((place.path, ordinals, "number", text[start:end], group))
                    else:
                        out.append((place.path, ordinals, *_LITERALS[text[start:end]], group))
        except ValueError:
            return None
        return [t for t in out if t is not None]


def lists_in(text: str | None, deepest: int = DEEPEST) -> set[str]:
    """Paths, down to ``deepest`` steps, at which a record holds a list of objects."""
    out: set[str] = set()
    stack: list[tuple[str | None, bool]] = []
    try:
        for kind, name, _, _ in tokens(text or ""):
            if kind in "}]":
                stack.pop()
                continue
            if kind not in "{[":
                continue
            path, listed = stack[-1] if stack else ("", False)
            if kind == "{" and listed and path is not None:
                out.add(path)
            if name is not None and path is not None:
                path = (f"{path}.{step(string_of(name))}" if path else step(string_of(name))) if len(stack) < deepest else None
            stack.append((path, kind == "["))
    except ValueError:
        return set()
    return {plain(p) for p in out}


def repeated_paths(df: DataFrame, body: str) -> list[str]:
    """The paths that hold a list of objects in any record: as many rows as the schema has lists."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[str] = set()
        for b in batches:
            for text in b.column(0).to_pylist():
                found |= lists_in(text)
        yield pa.RecordBatch.from_pydict({"path": pa.array(sorted(found), pa.string())})

    return [r.path for r in df.select(col(body)).mapInArrow(scan, "path string").distinct().orderBy("path").collect()]


def triples(df: DataFrame, key: str, body: str, repeated: Sequence[str], only: Sequence[str] | None = None, objects_only: bool = False, deepest: int = DEEPEST) -> DataFrame:
    """Path-value-ordinal triples of the JSON in ``body``, as :meth:`Walker.triples` makes them.

    Null, empty and invalid texts give no triple; :func:`rejected` names them. A record is parsed as
    a stream; what is held of it are its text and the triples that are kept of it, which leave in
    bounded batches.
    """
    rep, keep = list(repeated), list(only) if only is not None else None

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = Walker(rep, keep, objects_only, deepest=deepest)
        kinds = {"key": pa.string(), "path": pa.string(), "ordinals": pa.list_(pa.int32()), "json_type": pa.string(), "value": pa.string()}
        held: list[tuple] = []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, kinds.values(), strict=True)], list(kinds))

        for b in batches:
            for k, text in zip(b.column(0), b.column(1), strict=True):
                k = k.as_py()
                held += [(k, *t[:4]) for t in walker.triples(text.as_py() or "") or ()]
                while len(held) >= _FLUSH:
                    yield batch(held[:_FLUSH])
                    del held[:_FLUSH]
        yield batch(held)

    return df.select(col(key).cast("string"), col(body)).mapInArrow(parse, TRIPLES)


def flattened(df: DataFrame, key: str, body: str, repeated: Sequence[str], groups: Sequence[str] | None = None, only: Sequence[str] | None = None, deepest: int = DEEPEST) -> DataFrame:
    """``key, group, ordinals, fields``: one row per object of each repeated ancestor ('' for the record itself).

    The triples of a record are grouped by their deepest repeated ancestor and its ordinals, and each
    group is pivoted into one row with its fields by path. All triples of a row come from one record,
    so this is done where the record is parsed and nothing is shuffled. The parent's key is the same
    key and ordinals without the last one; a null or scalar in a list keeps its position and is no
    row. Lists of objects at paths that ``repeated`` does not name get groups of their own, so a new
    list loses nothing. ``groups`` keeps the rows of those groups; with ``only`` no other fields are
    followed. An object inside a row is its fields; an empty one is none.
    """
    rep, wanted, keep = list(repeated), None if groups is None else frozenset(groups), None if only is None else [*(groups or ()), *only]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = Walker(rep, keep, dynamic=True, deepest=deepest)
        kinds = {"key": pa.string(), "group": pa.string(), "ordinals": pa.list_(pa.int32()), "fields": pa.map_(pa.string(), pa.string())}
        held: list[tuple] = []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, kinds.values(), strict=True)], list(kinds))

        for b in batches:
            for k, text in zip(b.column(0), b.column(1), strict=True):
                k = k.as_py()
                held += [(k, *r) for r in pivot(walker.triples(text.as_py() or "") or ()) if wanted is None or r[0] in wanted]
                while len(held) >= _FLUSH:
                    yield batch(held[:_FLUSH])
                    del held[:_FLUSH]
        yield batch(held)

    return df.select(col(key).cast("string"), col(body)).mapInArrow(parse, ROWS)


def pivot(found: Collection[tuple]) -> list[tuple[str, tuple, list[tuple[str, str | None]]]]:
    """``(group, ordinals, fields)`` of one record's triples; document order puts a row's object before its fields."""
    rows: dict[tuple, list] = {}
    out = []
    for path, ordinals, kind, value, group in found:
        if kind == "object" and path == group:
            rows[group, ordinals] = fields = [] if value is None else [(path, value)]
            out.append((group, ordinals, fields))
        elif kind != "object" or value is not None:
            fields = rows.get((group, ordinals))
            if fields is not None:
                fields.append((path, value))
    return out


def rejected(df: DataFrame, key: str, body: str) -> DataFrame:
    """``key, reason`` of the records that give no row: ``null``, ``empty`` or ``not_json``."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                reason = "null" if text is None else "empty" if not text.strip() else None
                if reason is None:
                    try:
                        for _ in tokens(text):
                            pass
                    except ValueError:
                        reason = "not_json"
                if reason:
                    rows.append((k, reason))
            cols = list(zip(*rows, strict=True)) if rows else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["key", "reason"])

    return df.select(col(key).cast("string"), col(body)).mapInArrow(check, REJECTS)


def latest_delivery(df: DataFrame, key: str, body: str, order: Sequence[str]) -> DataFrame:
    """One row per key: the latest delivery, ties by the text itself. ``max`` combines map-side."""
    row = F.max(F.struct(*(col(o).alias(f"o{i}") for i, o in enumerate(order)), col(body).alias("body")))
    return df.groupBy(col(key).alias("key")).agg(row.alias("row")).select("key", F.col("row.body").alias("body"))


def group_of(path: str, repeated: Sequence[str]) -> str:
    """The deepest repeated ancestor of a path, or '' for the root."""
    above = [r for r in repeated if path == r or path.startswith(r + ".")]
    return max(above, key=len, default="")


def table_of(rows: DataFrame, group: str, columns: Mapping[str, str], repeated: Sequence[str]) -> DataFrame:
    """One flat table out of :func:`flattened`: key, a position per repeated ancestor, the columns, and ``others``.

    ``columns`` maps output names to paths whose deepest repeated ancestor is ``group``; ``others`` is a
    map of the fields at all other paths, so a field that nobody named is not lost.
    """
    above = sorted((r for r in repeated if group == r or group.startswith(r + ".")), key=len)
    wrong = [p for p in columns.values() if group_of(p, repeated) != group]
    if wrong:
        raise ValueError(f"not paths of {group or 'the root'}: {wrong}")
    ids = [F.get("ordinals", F.lit(i)).alias(f"{r.replace('.', '_')}_no") for i, r in enumerate(above)]
    values = [F.try_element_at("fields", F.lit(p)).alias(n) for n, p in columns.items()]
    named = F.array(*(F.lit(p) for p in columns.values())).cast("array<string>")
    others = F.map_filter("fields", lambda k, v: ~F.array_contains(named, k) & v.isNotNull()).alias("others")
    return rows.filter(F.col("group") == group).select("key", *ids, *values, others)

