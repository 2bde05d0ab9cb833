"""JSON in Python workers: strict decoding at any depth, a pull parser, and the names of JSON types."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from json.decoder import scanstring

#: Digits up to which a whole number is read as an int; a longer one keeps its text.
DIGITS = 4000
#: Steps down to which paths are followed; what lies deeper is one value, kept as its JSON text.
DEEPEST = 1000

_WS = r"[ \t\n\r]*+"
_STRING = r'"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+"'
_VALUE = re.compile(rf"{_WS}(?:({_STRING})|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?)|(true|false|null)|([\[{{]))")
_KEY = re.compile(rf"{_WS}({_STRING}){_WS}:")
_NEXT = re.compile(rf"{_WS}([,\]}}])")
_END = re.compile(rf"{_WS}\Z")
_OBJECTS = re.compile(rf"\[(?:{_WS}null{_WS},)*+{_WS}\{{")
_KINDS = (None, "s", "n", "l")


class Number:
    """A number that neither int nor float holds as it stands, such as one of 5,000 digits or 1e400."""

    __slots__ = ("text",)

    def __init__(self, text: str):
        self.text = text

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Number) and other.text == self.text

    def __hash__(self) -> int:
        return hash(self.text)


def _whole(text: str) -> int | Number:
    return int(text) if len(text) <= DIGITS else Number(text)


def _real(text: str) -> float | Number:
    value = float(text)
    return value if math.isfinite(value) else Number(text)


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


class _Decoder(json.JSONDecoder):
    """The strict decoder; workers get it by being told to make one."""

    def __init__(self):
        json.JSONDecoder.__init__(self, parse_int=_whole, parse_float=_real, parse_constant=_refuse)

    def __reduce__(self):
        return _Decoder, ()


_DECODER = _Decoder()


def parsed(text: str | None) -> tuple[bool, object]:
    """Whether the whole text is one valid JSON value, and the value. Depth and length of numbers have no limit."""
    if not text:
        return False, None
    try:
        return True, _DECODER.decode(text)
    except RecursionError:
        try:
            return True, built(text)
        except ValueError:
            return False, None
    except ValueError:
        return False, None


def loads(text: str | None) -> object:
    """The decoded value, or None where the whole text is not valid JSON (or is null)."""
    return parsed(text)[1]


def string_of(raw: str) -> str:
    """A string token, quotes included, as the string it stands for."""
    return raw[1:-1] if "\\" not in raw else scanstring(raw, 1)[0]


def tokens(text: str) -> Iterator[tuple[str, str | None, int, int]]:
    """``(kind, name, start, end)`` of each value and each end of one, in document order: a pull parser.

    Kinds are ``{ [ } ]``, ``s`` (string), ``n`` (number) and ``l`` (true, false, null); ``name`` is the
    member's name as it is written, None for items. Only the open brackets are held, so depth costs no
    stack. A fault in the text is a ValueError when it is met.
    """
    closing: list[str] = []
    at, name = 0, None
    while True:
        m = _VALUE.match(text, at)
        if m is None:
            raise ValueError(f"no value at {at}")
        which, at = m.lastindex, m.end()
        if which == 4:
            opening = m[4]
            yield opening, name, at - 1, at
            end = _NEXT.match(text, at)
            close = "}" if opening == "{" else "]"
            if end is not None and end[1] == close:
                at = end.end()
                yield close, None, at - 1, at
            else:
                closing.append(close)
                name = None
                if opening == "{":
                    k = _KEY.match(text, at)
                    if k is None:
                        raise ValueError(f"no member at {at}")
                    name, at = k[1], k.end()
                continue
        else:
            yield _KINDS[which], name, m.start(which), at
        while closing:
            m = _NEXT.match(text, at)
            if m is None:
                raise ValueError(f"no end at {at}")
            at = m.end()
            if m[1] == ",":
                name = None
                if closing[-1] == "}":
                    k = _KEY.match(text, at)
                    if k is None:
                        raise ValueError(f"no member at {at}")
                    name, at = k[1], k.end()
                break
            if m[1] != closing.pop():
                raise ValueError(f"wrong end at {at}")
            yield m[1], None, at - 1, at
        else:
            if _END.match(text, at) is None:
                raise ValueError(f"more text at {at}")
            return


def built(text: str) -> object:
    """The decoded value by the pull parser, for texts too deep for the decoder."""
    root: list = []
    stack: list = [root]
    for kind, name, start, end in tokens(text):
        if kind in "}]":
            stack.pop()
            continue
        raw = text[start:end]
        value: object
        if kind in "{[":
            value = {} if kind == "{" else []
        elif kind == "s":
            value = string_of(raw)
        else:
            value = _DECODER.decode(raw)
        if name is None:
            stack[-1].append(value)
        else:
            stack[-1][string_of(name)] = value
        if kind in "{[":
            stack.append(value)
    return root[0]


def items_of(text: str) -> list[str]:
    """The texts of the records that a valid JSON text holds: items of a list, those of a member ``results`` that is a list, or the whole."""
    out, results, depth, begun = [], [], 0, 0
    listed = within = None
    for kind, name, start, end in tokens(text):
        if depth == 0:
            listed = kind == "["
        if kind in "}]":
            depth -= 1
            whole = begun
        else:
            if depth == (1 if listed else 2):
                begun = start
            whole = start
            if depth == 1 and not listed:
                within = name is not None and string_of(name) == "results" and kind == "["
                results = [] if within else results
            depth += kind in "{["
        if kind not in "{[" and depth == (1 if listed else 2) and (listed or within):
            (out if listed else results).append(text[whole:end])
    return out if listed else results


def objects_inside(text: str, start: int) -> bool:
    """Whether the list that begins at ``start`` holds an object as its first item that is not null."""
    return _OBJECTS.match(text, start) is not None


def dumps(value: object, **options) -> str:
    """A decoded value as JSON text, at any depth."""
    try:
        return json.dumps(value, **options)
    except (RecursionError, TypeError):
        return _written(value, options.get("sort_keys", False))


def _written(value: object, sort_keys: bool) -> str:
    out: list[str] = []
    stack: list = [(True, value)]
    while stack:
        is_value, x = stack.pop()
        if not is_value:
            out.append(x)
        elif isinstance(x, Number):
            out.append(x.text)
        elif isinstance(x, dict):
            stack.append((False, "}"))
            for i, (k, v) in enumerate(reversed(sorted(x.items()) if sort_keys else list(x.items()))):
                stack += [(True, v), (False, ("" if i == len(x) - 1 else ", ") + json.dumps(k) + ": ")]
            out.append("{")
        elif isinstance(x, list):
            stack.append((False, "]"))
            for i, v in enumerate(reversed(x)):
                stack += [(True, v), (False, "" if i == len(x) - 1 else ", ")]
            out.append("[")
        else:
            out.append(json.dumps(x))
    return "".join(out)


def type_of(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int | float | Number):
        return "number"
    if isinstance(value, str):
        return "string"
    return "array" if isinstance(value, list) else "object"


def step(name: str) -> str:
    """A member's name as a step of a path: dots and backslashes in it are escaped."""
    return name.replace("\\", "\\\\").replace(".", "\\.") if "." in name or "\\" in name else name


def steps(path: str) -> list[str]:
    """The members' names that a path leads through."""
    if "\\" not in path:
        return path.split(".")
    return [re.sub(r"\\(.)", r"\1", p) for p in re.findall(r"(?:[^.\\]|\\.)+|(?<=\.)(?=\.|\Z)|\A(?=\.)", path)]


def value_at(record: object, path: str) -> object:
    """The value at a path of objects, None where there is none."""
    for name in steps(path):
        record = record.get(name) if isinstance(record, dict) else None
    return record


def plain(text: str) -> str:
    """Lone surrogates, which no column can hold, become question marks."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode("utf-8")


def text_of(value: object) -> str | None:
    """A scalar as text."""
    if value is None or isinstance(value, str):
        return value if value is None else plain(value)
    return value.text if isinstance(value, Number) else json.dumps(value, ensure_ascii=True)
