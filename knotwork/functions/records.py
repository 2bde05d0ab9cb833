"""What a prediction record is: its identifier, however a file writes it, and the contracts of the feeds."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from knotwork.functions.jsontree import items_of, parsed

# Words that name the same thing in a field name, by the word they are read as;
# words read as '' say nothing about the field.
SYNONYMS = {
    "src": "source", "from": "source", "head": "source", "origin": "source", "start": "source", "subject": "source",
    "tgt": "target", "to": "target", "tail": "target", "dest": "target", "destination": "target", "dst": "target", "end": "target",
    "rel": "relation", "edge": "relation", "relationship": "relation", "link": "relation",
    "kind": "type", "label": "type",
    "reason": "rationale", "reasoning": "rationale", "justification": "rationale", "explanation": "rationale", "why": "rationale",
    "span": "spans", "quote": "spans", "quotes": "spans", "excerpts": "spans", "passages": "spans",
    "support": "evidence", "supporting": "evidence", "supports": "evidence", "proof": "evidence",
    "canon": "canonical", "identifier": "id", "key": "id", "ident": "id", "ids": "id", "uid": "id",
    "object": "ko", "knowledge": "ko", "concept": "ko", "lesson": "lecture",
    "conn": "", "connection": "", "ref": "", "reference": "", "endpoint": "", "the": "",
}
#: Words so common in names that they weigh less than the others.
WEAK = frozenset({"id", "type", "canonical"})


def name_words(name: str) -> frozenset[str]:
    """The words of a field name (snake, camel or dotted), each read as its synonym."""
    parts = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)
    return frozenset(w for p in parts if (w := SYNONYMS.get(p.lower(), p.lower())))


def likeness(a: frozenset[str], b: frozenset[str]) -> float:
    """Weighted Jaccard of two names' words."""
    weigh = lambda ws: sum(0.4 if w in WEAK else 1.0 for w in ws)
    return weigh(a & b) / weigh(a | b) if a | b else 0.0


@dataclass(frozen=True)
class Contract:
    """A feed's agreed fields, in order, with their JSON types, and its identifier."""

    feed: str
    identifier: str
    pattern: str  # a whole identifier
    of_number: str | None  # printf form of an identifier written as a number
    fields: dict[str, str] = field(default_factory=dict)
    numbers: dict[str, str] = field(default_factory=dict)  # printf forms of other fields written as numbers

    @property
    def parents(self) -> frozenset[str]:
        return frozenset(".".join(f.split(".")[:i]) for f in self.fields for i in range(1, f.count(".") + 1))


RELATION = Contract("relation", "pair_id", r"rel_dev_\d+", "rel_dev_%08d")
CONNECTION = Contract(
    "connection", "canonical_pair_id", r"conn_dev_pair_[0-9a-f]+", None,
    numbers={"source_canonical_ko_id": "conn_dev_ko_%03d", "target_canonical_ko_id": "conn_dev_ko_%03d"},
)
CONTRACTS = {c.feed: c for c in (RELATION, CONNECTION)}


def identifier_in(value: object, contract: Contract) -> str | None:
    """The identifier a value stands for: as text, as a number, or alone in a list."""
    if isinstance(value, list) and len(value) == 1:
        value = value[0]
    if isinstance(value, str):
        text = value.strip()
        if re.fullmatch(contract.pattern, text):
            return text
        value = int(text) if contract.of_number and re.fullmatch(r"[0-9]{1,4000}", text) else None
    if contract.of_number and isinstance(value, int) and not isinstance(value, bool) and value >= 0:
        return contract.of_number % value
    return None


def identified(record: object, contract: Contract) -> tuple[str, str] | None:
    """``(field name, identifier)`` of a record; None where the object has no pair's identifier.

    The agreed name comes first, then a field whose text has the identifier's form, then a number
    or bare digits under a name that reads as a pair's id.
    """
    if not isinstance(record, dict):
        return None
    agreed = contract.identifier
    if agreed in record and (found := identifier_in(record[agreed], contract)):
        return agreed, found
    loose = None
    for name, value in record.items():
        found = identifier_in(value, contract)
        if found is None:
            continue
        inner = value[0] if isinstance(value, list) else value
        if isinstance(inner, str) and re.fullmatch(contract.pattern, inner.strip()):
            return name, found
        words = name_words(name)
        if loose is None and words <= {"pair", "id", "relation", "canonical", "no", "number"} and words & {"pair", "id"}:
            loose = name, found
    return loose


def records_of(content: str | None, contract: Contract | None) -> list[tuple[str, str, dict]]:
    """``(identifier, its field, record)`` for each record of a file, [] where it holds none.

    A file holds records only if its whole content is valid JSON: one record, a list of records or
    an object whose ``results`` is such a list. Depth and length of numbers have no limit.
    """
    return [(who[1], who[0], r) for r in _candidates(content, contract)[1] if (who := identified(r, contract))]


def record_texts(content: str | None, contract: Contract | None) -> list[tuple[str, str]]:
    """``(identifier, text)`` for each record of a file: the record's own text, byte for byte."""
    whole, values = _candidates(content, contract)
    found = [(i, who[1]) for i, r in enumerate(values) if (who := identified(r, contract))]
    if not found:
        return []
    texts = [content.strip(" \t\r\n")] if whole else items_of(content)
    return [(name, texts[i]) for i, name in found]


def _candidates(content: str | None, contract: Contract | None) -> tuple[bool, list]:
    """Whether the file is one object alone, and the values that may be records."""
    value = parsed(content)[1] if content and contract else None
    if isinstance(value, dict):
        inside = value.get("results")
        return (False, inside) if isinstance(inside, list) and not identified(value, contract) else (True, [value])
    return False, value if isinstance(value, list) else []


def reject_of(content: str | None, contract: Contract | None) -> str | None:
    """Why a file holds no record; None where it holds some."""
    if contract is None:
        return "unknown_feed"
    if not content:
        return "empty"
    valid, _ = parsed(content)
    if not valid:
        return "not_json"
    return None if records_of(content, contract) else "no_record"
