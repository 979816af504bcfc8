"""Personal-data screen for JSON events, and redaction of what it catches.

Two steps. A native screen over the raw text clears rows that cannot contain a hit; it may
suspect too much but never too little. Only suspects reach the Python worker, as one Arrow
column that is NULL for every cleared row, where a depth-first walk names the first hit.
"""

from __future__ import annotations

import json
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from provenant import contract
from provenant.functions.jsontypes import field
from provenant.functions.personal_data import EMAIL_PROBE, PHONE_PROBE

# The walk travels to the workers inside the plan, so they need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

def _first_letters(keys: tuple[str, ...]) -> str:
    return "".join(sorted({key[0] for key in keys}))


# A look-ahead on the first letter spares most quotes the whole key list.
_STRUCTURAL_PAIR = (
    rf'"(?=[{_first_letters(contract.STRUCTURAL_KEYS)}])(?:{"|".join(contract.STRUCTURAL_KEYS)})"'
    r'\s*+:\s*+(?:"[^"]*+"|-?[0-9.]++)'
)
_KEY_LETTERS = _first_letters(contract.PII_KEYS)
_PII_KEY = rf'"(?=[{_KEY_LETTERS}{_KEY_LETTERS.upper()}])(?i:{"|".join(contract.PII_KEYS)})"'

#: An event that may hold personal data and could not be searched for it.
UNSCREENED = "PII_SCREEN_IMPOSSIBLE"

_EMAIL = re.compile(contract.EMAIL_PATTERN)
_PHONE = re.compile(contract.PHONE_PATTERN)
_PII_KEYS = frozenset(contract.PII_KEYS)
_STRUCTURAL_KEYS = frozenset(contract.STRUCTURAL_KEYS)
_INDEX_KEY = re.compile(r"0|[1-9][0-9]{0,9}")


def suspect(raw: Column) -> Column:
    """True unless the text provably holds no personal data.

    Without a backslash every quote is a string delimiter and every string is its own text, so
    searching the whole text covers all strings and keys. Exempt ``"key":value`` pairs go first:
    their ids and clocks would look like phones. Other long numbers only cause a needless walk.
    """
    text = F.regexp_replace(raw, _STRUCTURAL_PAIR, "")
    return (
        raw.contains("\\")
        | (raw.contains("@") & text.rlike(EMAIL_PROBE))
        | text.rlike(PHONE_PROBE)
        | text.rlike(_PII_KEY)
    )


def _tainted(text: str) -> bool:
    return bool(_EMAIL.search(text) or _PHONE.search(text))


def _members(node: dict) -> list:
    """Members in visiting order: array-index-like keys ascending, then as written."""
    indexed = [k for k in node if _INDEX_KEY.fullmatch(k) and int(k) < 2**32 - 1]
    if not indexed:
        return list(node.items())
    order = sorted(indexed, key=int)
    order += [k for k in node if k not in set(indexed)]
    return [(k, node[k]) for k in order]


def _scan(document) -> str | None:
    """First hit of a depth-first walk; an explicit stack keeps deep nesting safe."""
    pending = [(None, document, "")]
    while pending:
        key, node, path = pending.pop()
        if key is not None:
            lowered = key.lower()
            if lowered in _PII_KEYS:
                return f"PII_KEY_PRESENT:{path}"
            if lowered in _STRUCTURAL_KEYS:
                continue
        if isinstance(node, str):
            if _tainted(node):
                return f"PII_IN_VALUE:{path}"
        elif isinstance(node, list):
            pending += [(None, node[i], f"{path}[{i}]") for i in reversed(range(len(node)))]
        elif isinstance(node, dict):
            pending += [(k, v, f"{path}.{k}") for k, v in reversed(_members(node))]
    return None


def first_hit_in(raw: str | None) -> str | None:
    """Reason code of the first hit in one JSON text, or None.

    A suspect that the parser refuses or that goes beyond its limits (nesting, digits of a number)
    could not be screened, which is a code of its own and never passes for clean.
    """
    if raw is None:
        return None
    try:
        found = _scan(json.loads(raw))
    except (ValueError, RecursionError):
        return UNSCREENED
    # A path may hold half a surrogate pair, which no UTF-8 column can.
    return None if found is None else found.encode("utf-8", "replace").decode()


@F.arrow_udf(StringType())
def _walk(raw: pa.Array) -> pa.Array:
    if raw.null_count == len(raw):
        return pa.nulls(len(raw), pa.string())
    return pa.array([first_hit_in(text) for text in raw.to_pylist()], pa.string())


# Declared non-deterministic so that no later filter is pushed below it: pushing one would copy
# the walk, and the parse beneath it, into the filter and run both twice.
_walk_once = _walk.asNondeterministic()


def first_hit(raw: Column) -> Column:
    """Reason code of the first hit in a JSON event, or NULL."""
    return _walk_once(F.when(suspect(raw), raw))


def redacted(raw: Column) -> Column:
    """Structural skeleton of an event: absent keys stay absent, explicit nulls stay null."""
    event = F.try_parse_json(raw)
    kept = [
        F.concat(F.lit(f',"{name}":'), F.to_json(field(event, name)))
        for name in contract.REDACTION_KEEPS
    ]
    return F.concat(
        F.lit('{"_redacted":true'), *[F.coalesce(part, F.lit("")) for part in kept], F.lit("}")
    )
