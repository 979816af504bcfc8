"""The elements of a JSON array of any depth and with numbers of any length, as texts."""

from __future__ import annotations

import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The splitter travels to the workers inside the plan, so they need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOKEN = re.compile(
    r'[ \t\r\n]*(?:(?P<string>"(?:[^"\\\x00-\x1f]++|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*+")'
    r"|(?P<plain>(?:-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|true|false|null)(?![\w.+-]))|(?P<mark>[\[\]{},:]))")


def elements_of(body: str | None) -> list[str] | None:
    """The text of every element as it was sent; None for what does not start with a JSON array.

    What follows the array is ignored, as Spark's parser does. Open brackets are a list, not calls, so depth has no bound.
    """
    found, opened, start, at, want = [], [], 0, 0, "array"
    while m := TOKEN.match(body or "", at):
        kind, at = m.lastgroup, m.end()
        token = m["mark"] or kind
        begin = m.start(kind)
        if want == "array":
            if token != "[":
                return None
            opened, start, want = ["["], at, "value or end"
            continue
        if want.startswith("value"):
            if token in ("[", "{"):
                if len(opened) == 1:
                    start = begin
                opened.append(token)
                want = "value or end" if token == "[" else "key or end"
                continue
            if token in ("string", "plain"):
                if len(opened) == 1:
                    found.append(m[kind])
                want = "next"
                continue
            if want == "value" or token != "]":
                return None
        elif want.startswith("key"):
            if token == "string":
                want = "colon"
                continue
            if want == "key" or token != "}":
                return None
        elif want == "colon":
            if token != ":":
                return None
            want = "value"
            continue
        elif token == ",":
            want = "value" if opened[-1] == "[" else "key"
            continue
        # Only the end of what is open can stand here.
        if token != ("]" if opened[-1] == "[" else "}"):
            return None
        opened.pop()
        if not opened:
            return found
        if len(opened) == 1:
            found.append(body[start:at])
        want = "next"
    return None


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_beyond(bodies: pd.Series) -> pd.Series:
    return pd.Series([elements_of(b) if isinstance(b, str) else None for b in bodies], dtype=object)
