"""Damaged JSON, as models write it, mended as far as it can be read."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = re.compile(r"```(?:json)?\s*|\s*```", re.I)
_CLOSES = {"{": "}", "[": "]"}


def mended(text: str | None) -> str | None:
    """The first JSON value of a text, closed and cleaned so that it parses, else null.

    Fences and words around it go; so do trailing commas and dots for left-out parts; quotes of other shapes become plain;
    what is cut off is closed, the last incomplete member left out.
    """
    if not text:
        return None
    t = _FENCE.sub("", text)
    start = min((k for k in (t.find("{"), t.find("[")) if k >= 0), default=-1)
    if start < 0:
        return None
    t = t[start:].translate({0x201C: '"', 0x201D: '"'})
    try:
        value, _ = json.JSONDecoder().raw_decode(t)
        return json.dumps(value, ensure_ascii=False)
    except ValueError:
        pass
    t = re.sub(r",\s*(?:\.{3}|…)\s*(?=[\]}])|(?:\.{3}|…)\s*(?=[\]}])", "", t)
    t = re.sub(r",\s*(?=[\]}])", "", t)
    stack, quote, skip, safe = [], False, False, []
    for k, c in enumerate(t):
        if skip:
            skip = False
        elif quote:
            skip = c == "\\"
            quote = c != '"'
        elif c == '"':
            quote = True
        elif c in _CLOSES:
            stack.append(c)
        elif c in "}]":
            if not stack:
                break
            stack.pop()
            safe.append((k + 1, list(stack)))
            if not stack:
                break
        elif c == ",":
            safe.append((k, list(stack)))
    fault = len(t)
    for end, open_ in reversed(safe):
        if end > fault:  # what breaks the text before this place would break it again
            continue
        try:
            return json.dumps(json.loads(t[:end] + "".join(_CLOSES[c] for c in reversed(open_))), ensure_ascii=False)
        except json.JSONDecodeError as e:
            fault = min(fault, e.pos)
    return None


def mend(column: Column) -> Column:
    """``mended`` over a column, in Arrow batches; parse the result with ``from_json``."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(mended, na_action="ignore")

    return run(column)
