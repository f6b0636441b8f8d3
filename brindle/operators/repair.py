"""Repair of cut or noisy texts: JSON in prose, brackets left open, TOML arrays without commas."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .textscan import _skip

CLOSERS = {"{": "}", "[": "]", "(": ")"}


def close_json(text: str) -> str | None:
    """The longest start of a cut JSON text that is valid once its open brackets are closed; null if none is.

    Cuts are tried from the end, at the places where a value or a bracket may end.
    """
    open_, cuts, i = [], [], 0
    while i < len(text):
        c = text[i]
        if c == '"':
            end = re.compile(r'"(?:[^"\\]|\\.)*"', re.S).match(text, i)
            if not end:
                break
            i = end.end()
            cuts.append((i, "".join(open_)))
            continue
        if c in "{[":
            open_.append(c)
            cuts.append((i + 1, "".join(open_)))
        elif c in "}]":
            if not open_ or CLOSERS[open_.pop()] != c:
                break
            cuts.append((i + 1, "".join(open_)))
        elif re.match(r"[0-9a-z]", c):
            cuts.append((i + 1, "".join(open_)))
        i += 1
    wrong = len(text)  # what is wrong there is so in every longer start
    for end, still in reversed(cuts):
        if end > wrong:
            continue
        whole = text[:end] + "".join(CLOSERS[c] for c in reversed(still))
        try:
            json.loads(whole)
            return whole
        except json.JSONDecodeError as e:
            wrong = min(wrong, e.pos)
    return None


def find_json(text: str | None) -> str | None:
    """The JSON of a noisy text, as compact JSON: the text itself, or what stands at the first brace that opens an object.

    One scan over the braces behind any <think> block: an object that is whole is the answer, one that the text's end
    cuts is closed, and a brace of anything else is passed over. If none is either, the first one is closed as far as it is valid.
    """
    body = re.sub(r"<think>[\s\S]*?</think>", "", text or "").strip()
    decoder = json.JSONDecoder()
    found: object = None
    braces = [m.start() for m in re.finditer(r"\{", body)]
    try:
        found, end = decoder.raw_decode(body)
        if end == len(body):
            return json.dumps(found, ensure_ascii=False)
    except ValueError:
        pass
    past = -1
    for at in braces:
        if at < past:
            continue
        try:
            return json.dumps(decoder.raw_decode(body, at)[0], ensure_ascii=False)
        except json.JSONDecodeError as e:
            if e.pos >= len(body) or e.msg.startswith("Unterminated string"):
                break
            past = e.pos  # what stands before it was read as part of something that is no JSON
    else:
        at = braces[0] if braces else len(body)
    closed = close_json(body[at:]) if braces else None
    return json.dumps(json.loads(closed), ensure_ascii=False) if closed else None



def balance(text: str) -> str:
    """Closers without an opener go, and openers without a closer get one at the end; strings and comments stay."""
    out, open_, i = [], [], 0
    while i < len(text):
        j = _skip(text, i)
        if j > i:
            out.append(text[i:j])
            i = j
            continue
        c = text[i]
        if c in CLOSERS:
            open_.append(c)
        elif c in CLOSERS.values():
            if not open_ or CLOSERS[open_[-1]] != c:
                i += 1
                continue
            open_.pop()
        out.append(c)
        i += 1
    return "".join(out) + "".join(CLOSERS[c] for c in reversed(open_))


def extract_json(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(find_json)

    return run(text)


def balanced(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else balance(t))

    return run(text)


def toml_commas(text: Column) -> Column:
    """A comma after a string that another string follows on the next line."""
    return F.regexp_replace(text, r'"[^\S\n]*\n\s*(?=")', '",\n    ')
