"""Arrow types of the type strings used here, for tasks, where no session can parse them."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa

_PLAIN = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}


@lru_cache(maxsize=64)
def arrow_type(text: str) -> pa.DataType:
    """The type of e.g. ``array<struct<kind:string,lcn:bigint>>``."""
    words = re.findall(r"[\w]+|[<>:,]", text)
    at = 0

    def one() -> pa.DataType:
        nonlocal at
        word, at = words[at], at + 1
        if word in _PLAIN:
            return _PLAIN[word]
        at += 1  # <
        if word == "array":
            inner = one()
            at += 1  # >
            return pa.list_(inner)
        if word != "struct":
            raise ValueError(f"unknown type {word}")
        fields = []
        while True:
            name, at = words[at], at + 2  # name and :
            fields.append(pa.field(name, one()))
            end, at = words[at], at + 1
            if end == ">":
                return pa.struct(fields)

    return one()
