"""Decoding of whole JSON documents held in strings."""

from __future__ import annotations

import json
from typing import Any

#: Marks a text that is not one complete JSON document.
BROKEN = object()


def _no_constant(name: str) -> Any:
    raise ValueError(f"{name} is not JSON")


_decode = json.JSONDecoder(parse_constant=_no_constant).decode


def decode(text: str | None) -> Any:
    """The value of a JSON text, or ``BROKEN`` for null, blank, cut off or otherwise incomplete text.

    A document that is wholly a JSON string holding JSON text counts as that JSON, however often it was wrapped;
    strings further inside stay strings. Documents nested too deep for the decoder count as broken.
    """
    try:
        value = _decode(text)
        while type(value) is str:
            value = _decode(value)
    except (ValueError, TypeError, RecursionError):
        return BROKEN
    return value


def clean(text: str) -> str:
    """``text`` without lone surrogates, which JSON escapes can produce and UTF-8 cannot hold."""
    try:
        text.encode()
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text
