"""Encryption of stored keys: AES-256 in GCM mode with a marked prefix, all in built-in expressions; and of keys inside JSON.

Already encrypted and blank values pass unchanged, so encryption may be repeated; null stays null.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import is_blank

#: Mark of an encrypted value (fixed value).
PREFIX = "enc:v1:"


def _key(secret: str) -> Column:
    return F.unhex(F.sha2(F.lit(secret), 256))


def is_encrypted(value: Column) -> Column:
    return F.coalesce(value.startswith(PREFIX), F.lit(False))


def encrypt(value: Column, secret: str) -> Column:
    """Prefix and base64 of nonce, ciphertext and tag; the nonce is random, so equal values differ."""
    hidden = F.concat(F.lit(PREFIX), F.base64(F.aes_encrypt(value, _key(secret), F.lit("GCM"))))
    return F.when(is_encrypted(value) | is_blank(value), value).otherwise(hidden)


def decrypt(value: Column, secret: str) -> Column:
    """The plain value; values without the prefix pass unchanged."""
    plain = F.aes_decrypt(F.unbase64(F.substring(value, len(PREFIX) + 1, 2**31 - 1)), _key(secret), F.lit("GCM")).cast("string")
    return F.when(is_encrypted(value), plain).otherwise(value)


def mask(value: Column, visible: Column) -> Column:
    """``value`` where ``visible``, else ''."""
    return F.when(visible, value).otherwise("")


def _walk(node: Any, field: str, change: Callable[[str], str]) -> Any:
    """``node`` with every non-blank string under ``field``, at any depth, changed; in the order of the document."""
    if isinstance(node, dict):
        return {key: change(value) if key == field and isinstance(value, str) and value.strip() else _walk(value, field, change) for key, value in node.items()}
    return [_walk(value, field, change) for value in node] if isinstance(node, list) else node


def _rewritten(body: str | None, field: str, change: Callable[[str], str]) -> str | None:
    if body is None or field not in body:
        return body
    try:
        return json.dumps(_walk(json.loads(body), field, change), ensure_ascii=False, separators=(",", ":"))
    except (ValueError, RecursionError):
        return body


def replace_in_json(text: Column, field: str = "apiKey", put: str = "***") -> Column:
    """JSON text with every non-blank string under ``field``, at any depth, replaced; what cannot be parsed passes unchanged.

    Spark has no deep rewrite of JSON, so this is an Arrow function; texts that do not mention the field are not parsed.
    """

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda body: _rewritten(body, field, lambda _: put))

    return run(text)


def _change_in_json(text: Column, field: str, change: Callable[[Column], Column]) -> Column:
    """The strings under ``field`` taken out, changed by a column expression, and put back in their order."""

    @F.pandas_udf("array<string>")
    def take(texts: pd.Series) -> pd.Series:
        def one(body: str | None) -> list[str]:
            held: list[str] = []
            _rewritten(body, field, lambda value: held.append(value) or value)
            return held

        return texts.map(one)

    @F.pandas_udf("string")
    def put(texts: pd.Series, values: pd.Series) -> pd.Series:
        def one(body: str | None, held: Any) -> str | None:
            left = iter(() if held is None else held)
            return _rewritten(body, field, lambda value: next(left, value))

        return pd.Series([one(body, held) for body, held in zip(texts, values, strict=True)], dtype=object)

    return put(text, F.transform(take(text), change))


def encrypt_in_json(text: Column, secret: str, field: str = "apiKey") -> Column:
    """JSON text with every key encrypted; encrypted ones, blank ones and texts that cannot be parsed pass unchanged."""
    return _change_in_json(text, field, lambda value: encrypt(value, secret))


def decrypt_in_json(text: Column, secret: str, field: str = "apiKey") -> Column:
    """JSON text with every encrypted key in plain; others pass unchanged."""
    return _change_in_json(text, field, lambda value: decrypt(value, secret))
