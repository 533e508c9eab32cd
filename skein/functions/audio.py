"""WAV pieces: merging in order and repair of the header, in built-in binary expressions.

The header is the first 44 bytes of the first piece; bytes 4 to 7 hold the length less 8 and bytes 40 to 43 the length
less 44, in little-endian order. An empty list or a result of less than 44 bytes is an error, given as null together
with ``problem``.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER = 44


def little_endian(number: Column) -> Column:
    """Four bytes of an unsigned number, the lowest first."""
    big = F.unhex(F.lpad(F.hex(number.cast("long")), 8, "0"))
    return F.concat(*(F.substring(big, place, 1) for place in (4, 3, 2, 1)))


def with_lengths(wav: Column) -> Column:
    """``wav`` with both lengths of its header put right; null if it is shorter than a header."""
    size = F.octet_length(wav)
    fixed = F.concat(F.substring(wav, 1, 4), little_endian(size - 8), F.substring(wav, 9, 32), little_endian(size - HEADER), F.substring(wav, HEADER + 1, 2**31 - 1))
    return F.when(size >= HEADER, fixed)


def merge(pieces: Column) -> Column:
    """One WAV of an array of WAVs in order; pieces of no more than a header add nothing."""
    # joined as hexadecimal text in one go: adding piece after piece would copy the audio once per piece
    body = F.unhex(F.array_join(F.transform(pieces, lambda piece: F.hex(F.substring(piece, HEADER + 1, 2**31 - 1))), ""))
    first = F.element_at(pieces, 1)
    joined = F.when(F.size(pieces) == 1, first).otherwise(F.concat(F.substring(first, 1, HEADER), body))
    return F.when(F.size(pieces) > 0, with_lengths(joined))


def problem(pieces: Column) -> Column:
    """Why ``merge`` gives null, or null."""
    return F.when(F.coalesce(F.size(pieces), F.lit(0)) <= 0, "no audio pieces").when(merge(pieces).isNull(), "shorter than a WAV header")


def merged(pieces: Sequence[bytes | None]) -> bytes:
    """``merge`` for one list outside of expressions; what gives null there is a ``ValueError``."""
    if not pieces:
        raise ValueError("no audio pieces")
    if any(x is None for x in pieces):
        raise ValueError("an audio piece is missing")
    whole = bytearray(pieces[0] if len(pieces) == 1 else b"".join((pieces[0][:HEADER], *(x[HEADER:] for x in pieces))))
    if len(whole) < HEADER:
        raise ValueError("shorter than a WAV header")
    struct.pack_into("<I", whole, 4, len(whole) - 8)
    struct.pack_into("<I", whole, 40, len(whole) - HEADER)
    return bytes(whole)
