"""Content hash and the base64 storage encoding (all JVM-side expressions).

Commands are byte strings: a cast to binary keeps every byte, where ``encode`` /
``decode`` as UTF-8 would replace or reject bytes that form no UTF-8.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def raw_bytes(text: Column | str) -> Column:
    """The bytes of a string, unchanged."""
    return (F.col(text) if isinstance(text, str) else text).cast("binary")


def byte_view(text: Column | str) -> Column:
    """One Latin-1 character per byte, so character functions count bytes."""
    return F.decode(raw_bytes(text), "ISO-8859-1")


def command_hash(cmd: Column | str) -> Column:
    """Lower-hex SHA-256 of the bytes of ``cmd`` (64 characters)."""
    return F.sha2(raw_bytes(cmd), 256)


def b64_encode(text: Column | str) -> Column:
    """Standard padded base64 of the bytes (needs chunking disabled)."""
    return F.base64(raw_bytes(text))


def b64_decode(b64: Column | str) -> Column:
    """Decode standard base64 to text; NULL when the input is not valid base64."""
    return F.try_to_binary(b64, F.lit("base64")).cast("string")
