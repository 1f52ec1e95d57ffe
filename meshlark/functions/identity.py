"""Keys as strings."""

from __future__ import annotations

import base64
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\u001f"


def project_id(*keys: Column | str) -> Column:
    """An object's id: a single key as text, several ones as ``V<length>:<text>`` or ``N``, joined.

    Lengths count code points. Different keys never give the same id; a single null key
    gives null.
    """
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    if len(cols) == 1:
        return cols[0].cast("string")
    part = lambda c: F.when(c.isNull(), "N").otherwise(F.concat(F.lit("V"), F.length(c.cast("string")), F.lit(":"), c.cast("string")))
    return F.concat_ws(SEPARATOR, *map(part, cols))


def row_id(*columns: str) -> Column:
    """A hash of whole rows, for tables without a key."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def valid_identity(value: Column) -> Column:
    """Not blank, and printable ASCII only."""
    return F.coalesce(value.rlike(r"^[\x20-\x7E]+$") & (F.trim(value) != ""), F.lit(False))


def encode_cursor(object_type: str, object_id: str, link: str, direction: str, offset: int) -> str:
    """An opaque token for the next page."""
    return base64.b64encode("|".join([object_type, object_id, link, direction, str(offset)]).encode()).decode()


def decode_cursor(cursor: str | None, object_type: str, object_id: str, link: str, direction: str) -> int:
    """The offset in a token of the same question; 0 for any other token."""
    try:
        parts = base64.b64decode(cursor or "", validate=True).decode().rsplit("|", 4)
    except ValueError:
        return 0
    same = parts[:4] == [object_type, object_id, link, direction]
    return int(parts[4]) if same and len(parts) == 5 and parts[4].isdigit() else 0


def snake_case(name: str) -> str:
    """``HTTPServerName`` -> ``http_server_name``."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


def short_identifier(name: str, limit: int = 63) -> str:
    """The name, or a prefix with 8 hex digits of its hash if it is longer than ``limit`` bytes."""
    import hashlib

    raw = name.encode()
    if len(raw) <= limit:
        return name
    return raw[: limit - 9].decode(errors="ignore") + "_" + hashlib.sha256(raw).hexdigest()[:8]
