"""Lists of byte strings that travel as base64 in JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BASE64 = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"


def decode_list(items: Column) -> Column:
    """Each base64 item as text; an item that is not padded base64 stays as it is."""

    def decode(item: Column) -> Column:
        text = F.try_to_binary(item, F.lit("base64")).cast("string")
        return F.when(item.rlike(_BASE64), F.coalesce(text, item)).otherwise(item)

    return F.transform(items, decode)


def text_list(items: Column, encoding: str) -> Column:
    """Decoded list, empty when unset. ``encoding`` is ``base64`` or ``text``."""
    decoded = decode_list(items) if encoding == "base64" else items
    return F.coalesce(decoded, F.array().cast("array<string>"))
