"""Assembling JSON text from columns without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def non_empty(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def json_object(fields: list[tuple[str, Column]]) -> Column:
    """JSON object of the non-null fields, in the given order."""
    if not fields:
        return F.lit("{}")
    return F.to_json(F.struct(*[c.alias(name) for name, c in fields]))


def _inner(text: Column) -> Column:
    """What stands between the braces of an object; a pattern names the text, which may be costly, only once."""
    return F.regexp_extract(text, r"(?s)^\{(.*)\}$", 1)


def _joined(*inners: Column) -> Column:
    """Object of the members in several texts without braces; NULL and empty ones add nothing."""
    return F.concat(F.lit("{"), F.array_join(F.array_remove(F.array(*inners), ""), ","), F.lit("}"))


def merge_json(base: Column, extra: Column) -> Column:
    """Members of two JSON objects without a common name in one; NULL counts as an empty object."""
    return _joined(_inner(base), _inner(extra))


def json_text(value: Column) -> Column:
    """JSON text of one value; NULL stays NULL."""
    listed = F.to_json(F.array(value))
    return F.when(value.isNotNull(), F.substring(listed, F.lit(2), F.length(listed) - 2))


class Members:
    """Members of one JSON object in the making: of equal names the later value wins, where it is not NULL."""

    def __init__(self, fields: list[tuple[str, Column]] = ()):
        self.values: dict[str, tuple[Column, bool]] = {}
        for name, value in fields:
            self.put(name, value)

    def put(self, name: str, value: Column, is_json: bool = False) -> None:
        """Sets a member; with ``is_json`` its value is JSON text already."""
        if name in self.values:
            old, old_json = self.values[name]
            if is_json != old_json:
                old, value = (old if old_json else json_text(old)), (value if is_json else json_text(value))
            value, is_json = F.coalesce(value, old), is_json or old_json
        self.values[name] = value, is_json

    def json(self) -> Column:
        """The object, written once."""
        text = json_object([(n, value) for n, (value, is_json) in self.values.items() if not is_json])
        raw = [raw_inner(name, value) for name, (value, is_json) in self.values.items() if is_json]
        return _joined(_inner(text), *raw) if raw else text


def last_members(text: Column) -> Column:
    """JSON object text in which every name stands once, with its last value; NULL if it is not an object."""
    def of_entries(entries: Column) -> Column:
        later = lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"])
        return F.map_from_entries(F.filter(entries, later))

    # A one-element list binds the entries, which the filter names for each of them, to one reading of the text.
    entries = F.map_entries(F.from_json(text, "map<string,variant>"))
    return F.to_json(F.get(F.transform(F.array(entries), of_entries), 0))


def overwrite_json(base: Column, fields: list[tuple[str, Column]]) -> Column:
    """Object text with further members, which replace those of the same name; NULL values change nothing."""
    given, taken = F.lit(False), lambda k: F.lit(False)
    # Names are unlikely to be there, and parsing is for texts that might have one.
    maybe = F.lit(False)
    for name, value in fields:
        given = given | value.isNotNull()
        taken = lambda k, name=name, value=value, before=taken: before(k) | ((k == name) & value.isNotNull())
        maybe = maybe | (value.isNotNull() & F.contains(base, json_text(F.lit(name))))
    old = F.from_json(base, "map<string,variant>")
    rest = F.to_json(F.map_filter(old, lambda k, _: ~taken(k)))
    kept = F.when(maybe, _inner(rest)).otherwise(F.substring(base, F.lit(2), F.length(base) - 2))
    return F.when(given, _joined(kept, _inner(json_object(fields)))).otherwise(F.coalesce(base, F.lit("{}")))


def raw_inner(name: str, json: Column) -> Column:
    """One member whose value is JSON text already, without braces; NULL when it is absent."""
    return F.concat(F.lit('"' + name + '":'), json)


def raw_member(name: str, json: Column) -> Column:
    """Object with one member whose value is JSON text already; NULL when it is absent."""
    return F.concat(F.lit("{"), raw_inner(name, json), F.lit("}"))
