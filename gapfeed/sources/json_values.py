"""Values inside JSON documents with their types, as column expressions over variants; odd input yields null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Json:
    """A parsed document (null: no JSON). Paths are dotted names below its root."""

    def __init__(self, value: Column) -> None:
        self.value = value

    def at(self, path: str) -> Column:
        return F.try_variant_get(self.value, "$." + path, "variant")

    def kind(self, path: str) -> Column:
        """STRING, BIGINT, BOOLEAN, VOID, ARRAY<..>, OBJECT<..>, ..; null if there is no such value."""
        return F.schema_of_variant(self.at(path))

    def text(self, path: str) -> Column:
        """The value if it is a string, else null."""
        return F.when(self.kind(path) == "STRING", self.shown(path))

    def shown(self, path: str) -> Column:
        """The value as text, arrays and objects as JSON; null for JSON's null."""
        return F.try_variant_get(self.value, "$." + path, "string")

    def printed(self, path: str) -> Column:
        """As `shown`, with words for what is missing or null."""
        return F.when(self.kind(path).isNull(), "undefined").when(self.kind(path) == "VOID", "null").otherwise(self.shown(path))

    def truthy(self, path: str) -> Column:
        """Present and none of null, false, 0 and the empty string."""
        return is_truthy(self.at(path))

    def shown_or(self, path: str, default: Column | str) -> Column:
        other = F.lit(default) if isinstance(default, str) else default
        return F.when(self.truthy(path), self.shown(path)).otherwise(other)

    def is_list(self, path: str) -> Column:
        return F.coalesce(F.startswith(self.kind(path), F.lit("ARRAY")), F.lit(False))

    def is_object(self, path: str | None = None) -> Column:
        kind = F.schema_of_variant(self.value) if path is None else self.kind(path)
        return F.coalesce(F.startswith(kind, F.lit("OBJECT")), F.lit(False))

    def texts(self, path: str) -> Column:
        """The elements of a list as texts; empty for anything else."""
        return F.coalesce(F.when(self.is_list(path), F.try_variant_get(self.value, "$." + path, "array<string>")), F.array().cast("array<string>"))

    def items(self, path: str) -> Column:
        """The elements of a list as variants; empty for anything else."""
        return F.coalesce(F.try_variant_get(self.value, "$." + path, "array<variant>"), F.array().cast("array<variant>"))

    def equals(self, path: str, number: int) -> Column:
        """Whether the value is this number, not a text of it."""
        numeric = ~self.kind(path).isin("STRING", "BOOLEAN", "VOID")
        return F.coalesce(numeric & (F.try_variant_get(self.value, "$." + path, "double") == number), F.lit(False))

    def same(self, path: str, other: str) -> Column:
        """Whether two values are of one type and equal; two missing ones are."""
        return self.kind(path).eqNullSafe(self.kind(other)) & self.shown(path).eqNullSafe(self.shown(other))

    def same_as(self, path: str, other: Json) -> Column:
        """Whether another document has an equal value at this path."""
        return self.kind(path).eqNullSafe(other.kind(path)) & self.shown(path).eqNullSafe(other.shown(path))

    def has_key(self, key: str) -> Column:
        """Whether an object at any depth has this key.

        Written out without white space, a key follows `{` or `,`; in a string the quote between would be escaped.
        """
        written = F.to_json(self.value)
        return F.coalesce(F.contains(written, F.lit(f'{{"{key}":')) | F.contains(written, F.lit(f',"{key}":')), F.lit(False))


def is_truthy(value: Column) -> Column:
    kind, shown = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    empty = F.when(kind == "STRING", shown == "").otherwise((kind == "VOID") | shown.isin("0", "0.0", "false"))
    return value.isNotNull() & ~F.coalesce(empty, F.lit(False))
