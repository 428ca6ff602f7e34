"""Reading the change text of an audit event. Malformed text reads as no change."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHANGES = "changed_fields"


def keys(c: str = CHANGES) -> Column:
    """Changed field names in written order; null when the text is not a JSON object."""
    return F.json_object_keys(c)


def field(name: str, c: str = CHANGES) -> Column:
    return F.get_json_object(c, f"$.{name}")


def action(c: str = CHANGES) -> Column:
    """Custom action without its application prefix: ``app_print`` reads as ``print``."""
    return F.regexp_replace(field("action", c), "^[a-z]+_(?=[a-z]+$)", "")


def values(name: str, c: str = CHANGES) -> Column:
    return F.from_json(field(name, c), "array<string>")


def status_list(c: str = CHANGES) -> Column:
    return values("status", c)


def print_mode(c: str = CHANGES) -> Column:
    return F.get(values("print_mode", c), F.lit(0))


def is_edit(c: str = CHANGES) -> Column:
    """A parsable, non-empty change that is more than the update time."""
    k = F.coalesce(keys(c), F.array().cast("array<string>"))
    return (F.size(k) > 0) & (F.size(F.array_except(k, F.array(F.lit("updated")))) > 0)
