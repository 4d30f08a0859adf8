"""Column functions shared by the operators; all of them stay in the JVM."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibliospark.schemas import PAPER_COLS

# Together these strip what Python's str.strip() strips. Spark's
# own trim() removes spaces only, and (?U)\s leaves out 0x1c to 0x1f.
STRIP_L = r"(?U)^[\s\x1c-\x1f]+"
STRIP_R = r"(?U)[\s\x1c-\x1f]+\z"


def normalize_name(name: Column) -> Column:
    """Lower-case a name, then strip white space at both ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), STRIP_L, ""), STRIP_R, "")


def name_key(name: Column, given: Column | None = None) -> Column:
    """The normalised name: the given one if it is not empty, else one made from ``name``."""
    if given is None:
        return normalize_name(name)
    return F.when(F.length(given) > 0, given).otherwise(normalize_name(name))


def array_to_json(values: Column) -> Column:
    return F.to_json(values)


def json_to_array(text: Column, element: str) -> Column:
    """Decode a JSON array; NULL and empty text give an empty array.

    Malformed text gives NULL, see :func:`is_malformed_json`.
    """
    empty = F.array().cast(f"array<{element}>")
    return F.when(text.isNull() | (text == ""), empty).otherwise(_strict_array(text, element))


def _strict_array(text: Column, element: str) -> Column:
    """The JSON array that ``text`` is as a whole, else NULL.

    It is put between two fields of an object. A text that ends before the
    array or goes on after it closes the object too early, leaves it open or
    gives it other fields than these two.
    """
    wrapped = F.concat(F.lit('{"v":'), text, F.lit(',"end":0}'))
    parsed = F.from_json(wrapped, f"v array<{element}>", {"allowSingleQuotes": "false"})
    whole = F.json_object_keys(wrapped) == F.array(F.lit("v"), F.lit("end"))
    return F.when(whole & F.rtrim(F.translate(text, "\t\n\r", "   ")).endswith("]"), parsed["v"])


def is_malformed_json(text: Column, element: str) -> Column:
    """True for text that is neither empty, nor a JSON array, nor JSON ``null``."""
    decoded = _strict_array(text, element)
    return F.coalesce((text != "") & decoded.isNull() & (F.trim(text) != "null"), F.lit(False))


def batch_time(now: datetime | None = None) -> Column:
    """One UTC time stamp for a whole batch, to the second and without a zone.

    It is fixed when the plan is made, so recomputed rows get the same one.
    """
    at = datetime.now(timezone.utc) if now is None else now
    return F.lit(at.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def element_positions(df: DataFrame, column: str, element: str) -> DataFrame:
    """One row per array element with its 1-based ``position``."""
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.posexplode(column).alias("_at", element)).select(
        *others, (F.col("_at") + 1).alias("position"), element
    )


def paper_columns(df: DataFrame) -> DataFrame:
    """The stored columns of a paper, in table order."""
    return df.select(*PAPER_COLS)
