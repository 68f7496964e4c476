"""Column expressions over values: types, percentages, sizes, versions.

(O-34 value_type, O-35 pct, O-38 format_bytes, O-42 extract_version.)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size units, 1024 apart; the last one absorbs larger sizes.
BYTE_UNITS = ("B", "KB", "MB", "GB", "TB")
NUMERIC_VARIANT_TYPES = ("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT",
                         "DOUBLE", "DECIMAL")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def value_type(value) -> Column:
    """Type name of one VARIANT value (O-34).

    ``null`` / ``array`` / ``object`` / ``date`` / ``boolean`` / ``string``;
    numbers are ``number`` when integer-valued (``10.0`` included) and
    ``double`` otherwise; anything else is ``unknown``.
    """
    v = _col(value)
    schema = F.schema_of_variant(v)
    head = F.regexp_extract(schema, r"^([A-Z_]+)", 1)
    # Decimals first: a long one loses its fraction as a double.
    whole = F.coalesce(F.try_variant_get(v, "$", "decimal(38,18)") % 1 == 0,
                       F.try_variant_get(v, "$", "double") % 1 == 0)
    return (F.when(v.isNull() | (schema == "VOID"), F.lit("null"))
            .when(head == "OBJECT", F.lit("object"))
            .when(head == "ARRAY", F.lit("array"))
            .when(head == "BOOLEAN", F.lit("boolean"))
            .when(head == "STRING", F.lit("string"))
            .when(head.isin("DATE", "TIMESTAMP", "TIMESTAMP_NTZ"), F.lit("date"))
            .when(head.isin(*NUMERIC_VARIANT_TYPES),
                  F.when(whole, F.lit("number")).otherwise(F.lit("double")))
            .otherwise(F.lit("unknown")))


def pct(n, d) -> Column:
    """Rounded percentage ``round(100 * n / d)``, halves up, as int (O-35)."""
    return F.floor(_col(n) / _col(d) * 100 + 0.5).cast("int")


def _trim_decimals(text: Column) -> Column:
    """``"1.50"`` -> ``"1.5"``, ``"2.00"`` -> ``"2"``."""
    return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+\z", "$1"),
                            r"\.\z", "")


def format_bytes(n) -> Column:
    """Human size: ``0 B``, then B..TB in steps of 1024, up to 2 decimals (O-38).

    The unit is chosen by comparisons, not logarithms, so exact powers of 1024
    land on the larger unit. Null stays null.
    """
    b = _col(n).cast("double")
    exponent = (F.when(b >= 1024.0 ** 4, 4).when(b >= 1024.0 ** 3, 3)
                .when(b >= 1024.0 ** 2, 2).when(b >= 1024.0, 1).otherwise(0))
    scaled = F.floor(b / F.pow(F.lit(1024.0), exponent) * 100 + 0.5) / 100
    text = _trim_decimals(F.regexp_replace(F.format_number(scaled, 2), ",", ""))
    unit = F.element_at(F.array(*[F.lit(u) for u in BYTE_UNITS]), exponent + 1)
    return (F.when(b.isNull(), F.lit(None).cast("string"))
            .when(b == 0, F.lit("0 B"))
            .otherwise(F.concat(text, F.lit(" "), unit)))


def thousands(n) -> Column:
    """Integer with thousands separators: ``1234567`` -> ``1,234,567``."""
    return F.format_number(_col(n).cast("bigint"), 0)


def extract_version(text, pattern: str = r"redis_version:([^\r\n]+)",
                    label: str = "Redis") -> Column:
    """Version text from a server info dump (O-42): ``Redis 7.2.4`` or null."""
    found = F.regexp_extract(_col(text), pattern, 1)
    return F.when(found != "", F.concat(F.lit(label + " "), found))
