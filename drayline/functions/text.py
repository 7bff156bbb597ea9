"""Value-to-text and text-to-number conversion shared by all cell rules.

Text follows the spelling a Python ``str()`` of the value would have, because
hashes, comparisons and cut lengths of cells are defined on that text. All of
it is built-in expressions, so it stays inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters that count as blank (Unicode white space plus
# the four ASCII separators).
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "
    "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Texts that read as whole and as general numbers. Single underscores between
# digits are allowed; hexadecimal and suffixed Java forms ("1d") are not.
WHOLE_NUMBER = r"^[+-]?[0-9]+(_[0-9]+)*$"
ANY_NUMBER = (
    r"(?i)^[+-]?((([0-9]+(_[0-9]+)*)(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)"
    r"(e[+-]?[0-9]+(_[0-9]+)*)?|nan|inf|infinity)$"
)


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def strip_column(name: str) -> Column:
    """``strip`` of a plain column, skipped for cells with no blank at either end."""
    text = F.col(f"`{name}`")
    clean = F.substring(text, 1, 1).between("!", "~") & F.right(text, F.lit(1)).between("!", "~")
    return F.when(clean, text).otherwise(strip(text))


def double_text(value: Column) -> Column:
    """Shortest decimal text of a double: plain from 1e-4 up to 1e16."""
    spark_text = value.cast("string")
    size = F.abs(value)
    digits = F.rtrim(spark_text.try_cast("decimal(38,22)").cast("string"), F.lit("0"))
    plain = F.when(F.endswith(digits, F.lit(".")), F.concat(digits, F.lit("0"))).otherwise(digits)
    mantissa = F.regexp_replace(F.substring_index(spark_text, "E", 1), r"\.0$", "")
    power = F.substring_index(spark_text, "E", -1).try_cast("int")
    power_text = F.concat(
        F.when(power < 0, "-").otherwise("+"),
        F.when(F.abs(power) < 10, "0").otherwise(""),
        F.abs(power).cast("string"),
    )
    return (
        F.when(F.isnan(value), "nan")
        .when(size == float("inf"), F.when(value > 0, "inf").otherwise("-inf"))
        .when((size == 0) | ((size >= 1e-3) & (size < 1e7)), spark_text)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(F.concat(mantissa, F.lit("e"), power_text))
    )


def timestamp_text(value: Column, zoned: bool) -> Column:
    whole = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    micros = F.date_format(value, "SSSSSS")
    parts = [whole, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise("")]
    if zoned:
        parts.append(F.date_format(value, "xxx"))
    return F.concat(*parts)


def as_text(value: Column, dtype: T.DataType) -> Column:
    """Text of a cell of any type; NULL stays NULL."""
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return value
    if isinstance(dtype, T.BooleanType):
        return F.when(value, "True").when(~value, "False")
    if isinstance(dtype, T.FloatType):
        # The short text of a 32-bit float, not that of its widened value.
        return double_text(value.cast("string").cast("double"))
    if isinstance(dtype, T.DoubleType):
        return double_text(value)
    if isinstance(dtype, T.TimestampType):
        return timestamp_text(value, zoned=True)
    if isinstance(dtype, T.TimestampNTZType):
        return timestamp_text(value, zoned=False)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(value)
    return value.cast("string")


def text_to_double(text: Column) -> Column:
    """Number in a text, or NULL when the text is not a number.

    Plain digits go straight to the cast; only texts with other signs pay for
    stripping and the full pattern.
    """
    s = strip(text)
    unusual = F.when(s.rlike(ANY_NUMBER), F.replace(s, F.lit("_"), F.lit("")).try_cast("double"))
    return F.when(text.rlike("[^0-9.+-]"), unusual).otherwise(text.try_cast("double"))


def text_to_bigint(text: Column) -> Column:
    s = strip(text)
    unusual = F.when(s.rlike(WHOLE_NUMBER), F.replace(s, F.lit("_"), F.lit("")).try_cast("bigint"))
    return F.when(text.rlike("[^0-9+-]"), unusual).otherwise(text.try_cast("bigint"))
