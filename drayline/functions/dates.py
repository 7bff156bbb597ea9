"""Date conversion of a cell."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayline.functions.rules import Cell
from drayline.functions.text import as_text, strip

# Default formats, output names, and the formats tried when the
# given one does not fit.
DEFAULT_SOURCE = "YYYY-MM-DD HH:mm:ss"
DEFAULT_TARGET = "ISO 8601"
UNIX = "UNIX"
DATE_ONLY = "YYYY-MM-DD"
FALLBACK_PATTERNS = (
    "yyyy-M-d H:m:s",
    "yyyy-M-d H:m:s.SSSSSS",
    "yyyy-M-d",
    "yyyy-M-d'T'H:m:s",
)
# Fractions of any length and zones, after a blank or a T.
ZONED_PATTERNS = tuple(
    f"yyyy-M-d{gap}H:m:s[.SSSSSSSSS][.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]{zone}"
    for gap in (" ", "'T'")
    for zone in ("", "XXX", "XX", "X", " XXX")
)

# User token or percent directive -> field letter and full width.
_FIELDS = {
    "YYYY": ("y", 4), "yyyy": ("y", 4), "MM": ("M", 2), "DD": ("d", 2), "dd": ("d", 2),
    "HH": ("H", 2), "hh": ("H", 2), "mm": ("m", 2), "SS": ("s", 2), "ss": ("s", 2),
    "%Y": ("y", 4), "%m": ("M", 2), "%d": ("d", 2), "%H": ("H", 2), "%M": ("m", 2),
    "%S": ("s", 2), "%f": ("S", 6),
}
_TOKEN = re.compile("|".join(re.escape(t) for t in _FIELDS))


def spark_pattern(user_format: str) -> str:
    """Spark pattern for a format such as ``DD/MM/YYYY HH:mm``.

    Tokens are case-sensitive, so month and minute stay apart. A field next
    to another field has a fixed width (``yyyyMMdd``); one between separators
    takes one or two digits.
    """
    fmt = user_format.strip()
    found = list(_TOKEN.finditer(fmt))
    out = []
    position = 0
    for i, match in enumerate(found):
        out.append(_literal(fmt[position : match.start()]))
        letter, width = _FIELDS[match.group()]
        touches = (i > 0 and found[i - 1].end() == match.start()) or (
            i + 1 < len(found) and found[i + 1].start() == match.end()
        )
        out.append(letter * (width if touches or width != 2 else 1))
        position = match.end()
    out.append(_literal(fmt[position:]))
    return "".join(out)


def _literal(text: str) -> str:
    """Separators as they are, letters and pattern signs in quotes."""
    return re.sub(r"[A-Za-z\[\]{}#']+", lambda m: "'" + m.group().replace("'", "''") + "'", text)


def parse_date(text: Column, user_format: str) -> Column:
    """Timestamp read with the given format or a fallback; NULL if none fits the whole text."""
    patterns = dict.fromkeys((spark_pattern(user_format), *FALLBACK_PATTERNS, *ZONED_PATTERNS))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in patterns])


def convert_date(
    cell: Cell,
    source_format: str = DEFAULT_SOURCE,
    target_format: str = DEFAULT_TARGET,
) -> Cell:
    """Parse a cell and write it in the target form.

    Blank text becomes NULL. Text that no format fits stays as it is where
    the result is text, and is a fault where the result is a number (UNIX).
    """
    zoned = isinstance(cell.dtype, T.TimestampType)
    if isinstance(cell.dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        original = None
        moment = cell.value.cast("timestamp")
    else:
        raw = as_text(cell.value, cell.dtype)
        original = F.when(strip(raw) != "", raw)
        moment = parse_date(strip(raw), source_format)

    if target_format == UNIX:
        # Values without a zone count as UTC, whatever zone the session has.
        # unix_seconds rounds down, also before 1970.
        utc = moment if zoned else F.from_utc_timestamp(moment, F.current_timezone())
        seconds = F.unix_seconds(utc)
        if original is None:
            return cell.to(seconds, T.LongType())
        return cell.convert("date", original, seconds, T.LongType())

    if target_format == DATE_ONLY:
        text = F.date_format(moment, "yyyy-MM-dd")
    elif target_format == DEFAULT_TARGET:
        ending = "Z" if zoned else "'Z'"
        text = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss" + ending)
    else:
        micros = F.date_format(moment, "SSSSSS")
        text = F.concat(
            F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"),
            F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""),
            F.date_format(moment, "xxx") if zoned else F.lit(""),
        )
    if original is not None:
        text = F.coalesce(text, original)
    return cell.to(text, T.StringType())
