"""Cell cleaning rules and their chains.

A chain is compiled once into one Column. A rule sees the cell so far (its
expression and type) and returns the next cell; no rule needs a Python UDF.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayline.functions.text import BLANKS, as_text, strip, text_to_double

# Texts that read as true, the mask texts, the tag pattern and
# the default cut length.
TRUE_WORDS = ["1", "true", "t", "yes", "y", "on"]
REDACTED = "[REDACTED]"
CARD_MASK = "****-****-****-"
MASK = "***"
TAG_PATTERN = "<[^>]+>"
DEFAULT_LENGTH = 255


class RuleError(ValueError):
    """A rule text that cannot be compiled."""


@dataclass(frozen=True)
class Fault:
    """Condition under which a rule could not handle the cell, and the cell."""

    rule: str
    when: Column
    value: Column


class Stages:
    """Columns that are computed before the final projection.

    A converted value is used for the result and for its fault. As a column of
    an earlier projection it is computed once. Level n may use level n - 1.
    """

    def __init__(self) -> None:
        self.levels: list[dict[str, Column]] = []

    def add(self, level: int, value: Column) -> Column:
        while len(self.levels) <= level:
            self.levels.append({})
        name = f"_stage_{sum(map(len, self.levels))}"
        self.levels[level][name] = value
        return F.col(name)


@dataclass(frozen=True)
class Cell:
    """A cell on its way: expression and type, and what to do on a bad value.

    With ``stages`` a bad value becomes NULL and a fault is noted; without
    them it raises an error that names the column.
    """

    value: Column
    dtype: T.DataType
    column: str = "cell"
    stages: Stages | None = None
    level: int = 0
    faults: tuple[Fault, ...] = ()

    def text(self) -> Column:
        return as_text(self.value, self.dtype)

    def to(self, value: Column, dtype: T.DataType) -> "Cell":
        return replace(self, value=value, dtype=dtype)

    def convert(self, rule: str, source: Column, value: Column, dtype: T.DataType) -> "Cell":
        """Go on with ``value``, which is NULL where ``source`` does not fit."""
        if self.stages is None:
            # The value is computed once; the message only where it is missing.
            message = F.concat(F.lit(f"{self.column}: {rule} cannot take "), self.text())
            raised = F.when(source.isNotNull(), F.raise_error(message).cast(dtype))
            return self.to(F.coalesce(value, raised), dtype)
        value = self.stages.add(self.level, value)
        fault = Fault(rule, source.isNotNull() & value.isNull(), self.text())
        return replace(
            self, value=value, dtype=dtype, level=self.level + 1, faults=self.faults + (fault,)
        )


@dataclass(frozen=True)
class Rule:
    name: str
    category: str
    params: tuple[str, ...]
    build: Callable[[Cell, list[str]], Cell]


RULES: dict[str, Rule] = {}


def _rule(name: str, category: str, *params: str):
    def register(build):
        RULES[name] = Rule(name, category, params, build)
        return build

    return register


def _text_rule(name: str, category: str, change: Callable[[Column], Column]) -> None:
    _rule(name, category)(lambda cell, _: cell.to(change(cell.text()), T.StringType()))


# A word is a run of cased letters; everything else separates words.
_CASED = r"\p{IsLowercase}\p{IsUppercase}\p{Lt}"
_PIECES = f"([{_CASED}]+|[^{_CASED}]+)"


def title_case(text: Column) -> Column:
    def capital(piece: Column) -> Column:
        # Upper-casing one letter may give two ("ß" to "SS"); only the first
        # of them stays large.
        head = F.upper(F.substring(piece, 1, 1))
        return F.concat(
            F.substring(head, 1, 1),
            F.lower(F.substring(head, 2, 3)),
            F.lower(F.substring(piece, 2, 2147483647)),
        )

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_PIECES), F.lit(1)), capital), "")


_text_rule("uppercase", "string", F.upper)
_text_rule("lowercase", "string", F.lower)
_text_rule("titlecase", "string", title_case)
_text_rule("trim", "string", strip)
_text_rule("ltrim", "string", lambda s: F.ltrim(s, F.lit(BLANKS)))
_text_rule("rtrim", "string", lambda s: F.rtrim(s, F.lit(BLANKS)))
_text_rule("strip_html", "string", lambda s: F.regexp_replace(s, TAG_PATTERN, ""))
_text_rule("to_string", "cast", lambda s: s)


def _whole_parameter(rule: str, params: list[str], default: int) -> int:
    if not params:
        return default
    try:
        return int(params[0])
    except ValueError:
        raise RuleError(f"{rule}: {params[0]!r} is not a whole number") from None


def _factor(rule: str, params: list[str]) -> float:
    if not params:
        return 1.0
    try:
        return float(params[0])
    except ValueError:
        raise RuleError(f"{rule}: {params[0]!r} is not a number") from None


@_rule("truncate", "string", "length")
def _truncate(cell: Cell, params: list[str]) -> Cell:
    length = _whole_parameter("truncate", params, DEFAULT_LENGTH)
    text = cell.text()
    if length >= 0:
        return cell.to(F.substring(text, 1, length), T.StringType())
    # A negative length drops that many characters from the end.
    kept = F.greatest(F.char_length(text) + F.lit(length), F.lit(0))
    return cell.to(F.substr(text, F.lit(1), kept), T.StringType())


@_rule("replace", "string", "old", "new")
def _replace(cell: Cell, params: list[str]) -> Cell:
    old = params[0] if params else ""
    new = params[1] if len(params) > 1 else ""
    if not old:
        raise RuleError("replace: the text to look for is empty")
    return cell.to(F.replace(cell.text(), F.lit(old), F.lit(new)), T.StringType())


@_rule("coalesce", "null", "default_value")
def _coalesce(cell: Cell, params: list[str]) -> Cell:
    default = F.lit(params[0] if params else "")
    text = cell.text()
    missing = cell.value.isNull()
    if isinstance(cell.dtype, T.StringType):
        missing = missing | (text == "")
    return cell.to(F.when(missing, default).otherwise(text), T.StringType())


@_rule("nullif", "null", "value")
def _nullif(cell: Cell, params: list[str]) -> Cell:
    target = params[0] if params else ""
    # otherwise() keeps the cell when the comparison is false or NULL.
    kept = F.when(cell.text() == target, F.lit(None)).otherwise(cell.value)
    return cell.to(kept, cell.dtype)


@_rule("mask_email", "pii")
def _mask_email(cell: Cell, _: list[str]) -> Cell:
    text = cell.text()
    at = F.instr(text, "@")
    masked = F.concat(F.substring(text, 1, 1), F.lit(MASK), F.substr(text, at))
    return cell.to(F.when(at >= 2, masked).when(text.isNotNull(), MASK), T.StringType())


@_rule("mask_credit_card", "pii")
def _mask_card(cell: Cell, _: list[str]) -> Cell:
    digits = F.regexp_replace(cell.text(), r"(?U)\D", "")
    return cell.to(F.concat(F.lit(CARD_MASK), F.right(digits, F.lit(4))), T.StringType())


@_rule("hash", "pii", "algorithm")
def _hash(cell: Cell, params: list[str]) -> Cell:
    algorithm = params[0].strip().lower() if params else "sha256"
    if algorithm not in ("sha256", "md5"):
        raise RuleError(f"hash: unknown algorithm {algorithm!r}")
    text = cell.text()
    return cell.to(F.md5(text) if algorithm == "md5" else F.sha2(text, 256), T.StringType())


@_rule("redact", "pii")
def _redact(cell: Cell, _: list[str]) -> Cell:
    return cell.to(F.when(cell.value.isNotNull(), REDACTED), T.StringType())


def _number(cell: Cell, rule: str) -> Cell:
    """The cell as a double."""
    if isinstance(cell.dtype, (T.NumericType, T.BooleanType)):
        return cell.to(cell.value.cast("double"), T.DoubleType())
    text = cell.text()
    return cell.convert(rule, text, text_to_double(text), T.DoubleType())


def round_half_even(value: Column, places: int) -> Column:
    """Round the exact binary value, ties to even.

    ``round`` and ``bround`` work on the printed decimal, so 2.675 would
    become 2.68 although the stored value lies below the tie.
    ``format_number`` rounds the stored value.
    """
    if places < 0:
        return F.bround(value, places)
    pattern = "0." + "0" * places if places else "0"
    odd = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(odd, value).otherwise(
        F.call_function("format_number", value, F.lit(pattern)).try_cast("double")
    )


@_rule("round", "numeric", "decimals")
def _round(cell: Cell, params: list[str]) -> Cell:
    places = _whole_parameter("round", params, 0)
    cell = _number(cell, "round")
    return cell.to(round_half_even(cell.value, places), T.DoubleType())


@_rule("multiply", "numeric", "factor")
def _multiply(cell: Cell, params: list[str]) -> Cell:
    factor = _factor("multiply", params)
    cell = _number(cell, "multiply")
    return cell.to(cell.value * F.lit(factor), T.DoubleType())


@_rule("divide", "numeric", "factor")
def _divide(cell: Cell, params: list[str]) -> Cell:
    divisor = _factor("divide", params)
    cell = _number(cell, "divide")
    return cell.to(F.try_divide(cell.value, F.lit(divisor)), T.DoubleType())


@_rule("abs", "numeric")
def _abs(cell: Cell, _: list[str]) -> Cell:
    cell = _number(cell, "abs")
    return cell.to(F.abs(cell.value), T.DoubleType())


@_rule("to_boolean", "cast")
def _to_boolean(cell: Cell, _: list[str]) -> Cell:
    return cell.to(F.lower(strip(cell.text())).isin(TRUE_WORDS), T.BooleanType())


Chain = str | Sequence[Sequence[str] | str]


def parse_chain(chain: Chain) -> list[tuple[str, list[str]]]:
    """Rule names and parameters of a chain.

    A text chain reads ``trim|lowercase|truncate:100``; names ignore case and
    empty rules are skipped. A list chain such as ``[("replace", "|", ":")]``
    takes parameters as they are, so they may hold the two separators.
    """
    steps = []
    if isinstance(chain, str):
        for part in chain.split("|"):
            name, *params = part.strip().split(":")
            if name or params:
                steps.append((name.strip().lower(), params))
        return steps
    for item in chain:
        name, *params = [item] if isinstance(item, str) else list(item)
        steps.append((name.strip().lower(), [str(p) for p in params]))
    return steps


def apply_chain(cell: Cell, chain: Chain, strict: bool = True) -> Cell:
    """Fold a chain over a cell. Unknown rules raise, or pass if not strict."""
    for name, params in parse_chain(chain):
        rule = RULES.get(name)
        if rule is None:
            if strict:
                raise RuleError(f"unknown rule {name!r}")
            continue
        cell = rule.build(cell, params)
    return cell


def rule_catalog() -> list[dict[str, object]]:
    """Names, categories and parameters of all rules, for listings."""
    return [
        {"rule": r.name, "category": r.category, "params": list(r.params)} for r in RULES.values()
    ]
