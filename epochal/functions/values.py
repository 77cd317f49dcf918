"""Values: money at a currency's scale, dates as day numbers, checked arithmetic, patterns, currency guards.

Arithmetic relies on ANSI mode, which the session turns on: overflow and
division by zero fail the query, and null goes through first.
"""

from __future__ import annotations

import datetime
import decimal
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.refusal import Refused

WIDE = "decimal(38,0)"


def column(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


@dataclass(frozen=True)
class Currency:
    code: int
    name: str
    scale: int


@dataclass
class Currencies:
    """Declared currencies; a currency's code is its place in the declaration."""

    known: dict[str, Currency] = field(default_factory=dict)

    def declare(self, name: str, scale: int) -> Currency:
        if not 0 <= scale <= 18:
            raise ValueError("a currency's scale is 0 to 18")
        self.known[name] = Currency(len(self.known), name, scale)
        return self.known[name]

    def named(self, name: str) -> Currency:
        if name not in self.known:
            raise Refused("NL0506", name)
        return self.known[name]

    def code(self, name: str) -> Column:
        return F.lit(self.named(name).code)

    def minor(self, amount: str | int | decimal.Decimal, name: str) -> int:
        """A decimal amount in minor units; more decimals than the currency has are refused."""
        currency = self.named(name)
        scaled = decimal.Decimal(amount).scaleb(currency.scale)
        if scaled != scaled.to_integral_value():
            raise Refused("NL0240", f"{amount} {name}")
        return int(scaled)

    def money(self, amount: str | int | decimal.Decimal, name: str) -> Column:
        """A literal: minor units beside the currency's code."""
        return F.struct(F.lit(self.minor(amount, name)).cast(WIDE).alias("minor"), self.code(name).alias("currency"))

    def scaled(self, amount: Column, name: str) -> Column:
        """A decimal column in minor units; a value with more decimals fails the query."""
        currency = self.named(name)
        exact = amount.cast("decimal(38,18)") * F.lit(10**currency.scale).cast("decimal(19,0)")
        whole = F.round(exact, 0)
        return F.when(amount.isNull(), None).when(whole == exact, whole.cast(WIDE)).otherwise(F.raise_error(F.lit(f"22003: more than {currency.scale} decimals of {name}")))


def standard_currencies() -> Currencies:
    """The currencies of the standard bank schema."""
    out = Currencies()
    for name, scale in (("usd", 2), ("eur", 2), ("gbp", 2), ("jpy", 0), ("bhd", 3)):
        out.declare(name, scale)
    return out


def same_currency(left: Column, right: Column) -> Column:
    """left.minor, after a check that both amounts have one currency."""
    return F.when(left["currency"] == right["currency"], left["minor"]).when(left.isNull() | right.isNull(), None).otherwise(F.raise_error(F.lit("NL0251: amounts of two currencies")))


def compare_money(left: Column, op: str, right: Column) -> Column:
    """left op right for two amounts; two currencies fail the query, null is unknown."""
    a, b = same_currency(left, right), right["minor"]
    return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def sum_in_currency(amount: Column | str, currency: Column | str) -> Column:
    """An aggregate: the sum, or a failure if the group holds two currencies.

    The check is part of the value, so it protects whoever reads the value; a bare
    count of the rows does not compute it.
    """
    total, low, high = F.sum(column(amount).cast(WIDE)), F.min(column(currency)), F.max(column(currency))
    return F.when(low.eqNullSafe(high), total).otherwise(F.raise_error(F.lit("22000: currencies are mixed in one total")).cast(WIDE))


def div(a, b) -> Column:
    """Whole division towards zero; by zero fails the query."""
    a, b = column(a), column(b)
    return ((a - a % b) / b).cast(WIDE)


def mod(a, b) -> Column:
    """The remainder of div: it has the sign of a."""
    return column(a) % column(b)


def like(text, pattern: str) -> Column:
    """% for any run and _ for any one character; there is no escape character."""
    return column(text).like(pattern.replace("\\", "\\\\"))


def parse_date(text: str) -> datetime.date:
    """A strict YYYY-MM-DD date."""
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        raise Refused("NL0509", text)
    try:
        return datetime.date.fromisoformat(text)
    except ValueError:
        raise Refused("NL0509", text) from None


def day_number(date: Column | str) -> Column:
    """Days since 1970-01-01."""
    return F.datediff(column(date), F.lit(datetime.date(1970, 1, 1)))


def day(number: Column | str) -> Column:
    return F.date_add(F.lit(datetime.date(1970, 1, 1)), column(number))
