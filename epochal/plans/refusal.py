"""Refusals: queries that the engine turns down, by code."""

from __future__ import annotations

#: The codes and what they mean.
CODES = {
    "NL0001": "join using is not in the strict fragment",
    "NL0002": "count(distinct) is not in the strict fragment",
    "NL0210": "a base must be retained forever",
    "NL0211": "a ledger must conserve",
    "NL0215": "an idempotency key needs a window",
    "NL0217": "an idempotency window counts epochs",
    "NL0220": "the strictest rung can't be served from spilled state",
    "NL0221": "pinned state can't be absent",
    "NL0222": "a view on demand must be incremental",
    "NL0223": "no anchor index on the view's key",
    "NL0230": "a ledger is append-only",
    "NL0240": "a literal has more decimals than its currency",
    "NL0250": "amounts of two currencies are added",
    "NL0251": "amounts of two currencies are compared",
    "NL0260": "a computation on a confidential column",
    "NL0300": "a transaction does not conserve",
    "NL0311": "a view reads a view of a weaker rung",
    "NL0400": "a fixpoint without a guard",
    "NL0500": "unknown relation or missing argument",
    "NL0501": "the predicate can't be read",
    "NL0502": "an aggregate argument or a subquery with several columns",
    "NL0503": "a side of a keyed join has no key",
    "NL0504": "a limit that is no literal",
    "NL0505": "unknown stage",
    "NL0506": "undeclared currency",
    "NL0507": "a fixpoint without a measure",
    "NL0508": "a projection outside the strict fragment",
    "NL0509": "a key is no column, or a date no date",
    "NL0510": "a bad argument of as_of or valid_at",
    "NL0511": "select without from",
    "NL0512": "set operands of different width",
    "NL0513": "a fixpoint step that is no function",
    "NL0514": "a fixpoint step of another shape",
    "NL0515": "is compares only with null",
    "NL0517": "a projection that an aggregating query can't have",
    "NL0518": "having asks for an aggregate that is not computed",
    "NL0519": "the keys of a join have different widths",
    "NL0520": "an ambiguous or unknown qualified column",
    "NL0521": "text compared with something else",
    "NL0522": "money whose currency can't be found",
    "NL0523": "a column list of another width than its query",
    "NL0524": "a recursive union all",
    "NL0525": "a recursive step outside the strict fragment",
    "NL0526": "a window outside a projection, or over an aggregating query",
    "NL0527": "not a window function of the strict fragment",
    "NL0528": "a bad number of rounds",
    "22000": "currencies are mixed in one total",
    "22003": "an amount has more decimals than its currency",
    "22023": "an anchor or a currency that does not exist",
    "0A000": "not supported",
    "42601": "the statement can't be read",
    "40001": "another writer came between a serializable read and its commit",
    "IR001": "an operator with a wrong number of inputs",
    "IR010": "an infeasible contract",
    "IR011": "the strictest rung over a pinned anchor",
    "IR012": "evictable state that is not anchored to bases",
    "IR013": "evictable state without a way to rebuild it",
    "IR016": "conservation claimed over an input that does not conserve",
    "IR018": "a dependent join in a served view",
}


class Refused(ValueError):
    """A query or a statement that the engine turns down."""

    def __init__(self, code: str, detail: str = ""):
        self.code = code
        super().__init__(f"{code}: {CODES[code]}" + f" ({detail})" * bool(detail))


class NonTerminating(RuntimeError):
    """A fixpoint that still finds new rows after its last round, or whose guard broke."""

    def __init__(self, rounds: int, tail: list[int], why: str = ""):
        self.rounds, self.tail = rounds, tail
        super().__init__(f"no fixpoint after {rounds} rounds; the last rounds found {tail} new rows" + f"; {why}" * bool(why))
