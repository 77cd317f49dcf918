"""Serve contracts: consistency rungs, materialisation, retention, and which combinations can be kept."""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntEnum, StrEnum

from .refusal import Refused


class Rung(IntEnum):
    """From the weakest to the strictest."""

    BOUNDED = 0
    MONOTONIC = 1
    READ_YOUR_WRITES = 2
    SNAPSHOT = 3
    SERIALIZABLE = 4
    LEDGER_CONSISTENT = 5


class Materialize(StrEnum):
    ABSENT = "absent"
    DEMAND = "demand"
    FULL = "full"
    SPILLED = "spilled"
    TIERED = "tiered"
    AUTO = "auto"


class Retain(StrEnum):
    EVICTABLE = "evictable"
    PINNED = "pinned"
    FOREVER = "forever"


class Lineage(StrEnum):
    OFF = "off"
    KEY = "key"
    FULL = "full"


@dataclass(frozen=True)
class Contract:
    """What a view promises its readers."""

    consistency: Rung = Rung.SNAPSHOT
    bound_epochs: int = 1
    materialize: Materialize = Materialize.AUTO
    retain: Retain = Retain.EVICTABLE
    lineage: Lineage = Lineage.OFF
    budget: int | None = None
    max_rounds: int = 1000

    def permits(self, mode: Materialize) -> bool:
        if self.consistency is Rung.LEDGER_CONSISTENT and mode is Materialize.SPILLED:
            return False
        return not (self.retain is Retain.PINNED and mode is Materialize.ABSENT)

    def checked(self) -> Contract:
        """The contract, or a refusal if no engine could keep it."""
        if not self.permits(self.materialize):
            raise Refused("NL0220" if self.materialize is Materialize.SPILLED else "NL0221")
        if self.max_rounds < 1:
            raise Refused("NL0528", str(self.max_rounds))
        return self

    def stride(self) -> int:
        """Epochs between two rounds of maintenance."""
        return max(1, self.bound_epochs) if self.consistency is Rung.BOUNDED else 1

    def highly_available(self) -> bool:
        return self.consistency <= Rung.READ_YOUR_WRITES

    def may_read(self, inner: Contract) -> bool:
        return inner.consistency >= self.consistency


def check_order(name: str, outer: Contract, inner: dict[str, Contract]) -> None:
    """No view may read a view of a weaker rung."""
    for other, contract in inner.items():
        if not outer.may_read(contract):
            raise Refused("NL0311", f"{name} reads {other}")
