"""What model calls may cost. A wallet can't be divided over executors, so calls stay on the driver."""

from __future__ import annotations

import contextlib
import dataclasses
import re
from collections.abc import Iterator
from typing import Any

from spanloom.errors import BudgetExceeded, SpanloomError
from spanloom.models.ports import field


@dataclasses.dataclass(frozen=True)
class Amount:
    """An amount in each unit. As a limit, infinity is none."""

    calls: float = 0
    tokens: float = 0
    usd: float = 0.0

    def __add__(self, other: Amount) -> Amount:
        return Amount(self.calls + other.calls, self.tokens + other.tokens, self.usd + other.usd)

    def __sub__(self, other: Amount) -> Amount:
        return Amount(self.calls - other.calls, self.tokens - other.tokens, self.usd - other.usd)

    def over(self, limit: Amount) -> list[str]:
        """Units in which this is more than ``limit``."""
        return [f.name for f in dataclasses.fields(self) if getattr(self, f.name) > getattr(limit, f.name)]


NO_LIMIT = Amount(float("inf"), float("inf"), float("inf"))


class Budget:
    """One object may serve several stages; each call is booked by ``call()``."""

    def __init__(self, limit: Amount = NO_LIMIT, *, usd_per_1k_tokens: float = 0.0):
        self.limit, self.spent, self.price = limit, Amount(), usd_per_1k_tokens / 1000

    def _priced(self, tokens: float) -> Amount:
        return Amount(1, tokens, tokens * self.price)

    @contextlib.contextmanager
    def call(self, about: float = 0) -> Iterator[list]:
        """A call of about so many tokens. Fails before it if it would pass a limit; inside, append the call's usage to the
        list. A call that fails is booked too. A reported ``cost_usd`` counts as it is, else the tokens at the price."""
        if passed := (self.spent + self._priced(about)).over(self.limit):
            raise BudgetExceeded(f"the {', '.join(passed)} of the budget are spent ({self.spent})")
        usage: list[Any] = []
        try:
            yield usage
        finally:
            used = usage[-1] if usage else None
            tokens = sum(int(field(used, k) or 0) for k in ("input_tokens", "output_tokens")) if used else 0
            bill = self._priced(tokens)
            cost = field(used, "cost_usd") if used else None
            self.spent = self.spent + (bill if cost is None else dataclasses.replace(bill, usd=float(cost)))


def budget_of(value: Budget | float | str | None) -> Budget:
    """``2.5`` and ``"2.5usd"`` are dollars; ``"5000 tokens"``, ``"40 calls"``; None is without limits."""
    if isinstance(value, Budget):
        return value
    if value is None:
        return Budget()
    found = re.fullmatch(r"\s*(?P<dollar>\$?)\s*(?P<number>\d+(\.\d+)?)\s*(?P<unit>usd|tokens|calls)?\s*", str(value).lower())
    if not found:
        raise SpanloomError(f"no budget: {value!r}")
    return Budget(dataclasses.replace(NO_LIMIT, **{found["unit"] or "usd": float(found["number"])}))
