"""Resolution of train, valid and test sizes."""

from __future__ import annotations

import math
from dataclasses import dataclass

from sunder.errors import ConfigurationError, EmptyPartitionError

DEFAULT = (0.8, 0.0, 0.2)


def floor_round(x: float) -> int:
    """Round half up."""
    return math.floor(x + 0.5)


@dataclass(frozen=True)
class Sizes:
    train: int
    valid: int
    test: int

    @property
    def total(self) -> int:
        return self.train + self.valid + self.test


def _one(spec, n: int, name: str) -> tuple[float, int, bool]:
    """Exact share, rounded count and whether the spec is a fraction."""
    if spec is None:
        return 0.0, 0, False
    if isinstance(spec, bool):
        raise ConfigurationError(f"{name}: a boolean is no size")
    if isinstance(spec, int):
        if spec < 1:
            raise ConfigurationError(f"{name}: a count is at least 1")
        return float(spec), spec, False
    if spec == 0.0:
        return 0.0, 0, False
    if not 0.0 < spec < 1.0:
        raise ConfigurationError(f"{name}: a fraction lies in (0, 1)")
    return spec * n, floor_round(spec * n), True


def resolve_sizes(n: int, train=None, valid=None, test=None) -> Sizes:
    """Counts that sum to ``n``.

    Nothing given: 80/0/20.  One size open: it takes the rest.  All given: what
    is left over goes to train.  Fractions that round to more than ``n`` are
    lowered in the order train, valid, test, none below its floor.
    """
    given = {"train": train, "valid": valid, "test": test}
    missing = [k for k, v in given.items() if v is None]
    if len(missing) == 3:
        given = dict(zip(given, DEFAULT, strict=True))
        missing = []
    elif len(missing) == 2:
        if missing == ["train", "valid"] or missing == ["valid", "test"]:
            given["valid"] = 0.0
            missing.remove("valid")
        else:
            raise ConfigurationError("give the train or the test size beside the valid size")
    parts = {k: _one(v, n, k) for k, v in given.items()}
    count = {k: p[1] for k, p in parts.items()}
    over = sum(count.values()) - n
    for k, (exact, _, fraction) in parts.items():
        while over > 0 and fraction and count[k] > math.floor(exact):
            count[k] -= 1
            over -= 1
    if over > 0:
        raise ConfigurationError(f"sizes exceed {n} records")
    count[missing[0] if missing else "train"] += -over
    if count["train"] < 1 or count["test"] < 1:
        raise EmptyPartitionError(f"{n} records leave train {count['train']} and test {count['test']}")
    return Sizes(count["train"], count["valid"], count["test"])
