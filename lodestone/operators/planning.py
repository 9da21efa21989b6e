"""Order and validity of chains of strategies, and effort of migrations; small, so decided by the driver."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordered(items: list[str], after: dict[str, set[str]], rank: dict[str, int]) -> list[str]:
    """Items with all they come after before them, of equals by rank; with a cycle, by rank alone."""
    left, done = set(items), []
    while left:
        free = sorted((i for i in left if not (after.get(i, set()) & left)), key=lambda i: (rank.get(i, 1 << 30), i))
        if not free:
            return sorted(items, key=lambda i: (rank.get(i, 1 << 30), i))
        done.append(free[0])
        left.remove(free[0])
    return done


def valid(chain: list[str], incompatible: set[tuple[str, str]], after: dict[str, set[str]]) -> bool:
    """Not empty, nothing twice, no neighbours that exclude each other or stand in the wrong order."""
    pairs = list(zip(chain, chain[1:]))
    return bool(chain) and len(set(chain)) == len(chain) and not any((a, b) in incompatible or (b, a) in incompatible or b in after.get(a, set()) for a, b in pairs)


def chains(items: list[str], incompatible: set[tuple[str, str]], after: dict[str, set[str]], rank: dict[str, int], impact: dict[str, float], most: int = 4) -> list[list[str]]:
    """All valid chains of up to ``most`` items, each in order, the greatest impact first."""
    found = [ordered(list(c), after, rank) for k in range(1, most + 1) for c in combinations(sorted(items), k)]
    return sorted((c for c in found if valid(c, incompatible, after)), key=lambda c: (-sum(impact.get(i, 0) for i in c), len(c), c))


def migration_hours(steps: Column, blocking: Column, high_risk: Column) -> Column:
    return (steps + blocking) * (1.15 + 0.1 * high_risk)
