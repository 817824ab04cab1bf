"""Edit scripts between nested schemas.

A schema is an unordered tree whose nodes carry a field name.  The distance is
the least total cost of adding, deleting, renaming and (on request) moving
nodes.  Siblings of one name are the same field; what remains on either side is
paired by a least-cost assignment, where pairing two structs costs the distance
of their subtrees.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

ADD, DELETE, RENAME, MOVE = "added", "removed", "renamed", "moved"
FORBIDDEN = 1e6


Path = tuple[str, ...]


class Edit(NamedTuple):
    kind: str
    path: Path  # in the contract; for an addition in the file
    seen: Path


def assign(cost: list[list[float]]) -> list[int]:
    """For each row the column of a least-cost assignment (rows <= columns)."""
    n, m = len(cost), len(cost[0]) if cost else 0
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, back, used = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            row, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    reduced = cost[row - 1][j - 1] - u[row] - v[j]
                    if reduced < least[j]:
                        least[j], back[j] = reduced, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[back[j0]], back[j0]
    rows = [0] * n
    for j in range(1, m + 1):
        if match[j]:
            rows[match[j] - 1] = j - 1
    return rows


def script(
    contract: dict,
    seen: dict,
    relabel: Callable[[Path, Path], float],
    *,
    mandatory: frozenset[Path],
    delete: float = 0.5,
    add: float = 0.5,
    moves: bool = False,
    inside: bool = False,
    here: Path = (),
    there: Path = (),
) -> tuple[float, list[Edit]]:
    """(distance, edits) that lead from ``contract`` to ``seen``.

    Trees map names to None (leaf) or to a subtree.  ``relabel(path, path)`` is
    the cost of a rename, FORBIDDEN if the two cannot be one field.  Only
    fields in ``mandatory`` can be deleted or renamed; others may be absent.
    With ``inside`` the renames below a renamed struct are listed as well.
    """
    more = {"mandatory": mandatory, "delete": delete, "add": add, "inside": inside}
    total, edits = 0.0, []
    lost = [k for k in contract if k not in seen and (*here, k) in mandatory]
    extra = [k for k in seen if k not in contract]
    for k in contract:
        if contract[k] and seen.get(k):
            cost, below = script(contract[k], seen[k], relabel, here=(*here, k), there=(*there, k), **more)
            total, edits = total + cost, edits + below
    pairs: dict[str, str] = {}
    within: dict[tuple[str, str], list[Edit]] = {}
    if lost and extra:
        costs = []
        for k in lost:
            row = []
            for x in extra:
                cost = relabel((*here, k), (*there, x))
                if cost < FORBIDDEN and contract[k] and seen[x]:
                    below_cost, within[k, x] = script(contract[k], seen[x], relabel, here=(*here, k), there=(*there, x), **more)
                    cost += below_cost
                row.append(cost)
            costs.append(row + [delete + add] * len(lost))  # the last columns stand for a deletion
        for r, j in enumerate(assign(costs)):
            if j < len(extra):
                pairs[lost[r]] = extra[j]
                total += costs[r][j]
    gone = [k for k in lost if k not in pairs]
    new = [x for x in extra if x not in pairs.values()]
    total += delete * len(gone) + add * len(new)
    edits += [Edit(RENAME, (*here, k), (*there, x)) for k, x in pairs.items()]
    if inside:
        edits += [e for pair in pairs.items() for e in within.get(pair, []) if e.kind == RENAME]
    edits += [Edit(DELETE, (*here, k), ()) for k in gone] + [Edit(ADD, (*there, x), (*there, x)) for x in new]
    if moves:
        gone = {e.path[-1]: e for e in edits if e.kind == DELETE}
        for path in _absent(contract, seen, here):  # a field that may be absent can have moved as well
            gone.setdefault(path[-1], Edit(DELETE, path, ()))
        for e in [e for e in edits if e.kind == ADD]:
            d = gone.get(e.path[-1])
            if d and d.path[:-1] != e.path[:-1]:
                del gone[e.path[-1]]
                total -= (delete + add) / 2 if d in edits else add / 2
                edits = [x for x in edits if x not in (d, e)] + [Edit(MOVE, d.path, e.path)]
    return total, edits


def _absent(contract: dict, seen: dict, here: Path) -> list[Path]:
    """Contract fields without a field of their name in their place."""
    out = []
    for k, below in contract.items():
        if k not in seen:
            out.append((*here, k))
        if below:
            out += _absent(below, seen.get(k) or {}, (*here, k))
    return out
