"""The cheapest repair of a sequence of turns as a walk through four states.

A repaired conversation is empty, or an optional system turn and then user and assistant by
turns. The states say what has been written: nothing, the system turn, a user turn, a
finished pair. A row's edits are a 4 x 4 matrix of costs, and rows after one another are the
min-plus product of theirs; so a run of equal rows is a power, and any stretch of rows,
however long, is one matrix.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

NOTHING, SYSTEM, USER, PAIR = range(4)
STATES = range(4)
FAR = 1 << 60
Matrix = tuple[tuple[int, ...], ...]
Vector = tuple[int, ...]

# What an edit costs, and what a truncated row costs besides unless it is deleted.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
AT_END: Vector = (0, FAR, FAR, 0)

# What a written turn leads to: the state after a user or assistant turn (the other of the
# two cannot follow), and where a row may stay as it is.
NEXT = (USER, USER, PAIR, USER)
ROLES = ("user", "user", "assistant", "user")
KEPT = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, PAIR, None)}

# A row as one number: its role's initial (s, u, a, other) and its fault.
INITIALS = "sua"
SOUND, TRUNCATED_FAULT, BLANK, DUPLICATE = range(4)


def symbol(initial: str, fault: int) -> int:
    at = INITIALS.find(initial) if initial else -1
    return fault * 4 + (at if at >= 0 else 3)


def fault_of(sym: int) -> int:
    return sym // 4


def edits(sym: int, state: int) -> list[tuple[str, int, int]]:
    """`(edit, cost, next state)` of a row, in the order of the edits' letters, without inserts."""
    fault, initial = sym // 4, (INITIALS + "?")[sym % 4]
    out = [("D", DELETE, state)]
    if fault in (BLANK, DUPLICATE):
        return out
    more = TRUNCATED if fault == TRUNCATED_FAULT else 0
    stays = KEPT[initial][state] if initial in KEPT else None
    if stays is not None:
        out.append(("K", more, stays))
    out.append(("R", REROLE + more, NEXT[state]))
    return out


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(
        tuple(min(min(a[i][k] + b[k][j] for k in STATES), FAR) for j in STATES) for i in STATES
    )


def apply(a: Matrix, v: Vector) -> Vector:
    return tuple(min(min(a[i][k] + v[k] for k in STATES), FAR) for i in STATES)


def _closure() -> Matrix:
    """Any number of inserts."""
    once = tuple(
        tuple(0 if i == j else INSERT if NEXT[i] == j else FAR for j in STATES) for i in STATES
    )
    return times(times(once, once), times(once, once))


INSERTS = _closure()
UNIT: Matrix = tuple(tuple(0 if i == j else FAR for j in STATES) for i in STATES)


@lru_cache(maxsize=None)  # 16 symbols, as many powers as a count has bits
def power(sym: int, k: int) -> Matrix:
    """The matrix of 2^k rows of one symbol, each with the inserts before it."""
    if k:
        half = power(sym, k - 1)
        return times(half, half)
    row = [[FAR] * 4 for _ in STATES]
    for i in STATES:
        for _, cost, j in edits(sym, i):
            row[i][j] = min(row[i][j], cost)
    return times(INSERTS, tuple(map(tuple, row)))


def run_matrix(sym: int, n: int) -> Matrix:
    out, k = UNIT, 0
    while n >> k:
        if n >> k & 1:
            out = times(out, power(sym, k))
        k += 1
    return out


def stretch(symbols: Sequence[int], counts: Sequence[int]) -> Matrix:
    """The matrix of runs after one another."""
    out = UNIT
    for sym, n in zip(symbols, counts):
        out = times(out, run_matrix(sym, n))
    return out


def before(sym: int, n: int, after: Vector) -> Vector:
    """Costs to the end from before a run, given those from behind it."""
    k = 0
    while n >> k:
        if n >> k & 1:
            after = apply(power(sym, k), after)
        k += 1
    return after


def to_end(at_end: bool, after: Vector) -> Vector:
    """Costs behind the last row: inserts may follow it where nothing else does."""
    return apply(INSERTS, after) if at_end else after


def unroll(symbols: Sequence[int], counts: Sequence[int], after: Vector, start: int,
           at_end: bool) -> tuple[str, int, int]:
    """The cheapest edits from `start` over the runs, the ASCII-least of equals, with their cost
    and the state they end in. `after`: costs to the end from behind the stretch, before any
    insert there; inserts behind the last row belong to the stretch if it is the last."""
    ends = [after if not at_end else to_end(True, AT_END)]
    for sym, n in zip(reversed(symbols), reversed(counts)):
        ends.append(before(sym, n, ends[-1]))
    ends.reverse()
    out: list[str] = []
    state = start
    spent = 0

    def row(sym: int, behind: Vector) -> None:
        """The edits of one row and the inserts before it."""
        nonlocal state, spent
        best = apply(power(sym, 0), behind)
        while True:
            goal = best[state]
            ways = edits(sym, state)
            # D sorts before I, and I before K and R.
            ways.insert(1, ("I", INSERT, NEXT[state]))
            for letter, cost, there in ways:
                if cost + (best if letter == "I" else behind)[there] == goal:
                    out.append(letter)
                    spent += cost
                    state = there
                    break
            if letter != "I":
                return

    for (sym, n), behind in zip(zip(symbols, counts), ends[1:]):
        # Halves of powers of two, the costs behind each from a cached power.
        pending = [(n, behind)]
        while pending:
            m, v = pending.pop()
            if m == 1:
                row(sym, v)
                continue
            k = (m - 1).bit_length() - 1  # the largest power of two below m
            pending += [(1 << k, v), (m - (1 << k), apply(power(sym, k), v))]
    if at_end:
        while state not in (NOTHING, PAIR):
            out.append("I")
            spent += INSERT
            state = NEXT[state]
    return "".join(out), spent, state
