"""Edit distance of two texts in Python, for searches that run inside tasks.

Spark's own ``levenshtein`` visits every cell of the table of prefixes; here a column of that
table is a few operations on whole numbers as wide as the text, and common ends are left out.
"""

from __future__ import annotations

from functools import lru_cache


def _shared(a: str, b: str) -> int:
    """Length of the common beginning, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


# A text meets many others in a row.
@lru_cache(maxsize=512)
def _places(text: str) -> dict[str, int]:
    """Per letter a number whose bits are its places."""
    letters, backwards = set(text), text[::-1]
    zeros = dict.fromkeys(map(ord, letters), "0")
    return {c: int(backwards.translate(zeros | {ord(c): "1"}), 2) for c in letters}


# Letters of a common end that is left out; shorter ones stay, so that the places of a whole text are found once.
COMMON = 8
# Letters that a piece of a text needs to be searched for on its own.
PIECE = 3


def _surely_apart(a: str, b: str, most: int) -> bool:
    """True if more than ``most`` of ``2 * most + 1`` pieces of ``a`` are missing near their places in ``b``: each takes an edit."""
    pieces = 2 * most + 1
    missing, end = 0, 0
    for k in range(1, pieces + 1):
        start, end = end, k * len(a) // pieces
        if b.find(a[start:end], max(0, start - most), end + most) < 0:
            missing += 1
            if missing > most:
                return True
    return False


def edit_distance(a: str, b: str, most: int | None = None) -> int | None:
    """Insertions, deletions and replacements between two texts; None when surely more than ``most``."""
    if a == b:
        return 0
    at = _shared(a, b)
    if at >= COMMON:
        a, b = a[at:], b[at:]
    at = _shared(a[::-1], b[::-1])
    if at >= COMMON:
        a, b = a[:-at], b[:-at]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    if most is not None and (len(a) - len(b) > most or (2 * most + 1) * PIECE <= len(a) and _surely_apart(a, b, most)):
        return None
    places, mask, top = _places(a), (1 << len(a)) - 1, 1 << (len(a) - 1)
    # bits of the column's steps: one more, one less
    more, less, distance = mask, 0, len(a)
    for left, letter in zip(range(len(b) - 1, -1, -1), b):
        same = places.get(letter, 0)
        level = same | less
        diagonal = (((same & more) + more) ^ more) | same
        up = less | (mask & ~(diagonal | more))
        down = more & diagonal
        if up & top:
            distance += 1
            if most is not None and distance - left > most:
                return None
        elif down & top:
            distance -= 1
        up = (up << 1 | 1) & mask
        more = (down << 1 & mask) | (mask & ~(level | up))
        less = up & level
    return distance
