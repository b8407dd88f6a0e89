"""A small database with known answers, and brute force."""

from __future__ import annotations

from itertools import combinations

TEXT = """3 5 1 2 4:18:5 1 2 4 6
5 2 3:12:3 8 1
1 3 4:13:5 6 2
1 2 3 5 6:18:5 4 1 6 2
2 4 5:13:4 6 3
7:1:1
"""
BASKETS = [dict(zip(map(int, i.split()), map(int, u.split()), strict=True)) for i, _, u in (x.split(":") for x in TEXT.splitlines())]
ROWS = [(t, i, u) for t, b in enumerate(BASKETS, 1) for i, u in b.items()]
HUI_15 = {
    (1, 2): 15, (1, 2, 3): 21, (1, 2, 3, 4): 17, (1, 2, 3, 4, 5): 18, (1, 2, 3, 5): 28, (1, 2, 3, 5, 6): 18, (1, 2, 5): 22, (1, 2, 5, 6): 17,
    (1, 3): 24, (1, 3, 4): 26, (1, 3, 5): 20, (1, 4): 15, (2,): 20, (2, 3): 23, (2, 3, 4): 15, (2, 3, 4, 5): 16, (2, 3, 5): 33, (2, 4): 20,
    (2, 4, 5): 24, (2, 5): 33, (3, 4): 19, (3, 5): 17, (4, 5): 16,
}
HUI_30 = {(2, 5): 33, (2, 3, 5): 33}


def brute(baskets: list[dict[int, int]], min_util: int) -> dict[tuple[int, ...], int]:
    out: dict[tuple[int, ...], int] = {}
    for b in baskets:
        for k in range(1, len(b) + 1):
            for s in combinations(sorted(b), k):
                out[s] = out.get(s, 0) + sum(b[i] for i in s)
    return {s: u for s, u in out.items() if u >= min_util}
