"""The refined combination against a scan over a grid of cells."""

import random

import pytest

from glosspark.operators import align


def scan(a, b, size):
    """Cells in rows and then columns: taken if row and column are free, or unless cells stand beside it in both directions."""
    grid = [[(s, t) in a and (s, t) in b for t in range(size + 2)] for s in range(size + 2)]
    for s in range(1, size + 1):
        for t in range(1, size + 1):
            if grid[s][t] or not ((s, t) in a or (s, t) in b):
                continue
            free = not any(grid[s]) and not any(row[t] for row in grid)
            upright, level = grid[s - 1][t] or grid[s + 1][t], grid[s][t - 1] or grid[s][t + 1]
            grid[s][t] = free or not (upright and level)
    return {(s, t) for s in range(1, size + 1) for t in range(1, size + 1) if grid[s][t]}


@pytest.mark.parametrize("seed", [1, 2])
def test_refined(spark, seed):
    rng = random.Random(seed)
    cells = lambda: {(rng.randint(1, 5), rng.randint(1, 5)) for _ in range(rng.randint(0, 12))}
    pairs = {k: (cells(), cells()) for k in range(120)}
    a, b = (spark.createDataFrame([(k, s, t) for k, both in pairs.items() for s, t in both[i]], "k int, src int, tgt int") for i in (0, 1))
    want = {(k, s, t) for k, (x, y) in pairs.items() for s, t in scan(x, y, 5)}
    assert {tuple(r) for r in align.refined(a, b, ["k"]).collect()} == want
