"""Linear assignment on small matrices."""

from __future__ import annotations


def best_matching(score: list[list[float]]) -> list[tuple[int, int]]:
    """(row, column) pairs of largest total score, by shortest augmenting paths; needs no square.

    Rows are added one at a time; each follows the cheapest path to a free
    column under reduced costs.  Ties go to the smaller column.
    """
    rows, cols = len(score), len(score[0]) if score else 0
    n = max(rows, cols)
    if not n:
        return []
    top = max(max(r) for r in score)
    cost = [[top - (score[i][j] if i < rows and j < cols else 0.0) for j in range(n)] for i in range(n)]
    price_row, price_col = [0.0] * n, [0.0] * n
    owner = [-1] * n
    for i in range(n):
        reach = [float("inf")] * n
        came = [-1] * n
        done = [False] * n
        row, column = i, -1
        while True:
            low, nxt = float("inf"), -1
            for j in range(n):
                if done[j]:
                    continue
                d = cost[row][j] - price_row[row] - price_col[j]
                if column >= 0:
                    d += reach[column]
                if d < reach[j]:
                    reach[j], came[j] = d, column
                if reach[j] < low:
                    low, nxt = reach[j], j
            done[nxt] = True
            column = nxt
            if owner[column] < 0:
                break
            row = owner[column]
        end = reach[column]
        price_row[i] += end
        for j in range(n):
            if done[j] and j != column:
                price_row[owner[j]] += end - reach[j]
                price_col[j] -= end - reach[j]
        while True:
            before = came[column]
            owner[column] = i if before < 0 else owner[before]
            if before < 0:
                break
            column = before
    return sorted((owner[j], j) for j in range(cols) if owner[j] < rows)


def greedy_matching(score: list[list[float]]) -> list[tuple[int, int]]:
    """Rows by descending best score, each to the best column still free."""
    rows = sorted(range(len(score)), key=lambda i: (-max(score[i], default=0.0), i))
    free = set(range(len(score[0]) if score else 0))
    out = []
    for i in rows:
        if free:
            j = max(sorted(free), key=lambda j: score[i][j])
            free.discard(j)
            out.append((i, j))
    return sorted(out)
