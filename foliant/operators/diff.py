"""Line differences between two texts: the shortest edit script."""

from __future__ import annotations

from array import array

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def _common(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common run of lines, by furthest-reaching paths; step d keeps the 2d + 3 ends it began with."""
    n, m = len(x), len(y)
    mid = n + m + 1
    reach = [0] * (2 * mid + 1)
    trail: list[array] = []
    end = False
    while not end:
        d = len(trail)
        trail.append(array("i", reach[mid - d - 1 : mid + d + 2]))
        for k in range(-d, d + 1, 2):
            i = reach[mid + k + 1] if k == -d or (k != d and reach[mid + k - 1] < reach[mid + k + 1]) else reach[mid + k - 1] + 1
            while i < n and i - k < m and x[i] == y[i - k]:
                i += 1
            reach[mid + k] = i
            if i >= n and i - k >= m:
                end = True
                break
    out: list[tuple[int, int]] = []
    i, j = n, m
    for d in range(len(trail) - 1, -1, -1):
        ends, k = trail[d], i - j
        down = k == -d or (k != d and ends[k + d] < ends[k + d + 2])
        p = ends[k + d + 2] if down else ends[k + d]
        q = p - (k + 1 if down else k - 1)
        start = (0 if d == 0 else p if down else p + 1)
        while i > start and j > 0:
            i, j = i - 1, j - 1
            out.append((i, j))
        i, j = p, q
    return out[::-1]


def line_diff(old: str, new: str) -> list[tuple[str, int, str]]:
    """(kind, lines, text) runs with kind same, removed or added; removals come before additions in one place.

    Common lines at both ends are set aside, and lines that only one side has are no part of the search, which gives a least number of changes.
    """
    a, b = old.split("\n") if old else [], new.split("\n") if new else []
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[lead : len(a) - tail], b[lead : len(b) - tail]
    both = set(x) & set(y)
    at, bt = [i for i, s in enumerate(x) if s in both], [j for j, s in enumerate(y) if s in both]
    ops: list[tuple[str, str]] = [("same", s) for s in a[:lead]]
    i = j = 0
    for u, v in [(at[u], bt[v]) for u, v in _common([x[k] for k in at], [y[k] for k in bt])] + [(len(x), len(y))]:
        ops += [("removed", s) for s in x[i:u]] + [("added", s) for s in y[j:v]]
        ops += [("same", x[u])] if u < len(x) else []
        i, j = u + 1, v + 1
    ops += [("same", s) for s in a[len(a) - tail :]]
    out: list[tuple[str, int, str]] = []
    at = 0
    while at < len(ops):
        end = at
        if ops[at][0] == "same":
            while end < len(ops) and ops[end][0] == "same":
                end += 1
            out.append(("same", end - at, "\n".join(s for _, s in ops[at:end])))
        else:
            while end < len(ops) and ops[end][0] != "same":
                end += 1
            for kind in ("removed", "added"):
                if run := [s for k, s in ops[at:end] if k == kind]:
                    out.append((kind, len(run), "\n".join(run)))
        at = end
    return out


RUNS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("lines", T.IntegerType()), T.StructField("text", T.StringType())]))


@F.pandas_udf(RUNS)
def _runs(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([None if o is None and n is None else [{"kind": k, "lines": c, "text": t} for k, c, t in line_diff(o or "", n or "")] for o, n in zip(old, new)])


def diff_runs(old: Column, new: Column) -> Column:
    """Runs of equal, removed and added lines; a null side counts as empty, two nulls give null."""
    return _runs(old, new)
