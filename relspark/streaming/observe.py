"""Live queries: after a commit, queries whose tables changed run again and report what differs.

Observers of ordered results get splice records; large results should use ``result_diff``, which stays a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def result_diff(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(added, removed) rows as multisets."""
    return new.exceptAll(old), old.exceptAll(new)


def splices(old: list, new: list) -> list[dict]:
    """Records that turn ``old`` into ``new``: removals first, then additions; a changed row is one of each.

    The rows that stay are a longest common subsequence, found by the shortest edit script: work and memory grow with
    the number of changes, not with the product of the lengths.
    """
    n, m = len(old), len(new)
    head = 0
    while head < min(n, m) and old[head] == new[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and old[n - 1 - tail] == new[m - 1 - tail]:
        tail += 1
    a, b = old[head : n - tail], new[head : m - tail]
    same = _common(a, b)
    keep_a, keep_b = {i for i, _ in same}, {j for _, j in same}
    current, out = list(old), []

    def record(index, removed, added):
        out.append({"type": "splice", "index": index, "removed": removed, "added_count": added, "object": list(current)})

    at = head
    for i, row in enumerate(a):
        if i in keep_a:
            at += 1
        else:
            del current[at]
            record(head + i, [row], 0)
    for j, row in enumerate(b):
        if j not in keep_b:
            current.insert(head + j, row)
            record(head + j, [], 1)
    return out


def _common(a: list, b: list) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence: for each number of edits, how far each diagonal gets."""
    reach, steps = {1: 0}, []
    for d in range(len(a) + len(b) + 1):
        steps.append(dict(reach))
        for k in range(-d, d + 1, 2):
            i = reach[k + 1] if k == -d or k != d and reach[k - 1] < reach[k + 1] else reach[k - 1] + 1
            while i < len(a) and i - k < len(b) and a[i] == b[i - k]:
                i += 1
            reach[k] = i
            if i >= len(a) and i - k >= len(b):
                return _walked_back(steps, len(a), len(b))
    return []


def _walked_back(steps: list[dict], i: int, j: int) -> list[tuple[int, int]]:
    out = []
    for d in range(len(steps) - 1, -1, -1):
        reach, k = steps[d], i - j
        before = k + 1 if k == -d or k != d and reach[k - 1] < reach[k + 1] else k - 1
        x = reach[before] if d else 0
        y = x - before if d else 0
        while i > x and j > y:
            i, j = i - 1, j - 1
            out.append((i, j))
        i, j = x, y
    return out[::-1]


class Observers:
    def __init__(self):
        self._all: list[list] = []  # [query, callbacks, last result]
        self._frames: list[list] = []  # [query, callback, last result as a DataFrame]

    def add_frames(self, query, callback, now: DataFrame) -> None:
        self._frames.append([query, callback, now])

    def update_frames(self, tables: set[str]) -> None:
        for entry in self._frames:
            if entry[0].scope() & tables:
                last, entry[2] = entry[2], entry[0].exec_df()
                entry[1](*result_diff(last, entry[2]))

    def add(self, query, callback) -> None:
        for entry in self._all:
            if entry[0] is query:
                entry[1].append(callback)
                return
        self._all.append([query, [callback], []])

    def remove(self, query, callback) -> None:
        for entry in self._all:
            if entry[0] is query and callback in entry[1]:
                entry[1].remove(callback)
        self._all = [e for e in self._all if e[1]]
        self._frames = [e for e in self._frames if e[0] is not query or e[1] != callback]

    def update(self, query, rows: list) -> None:
        for entry in self._all:
            if entry[0] is query:
                changes = splices(entry[2], rows)
                entry[2] = rows
                if changes:
                    for f in list(entry[1]):
                        f(changes)

    def touched(self, tables: set[str]) -> list:
        return [e[0] for e in self._all if e[0].scope() & tables]
