"""Permutations of 0..n-1 that need no sort: each place is worked out alone, by a keyed bijection.

A place is cut into a left and a right half of bits; in turn each half is moved by a function of the
other and a key, which can be undone step by step. Places that land beyond n go
round again until they are below it, which keeps the map one to one. Keys are
from the md5 of seed, permutation, group and round; all else is whole numbers below 2^63, so that SQL can
repeat it.
"""

from __future__ import annotations

import hashlib

import numpy as np

ROUNDS, PRIME = 6, 2**31 - 1


def round_keys(seed: int, perm: int, group: str) -> list[tuple[int, int]]:
    """(a, b) of each round."""
    digests = (hashlib.md5(f"{seed}|{perm}|{group}|{j}".encode()).hexdigest() for j in range(ROUNDS))
    return [(int(h[:7], 16) + 1, int(h[7:14], 16)) for h in digests]


def halves(n: int) -> tuple[int, int]:
    """The number of values of the left and of the right half of a place below n."""
    bits = max(2, (n - 1).bit_length())
    return 1 << bits // 2, 1 << bits - bits // 2


def _moved(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    v = (x * a + b) % PRIME
    return (v * v + a) % PRIME


def _once(x: np.ndarray, n: int, a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
    left, right = halves(n)
    x, y = x // right, x % right
    for j in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
        sign = -1 if back else 1
        if j % 2 == 0:
            x = (x + sign * _moved(y, a[j], b[j])) % left
        else:
            y = (y + sign * _moved(x, a[j], b[j])) % right
    return x * right + y


def dealt(at: np.ndarray, n: int, keys: list[list[tuple[int, int]]], back: bool = False) -> np.ndarray:
    """For each permutation's keys (row) and place (column) the place it is dealt to among n; back: the place that is dealt to it."""
    every = np.array(keys, np.int64).reshape(len(keys), ROUNDS, 2)
    if len(at) >= 2 * sum(halves(n)):
        return np.stack([_dealt_by_table(at, n, own, back) for own in every]) if len(every) else np.empty((0, len(at)), np.int64)
    a, b = every[:, :, 0].T, every[:, :, 1].T  # round by permutation
    out = _once(np.broadcast_to(at, (len(keys), len(at))), n, a[:, :, None], b[:, :, None], back)
    row, column = np.nonzero(out >= n)
    while len(row):
        x = _once(out[row, column], n, a[:, row], b[:, row], back)
        out[row, column] = x
        beyond = x >= n
        row, column = row[beyond], column[beyond]
    return out


def _dealt_by_table(at: np.ndarray, n: int, key: np.ndarray, back: bool) -> np.ndarray:
    """A row of dealt() for many places: a half has few values, whose moves are looked up in each round."""
    sizes = halves(n)
    shift, sign = sizes[1].bit_length() - 1, -1 if back else 1
    moves = [sign * (_moved(np.arange(sizes[1 - j % 2]), *key[j]) % sizes[j % 2]) for j in range(ROUNDS)]

    def once(place: np.ndarray) -> np.ndarray:
        half = [place >> shift, place & (sizes[1] - 1)]
        for j in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            half[j % 2] = (half[j % 2] + moves[j].take(half[1 - j % 2])) & (sizes[j % 2] - 1)
        return (half[0] << shift) | half[1]

    out = once(np.asarray(at, np.int64))
    beyond = np.nonzero(out >= n)[0]
    while len(beyond):
        x = once(out[beyond])
        out[beyond] = x
        beyond = beyond[x >= n]
    return out


def permutation_sql(tokens: str, perms: int, name: str, seed: int = 42) -> str:
    """Recursive CTEs up to <name> (perm, g, seat, token) over a CTE tokens(g, seat, n): the token dealt to each seat, as dealt() has it."""
    keys = ", ".join(f"('0x' || md5(concat_ws('|', '{seed}', perm::VARCHAR, g, '{j}'))[1:7])::BIGINT + 1 AS a{j}, ('0x' || md5(concat_ws('|', '{seed}', perm::VARCHAR, g, '{j}'))[8:14])::BIGINT AS b{j}" for j in range(ROUNDS))

    def once(source: str) -> str:
        """source has perm, g, seat, x, n, lft, rgt and the keys."""
        body = f"SELECT *, x // rgt AS l, x % rgt AS r FROM ({source})"
        for j in range(ROUNDS):
            own, other, size = ("l", "r", "lft") if j % 2 == 0 else ("r", "l", "rgt")
            body = f"SELECT * REPLACE (({own} + (v * v + a{j}) % {PRIME}) % {size} AS {own}) FROM (SELECT *, ({other} * a{j} + b{j}) % {PRIME} AS v FROM ({body}))"
            body = f"SELECT * EXCLUDE (v) FROM ({body})"
        return f"SELECT perm, g, seat, n, lft, rgt, l * rgt + r AS x FROM ({body})"

    bits = "greatest(2, CASE WHEN n > 1 THEN length(ltrim(bin(n - 1), '0')) ELSE 0 END)"
    return f"""{name}_g AS MATERIALIZED (SELECT g, n, (1::BIGINT << (bits // 2)::INTEGER) AS lft, (1::BIGINT << (bits - bits // 2)::INTEGER) AS rgt FROM (SELECT g, any_value(n)::BIGINT AS n, {bits.replace('n - 1', 'any_value(n) - 1').replace('n > 1', 'any_value(n) > 1')} AS bits FROM {tokens} GROUP BY g)),
{name}_k AS MATERIALIZED (SELECT perm, g, {keys} FROM (SELECT g, unnest(range(1, {perms} + 1)) AS perm FROM {name}_g)),
{name}_w AS ({once(f"SELECT k.*, t.seat, t.seat AS x, s.n, s.lft, s.rgt FROM {tokens} t JOIN {name}_g s USING (g) JOIN {name}_k k USING (g)")}
  UNION ALL {once(f"SELECT k.*, w.seat, w.x, w.n, w.lft, w.rgt FROM {name}_w w JOIN {name}_k k USING (perm, g) WHERE w.x >= w.n")}),
{name} AS (SELECT perm, g, seat, x AS token FROM {name}_w WHERE x < n)"""
