"""Arithmetic in GF(2**61 - 1): vectorised products and small polynomials."""

from __future__ import annotations

import random

import numpy as np

P = (1 << 61) - 1
_P = np.uint64(P)
_M31 = np.uint64((1 << 31) - 1)
_M30 = np.uint64((1 << 30) - 1)
_S31, _S30, _S61, _S1 = np.uint64(31), np.uint64(30), np.uint64(61), np.uint64(1)


def mulmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a*b mod P of uint64 arrays below P, by halves of 31 bits."""
    ah, al, bh, bl = a >> _S31, a & _M31, b >> _S31, b & _M31
    mid = ah * bl + al * bh
    s = ((ah * bh) << _S1) + (mid >> _S30) + ((mid & _M30) << _S31)
    s = (s & _P) + (s >> _S61) + al * bl
    s = (s & _P) + (s >> _S61)
    return np.where(s >= _P, s - _P, s)


def segment_products(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, product of the rows of values with each key); values is rows x points."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    while len(keys):
        first = np.r_[True, keys[1:] != keys[:-1]]
        starts = np.flatnonzero(first)
        if len(starts) == len(keys):
            break
        rank = np.arange(len(keys)) - np.repeat(starts, np.diff(np.r_[starts, len(keys)]))
        odd = np.flatnonzero(rank & 1)
        values[odd - 1] = mulmod(values[odd - 1], values[odd])
        keep = (rank & 1) == 0
        keys, values = keys[keep], values[keep]
    return keys, values


# Polynomials are lists of coefficients, lowest first, without leading zeros.


def _trim(f: list[int]) -> list[int]:
    while f and not f[-1]:
        f.pop()
    return f


def _divmod(f: list[int], g: list[int]) -> tuple[list[int], list[int]]:
    f, inv, n = list(f), pow(g[-1], P - 2, P), len(g) - 1
    q = [0] * max(0, len(f) - n)
    for i in range(len(f) - n - 1, -1, -1):
        c = f[i + n] * inv % P
        q[i] = c
        if c:
            for j in range(n + 1):
                f[i + j] = (f[i + j] - c * g[j]) % P
    return _trim(q), _trim(f[:n])


def _gcd(f: list[int], g: list[int]) -> list[int]:
    while g:
        f, g = g, _divmod(f, g)[1]
    inv = pow(f[-1], P - 2, P)
    return [c * inv % P for c in f]


def _mul(f: list[int], g: list[int], m: list[int]) -> list[int]:
    out = [0] * (len(f) + len(g) - 1) if f and g else []
    for i, a in enumerate(f):
        for j, b in enumerate(g):
            out[i + j] += a * b
    return _divmod([c % P for c in out], m)[1] if out else []


def _power(f: list[int], e: int, m: list[int]) -> list[int]:
    out = [1]
    while e:
        if e & 1:
            out = _mul(out, f, m)
        f, e = _mul(f, f, m), e >> 1
    return out


def roots(f: list[int]) -> list[int] | None:
    """The roots of a monic f when it is a product of distinct linear factors, else None."""
    if len(f) == 1:
        return []
    if len(f) == 2:
        return [-f[0] % P]
    x = _power([0, 1], P, f)
    x = _trim([*x, *[0] * (2 - len(x))])
    x = x + [0] * (2 - len(x))
    x[1] = (x[1] - 1) % P
    if _trim(x):
        return None
    rng, out, todo = random.Random(len(f)), [], [f]
    while todo:
        g = todo.pop()
        if len(g) <= 2:
            out += [-g[0] % P] if len(g) == 2 else []
            continue
        h = _power([rng.randrange(P), 1], (P - 1) // 2, g) or [0]
        h[0] = (h[0] - 1) % P
        d = _gcd(g, h) if _trim(h) else g
        if 1 < len(d) < len(g):
            todo += [d, _divmod(g, d)[0]]
        else:
            todo.append(g)
    return out


def rational(points: list[int], ratios: list[int], da: int, db: int) -> tuple[list[int], list[int]] | None:
    """Monic f of degree da and g of degree db with f = ratio * g at the first da+db points, in lowest terms.

    Unknowns that the points leave free are set to zero: they belong to a common
    factor, which the division by the greatest common divisor takes out.
    """
    n = da + db
    rows = []
    for z, r in zip(points[:n], ratios[:n]):
        row, t = [], 1
        powers = []
        for _ in range(max(da, db) + 1):
            powers.append(t)
            t = t * z % P
        row = powers[:da] + [-r * powers[j] % P for j in range(db)]
        row.append((r * powers[db] - powers[da]) % P)
        rows.append(row)
    pivots, at = [], 0
    for c in range(n):
        k = next((i for i in range(at, n) if rows[i][c]), None)
        if k is None:
            continue
        rows[at], rows[k] = rows[k], rows[at]
        inv = pow(rows[at][c], P - 2, P)
        rows[at] = [v * inv % P for v in rows[at]]
        for i in range(n):
            if i != at and rows[i][c]:
                m, top = rows[i][c], rows[at]
                rows[i] = [(v - m * w) % P for v, w in zip(rows[i], top)]
        pivots.append(c)
        at += 1
    if any(row[n] for row in rows[at:]):
        return None
    solution = [0] * n
    for i, c in enumerate(pivots):
        solution[c] = rows[i][n]
    f, g = solution[:da] + [1], solution[da:] + [1]
    common = _gcd(f, g)
    return (_divmod(f, common)[0], _divmod(g, common)[0]) if len(common) > 1 else (f, g)


def value(f: list[int], z: int) -> int:
    out = 0
    for c in reversed(f):
        out = (out * z + c) % P
    return out
