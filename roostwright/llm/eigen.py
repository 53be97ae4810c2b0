"""Exact eigenpairs of an integer scatter matrix: what one task does for a few primes or for one component.

The characteristic polynomial is worked out modulo 31-bit primes by reduction to Hessenberg form and put together by the Chinese
remainder theorem. Its roots are real, so the sign changes of its coefficients, shifted to a, count the roots above a exactly:
bisection on those counts isolates them, bisection on the sign refines them. Nothing here is rounded but the last step,
the unit vector as doubles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce
from math import gcd, isqrt

import numpy as np

#: Bits by which a root's interval is narrower than the gap to its neighbours (and the root itself), and guard bits of the elimination.
NARROW, GUARD = 96, 64


def primes_below(top: int, count: int) -> list[int]:
    """The `count` largest primes below top (2^31 at most)."""
    small = [p for p in range(2, isqrt(top) + 1) if all(p % q for q in range(2, isqrt(p) + 1))]
    small, out, hi = np.array(small, np.int64), [], top
    while len(out) < count:
        lo = max(2, hi - (1 << 16))
        sieve = np.ones(hi - lo, bool)
        for p in small:
            sieve[max(int(-lo % p), int(p * p - lo)) :: int(p)] = False
        out += [int(x) for x in (np.flatnonzero(sieve) + lo)[::-1]]
        if lo == 2:
            break
        hi = lo
    return out[:count]


def charpoly_mod(matrix: list[list[int]], p: int) -> list[int]:
    """Coefficients of det(xI - matrix) modulo p, from the constant up."""
    d = len(matrix)
    h = np.array([[x % p for x in row] for row in matrix], np.int64).reshape(d, d)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        i = m + int(below[0])
        h[[i, m]] = h[[m, i]]
        h[:, [i, m]] = h[:, [m, i]]
        u = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u % p).sum(axis=1)) % p
    polys = [np.array([1], np.int64)]
    for k in range(d):
        out = np.zeros(k + 2, np.int64)
        out[1:] = polys[k]
        out[:-1] = (out[:-1] - int(h[k, k]) * polys[k]) % p
        chain = 1
        for i in range(k - 1, -1, -1):
            chain = chain * int(h[i + 1, i]) % p
            if not chain:
                break
            out[: i + 1] = (out[: i + 1] - chain * int(h[i, k]) % p * polys[i]) % p
        polys.append(out)
    return [int(x) for x in polys[d]]


def coefficient_bits(trace: int, d: int) -> int:
    """Bits that hold any coefficient of the polynomial of a positive semidefinite matrix: the product of 1 + root is at most (1 + trace / d)^d."""
    return d * (1 + trace // d + 1).bit_length() + 2


def remaindered(residues: dict[int, list[int]]) -> list[int]:
    """The integers of least absolute value with these residues: prime -> a residue for each coefficient."""
    whole = reduce(lambda a, b: a * b, residues, 1)
    parts = [(p, whole // p * pow(whole // p, -1, p)) for p in residues]
    out = []
    for i in range(len(next(iter(residues.values())))):
        x = sum(residues[p][i] * unit for p, unit in parts) % whole
        out.append(x - whole if 2 * x > whole else x)
    return out


def _trim(a: list[int]) -> list[int]:
    while len(a) > 1 and a[-1] == 0:
        a = a[:-1]
    return a


def _primitive(a: list[int]) -> list[int]:
    g = reduce(gcd, a, 0) or 1
    return [x // g for x in (a if a[-1] > 0 else [-x for x in a])]


def _derivative(a: list[int]) -> list[int]:
    return [i * x for i, x in enumerate(a)][1:] or [0]


def _common(a: list[int], b: list[int]) -> list[int]:
    """The primitive greatest common divisor."""
    while b != [0]:
        r = a
        while len(r) >= len(b) and r != [0]:
            lead, shift = r[-1], len(r) - len(b)
            r = _trim([x * b[-1] - (lead * b[i - shift] if i >= shift else 0) for i, x in enumerate(r)][:-1] or [0])
        a, b = b, (_primitive(r) if r != [0] else r)
    return _primitive(a)


def _quotient(a: list[int], b: list[int]) -> list[int]:
    """a / b for a divisor b, as a primitive polynomial."""
    r, out = [Fraction(x) for x in a], []
    while len(r) >= len(b):
        f = r[-1] / b[-1]
        out.append(f)
        for i in range(1, len(b) + 1):
            r[-i] -= f * b[-i]
        r.pop()
    out.reverse()
    scale = reduce(lambda m, f: m * f.denominator // gcd(m, f.denominator), out, 1)
    return _primitive([int(f * scale) for f in out])


def _coprime_mod(a: list[int], p: int) -> bool:
    """Whether a has no repeated root modulo p (then it has none at all)."""
    x, y = [c % p for c in a], [c % p for c in _derivative(a)]
    if not x[-1] or not y[-1]:
        return False
    while y != [0]:
        inv = pow(y[-1], -1, p)
        while len(x) >= len(y) and x != [0]:
            f, shift = x[-1] * inv % p, len(x) - len(y)
            x = _trim([(c - (f * y[i - shift] if i >= shift else 0)) % p for i, c in enumerate(x)][:-1] or [0])
        x, y = y, x
    return len(x) == 1


def square_free(poly: list[int]) -> list[tuple[list[int], int]]:
    """(factor without repeated roots, its multiplicity): together the polynomial, up to a constant."""
    if len(poly) <= 1:
        return []
    if any(_coprime_mod(poly, p) for p in primes_below(1 << 31, 3)):
        return [(_primitive(poly), 1)]
    out, shared, k = [], _common(_primitive(poly), _primitive(_derivative(poly))), 1
    rest = _quotient(poly, shared)
    while len(rest) > 1:
        both = _common(rest, shared)
        once = _quotient(rest, both)
        if len(once) > 1:
            out.append((once, k))
        rest, shared, k = both, _quotient(shared, both), k + 1
    return out


@dataclass
class Root:
    """The root in (low, low + 1] / 2^scale of a factor without repeated roots; scale may be negative."""

    factor: list[int]
    times: int
    low: int
    scale: int
    end: int | None = None  # the factor's sign at the upper end

    def sign(self, m: int, s: int) -> int:
        """Of the factor at m / 2^s."""
        m, s, v = m << max(-s, 0), max(s, 0), 0
        for i, c in enumerate(reversed(self.factor)):
            v = v * m + (c << (s * i))
        return (v > 0) - (v < 0)

    def halve(self) -> None:
        if self.end is None:
            self.end = self.sign(self.low + 1, self.scale)
        m, self.scale = 2 * self.low + 1, self.scale + 1
        at = self.sign(m, self.scale)
        if self.end == 0 or (at and at != self.end):  # in the upper half, at its end maybe
            self.low = m
        else:
            self.low, self.end = m - 1, at

    def ends(self) -> tuple[Fraction, Fraction]:
        unit = Fraction(1, 1 << self.scale) if self.scale > 0 else Fraction(1 << -self.scale)
        return self.low * unit, (self.low + 1) * unit

    def mid(self) -> Fraction:
        return sum(self.ends()) / 2


def roots_above(poly: list[int], m: int, s: int) -> int:
    """How many roots of a polynomial with real roots only are greater than m / 2^s: the sign changes of its coefficients shifted there."""
    m, s, n = m << max(-s, 0), max(s, 0), len(poly) - 1
    a = [c << (s * (n - i)) for i, c in enumerate(poly)]
    for i in range(n):
        for j in range(n - 1, i - 1, -1):
            a[j] += m * a[j + 1]
    signs = [x > 0 for x in a if x]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def isolated(factor: list[int], times: int) -> Iterator[Root]:
    """A Root for each root of a factor whose roots are positive and differ."""
    scale = 0
    while roots_above(factor, 1, scale):
        scale -= 1
    todo = [(0, scale, len(factor) - 1, 0)]  # low, scale, roots above the lower end, roots above the upper end
    while todo:
        low, s, above, beyond = todo.pop()
        if above - beyond == 1:
            yield Root(factor, times, low, s)
        elif above > beyond:
            between = roots_above(factor, 2 * low + 1, s + 1)
            todo += [(2 * low, s + 1, above, between), (2 * low + 1, s + 1, between, beyond)]


def ranked_roots(poly: list[int], most: int) -> list[Root]:
    """The positive roots, largest first, until their multiplicities reach `most`; each is narrowed far below the gaps to its neighbours."""
    poly = _trim(poly)
    zeros = next(i for i, c in enumerate(poly) if c)
    roots = [r for f, k in square_free(poly[zeros:]) for r in isolated(f, k)]
    while True:
        roots.sort(key=Root.ends, reverse=True)
        close = {id(x): x for a, b in zip(roots, roots[1:], strict=False) if b.ends()[1] > a.ends()[0] for x in (a, b)}
        if not close:
            break
        for r in close.values():
            r.halve()
    out = []
    for i, r in enumerate(roots):
        if sum(x.times for x in out) >= most:
            break
        around = [x for x in (roots[i - 1] if i else None, roots[i + 1] if i + 1 < len(roots) else None) if x]
        while True:
            lo, hi = r.ends()
            room = min([hi, *(max(x.ends()[0] - hi, lo - x.ends()[1]) for x in around)])
            if room > 0 and (hi - lo) * (1 << NARROW) <= room:
                break
            for x in [r, *(around if room <= 0 else [])]:
                x.halve()
        out.append(r)
    return out


def null_space(matrix: list[list[int]], root: Fraction, times: int) -> list[list[float]]:
    """`times` orthogonal unit vectors of the eigenspace next to root: two steps of inverse iteration on eliminated fixed-point numbers."""
    d, bits = len(matrix), root.denominator.bit_length() + GUARD
    a = np.array([[x << bits for x in row] for row in matrix], object).reshape(d, d)
    a[range(d), range(d)] -= (root.numerator << bits) // root.denominator
    pivots, steps = [], []
    for k in range(d):
        i = k + max(range(d - k), key=lambda j: abs(a[k + j, k]))
        a[[i, k]] = a[[k, i]]
        pivots.append(i)
        a[k, k] = a[k, k] or 1  # the root itself: the least number stands for 0
        f = (a[k + 1 :, k] << bits) // a[k, k]
        a[k + 1 :, k + 1 :] -= np.multiply.outer(f, a[k, k + 1 :]) >> bits
        steps.append(f)

    def solved(b: np.ndarray) -> np.ndarray:
        b = b.copy()
        for k in range(d):
            b[[k, pivots[k]]] = b[[pivots[k], k]]
            b[k + 1 :] -= steps[k] * b[k] >> bits
        for k in range(d - 1, -1, -1):
            b[k] = ((b[k] - ((a[k, k + 1 :] * b[k + 1 :] >> bits).sum() if k + 1 < d else 0)) << bits) // a[k, k]
        shift = max(max(abs(x) for x in b).bit_length() - 2 * bits, 0)
        return b >> shift

    found: list[np.ndarray] = []
    for t in range(times):
        v = np.array([(((i + 1) * (2 * t + 3) ** 3 * 2654435761) % 1000003 - 500001) << bits for i in range(d)], object)
        for _ in range(2):
            v = solved(v)
            for _ in range(2):
                for u in found:
                    v = v - (u * (v * u).sum()) // (u * u).sum()
        found.append(v)
    out = []
    for v in found:
        big = max(v, key=abs)
        norm = isqrt(int((v * v).sum()))
        out.append([(int(x) if big > 0 else -int(x)) / norm for x in v])
    return out
