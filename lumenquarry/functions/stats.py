"""Statistics on small aggregates, without libraries beyond math."""

from __future__ import annotations

import math


def chi2_sf(x: float, dof: int) -> float:
    """P(X >= x) of a chi-squared variable: the regularised upper incomplete gamma function."""
    if x <= 0 or dof <= 0:
        return 1.0
    a, z = dof / 2, x / 2
    front = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - total * front)
    tiny = 1e-300
    b = z + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeom_sf(k: int, population: int, marked: int, drawn: int) -> float:
    """P(at least k marked among those drawn)."""
    top = min(marked, drawn)
    return min(1.0, sum(math.exp(_log_choose(marked, i) + _log_choose(population - marked, drawn - i) - _log_choose(population, drawn)) for i in range(max(k, drawn - population + marked, 0), top + 1)))


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2 x 2 table: all tables no likelier than this one."""
    rows, columns, n = a + b, a + c, a + b + c + d
    log_p = lambda x: _log_choose(columns, x) + _log_choose(n - columns, rows - x) - _log_choose(n, rows)
    here = log_p(a)
    return min(1.0, sum(math.exp(log_p(x)) for x in range(max(0, rows + columns - n), min(rows, columns) + 1) if log_p(x) <= here + 1e-7))


def ks_sf(d: float, n: int, m: int, exact_up_to: int = 10_000) -> float:
    """P(D >= d) of the two-sample statistic: by counting lattice paths for small samples, else the asymptotic series."""
    if d <= 0:
        return 1.0
    if n * m <= exact_up_to:
        limit = round(d * n * m)
        ways = [0.0] * (m + 1)
        for i in range(n + 1):
            for j in range(m + 1):
                if abs(i * m - j * n) >= limit:
                    ways[j] = 0.0
                elif i == 0 and j == 0:
                    ways[j] = 1.0
                else:
                    # Weights that make the sum of all paths 1: a share of what is left in each sample.
                    up = ways[j] * i / (i + j) if i else 0.0
                    side = ways[j - 1] * j / (i + j) if j else 0.0
                    ways[j] = up + side
        return min(1.0, max(0.0, 1 - ways[m]))
    x = d * math.sqrt(n * m / (n + m))
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def wilson(successes: int, n: int, z: float = 1.96) -> tuple[float, float]:
    if n == 0:
        return 0.0, 1.0
    p, w = successes / n, z * z / n
    middle, half = (p + w / 2) / (1 + w), z / (1 + w) * math.sqrt(p * (1 - p) / n + w / (4 * n))
    return middle - half, middle + half


def holm(ps: dict[str, float], alpha: float) -> set[str]:
    """The names whose hypotheses are rejected, step by step from the smallest p."""
    out: set[str] = set()
    for i, (name, p) in enumerate(sorted(ps.items(), key=lambda x: (x[1], x[0]))):
        if p > alpha / (len(ps) - i):
            break
        out.add(name)
    return out
