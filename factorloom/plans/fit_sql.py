"""Factorizations of rank 2 (or 1) in DuckDB SQL: the solver has a closed form there, so whole fits can be checked.

A coordinate descent that takes l1 from each step settles where the cross products, less l1 times the Gram matrix's diagonal, are met as
far as non-negative weights allow: for two factors that is one of four cases. All functions return common table expressions by name; a factor is a
table (id, a, b), and a matrix one of (row_id, col_id, v).
"""

from __future__ import annotations

_MOD = "18446744073709551616::UHUGEINT"


def hashed(name: str, pairs: str, seed: int) -> str:
    """name(s, f, x): the 64-bit hash of seed, s and f for a query of distinct pairs (s, f)."""
    up = lambda x, n: f"xor({x}, CAST(({x}::UHUGEINT * {1 << n} % {_MOD}) AS UBIGINT))"
    steps = [
        f"SELECT s, f, CAST(s AS UBIGINT) AS i, CAST(f AS UBIGINT) AS j FROM ({pairs})",
        f"SELECT s, f, {up('i', 19)} AS i, xor(j, j >> 7) AS j",
        f"SELECT s, f, xor(i, i >> 7) AS i, {up('j', 23)} AS j",
        f"SELECT s, f, {up('i', 36)} AS i, xor(j, j >> 8) AS j",
        f"SELECT s, f, CAST(((i::UHUGEINT + {seed}) % {_MOD}) AS UBIGINT) AS x, j",
        f"SELECT s, f, {up('x', 38)} AS x, j",
        "SELECT s, f, xor(x, x >> 13) AS x, j",
        f"SELECT s, f, {up('x', 23)} AS x, j",
        f"SELECT s, f, CAST(((x::UHUGEINT + j::UHUGEINT) % {_MOD}) AS UBIGINT) AS x",
        "SELECT s, f, xor(x, x >> 7) AS x",
        f"SELECT s, f, {up('x', 53)} AS x",
        "SELECT s, f, xor(x, x >> 4) AS x",
    ]
    names = [f"{name}_{k}" for k in range(len(steps) - 1)] + [name]
    return ", ".join(f"{n} AS ({s}{f' FROM {names[k - 1]}' if k else ''})" for k, (n, s) in enumerate(zip(names, steps)))


def start(name: str, ids: str, seed: int, rank: int = 2) -> str:
    """The uniform start; a second factor of zeros never leaves zero."""
    u = "SELECT s AS id, CAST(x AS DOUBLE) / 18446744073709551616 AS u FROM {}"
    out = hashed(f"{name}_a", f"SELECT id AS s, 0 AS f FROM ({ids})", seed) + ", " + hashed(f"{name}_b", f"SELECT id AS s, 1 AS f FROM ({ids})", seed)
    second = "y.u" if rank == 2 else "0.0::DOUBLE"
    return out + f", {name} AS MATERIALIZED (SELECT x.id, x.u AS a, {second} AS b FROM ({u.format(name + '_a')}) x JOIN ({u.format(name + '_b')}) y USING (id))"


def half(name: str, by: str, w: str, l1: float = 0.01, matrix: str = "a", link: str | None = None, extra: str | None = None, mask: str | None = None, products: str | None = None) -> str:
    """name: the solved side, unscaled. link(id, la, lb) shuts factors out, extra(id, ea, eb) adds l1, mask(s, f) leaves cells out (s: samples).

    products: a table (id, p, q) of cross products instead of those with w.
    """
    other, own, across = ("row_id", "s", "f") if by == "col_id" else ("col_id", "f", "s")
    cells = f"SELECT {by} AS id, {other} AS o, v FROM {matrix}"
    if mask:
        cells = f"SELECT c.id, c.o, CASE WHEN z.s IS NULL THEN c.v ELSE 0 END AS v FROM ({cells}) c LEFT JOIN {mask} z ON z.{own} = c.id AND z.{across} = c.o"
    lit, per = ("m11", "m12", "m22"), f"LEFT JOIN (SELECT z.{own} AS id, SUM(a * a) AS m11, SUM(a * b) AS m12, SUM(b * b) AS m22 FROM {mask} z JOIN {w} w ON w.id = z.{across} GROUP BY 1) m USING (id)" if mask else ""
    g = [f"g{x[1:]} - COALESCE({x}, 0)" if mask else f"g{x[1:]}" for x in lit]
    la, lb = ("la", "lb") if link else ("1", "1")
    ea, eb = ("ea", "eb") if extra else ("0", "0")
    return ", ".join([
        products.format(name=f"{name}_p") if products else f"{name}_p AS MATERIALIZED (SELECT c.id, SUM(v * a) AS p, SUM(v * b) AS q FROM ({cells}) c JOIN {w} w ON w.id = c.o GROUP BY 1)",
        f"{name}_g AS MATERIALIZED (SELECT SUM(a * a) + 1e-15 AS g11, SUM(a * b) AS g12, SUM(b * b) + 1e-15 AS g22 FROM {w})",
        f"{name}_s AS (SELECT id, p * {la} AS p, q * {lb} AS q, {g[0]} AS g11, {g[1]} AS g12, {g[2]} AS g22, {l1} + {ea} AS l1, {l1} + {eb} AS l2 FROM {name}_p CROSS JOIN {name}_g {per}"
        + (f" JOIN {link} USING (id)" if link else "") + (f" JOIN {extra} USING (id)" if extra else "") + ")",
        f"{name}_t AS (SELECT id, p - l1 * g11 AS p, q - l2 * g22 AS q, g11, g12, g22 FROM {name}_s)",
        f"{name}_u AS (SELECT *, (g22 * p - g12 * q) / (g11 * g22 - g12 * g12) AS x, (g11 * q - g12 * p) / (g11 * g22 - g12 * g12) AS y FROM {name}_t)",
        f"{name} AS MATERIALIZED (SELECT id, CASE WHEN x >= 0 AND y >= 0 THEN x WHEN x < 0 THEN 0 ELSE greatest(0, p / g11) END AS a, CASE WHEN x >= 0 AND y >= 0 THEN y WHEN x < 0 THEN greatest(0, q / g22) ELSE 0 END AS b FROM {name}_u)",
    ])


def unit(name: str, of: str) -> str:
    """name: the factor with unit sums; name_d(da, db): the sums."""
    return f"{name}_d AS MATERIALIZED (SELECT SUM(a) + 1e-15 AS da, SUM(b) + 1e-15 AS db FROM {of}), {name} AS MATERIALIZED (SELECT id, a / da AS a, b / db AS b FROM {of} CROSS JOIN {name}_d)"


def fit(iterations: int, matrix: str = "a", rank: int = 2, seed: int = 1, prefix: str = "", **options) -> str:
    """Factors {prefix}w{n} and {prefix}h{n} of each iteration, sums {prefix}w{n}_d. Penalties and links by keyword: h_ and w_ for either side, others for both."""
    for_side = lambda side: {k[2:] if k[:2] == f"{side}_" else k: v for k, v in options.items() if k[:2] not in ("h_", "w_") or k[:2] == f"{side}_"}
    out, w = [start(f"{prefix}w0", f"SELECT DISTINCT row_id AS id FROM {matrix}", seed, rank)], f"{prefix}w0"
    for n in range(1, iterations + 1):
        h = f"{prefix}h{n}"
        out += [half(f"{h}_raw", "col_id", w, matrix=matrix, **for_side("h")), unit(h, f"{h}_raw")]
        w = f"{prefix}w{n}"
        out += [half(f"{w}_raw", "row_id", h, matrix=matrix, **for_side("w")), unit(w, f"{w}_raw")]
    return ", ".join(out)


def factors(of: str, d: str, digits: int = 6) -> str:
    """(sample_id, factor, weight), factors in descending order of d."""
    one = "SELECT id AS sample_id, CAST({} AS INTEGER) AS factor, round(CASE WHEN (SELECT da >= db FROM {}) THEN {} ELSE {} END, {}) AS weight FROM {}"
    return one.format(0, d, "a", "b", digits, of) + " UNION ALL " + one.format(1, d, "b", "a", digits, of)


def test_error(h: str, w: str, mask: str, matrix: str = "a") -> str:
    """The mean over samples of the mean squared error at masked cells, as a scalar query."""
    return (
        f"(SELECT SUM(e) / (SELECT COUNT(*) FROM {h}) FROM (SELECT z.s, AVG(power(w.a * d.da * h.a + w.b * d.db * h.b - COALESCE(v, 0), 2)) AS e FROM {mask} z JOIN {h} h ON h.id = z.s JOIN {w} w ON w.id = z.f "
        f"CROSS JOIN {w}_d d LEFT JOIN {matrix} c ON c.col_id = z.s AND c.row_id = z.f GROUP BY 1))"
    )
