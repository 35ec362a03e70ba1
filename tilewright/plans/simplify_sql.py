"""SQL of the polyline simplifiers as recursions over the points of a series, written apart from the Spark operators."""

from __future__ import annotations

from .fixtures import SERIES


def _dist2(a: str, b: str, p: str, low: bool = True, high: bool = True) -> str:
    """Squared distance of p to the line through a and b, cut at a (low) and at b (high); names are prefixes of x and y."""
    cv = f"(({b}x - {a}x) ** 2 + ({b}y - {a}y) ** 2)"
    cw = f"(({p}x - {a}x) * ({b}x - {a}x) + ({p}y - {a}y) * ({b}y - {a}y))"
    t = f"CASE WHEN {cv} = 0 THEN 0.0 ELSE {cw} / {cv} END"
    t = f"greatest(0.0, {t})" if low else t
    t = f"least(1.0, {t})" if high else t
    return f"(({p}x - {a}x - ({t}) * ({b}x - {a}x)) ** 2 + ({p}y - {a}y - ({t}) * ({b}y - {a}y)) ** 2)"


HEAD = f"WITH RECURSIVE v AS MATERIALIZED ({SERIES}), l AS MATERIALIZED (SELECT key, max(ord) AS last FROM v GROUP BY 1)"
SMALL = "SELECT v.key, CAST(v.ord AS BIGINT) AS ord FROM v JOIN l ON l.key = v.key WHERE last < 2"
NEXT = "JOIN v ON v.key = r.key AND v.ord = r.ord + 1"


def _radial(tol: float, name: str) -> str:
    far = f"(v.x - kx) ** 2 + (v.y - ky) ** 2 >= {tol * tol}"
    return f"{name}(key, ord, kx, ky, kept) AS (SELECT key, ord, x, y, true FROM v WHERE ord = 0 UNION ALL SELECT v.key, v.ord, CASE WHEN {far} THEN v.x ELSE kx END, CASE WHEN {far} THEN v.y ELSE ky END, {far} FROM {name} r {NEXT})"


def radial(tol: float) -> str:
    return f"{HEAD}, {_radial(tol, 'r1')} SELECT r1.key, CAST(ord AS BIGINT) AS ord FROM r1 JOIN l ON l.key = r1.key WHERE kept OR ord = last"


def _perpendicular(tol: float, k: int, v: str) -> str:
    """Pass k over the points of v (key, n, ord, x, y), numbered by n from 0; its result is c{k}."""
    near = _dist2("k", "v.", "p") + f" < {tol * tol}"
    taken, moved = f"r.p IS NOT NULL AND {near}", f"r.p IS NOT NULL AND NOT ({near})"
    return f"""a{k}(key, n, kx, ky, p, px, py, out) AS (
SELECT s.key, 1, s.x, s.y, t.ord, t.x, t.y, CAST(s.ord AS INT) FROM {v} s JOIN {v} t ON t.key = s.key AND s.n = 0 AND t.n = 1
UNION ALL SELECT v.key, v.n, CASE WHEN {taken} THEN v.x WHEN {moved} THEN px ELSE kx END, CASE WHEN {taken} THEN v.y WHEN {moved} THEN py ELSE ky END,
CASE WHEN {taken} THEN NULL ELSE v.ord END, CASE WHEN {taken} THEN NULL ELSE v.x END, CASE WHEN {taken} THEN NULL ELSE v.y END,
CASE WHEN {taken} THEN v.ord WHEN {moved} THEN r.p END FROM a{k} r JOIN {v} v ON v.key = r.key AND v.n = r.n + 1),
b{k} AS (SELECT key, out AS ord FROM a{k} WHERE out IS NOT NULL UNION ALL SELECT key, p FROM (SELECT key, p, n = max(n) OVER (PARTITION BY key) AS at_end FROM a{k}) WHERE at_end AND p IS NOT NULL),
c{k} AS MATERIALIZED (SELECT v.key, CAST(row_number() OVER (PARTITION BY v.key ORDER BY v.ord) - 1 AS INT) AS n, v.ord, v.x, v.y FROM v JOIN (SELECT key, ord FROM b{k} UNION SELECT key, ord FROM {v} WHERE n = 0) b ON b.key = v.key AND b.ord = v.ord)"""


def perpendicular(tol: float, repeat: int) -> str:
    """Series of one or two points come out as they are: the first point, and the waiting second one."""
    passes = ", ".join(_perpendicular(tol, k, f"c{k - 1}") for k in range(1, repeat + 1))
    return f"{HEAD}, c0 AS MATERIALIZED (SELECT key, ord AS n, ord, x, y FROM v), {passes} SELECT key, CAST(ord AS BIGINT) AS ord FROM c{repeat}"


def reumann(tol: float) -> str:
    inside = _dist2("k", "p", "v.", False, False) + f" < {tol * tol}"
    pick = lambda yes, no: f"CASE WHEN {inside} THEN {yes} ELSE {no} END"
    return f"""{HEAD}, r1(key, ord, kx, ky, px, py, j, jx, jy, out) AS (
SELECT a.key, b.ord, a.x, a.y, b.x, b.y, b.ord, b.x, b.y, CAST(0 AS INT) FROM v a JOIN v b ON b.key = a.key AND a.ord = 0 AND b.ord = 1 JOIN l ON l.key = a.key AND last >= 2
UNION ALL SELECT v.key, v.ord, {pick("kx", "jx")}, {pick("ky", "jy")}, {pick("px", "v.x")}, {pick("py", "v.y")}, v.ord, v.x, v.y, {pick("NULL", "j")} FROM r1 r {NEXT})
SELECT key, CAST(out AS BIGINT) AS ord FROM r1 WHERE out IS NOT NULL UNION ALL SELECT r1.key, CAST(j AS BIGINT) FROM r1 JOIN l ON l.key = r1.key AND r1.ord = last UNION ALL {SMALL}"""


def opheim(least: float, most: float) -> str:
    d = "(v.x - kx) ** 2 + (v.y - ky) ** 2"
    close = f"(qx IS NULL AND {d} < {least * least})"
    ray = _dist2("k", "#", "v.", True, False).replace("#x", "coalesce(qx, jx)").replace("#y", "coalesce(qy, jy)")
    inside = f"({d} < {most * most} AND {ray} < {least * least})"
    pick = lambda a, b, c: f"CASE WHEN {close} THEN {a} WHEN {inside} THEN {b} ELSE {c} END"
    return f"""{HEAD}, r1(key, ord, kx, ky, qx, qy, j, jx, jy, out) AS (
SELECT a.key, b.ord, a.x, a.y, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), b.ord, b.x, b.y, CAST(0 AS INT) FROM v a JOIN v b ON b.key = a.key AND a.ord = 0 AND b.ord = 1 JOIN l ON l.key = a.key AND last >= 2
UNION ALL SELECT v.key, v.ord, {pick("kx", "kx", "jx")}, {pick("ky", "ky", "jy")}, {pick("qx", "coalesce(qx, jx)", "NULL")}, {pick("qy", "coalesce(qy, jy)", "NULL")}, v.ord, v.x, v.y, {pick("NULL", "NULL", "j")} FROM r1 r {NEXT})
SELECT key, CAST(out AS BIGINT) AS ord FROM r1 WHERE out IS NOT NULL UNION ALL SELECT r1.key, CAST(j AS BIGINT) FROM r1 JOIN l ON l.key = r1.key AND r1.ord = last UNION ALL {SMALL}"""


def lang(tol: float, ahead: int) -> str:
    return f"""{HEAD}, w AS (SELECT a.key, a.ord AS at, b.ord AS upto, max({_dist2("a.", "b.", "p.")}) AS worst FROM v a JOIN v b ON b.key = a.key AND b.ord BETWEEN a.ord + 2 AND a.ord + {ahead} JOIN v p ON p.key = a.key AND p.ord > a.ord AND p.ord < b.ord GROUP BY 1, 2, 3),
n AS MATERIALIZED (SELECT v.key, v.ord AS at, coalesce(max(upto), v.ord + 1) AS upto FROM v LEFT JOIN w ON w.key = v.key AND w.at = v.ord AND worst < {tol * tol} GROUP BY v.key, v.ord),
r1(key, ord) AS (SELECT key, 0 FROM v WHERE ord = 0 UNION ALL SELECT n.key, n.upto FROM r1 JOIN n ON n.key = r1.key AND n.at = r1.ord JOIN l ON l.key = n.key AND n.upto <= last)
SELECT r1.key, CAST(ord AS BIGINT) AS ord FROM r1 JOIN l ON l.key = r1.key WHERE last >= 2 UNION ALL {SMALL}"""


def _furthest(points: str) -> str:
    """The furthest inner point k and its distance d of each pair of points (key, n, x, y)."""
    d = _dist2("a.", "b.", "p.")
    return f"f AS MATERIALIZED (SELECT key, a, b, arg_max(n, (d, -n)) AS k, max(d) AS d FROM (SELECT a.key, a.n AS a, b.n AS b, p.n AS n, {d} AS d FROM {points} a JOIN {points} b ON b.key = a.key AND b.n > a.n + 1 JOIN {points} p ON p.key = a.key AND p.n > a.n AND p.n < b.n) GROUP BY 1, 2, 3)"


def douglas_peucker(tol: float) -> str:
    """After the radial pass, all pairs' furthest points first, then the splits as a recursion."""
    return f"""{HEAD}, {_radial(tol, 'r1')}, q AS MATERIALIZED (SELECT v.key, CAST(row_number() OVER (PARTITION BY v.key ORDER BY v.ord) - 1 AS INT) AS n, v.ord, v.x, v.y FROM v JOIN r1 ON r1.key = v.key AND r1.ord = v.ord JOIN l ON l.key = v.key WHERE kept OR v.ord = last),
{_furthest("q")}, s(key, a, b) AS (SELECT key, 0, max(n) FROM q GROUP BY 1 UNION ALL SELECT s.key, CASE WHEN h.i = 0 THEN s.a ELSE f.k END, CASE WHEN h.i = 0 THEN f.k ELSE s.b END FROM s JOIN f ON f.key = s.key AND f.a = s.a AND f.b = s.b AND f.d > {tol * tol}, range(2) h(i)),
e AS (SELECT key, a AS n FROM s UNION SELECT key, b FROM s) SELECT q.key, CAST(q.ord AS BIGINT) AS ord FROM q JOIN e ON e.key = q.key AND e.n = q.n"""


def douglas_peucker_n(n: int) -> str:
    """The furthest point of any open segment, n - 2 times."""
    steps = ["s0 AS (SELECT key, 0 AS a, last AS b FROM l)"]
    picks = []
    for i in range(n - 2):
        steps.append(f"p{i} AS (SELECT key, arg_min((a, b, k), (-d, k)) AS s FROM s{i} JOIN f USING (key, a, b) WHERE d > 0 GROUP BY 1)")
        steps.append(f"s{i + 1} AS (SELECT s.key, s.a, s.b FROM s{i} s LEFT JOIN p{i} p ON p.key = s.key AND p.s[1] = s.a AND p.s[2] = s.b WHERE p.key IS NULL UNION ALL SELECT key, s[1], s[3] FROM p{i} UNION ALL SELECT key, s[3], s[2] FROM p{i})")
        picks.append(f"SELECT key, s[3] AS ord FROM p{i}")
    few = f"SELECT v.key, CAST(v.ord AS BIGINT) AS ord FROM v JOIN l ON l.key = v.key WHERE last < {n}"
    return f"{HEAD}, u AS MATERIALIZED (SELECT key, ord AS n, x, y FROM v), {_furthest('u')}, {', '.join(steps)}, e AS ({' UNION '.join(picks)} UNION SELECT key, last FROM l UNION SELECT key, 0 FROM l) SELECT e.key, CAST(ord AS BIGINT) AS ord FROM e JOIN l ON l.key = e.key WHERE last >= {n} UNION ALL {few}"
