"""The registered queries in plain SQL, written from their definitions and not from the Spark plans.

Cells are compared as whole vectors here: where the engine keeps running sums over changes, the SQL adds
up complete vectors for every pair of a round start and a slot.
"""

from __future__ import annotations

from itertools import combinations

from driftgate.functions.keys import PRIME
from driftgate.plans.queries import DAY, EPS, HOUR, KS, LATE_DAYS, SHAPE, SITES, TYPES, WARM_DAYS
from driftgate.sources.synthetic import _draw_coefficients

P, D, W = PRIME, SHAPE.depth, SHAPE.width
QUORUM = (D + 1) // 2
MQF = 0.01


def _r(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


def _dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


_CODE = "CASE event_type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(TYPES)) + " END"

EV = f"""ev AS (
  SELECT event_id, event_id % {SITES} AS site, (epoch_us(ts) // 1000) AS ts_ms, user_id AS a,
         CAST({_CODE} AS BIGINT) AS b, (31 * user_id + CAST({_CODE} AS BIGINT)) % {P} AS x,
         CAST(1.0 AS DOUBLE) AS val, event_type,
         (epoch_us(ts) // 1000) // {DAY} AS slot,
         (epoch_us(ts) // 1000) // {DAY} - (SELECT min((epoch_us(ts) // 1000)) // {DAY} FROM events) AS day
  FROM events)"""

SEEDS = "seeds(d, c0, c1, c2, c3, c4, c5) AS (VALUES " + ", ".join(
    f"({d}::BIGINT, " + ", ".join(f"{c}::BIGINT" for c in coeff) + ")" for d, coeff in enumerate(SHAPE.coefficients())
) + ")"


def _hit(x: str) -> tuple[str, str]:
    bucket = f"(({x} * c0 + c1) % {P}) % {W}"
    cubic = f"(((((c2 * {x} + c3) % {P}) * {x} + c4) % {P}) * {x} + c5) % {P}"
    return bucket, f"(1 - 2 * (({cubic}) % 2))"


def cells(name: str, source: str, by: str, value: str = "v", x: str = "x", where: str = "true") -> str:
    """CTE: the sketch of ``source`` per ``by``; needs the seeds CTE."""
    bucket, sgn = _hit(x)
    lead = f"{by}, " if by else ""
    return f"""{name} AS (
  SELECT {lead}d, {bucket} AS w, CAST(sum(val * {sgn}) AS DOUBLE) AS {value}
  FROM {source}, seeds WHERE {where} GROUP BY ALL)"""


def _with(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"


SKETCHED = _with(EV, SEEDS, cells("s", "ev", "site"))
VEC = "v AS (SELECT site, x, sum(val) AS v FROM ev GROUP BY ALL)"
EXACT_PARTS = (
    EV,
    f"e AS (SELECT x, sum(val) / {SITES} AS e FROM ev WHERE day < {WARM_DAYS} GROUP BY x)",
    f"dr AS (SELECT site, slot, x, sum(val) AS v FROM ev WHERE day >= {WARM_DAYS} GROUP BY ALL)",
    "g AS (SELECT DISTINCT site, slot FROM dr)",
)
SKETCH_PARTS = (
    EV,
    SEEDS,
    cells("e0", "ev", "", where=f"day < {WARM_DAYS}"),
    f"e AS (SELECT d, w, v / {SITES} AS e FROM e0)",
    cells("dr", "ev", "site, slot", where=f"day >= {WARM_DAYS}"),
    "g AS (SELECT DISTINCT site, slot FROM dr)",
)


def quorum_ctes(rows: str, by: str, out: str, k: int, n: int, eikonal: bool = True) -> list[str]:
    """``rows (by, d, ref, z)`` to ``out (by, score)`` by the k-of-n rule."""
    legal = f"{out}_legal AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY d) AS i, count(*) OVER (PARTITION BY {by}) AS l FROM {rows} WHERE ref > 0)"
    if not eikonal:
        ranked = f"{out}_ranked AS (SELECT {by}, l, ref * z AS p, row_number() OVER (PARTITION BY {by} ORDER BY ref * z) AS j FROM {out}_legal)"
        return [legal, ranked, f"{out} AS (SELECT {by}, sum(p) AS score FROM {out}_ranked WHERE j <= l - {k} + 1 GROUP BY ALL)"]
    picks, number = [], 0
    for size in range(k, n + 1):
        for pick in combinations(range(1, size + 1), size - k + 1):
            picks += [f"({size}, {number}, {i})" for i in pick]
            number += 1
    return [
        f"{out}_pick(l, p, i) AS (VALUES {', '.join(picks)})",
        legal,
        f"{out}_each AS (SELECT {by}, p, sum(ref * z) / sqrt(sum(ref * ref)) AS score FROM {out}_legal JOIN {out}_pick USING (l, i) GROUP BY ALL)",
        f"{out} AS (SELECT {by}, min(score) AS score FROM {out}_each GROUP BY ALL)",
    ]


def f2_rows(drift: str, scale: float = 1.0) -> list[str]:
    """CTEs: for every group of g and row d the whole vector E+X against the zone of e."""
    return [
        "en AS (SELECT d, sqrt(sum(e * e)) AS n, sum(e * e) AS n2 FROM e GROUP BY d)",
        "f AS (SELECT list_sort(list(n2))[len(list(n)) // 2 + 1] AS f2 FROM en)",
        f"""whole AS (
  SELECT site, slot, d, w, sum(e) AS e, sum(e) + sum(v) AS xe FROM (
    SELECT g.site, g.slot, e.d, e.w, e.e, CAST(0 AS DOUBLE) AS v FROM g, e
    UNION ALL SELECT site, slot, d, w, CAST(0 AS DOUBLE), v * {_dbl(scale)} FROM {drift})
  GROUP BY ALL)""",
        "rs AS (SELECT site, slot, d, sqrt(sum(xe * xe)) AS nx, sum(xe * e) AS dot FROM whole GROUP BY ALL)",
        f"""up AS (SELECT site, slot, d, sqrt((1 + {_dbl(EPS)}) * f2) - n AS ref, sqrt((1 + {_dbl(EPS)}) * f2) - nx AS z
  FROM rs JOIN en USING (d), f)""",
        f"""lo AS (SELECT site, slot, d, n - sqrt((1 - {_dbl(EPS)}) * f2) AS ref, dot / n - sqrt((1 - {_dbl(EPS)}) * f2) AS z
  FROM rs JOIN en USING (d), f)""",
    ]


def _zone_f2(side: str, scale: float = 1.0) -> str:
    ctes = [*SKETCH_PARTS, *f2_rows("dr", scale)]
    ctes += quorum_ctes("up", "site, slot", "qu", QUORUM, D) + quorum_ctes("lo", "site, slot", "ql", QUORUM, D)
    phi = {"upper": "qu.score", "lower": "ql.score", "both": "least(qu.score, ql.score)"}[side]
    return _with(*ctes) + f"SELECT site, slot, {_r(f'{phi} / {_dbl(scale)}', 'phi')} FROM qu JOIN ql USING (site, slot)"


def _zone_cap(sign: str) -> str:
    eps = _dbl(EPS)
    return _with(
        *EXACT_PARTS,
        "n AS (SELECT sqrt(sum(e * e)) AS n FROM e)",
        """whole AS (SELECT site, slot, x, sum(e) AS e, sum(v) AS v FROM (
  SELECT g.site, g.slot, e.x, e.e, CAST(0 AS DOUBLE) AS v FROM g, e
  UNION ALL SELECT site, slot, x, CAST(0 AS DOUBLE), v FROM dr) GROUP BY ALL)""",
        "rs AS (SELECT site, slot, sqrt(sum((e + v) * (e + v))) AS ne, sum(e * v) AS dot FROM whole GROUP BY ALL)",
    ) + f"SELECT site, slot, {_r(f'{sign}least((1 + {eps}) * n - ne, dot / n + {eps} * n)', 'phi')} FROM rs, n"


# -- hyperbola ------------------------------------------------------------------------------------


def nearest_ctes(points: str, out: str) -> list[str]:
    """``points (id, p, q, t)`` with t > 0 to ``out (id, near)``: the multiplier of the constraint, by halving.

    At the nearest point of ``y^2 - x^2 = t`` some m gives ``x = p / (1 + m), y = q / (1 - m)``: between -1 and 1 for
    q > 0, beyond 1 (written 1 / m) for q < 0. The residual ``y^2 - x^2 - t`` then rises or falls through zero once.
    """
    m = "CASE WHEN q > 0 THEN (lo + hi) / 2 ELSE 2 / (lo + hi) END"
    residual = f"(q / (1 - ({m}))) ** 2 - (p / (1 + ({m}))) ** 2 - t"
    return [
        f"""{out}_b(id, p, q, t, lo, hi, n) AS (
  SELECT id, p, q, t, CASE WHEN q > 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END, CAST(1 AS DOUBLE), 0
  FROM {points} WHERE p <> 0 AND q <> 0
  UNION ALL
  SELECT id, p, q, t, CASE WHEN {residual} < 0 THEN (lo + hi) / 2 ELSE lo END,
    CASE WHEN {residual} < 0 THEN hi ELSE (lo + hi) / 2 END, n + 1
  FROM {out}_b WHERE n < 64)""",
        f"""{out} AS (
  SELECT id, p / (1 + ({m})) AS near FROM {out}_b WHERE n = 64
  UNION ALL
  SELECT id, CASE WHEN p = 0 THEN sqrt(greatest(q * q / 4 - t, 0)) * CAST(q > 0 AS INTEGER) ELSE p / 2 END
  FROM {points} WHERE p = 0 OR q = 0)""",
    ]


def hyperbola_ctes(points: str, out: str) -> list[str]:
    """``points (id, xi, psi, t, x, y)`` to ``out (id, score)``."""
    pos, neg = f"{out}_p", f"{out}_n"
    return [
        f"{pos} AS (SELECT id, y AS p, x * (CASE WHEN xi >= 0 THEN 1 ELSE -1 END) AS q, t FROM {points} WHERE t > 0)",
        *nearest_ctes(pos, f"{pos}n"),
        f"{neg} AS (SELECT id, xi AS p, abs(psi) AS q, -t AS t FROM {points} WHERE t < 0)",
        *nearest_ctes(neg, f"{neg}n"),
        f"""{out} AS (
  SELECT id, (CASE WHEN q >= sqrt(p * p + t) THEN 1 ELSE -1 END)
           * sqrt((q - sqrt(near * near + t)) ** 2 + (p - near) ** 2) AS score
  FROM {pos} JOIN {pos}n USING (id)
  UNION ALL
  SELECT m.id, (near * m.x - sqrt(near * near - m.t) * abs(m.y) - m.t) / sqrt(2 * near * near - m.t)
  FROM {points} m JOIN {neg}n USING (id)
  UNION ALL
  SELECT id, (x * (CASE WHEN xi >= 0 THEN 1 ELSE -1 END) - abs(y)) / sqrt(CAST(2 AS DOUBLE)) FROM {points} WHERE t = 0)""",
    ]


def _zone_join() -> str:
    root = "sqrt(CAST(0.5 AS DOUBLE))"
    parts = [EV.replace("ev AS (", "ev0 AS ("), "ev AS (SELECT site, slot, day, b, a AS x, val FROM ev0)", SEEDS]
    for name, b in (("a", 1), ("b", 2)):
        parts.append(cells(f"e{name}", "ev", "", where=f"b = {b} AND day < {WARM_DAYS}"))
        parts.append(cells(f"d{name}", "ev", "site, slot", where=f"b = {b} AND day >= {WARM_DAYS}"))
    parts += [
        f"""e AS (SELECT d, w, sum(x) / {SITES} AS x, sum(y) / {SITES} AS y FROM (
  SELECT d, w, v AS x, v AS y FROM ea UNION ALL SELECT d, w, v, -v FROM eb) GROUP BY ALL)""",
        "en AS (SELECT d, sqrt(sum(x * x)) AS nx, sqrt(sum(y * y)) AS ny FROM e GROUP BY d)",
        "pr AS (SELECT list_sort(list((nx * nx - ny * ny) / 4))[len(list(nx)) // 2 + 1] AS size FROM en)",
        f"zt AS (SELECT 4 * (size - {_dbl(EPS)} * abs(size)) AS tl, -4 * (size + {_dbl(EPS)} * abs(size)) AS th FROM pr)",
        "g AS (SELECT site, slot FROM da UNION SELECT site, slot FROM db)",
        """whole AS (SELECT site, slot, d, w, sum(ex) AS ex, sum(ey) AS ey, sum(ex) + sum(x) AS x, sum(ey) + sum(y) AS y FROM (
  SELECT g.site, g.slot, e.d, e.w, e.x AS ex, e.y AS ey, CAST(0 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y FROM g, e
  UNION ALL SELECT site, slot, d, w, 0, 0, v, v FROM da
  UNION ALL SELECT site, slot, d, w, 0, 0, v, -v FROM db) GROUP BY ALL)""",
        """rs AS (SELECT site, slot, d, sum(x * ex) AS dx, sum(y * ey) AS dy, sqrt(sum(x * x)) AS lx, sqrt(sum(y * y)) AS ly
  FROM whole GROUP BY ALL)""",
        """points AS (
  SELECT {'k': 'l', 'site': site, 'slot': slot, 'd': d} AS id, nx AS xi, ny AS psi, tl AS t, dx / nx AS x, ly AS y FROM rs JOIN en USING (d), zt
  UNION ALL SELECT {'k': 'u', 'site': site, 'slot': slot, 'd': d}, ny, nx, th, dy / ny, lx FROM rs JOIN en USING (d), zt
  UNION ALL SELECT {'k': 'L', 'site': 0, 'slot': 0, 'd': d}, nx, ny, tl, nx, ny FROM en, zt
  UNION ALL SELECT {'k': 'U', 'site': 0, 'slot': 0, 'd': d}, ny, nx, th, ny, nx FROM en, zt)""",
        *hyperbola_ctes("points", "h"),
        f"""lo AS (SELECT h.id.site AS site, h.id.slot AS slot, h.id.d AS d, r.score * {root} AS ref, h.score * {root} AS z
  FROM h JOIN h r ON r.id.d = h.id.d AND r.id.k = 'L' WHERE h.id.k = 'l')""",
        f"""up AS (SELECT h.id.site AS site, h.id.slot AS slot, h.id.d AS d, r.score * {root} AS ref, h.score * {root} AS z
  FROM h JOIN h r ON r.id.d = h.id.d AND r.id.k = 'U' WHERE h.id.k = 'u')""",
        *quorum_ctes("lo", "site, slot", "ql", QUORUM, D),
        *quorum_ctes("up", "site, slot", "qu", QUORUM, D),
    ]
    return _with(*parts, recursive=True) + (
        f"SELECT site, slot, {_r('least(ql.score, qu.score)', 'phi')} FROM ql JOIN qu USING (site, slot)"
    )


# -- the gate -------------------------------------------------------------------------------------


def _signed(by: str, window_days: int | None) -> str:
    """CTE: cell changes per (site, slot), with the withdrawals of a window."""
    base = f"SELECT site, slot, {by}, v FROM delta0"
    if window_days:
        base += f" UNION ALL SELECT site, slot + {window_days}, {by}, -v FROM delta0"
    return f"delta AS (SELECT site, slot, {by}, sum(v) AS v FROM ({base}) GROUP BY ALL)"


def _ev(k: int) -> str:
    return EV.replace(f"event_id % {SITES} AS site", f"event_id % {k} AS site")


def _walk(phi_ctes: list[str], rebalance: bool, k: int = SITES) -> str:
    """Replay of the protocol over slots.

    Needs ``start (r, phi0, f2)`` per possible round start and ``ph (r, b, s, phis)``: phi of all sites at slot
    s for drifts since b under the estimate of r; with rebalancing also ``bal (r, b, psi_beta)``.
    """
    lam = "CASE WHEN b = r THEN CAST(1 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END"
    fill = lambda expr: f"list_transform(range({k}), lambda i: {expr})"
    psi_beta = "coalesce((SELECT psi_beta FROM bal WHERE bal.r = n.r AND bal.b = n.b), CAST(0 AS DOUBLE))" if rebalance else "CAST(0 AS DOUBLE)"
    fresh_beta = "(SELECT psi_beta FROM bal WHERE bal.r = n.r AND bal.b = n.s)" if rebalance else "CAST(0 AS DOUBLE)"
    return _with(
        *phi_ctes,
        f"""walk(s, rnd, r, b, q, z, c, growth, emitted) AS (
  SELECT warm, 1, warm, warm, phi0 / 2, {fill('phi0')}, {fill('CAST(0 AS BIGINT)')}, CAST(0 AS BIGINT), true
  FROM warm JOIN start ON r = warm
  UNION ALL
  SELECT s, CASE WHEN fate = 2 THEN rnd + 1 ELSE rnd END,
    CASE WHEN fate = 2 THEN s ELSE r END,
    CASE WHEN fate >= 2 THEN s ELSE b END,
    CASE fate WHEN 0 THEN q WHEN 1 THEN budget / {2 * k} WHEN 2 THEN phi0_s / 2 ELSE fresh / {2 * k} END,
    CASE fate WHEN 0 THEN z WHEN 1 THEN phis WHEN 2 THEN {fill('phi0_s')} ELSE {fill('phi0 / 2')} END,
    CASE fate WHEN 0 THEN c2 ELSE {fill('CAST(0 AS BIGINT)')} END,
    CASE fate WHEN 0 THEN growth ELSE 0 END,
    fate = 2
  FROM (
    SELECT *, CASE WHEN growth <= {k} THEN 0
                   WHEN budget >= {_dbl(MQF)} * {k} * phi0 THEN 1
                   WHEN {'b = r' if rebalance else 'false'} AND fresh >= {_dbl(MQF)} * {k} * phi0 THEN 3
                   ELSE 2 END AS fate
    FROM (
      SELECT n.*, list_sum(phis) + {psi_beta} AS budget, {k} * phi0 / 2 + {fresh_beta} AS fresh FROM (
        SELECT walk.s + 1 AS s, rnd, walk.r, walk.b, q, z, st.phi0, sn.phi0 AS phi0_s, ph.phis,
          {fill('greatest(c[i + 1], CAST(trunc((z[i + 1] - ph.phis[i + 1]) / q) AS BIGINT))')} AS c2,
          growth + list_sum({fill('greatest(0, CAST(trunc((z[i + 1] - ph.phis[i + 1]) / q) AS BIGINT) - c[i + 1])')}) AS growth
        FROM walk
        JOIN ph ON ph.r = walk.r AND ph.b = walk.b AND ph.s = walk.s + 1
        JOIN start st ON st.r = walk.r JOIN start sn ON sn.r = walk.s + 1) n)))""",
        recursive=True,
    )


def _monitor_parts(kind: str, window_days: int | None, rebalance: bool, k: int = SITES) -> list[str]:
    """CTEs warm, start, ph (and bal) of the exact or the sketch form."""
    by = "x" if kind == "exact" else "d, w"
    eps = _dbl(EPS)
    if kind == "exact":
        parts = [_ev(k), "delta0 AS (SELECT site, slot, x, sum(val) AS v FROM ev GROUP BY ALL)"]
    else:
        parts = [_ev(k), SEEDS, cells("delta0", "ev", "site, slot")]
    span = "r = b OR r < b" if rebalance else "r = b"
    on_k = ", ".join(f"k.{c}" for c in by.split(", "))
    same = " AND ".join(f"delta.{c} = k.{c}" for c in by.split(", "))
    parts += [
        _signed(by, window_days),
        f"warm AS (SELECT min(slot) + {WARM_DAYS - 1} AS warm, max(slot) AS top FROM ev)",
        "slots AS (SELECT unnest(range(warm, top + 1)) AS s FROM warm)",
        f"keys AS (SELECT DISTINCT {by} FROM delta)",
        f"""cum AS (SELECT k.s, k.site, {on_k}, coalesce(sum(v), 0) AS v
  FROM (SELECT s, site, {by} FROM slots, range({k}) q(site), keys) AS k
  LEFT JOIN delta ON delta.site = k.site AND delta.slot <= k.s AND {same} GROUP BY ALL)""",
        f"est AS (SELECT s AS r, {by}, sum(v) / {k} AS e FROM cum GROUP BY ALL)",
        f"trip AS (SELECT a.s AS r, m.s AS b, z.s AS s FROM slots a, slots m, slots z WHERE a.s <= m.s AND m.s < z.s AND (m.s = a.s {'OR true' if rebalance else ''}))",
    ]
    scale = "CASE WHEN t.b = t.r THEN CAST(1 AS DOUBLE) ELSE CAST(2 AS DOUBLE) END"
    if kind == "exact":
        parts += [
            "start AS (SELECT r, sum(e * e) AS f2, " + f"{eps} * sqrt(sum(e * e)) AS phi0 FROM est GROUP BY r)",
            f"""sums AS (SELECT t.r, t.b, t.s, c.site, {scale} AS m,
    sqrt(sum((e + {scale} * (c.v - p.v)) ** 2)) AS ne, sum({scale} * (c.v - p.v) * e) AS dot
  FROM trip t JOIN cum c ON c.s = t.s JOIN cum p ON p.s = t.b AND p.site = c.site AND p.x = c.x
  JOIN est ON est.r = t.r AND est.x = c.x GROUP BY ALL)""",
            f"""ph1 AS (SELECT r, b, s, site,
    least((1 + {eps}) * sqrt(f2) - ne, dot / sqrt(f2) + {eps} * sqrt(f2)) / m AS phi
  FROM sums JOIN start USING (r))""",
        ]
    else:
        parts += [
            "en AS (SELECT r, d, sqrt(sum(e * e)) AS n, sum(e * e) AS n2 FROM est GROUP BY ALL)",
            "f AS (SELECT r, list_sort(list(n2))[len(list(n)) // 2 + 1] AS f2 FROM en GROUP BY r)",
            f"""zu AS (SELECT r, d, sqrt((1 + {eps}) * f2) - n AS ref, sqrt((1 + {eps}) * f2) - n AS z FROM en JOIN f USING (r))""",
            f"""zl AS (SELECT r, d, n - sqrt((1 - {eps}) * f2) AS ref, n - sqrt((1 - {eps}) * f2) AS z FROM en JOIN f USING (r))""",
            *quorum_ctes("zu", "r", "z0u", QUORUM, D),
            *quorum_ctes("zl", "r", "z0l", QUORUM, D),
            "start AS (SELECT r, f2, least(z0u.score, z0l.score) AS phi0 FROM f JOIN z0u USING (r) JOIN z0l USING (r))",
            f"""sums AS (SELECT t.r, t.b, t.s, c.site, c.d, {scale} AS m,
    sqrt(sum((e + {scale} * (c.v - p.v)) ** 2)) AS ne, sum((e + {scale} * (c.v - p.v)) * e) AS dot
  FROM trip t JOIN cum c ON c.s = t.s JOIN cum p ON p.s = t.b AND p.site = c.site AND p.d = c.d AND p.w = c.w
  JOIN est ON est.r = t.r AND est.d = c.d AND est.w = c.w GROUP BY ALL)""",
            f"""ru AS (SELECT r, b, s, site, m, d, ref, sqrt((1 + {eps}) * f2) - ne AS z
  FROM sums JOIN f USING (r) JOIN zu USING (r, d))""".replace("d, ref, sqrt", "d, zu.ref, sqrt"),
            f"""rl AS (SELECT r, b, s, site, m, d, zl.ref, dot / n - sqrt((1 - {eps}) * f2) AS z
  FROM sums JOIN f USING (r) JOIN zl USING (r, d) JOIN en USING (r, d))""",
            *quorum_ctes("ru", "r, b, s, site, m", "pu", QUORUM, D),
            *quorum_ctes("rl", "r, b, s, site, m", "pl", QUORUM, D),
            "ph1 AS (SELECT r, b, s, site, least(pu.score, pl.score) / m AS phi FROM pu JOIN pl USING (r, b, s, site, m))",
        ]
    parts.append("ph AS (SELECT r, b, s, list(phi ORDER BY site) AS phis FROM ph1 GROUP BY ALL)")
    if rebalance:
        parts += _balance_parts(kind)
    return parts


def _balance_parts(kind: str) -> list[str]:
    """CTE bal: (1-lam)k * phi(B / ((1-lam)k)) for every round start r and rebalance slot b."""
    eps, mu = _dbl(EPS), _dbl(0.5 * SITES)
    keys = "x" if kind == "exact" else "d, w"
    both = " AND ".join(f"est.{c.strip()} = g.{c.strip()}" for c in keys.split(","))
    head = [
        f"tot AS (SELECT s, {keys}, sum(v) AS v FROM cum GROUP BY ALL)",
        f"gap AS (SELECT p.s AS r, c.s AS b, {keys}, (c.v - p.v) / {mu} AS v FROM tot p JOIN tot c USING ({keys}) WHERE p.s < c.s)",
    ]
    if kind == "exact":
        return head + [
            f"bsum AS (SELECT g.r, g.b, sqrt(sum((e + v) ** 2)) AS ne, sum(v * e) AS dot FROM gap g JOIN est ON est.r = g.r AND {both} GROUP BY ALL)",
            f"bal AS (SELECT r, b, {mu} * least((1 + {eps}) * sqrt(f2) - ne, dot / sqrt(f2) + {eps} * sqrt(f2)) AS psi_beta FROM bsum JOIN start USING (r))",
        ]
    return head + [
        f"bsum AS (SELECT g.r, g.b, g.d, sqrt(sum((e + v) ** 2)) AS ne, sum((e + v) * e) AS dot FROM gap g JOIN est ON est.r = g.r AND {both} GROUP BY ALL)",
        f"bu AS (SELECT r, b, d, zu.ref, sqrt((1 + {eps}) * f2) - ne AS z FROM bsum JOIN f USING (r) JOIN zu USING (r, d))",
        f"bl AS (SELECT r, b, d, zl.ref, dot / n - sqrt((1 - {eps}) * f2) AS z FROM bsum JOIN f USING (r) JOIN zl USING (r, d) JOIN en USING (r, d))",
        *quorum_ctes("bu", "r, b", "bqu", QUORUM, D),
        *quorum_ctes("bl", "r, b", "bql", QUORUM, D),
        f"bal AS (SELECT r, b, {mu} * least(bqu.score, bql.score) AS psi_beta FROM bqu JOIN bql USING (r, b))",
    ]


def _late_events() -> list[str]:
    """CTEs: events in three micro-batches; one in 50 comes a batch late and joins the first open slot."""
    open_ = "(SELECT max(slot) FROM part p WHERE p.part < part.part)"
    return [
        EV.replace("ev AS (", "ev0 AS ("),
        f"""part AS (SELECT *, least(2, CASE WHEN day < {LATE_DAYS[0]} THEN 0 WHEN day < {LATE_DAYS[1]} THEN 1 ELSE 2 END
    + CAST(event_id % 50 = 0 AS INTEGER)) AS part FROM ev0)""",
        f"ev AS (SELECT * REPLACE (coalesce(greatest(slot, {open_}), slot) AS slot) FROM part)",
    ]


def _monitor(kind: str, window_days: int | None = None, rebalance: bool = False, late: bool = False) -> str:
    parts = _monitor_parts(kind, window_days, rebalance)
    walk = _walk([*_late_events(), *parts[1:]] if late else parts, rebalance)
    return walk + (
        f"SELECT CAST(rnd AS BIGINT) AS round, CAST(s * {DAY} AS BIGINT) AS ts, start.f2 AS estimate "
        f"FROM walk JOIN start ON start.r = walk.s WHERE emitted"
    )


# -- logs -----------------------------------------------------------------------------------------

LOG = f"""log AS (
  SELECT event_id AS seq, ts_ms AS realTS, ts_ms + a * 1000 AS eventTS, site AS nodeID, b,
         (ts_ms - min(ts_ms) OVER ()) / CAST(1000 AS DOUBLE) AS since_start,
         (ts_ms - min(ts_ms) OVER (PARTITION BY site)) / CAST(1000 AS DOUBLE) AS elapsed,
         count(*) OVER (PARTITION BY site ORDER BY ts_ms, event_id) AS events
  FROM ev)"""


def _increments(marks: str) -> str:
    return _with(
        EV,
        LOG,
        f"m AS (SELECT *, sum(CASE WHEN b IN ({marks}) THEN 1 ELSE 0 END) OVER (PARTITION BY nodeID ORDER BY realTS, seq) AS passed FROM log)",
        f"p AS (SELECT nodeID, b, CASE WHEN b IN ({marks}) THEN passed ELSE passed + 1 END AS period FROM m)",
    ) + (
        "SELECT nodeID, CAST(period AS BIGINT) AS period, count(*) FILTER (WHERE b = 1) AS increments FROM p "
        f"GROUP BY nodeID, period HAVING count(*) FILTER (WHERE b IN ({marks})) > 0"
    )


def _derivative(source: str, node: str, h: int) -> str:
    return f"""SELECT {node}, bucket, (last - coalesce(lag(last) OVER (PARTITION BY {node} ORDER BY bucket), first)) / CAST({h} AS DOUBLE) AS rate
FROM (SELECT {node}, CAST(floor(elapsed / {h}) AS BIGINT) AS bucket, max(events) AS last, min(events) AS first FROM {source} GROUP BY ALL)"""


def _compare_k() -> str:
    runs = " UNION ALL ".join(
        f"""SELECT {k} AS k, * FROM ({_derivative(f"(SELECT event_id % {k} AS nodeID, (ts_ms - min(ts_ms) OVER (PARTITION BY event_id % {k})) / CAST(1000 AS DOUBLE) AS elapsed, count(*) OVER (PARTITION BY event_id % {k} ORDER BY ts_ms, event_id) AS events FROM ev)", 'nodeID', 86400)})"""
        for k in KS
    )
    return _with(EV) + f"SELECT CAST(k AS BIGINT) AS k, nodeID, bucket, rate FROM ({runs})"


# -- the rest -------------------------------------------------------------------------------------


def _text_hash(text: str, base: int = 31) -> str:
    """Fold over the characters with 32-bit wrap-around."""
    step = f"((h * {base} + ascii(c) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648"
    step = step.replace("ascii(c)", "c")
    codes = f"list_prepend(CAST(0 AS BIGINT), list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT)))"
    return f"list_reduce({codes}, lambda h, c: {step})"


def _coverage() -> str:
    once = _text_hash("CAST(u AS VARCHAR)")
    mod = "(h % k + k) % k"
    return f"""WITH u AS (SELECT DISTINCT user_id AS u FROM events),
h1 AS (SELECT u, {once} AS th FROM u),
h2 AS (
  SELECT 'raw' AS hash, u AS h FROM h1 UNION ALL SELECT 'text_hash', th FROM h1
  UNION ALL SELECT 'double_text_hash', {_text_hash('CAST(th AS VARCHAR)')} FROM h1
  UNION ALL SELECT 'md5', CAST('0x' || substr(md5(CAST(u AS VARCHAR)), 9, 8) AS BIGINT) FROM h1
  UNION ALL SELECT 'sha', CAST('0x' || substr(sha256(CAST(u AS VARCHAR)), 1, 8) AS BIGINT) FROM h1)
SELECT hash, k, count(DISTINCT {mod}) AS sites_hit FROM h2, range(2, 28) r(k) GROUP BY hash, k"""


def _synthetic() -> str:
    def draw(which: int, n: int) -> str:
        c = _draw_coefficients(which, 512)
        acc = str(c[0])
        for x in c[1:4]:
            acc = f"(({acc} * (event_id % {P}) + {x}) % {P})"
        return f"({acc} % {n})"

    return f"""WITH r AS (SELECT event_id AS id, {draw(0, 10)} AS site, {draw(1, 100)} AS a, {draw(2, 5)} + 1 AS step FROM events),
t AS (SELECT *, CAST(sum(step) OVER (ORDER BY id) - step AS BIGINT) AS tick FROM r)
SELECT id, site, 1000000 + tick * 100 AS ts_ms, a, CAST(1 AS BIGINT) AS b, CAST(1 AS DOUBLE) AS val FROM t"""


_STARTS = f"""st(site, start) AS (
  SELECT site, min(ts_ms) FROM ev GROUP BY site
  UNION ALL
  SELECT site, (SELECT min(ts_ms) FROM ev WHERE ev.site = st.site AND ev.ts_ms >= st.start + {HOUR}) AS start
  FROM st WHERE EXISTS (SELECT 1 FROM ev WHERE ev.site = st.site AND ev.ts_ms >= st.start + {HOUR}))"""


def _anchored() -> str:
    return _with(
        EV,
        _STARTS,
        f"""sl AS (SELECT site, start, lead(start) OVER (PARTITION BY site ORDER BY start) AS released,
    (SELECT min(n.start) FROM st n WHERE n.site = st.site AND n.start > st.start + {HOUR}) + {23 * HOUR} AS withdrawn FROM st)""",
        "lab AS (SELECT event_id, ev.site, max(start) AS start, x, val FROM ev JOIN st ON st.site = ev.site AND st.start <= ev.ts_ms GROUP BY ALL)",
        recursive=True,
    ) + """SELECT event_id, site, start AS ts_ms, x, val, released AS at FROM lab JOIN sl USING (site, start) WHERE released IS NOT NULL
UNION ALL SELECT event_id, site, start, x, -val, withdrawn FROM lab JOIN sl USING (site, start) WHERE withdrawn IS NOT NULL"""


_FIRST_ROUND = (
    *SKETCH_PARTS[:4],
    cells("dd", "ev", "site, slot", where=f"day >= {WARM_DAYS}"),
    "g AS (SELECT DISTINCT site, slot FROM dd)",
    "dr AS (SELECT g.site, g.slot, d, w, sum(v) AS v FROM g JOIN dd ON dd.site = g.site AND dd.slot <= g.slot GROUP BY ALL)",
    *f2_rows("dr"),
    *quorum_ctes("up", "site, slot", "qu", QUORUM, D),
    *quorum_ctes("lo", "site, slot", "ql", QUORUM, D),
    "ph AS (SELECT site, slot, least(qu.score, ql.score) AS phi FROM qu JOIN ql USING (site, slot))",
)


def _counters() -> str:
    zero = [
        "zu AS (SELECT DISTINCT 0 AS one, d, ref, ref AS z FROM up)",
        "zl AS (SELECT DISTINCT 0 AS one, d, ref, ref AS z FROM lo)",
        *quorum_ctes("zu", "one", "z0u", QUORUM, D),
        *quorum_ctes("zl", "one", "z0l", QUORUM, D),
        "z0 AS (SELECT least(z0u.score, z0l.score) AS z FROM z0u, z0l)",
        """c AS (SELECT site, slot, max(greatest(CAST(trunc((z - phi) / (z / 2)) AS BIGINT), 0)) OVER (PARTITION BY site ORDER BY slot) AS counter
  FROM ph, z0)""",
        "gr AS (SELECT *, counter - coalesce(lag(counter) OVER (PARTITION BY site ORDER BY slot), 0) AS gained FROM c)",
    ]
    return _with(*_FIRST_ROUND, *zero) + f"""SELECT site, slot, counter, gained, CAST(total AS BIGINT) AS total, total > {SITES} AS over
FROM gr JOIN (SELECT slot, sum(sum(gained)) OVER (ORDER BY slot) AS total FROM gr GROUP BY slot) USING (slot)"""


def _quorum(eikonal: bool, component: str = "b", n: int = len(TYPES), k: int = 3) -> str:
    return _with(
        EV,
        f"ref0 AS (SELECT {component} AS d, CAST(count(*) AS DOUBLE) AS v FROM ev WHERE day < {WARM_DAYS} GROUP BY ALL)",
        f"ref AS (SELECT d, v - 0.25 * (SELECT sum(v) FROM ref0) / {n} AS ref FROM ref0)",
        f"users AS (SELECT DISTINCT a FROM ev WHERE day >= {WARM_DAYS})",
        f"""rows_ AS (SELECT users.a, ref.d, ref.ref, count(ev.a) - CAST(1 AS DOUBLE) AS z
  FROM users CROSS JOIN ref LEFT JOIN ev ON ev.a = users.a AND {component} = ref.d AND ev.day >= {WARM_DAYS} GROUP BY ALL)""",
        *quorum_ctes("rows_", "a", "q", k, n, eikonal),
    ) + f"SELECT a, {_r('score', 'score')} FROM q"


def _row_arith() -> str:
    return _with(
        EV,
        SEEDS,
        cells("s", "ev", "site"),
        cells("t", "ev", ""),
        "m AS (SELECT d, sqrt(sum(v * v)) AS m FROM s WHERE site = 0 GROUP BY d)",
        "n AS (SELECT d, sqrt(sum(v * v)) AS n FROM t GROUP BY d)",
    ) + f"""SELECT d, {_r('n + m', 'added')}, {_r('n - m', 'subtracted')}, {_r('n * m', 'multiplied')}, {_r('sqrt(n)', 'root')},
  {_r('n * 0.5', 'scaled')}, {_r('sqrt(sum(n * n) OVER ())', 'norm')} FROM n JOIN m USING (d)"""


def _join_size_sketch() -> str:
    parts, picks = [SEEDS], []
    pairs = (
        ("orders_lineitem", "orders", "o_orderkey", "lineitem", "l_orderkey"),
        ("customer_supplier", "customer", "c_nationkey", "supplier", "s_nationkey"),
    )
    for i, (name, ta, ca, tb, cb) in enumerate(pairs):
        for side, table, column in (("a", ta, ca), ("b", tb, cb)):
            parts.append(
                f"k{side}{i} AS (SELECT CAST({column} AS BIGINT) % {P} AS x, CAST(count(*) AS DOUBLE) AS val FROM {table} GROUP BY ALL)"
            )
            parts.append(cells(f"c{side}{i}", f"k{side}{i}", ""))
        parts.append(
            f"p{i} AS (SELECT seeds.d, coalesce(sum(a.v * b.v), 0) AS p FROM seeds LEFT JOIN ca{i} a ON a.d = seeds.d LEFT JOIN cb{i} b ON b.d = a.d AND b.w = a.w GROUP BY seeds.d)"
        )
        picks.append(f"SELECT '{name}' AS pair, list_sort(list(p))[len(list(p)) // 2 + 1] AS estimate FROM p{i}")
    return _with(*parts) + " UNION ALL ".join(picks)


def _f2_checkpoints() -> str:
    return _with(
        EV,
        "o AS (SELECT ts_ms, x, row_number() OVER (ORDER BY ts_ms, event_id) AS rn, row_number() OVER (PARTITION BY x ORDER BY ts_ms, event_id) AS c FROM ev)",
        "f AS (SELECT rn, ts_ms, CAST(sum(2 * c - 1) OVER (ORDER BY rn) AS DOUBLE) AS f2 FROM o)",
    ) + f"SELECT rn, ts_ms, {_r('f2 * 0.1 * 0.1', 'f2')} FROM f WHERE (rn - 1) % 1000 = 0"


def _window_estimates() -> str:
    return _with(
        EV,
        SEEDS,
        cells("dd", "ev", "site, slot"),
        "g AS (SELECT site, slot FROM dd UNION SELECT site, slot + 7 FROM dd)",
        """c AS (SELECT g.site, g.slot, seeds.d, w, sum(v) AS v FROM g CROSS JOIN seeds
  LEFT JOIN dd ON dd.site = g.site AND dd.d = seeds.d AND dd.slot <= g.slot AND dd.slot > g.slot - 7 GROUP BY ALL)""",
        "r AS (SELECT site, slot, d, coalesce(sum(v * v), 0) AS f2 FROM c GROUP BY ALL)",
    ) + f"SELECT site, slot, {_r('list_sort(list(f2))[len(list(f2)) // 2 + 1] * 0.1 * 0.1', 'estimate')} FROM r GROUP BY site, slot"


def _log_lines() -> str:
    return _with(EV) + "SELECT site, (ts_ms // 1000) * 1000 AS ts_ms, a, b, x, val FROM ev"


def _monitor_join(eps: float) -> str:
    """Clicks joined with purchases on the user; the vector holds the polarised sketches x and y."""
    root, e = "sqrt(CAST(0.5 AS DOUBLE))", _dbl(eps)
    parts = [EV.replace("ev AS (", "ev0 AS ("), "ev AS (SELECT site, slot, b, a AS x, val FROM ev0)", SEEDS]
    parts += [cells(f"d{b}", "ev", "site, slot", where=f"b = {b}") for b in (1, 2)]
    parts += [
        """delta AS (SELECT site, slot, d, w, sum(x) AS x, sum(y) AS y FROM (
  SELECT site, slot, d, w, v AS x, v AS y FROM d1 UNION ALL SELECT site, slot, d, w, v, -v FROM d2) GROUP BY ALL)""",
        f"warm AS (SELECT min(slot) + {WARM_DAYS - 1} AS warm, max(slot) AS top FROM ev WHERE b IN (1, 2))",
        "slots AS (SELECT unnest(range(warm, top + 1)) AS s FROM warm)",
        "keys AS (SELECT DISTINCT d, w FROM delta)",
        f"""cum AS (SELECT k.s, k.site, k.d, k.w, coalesce(sum(x), 0) AS x, coalesce(sum(y), 0) AS y
  FROM (SELECT s, site, d, w FROM slots, range({SITES}) q(site), keys) AS k
  LEFT JOIN delta ON delta.site = k.site AND delta.slot <= k.s AND delta.d = k.d AND delta.w = k.w GROUP BY ALL)""",
        f"est AS (SELECT s AS r, d, w, sum(x) / {SITES} AS x, sum(y) / {SITES} AS y FROM cum GROUP BY ALL)",
        "en AS (SELECT r, d, sqrt(sum(x * x)) AS nx, sqrt(sum(y * y)) AS ny, (sum(x * x) - sum(y * y)) / 4 AS p FROM est GROUP BY ALL)",
        "f AS (SELECT r, list_sort(list(p))[len(list(p)) // 2 + 1] AS f2 FROM en GROUP BY r)",
        f"zt AS (SELECT r, 4 * (f2 - {e} * abs(f2)) AS tl, -4 * (f2 + {e} * abs(f2)) AS th FROM f)",
        """sums AS (SELECT a.s AS r, c.s AS s, c.site, c.d, sum((e.x + c.x - p.x) * e.x) AS dx, sum((e.y + c.y - p.y) * e.y) AS dy,
    sqrt(sum((e.x + c.x - p.x) ** 2)) AS lx, sqrt(sum((e.y + c.y - p.y) ** 2)) AS ly
  FROM slots a JOIN cum c ON c.s > a.s JOIN cum p ON p.s = a.s AND p.site = c.site AND p.d = c.d AND p.w = c.w
  JOIN est e ON e.r = a.s AND e.d = c.d AND e.w = c.w GROUP BY ALL)""",
        """points AS (
  SELECT {'k': 'l', 'r': r, 's': s, 'site': site, 'd': d} AS id, nx AS xi, ny AS psi, tl AS t, dx / nx AS x, ly AS y FROM sums JOIN en USING (r, d) JOIN zt USING (r)
  UNION ALL SELECT {'k': 'u', 'r': r, 's': s, 'site': site, 'd': d}, ny, nx, th, dy / ny, lx FROM sums JOIN en USING (r, d) JOIN zt USING (r)
  UNION ALL SELECT {'k': 'L', 'r': r, 's': 0, 'site': 0, 'd': d}, nx, ny, tl, nx, ny FROM en JOIN zt USING (r)
  UNION ALL SELECT {'k': 'U', 'r': r, 's': 0, 'site': 0, 'd': d}, ny, nx, th, ny, nx FROM en JOIN zt USING (r))""",
        *hyperbola_ctes("points", "h"),
        f"hs AS MATERIALIZED (SELECT id.k AS k, id.r AS r, id.s AS s, id.site AS site, id.d AS d, score * {root} AS score FROM h)",
    ]
    for side, name in (("l", "lo"), ("u", "up")):
        parts += [
            f"ref{name} AS (SELECT r, d, score AS ref, score AS z FROM hs WHERE k = '{side.upper()}')",
            f"{name} AS (SELECT hs.r, hs.s, hs.site, hs.d, ref, hs.score AS z FROM hs JOIN ref{name} q ON q.r = hs.r AND q.d = hs.d WHERE k = '{side}')",
            *quorum_ctes(f"ref{name}", "r", f"z0{name}", QUORUM, D),
            *quorum_ctes(name, "r, s, site", f"ph{name}", QUORUM, D),
        ]
    parts += [
        "start AS (SELECT r, f2, least(z0lo.score, z0up.score) AS phi0 FROM f JOIN z0lo USING (r) JOIN z0up USING (r))",
        "ph1 AS (SELECT r, s, site, least(phlo.score, phup.score) AS phi FROM phlo JOIN phup USING (r, s, site))",
        "ph AS (SELECT r, r AS b, s, list(phi ORDER BY site) AS phis FROM ph1 GROUP BY ALL)",
    ]
    return _walk(parts, False) + (
        f"SELECT CAST(rnd AS BIGINT) AS round, CAST(s * {DAY} AS BIGINT) AS ts, {_r('start.f2', 'estimate')} "
        "FROM walk JOIN start ON start.r = walk.s WHERE emitted"
    )


def _monitor_log() -> str:
    """Decisions per kind, derived from what happened in every slot of the walk."""
    k = SITES
    walk = _walk(_monitor_parts("exact", None, False), False)
    return walk + f""", h AS (
  SELECT w.s, w.emitted, w.rnd, p.s IS NOT NULL AND (w.emitted OR w.q <> p.q) AS ended,
    CASE WHEN p.s IS NULL THEN 0 ELSE len(list_filter(range({k}), lambda i:
      CAST(trunc((p.z[i + 1] - ph.phis[i + 1]) / p.q) AS BIGINT) > p.c[i + 1])) END AS inc
  FROM walk w LEFT JOIN walk p ON p.s = w.s - 1 LEFT JOIN ph ON ph.r = p.r AND ph.b = p.b AND ph.s = w.s),
m AS (
  SELECT s, 'SITE_SENT_INCREMENT' AS kind, inc AS n FROM h
  UNION ALL SELECT s, 'SUBROUND', 1 FROM h WHERE ended
  UNION ALL SELECT s, 'ROUND', 1 FROM h WHERE emitted)
SELECT CAST(s * {DAY} AS BIGINT) AS "eventTS", kind, CAST(n AS BIGINT) AS n FROM m WHERE n > 0"""


def _compare_gates() -> str:
    """Ordinals of rounds and subrounds of the exact run over event time, for each number of sites."""
    runs = []
    for k in KS:
        walk = _walk(_monitor_parts("exact", None, False, k), False, k)
        runs.append(f"""SELECT {k} AS k, * FROM ({walk}, h AS (
  SELECT w.s, w.emitted, p.s IS NOT NULL AND (w.emitted OR w.q <> p.q) AS ended FROM walk w LEFT JOIN walk p ON p.s = w.s - 1),
m AS (SELECT s, 'ROUND' AS kind FROM h WHERE emitted UNION ALL SELECT s, 'SUBROUND' FROM h WHERE ended)
SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY s) AS ordinal,
  (s - min(s) OVER ()) * CAST({DAY // 1000} AS DOUBLE) AS elapsed FROM m)""")
    return "SELECT CAST(k AS BIGINT) AS k, kind, ordinal, elapsed FROM (" + " UNION ALL ".join(runs) + ")"


def all_sql() -> dict[str, str]:
    ev = _with(EV)
    vec = _with(EV, VEC)
    logw = _with(EV, LOG)
    return {
        "ingest_events": ev + "SELECT event_id, site, ts_ms, a, b, x, val FROM ev",
        "ingest_log_lines": _log_lines(),
        "ingest_log_files": _log_lines(),
        "synthetic_events": _synthetic(),
        "site_load": f"SELECT event_id % {SITES} AS site, count(*) AS records FROM events GROUP BY 1",
        "site_coverage": _coverage(),
        "site_vectors": vec + "SELECT site, x, v FROM v",
        "vector_add": vec + "SELECT x, sum(v) AS v FROM v WHERE site IN (0, 1) GROUP BY x",
        "vector_scale": vec + "SELECT site, x, v * 0.25 AS v FROM v",
        "vector_norm": vec + f"SELECT site, {_r('sqrt(sum(v * v))', 'norm')} FROM v GROUP BY site",
        "vector_normalize": vec + f"SELECT site, x, {_r('v / sqrt(sum(v * v) OVER (PARTITION BY site))', 'v')} FROM v",
        "vector_dot": vec + "SELECT p.site, sum(p.v * q.v) AS dot FROM v p JOIN v q ON p.x = q.x AND q.site = 0 GROUP BY p.site",
        "mean_vector": ev + f"SELECT x, sum(val) / {SITES} AS v FROM ev GROUP BY x",
        "f2_exact": ev + f"SELECT sum(v * v) AS f2 FROM (SELECT sum(val) / {SITES} AS v FROM ev GROUP BY x)",
        "f2_checkpoints": _f2_checkpoints(),
        "sketch_cells": SKETCHED + "SELECT site, d, w, v FROM s",
        "sketch_packed": SKETCHED + "SELECT site, d, w, v FROM s WHERE v <> 0",
        "sketch_add": SKETCHED + "SELECT d, w, sum(v) AS v FROM s WHERE site IN (0, 1) GROUP BY d, w",
        "sketch_subtract": SKETCHED + "SELECT d, w, sum(CASE WHEN site = 0 THEN v ELSE -v END) AS v FROM s WHERE site IN (0, 1) GROUP BY d, w",
        "sketch_scale": SKETCHED + "SELECT site, d, w, v * 0.5 AS v FROM s",
        "sketch_row_arith": _row_arith(),
        "sketch_row_norms": SKETCHED + f"SELECT site, d, {_r('sqrt(sum(v * v))', 'norm')} FROM s GROUP BY site, d",
        "sketch_normalize": SKETCHED + f"SELECT site, d, w, {_r('v / sqrt(sum(v * v) OVER (PARTITION BY site, d))', 'v')} FROM s",
        "sketch_row_dot": SKETCHED + "SELECT p.site, p.d, sum(p.v * q.v) AS dot FROM s p JOIN s q ON p.d = q.d AND p.w = q.w AND q.site = 0 GROUP BY ALL",
        "sketch_dense_pos": SKETCHED + f"SELECT site, d * {W} + w AS flat, d, w, v FROM s",
        "sketch_dense": SKETCHED + f"""SELECT g.site, g.pos, coalesce(s.v, CAST(0 AS DOUBLE)) AS v
FROM (SELECT site, pos FROM range({SITES}) a(site), range({D * W}) b(pos)) g
LEFT JOIN s ON s.site = g.site AND s.d * {W} + s.w = g.pos""",
        "sketch_dense_arrays": SKETCHED + f"""SELECT g.site, g.pos, coalesce(s.v, CAST(0 AS DOUBLE)) AS v
FROM (SELECT site, pos FROM range({SITES}) a(site), range({D * W}) b(pos)) g
LEFT JOIN s ON s.site = g.site AND s.d * {W} + s.w = g.pos""",
        "sketch_column": SKETCHED + "SELECT d, w, v FROM s WHERE (site = 1 AND w <> 17) OR (site = 0 AND w = 17)",
        "sketch_equal": SKETCHED.rstrip() + ",\n" + cells("t", "ev", "") + """
SELECT count(*) FILTER (WHERE coalesce(p.v, 0) <> coalesce(t.v, 0)) = 0 AS equal
FROM (SELECT d, w, sum(v) AS v FROM s GROUP BY ALL) p FULL JOIN t ON p.d = t.d AND p.w = t.w""",
        "sketch_empty_sites": "SELECT DISTINCT event_id % 4 AS site FROM events WHERE event_id % 4 = 2",
        "f2_sketch": SKETCHED + f"""SELECT site, list_sort(list(f2))[len(list(f2)) // 2 + 1] AS estimate FROM (
  SELECT site, d, sum(v * v) AS f2 FROM s GROUP BY ALL
  UNION ALL SELECT -1, d, sum(v * v) FROM (SELECT d, w, sum(v) / {SITES} AS v FROM s GROUP BY ALL) GROUP BY d) GROUP BY site""",
        "join_size_exact": """SELECT 'orders_lineitem' AS pair, CAST(count(*) AS DOUBLE) AS size FROM orders JOIN lineitem ON o_orderkey = l_orderkey
UNION ALL SELECT 'customer_supplier', CAST(count(*) AS DOUBLE) FROM customer JOIN supplier ON c_nationkey = s_nationkey""",
        "join_size_sketch": _join_size_sketch(),
        "zone_cap": _zone_cap(""),
        "zone_cap_neg": _zone_cap("-"),
        "zone_f2_upper": _zone_f2("upper"),
        "zone_f2_lower": _zone_f2("lower"),
        "zone_f2": _zone_f2("both"),
        "zone_rebalanced": _zone_f2("both", 2.0),
        "balance_term": _with(
            *SKETCH_PARTS[:5],
            "g AS (SELECT 0 AS site, 0 AS slot)",
            f"bs AS (SELECT 0 AS site, 0 AS slot, d, w, sum(v) / {_dbl(0.5 * SITES)} AS v FROM dr GROUP BY ALL)",
            *f2_rows("bs"),
            *quorum_ctes("up", "site, slot", "qu", QUORUM, D),
            *quorum_ctes("lo", "site, slot", "ql", QUORUM, D),
        )
        + f"SELECT {_r(f'{_dbl(0.5 * SITES)} * least(qu.score, ql.score)', 'psi_beta')} FROM qu, ql",
        "quorum_eikonal": _quorum(True),
        "quorum_fast": _quorum(False),
        "quorum_deep": _quorum(True, f"(ts_ms // {2 * HOUR}) % 12", 12, 6),
        "zone_hyperbola": _with(
            EV,
            "u AS (SELECT a, CAST(count(*) FILTER (WHERE b = 1) AS DOUBLE) AS x, CAST(count(*) FILTER (WHERE b = 2) AS DOUBLE) AS y FROM ev GROUP BY a)",
            "points AS (SELECT {'a': a, 't': t} AS id, CAST(9 AS DOUBLE) AS xi, CAST(3 AS DOUBLE) AS psi, CAST(t AS DOUBLE) AS t, x, y FROM u, (VALUES (4), (0), (-4)) v(t))",
            *hyperbola_ctes("points", "h"),
            recursive=True,
        )
        + f"SELECT h.id.a AS a, CAST(h.id.t AS DOUBLE) AS t, {_r('score', 'score')} FROM h",
        "zone_join": _zone_join(),
        "retract_aligned": _with(EV, f"t AS (SELECT site, ts_ms // {HOUR} AS slot, x, sum(val) AS v FROM ev GROUP BY ALL)")
        + "SELECT site, slot, x, v FROM t UNION ALL SELECT site, slot + 24, x, -v FROM t",
        "retract_anchored": _anchored(),
        "retract_anchored_stream": _anchored(),
        "window_sliding": ev
        + f"""SELECT site, (ts_ms // {HOUR} - 23 + i) * {HOUR} AS window_start_ms, count(*) AS n, sum(val) AS total
FROM ev, range(24) o(i) GROUP BY ALL""",
        "window_extremes": ev
        + f"""SELECT site, (ts_ms // {HOUR} - 23 + i) * {HOUR} AS window_start_ms, count(*) AS n, CAST(sum(a) AS DOUBLE) AS total,
  CAST(min(a) AS DOUBLE) AS low, CAST(max(a) AS DOUBLE) AS high
FROM ev, range(24) o(i) GROUP BY ALL""",
        "window_fine": ev
        + f"""SELECT site, start // {DAY} AS day, count(*) AS windows, CAST(sum(n) AS BIGINT) AS records, max(n) AS most,
  CAST(max(total) AS DOUBLE) AS total, CAST(min(low) AS DOUBLE) AS low, CAST(max(high) AS DOUBLE) AS high
FROM (SELECT site, (ts_ms // 5000 - 199 + i) * 5000 AS start, count(*) AS n, sum(a) AS total, min(a) AS low, max(a) AS high
  FROM ev, range(200) o(i) GROUP BY ALL) GROUP BY ALL""",
        "user_moments": ev
        + f"SELECT site, slot, count(*) AS n, {_r('avg(a)', 'mean')}, {_r('var_pop(a)', 'variance')} FROM ev GROUP BY ALL",
        "pane_delta": ev
        + """SELECT site, x, slot, sum(v) AS v FROM (
  SELECT site, x, slot, val AS v FROM ev UNION ALL SELECT site, x, slot + 3, -val FROM ev) GROUP BY ALL HAVING sum(v) <> 0""",
        "window_estimates": _window_estimates(),
        "slide_throttle": _with(EV, _STARTS, recursive=True) + "SELECT site, start FROM st",
        "warmup_filter": ev
        + f"""SELECT site, min(ts_ms // {HOUR}) AS first_slot, count(*) AS records FROM ev
WHERE ts_ms // {HOUR} >= (SELECT min(ts_ms) // {HOUR} + 36 FROM ev) GROUP BY site""",
        "late_watermark": ev
        + f"""SELECT site, slot * {DAY} AS window_start_ms, count(*) AS records FROM ev
WHERE (slot + 1) * {DAY} <= (SELECT max(ts_ms) FROM ev) - {6 * HOUR} GROUP BY site, slot""",
        "phi_series_first_round": _with(*_FIRST_ROUND) + f"SELECT site, slot, {_r('phi', 'phi')} FROM ph",
        "gate_counters": _counters(),
        "monitor_exact": _monitor("exact"),
        "monitor_exact_rebalance": _monitor("exact", rebalance=True),
        "monitor_exact_window": _monitor("exact", window_days=10),
        "monitor_f2": _monitor("f2"),
        "monitor_f2_rebalance": _monitor("f2", rebalance=True),
        "monitor_f2_window": _monitor("f2", window_days=10),
        "monitor_join": _monitor_join(0.5),
        "monitor_log": _monitor_log(),
        "monitor_throughput": ev
        + f"""SELECT slot * {DAY} AS "eventTS", site AS "nodeID", CAST(sum(count(*)) OVER (PARTITION BY site ORDER BY slot) AS BIGINT) AS events
FROM ev GROUP BY site, slot""",
        "monitor_stream_exact": _monitor("exact"),
        "monitor_stream_late": _monitor("exact", late=True),
        "gate_compare_k": _compare_gates(),
        "sink_answers": f"SELECT ts, estimate FROM ({_monitor('exact')})",
        "sink_logs": f"""SELECT log, kind, CAST(n AS BIGINT) AS n FROM (
  SELECT 'centre' AS log, kind, sum(n) AS n FROM ({_monitor_log()}) WHERE kind NOT LIKE 'SITE%' GROUP BY kind
  UNION ALL SELECT 'site', substr(kind, 6), sum(n) FROM ({_monitor_log()}) WHERE kind LIKE 'SITE%' GROUP BY kind
  UNION ALL SELECT 'throughput', CAST(site AS VARCHAR), count(*) FROM ({ev} SELECT site FROM ev) GROUP BY site)""",
        "log_node": logw + "SELECT seq, \"realTS\", CASE b WHEN 2 THEN 'RECEIVED_ESTIMATE' WHEN 3 THEN 'RECEIVED_QUANTUM' WHEN 1 THEN 'SENT_INCREMENT' ELSE 'EVENT' END AS \"eventType\" FROM log WHERE nodeID = 1",
        "log_elapsed": logw + f"SELECT seq, {_r('since_start', 'elapsed')} FROM log WHERE b = 2",
        "log_events": logw + f"SELECT nodeID, seq, {_r('elapsed', 'elapsed')}, events FROM log",
        "log_derivative": logw + _derivative("log", "nodeID", 3 * 3600),
        "log_mean_throughput": logw + f"SELECT nodeID, seq, {_r('elapsed', 'elapsed')}, CASE WHEN elapsed > 0 THEN events / elapsed END AS rate FROM log",
        "log_rounds": logw + f"SELECT row_number() OVER (ORDER BY realTS, seq) AS ordinal, {_r('since_start', 'elapsed')} FROM log WHERE b = 2",
        "log_subrounds": logw + f"SELECT row_number() OVER (ORDER BY realTS, seq) AS ordinal, {_r('since_start', 'elapsed')} FROM log WHERE b = 3",
        "log_inc_per_round": _increments("2"),
        "log_inc_per_subround": _increments("2, 3"),
        "log_inc_total": logw + f"SELECT nodeID, seq, {_r('elapsed', 'elapsed')}, row_number() OVER (PARTITION BY nodeID ORDER BY realTS, seq) AS increments FROM log WHERE b = 1",
        "log_time_vs_time": logw
        + f"""SELECT seq, {_r('since_start', 'elapsed')}, (eventTS - (SELECT eventTS FROM log ORDER BY realTS, seq LIMIT 1 OFFSET 1)) / CAST(3600000 AS DOUBLE) AS event_hours
FROM log WHERE seq <> (SELECT seq FROM log ORDER BY realTS, seq LIMIT 1)""",
        "log_compare_k": _compare_k(),
    }
