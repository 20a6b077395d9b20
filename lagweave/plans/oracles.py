"""The same queries in DuckDB SQL, written on their own from the definitions."""

from __future__ import annotations

FLT_MAX = "3.4028234663852886e38"

HOURLY = """found AS (
  SELECT {sid} AS sid, CAST(floor(epoch(ts - TIMESTAMP '2024-01-01 00:00:00') / 3600) AS INT) AS t,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 AS v
  FROM events GROUP BY 1, 2),
p AS (
  SELECT s.sid, CAST(g.t AS INT) AS t, CAST(CAST(coalesce(f.v, 0) AS FLOAT) AS DOUBLE) AS v
  FROM (SELECT DISTINCT sid FROM found WHERE t BETWEEN 0 AND 719) s CROSS JOIN (SELECT unnest(range(720)) AS t) g
  LEFT JOIN found f ON f.sid = s.sid AND f.t = g.t)"""
H = HOURLY.format(sid="event_type")
ALL = HOURLY.format(sid="'all'")
DAILY = """days AS (
  SELECT CAST(date_trunc('day', min(l_shipdate)) AS TIMESTAMP) AS first, date_diff('day', min(l_shipdate), max(l_shipdate)) + 1 AS n FROM lineitem),
found AS (
  SELECT l_returnflag || l_linestatus AS sid, CAST(floor(epoch(l_shipdate - first) / 86400) AS INT) AS t,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS v
  FROM lineitem, days GROUP BY 1, 2),
p AS (
  SELECT s.sid, CAST(g.t AS INT) AS t, CAST(CAST(coalesce(f.v, 0) AS FLOAT) AS DOUBLE) AS v
  FROM (SELECT DISTINCT sid FROM found) s CROSS JOIN (SELECT unnest(range(n)) AS t FROM days) g
  LEFT JOIN found f ON f.sid = s.sid AND f.t = g.t)"""


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def slice_(name: str, of: str, a: int, b: int, where: str = "true") -> str:
    return f"{name} AS (SELECT sid, t - {a} AS t, v FROM {of} WHERE t >= {a} AND t < {b} AND {where})"


def embed(name: str, of: str, E: int, tau: int, Tp: int, ahead: bool) -> str:
    lead = ", ".join(f"lead(v, {e * tau}) OVER (PARTITION BY sid ORDER BY t) AS e{e}" for e in range(E))
    span = (E - 1) * tau
    return f"{name} AS (SELECT * FROM (SELECT sid, t AS j, t + {span + Tp} AS idx, {lead}, count(*) OVER (PARTITION BY sid) AS n FROM {of}) WHERE j < n - {span + (Tp if ahead else 0)})"


def pairs(name: str, a: str, b: str, E: int, mask: bool = True) -> str:
    d2 = " + ".join(f"(a.e{e} - b.e{e}) * (a.e{e} - b.e{e})" for e in range(E))
    d2 = f"CASE WHEN {d2} = 0 THEN {FLT_MAX} ELSE {d2} END" if mask else d2
    return f"{name} AS (SELECT a.sid, a.j AS i, b.j AS j, b.idx, {d2} AS d2 FROM {a} a JOIN {b} b ON a.sid = b.sid)"


def near(name: str, of: str, k: int | None, keys: str = "sid, i") -> str:
    rank = f"row_number() OVER (PARTITION BY {keys} ORDER BY d2, j)"
    return f"{name} AS (SELECT *, CAST({rank} AS INT) AS rk, sqrt(d2) AS dist FROM {of} {'' if k is None else f'QUALIFY {rank} <= {k}'})"


def weigh(name: str, of: str, keys: str = "sid, i") -> str:
    return f"""{name} AS (SELECT *, u / sum(u) OVER (PARTITION BY {keys}) AS w FROM (
  SELECT *, greatest(CASE WHEN m > 0 THEN exp(-dist / m) WHEN dist > 0 THEN 0 ELSE 1 END, 1e-6) AS u
  FROM (SELECT *, min(dist) OVER (PARTITION BY {keys}) AS m FROM {of})))"""


def lut(lib: str, pred: str, E: int, tau: int, Tp: int, k: int, tag: str = "") -> list[str]:
    return [embed(f"a{tag}", pred, E, tau, Tp, False), embed(f"b{tag}", lib, E, tau, Tp, True), pairs(f"d{tag}", f"a{tag}", f"b{tag}", E), near(f"n{tag}", f"d{tag}", k), weigh(f"l{tag}", f"n{tag}")]


def look(name: str, l: str, target: str, keys: str = "l.sid, l.i", on: str = "l.sid = y.sid AND ") -> str:
    return f"{name} AS (SELECT {keys}, sum(l.w * y.v) AS pred FROM {l} l JOIN {target} y ON {on}l.idx = y.t GROUP BY ALL)"


def corr(x: str, y: str) -> str:
    return f"CASE WHEN isnan(corr({x}, {y})) THEN NULL ELSE corr({x}, {y}) END"


def forecast(E: int, Tp: int, observed: str = "p") -> str:
    return f"SELECT x.sid, x.i, CAST(x.i + {E - 1 + Tp} AS INT) AS t, round(x.pred, 6) AS pred, round(o.v, 6) AS actual FROM x LEFT JOIN {observed} o ON o.sid = x.sid AND o.t = x.i + {E - 1 + Tp}"


def rhos(panel: str, E: int, tau: int, tag: str, Tp: int = 1) -> list[str]:
    span = (E - 1) * tau
    return [*lut(panel, panel, E, tau, Tp, E + 1, tag), look(f"x{tag}", f"l{tag}", panel), f"r{tag} AS (SELECT x.sid, CAST({E} AS INT) AS E, {corr('x.pred', 'o.v')} AS rho FROM x{tag} x JOIN {panel} o ON o.sid = x.sid AND o.t = x.i + {span + Tp} GROUP BY x.sid)"]


def best(n: int, panel_ctes: str, tau: int) -> str:
    ctes = [c for E in range(1, n + 1) for c in rhos("p", E, tau, str(E))]
    union = " UNION ALL ".join(f"SELECT * FROM r{E}" for E in range(1, n + 1))
    return with_(panel_ctes, *ctes, f"u AS ({union})", select="SELECT sid, E, round(rho, 6) AS rho FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY rho DESC NULLS LAST, E) AS k FROM u) WHERE k = 1")


def xmap(panel: str) -> list[str]:
    """Dimensions are length(sid) % 3 + 2."""
    ctes = []
    for E in (2, 3, 4):
        ctes += lut(panel, panel, E, 1, 0, E + 1, str(E))
        ctes.append(f"y{E} AS (SELECT sid AS tgt_sid, t, v FROM {panel} WHERE length(sid) % 3 + 2 = {E})")
        ctes.append(f"x{E} AS (SELECT l.sid AS lib_sid, y.tgt_sid, l.i, sum(l.w * y.v) AS pred FROM l{E} l JOIN y{E} y ON y.t = l.idx GROUP BY ALL)")
        ctes.append(f"m{E} AS (SELECT x.lib_sid, x.tgt_sid, CAST({E} AS INT) AS E, {corr('x.pred', 'y.v')} AS rho FROM x{E} x JOIN y{E} y ON y.tgt_sid = x.tgt_sid AND y.t = x.i + {E - 1} GROUP BY ALL)")
    return [*ctes, "m AS (SELECT * FROM m2 UNION ALL SELECT * FROM m3 UNION ALL SELECT * FROM m4)"]


CORRS = f"c AS (SELECT a.sid AS lib_sid, b.sid AS tgt_sid, {corr('a.v', 'b.v')} AS rho FROM p a JOIN p b ON a.t = b.t GROUP BY ALL)"


def ccm(sizes: list[int], trials: int, E: int, Tp: int, keep: int | None, naive: bool = False, full: bool = False) -> list[str]:
    universe = f"SELECT t AS idx FROM a0 WHERE t < (SELECT count(*) FROM a0) - {E - 1 + Tp}" if naive else "SELECT t AS idx FROM a0"
    drawn = "row_number() OVER (PARTITION BY lib_size, trial ORDER BY md5(concat_ws('-', trial, idx)), idx)"
    some = f"smp AS (SELECT lib_size, trial, idx FROM ({universe}) CROSS JOIN (SELECT unnest({sizes}) AS lib_size) CROSS JOIN (SELECT unnest(range({trials})) AS trial) QUALIFY {drawn} <= lib_size)"
    ctes = ["a0 AS (SELECT * FROM p WHERE sid = 'click')", "y0 AS (SELECT * FROM p WHERE sid = 'view')", some, embed("a", "a0", E, 1, Tp, False), embed("b", "a0", E, 1, Tp, True), pairs("d", "a", "b", E), near("n", "d", keep)]
    on = "s.idx = n.j" if naive else "s.idx = n.idx"
    again = "row_number() OVER (PARTITION BY s.lib_size, s.trial, n.i ORDER BY n.rk)"
    ctes.append(f"c AS (SELECT s.lib_size, s.trial, n.i, n.idx, n.dist, {again} AS q FROM n JOIN smp s ON {on} QUALIFY {again} <= {E + 1})")
    ctes.append(f"g AS (SELECT z.lib_size, z.trial, a.j AS i, r.q FROM (SELECT DISTINCT lib_size, trial FROM c) z CROSS JOIN a CROSS JOIN (SELECT unnest(range(1, {E + 2})) AS q) r)")
    ctes.append(f"f AS (SELECT g.lib_size, g.trial, g.i, coalesce(c.idx, 0) AS idx, coalesce(c.dist, {FLT_MAX}) AS dist FROM g LEFT JOIN c USING (lib_size, trial, i, q))")
    ctes.append(weigh("l", "f", "lib_size, trial, i"))
    ctes.append("x AS (SELECT l.lib_size, l.trial, l.i, sum(l.w * y.v) AS pred FROM l JOIN y0 y ON y.t = l.idx GROUP BY ALL)")
    ctes.append(f"r AS (SELECT CAST(x.lib_size AS INT) AS lib_size, CAST(x.trial AS INT) AS trial, {corr('x.pred', 'o.v')} AS rho FROM x JOIN y0 o ON o.t = x.i + {E - 1 + Tp} GROUP BY x.lib_size, x.trial)")
    return ctes


TRIALS = "SELECT lib_size, trial, round(rho, 6) AS rho FROM r"


def smap(E: int, thetas: list[float]) -> list[str]:
    """Weighted least squares in closed form: centred normal equations, for one or two regressors."""
    d2 = " + ".join(f"(a.e{e} - b.e{e}) * (a.e{e} - b.e{e})" for e in range(E))
    ctes = [embed("a", "p", E, 1, 1, False), embed("b", "p", E, 1, 1, True)]
    xs = ", ".join(f"a.e{e} AS q{e}, b.e{e} AS x{e}" for e in range(E))
    ctes.append(f"d AS (SELECT a.sid, a.j AS i, {xs}, y.v AS y, sqrt({d2}) AS dist FROM a JOIN b ON a.sid = b.sid JOIN p y ON y.sid = b.sid AND y.t = b.idx)")
    ctes.append("m AS (SELECT *, sum(dist) OVER (PARTITION BY sid, i) / count(*) OVER (PARTITION BY sid, i) AS mean FROM d)")
    ctes.append(f"w AS (SELECT *, CASE WHEN dist = 0 THEN CASE WHEN theta = 0 THEN 1.0 ELSE 0.0 END ELSE exp(-2 * theta * dist / mean) END AS o FROM m CROSS JOIN (SELECT unnest({thetas}::DOUBLE[]) AS theta))")
    means = ", ".join(f"sum(o * x{e}) / sum(o) AS m{e}, any_value(q{e}) AS q{e}" for e in range(E))
    ctes.append(f"c AS (SELECT sid, theta, i, {means}, sum(o * y) / sum(o) AS my FROM w GROUP BY sid, theta, i)")
    sums = ", ".join([f"sum(w.o * (w.x{e} - c.m{e}) * (w.y - c.my)) AS s{e}y" for e in range(E)] + [f"sum(w.o * (w.x{e} - c.m{e}) * (w.x{f} - c.m{f})) AS s{e}{f}" for e in range(E) for f in range(e, E)])
    ctes.append(f"k AS (SELECT c.*, z.* EXCLUDE (sid, theta, i) FROM c JOIN (SELECT w.sid, w.theta, w.i, {sums} FROM w JOIN c USING (sid, theta, i) GROUP BY w.sid, w.theta, w.i) z USING (sid, theta, i))")
    fit = "my + s0y / s00 * (q0 - m0)" if E == 1 else "my + ((s0y * s11 - s1y * s01) * (q0 - m0) + (s1y * s00 - s0y * s01) * (q1 - m1)) / (s00 * s11 - s01 * s01)"
    ctes.append(f"x AS (SELECT sid, theta, i, {fit} AS pred FROM k)")
    return ctes


def smap_rows(E: int) -> str:
    return with_(H, *smap(E, [0.0, 1.0]), select=f"SELECT x.sid, x.theta, x.i, CAST(x.i + {E} AS INT) AS t, round(x.pred, 4) AS pred, round(o.v, 4) AS actual FROM x LEFT JOIN p o ON o.sid = x.sid AND o.t = x.i + {E}")


def smap_skill(E: int, digits: int, by: str) -> str:
    return f"SELECT {by}, round({corr('x.pred', 'o.v')}, {digits}) AS rho FROM x JOIN p o ON o.sid = x.sid AND o.t = x.i + {E} GROUP BY {by}"


def _knn(select: str) -> str:
    return with_(H, *lut("p", "p", 2, 1, 1, 3), select=select)


def _block(n: str, E: int, ahead: bool) -> str:
    cols = ", ".join([f"c.e{e} AS e{e}" for e in range(E)] + [f"v.e{e} AS e{E + e}" for e in range(E)])
    side = "b" if ahead else "a"
    return f"{n} AS (SELECT 'block' AS sid, c.j, c.idx, {cols} FROM {side}1 c JOIN {side}1 v ON c.j = v.j AND c.sid = 'click' AND v.sid = 'view')"


_EMB = " + ".join(f"(CAST(a.embedding[{k}] AS DOUBLE) - CAST(b.embedding[{k}] AS DOUBLE)) * (CAST(a.embedding[{k}] AS DOUBLE) - CAST(b.embedding[{k}] AS DOUBLE))" for k in range(1, 65))
_DIGEST = "SELECT sid, i, count(*) AS pairs, CAST(sum(CAST(floor(d2) AS BIGINT)) AS BIGINT) AS total, CAST(sum(CAST(floor(d2) AS BIGINT) * idx) AS BIGINT) AS moment, round(min(d2), 6) AS least, round(max(d2), 6) AS most FROM d GROUP BY sid, i"
_SAWTOOTH = "p AS (SELECT 'sawtooth' AS sid, CAST(t AS INT) AS t, CAST(CAST((t % 1000) / 1000 AS FLOAT) AS DOUBLE) AS v FROM range(3000) r(t))"
_LOGISTIC = "RECURSIVE g AS (SELECT 0 AS t, 0.23456::DOUBLE AS x UNION ALL SELECT t + 1, 4::DOUBLE * x * (1::DOUBLE - x) FROM g WHERE t < 299),\np AS (SELECT 'logistic' AS sid, t, CAST(CAST(x AS FLOAT) AS DOUBLE) AS v FROM g)"
_DIST = "SELECT sid, i, rk, j, idx, round(dist, 6) AS dist FROM n"

ORACLES: dict[str, str] = {
    "panel_hourly": with_(H, select="SELECT sid, t, v FROM p"),
    "panel_daily_revenue": with_(DAILY, select="SELECT sid, t, v FROM p"),
    "panel_slice": with_(H, slice_("s", "p", 100, 300, "sid IN ('click', 'view')"), select="SELECT sid, t, v FROM s"),
    "panel_wide": with_(H, select="SELECT t, " + ", ".join(f"max(v) FILTER (sid = '{s}') AS {s}" for s in ("click", "error", "purchase", "signup", "view")) + " FROM p GROUP BY t"),
    "delay_embed_e3": with_(H, embed("e", "p", 3, 1, 1, True), select="SELECT sid, j, idx, e0, e1, e2 FROM e"),
    "pairwise_dist": with_(H, embed("a", "p", 2, 1, 0, False), embed("b", "p", 2, 1, 1, True), pairs("d", "a", "b", 2, False), select=_DIGEST),
    "degenerate_mask": with_(H, embed("a", "p", 1, 1, 0, False), embed("b", "p", 1, 1, 1, True), pairs("d", "a", "b", 1), select="SELECT sid, CAST(sum(CASE WHEN d2 > 1e38 THEN 1 ELSE 0 END) AS BIGINT) AS masked, count(*) AS pairs FROM d GROUP BY sid"),
    "multivar_dist": with_(H, embed("a1", "p", 2, 1, 1, False), embed("b1", "p", 2, 1, 1, True), _block("a", 2, False), _block("b", 2, True), pairs("d", "a", "b", 4, False), select=_DIGEST),
    "knn_topk": _knn(_DIST),
    "knn_relational": _knn(_DIST),
    "knn_full_sort": with_(H, embed("a", "p", 2, 1, 1, False), embed("b", "p", 2, 1, 1, True), pairs("d0", "a", "b", 2), "d AS (SELECT * FROM d0 WHERE d2 < 1e38)", near("n", "d", None), select="SELECT sid, i, count(*) AS n, CAST(sum(CAST(rk AS BIGINT) * rk * (j + 1)) AS BIGINT) AS places, round(max(dist), 6) AS farthest FROM n GROUP BY sid, i"),
    "embeddings_knn": with_(f"d0 AS (SELECT CAST(a.vec_id AS INT) AS i, CAST(b.vec_id AS INT) AS j, {_EMB} AS s FROM embeddings a JOIN embeddings b ON true)", f"d AS (SELECT i, j, CASE WHEN s = 0 THEN {FLT_MAX} ELSE s END AS d2 FROM d0)", near("n", "d", 3, "i"), weigh("l", "n", "i"), select="SELECT i, rk, j, round(dist, 5) AS dist, round(w, 5) AS w FROM l"),
    "lut_weights": with_(H, *lut("p", "p", 3, 1, 1, 4), select="SELECT sid, i, rk, idx, round(w, 6) AS w FROM l"),
    "lut_relational": with_(H, *lut("p", "p", 3, 1, 1, 4), select="SELECT sid, i, rk, idx, round(w, 6) AS w FROM l"),
    "lookup_many": with_(H, "c AS (SELECT * FROM p WHERE sid = 'click')", *lut("c", "c", 2, 1, 1, 3), select="SELECT y.sid, l.i, round(sum(l.w * y.v), 6) AS pred FROM l JOIN p y ON y.t = l.idx GROUP BY ALL"),
    "simplex_self": with_(H, *lut("p", "p", 3, 1, 1, 4), look("x", "l", "p"), select=forecast(3, 1)),
    "simplex_holdout": with_(H, slice_("u", "p", 0, 360), slice_("o2", "p", 360, 720), *lut("u", "o2", 2, 1, 1, 3), look("x", "l", "u"), select=forecast(2, 1, "o2")),
    "simplex_crossmap": with_(H, "u AS (SELECT * FROM p WHERE sid = 'click')", "y2 AS (SELECT 'click' AS sid, t, v FROM p WHERE sid = 'view')", *lut("u", "u", 3, 1, 0, 4), look("x", "l", "y2"), select=forecast(3, 0, "y2")),
    "simplex_multivar": with_(H, embed("a1", "p", 2, 1, 1, False), embed("b1", "p", 2, 1, 1, True), _block("a", 2, False), _block("b", 2, True), pairs("d", "a", "b", 4), near("n", "d", 3), weigh("l", "n"), "y2 AS (SELECT t, v FROM p WHERE sid = 'click')", look("x", "l", "y2", "l.i", ""), select="SELECT i, CAST(i + 2 AS INT) AS t, round(pred, 6) AS pred FROM x"),
    **{f"eval_simplex_e{E}": with_(ALL, *rhos("p", E, 1, ""), select="SELECT sid, round(rho, 6) AS rho FROM r") for E in (1, 2, 3)},
    "edim_by_type": best(5, H, 1),
    "edim_relational": best(3, H, 2),
    "xmap_matrix": with_(H, *xmap("p"), select="SELECT lib_sid, tgt_sid, E, round(rho, 6) AS rho FROM m"),
    "xmap_relational": with_(H, *xmap("p"), select="SELECT lib_sid, tgt_sid, E, round(rho, 6) AS rho FROM m"),
    "corr_matrix": with_(H, CORRS, select="SELECT lib_sid, tgt_sid, round(rho, 6) AS rho FROM c"),
    "corr_relational": with_(DAILY, CORRS, select="SELECT lib_sid, tgt_sid, round(rho, 6) AS rho FROM c"),
    "corr_against": with_(DAILY, CORRS, select="SELECT lib_sid AS sid, round(rho, 6) AS rho FROM c WHERE tgt_sid = 'NO'"),
    "rho_diff": with_(H, *xmap("p"), CORRS, select="SELECT lib_sid, tgt_sid, round(m.rho - abs(c.rho), 6) AS rhodiff FROM m JOIN c USING (lib_sid, tgt_sid)"),
    "mae_mse": with_(H, select=f"SELECT round({corr('a.v', 'b.v')}, 6) AS corr, round(avg(abs(a.v - b.v)), 6) AS mae, round(avg((a.v - b.v) * (a.v - b.v)), 6) AS mse FROM p a JOIN p b ON a.t = b.t AND a.sid = 'click' AND b.sid = 'view'"),
    "ccm_full_lib": with_(H, *ccm([720], 1, 3, 0, None), select="SELECT lib_size, round(rho, 6) AS rho FROM r"),
    "ccm_sampled": with_(H, *ccm([40, 120], 3, 2, 0, None), select=TRIALS),
    "ccm_approx": with_(H, *ccm([60, 120], 3, 2, 0, 117), select=TRIALS),
    "ccm_naive": with_(H, *ccm([40, 120], 2, 2, 1, None, naive=True), select=TRIALS),
    "smap_e1": smap_rows(1),
    "smap_e2": smap_rows(2),
    "eval_smap": with_(H, *smap(1, [0.0, 0.5, 1.0]), select=smap_skill(1, 4, "x.sid, theta")),
    "csv_roundtrip": with_(H, select="SELECT sid, t, v FROM p"),
    "sawtooth_knn": with_(_SAWTOOTH, *lut("p", "p", 2, 1, 0, 3), select=_DIST),
    "logistic_smap": with_(_LOGISTIC, *smap(2, [0.0, 1.0, 4.0]), select=smap_skill(2, 6, "theta")),
}
