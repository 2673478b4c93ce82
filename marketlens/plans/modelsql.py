"""Oracle SQL of the forecast models: recursions over time, rounds and tree
levels, on the CTE ``ok`` (fit-able series: target_type, target_key, month, t,
value, n, hold)."""

from __future__ import annotations

from marketlens.operators import arima, forecast, trees
from marketlens.plans import sqlparts as S

KEY = "target_type, target_key"
LAGS = range(1, forecast.N_LAGS + 1)
FAR = 4611686018427387904


def recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


def fitable(least: int) -> str:
    return f"""ok AS (SELECT target_type, target_key, month, t, n, {S.rnd('value', forecast.VALUE_DIGITS)} AS value,
  CAST(least(3, greatest(1, CAST(floor(n / 5) AS INTEGER))) AS INTEGER) AS hold FROM ser WHERE n >= {least} AND known = n)"""


def points(model: str) -> str:
    value = S.rnd("greatest(0.0, yhat)", 4)
    return f"""SELECT '{model}' AS model_name, target_type, target_key, CAST(k AS INTEGER) AS horizon_months,
  CAST(last_month + to_months(CAST(k AS INTEGER)) AS DATE) AS period_start,
  CASE WHEN target_type = 'salary_role' THEN round_even({value}, 0) + 0.0 ELSE {value} END AS predicted_value FROM fc WHERE fit = 'full'"""


def metrics(model: str) -> str:
    return f"""SELECT '{model}' AS model_name, fc.target_type, fc.target_key,
  {S.rnd('avg(abs(ok.value - fc.yhat))', 4)} AS mae, {S.rnd('sqrt(avg((ok.value - fc.yhat) * (ok.value - fc.yhat)))', 4)} AS rmse
FROM fc JOIN ok ON ok.target_type = fc.target_type AND ok.target_key = fc.target_key AND ok.t = fc.n_fit + fc.k - 1
WHERE fc.fit = 'holdout' GROUP BY 1, 2, 3"""


# ------------------------------------------------------------------ ARIMA / SARIMA
def arima_ctes(horizon: int, seasonal: bool) -> tuple[str, ...]:
    """One row per fit walks over time; at the end of a pass the trial is
    judged and the next one proposed."""
    gap = forecast.HOLDOUT_GAP["arima"]
    sums, at = arima.SUMS, lambda i: f"(CASE WHEN t >= {i} THEN w[t - {i - 1}] ELSE 0 END)"
    w12, w13 = (at(arima.SEASON), at(arima.SEASON + 1)) if seasonal else ("0", "0")
    u1 = f"({at(1)} - ts * {w13})"
    run = {"e": f"({at(0)} - ts * {w12}) - tp * {u1} - tq * e", "dp": f"-{u1} - tq * dp", "dq": "-e - tq * dq", "ds": f"tp * {w13} - {w12} - tq * ds" if seasonal else "0"}
    added = {k: f"{k} + {a} * {b}" for k, (a, b) in arima.FACTORS.items()}
    b = arima.BOUND
    clip = lambda x: f"greatest(-{b}, least({b}, {x}))"
    best = ("p", "q", "s", "r", *[f"b_{n}" for n in sums])
    mine = {"p": "tp", "q": "tq", "s": "ts", "r": "e", **{f"b_{n}": f"g_{n}" for n in sums}}
    d = lambda n: f"(c_b_{n} + c_b_{n} * lam2 + ground)"
    c = lambda n: f"c_b_{n}"
    m = [[d("a11"), c("a12"), c("a13")], [c("a12"), d("a22"), c("a23")], [c("a13"), c("a23"), d("a33")]]
    det = lambda x: f"({x[0][0]} * ({x[1][1]} * {x[2][2]} - {x[1][2]} * {x[2][1]}) - {x[0][1]} * ({x[1][0]} * {x[2][2]} - {x[1][2]} * {x[2][0]}) + {x[0][2]} * ({x[1][0]} * {x[2][1]} - {x[1][1]} * {x[2][0]}))"
    v = [c("b1"), c("b2"), c("b3")]
    trial = {n: clip(f"c_{n} - CASE WHEN det > 0 THEN {det([[v[r] if k == j else m[r][k] for k in range(3)] for r in range(3)])} / det ELSE 0 END") for j, n in enumerate(("p", "q", "s"))}
    if not seasonal:
        trial["s"] = "0"
    pass_ = lambda go, end: f"CASE WHEN t < m THEN {go} ELSE {end} END"
    columns = ["t", "it", "tp", "tq", "ts", *run, *sums, *best, "lam"]
    after = {"t": pass_("t + 1", "1"), "it": pass_("it", "it + 1"), "tp": pass_("tp", trial["p"]), "tq": pass_("tq", trial["q"]), "ts": pass_("ts", trial["s"]),
             **{n: pass_(x, "0") for n, x in run.items()}, **{n: pass_(f"g_{n}", "0") for n in sums}, **{n: pass_(n, f"c_{n}") for n in best}, "lam": pass_("lam", "lam2")}
    zero = lambda n: f"{'CAST(1e999 AS DOUBLE)' if n == 'b_css' else '0::DOUBLE'} AS {n}"
    double = lambda x: f"CAST({x} AS DOUBLE)"
    lag_of = lambda i: f"(CASE WHEN m + k >= {i} THEN ws[m + k - {i - 1}] ELSE 0 END)"
    s12, s13 = (f"s * {lag_of(arima.SEASON)}", f"s * {lag_of(arima.SEASON + 1)}") if seasonal else ("0", "0")
    return (f"""fits AS (
  SELECT {KEY}, 'full' AS fit, max(n) AS n_fit, max(hold) AS hold, max(month) AS last_month, list(value ORDER BY t) AS ys FROM ok GROUP BY ALL
  UNION ALL SELECT {KEY}, 'holdout', max(n - hold), max(hold), max(month), list(value ORDER BY t) FROM ok WHERE n > hold + {gap} AND t < n - hold GROUP BY ALL)""",
            "waves AS (SELECT *, list_transform(range(1, len(ys)), lambda i: ys[i + 1] - ys[i]) AS w, len(ys) - 1 AS m, ys[len(ys)] AS y_last FROM fits)",
            f"""walk AS (
  SELECT {KEY}, fit, w, m, 1::BIGINT AS t, 0 AS it, {double(f"CASE WHEN squares > 0 THEN {clip('own / squares')} ELSE 0 END")} AS tp, 0::DOUBLE AS tq, 0::DOUBLE AS ts, {', '.join(zero(n) for n in (*run, *sums, *best))}, {arima.DAMPING}::DOUBLE AS lam
  FROM (SELECT *, list_sum(list_transform(range(1, m), lambda i: w[i + 1] * w[i])) AS own, list_sum(list_transform(w, lambda x: x * x)) AS squares FROM waves)
  UNION ALL
  SELECT {KEY}, fit, w, m, {', '.join(f"{after[n] if n in ('t', 'it') else double(after[n])} AS {n}" for n in columns)}
  FROM (SELECT *, {det(m)} AS det FROM (SELECT *, {arima.FLOOR} * (c_b_a11 + c_b_a22 + c_b_a33) AS ground FROM (
    SELECT *, CASE WHEN g_css < b_css THEN lam / 10.0 ELSE lam * 10.0 END AS lam2, {', '.join(f"CASE WHEN g_css < b_css THEN {mine[n]} ELSE {n} END AS c_{n}" for n in best)} FROM (
      SELECT *, {', '.join(f'{x} AS g_{n}' for n, x in added.items())} FROM walk WHERE it < {arima.ROUNDS})))))""",
            f"""ahead AS (
  SELECT e.{KEY.replace(', ', ', e.')}, e.fit, n_fit, last_month, CASE WHEN e.fit = 'full' THEN {horizon} ELSE hold END AS steps, e.m, p, q, s, r, 0::BIGINT AS k, e.w AS ws, y_last AS yhat
  FROM walk e JOIN waves USING ({KEY}, fit) WHERE it = {arima.ROUNDS}
  UNION ALL
  SELECT {KEY}, fit, n_fit, last_month, steps, m, p, q, s, r, k + 1, list_append(ws, new), yhat + new
  FROM (SELECT *, {s12} + p * ({lag_of(1)} - {s13}) + CASE WHEN k = 0 THEN q * r ELSE 0 END AS new FROM ahead WHERE k < steps))""",
            "fc AS (SELECT * FROM ahead WHERE k > 0)")


# ------------------------------------------------------------------ ridge
def prophet_ctes(horizon: int) -> tuple[str, ...]:
    n, gap = forecast.N_FEAT, forecast.HOLDOUT_GAP["prophet"]
    two_pi = "6.283185307179586::DOUBLE"
    month = lambda m: [f"sin({two_pi} * {m} / 12)", f"cos({two_pi} * {m} / 12)", f"sin(2 * {two_pi} * {m} / 12)", f"cos(2 * {two_pi} * {m} / 12)"]
    sums = [f"sum(f{i} * f{j}) + {forecast.RIDGE_LAMBDA if i == j and i else 0} AS a{i}{j}" for i in range(n) for j in range(i + 1)] + [f"sum(f{i} * value) AS b{i}" for i in range(n)]
    span = "CAST(greatest(n_fit - 1, 1) AS DOUBLE)"
    chain, last = [], "normal"
    for k, stage in enumerate(arima.cholesky_stages(n)):
        chain.append(f"ch{k} AS (SELECT *, {', '.join(f'{x} AS {name}' for name, x in stage)} FROM {last})")
        last = f"ch{k}"
    return (f"""fits AS (
  SELECT *, 'full' AS fit, n AS n_fit FROM ok UNION ALL SELECT *, 'holdout', n - hold FROM ok WHERE n > hold + {gap} AND t < n - hold)""",
            f"""design AS (SELECT *, 1::DOUBLE AS f0, t / {span} AS f1, {', '.join(f'{x} AS f{i}' for i, x in enumerate(month("month(month)"), 2))} FROM fits)""",
            f"normal AS (SELECT {KEY}, fit, n_fit, max(hold) AS hold, max(month) AS last_month, {', '.join(sums)} FROM design GROUP BY {KEY}, fit, n_fit)", *chain,
            f"""steps AS (SELECT *, CAST(last_month + to_months(CAST(k AS INTEGER)) AS DATE) AS mon FROM
  (SELECT *, unnest(generate_series(1, CASE WHEN fit = 'full' THEN {horizon} ELSE hold END)) AS k FROM {last}))""",
            f"fc AS (SELECT *, x0 + x1 * ((n_fit - 1 + k) / {span}) + {' + '.join(f'x{i} * {x}' for i, x in enumerate(month('month(mon)'), 2))} AS yhat FROM steps)")


# ------------------------------------------------------------------ trees
BOUNDS = [f"{side}{j}" for j in LAGS for side in ("lo", "hi")]
INSIDE = lambda x: " AND ".join(f"2 * {x(j)} > lo{j} AND 2 * {x(j)} <= hi{j}" for j in LAGS)


def level_ctes(how: trees.Settings, rows: str) -> tuple[list[str], str, str]:
    """Trees grown level by level from ``rows`` (sid, tree, r, w, y): the CTEs,
    and the queries of all leaves (sid, tree, node, value, bounds) and of each
    row's leaf (sid, tree, r, node)."""
    out = [f"rows0 AS (SELECT sid, tree, r, w, y, 0::BIGINT AS node FROM {rows})",
           f"nodes0 AS (SELECT DISTINCT sid, tree, 0::BIGINT AS node, {', '.join(f'{chr(45) if b[0] == chr(108) else str()}{FAR}::BIGINT AS {b}' for b in BOUNDS)} FROM rows0)"]
    leaves, done = [], []
    for d in range(how.depth + 1):
        out.append(f"tot{d} AS MATERIALIZED (SELECT sid, tree, node, sum(w)::BIGINT AS tw, sum(w * y)::BIGINT AS ty FROM rows{d} GROUP BY ALL)")
        open_ = d < how.depth
        if open_:
            out += [f"bin{d} AS (SELECT a.sid, a.tree, a.node, x.j, x.v, sum(a.w) AS w, sum(a.w * a.y) AS wy FROM rows{d} a JOIN cells x ON a.sid = x.sid AND a.r = x.r GROUP BY ALL)",
                    f"cum{d} AS (SELECT *, sum(w) OVER p AS wl, sum(wy) OVER p AS yl, lead(v) OVER p AS after FROM bin{d} WINDOW p AS (PARTITION BY sid, tree, node, j ORDER BY v))",
                    f"""best{d} AS MATERIALIZED (SELECT sid, tree, node, j, cut FROM (
  SELECT *, row_number() OVER (PARTITION BY sid, tree, node ORDER BY score DESC, j, v) AS place FROM (
    SELECT c.sid, c.tree, c.node, c.j, c.v, {'g.after' if how.boosted else 'c.after'} + c.v AS cut, tw, ty,
      yl::DOUBLE * yl::DOUBLE / wl::DOUBLE + (ty - yl)::DOUBLE * (ty - yl)::DOUBLE / (tw - wl)::DOUBLE AS score
    FROM cum{d} c JOIN tot{d} USING (sid, tree, node) {'JOIN apart g ON g.sid = c.sid AND g.j = c.j AND g.v = c.v' if how.boosted else ''}
    WHERE c.after IS NOT NULL AND wl >= {how.least} AND tw - wl >= {how.least}) WHERE score > ty::DOUBLE * ty::DOUBLE / tw::DOUBLE) WHERE place = 1)"""]
        anti = lambda of: f"{of} a WHERE NOT EXISTS (SELECT 1 FROM best{d} b WHERE b.sid = a.sid AND b.tree = a.tree AND b.node = a.node)" if open_ else f"{of} a"  # noqa: E731, B023
        leaves.append(f"SELECT a.sid, a.tree, a.node, CAST(round_even({how.rate}::DOUBLE * ty::DOUBLE / tw::DOUBLE, 0) AS BIGINT) AS value, {', '.join(BOUNDS)} FROM (SELECT n.*, tw, ty FROM nodes{d} n JOIN tot{d} USING (sid, tree, node)) a" + (anti("")[2:] if open_ else ""))
        done.append(f"SELECT a.sid, a.tree, a.r, a.node FROM {anti(f'rows{d}')}")
        if open_:
            out.append(f"rows{d + 1} AS MATERIALIZED (SELECT a.sid, a.tree, a.r, a.w, a.y, 2 * a.node + 1 + CASE WHEN 2 * x.v > b.cut THEN 1 ELSE 0 END AS node FROM rows{d} a JOIN best{d} b USING (sid, tree, node) JOIN cells x ON x.sid = a.sid AND x.r = a.r AND x.j = b.j)")
            side = lambda right: ", ".join(f"CASE WHEN j = {b[2:]} THEN {'greatest' if right else 'least'}({b}, cut) ELSE {b} END AS {b}" if (b[0] == "l") == right else b for b in BOUNDS)
            out.append(f"nodes{d + 1} AS (SELECT sid, tree, 2 * node + 1 AS node, {side(False)} FROM nodes{d} JOIN best{d} USING (sid, tree, node) UNION ALL SELECT sid, tree, 2 * node + 2, {side(True)} FROM nodes{d} JOIN best{d} USING (sid, tree, node))")
    return out, " UNION ALL ".join(leaves), " UNION ALL ".join(done)


def tree_ctes(horizon: int, how: trees.Settings) -> tuple[str, ...]:
    n = forecast.N_LAGS
    lag = ", ".join(f"lag(yi, {n + 1 - j}) OVER p AS x{j}" for j in LAGS)
    xs = ", ".join(f"x{j}" for j in LAGS)
    ctes = [f"whole AS (SELECT *, CAST(round_even(value * {trees.UNIT}, 0) AS BIGINT) AS yi FROM ok)",
            f"lagged AS MATERIALIZED (SELECT *, {lag} FROM whole WINDOW p AS (PARTITION BY {KEY} ORDER BY t))",
            f"""sids AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {KEY}, fit) AS sid FROM (
  SELECT {KEY}, 'full' AS fit, max(n) AS n_fit, max(hold) AS hold, max(month) AS last_month, max(n) - {n} AS size FROM ok GROUP BY ALL
  UNION ALL SELECT {KEY}, 'holdout', max(n - hold), max(hold), max(month), max(n - hold) - {n} FROM ok WHERE n - {n} > hold + 2 GROUP BY ALL))""",
            f"lagr AS MATERIALIZED (SELECT sid, size, t - {n} AS r, yi AS y, {xs} FROM sids JOIN lagged USING ({KEY}) WHERE t >= {n} AND t < n_fit)",
            "cells AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT sid, r, {j} AS j, x{j} AS v FROM lagr" for j in LAGS) + ")"]
    if how.boosted:
        ctes.append("apart AS MATERIALIZED (SELECT sid, j, v, lead(v) OVER (PARTITION BY sid, j ORDER BY v) AS after FROM (SELECT DISTINCT sid, j, v FROM cells))")
        inner, leaves, done = level_ctes(how, "(SELECT s.sid, 0 AS tree, s.r, 1::BIGINT AS w, y - f AS y FROM boost s JOIN lagr USING (sid, r) WHERE s.kind = 'row')")
        none = ", ".join(f"NULL::BIGINT AS {b}" for b in BOUNDS)
        ctes += ["base AS MATERIALIZED (SELECT sid, CAST(round_even(sum(y)::DOUBLE / count(*), 0) AS BIGINT) AS f FROM lagr GROUP BY sid)",
                 f"""boost AS (
  SELECT 0 AS it, 'row' AS kind, sid, r, f, NULL::BIGINT AS value, {none} FROM lagr JOIN base USING (sid)
  UNION ALL (WITH {', '.join(inner)}, leafs AS MATERIALIZED ({leaves}), placed AS ({done}), old AS MATERIALIZED (SELECT * FROM boost WHERE kind = 'row' AND it < {how.trees})
  SELECT it + 1, 'row', o.sid, o.r, o.f + l.value, NULL, {', '.join('NULL' for _ in BOUNDS)} FROM old o JOIN placed d ON d.sid = o.sid AND d.r = o.r JOIN leafs l ON l.sid = o.sid AND l.node = d.node
  UNION ALL SELECT (SELECT max(it) FROM old) + 1, 'leaf', sid, 0, 0, value, {', '.join(BOUNDS)} FROM leafs WHERE EXISTS (SELECT 1 FROM old)))""",
                 f"leaf AS MATERIALIZED (SELECT sid, value, {', '.join(BOUNDS)} FROM boost WHERE kind = 'leaf')"]
        total = "any_value(base.f) + sum(value)::BIGINT"
        join = "JOIN base ON base.sid = {a}.sid"
    else:
        grown, leaves, _ = level_ctes(how, "bag")
        ctes += [f"draws AS (SELECT size, tree, CAST(('0x' || substr(sha256('{trees.SEED}:' || tree || ':' || draw), 1, 8))::BIGINT % size AS BIGINT) AS r FROM (SELECT DISTINCT size FROM lagr), range({how.trees}) a(tree), range(200) b(draw) WHERE draw < size)",
                 "bag AS MATERIALIZED (SELECT sid, tree, r, count(*) AS w, any_value(y) AS y FROM draws JOIN lagr USING (size, r) GROUP BY sid, tree, r)",
                 *grown, f"leaf AS MATERIALIZED ({leaves})"]
        total = f"CAST(round_even(sum(value)::DOUBLE / {how.trees}, 0) AS BIGINT)"
        join = ""
    ctes += [f"""future AS (
  SELECT sid, 0::BIGINT AS k, 0::BIGINT AS yi, {', '.join(f'(max(CASE WHEN t = n_fit - {n + 1 - j} THEN l.yi END))::BIGINT AS h{j}' for j in LAGS)} FROM sids JOIN lagged l USING ({KEY}) WHERE fit = 'full' GROUP BY sid
  UNION ALL SELECT sid, k + 1, p, {', '.join(f'h{j + 1}' for j in LAGS if j < n)}, p FROM (
    SELECT a.sid, a.k, {', '.join(f'any_value(a.h{j}) AS h{j}' for j in LAGS)}, greatest(0, {total}) AS p FROM future a JOIN leaf ON leaf.sid = a.sid AND {INSIDE(lambda j: f'a.h{j}')} {join.format(a='a')} WHERE a.k < {horizon} GROUP BY a.sid, a.k))""",
             f"""held AS (SELECT a.sid, a.t, {total} AS yi FROM (SELECT sid, t, {xs} FROM sids JOIN lagged USING ({KEY}) WHERE fit = 'holdout' AND t >= n_fit) a
  JOIN leaf ON leaf.sid = a.sid AND {INSIDE(lambda j: f'a.x{j}')} {join.format(a='a')} GROUP BY a.sid, a.t)""",
             f"""fc AS (
  SELECT {KEY}, fit, n_fit, last_month, k, f.yi / {float(trees.UNIT)}::DOUBLE AS yhat FROM future f JOIN sids USING (sid) WHERE k > 0
  UNION ALL SELECT {KEY}, fit, n_fit, last_month, t - n_fit + 1, h.yi / {float(trees.UNIT)}::DOUBLE FROM held h JOIN sids USING (sid))"""]
    return tuple(ctes)


def model_ctes(model: str, horizon: int, how: trees.Settings | None = None) -> tuple[str, ...]:
    least = fitable(forecast.MIN_HISTORY[model])
    if model in ("arima", "sarima"):
        return (least, *arima_ctes(horizon, model == "sarima"))
    return (least, *(prophet_ctes(horizon) if model == "prophet" else tree_ctes(horizon, how or forecast.TREES[model])))
