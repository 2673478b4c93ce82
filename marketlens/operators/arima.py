"""ARIMA(1,1,1) and SARIMA(1,1,1)(1,0,0,12) for all series at once.

The model of the first differences w is (1 - p B)(1 - s B^12) w = (1 + q B) e,
with s = 0 for ``arima``. It is estimated by the conditional sum of squares:
with w and e zero before the sample and the first residual zero, the residuals
and their derivatives are recursions over time. One ``aggregate`` over the
array of differences gives the sum of squares and the normal equations of a
trial, an outer ``aggregate`` does ``ROUNDS`` damped Gauss-Newton steps
(Levenberg-Marquardt). A series is one row, so estimating is one projection:
no shuffle, no Python, no loop on the driver.

p, q and s stay within +-``BOUND``. A season that the sample does not show (12
differences or fewer) has no derivative, so s stays 0 there; the model is the
same for every length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 20
SEASON = 12
BOUND = 0.99
#: Damping of the first step; divided or multiplied by ten after each.
DAMPING = 0.01
#: Share of the trace added to the diagonal.
FLOOR = 1e-9

SUMS = ("css", "a11", "a12", "a13", "a22", "a23", "a33", "b1", "b2", "b3")
FACTORS = {"css": ("e", "e"), "a11": ("dp", "dp"), "a12": ("dp", "dq"), "a13": ("dp", "ds"), "a22": ("dq", "dq"), "a23": ("dq", "ds"), "a33": ("ds", "ds"),
           "b1": ("dp", "e"), "b2": ("dq", "e"), "b3": ("ds", "e")}


# Expressions are SQL text: one parse instead of a call per node.

def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for a value that is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def _at(a: str, i: str) -> str:
    return f"coalesce(get({a}, {i}), 0D)"


def _clip(x: str) -> str:
    return f"greatest(-{BOUND}D, least({BOUND}D, {x}))"


def differences(y: str) -> str:
    return f"transform(sequence(1, size({y}) - 1), i -> get({y}, i) - get({y}, i - 1))"


def residuals(w: str, trial: str, seasonal: bool) -> str:
    """The last residual ``e``, the sum of squares and the normal equations of
    one trial (tp, tq, ts). A step first adds up what the step before it found."""
    p, q, s = (f"{trial}.{n}" for n in ("tp", "tq", "ts"))
    w12, w13 = (_at(w, f"t - {SEASON}"), _at(w, f"t - {SEASON + 1}")) if seasonal else ("0D", "0D")
    u1 = f"({_at(w, 't - 1')} - {s} * {w13})"
    added = {k: f"r.{k} + r.{a} * r.{b}" for k, (a, b) in FACTORS.items()}
    step = _struct(
        e=f"({_at(w, 't')} - {s} * {w12}) - {p} * {u1} - {q} * r.e", dp=f"-{u1} - {q} * r.dp", dq=f"-r.e - {q} * r.dq",
        ds=f"{p} * {w13} - {w12} - {q} * r.ds" if seasonal else "0D", **added)
    zero = _struct(**{n: "0D" for n in ("e", "dp", "dq", "ds", *SUMS)})
    return f"aggregate(sequence(1, size({w}) - 1), {zero}, (r, t) -> {step}, r -> {_struct(e='r.e', **added)})"


def _det(m: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def _trial(x: str, seasonal: bool) -> str:
    """The parameters one damped step from the best so far."""
    best, lam = f"{x}.best", f"{x}.lam"
    diagonal = lambda n: f"({best}.{n} + {best}.{n} * {lam} + floor_)"
    a = lambda n: f"{best}.{n}"
    m = [[diagonal("a11"), a("a12"), a("a13")], [a("a12"), diagonal("a22"), a("a23")], [a("a13"), a("a23"), diagonal("a33")]]
    b = [a("b1"), a("b2"), a("b3")]
    move = [f"if(det > 0, {_det([[b[r] if c == k else m[r][c] for c in range(3)] for r in range(3)])} / det, 0D)" for k in range(3)]
    moved = [_clip(f"{best}.{n} - {move[k]}") for k, n in enumerate(("p", "q", "s"))]
    out = _struct(best=best, lam=lam, tp=moved[0], tq=moved[1], ts=moved[2] if seasonal else "0D")
    return _let(f"{FLOOR}D * ({a('a11')} + {a('a22')} + {a('a33')})", "floor_", _let(_det(m), "det", out))


def estimated(w: str, seasonal: bool) -> str:
    """Struct with p, q, s and the last residual e of the best trial."""
    fields = ("p", "q", "s", "e", *SUMS)
    own = f"aggregate(sequence(1, size({w}) - 1), 0D, (a, t) -> a + get({w}, t) * get({w}, t - 1))"
    squares = f"aggregate({w}, 0D, (a, x) -> a + x * x)"
    start = _let(own, "own", _let(squares, "squares", f"if(squares > 0, {_clip('own / squares')}, 0D)"))
    init = _struct(best=_struct(p="0D", q="0D", s="0D", e="0D", **{n: "double('inf')" if n == "css" else "0D" for n in SUMS}), lam=f"{DAMPING}D", tp=start, tq="0D", ts="0D")
    mine = {"p": "f.tp", "q": "f.tq", "s": "f.ts", **{n: f"g.{n}" for n in ("e", *SUMS)}}
    chosen = _struct(best=_struct(**{n: f"if(g.css < f.best.css, {mine[n]}, f.best.{n})" for n in fields}), lam="if(g.css < f.best.css, f.lam / 10D, f.lam * 10D)")
    round_ = _let(residuals(w, "f", seasonal), "g", _let(chosen, "x", _trial("x", seasonal)))
    return f"aggregate(sequence(1, {ROUNDS}), {init}, (f, n_) -> {round_}, f -> f.best)"


def path(y_last: str, w: str, est: str, steps: str, seasonal: bool) -> str:
    """Forecast levels 1 ... ``steps`` after the sample."""
    back = lambda k: _at("s.ws", f"size({w}) + k - 1 - {k}")
    s12, s13 = (f"{est}.s * {back(SEASON)}", f"{est}.s * {back(SEASON + 1)}") if seasonal else ("0D", "0D")
    new = f"{s12} + {est}.p * ({back(1)} - {s13}) + if(k = 1, {est}.q * {est}.e, 0D)"
    step = _let(new, "d", _struct(ws="concat(s.ws, array(d))", y="s.y + d", out="concat(s.out, array(s.y + d))"))
    zero = _struct(ws=w, y=y_last, out="cast(array() as array<double>)")
    return f"aggregate(sequence(1, cast({steps} as int)), {zero}, (s, k) -> {step}, s -> s.out)"


def forecast(y: str, steps: str, seasonal: bool) -> str:
    """Forecast path of the array ``y`` of values in time order."""
    return _let(differences(y), "w", _let(estimated("w", seasonal), "est", path(f"element_at({y}, -1)", "w", "est", steps, seasonal)))


def forecasts(fits: list[tuple[str, str]], seasonal: bool) -> Column:
    """Array of the forecast paths of some (values, steps) of a row."""
    each = ", ".join(_struct(ys=y, steps=f"cast({k} as int)") for y, k in fits)
    return F.expr(f"transform(array({each}), u -> {forecast('u.ys', 'u.steps', seasonal)})")


# --- ridge of the trend model (I6) -----------------------------------------------

def cholesky_stages(n: int, a: str = "a", b: str = "b", x: str = "x") -> list[list[tuple[str, str]]]:
    """SQL of the solution x0 ... of a symmetric positive definite n x n system
    with columns a{i}{j} (i >= j) and b{i}: stages of (name, expression), each
    over the columns of the stages before it."""
    out, total = [], lambda terms: "".join(f" - {t}" for t in terms)
    for k in range(n):
        out.append([(f"l{k}{k}", f"sqrt({a}{k}{k}{total(f'l{k}{j} * l{k}{j}' for j in range(k))})")])
        below = [(f"l{i}{k}", f"({a}{i}{k}{total(f'l{i}{j} * l{k}{j}' for j in range(k))}) / l{k}{k}") for i in range(k + 1, n)]
        out.append([*below, (f"z{k}", f"({b}{k}{total(f'l{k}{j} * z{j}' for j in range(k))}) / l{k}{k}")])
    for k in reversed(range(n)):
        out.append([(f"{x}{k}", f"(z{k}{total(f'l{j}{k} * {x}{j}' for j in range(k + 1, n))}) / l{k}{k}")])
    return out


def solved(df, n: int, keep: list[str]):
    """``keep`` and x0 ... x{n-1} of a frame with the columns of the system."""
    every = [f"{e} AS {name}" for stage in cholesky_stages(n) for name, e in stage]  # later ones use earlier ones
    return df.selectExpr("*", *every).select(*keep, *[f"x{i}" for i in range(n)])
