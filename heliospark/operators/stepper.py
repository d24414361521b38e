"""Adaptive arc-length stepping of many half lines inside one task (vectorised NumPy).

The pair is the 5(4) Runge-Kutta of Dormand and Prince (1980) with the quartic dense output of
Shampine (1986); steps follow a PI controller under a ceiling tied to the local cell size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# End codes of a half line.
ACTIVE, INNER, OUTER, NULL, MAX_STEPS, STALLED, DEFLECTED = -1, 0, 1, 2, 3, 4, 5

# Stage weights, solution weights, error weights, dense-output polynomial.
STAGES = (
    (1 / 5,),
    (3 / 40, 9 / 40),
    (44 / 45, -56 / 15, 32 / 9),
    (19372 / 6561, -25360 / 2187, 64448 / 6561, -212 / 729),
    (9017 / 3168, -355 / 33, 46732 / 5247, 49 / 176, -5103 / 18656),
)
SOLUTION = (35 / 384, 0.0, 500 / 1113, 125 / 192, -2187 / 6784, 11 / 84)
ERROR = (71 / 57600, 0.0, -71 / 16695, 71 / 1920, -17253 / 339200, 22 / 525, -1 / 40)
DENSE = (
    (1.0, -8048581381 / 2820520608, 8663915743 / 2820520608, -12715105075 / 11282082432),
    (0.0, 0.0, 0.0, 0.0),
    (0.0, 131558114200 / 32700410799, -68118460800 / 10900136933, 87487479700 / 32700410799),
    (0.0, -1754552775 / 470086768, 14199869525 / 1410260304, -10690763975 / 1880347072),
    (0.0, 127303824393 / 49829197408, -318862633887 / 49829197408, 701980252875 / 199316789632),
    (0.0, -282668133 / 205662961, 2019193451 / 616988883, -1453857185 / 822651844),
    (0.0, 40617522 / 29380423, -110615467 / 29380423, 69997945 / 29380423),
)
# Fixed values of the step controller.
SAFETY, MEMORY, SHRINK, GROW = 0.9, 0.04, 0.2, 10.0
RESPONSE = 0.2 - 0.75 * MEMORY
ERROR_FLOOR, TOLERANCE, TINY_STEP = 1e-4, 1e-7, 1e-11
#: Lanes that step together: what a step reads and makes of them stays in cache.
PORTION = 1 << 11


@dataclass(frozen=True)
class TraceOptions:
    rtol: float = 1e-4
    cfl: float = 0.5
    max_steps: int = 10_000
    max_reversals: int = 8
    turn_angle: float = 45.0
    turn_radius: float = 2.0
    weak_fraction: float = 1e-5
    min_turns: int = 3

    def __post_init__(self) -> None:
        if not 0.0 < self.cfl < 1.0:
            raise ValueError("cfl lies strictly between 0 and 1, so a step stays within the ghost layers")


class Lanes:
    """Half lines of one task: state, controller memory and counters, one array each."""

    FIELDS = ("step", "err", "rejected", "arc", "reversals", "turns", "tries", "code")

    def __init__(self, y, slope, direction, weak, **memory) -> None:
        self.y, self.slope, self.direction, self.weak = y, slope, direction, weak
        for name in self.FIELDS:
            setattr(self, name, memory[name])
        self.trail: list[tuple[np.ndarray, np.ndarray]] | None = None

    def note(self, lanes, points) -> None:
        if self.trail is not None:
            self.trail.append((lanes, points.copy()))


def slope_of(field, y, direction):
    """d(state)/d(arc length): the unit field, and the deviations carried by its gradient; and which lanes ``field`` could
    read (None: all). Components run along the first axis, so every operation is one long vector."""
    carried = [y[k : k + 3] for k in range(3, len(y), 3)]
    b, turned, held = field.read(y[:3].T, carried) if hasattr(field, "read") else (*_read_all(field, y[:3].T, carried), None)
    out = np.empty_like(y)
    with np.errstate(divide="ignore", invalid="ignore"):
        size = _length(b)
        unit = np.divide(b, size, out=out[:3])
        for k, change in enumerate(turned, start=1):
            change -= unit * _dot(unit, change)
            np.divide(change, size, out=out[3 * k : 3 * k + 3])
    out *= direction
    return out, held


def _read_all(field, p, carried):
    """B (3, n) and its change along each carried vector, of a field that can be read anywhere."""
    if not carried:
        return field.b(p).T, []
    b, jac = field.b_and_jacobian(p)
    return b.T, [np.einsum("nij,jn->in", jac, v) for v in carried]


def _dot(a, b):
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _length(a):
    return np.sqrt(_dot(a, a))


def _sum(weights, k):
    """Weighted sum of the first slopes of a step."""
    s = len(weights)
    return (np.asarray(weights) @ k[:s].reshape(s, -1)).reshape(k.shape[1:])


def march(field, lanes: Lanes, opt: TraceOptions, inner: float, outer: float) -> None:
    """Advance every active lane until it ends or leaves what ``field`` can read."""
    state, slope = np.ascontiguousarray(lanes.y.T), np.ascontiguousarray(lanes.slope.T)
    live = np.flatnonzero(lanes.code == ACTIVE)
    fresh = live[np.isnan(lanes.step[live])]
    if fresh.size:
        lanes.step[fresh] = opt.cfl * field.step_ceiling(state[:3, fresh].T)
        slope[:, fresh] = slope_of(field, state[:, fresh], lanes.direction[fresh])[0]
    landings: list[tuple] = []
    while live.size:
        live = _retire(lanes, live, lanes.tries[live] >= opt.max_steps, MAX_STEPS)
        live = _retire(lanes, live, ~np.isfinite(slope[:, live]).all(axis=0), NULL)
        if not live.size:
            break
        parts = [live[lo : lo + PORTION] for lo in range(0, live.size, PORTION)]
        live = np.concatenate([_step(field, lanes, state, slope, landings, part, opt, inner, outer) for part in parts])
    if landings:  # all at once: bisections of few lanes each cost as many calls as of all
        _land(lanes, state, *(np.concatenate(parts, axis=-1) for parts in zip(*landings)), inner, outer)
    lanes.y, lanes.slope = np.ascontiguousarray(state.T), np.ascontiguousarray(slope.T)


def _step(field, lanes, state, slope, landings, live, opt, inner, outer):
    """Try one step of some lanes; gives those that go on."""
    y, direction = state[:, live], lanes.direction[live]
    ceiling = opt.cfl * field.step_ceiling(y[:3].T)
    h = np.minimum(lanes.step[live], ceiling)
    k = np.empty((7, *y.shape))
    k[0] = slope[:, live]
    held = None
    for s, row in enumerate((*STAGES, SOLUTION), start=1):
        at = y + h * _sum(row, k)
        k[s], here = slope_of(field, at, direction)
        if here is not None:
            held = here if held is None else held & here
    if held is not None and not held.all():
        live, y, at, h, ceiling, k = live[held], y[:, held], at[:, held], h[held], ceiling[held], k[:, :, held]
    if live.size:
        lanes.tries[live] += 1
        _settle(field, lanes, state, slope, landings, live, y, at, h, ceiling, k, opt, inner, outer)
    return live[lanes.code[live] == ACTIVE]


def _retire(lanes, live, done, code):
    lanes.code[live[done]] = code
    return live[~done]


def _settle(field, lanes, state, slope, landings, live, y, new, h, ceiling, k, opt, inner, outer) -> None:
    """Accept, land or reject one attempted step of each live lane."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        scale = TOLERANCE + opt.rtol * np.maximum(np.abs(y), np.abs(new))
        wrong = h * _sum(ERROR, k) / scale
        err = np.sqrt(np.mean(wrong * wrong, axis=0))
        err = np.where(np.isfinite(err), err, np.inf)
        factor = SAFETY * err**-RESPONSE
    good = err <= 1.0
    reach = _length(new)
    lowest, until = _dips(y, new, h, k, good & (reach > inner), inner)
    under = lowest <= inner
    landed = good & ((reach >= outer) | (reach <= inner) | under)
    reach = np.where(under, lowest, reach)
    stepped = good & ~landed

    at = live[stepped]
    if at.size:
        turn = _dot(k[0][:3], k[6][:3])[stepped]
        limit = np.where(lanes.rejected[at], 1.0, GROW)
        with np.errstate(invalid="ignore"):
            grown = np.clip(factor[stepped] * lanes.err[at] ** MEMORY, SHRINK, limit)
        state[:, at], slope[:, at] = new[:, stepped], k[6][:, stepped]
        lanes.arc[at] += h[stepped]
        lanes.step[at] = h[stepped] * grown
        lanes.err[at] = np.maximum(err[stepped], ERROR_FLOOR)
        lanes.rejected[at] = False
        lanes.note(at, new[:3, stepped].T)
        _guard(field, lanes, state, at, turn, reach[stepped], opt)

    if landed.any():
        at = live[landed]
        lanes.code[at] = np.where(reach[landed] >= outer, OUTER, INNER)
        landings.append((at, y[:, landed], h[landed], k[:, :, landed], until[landed]))

    bad = ~good
    if bad.any():
        at = live[bad]
        lanes.step[at] = h[bad] * np.clip(factor[bad], SHRINK, 1.0)
        lanes.rejected[at] = True
        lanes.code[at[lanes.step[at] < TINY_STEP * ceiling[bad]]] = MAX_STEPS


def _guard(field, lanes, state, at, turn, reach, opt) -> None:
    """Stop lines that thrash (many reversals) or bend sharply where the field is weak."""
    if opt.max_reversals > 0:
        lanes.reversals[at] += turn < 0.0
    guarded = lanes.weak[at] > 0.0
    if opt.turn_angle > 0 and guarded.any():
        sharp = guarded & (turn < np.cos(np.radians(opt.turn_angle))) & (reach > opt.turn_radius)
        corner = at[sharp]
        if corner.size:
            weak = np.linalg.norm(field.b(state[:3, corner].T), axis=1) < lanes.weak[corner]
            lanes.turns[corner[weak]] += 1
        lanes.code[at[guarded & (lanes.turns[at] >= opt.min_turns)]] = DEFLECTED
    if opt.max_reversals > 0:
        stuck = (lanes.reversals[at] >= opt.max_reversals) & (lanes.code[at] == ACTIVE)
        lanes.code[at[stuck]] = STALLED


def _dense(y, h, k, width):
    """The dense-output curve of each step: its first ``width`` components at a share of the step."""
    c = [_sum(np.asarray(DENSE)[:, p], k)[:width] for p in range(4)]

    def state(t):
        return y[:width] + h * t * (c[0] + t * (c[1] + t * (c[2] + t * c[3])))

    def slope(t):
        return c[0] + t * (2 * c[1] + t * (3 * c[2] + t * 4 * c[3]))

    return state, slope


def _dips(y, new, h, k, asked, inner):
    """Smallest radius of a step that falls and rises again, and where; a line may cross the inner sphere and
    come out within one step. Other steps have no smallest radius inside."""
    lowest, until = np.full(len(h), np.inf), np.ones(len(h))
    falls = _dot(k[0], y) < 0.0
    rises = _dot(k[6], new) > 0.0
    start = _length(y)
    # a step is not longer than its arc, so one that starts higher cannot reach the sphere
    near = np.flatnonzero(asked & falls & rises & (start > inner) & (start - inner <= h))
    if near.size:
        state, slope = _dense(y[:, near], h[near], k[:, :, near], 3)
        low, high = np.zeros(near.size), np.ones(near.size)
        while np.any(high - low >= 1e-14):
            middle = 0.5 * (low + high)
            down = _dot(state(middle), slope(middle)) < 0.0
            low, high = np.where(down, middle, low), np.where(down, high, middle)
        until[near] = 0.5 * (low + high)
        lowest[near] = _length(state(until[near]))
        until[near[lowest[near] > inner]] = 1.0
    return lowest, until


def _land(lanes, states, at, y, h, k, until, inner, outer) -> None:
    """Find where the dense-output curve meets the sphere, by bisection up to ``until``."""
    target = np.where(lanes.code[at] == OUTER, outer, inner)
    whole, place = _dense(y, h, k, len(y))[0], _dense(y, h, k, 3)[0]

    def side(t):
        p = place(t)
        return np.sign(_dot(p, p) - target * target)

    low, high = np.zeros(len(at)), until.copy()
    start = side(low)
    while np.any(high - low >= 1e-14):
        middle = 0.5 * (low + high)
        same = side(middle) == start
        low, high = np.where(same, middle, low), np.where(same, high, middle)
    t = 0.5 * (low + high)
    states[:, at] = whole(t)
    lanes.arc[at] += t * h
    lanes.note(at, states[:3, at].T)
