"""Dense view of one tile of grid nodes inside a task, and the cubic stencil on it."""

from __future__ import annotations

import numpy as np

from heliospark.functions.geometry import TWO_PI, coord_jacobian
from heliospark.functions.grid import GridSpec, keys_slopes, keys_weights

GHOST = 2
MIN_KEPT_WEIGHT = 1e-6
#: Points read at a time: their partial sums stay in cache.
_CHUNK = 1 << 11


def _along(weights, values):
    """Sum over the last axis but one, weighted at every point."""
    return np.einsum("kn,...kn->...n", weights, values)


def _by_axis(four):
    """Four weights of three axes (each 3, n) as the four of each axis."""
    out = np.empty((3, 4, four[0].shape[1]))
    for k, w in enumerate(four):
        out[:, k] = w
    return out


class Block:
    """Nodes with r index in [r0, r1) and theta index in [t0, t1), every azimuth, ghosts included."""

    def __init__(self, spec: GridSpec, box, i_r, i_t, i_p, columns) -> None:
        r0, r1, t0, t1 = box
        self.spec = spec
        self.r0, self.r1 = max(r0, -GHOST), min(r1, spec.n_r + GHOST)
        self.t0, self.t1 = max(t0, -GHOST), min(t1, spec.n_theta + GHOST)
        lo_r, hi_r = max(self.r0, 0), min(self.r1, spec.n_r)
        lo_t, hi_t = max(self.t0, 0), min(self.t1, spec.n_theta)
        core = np.full((hi_r - lo_r, hi_t - lo_t, spec.n_phi, len(columns)), np.nan)
        keep = (i_r >= lo_r) & (i_r < hi_r) & (i_t >= lo_t) & (i_t < hi_t)
        at = (i_r[keep] - lo_r, i_t[keep] - lo_t, i_p[keep])
        for c, column in enumerate(columns):
            core[(*at, c)] = column[keep]
        self.values = self._with_ghosts(core, lo_r - self.r0, self.r1 - hi_r, lo_t - self.t0, self.t1 - hi_t)
        self._planes = np.ascontiguousarray(self.values.reshape(-1, core.shape[3]).T)
        _, n_t, n_p, _ = self.values.shape
        four = np.arange(4)
        self._taps = (((four[:, None] * n_t + four)[:, :, None] * n_p) + four).reshape(-1, 1)
        self._room, self._held = np.empty(64 * _CHUNK * len(self._planes)), np.zeros(0, np.int64)
        #: Every position has its whole stencil here.
        self.whole = self.r0 == self.t0 == -GHOST and self.r1 == spec.n_r + GHOST and self.t1 == spec.n_theta + GHOST

    def _with_ghosts(self, v, r_low, r_high, t_low, t_high):
        # theta beyond a pole reads the mirrored row half a turn away
        turn = self.spec.n_phi // 2
        parts = [np.roll(v[:, :t_low][:, ::-1], turn, axis=2)] if t_low else []
        parts.append(v)
        if t_high:
            parts.append(np.roll(v[:, -t_high:][:, ::-1], turn, axis=2))
        v = np.concatenate(parts, axis=1)
        # r beyond an end follows the quadratic through the three nearest layers
        ghost = {1: (3.0, -3.0, 1.0), 2: (6.0, -8.0, 3.0)}
        low = [sum(w * v[k] for k, w in enumerate(ghost[d])) for d in range(r_low, 0, -1)]
        high = [sum(w * v[-1 - k] for k, w in enumerate(ghost[d])) for d in range(1, r_high + 1)]
        v = np.concatenate([*(x[None] for x in low), v, *(x[None] for x in high)])
        return np.concatenate([v[:, :, -GHOST:], v, v[:, :, :GHOST]], axis=2)

    def covers(self, fr, ft):
        """True where the whole 4-point stencil lies in the block."""
        br, bt = np.floor(fr), np.floor(ft)
        return (br - 1 >= self.r0) & (br + 2 < self.r1) & (bt - 1 >= self.t0) & (bt + 2 < self.t1)

    def _base(self, index):
        """First node of each stencil and its weights' positions (3, n)."""
        _, n_t, n_p, _ = self.values.shape
        base = np.floor(index)
        start = ((base[0] - (1 + self.r0)) * n_t + (base[1] - (1 + self.t0))) * n_p + (base[2] - (1 - GHOST))
        return start.astype(np.int64), index - base

    def cubic(self, fr, ft, fp, gradient=False, skip_nan=False):
        """Tricubic values (n, C); with ``gradient`` also d/d(index) (n, 3, C)."""
        value, slope = self.read(np.stack((fr, ft, fp)), gradient, skip_nan)
        return value.T, slope.transpose(2, 0, 1) if gradient else None

    def read(self, index, gradient=False, skip_nan=False):
        """As ``cubic`` at index (3, n), components first: (C, n) and (3, C, n)."""
        n, width = index.shape[1], self.values.shape[3]
        value = np.empty((width, n))
        slope = np.empty((3, width, n)) if gradient else None
        for lo in range(0, n, _CHUNK):
            part = slice(lo, lo + _CHUNK)
            out = self._cubic_chunk(index[:, part], gradient, skip_nan)
            value[:, part] = out[0]
            if gradient:
                for d in range(3):
                    slope[d, :, part] = out[1][d]
        return value, slope

    def _cubic_chunk(self, index, gradient, skip_nan):
        """Sum axis by axis; points run along the last axis, so every operation is one long vector."""
        start, frac = self._base(index)
        w_r, w_t, w_p = _by_axis(keys_weights(frac))
        taps = self._gathered(start).reshape(-1, 4, 4, 4, len(start))
        if skip_nan:
            good = np.isfinite(taps)
            total, kept = (_along(w_r, _along(w_t, _along(w_p, v))) for v in (np.where(good, taps, 0.0), good.astype(float)))
            usable = np.abs(kept) > MIN_KEPT_WEIGHT
            return np.where(usable, total / np.where(usable, kept, 1.0), np.nan), None
        rows = _along(w_p, taps)
        layers = _along(w_t, rows)
        total = _along(w_r, layers)
        if not gradient:
            return total, None
        s_r, s_t, s_p = _by_axis(keys_slopes(frac))
        return total, (_along(s_r, layers), _along(w_r, _along(s_t, rows)), _along(w_r, _along(w_t, _along(s_p, taps))))

    def _gathered(self, start):
        """The 64 nodes of each stencil (C, 64, n). Those of the last portion stay: the stages of a step read mostly the same."""
        width, n = len(self._planes), len(start)
        room = self._room[: width * 64 * n].reshape(width, 64, n)
        moved = np.flatnonzero(start != self._held) if len(self._held) == n else None
        if moved is None or 3 * len(moved) > n:
            self._planes.take(start + self._taps, axis=1, mode="clip", out=room)
        elif len(moved):
            room[:, :, moved] = self._planes.take(start[moved] + self._taps, axis=1, mode="clip")
        self._held = start
        return room

    def nearest(self, fr, ft, fp):
        """Values of the nearest node."""
        _, n_t, n_p, _ = self.values.shape
        br, bt, bp = (np.floor(f + 0.5).astype(np.int64) for f in (fr, ft, fp))
        return self._planes[:, ((br - self.r0) * n_t + bt - self.t0) * n_p + bp + GHOST].T


class BlockField:
    """Magnetic field read from a block; positions are (n, 3) Cartesian.

    A position whose stencil the block does not hold has no value here; ``read`` tells it apart from
    a position that has no value anywhere.
    """

    def __init__(self, block: Block) -> None:
        self.block, self.spec = block, block.spec

    def _index(self, p):
        """Fractional index (3, n) of positions, as ``GridSpec.index_of`` with the radial one held within the ghosts."""
        x, y, z = p.T
        ring = x * x + y * y
        r = np.sqrt(ring + z * z)
        np.sqrt(ring, out=ring)
        index = np.empty((3, len(r)))
        np.clip(self.spec.parameter(r, np) * float(self.spec.n_r - 1), -1.0, self.spec.n_r - 1.0, out=index[0])
        theta, phi = np.arctan2(ring, z, out=index[1]), np.arctan2(y, x, out=index[2])
        theta /= self.spec.theta_step
        theta -= 0.5
        phi += TWO_PI * (phi < 0.0)
        phi /= self.spec.phi_step
        phi -= self.spec.n_phi * (phi >= self.spec.n_phi)  # an angle below a turn needs no remainder
        return index, r, ring

    def step_ceiling(self, p):
        x, y, z = p.T
        # the azimuthal edge never counts below the meridional one, so the colatitude does not matter
        return self.spec.cell_extent(np.sqrt(x * x + y * y + z * z), 0.0, np)

    def b(self, p):
        return self.read(p, [])[0].T

    def read(self, p, carried):
        """B (3, n), its change along each of the vectors ``carried`` (3, n), and which positions have a value or none anywhere."""
        index, r, ring = self._index(p)
        known = np.isfinite(index).all(axis=0)
        here = known if self.block.whole else known & self.block.covers(index[0], index[1])
        held = None if self.block.whole else here | ~known
        if here.all():
            return *self._values(index, r, ring, p, carried), held
        b = np.full((3, len(p)), np.nan)
        turned = [np.full((3, len(p)), np.nan) for _ in carried]
        b[:, here], some = self._values(index[:, here], r[here], ring[here], p[here], [v[:, here] for v in carried])
        for out, part in zip(turned, some):
            out[:, here] = part
        return b, turned, held

    def _values(self, index, r, ring, p, carried):
        value, slope = self.block.read(index, gradient=bool(carried))
        turned = []
        if carried:
            x, y, z = p.T
            per_r, per_t, per_p = self.spec.index_slope(r, np)
            with np.errstate(divide="ignore", invalid="ignore"):  # no value on the polar axis
                per_r, per_t, per_p = per_r / r, per_t / (r * r), per_p / (ring * ring)
                for v in carried:
                    across = x * v[0] + y * v[1]
                    change = slope[0] * ((across + z * v[2]) * per_r)
                    change += slope[1] * ((z * across / ring - ring * v[2]) * per_t)
                    change += slope[2] * ((x * v[1] - y * v[0]) * per_p)
                    turned.append(change)
        return value, turned


def cartesian_gradient(spec: GridSpec, slope, x, y, z, r) -> np.ndarray:
    """Index-space gradients (n, 3, C) to Cartesian ones (n, C, 3)."""
    rows = coord_jacobian(x, y, z, np)
    per_index = spec.index_slope(r, np)
    grad = np.zeros((len(x), slope.shape[2], 3))
    for d in range(3):
        towards = np.stack([c * per_index[d] for c in rows[d]], axis=1)
        grad += slope[:, d, :, None] * towards[:, None, :]
    return grad
