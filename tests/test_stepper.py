"""Lines that cross the inner sphere and come out again within one step."""

import numpy as np

from heliospark.functions.grid import GridSpec
from heliospark.operators import stepper
from heliospark.operators.blocks import Block


class Uniform:
    """A field of one direction, read anywhere."""

    def step_ceiling(self, p):
        return np.full(len(p), 0.4)

    def b(self, p):
        return np.tile([1.0, 0.0, 0.0], (len(p), 1))


def test_a_grazing_chord_ends_the_line():
    # half chords from a fifth to two hundredths of a step, and lines that pass above the sphere
    half = np.array([0.04, 0.02, 0.004])
    across = np.concatenate([np.sqrt(1.0 - half**2), [1.0 + 1e-6, 1.2]])
    start = np.array([-0.117, -0.11, -0.103, -0.11, -0.11])
    y = np.stack([start, across, np.zeros(5)], axis=1)
    nan = np.full(5, np.nan)
    memory = dict(step=nan.copy(), err=np.full(5, stepper.ERROR_FLOOR), rejected=np.zeros(5, bool), arc=np.zeros(5))
    memory |= {c: np.zeros(5, np.int64) for c in ("reversals", "turns", "tries")} | {"code": np.full(5, stepper.ACTIVE)}
    lanes = stepper.Lanes(y.copy(), np.full((5, 3), np.nan), np.ones(5), np.zeros(5), **memory)
    stepper.march(Uniform(), lanes, stepper.TraceOptions(), 1.0, 2.5)
    assert lanes.code.tolist() == [stepper.INNER] * 3 + [stepper.OUTER] * 2
    assert np.allclose(lanes.y[:3, 0], -half, atol=1e-9) and np.allclose(lanes.arc[:3], -half - start[:3], atol=1e-9)
    assert np.allclose(lanes.y[3:, 0], np.sqrt(6.25 - across[3:] ** 2), atol=1e-9)


def test_landings_are_found_together(monkeypatch):
    calls = []
    land = stepper._land
    monkeypatch.setattr(stepper, "_land", lambda *args: (calls.append(len(args[2])), land(*args)))
    y = np.stack([np.linspace(1.01, 2.4, 40), np.zeros(40), np.zeros(40)], axis=1)
    memory = dict(step=np.full(40, np.nan), err=np.full(40, stepper.ERROR_FLOOR), rejected=np.zeros(40, bool), arc=np.zeros(40))
    memory |= {c: np.zeros(40, np.int64) for c in ("reversals", "turns", "tries")} | {"code": np.full(40, stepper.ACTIVE)}
    lanes = stepper.Lanes(y.copy(), np.full((40, 3), np.nan), np.ones(40), np.zeros(40), **memory)
    stepper.march(Uniform(), lanes, stepper.TraceOptions(cfl=0.1), 1.0, 2.5)
    assert len(set(lanes.tries.tolist())) > 10 and calls == [40]
    assert np.allclose(lanes.arc, 2.5 - y[:, 0], atol=1e-12)


def test_nodes_that_stay_are_not_gathered_again():
    spec = GridSpec(6, 8, 12, inner=1.0, outer=2.5)
    at = [a.ravel() for a in np.meshgrid(np.arange(6), np.arange(8), np.arange(12), indexing="ij")]
    random = np.random.default_rng(3)
    values = [random.random(len(at[0])) for _ in range(3)]
    block = Block(spec, (-9, 20, -9, 20), *at, values)
    index = np.stack([random.random(500) * 5, random.random(500) * 7, random.random(500) * 12])
    gathered = []
    planes = block._planes

    class Counted:
        def __len__(self):
            return len(planes)

        def take(self, which, **how):
            gathered.append(which.shape[1])
            return planes.take(which, **how)

    block._planes = Counted()
    for move in (0.0, 0.0, 0.02, 0.02, 1.0):  # the same, some in other cells, most in other cells
        index[0] = np.clip(index[0] + move, 0.0, 5.0)
        got = block.cubic(*index, gradient=True)
        want = Block(spec, (-9, 20, -9, 20), *at, values).cubic(*index, gradient=True)
        assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])
    assert gathered[0] == gathered[-1] == 500 and len(gathered) == 4 and max(gathered[1:3]) < 50
