import resource

import numpy as np
import pytest

from heliospark.llm import frames


def resident() -> int:
    """MB of this process."""
    with open("/proc/self/statm") as file:
        return int(file.read().split()[1]) * resource.getpagesize() >> 20


@pytest.mark.skipif(frames._trim is None, reason="needs glibc")
def test_freed_arrays_leave_the_worker():
    held = [np.ones(8 << 10) for _ in range(4_000)]  # 64 KB each, below the size that is mapped alone
    last, full = held[-1], resident()
    del held
    frames.release()
    assert resident() < full - 150
    assert len(last)
