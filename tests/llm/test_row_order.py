"""The order in which a step adds up its changes: by row, ties as they come, near rows and far ones alike."""

import numpy as np
import pytest

from lumaframe.llm import lm


@pytest.mark.parametrize("low, wide", [(0, 1), (70_000, 65_535), (3, 65_536), (0, 400_000)])
def test_rows_in_order(low, wide):
    rows = low + np.random.default_rng(wide).integers(0, wide + 1, 5000)
    rows[:2] = low, low + wide
    assert (lm._order(rows) == sorted(range(len(rows)), key=lambda i: rows[i])).all()
