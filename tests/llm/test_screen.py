from math import ceil, comb

import pytest

from loamlog.llm import minhash


@pytest.mark.parametrize("threshold", [0.8, 0.85])
def test_screen_misses_less_than_the_bands(threshold):
    """A pair right at the threshold, by the binomial law of equal low bits."""
    n = minhash.BANDS * minhash.ROWS
    chance = 2.0**-minhash.BITS
    floor = threshold - minhash.SCREEN_SIGMAS * (threshold * (1 - threshold) / n) ** 0.5
    equal = threshold + (1 - threshold) * chance
    need = ceil(n * (chance + (1 - chance) * floor))
    missed = sum(comb(n, k) * equal**k * (1 - equal) ** (n - k) for k in range(need))
    assert missed < (1 - threshold**minhash.ROWS) ** minhash.BANDS
