"""Tables of prefix codes: built in one pass over the symbols, once for equal codes."""

import random

import pytest

from lumaframe.kernels import vp8l
from lumaframe.plans import encode


def lengths_of(rng, n):
    out = [1, 1]
    while len(out) < n:
        k = rng.randrange(len(out))
        if out[k] < 15:
            out[k] += 1
            out.append(out[k])
    out += [0] * rng.randrange(5)
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("n", [2, 3, 40, 256, 600])
def test_words_in_order(n):
    rng = random.Random(n)
    for _ in range(10):
        lengths = lengths_of(rng, n)
        code, word, longest = vp8l.Code(lengths), 0, max(lengths)
        seen = 0
        for bits in range(1, longest + 1):
            for s in (s for s, k in enumerate(lengths) if k == bits):
                turned = int(f"{word:0{bits}b}"[::-1], 2)
                assert all(code.table[turned | k << bits] == (s, bits) for k in range(1 << longest - bits))
                seen += 1 << longest - bits
                word += 1
            word <<= 1
        assert seen == len(code.table)


def test_equal_codes_have_one_table():
    """A file of 8 x 8 pixels spent nine tenths of its time on tables that the file before had had too."""
    assert vp8l.Code([2, 1, 2]).table is vp8l.Code([2, 1, 2]).table
    held = vp8l._table.cache_info()
    assert held.maxsize is not None and held.maxsize * (1 << 15) <= 1 << 21


def test_lengths_that_are_all_equal_may_end_early():
    """A description of one length and of fewer symbols than the alphabet has leaves the others out."""
    out = encode.BitWriter()
    for v, k in ((0, 1), (8, 4), *((int(s == 2), 3) for s in vp8l.LENGTH_ORDER[:12]), (1, 1), (0, 3), (2, 2)):  # four symbols of 2 bits
        out.put(v, k)
    code = vp8l._read_code(vp8l.Bits(out.bytes()), 256)
    assert [code.table[k][0] for k in range(4)] == [0, 2, 1, 3] and code.bits == 2
