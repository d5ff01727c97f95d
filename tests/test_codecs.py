import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from suffloom.functions import codecs


def test_vectors():
    assert codecs.vbyte_encode(np.array([0, 127, 128, 300, 16384])).hex() == "007f8001ac02808001"
    assert codecs.uint40_encode(np.array([0, 258, 1 << 32, codecs.UINT40_MAX])).hex() == "0000000000" "0201000000" "0000000001" "ffffffffff"
    assert codecs.bits_encode(np.array([1, 0, 0, 0, 0, 0, 0, 0, 1])).hex() == "0101"


@given(st.lists(st.integers(0, 2**64 - 1)))
def test_vbyte_roundtrip(values):
    assert codecs.vbyte_decode(codecs.vbyte_encode(np.array(values, np.uint64))).tolist() == values


@given(st.lists(st.integers(0, codecs.UINT40_MAX)))
def test_uint40_roundtrip(values):
    assert codecs.uint40_decode(codecs.uint40_encode(np.array(values, np.int64))).tolist() == values


@given(st.lists(st.booleans()))
def test_bits_roundtrip(values):
    assert codecs.bits_decode(codecs.bits_encode(np.array(values, bool)), len(values)).tolist() == values


def test_range_is_checked():
    with pytest.raises(ValueError):
        codecs.uint40_encode(np.array([1 << 40]))
    with pytest.raises(ValueError):
        codecs.uint40_decode(b"1234")
    with pytest.raises(ValueError):
        codecs.vbyte_decode(b"\x80")


@pytest.mark.parametrize(("text", "value"), [("10k", 10_000), ("1Mi", 1 << 20), ("3G", 3 * 10**9), ("2ti", 2 << 40), ("17", 17)])
def test_sizes(text, value):
    assert codecs.parse_size(text) == value


@pytest.mark.parametrize("text", ["10kb", "k", "", "-1", "1.5G"])
def test_bad_sizes(text):
    with pytest.raises(ValueError):
        codecs.parse_size(text)
