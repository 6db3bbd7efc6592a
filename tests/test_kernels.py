"""The Arrow kernel against dense arithmetic, also on slices."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from ticketweave.functions import kernels

FEATURES = 12
ROWS = st.lists(st.dictionaries(st.integers(0, FEATURES - 1), st.integers(1, 9), max_size=6), max_size=12)


def column(rows):
    kind = pa.list_(pa.struct([("bucket", pa.int32()), ("tf", pa.int32())]))
    return pa.array([[{"bucket": b, "tf": n} for b, n in sorted(r.items())] for r in rows], kind)


@settings(max_examples=200, deadline=None)
@given(rows=ROWS, columns=st.integers(1, 4), start=st.integers(0, 3))
def test_dot_rows(rows, columns, start):
    dense = np.arange(FEATURES * columns, dtype=float).reshape(columns, FEATURES) - 7
    plain = np.zeros((len(rows), FEATURES))
    for i, r in enumerate(rows):
        for b, n in r.items():
            plain[i, b] = n
    offsets, buckets, counts = kernels.csr_parts(column(rows).slice(start))
    got = kernels.dot_rows(offsets, buckets, counts, dense)
    assert np.array_equal(got, dense @ plain.T[:, start:])


def test_row_sums_of_empty_rows():
    assert kernels.row_sums(np.array([0, 0, 2, 2]), np.array([1.0, 2.0])).tolist() == [0.0, 3.0, 0.0]


def test_rounding_is_half_up():
    assert kernels.round6(np.array([0.0000005, 0.1234565, 1 / 3])).tolist() == [0.000001, 0.123457, 0.333333]
