"""Words of many texts at once as small integers, by Arrow's dictionaries: equal words have equal codes, whatever their hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from corpusflow.llm import arrays


def word_codes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, firsts, at, packed, values) of the words of texts laid out as by arrays.chunks().

    codes: a number for each word; firsts: text i has the words firsts[i]:firsts[i + 1]; packed[at[j]:at[j + 1]]: the bytes of
    word j; values: the first word of each code.
    """
    inside = ~arrays.IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = bounds[:-1][bounds[:-1] < len(data)]
    first[edges] |= inside[edges]  # two texts may meet without white space
    starts = np.flatnonzero(first)
    packed, at = data[inside], np.flatnonzero(first[inside])
    firsts = np.searchsorted(starts, bounds)
    at = np.append(at, len(packed)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(packed))])
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    values = np.zeros(int(codes.max()) + 1 if len(codes) else 0, np.int64)
    values[codes[::-1]] = np.arange(len(codes))[::-1]
    return codes, firsts, at.astype(np.int64), packed, values
