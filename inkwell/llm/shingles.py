"""Distinct word shingles of whole texts, as sorted 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import LOWER, mix, runs, span_hashes, spans, strings

#: Words are runs of bytes other than space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of ``width`` lower-cased (A-Z) words, ascending.

    A text with fewer words has one shingle, its whole word sequence; one without words
    (or null) has none. Work is done in runs of a few MB, however long the texts are.
    """
    data, offsets = strings(texts)
    factors = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(width)]
    for first, end in runs(offsets):
        part = LOWER[data[offsets[first] : offsets[end]]]
        at = offsets[first : end + 1] - offsets[first]
        starts, ends, row = spans(~SPACE[part], at)
        words = span_hashes(part, starts, ends)
        edges = np.searchsorted(row, np.arange(end - first + 1))
        n = max(0, len(words) - width + 1)
        rolled = np.zeros(n, np.uint64)
        for k, factor in enumerate(factors):
            rolled += words[k : k + n] * factor
        rolled = mix(rolled)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                yield mix((words[a:b] * np.array(factors[: b - a])).sum(keepdims=True) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
