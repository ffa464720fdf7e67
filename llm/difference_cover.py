"""Suffix sorting by a difference cover, for texts of a few million symbols in one task."""

from __future__ import annotations

import numpy as np


def _dense(keys: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """Rank of each key among the different keys, from 0, and their number. Keys have at most ``bits`` bits; key and
    place share a 64-bit number while it is sorted."""
    n = len(keys)
    place_bits = max(n - 1, 1).bit_length()
    if bits + place_bits > 63:
        values, ranks = np.unique(keys, return_inverse=True)
        return ranks.astype(np.int64), len(values)
    packed = (keys << np.int64(place_bits)) | np.arange(n, dtype=np.int64)
    packed.sort()
    at = packed & np.int64((1 << place_bits) - 1)
    packed >>= np.int64(place_bits)
    ranks = np.empty(n, np.int64)
    ranks[at] = np.cumsum(np.concatenate(([0], packed[1:] != packed[:-1])))
    return ranks, int(ranks[at[-1]]) + 1 if n else 0


def _smaller(ranks: np.ndarray, among: np.ndarray, size: int) -> np.ndarray:
    """How many of ``among`` are smaller than each of ``ranks``; all are below ``size``."""
    counts = np.cumsum(np.bincount(among, minlength=size))
    return counts[ranks] - np.bincount(among, minlength=size)[ranks]


def suffix_ranks(text: np.ndarray, symbols: int, depth: int) -> np.ndarray:
    """For each suffix, how many suffixes are smaller; suffixes with equal first ``depth`` symbols may share a rank,
    and stand together in any case. Symbols are whole numbers below ``symbols``; behind the end stand zeros.

    Suffixes at places 1 and 2 modulo 3 are sampled: their triples are sorted into names, and the names are
    sorted in the same way unless they differ already or reach deep enough. A remaining suffix is its first
    symbol and a sampled suffix. Any two suffixes are compared by at most two symbols and a pair of sampled ones.
    """
    n = len(text)
    if n == 0 or depth <= 1:
        return _dense(text, max(symbols - 1, 1).bit_length())[0] if n else np.empty(0, np.int64)
    padded = np.concatenate((text, np.zeros(5, np.int64)))
    bits = max(symbols - 1, 1).bit_length()
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate((one, two))
    if 3 * bits <= 40:
        triples = (padded[sample] << (2 * bits)) | (padded[sample + 1] << bits) | padded[sample + 2]
        names, found = _dense(triples, 3 * bits)
    else:
        pairs, found = _dense((padded[sample] << bits) | padded[sample + 1], 2 * bits)
        names, found = _dense((pairs << bits) | padded[sample + 2], found.bit_length() + bits)
    if found < len(sample) and depth > 3:
        # A zero between the two rows of names ends the suffixes of the first.
        joined = np.concatenate((names[: len(one)] + 1, [0], names[len(one) :] + 1))
        ranks = suffix_ranks(joined, found + 1, -(-depth // 3))
        names = np.concatenate((ranks[: len(one)], ranks[len(one) + 1 :]))
    rank = np.zeros(n + 5, np.int64)
    rank[sample] = names + 1
    wide = int(rank.max()).bit_length()

    zero, one = np.arange(0, n, 3), one[one < n]
    # The remaining suffixes against those at places 1, by a symbol and a sampled suffix.
    at = np.concatenate((zero, one))
    ranks, found = _dense((padded[at] << wide) | rank[at + 1], bits + wide)
    zero_ranks, one_ranks = ranks[: len(zero)], ranks[len(zero) :]
    out = np.empty(n, np.int64)
    out[zero] = _smaller(zero_ranks, zero_ranks, found) + _smaller(zero_ranks, one_ranks, found)
    out[one] = _smaller(one_ranks, zero_ranks, found)
    # Those at places 2 need two symbols.
    at = np.concatenate((zero, two))
    pairs, found = _dense((padded[at] << bits) | padded[at + 1], 2 * bits)
    ranks, found = _dense((pairs << wide) | rank[at + 2], found.bit_length() + wide)
    zero_ranks, two_ranks = ranks[: len(zero)], ranks[len(zero) :]
    out[zero] += _smaller(zero_ranks, two_ranks, found)
    out[two] = _smaller(two_ranks, zero_ranks, found)
    names = names[sample < n]
    out[np.concatenate((one, two))] += _smaller(names, names, int(names.max(initial=0)) + 1)
    return out


def repeated_windows(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Of the places ``starts``, those whose ``length`` bytes also stand at a smaller one of them.

    Suffixes are sorted; neighbours in that order are compared byte by byte, eight at a time.
    """
    if len(starts) < 2:
        return starts[:0]
    ranks = suffix_ranks(text.astype(np.int64) + 1, 257, length)
    place_bits = len(text).bit_length()
    order = np.sort((ranks[starts] << place_bits) | starts) & ((1 << place_bits) - 1)
    words = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
    for step in (1, 2, 4):
        words = words[: len(words) - step] | (words[step:] << np.uint64(8 * step))
    pairs = np.arange(1, len(order))
    for shift in sorted({*range(0, length - 7, 8), length - 8}):
        pairs = pairs[words[order[pairs] + shift] == words[order[pairs - 1] + shift]]
    same = np.zeros(len(order), bool)
    same[pairs] = True
    heads = np.flatnonzero(~same)
    first = np.minimum.reduceat(order, heads)
    return np.sort(order[order > np.repeat(first, np.diff(np.append(heads, len(order))))])
