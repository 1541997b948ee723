"""XXH64 of many byte ranges at once, in NumPy: ranges of one length go through the algorithm's steps together."""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64
#: The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (_U(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Ranges longer than this go to the library, one by one.
LONGEST = 256


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def _same_length(eight: np.ndarray, four: np.ndarray, data: np.ndarray, at: np.ndarray, n: int, seed: np.uint64) -> np.ndarray:
    """Hashes of the ranges of n bytes that start at `at`."""
    done = 0
    if n >= 32:
        first = (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)
        acc = [np.full(len(at), v, _U) for v in first]
        while done + 32 <= n:
            acc = [_round(a, eight[at + (done + 8 * i)]) for i, a in enumerate(acc)]
            done += 32
        h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for a in acc:
            h = (h ^ _round(np.zeros(len(at), _U), a)) * _P1 + _P4
    else:
        h = np.full(len(at), seed + _P5, _U)
    h = h + _U(n)
    while done + 8 <= n:
        h = _rotl(h ^ _round(np.zeros(len(at), _U), eight[at + done]), 27) * _P1 + _P4
        done += 8
    if done + 4 <= n:
        h = _rotl(h ^ (four[at + done].astype(_U) * _P1), 23) * _P2 + _P3
        done += 4
    while done < n:
        h = _rotl(h ^ (data[at + done].astype(_U) * _P5), 11) * _P1
        done += 1
    h = (h ^ (h >> _U(33))) * _P2
    h = (h ^ (h >> _U(29))) * _P3
    return h ^ (h >> _U(32))


def xxh64(data: np.ndarray, begin: np.ndarray, stop: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of data[begin[i]:stop[i]] for each i."""
    out, length = np.zeros(len(begin), _U), stop - begin
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    # words of eight and four bytes at every byte
    eight, four = (np.ndarray(len(data) + 1, t, padded, strides=(1,)) for t in ("<u8", "<u4"))
    order = np.argsort(length, kind="stable")
    sizes, starts = np.unique(length[order], return_index=True)
    with np.errstate(over="ignore"):
        for n, a, b in zip(sizes.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
            some = order[a:b]
            if n > LONGEST:
                out[some] = [xxhash.xxh64_intdigest(data[i : i + n].tobytes(), seed) for i in begin[some].tolist()]
            else:
                out[some] = _same_length(eight, four, padded, begin[some], n, _U(seed))
    return out
