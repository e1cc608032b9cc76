"""SHA-256 of many messages at once, with hash states that can be copied, stored and resumed.

Messages are sequences of lower-case hex digests. Such a digest is 64 bytes, one block of the hash, so
the state in front of any digest is eight words without pending bytes. Digests and states are arrays
(8, n) of 32-bit words, one column for each message.
"""

from __future__ import annotations

import math

import numpy as np

_U = np.uint32


def _constants() -> tuple[np.ndarray, np.ndarray]:
    """The first 32 bits behind the point of the cube and square roots of the first primes."""
    primes = [p for p in range(2, 312) if all(p % q for q in range(2, math.isqrt(p) + 1))]

    def cube_root(n: int) -> int:
        r = round(n ** (1 / 3))
        while r**3 > n:
            r -= 1
        while (r + 1) ** 3 <= n:
            r += 1
        return r

    cubes = [cube_root(p << 96) & 0xFFFFFFFF for p in primes]
    squares = [math.isqrt(p << 64) & 0xFFFFFFFF for p in primes[:8]]
    return np.array(cubes, dtype=_U), np.array(squares, dtype=_U)


_ROUND, _START = _constants()
# Four hex digits of every 16-bit number, as one big-endian word.
_HEX = np.frombuffer("".join(f"{i:04x}" for i in range(1 << 16)).encode(), dtype=">u4").astype(_U)


def start(n: int) -> np.ndarray:
    """The state before the first digest of ``n`` messages."""
    return np.repeat(_START[:, None], n, axis=1)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> _U(by)) | (x << _U(32 - by))


def _compress(state: np.ndarray, block: list[np.ndarray]) -> np.ndarray:
    w = list(block)
    a, b, c, d, e, f, g, h = state
    for i in range(64):
        if i >= 16:
            x, y = w[(i + 1) & 15], w[(i + 14) & 15]
            w[i & 15] = (
                w[i & 15]
                + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> _U(3)))
                + w[(i + 9) & 15]
                + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> _U(10)))
            )
        first = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + w[i & 15] + _ROUND[i]
        second = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = first + second, a, b, c, d + first, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def append(state: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """The states after one more digest, as hex text, in each message."""
    words = []
    for word in digest:
        words += [_HEX[word >> _U(16)], _HEX[word & _U(0xFFFF)]]
    return _compress(state, words)


def finish(state: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The digests of messages of ``count`` digests that have these states."""
    bits = np.asarray(count, dtype=np.uint64) * np.uint64(512)
    zero = np.zeros(state.shape[1], dtype=_U)
    block = [zero + _U(0x80000000), *[zero] * 13, (bits >> np.uint64(32)).astype(_U), bits.astype(_U)]
    return _compress(state, block)


def words_of(raw: bytes) -> np.ndarray:
    """Digests or states (8, n) from 32 bytes each."""
    return np.ascontiguousarray(np.frombuffer(raw, dtype=">u4").astype(_U).reshape(-1, 8).T)


def bytes_of(digest: np.ndarray) -> bytes:
    return np.ascontiguousarray(digest.T).astype(">u4").tobytes()
