"""SHA-256 over many messages side by side, with states that can be kept, moved and resumed.

A state is eight 32-bit words per message, ``(8, n)`` as an array, and 32 bytes a message when stored. Messages here
are digests as lower-case hex text: 64 characters, which is one block of the hash, so a state between two digests
is whole.
"""

from __future__ import annotations

import numpy as np

_LANES = 4096


def _primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def _root_bits(p: int, power: int) -> int:
    """The first 32 bits of the fraction of a root (so FIPS 180-4 defines its constants)."""
    scaled = p << (32 * power)
    low, high = 0, 1 << 40
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if mid**power <= scaled else (low, mid)
    return low & 0xFFFFFFFF


_K = np.array([_root_bits(p, 3) for p in _primes(64)], np.uint32)
START = np.array([_root_bits(p, 2) for p in _primes(8)], np.uint32)
_DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8).astype(np.uint32)
_half = np.arange(1 << 16, dtype=np.uint32)
#: Four hex digits, as one word, of every 16-bit number.
_HEX = (_DIGITS[_half >> 12] << 24) | (_DIGITS[_half >> 8 & 15] << 16) | (_DIGITS[_half >> 4 & 15] << 8) | _DIGITS[_half & 15]


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states after one more block ``(16, n)`` each."""
    n = block.shape[1]
    if n > _LANES:
        return np.concatenate([compress(state[:, i:i + _LANES], block[:, i:i + _LANES]) for i in range(0, n, _LANES)], axis=1)
    w = list(block)
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        if t >= 16:
            x, y = w[t - 15], w[t - 2]
            w.append(w[t - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))) + w[t - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))))
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + _K[t] + w[t]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def start(n: int) -> np.ndarray:
    return np.repeat(START[:, None], n, axis=1)


def hex_block(digest: np.ndarray) -> np.ndarray:
    """The block that a digest ``(8, n)`` is as hex text."""
    out = np.empty((16, digest.shape[1]), np.uint32)
    out[0::2], out[1::2] = _HEX[digest >> np.uint32(16)], _HEX[digest & np.uint32(0xFFFF)]
    return out


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The digests of messages of so many whole blocks."""
    end = np.zeros((16, state.shape[1]), np.uint32)
    end[0] = 0x80000000
    bits = np.asarray(blocks, np.uint64) * np.uint64(512)
    end[14], end[15] = bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF)
    return compress(state, end)


def of_bytes(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), ">u4").astype(np.uint32).reshape(-1, 8).T


def to_bytes(words: np.ndarray) -> list[bytes]:
    whole = np.ascontiguousarray(words.T).astype(">u4").tobytes()
    return [whole[k:k + 32] for k in range(0, len(whole), 32)]
