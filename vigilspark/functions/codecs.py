"""Address codecs that SQL functions can't express, as Arrow-batched pandas functions on distinct values."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of BIP-173 and Base58.
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

# Chains whose addresses share keys with the home chain.
SHARED_KEYS = ("cosmos", "osmo", "kujira", "terra", "akash", "juno", "stars", "inj", "sei", "evmos", "cro", "axelar", "stride", "umee", "regen")


def _checksum(values: list[int]) -> int:
    state = 1
    for v in values:
        top, state = state >> 25, (state & 0x1FFFFFF) << 5 ^ v
        for bit, g in enumerate(GENERATOR):
            state ^= g if top >> bit & 1 else 0
    return state


def _expanded(prefix: str) -> list[int]:
    return [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix]


def bech32_decode(address: str | None) -> tuple[str, list[int]] | None:
    """Prefix and words; None where case, alphabet, length or checksum is wrong."""
    if not address or not address.isascii() or len(address) > 90 or address != address.lower() and address != address.upper():
        return None
    prefix, one, tail = address.lower().rpartition("1")
    if not one or not prefix or len(tail) < 6 or any(c not in BECH32 for c in tail) or not all(33 <= ord(c) <= 126 for c in prefix):
        return None
    words = [BECH32.index(c) for c in tail]
    return (prefix, words[:-6]) if _checksum(_expanded(prefix) + words) == 1 else None


def bech32_encode(prefix: str, words: list[int]) -> str:
    check = _checksum(_expanded(prefix) + words + [0] * 6) ^ 1
    return prefix + "1" + "".join(BECH32[w] for w in words + [check >> 5 * (5 - i) & 31 for i in range(6)])


def home_address(address: str | None, prefix: str = "thor") -> str | None:
    """The home-chain address of the same key; None for chains that don't share keys."""
    got = bech32_decode(address)
    if got is None:
        return None
    return address if got[0] == prefix else bech32_encode(prefix, got[1]) if got[0] in SHARED_KEYS else None


def base58check(payload: bytes) -> str:
    data = payload + hashlib.sha256(hashlib.sha256(payload).digest()).digest()[:4]
    n, out = int.from_bytes(data, "big"), ""
    while n:
        n, digit = divmod(n, 58)
        out = BASE58[digit] + out
    return "1" * (len(data) - len(data.lstrip(b"\0"))) + out


def tron_address(hex_address: str | None) -> str | None:
    """The Base58Check form of a hexadecimal address; other forms stay."""
    if hex_address is None:
        return None
    body = hex_address.removeprefix("0x")
    if len(body) == 42 and body.startswith("41"):
        body = body[2:]
    try:
        return base58check(b"\x41" + bytes.fromhex(body)) if len(body) == 40 else hex_address
    except ValueError:
        return hex_address


#: What each of the 32 values of a state's top bits adds to it, the codes of the alphabet, and each code's place there (-1: none).
_TOPS = np.array([int(np.bitwise_xor.reduce([g for bit, g in enumerate(GENERATOR) if top >> bit & 1] or [0])) for top in range(32)], np.int64)
_CODES = np.frombuffer(BECH32.encode(), np.uint8)
_PLACES = np.array([BECH32.find(chr(c)) for c in range(128)], np.int8)


def _checksums(values: np.ndarray) -> np.ndarray:
    """The checksum of each row of values."""
    state = np.ones(len(values), np.int64)
    for v in values.T:
        state = (state & 0x1FFFFFF) << 5 ^ v ^ _TOPS[state >> 25]
    return state


def _matrix(parts: list[bytes]) -> np.ndarray:
    """Bytes of one length as rows."""
    return np.frombuffer(b"".join(parts), np.uint8).reshape(len(parts), len(parts[0]))


def _by_size(values: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """The places of the values of each length."""
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    for n in np.unique(sizes):
        yield np.flatnonzero(sizes == n), int(n)


def _decoded(address: np.ndarray) -> Iterator[tuple[np.ndarray, str, np.ndarray]]:
    """(places, prefix, words) of the addresses that bech32_decode takes, those of one prefix and length together."""
    known = np.flatnonzero([isinstance(a, str) and a.isascii() for a in address])
    for at, n in _by_size(address[known]):
        if not 8 <= n <= 90:
            continue
        at = known[at]
        m = _matrix([a.encode() for a in address[at]])
        small, large = (m >= 97) & (m <= 122), (m >= 65) & (m <= 90)
        m = m + (large * 32).astype(np.uint8)
        one = n - 1 - np.argmax(m[:, ::-1] == 49, axis=1)
        fine = ~(small.any(1) & large.any(1)) & ((m >= 33) & (m <= 126)).all(1) & (m == 49).any(1) & (one >= 1) & (n - 1 - one >= 6)
        for k in np.unique(one[fine]):
            rows = np.flatnonzero(fine & (one == k))
            words = _PLACES[m[rows, k + 1 :]]
            prefix = m[rows, :k]
            good = (words >= 0).all(1)
            good &= _checksums(np.hstack([prefix >> 5, np.zeros((len(rows), 1), np.uint8), prefix & 31, words])) == 1
            names = np.ascontiguousarray(prefix).view(f"S{k}").ravel()
            for name in np.unique(names[good]):
                those = good & (names == name)
                yield at[rows[those]], name.decode(), words[those, :-6]


def _encoded(prefix: str, words: np.ndarray) -> list[str]:
    """Addresses of rows of words."""
    n = len(words)
    head = np.tile(np.array(_expanded(prefix), np.int64), (n, 1))
    check = _checksums(np.hstack([head, words, np.zeros((n, 6), np.int64)])) ^ 1
    tail = np.hstack([words, (check[:, None] >> 5 * np.arange(5, -1, -1)) & 31])
    size, letters = tail.shape[1], _CODES[tail].tobytes().decode()
    return [f"{prefix}1{letters[i : i + size]}" for i in range(0, n * size, size)]


def _series(values: np.ndarray, like: pd.Series) -> pd.Series:
    return pd.Series(values, index=like.index, dtype=object)


@F.pandas_udf(StringType())
def to_home_address(address: pd.Series) -> pd.Series:
    given = address.to_numpy(object)
    out = np.full(len(given), None, object)
    for at, prefix, words in _decoded(given):
        if prefix == "thor":
            out[at] = given[at]
        elif prefix in SHARED_KEYS:
            out[at] = _encoded("thor", words)
    return _series(out, address)


@F.pandas_udf(StringType())
def to_cosmos_address(address: pd.Series) -> pd.Series:
    given = address.to_numpy(object)
    out = np.full(len(given), None, object)
    for at, _, words in _decoded(given):
        out[at] = _encoded("cosmos", words)
    return _series(out, address)


@F.pandas_udf(StringType())
def to_tron_address(address: pd.Series) -> pd.Series:
    return address.map(tron_address, na_action="ignore")


@F.pandas_udf(StringType())
def bech32_of_hex(hex_digits: pd.Series) -> pd.Series:
    """A home-chain address over the bytes of hexadecimal text."""
    given = hex_digits.to_numpy(object)
    out = np.full(len(given), None, object)
    known = np.flatnonzero([isinstance(h, str) for h in given])
    data = np.empty(len(known), object)
    data[:] = [bytes.fromhex(h) for h in given[known]]
    for at, _ in _by_size(data):
        bits = np.unpackbits(_matrix(list(data[at])), axis=1)
        bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 5)))
        words = bits.reshape(len(at), bits.shape[1] // 5, 5) @ np.array([16, 8, 4, 2, 1], np.uint8)
        out[known[at]] = _encoded("thor", words)
    return _series(out, hex_digits)
