"""Address codecs over batches give what they give for one address, and cost little for each."""

from __future__ import annotations

import random
import time

import pandas as pd
import pytest

from vigilspark.functions import codecs

PREFIXES = ["thor", "cosmos", "osmo", "bc", "a", "x1y", "terra", "z" * 40]


def addresses(n):
    rng = random.Random(5)
    for _ in range(n):
        a = codecs.bech32_encode(rng.choice(PREFIXES), [rng.randrange(32) for _ in range(rng.choice([0, 1, 32, 32, 32, 52]))])
        i = rng.randrange(len(a))
        yield rng.choice([a, a, a, a.upper(), a[:i] + rng.choice("qpb1oé Q\x7f") + a[i + 1 :], a[:i], a.capitalize(), a + "q"])


def test_batches_equal_single_addresses():
    given = pd.Series([None, "", "1", "1qqqqqq", "thor1", "A12UEL5L", "K" * 20, *addresses(4000)], dtype=object, name="a")
    home = [codecs.home_address(a) for a in given]
    hub = [codecs.bech32_encode("cosmos", got[1]) if (got := codecs.bech32_decode(a)) else None for a in given]
    assert list(codecs.to_home_address.func(given)) == home and sum(x is not None for x in home) > 500
    assert list(codecs.to_cosmos_address.func(given)) == hub and sum(x is not None for x in hub) > 1000
    assert list(codecs.to_home_address.func(given[:0])) == [] and list(codecs.to_home_address.func(pd.Series([None, None], dtype=object))) == [None, None]


def test_hexadecimal_text_in_batches():
    rng = random.Random(6)
    given = pd.Series([None, "", "ff", "00 ff", *[rng.randbytes(n).hex() for n in (20, 20, 32, 5, 1)]], dtype=object)

    def words(h):
        bits = "".join(f"{b:08b}" for b in bytes.fromhex(h))
        bits += "0" * (-len(bits) % 5)
        return [int(bits[i : i + 5], 2) for i in range(0, len(bits), 5)]

    assert list(codecs.bech32_of_hex.func(given)) == [None if h is None else codecs.bech32_encode("thor", words(h)) for h in given]
    with pytest.raises(ValueError):
        codecs.bech32_of_hex.func(pd.Series(["0"]))


def test_an_address_takes_microseconds():
    digits = pd.Series([f"{i:040x}" for i in range(10_000)])
    began = time.process_time()
    hub = codecs.to_cosmos_address.func(codecs.bech32_of_hex.func(digits))
    assert codecs.to_home_address.func(hub).nunique() == len(digits)
    assert time.process_time() - began < 1.5  # 3.0 s one by one
