import random

import public_tokenizers
import regex
from marketprose.llm import common, pretokens

SIGNS = [chr(c) for c in range(0x250)] + [chr(c) for c in range(0x2010, 0x2060)] + ["€", "漢", "🚀", " ", "́", "Ⅷ"]


def test_pieces_are_the_matches_of_the_pattern():
    assert pretokens.PATTERN == public_tokenizers.PATTERN
    find = regex.compile(public_tokenizers.PATTERN).findall
    r = random.Random(3)
    for sign in SIGNS:
        for text in (sign, f"a{sign}b", f" {sign}{sign} 1", f"'{sign}  {sign}"):
            assert pretokens.pieces(text) == find(text)
    for signs in ("ab1 .'st\n\t", SIGNS[:128], SIGNS[:0x250], SIGNS):
        for _ in range(1500):
            text = "".join(r.choice(signs) if r.random() < 0.6 else r.choice("a1 's.") for _ in range(r.randint(0, 15)))
            assert pretokens.pieces(text) == find(text)
    assert pretokens.splitter("a+")("caab") == ["aa"]


def test_cache_is_bounded():
    seen = []
    cache = pretokens.ByteCache(lambda k: seen.append(k) or k.encode(), limit=5_000)
    for k in [*map(str, range(300)), "x" * 300, "x" * 300]:
        assert cache[k] == k.encode()
        assert cache.used + cache.used_by_older <= 5_000
    assert len(seen) == 302 and cache["299"] == b"299" and len(seen) == 302
    for _ in range(50):  # what is asked for again stays
        assert cache["299"] == b"299" and cache[f"new {len(seen)}"]
    assert seen.count("299") == 1
    cache.forget()
    assert not cache and not cache.older and cache["299"] == b"299"


def test_other_work_empties_the_caches():
    cache = pretokens.ByteCache(str.encode, limit=1_000)
    assert all(cache[str(k)] for k in range(20)) and cache and cache.older
    common.forget_recent()
    assert not cache and not cache.older and not cache.used and cache["7"] == b"7"
