import random

import numpy as np
import pytest

from mediarec.llm import queries
from mediarec.llm.common import read
from mediarec.llm.word_cache import ByteCache, LetterCache, WordCache

PATH = queries.tokenizer_path("word_bpe_49k.json")


def test_quick_way_equals_the_library(spark, sf):
    quick = LetterCache(PATH)
    assert quick.merge is not None
    words = {w for r in read(spark, sf, "documents").collect() for w in (r.text or "").encode().split()}
    rng = random.Random(5)
    alphabet = "aeinrstABÉéßþÿ.,!'%<|>-#"
    words |= {"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 18))).encode() for _ in range(20_000)}
    words |= {b"it's", b"'tis", b"<|endoftext|>", "ı".encode(), "İ".encode(), "é".encode(), b"a1b22", "µ".encode()}
    words = sorted(words)
    assert quick.encoded(words) == WordCache(PATH).encoded(words)


def test_cache_is_bounded():
    cache = WordCache(PATH, most=50)
    for k in range(20):
        words = [f"w{k}x{i}".encode() for i in range(30)]
        cache.learn(set(words))
        assert len(cache.known) <= 60
        want = cache.tokenizer.encode(" ".join(w.decode() for w in words), add_special_tokens=False).ids
        assert np.frombuffer(cache.join(words), "<u4").tolist() == want


@pytest.mark.parametrize("prefix", ["", " "])
def test_quick_bytes_equal_the_library(spark, sf, prefix):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    quick = ByteCache(path, prefix)
    assert quick.merge is not None
    words = {w for r in read(spark, sf, "documents").collect() for w in (r.text or "").encode().split(b" ") if w}
    rng = random.Random(7)
    alphabet = "aeinrstABÉéßþÿ.,!'%<|>-#019\n\tªµ²\x85"
    words |= {"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 18))).encode() for _ in range(20_000)}
    words |= {b"it's", b"'tis", b"<|endoftext|>", b"a<|endoftext|>b", b"a\n\nb", b"a\n", b"\na", "\u0131".encode(), b"a1b22", "\xb5".encode()}
    words = sorted(words)
    assert quick.encoded(words) == WordCache(path, prefix).encoded(words)
