import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from mediarec.llm import queries, tree_bpe
from mediarec.llm.common import read

PATH = queries.tokenizer_path("byte_bpe_50k.json")
PIECES = ["a", "the", " ", "  ", "\n", "'s", "'", "1", "22", "é", "!", "<|endoftext|>", "　", "\r\n", "語", "\xa0", "x" * 40, "Ώ"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(PATH)
    return tokenizer, lambda t: np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=50).map("".join), st.integers(2, 9))
def test_any_cut_gives_the_whole_encoding(text, n):
    own = tree_bpe.encoder(PATH)
    assert own.many([text])[0] == own.whole(text)
    step = max(1, -(-len(text) // n))
    parts = [text[i:i + step] for i in range(0, len(text), step)] or [""]
    assert own.tree(list(zip(parts, own.many(parts)))) == own.whole(text)


def test_runs_without_any_place_to_cut(library):
    own, rng = tree_bpe.encoder(PATH), random.Random(1)
    for alphabet in ("ab", "é", "!?", "0123", "語字"):
        text = "".join(rng.choice(alphabet) for _ in range(3000))
        parts = [text[i:i + 400] for i in range(0, 3000, 400)]
        assert own.tree(list(zip(parts, own.many(parts)))) == library[1](text)


@pytest.mark.parametrize("leaf", [tree_bpe.LEAF, 200])
def test_query_matches_the_library(spark, sf, library, leaf):
    tokenizer, ids_of = library
    want = {}
    for r in read(spark, sf, "documents").collect():
        ids = ids_of(r.text or "")
        text = tokenizer.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        want[r.doc_id] = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    rows = queries.op10_tree_bpe(spark, sf) if leaf == tree_bpe.LEAF else tree_bpe.digests(read(spark, sf, "documents"), PATH, leaf)
    assert {r.doc_id: tuple(r)[1:] for r in rows.collect()} == want


def test_awkward_rows(awkward, nothing, library):
    rows = tree_bpe.digests(awkward, PATH, leaf=1000).collect()
    assert len(rows) == awkward.count() and sum(r.doc_id == 5 for r in rows) == 2
    texts = {r.doc_id: r.text or "" for r in awkward.collect()}
    assert all(r.ids_sha256 == hashlib.sha256(library[1](texts[r.doc_id])).hexdigest() for r in rows)
    assert tree_bpe.digests(nothing, PATH).count() == 0
