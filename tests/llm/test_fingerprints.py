import hashlib
from collections import Counter

import pytest

from mediarec.llm import merkle, queries
from mediarec.llm.common import read


def brute(docs):
    """docs: (doc_id, text) in order of id."""
    out = {}
    for i, (doc, text) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        half = len(text) // 2
        changed = text[:len(text) - half] + following[:half]
        out[doc] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), merkle.fingerprint(text), merkle.fingerprint(changed))
    return out


def test_query_matches_brute_force(spark, sf):
    docs = sorted((r.doc_id, r.text or "") for r in read(spark, sf, "documents").collect())
    got = {r.doc_id: tuple(r)[1:5] for r in queries.op1_merkle_fingerprints(spark, sf).collect()}
    assert got == brute(docs)


def shared(a, b):
    """Share of weight that the blocks of two texts have in common, from the blocks themselves."""
    one, two = (Counter(block for paragraph in t.split("\n") for block in merkle._blocks(paragraph)) for t in (a, b))
    weight = lambda c: sum((len(x) + 1) * n for x, n in c.items())
    return 2 * weight(one & two) / (weight(one) + weight(two))


def test_likeness_and_edited_places_match_brute_force(spark, sf):
    docs = sorted((r.doc_id, r.text or "") for r in read(spark, sf, "documents").collect())
    got = {r.doc_id: r for r in queries.op1_merkle_fingerprints(spark, sf).collect()}
    for i, (doc, text) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        changed = merkle.edited(text, following)
        assert got[doc].near_edited == pytest.approx(shared(text, changed), abs=1e-6)
        assert got[doc].near_next == pytest.approx(shared(text, following), abs=1e-6)
        # The places are paragraphs of the edited text that the text doesn't have; what lies before the edit is equal.
        paragraphs, at = changed.split("\n"), []
        sections = merkle.fingerprint(changed).partition("|")[2].split(";")
        for s, section in enumerate(sections):
            at += [(s, p) for p in range(section.count(",") + 1)]
        assert len(at) == len(paragraphs)
        named = {paragraphs[at.index(tuple(map(int, place.split(":"))))] for place in got[doc].edited_places.split(",") if place}
        assert not named & set(text.split("\n"))
        assert {p for p in paragraphs if p not in text.split("\n")} == named


def test_range_borders(spark, sf):
    docs = read(spark, sf, "documents")
    one, many = (sorted(map(tuple, merkle.with_next(docs, b).collect())) for b in (1, 64))
    assert one == many


def test_likeness_and_places():
    text = "\n".join(f"Paragraph {i} has its own words. And a second sentence number {i * i}." for i in range(40))
    changed = text.replace("Paragraph 20 has", "Paragraph twenty had")
    a, b = merkle.fingerprint(text), merkle.fingerprint(changed)
    assert merkle.likeness(a, a) == 1.0 and merkle.root(a) != merkle.root(b)
    assert 0.9 < merkle.likeness(a, b) < 1.0
    assert len(merkle.differing(a, b)) == 1 and merkle.differing(a, a) == []
    assert merkle.likeness(a, merkle.fingerprint("Nothing in common here.")) == 0.0
    # Paragraph borders count, not only the blocks.
    assert merkle.root(merkle.fingerprint("A b. C d.")) != merkle.root(merkle.fingerprint("A b.\nC d."))


def test_awkward_rows(awkward, nothing):
    rows = merkle.with_next(awkward).collect()
    assert len(rows) == awkward.count() and sum(r.doc_id == 5 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    by = {r.doc_id: r for r in rows}
    assert by[2].fingerprint == by[3].fingerprint and by[2].n_chars == 0 and by[2].near_next == 1.0
    assert merkle.with_next(nothing).count() == 0
    alone = merkle.with_next(awkward.where("doc_id = 1")).first()
    assert alone.near_next == 1.0 and alone.n_chars > 0
