import math
from collections import Counter, defaultdict

import pytest

from mediarec.llm import line_templates as lt, queries
from mediarec.llm.common import read

A = "Copyright notice of the year 2019 by the owners of this site"
B = "Copyright notice of the year 2024 by the owners of this site"


def texts(spark, docs, **config):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    return {r.doc_id: r.text for r in lt.drop_recurring(frame, lt.TemplateConfig(**config)).collect()}


def test_first_text_keeps_a_recurring_line(spark):
    own = ("Rain fell on the roof", "Nobody saw him leave that day, they said", "Bread and salt", "We sang until the morning came", "It was a long way home")
    docs = [(i, f"{line}\n{A if i % 2 else B}\nshort one") for i, line in enumerate(own)]
    got = texts(spark, docs)
    assert got[0] == docs[0][1]
    assert all(got[i] == docs[i][1].split("\n")[0] + "\nshort one" for i in range(1, 5))


def test_two_texts_are_too_few_unless_the_line_is_long(spark):
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    got = texts(spark, [(1, f"first text here now\n{A}\n{long}"), (2, f"second text comes here\n{A}\n{long}")])
    assert got[1].count("\n") == 2 and got[2] == f"second text comes here\n{A}"


def test_variable_words_are_generalised(spark):
    names = "anna bert carl dora emil".split()
    docs = [(i, f"{n * (i + 1)}\nThe order of {n} was sent to the address given by the client in the last week") for i, n in enumerate(names)]
    got = texts(spark, docs)
    assert [got[i].count("\n") for i in range(5)] == [1, 0, 0, 0, 0]


def test_unlike_lines_of_a_leaf_stay(spark):
    docs = [(i, f"The old man {a}\n{A}") for i, a in enumerate(("went home early", "sold his boat", "saw the sea", "ate some bread"))]
    got = texts(spark, docs)
    assert all(got[i].startswith(docs[i][1].split("\n")[0]) for i in range(4))


def test_short_lines_with_one_word_left_are_not_generalised(spark):
    docs = [(i, f"Text number {w} of {w * 2} begins\nI do not {w}") for i, w in enumerate(("know", "care", "want", "swim"))]
    got = texts(spark, docs)
    assert all(got[i].endswith(docs[i][1].split("\n")[1]) for i in range(4))


def test_every_template_of_a_leaf_is_found(spark):
    """Two templates of equal length and opening, 80 and 40 variants, each variant once."""
    def word(i):
        return "".join(chr(97 + int(d)) for d in f"{i:04}") + "x"
    docs = [(i, f"{word(i)} {word(i + 500)} opens\nThe order of {word(i)} was sent to the given address last week") for i in range(80)]
    docs += [(100 + i, f"{word(i + 200)} {word(i + 700)} opens\nThe order of bread and {word(i)} came without a bill this morning again") for i in range(40)]
    got = texts(spark, docs)
    assert all(len(got[i].split("\n")) == (2 if i in (0, 100) else 1) for i, _ in docs)


def test_variants_in_one_text_count_once(spark):
    docs = [(1, "The order of anna was sent to the given address last week\nThe order of bert was sent to the given address last week"),
            (2, "The order of carl was sent to the given address last week")]
    assert texts(spark, docs) == dict(docs)


def plain_recurring(rows, config):
    """`recurring` over collected lines, template by template in plain Python."""
    texts_of, shape = defaultdict(dict), {}
    for r in rows:
        texts_of[r.line][r.body] = min(r.doc, texts_of[r.line].get(r.body, r.doc))
        shape[r.line] = (r.leaf, r.n, tuple(r.parts))
    differ = {line: len(p) - math.ceil(config.similar * len(p) - 1e-9) for line, (_, _, p) in shape.items()}
    buckets = defaultdict(list)
    for line, (leaf, _, p) in shape.items():
        s = differ[line] + 1
        for g in range(s if s > 1 else 0):
            buckets[leaf, len(p), g, p[g * len(p) // s:(g + 1) * len(p) // s]].append(line)
    members = defaultdict(set)
    for (leaf, k, *_), lines in buckets.items():
        if len(lines) > 1:
            top = []
            for at in range(k):
                weight = Counter()
                for line in lines:
                    weight[shape[line][2][at]] += len(texts_of[line])
                top.append(max((w, part) for part, w in weight.items())[1])
            for line in lines:
                if sum(a != b for a, b in zip(shape[line][2], top)) <= differ[line]:
                    members[leaf, tuple(top)].add(line)
    best = {}
    for key, lines in members.items():
        if len(lines) > 1:
            weight = sum(len(texts_of[line]) for line in lines)
            for line in lines:
                best[line] = max(best.get(line, (0, (), 0)), (weight, key[1], key[0]))
    groups = defaultdict(list)
    for line in shape:
        groups[best[line][1:] if line in best else line].append(line)
    out = set()
    for lines in groups.values():
        bodies = {}
        for line in lines:
            for body, doc in texts_of[line].items():
                bodies[body] = min(doc, bodies.get(body, doc))
        n = max(shape[line][1] for line in lines)
        if len(bodies) >= (config.passage_docs if n >= config.passage_tokens else config.min_docs):
            doc, body = min((d, b) for b, d in bodies.items())
            out |= {(line, doc, body) for line in lines}
    return out


@pytest.mark.parametrize("config", [lt.TemplateConfig(), lt.TemplateConfig(depth=1, parts=5, similar=0.5, min_docs=2)])
def test_matches_a_plain_parser(spark, sf, config):
    docs = read(spark, sf.replace("0.001", "0.01"), "documents")
    lines = lt.parsed(docs, config)
    got = {tuple(r) for r in lt.recurring(lines, config).collect()}
    assert got == plain_recurring(lines.collect(), config) and got


def test_hot_buckets_give_the_same(spark, sf):
    docs = read(spark, sf, "documents")
    config = lt.TemplateConfig(depth=1, parts=5, similar=0.5, min_docs=2)
    lines = lt.parsed(docs, config)
    one, salted = ({tuple(r) for r in lt.recurring(lines, config, hot).collect()} for hot in (4_000_000, 3))
    assert one == salted and one


def test_copies_of_a_text_count_once(spark):
    docs = [(i, f"{A}\nand a second line of it") for i in range(6)]
    assert texts(spark, docs) == dict(docs)


def test_awkward_rows(awkward, nothing):
    out = lt.drop_recurring(awkward)
    assert out.columns == awkward.columns and out.schema["text"].dataType == awkward.schema["text"].dataType
    rows = out.collect()
    assert len(rows) == awkward.count()
    by = {r.doc_id: r for r in rows}
    assert by[2].text is None and by[3].text == "" and by[7].text == "one" and by[1].n_chars == len(by[1].text)
    # Five lines recur in three different texts; the first text keeps them, the null id counts as the largest.
    assert by[1].text == by[5].text and by[None].text.strip() == "A line of its own." and by[10].gone == "x"
    assert lt.drop_recurring(nothing).count() == 0


def test_query_is_consistent(spark, sf):
    for r in queries.op4_line_templates(spark, sf).collect():
        kept = r.text.split("\n") if r.n_dropped < r.n_lines else []
        assert len(kept) == r.n_lines - r.n_dropped


@pytest.mark.parametrize("text, want", [("abc 12 x9y", ["abc <*> <*>"]), (" a1\t\x0b b ", ["<*> b"]), ("no digits here", ["no digits here"]), ("", [""]), ("x  y\n\n2", ["x y", "", "<*>"])])
def test_masking(spark, text, want):
    frame = spark.createDataFrame([(text,)], "text string").select(lt.masked_lines(lt.F.col("text")).alias("m"))
    assert frame.first().m == want


def test_lines_are_split_once(spark):
    """Short lines are left out before they are split, and every part has the hash of its tokens."""
    lines = [" ".join(f"{'abcdefgh'[i % 8]}x" for i in range(n)) for n in (1, 2, 3, 4, 19, 20, 50)]
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    found = lt.parsed(docs)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(shape") == 1
    wanted = {}
    for n in (3, 4, 19, 20, 50):
        k = min(n - 3, 16)
        tokens = lines[(1, 2, 3, 4, 19, 20, 50).index(n)].split(" ")
        wanted[n] = [tokens[3 + i * (n - 3) // k:3 + (i + 1) * (n - 3) // k] for i in range(k)]
    pieces = spark.createDataFrame(list(wanted.items()), "n int, pieces array<array<string>>")
    got = {r["n"]: r["parts"] for r in found.collect()}
    assert got == {r["n"]: r["h"] for r in pieces.select("n", lt.F.transform("pieces", lambda p: lt.F.hash(p)).alias("h")).collect()}
