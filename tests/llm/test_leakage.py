import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.llm import leakage as L

VOCABULARY = [f"w{i}" for i in range(300)]
rng = random.Random(3)


def text(n, r=rng):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


ITEMS = [(i, text(40 + i % 30)) for i in range(30)]
STOCK = "give the result to three significant figures and state all assumptions clearly"


@pytest.fixture(params=[1, 8])
def passes(request, monkeypatch):
    """The same with blocks of few items, one or several in a pass."""
    monkeypatch.setattr(L, "BLOCK_ITEMS", 9)
    monkeypatch.setattr(L, "PASS_BLOCKS", request.param)


def found(spark, docs, items=ITEMS):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(0)).withColumn("id", F.lit("x"))
    i = spark.createDataFrame(items, "item_id long, item_text string").withColumn("text", F.lit("y"))
    return {(r.doc_id, r.item_id) for r in L.leaked(d, i).collect()}


def part(item, a, b):
    return " ".join(ITEMS[item][1].split()[a:b])


def changed(s, every, r=rng):
    return " ".join("changed" if k % every == every - 1 else w for k, w in enumerate(s.split()))


def test_what_is_a_case_and_what_is_not(spark, passes):
    whole = ITEMS[5][1]
    n = len(whole.split())
    docs = [
        (1, f"{text(50)} {whole} {text(50)}"),
        (2, text(80) + "\n" + whole.upper().replace(" ", "\n% ") + "\n" + text(10)),
        (3, text(30) + " \\emph{" + whole.replace(" ", " \\textbf{", 1) + "}} \\cite{key2004} " + text(30)),
        (4, f"{text(50)} {part(6, 3, 3 + len(ITEMS[6][1].split()) // 2)} {text(50)}"),
        (5, f"{text(20)} {changed(whole, 7)} {text(5)}"),
        (6, f"{text(20)} {' and also '.join(whole.split()[k : k + 12] and ' '.join(whole.split()[k : k + 12]) for k in range(0, n, 12))} {text(5)}"),
        (7, f"{whole} {ITEMS[9][1]}"),
        (20, f"{text(50)} {part(5, 0, n // 6)} {text(50)}"),  # a short quote
        (21, " ".join(random.Random(1).sample(whole.split(), n))),  # loose words
        (22, " ".join(reversed(whole.split()))),
        (23, ""), (24, None), (None, whole), (25, "%%%"), (26, "\\section{}"),
    ]
    assert found(spark, docs) == {(1, 5), (2, 5), (3, 5), (4, 6), (5, 5), (6, 5), (7, 5), (7, 9)}


def test_stock_phrases_are_no_case(spark):
    items = [(i, f"{text(20)} {STOCK}") for i in range(20)]
    own = items[4][1]
    docs = [(1, f"{text(40)} {STOCK} {text(40)}"), (2, f"{text(40)} {own} {text(40)}"), (3, STOCK)]
    assert found(spark, docs, items) == {(2, 4)}


def test_copies_items_of_one_id_nulls_and_empty(spark):
    whole = ITEMS[0][1]
    items = [(1, whole), (1, ITEMS[1][1]), (2, whole), (3, None), (None, whole), (4, ""), (5, "one two")]
    assert found(spark, [(7, whole), (7, whole), (8, ITEMS[1][1]), (9, "one two")], items) == {(7, 1), (7, 2), (8, 1)}
    assert found(spark, [], items) == set() and found(spark, [(1, whole)], []) == set()


def brute(docs, items):
    """Every item against every document: the same alignment over the whole text, without index or hits."""
    out = set()
    for d, t in docs:
        w = np.array([L.term(x) for x in L.words(t)], np.int64)
        for i, s in items:
            v = np.array([L.term(x) for x in L.words(s)], np.int64)
            if len(w) and L.align([v], [np.ones(len(v), bool)], [w])[0][0] >= L.SHARE * (1 - L.EXCHANGED) * len(v):
                out.add((d, i))
    return out


def test_against_brute_force(spark, monkeypatch):
    r = random.Random(11)
    docs = []
    for d in range(120):
        body = text(r.randrange(0, 200), r)
        if d % 2:
            w = ITEMS[r.randrange(30)][1].split()
            a = r.randrange(len(w))
            body += " " + changed(" ".join(w[a : a + r.randrange(4, 60)]), r.choice([6, 8, 1000])) + " " + text(30, r)
        docs.append((d, body))
    want = brute(docs, ITEMS)
    assert len(want) > 15 and found(spark, docs) == want


def test_items_of_three_words_match_as_a_whole(spark):
    items = [(1, "zeta eta theta"), (2, "only two"), (3, "iota kappa lambda mu")]
    docs = [(1, f"{text(30)} zeta eta theta {text(30)}"), (2, "zeta theta eta"), (3, "Zeta,\neta theta"), (4, "only two"), (5, "iota kappa lambda mu"), (6, "zeta eta theta zeta eta theta")]
    assert found(spark, docs, items) == {(1, 1), (3, 1), (5, 3), (6, 1)}


def test_one_run_that_occurs_twice_is_one_hit():
    item = "iota kappa lambda " + text(2)
    docs = pd.DataFrame({"id": [1], "text": ["iota kappa lambda x y iota kappa lambda"]})
    (table,) = L._index(iter([docs]))
    s = L.Segment(next(table.itertuples(index=False)))
    assert not list(L._matches(s, L.Items([(1, L.words(item))], set())))


def test_matches_say_where_they_lie_and_of_what_kind(spark):
    whole = ITEMS[5][1]
    n = len(whole.split())
    docs = [(1, f"{text(50)} {whole} {text(50)}"), (2, f"{text(20)} {changed(whole, 7)} {text(5)}"), (3, f"{text(9)} {part(5, 10, 10 + n // 2)}")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, item_text string")
    got = {r.doc_id: r for r in L.leaked(d, i).collect()}
    assert (got[1].first_word, got[1].phrase_words, got[1].kind) == (50, n, L.EXACT)
    assert (got[2].first_word, got[2].phrase_words, got[2].kind) == (20, 6, L.PROXIMITY)
    assert (got[3].first_word, got[3].phrase_words, got[3].kind) == (9, n // 2, L.EXACT)


def test_alignment_equals_the_plain_recurrence():
    r = np.random.default_rng(2)
    pairs = [(r.integers(0, 6, r.integers(1, 15)), r.integers(0, 6, r.integers(1, 25))) for _ in range(60)]

    def plain(a, b):
        best, table = (0, 0), [[(0, 0)] * (len(b) + 1)]
        for x in a:
            row = [(0, 0)]
            for j, y in enumerate(b):
                s, m = table[-1][j]
                options = [(s + 1, m + 1) if x == y else (s - 1, m), (table[-1][j + 1][0] - 1, table[-1][j + 1][1]), (row[-1][0] - 1, row[-1][1]), (0, 0)]
                c = max(options)
                row.append(c if c[0] > 0 else (0, 0))
                best = max(best, row[-1])
            table.append(row)
        return best[1]

    got, _ = L.align([a for a, _ in pairs], [np.ones(len(a), bool) for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == [plain(a, b) for a, b in pairs]


def test_segments_give_exact_phrases():
    r = random.Random(4)
    docs = pd.DataFrame({"id": range(40), "text": [" ".join(r.choice("abcd") for _ in range(r.randrange(0, 50))) for _ in range(40)]})
    (table,) = L._index(iter([docs]))
    s = L.Segment(next(table.itertuples(index=False)))
    runs = [("a", "b", "c"), ("d", "d", "d"), ("a", "x", "a")]
    rows, at = s.phrases(s.find(np.array([[L.term(w) for w in run] for run in runs], np.int64).ravel()).reshape(3, 3))
    got = sorted((int(k), int(s.doc_ids[s.doc(p)]), int(p - s.doc_starts[s.doc(p)])) for k, p in zip(rows, at, strict=True))
    want = sorted((k, d, p) for k, run in enumerate(runs) for d, t in zip(docs.id, docs.text, strict=True) for p in range(len(t.split()) - 2) if tuple(t.split()[p : p + 3]) == run)
    assert got == want


@pytest.mark.parametrize("size", [1, 37, 10_000])
def test_result_does_not_depend_on_segments_or_blocks(monkeypatch, size):
    docs = pd.DataFrame({"id": range(60), "text": [f"{text(30)} {ITEMS[k % 30][1]} {text(30)}" for k in range(60)]})
    monkeypatch.setattr(L, "SEGMENT_TOKENS", size)
    segments = [L.Segment(next(t.itertuples(index=False))) for t in L._index(iter([docs]))]
    out = set()
    for lo in range(0, 30, 7):
        items = L.Items([(i, L.words(t)) for i, t in ITEMS[lo : lo + 7]], set())
        out |= {m[:2] for s in segments for m in L._matches(s, items)}
    assert out == {(k, k % 30) for k in range(60)}


def test_very_long_text(spark):
    docs = [(1, text(200_000) + " " + ITEMS[3][1] + " " + text(10)), (2, "x" * 3_000_000), (3, "{" * 100_000)]
    assert found(spark, docs) == {(1, 3)}
