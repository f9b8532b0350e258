import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm.decontaminate import Matcher, best_occurrence, cuts, find_leaks, masks, normalise


def brute(item, text):
    """Least edit distance of item to any substring of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", min_size=1, max_size=12), st.text("abc ", max_size=40))
def test_myers_equals_dynamic_program(item, text):
    assert best_occurrence(masks(item), len(item), text)[0] == brute(item, text)


@settings(max_examples=60, deadline=None)
@given(st.text("abcd", min_size=1, max_size=40), st.integers(0, 9))
def test_pieces_cover_item(item, k):
    at = cuts(item, k)
    assert at[0] == 0 and at[-1] == len(item) and at == sorted(at) and len(at) == k + 2


def edit(rng, text, n):
    t = list(text)
    for _ in range(n):
        i = rng.randrange(len(t))
        how = rng.randrange(3)
        t[i:i + 1] = [] if how == 0 else ["q"] if how == 1 else [t[i], "q"]
    return "".join(t)


def test_every_occurrence_within_budget_is_found(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeo") for _ in range(rng.randrange(1, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(4, 30)))) for i in range(25)]
    items += [(100, None), (101, " .,!"), (102, "tiny"), (103, items[0][1])]
    docs = []
    for d in range(120):
        text = " ".join(word() for _ in range(rng.randrange(0, 60)))
        if d % 2:
            item = items[rng.randrange(25)][1]
            text += " " + edit(rng, item, rng.randrange(0, 2 + len(item) // 8)).upper() + "\n" + word()
        docs.append((d, text))
    docs += [(500, None), (501, ""), (502, "x" * 200_000 + " tiny " + "y" * 1000), (503, docs[1][1]), (503, docs[1][1])]
    got = find_leaks(spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, distance string"),
                     spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, budget int"),
                     block_items=10).collect()
    expected = set()
    for d, text in docs:
        t = normalise(text)
        for i, item in items:
            n = normalise(item)
            if n and t and (n in t if len(t) > 10_000 else True):
                dist = 0 if n in t else brute(n, t)
                if dist <= int(0.1 * len(n)):
                    expected.add((d, i, dist))
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in got} == expected
    assert len(got) == len(expected) + len([e for e in expected if e[0] == 503])
    assert len(expected) > 30


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(docs, none).collect() == []
    assert find_leaks(docs.limit(0), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).collect() == []
    assert list(Matcher([], 0.1).leaks("abc")) == []
