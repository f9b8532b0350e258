import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.llm.toxicity import (DECAY, MAX_SPAN, SYMBOLS, WINDOW, Landmarks, best_windows, held_out, joined, subsequences,
                                    symbols, toxicity)


def brute(text):
    x, out = symbols(text).tolist(), {}
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            for k in range(j + 1, len(x)):
                for m in range(k + 1, min(len(x), i + MAX_SPAN)):
                    if all((x[i], x[j], x[k], x[m])):
                        u = ((x[i] * SYMBOLS + x[j]) * SYMBOLS + x[k]) * SYMBOLS + x[m]
                        out[u] = out.get(u, 0.0) + DECAY ** (m - i + 1)
    return out


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=list("abcé -*9. "), max_size=14))
def test_subsequences_are_the_kernel_features(text):
    u, w = subsequences(text)
    assert dict(zip(u.tolist(), np.round(w, 9).tolist())) == {k: round(v, 9) for k, v in brute(text).items()}


def joined_one_by_one(text):
    """Each character is looked at by itself: which letters stand alone, which gaps lie beside a gap of the same kind."""
    x = symbols(text).tolist()
    letter = [False] + [s > 0 and s != 27 for s in x] + [False] * 6
    alone = [i for i in range(len(x)) if letter[i + 1] and not letter[i] and not letter[i + 2]]
    gap = {i: (j - i, text[i + 1]) for i, j in zip(alone, alone[1:])
           if j - i <= 4 and not any(letter[k + 1] or text[k] in "0123456789" for k in range(i + 1, j))}
    gone = {i for i in range(len(x)) if x[i] == 0 and letter[i] and letter[i + 2] and text[i] not in "0123456789"}
    for i, j in zip(alone, alone[1:]):
        if i in gap and j in gap and gap[i] == gap[j]:
            gone |= set(range(i + 1, i + gap[i][0])) | set(range(j + 1, j + gap[j][0]))
    return "".join(c for i, c in enumerate(text) if i not in gone)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=list("ab\u00e9\U0001f600 .-_*1\n"), max_size=24))
def test_joined_equals_looking_at_each_character(text):
    assert joined(text) == joined_one_by_one(text)


def test_joined():
    assert joined("you i d i o t, an i.d.i.o.t. a m-o-r-o-n and l__o__s__e__r") == "you idiot, an idiot. a moron and loser"
    assert joined("id*iot well-known") == "idiot wellknown"
    for text in ["", "a b", "he is a good man", "1 2 3 4", "a 1 b 2 c", "3.5 - 4.5"]:
        assert joined(text) == text


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet=list("idiotlosr -é"), max_size=16), min_size=1, max_size=5))
def test_nystrom_features_reproduce_the_kernel(texts):
    marks = Landmarks([" idiot ", " loser ", " stair "])
    own = [brute(w) for w in (" idiot ", " loser ", " stair ")]
    k = np.array([[sum(v * o.get(u, 0.0) for u, v in brute(t).items()) / np.sqrt(sum(v * v for v in o.values())) for o in own] for t in texts])
    np.testing.assert_allclose(marks.features(texts), k @ marks.root, atol=1e-9)


def test_folded_table_gives_the_decision_value_of_a_window():
    marks = Landmarks([" idiot ", " loser "])
    table = marks.table(np.array([0.7, -0.2]))
    text = "you idiot"
    direct = float((marks.features([" " + text]) @ np.array([0.7, -0.2]))[0])
    assert len(text) <= WINDOW
    (peak, end, _), = best_windows([text], table)
    assert peak == pytest.approx(direct, rel=1e-4) and end == len(text) + 1


def test_slices_of_long_texts_agree():
    marks = Landmarks([" idiot ", " loser "])
    table = marks.table(np.array([1.0, 1.0]))
    text = "words of no harm " * 40_000
    cut = text[:399_995] + " idiot " + text
    (peak, end, _), = best_windows([cut], table)
    (short, _, _), = best_windows(["harm idiot of"], table)
    assert "idiot" in (" " + cut)[end - WINDOW - 3:end + 3] and peak == pytest.approx(short, rel=0.1)
    assert best_windows(["", "9 9", "--"], table) == [(0.0, 0, 0)] * 3


def corpus(n, seed):
    rng = random.Random(seed)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it"]
    bad = ["idiot", "moron", "loser", "scum", "clown"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(rng.randrange(20, 90))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words) + "."))
        labels.append((i, toxic))
    return rows, labels


def test_held_out_accuracy_and_gapped_insults(spark):
    rows, labels = corpus(1500, 3)
    clean = rows[next(i for i, t in labels if t == 0)][1]
    extra = [(9000, None), (9001, ""), (9002, clean + " you i-d-i-o-t and l.o.s.e.r and m o r o n"), (9003, clean), (9003, clean)]
    extra += [(9100 + k, f"{clean} an {s.join('idiot')} then {clean}") for k, s in enumerate(" .-_")]
    docs = spark.createDataFrame([(*r, "c") for r in rows + extra], "doc_id long, text string, score string")
    got = toxicity(docs, spark.createDataFrame(labels + labels[:5], "doc_id long, toxic int"), toxic_docs=400, clean_docs=800).collect()
    assert len(got) == len(rows + extra) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    held = {r[0] for r in docs.where(held_out(F.col("doc_id"))).select("doc_id").collect()}
    assert {i for i, r in by.items() if r["held_out"]} == held
    right = [by[i]["predicted"] == t for i, t in labels if i in held]
    assert len(right) > 200 and sum(right) / len(right) > 0.97
    assert by[9003]["predicted"] == by[9001]["predicted"] == by[9000]["predicted"] == 0
    assert by[9002]["score"] > 5 * by[9003]["score"]      # the same text with insults spelt with gaps
    assert all(by[9100 + k]["predicted"] == 1 for k in range(4))     # one insult, with each kind of separator
    assert by[9000]["score"] == by[9001]["score"]


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r["score"], r["predicted"]) for r in toxicity(docs, none).collect()] == [(0.0, 0)] * 2
    assert toxicity(docs.limit(0), none).collect() == []


def test_landmark_features_take_little_memory():
    """What a worker holds at once does not grow with the number of windows; an executor runs several workers."""
    import tracemalloc

    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghijklmnoprstuv"), 4 + i % 8)) for i in range(240)]
    marks = Landmarks([f" {w} " for w in words])
    windows = [f" {words[i % 240]} {words[i * 7 % 240]}"[:WINDOW] for i in range(1000)]
    tracemalloc.start()
    got = marks.features(windows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    assert np.allclose(got[::97], np.concatenate([marks.features([w]) for w in windows[::97]]))
