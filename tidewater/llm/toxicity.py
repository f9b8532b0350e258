"""Toxicity by a subsequence string-kernel support vector machine with Nystrom landmarks.

Kernel: two strings are compared by their common 4-symbol subsequences with gaps (letters, and one symbol for a
word boundary); an occurrence that spans n characters weighs DECAY ** n, up to MAX_SPAN, so an insult with inserted
characters still matches.  Characters decide how much their gap weighs: separators between letters that stand alone
and a mark inside a word (``joined``) do not count, so a spaced-out or dotted insult weighs as much as a plain one.
Landmarks are words: those that speak most for the toxic label, and words chosen by hash.  A sentence enters
training as the window of WINDOW characters that speaks most for its label; its Nystrom features are the kernel
values with the landmarks times K ** -1/2, and MLlib's linear support vector machine is fitted on them, twice: the
second time with the windows that the first model finds worst in clean documents.

The decision function is linear in the subsequence weights, so the landmarks fold into one table of fixed size
over all subsequences.  A document's margin is the largest window sum anywhere in its whole text, found by array
arithmetic where the document is read; a logistic curve over the training documents, some of the clean ones once
more with a single planted insult, turns it into the score.

Training reads a bounded, hash-ordered sample of labelled rows (``toxic_docs``, ``clean_docs``); labels, lang,
source and doc_id are no inputs of a score.

Defined results: null text is the empty text, which scores like a text without a match; without labels of both
kinds every document gets the share of toxic labels (0 if there are none); repeated label rows count once, the
largest label holds; repeated documents give repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

TOXIC_DOCS, CLEAN_DOCS = 3000, 6000
CLEAN_SENTENCES = 6              # of a clean training document, about, chosen by hash
GAPPED_WEIGHT = 0.6              # of a toxic training document spelt with gaps, when the score is calibrated
PLANTED_WEIGHT = 0.2             # of clean training documents with one planted insult, against all toxic ones
LANDMARKS = 240
DECAY, MAX_SPAN, WINDOW = 0.75, 7, 12
SYMBOLS = 40                     # 0 matches nothing, 1-26 a-z, 27 word boundary, the rest shared by other letters
SLICE = 100_000                  # characters handled at once
TOGETHER = 25                    # windows mapped onto the landmarks at once

_SENTENCE = re.compile(r"[^.!?\n]+")
_TOKEN = re.compile(r"[^\W\d_]{3,}")


def _symbol_table() -> np.ndarray:
    t = np.zeros(0x3000, dtype=np.int32)
    for c in range(0x3000):
        if chr(c).isalpha():
            t[c] = c - 96 if 97 <= c <= 122 else 28 + c % (SYMBOLS - 28)
        elif chr(c).isspace() or chr(c) in ".,;:!?()\"":
            t[c] = 27
    return t


_TABLE = _symbol_table()
_EDGE = np.array([27], dtype=np.int32)     # a text begins with a word boundary
# (a, b, c): how far before the last symbol the others stand.
_STEPS = [(a, b, c) for c in range(3, MAX_SPAN) for b in range(2, c) for a in range(1, b)]


def symbols(text: str) -> np.ndarray:
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    wide = code >= len(_TABLE)
    if wide.any():
        return np.where(wide, 28 + code % (SYMBOLS - 28), _TABLE[np.where(wide, 0, code)]).astype(np.int32)
    return _TABLE[code]


def joined(text: str) -> str:
    """The text without the characters whose gap weighs nothing: separators between letters that all stand alone, and
    a mark between two letters of a word (``i d i o t``, ``i.d.i.o.t`` and ``id*iot`` give ``idiot``).

    Letters stand alone in a run of three or more with the same separator, one to three characters and no digits.
    """
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kind = _TABLE[code] if not len(code) or code.max() < len(_TABLE) else symbols(text)
    if len(kind) != len(code):
        kind = symbols("".join(c if len(c.lower()) == 1 else "?" for c in text))
    letter = np.zeros(len(code) + 6, dtype=bool)         # with room on both sides
    letter[1:-5] = (kind > 0) & (kind != 27)
    here, left, right = letter[1:-5], letter[:-6], letter[2:-4]
    digit = (code >= 48) & (code <= 57)
    drop = (kind == 0) & left & right & ~digit
    alone = np.nonzero(here & ~left & ~right)[0]
    if len(alone) > 2:
        step = np.diff(alone)
        near = step <= 4
        other = letter.copy()
        other[1:-5] |= digit
        for g in (1, 2, 3):                              # nothing but a separator between
            near &= (step <= g) | ~other[alone[:-1] + g + 1]
        sign = code[alone[:-1] + 1]
        like = near[1:] & near[:-1] & (step[1:] == step[:-1]) & (sign[1:] == sign[:-1])
        spread = np.zeros(len(near), dtype=bool)
        spread[1:] |= like
        spread[:-1] |= like
        for g in (1, 2, 3):
            drop[alone[:-1][spread & (step > g)] + g] = True
    return code[~drop].tobytes().decode("utf-32-le", "surrogatepass") if drop.any() else text


def subsequences(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The subsequences of a short text and their kernel weights."""
    x = symbols(text)
    ids, weights = [], []
    for a, b, c in _STEPS:
        if len(x) > c:
            q = x[:-c], x[c - b:len(x) - b], x[c - a:len(x) - a], x[c:]
            ok = (q[0] > 0) & (q[1] > 0) & (q[2] > 0) & (q[3] > 0)
            ids.append((((q[0] * SYMBOLS + q[1]) * SYMBOLS + q[2]) * SYMBOLS + q[3])[ok])
            weights.append(np.full(int(ok.sum()), DECAY ** (c + 1)))
    if not ids:
        return np.zeros(0, np.int32), np.zeros(0)
    u, at = np.unique(np.concatenate(ids), return_inverse=True)
    return u, np.bincount(at, np.concatenate(weights), len(u))


class Landmarks:
    """Normalised landmark strings, and the Nystrom map of other strings onto them."""

    def __init__(self, words: list[str]):
        own = [(u, w / np.linalg.norm(w)) for u, w in map(subsequences, words) if len(u)]
        self.ids = np.unique(np.concatenate([u for u, _ in own]))
        self.by_id = np.zeros((len(self.ids), len(own)))
        for j, (u, w) in enumerate(own):
            self.by_id[np.searchsorted(self.ids, u), j] = w
        values, vectors = np.linalg.eigh(self.by_id.T @ self.by_id)
        keep = values > 1e-6 * values.max()
        self.root = vectors[:, keep] / np.sqrt(values[keep]) @ vectors[:, keep].T

    def features(self, texts: list[str]) -> np.ndarray:
        """Nystrom features of short strings, all at once: they are laid end to end with gaps that nothing spans."""
        place = np.full(SYMBOLS ** 4, -1, dtype=np.int32)
        place[self.ids] = np.arange(len(self.ids))
        out = np.zeros((len(texts), self.by_id.shape[1]))
        for lo in range(0, len(texts), TOGETHER):
            part = [symbols(t) for t in texts[lo:lo + TOGETHER]]
            gap = np.zeros(MAX_SPAN, dtype=np.int32)
            x = np.concatenate([y for p in part for y in (p, gap)])
            owner = np.repeat(np.arange(len(part)), [len(p) + MAX_SPAN for p in part])
            whose, where, weight = [], [], []
            for a, b, c in _STEPS:
                n = len(x) - c
                if n <= 0:
                    continue
                q = x[:n], x[c - b:c - b + n], x[c - a:c - a + n], x[c:]
                col = place[((q[0] * SYMBOLS + q[1]) * SYMBOLS + q[2]) * SYMBOLS + q[3]]
                at = np.nonzero(col >= 0)[0]
                whose.append(owner[at])
                where.append(col[at])
                weight.append(np.full(len(at), DECAY ** (c + 1)))
            who = np.concatenate(whose) if whose else np.zeros(0, np.int64)
            if len(who):
                order = np.argsort(who, kind="stable")
                who, cols, w = who[order], np.concatenate(where)[order], np.concatenate(weight)[order]
                first = np.nonzero(np.diff(who, prepend=-1))[0]
                out[lo + who[first]] = np.add.reduceat(self.by_id[cols] * w[:, None], first, axis=0)
        return out @ self.root

    def table(self, coefficients: np.ndarray) -> np.ndarray:
        """The weight of every subsequence under the given Nystrom coefficients."""
        out = np.zeros(SYMBOLS ** 4, dtype=np.float32)
        out[self.ids] = self.by_id @ (self.root @ coefficients)
        return out


def window_sums(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each place, the kernel decision sum of the window of WINDOW characters that ends there."""
    n, got = len(x), np.zeros(len(x), dtype=np.float32)
    pairs = {d: x[:-d] * SYMBOLS + x[d:] for d in range(1, MAX_SPAN - 2) if n > d}   # two symbols d apart, by the first
    for a, b, c in _STEPS:
        if n > c:
            early, late = pairs[c - b][:n - c], pairs[a][c - a:]
            got[c:] += np.float32(DECAY ** (c + 1)) * table[early * (SYMBOLS * SYMBOLS) + late]
    total = np.cumsum(got, dtype=np.float64)
    total[WINDOW:] -= total[:-WINDOW].copy()
    return total


def best_windows(texts: list[str], table: np.ndarray, over: float = np.inf) -> list[tuple[float, int, int]]:
    """(largest window sum, where that window ends, places with a sum above ``over``) of each text; zeros without a match."""
    out: list[tuple[float, int, int]] = []
    gap = np.zeros(WINDOW + MAX_SPAN, dtype=np.int32)
    held: list[np.ndarray] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        if not held:
            return
        sums = window_sums(np.concatenate([y for x in held for y in (x, gap)]), table)
        at = 0
        for x in held:
            own = sums[at:at + len(x) + 1]
            n = int(own.argmax())
            out.append((float(own[n]), n + 1, int((own > over).sum())) if own[n] > 0 else (0.0, 0, 0))
            at += len(x) + len(gap)
        held, size = [], 0

    for t in texts:
        x = np.concatenate([_EDGE, symbols(t)])
        if len(x) > SLICE:                       # a long text: slices that overlap by a window and a span
            flush()
            best, lead = (0.0, 0), WINDOW + MAX_SPAN
            places = 0
            for s in range(0, len(x), SLICE):
                lo = max(s - lead, 0)
                sums = window_sums(x[lo:s + SLICE], table)[s - lo:]
                n = int(sums.argmax())
                if sums[n] > best[0]:
                    best = (float(sums[n]), s + n + 1)
                places += int((sums > over).sum())
            out.append((*best, places))
            continue
        held.append(x)
        size += len(x)
        if size > SLICE:
            flush()
    flush()
    return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def _signature(words: set[str]) -> int:
    """Near copies mostly agree on it, so their words do not count once per copy."""
    return min((zlib.crc32(w.encode()) for w in words), default=0)


def _sample(docs: DataFrame, labels: DataFrame, toxic_docs: int, clean_docs: int) -> DataFrame:
    own = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for label, bound in ((1, toxic_docs), (0, clean_docs)):
        some = own.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
        chosen = some if chosen is None else chosen.unionAll(some)
    # at most toxic_docs + clean_docs ids
    return docs.join(F.broadcast(chosen), "doc_id").dropDuplicates(["text"]).select("doc_id", "text", "toxic")


def _per_doc(df: DataFrame, fn, schema: str, names: list[str], kinds: list[pa.DataType]) -> DataFrame:
    """Rows that ``fn(texts, toxic)`` makes of each batch of sample documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 128):
                part = b.slice(s, 128)
                rows = fn(part.column(0).to_pylist(), part.column(1).to_pylist())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    return df.select(F.coalesce("text", F.lit("")).alias("text"), "toxic").mapInArrow(run, schema)


def _word_evidence(sample: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """word, gain: how much a word's spread over toxic and clean documents speaks for the toxic label."""
    def words(texts, toxic):
        rows = []
        for t, y in zip(texts, toxic):
            own = set(_TOKEN.findall(joined(t).lower()))
            sig = _signature(own)
            rows += [(w, int(y), sig) for w in own]
        return rows

    counted = (_per_doc(sample, words, "word string, toxic int, sig long", ["word", "toxic", "sig"],
                        [pa.string(), pa.int32(), pa.int64()])
               .distinct().groupBy("word").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")))
    odds = F.log(((F.col("p") + 0.5) / (n_toxic + 1)) / ((F.col("n") + 0.5) / (n_clean + 1)))
    share = n_toxic / (n_toxic + n_clean)
    both = F.col("p") + F.col("n")

    def part(seen: str, expected: float) -> Column:
        return F.when(F.col(seen) > 0, F.col(seen) * F.log(F.col(seen) / (both * expected))).otherwise(0.0)

    # Log-likelihood gain of the word's own toxic share over the share of all documents.
    sure = F.when(F.col("p") > both * share, part("p", share) + part("n", 1 - share)).otherwise(0.0)
    return counted.withColumn("odds", odds).withColumn("gain", F.col("p") * odds).withColumn("sure", sure)


def _gapped(word: str, k: int) -> str:
    """The word with characters put between its letters, in one of several ways."""
    return [word, "-".join(word), ".".join(word), " ".join(word), word[:2] + "*" + word[2:], word[:3] + "." + word[3:],
            "".join(c + ("_" if i % 2 else "") for i, c in enumerate(word)), word[:1] + "x" + word[1:]][k % 8]


def _spelt_with_gaps(text: str, gains: dict[str, float]) -> str:
    return _TOKEN.sub(lambda m: _gapped(m[0], 1 + zlib.crc32(f"{m.start()}".encode()) % 7) if m[0] in gains else m[0], text.lower())


def _with_one(text: str, words: list[str], sums: np.ndarray) -> str:
    """The text with one of the words, drawn by its share of ``sums`` and spelt in one of several ways, at a place of its own."""
    h = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    word = words[int(np.searchsorted(sums, sums[-1] * (h % 1009) / 1009, side="right"))]
    at = max(text.find(" ", h % (len(text) + 1)), 0)
    return f"{text[:at]} {_gapped(word, h // 1009)}{text[at:] if at else ' ' + text}"


def _windows_of_sentences(gains: dict[str, float]):
    """Sentences as windows: around the strongest word of toxic ones, around hash-chosen words of clean ones."""
    def rows(texts, toxic):
        out = []
        for t, y in zip(texts, toxic):
            low = joined(t).lower()
            sentences = sum(1 for _ in _SENTENCE.finditer(low))
            for n, s in enumerate(f" {m[0]} " for m in _SENTENCE.finditer(low)):
                found = [(m.start(), m[0]) for m in _TOKEN.finditer(s)]
                if not found:
                    continue
                if y:
                    at, w = max(found, key=lambda f: gains.get(f[1], 0.0))
                    if w not in gains:
                        continue        # nothing in this sentence of a toxic document speaks for its label
                    k = zlib.crc32(f"{n} {w}".encode())
                    out.append((s[max(at - 2, 0):at + WINDOW], 1.0))
                    out.append((f" {joined(_gapped(w, k))[:WINDOW + 4]} ", 1.0))
                elif zlib.crc32(s.encode()) % max(1, sentences // CLEAN_SENTENCES) == 0:
                    at, w = found[zlib.crc32(s.encode()) % len(found)]
                    out.append((s[max(at - 2, 0):at + WINDOW], 0.0))
                    if n % 8 == 0:
                        out.append((f" {joined(_gapped(w, n // 8))[:WINDOW + 4]} ", 0.0))
        return out
    return rows


def _worst_windows(table: np.ndarray):
    """The window of each document that the given model finds most toxic."""
    def rows(texts, toxic):
        texts = [joined(t) for t in texts]
        return [(f" {t.lower()}"[max(e - WINDOW - 3, 0):e], float(y)) for t, y, (s, e, _) in zip(texts, toxic, best_windows(texts, table))
                if s > 0 and not y]
    return rows


def _fit(sample: DataFrame, makers: list, marks: Landmarks) -> tuple[np.ndarray, float]:
    """The machine fitted on the windows that each of ``makers`` (as in ``_per_doc``) finds in the sample.

    Windows are made and mapped by the same Python worker: a chain of two steps would hold two workers a task.
    """
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import array_to_vector

    held = sample.sparkSession.sparkContext.broadcast(marks)

    def mapped(make):
        def rows(texts, toxic):
            found = make(texts, toxic)
            return [(x, y) for x, (_, y) in zip(held.value.features([w for w, _ in found]), found)]
        return _per_doc(sample, rows, "x array<double>, label double", ["x", "label"], [pa.list_(pa.float64()), pa.float64()])

    got = reduce(DataFrame.unionAll, map(mapped, makers)).coalesce(4)
    rows = got.select(array_to_vector("x").alias("x"), "label").persist()
    try:
        n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        if len(n) < 2:
            return np.zeros(marks.by_id.shape[1]), 0.0
        balance = F.when(F.col("label") == 1, n[0.0] / n[1.0]).otherwise(1.0) if n[1.0] < n[0.0] else F.lit(1.0)
        fitted = LinearSVC(featuresCol="x", labelCol="label", weightCol="w", regParam=1e-4, maxIter=50,
                           standardization=False).fit(rows.withColumn("w", balance))
        return fitted.coefficients.toArray(), float(fitted.intercept)
    finally:
        rows.unpersist()


def _evidence(texts: list[str], table: np.ndarray, over: float) -> np.ndarray:
    """What the score is made of: the largest window sum, the places above ``over``, the length, and one."""
    got = best_windows([joined(t) for t in texts], table, over)
    return np.array([[m, np.log1p(n), np.log1p(len(t)), 1.0] for (m, _, n), t in zip(got, texts)]).reshape(-1, 4)


def _logistic(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Coefficients of a weighted logistic regression, by Newton's method with a little ridge."""
    scale = np.maximum(np.abs(z).max(0), 1e-9)
    z, beta = z / scale, np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        g = z.T @ (w * (y - p)) - 1e-2 * beta
        h = (z * (w * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(beta))
        step = np.clip(np.linalg.solve(h, g), -4, 4)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta / scale


class Model:
    """Subsequence weights and the curve from a document's evidence to its score; without weights, one score."""

    def __init__(self, table: np.ndarray | None, over: float = 0.0, curve: np.ndarray | None = None, plain: float = 0.0):
        self.table, self.over, self.curve, self.plain = table, over, curve, plain

    def scores(self, texts: list[str]) -> list[float]:
        if self.table is None or not texts:
            return [self.plain] * len(texts)
        return (1 / (1 + np.exp(-np.clip(_evidence(texts, self.table, self.over) @ self.curve, -500, 500)))).tolist()


def train(docs: DataFrame, labels: DataFrame, toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS,
          landmarks: int = LANDMARKS) -> Model:
    spark = docs.sparkSession
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    sample = staged(_sample(docs, labels, toxic_docs, clean_docs), "toxic-sample")
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return Model(None, plain=float(bool(n.get(1))))
    gains_df = staged(_word_evidence(sample, n[1], n[0]), "toxic-words")
    # Words that chance would not make in so large a vocabulary; a small corpus can show none, and there the likeliest.
    found = gains_df.where("p >= 3 AND odds > 1.7")
    chance = math.log(max(gains_df.count(), 1))
    for some in (found.where(F.col("sure") > chance), found):
        strong = {r["word"]: r["gain"] for r in some.orderBy(F.desc("gain"), "word").limit(4 * landmarks).collect()}
        if strong:
            break
    plain = [r["word"] for r in gains_df.where("n > 0").orderBy(F.xxhash64("word"), "word").limit(landmarks // 2).collect()]
    if not strong:
        return Model(None, plain=n[1] / (n[0] + n[1]))
    marks = Landmarks([f" {w} " for w in [*list(strong)[:landmarks - len(plain)], *plain]])
    first = _windows_of_sentences(strong)
    coef, _ = _fit(sample, [first], marks)
    table = spark.sparkContext.broadcast(marks.table(coef))

    def worst(texts, toxic):
        return _worst_windows(table.value)(texts, toxic)

    coef, _ = _fit(sample, [first, worst, worst], marks)
    final = marks.table(coef)
    held = spark.sparkContext.broadcast(final)
    peaks = _per_doc(sample.where("toxic = 1"), lambda t, y: [(m,) for m, _, _ in best_windows([joined(x) for x in t], held.value)],
                     "margin double", ["margin"], [pa.float64()]).collect()          # bounded by the sample
    over = 0.6 * float(np.median([r["margin"] for r in peaks]))
    # Rows of evidence, bounded by the sample; toxic documents once more with their strongest words spelt with gaps,
    # and every third clean one with a single insult, which must be enough.
    words, sums = list(strong), np.cumsum(list(strong.values()))

    def evidence(texts, toxic):
        spelt = [(_spelt_with_gaps(t, strong), 2) for t, y in zip(texts, toxic) if y]
        one = [(_with_one(t, words, sums), 3) for t, y in zip(texts, toxic) if not y and zlib.crc32(t.encode("utf-8", "surrogatepass")) % 3 == 0]
        every = [*zip(texts, toxic), *spelt, *one]
        return [(e.tolist(), int(y)) for e, (_, y) in zip(_evidence([t for t, _ in every], held.value, over), every)]

    rows = _per_doc(sample, evidence, "e array<double>, toxic int", ["e", "toxic"], [pa.list_(pa.float64()), pa.int32()]).collect()
    totals = {r["toxic"]: r["n"] for r in labels.where(~held_out(F.col("doc_id"))).groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    kind = np.array([r["toxic"] for r in rows])
    y = (kind > 0).astype(float)
    w = np.where(y > 0, totals.get(1, 1) / n[1], totals.get(0, 1) / n[0]) * np.where(kind == 2, GAPPED_WEIGHT, 1.0)
    w[kind == 3] *= PLANTED_WEIGHT * n[1] / max((kind == 3).sum(), 1)
    return Model(final, over, _logistic(np.array([r["e"] for r in rows]), y, w * len(w) / w.sum()))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 128):
                part = b.slice(s, 128)
                texts = [t or "" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held.value.scores(texts), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """Train on the labelled documents outside the held-out fifth and score every document."""
    model = train(docs.select("doc_id", "text"), labels, **bounds)
    return score_documents(docs, model).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents, all columns, whose score is below ``threshold``; read once, no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 128):
                part = b.slice(s, 128)
                scores = held.value.scores([t or "" for t in part.column(at).to_pylist()])
                yield part.filter(pa.array([x < threshold for x in scores]))

    return docs.mapInArrow(run, docs.schema)
