"""Personal data by candidate gradient boosting.

Generators with high recall propose overlapping spans; boosted trees score each from its format and context;
thresholds calibrated per kind select what is redacted.  The base rules (email, ip, card, phone) always stay, the
model adds spans that no base span touches: cards and phones that run into other digits, obfuscated emails,
phones without a plus sign, bracketed addresses.

Training labels come from the whole corpus: spans that pass the base rules are true; the same spans are also planted
into harder contexts (joined with other numbers, obfuscated, corrupted), where truth is known by construction.  Every
other candidate there is false.  Candidates with equal features are counted, and the trees fit the counts as weights,
so training holds different feature vectors, not documents or candidates.

Documents are scored where they are read, in one pass without a shuffle.

Defined results: null text is the empty text (no spans); a corpus without a single base span trains no model and
gets base spans only; repeated rows give repeated results; an empty table gives an empty table; only ``doc_id``
and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import trees
from .common import release, staged

KINDS = ["email", "ip", "card", "phone"]
TARGET_PRECISION = 0.98
LEAST_ROWS = 3              # candidates in a leaf
STEPS = 256                 # parts of a unit of margin that are summed first
RESULT = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
          "n_added long, redacted_chars long")

# The base rules' patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match of these begins at the first digit of a run or nowhere in it, so later starts are not tried again.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Generators of further candidates.
_NUMBER = re.compile(r"[0-9](?:[ ().\[\]/-]{0,3}[0-9])+")
_MAYBE = re.compile(r"[0-9@]")
_GROUP = re.compile(r"[0-9]+")
_SPELT = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}"
                    r"(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{1,63}){1,6}")
# Words that announce personal data.
_CUES = {"email": {"email", "mail", "contact", "write", "e-mail"}, "ip": {"ip", "host", "server", "address", "from"},
         "card": {"card", "visa", "credit", "cc", "pay", "card:"}, "phone": {"phone", "tel", "call", "fax", "mobile", "tel:"}}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_GROUP.findall(s))


def email_spans(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the email pattern: from each @, back over the local part, on over the domain."""
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > done and (c := text[lo - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            out.append((lo, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The base rules: per kind, leftmost matches that do not overlap; failing matches are dropped."""
    if not _MAYBE.search(text):
        return {k: [] for k in KINDS}
    return {
        "email": email_spans(text),
        "ip": [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255
                                                           for p in m[0].split("."))],
        "card": [m.span() for m in _CARD.finditer(text)
                 if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)],
        "phone": [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15],
    }


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) proposals, overlapping: runs of neighbouring digit groups, and email-like spans."""
    out: set[tuple[int, int, int]] = set()
    for m in _NUMBER.finditer(text):
        if m.end() - m.start() < 7:
            continue
        groups = [g.span() for g in _GROUP.finditer(text, m.start(), m.end())]
        for i, (a, _) in enumerate(groups):
            total = 0
            for j in range(i, len(groups)):
                s, e = groups[j]
                total += e - s
                if total > 19:
                    break
                if total >= 13:
                    out.add((a, e, 2))
                if 9 <= total <= 15:
                    lo = a
                    if lo > 0 and text[lo - 1] == "(":
                        lo -= 1
                    if lo > 0 and text[lo - 1] == "+":
                        lo -= 1
                    out.add((lo, e, 3))
                if j - i == 3 and total <= 12:
                    out.add((a, e, 1))
    if "@" in text or "at)" in text or "at]" in text or " dot " in text:
        out.update((*m.span(), 0) for m in _SPELT.finditer(text))
    return sorted(out)


FEATURES = ["kind", "chars", "digits", "groups", "longest", "shortest", "plus", "parens", "dots", "spaces", "dashes",
            "luhn", "octets", "first_len", "last_len", "letters", "lead_digit", "touch_left", "touch_right",
            "digits_left", "digits_right", "cue", "dotted_tail", "spelt"]


def features(text: str, a: int, b: int, kind: int) -> list[float]:
    """Format of the span and context around it; the order is that of ``FEATURES``."""
    s = text[a:b]
    groups = _GROUP.findall(s)
    d = "".join(groups)
    sizes = [len(g) for g in groups] or [0]
    before, after = text[max(a - 24, 0):a], text[b:b + 24]
    left = before.split()[-2:] if before else []
    tail = re.split(r"\.|dot", s)[-1].strip(" )]([")
    return [kind, len(s), len(d), len(groups), max(sizes), min(sizes), s.startswith("+"), "(" in s, s.count("."),
            s.count(" "), s.count("-"), kind == 2 and luhn(d), kind == 1 and all(int(g[:4]) <= 255 for g in groups),
            sizes[0], sizes[-1], sum(c.isalpha() for c in s), int(d[0]) if d else -1,
            bool(before) and (before[-1].isalnum() or before[-1] in "=_\"'"),
            bool(after) and (after[0].isalnum() or after[0] in "=_\"'"),
            bool(re.search(r"[0-9][ ().-]?$", before)), bool(re.match(r"[ ().-]?[0-9]", after)),
            any(w.lower().strip(":,(") in _CUES[KINDS[kind]] for w in left),
            tail.isalpha() and 2 <= len(tail) <= 8, "at" in s and "@" not in s and kind == 0]


def _harder(kind: int, s: str, k: int, o: str) -> tuple[str, list[tuple[int, int]]]:
    """A context for a true span, chosen by ``k``, with ``o`` beside it: the text and the true spans of ``kind`` in it."""
    if kind == 0:
        t = s.replace("@", [" (at) ", " [at] ", " at ", "(at)"][k % 4], 1)
        t = t.replace(".", [".", " dot ", "[dot]"][k % 3]) if k % 3 else t
        return f"reach {t} now", [(6, 6 + len(t))]
    if kind == 1 and k % 3 == 0:
        t = s.replace(".", "[.]")
        return f"seen {t} today", [(5, 5 + len(t))]
    if kind == 3 and k % 4 == 0 and len(_GROUP.findall(s)) > 2:
        t = s.split(" ", 1)[1] if " " in s else s[1:]
        return f"call {t} soon", [(5, 5 + len(t))]
    if kind in (2, 3) and k % 2:
        return f"of {s} {o} and", [(3, 3 + len(s))]
    if kind == 2:
        return f"of {o} {s} and", [(4 + len(o), 4 + len(o) + len(s))]
    return f"with {s}, {o} in", [(5, 5 + len(s))]


def labelled(text: str) -> list[tuple[list[float], int]]:
    """Training rows of one document: candidates in place, and in planted contexts."""
    base = base_spans(text)
    rows = []

    def of(t: str, true: set[tuple[int, int, int]]) -> None:
        rows.extend((features(t, a, b, k), int((a, b, k) in true)) for a, b, k in candidates(t))

    true = {(a, b, k) for k, kind in enumerate(KINDS) for a, b in base[kind]}
    of(text, true)
    every = [(x, y) for x, y, _ in true]
    at: dict[tuple[int, int], list[int]] = {}
    kinds: dict[str, set[int]] = {}
    for i, (x, y, q) in enumerate(true):
        at.setdefault((x, y), []).append(i)
        kinds.setdefault(text[x:y], set()).add(q)
    lengths = sorted({len(s) for s in kinds})
    plain = [str(len(text)), "2024-01-31", "12 7 1999"]

    def companion(span: tuple[int, int], k: int) -> str:
        """Another true span of the document, or one of the plain values."""
        own = at[span]
        n = len(every) - len(own)
        i = k % (n + len(plain))
        if i >= n:
            return plain[i - n]
        for p in own:
            i += i >= p
        x, y = every[i]
        return text[x:y]

    for a, b, kind in sorted(true):
        s = text[a:b]
        for k in range(4):
            t, good = _harder(kind, s, a + k, companion((a, b), a + k))
            # What the companion holds is true as well; digits changed by one are false cards and addresses.
            truth = {(x, y, kind) for x, y in good}
            held = {w for n in lengths for i in range(len(t) - n + 1) if (w := t[i:i + n]) in kinds}
            truth |= {(t.find(w), t.find(w) + len(w), q) for w in held for q in kinds[w]}
            of(t, truth)
        if kind == 2:
            of(f"no {s[:-1]}{(int(s[-1]) + 1 + a % 8) % 10} x", set())
        if kind == 1:
            of(f"v {s.rsplit('.', 1)[0]}.{300 + a % 600} x", set())
    return rows


def _mask(spans: Iterable[tuple[int, int]], length: int) -> bytearray:
    """A byte for each character, 1 under a span: one look tells whether a candidate touches any of many spans."""
    mask = bytearray(length)
    for a, b in spans:
        mask[a:b] = b"\1" * (b - a)
    return mask


def _add(base: dict[str, list[tuple[int, int]]], scored: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int]]:
    """Greedy choice, best score first, of spans that touch no base span and no chosen one."""
    if not scored:
        return []
    spans = [x for own in base.values() for x in own]
    taken = _mask(spans, max(b for _, b in [*spans, *((a, b) for _, a, b, _ in scored)]))
    out = []
    for _, a, b, k in sorted(scored, key=lambda x: (-x[0], x[1], -x[2], x[3])):
        if taken.find(1, a, b) < 0:
            taken[a:b] = b"\1" * (b - a)
            out.append((k, a, b))
    return out


class Model:
    """Flat trees and a margin threshold per kind."""

    def __init__(self, forest: list, cut: list[float]):
        self.forest, self.cut = forest, cut


def labels(docs: DataFrame) -> DataFrame:
    """held, label, x (features), n: how many candidates of all documents are so; a fifth of the ids is held for calibration."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = Counter((i is not None and i % 5 == 0, float(y), tuple(map(int, x)))
                          for i, text in zip(batch.column(0).to_pylist(), batch.column(1)) for x, y in labelled(text.as_py() or ""))
            if got:
                held, y, x = zip(*got)
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.bool_()), pa.array(y, pa.float64()), pa.array(x, pa.list_(pa.int32())),
                                                  pa.array(got.values(), pa.int64())], ["held", "label", "x", "n"])

    return (docs.select("doc_id", "text").mapInArrow(rows, "held boolean, label double, x array<int>, n long")
            .groupBy("held", "label", "x").agg(F.sum("n").alias("n")))


def train(docs: DataFrame, precision: float = TARGET_PRECISION) -> Model | None:
    """Boosted trees on the labelled candidates of all documents but a fifth; that fifth gives the thresholds."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    got = staged(labels(docs), "pii-labels")
    n = {(r["held"], r["label"]): r["n"] for r in got.groupBy("held", "label").agg(F.sum("n").alias("n")).collect()}
    if not n.get((False, 1.0)) or not n.get((False, 0.0)):
        release(got)
        return None
    # By weight, half a candidate less, so that no rounding keeps LEAST_ROWS from being enough.
    least = min((LEAST_ROWS - 0.5) / (n[False, 1.0] + n[False, 0.0]), 0.49)
    fitted = GBTClassifier(featuresCol="v", labelCol="label", weightCol="w", maxDepth=4, maxIter=15, stepSize=0.3, seed=7,
                           minWeightFractionPerNode=least).fit(
        got.where("NOT held").select(array_to_vector(F.col("x").cast("array<double>")).alias("v"), "label", F.col("n").cast("double").alias("w")))
    forest = trees.flatten(fitted)
    cut = cuts(got.where("held"), forest, precision)
    release(got)
    return Model(forest, cut)


def cuts(held: DataFrame, forest: list, precision: float) -> list[float]:
    """Per kind, the lowest margin from which up ``precision`` of the candidates (x, label, n) are true, 0 at least."""
    model = held.sparkSession.sparkContext.broadcast(forest)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(0).to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].astype(np.int32)), pa.array(trees.margin(model.value, x)),
                                                  batch.column(1), batch.column(2)], ["kind", "margin", "n", "good"])

    at = staged(held.select("x", "n", (F.col("n") * F.col("label")).cast("long").alias("good"))
                .mapInArrow(score, "kind int, margin double, n long, good long")
                .groupBy("kind", "margin").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
                .withColumn("step", F.floor(F.col("margin") * STEPS)), "pii-margins")
    # Margins are bounded by the trees' weights, so there are a few thousand steps, whatever the size of the data.
    higher = Window.partitionBy("kind").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    sums = at.groupBy("kind", "step").agg(F.sum("n").alias("step_n"), F.sum("good").alias("step_good"))
    above = sums.select("kind", "step", *[F.coalesce(F.sum(f"step_{c}").over(higher), F.lit(0)).alias(f"above_{c}") for c in ("n", "good")])
    within = Window.partitionBy("kind", "step").orderBy(F.desc("margin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    up = at.join(F.broadcast(above), ["kind", "step"]).select("kind", "margin", *[
        (F.sum(c).over(within) + F.col(f"above_{c}")).alias(c) for c in ("n", "good")])
    least = {r["kind"]: r["least"] for r in up.where(F.col("good") / F.col("n") >= precision).groupBy("kind").agg(F.min("margin").alias("least")).collect()}
    release(at)
    # Nothing of a kind in the calibration part: only what the trees are surest of.
    return [max(least[k], 0.0) if k in least else 1.0 for k in range(len(KINDS))]


def find_pii(docs: DataFrame) -> DataFrame:
    """Per document: base counts, hash of the base spans, all spans (base and added), how many were added."""
    spark: SparkSession = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = spark.sparkContext.broadcast(train(source))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            docs_, where, found = [], [], []
            for n, text in enumerate(texts):
                t = text.as_py() or ""
                base = base_spans(t)
                docs_.append(base)
                if m:
                    proposed = candidates(t)
                    mask = _mask((x for s in base.values() for x in s), len(t)) if proposed else b""
                    own = [c for c in proposed if mask.find(1, c[0], c[1]) < 0]
                    where += [(n, *c) for c in own]
                    found += [features(t, *c) for c in own]
            added: dict[int, list[tuple[float, int, int, int]]] = {}
            if where:
                score = trees.margin(m.forest, np.array(found, dtype=np.float64))
                for (n, a, b, k), s in zip(where, score):
                    if s >= m.cut[k]:
                        added.setdefault(n, []).append((float(s), a, b, k))
            rows = []
            for n, base in enumerate(docs_):
                more = _add(base, added.get(n, []))
                plain = [f"{k}:{a}:{b}" for k in KINDS for a, b in base[k]]
                every = sorted([(k, a, b) for k, kind in enumerate(KINDS) for a, b in base[kind]] + more)
                rows.append((ids[n], *(len(base[k]) for k in KINDS), hashlib.sha256(",".join(plain).encode()).hexdigest(),
                             ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in every), len(more), covered(every)))
            cols = list(zip(*rows)) if rows else [[]] * 9
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string() if i in (5, 6) else pa.int64()) for i, c in enumerate(cols)],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "redacted_chars"])

    return source.mapInArrow(scan, RESULT)


def covered(spans: list[tuple[int, int, int]]) -> int:
    """Characters under at least one span."""
    total = end = 0
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def redact(text: str, spans: str) -> str:
    """``text`` with the spans of a result row replaced by their kind."""
    out, end = [], 0
    for kind, a, b in sorted(((k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)), key=lambda s: s[1:]):
        if a >= end:
            out += [text[end:a], f"<{kind}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])
