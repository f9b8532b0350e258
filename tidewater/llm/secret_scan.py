"""Secret scan: a random forest over candidate strings, trained from labelled findings, with Spark expressions only.

Candidates are long runs of key-like characters, quoted or assigned values, and values after a credential's name.  MLlib's random forest judges each by
its length, transitions between character kinds, how much of it dictionary words cover, whether it looks like a path
or address, and the words beside it.

Labelled findings come from the corpus in a bounded sample (``sample_docs`` documents by hash): candidates of a known
key format, or assigned to a name of a credential, are findings; other candidates are false positives.  The forest
never sees these rules: the format prefix and the full assignment are no features, and a bounded number of findings
enters a second time without its neighbours, so that a secret is known by its characters alone, too.

Everything runs on the JVM and in one pass without a shuffle: candidates by regular expressions, features by
expressions, the forest by MLlib.

Defined results: null text is the empty text (no row); documents without a candidate give no row; repeated documents
give repeated findings; without findings of both kinds in the sample the rule alone decides; an empty table gives an
empty table; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS = 8_000
TREES, DEPTH = 30, 8
THRESHOLD = 0.5
MARK = "\x01"

# A candidate: 12 or more key characters holding a digit, not inside a longer run of them.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_-]{12,}={0,2}(?![A-Za-z0-9+/_=-])"
# With a name and an equals sign in front, the value after it, 8 or more characters.
ASSIGNED = r"(?<=[A-Za-z0-9_-]=)[^\s\"'=&<>]{8,}"
# Between quotes, 8 or more characters without white space.
QUOTED = r"(?<=[\"'])[^\s\"'<>]{8,}(?=[\"'])"
# Name of a credential with ':' or '=' behind it, and the value after them, 8 or more characters.
NAMES = r"(?:pass(?:word|wd)?|secret|token|api_?key|access_?key|auth|credential|private_?key)"
NAMED_VALUE = rf"((?i:{NAMES})[_-]?[0-9]{{0,3}}[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?)([^\s\"'=&<>]{{7,}}[^\s\"'=&<>.,;:!?)\]}}]={{0,2}})"
# Public key formats, and names under which credentials are kept.
KNOWN = (r"^(AKIA|ASIA)[0-9A-Z]{12,}$|^gh[pousr]_[A-Za-z0-9]{20,}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|^eyJ[A-Za-z0-9_-]{10,}"
         r"|^sk[-_](live|test)?[-_]?[A-Za-z0-9]{16,}$|^AIza[0-9A-Za-z_-]{30,}$")
NAMED = r"(?i)(pass(word|wd)?|secret|token|api_?key|access_?key|auth|credential|private_?key)\s*[=:]\s*[\"']?$"
NAME_WORD = r"(?i)pass(word|wd)?|secret|token|key|auth|credential|private"
# Pieces of ordinary words, for dictionary coverage.
PIECES = (r"(?i)the|and|ing|tion|ent|ver|ich|sch|ung|keit|heit|lich|que|eau|eux|elle|ment|aux|ci[oó]n|mente|ado|ara|er|on|an"
          r"|re|he|in|ed|nd|ha|at|en|es|of|or|nt|ea|ti|to|it|st|is|le|th|wh|ou|sh|ble|ly")

FEATURES = ["chars", "digits", "uppers", "lowers", "symbols", "kinds", "changes", "change_rate", "hex", "cover", "path",
            "quoted", "name_left", "equals_left", "left_chars", "right_chars", "left_digit", "distinct"]


def segments(docs: DataFrame) -> DataFrame:
    """doc, place in the document's list, segment: texts cut around their candidates, which take the odd places."""
    t = F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(MARK), F.lit(" "))
    # Every candidate holds a digit or follows a quote, a colon or an equals sign; texts with none of them need no search.
    cut = F.when(t.rlike("[0-9=:\"']"), F.regexp_replace(
        t, f"{NAMED_VALUE}|({ASSIGNED}|{QUOTED}|{CANDIDATE})", f"$1{MARK}$2$3{MARK}")).otherwise(F.lit(""))
    parts = F.split(cut, MARK)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(t).alias("text_hash"), parts.alias("parts"))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, start (code points), candidate, before, after: one row for each candidate."""
    parts = F.col("parts")
    # Candidates with the text on both sides: zipped lists, so no lookups by place.
    n = F.size(parts)
    sides = F.arrays_zip(
        F.filter(parts, lambda x, i: (i % 2 == 0) & (i < n - 1)).alias("before"),
        F.filter(parts, lambda x, i: i % 2 == 1).alias("candidate"),
        F.filter(parts, lambda x, i: (i % 2 == 0) & (i > 0)).alias("after"))
    rows = F.transform(sides, lambda x: F.struct(
        (F.length(x["before"]) + F.length(x["candidate"])).alias("advance"), x["candidate"].alias("candidate"),
        F.right(x["before"], F.lit(40)).alias("before"), F.left(x["after"], F.lit(40)).alias("after")))
    # Running place: an aggregation over the advances before each candidate.
    ends = F.aggregate("r", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["advance"])))
    lists = docs.select("doc_id", "text_hash", rows.alias("r")).select("doc_id", "text_hash", "r", F.slice(ends, F.lit(2), F.size("r")).alias("e"))
    flat = lists.select("doc_id", "text_hash", F.inline(F.arrays_zip("r", "e")))
    return flat.select("doc_id", "text_hash", (F.col("e") - F.length("r.candidate")).alias("start"), "r.candidate", "r.before", "r.after")


def _count(c: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(c, f"[^{keep}]", "")).cast("double")


def with_features(rows: DataFrame) -> DataFrame:
    c, before, after = F.col("candidate"), F.col("before"), F.col("after")
    # Kinds of neighbouring characters: where a run of one kind ends and another begins.
    runs = F.size(F.split(F.regexp_replace(c, r"[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+", "x"), "x")) - 1
    left = F.element_at(F.split(F.rtrim(before), r"\s+"), -1)
    right = F.element_at(F.split(F.ltrim(after), r"\s+"), 1)
    return rows.select(
        "*", F.length(c).cast("double").alias("chars"), _count(c, "0-9").alias("digits"), _count(c, "A-Z").alias("uppers"),
        _count(c, "a-z").alias("lowers"), F.length(F.regexp_replace(c, "[A-Za-z0-9]", "")).cast("double").alias("symbols"),
        (c.rlike("[a-z]").cast("double") + c.rlike("[A-Z]").cast("double") + c.rlike("[0-9]").cast("double")).alias("kinds"),
        runs.cast("double").alias("changes"), (runs / F.length(c)).alias("change_rate"), c.rlike("^[0-9a-f]+$").cast("double").alias("hex"),
        (1 - F.length(F.regexp_replace(c, PIECES, "")) / F.length(c)).alias("cover"),
        c.rlike(r"/[^/]+/|^www|\.(com|org|net|html?)|^[0-9-]+$").cast("double").alias("path"),
        (before.rlike("[\"']$") & after.rlike("^[\"']")).cast("double").alias("quoted"),
        before.rlike(f"({NAME_WORD})" + r"\W{0,4}$").cast("double").alias("name_left"),
        before.rlike("[=:]\\s*[\"']?$").cast("double").alias("equals_left"),
        F.length(left).cast("double").alias("left_chars"), F.length(right).cast("double").alias("right_chars"),
        left.rlike("[0-9]").cast("double").alias("left_digit"),
        F.size(F.array_distinct(F.split(c, ""))).cast("double").alias("distinct"))


def rule() -> Column:
    """The finding rule that labels training rows."""
    return F.col("candidate").rlike(KNOWN) | F.col("before").rlike(NAMED)


def scan_secrets(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, start, chars, candidate, score, is_secret for every candidate of every document."""
    found = with_features(candidates(segments(docs)))
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    sample = docs.join(F.broadcast(ids), "doc_id", "left_semi")        # at most sample_docs ids
    rows = with_features(candidates(segments(sample))).dropDuplicates(["candidate", "before"]).withColumn("label", rule().cast("double"))
    # Findings once more without their neighbours' words.
    beside = ["name_left", "equals_left", "quoted"]
    twice = rows.withColumn("__bare", F.explode(F.when(F.col("label") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    train = twice.withColumns({c: F.when(F.col("__bare") == 1, 0.0).otherwise(F.col(c)) for c in beside}).select(
        *FEATURES, "label").coalesce(4).persist()
    try:
        n = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        if len(n) < 2:
            verdict = found.withColumn("score", rule().cast("double"))
        else:
            assembler = VectorAssembler(inputCols=FEATURES, outputCol="__features")
            weight = F.when(F.col("label") == 1, n[0.0] / n[1.0]).otherwise(1.0) if n[1.0] < n[0.0] else F.lit(1.0)
            forest = RandomForestClassifier(featuresCol="__features", labelCol="label", weightCol="__w", numTrees=TREES, maxDepth=DEPTH,
                                            minInstancesPerNode=2, seed=11, probabilityCol="__p", rawPredictionCol="__raw",
                                            predictionCol="__y").fit(assembler.transform(train).withColumn("__w", weight))
            verdict = forest.transform(assembler.transform(found)).withColumn("score", vector_to_array("__p")[1])
    finally:
        train.unpersist()
    return verdict.select("doc_id", F.col("start").cast("long").alias("start"), F.length("candidate").cast("long").alias("chars"), "candidate",
                          "score", (F.col("score") >= threshold).alias("is_secret"))
