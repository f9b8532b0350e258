"""op12: Merkle manifest against plain Python and DuckDB SQL."""

import hashlib
import zlib

import duckdb
import pyarrow as pa
import pytest
from tidewater.llm import merkle
from tidewater.llm.merkle import FAN, build, depth, manifest, position
from tidewater.llm.q_merkle import rows_sql

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def digest(row, text) -> str:
    doc_id, _, lang, source, n_chars = row
    return h("".join(field(v) for v in (doc_id, source, lang, n_chars, text)))


def up(level: list[str]) -> list[list[str]]:
    out = [level]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][k:k + FAN])) for k in range(0, len(out[-1]), FAN)])
    return out


def siblings(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    out = []
    for row in levels[:-1]:
        a = i - i % FAN
        out.append(("".join(row[a:i]), "".join(row[i + 1:a + FAN])))
        i //= FAN
    return out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees, got = {}, []
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r, r[1])))
        trees[lang] = up([digest(r, r[1]) for r in groups[lang]])
    top = up([trees[x][-1][0] for x in langs])
    for k, lang in enumerate(langs):
        for i, r in enumerate(groups[lang]):
            path = siblings(trees[lang], i) + siblings(top, k)
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            d = digest(r, text)
            for a, b in path:
                d = h(a + d + b)
            got.append((r[0], digest(r, r[1]), trees[lang][-1][0], top[-1][0], h("".join(a + b for a, b in path)), d, d == top[-1][0]))
    return got


def rows():
    out = [(i, f"Text {i} ÄB" * (i % 3), ["en", "de", "zz"][i % 3] if i % 7 else None, "src" if i % 2 else None, i if i % 5 else None) for i in range(300)]
    return out + [(3, "Text 3", "en", "s", 1), (3, "Text 3", "en", "s", 1), (None, None, "alone", None, None), (None, "A", "en", "", 0), (11, "", "", "s", 0),
                  (12, "LONG " * 50_000, "en", "s", 250_000)]


@pytest.mark.parametrize("levels", [1, 4])
def test_equals_brute_force(spark, monkeypatch, levels):
    """Also with builders of eight leaves, where several tiers are needed."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "SPAN", FAN ** levels)
    docs = spark.createDataFrame(rows(), SCHEMA).selectExpr("*", "1 AS g", "'x' AS id", "0 AS digest", "2 AS block", "3 AS root")
    if levels == 1:
        # Workers hold the module's own constants: the builders run here.
        got = local_manifest(rows())
    else:
        got = [tuple(r) for r in manifest(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows())))


def local_manifest(data):
    """The operator's own tasks, group by group, with the module's current span."""
    groups = {}
    for r in data:
        groups.setdefault("-" if r[2] is None else "=" + r[2], []).append(r)

    def tiers(leaves):
        out = []
        while True:
            n, logs = len(leaves), []
            for b in range(0, n, merkle.SPAN):
                part = leaves[b:b + merkle.SPAN]
                logs.append(build(pa.table({
                    "g": pa.array(["g"] * len(part)), "block": pa.array([b // merkle.SPAN] * len(part), pa.int64()),
                    "i": pa.array(range(b, b + len(part)), pa.int64()), "n": pa.array([n] * len(part), pa.int64()),
                    "digest": pa.array([x[0] for x in part]), "id": pa.array([x[1] for x in part], pa.int64()),
                    "other": pa.array([x[2] for x in part], pa.string())})))
            out.append(logs)
            leaves = [(t.column("digest")[i].as_py(), None, None) for t in logs for i in range(t.num_rows) if t.column("top")[i].as_py()]
            if n <= merkle.SPAN:
                return out

    def down(logs, path):
        paths = {0: path}
        for tier in reversed(logs):
            below = {}
            for k, log in enumerate(tier):
                for row in merkle.lower_paths(log, paths[k]).to_pylist():
                    below[row["block"]] = pa.Table.from_pylist([row], merkle._PATH)
            paths = below
        return paths

    made, leaves = {}, {}
    for g, held in groups.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r, r[1])))
        cells = []
        for r in held:
            low = None if r[1] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
            tampered = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and low != r[1]
            cells.append((digest(r, r[1]), r[0], digest(r, low) if tampered else None))
        made[g], leaves[g] = tiers(cells), cells
    order = sorted(made)
    subroot = {g: made[g][-1][0].column("digest")[-1].as_py() for g in order}
    upper = tiers([(subroot[g], None, g) for g in order])
    root = upper[-1][0].column("digest")[-1].as_py()
    start = pa.Table.from_pylist([{"g": "g", "block": 0, "lefts": [], "rights": [], "subroot": None, "root": root}], merkle._PATH)
    got = []
    for k, p in sorted(down(upper, start).items()):
        g = p.column("other")[0].as_py()
        p = p.set_column(p.schema.get_field_index("subroot"), "subroot", p.column("digest"))
        for b, log in enumerate(made[g][0]):
            above = p if len(made[g]) == 1 else down(made[g][1:], p)[b]
            got += [tuple(r.values()) for r in merkle.proofs_of(log, above).to_pylist()]
    return got


def test_positions_are_the_completion_order():
    for n in [*range(1, 75), 511, 512, 513, 600]:
        log = build(pa.table({"g": ["x"] * n, "block": [0] * n, "i": list(range(n)), "n": [n] * n, "digest": [str(i) for i in range(n)],
                              "id": list(range(n)), "other": pa.array([None] * n, pa.string())})).column("digest").to_pylist()
        for level, row in enumerate(up([str(i) for i in range(n)])):
            assert [log[position(level, j, n, depth(n))] for j in range(len(row))] == row


def test_sql_agrees_with_brute_force():
    con = duckdb.connect()
    con.register("docs", pa.Table.from_pylist([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows()],
                                              pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()),
                                                         ("n_chars", pa.int64())])))
    con.sql("CREATE VIEW v AS " + rows_sql("docs"))
    got = con.sql("SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM v").fetchall()
    assert sorted(map(str, got)) == sorted(map(str, brute(rows())))


def test_empty_and_one_row(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    assert manifest(docs.where("false")).collect() == []
    one = manifest(docs.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root and one[0].proof_sha256 == h("")
