"""Manifest, line dedup and hard negatives: equal to their SQL on given and odd tables, and to brute force."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import lines, manifest, negatives
from lumenframe.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, place int, size int, kept string, key string"


def docs(spark, rows):
    """Rows ``(doc_id, source, text)`` with columns whose names clash."""
    return spark.createDataFrame([(i, t, None if i == 3 else "en", s, None if t is None else len(t), "clash", 1, 2, "clash", "k") for i, s, t in rows], DOCS)


def compare(spark, tmp_path, name, tables):
    con = duckdb.connect()
    for t, df in tables.items():
        path = f"{tmp_path}/{t}.parquet"
        df.write.parquet(path)
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want.fetchall()))
    return rows


# Merkle manifest


def odd_docs():
    line = "this very line stands in many documents"
    rows = [(1, "a", None), (2, "a", ""), (3, None, "null source"), (4, None, None), (None, "a", "no id"), (5, "ä", "x" * 100_000), (6, "b", "Only One"), (7, "Z", "🙂 Ünïcödé\x00 Text")]
    rows += [(i, "hot", f"Text {i}\n{line}") for i in range(100, 400)] + [(8, "a", "same"), (8, "a", "same"), (8, "a", "other"), (8, None, "same")]
    return rows + [(i, f"s{i}", f"  {line.upper()}\t\n\n{line}") for i in range(20, 45)]


def test_merkle_of_odd_rows(spark, tmp_path):
    rows = compare(spark, tmp_path, "op11_merkle", {"documents": docs(spark, odd_docs())})
    assert len(rows) == len(odd_docs()) and {r[-1] for r in rows} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 16, 17, 257])
def test_merkle_sizes(spark, tmp_path, n):
    rows = compare(spark, tmp_path, "op11_merkle", {"documents": docs(spark, [(i, "one", str(i)) for i in range(n)])})
    assert len(rows) == n and all(r[-1] for r in rows)  # digits have no letters to alter


def test_merkle_of_an_empty_table(spark):
    m = manifest.build(docs(spark, []))
    assert m.root is None and manifest.proofs(m).isEmpty()


def test_merkle_leaf_and_lone_root(spark):
    m = manifest.build(docs(spark, [(7, None, "é")]))
    assert m.root == hashlib.sha256("1:7-2:en1:12:é".encode()).hexdigest()
    row = manifest.proofs(m).first()
    assert row["leaf"] == row["subroot"] == m.root and row["steps"] == []


def test_merkle_finds_any_altered_field(spark):
    df = docs(spark, [(i, f"s{i % 3}", f"text {i}") for i in range(60)])
    for column, value in (("n_chars", F.lit(-1)), ("lang", F.lit(None))):
        m = manifest.build(df, altered={column: value}, only=F.col("doc_id") == 33)
        bad = manifest.proofs(m).where(manifest.fold(F.col("second"), F.col("steps")) != m.root)
        assert [r["key"] for r in bad.collect()] == [33]


def test_merkle_spreads_a_hot_group(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot_group(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def hot_group(spark):
    df = docs(spark, [(1, "hot", "same")]).select("doc_id", "text", "lang", "source", "n_chars").crossJoin(spark.range(5000).select()).repartition(4)
    m = manifest.build(df)
    assert m.groups == 1 and sum(r["n"] for r in m.units.select(F.size("members").alias("n")).collect()) == 5000
    parts = m.units.groupBy(F.input_file_name()).count().collect()
    assert len(parts) > 1


# line dedup


def test_lines_of_odd_rows(spark, tmp_path):
    rows = compare(spark, tmp_path, "op12_lines", {"documents": docs(spark, odd_docs())})
    by = {r[0]: r for r in rows if r[0] is not None}
    assert by[399][1:3] == (2, 0) and by[100][1:3] == (2, 1) and by[20][1:3] == (3, 2) and by[1][1:3] == (1, 0)


def test_lines_counts_documents_not_rows(spark, tmp_path):
    line = "a line of more than twenty characters"
    rows = [(1, "s", line), (1, "s", line), (1, "s", f"{line}\n{line}"), (2, "s", line), (5, "s", "twenty characters ok"), (6, "s", "twenty characters ok"), (7, "s", " Twenty characters ok\r"), (8, "s", "nineteen characters"), (9, "s", "nineteen characters"), (10, "s", "nineteen characters")]
    got = {(r[0], r[2]) for r in compare(spark, tmp_path, "op12_lines", {"documents": docs(spark, rows)})}
    assert got == {(1, 0), (2, 0), (5, 1), (6, 1), (7, 0), (8, 0), (9, 0), (10, 0)}


def test_lines_empty_and_clashing(spark):
    assert lines.clean(docs(spark, [])).isEmpty()
    df = docs(spark, [(i, "s", f"Own {i}\nSome line that everybody has") for i in range(4)]).withColumn("_kept", F.lit(1)).withColumn("_stays", F.lit(2))
    got = lines.clean(df)
    assert got.columns == df.columns and {r["doc_id"]: r["text"] for r in got.collect()} == {i: f"Own {i}" + ("\nSome line that everybody has" if i == 3 else "") for i in range(4)}
    assert {(r["kept"], r["_kept"], r["_stays"]) for r in got.collect()} == {("clash", 1, 2)}


def test_lines_over_many_shards_and_gatherings(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHARD", 64)
    monkeypatch.setattr(lines, "LINES", 50)
    rng = random.Random(3)
    pool = [f"shared line number {i} of the pool" for i in range(600)]
    rows = [(i, "s", "\n".join(rng.choices(pool, k=rng.randint(0, 30)) + [f"own line of document {i}"])) for i in range(300)]
    found = lines.index(docs(spark, rows))
    assert found.shards > 4
    holders = {}
    for i, _, t in rows:
        for x in set(t.split("\n")):
            holders.setdefault(x, set()).add(i)
    want = {i: "\n".join(x for x in t.split("\n") if len(holders[x]) < 3 or max(holders[x]) == i) for i, _, t in rows}
    assert {r["doc_id"]: r["kept2"] for r in lines.cleaned(docs(spark, rows), found, "kept2").collect()} == want
    fewer = lines.cleaned(docs(spark, rows), found, "kept2", least=10)
    want = {i: "\n".join(x for x in t.split("\n") if len(holders[x]) < 10 or max(holders[x]) == i) for i, _, t in rows}
    assert {r["doc_id"]: r["kept2"] for r in fewer.collect()} == want
    with pytest.raises(ValueError):
        lines.cleaned(docs(spark, rows), found, least=2)


def test_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        a, b = (rng.integers(-(1 << 63), (1 << 63) - 1, n) for _ in "ab")
        a[: n // 2] = 7  # pairs may share one half
        h = lines.PerfectHash.build(a, b)
        assert sorted(h.slots(a, b).tolist()) == list(range(n))
        assert len(h.bits) < 5 * n + 9
        other = h.slots(b, a)
        assert ((other >= -1) & (other < max(n, 1))).all()


# hard negatives


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, l, "clash", 1, 0) for i, v, l in rows], "vec_id long, embedding array<float>, label int, key string, tie int, low int")


def test_negatives_of_odd_rows(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(i % 3, 1) for _ in range(8)], rng.randint(0, 9)) for i in range(900)]
    rows += [(i, [1.0] * 8, 1) for i in range(1000, 1130)]  # ties
    rows += [(2000, None, 1), (2001, [1.0] * 7 + [None], 1), (2100, [float("nan")] + [1.0] * 7, 1), (2101, [float("inf")] * 8, 1), (2200, [1.0] * 8, None), (2300, [0.0] * 8, 2), (2400, [-1.0] * 8, 3)]
    got = compare(spark, tmp_path, "op13_negatives", {"embeddings": vectors(spark, rows)})
    assert {r[0] for r in got} >= {0, 100, 1000, 1100} and not {r[0] for r in got} & {2000, 2100, 2200}


def test_negatives_empty_repeated_and_ragged(spark):
    run = lambda rows, **k: [tuple(r) for r in negatives.mine(negatives.usable(vectors(spark, rows)), F.col("key") == 0, **k).collect()]
    assert run([]) == []
    few = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0], 1), (2, [0.5], 2), (2, [0.5, 0.0, 9.0], 2), (3, [1.0], 2), (4, [], 2)]
    # equal rows once; two rows of id 2 are two; shorter vectors end in zeros; 100 % lies above the window
    assert sorted(run(few)) == [(0, 1, 1, 2, 65536, 32768), (0, 1, 2, 2, 65536, 32768)]
    assert run([(0, [1.0], 1), (5, [0.5], 2)]) == []  # no positive
    assert run([(0, [1e30, 1.0], 1), (1, [1e30], 1), (2, [2.5e5], 2)])[0][4] == (1 << 54)  # saturated


def test_dual_trees_prune_and_stay_exact(monkeypatch):
    rng = np.random.default_rng(2)
    centers = rng.integers(-200, 200, (20, 16))
    points = (centers[rng.integers(0, 20, 6000)] + rng.integers(-9, 9, (6000, 16))).astype(float)
    asked = points[:300] + rng.integers(-3, 3, (300, 16))
    keys, none = np.arange(6000), np.zeros(6000, np.int64)
    lists = negatives.Lists(np.full((300, 1), -(1 << 63)), np.full((300, 1), 10**6), 7)
    scored = negatives.dual_search(negatives.Tree.of(asked, 32), negatives.Tree.of(points), lists, np.full(300, -1), np.zeros(300, np.int64), keys, none)
    scores = (asked @ points.T).astype(int)
    for g in range(300):
        want = sorted(((-s, k) for k, s in enumerate(scores[g].tolist()) if s <= 10**6))[:7]
        assert [(-s, k) for s, k in zip(lists.found[g, 0][0].tolist(), lists.found[g, 0][1].tolist(), strict=True)] == want
    assert scored < 0.5 * scores.size  # clusters: most node pairs go unscored


def test_interval_holds_every_product():
    rng = np.random.default_rng(4)
    a, b = (negatives.Tree.of(rng.normal(0, 50, (500, 5)).round(), 16) for _ in "ab")
    for i in range(0, len(a.lo), 3):
        for j in range(0, len(b.lo), 3):
            low, high = negatives.interval(a, i, b, j)
            s = a.points[a.rows[a.lo[i] : a.hi[i]]] @ b.points[b.rows[b.lo[j] : b.hi[j]]].T
            assert low <= s.min() and s.max() <= high
