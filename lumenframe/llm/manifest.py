"""Merkle manifest of a table with proofs by coordinate lookup.

A row is a leaf: the digest of its fields. The leaves of a group, by key, are hashed in runs of
``FAN`` until one node remains, the group's subroot; the subroots, by group, likewise give the root.
The node table has one row a run: ``(tree, level, run)`` and the digests of its nodes. A proof needs
the other nodes of its run on every level. These coordinates follow from a leaf's position and its
group's size alone: leaves explode them, join the node table, order what they find by level,
concatenate it (the proof's digest) or fold a leaf through it (the recomputed root).

Plan: texts are read once, in the scan that makes leaves; all that moves is digests. Positions come
from a range partitioning by (group, key) whose partitions are counted, so a group of any size
spreads over tasks. The leaves of one run need the same coordinates, so a run explodes them once for
all its leaves. Runs near a root are wanted by nearly all leaves: ``spread_join`` deals such keys over
tasks, by the exact number of runs below each node. The driver gets counts and the root, no more.

Defined cases: null fields count as ``-``; the null group comes first; a null key sorts first; rows
that repeat a key follow their leaf digests, equal rows are leaves of their own; a group of one leaf
has that leaf as its subroot; an empty table has no root (None) and no proofs. Columns that aren't
named are ignored, so their names can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import require, spread_join, table, written

FAN_BITS = 4
FAN = 1 << FAN_BITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree of subroots; trees of groups are numbered from 0.
TOP = -1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of the fields one after another, each as UTF-8 byte count, ``:`` and value, or ``-`` if null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds ``name``, each row's position (from 0) by ``order``, without one task for all rows.

    A range partition numbers its own rows, written so that a retry can't move them; counts of the
    partitions give each its start, and there are as many of these as partitions.
    """
    local = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    local = local.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    sizes = local.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    start = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", start.alias("_start"))
    return local.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_start", "_at")


def _runs(nodes: DataFrame) -> DataFrame:
    """``(tree, run, nodes, size, weight)`` from nodes ``(tree, at, digest, size, weight)``: at most ``FAN`` a group."""
    grouped = nodes.groupBy("tree", F.shiftright("at", FAN_BITS).alias("run")).agg(
        F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("nodes"), F.first("size").alias("size"), F.sum("weight").alias("weight")
    )
    return grouped.withColumn("nodes", F.col("nodes.digest"))


def _climb(runs: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The node table over ``runs`` of level 0, and the node that remains of every tree. ``most`` is the largest size."""
    table_, tops, level = None, None, 0
    while True:
        runs = written(runs.select("tree", F.lit(level).alias("level"), "run", "nodes", "size", "weight"), "runs")
        digest = F.when(F.col("size") == 1, F.col("nodes")[0]).otherwise(F.sha2(F.array_join("nodes", ""), 256))
        above = runs.select("tree", F.col("run").alias("at"), digest.alias("digest"), "size", "weight")
        level_rows, done = runs.where("size > 1"), above.where(F.col("size") <= FAN).select("tree", "digest", "weight")
        table_ = level_rows if table_ is None else table_.unionByName(level_rows)
        tops = done if tops is None else tops.unionByName(done)
        if most <= FAN:
            return table_, tops
        more = above.where(F.col("size") > FAN).withColumn("size", F.shiftright(F.col("size") + (FAN - 1), FAN_BITS))
        runs, most, level = _runs(more), -(-most // FAN), level + 1


@dataclass
class Manifest:
    """``units``: runs of leaves; ``nodes``: the node table; ``root``: None for an empty table."""

    units: DataFrame
    nodes: DataFrame
    root: str | None
    groups: int


def build(df: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS, altered: dict[str, Column] | None = None, only: Column | None = None) -> Manifest:
    """The manifest of ``df``. ``altered`` gives fields other values in a second digest of each leaf, ``only`` where it holds:
    the copy that a proof is checked against. Without it the second digest is the leaf."""
    require(df, key, group, *fields)
    leaf = leaf_digest(*[F.col(f) for f in fields])
    other = leaf if not altered else leaf_digest(*[altered.get(f, F.col(f)) for f in fields])
    second = F.when(only if only is not None else F.lit(True), other) if altered else F.lit(None).cast("string")
    rows = df.select(F.col(key).alias("key"), F.col(group).alias("group"), leaf.alias("leaf"), second.alias("second"))
    # the row number tells equal rows apart, so that a million of them are dealt over ranges too
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
    order = [F.col("group").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("leaf"), F.col("row")]
    rows = numbered(rows, order, "place").withColumn("name", F.coalesce(F.concat(F.lit("="), F.col("group").cast("string")), F.lit("")))
    groups = rows.groupBy("name").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("size"))
    groups = written(numbered(groups, [F.col("first")], "tree"), "groups")
    found = groups.agg(F.count(F.lit(1)), F.max("size")).first()
    count, most = found[0], found[1] or 0
    placed = spread_join(rows, groups.select("name", "tree", "first", "size"), ["name"], "place", groups.select("name", F.col("size").alias("n")))
    at = F.col("place") - F.col("first")
    placed = placed.select("tree", at.alias("at"), "size", "key", "leaf", "second")
    units = placed.groupBy("tree", F.shiftright("at", FAN_BITS).alias("run")).agg(
        F.array_sort(F.collect_list(F.struct("at", "leaf", "second", "key"))).alias("members"), F.first("size").alias("size")
    )
    units = written(units, "units")
    own, subroots = _climb(units.select("tree", "run", F.col("members.leaf").alias("nodes"), "size", F.lit(1).cast("long").alias("weight")), most)
    nodes = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("at"), "digest", F.lit(count).cast("long").alias("size"), "weight")
    top, root = _climb(_runs(nodes), count)
    last = root.select("digest").first()
    return Manifest(units, own.unionByName(top), last[0] if last else None, count)


def proofs(m: Manifest) -> DataFrame:
    """``(key, leaf, second, subroot, steps)`` of every leaf. A step has the digests of a run and the leaf's or its node's position there, from the leaf up."""
    long_ = lambda k: k.cast("long")
    levels = F.sequence(F.lit(0), F.lit(15))
    # on level k of a tree of n leaves there are ceil(n / FAN^k) nodes
    above = lambda n, k: F.call_function("shiftright", n + F.call_function("shiftleft", F.lit(1).cast("long"), k * FAN_BITS) - 1, k * FAN_BITS)
    right = lambda x, k: F.call_function("shiftright", x, k * FAN_BITS)

    def wanted(tree: Column, at: Column, size: Column, first: int) -> Column:
        many = F.filter(levels, lambda k: above(size, k) > 1)
        return F.transform(
            many, lambda k: F.struct((k + first).alias("step"), tree.alias("tree"), k.alias("level"), right(at, k + 1).alias("run"), right(at, k).bitwiseAND(FAN - 1).cast("int").alias("at"))
        )

    # a unit's own position stands for its first leaf: on level 0 each leaf has its own
    own = wanted(F.col("tree"), F.call_function("shiftleft", F.col("run"), F.lit(FAN_BITS)), F.col("size"), 0)
    top = wanted(F.lit(TOP).cast("long"), F.col("tree"), F.lit(m.groups).cast("long"), 16)
    asked = m.units.select(F.col("tree").alias("_tree"), F.col("run").alias("_run"), F.explode(F.concat(own, top)).alias("c"))
    asked = asked.select("_tree", "_run", F.xxhash64("_tree", "_run").alias("_deal"), "c.step", "c.at", long_(F.col("c.tree")).alias("tree"), "c.level", "c.run")
    nodes = m.nodes.select("tree", "level", "run", "nodes")
    found = spread_join(asked, nodes, ["tree", "level", "run"], "_deal", m.nodes.select("tree", "level", "run", F.col("weight").alias("n")))
    steps = found.groupBy("_tree", "_run").agg(F.array_sort(F.collect_list(F.struct("step", "at", "nodes"))).alias("steps"))
    units = m.units.select(F.col("tree").alias("_tree"), F.col("run").alias("_run"), "members")
    both = units.join(steps, ["_tree", "_run"], "left")
    none = F.array().cast("array<struct<step: int, at: int, nodes: array<string>>>")
    each = both.select(F.coalesce("steps", none).alias("steps"), F.explode("members").alias("m"))
    place = F.col("m.at").bitwiseAND(FAN - 1).cast("int")
    each = each.withColumn("steps", F.transform("steps", lambda s: F.struct(s["step"].alias("step"), F.when(s["step"] == 0, place).otherwise(s["at"]).alias("at"), s["nodes"].alias("nodes"))))
    first = F.get(F.filter("steps", lambda s: s["step"] == 16), F.lit(0))
    subroot = F.when(first.isNotNull(), F.get(first["nodes"], first["at"])).otherwise(F.lit(m.root))
    return each.select("m.key", "m.leaf", F.coalesce("m.second", "m.leaf").alias("second"), subroot.alias("subroot"), "steps")


def siblings(steps: Column) -> Column:
    """The proof as one text: all other nodes of each run, left to right, from the leaf up."""
    return F.array_join(F.transform(steps, lambda s: F.array_join(F.filter(s["nodes"], lambda _, i: i != s["at"]), "")), "")


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf gives with the nodes beside it."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.array_join(F.transform(s["nodes"], lambda x, i: F.when(i == s["at"], h).otherwise(x)), ""), 256))


def op11_merkle(spark, sf_dir) -> DataFrame:
    """Every document's leaf, proof and root; in one id of five the text is altered before the proof is checked."""
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    m = build(table(spark, sf_dir, "documents"), altered={"text": F.translate("text", UPPER, LOWER)}, only=altered)
    rows = proofs(m).select(
        F.col("key").alias("doc_id"), "leaf", "subroot", F.lit(m.root).cast("string").alias("root"), F.sha2(siblings(F.col("steps")), 256).alias("proof_sha256"),
        fold(F.col("second"), F.col("steps")).alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _leaf_sql(text: str) -> str:
    one = lambda v: f"coalesce(strlen({v}) || ':' || {v}, '-')"
    return "sha256(" + " || ".join(one(f"CAST({f} AS VARCHAR)") for f in (*FIELDS[:-1], text)) + ")"


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_leaf_sql("text")} AS leaf, CASE WHEN {_CRC} % 5 = 0 THEN {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} END AS second FROM documents),
a AS (SELECT *, row_number() OVER () AS id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
nodes(t, l, i, h, n) AS (
  SELECT t, 0, i, leaf, count(*) OVER (PARTITION BY t) FROM a
  UNION ALL SELECT t, l + 1, i // {FAN}, sha256(string_agg(h, '' ORDER BY i)), (max(n) + {FAN - 1}) // {FAN} FROM nodes WHERE n > 1 GROUP BY t, l, i // {FAN}),
tops(l, i, h, n) AS (
  SELECT 0, t, h, count(*) OVER () FROM nodes WHERE n = 1
  UNION ALL SELECT l + 1, i // {FAN}, sha256(string_agg(h, '' ORDER BY i)), (max(n) + {FAN - 1}) // {FAN} FROM tops WHERE n > 1 GROUP BY l, i // {FAN}),
tree AS (SELECT t, l, i, h, n FROM nodes UNION ALL SELECT -1, l, i, h, n FROM tops),
path(id, t, l, i, h, p) AS (
  SELECT id, t, 0, i, coalesce(second, leaf), '' FROM a
  UNION ALL SELECT p.id, p.t, p.l + 1, p.i // {FAN}, sha256(string_agg(CASE WHEN n.i = p.i THEN p.h ELSE n.h END, '' ORDER BY n.i)), p.p || coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (n.i <> p.i), '')
  FROM path p JOIN nodes n ON n.t = p.t AND n.l = p.l AND n.i // {FAN} = p.i // {FAN} WHERE n.n > 1 GROUP BY p.id, p.t, p.l, p.i, p.h, p.p),
up AS (SELECT id, t, arg_max(h, l) AS h, arg_max(p, l) AS p FROM path GROUP BY id, t),
climb(id, l, i, h, p) AS (
  SELECT id, 0, t, h, p FROM up
  UNION ALL SELECT p.id, p.l + 1, p.i // {FAN}, sha256(string_agg(CASE WHEN n.i = p.i THEN p.h ELSE n.h END, '' ORDER BY n.i)), p.p || coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (n.i <> p.i), '')
  FROM climb p JOIN tops n ON n.l = p.l AND n.i // {FAN} = p.i // {FAN} WHERE n.n > 1 GROUP BY p.id, p.l, p.i, p.h, p.p),
folded AS (SELECT id, arg_max(h, l) AS h, arg_max(p, l) AS p FROM climb GROUP BY id)
SELECT a.doc_id, a.leaf, s.h AS subroot, r.h AS root, sha256(f.p) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM a JOIN folded f USING (id) JOIN (SELECT t, h FROM nodes WHERE n = 1) s USING (t), (SELECT h FROM tops WHERE n = 1) r
"""
