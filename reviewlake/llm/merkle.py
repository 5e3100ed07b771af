"""Merkle manifest of a dataset: 16-ary trees per group and a recursive query that climbs from each leaf to the root.

Leaves are numbered within their group without a window over a whole group: the leaf table is
range-partitioned by (group, order), a window numbers the rows of one partition of one group, and
the counts of (partition, group) give what comes before.

Levels are built one after the other, each from the nodes of the one below, and written as rows
that hold a node's own key, its parent's key and its siblings' digests to the left and right.  The
groups' top nodes (subroots) are the lowest level of one more tree.

A recursive query climbs these links.  The up to ``ARITY`` leaves of a run have all nodes above
them in common, so one row climbs for a run: it carries the fold of each leaf, and the siblings,
which are the same for all, are appended once; digests travel as bytes.  Nodes with more than ``MEETING`` runs below them
are linked in as many copies, and each run uses the copy of its number, so that no key of the join
gathers the runs of a large group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .tables import written

ARITY = 16
#: runs that share one copy of a node's link row
MEETING = 256
#: the number of the tree over the subroots
TOP = -1
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def field(value: Column) -> Column:
    """A value as it enters a leaf: ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lower-case hex sha256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(*values: Column) -> Column:
    return digest(*[field(v) for v in values])


def numbered(df: DataFrame, group: str, order: Sequence[str], name: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``n``, each row's number in its group from 0, and the groups with their row counts ``cnt``.

    Rows ascend by ``order``, nulls first, strings by their UTF-8 bytes; rows alike in all of it are
    numbered in any order.  Both are written tables.
    """
    keys = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    cut = written(df.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), f"{name}-cut")
    counts = written(cut.groupBy("part", group).agg(F.count(F.lit(1)).alias("in_part")), f"{name}-counts")
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.withColumn("before", F.coalesce(F.sum("in_part").over(before), F.lit(0))).select(
        F.col("part").alias("o_part"), F.col(group).alias("o_group"), "before")
    own = Window.partitionBy("part", group).orderBy(*keys[1:])
    rows = cut.withColumn("within", F.row_number().over(own) - 1).join(
        offset, (F.col("part") == F.col("o_part")) & F.col(group).eqNullSafe(F.col("o_group")))
    out = rows.select(*df.columns, (F.col("before") + F.col("within")).cast("long").alias("n"))
    return out, counts.groupBy(group).agg(F.sum("in_part").alias("cnt"))


def _joined(parts: Column) -> Column:
    return F.array_join(parts, "")


def _text(bytes_: Column) -> Column:
    return F.lower(F.hex(bytes_))


def _parents(nodes: DataFrame) -> DataFrame:
    """The parents of ``nodes`` (tree, level, idx, hash, weight, cnt and the links' own key), with their ``children`` by number."""
    child = F.struct("idx", "hash", "weight", "o_tree", "o_level", "o_idx")
    return (nodes.where("cnt > 1").groupBy("tree", "level", F.floor(F.col("idx") / ARITY).alias("p_idx"))
            .agg(F.array_sort(F.collect_list(child)).alias("children"), F.first("cnt").alias("c"), F.sum("weight").alias("w"))
            .select("tree", (F.col("level") + 1).alias("level"), F.col("p_idx").alias("idx"), "children",
                    digest(_joined(F.transform("children", lambda x: x["hash"]))).alias("hash"), F.col("w").alias("weight"),
                    F.ceil(F.col("c") / ARITY).alias("cnt")))


def _copies(weight: str) -> Column:
    return F.ceil(F.col(weight) / MEETING).cast("int")


def _links(parents: DataFrame) -> DataFrame:
    """One row for each child and copy: its key, its parent's key and copies, and the siblings' digests."""
    p = parents.select("tree", "level", "idx", _copies("weight").alias("p_copies"), F.col("hash").alias("p_hash"), "children",
                       F.posexplode("children").alias("at", "child"))
    hashes = F.transform("children", lambda x: x["hash"])
    p = p.select(F.col("child.o_tree").alias("tree"), F.col("child.o_level").alias("level"), F.col("child.o_idx").alias("idx"),
                 F.col("tree").alias("p_tree"), F.col("level").alias("p_level"), F.col("idx").alias("p_idx"), "p_copies", "p_hash",
                 F.unhex(_joined(F.slice(hashes, F.lit(1), F.col("at")))).alias("before"),
                 F.unhex(_joined(F.slice(hashes, F.col("at") + 2, F.lit(ARITY)))).alias("after"),
                 F.ceil(F.col("child.weight") / MEETING).cast("int").alias("copies"))
    return p.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")


NODE = ["tree", "level", "idx", "hash", "weight", "cnt", "o_tree", "o_level", "o_idx"]


def _levels(nodes: DataFrame, name: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """(links of all levels, nodes that are the only one of their level), from the lowest level of each tree up."""
    links, tops = [], []
    while True:
        tops.append(nodes.where("cnt = 1"))
        if nodes.where("cnt > 1").isEmpty():
            return links, tops
        parents = written(_parents(nodes), name)
        links.append(_links(parents))
        nodes = parents.select("tree", "level", "idx", "hash", "weight", "cnt", F.col("tree").alias("o_tree"),
                               F.col("level").alias("o_level"), F.col("idx").alias("o_idx"))


CLIMB = """
WITH RECURSIVE climb (r_tree, r_idx, tree, level, idx, copies, hash, subroot, folds, proof) AS (
  SELECT tree, idx, tree, level, idx, copies, hash, CAST(NULL AS STRING), folds, X'' FROM {start}
  UNION ALL
  SELECT c.r_tree, c.r_idx, k.p_tree, k.p_level, k.p_idx, k.p_copies, k.p_hash,
         CASE WHEN c.tree >= 0 AND k.p_tree < 0 THEN c.hash ELSE c.subroot END,
         transform(c.folds, f -> unhex(sha2(lower(hex(concat(k.before, f, k.after))), 256))),
         concat(c.proof, k.before, k.after)
  FROM climb AS c JOIN {links} AS k
    ON c.tree = k.tree AND c.level = k.level AND c.idx = k.idx AND pmod(xxhash64(c.r_tree, c.r_idx), c.copies) = k.copy)
SELECT r_tree, r_idx, hash AS root, coalesce(subroot, hash) AS subroot, folds, proof FROM climb WHERE tree = {top} AND level = {height}"""


def _climbed(spark: SparkSession, start: DataFrame, links: DataFrame, top: int, height: int) -> DataFrame:
    """The runs' rows at the root, written; the recursion's row limit is lifted for this one write."""
    limit = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        return written(spark.sql(CLIMB, start=start, links=links, top=top, height=height), "climbed")
    finally:
        spark.conf.set(ROW_LIMIT, limit)


def manifest(rows: DataFrame, leaf: Column, claimed: Column, key: str, group: str) -> DataFrame:
    """One row per row of ``rows``: ``key``, leaf, subroot, root, proof, folded_root, verified.

    ``leaf`` is a row's digest and ``claimed`` the one that is held against the manifest (both
    Columns over ``rows``, never null).  Leaves ascend by ``key`` (nulls first) within ``group``;
    while several nodes remain, every ``ARITY`` consecutive ones become the digest of their
    digests.  The groups' last nodes, ordered by group (null first, UTF-8 bytes), give the root in
    the same way.  ``proof`` holds the digests of the siblings, level by level up to the root, left
    to right; ``folded_root`` is the root that ``claimed`` leads to with them, and ``verified``
    tells whether it is ``root``.

    A null group is a group, a null key a key.  Rows of one key in one group are ordered by
    their digests, so that repeated rows give the same tree in every run.  A lone leaf is its
    group's subroot, and a lone group's subroot is the root.  An empty table gives an empty table.
    """
    spark = rows.sparkSession
    key_type = rows.schema[key].dataType
    leaves = written(rows.select(F.col(key).alias("key"), F.col(group).cast("string").alias("grp"), leaf.alias("leaf"), claimed.alias("claimed")), "leaves")
    placed, sizes = numbered(leaves, "grp", ["key", "leaf", "claimed"], "leaves")
    trees, _ = numbered(sizes.withColumn("all", F.lit(0)), "all", ["grp"], "groups")
    trees = written(trees.select(F.col("grp").alias("t_grp"), F.col("n").alias("tree"), "cnt"), "trees")
    member = F.struct("n", "key", "leaf", "claimed")
    grouped = placed.groupBy("grp", F.floor(F.col("n") / ARITY).alias("idx")).agg(F.array_sort(F.collect_list(member)).alias("members"))
    hashes = F.transform("members", lambda m: m["leaf"])
    runs = grouped.join(trees, F.col("grp").eqNullSafe(F.col("t_grp"))).select(
        "tree", F.lit(1).alias("level"), "idx", "members", F.ceil(F.col("cnt") / ARITY).alias("cnt"), F.lit(1).cast("long").alias("weight"),
        F.when(F.col("cnt") > 1, digest(_joined(hashes))).otherwise(F.element_at(hashes, 1)).alias("hash"))
    runs = written(runs, "runs")
    if runs.isEmpty():
        none = [F.lit(None).cast("string").alias(c) for c in ("leaf", "subroot", "root", "proof", "folded_root")]
        return spark.range(0).select(F.lit(None).cast(key_type).alias(key), *none, F.lit(None).cast("boolean").alias("verified"))
    lowest = runs.select("tree", "level", "idx", "hash", "weight", "cnt", F.col("tree").alias("o_tree"), F.col("level").alias("o_level"), F.col("idx").alias("o_idx"))
    links, tops = _levels(lowest, "level")
    subroots = tops[0]
    for t in tops[1:]:
        subroots = subroots.unionByName(t)
    n_trees = trees.count()
    over = written(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("idx"), "hash", "weight",
                                   F.lit(n_trees).cast("long").alias("cnt"), "o_tree", "o_level", "o_idx"), "subroots")
    more, _ = _levels(over, "top")
    links += more
    top, height = (TOP, len(more)) if n_trees > 1 else (0, len(tops))
    own = lambda m, i, side: F.when(F.size(hashes) > 1, _joined(side(i))).otherwise("")
    left, right = lambda i: F.slice(hashes, F.lit(1), i), lambda i: F.slice(hashes, i + 2, F.lit(ARITY))
    lone = (F.col("cnt") == 1) & (F.size("members") == 1)
    folds = F.transform("members", lambda m, i: F.when(lone, m["claimed"]).otherwise(
        digest(own(m, i, left), m["claimed"], own(m, i, right))))
    start = runs.select("tree", "level", "idx", _copies("weight").alias("copies"), "hash", F.transform(folds, F.unhex).alias("folds"))
    every = None
    for part in links:
        every = part if every is None else every.unionByName(part)
    if every is None:       # a single run: nothing to climb
        climbed = start.select(F.col("tree").alias("r_tree"), F.col("idx").alias("r_idx"), F.col("hash").alias("root"), F.col("hash").alias("subroot"), "folds", F.lit(b"").alias("proof"))
    else:
        climbed = _climbed(spark, start, written(every, "links"), top, height)
    back = climbed.join(runs.select(F.col("tree").alias("r_tree"), F.col("idx").alias("r_idx"), "members"), ["r_tree", "r_idx"])
    siblings = F.transform("members", lambda m, i: F.concat(own(m, i, left), own(m, i, right)))
    out = back.select("root", "subroot", "folds", "proof", siblings.alias("siblings"), F.posexplode("members").alias("at", "m"))
    folded = _text(F.get("folds", F.col("at")))
    return out.select(F.col("m.key").alias(key), F.col("m.leaf").alias("leaf"), "subroot", "root",
                      F.concat(F.get("siblings", F.col("at")), _text(F.col("proof"))).alias("proof"), folded.alias("folded_root"),
                      (folded == F.col("root")).alias("verified"))
