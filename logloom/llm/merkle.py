"""Merkle manifest of a dataset with proofs of membership, made as an octopus multiproof.

Every group of rows (a source) is a tree over its leaves, and the groups' roots are the leaves of one upper tree. Each run of up to
16 neighbouring nodes becomes one node, the sha256 of their joined hex digests. The levels are tables, so building
is one aggregate per level.

Proofs are made for slices of neighbouring leaves. A slice first works out which nodes it lacks: at each level at most 15 on
either side of what it has or can derive. It fetches these once, derives the nodes that its leaves share, and expands
them into the proof of each leaf.

Nulls: a null field counts as ``-`` in a leaf, null groups are one group and come first, null keys come first in their group. Rows
with equal group and key are ordered by their leaf; equal rows are leaves of their own. An empty table has no root.
"""

from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from logloom.session import cut_lineage

FANOUT_BITS = 4
FANOUT = 1 << FANOUT_BITS
DIGEST = 64  # characters
SLICE_LEAVES = 4096
GROUP_TREES, UPPER_TREE = 0, 1

PROOF = T.ArrayType(
    T.StructType([T.StructField("place", T.IntegerType()), T.StructField("siblings", T.StringType())])
)
_ARROW_PROOF = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.string())]))


def leaf_digest(fields: list[Column]) -> Column:
    """sha256 of the fields, each as its UTF-8 byte count, ``:`` and value, or ``-`` if null."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its proof."""

    def up(digest: Column, step: Column) -> Column:
        at = step["place"] * DIGEST
        before, after = F.substring(step["siblings"], F.lit(1), at), F.substring(step["siblings"], at + 1, F.lit(FANOUT * DIGEST))
        return F.sha2(F.concat(before, digest, after), 256)

    return F.aggregate(proof, leaf, up)


def proof_digest(proof: Column) -> Column:
    """sha256 of all siblings of a proof, from the leaf's run up to the root's."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: step["siblings"]), ""), 256)


@dataclass(frozen=True)
class Manifest:
    """Tables of the tree.

    ``leaves`` has the given columns with slice, seq (place in the slice's order), tree, idx, n (leaves of the tree), trees (number of trees);
    ``nodes`` has (kind, tree, level, idx, digest) of every node; ``root`` is None for an empty table.
    """

    leaves: DataFrame
    nodes: DataFrame
    root: str | None


def _ascending(column: str) -> Column:
    return F.col(column).asc_nulls_first()


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` written in ascending order, with ``_at``: the partition's number above 33 bits, the row's number in it below."""
    by = [_ascending(c) for c in order]
    return cut_lineage(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))


def _part() -> Column:
    return F.shiftright("_at", 33)


def _before(window) -> Column:
    return F.coalesce(F.sum("_n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _placed(rows: DataFrame, slice_leaves: int) -> DataFrame:
    """Leaves with slice, seq, tree, idx, n and trees.

    Ranks are the places inside a sorted partition plus what came before, counted per (partition, group): no window runs over rows.
    """
    at = _numbered(rows, ["group", "key", "leaf"])
    spans = cut_lineage(at.groupBy(_part().alias("_part"), "group").agg(F.count("*").alias("_n"), F.min("_at").alias("_first")))
    groups = _numbered(spans.groupBy("group").agg(F.sum("_n").alias("n")), ["group"])
    earlier = Window.orderBy("_part")  # one row per partition
    starts = groups.groupBy(_part().alias("_part")).agg(F.count("*").alias("_n"))
    starts = starts.select("_part", _before(earlier).alias("_start"), F.sum("_n").over(Window.partitionBy()).alias("trees"))
    groups = groups.withColumn("_part", _part()).join(starts, "_part").select(
        F.col("group").alias("_group"), "n", "trees",
        (F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias("tree"),
    )
    parts = spans.groupBy("_part").agg(F.sum("_n").alias("_n")).select("_part", _before(earlier).alias("_part_start"))
    inside = Window.partitionBy("group").orderBy("_part")  # one row per partition
    spans = spans.select("*", _before(inside).alias("_group_start")).drop("_n").join(parts, "_part")
    spans = spans.join(groups, F.col("group").eqNullSafe(F.col("_group"))).drop("group")
    spans = spans.withColumnRenamed("_part", "_span_part")
    here = (_part() == F.col("_span_part")) & F.col("group").eqNullSafe(F.col("_group"))
    rank = F.col("_part_start") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return at.join(spans, here).select(
        *rows.columns, "tree", "n", "trees",
        (F.col("_group_start") + F.col("_at") - F.col("_first")).alias("idx"),
        F.floor(rank / slice_leaves).alias("slice"), (rank % slice_leaves).cast("int").alias("seq"),
    )


def _levels(nodes: DataFrame, most: int) -> DataFrame:
    """All nodes (tree, level, idx, digest, n) over the lowest ones (tree, idx, n, digest); ``n`` nodes stand on that level of the tree."""
    columns = ["tree", "level", "idx", "digest", "n"]
    found = level = nodes.withColumn("level", F.lit(0)).select(*columns)
    height = 0
    while most > 1:
        height, most = height + 1, -(-most // FANOUT)
        runs = level.where("n > 1").groupBy("tree", F.shiftright("idx", FANOUT_BITS).alias("up"), "n")
        joined = runs.agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("run"))  # FANOUT entries at most
        digest = F.sha2(F.array_join(F.transform("run", lambda x: x["digest"]), ""), 256)
        level = cut_lineage(
            joined.select(
                "tree", F.lit(height).alias("level"), F.col("up").alias("idx"), digest.alias("digest"),
                (F.shiftright(F.col("n") - 1, FANOUT_BITS) + 1).alias("n"),
            )
        )
        found = found.unionByName(level)
    return found


def manifest(rows: DataFrame, slice_leaves: int = SLICE_LEAVES) -> Manifest:
    """The trees over ``rows`` (group, key, leaf and any columns that proofs are to carry along)."""
    leaves = cut_lineage(_placed(cut_lineage(rows), slice_leaves))
    largest = leaves.agg(F.max("n"), F.max("trees")).first()
    lower = _levels(leaves.select("tree", "idx", "n", F.col("leaf").alias("digest")), largest[0] or 0)
    tops = cut_lineage(lower.where("n = 1").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), "digest"))
    upper = _levels(tops.withColumn("n", F.lit(largest[1] or 0).cast("long")), largest[1] or 0)
    nodes = lower.withColumn("kind", F.lit(GROUP_TREES)).unionByName(upper.withColumn("kind", F.lit(UPPER_TREE)))
    top = upper.where("n = 1").select("digest").first()
    return Manifest(leaves, nodes.select("kind", "tree", "level", "idx", "digest"), top[0] if top else None)


def lacking(found: Manifest) -> DataFrame:
    """(slice, kind, tree, level, idx) of every node that a slice needs and cannot derive from its leaves and the others it needs."""
    # aliases keep these columns apart from those of the leaves that they meet again
    leaves = found.leaves.select(*[F.col(c).alias(c) for c in ("slice", "tree", "idx", "n", "trees")])
    ends = [F.min("idx").alias("lo"), F.max("idx").alias("hi")]
    lower = leaves.groupBy("slice", "tree", "n").agg(*ends).withColumn("kind", F.lit(GROUP_TREES))
    upper = leaves.select("slice", F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("trees").alias("n"))
    upper = upper.groupBy("slice", "tree", "n").agg(*ends).withColumn("kind", F.lit(UPPER_TREE))
    height = F.length(F.hex(F.col("n") - 1))  # hexadecimal digits are levels of sixteen
    step = F.lit(FANOUT_BITS) * F.col("level")
    levels = (
        lower.unionByName(upper).where("n > 1")
        .withColumn("level", F.explode(F.sequence(F.lit(0), height - 1)))
        .select(
            "slice", "kind", "tree", "level",
            F.call_function("shiftright", "lo", step.cast("int")).alias("lo"),
            F.call_function("shiftright", "hi", step.cast("int")).alias("hi"),
            F.call_function("shiftright", F.col("n") - 1, step.cast("int")).alias("last"),
        )
    )
    none = F.array().cast("array<bigint>")
    start, end = F.col("lo") - F.col("lo") % FANOUT, F.least(F.col("hi") - F.col("hi") % FANOUT + FANOUT - 1, F.col("last"))
    left = F.when(start < F.col("lo"), F.sequence(start, F.col("lo") - 1)).otherwise(none)
    right = F.when(end > F.col("hi"), F.sequence(F.col("hi") + 1, end)).otherwise(none)
    return levels.select("slice", "kind", "tree", "level", F.explode(F.concat(left, right)).alias("idx"))


class _Climb:
    """One tree's nodes as far as a slice knows them, level by level: runs of digests, and each node's proof step."""

    def __init__(self, digests: list[str], lo: int, n: int, fetched: dict[int, dict[int, str]]):
        self.lo, self.levels = lo, []
        level = 0
        while n > 1:
            others = fetched.get(level, {})
            start = lo - lo % FANOUT
            end = min(-(-(lo + len(digests)) // FANOUT) * FANOUT, n)
            known = [others[i] for i in range(start, lo)] + digests
            known += [others[i] for i in range(lo + len(digests), end)]
            runs = ["".join(known[i : i + FANOUT]) for i in range(0, len(known), FANOUT)]
            self.levels.append((start, runs, {}))
            digests, lo = [sha256(run.encode()).hexdigest() for run in runs], start // FANOUT
            n, level = -(-n // FANOUT), level + 1
        self.top = digests[0]

    def steps(self, idx: int) -> list[tuple[int, str]]:
        """(place in the run, the run's other digests) of a leaf and of the nodes above it."""
        out = []
        for start, runs, made in self.levels:
            step = made.get(idx)
            if step is None:
                run, place = runs[(idx - start) // FANOUT], idx % FANOUT
                step = made[idx] = (place, run[: place * DIGEST] + run[(place + 1) * DIGEST :])
            out.append(step)
            idx //= FANOUT
        return out


def _expand(schema: pa.Schema, carried: list[str]):
    """Derive the shared nodes of one slice and expand them into the proof of every leaf."""

    def expand(leaves: pa.Table, others: pa.Table) -> pa.Table:
        leaves = leaves.sort_by("seq")
        fetched: dict[tuple[int, int], dict[int, dict[int, str]]] = {}
        for row in zip(*(others[c].to_pylist() for c in ("kind", "tree", "level", "idx", "digest"))):
            fetched.setdefault(row[:2], {}).setdefault(row[2], {})[row[3]] = row[4]
        digests, trees = leaves["leaf"].to_pylist(), leaves["tree"].to_pylist()
        idx, sizes = leaves["idx"].to_pylist(), leaves["n"].to_pylist()
        starts = [i for i in range(len(trees)) if i == 0 or trees[i] != trees[i - 1]]
        climbs = [
            _Climb(digests[i:j], idx[i], sizes[i], fetched.get((GROUP_TREES, trees[i]), {}))
            for i, j in zip(starts, [*starts[1:], len(trees)])
        ]
        upper = _Climb(
            [c.top for c in climbs], trees[0], leaves["trees"][0].as_py(), fetched.get((UPPER_TREE, 0), {})
        )
        offsets, places, siblings, tops = [0], [], [], []
        for climb, i, j in zip(climbs, starts, [*starts[1:], len(trees)]):
            shared = upper.steps(trees[i])
            for at in idx[i:j]:
                for place, joined in (*climb.steps(at), *shared):
                    places.append(place)
                    siblings.append(joined)
                offsets.append(len(places))
            tops += [climb.top] * (j - i)
        steps = pa.StructArray.from_arrays([pa.array(places, pa.int32()), pa.array(siblings, pa.string())], ["place", "siblings"])
        proof = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), steps)
        columns = [*(leaves[c] for c in carried), pa.array(tops, pa.string()), proof]
        return pa.Table.from_arrays(columns, schema=schema)

    return expand


def proofs(found: Manifest) -> DataFrame:
    """The rows given to ``manifest`` with subroot and proof, the steps from the leaf to the root (see ``fold``)."""
    # one row per node lacking: at most 30 for each level of the two trees that a slice shares with others
    fetched = lacking(found).join(found.nodes, ["kind", "tree", "level", "idx"])
    places = ("tree", "n", "trees", "idx", "slice", "seq")
    carried = [c for c in found.leaves.columns if c not in places]
    fields = [found.leaves.schema[c] for c in carried]
    out = T.StructType([*fields, T.StructField("subroot", T.StringType()), T.StructField("proof", PROOF)])
    arrow = pa.schema([*((f.name, to_arrow_type(f.dataType)) for f in fields), ("subroot", pa.string()), ("proof", _ARROW_PROOF)])
    return (
        found.leaves.groupBy("slice").cogroup(fetched.groupBy("slice"))
        .applyInArrow(_expand(arrow, carried), out)
    )
