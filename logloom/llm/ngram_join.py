"""Jaccard join of documents on word shingles, by grouped prefixes.

Shingles are ordered by how many documents hold them, rare ones first. Two similar sets must share a shingle of their
prefixes, so only prefixes are joined. Documents with the same prefix and set size form one group, and groups are
paired first, with size and position filters; the members of a group pair are then verified on their whole sets.

A list of groups that share a prefix shingle can be long (thousands of near copies of one document). It is not
expanded into all pairs: every group is first verified against one pivot of the list, and later rounds leave out what is
already linked. The last round takes every pair of a list that is not known to be connected, so no link between
components is lost.
"""

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from logloom.llm import hash_arrays, worker_memory, words
from logloom.llm.components import components
from logloom.session import cut_lineage, shared_folder

WORDS = 5
SIMILARITY = (80, 100)
#: document counts are kept for keys of so many bits: an upper bound is enough to order shingles
COUNT_BITS = 44
#: shingles of fewer documents are alike in the order
FREQUENT = 4
COUNTED_AT_ONCE = 4_000_000
#: further pivot rounds as long as the last round would take more than so many pairs per list entry
PAIRS_PER_ENTRY = 4
PIVOT_ROUNDS = 4
#: lists of so many groups are paired without pivots
SHORT_LIST = 24


@dataclass(frozen=True)
class Rule:
    """Two sets link when ``over * intersection >= share * union``."""

    share: int
    over: int

    def prefix(self, n: int) -> int:
        return n - -(-self.share * n // self.over) + 1

    def least_overlap(self, n: Column, m: Column) -> Column:
        return F.ceil((n + m) * self.share / float(self.over + self.share) - 1e-9)

    def log_sizes(self) -> tuple[int, int]:
        """How far the logarithms of two sets' sizes may lie apart, in millionths."""
        reach = math.ceil(math.log(self.over / self.share) * 1_000_000) + 1
        return -reach, reach

    def holds(self, common: int, n: int, m: int) -> bool:
        return self.over * common >= self.share * (n + m - common)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of every text's k-word shingles; a shorter text is one shingle, an empty one none."""
    for _, hashes, first in words.hashed(column, words.NOT_BLANK):
        for a, b in zip(first[:-1], first[1:]):
            if a == b:
                yield np.empty(0, np.uint64)
            else:
                yield np.unique(words.gram_hashes(hashes[a:b], min(k, b - a)))


def _key(shingles: np.ndarray) -> int:
    """64-bit key of a set; empty sets have key 0 and link with nothing."""
    if not len(shingles):
        return 0
    both = np.array([shingles.sum(dtype=np.uint64), np.bitwise_xor.reduce(shingles), len(shingles)], np.uint64)
    return int(words.mix(both[:1] + words.mix(both[1:2]) * np.uint64(3) + both[2:])[0].view(np.int64)) or 1


def _frequent(docs: DataFrame, k: int, folder: str, bits: int) -> hash_arrays.HashSetFiles:
    """Shingle keys that at least ``FREQUENT`` documents hold, with log2 of their number."""
    shift = np.uint64(64 - COUNT_BITS)
    bucket_shift = np.uint64(64 - bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(waiting) >> shift << shift, return_counts=True)
            return hash_arrays.count_blocks(keys >> shift, counts, (keys >> bucket_shift).astype(np.int64))

        for batch in batches:
            for shingles in shingle_sets(batch.column(0), k):
                waiting.append(shingles)
                n += len(shingles)
                if n >= COUNTED_AT_ONCE:
                    yield flush()
                    waiting, n = [], 0
        if n:
            yield flush()

    def merge(bucket: int, blocks: list[bytes]) -> dict[str, list]:
        pairs = [hash_arrays.read_counts(b) for b in blocks]
        keys, counts = hash_arrays.sum_by_key(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]))
        kept = counts >= FREQUENT
        level = np.log2(counts[kept]).astype(np.uint8)
        return {
            "bucket": pa.array([bucket], pa.int32()),
            "keys": [hash_arrays.write_array(folder, "frequent", keys[kept] << shift)],
            "levels": [hash_arrays.write_array(folder, "levels", level)],
        }

    blocks = docs.select("text").mapInArrow(count, hash_arrays.BLOCK_SCHEMA)
    rows = hash_arrays.merge_buckets(blocks, merge, "bucket int, keys string, levels string").collect()  # one row per bucket
    return hash_arrays.HashSetFiles(folder, bits, {r.bucket: (r.keys, r.levels) for r in rows}, ("<u8", "u1"))


def _prefixes(docs: DataFrame, k: int, rule: Rule, frequent: hash_arrays.HashSetFiles) -> DataFrame:
    """doc_id, key (of the text), n_shingles, node (key of the set), prefix_group and, once per group and task, the prefix."""
    shift = np.uint64(64 - COUNT_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory.only()
        given: set[int] = set()
        for batch in batches:
            at = 0
            for part in _bounded(shingle_sets(batch.column(1), k)):
                sizes = np.array([len(s) for s in part], np.int64)
                flat = np.concatenate(part)
                order = np.argsort(flat)
                level = np.zeros(len(flat), np.uint8)
                for piece, arrays, where, there in frequent.find(flat[order] >> shift << shift):
                    level[order[piece]] = np.where(there, arrays[1][where], 0)
                nodes, groups, prefixes = [], [], []
                ends = np.cumsum(sizes)
                for shingles, end in zip(part, ends):
                    nodes.append(_key(shingles))
                    ordered = shingles[np.argsort(level[end - len(shingles) : end], kind="stable")]
                    prefix = ordered[: rule.prefix(len(shingles))] if len(shingles) else ordered
                    group = _key(np.append(prefix, np.uint64(len(shingles)))) if len(shingles) else 0
                    groups.append(group)
                    prefixes.append(prefix.view(np.int64) if group and group not in given else None)
                    if len(given) > 200_000:
                        given.clear()
                    given.add(group)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(part)), batch.column(2).slice(at, len(part)), pa.array(sizes), pa.array(nodes, pa.int64()),
                        pa.array(groups, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "key", "n_shingles", "node", "prefix_group", "prefix"],
                )
                at += len(part)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", hash_arrays.text_key().alias("key")).mapInArrow(
        run, f"doc_id {kind}, key bigint, n_shingles bigint, node bigint, prefix_group bigint, prefix array<bigint>"
    )


def _bounded(sets: Iterator[np.ndarray], limit: int = 1_000_000) -> Iterator[list[np.ndarray]]:
    part, n = [], 0
    for s in sets:
        part.append(s)
        n += len(s)
        if n >= limit:
            yield part
            part, n = [], 0
    if part:
        yield part


def _whole_sets(docs: DataFrame, k: int, needed: hash_arrays.HashSetFiles) -> hash_arrays.HashSetFiles:
    """Files of the sets that take part in any pair: nodes, ends of their sets, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory.only()
        given: set[int] = set()
        for batch in batches:
            for part in _bounded(shingle_sets(batch.column(0), k)):
                nodes = np.array([_key(s) for s in part], np.int64).view(np.uint64)
                found = []
                for i in np.flatnonzero(needed.contains(nodes)):
                    if int(nodes[i]) not in given:
                        found.append(i)
                        given.add(int(nodes[i]))
                if len(given) > 200_000:
                    given.clear()
                bucket = (nodes[found] >> np.uint64(64 - needed.bits)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket), pa.array([nodes[i].tobytes() + part[i].tobytes() for i in found], pa.binary())],
                    names=["bucket", "block"],
                )

    def write(bucket: int, blocks: list[bytes]) -> dict[str, list]:
        sets = {int.from_bytes(b[:8], "little"): b[8:] for b in blocks}
        nodes = sorted(sets)
        ends = np.cumsum([len(sets[x]) // 8 for x in nodes], dtype=np.int64)
        shingles = np.frombuffer(b"".join(sets[x] for x in nodes), np.uint64)
        arrays = {"nodes": np.array(nodes, np.uint64), "ends": ends, "sets": shingles}
        return {"bucket": pa.array([bucket], pa.int32()), "files": [[hash_arrays.write_array(needed.folder, n, x) for n, x in arrays.items()]]}

    blocks = docs.select("text").mapInArrow(run, hash_arrays.BLOCK_SCHEMA)
    rows = hash_arrays.merge_buckets(blocks, write, "bucket int, files array<string>").collect()  # one row per bucket
    return hash_arrays.HashSetFiles(needed.folder, needed.bits, {r.bucket: tuple(r.files) for r in rows}, ("<u8", "<i8", "<u8"))


def _verify(pairs: DataFrame, sets: hash_arrays.HashSetFiles, rule: Rule) -> DataFrame:
    """The pairs (a, b) of nodes that link; their sets are read from the mapped files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory.only()
        for batch in batches:
            a, b = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            nodes = np.unique(np.concatenate([a, b]))
            where: dict[int, tuple[np.ndarray, int, int]] = {}
            for piece, (_, ends, shingles), at, there in sets.find(nodes):
                assert there.all()
                for node, i in zip(nodes[piece].tolist(), at.tolist()):
                    where[node] = (shingles, int(ends[i - 1]) if i else 0, int(ends[i]))
            kept = []
            for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
                (s, lo, hi), (t, low, high) = where[x], where[y]
                union = len(np.unique(np.concatenate([s[lo:hi], t[low:high]])))
                n, m = hi - lo, high - low
                if rule.holds(n + m - union, n, m):
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    return pairs.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def _fits(rule: Rule, left: str, right: str) -> Column:
    """Size and position filter of two list entries that share a shingle."""
    n, m = F.col(f"{left}.n"), F.col(f"{right}.n")
    at_most = 1 + F.least(n - F.col(f"{left}.place"), m - F.col(f"{right}.place"))
    return at_most >= rule.least_overlap(n, m)


def _node_pairs(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _apart() -> Column:
    """Whether two list entries have members that are not known to be connected."""
    uniform = (F.col("p.low") == F.col("p.high")) & (F.col("q.low") == F.col("q.high"))
    return ~(uniform & (F.col("p.low") == F.col("q.low")))


def _short_pairs(short: DataFrame, rule: Rule) -> DataFrame:
    met = short.alias("p").join(short.alias("q"), "token").where((F.col("p.g") < F.col("q.g")) & _fits(rule, "p", "q"))
    return met.select(*_node_pairs(F.col("p.lead"), F.col("q.lead")))


def _pivot_pairs(lists: DataFrame, inside: DataFrame, rule: Rule) -> DataFrame:
    """Each group of a list with the list's pivot, and each member of an unconnected group with one of its own.

    The pivot is a group outside the list's largest component that has the shingle at the smallest place: the document that its
    near copies were made from has few shingles of its own before it.
    """
    by_token = Window.partitionBy("token")
    outside = F.col("main").isNull() | (F.col("low") != F.col("high")) | (F.col("low") != F.col("main"))
    main = _main_component(lists).select("token", F.when(F.col("c") > 1, F.col("main")).alias("main"))
    pivot = (
        lists.join(main, "token").withColumn("_order", F.when(outside, F.struct("place", "g")))
        .withColumn("_least", F.min("_order").over(by_token)).where("_order = _least")
    )
    met = pivot.alias("p").join(lists.alias("q"), "token").where(
        (F.col("p.g") != F.col("q.g")) & _apart() & _fits(rule, "p", "q")
    )
    first = Window.partitionBy("g").orderBy(F.xxhash64("node", "root"), "node")
    own = inside.withColumn("other", F.first("node").over(first)).withColumn("other_root", F.first("root").over(first))
    return met.select(*_node_pairs(F.col("p.lead"), F.col("q.lead"))).union(
        own.where("node <> other AND root <> other_root").select(*_node_pairs(F.col("node"), F.col("other")))
    )


def _main_component(lists: DataFrame) -> DataFrame:
    """Per token the component of most uniform groups, its number of groups and that of all."""
    uniform = F.col("low") == F.col("high")
    sizes = lists.groupBy("token", "low").agg(F.count(F.when(uniform, 1)).alias("c"), F.count("*").alias("n"))
    return sizes.groupBy("token").agg(F.max(F.struct("c", "low")).alias("main"), F.sum("n").alias("n")).select(
        "token", F.col("main.low").alias("main"), F.col("main.c").alias("c"), "n"
    )


def _work(lists: DataFrame, inside: DataFrame) -> tuple[int, int]:
    """(pairs that the last round would look at, entries)"""
    main = _main_component(lists).agg(F.sum((F.col("n") - F.col("c")) * F.col("n")), F.sum("n")).first()
    own = inside.groupBy("g").agg(F.count("*").alias("c")).agg(F.sum(F.col("c") * F.col("c")), F.sum("c")).first()
    return (main[0] or 0) + (own[0] or 0), (main[1] or 0) + (own[1] or 0)


def _all_pairs(lists: DataFrame, inside: DataFrame, state: DataFrame, rule: Rule) -> DataFrame:
    """Every pair of members that share a list or a group and are not known to be connected."""
    others = lists.join(_main_component(lists).select("token", "main"), "token").where("low <> high OR low <> main")
    met = others.alias("p").join(lists.alias("q"), "token").where(
        (F.col("p.g") != F.col("q.g")) & _apart() & _fits(rule, "p", "q")
    )
    groups = met.select(F.col("p.g").alias("g"), F.col("q.g").alias("h")).distinct()
    second = state.select(F.col("g").alias("h"), F.col("node").alias("node2"), F.col("root").alias("root2"))
    across = groups.join(state, "g").join(second, "h").where("root <> root2")
    own = inside.alias("one").join(inside.alias("two"), "g").where("one.node < two.node AND one.root <> two.root")
    return across.select(*_node_pairs(F.col("node"), F.col("node2"))).union(
        own.select(F.col("one.node").alias("a"), F.col("two.node").alias("b"))
    )


def near_duplicates(
    docs: DataFrame, k: int = WORDS, similarity: tuple[int, int] = SIMILARITY
) -> DataFrame:
    """(doc_id, key, n_shingles, node, component) for every row of ``docs`` (doc_id, text).

    Words are runs of bytes other than ASCII white space, A-Z in lower case; a set holds the distinct shingles of
    ``k`` words, or the whole sequence if it is shorter. Two sets link when their Jaccard similarity reaches
    ``similarity`` (numerator, denominator). ``component`` is the same number for all rows that links connect; rows of
    equal sets share ``node`` and ``component``; ``key`` is the ``text_key`` of the row. A null text is an empty one: its ``node`` and ``component`` are null and
    it links with nothing. Null and repeated doc_ids are rows like any other; further columns are left out.
    Sets are compared by 64-bit hashes of their shingles.
    """
    spark = docs.sparkSession
    rule = Rule(*similarity)
    folder = f"{shared_folder(spark)}/shingles-{uuid.uuid4().hex}"
    bits = hash_arrays.bucket_bits(hash_arrays.text_size(docs))
    rows = cut_lineage(_prefixes(docs, k, rule, _frequent(docs, k, folder, bits)))

    entries = rows.where("prefix IS NOT NULL").select(
        F.posexplode("prefix").alias("place", "token"), F.col("prefix_group").alias("g"), F.col("n_shingles").alias("n")
    )
    # an entry stays if its list has another group of a fitting size
    by_token = Window.partitionBy("token")
    by_size = by_token.orderBy("log_n").rangeBetween(*rule.log_sizes())
    lists = cut_lineage(
        entries.select("token", "g", "n", "place", (F.log("n") * 1_000_000).cast("bigint").alias("log_n"))
        .withColumn("_low", F.min("g").over(by_size)).withColumn("_high", F.max("g").over(by_size))
        .where("_low <> _high")
        .select("token", "g", F.col("n").cast("int").alias("n"), (F.col("place") + 1).alias("place"))
        .distinct().withColumn("c", F.count("*").over(by_token).cast("int"))
    )
    listed = lists.select("g").distinct()
    member = rows.where("prefix_group <> 0").select(F.col("prefix_group").alias("g"), "node")
    groups = member.groupBy("g").agg(F.min("node").alias("lead"), F.max("node").alias("last"))
    alone = groups.where("lead = last").join(listed, "g", "left_anti").select("g")
    members = cut_lineage(
        member.distinct().join(alone, "g", "left_anti")
        .withColumn("lead", F.min("node").over(Window.partitionBy("g")))
        .withColumn("several", F.max("node").over(Window.partitionBy("g")) != F.col("lead"))
    )
    needed = hash_arrays.hash_set(members.select(F.col("node").alias("key")), folder, bits)
    sets = _whole_sets(docs, k, needed)

    # short lists of groups with one member are paired at once, the others step by step
    leads = members.where("node = lead").select("g", "lead", "several")
    lists = lists.join(leads, "g").withColumn("open", F.max("several").over(by_token) | (F.col("c") > SHORT_LIST))
    lists = cut_lineage(lists.select("token", "g", "n", "place", "lead", "open"))
    short = lists.where("NOT open")
    links = _short_pairs(short, rule)
    open_lists = lists.where("open").drop("open")
    open_members = members.where("several").unionByName(
        members.where("NOT several").join(open_lists.select("g").distinct(), "g", "left_semi")
    )
    state = cut_lineage(open_members.select("g", "node", "lead", F.col("node").alias("root")))
    for turn in range(PIVOT_ROUNDS + 1):
        # one row per group: whether all its members are connected
        group = state.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        current = cut_lineage(
            open_lists.join(group, "g")
            .withColumn("_low", F.min("low").over(by_token)).withColumn("_high", F.max("high").over(by_token))
            .where("_low <> _high").drop("_low", "_high")
        )
        inside = state.join(group.where("low <> high").select("g"), "g", "left_semi")
        final = turn == PIVOT_ROUNDS
        if turn:
            work, size = _work(current, inside)
            if not work:
                break
            # pivots that find nothing more leave the rest to the last round
            final = final or work <= PAIRS_PER_ENTRY * size or (turn > 1 and found.isEmpty())
        pairs = _all_pairs(current, inside, state, rule) if final else _pivot_pairs(current, inside, rule)
        if not turn:
            pairs = pairs.union(links)
        found = cut_lineage(_verify(pairs.distinct(), sets, rule))
        links = found if not turn else links.union(found)
        roots = components(links)
        if final:
            break
        state = cut_lineage(
            open_members.select("g", "node", "lead").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        )
    return (
        rows.join(roots.withColumnRenamed("root", "_root"), "node", "left")
        .select(
            "doc_id", "key", "n_shingles", F.nullif("node", F.lit(0)).alias("node"),
            F.nullif(F.coalesce("_root", "node"), F.lit(0)).alias("component"),
        )
    )


def component_ids(joined: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest doc_id of each row's component; a row without words has its own."""
    least = joined.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("_least"))
    return joined.join(least, "component", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("_least")).alias("component_id"),
    )


def one_of_each(
    docs: DataFrame, k: int = WORDS, similarity: tuple[int, int] = SIMILARITY
) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row with the smallest doc_id stays.

    A null doc_id comes last, then the text's key decides. Of rows that repeat both doc_id and text one stays. Rows without words
    all stay. All columns are returned as they are.
    """
    row = F.xxhash64("doc_id", "key")
    joined = cut_lineage(near_duplicates(docs, k, similarity).select("doc_id", "key", "component").where("component IS NOT NULL"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    winners = joined.groupBy("component").agg(F.min(place).alias("w")).select(F.col("w.doc_id").alias("doc_id"), F.col("w.key").alias("key"))
    lost = joined.select(row.alias("key")).join(winners.select(row.alias("key")), "key", "left_anti")
    folder = f"{shared_folder(docs.sparkSession)}/copies-{uuid.uuid4().hex}"
    bits = hash_arrays.bucket_bits(hash_arrays.text_size(docs))
    key = F.xxhash64("doc_id", hash_arrays.text_key())
    kept = hash_arrays.without(docs, key, hash_arrays.hash_set(lost, folder, bits))
    repeated = cut_lineage(joined.groupBy(row.alias("key")).agg(F.count("*").alias("n")).where("n > 1").select("key").join(winners.select(row.alias("key")), "key", "left_semi"))
    if repeated.isEmpty():
        return kept
    files = hash_arrays.hash_set(repeated, folder, bits)
    single = hash_arrays.without(kept, key, files)
    rest = kept.select(F.struct("*").alias("row"), key.alias("key")).join(repeated, "key", "left_semi")
    return single.union(rest.dropDuplicates(["key"]).select("row.*"))
