"""Merkle manifests of a table: postorder append logs, closed-form node positions, proofs.

Rows become leaves of one tree for each group; the groups' roots are the leaves of a last tree. Aligned builders take 2**HEIGHT
consecutive leaves each and append nodes to their log as they are completed: a leaf, then every parent that it completes. In such
a log the node of height h over leaves a..e stands behind the 2e - popcount(e) nodes that were complete before leaf e came, and the h
nodes from leaf e up to it: its position is 2e - popcount(e) + h. That addresses any sibling without an index. Roots of the builders
are leaves of the next tier, so no task holds more than one block of a tree of any size.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from cohortweave.llm.storage import Scope, cut

#: Levels of a builder's block; its log has at most 2 * 2**HEIGHT - 1 nodes of 32 bytes.
HEIGHT = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A step of a path: a byte for the sibling's side and 32 for the sibling, zeros where a node is alone.
ALONE, RIGHT, LEFT = 0, 1, 2
STEP = 33


def node_position(height: int, index: int, leaves: int) -> int:
    """The position in the log of the node number `index` at a height, in a block of so many leaves."""
    last = min((index + 1) << height, leaves) - 1
    return 2 * last - last.bit_count() + height


def levels(leaves: int) -> int:
    """Levels above the leaves until one node is left."""
    return max(0, leaves - 1).bit_length()


def parent(*children: bytes) -> bytes:
    """The SHA-256 of the children's digests as hex text, one after another."""
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def append_log(leaves: list[bytes], top: int) -> bytearray:
    """The nodes over the leaves up to height `top`, in the order in which they are completed."""
    out, open_, n = bytearray(), [None] * (top + 1), len(leaves)
    for i, node in enumerate(leaves):
        h = 0
        while True:
            out += node
            index = i >> h
            if h == top or (i + 1) & ((1 << (h + 1)) - 1) and i + 1 < n:
                break  # the parent has more leaves to come
            node = parent(open_[h], node) if index & 1 else parent(node)
            h += 1
        if h <= top:
            open_[h] = node
    return out


def sibling_steps(log: bytes, index: int, leaves: int, top: int) -> bytes:
    """The path of a leaf to height `top`, a step for each level, read from the log by position."""
    out = bytearray()
    for h in range(top):
        at, count = index >> h, (leaves + (1 << h) - 1) >> h
        if at ^ 1 < count:
            p = 32 * node_position(h, at ^ 1, leaves)
            out += bytes([LEFT if at & 1 else RIGHT]) + log[p : p + 32]
        else:
            out += bytes(STEP)
    return bytes(out)


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its path lead to."""
    for i in range(0, len(path), STEP):
        side, other = path[i], path[i + 1 : i + STEP]
        leaf = parent(leaf) if side == ALONE else parent(leaf, other) if side == RIGHT else parent(other, leaf)
    return leaf


def siblings(path: bytes) -> list[str]:
    """The digests in a path as hex text, bottom up."""
    return [path[i + 1 : i + STEP].hex() for i in range(0, len(path), STEP) if path[i] != ALONE]


def record_digest(columns: dict[str, Column]) -> Column:
    """The SHA-256 of values one after another: `-` for null, else the length in UTF-8 bytes, a colon and the value; integers are decimal."""
    text = [c.cast("string") for c in columns.values()]
    return F.unhex(F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]), 256))


class Tree(NamedTuple):
    """Trees of groups, a table for each tier: group_, block, n (leaves of the group in the tier), keys, log, and other with other_at."""

    tiers: list[DataFrame]

    def roots(self) -> DataFrame:
        """(group_, root) of every group."""
        parts = [t.where(F.col("n") <= 1 << HEIGHT).select("group_", F.expr("substring(log, -32, 32)").alias("root")) for t in self.tiers]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


class Manifest(NamedTuple):
    """docs: the groups' trees; top: the tree over their roots in order of the groups."""

    docs: Tree
    top: Tree

    def root(self) -> DataFrame:
        """One row with the root of all (none for an empty table)."""
        return self.top.roots().select("root")


def _numbered(leaves: DataFrame) -> DataFrame:
    """leaves (group_, key, digest, other) with their index in their group and its number of leaves n, in order of key, then digest.

    The group may be any size: leaves are sorted over range partitions, and each adds what its group has in earlier ones. Equal
    rows are told apart by their place in the input, so that a range ends within them too.
    """
    order = ["group_", "key", "digest", "tie"]
    dealt = leaves.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut(dealt.select("group_", "key", "digest", "other", F.monotonically_increasing_id().alias("place")), "manifest-leaves")
    rows = rows.withColumn("range", F.shiftright("place", 33))
    parts = rows.groupBy("group_", "range").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("held"))
    group = Window.partitionBy("group_")
    upto = group.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.select(F.col("group_").alias("of"), F.col("range").alias("in"), (F.sum("held").over(upto) - F.col("held") - F.col("first")).alias("shift"), F.sum("held").over(group).alias("n"))
    parts = cut(parts, "manifest-ranges")
    met = rows.join(parts, rows["group_"].eqNullSafe(parts["of"]) & (rows["range"] == parts["in"]))
    return met.select("group_", "key", "digest", "other", (F.col("place") + F.col("shift")).alias("index"), "n")


def _built(numbered: DataFrame) -> tuple[DataFrame, bool]:
    """One tier: a row for each aligned block, and if any group has more than one."""
    kind = numbered.schema["key"].dataType.simpleString()
    fields = numbered.schema["group_"].dataType.simpleString()

    def build(key, table):
        import pyarrow as pa

        table = table.sort_by("index")
        n = table.column("n")[0].as_py()
        log = append_log(table.column("digest").to_pylist(), HEIGHT if n > 1 << HEIGHT else levels(n))
        other = [(i, d) for i, d in enumerate(table.column("other").to_pylist()) if d is not None]
        keys = table.column("key").combine_chunks()
        made = [
            pa.array([key[0].as_py()], table.schema.field("group_").type), pa.array([key[1].as_py()], pa.int64()), pa.array([n], pa.int64()),
            pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([bytes(log)], pa.binary()),
            pa.array([[i for i, _ in other]], pa.list_(pa.int32())), pa.array([b"".join(d for _, d in other)], pa.binary()),
        ]
        return pa.Table.from_arrays(made, names=["group_", "block", "n", "keys", "log", "other_at", "other"])

    schema = f"group_ {fields}, block long, n long, keys array<{kind}>, log binary, other_at array<int>, other binary"
    made = numbered.withColumn("block", F.shiftright("index", HEIGHT)).groupBy("group_", "block").applyInArrow(build, schema)
    seen = Observation()
    out = cut(made.observe(seen, F.max("n").alias("most")), "manifest-log")
    return out, (seen.get.get("most") or 0) > 1 << HEIGHT


def build_tree(leaves: DataFrame) -> Tree:
    """The trees of leaves (group_, key, digest and other, a second digest or null that goes along with a leaf)."""
    tier, more = _built(_numbered(leaves))
    tiers = [tier]
    while more:
        up = tier.where(F.col("n") > 1 << HEIGHT).select("group_", F.col("block").alias("key"), F.expr("substring(log, -32, 32)").alias("digest"), F.lit(None).cast("binary").alias("other"), F.col("block").alias("index"), F.shiftright(F.col("n") + ((1 << HEIGHT) - 1), HEIGHT).alias("n"))
        tier, more = _built(up)
        tiers.append(tier)
    return Tree(tiers)


def build_manifest(docs: DataFrame, group: str = "lang", key: str = "doc_id", fields: tuple[str, ...] = FIELDS, other: Column | None = None) -> Manifest:
    """Trees of the rows of docs by group, in order of key, and the tree over their roots in order of the groups (null first, bytewise).

    Equal keys follow their digests; null keys come first. `other`: a digest to be checked in place of a row's own, null for none.
    Digests are made where the rows are read; texts are never shuffled.
    """
    leaves = docs.select(F.col(group).alias("group_"), F.col(key).alias("key"), record_digest({c: F.col(c) for c in fields}).alias("digest"), (F.lit(None).cast("binary") if other is None else other).alias("other"))
    own = build_tree(leaves)
    heads = own.roots().select(F.lit(0).alias("group_"), F.col("group_").alias("key"), F.col("root").alias("digest"), F.lit(None).cast("binary").alias("other"))
    return Manifest(own, build_tree(heads))


def _leaf_paths(segments: DataFrame, kind: str, group: str) -> DataFrame:
    """(group_, index, key, path) of every leaf of segments that have a tail, the steps behind their block's root."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                keys, n = row["keys"], len(row["keys"])
                top = HEIGHT if row["n"] > 1 << HEIGHT else levels(row["n"])
                start = row["block"] << HEIGHT
                paths = [sibling_steps(row["log"], i, n, top) + row["tail"] for i in range(n)]
                table = pa.table({"group_": pa.array([row["group_"]] * n, batch.schema.field("group_").type), "index": pa.array(range(start, start + n), pa.int64()), "key": pa.array(keys, batch.schema.field("keys").type.value_type), "path": pa.array(paths, pa.binary())})
                yield from table.to_batches()

    return segments.select("group_", "block", "n", "keys", "log", "tail").mapInArrow(run, f"group_ {group}, index long, key {kind}, path binary")


def _with_tails(tree: Tree, ends: DataFrame | None) -> DataFrame:
    """The lowest tier of a tree with the tail of each block; ends: (of, tail) by group, what follows a group's root."""
    kind = lambda t, c: t.schema[c].dataType.simpleString()
    above = None
    for tier in reversed(tree.tiers):
        top = tier.where(F.col("n") <= 1 << HEIGHT)
        top = top.withColumn("tail", F.lit(b"")) if ends is None else top.join(ends, top["group_"].eqNullSafe(ends["of"])).drop("of")
        if above is not None:
            paths = _leaf_paths(above, "long", kind(tier, "group_")).select(F.col("group_").alias("of"), F.col("index").alias("nth"), F.col("path").alias("tail"))
            paths = cut(paths, "manifest-tails")
            low = tier.where(F.col("n") > 1 << HEIGHT)
            top = top.unionByName(low.join(paths, low["group_"].eqNullSafe(paths["of"]) & (low["block"] == paths["nth"])).drop("of", "nth"))
        above = top
    return above


def proofs(manifest: Manifest, with_siblings: bool = False) -> DataFrame:
    """Per row: key, leaf, subroot, root, proof_sha256, folded_root and verified, digests as hex text; with_siblings adds them, bottom up.

    proof_sha256 is the digest of the siblings one after another, from the leaf by way of the subroot to the root. folded_root is
    what the other digest, if there is one, else the leaf, leads to with them; verified says if that is the root.
    """
    top = _with_tails(manifest.top, None)
    kind = manifest.docs.tiers[0].schema["group_"].dataType.simpleString()
    ends = cut(_leaf_paths(top, kind, "int").select(F.col("key").alias("of"), F.col("path").alias("tail")), "manifest-tails")
    key = manifest.docs.tiers[0].schema["keys"].dataType.elementType.simpleString()
    fields = ("siblings",) if with_siblings else ()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                n, log, tail = len(row["keys"]), row["log"], row["tail"]
                height = HEIGHT if row["n"] > 1 << HEIGHT else levels(row["n"])
                # a tail's first steps belong to the group's own upper tiers
                upper = sum(STEP for _ in range(levels(row["n"]) - height))
                subroot = fold(log[-32:], tail[:upper])
                root = fold(subroot, tail[upper:])
                other = {at: row["other"][32 * k : 32 * k + 32] for k, at in enumerate(row["other_at"])}
                out: dict[str, list] = {c: [] for c in ("leaf", "proof_sha256", "folded_root", "verified", *fields)}
                for j in range(n):
                    at = 32 * node_position(0, j, n)
                    leaf, path = log[at : at + 32], sibling_steps(log, j, n, height) + tail
                    sib = siblings(path)
                    folded = fold(other.get(j, leaf), path)
                    for c, v in zip(out, (leaf.hex(), hashlib.sha256("".join(sib).encode()).hexdigest(), folded.hex(), folded == root, sib)):
                        out[c].append(v)
                made = {"key": pa.array(row["keys"], batch.schema.field("keys").type.value_type), "leaf": out["leaf"], "subroot": [subroot.hex()] * n, "root": [root.hex()] * n}
                yield from pa.table(made | {c: out[c] for c in ("proof_sha256", "folded_root", "verified", *fields)}).to_batches()

    schema = f"key {key}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (", siblings array<string>" if with_siblings else "")
    held = _with_tails(manifest.docs, ends).select("n", "keys", "log", "other_at", "other", "tail")
    return held.mapInArrow(run, schema)


def tampered_digest(every: int = 7) -> Column:
    """The digest of a row with 1 added to n_chars, where `every` divides the CRC-32 of its decimal doc_id; null for other rows."""
    columns = {c: F.col(c) for c in FIELDS} | {"n_chars": F.col("n_chars") + 1}
    return F.when(F.crc32(F.col("doc_id").cast("string")) % every == 0, record_digest(columns))


def checked_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row, where a seventh of the rows is tampered with.

    Leaves are the digests of doc_id, source, lang, n_chars and text, each of which may be null; an empty text is not a null one.
    Trees go by lang, null being one of them. Rows that share a doc_id follow their leaves, and equal rows are leaves of their own; a
    null doc_id comes first and is never tampered with; nor does a null n_chars change. A lang with one row has that leaf as subroot.
    An empty table gives an empty result; texts of any length are digested whole where they are read; other columns are ignored.
    """
    with Scope() as scope:
        found = proofs(build_manifest(docs, other=tampered_digest())).withColumnRenamed("key", "doc_id")
        return scope.keep(cut(found, "manifest-proofs"))
