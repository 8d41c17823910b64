"""Mixing sources to target weights by balanced sampling with the cube method.

A source takes each document floor(f) times, f being its target over its size, and once more with
inclusion probability f - floor(f). The flight phase moves those probabilities along the null-space of two
constraints, tokens and documents, so both totals stay what they were until a few documents of a block are undecided.
Blocks of a source fly apart from one another, three documents at a time; the undecided of many blocks, and a few more,
meet in the next round. A source's last block flies its largest documents first, each against all that are undecided,
until a dozen small ones are left; they land where the token total is least off.

Only a narrow table flies: rows that are equal in what identifies them are counted, and what a count takes is shared
among them. Texts are joined to their copies once.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortweave.functions.ranks import counted_values
from cohortweave.llm.storage import Scope, cut, join_salted

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3.0
BLOCK = 1500
#: Documents that a source's last block keeps for the landing; other blocks pass half as many on.
HELD = 12
#: Equal rows that are dealt out of their count at once.
DEALT = 10_000
_TINY = 1e-9


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> dict[str | None, float]:
    """Words each source should give: sources by code point, null last, with repeating weights share the whole.

    A target stops at `most` times its source; what it leaves is shared by weight among the others, until none is above.
    source_targets does the same for any number of sources.
    """
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out: dict[str | None, float] = {}
    open_, left = list(names), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        out |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ = [s for s in open_ if s not in set(full)]
    return out


def flight(p: list[float], size: list[int], rng: np.random.Generator) -> list[float]:
    """Move p to 0 or 1 in place, keeping sum(p) and sum(p * size); at most two stay between."""
    coins = iter(rng.random(3 * len(p) + 3).tolist())
    active: list[int] = []

    def step(u: tuple[float, ...]) -> None:
        up = down = math.inf
        for i, x in zip(active, u):
            if x:
                a, b = ((1 - p[i]) / x, p[i] / x) if x > 0 else (p[i] / -x, (1 - p[i]) / -x)
                up, down = min(up, a), min(down, b)
        move = up if next(coins) < down / (up + down) else -down
        for i, x in zip(active, u):
            p[i] += move * x
            if p[i] < _TINY:
                p[i] = 0.0
            elif p[i] > 1 - _TINY:
                p[i] = 1.0
        active[:] = [i for i in active if 0 < p[i] < 1]

    for i in range(len(p)):
        if not 0 < p[i] < 1:
            continue
        active.append(i)
        if len(active) == 3:
            a, b, c = (size[j] for j in active)
            u = (b - c, c - a, a - b)
            step(u if any(u) else (1, -1, 0))
    if len(active) == 2 and size[active[0]] == size[active[1]]:
        step((1, -1))
    return p


def fly_largest(p: list[float], size: list[int], rng: np.random.Generator, left: int) -> list[float]:
    """Decide documents from the largest on until `left` are undecided, keeping sum(p) and sum(p * size).

    A step moves one document and, by the projection onto the null-space of the constraints, all undecided ones a little
    against it, so that a huge document is settled while there are many to level it.
    """
    x, s = np.array(p, np.float64), np.array(size, np.float64)
    s /= max(1.0, s.max(initial=0.0))
    live = np.flatnonzero((x > 0) & (x < 1))
    live = live[np.argsort(-s[live], kind="stable")]
    while len(live) > left:
        a = np.stack([np.ones(len(live)), s[live]])
        inverse = np.linalg.pinv(a @ a.T, rcond=1e-12)
        for first in range(len(live)):
            u = -a.T @ (inverse @ a[:, first])
            u[first] += 1
            if u[first] > 1e-9:
                break
        else:
            break
        u[np.abs(u) < 1e-12] = 0.0
        q = x[live]
        room = lambda v: np.min(np.where(v > 0, (1 - q) / np.maximum(v, 1e-300), np.where(v < 0, q / np.maximum(-v, 1e-300), np.inf)))
        up, down = room(u), room(-u)
        q = q + (up if rng.random() < down / (up + down) else -down) * u
        q[q < _TINY] = 0.0
        q[q > 1 - _TINY] = 1.0
        x[live] = q
        live = live[(q > 0) & (q < 1)]
    return x.tolist()


def land(p: list[float], size: list[int]) -> list[float]:
    """Decide the last few so that the token total is least off, then the document total; fewer taken on a tie."""
    at = [i for i, x in enumerate(p) if 0 < x < 1]
    if at:
        x = np.arange(1 << len(at))[:, None] >> np.arange(len(at)) & 1
        q, s = np.array([p[i] for i in at]), np.array([size[i] for i in at], np.float64)
        tokens, documents = np.abs(x @ s - q @ s), np.abs(x.sum(axis=1) - q.sum())
        best = np.lexsort((x.sum(axis=1), np.round(documents, 6), np.round(tokens, 3)))[0]
        for i, v in zip(at, x[best].tolist()):
            p[i] = float(v)
    return p


def fly(p: list[float], size: list[int], rng: np.random.Generator, held: int) -> list[float]:
    """Flight with a few documents of spread-out sizes held back for the next round."""
    at = [i for i, x in enumerate(p) if 0 < x < 1]
    back = {at[int(k)] for k in np.linspace(0, len(at) - 1, held)} if len(at) > held + 2 else set(at)
    rest = [i for i in at if i not in back]
    for i, x in zip(rest, flight([p[i] for i in rest], [size[i] for i in rest], rng)):
        p[i] = x
    return p


def _flown(rows, seed: int):
    """One block, an Arrow table, with p after its flight."""
    import pyarrow as pa

    first = {c: rows[c][0].as_py() for c in ("__source", "__block", "__level", "__blocks")}
    p, size, order = (rows[c].to_numpy() for c in ("p", "size", "__order"))
    at = np.lexsort((order, -size))
    rng = np.random.default_rng(zlib.crc32(f"{first['__source']}/{first['__block']}/{first['__level']}/{seed}".encode()))
    q, sizes = p[at].tolist(), size[at].tolist()
    out = np.empty(len(p))
    out[at] = land(fly_largest(q, sizes, rng, HELD), sizes) if first["__blocks"] == 1 else fly(q, sizes, rng, HELD // 2)
    return rows.set_column(rows.schema.get_field_index("p"), "p", pa.array(out))


def _flights(seed: int):
    """Over partitions sorted by source and block: a block flies when the next one begins."""

    def run(batches):
        import pyarrow as pa

        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            source, block = rows["__source"].to_pylist(), rows["__block"].to_pylist()
            starts = [i for i in range(len(block)) if i == 0 or block[i] != block[i - 1] or source[i] != source[i - 1]]
            for a, b in zip(starts, starts[1:]):
                yield from _flown(rows.slice(a, b - a), seed).to_batches()
            held = rows.slice(starts[-1]) if starts else None
        if held is not None:
            yield from _flown(held, seed).to_batches()

    return run


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Per source of (source, size, n): source_size, docs and target. Sources are ranked and summed in Spark; the driver sees one row a round.

    All share one level, words per weight; a source is full where its share would exceed `most` times its size. The level
    only rises as full sources leave words to the others, so it settles when no more become full.
    """
    sums = cut(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"), F.sum("n").cast("long").alias("docs")), "mix-sources")
    known = counted_values(sums, ["source"]).select("source", F.col("n_before").alias("at")).unionByName(
        sums.where("source is null").select("source", F.lit(sums.where("source is not null").count()).cast("long").alias("at")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    ranked = cut(sums.join(known, sums["source"].eqNullSafe(known["source"])).select(sums["source"], "source_size", "docs", weight.alias("weight")), "mix-weights")
    left, total, full = *ranked.agg(F.sum("source_size"), F.sum("weight")).first(), 0
    if not left:
        return ranked.select("source", "source_size", "docs", F.lit(0.0).alias("target"))
    words, share = left, lambda: F.lit(float(left)) * F.col("weight") / F.lit(total)
    while True:
        is_full = share() > most * F.col("source_size")
        n, held, weighs = ranked.agg(F.count_if(is_full), F.sum(F.when(is_full, most * F.col("source_size"))), F.sum(F.when(~is_full, F.col("weight")))).first()
        if n == full or not weighs:
            break
        full, left, total = n, words - (held or 0), weighs
    return ranked.select("source", "source_size", "docs", F.when(is_full, most * F.col("source_size")).otherwise(share()).alias("target"))


def _copies(counted: DataFrame, key: list[str], weights: tuple[int, ...], most: float, seed: int) -> DataFrame:
    """A row for each document of counted (key, source, size, n: so many alike): key, source, size, source_size, target, copies.

    Blocks fly as Arrow tables, so the key may be anything.
    """
    with Scope() as scope:
        plan = cut(source_targets(counted, weights, most), "mix-plan")
        largest = plan.agg(F.max("docs")).first()[0]
        name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
        f = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
        whole = F.least(F.lit(int(most)), F.floor(f + _TINY)).cast("int")
        part = F.when(f - whole > _TINY, F.least(F.lit(1.0), F.greatest(F.lit(0.0), f - whole))).otherwise(F.lit(0.0))
        plan = plan.select(name.alias("__source"), "source_size", "target", whole.alias("whole"), part.alias("p"), F.greatest(F.lit(1), F.ceil(F.col("docs") / BLOCK)).cast("long").alias("__blocks"))
        chunk = counted.withColumn("__at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(DEALT).cast("long"))))
        # the copies of one row are made in many tasks, if they are many
        chunk = chunk.where(F.col("n") <= DEALT).unionByName(chunk.where(F.col("n") > DEALT).repartition(*key, "__at"))
        each = chunk.withColumn("__at", F.explode(F.sequence(F.col("__at"), F.least(F.col("__at") + (DEALT - 1), F.col("n") - 1))))
        rows = each.select(*key, "source", name.alias("__source"), "size", F.xxhash64(*key, "size", "__at", F.lit(seed)).alias("__order"))
        rows = join_salted(rows, plan, ["__source"], "__order", "inner")
        done, level, most_blocks = None, 0, max(1, math.ceil((largest or 0) / BLOCK))
        while True:
            some = rows.withColumn("__block", F.pmod(F.xxhash64("__order", F.lit(level)), F.col("__blocks"))).withColumn("__level", F.lit(level))
            dealt = some.repartition("__source", "__block").sortWithinPartitions("__source", "__block")
            flown = scope.keep(cut(dealt.mapInArrow(_flights(seed), some.schema), f"mix-{level}"))
            settled = flown.where("p = 0 or p = 1")
            done = settled if done is None else done.unionByName(settled)
            if most_blocks == 1:
                break
            again = lambda b: max(1, math.ceil((HELD // 2 + 2) * b / BLOCK))
            most_blocks, level = again(most_blocks), level + 1
            fewer = F.when(F.col("__blocks") > 1, F.greatest(F.lit(1), F.ceil((HELD // 2 + 2) * F.col("__blocks") / BLOCK))).otherwise(F.lit(1)).cast("long")
            rows = flown.where("p > 0 and p < 1").withColumn("__blocks", fewer).drop("__block", "__level")
    return done.select(*key, "source", "size", "source_size", "target", (F.col("whole") + F.col("p").cast("int")).alias("copies"))


def _sizes(docs: DataFrame, *columns: Column) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(*columns, F.col("source").cast("string").alias("source"), size.alias("size"))


def cube_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, seed: int = 8) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, copies, taken.

    The size is the number of words of the whole text, 0 for a null one. A null source is a source of its own, the last. A null
    doc_id is a document like others, repeated rows are documents of their own, and an empty table gives an empty
    result. Ties in size are ordered by a hash, and draws depend on seed, source, doc_id and size only, so reruns agree. A
    text may have any length, and a source any share of the rows. Other columns are ignored.
    """
    with Scope() as scope:
        sized = _sizes(docs, F.col("doc_id").cast("long").alias("doc_id"))
        counted = cut(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-counted")
        out = scope.keep(cut(_copies(counted, ["doc_id"], weights, most, seed), "mix-copies"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, seed: int = 8) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with its own columns, whatever their names.

    Rows are told apart by two hashes of all their columns, which fly without the texts; rows that are equal in every
    column share what their count takes. Texts are shuffled once, to be joined to their copies. Nulls in any column,
    empty texts and an empty table are as in cube_mix.
    """
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    a, b = F.xxhash64(*columns).alias("__a"), F.xxhash64(F.lit(seed), *columns).alias("__b")
    with Scope() as scope:
        counted = cut(_sizes(docs, a, b).groupBy("__a", "__b", "source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-counted")
        flown = _copies(counted, ["__a", "__b"], weights, most, seed).groupBy("__a", "__b").agg(F.sum("copies").cast("int").alias("copies"), F.count(F.lit(1)).alias("alike"))
        copies = scope.keep(cut(flown, "mix-copies"))
        alike = scope.keep(cut(copies.where("alike > 1").select("__a", "__b", F.col("copies").alias("of_all")), "mix-alike"))
    # a row travels as one struct, so that its columns may have any names
    rows, own = docs.select(F.struct(*columns).alias("row"), a, b), copies.where("alike = 1 and copies > 0").select("__a", "__b", "copies")
    out = lambda df: df.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
    if alike.isEmpty():
        return out(rows.join(own, ["__a", "__b"]))
    # equal rows meet before the shuffle, however many they are
    marked = join_salted(rows.withColumn("place", F.monotonically_increasing_id()), alike, ["__a", "__b"], "place").drop("place")
    one = marked.where("of_all > 0").groupBy("__a", "__b").agg(F.first("of_all").alias("copies"), F.first("row").alias("row"))
    return out(marked.where("of_all is null").drop("of_all").join(own, ["__a", "__b"])).unionByName(out(one))
