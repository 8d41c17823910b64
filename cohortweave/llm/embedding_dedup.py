"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are cut in two halves, each with a codebook of its own; the product of the codebooks is a grid of
cells. A vector is stored in the cell of its two nearest centroids. As a query it visits cells in order of the sum of
its two half distances (multi-sequence traversal) for as long as that sum exceeds the one of its own cell by no more than a
reach. The reach is set so that the target share of pairs meets: of pairs just at the threshold in random directions, and of the
table's own links of a few hundred vectors, which are found by comparing those with all rows. What meets is verified
by cosine in double precision. Every vector is stored and every vector asks. Labels of like size share a pair of codebooks, as
fine as the largest of them needs, so one label with most of the vectors has cells as small as any other.

Ids and cells are worked out once, as a narrow table; vectors travel to the cells where they meet, as the floats they came as.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cohortweave.llm.storage import Scope, cut, join_salted
from cohortweave.operators.components import connected_components


#: Distances that are held at once, of some vectors to all centroids of a codebook.
CELLS = 4 << 20


@dataclass(frozen=True)
class IndexConfig:
    cosine: float = 0.93
    #: Share of pairs at the threshold that must meet; pairs closer than that meet more often.
    recall: float = 0.98
    #: Codebooks are fitted on about so many vectors, or on 20 for each centroid where that is more, taken by a hash of vec_id.
    sample: int = 6000
    #: Vectors per cell that the size of the codebooks aims at.
    per_cell: int = 40
    #: Centroids of a codebook, at most; its square times per_cell vectors of a label is where cells begin to grow. Labels of like size share codebooks.
    most_centroids: int = 8192
    #: Vectors whose links in the whole table are looked up to set the reach.
    measured: int = 200
    #: A cell's vectors and its queries are dealt in blocks of so many.
    block: int = 1500
    queries: int = 6000
    seed: int = 10


def unit(vector) -> np.ndarray | None:
    """The vector over its norm in double precision; None when null, empty, zero or not all finite."""
    if vector is None or len(vector) == 0:
        return None
    if any(x is None for x in vector) if isinstance(vector, list) else False:
        return None
    x = np.asarray(vector, np.float64)
    if not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    return None if top == 0 else (x / top) / np.linalg.norm(x / top)


def _units(wide: bool):
    """Usable rows with their components as they came, and a digest of the unit vector that tells equal directions."""

    def run(batches):
        import pyarrow as pa

        kind = "<f8" if wide else "<f4"
        for batch in batches:
            ids, labels, vectors = (batch.column(i).to_pylist() for i in range(3))
            rows = [(i, k, len(v), np.asarray(v, kind).tobytes(), hashlib.blake2b(u.tobytes(), digest_size=16).digest()) for i, k, v in zip(ids, labels, vectors) if i is not None and k is not None and (u := unit(v)) is not None]
            cols = list(zip(*rows)) if rows else [[], [], [], [], []]
            types = (pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["vec_id", "label", "dim", "x", "key"])

    return run


def unit_rows(raw, dim: int) -> np.ndarray:
    """Unit vectors in double precision from the bytes of many vectors of one length."""
    raw = list(raw)
    kind = "<f4" if raw and len(raw[0]) == 4 * dim else "<f8"
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), dim).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 15) -> np.ndarray:
    """Centroids of x; distances are taken for some rows at a time, never for all rows against all centroids at once."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    step = max(1, CELLS // len(c))
    for _ in range(rounds):
        half = (c**2).sum(axis=1)
        own = np.concatenate([(half - 2 * x[at : at + step] @ c.T).argmin(axis=1) for at in range(0, len(x), step)])
        order = np.argsort(own, kind="stable")
        held, first = np.unique(own[order], return_index=True)
        c[held] = np.add.reduceat(x[order], first, axis=0) / np.diff(np.append(first, len(x)))[:, None]
    return c


@dataclass
class MultiIndex:
    left: np.ndarray
    right: np.ndarray
    reach: float = 0.0

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of each vector's halves to the centroids of their codebooks."""
        h = x.shape[1] // 2
        out = []
        for part, c in ((x[:, :h], self.left), (x[:, h:], self.right)):
            out.append((part**2).sum(axis=1)[:, None] + (c**2).sum(axis=1)[None] - 2 * part @ c.T)
        return out[0], out[1]

    def cell(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return i * len(self.right) + j

    def visit(self, d1: np.ndarray, d2: np.ndarray) -> list[int]:
        """Cells from the nearest on, until the sum of half distances leaves the reach."""
        o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
        s1, s2 = d1[o1].tolist(), d2[o2].tolist()
        end = s1[0] + s2[0] + self.reach
        heap, seen, out = [(s1[0] + s2[0], 0, 0)], {(0, 0)}, []
        while heap:
            far, a, b = heapq.heappop(heap)
            if far > end:
                break
            out.append(int(o1[a]) * len(self.right) + int(o2[b]))
            for p in ((a + 1, b), (a, b + 1)):
                if p[0] < len(s1) and p[1] < len(s2) and p not in seen:
                    seen.add(p)
                    heapq.heappush(heap, (s1[p[0]] + s2[p[1]], *p))
        return out

    def excess(self, q: np.ndarray, other: np.ndarray) -> np.ndarray:
        """How much further than to its own cell a query must go to the cell of the other vector of its row."""
        (a, b), (c, d) = self.halves(q), self.halves(other)
        rows = np.arange(len(q))
        return a[rows, c.argmin(axis=1)] + b[rows, d.argmin(axis=1)] - a.min(axis=1) - b.min(axis=1)

    def needed(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The least reach by which the vectors of a row meet, from either side."""
        return np.minimum(self.excess(x, y), self.excess(y, x))

    def calibrate(self, x: np.ndarray, cosine: float, recall: float, rng: np.random.Generator) -> None:
        """Set the reach from the sampled vectors and, for each, one in a random direction at the threshold."""
        noise = rng.normal(size=x.shape)
        noise -= (noise * x).sum(axis=1, keepdims=True) * x
        y = cosine * x + math.sqrt(1 - cosine**2) * noise / np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
        self.reach = float(np.quantile(self.needed(x, y), recall)) + 1e-9


#: Reaches are counted in steps of this size.
STEP = 1e-3


def _fit(seed: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        """Both codebooks of one book from its sampled vectors."""
        dim, tier = key
        x, h = unit_rows(group.sort_values("vec_id")["x"], dim), dim // 2
        rng = np.random.default_rng([seed, dim, tier])
        k = int(group["k"].iloc[0])
        left, right = kmeans(x[:, :h], k, rng), kmeans(x[:, h:], k, rng)
        return pd.DataFrame({"dim": [dim], "tier": [tier], "n_left": [len(left)], "n_right": [len(right)], "lefts": [left.tobytes()], "rights": [right.tobytes()]})

    return run


def fit_books(vectors: DataFrame, config: IndexConfig) -> dict[tuple[int, int], MultiIndex]:
    """A multi-index for each length of vectors and each tier of label sizes.

    A book's k is set by the largest of its labels, which is at most four times the smallest above the first tier, so no label has cells that
    are much too coarse or too fine. Codebooks are fitted in tasks, each on a bounded sample; the driver gets the centroids, and at
    most about `sample` vectors of a book for its reach.
    """
    sizes = vectors.groupBy("dim", "tier", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("dim", "tier").agg(F.max("n").alias("top"), F.sum("n").alias("n")).collect()
    if not sizes:
        return {}
    part = lambda want, n: min(1 << 32, int(want / n * (1 << 32)) + 1)
    plan = []
    for r in sizes:
        k = int(np.clip(round(math.sqrt(r["top"] / config.per_cell)), 4, config.most_centroids))
        plan.append((r["dim"], r["tier"], k, part(max(config.sample, 20 * k), r["n"]), part(config.sample, r["n"])))
    plans = F.broadcast(vectors.sparkSession.createDataFrame(plan, "dim int, tier int, k int, share long, few long"))
    place = F.pmod(F.xxhash64("vec_id", F.lit(config.seed)), F.lit(1 << 32))
    placed = vectors.withColumn("place", place).join(plans, ["dim", "tier"])
    fitted = placed.where("place < share").select("dim", "tier", "k", "vec_id", "x").groupBy("dim", "tier")
    books = {}
    for r in fitted.applyInPandas(_fit(config.seed), "dim int, tier int, n_left int, n_right int, lefts binary, rights binary").collect():
        left, right = (np.frombuffer(bytes(raw)).reshape(n, -1) if n else np.zeros((1, 0)) for raw, n in ((r["lefts"], r["n_left"]), (r["rights"], r["n_right"])))
        books[r["dim"], r["tier"]] = MultiIndex(left, right)
    for dim, tier, *_ in plan:
        # a sample may turn out empty by chance; then all of the book's vectors share one cell
        books.setdefault((dim, tier), MultiIndex(np.zeros((1, dim // 2)), np.zeros((1, dim - dim // 2)), math.inf))
    sample = placed.where("place < few").select("dim", "tier", "vec_id", "x", "label", "place").toPandas().sort_values("vec_id")
    few = {}
    for book, some in sample.groupby(["dim", "tier"]):
        x = unit_rows(some["x"], book[0])
        books[book].calibrate(x, config.cosine, config.recall, np.random.default_rng([config.seed, *book]))
        asked = some.sort_values("place").head(config.measured)
        few[book] = asked["vec_id"].to_numpy(), asked["label"].to_numpy(), unit_rows(asked["x"], book[0])
    for book, counts in measured_reaches(vectors, books, few, config.cosine).items():
        total, seen = sum(counts.values()), 0
        for at in sorted(counts):
            seen += counts[at]
            if seen >= config.recall * total:
                books[book].reach = max(books[book].reach, (at + 1) * STEP)
                break
    return books


def measured_reaches(vectors: DataFrame, books: dict, few: dict, cosine: float) -> dict[tuple[int, int], dict[int, int]]:
    """All links of a few vectors of each book in the whole table, counted by the reach that each needs, in steps of STEP."""

    def run(batches):
        counts: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            for book, of_book in batch.groupby(["dim", "tier"]):
                if book not in few:
                    continue
                ids, labels, x = few[book]
                for at in range(0, len(of_book), 4000):
                    part = of_book.iloc[at : at + 4000]
                    y = unit_rows(part["x"], book[0])
                    same = (part["label"].to_numpy()[:, None] == labels[None]) & (part["vec_id"].to_numpy()[:, None] != ids[None])
                    row, col = np.nonzero((y @ x.T >= cosine) & same)
                    if len(row):
                        steps = np.floor(np.maximum(books[book].needed(x[col], y[row]), 0) / STEP).astype(int)
                        for b, c in zip(*np.unique(steps, return_counts=True)):
                            counts[*book, int(b)] = counts.get((*book, int(b)), 0) + int(c)
        yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["dim", "tier", "at", "n"], dtype="int64")

    found: dict[tuple[int, int], dict[int, int]] = {}
    made = vectors.select("vec_id", "label", "dim", "tier", "x").mapInPandas(run, "dim int, tier int, at long, n long")
    for r in made.groupBy("dim", "tier", "at").agg(F.sum("n").alias("n")).collect():
        found.setdefault((r["dim"], r["tier"]), {})[r["at"]] = r["n"]
    return found


def _postings(books: dict):
    def run(batches):
        for batch in batches:
            for book, of_book in batch.groupby(["dim", "tier"]):
                index = books[book]
                step = max(1, min(2000, CELLS // max(len(index.left), len(index.right))))
                for at in range(0, len(of_book), step):
                    part = of_book.iloc[at : at + step]
                    d1, d2 = index.halves(unit_rows(part["x"], book[0]))
                    own = index.cell(d1.argmin(axis=1), d2.argmin(axis=1)).tolist()
                    rows = []
                    for label, vec_id, a, b, cell in zip(part["label"], part["vec_id"], d1, d2, own):
                        visits = {cell, *index.visit(a, b)}
                        probes = np.array(sorted(visits), "<i4").tobytes()
                        rows += [(label, book[0], c, c == cell, vec_id, cell, probes) for c in visits]
                    yield pd.DataFrame(rows, columns=["label", "dim", "cell", "stored", "vec_id", "own", "probes"])

    return run


def _meet(cosine: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Links between a block of stored vectors and a block of queries of one cell: counts per vector, and a spanning forest."""
        kept = group[group["stored"] & group["as_stored"]]
        asks = group[~group["as_stored"]]
        empty = pd.DataFrame({"a": [], "b": [], "n": []}).astype({"a": "int64", "b": "Int64", "n": "int64"})
        if not len(kept) or not len(asks):
            return empty
        dim = int(group["dim"].iloc[0])
        xs, ys = unit_rows(asks["x"], dim), unit_rows(kept["x"], dim)
        xi, yi = asks["vec_id"].to_numpy(), kept["vec_id"].to_numpy()
        xc, yc = asks["copies"].to_numpy(), kept["copies"].to_numpy()
        cell, own = int(group["cell"].iloc[0]), asks["own"].to_numpy()
        sees = [frozenset(np.frombuffer(p, "<i4").tolist()) for p in kept["probes"]]
        places = {c: np.array([c in s for s in sees]) for c in set(own.tolist())}
        nx, ny = np.zeros(len(xi), np.int64), np.zeros(len(yi), np.int64)
        root = {}

        def find(v: int) -> int:
            while root.setdefault(v, v) != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        edges = []
        for at in range(0, len(xi), 1000):
            near = xs[at : at + 1000] @ ys.T >= cosine
            for r in np.flatnonzero(near.any(axis=1)):
                q = at + int(r)
                hit = near[r]
                if own[q] == cell:
                    hit = hit & (yi > xi[q])
                elif cell > own[q]:
                    # both see each other's cell: the smaller cell counts the pair
                    hit = hit & ~places[int(own[q])]
                hits = np.flatnonzero(hit)
                if len(hits):
                    nx[q] += yc[hits].sum()
                    ny[hits] += xc[q]
                    a = find(int(xi[q]))
                    for y in yi[hits].tolist():
                        b = find(y)
                        if a != b:
                            root[b] = a
                            edges.append((int(xi[q]), y))
        ids, n = np.concatenate([xi[nx > 0], yi[ny > 0]]), np.concatenate([nx[nx > 0], ny[ny > 0]])
        return pd.DataFrame({
            "a": np.concatenate([ids, np.array([e[0] for e in edges], np.int64)]),
            "b": pd.array([None] * len(ids) + [e[1] for e in edges], "Int64"),
            "n": np.concatenate([n, np.zeros(len(edges), np.int64)]),
        })

    return run


def _found(reps: DataFrame, config: IndexConfig) -> DataFrame | None:
    """Link counts (a, n) and a spanning forest of the links (a, b) of vectors of any lengths; None of an empty table."""
    books = fit_books(reps, config)
    if not books:
        return None
    kinds = "label string, dim int, cell int, stored boolean, vec_id long, own int, probes binary"
    posted = cut(reps.select("label", "dim", "tier", "vec_id", "x").mapInPandas(_postings(books), kinds), "index-postings")
    place = ["label", "dim", "cell"]
    sizes = posted.groupBy(*place).agg(F.count_if("stored").alias("kept"), F.count(F.lit(1)).alias("asks")).where("kept > 0 and asks > 1")
    sizes = cut(sizes.select(*place, F.ceil(F.col("kept") / config.block).cast("int").alias("kb"), F.ceil(F.col("asks") / config.queries).cast("int").alias("ab")), "index-cells")
    dealt = join_salted(posted, sizes, place, "vec_id", "inner").join(reps.select("vec_id", "copies", "x"), "vec_id")
    spread = F.xxhash64("vec_id")
    stored = dealt.where("stored").select("*", F.pmod(spread, F.col("kb")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("ab") - 1)).alias("j"), F.lit(True).alias("as_stored"))
    asking = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("kb") - 1)).alias("i"), F.pmod(spread, F.col("ab")).cast("int").alias("j"), F.lit(False).alias("as_stored"))
    return cut(stored.unionByName(asking).drop("kb", "ab").groupBy(*place, "i", "j").applyInPandas(_meet(config.cosine), "a long, b long, n long"), "index-links")


def label_tiers(classes: DataFrame, config: IndexConfig) -> DataFrame:
    """(label, dim, tier) of the labels above the first tier: a tier ends at four times as many vectors as the one before.

    The first holds labels of up to 16 cells of per_cell vectors, which the smallest codebooks serve; the last, those of most_centroids.
    """
    n = F.count(F.lit(1)).cast("double")
    last = max(0, math.ceil(math.log(config.most_centroids**2 / 16, 4)))
    tier = F.least(F.ceil(F.log(n / (16 * config.per_cell)) / math.log(4)), F.lit(last)).cast("int")
    return classes.groupBy("label", "dim").agg(tier.alias("tier")).where("tier > 0")


def embedding_links(vectors: DataFrame, config: IndexConfig = IndexConfig()) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Only vectors with the same label and of the same length link. A null label, a vector that is null, empty, zero or has
    null or non-finite components, and a null vec_id link with nothing. Vectors of equal direction are one class from the start;
    its copies count as links of each other. Of equally near centroids the first holds a vector. An empty table gives an empty
    result. vec_id, embedding and label are read, other columns ignored. vec_id should be unique, and rows that share one
    are one vector to the counts.
    """
    with Scope() as scope:
        return scope.keep(cut(_links(vectors, config), "index-result"))


def _links(vectors: DataFrame, config: IndexConfig) -> DataFrame:
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    wide = vectors.schema["embedding"].dataType.simpleString() != "array<float>"
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>" if wide else "array<float>"))
    units = cut(source.mapInArrow(_units(wide), "vec_id long, label string, dim int, x binary, key binary"), "index-units")
    classes = cut(units.groupBy("label", "dim", "key").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies")), "index-classes")
    repeated = classes.where("copies > 1").drop("dim")
    member = cut(join_salted(units.select("vec_id", "label", "key"), repeated, ["label", "key"], "vec_id", "inner").select("vec_id", "rep", "copies").distinct(), "index-members")
    reps = units.join(member.where("vec_id <> rep"), "vec_id", "left_anti").dropDuplicates(["vec_id"])
    reps = reps.join(member.where("vec_id = rep").select("vec_id", "copies"), "vec_id", "left").select("vec_id", "label", "dim", "x", F.coalesce("copies", F.lit(1)).alias("copies"))
    tiers = cut(label_tiers(classes, config), "index-tiers")
    reps = join_salted(reps, tiers, ["label", "dim"], "vec_id").withColumn("tier", F.coalesce("tier", F.lit(0)))
    reps = cut(reps, "index-reps")

    found = _found(reps, config)
    if found is None:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))

    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    reached = connected_components(found.where("b is not null").select("a", "b"))
    info = cut(counts.join(reached.select(F.col("node").alias("rep"), "component"), "rep", "full"), "index-info")
    rows = ids.join(member, "vec_id", "left").withColumn("rep", F.coalesce("rep", "vec_id"))
    rows = join_salted(rows, info, ["rep"], "vec_id")
    component = F.coalesce("component", "rep")
    return rows.select(
        "vec_id",
        (F.coalesce("n", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
