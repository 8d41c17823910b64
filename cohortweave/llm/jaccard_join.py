"""N-gram Jaccard join with adaptive multi-match prefixes.

Shingles have one global order: rare before frequent, as far as a sample of the documents tells, then by hash. Two sets
with Jaccard similarity of at least 0.8 share k of the first n - ceil(0.8 n) + k shingles of each, for any k.
A document chooses its k by the candidates it expects from its prefix, so an expensive one has a longer prefix and
must share more of it. Documents that share min(k, k') prefix shingles, and whose positions leave room for enough more
behind the last shared one, are candidates.

A prefix shingle of very many documents is frequent: it is not joined with itself. A pair that shares a rarer one as well
is found by that, with its frequent ones credited. A pair that shares frequent ones only is found by its first shared
shingle, of which at least the needed overlap must follow in both sets: documents meet by shingle and length, and a
shingle that is nobody's early one meets nothing.

Identical sets are one class from the start. Verification takes two steps. First every document is compared with the
smallest of its candidates and with the leaders of its frequent shingles; then pairs that are still in different
components. So a group of thousands of near copies costs a comparison each, not one for each pair. Pairs are compared
on whole sets in joins: no group is held by one task.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortweave.llm.rows import map_texts, slices
from cohortweave.llm.storage import SALTS, Scope, cut, join_salted, small_side
from cohortweave.llm.words import shingle_set
from cohortweave.operators.components import connected_components

#: Pairs of one document from which on they are dealt over tasks.
HEAVY = 1000


@dataclass(frozen=True)
class JoinConfig:
    percent: int = 80
    words: int = 5
    #: One document in so many is sampled to estimate shingle frequencies; estimates steer cost, never the result.
    sample_of: int = 8
    #: A shingle seen so often in the sample counts as frequent.
    sample_least: int = 3
    #: The table of frequent shingles that tasks get holds the most frequent ones, at most so many (12 bytes each).
    most_frequent: int = 1 << 19
    #: A prefix shingle of more classes than this is frequent; up to it, pairs count their matches.
    pairs_up_to: int = 96
    #: Documents of a frequent shingle and length that a task compares with all others of that shingle and length.
    block: int = 2000


def _overlap_needed(n: int, percent: int) -> int:
    return (percent * n + 99) // 100


def prefix_matches(n: int, cost: float, percent: int) -> int:
    """How many prefix shingles a document of n shingles must share: 1 and a part of n that grows with the expected candidates per shingle."""
    part = 64 if cost < 1 else 32 if cost < 16 else 16 if cost < 256 else 10
    return min(1 + n // part, _overlap_needed(n, percent))


def _frequent(docs: DataFrame, config: JoinConfig) -> tuple[np.ndarray, np.ndarray]:
    """Sorted frequent shingles and their estimated document counts."""

    def tokens(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b in slices(batch.column(0)):
                sets = [shingle_set(t, config.words) for t in batch.column(0).slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["token"])

    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(config.sample_of)) == 0).select("text")
    counts = cut(some.mapInArrow(tokens, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= config.sample_least), "jaccard-frequent")
    left, least = config.most_frequent, None
    for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n")).toLocalIterator():
        if r["k"] > left:
            break
        left, least = left - r["k"], r["n"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    found = counts.where(F.col("n") >= least).toPandas()
    token = found["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], found["n"].to_numpy(np.int32)[order] * config.sample_of


def _prefixes(frequent, config: JoinConfig):
    def make():
        token, count = frequent.value

        def run(texts: list[str | None]) -> tuple:
            rows = []
            for text in texts:
                s = shingle_set(text, config.words)
                n = len(s)
                est = np.zeros(n, np.int32)
                if n and len(token):
                    at = np.minimum(np.searchsorted(token, s), len(token) - 1)
                    est = np.where(token[at] == s, count[at], 0)
                order = np.argsort(est, kind="stable") if est.any() else np.arange(n)
                need = _overlap_needed(n, config.percent)
                cost = float(est[order[: n - need + 1]].mean()) if n else 0.0
                k = prefix_matches(n, cost, config.percent)
                sig = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                rows.append((n, k, sig[0], sig[1], s[order[: n - need + k]].view(np.int64)))
            return tuple(zip(*rows)) if rows else ((),) * 5

        return run

    return make


def _sets(config: JoinConfig):
    return lambda: lambda texts: ([shingle_set(t, config.words).view(np.int64) for t in texts],)


def _join_heavy(rows: DataFrame, table: DataFrame, key: str, by: str) -> DataFrame:
    """rows joined to table, which has each key once; the rows of a heavy key are dealt over tasks by column `by`."""
    heavy = cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > HEAVY), "jaccard-heavy")
    if heavy.isEmpty():
        return rows.join(table, key)
    held = heavy if (few := small_side(heavy)) is None else few
    dealt = rows.join(held, key, "left").withColumn("__salt", F.when(F.col("__n").isNotNull(), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(0).cast("int")).drop("__n")
    copies = table.join(held, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.when(F.col("__n").isNotNull(), F.lit(SALTS - 1)).otherwise(0)))).drop("__n")
    return dealt.join(copies, [key, "__salt"]).drop("__salt")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that link, by the sizes of whole sets and of their intersection."""
    one = _join_heavy(pairs, sets.select(F.col("doc_id").alias("a"), F.col("set").alias("sa")), "a", "b")
    both = _join_heavy(one, sets.select(F.col("doc_id").alias("b"), F.col("set").alias("sb")), "b", "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def _room(config: JoinConfig, na: str, nb: str, most: Column) -> Column:
    """Whether sets of na and nb shingles that share at most so many can link."""
    return (100 + config.percent) * most >= config.percent * (F.col(na) + F.col(nb))


def _rare_pairs(rare: DataFrame, config: JoinConfig) -> DataFrame:
    """Candidates (a < b) by shingles that are not frequent; h is how many frequent ones a prefix has beside them."""
    side = lambda x: rare.select("token", *[F.col(c).alias(c + x) for c in ("doc_id", "n", "k", "h", "pos", "sig0")])
    after = F.least(F.col("na") - F.col("posa"), F.col("nb") - F.col("posb")) - 1
    close = (F.col("doc_ida") < F.col("doc_idb")) & (100 * F.least("na", "nb") >= config.percent * F.greatest("na", "nb"))
    met = side("a").join(side("b"), "token").where(close & _room(config, "na", "nb", F.least("posa", "posb") + 1 + after))
    least = lambda x, y: F.min(F.least(x, y))
    # a doc_id of several texts has several sets
    pairs = met.groupBy(F.col("doc_ida").alias("a"), F.col("doc_idb").alias("b"), "sig0a", "sig0b").agg(
        F.count(F.lit(1)).alias("both"), least("ka", "kb").alias("k"), least("ha", "hb").alias("h"), F.min("na").alias("na"), F.min("nb").alias("nb"), F.min(after).alias("after"))
    known = F.col("both") + F.col("h")
    return pairs.where((known >= F.col("k")) & _room(config, "na", "nb", known + F.col("after"))).select("a", "b").distinct()


def _length_class(n: Column, config: JoinConfig) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(100.0 / config.percent))).cast("int")


def _meetings(frequent: DataFrame, config: JoinConfig) -> DataFrame:
    """Postings of frequent shingles by shingle and class of the shorter set's length, where any pair can meet there.

    A posting stands in its own class if its set can be the shorter one (`short`), and as the longer one in the classes of
    all lengths that it can link with; its position says whether enough shingles follow for that.
    """
    short = _room(config, "n", "n", F.col("n") - F.col("pos"))
    longer = 100 * (F.col("n") - F.col("pos")) >= config.percent * F.col("n")
    own = _length_class(F.col("n"), config)
    least = _length_class(F.floor((F.col("n") * config.percent + 99) / 100), config)
    as_longer = frequent.where(longer).withColumn("class", F.explode(F.sequence(least, own))).withColumn("short", F.lit(False))
    as_short = frequent.where(short).withColumn("class", own).withColumn("short", F.lit(True))
    both = cut(as_longer.unionByName(as_short), "jaccard-meetings")
    first = F.min(F.when(F.col("short"), F.struct("doc_id", "pos", "n")))
    groups = both.groupBy("token", "class").agg(first.alias("lead"), F.count_if("short").alias("shorts"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("shorts > 0 and low < high")
    groups = groups.select("token", "class", F.col("lead.pos").alias("lpos"), F.col("lead.doc_id").alias("lead"), F.col("lead.n").alias("ln"), F.ceil(F.col("shorts") / config.block).cast("int").alias("blocks"))
    return cut(join_salted(both, cut(groups, "jaccard-meeting-groups"), ["token", "class"], "doc_id", "inner"), "jaccard-met")


def _possible(config: JoinConfig, n: str, pos: str, m: str, mpos: str) -> Column:
    close = 100 * F.least(n, m) >= config.percent * F.greatest(n, m)
    return close & _room(config, n, m, F.least(F.col(n) - F.col(pos), F.col(m) - F.col(mpos)))


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _lead_pairs(met: DataFrame, config: JoinConfig) -> DataFrame:
    """Each document with the leader of each of its meetings."""
    return met.where((F.col("doc_id") != F.col("lead")) & _possible(config, "n", "pos", "ln", "lpos")).select(*_ordered("doc_id", "lead"))


def _apart(met: DataFrame, component: DataFrame, config: JoinConfig) -> DataFrame:
    """Pairs of a meeting that are still in different components."""
    rows = join_salted(met, component, ["doc_id"], "token").withColumn("component", F.coalesce("component", "doc_id"))
    rows = cut(rows.select("token", "class", "short", "doc_id", "n", "pos", "blocks", "component"), "jaccard-apart")
    groups = rows.groupBy("token", "class").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token", "class")
    rows = join_salted(rows, cut(groups, "jaccard-apart-groups"), ["token", "class"], "doc_id", "inner")
    shorter = rows.where("short").select("token", "class", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block"), *[F.col(c).alias("s_" + c) for c in ("doc_id", "n", "pos", "component")])
    longer = rows.where("not short").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "short")
    pairs = longer.join(shorter, ["token", "class", "block"]).where(F.col("component") != F.col("s_component"))
    return pairs.where((F.col("s_n") <= F.col("n")) & _possible(config, "n", "pos", "s_n", "s_pos")).select(*_ordered("doc_id", "s_doc_id"))


def _links(only: DataFrame, docs: DataFrame, config: JoinConfig) -> DataFrame:
    """Links between different sets, enough of them to connect every component: (a, b)."""
    postings = only.select(F.posexplode("prefix").alias("pos", "token"), "doc_id", "n", "k", "sig0")
    counts = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > config.pairs_up_to)
    hot = cut(counts.select("token"), "jaccard-hot")
    held = small_side(hot)
    rare = postings.join(hot if held is None else held, "token", "left_anti")
    rare = rare.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("df > 1").drop("df")
    if hot.isEmpty():
        candidates = cut(_rare_pairs(rare.withColumn("h", F.lit(0).cast("long")), config), "jaccard-candidates")
        met = leads = None
    else:
        often = cut(join_salted(postings, hot, ["token"], "doc_id", "inner"), "jaccard-often")
        credit = cut(often.groupBy("doc_id").agg(F.count(F.lit(1)).alias("h")), "jaccard-credit")
        rare = rare.join(credit if (few := small_side(credit)) is None else few, "doc_id", "left").withColumn("h", F.coalesce("h", F.lit(0).cast("long")))
        candidates = cut(_rare_pairs(cut(rare, "jaccard-rare"), config), "jaccard-candidates")
        met = _meetings(often, config)
        leads = _lead_pairs(met, config)
    first = candidates.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    first = cut((first if leads is None else first.unionByName(leads)).distinct(), "jaccard-first")

    ends = lambda df: df.select(F.col("a").alias("doc_id")).unionByName(df.select(F.col("b").alias("doc_id")))
    named = ends(candidates) if met is None else ends(candidates).unionByName(met.select("doc_id"))
    named = cut(named.distinct(), "jaccard-named")
    texts = docs.join(named if (few := small_side(named)) is None else few, "doc_id")
    sets = map_texts(texts, _sets(config), "set array<long>").where(F.size("set") > 0)
    # rows that share a doc_id are one document, which links by any of its texts
    sets = cut(sets, "jaccard-sets")
    linked = cut(_verified(first, sets, config.percent), "jaccard-linked")
    component = cut(connected_components(linked).select(F.col("node").alias("doc_id"), "component"), "jaccard-step")

    rest = candidates.join(first, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        rest = join_salted(rest, component.select(F.col("doc_id").alias(end), F.col("component").alias("c" + end)), [end], "b" if end == "a" else "a")
    rest = rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    if met is not None:
        rest = rest.unionByName(_apart(met, component, config).join(first, ["a", "b"], "left_anti")).distinct()
    return linked.unionByName(_verified(cut(rest, "jaccard-rest"), sets, config.percent))


def jaccard_components(docs: DataFrame, config: JoinConfig = JoinConfig()) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    A null or empty text, or one without words, has an empty set and links with nothing. A null doc_id takes no part
    and has a null component. Repeated rows are copies of each other; rows that share a doc_id are one document
    that links by any of its texts. Shingles that are equally frequent are ordered by their hash. An empty table gives an
    empty result, and a text may have any length. Only doc_id and text are read. The result is a table of these three
    columns; the tables before it are deleted.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with Scope() as scope:
        return scope.keep(cut(_components(docs, config), "jaccard-result"))


def _components(docs: DataFrame, config: JoinConfig) -> DataFrame:
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, config))
    rows = cut(map_texts(docs, _prefixes(frequent, config), "n long, k long, sig0 long, sig1 long, prefix array<long>"), "jaccard-prefixes")
    known = rows.where("n > 0 and doc_id is not null")

    classes = known.groupBy("sig0", "sig1").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last")
    classes = cut(classes.select("sig0", "sig1", "rep"), "jaccard-classes")
    member = cut(join_salted(known.select("doc_id", "sig0", "sig1"), classes, ["sig0", "sig1"], "doc_id", "inner").where("rep < doc_id").select("doc_id", "sig0", "sig1", "rep"), "jaccard-members")

    copies = member.select("doc_id", "sig0", "sig1")
    only = known.join(copies if (held := small_side(copies)) is None else held, ["doc_id", "sig0", "sig1"], "left_anti")
    links = _links(only.select("doc_id", "n", "k", "sig0", "prefix"), docs.where("doc_id is not null"), config)
    # a document of several texts may belong to several classes
    same = member.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    several = known.groupBy("doc_id").agg(F.min("sig0").alias("x"), F.max("sig0").alias("y")).where("x <> y").select(F.col("doc_id").alias("a"))
    links = links.unionByName(same.join(several, "a", "left_semi"))
    reached = cut(connected_components(links).select(F.col("node").alias("rep"), "component"), "jaccard-reached")

    rep = cut(member.groupBy("doc_id").agg(F.min("rep").alias("rep")), "jaccard-reps")
    ids = rows.where("doc_id is not null").select("doc_id", F.col("n").alias("n_shingles"))
    ids = ids.join(rep if (held := small_side(rep)) is None else held, "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    ids = join_salted(ids, reached, ["rep"], "doc_id").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return ids.unionByName(rows.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))
