"""Spelling variants: words one edit apart, found by asymmetric q-chunks, and the form that each of them stands for.

A word contributes two disjoint chunks, its halves; a word of the same length or one more contributes its positional grams.
One edit touches one half only, so the other half is a gram of the near word, shifted by the difference of their lengths, at
most one: only grams that could be such a half are made. The two meet on that gram and are verified. A gram that many words share is split again: what
lies behind or before it is halved in the same way, so that a meeting stays small however many words begin alike.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, functions as F

from cohortweave.llm.storage import Scope, cut

#: Maximal runs of these letters are taken from texts (fixed value).
RUN = "[A-Za-zÀ-ÿ]+"
#: A run changes where this divides its checksum.
EVERY = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Rows that may meet on a gram before it is split.
CROWD = 64
#: Code points up to which a word is compared by an edit distance, whose time is quadratic.
SHORT = 64
#: Distinct words that a counting task holds before it hands them on.
HELD = 200_000
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})


def changed_runs(doc_id: int | None, text: str, every: int = EVERY) -> Iterator[tuple[str, int]]:
    """The lower-cased runs of a text with how often they occur; a run loses a code point where `every` divides the CRC-32 of `<doc_id>:<run>`."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(re.findall(RUN, text.translate(_LOWER))).items():
        h = zlib.crc32(run.encode(), start)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def word_counts(docs: DataFrame, every: int = EVERY, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the changed runs of all whole texts that are long and frequent enough; a task's words are added up before they are shuffled."""

    def count(batches):
        import pyarrow as pa

        held: Counter = Counter()

        def flushed():
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for run, n in changed_runs(doc_id, text.as_py() or "", every):
                    if len(run) >= least_length:
                        held[run] += n
                if len(held) >= HELD:
                    yield flushed()
        yield flushed()

    found = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _halved(rows: DataFrame) -> DataFrame:
    """rows (word, n, gram, rest, longer) with rest split: a half of it joins the gram, and the other half is the new rest.

    Of a word that is to be the longer of two, one half is as long as that of the shorter one and the other has one code point
    more: the one before the gram if the gram is shifted, or the one behind it. A rest of one code point in the shorter word
    is not halved: words of the same length are near whatever it is, and a longer word must hold it.
    """
    half = "int((char_length(rest) - longer) / 2)"
    made = lambda gram, rest: f"struct(concat(gram, {gram}) AS gram, {rest} AS rest)"
    halves = [made(f"'<', substring(rest, 1, {half})", f"substring(rest, {half} + 1)"), made(f"'>', substring(rest, {half} + longer + 1)", f"substring(rest, 1, {half} + longer)")]
    alone = [made("'='", "''"), made("'+', rest", "''")]
    either = [made("'+', left(rest, 1)", "left(rest, 1)"), made("'+', right(rest, 1)", "left(rest, 1)")]
    split = F.expr(f"CASE WHEN char_length(rest) - longer > 1 THEN array({', '.join(halves)}) WHEN longer = 0 THEN array({', '.join(alone)}) ELSE array({', '.join(either)}) END")
    return rows.withColumn("split", F.explode(split)).select("word", "n", "split.gram", "split.rest", "longer")


def _one_edit_apart(a: str, b: str, longer: str) -> Column:
    """If two different words, of the same length or b longer by one, are one edit apart; in linear time where words are long."""
    at = f"array_position(zip_with(split({a}, ''), split({b}, ''), (x, y) -> NOT (x <=> y)), true)"
    return F.when(F.char_length(b) <= SHORT, F.levenshtein(a, b, 1) == 1).otherwise(F.expr(f"substring({b}, int({at}) + 1) = substring({a}, int({at}) + 1 - {longer})"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, n_other): each pair of words exactly one inserted, deleted or replaced code point apart, both ways, once.

    A word meets words of its own length and the next larger one, by grams. Where more than CROWD rows share a gram they are split
    further, until nothing is left of the shorter word: then all that meet are near.
    """
    start = words.where("word <> ''").select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("longer")).where("longer = 0 or char_length(word) > 1")
    start = start.select("word", "n", (F.char_length("word") - F.col("longer")).cast("string").alias("gram"), F.col("word").alias("rest"), "longer")
    rows, ready = _halved(start), None
    while True:
        rows = cut(rows, "spelling-grams")
        crowded = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("rows"), F.max(F.expr("char_length(rest) - longer")).alias("left")).where((F.col("rows") > CROWD) & (F.col("left") > 0)).select("gram")
        seen = Observation()
        crowded = cut(crowded.observe(seen, F.count(F.lit(1)).alias("n")), "spelling-crowded")
        if not seen.get["n"]:
            ready = rows if ready is None else ready.unionByName(rows)
            break
        quiet = rows.join(crowded, "gram", "left_anti").select(rows.columns)
        ready = quiet if ready is None else ready.unionByName(quiet)
        rows = _halved(rows.join(crowded, "gram", "left_semi").select(rows.columns))
    a = ready.where("longer = 0").select("gram", F.col("word").alias("a"), F.col("n").alias("na"))
    b = ready.select("gram", "longer", F.col("word").alias("b"), F.col("n").alias("nb"))
    met = a.join(b, "gram").where("longer = 1 or a < b").where(_one_edit_apart("a", "b", "longer"))
    pairs = cut(met.select("a", "na", "b", "nb").distinct(), "spelling-pairs")
    return pairs.select(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("other"), F.col("nb").alias("n_other")).unionByName(pairs.select(F.col("b").alias("word"), F.col("nb").alias("n"), F.col("a").alias("other"), F.col("na").alias("n_other")))


def rooted(forms: DataFrame) -> DataFrame:
    """forms (word, form, ...) with root: where following forms from word ends. Steps double in each round, and forms lead to no circle."""
    with Scope() as scope:
        now, moved = cut(forms.withColumn("root", F.coalesce("form", "word")), "spelling-roots"), 1
        while moved:
            ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next")).where("root <> next")
            seen = Observation()
            step = now.join(ahead, "root", "left").observe(seen, F.count("next").alias("n")).select(*forms.columns, F.coalesce("next", "root").alias("root"))
            last, now = now, cut(step, "spelling-roots")
            scope.free(last)
            moved = seen.get["n"]
        return scope.keep(now)


def spelling_variants(docs: DataFrame, every: int = EVERY, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = 2) -> DataFrame:
    """Every word of the texts with its form and root: word, form, root, n, n_near, form_n.

    A word is a changed run (word_counts) of at least least_length code points that occurs at least least_count times. Its form is the near
    word of largest n, on ties the smallest by code point, if that n is at least ratio (2 or more) times its own. Null and empty texts have no words; a null
    doc_id counts as an empty one in the checksum; repeated rows count as often as they are there; an empty table gives an empty
    result. Texts and runs of any length are read whole; other columns are ignored.
    """
    with Scope() as scope:
        words = cut(word_counts(docs, every, least_length, least_count), "spelling-words")
        best = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("less"), "other")).alias("best"))
        kept = -F.col("best.less") >= ratio * F.col("n")
        forms = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(kept, F.col("best.other")).alias("form"), F.when(kept, -F.col("best.less")).alias("form_n"))
        return scope.keep(rooted(forms)).select("word", "form", "root", "n", "n_near", "form_n")
