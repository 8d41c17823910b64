"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed byte bigram and trigram counts over its letters, weighted by TF-IDF and
normalised. Each learned language is summarised by a few spherical k-means centroids; a text takes the
language of the centroid with the highest cosine, and is marked as rejected when it lies further from that
centroid than nearly all of the centroid's own members did.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cohortweave.llm.rows import map_texts
from cohortweave.llm.storage import Scope, cut

_WORDISH = re.compile(r"[^\W\d_]")
_FOLD = np.full(256, 0x20, np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class LanguageConfig:
    buckets: int = 4096
    centroids: int = 4
    #: At most about so many texts of each language are fitted on; they are taken by a hash of doc_id.
    max_per_language: int = 1200
    held_out_of: int = 4
    held_out: int = 2
    reject_quantile: float = 0.995
    reject_slack: float = 1.25


def has_letter(text: str) -> bool:
    """Whether any character is a letter (Unicode category L); other numerals than digits, such as fractions, are none."""
    return any(m.group().isalpha() for m in _WORDISH.finditer(text))


def ngram_counts(text: str, buckets: int) -> np.ndarray:
    """Counts of hashed byte bigrams and trigrams of the lower-cased text; anything but a letter is a space."""
    b = _FOLD[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)]
    out = np.zeros(buckets, np.int64)
    for n in (2, 3):
        if len(b) >= n:
            h = b[: len(b) - n + 1].copy()
            for i in range(1, n):
                h = h * np.uint32(0x01000193) ^ b[i : len(b) - n + 1 + i]
            h *= np.uint32(0x9E3779B1)
            out += np.bincount(h >> np.uint32(16) & np.uint32(buckets - 1), minlength=buckets)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class LanguageModel:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    limits: np.ndarray

    def vectors(self, texts: list[str]) -> np.ndarray:
        tf = np.log1p(np.array([ngram_counts(t, len(self.idf)) for t in texts], np.float32))
        return _unit(tf * self.idf)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and rejected, for each text."""
        cos = self.vectors(texts) @ self.centroids.T
        best = cos.argmax(axis=1)
        top = cos[np.arange(len(texts)), best]
        return [self.languages[i] for i in best], top, 1 - top > self.limits[best]


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids of unit rows and each row's centroid; starts from far-apart rows, so reruns agree."""
    centres = [_unit(x.mean(axis=0, keepdims=True))[0]]
    nearest = x @ centres[0]
    for _ in range(1, min(k, len(x))):
        centres.append(x[int(nearest.argmin())])
        nearest = np.maximum(nearest, x @ centres[-1])
    c = np.array(centres)
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.array([_unit(x[own == j].mean(axis=0, keepdims=True))[0] if (own == j).any() else c[j] for j in range(len(c))])
    return c, (x @ c.T).argmax(axis=1)


def _crc(of: int):
    return F.crc32(F.col("doc_id").cast("string")) % of


def fit(docs: DataFrame, config: LanguageConfig) -> LanguageModel | None:
    """Learn from text and lang of the rows outside the held-out remainder; None when no such row has a letter."""
    rows = docs.where(_crc(config.held_out_of) != config.held_out).where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    spark = docs.sparkSession
    shares = spark.createDataFrame([(k, min(1 << 32, int(config.max_per_language / n * (1 << 32)) + 1)) for k, n in sorted(counts.items())], "lang string, share long")
    sample = rows.join(F.broadcast(shares) if len(counts) < 10_000 else shares, "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 32)) < F.col("share"))

    def vectors(batches):
        for batch in batches:
            some = [(k, t) for k, t in zip(batch["lang"], batch["text"]) if has_letter(t)]
            yield pd.DataFrame({"lang": [k for k, _ in some], "tf": [np.log1p(ngram_counts(t, config.buckets)).astype(np.float32).tobytes() for _, t in some]})

    tf = cut(sample.select("lang", "text").mapInPandas(vectors, "lang string, tf binary"), "language-fit")

    def document_counts(batches):
        df, n = np.zeros(config.buckets), 0
        for batch in batches:
            x = np.frombuffer(b"".join(batch["tf"]), np.float32).reshape(len(batch), config.buckets)
            df += (x > 0).sum(axis=0)
            n += len(batch)
        yield pd.DataFrame({"df": [df.tobytes()], "n": [n]})

    parts = tf.coalesce(16).mapInPandas(document_counts, "df binary, n long").collect()
    n = sum(p["n"] for p in parts)
    if not n:
        return None
    idf = (np.log((1 + n) / (1 + sum(np.frombuffer(p["df"]) for p in parts))) + 1).astype(np.float32)

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        raw = sorted(group["tf"])
        x = _unit(np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), config.buckets) * idf)
        c, own = spherical_kmeans(x, config.centroids)
        far = 1 - (x * c[own]).sum(axis=1)
        limits = [float(np.quantile(far[own == j], config.reject_quantile)) if (own == j).any() else 0.0 for j in range(len(c))]
        return pd.DataFrame({"lang": group["lang"].iloc[0], "k": range(len(c)), "centroid": [v.astype(np.float32).tobytes() for v in c], "far": limits})

    found = tf.groupBy("lang").applyInPandas(cluster, "lang string, k int, centroid binary, far double").collect()
    found.sort(key=lambda r: (r["lang"], r["k"]))
    return LanguageModel(
        idf,
        np.frombuffer(b"".join(r["centroid"] for r in found), np.float32).reshape(len(found), config.buckets),
        [r["lang"] for r in found],
        np.array([r["far"] for r in found]) * config.reject_slack,
    )


def language_id(docs: DataFrame, config: LanguageConfig = LanguageConfig()) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score (0 to 1) and rejected.

    A null text, or one without a letter, is `und` with score 0; numerals of any script are no letters. A rejected text
    keeps the nearest language with half its cosine as score; of equally near centroids the first by language wins. A
    null doc_id is not held out and not learned from; repeated rows get equal results; an empty table gives an empty
    result; without anything to learn from all rows are `und`. A text may have any length. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    with Scope():
        model = fit(docs, config)

    def predictor():
        def predict(texts: list[str | None]) -> tuple:
            lang, score, far = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            known = [i for i, t in enumerate(texts) if model is not None and t and has_letter(t)]
            if known:
                names, cos, rejected = model.predict([texts[i] for i in known])
                for i, name in zip(known, names):
                    lang[i] = name
                score[known] = np.clip(np.where(rejected, cos / 2, cos), 0, 1)
                far[known] = rejected
            return lang, score, far

        return predict

    held = F.coalesce(_crc(config.held_out_of) == config.held_out, F.lit(False)).alias("held_out")
    return map_texts(docs, predictor, "lang_pred string, score double, rejected boolean").select("doc_id", held, "lang_pred", "score", "rejected")
