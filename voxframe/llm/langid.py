"""Language identification in two levels.

A text's family is predicted first; within a family of several languages, one linear support
vector machine for each pair of languages votes. Features are hashed letter 1- to 3-grams of the whole
text, as relative frequencies, so that long texts count no more than short ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from voxframe.llm import common
from voxframe.llm.shingles import mixed

#: Families of closely related languages; a language that is in none is a family by itself.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"],
    "indic": ["hi", "mr", "ne", "bn", "as", "gu", "pa"],
    "turkic": ["tr", "az", "kk", "uz", "ky", "tt"],
    "uralic": ["fi", "et", "hu"],
    "semitic": ["ar", "he", "fa", "ur"],
    "east_asian": ["zh", "ja", "ko"],
}
SLOTS = 1 << 13
#: Distinct training texts of a language at most: the bound of the fitted sample.
SAMPLE_TEXTS = 600
LETTER = regex.compile(r"\p{L}")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else (b if b >= 97 and b <= 122 or b >= 128 or b == 39 else 32) for b in range(256))


def slots_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature slots of a text and their square-rooted, then unit-length frequencies."""
    raw = np.frombuffer(b" " + text.lower().encode().translate(_FOLD) + b" ", np.uint8).astype(np.uint64)
    two = raw[:-1] << np.uint64(8) | raw[1:]
    three = two[:-1] << np.uint64(8) | raw[2:]
    found = np.zeros(SLOTS, np.int64)
    for k, grams in enumerate((raw, two, three)):
        found += np.bincount((mixed(grams + np.uint64(k << 32)) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
    at = np.flatnonzero(found)
    value = np.sqrt(found[at])
    return at, value / np.linalg.norm(value)


def svm(x: np.ndarray, y: np.ndarray, passes: int = 12, reach: float = 1e-4, seed: int = 5) -> np.ndarray:
    """Weights (with a bias last) of a linear support vector machine, y in {-1, 1}, by averaged stochastic subgradients of the squared hinge loss; both classes weigh the same."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    w, mean, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    for _ in range(passes):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), 32):
            own = order[lo : lo + 32]
            slack = np.maximum(0, 1 - y[own] * (x[own] @ w))
            t += 1
            w -= 2.0 / np.sqrt(t) * (reach * w - (weight[own] * slack * y[own]) @ x[own] / own.size)
            mean += (w - mean) / t
    return mean


@dataclass
class Model:
    """Languages, families, one weight column for each family and for each pair within a family."""

    languages: list[str]
    families: list[list[str]]
    weights: np.ndarray
    pairs: list[tuple[str, str]]

    def predict(self, text: str | None) -> tuple[str, float]:
        """A learned language and a score in 0..1; ``und`` and 0 without a letter or without a learned language."""
        if not text or not self.languages or not LETTER.search(text):
            return "und", 0.0
        at, value = slots_of(text)
        margin = value @ self.weights[at] + self.weights[-1]
        odds = 1 / (1 + np.exp(-np.clip(3 * margin, -30, 30)))
        f = int(np.argmax(margin[: len(self.families)])) if len(self.families) > 1 else 0
        own = self.families[f]
        score = odds[f] / odds[: len(self.families)].sum() if len(self.families) > 1 else 1.0
        votes, strength = dict.fromkeys(own, 0), dict.fromkeys(own, 0.0)
        for k, (a, b) in enumerate(self.pairs):
            if a in votes:
                m, p = margin[len(self.families) + k], odds[len(self.families) + k]
                votes[a if m > 0 else b] += 1
                strength[a] += p
                strength[b] += 1 - p
        best = max(own, key=lambda x: (votes[x], strength[x], x))
        return best, float(min(1.0, max(0.0, score * (strength[best] / (len(own) - 1) if len(own) > 1 else 1.0))))


def fit(train: DataFrame, sample_texts: int = SAMPLE_TEXTS) -> Model:
    """Learn from (text, lang) of labelled rows with a letter.

    Of each language the ``sample_texts`` distinct texts with a letter that have the least hashes are used, so a text that
    is repeated a million times is one text and no language takes another's place; executors
    turn them to sparse features. Rows without a language are left out; no rows give a model without languages.
    """
    train = train.where("lang IS NOT NULL").where(F.col("text").rlike(r"\p{L}")).select("text", F.col("lang").cast("string"), F.pmod(F.xxhash64("text"), F.lit(1 << 40)).alias("h"))
    counts = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return Model([], [], np.zeros((SLOTS + 1, 0)), [])
    # a first cut that leaves each language somewhat more than its sample, then its least hashes
    share = F.element_at(F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 1.5 * (sample_texts + 50) / max(1, n))))]), F.col("lang"))
    distinct = train.where(F.col("h") < share * (1 << 40)).groupBy("lang", "h").agg(F.min("text").alias("text"))
    chosen = distinct.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= sample_texts).select("text", "lang")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, limit=1 << 20):
            rows = [(lang, *slots_of(t)) for lang, t in zip(block.column("lang").to_pylist(), common.texts_of(block), strict=True)]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1].astype(np.int16) for r in rows], pa.list_(pa.int16())), pa.array([r[2].astype(np.float32) for r in rows], pa.list_(pa.float32()))], names=["lang", "at", "value"])

    rows = common.map_arrow(chosen, featured, "lang string, at array<short>, value array<float>").toArrow().combine_chunks()
    names = np.array(rows.column("lang").to_pylist(), object)
    x = np.zeros((len(names), SLOTS), np.float32)
    for k, (at, value) in enumerate(zip(rows.column("at").to_pylist(), rows.column("value").to_pylist(), strict=True)):
        x[k, at] = value
    order = np.lexsort(((x @ np.arange(SLOTS, dtype=np.float32)), names.astype(str)))
    x, names = x[order], names[order]
    languages = sorted(set(names.tolist()))
    family_of = {c: f for f, own in FAMILIES.items() for c in own}
    families: dict[str, list[str]] = {}
    for c in languages:
        families.setdefault(family_of.get(c.lower()[:2], c), []).append(c)
    groups = list(families.values())
    columns, pairs = [], []
    for own in groups:
        inside = np.isin(names, own)
        columns.append(svm(x, np.where(inside, 1.0, -1.0)) if len(groups) > 1 else np.zeros(SLOTS + 1))
    for own in groups:
        for a, b in combinations(own, 2):
            use = np.isin(names, [a, b])
            columns.append(svm(x[use], np.where(names[use] == a, 1.0, -1.0)))
            pairs.append((a, b))
    return Model(languages, groups, np.stack(columns, axis=1), pairs)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score of its whole texts; columns of those names are replaced, others kept.

    Null, empty and letterless texts are ``und``. Rows are independent, so ties, repeated rows and hot
    sources need no care; an empty table gives an empty one.
    """
    docs = docs.drop("lang_pred", "score")
    kept = docs.columns

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, limit=1 << 20):
            found = [model.predict(t) for t in common.texts_of(block)]
            yield pa.record_batch([*[block.column(c) for c in kept], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*kept, "lang_pred", "score"])

    return common.map_arrow(docs, predicted, T.StructType(list(docs.schema.fields)).add("lang_pred", "string").add("score", "double"))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(common.crc_bucket(F.col(doc_id), 4) == 2, F.lit(False))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of (doc_id, text, lang), learned from rows that aren't held out."""
    model = fit(docs.where(~held_out()))
    return predict(docs.select(F.col("doc_id"), held_out().alias("held_out"), "text"), model).drop("text")
