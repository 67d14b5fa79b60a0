"""Language identification by nearest centroids.

A text becomes a vector of hashed character n-grams of its letters, weighted by
TF-IDF and of length one. Each language has several centroids, clusters of its
training texts, because texts of one language come in kinds. The language is that
of the centroid with the largest cosine; a text farther from it than nearly all
training texts of that centroid is marked as rejected.

The classifier is fitted on a bounded sample: the training rows with the smallest
hash, the same number for each language. Prediction reads every whole text.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urltriage.llm.common import col, stored

#: Hash space of the n-grams.
DIMENSIONS = 1 << 13
#: Characters of a text that are counted together.
SLAB_CHARS = 1 << 20
UNDETERMINED = "und"
#: Multipliers of the hash of an n-gram.
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


@dataclass(frozen=True)
class Sample:
    #: Training texts of each language, and most languages, the frequent ones first.
    texts: int = 400
    languages: int = 256
    #: Clusters of a language.
    centroids: int = 4
    rounds: int = 12
    #: Share of the training texts of a centroid that lie farther away than its limit.
    outside: float = 0.005


@functools.cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter or a mark on one."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)])


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def count_ngrams(text: str) -> np.ndarray:
    """Counts of hashed 1-, 2- and 3-grams; each stretch without letters is one space."""
    counts = np.zeros(DIMENSIONS, dtype=np.int64)
    for begin in range(0, len(text), SLAB_CHARS):
        # Two characters of overlap keep the n-grams across slabs.
        slab = text[max(0, begin - 2) : begin + SLAB_CHARS].lower()
        codes = np.frombuffer(f" {slab} ".encode("utf-32-le", "replace"), dtype=np.uint32)
        codes = np.where(_letters()[codes], codes, np.uint32(32))
        codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
        code = codes * _MIX[0]
        for n in (1, 2, 3):
            if n > 1:
                code = (code[:-1] ^ (code[:-1] >> np.uint32(15))) * _MIX[1] + codes[n - 1 :] * _MIX[n - 1]
            mixed = (code ^ (code >> np.uint32(16))) * _MIX[2]
            counts += np.bincount(mixed >> np.uint32(33 - DIMENSIONS.bit_length()), minlength=DIMENSIONS)
    return counts


def unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF vectors of length one."""
    weighted = np.log1p(counts) * idf
    length = np.linalg.norm(weighted, axis=-1, keepdims=True)
    return weighted / np.where(length > 0, length, 1)


def clusters(vectors: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Centroids of length one by spherical k-means; the first ones lie far from each other."""
    chosen = [vectors.mean(axis=0)]
    for _ in range(min(k, len(vectors)) - 1):
        nearest = np.max([vectors @ (c / (np.linalg.norm(c) or 1)) for c in chosen], axis=0)
        chosen.append(vectors[int(np.argmin(nearest))])
    centres = np.array(chosen)
    for _ in range(rounds):
        of = np.argmax(vectors @ centres.T, axis=1)
        centres = np.array([vectors[of == j].mean(axis=0) if (of == j).any() else centres[j] for j in range(len(centres))])
        length = np.linalg.norm(centres, axis=1, keepdims=True)
        centres = centres / np.where(length > 0, length, 1)
    return centres


@dataclass(frozen=True)
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    limits: np.ndarray  # least cosine of a text that is not rejected
    idf: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine (0 to 1) and whether the text is rejected."""
        if not len(self.languages) or not has_letter(text):
            return UNDETERMINED, 0.0, True
        cosines = self.centroids @ unit(count_ngrams(text), self.idf)
        best = int(np.argmax(cosines))
        cosine = float(min(1.0, max(0.0, cosines[best])))
        return self.languages[best], cosine, bool(cosine < self.limits[best])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: Sample = Sample()) -> Model:
    """Centroids learned from the rows of ``docs`` with text and language."""
    source = docs.select(
        col(id_col).alias("doc_id"), col(text_col).alias("text"), col(lang_col).alias("lang")
    ).where("text is not null and lang is not null")
    counted = source.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample.languages).collect()
    if not counted:
        return Model([], np.zeros((0, DIMENSIONS)), np.zeros(0), np.zeros(DIMENSIONS))
    sizes = F.create_map(*(x for r in counted for x in (F.lit(r["lang"]), F.lit(float(r["count"])))))
    # About the rank of a row within its language, without a window over a language.
    place = (F.xxhash64("doc_id").cast("double") / 2.0**64 + 0.5) * F.col("size")
    chosen = (
        source.withColumn("size", F.element_at(sizes, F.col("lang")))
        .where("size is not null")
        .withColumn("place", place)
        .where(F.col("place") < 2 * sample.texts)
        .orderBy("place", "lang", "doc_id")
        .limit(sample.texts * len(counted))
        .select("lang", "text")
    )

    def train(frames):
        frames = [f for f in frames if len(f)]
        if not frames:
            return
        rows = pd.concat(frames)
        rows = rows[rows["text"].map(has_letter)].sort_values(["lang", "text"])
        if not len(rows):
            return
        counts = np.array([count_ngrams(t) for t in rows["text"]])
        idf = np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 1
        vectors = unit(counts, idf)
        out = [{"lang": "", "limit": 0.0, "vector": idf.astype(np.float64).tobytes()}]
        langs = rows["lang"].to_numpy()
        for lang in sorted(set(langs)):
            own = vectors[langs == lang]
            centres = clusters(own, sample.centroids, sample.rounds)
            cosines = own @ centres.T
            of = np.argmax(cosines, axis=1)
            for j, centre in enumerate(centres):
                near = cosines[of == j, j]
                limit = float(np.quantile(near, sample.outside)) if len(near) else 1.0
                out.append({"lang": lang, "limit": limit, "vector": centre.astype(np.float64).tobytes()})
        yield pd.DataFrame(out)

    learned = stored(
        chosen.repartition(1).mapInPandas(train, "lang string, limit double, vector binary"), "language-model"
    ).collect()
    idf = [np.frombuffer(r["vector"]) for r in learned if r["lang"] == ""]
    rows = sorted((r["lang"], r["limit"], bytes(r["vector"])) for r in learned if r["lang"])
    if not rows:
        return Model([], np.zeros((0, DIMENSIONS)), np.zeros(0), np.zeros(DIMENSIONS))
    return Model(
        [r[0] for r in rows], np.array([np.frombuffer(r[2]) for r in rows]), np.array([r[1] for r in rows]), idf[0]
    )


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score``, ``rejected`` for every row and whole text."""
    source = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [model.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                    pa.array([f[2] for f in found], pa.bool_()),
                ],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    return source.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample: Sample = Sample(),
) -> DataFrame:
    """Languages of all documents, learned from two thirds of them.

    A document is held out of training if the CRC-32 of its id as text leaves 1
    modulo 3. Columns: ``doc_id``, ``held_out``, ``lang_pred``, ``score``,
    ``rejected``. Null texts and those without a letter are ``und`` with score 0, and
    so are all if nothing can be learned. Documents with a null id are neither held
    out nor learned from. Repeated rows stay. An empty table gives an empty result.
    """
    held_out = F.crc32(col(id_col).cast("string")) % 3 == 1
    model = fit(docs.where(~held_out), id_col, text_col, lang_col, sample)
    return predict(docs, model, id_col, text_col).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
        "rejected",
    )
