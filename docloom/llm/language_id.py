"""Language of a text by string kernels.

A text is lowered and cut at all but letters; its n-grams are those of 1 to GRAMS
characters, with a space at both ends of every word. The kernel of two texts is
the number of n-grams that both have (presence, not counts, blended over the
lengths), divided by the root of the product of their own numbers.

Landmarks are labelled texts; the Nyström map of a text is its row of kernel values
with them, times the inverse root of the landmarks' own kernel matrix. Ridge regression
on these features, one language against the rest, gives a weight for each landmark
and language; the ridge is the one with the least leave-one-out error. Texts are
scored by two matrix products a batch: presence by landmarks, and kernel by weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.vocab import by_bytes
from docloom.runtime import ship

GRAMS = 3  # characters of an n-gram, at most; three code points of 21 bits fill a 64-bit number
TRAIN_PER_LANGUAGE = 300  # documents of each language that the weights are fitted on, at most
LANDMARKS_PER_LANGUAGE = 64  # of these, the landmarks
RIDGES = (1e-4, 1e-3, 1e-2, 1e-1, 1.0)
BATCH = 128  # texts of one matrix product
UNKNOWN = "und"


class _Letters:
    """Which code points are letters, made once for each worker."""

    table: np.ndarray | None = None

    @classmethod
    def get(cls) -> np.ndarray:
        if cls.table is None:
            cls.table = np.array([chr(c).isalpha() for c in range(0x110000)])
        return cls.table


def grams(text: str | None) -> np.ndarray:
    """The distinct n-grams of a text as sorted numbers; none without a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _Letters.get()[points]
    if not letter.any():
        return np.zeros(0, np.int64)
    points = np.concatenate([[32], np.where(letter, points, 32), [32]])
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    points = points[keep]
    parts, gram = [points[points != 32]], points
    for n in range(2, GRAMS + 1):
        gram = (gram[:-1] << 21) | points[n - 1 :]
        parts.append(gram[points[1 : len(gram) + 1] != 32] if n == 3 else gram)  # none that spans two words
    found = np.sort(np.concatenate(parts))
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


@dataclass
class Machine:
    """Landmarks and weights."""

    languages: list[str]
    vocabulary: np.ndarray  # n-grams of the landmarks, sorted
    presence: np.ndarray  # n-gram x landmark, 0 or 1
    sizes: np.ndarray  # n-grams of each landmark
    weights: np.ndarray  # landmark x language

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """Kernel values of texts (as sets of n-grams) with the landmarks."""
        at = [np.searchsorted(self.vocabulary, s) for s in sets]
        known = [i[self.vocabulary[np.minimum(i, len(self.vocabulary) - 1)] == s] for i, s in zip(at, sets, strict=True)]
        used, column = np.unique(np.concatenate(known), return_inverse=True)
        x = np.zeros((len(sets), len(used)), np.float32)
        x[np.repeat(np.arange(len(sets)), [len(k) for k in known]), column] = 1
        own = np.array([max(len(s), 1) for s in sets])
        return x @ self.presence[used] / np.sqrt(own[:, None] * self.sizes[None, :])

    def predict(self, sets: list[np.ndarray]) -> tuple[list[str], np.ndarray]:
        """Language and score (0 to 1) of each text; ties go to the language first in order."""
        values = self.kernel(sets) @ self.weights
        best = values.argmax(axis=1)
        score = np.clip((values[np.arange(len(sets)), best] + 1) / 2, 0, 1)
        empty = np.array([not len(s) for s in sets])
        return [UNKNOWN if e else self.languages[i] for i, e in zip(best, empty, strict=True)], np.where(empty, 0.0, score)


def fit(samples: list[tuple[str, np.ndarray]]) -> Machine:
    """A machine from (language, n-grams); the first texts of each language are the landmarks."""
    languages = sorted({name for name, _ in samples})
    taken = dict.fromkeys(languages, 0)
    marks = []
    for i, (name, _) in enumerate(samples):
        if taken[name] < LANDMARKS_PER_LANGUAGE:
            taken[name] += 1
            marks.append(i)
    sets = [samples[i][1] for i in marks]
    vocabulary = np.unique(np.concatenate(sets))
    presence = np.zeros((len(vocabulary), len(marks)), np.float32)
    for j, s in enumerate(sets):
        presence[np.searchsorted(vocabulary, s), j] = 1
    machine = Machine(languages, vocabulary, presence, np.array([len(s) for s in sets]), np.zeros((len(marks), len(languages))))
    value, vector = np.linalg.eigh(machine.kernel(sets).astype(float))
    sound = value > 1e-8 * value.max()
    root = vector[:, sound] / np.sqrt(value[sound])
    mapped = np.concatenate([machine.kernel([s for _, s in samples[i : i + BATCH]]) for i in range(0, len(samples), BATCH)]) @ root
    wanted = np.array([[1.0 if name == x else -1.0 for x in languages] for name, _ in samples])
    balance = np.array([1 / sum(n == name for n, _ in samples) for name, _ in samples])
    balance /= balance.mean()
    square = mapped.T @ (mapped * balance[:, None])
    best = None
    for ridge in RIDGES:
        inverse = np.linalg.inv(square + ridge * np.eye(len(square)))
        w = inverse @ (mapped.T @ (wanted * balance[:, None]))
        leverage = np.einsum("ij,jk,ik->i", mapped, inverse, mapped) * balance
        error = float((((wanted - mapped @ w) / np.maximum(1 - leverage, 1e-6)[:, None]) ** 2 * balance[:, None]).sum())
        if best is None or error < best[0]:
            best = (error, w)
    machine.weights = root @ best[1]
    return machine


def _train(docs: DataFrame, per_language: int) -> Machine | None:
    """Fit on at most ``per_language`` texts of each language, whole; of equal texts one. None if there are none."""
    rated = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r.lang: r.n for r in rated.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return None
    place = F.xxhash64("text")
    # thin out before ranking, so that a language of any size sends a few times per_language rows
    rated = rated.withColumns({"place": place, "share": F.pmod(place, F.lit(1_000_000)) / 1_000_000})
    limit = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 4.0 * per_language / n)))])
    few = rated.where(F.col("share") < F.element_at(limit, F.col("lang"))).dropDuplicates(["lang", "place"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "text"))
    few = few.withColumn("rank", rank).where(F.col("rank") <= per_language).select("lang", "rank", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                found = [grams(t).tobytes() for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("rank"), pa.array(found, pa.binary())], ["lang", "rank", "grams"])

    rows = few.mapInArrow(sets, "lang string, rank int, grams binary").where(F.length("grams") > 0).collect()  # per_language for each language
    if not rows:
        return None
    return fit([(r.lang, np.frombuffer(bytes(r.grams), np.int64)) for r in sorted(rows, key=lambda r: (r["rank"], r.lang))])


def identify_languages(docs: DataFrame, labelled: DataFrame, text: str = "text", key: str = "doc_id", per_language: int = TRAIN_PER_LANGUAGE) -> DataFrame:
    """``key``, ``lang_pred`` and ``score`` (0 to 1) of every whole text.

    ``labelled(text, lang)`` are the texts to learn from, at most ``per_language``
    of each language (null texts and languages are left out). A text that is null
    or has no letter, or any text if nothing could be learned, is ``und`` with
    score 0. Repeated rows and null keys give a row each; other columns are
    ignored. No shuffle of texts but the few that are learned from.
    """
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    machine = _train(labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")), per_language)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for piece in by_bytes(whole, "text"):
                for i in range(0, piece.num_rows, BATCH):
                    batch = piece.slice(i, BATCH)
                    sets = [grams(t) for t in batch.column("text").to_pylist()]
                    names, scores = machine.predict(sets) if machine is not None else ([UNKNOWN] * len(sets), np.zeros(len(sets)))
                    yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["key", "lang_pred", "score"])

    chosen = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(score, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def held_out(doc_id) -> F.Column:
    """A quarter of the documents, by id, that nothing is learned from; a null id isn't in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op13_language_id(spark, sf_dir: str) -> DataFrame:
    """Contract query: the language of every document, learned from three quarters of them; rows with a null id are not learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify_languages(docs, docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
