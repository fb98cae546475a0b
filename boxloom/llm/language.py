"""Language identification, word first with backoff to character n-grams.

A word that the training sample knows is scored by its log frequency in each language.  An unseen word is
scored by the longest of its character n-grams that are known (from ``MAX_GRAM`` characters down to one).

The model is learned from a bounded sample: per language the ``per_language`` documents with the smallest hash
of their text, not longer than ``max_chars``; of each language the ``top_words`` words and, for each length, the
``top_grams`` n-grams are kept (up to 1,000 documents a language, Spark limits the sample before it is shuffled).  These bounds are parameters and do not follow the input.  Every document is
scored on its whole text.

Defined cases: null text or a text without a letter is ``und`` with score 0; so is every text when nothing
was learned; equal scores go to the alphabetically first language; repeated rows are scored each; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxloom.llm.common import CACHE_ENTRIES, stored

MAX_GRAM = 4
LETTERS = re.compile(r"[^\W\d_]+")
# at most so many words of a document sharpen its score: the votes of a long text are not independent
EVIDENCE_WORDS = 25.0


def training_counts(labelled: DataFrame, per_language: int, max_chars: int, top_words: int, top_grams: int) -> DataFrame:
    """Counts of words (size 0) and n-grams by language, cut to the model's size."""
    by_hash = W.partitionBy("lang").orderBy(F.xxhash64("text"), "text")
    sample = (
        labelled.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.char_length("text") <= max_chars))
        .withColumn("place", F.row_number().over(by_hash)).where(F.col("place") <= per_language)
    )

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, n in Counter(LETTERS.findall(text.lower())).items():
                    counts[lang, word] += n
            keys = list(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], ["lang", "gram", "n"])

    counted = sample.select("text", "lang").mapInArrow(words, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = stored(counted.withColumn("size", F.lit(0)), "language-words")
    padded = F.concat(F.lit(" "), F.col("gram"), F.lit(" "))
    grams = [
        counted.select("lang", F.explode(F.transform(F.sequence(F.lit(1), F.char_length(padded) - (size - 1)), lambda i, s=size: F.substr(padded, i, F.lit(s)))).alias("gram"), "n", F.lit(size).alias("size"))
        .where(F.col("gram") != " ") for size in range(1, MAX_GRAM + 1)]
    every = counted.select("lang", "gram", "n", "size")
    for part in grams:
        every = every.unionByName(part.groupBy("lang", "gram", "size").agg(F.sum("n").alias("n")))
    most = W.partitionBy("lang", "size").orderBy(F.desc("n"), "gram")
    totals = W.partitionBy("lang", "size")
    return (
        every.withColumn("total", F.sum("n").over(totals)).withColumn("place", F.row_number().over(most))
        .where(F.col("place") <= F.when(F.col("size") == 0, top_words).otherwise(top_grams)).select("lang", "gram", "size", "n", "total"))


class Model:
    """Log frequencies by size and text; size 0 holds words."""

    def __init__(self, rows: list):
        self.langs = sorted({r["lang"] for r in rows})
        place = {lang: i for i, lang in enumerate(self.langs)}
        totals = [[1] * len(self.langs) for _ in range(MAX_GRAM + 1)]
        for r in rows:
            totals[r["size"]][place[r["lang"]]] = r["total"]
        floors = [np.log(0.5 / np.array(t, dtype=float)) for t in totals]
        self.tables: list[dict[str, np.ndarray]] = [{} for _ in range(MAX_GRAM + 1)]
        for r in rows:
            held = self.tables[r["size"]]
            if r["gram"] not in held:
                held[r["gram"]] = floors[r["size"]].astype(np.float32)
            held[r["gram"]][place[r["lang"]]] = math.log(r["n"] / r["total"])

    def word(self, word: str) -> np.ndarray:
        """Score of a word in each language: known, or by its longest known n-grams."""
        if word in self.tables[0]:
            return self.tables[0][word]
        padded = f" {word} "
        for size in range(MAX_GRAM, 0, -1):
            held = self.tables[size]
            found = [held[g] for g in (padded[i : i + size] for i in range(len(padded) - size + 1)) if g in held]
            if found:
                return np.add.reduce(found) / len(found)
        return np.zeros(len(self.langs), dtype=np.float32)


class WordScores(dict):
    """Number of each word met, and its scores in that row of ``rows``."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.rows = np.zeros((1024, len(model.langs)), dtype=np.float32)

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        if number == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[number] = self.model.word(word)
        return number


def identify(documents: DataFrame, labelled: DataFrame, per_language: int = 1000, max_chars: int = 20_000, top_words: int = 10_000, top_grams: int = 5_000) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` (0 to 1) of every document, learned from ``labelled`` (text, lang)."""
    model = Model(training_counts(labelled, per_language, max_chars, top_words, top_grams).collect())
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = shared.value, WordScores(shared.value)
        for batch in batches:
            # a full memory of words is emptied between batches, which changes no score
            if len(known) > CACHE_ENTRIES:
                known = WordScores(m)
            langs, scores = [], []
            for text in batch.column(1).to_pylist():
                # runs of number signs like ² or ½ match the pattern and are no letters
                words = [w for w in LETTERS.findall(text.lower()) if w.isalpha() or any(c.isalpha() for c in w)] if text else []
                if not words or not m.langs:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                numbers = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
                sums = known.rows[numbers].sum(axis=0, dtype=np.float64) * min(1.0, EVIDENCE_WORDS / len(words))
                odds = np.exp(sums - sums.max())
                best = int(np.argmax(sums))
                langs.append(m.langs[best])
                scores.append(float(odds[best] / odds.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id bigint, lang_pred string, score double")
