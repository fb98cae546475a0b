"""Toxicity by the nearest labelled examples under TF-IDF cosine over all terms of the examples.

Examples are a bounded sample of labelled rows: of each class the ``per_class`` rows with the smallest hash of
their id.  Terms are words, beginnings of words (``PREFIXES`` characters, for inflected forms), marks for a term that
a text repeats, and marks for the share of capitals and of words said twice running.  Every term of every example is
indexed; a text with one known word has neighbours.  Weights are (1 + log tf) * idf * relevance.  Relevance is
``FLOOR`` for a term that does not depend on the label and grows with the square of its G statistic up to 1 at
``FULL_G``; no term has weight 0, so all count in the products and in the norm.  Plain TF-IDF (relevance 1 for all)
follows a text's subject, not its tone.

Terms are held by 64-bit hash.  Examples are ordered by their strongest term and dealt to blocks; each of the longest
lists has its largest weight in every block.  A text's bound in a block is the sum over these maxima plus the largest
exact sum over the short lists, for which maxima would be no shorter than the lists.  Blocks are opened by
falling bounds: first the ``FIRST_BLOCKS`` best ones, then those whose bound reaches the last of the k cosines found so far;
no other block can hold a nearer example, so the nearest examples are the exact ones.  The classifier is
fitted in one task over the bounded sample and lies in the shared folder; the driver sees its path only.  Neighbours vote with their
cosine, beside ``PRIOR`` votes for the class shares; the share of toxic votes is calibrated by a monotone fit on leave-one-out scores of the examples, weighted back
to the class shares of all labelled rows.  A text without a known term has no neighbour and gets the toxic share of such
examples.

Defined cases: null text is empty; labels that are null or conflict count as toxic if any says 1 (null only: unlabelled);
without labelled rows every score is 0; ties in cosine go to the smaller example id; repeated rows are scored each; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import operator
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import CACHE_ENTRIES, file_system, fresh_folder, mix, plain_words, release, resident

# texts that are scored together, examples of a block, blocks opened before any bound is known
TEXTS, BLOCK, FIRST_BLOCKS = 64, 16, 8
PREFIXES = range(5, 11)
REPEATED = (2, 4)
# shares from which a text is marked, and the words from which shares are asked for
CAPITALS, TWICE, LEAST_WORDS = (0.25, 0.5, 0.75, 0.9), (0.1, 0.3, 0.5), 5
FLOOR, FULL_G = 0.02, 24.0
COMMON_TERMS = 1024
# votes for the class shares, so that faint likeness alone decides nothing
PRIOR = 1.0
NEIGHBOURS = 15
DECISION = 0.3
PIECE_BYTES = 1 << 20


def terms_of(word: str) -> list[str]:
    """The word and its beginnings."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)]


def _hash(term: str) -> int:
    return xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"))


def term_hashes(word: str) -> list[int]:
    """Hashes of ``terms_of`` a word."""
    if not word.isascii():
        return [_hash(t) for t in terms_of(word)]
    raw, digest = word.encode(), xxhash.xxh64_intdigest
    return [digest(raw), *[digest(raw[:n] + b"*") for n in PREFIXES[: max(0, len(raw) - PREFIXES[0] + 1)]]]


def _repeat_hashes(hashes: np.ndarray, least: int) -> np.ndarray:
    """Hashes of the marks for terms that a text repeats."""
    return mix(hashes + np.uint64(least))


def _marks(text: str, words: list[str]) -> list[str]:
    """Marks of the share of capitals and of words that repeat the one before."""
    if len(words) < LEAST_WORDS:
        return []
    lower, letters = text.lower(), sum(map(len, words))
    if len(lower) == len(text):
        capitals = int((np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) != np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)).sum())
    else:
        capitals = sum(map(str.isupper, text))
    twice = sum(map(operator.eq, words, words[1:]))
    return [f"# capitals {s}" for s in CAPITALS if capitals >= s * letters] + [f"# twice {s}" for s in TWICE if twice >= s * len(words)]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of their counts."""
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, counts, len(keys)).astype(np.int64)


def term_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of all terms of a text."""
    words = plain_words(text)
    pairs = [(h, n) for word, n in Counter(words).items() for h in term_hashes(word)]
    keys, counts = _summed(np.array([h for h, _ in pairs], np.uint64), np.array([n for _, n in pairs], np.int64))
    marks = [np.array([_hash(m) for m in _marks(text, words)] if words else [], np.uint64)]
    marks += [_repeat_hashes(keys[counts >= least], least) for least in REPEATED]
    more = np.concatenate(marks)
    return np.concatenate([keys, more]), np.concatenate([counts, np.ones(len(more), np.int64)])


def _sample(documents: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """Examples (id, label, hashes and counts of terms) and the number of labelled rows of each class."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    sizes = {int(r["label"]): int(r["count"]) for r in known.groupBy("label").count().collect()}
    picked = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            found = [term_counts(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([k.astype("<u8").tobytes() for k, _ in found], pa.binary()), pa.array([n.astype("<u4").tobytes() for _, n in found], pa.binary())],
                ["doc_id", "label", "terms", "counts"])

    # the sample is at most 2 * per_class ids, so its broadcast is bounded
    texts = documents.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(picked), F.col("id") == F.col("doc_id"))
    rows = texts.groupBy("doc_id").agg(F.max("label").cast("int").alias("label"), F.min("text").alias("text"))
    return rows.mapInArrow(counted, "doc_id bigint, label int, terms binary, counts binary"), sizes


def _relevance(toxic_df: np.ndarray, df: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Weight of each term by the G statistic of its 2 x 2 table, ``FLOOR`` at least."""
    if not toxic or not clean:
        return np.ones(len(df))
    part = lambda o, e: np.where(o > 0, o * np.log(np.maximum(o, 1) / e), 0.0)
    a, b, both = toxic_df, df - toxic_df, toxic + clean
    rest = np.maximum(both - df, 1e-9)
    g = 2 * (part(a, df * toxic / both) + part(b, df * clean / both) + part(toxic - a, rest * toxic / both) + part(clean - b, rest * clean / both))
    return FLOOR + (1 - FLOOR) * np.minimum(1.0, g / FULL_G) ** 2


class Index:
    """All terms of the examples with their postings; ``vectors`` are the examples' term numbers and counts."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, weights: np.ndarray, hashes: np.ndarray, idf: np.ndarray, terms: np.ndarray, places: np.ndarray, counts: np.ndarray):
        self.ids, self.labels, self.votes = ids, labels, weights
        self.share = float((labels * weights).sum() / weights.sum()) if len(ids) else 0.0
        self.hashes, self.idf = hashes, idf
        self.marks = [(least, self.numbers(_repeat_hashes(hashes, least)).astype(np.int32)) for least in REPEATED]
        # a term's postings lie side by side, in example order
        raw = (1 + np.log(counts)) * idf.astype(np.float32)[terms]
        if len(ids):  # an example's terms lie side by side
            raw /= np.sqrt(np.add.reduceat(raw * raw, np.searchsorted(places, np.arange(len(ids), dtype=np.int32)), dtype=np.float64)).astype(np.float32)[places]
        order = np.argsort(terms, kind="stable")
        self.places, self.weights = places[order].astype(np.int32), raw[order]
        del raw, order
        df = np.bincount(terms, minlength=len(hashes))
        self.begin = np.concatenate([[0], np.cumsum(df)])
        common = np.argsort(-df, kind="stable")[:COMMON_TERMS]
        self.row = np.full(len(hashes), -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.common, self.blocks, self.maxima = common, None, None
        self.known: dict[str, bytes] = {}
        self.opened = self.bounded = 0

    def __getstate__(self) -> dict:
        return self.__dict__ | {"blocks": None, "maxima": None, "known": {}}

    @property
    def postings(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Terms, places in the block and weights of each block of examples."""
        terms = np.repeat(np.arange(len(self.hashes)), np.diff(self.begin))
        for b in range(-(-len(self.ids) // BLOCK)):
            held = self.places // BLOCK == b
            yield terms[held], self.places[held] % BLOCK, self.weights[held].astype(np.float64)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Term numbers, -1 for unknown terms."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def learn(self, words: set[str]) -> None:
        """Remember the term numbers of words."""
        if len(self.known) + len(words) > CACHE_ENTRIES // 2:
            self.known.clear()
        words = [w for w in words if w not in self.known]
        found = [term_hashes(w) for w in words]
        numbers = self.numbers(np.array([h for f in found for h in f], np.uint64)).astype(np.int32)
        ends = np.cumsum([0] + [4 * len(f) for f in found]) - 4 * np.cumsum(np.concatenate([[0], numbers < 0]))[np.cumsum([0] + [len(f) for f in found])]
        packed = numbers[numbers >= 0].tobytes()
        for word, a, b in zip(words, ends.tolist(), ends[1:].tolist()):
            self.known[word] = packed[a:b]

    def vectors(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Numbers of the known terms of each text and their weights, of length 1."""
        split = [plain_words(t) for t in texts]
        counted = [Counter(words) for words in split]
        self.learn({*(w for c in counted for w in c)})
        result = []
        for text, words, count in zip(texts, split, counted):
            of = [self.known[word] for word in count]
            times = np.repeat(np.fromiter(count.values(), np.int64, len(of)), np.fromiter(map(len, of), np.int64, len(of)) // 4)
            keys, counts = _summed(np.frombuffer(b"".join(of), np.int32), times)
            more = [self.numbers(np.array([_hash(m) for m in _marks(text, words)], np.uint64))] if words else []
            more += [marks[keys[counts >= least]] for least, marks in self.marks]
            extra = np.concatenate(more).astype(np.int64)
            extra = extra[extra >= 0]
            result.append(self.weighted(np.concatenate([keys, extra]), np.concatenate([counts, np.ones(len(extra), np.int64)])))
        return result

    def weighted(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = (1 + np.log(counts)) * self.idf[terms]
        norm = np.sqrt((raw * raw).sum())
        return terms, raw / norm if norm else raw

    def known_terms(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and weights of the known terms of one text."""
        return self.vectors([text])[0]

    def vector(self, known: tuple[np.ndarray, np.ndarray]) -> dict[int, float]:
        return dict(zip(known[0].tolist(), known[1].tolist()))

    def nearest(self, vector: dict[int, float], k: int = NEIGHBOURS, without: int | None = None) -> list[tuple[float, int]]:
        """The k largest cosines and their places, ties to the smaller id; ``without`` is an id left out."""
        return self.nearest_of([(np.array(list(vector), np.int64), np.array(list(vector.values())))], k, [without])[0]

    def nearest_of(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, without: list | None = None) -> list[list[tuple[float, int]]]:
        """``nearest`` for each of some vectors."""
        size, count = len(self.ids), -(-len(self.ids) // BLOCK)
        if not size:
            return [[] for _ in vectors]
        if self.blocks is None:
            # the long lists, block by block, and their maxima
            self.blocks = np.zeros((count, BLOCK, len(self.common)), np.float32)
            for row, term in enumerate(self.common.tolist()):
                held = slice(self.begin[term], self.begin[term + 1])
                self.blocks[self.places[held] // BLOCK, self.places[held] % BLOCK, row] = self.weights[held]
            self.maxima = self.blocks.max(axis=1)
        asked = np.zeros((len(vectors), len(self.common)))
        total = np.zeros((len(vectors), count * BLOCK))
        for i, (terms, values) in enumerate(vectors):
            rows = self.row[terms]
            asked[i, rows[rows >= 0]] = values[rows >= 0]
            terms, values = terms[rows < 0], values[rows < 0]
            lengths = self.begin[terms + 1] - self.begin[terms]
            at = np.repeat(self.begin[terms] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            total[i] = np.bincount(self.places[at], self.weights[at] * np.repeat(values, lengths), count * BLOCK)
        rest = total.copy()
        single = asked.astype(np.float32)
        # single precision finds the candidates; their sums are then made in double precision
        bounds = single @ self.maxima.T + rest.reshape(len(vectors), count, BLOCK).max(axis=2) + 1e-5
        left_out = [np.flatnonzero(self.ids == d) if d is not None else [] for d in without or [None] * len(vectors)]
        seen = np.zeros(bounds.shape, bool)

        def open_blocks(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(axis=0)).tolist():
                texts = np.flatnonzero(wanted[:, b])
                total[texts, b * BLOCK : (b + 1) * BLOCK] += single[texts] @ self.blocks[b].T
            seen[wanted] = True

        def last_of_nearest() -> np.ndarray:
            shown = np.where(np.repeat(seen, BLOCK, axis=1), total, 0.0)
            for i, places in enumerate(left_out):
                shown[i, places] = 0.0
            return np.maximum(0.0, np.partition(shown, -k, axis=1)[:, -k] - 1e-5) if shown.shape[1] > k else np.zeros(len(vectors))

        first = np.zeros(bounds.shape, bool)
        np.put_along_axis(first, np.argpartition(-bounds, min(FIRST_BLOCKS, count) - 1, axis=1)[:, :FIRST_BLOCKS], True, axis=1)
        open_blocks(first)
        open_blocks((bounds >= last_of_nearest()[:, None]) & ~seen)
        self.opened, self.bounded = self.opened + int(seen.sum()), self.bounded + seen.size
        least = last_of_nearest()
        result = []
        for i in range(len(vectors)):
            ready = np.repeat(seen[i], BLOCK)
            ready[left_out[i]] = False
            places = np.flatnonzero(ready & (total[i] >= least[i]) & (total[i] > 0))
            exact = np.round(rest[i, places] + self.blocks[places // BLOCK, places % BLOCK].astype(np.float64) @ asked[i], 12)
            best = sorted((-c, d, p) for c, d, p in zip(exact.tolist(), self.ids[places].tolist(), places.tolist()))[:k]
            result.append([(-c, p) for c, _, p in best if c < 0])
        return result

    def vote(self, found: list[tuple[float, int]]) -> float:
        """Share of toxic votes; cosines are the votes, weighted back to the class shares, beside ``PRIOR`` votes at these shares."""
        cosines, places = np.array([c for c, _ in found]), [p for _, p in found]
        votes = cosines * self.votes[places]
        return float(((votes * self.labels[places]).sum() + PRIOR * self.share) / (votes.sum() + PRIOR))


def _monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted monotone fit: knots and their levels."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for i in order:
        blocks.append([x[i], x[i], y[i] * w[i], w[i]])
        while len(blocks) > 1 and (blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3] or blocks[-2][1] == blocks[-1][0]):
            _, hi, s, n = blocks.pop()
            blocks[-1] = [blocks[-1][0], hi, blocks[-1][2] + s, blocks[-1][3] + n]
    return np.array([(b[0] + b[1]) / 2 for b in blocks]), np.array([b[2] / b[3] for b in blocks])


class Classifier:
    """Index, calibration and the share for texts without a neighbour."""

    def __init__(self, rows: list, sizes: dict[int, int]):
        ids, labels, keys, counts = [], [], [], []
        while rows:  # emptied on the way, so the terms are held once
            doc, label, k, n = rows.pop()
            ids.append(doc)
            labels.append(label)
            keys.append(np.frombuffer(k, "<u8"))
            counts.append(np.frombuffer(n, "<u4"))
        ids, labels, lengths = np.array(ids, np.int64), np.array(labels, np.int64), np.array([len(k) for k in keys], np.int64)
        count = Counter(labels.tolist())
        share = np.array([sizes.get(y, 0) / count[y] for y in labels.tolist()])
        keys = np.concatenate([np.zeros(0, np.uint64), *keys])
        hashes = np.unique(keys)
        terms = np.searchsorted(hashes, keys).astype(np.int32)
        del keys
        counts = np.concatenate([np.zeros(0, np.uint32), *counts]).astype(np.float32)
        # examples without a term are not in the index
        held = np.flatnonzero(lengths)
        places = np.repeat(np.arange(len(held), dtype=np.int32), lengths[held])
        df = np.bincount(terms, minlength=len(hashes))
        relevance = _relevance(np.bincount(terms[(labels[held] == 1)[places]], minlength=len(hashes)), df, count[1], count[0])
        # a term that every example holds keeps a positive weight
        idf = np.log(1 + len(ids) / df) * relevance
        # like examples stand side by side, ordered by their strongest term
        strength = (1 + np.log(counts)) * idf.astype(np.float32)[terms]
        starts = np.cumsum(lengths) - lengths
        strongest = np.lexsort((terms, -strength, places))[starts[held]]
        held = held[np.lexsort((ids[held], -strength[strongest], terms[strongest]))]
        size = lengths[held]
        moved = np.repeat(starts[held] - np.cumsum(size) + size, size) + np.arange(size.sum())
        terms, counts, places = terms[moved], counts[moved], np.repeat(np.arange(len(held), dtype=np.int32), size)
        del strength, strongest, moved
        self.index = Index(ids[held], labels[held].astype(np.float64), share[held], hashes, idf, terms, places, counts)
        none = lengths == 0
        self.without = float((labels * share)[none].sum() / share[none].sum()) if none.any() else 0.0
        ends = np.cumsum(lengths[held])
        xs, at = [], []
        for first in range(0, len(held), TEXTS):
            block = range(first, min(first + TEXTS, len(held)))
            vectors = [self.index.weighted(terms[ends[i] - lengths[held[i]] : ends[i]], counts[ends[i] - lengths[held[i]] : ends[i]]) for i in block]
            for i, found in zip(block, self.index.nearest_of(vectors, without=[int(self.index.ids[i]) for i in block])):
                if found:
                    xs.append(self.index.vote(found))
                    at.append(held[i])
        self.knots, self.levels = _monotone(np.array(xs), labels[at].astype(np.float64), share[at]) if xs else (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def scores(self, texts: list[str | None]) -> Iterator[tuple[float, list]]:
        """Calibrated score and nearest examples of each text."""
        for first in range(0, len(texts), TEXTS):
            for found in self.index.nearest_of(self.index.vectors(texts[first : first + TEXTS])):
                near = [(int(self.index.ids[p]), c, int(self.index.labels[p])) for c, p in found[:3]]
                yield (float(np.interp(self.index.vote(found), self.knots, self.levels)), near) if found else (self.without, [])


class Model:
    """A fitted classifier, stored in pieces in the shared folder; each worker reads it once."""

    def __init__(self, path: str):
        self.path = path

    def load(self) -> Classifier:
        from pyarrow import parquet

        def read() -> Classifier:
            system, path = file_system(self.path)
            pieces = sorted(parquet.read_table(path, filesystem=system).to_pylist(), key=lambda r: r["piece"])
            # without a labelled row there is no piece
            return pickle.loads(b"".join(r["bytes"] for r in pieces)) if pieces else Classifier([], {})

        return resident(("toxicity", self.path), read)


def train(documents: DataFrame, labels: DataFrame, per_class: int = 3000) -> Model:
    """Fit on a bounded sample of the labelled rows, in one task; see the module text for the bounds."""
    examples, sizes = _sample(documents, labels, per_class)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        rows = [list(r) for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns))]
        rows.sort(key=lambda r: -r[0])
        packed = pickle.dumps(Classifier(rows, sizes), protocol=5)
        for i in range(0, len(packed), PIECE_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array([i // PIECE_BYTES], pa.int64()), pa.array([packed[i : i + PIECE_BYTES]], pa.binary())], ["piece", "bytes"])

    path = fresh_folder(documents.sparkSession, "toxicity-model")
    examples.repartition(1).mapInArrow(fit, "piece bigint, bytes binary").write.parquet(path)
    return Model(path)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score``, ``predicted`` and ``evidence`` (nearest examples: id, cosine, label) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
        classifier = model.load()
        for batch in batches:
            results = list(classifier.scores(batch.column(1).to_pylist()))
            evidence = [[{"doc_id": d, "cosine": c, "label": y} for d, c, y in e] for _, e in results]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s for s, _ in results], pa.float64()), pa.array([int(s >= DECISION) for s, _ in results], pa.int32()), pa.array(evidence, kind)],
                ["doc_id", "score", "predicted", "evidence"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, score double, predicted int, evidence array<struct<doc_id:bigint,cosine:double,label:int>>")


def keep_clean(documents: DataFrame, model: Model) -> DataFrame:
    """The documents that the classifier does not call toxic, with all their columns, in one pass without a join."""
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = model.load()
        for batch in batches:
            keep = [s < DECISION for s, _ in classifier.scores(batch.column(at).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
