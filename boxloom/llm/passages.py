"""Repeated lines and passages: hashed units, grouped over the whole corpus, earliest occurrence kept.

A line is a paragraph of the text.  Its units are pieces between cut words; a cut word is the one whose hash (of itself
and its two neighbours) is the least within ``RADIUS`` words on either side of the line, so a passage is cut alike
wherever it stands, also inside a longer line.  A unit is normalised (lower-case letters and digits) and hashed to
128 bits.  Units are grouped over all documents: the document with the smallest id keeps a unit, in its first place
there; every other occurrence is flagged.  Flagged neighbours make a run; a run of ``run_words`` words or more is removed,
and of a shorter run the whole lines of ``line_words`` words or more.  What is shorter stays, as such sequences repeat by chance.

A frequent unit costs one row per document and is never gathered: the first document comes from a combinable minimum,
flags from an equi-join whose hot keys adaptive execution splits.

Defined cases: null text stays null and has no unit; a text whose every unit repeats becomes empty; rows that share an id are one document
in rank, so they lose nothing to each other; rows without id are one document that ranks last; an empty table gives an empty result; further
columns are kept, and a column that has the name of a result column is replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import CACHE_ENTRIES, WordHashes, mix, release

RADIUS = 4
TOKEN = re.compile(r"[^\W_]+|\n")
NO_ID = 2**63 - 1
_STEP, _TOP = np.uint64(0x9E3779B97F4A7C15), np.uint64(2**64 - 1)


class LowerHashes(WordHashes):
    """Hash of the lower-case form, looked up by the word as it stands."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        lower = word.lower()
        value = self[word] = WordHashes.__missing__(self, lower) if lower != word else WordHashes.__missing__(self, word)
        return value


def cut(texts: list[str | None], hashes: LowerHashes) -> dict[str, np.ndarray]:
    """Units of some texts: ``document`` number, ``line`` number (over all texts), ``begin`` and ``end`` word (over all texts), two hashes."""
    tokens: list[str] = []
    counts = []
    for text in texts:
        found = TOKEN.findall(text) if text else []
        found.append("\n")
        counts.append(len(found))
        tokens += found
    values = hashes.of(tokens)
    is_word = values != np.uint64(hashes["\n"])
    newlines = np.cumsum(~is_word)
    # lines of the texts before, and words before, of each text
    first_token = np.cumsum([0, *counts[:-1]])
    bases = {"line_base": newlines[first_token - 1] * (first_token > 0), "word_base": (first_token - newlines[first_token - 1]) * (first_token > 0)}
    line = newlines[is_word]
    document = np.repeat(np.arange(len(texts)), counts)[is_word]
    h = values[is_word]
    n = len(h)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return {"document": none, "line": none, "begin": none, "end": none, "h1": none, "h2": none, **bases}
    new_line = np.concatenate([[True], line[1:] != line[:-1]])
    left = np.where(new_line, np.uint64(0), np.concatenate([[np.uint64(0)], h[:-1]]))
    right = np.where(np.concatenate([new_line[1:], [True]]), np.uint64(0), np.concatenate([h[1:], [np.uint64(0)]]))
    around = mix(mix(left) + mix(h + np.uint64(1)) * np.uint64(3) + mix(right + np.uint64(2)) * np.uint64(5))
    least = np.ones(n, dtype=bool)
    for d in range(1, min(RADIUS, n - 1) + 1):
        same = line[d:] == line[:-d]
        least[d:] &= np.where(same, around[d:] < around[:-d], True)
        least[:-d] &= np.where(same, around[:-d] <= around[d:], True)
    starts_unit = new_line.copy()
    starts_unit[1:] |= least[:-1]
    begin = np.flatnonzero(starts_unit)
    end = np.append(begin[1:], n)
    at = (np.arange(n) - np.repeat(begin, end - begin) + 1).astype(np.uint64)
    h1 = np.add.reduceat(mix(h + at * _STEP), begin) ^ (end - begin).astype(np.uint64)
    h2 = np.bitwise_xor.reduceat(mix(mix(h) ^ mix(at + np.uint64(7))), begin)
    return {"document": document[begin], "line": line[begin], "begin": begin, "end": end, "h1": h1.view(np.int64), "h2": h2.view(np.int64), **bases}


def unit_rows(documents: DataFrame) -> DataFrame:
    """One row for each different unit of a document: ``h1``, ``h2``, ``rank`` (its id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        hashes = LowerHashes()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            u = cut(batch.column(1).to_pylist(), hashes)
            order = np.lexsort((u["h2"], u["h1"], u["document"]))
            d, a, b = u["document"][order], u["h1"][order], u["h2"][order]
            keep = np.ones(len(d), dtype=bool)
            keep[1:] = (d[1:] != d[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(ids[d[keep]], pa.int64())], ["h1", "h2", "rank"])

    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("rank"), "text").mapInArrow(run, "h1 bigint, h2 bigint, rank bigint")


def flagged_units(documents: DataFrame) -> DataFrame:
    """Per document the units that an earlier document holds: ``rank``, ``units`` (their first hash)."""
    first = unit_rows(documents).groupBy("h1", "h2").agg(F.min("rank").alias("first"), F.max("rank").alias("last")).where(F.col("first") < F.col("last"))
    rows = unit_rows(documents).join(first.select(F.col("h1").alias("a"), F.col("h2").alias("b"), "first"), (F.col("h1") == F.col("a")) & (F.col("h2") == F.col("b")) & (F.col("rank") != F.col("first")))
    return rows.groupBy(F.col("rank").alias("flag_rank")).agg(F.collect_list("h1").alias("flag_units"))


def flags(u: dict[str, np.ndarray], elsewhere: list[list[int] | None]) -> np.ndarray:
    """Units that an earlier document holds (``elsewhere``, by text) or that stand earlier in their own text."""
    order = np.lexsort((u["h2"], u["h1"], u["document"]))
    d, a, b = u["document"][order], u["h1"][order], u["h2"][order]
    flagged = np.zeros(len(order), dtype=bool)
    flagged[order[1:]] = (d[1:] == d[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    edges = np.searchsorted(u["document"], np.arange(len(elsewhere) + 1))
    for number, held in enumerate(elsewhere):
        if held:
            part = slice(edges[number], edges[number + 1])
            flagged[part] |= np.isin(u["h1"][part], np.array(held, dtype=np.int64))
    return flagged


def with_removals(u: dict[str, np.ndarray], flagged: np.ndarray, run_words: int, line_words: int) -> np.ndarray:
    """Numbers of the texts that have a run or a whole line to remove."""
    if not flagged.any():
        return np.zeros(0, dtype=np.int64)
    words = (u["end"] - u["begin"]) * flagged
    new_run = np.ones(len(flagged), dtype=bool)
    new_run[1:] = (flagged[1:] != flagged[:-1]) | (u["document"][1:] != u["document"][:-1])
    new_line = np.ones(len(flagged), dtype=bool)
    new_line[1:] = u["line"][1:] != u["line"][:-1]
    runs, lines = np.flatnonzero(new_run), np.flatnonzero(new_line)
    long_runs = runs[np.add.reduceat(words, runs) >= run_words]
    whole_lines = lines[np.logical_and.reduceat(flagged, lines) & (np.add.reduceat(words, lines) >= line_words)]
    return np.unique(u["document"][np.concatenate([long_runs, whole_lines])])


def removals(text: str, begin: list[int], end: list[int], line: list[int], flagged: list[bool], run_words: int, line_words: int) -> list[tuple[int, int]]:
    """Ranges of code points to remove from a text, by its units (word numbers, line numbers, flags)."""
    spans, bounds, line_start = [], {}, 0
    number = 0
    for m in TOKEN.finditer(text):
        if m[0] == "\n":
            bounds[number] = (line_start, m.end())
            number, line_start = number + 1, m.end()
        else:
            spans.append(m.span())
    bounds[number] = (line_start, len(text))
    units_of_line: dict[int, int] = {}
    for x in line:
        units_of_line[x] = units_of_line.get(x, 0) + 1
    ranges: list[tuple[int, int]] = []

    def drop(first: int, last: int) -> None:
        """Units first..last of one line."""
        x = line[first]
        if last - first + 1 == units_of_line[x]:
            ranges.append(bounds[x])
        else:
            ranges.append((spans[begin[first]][0], spans[end[last]][0] if last + 1 < len(line) and line[last + 1] == x else spans[end[last] - 1][1]))

    i = 0
    while i < len(flagged):
        if not flagged[i]:
            i += 1
            continue
        j = i
        while j + 1 < len(flagged) and flagged[j + 1]:
            j += 1
        whole = end[j] - begin[i] >= run_words
        k = i
        while k <= j:
            last = k
            while last < j and line[last + 1] == line[k]:
                last += 1
            if whole or (last - k + 1 == units_of_line[line[k]] and end[last] - begin[k] >= line_words):
                drop(k, last)
            k = last + 1
        i = j + 1
    merged: list[tuple[int, int]] = []
    for a, b in ranges:
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def remove_repeats(documents: DataFrame, run_words: int = 15, line_words: int = 6) -> DataFrame:
    """Documents with repeated lines and passages removed.

    Every column is kept; ``text`` is what stays, ``removed`` lists the removed ranges as (start, end) code points of the
    original text and ``n_removed`` counts their code points.
    """
    kept = [c for c in documents.columns if c not in ("removed", "n_removed")]
    held = flagged_units(documents)
    left = documents.select(*kept, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("__rank"))
    joined = left.join(held, F.col("__rank") == F.col("flag_rank"), "left").drop("__rank", "flag_rank")
    at = joined.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = LowerHashes()
        for batch in batches:
            texts, spans, sizes = [], [], []
            whole, elsewhere = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            u = cut(whole, hashes)
            flagged = flags(u, elsewhere)
            touched = set(with_removals(u, flagged, run_words, line_words).tolist())
            edges = np.searchsorted(u["document"], np.arange(len(whole) + 1))
            for number, text in enumerate(whole):
                found = []
                if number in touched:
                    part = slice(edges[number], edges[number + 1])
                    begin, end = (u[k][part] - u["word_base"][number] for k in ("begin", "end"))
                    found = removals(text, begin.tolist(), end.tolist(), (u["line"][part] - u["line_base"][number]).tolist(), flagged[part].tolist(), run_words, line_words)
                if found:
                    ends = [0, *(x for r in found for x in r), len(text)]
                    text = "".join(text[ends[i] : ends[i + 1]] for i in range(0, len(ends), 2))
                texts.append(text)
                spans.append([{"start": a, "end": b} for a, b in found])
                sizes.append(sum(b - a for a, b in found))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns[at] = pa.array(texts, pa.string())
            names = [batch.schema.names[i] for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(sizes, pa.int64())], [*names, "removed", "n_removed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:-1])
    return joined.mapInArrow(run, f"{schema}, removed array<struct<start:int,end:int>>, n_removed bigint")
