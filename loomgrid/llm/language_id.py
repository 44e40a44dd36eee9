"""Language identification by a linear-chain conditional random field over words.

The field is trained on a bounded sample of labelled documents: windows of their words, and windows spliced from two languages
so that it learns to switch. Every whole text is then labelled word by word through forward-backward; a document's language is
the one with the largest sum of word probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomgrid.llm.common import fold, text_batches
from loomgrid.llm.crf import CHUNK, Emissions, Model, marginals, marginals_of_long, train

FOLDS, HELD_FOLD = 4, 2
#: Labelled documents that the field is fitted on, at most about, shared evenly by the languages; a language's share is at least about LEAST_DOCS.
TRAIN_DOCS, LEAST_DOCS = 1_600, 16
#: All languages are learned. More values of lang than this are an error, since the field's tables grow with their square.
MAX_LANGUAGES = 200
#: Words in a training window, and windows from one document at most.
WINDOW, WINDOWS = 32, 3
#: Words of a batch worked on at once, and numbers in the matrices of its chunks (languages squared for each), to bound memory.
BATCH_WORDS, BATCH_CELLS = 30_000, 4_000_000
#: Numbers in the scores of a block of a text that is longer than a batch.
BLOCK_CELLS = 1_000_000
UNKNOWN = "und"
_RUN = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    if not text:
        return []
    runs = _RUN.findall(text.lower())
    return runs if text.isascii() else [w for w in runs if w.isalpha() or any(map(str.isalpha, w))]  # a run may be numerals such as U+00B2


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to `WINDOWS` windows of each text, chosen over its whole length by a seed from the text; a short text's words are repeated."""
    for batch in batches:
        keys, langs, windows = [], [], []
        for key, text, lang in zip(batch["k"].to_pylist(), batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True):
            words = words_of(text)
            if words:
                count = -(-len(words) // WINDOW)
                for s in sorted(np.random.default_rng(zlib.crc32(text.encode())).permutation(count)[:WINDOWS].tolist()):
                    window = words[s * WINDOW : (s + 1) * WINDOW]
                    keys.append(key)
                    langs.append(lang)
                    windows.append((window * WINDOW)[:WINDOW])
        yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field("k").type), pa.array(langs, pa.string()), pa.array(windows, pa.list_(pa.string()))], names=["k", "y", "w"])


def _sequences(rows: list[tuple[list[str], int]]) -> list[tuple[list[str], list[int]]]:
    """Every window with its label, and windows spliced from two of different labels."""
    rng = np.random.default_rng(11)
    out = [(w, [y] * WINDOW) for w, y in rows]
    for (a, x), j in zip(rows, rng.permutation(len(rows)), strict=True):
        b, y = rows[j]
        if x != y:
            cut = int(rng.integers(4, WINDOW - 4))
            out.append((a[:cut] + b[cut:], [x] * cut + [y] * (WINDOW - cut)))
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = FOLDS, held_fold: int = HELD_FOLD, limit: int = TRAIN_DOCS) -> Model:
    """The field, from text and lang of documents outside the held-out fold whose lang is not null.

    Which documents are used goes by a hash of the id, with a share for each language that comes from its count; windows of about `limit` texts come to the driver,
    or of `LEAST_DOCS` a language where that is more. Every value of lang is learned; more than `MAX_LANGUAGES` of them raise a ValueError.
    """
    usable = text_batches(docs).select(F.col(id_col).alias("k"), F.col(text_col).alias("x"), F.col(lang_col).alias("y")).filter(F.col("y").isNotNull() & (fold("k", folds) != held_fold))
    counts = usable.groupBy("y").count().orderBy(F.col("count").desc(), "y").limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MAX_LANGUAGES} values, the most languages that can be learned")
    labels = sorted(r.y for r in counts)
    if not labels:
        return train([], [])
    each = max(LEAST_DOCS, limit / len(labels))
    share = F.element_at(F.create_map(*[F.lit(v) for r in counts for v in (r.y, min(1.0, each / r["count"]))]), F.col("y"))
    draw = F.pmod(F.xxhash64(F.lit("language"), "k"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    once = usable.filter(draw < share).groupBy("k").agg(F.min(F.struct("y", "x")).alias("one")).select("k", "one.x", "one.y")  # an id counts once, by its least row
    cut = once.mapInArrow(_windows, f"k {usable.schema['k'].dataType.simpleString()}, y string, w array<string>")
    number = {x: i for i, x in enumerate(labels)}
    rows = sorted((r.k, number[r.y], r.w) for r in cut.collect())
    return train(_sequences([(w, y) for _, y, w in rows]), labels)


def label_words(texts: Iterable[str | None], emissions: Emissions) -> Iterator[tuple[int, int, list[str], np.ndarray]]:
    """(text number, first word, words, probabilities of the labels for each) for texts with words, in bounded batches.

    A text too long for one batch comes in several pieces, one after another and the last first; others come whole.
    """
    numbers: list[int] = []
    words: list[list[str]] = []
    waiting = chunks = 0
    labels = len(emissions.model.labels)
    cells = labels**2

    def flush() -> Iterator[tuple[int, int, list[str], np.ndarray]]:
        if numbers:
            lengths = np.array([len(w) for w in words])
            p = marginals(emissions([w for many in words for w in many]), lengths, emissions.model.transitions)
            yield from zip(numbers, [0] * len(numbers), words, np.split(p, np.cumsum(lengths)[:-1]), strict=True)

    for i, text in enumerate(texts):
        own = words_of(text)
        if len(own) > BATCH_WORDS or -(-len(own) // CHUNK) * cells > BATCH_CELLS:
            block = max(CHUNK, min(BATCH_WORDS, BLOCK_CELLS // labels))
            for at, p in marginals_of_long(lambda a, b, own=own: emissions(own[a:b]), len(own), emissions.model.transitions, block):
                yield i, at, own[at : at + block], p
        elif own:
            if waiting and (waiting + len(own) > BATCH_WORDS or (chunks - len(own) // -CHUNK) * cells > BATCH_CELLS):
                yield from flush()
                numbers, words, waiting, chunks = [], [], 0, 0
            numbers.append(i)
            words.append(own)
            waiting += len(own)
            chunks -= len(own) // -CHUNK
    yield from flush()


def _judge(batch: pa.RecordBatch, column: str, emissions: Emissions) -> tuple[list[str], list[float], list[float]]:
    """For each row its language, that language's mean word probability, and the mean of each word's largest probability."""
    labels = emissions.model.labels
    found, score, sure = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows, [0.0] * batch.num_rows
    if labels:
        sums = np.zeros((batch.num_rows, len(labels)))
        clear, count = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
        for i, _, words, p in label_words((x.as_py() for x in batch[column]), emissions):
            sums[i] += p.sum(axis=0)
            clear[i] += p.max(axis=1).sum()
            count[i] += len(words)
        for i in np.flatnonzero(count).tolist():
            mean = sums[i] / count[i]
            found[i], score[i], sure[i] = labels[int(mean.argmax())], float(min(1.0, mean.max())), float(min(1.0, clear[i] / count[i]))
    return found, score, sure


def identify(docs: DataFrame, model: Model, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), certainty: bool = False) -> DataFrame:
    """The columns `carry`, then lid_lang and lid_score: the language of each whole text and its mean word probability.

    With `certainty` also lid_sure, the mean of each word's largest probability: it is high where every word's language is clear, whether
    or not the words share one.

    Null texts and texts without a letter are `und` with score 0. Rows are judged on their own: repeated rows alike, an empty table
    gives an empty result, and without anything to learn from all texts are `und`. Other columns are not read.
    """
    held: Broadcast = docs.sparkSession.sparkContext.broadcast(model)
    column = text_col if text_col in carry else "lid_text"  # carried text goes to Python once
    narrow = text_batches(docs).select(*[F.col(f"`{c}`") for c in carry], *([] if text_col in carry else [F.col(text_col).alias("lid_text")]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions = Emissions(held.value)
        for batch in batches:
            lang, score, sure = _judge(batch, column, emissions)
            arrays, names = [*[batch[c] for c in carry], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*carry, "lid_lang", "lid_score"]
            if certainty:
                arrays, names = [*arrays, pa.array(sure, pa.float64())], [*names, "lid_sure"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    judged = StructType.fromDDL("lid_lang string, lid_score double" + ", lid_sure double" * certainty)
    return narrow.mapInArrow(judge, StructType([*[narrow.schema[c] for c in carry], *judged]))


def spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(span_id, lang, first, last, score): runs of words of one language in every text, runs of letters counted from 0; for code-switched text."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    narrow = text_batches(docs).select(F.col(id_col).alias("span_id"), F.col(text_col).alias("x"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions = Emissions(held.value)
        for batch in batches:
            rows: list[tuple[int, str, int, int, float]] = []
            pieces = label_words((x.as_py() for x in batch["x"]), emissions) if held.value.labels else ()
            for i, own in groupby(pieces, key=lambda piece: piece[0]):
                parts = sorted((at, p.argmax(axis=1), p.max(axis=1)) for _, at, _, p in own)
                best, likely = np.concatenate([x for _, x, _ in parts]), np.concatenate([x for _, _, x in parts])
                edges = np.flatnonzero(np.diff(best)) + 1
                for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(best)], strict=True):
                    rows.append((i, held.value.labels[best[a]], a, b - 1, float(likely[a:b].mean())))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            arrays = [batch["span_id"].take(pa.array(columns[0], pa.int64()))] + [pa.array(c, t) for c, t in zip(columns[1:], (pa.string(), pa.int64(), pa.int64(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["span_id", "lang", "first", "last", "score"])

    return narrow.mapInArrow(cut, f"span_id {narrow.schema['span_id'].dataType.simpleString()}, lang string, first long, last long, score double")
