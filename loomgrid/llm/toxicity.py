"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features are densities of a lexicon learned from labelled texts (whole words, and the openings of words, so that inflected
and compounded forms are found), nearness of its words to the second person, and rates of capitals, punctuation and
obfuscation. Labelled documents are dealt into three parts by a hash of their id. For fitting, a labelled document's features use a lexicon learned
without its part, and calibration uses margins of trees grown without its part, so neither sees its own labels. Scores of all documents, labelled
or not, come from features by the one lexicon learned on all parts, so they depend on the text alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.boost import Isotonic, Trees, fit_isotonic, fit_trees
from loomgrid.llm.common import fold, materialize, text_batches
from loomgrid.llm.labelled import even_weights, training_labels
from loomgrid.llm.quality_model import matrix
from loomgrid.llm.text_stats import byte_classes

FOLDS, HELD_FOLD = 4, 2
#: Labelled rows used at most about, and entries of the lexicon at most.
TRAIN_ROWS, MAX_LEXICON = 18_000, 3_000
#: An entry must stand in so many labelled toxic texts, and be this many times as frequent in them (with one added to either count).
MIN_TEXTS, MIN_RATIO = 3, 6.0
THRESHOLD = 0.3
#: Openings of words that count as entries, in bytes.
OPENINGS = (4, 5, 6)
#: Words between a lexicon word and the second person that count as near.
NEAR = 5
#: Second person in the four languages of the corpus.
SECOND_PERSON = frozenset(w.encode() for w in "you your yours yourself du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split())
#: Insults that count as entries from the start, at the weight of an entry e^3 times as frequent in toxic texts.
SEED_WORDS = tuple(w.encode() for w in "idiot idiots stupid moron morons dumb loser losers scum trash pathetic worthless disgusting fool jerk ugly filthy creep".split())
SEED_WEIGHT = 3.0
PARTS = 3
#: Marks stripped from the ends of words, and symbols read as the letters they stand for.
MARKS = b".,;:!?\"'()[]{}<>*&%$#|~_-"
DISGUISE = bytes.maketrans(b"013457@$!", b"oieastasi")
FEATURES = (
    "log_words", "strong_density", "strong_any", "weak_density", "best_entry", "sum_entries", "distinct_hits", "second_person", "near_second_person", "capitals", "capital_words",
    "exclaims", "marks", "symbols", "obfuscated", "disguised_hits", "last_hit",
)


class Lexicon(dict):
    """Weight of each word, looked up once and kept; `entries` holds whole words, and openings as (length, bytes)."""

    LIMIT = 200_000

    def __init__(self, words: dict[bytes, float], openings: dict[bytes, float]) -> None:
        super().__init__()
        self.words, self.openings = words, openings

    def __missing__(self, word: bytes) -> float:
        if len(self) > self.LIMIT:
            self.clear()
        bare = word.strip(MARKS)
        found = max([self.words.get(bare, 0.0), *(self.openings.get(bare[:k], 0.0) for k in OPENINGS if len(bare) > k)])
        self[word] = found
        return found

    def __reduce__(self):
        return Lexicon, (self.words, self.openings)


def features(data: bytes, lexicon: Lexicon) -> list[float]:
    """The numbers named in FEATURES, from a whole text; all zero for an empty one."""
    words = data.lower().split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    classes = byte_classes(data)
    per = np.bincount(classes, minlength=10).tolist()
    weights = [lexicon[w] for w in words]
    hits = [i for i, w in enumerate(weights) if w > 0]
    strong = [i for i in hits if weights[i] >= 3.0]
    you = near = 0
    people = [i for i, w in enumerate(words) if w in SECOND_PERSON] if hits else []
    you = len(people)
    if people and hits:
        gaps = np.searchsorted(people, hits)
        around = np.array([-(10**9), *people, 10**9])
        near = int((np.minimum(np.array(hits) - around[gaps], around[gaps + 1] - np.array(hits)) <= NEAR).sum())
    letters = (classes == 1) | (classes == 2)
    middle = ((classes == 3) | (classes == 7))[1:-1]
    odd = letters[:-2] & middle & letters[2:] if len(classes) > 2 else np.zeros(0, bool)
    disguised = 0
    if odd.any():
        disguised = sum(lexicon[w.strip(MARKS).translate(DISGUISE)] > 0 and not lexicon[w] for w in words if not w.isalpha())
    return [
        float(np.log1p(n)), len(strong) / n, float(len(strong)), len(hits) / n, max(weights), sum(weights) / n, float(len({words[i] for i in hits})), you / n, float(near), per[2] / len(data), sum(map(bytes.isupper, data.split())) / n,
        data.count(b"!") / n, (per[5] + per[6]) / n, per[7] / n, int(odd.sum()) / n, float(disguised), hits[-1] / n if hits else 0.0,
    ]


def part_of(doc_id: str) -> Column:
    """The part that a labelled document falls into."""
    return F.pmod(F.xxhash64(F.lit("part"), doc_id), F.lit(PARTS)).cast("int")


def learn_lexicons(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> list[Lexicon]:
    """Lexicons learned without the part 0, 1, ..., and last one learned on all parts.

    Entries are words and openings that stand in far more toxic than other labelled texts, the most telling `MAX_LEXICON` of them.
    Texts are counted where they lie and the counts are summed by entry; only the entries kept come to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text, label, part in zip(batch["x"], batch["label"].to_pylist(), batch["part"].to_pylist(), strict=True):
                bare = {w.strip(MARKS) for w in (text.as_py() or "").encode().lower().split()}
                seen.update((b"w" + w, label, part) for w in bare)
                seen.update({(b"o" + w[:k], label, part) for w in bare for k in OPENINGS if len(w) > k})
            columns = list(zip(*seen.keys(), strict=True)) or [(), (), ()]
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.int32()), strict=True)] + [pa.array(list(seen.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["entry", "label", "part", "n"])

    texts = text_batches(docs).select(F.col(id_col).alias("doc_key"), F.col(text_col).alias("x")).join(F.broadcast(sample), F.col("doc_key") == F.col("label_id"))
    texts = texts.groupBy("doc_key").agg(F.min(F.struct("x", "label", "part")).alias("one")).select("one.*")  # an id counts once, by its least text
    sizes = np.zeros((2, PARTS))
    for r in sample.groupBy("label", "part").count().collect():
        sizes[r.label, r.part] = r["count"]
    cells = [F.sum(F.when((F.col("label") == y) & (F.col("part") == p), F.col("n")).otherwise(0)).alias(f"n{y}{p}") for y in (0, 1) for p in range(PARTS)]
    counted = texts.mapInArrow(count, "entry binary, label int, part int, n long").groupBy("entry").agg(*cells)
    toxic, other = (reduce(lambda a, b: a + b, [F.col(f"n{y}{p}") for p in range(PARTS)]) for y in (1, 0))
    ratio = (toxic + 1) / F.lit(sizes[1].sum() + 1.0) / ((other + 1) / F.lit(sizes[0].sum() + 1.0))
    telling = counted.filter(toxic >= MIN_TEXTS).withColumn("ratio", ratio).filter(F.col("ratio") >= MIN_RATIO)
    kept = telling.orderBy(toxic.desc(), F.col("ratio").desc(), "entry").limit(MAX_LEXICON).collect()
    lexicons = []
    for without in (*range(PARTS), None):
        use = [p for p in range(PARTS) if p != without]
        words, openings = dict.fromkeys(SEED_WORDS, SEED_WEIGHT), {}
        for r in kept:
            n = np.array([[r[f"n{y}{p}"] for p in use] for y in (0, 1)]).sum(axis=1)
            times = (n[1] + 1) / (sizes[1][use].sum() + 1) / ((n[0] + 1) / (sizes[0][use].sum() + 1))
            if n[1] >= MIN_TEXTS - 1 and times >= MIN_RATIO:
                (words if bytes(r.entry)[:1] == b"w" else openings)[bytes(r.entry)[1:]] = float(np.log(times))
        lexicons.append(Lexicon(words, openings))
    return lexicons


def document_features(docs: DataFrame, sample: DataFrame, lexicons: list[Lexicon], id_col: str, text_col: str) -> DataFrame:
    """(doc_key, label_part, label, weight, stats, own) for every row: `stats` by the lexicon of all parts; for a row of the sample also `own`, by the lexicon without its part."""
    held = docs.sparkSession.sparkContext.broadcast(lexicons)
    width = len(FEATURES)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch["label_part"].to_pylist()
            rows, own = np.zeros((batch.num_rows, width), np.float32), []
            for i, (x, part) in enumerate(zip(batch["x"], parts, strict=True)):
                data = (x.as_py() or "").encode()
                rows[i] = features(data, held.value[PARTS])
                own.append(None if part is None else np.array(features(data, held.value[part]), np.float32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * width, pa.int32()), pa.array(rows.ravel()))
            arrays = [batch["doc_key"], batch["label_part"], batch["label"], batch["weight"], lists, pa.array(own, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_key", "label_part", "label", "weight", "stats", "own"])

    narrow = docs.select(F.col(id_col).alias("doc_key"), F.col(text_col).alias("x"))
    marked = narrow.join(F.broadcast(sample.select("label_id", "label", "weight", F.col("part").alias("label_part"))), F.col("doc_key") == F.col("label_id"), "left").select("doc_key", "label_part", "label", "weight", "x")
    return marked.mapInArrow(measure, f"doc_key {narrow.schema['doc_key'].dataType.simpleString()}, label_part int, label int, weight double, stats array<float>, own array<float>")


class Model(NamedTuple):
    trees: Trees
    calibration: Isotonic

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.calibration(self.trees.margin(x))


def fit(stats: DataFrame) -> Model:
    """Trees on the whole sample, calibrated on the margins of trees grown without each row's part. The sample is bounded by `TRAIN_ROWS`, with one row
    (the least) for each id, and its rows are weighted back to the labels' natural rates."""
    once = stats.filter("label is not null").groupBy("doc_key").agg(F.min(F.struct("own", "label_part", "label", "weight")).alias("one"))
    rows = once.select("doc_key", "one.*").collect()
    rows.sort(key=lambda r: r.doc_key)
    x = np.array([r.own for r in rows], np.float32).reshape(len(rows), len(FEATURES))
    y, part = np.array([r.label for r in rows], float), np.array([r.label_part for r in rows], int)
    weight = even_weights([r.weight for r in rows])
    margin = np.zeros(len(y))
    for p in range(PARTS):
        if (part == p).any():
            margin[part == p] = fit_trees(x[part != p], y[part != p], weight[part != p], trees=40).margin(x[part == p])
    return Model(fit_trees(x, y, weight, trees=40), fit_isotonic(margin, y, weight))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per row of `docs`: id, held_out, score, predicted.

    Features are taken once from the whole texts into a scratch table. A null text counts as empty; empty texts are scored by their
    all-zero features; a null id is never held out and never trained on; repeated rows score alike; an empty table gives an empty result;
    without labels every score is one half. Other columns are not read.
    """
    sample = training_labels(labels, label_col, id_col, FOLDS, HELD_FOLD, TRAIN_ROWS)
    sample = materialize(sample.withColumn("part", part_of("label_id")))
    lexicons = learn_lexicons(docs, sample, id_col, text_col)
    stats = materialize(document_features(docs, sample, lexicons, id_col, text_col))
    model = docs.sparkSession.sparkContext.broadcast(fit(stats))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.value.score(matrix(batch["stats"], len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch["doc_key"], batch["held_out"], pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_key", "held_out", "score", "predicted"])

    keyed = stats.select("doc_key", F.coalesce(fold("doc_key", FOLDS) == HELD_FOLD, F.lit(False)).alias("held_out"), "stats")
    scored = keyed.mapInArrow(apply, f"doc_key {keyed.schema['doc_key'].dataType.simpleString()}, held_out boolean, score double, predicted int")
    return scored.withColumnRenamed("doc_key", id_col)
