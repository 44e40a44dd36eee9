"""Toxicity scores against a plain double: the lexicon by sets of words, features word by word, the trees of the score by a search over every split, calibration by means of runs."""

import bisect
import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from loomgrid.llm import toxicity
from loomgrid.llm.boost import fit_trees
from loomgrid.llm.queries import QUERIES
from test_plain_models import SF, SPACE, SYMBOLS, grow, walk

LETTERS = "abcdefghijklmnopqrstuvwxyz"
MARKS, READ_AS = ".,;:!?\"'()[]{}<>*&%$#|~_-", dict(zip("013457@$!", "oieastasi", strict=True))


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def split(text):
    return re.findall(f"[^{SPACE}]+", text or "")


def openings(word):
    data = word.encode()
    return {data[:k] for k in (4, 5, 6) if len(data) > k}


def learn(texts, labels, parts, without):
    """{entry: weight}: words as text, openings as bytes."""
    use = [i for i in texts if parts[i] != without]
    size = [sum(labels[i] == y for i in use) for y in (0, 1)]
    everywhere = [sum(labels[i] == y for i in texts) for y in (0, 1)]
    found = {i: {e for w in {lower(w).strip(MARKS) for w in split(texts[i])} for e in ({w} | openings(w))} for i in texts}
    total = [Counter(e for i in texts if labels[i] == y for e in found[i]) for y in (0, 1)]
    here = [Counter(e for i in use if labels[i] == y for e in found[i]) for y in (0, 1)]
    ratio = lambda n0, n1, s: (n1 + 1) / (s[1] + 1) / ((n0 + 1) / (s[0] + 1))
    telling = [e for e, n in total[1].items() if n >= 3 and ratio(total[0][e], n, everywhere) >= 6]
    assert len(telling) < toxicity.MAX_LEXICON
    out = dict.fromkeys((w.decode() for w in toxicity.SEED_WORDS), 3.0)
    for e in telling:
        if here[1][e] >= 2 and ratio(here[0][e], here[1][e], size) >= 6:
            out[e] = math.log(ratio(here[0][e], here[1][e], size))
    return out


def measure(text, lexicon):
    words = [lower(w) for w in split(text)]
    if not words:
        return [0.0] * 17
    weight = lambda w: max([lexicon.get(w.strip(MARKS), 0.0), *(lexicon.get(o, 0.0) for o in openings(w.strip(MARKS)))])
    n, size, weights = len(words), len(text.encode()), [weight(w) for w in words]
    hits, people = [i for i, w in enumerate(weights) if w > 0], [i for i, w in enumerate(words) if w.encode() in toxicity.SECOND_PERSON]
    near = sum(any(abs(i - j) <= 5 for j in people) for i in hits)
    strong = sum(w >= 3 for w in weights)
    alpha = LETTERS + LETTERS.upper()
    odd = sum(a in alpha and (b in SYMBOLS or "0" <= b <= "9") and c in alpha for a, b, c in zip(text, text[1:], text[2:], strict=False))
    read = lambda w: "".join(READ_AS.get(c, c) for c in w.strip(MARKS))
    ascii_letters = lambda w: all(c in alpha for c in w)
    disguised = sum(not ascii_letters(w) and weight(read(w)) > 0 and not weight(w) for w in words) if odd else 0
    shouted = sum(bool(re.search("[A-Z]", w)) and not re.search("[a-z]", w) for w in split(text))
    count = lambda signs: sum(c in signs for c in text)
    return [
        math.log1p(n), strong / n, strong, len(hits) / n, max(weights), sum(weights) / n, len({words[i] for i in hits}), len(people) / n if hits else 0.0, near, sum("A" <= c <= "Z" for c in text) / size, shouted / n,
        text.count("!") / n, count(".!?,;:'\"-()") / n, count(SYMBOLS) / n, odd / n, disguised, hits[-1] / n if hits else 0.0,
    ]


def rising(margins, labels):
    """Corners of the step function: the isotonic mean at every margin is the largest, over beginnings, of the smallest mean of a run that ends here or later."""
    places = sorted(set(margins))
    total, many = ([sum(f(y) for m, y in zip(margins, labels, strict=True) if m == p) for p in places] for f in (lambda y: y, lambda y: 1))
    sums, counts = ([0, *np.cumsum(v).tolist()] for v in (total, many))
    mean = lambda a, b: (sums[b + 1] - sums[a]) / (counts[b + 1] - counts[a])
    tail = [[0.0] * len(places) for _ in places]
    for a in range(len(places)):
        low = math.inf
        for b in range(len(places) - 1, a - 1, -1):
            low = min(low, mean(a, b))
            tail[a][b] = low
    values = [max(tail[a][i] for a in range(i + 1)) for i in range(len(places))]
    xs, vs, start = [], [], 0
    for i in range(1, len(places) + 1):
        if i == len(places) or not math.isclose(values[i], values[start], abs_tol=1e-12):
            value = (sums[i] - sums[start] + 0.5) / (counts[i] - counts[start] + 1.0)
            xs += [places[start]] if i - 1 == start else [places[start], places[i - 1]]
            vs += [value] * (1 if i - 1 == start else 2)
            start = i
    return xs, [max(vs[: k + 1]) for k in range(len(vs))]


def at(xs, vs, x):
    k = bisect.bisect_right(xs, x)
    if k == 0 or k == len(xs):
        return vs[0] if k == 0 else vs[-1]
    return vs[k - 1] + (vs[k] - vs[k - 1]) * (x - xs[k - 1]) / (xs[k] - xs[k - 1])


def test_toxicity_scores_equal_a_plain_double(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.toxic in (0, 1) and r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    drawn = spark.createDataFrame([(i,) for i in labels], "label_id long").select("label_id", toxicity.part_of("label_id").alias("p")).collect()  # a hash decides it
    parts, known = {r.label_id: r.p for r in drawn}, {i: texts[i] for i in labels}
    lexicons = [learn(known, labels, parts, p) for p in (0, 1, 2, None)]
    single = lambda text, lexicon: [float(np.float32(v)) for v in measure(text, lexicon)]
    rows, train = {i: single(t, lexicons[3]) for i, t in texts.items()}, sorted(labels)
    own = [single(texts[i], lexicons[parts[i]]) for i in train]
    y = [float(labels[i]) for i in train]

    def margin(model, row):
        total = model[0]
        for tree in model[1]:
            total += walk(tree, row)
        return total

    # For calibration the library grows the trees: without a third of the rows two splits can part the others alike, and which one is taken is a matter of rounding.
    x, target, part = np.array(own, np.float32), np.array(y), np.array([parts[i] for i in train])
    margins = np.zeros(len(train))
    for p in range(3):
        margins[part == p] = fit_trees(x[part != p], target[part != p], trees=40).margin(x[part == p])
    margins = margins.tolist()
    xs, vs = rising(margins, y)
    whole = grow(own, y, trees=40)
    assert any(t[1] < math.inf for t in whole[1]) and len(set(vs)) > 3
    found = QUERIES["op1_toxicity"](spark, SF).withColumn("at", F.lit(0)).collect()
    off = [abs(r.score - at(xs, vs, margin(whole, rows[r.doc_id]))) for r in found]
    assert max(off) < 1e-5, (max(off), sum(o > 1e-5 for o in off), len(off))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for r in found)
