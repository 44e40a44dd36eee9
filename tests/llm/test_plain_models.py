"""The quality classifier against a plain double: statistics character by character, and trees by a search over every split of every node."""

import bisect
import math
import re
import zlib
from collections import Counter

import numpy as np

from loomgrid.llm import quality_model
from loomgrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>@^~_+=/\\[]{}`"


def statistics(text):
    words = re.findall(f"[^{SPACE}]+", text or "")
    if not words:
        return [0.0] * 25
    n, chars = len(words), len(text)
    count = lambda signs: sum(c in signs for c in text)
    size = lambda x: len(x.encode())
    lower = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x)
    small, large, digits = (sum(a <= c <= b for c in text) for a, b in ("az", "AZ", "09"))
    times = Counter(map(lower, words))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    parts = [x for x in re.split(r"[\n.]", text) if size(x) > 8]
    shouted = sum(bool(re.search("[A-Z]", w)) and not re.search("[a-z]", w) for w in words)
    mixed = sum("a" <= a <= "z" and (b in SYMBOLS or "0" <= b <= "9") and "a" <= c <= "z" for a, b, c in zip(text, text[1:], text[2:], strict=False))
    return [
        math.log1p(n), math.log1p(chars), (chars - count(SPACE)) / n, len(times) / n, small / chars, large / chars, digits / chars, count(SPACE) / chars, count(".!?") / n, count(",;:'\"-()") / n, count(SYMBOLS) / n,
        sum(ord(c) > 127 for c in text) / chars, count("!") / n, count("|") / n, math.log1p(len(lines)), n / len(lines), 1 - len(set(lines)) / len(lines), sum(size(x) < 30 for x in lines) / len(lines),
        sum(x.rstrip(SPACE)[-1] in ".!?" for x in lines) / len(lines), shouted / n, count(SYMBOLS) / max(1, small + large), max(map(size, words)), max(times.values()) / n, 1 - len(set(parts)) / len(parts) if parts else 0.0, mixed / n,
    ]


def grow(x, y, trees=60, depth=4, rate=0.2, bins=64, ridge=1.0, least=5.0):
    """Trees as nested (feature, threshold, left, right), and leaves as numbers."""
    n, k = len(x), len(x[0])
    edges = []
    for f in range(k):
        column = sorted(r[f] for r in x)
        edges.append(sorted({column[math.floor(q * (n - 1))] for q in np.linspace(0, 1, bins + 1)[1:-1].tolist()}))
    cells = [[bisect.bisect_left(edges[f], r[f]) for f in range(k)] for r in x]
    base = math.log((sum(y) + 0.5) / (n + 1) / (1 - (sum(y) + 0.5) / (n + 1)))
    margin, out = [base] * n, []

    def split(rows, grad, hess):
        best = (1e-9, None, None)
        whole = None
        for f in range(k):
            g, h = [0.0] * (len(edges[f]) + 1), [0.0] * (len(edges[f]) + 1)
            for i in rows:
                cell = cells[i][f]
                g[cell] += grad[i]
                h[cell] += hess[i]
            whole = whole or (sum(g), sum(h))
            left_g = left_h = 0.0
            for b, edge in enumerate(edges[f]):
                left_g, left_h = left_g + g[b], left_h + h[b]
                right_g, right_h = whole[0] - left_g, whole[1] - left_h
                if left_h >= least and right_h >= least:
                    gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - whole[0] ** 2 / (whole[1] + ridge)
                    if gain > best[0]:
                        best = (gain, f, edge)
        return best[1:]

    def build(rows, grad, hess, level):
        if level == depth:
            return -rate * sum(grad[i] for i in rows) / (sum(hess[i] for i in rows) + ridge)
        f, edge = split(rows, grad, hess) if rows else (None, None)
        if f is None:
            f, edge = 0, math.inf
        return f, edge, build([i for i in rows if x[i][f] <= edge], grad, hess, level + 1), build([i for i in rows if x[i][f] > edge], grad, hess, level + 1)

    for _ in range(trees):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        tree = build(list(range(n)), [a - b for a, b in zip(p, y, strict=True)], [max(a * (1 - a), 1e-6) for a in p], 0)
        margin = [m + walk(tree, r) for m, r in zip(margin, x, strict=True)]
        out.append(tree)
    return base, out


def walk(tree, row):
    while isinstance(tree, tuple):
        tree = tree[3] if row[tree[0]] > tree[1] else tree[2]
    return tree


def test_quality_scores_equal_a_plain_double(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality in (0, 1) and r.doc_id in texts}
    single = lambda text: [float(np.float32(v)) for v in statistics(text)]
    rows = {i: single(t) for i, t in texts.items()}
    stats = {r.doc_key: list(r.stats) for r in quality_model.document_stats(spark.createDataFrame([*texts.items(), (-1, None)], "doc_id long, text string"), "doc_id", "text").collect()}
    assert all(np.allclose(stats[i], rows[i], rtol=1e-6) for i in rows) and stats[-1] == [0.0] * 25
    train = sorted(i for i in labels if zlib.crc32(str(i).encode()) % 5)
    assert len(train) > 40 and {labels[i] for i in train} == {0, 1}
    base, trees = grow([rows[i] for i in train], [float(labels[i]) for i in train])
    assert any(t[1] < math.inf for t in trees)
    for r in QUERIES["op9_quality_classifier"](spark, SF).collect():
        want = 1 / (1 + math.exp(-base - sum(walk(t, rows[r.doc_id]) for t in trees)))
        assert abs(r.score - want) < 1e-6 and r.predicted == (want >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
