"""Language identification against a plain double of features, field, training and decision; texts longer than a batch."""

import math
import resource
import zlib

import numpy as np
import pytest

from loomgrid.llm import crf, language_id

M64 = (1 << 64) - 1
#: The salts of the feature kinds and the mixer.
SALTS, MIXER = {2: 0x9E3779B97F4A7C15, 3: 0xC2B2AE3D27D4EB4F, "^": 0x165667B19E3779F9, "$": 0x27D4EB2F165667C5}, 0xFF51AFD7ED558CCD


def plain_words(text):
    words, own = [], ""
    for c in (text or "").lower() + " ":
        if c.isalnum() and not c.isdecimal() and c != "_":
            own += c
        else:
            if any(x.isalpha() for x in own):
                words.append(own)
            own = ""
    return words


def plain_rows(word, lexicon):
    def bucket(letters, kind):
        mixed = SALTS[kind]
        for c in letters:
            mixed = ((mixed ^ ord(c)) * MIXER) & M64
            mixed ^= mixed >> 33
        return mixed % crf.BUCKETS

    marked = f"^{word}$"
    rows = [bucket(marked[i : i + n], n) for n in (2, 3) for i in range(len(marked) - n + 1)]
    if len(word) >= 3:
        rows += [bucket(word[:3], "^"), bucket(word[-3:], "$")]
    return rows + ([crf.BUCKETS + lexicon[word]] if word in lexicon else [])


def plain_marginals(scores, transitions):
    """Word and pair probabilities from sums over all paths, in logarithms."""
    k, n = len(transitions), len(scores)
    add = lambda xs: max(xs) + math.log(sum(math.exp(x - max(xs)) for x in xs))
    ahead, behind = [[0.0] * k for _ in range(n)], [[0.0] * k for _ in range(n)]
    for t in range(n):
        for j in range(k):
            ahead[t][j] = scores[t][j] + add([(ahead[t - 1][i] if t else 0.0) + transitions[i][j] for i in range(k)])  # a first word is entered from any label alike
    for t in range(n - 2, -1, -1):
        for i in range(k):
            behind[t][i] = add([transitions[i][j] + scores[t + 1][j] + behind[t + 1][j] for j in range(k)])
    total = add(ahead[-1])
    single = [[math.exp(ahead[t][i] + behind[t][i] - total) for i in range(k)] for t in range(n)]
    pair = [[sum(math.exp(ahead[t][i] + transitions[i][j] + scores[t + 1][j] + behind[t + 1][j] - total) for t in range(n - 1)) for j in range(k)] for i in range(k)]
    return single, pair


def plain_train(sequences, k, lexicon, epochs=6, rate=0.25, ridge=1e-5, batch=256):
    weights, moved, transitions, stirred = {}, {}, [[0.0] * k for _ in range(k)], [[1e-8] * k for _ in range(k)]
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        order = rng.permutation(len(sequences)).tolist()
        for start in range(0, len(order), batch):
            some = [sequences[i] for i in order[start : start + batch]]
            grad, across = {}, [[0.0] * k for _ in range(k)]
            for words, truth in some:
                rows = [plain_rows(w, lexicon) for w in words]
                single, pair = plain_marginals([[sum(weights.get((r, y), 0.0) for r in own) for y in range(k)] for own in rows], transitions)
                for own, p, y in zip(rows, single, truth, strict=True):
                    for r in own:
                        for j in range(k):
                            grad[r, j] = grad.get((r, j), 0.0) + (p[j] - (j == y)) / len(some)
                for i in range(k):
                    for j in range(k):
                        across[i][j] += (pair[i][j] - sum(a == i and b == j for a, b in zip(truth, truth[1:], strict=False))) / len(some)
            for key, g in grad.items():
                g += ridge * weights.get(key, 0.0)
                moved[key] = moved.get(key, 1e-8) + g * g
                weights[key] = weights.get(key, 0.0) - rate * g / math.sqrt(moved[key])
            for i in range(k):
                for j in range(k):
                    g = across[i][j] + ridge * transitions[i][j]
                    stirred[i][j] += g * g
                    transitions[i][j] -= rate * g / math.sqrt(stirred[i][j])
    return weights, transitions


TEXTS = {"aa": "kala maru sole tani kala", "bb": "Ströß dwyth gwern pfad", "cc": "один два три четыре"}


def table(spark, n=36):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        lang = list(TEXTS)[i % 3]
        rows.append((i, " ".join(rng.choice(TEXTS[lang].split(), int(rng.integers(1, 60))).tolist()), lang if i % 7 else None))
    rows += [(n, None, "aa"), (n + 1, "", "bb"), (n + 2, "12 _ 3²", "cc"), (n + 3, "kala, один; x1y Ströß²!", None), (n + 4, rows[1][1], None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_scores_equal_a_plain_double(spark):
    rows, docs = table(spark)
    model = language_id.fit(docs)
    plain = {}
    for key, text, _ in rows:
        words = plain_words(text)
        scores = []
        for w in words:
            own = [np.float32(0)] * len(model.labels)
            for r in plain_rows(w, model.lexicon):
                own = [a + b for a, b in zip(own, model.weights[r], strict=True)]
            scores.append([float(x) for x in own])
        if words:
            p, _ = plain_marginals(scores, model.transitions.tolist())
            mean = [sum(x) / len(words) for x in zip(*p, strict=True)]
            plain[key] = (model.labels[mean.index(max(mean))], max(mean), sum(map(max, p)) / len(words))
        else:
            plain[key] = ("und", 0.0, 0.0)
    found = {r.doc_id: (r.lid_lang, r.lid_score, r.lid_sure) for r in language_id.identify(docs, model, certainty=True).collect()}
    assert found.keys() == plain.keys() and {v[0] for v in plain.values()} == {"aa", "bb", "cc", "und"}
    for key, (lang, score, sure) in plain.items():
        assert found[key][0] == lang and found[key][1:] == pytest.approx((score, sure), abs=1e-6)


def test_training_equals_a_plain_double(spark):
    """The rows that may be learned from, their windows, the lexicon, and all weights after six passes."""
    rows, docs = table(spark)
    model = language_id.fit(docs)
    assert model.labels == ["aa", "bb", "cc"]
    learned = [(k, model.labels.index(y), plain_words(x)) for k, x, y in rows if y and zlib.crc32(str(k).encode()) % 4 != 2]
    windows = []
    for k, y, words in learned:  # few rows: all are drawn
        parts = [words[s : s + 32] for s in range(0, len(words), 32)]
        windows += [(k, y, (part * 32)[:32]) for part in parts[:3]]
    sequences = language_id._sequences([(w, y) for _, y, w in sorted(windows)])
    times = {}
    for words, _ in sequences:
        for w in words:
            times[w] = times.get(w, 0) + 1
    lexicon = {w: i for i, w in enumerate(sorted((w for w in times if times[w] >= 5), key=lambda w: (-times[w], w)))}
    assert model.lexicon == lexicon
    weights, transitions = plain_train(sequences, 3, lexicon)
    assert model.transitions == pytest.approx(np.array(transitions), abs=1e-6)
    expected = np.zeros(model.weights.shape)
    for (r, y), w in weights.items():
        expected[r, y] = w
    assert model.weights == pytest.approx(expected, abs=1e-5) and np.abs(expected).max() > 0.1


def test_a_long_sequence_in_blocks_equals_one_piece():
    rng = np.random.default_rng(4)
    scores, transitions = rng.normal(size=(1000, 5)).astype(np.float32) * 3, rng.normal(size=(5, 5))
    whole = crf.marginals(scores, np.array([1000]), transitions)
    for block in (1, 7, 100, 999, 1000, 5000):
        got = np.full_like(whole, np.nan)
        for at, p in crf.marginals_of_long(lambda a, b: scores[a:b], 1000, transitions, block):
            got[at : at + len(p)] = p
        assert np.abs(got - whole).max() < 1e-9


def test_long_texts_are_judged_and_cut_as_others(spark, monkeypatch):
    rows, docs = table(spark)
    model = language_id.fit(docs)
    text = " ".join(x for _, x, _ in rows if x)
    before = list(language_id.label_words([text, None, "kala"], crf.Emissions(model)))
    monkeypatch.setattr(language_id, "BATCH_WORDS", 50)
    after = list(language_id.label_words([text, None, "kala"], crf.Emissions(model)))
    assert [i for i, *_ in before] == [0, 2] and len(after) > 10 and after[-1][0] == 2
    whole = sorted((at, words, p) for i, at, words, p in after if i == 0)
    assert [w for _, words, _ in whole for w in words] == before[0][2]
    assert np.abs(np.concatenate([p for *_, p in whole]) - before[0][3]).max() < 1e-9


def test_many_words_and_two_hundred_labels_stay_in_memory():
    """The peak of this process grows by far less than the probabilities of all words would take (600,000 x 200 doubles: 960 MB), let alone a matrix for each chunk."""
    rng = np.random.default_rng(5)
    labels = [f"l{i:03d}" for i in range(200)]
    model = crf.Model(labels, {}, rng.normal(size=(crf.BUCKETS, 200)).astype(np.float32), rng.normal(size=(200, 200)))
    names = ["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(5000)]
    text = " ".join(names[i] for i in rng.integers(0, len(names), 600_000).tolist())
    start, seen, total = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, 0, np.zeros(200)
    for i, _, words, p in language_id.label_words([text], crf.Emissions(model)):
        seen += len(words)
        total += p.sum(axis=0)
    assert i == 0 and seen == 600_000 and total.sum() == pytest.approx(6e5)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - start < 350_000  # KB
