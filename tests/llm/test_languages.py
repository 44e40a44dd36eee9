"""Documents of several languages, and many languages."""

import numpy as np
import pytest

from loomgrid.llm import language_id, stages

SCHEMA = "doc_id long, text string, lang string, source string"


def invented(n, docs, words=40):
    """`docs` documents in each of `n` languages; a language has twelve syllables of its own."""
    rng = np.random.default_rng(6)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    syllables = {k: ["".join(rng.choice(letters, 3)) for _ in range(12)] for k in range(n)}
    word = lambda k: "".join(rng.choice(syllables[k], 2))
    rows = [(1000 * k + i, " ".join(word(k) for _ in range(words)), f"l{k:03d}", "s") for k in range(n) for i in range(docs)]
    return rows, word


def test_documents_of_three_languages_stay(spark):
    rows, word = invented(4, 60)
    mixed = [(10**6 + i, " ".join(word((i + k) % 4) for k in range(3) for _ in range(20)), None, "s") for i in range(8)]
    docs = spark.createDataFrame([*rows, *mixed], SCHEMA)
    found = {r.doc_id: r for r in language_id.identify(docs, language_id.fit(docs)).collect()}
    assert all(found[r[0]].lid_lang != language_id.UNKNOWN and found[r[0]].lid_score < 0.5 for r in mixed)
    kept = {r.doc_id for r in stages.keep_language(docs).collect()}
    assert {r[0] for r in mixed} <= kept


def test_every_language_is_learned(spark):
    rows, _ = invented(60, 8)
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language_id.fit(docs)
    assert len(model.labels) == 60
    found = {r.doc_id: r.lid_lang for r in language_id.identify(docs, model).collect()}
    assert np.mean([found[r[0]] == r[2] for r in rows]) > 0.95
    with pytest.raises(ValueError, match="languages"):
        language_id.fit(spark.createDataFrame([(i, "word", f"l{i}", "s") for i in range(2 * language_id.MAX_LANGUAGES)], SCHEMA))
