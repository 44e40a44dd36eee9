"""The pipeline against the same steps in plain Python, text by text and without Spark (but for fitting the language model)."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

from loomgrid.llm import language_id, mixing, quality_rules, stages
from loomgrid.llm.crf import Emissions, marginals

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quality(docs):
    texts, held = defaultdict(set), defaultdict(set)
    norm = lambda line: " ".join(WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), line)))
    for _, text, _, source in docs:
        texts[source].add(text)
        for line in text.split("\n"):
            if norm(line):
                held[source, norm(line)].add(text)
    often = {k for k, v in held.items() if len(v) >= quality_rules.MIN_TEXTS and len(v) > quality_rules.MAX_SHARE * len(texts[k[0]])}
    out = []
    for i, text, lang, source in docs:
        words = WORD.findall(text)
        grams = Counter(zip(words, words[1:], words[2:], strict=False))
        repeated = {j for at in range(len(words) - 2) if grams[tuple(words[at : at + 3])] > 1 for j in (at, at + 1, at + 2)}
        stay = [line for line in text.split("\n") if (source, norm(line)) not in often]
        if len(words) >= 50 and 2 * len(repeated) <= len(words) and sum(len(WORD.findall(x)) for x in stay) >= max(50, quality_rules.MIN_LEFT * len(words)):
            out.append((i, "\n".join(stay), lang, source))
    return out


def language(spark, docs):
    model = language_id.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"))
    emissions, out = Emissions(model), []
    for doc in docs:
        words = language_id.words_of(doc[1])
        if words and marginals(emissions(words), np.array([len(words)]), model.transitions).max(axis=1).mean() >= stages.MIN_LANGUAGE_SCORE:
            out.append(doc)
    return out


def simhash(docs):
    def mark(text):
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    docs = sorted(docs)
    marks = [mark(d[1]) for d in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 2:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return [d for i, d in enumerate(docs) if group[i] == i]


def mix(docs):
    sizes = defaultdict(int)
    for d in docs:
        sizes[d[3]] += len(WORD.findall(d[1]))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sorted(sizes))}
    target, open_, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while open_:  # share by weight; cap; share the excess again
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        for s in over or open_:
            target[s] = 2.0 * sizes[s] if over else weight[s] * level
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    out = []
    for d in docs:
        rate = target[d[3]] / sizes[d[3]]
        md5 = lambda text: hashlib.md5(text.encode()).hexdigest()
        u = int(md5(md5(f"{mixing.SEED}:{d[0]}:{d[3]}:{md5(d[1])}") + ":0")[:13], 16) / 2**52
        out += [d] * (int(rate) + (u < rate - int(rate)))
    return out


def pieces(docs):
    full, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for i, text, _, _ in docs:
        ids = np.array([*full.encode(text, add_special_tokens=False).ids, 1], "<u4")
        out += [(i, k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    return out


def test_pipeline_equals_plain_python(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    want = pieces(mix(simhash(language(spark, quality(docs)))))
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for own in used.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 4096
    assert len(used) <= -(-sum(r.length for r in rows) // 4096) + 1
