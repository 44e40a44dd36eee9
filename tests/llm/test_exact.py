"""Queries against SQL, brute force and held-out labels; the ways beyond a broadcast; and the numeric helpers."""

import bisect
import itertools
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgrid.llm import boost, crf, language_id, licenses, mixing, packing, quality_rules, simhash, stages, url_filter, vector_dedup
from loomgrid.llm.components import components
from loomgrid.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "labels")


def plain(value):
    return float(f"{value:.9g}") if isinstance(value, float) else value


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = QUERIES[name](spark, SF)
    result = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(found.columns)
    want = sorted((repr([plain(v) for v in row]) for row in result.fetchall()))
    assert sorted(repr([plain(r[c]) for c in columns]) for r in found.collect()) == want


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(ids, linked):
    low = {i: i for i in ids}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        low[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.fixture(scope="module")
def near_copies(spark):
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in range(400)]
    rows = [(i, " ".join(rng.permutation(base)[:60])) for i in range(60)]
    text = rows[0][1].split()
    for i in range(100, 190):  # near copies of one text, chains of changes among them
        text[rng.integers(60)] = f"u{i}"
        rows.append((i, " ".join(text)))
        if i % 10 == 0:
            text = rows[0][1].split()
    return rows


@pytest.mark.parametrize("crowd,points", [(256, 100_000), (2, 100_000), (1, 0)])
def test_simhash_equals_brute_force(spark, near_copies, monkeypatch, crowd, points):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "BROADCAST_POINTS", points)
    prints = {i: brute_simhash(t) for i, t in near_copies}
    pairs = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = brute_groups(prints, pairs)
    assert pairs and len(set(want.values())) < len(want)
    got = simhash.near_duplicates(spark.createDataFrame(near_copies, "doc_id long, text string")).collect()
    assert {r.sim_id: (r.sim_fp % 2**64, r.sim_component) for r in got} == {i: (prints[i], want[i]) for i in prints}


def test_simhash_query_on_test_data(spark):
    docs = {r.doc_id: brute_simhash(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = brute_groups(docs, [(a, b) for a, b in itertools.combinations(docs, 2) if (docs[a] ^ docs[b]).bit_count() <= 2])
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op7_simhash_near_dedup"](spark, SF).collect()} == {i: (f"{v:016x}", want[i]) for i, v in docs.items()}


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(100)]
    want = brute_groups({x for p in links for x in p}, links)
    assert {r.node: r.component for r in components(spark.createDataFrame([*links, (None, 1)], "a long, b long")).collect()} == want
    assert components(spark.createDataFrame([(4, 4)], "a long, b long")).collect() == [(4, 4)]


def vector_sets():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(8, 6))
    dense = np.concatenate([centres[rng.integers(8, size=300)] + rng.normal(scale=0.12, size=(300, 6)), centres[:1].repeat(60, 0)]) * rng.uniform(0.5, 3, (360, 1))
    dense[300:] = dense[300]
    yield "dense", dense
    # 64 dimensions: many small groups, and groups that are paths, linked from one to the next only.
    angle = np.arccos(0.96) * np.arange(7)
    planes = [np.linalg.qr(rng.normal(size=(64, 2)))[0] for _ in range(30)]
    paths = np.concatenate([(q @ np.stack([np.cos(angle), np.sin(angle)])).T for q in planes])
    pairs = np.repeat(rng.normal(size=(120, 64)), 2, axis=0) + rng.normal(scale=0.05, size=(240, 64))
    yield "sparse", rng.permutation(np.concatenate([paths, pairs, rng.normal(size=(150, 64))]))


@pytest.mark.parametrize("name", ["dense", "sparse"])
@pytest.mark.parametrize("block,pivots", [(8192, (1, 4, 16, 64, 256, 512)), (16, (9,)), (50, (64,)), (8192, (1,))])
def test_vectors_equal_brute_force(spark, monkeypatch, name, block, pivots):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    monkeypatch.setattr(vector_dedup, "PIVOTS", pivots)
    x = dict(vector_sets())[name].astype(np.float32 if block == 16 else np.float64)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.95) | (x[:, None] == x[None]).all(axis=2)
    want = brute_groups(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)])
    assert near.sum() > len(x) and len(set(want.values())) < len(x)
    kind = "float" if x.dtype == np.float32 else "double"
    got = {r.v_id: (r.n_links, r.component_id) for r in vector_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")).collect()}
    assert got == {i: (int(near[i].sum()) - 1, want[i]) for i in range(len(x))}


def test_more_pivots_where_vectors_cluster(spark):
    rng = np.random.default_rng(4)
    loose = rng.normal(size=(4000, 64))
    tight = np.repeat(rng.normal(size=(200, 64)), 20, axis=0) + rng.normal(scale=0.02, size=(4000, 64))
    few, many = (len(vector_dedup.choose_pivots(spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(x)], "v_key long, v_raw binary"), len(x), np.float64, 0.3163)) for x in (loose, tight))
    assert few <= 4 and many > 100


def test_links_in_a_path_of_blocks_are_not_lost():
    linked = np.array([[1, 0, 1], [0, 1, 1]], bool)  # x0 - y0, x0 - y2, x1 - y2, x1 - y1
    pairs = np.concatenate(list(vector_dedup._pairs(linked, np.array([10, 20]), np.array([1, 2, 3]), np.zeros(3, np.int64))))
    assert set(brute_groups([1, 2, 3, 10, 20], pairs.tolist()).values()) == {1}


def test_packing_equals_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    odd = [(10**6 + i, t) for i, t in enumerate(["it's don't 'tis", "a\u0301 \u0301b İ ẞ ΑΣ Σ", "x\x1cy z", "<|endoftext|> a<|startoftext|>b", "Naïve, ÉTÉ!!! end.&&& 12ab", "a b\u2003c\u0085d", "ᾳ Ǆ ŉ ﬁ K", "x²y ½. a_b__c 1a2 ª.º µ|~ ÀÞ÷ß"])]
    table = spark.createDataFrame([*[tuple(d) for d in docs], *odd], "doc_id long, text string")
    want = set()
    for doc, text in [*docs, *odd]:
        ids = np.array([*full.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want |= {(doc, i // 4096, i, len(ids[i : i + 4096]), zlib.crc32(ids[i : i + 4096].tobytes())) for i in range(0, len(ids), 4096)}
    rows = packing.pack(table, keep_ids=True).collect()
    assert {(r.pk_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= 1.02 * total / 4096 + 1


def test_encoder_keeps_within_its_limit():
    encoder = packing.ChunkEncoder(__import__("public_tokenizers").path("word_bpe_49k.json"))
    encoder.known.limit = 25
    text = " ".join(f"wörd{i}x more, text" for i in range(40))
    for _ in range(3):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.full.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode("brand new words " * 30), "<u4").tolist() == encoder.full.encode("brand new words " * 30, add_special_tokens=False).ids
    assert len(encoder.known) <= 25 and len(encoder.known.older) <= 25


def test_words_are_cut_once():
    """A word that comes again is neither cut nor looked up by its runs; beyond the limit words are cut each time, with the same ids."""
    encoder = packing.ChunkEncoder(__import__("public_tokenizers").path("word_bpe_49k.json"))
    text = "Wörds, words; more-words 12²\u00a0_x\x85 " * 50
    want = encoder.full.encode(text, add_special_tokens=False).ids
    cut = []
    encoder.words.compute = lambda word: cut.append(word) or encoder._word(word)
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want and len(cut) == len({*text.lower().split()})
    encoder.words.clear()
    encoder.words.limit = 2
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want and len(encoder.words) <= 2


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "Wörd", "the", "'s", "'", ".", "!!", "<|", "<|endoftext|>", " ", "\n", "\x1c", "\x85", "\xa0", "12", "²", "_", "é", "e\u0301", "İ", "Σ", "漢", "ﬁ", "\u200b", "ß", "&", "S", "T"]), max_size=12).map("".join))
def test_encoder_equals_the_tokenizer(text):
    encoder = packing.encoder(packing.TOKENIZER)
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.full.encode(text, add_special_tokens=False).ids


def best_fit_decreasing(counts, capacity):
    """Sequences that one document after another uses, longest first, each in the smallest gap that holds it."""
    gaps: list[int] = []
    used = 0
    for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        at = bisect.bisect_left(gaps, length)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        used += gap == capacity
        if gap > length:
            bisect.insort(gaps, gap - length)
    return used


def packing_sets():
    rng = np.random.default_rng(12)
    tally = lambda values: dict(zip(*(x.tolist() for x in np.unique(values, return_counts=True)), strict=True))
    yield "skewed", 4096, tally(np.clip(rng.lognormal(5.5, 1.2, 6000).astype(int), 1, 4096))
    yield "even", 4096, tally(rng.integers(1, 4097, 4000))
    yield "1025 to 2048", 4096, tally(rng.integers(1025, 2049, 4000))
    yield "few lengths", 4096, tally(rng.choice([700, 1000, 1400, 2100], 4000))
    yield "one length", 30, {7: 1001}
    yield "ones", 16, {1: 100}
    yield "full", 30, {30: 12, 15: 3, 29: 2, 1: 2}
    yield "none", 30, {}


@pytest.mark.parametrize("name", [n for n, *_ in packing_sets()])
def test_rounds_place_everything_once(spark, name):
    capacity, counts = {n: x for n, *x in packing_sets()}[name]
    matches = packing.match_classes(spark, counts, capacity).collect()
    filled: dict[int, list[tuple[int, int]]] = {}
    for length, count in counts.items():
        own = sorted(m for m in matches if m["size"] == length)
        assert [m["first"] for m in own] == list(itertools.accumulate([0, *[m["many"] for m in own]]))[:-1] and sum(m["many"] for m in own) == count
        for m in own:
            for i in range(m["many"]):
                filled.setdefault(m["sequence"] + i // m["per"], []).append((m["offset"] + i % m["per"] * length, length))
    assert set(filled) == set(range(len(filled)))
    for own in filled.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= capacity
    assert len(filled) <= 1.01 * best_fit_decreasing(counts, capacity) + 1


def test_beyond_the_broadcasts_results_are_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    few = lambda: (sorted(map(tuple, quality_rules.apply_rules(docs).collect())), sorted(map(tuple, mixing.copy_counts(docs).collect())), sorted(r.doc_id for r in stages.keep_one_of_near_copies(docs).collect()))
    want = few()
    monkeypatch.setattr(quality_rules, "BROADCAST_LINES", 0)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    monkeypatch.setattr(stages, "BROADCAST_IDS", 0)
    assert few() == want


def test_boilerplate_by_the_join(spark, monkeypatch):
    rows = [(i, f"own line {i}\nshared line of all\n" + " ".join(f"v{i * 50 + j}" for j in range(60)), "h") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted((r.doc_id, r.q_text) for r in quality_rules.apply_rules(docs, rewrite=True).collect())
    assert all("shared" not in t and "own line" in t for _, t in want)
    monkeypatch.setattr(quality_rules, "BROADCAST_LINES", 0)
    assert sorted((r.doc_id, r.q_text) for r in quality_rules.apply_rules(docs, rewrite=True).collect()) == want


def test_mix_is_steady_and_near_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "source")
    rows = mixing.copy_counts(docs).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.copy_counts(docs.repartition(7)).collect()))
    assert all(r.mix_copies <= 2 for r in rows)
    for source in {r.mix_source for r in rows}:
        own = [r for r in rows if r.mix_source == source]
        assert abs(sum(r.mix_size * r.mix_copies for r in own) - own[0].target) < 0.12 * own[0].target
    assert mixing.mix(docs).count() == sum(r.mix_copies for r in rows)


def test_license_spans_survive_small_changes(spark):
    notice = "you may not use this file except in compliance with the license"
    rows = [
        (1, "foo Licensed under the (new) Apache License, Version 2.0 bar"), (2, "under the apache  LICENSE"), (3, "general public\nlicense general public"), (4, "MIT-License, mit license; mit  licenses"),
        (5, "gnu general public license version 3"), (6, "\u212a license mit"), (7, "gnu general public license version"), (8, "GNU General Public License, version 2"), (9, "licensed under the apache license version 2 1"),
        (10, "mozilla public license version 2"), (11, "Mozilla Public License, version 2.0"), (12, "Licensed under CC BY-NC 4.0."), (13, "licensed under cc by 4 0"), (14, "released under the bsd license"),
        (15, "version 3 license public general gnu"), (16, "with the license compliance in except file this use not may you"), (17, "gnu lesser general public license version 2"),
    ]
    got = {r.doc_id: (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    none = (0, None, None, "", "")
    assert got == {
        1: (1, 5, 5, "apache", "apache,apache-2.0"), 2: (1, 2, 2, "apache", "apache"), 3: (1, 0, 0, "gpl", "gpl"), 4: (2, 0, 2, "mit", "mit"), 5: (1, 1, 1, "gpl", "gpl,gpl-3.0"), 6: none,
        7: (1, 1, 1, "gpl", "gpl"), 8: (1, 1, 1, "gpl", "gpl,gpl-2.0"), 9: (1, 3, 3, "apache", "apache"), 10: none, 11: (0, None, None, "", "mpl-2.0"), 12: (0, None, None, "", "cc-by-nc-4.0"), 13: (0, None, None, "", "cc-by-4.0"),
        14: none, 15: none, 16: none, 17: (1, 2, 2, "gpl", "gpl"),
    }
    changed = [(i, " ".join("other" if j == i else w for j, w in enumerate(notice.split()))) for i in range(12)]
    found = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(changed, "doc_id long, text string")).collect()}
    assert all(found[i] == "apache-2.0-notice" for i in range(12)), found


def test_every_license_template_survives_one_changed_word(spark):
    rows, want = [], {}
    for t, label, base, words, must in licenses._templates():
        held = {p + i for p in must for i in (0, 1)}
        for j in range(len(words)):
            rows.append((100 * t + j, " ".join("changed" if i == j else w for i, w in enumerate(words))))
            # A changed word between others breaks two 2-grams, one beside an end may leave a lone word that no 2-gram aligns.
            aligned = sum(len(run) for run in (words[:j], words[j + 1 :]) if len(run) > 1)
            want[100 * t + j] = not base and j not in held and aligned >= licenses.MIN_COVER * len(words)
    label = {t: x for t, x, *_ in licenses._templates()}
    found = {r.doc_id: r.labels.split(",") for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: label[i // 100] in found[i] for i in want} == want


HOSTS = st.lists(st.sampled_from(["a", "b", "org"]), min_size=1, max_size=3).map(".".join)
PATHS = st.lists(st.sampled_from(["x", "xy", "", "z"]), max_size=3).map(lambda p: "/" + "/".join(p))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(HOSTS, PATHS), max_size=8, unique=True), HOSTS, PATHS)
def test_trie_equals_a_scan_of_all_rules(rules, host, path):
    known = [url_filter.Rule("block", h, p) for h, p in rules]
    fits = [r for r in known if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    assert url_filter.UrlTrie(known).match(host, path) == max(fits, key=lambda r: (r.host.count("."), len(r.path)), default=None)


def test_many_rules_of_one_host_are_not_scanned():
    rules = [url_filter.Rule("block", "one.org", f"/{i:06d}x") for i in range(100_000)] + [url_filter.Rule("allow", "one.org", "/0999")]
    trie = url_filter.UrlTrie(rules)
    start = time.perf_counter()
    assert all(trie.match("www.one.org", f"/{i:06d}xyz/more") == rules[i] for i in range(0, 100_000, 50))
    assert trie.match("one.org", "/099912") == rules[-1] and trie.match("one.org", "/x") is None
    assert time.perf_counter() - start < 1  # 2,000 look-ups; a scan of all rules took 8.7 ms each


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    lengths, k = np.array([1, 5, 3, 7]), 3
    emissions, transitions = rng.normal(size=(16, k)), rng.normal(size=(k, k))
    old, crf.CHUNK = crf.CHUNK, 2
    try:
        got = crf.marginals(emissions, lengths, transitions)
    finally:
        crf.CHUNK = old
    at = 0
    for n in lengths:
        p = np.zeros((n, k))
        for path in itertools.product(range(k), repeat=int(n)):
            start = np.log(np.exp(transitions).sum(axis=0))[path[0]]
            weight = np.exp(start + sum(emissions[at + i, y] for i, y in enumerate(path)) + sum(transitions[a, b] for a, b in itertools.pairwise(path)))
            for i, y in enumerate(path):
                p[i, y] += weight
        assert np.allclose(got[at : at + n], p / p.sum(axis=1, keepdims=True))
        at += n


def test_code_switched_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs)
    texts = {r.lang: r.text for r in docs.filter("length(text) between 800 and 3000 and lang in ('en', 'de')").orderBy("doc_id").collect()}
    en, de = texts["en"].split()[:60], texts["de"].split()[:60]
    rows = language_id.spans(spark.createDataFrame([(1, " ".join(en + de))], "doc_id long, text string"), model).collect()
    right = sum(max(0, min(r.last, 59) - r.first + 1) if r.lang == "en" else max(0, r.last - max(r.first, 60) + 1) if r.lang == "de" else 0 for r in rows)
    assert right >= 108


def test_trees_and_calibration():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = boost.fit_trees(x[:1500], y[:1500])
    assert ((trees.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    steps = boost.fit_isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0, 1, 0, 1, 1]))
    assert np.all(np.diff(steps(np.linspace(0, 5, 50))) >= 0) and steps(np.array([0.0]))[0] < steps(np.array([5.0]))[0]
    assert boost.fit_trees(np.zeros((0, 3)), np.zeros(0)).probability(np.zeros((2, 3))).tolist() == [0.5, 0.5]


@pytest.mark.parametrize("name,column,least", [("op1_toxicity", "toxic", 0.8), ("op9_quality_classifier", "quality", 0.95)])
def test_held_out_ranking(spark, name, column, least):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r[column] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.score, truth[r.doc_id]) for r in QUERIES[name](spark, sf).collect() if r.held_out and r.doc_id in truth]
    high, low = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in high for b in low]) > least


def test_held_out_languages(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [truth[r.doc_id] == r.lang_pred for r in QUERIES["op8_language_id"](spark, sf).collect() if r.held_out]
    assert np.mean(held) > 0.98


def test_quality_counts_of_a_text():
    data = "Ä b c\nd\n\nÄ b c\nd # <é>".encode()
    assert quality_rules.text_counts(data) == (10, 12, 3, 1, 8)


def test_scratch_tables_are_shared_and_released(spark):
    from pathlib import Path

    from loomgrid.llm import common

    table = common.materialize(spark.range(3))
    folder = Path(common.scratch_root(spark).removeprefix("file://")) / f"loomgrid-{spark.sparkContext.applicationId}"
    assert table.count() == 3 and any(folder.iterdir())
    common.release(spark)
    assert not folder.exists()


@pytest.mark.parametrize("sources", [10_000, 0])
def test_equal_rows_and_missing_ids_are_drawn_each(spark, monkeypatch, sources):
    """A third of a source without an id, and a third of another one row many times: both come near their targets, however the rows are dealt."""
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", sources)
    words = " ".join("w" for _ in range(20))
    rows = [(i, words + f" {i}", "a") for i in range(3_000)] + [(None, words + f" n{i}", "a") for i in range(1_500)] + [(9, words, "b")] * 2_000 + [(10_000 + i, words + f" {i}", "b") for i in range(4_000)] + [(50_000 + i, words, None) for i in range(12_000)] + [(None, None, "c"), (None, "", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.copy_counts(docs).collect()
    by_source = {}
    for r in found:
        own = by_source.setdefault(r.mix_source, [0, r.target, r.source_size])
        own[0] += r.mix_size * r.mix_copies
    assert len(found) == len(rows) and all(abs(taken - target) <= 0.03 * target for taken, target, _ in by_source.values())
    assert abs(sum(t for _, t, _ in by_source.values()) - 1.5 * sum(s for *_, s in by_source.values())) < 1e-3
    twins = sorted(r.mix_copies for r in found if r.mix_id == 9)
    assert len(twins) == 2_001 and len(set(twins)) == 2
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, mixing.copy_counts(docs.repartition(13)).collect()), key=str)
    assert mixing.mix(docs).count() == sum(r.mix_copies for r in found)


def test_license_rows_that_are_very_often_equal(spark, monkeypatch):
    monkeypatch.setattr(licenses, "ROW_BLOCK", 7)
    rows = [(1, "under the MIT License here")] * 500 + [(None, None)] * 30 + [(i, f"text {i}") for i in range(2, 60)] + [(1, "other text")] * 8
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    counts = sorted((str(r.doc_id), r.base_labels) for r in found)
    assert len(found) == len(rows) and counts.count(("1", "mit")) == 500 and counts.count(("None", "")) == 30 and counts.count(("1", "")) == 8
