"""License scans by diagonal voting, with DataFrame operations only.

Every rolling word 2-gram of every text is hashed and joined to the template positions with that hash. A match votes
for the diagonal (place in the text minus place in the template). Votes are summed per diagonal and neighbouring
diagonals of a template are merged. A span so found is verified: its words are aligned with the template's in order, the aligned words
must cover enough of the template, and the 2-grams that tell it from others (a version, a name) must be among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.llm.common import ascii_lower, materialize

#: Separators between words, for Java's regular expressions: ASCII except digits and letters.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Longer templates of the method, their labels, and the 2-grams without which a span does not count.
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache-2.0", ("apache license", "version 2", "2 0")),
    ("you may not use this file except in compliance with the license", "apache-2.0-notice", ()),
    ("distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache-2.0-notice", ()),
    ("released under the mit license", "mit-release", ("mit license",)),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-text", ()),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit-text", ()),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", ()),
    ("gnu general public license version 2", "gpl-2.0", ("gnu general", "public license", "version 2")),
    ("gnu general public license version 3", "gpl-3.0", ("gnu general", "public license", "version 3")),
    ("this program is free software you can redistribute it and or modify it under the terms of", "gpl-notice", ()),
    ("creative commons attribution", "cc-by", ("creative commons", "commons attribution")),
    ("licensed under cc by 4 0", "cc-by-4.0", ("cc by", "by 4", "4 0")),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0", ("cc by", "by sa", "sa 4", "4 0")),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0", ("cc by", "by nc", "nc 4", "4 0")),
    ("mozilla public license version 2 0", "mpl-2.0", ("mozilla public", "public license", "version 2", "2 0")),
    ("all rights reserved", "all-rights-reserved", ("all rights", "rights reserved")),
)
#: Diagonals of a template at most so far apart are merged: words inserted or left out shift the diagonal.
MERGE_GAP = 3
#: Least share of a template's words that a span's aligned words must cover.
MIN_COVER = 0.8
#: Rows equal in id and text that one row is multiplied into by one task.
ROW_BLOCK = 10_000


def _templates() -> list[tuple[int, str, bool, list[str], list[int]]]:
    """(number, label, base, words, places of compulsory 2-grams); all 2-grams of a base phrase are compulsory."""
    out = []
    for t, (phrase, label, *must) in enumerate((*BASE, *TEMPLATES)):
        words, base = phrase.split(), t < len(BASE)
        grams = [" ".join(x) for x in zip(words, words[1:], strict=False)]
        if must and not set(must[0]) <= set(grams):
            raise ValueError(f"{phrase!r} lacks one of {must[0]}")
        out.append((t, label, base, words, [p for p, g in enumerate(grams) if base or g in must[0]]))
    return out


def template_grams(spark: SparkSession) -> DataFrame:
    """(lic_t, lic_pos, lic_a, lic_b, lic_hash): every 2-gram of every template. From the constants above: a few hundred rows whatever the input."""
    rows = [(t, p, a, b) for t, _, _, words, _ in _templates() for p, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    return spark.createDataFrame(rows, "lic_t int, lic_pos int, lic_a string, lic_b string").withColumn("lic_hash", F.xxhash64("lic_a", "lic_b"))


def template_facts(spark: SparkSession) -> DataFrame:
    """(lic_of, lic_label, lic_base, lic_len, lic_must): one row for each template."""
    rows = [(t, label, base, len(words), must) for t, label, base, words, must in _templates()]
    return spark.createDataFrame(rows, "lic_of int, lic_label string, lic_base boolean, lic_len int, lic_must array<int>")


def words_of(text: Column) -> Column:
    """Words with A-Z lower-cased; an empty array for null."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def votes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(lic_id, lic_key, lic_words, lic_t, lic_diag, lic_places, lic_rows): the template places that voted for a diagonal of a text.

    Rows with one id and one text vote together; each text also has a row without a template, where lic_rows counts the rows that hold it.
    """
    narrow = docs.select(F.col(id_col).alias("lic_id"), F.xxhash64(text_col, F.length(text_col)).alias("lic_key"), words_of(F.col(text_col)).alias("lic_w"))
    # Each word with the one before it; the first pair has none before it, so it matches nothing and stands for the row, even an empty one.
    pairs = F.arrays_zip(F.array_prepend("lic_w", F.lit(None).cast("string")).alias("a"), F.col("lic_w").alias("b"))
    grams = narrow.select("lic_id", "lic_key", F.size("lic_w").cast("long").alias("lic_words"), F.posexplode(pairs).alias("lic_at", "lic_pair"))
    grams = grams.select("lic_id", "lic_key", "lic_words", "lic_at", F.col("lic_pair.a").alias("lic_ga"), F.col("lic_pair.b").alias("lic_gb"))
    grams = grams.withColumn("lic_gram", F.when(F.col("lic_ga").isNotNull() & F.col("lic_gb").isNotNull(), F.xxhash64("lic_ga", "lic_gb")))
    found = grams.join(F.broadcast(template_grams(docs.sparkSession)), F.col("lic_gram") == F.col("lic_hash"), "left")
    same = (F.col("lic_ga") == F.col("lic_a")) & (F.col("lic_gb") == F.col("lic_b"))  # equal hashes are not yet equal words
    found = found.filter((F.col("lic_at") == 0) | same)
    diagonal = (F.col("lic_at") - 1 - F.col("lic_pos")).alias("lic_diag")
    found = found.select("lic_id", "lic_key", "lic_words", "lic_t", diagonal, "lic_pos", (F.col("lic_at") == 0).alias("lic_row"))
    return found.groupBy("lic_id", "lic_key", "lic_words", "lic_t", "lic_diag").agg(F.collect_set("lic_pos").alias("lic_places"), F.count_if("lic_row").alias("lic_rows"))


def aligned_words(diagonals: Column, length: Column) -> Column:
    """Most words of a template that can be aligned with words of the text in the order of both.

    `diagonals` has (lic_diag, lic_places). A match of a 2-gram aligns two words. Taken by place in the text, and at one place from the template's end, each
    pair of words extends the longest chain that ends before it in the template.
    """
    two = lambda d, p: F.array(*[F.struct((d + p + i).alias("at"), (-p - i).alias("back")) for i in (0, 1)])
    pairs = F.flatten(F.transform(diagonals, lambda r: F.flatten(F.transform(r["lic_places"], lambda p: two(r["lic_diag"], p)))))

    def extend(best: Column, pair: Column) -> Column:
        chain = F.coalesce(F.array_max(F.slice(best, F.lit(1), -pair["back"])), F.lit(0)) + 1
        return F.transform(best, lambda v, i: F.when(i == -pair["back"], F.greatest(v, chain)).otherwise(v))

    return F.array_max(F.aggregate(F.array_sort(F.array_distinct(pairs)), F.array_repeat(F.lit(0), length), extend))


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified spans (lic_id, lic_key, lic_words, lic_rows, lic_label, lic_base, lic_start, lic_end, lic_cover) of each text, and for each text a row without a span.

    A base phrase must stand on one diagonal with all its 2-grams. A longer template's span joins diagonals at most `MERGE_GAP` apart; it must hold all
    compulsory 2-grams, and its words, aligned in order, must cover `MIN_COVER` of the template's.
    """
    doc = ["lic_id", "lic_key", "lic_words"]
    by_template = Window.partitionBy(*doc, "lic_t").orderBy("lic_diag")
    voted = votes(docs, id_col, text_col).join(F.broadcast(template_facts(docs.sparkSession)), F.col("lic_t") == F.col("lic_of"), "left")
    far = F.coalesce(F.col("lic_diag") - F.lag("lic_diag").over(by_template) > F.when(F.col("lic_base"), 0).otherwise(MERGE_GAP), F.lit(False))
    grouped = voted.withColumn("lic_far", far.cast("int"))
    grouped = grouped.withColumn("lic_run", F.sum("lic_far").over(by_template))
    runs = grouped.groupBy(*doc, "lic_t", "lic_label", "lic_base", "lic_len", "lic_must", "lic_run").agg(
        F.sum("lic_rows").alias("lic_rows"), F.collect_list(F.struct("lic_diag", "lic_places")).alias("lic_votes"),
        F.min(F.col("lic_diag") + F.array_min("lic_places")).cast("long").alias("lic_start"), (F.max(F.col("lic_diag") + F.array_max("lic_places")) + 2).cast("long").alias("lic_end"))
    places = F.array_distinct(F.flatten("lic_votes.lic_places"))
    # The cheap conditions first: n places align n + 1 words on one diagonal, and two words each at most.
    maybe = (F.size(F.array_except("lic_must", places)) == 0) & (2 * F.size(places) >= F.lit(MIN_COVER) * F.col("lic_len"))
    runs = runs.withColumn("lic_cover", F.when(maybe, aligned_words(F.col("lic_votes"), F.col("lic_len"))) / F.col("lic_len"))
    good = F.col("lic_cover") >= F.when(F.col("lic_base"), 1.0).otherwise(MIN_COVER)
    return runs.filter(good | F.col("lic_t").isNull()).select(*doc, "lic_rows", "lic_label", "lic_base", "lic_start", "lic_end", "lic_cover")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best cover).

    A null text is empty; an empty one has no words, empty labels and score 0. Rows that repeat an id and a text give equal rows, as many as there
    are; a null id is an id like any other; an empty table gives an empty result. Other columns are not read.
    """
    joined = lambda only: F.array_join(F.array_sort(F.collect_set(F.when(only, F.col("lic_label")))), ",")
    base = F.col("lic_base")
    texts = license_spans(docs, id_col, text_col).groupBy("lic_id", "lic_key", "lic_words").agg(
        F.sum("lic_rows").alias("lic_rows"), F.count_if(base).cast("long").alias("n_base"), F.min(F.when(base, F.col("lic_start"))).alias("first_word"), F.max(F.when(base, F.col("lic_start"))).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.lit(True)).alias("labels"), F.coalesce(F.max("lic_cover"), F.lit(0.0)).alias("score"))
    # Rows equal in id and text were judged as one. Few of them are written out in place; many in blocks that are dealt over all tasks first.
    texts = materialize(texts)
    few, many = texts.filter(F.col("lic_rows") <= ROW_BLOCK), texts.filter(F.col("lic_rows") > ROW_BLOCK)
    if not many.isEmpty():
        dealt = many.withColumn("lic_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(lic_rows - 1) div {ROW_BLOCK}"))))
        dealt = dealt.withColumn("lic_rows", F.least(F.lit(ROW_BLOCK), F.col("lic_rows") - ROW_BLOCK * F.col("lic_block")))
        few = few.unionByName(dealt.repartition("lic_id", "lic_key", "lic_block").drop("lic_block"))
    each = few.withColumn("lic_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("lic_rows"))))
    return each.select(F.col("lic_id").alias(id_col), F.col("lic_words").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _oracle() -> str:
    """The same report in DuckDB without hashes, votes or dynamic programming: single words are matched, pairs of them in a row are found by a
    self-join, and chains of aligned words are enumerated by recursion."""
    words = ", ".join(f"({t}, {p}, '{w}')" for t, _, _, ws, _ in _templates() for p, w in enumerate(ws))
    facts = ", ".join(f"({t}, '{label}', {str(base).lower()}, {len(ws)}, {len(must)})" for t, label, base, ws, must in _templates())
    musts = ", ".join(f"({t}, {p})" for t, _, _, _, must in _templates() for p in must)
    return f"""
with recursive tw(t, p, word) as (values {words}),
tf(t, label, base, n, musts) as (values {facts}),
mu(t, p) as (values {musts}),
d as (select row_number() over () as rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
u as (select rid, unnest(w) as word, generate_subscripts(w, 1) - 1 as a from d),
m as (select rid, t, a, p, a - p as diag from u join tw using (word)),
h as (select x.rid, x.t, x.a, x.p, x.diag from m x join m y on y.rid = x.rid and y.t = x.t and y.a = x.a + 1 and y.p = x.p + 1),
g as (select distinct rid, t, diag from h),
f as (select g.*, case when diag - lag(diag) over (partition by rid, t order by diag) > case when base then 0 else {MERGE_GAP} end then 1 else 0 end as far from g join tf using (t)),
r as (select rid, t, diag, sum(far) over (partition by rid, t order by diag rows between unbounded preceding and current row) as run from f),
hr as (select h.*, run from h join r on r.rid = h.rid and r.t = h.t and r.diag = h.diag),
likely as (
    select rid, t, run, min(a) as start from hr join tf using (t) left join mu using (t, p) group by rid, t, run, n, musts
    having count(distinct mu.p) = musts and 2 * count(distinct p) >= {MIN_COVER}::double * n),
wr as (select distinct rid, t, run, a + i as a, p + i as p from hr join likely using (rid, t, run), (select unnest([0, 1]) as i)),
chain(rid, t, run, a, p, long) as (
    select rid, t, run, a, p, 1 from wr
    union select c.rid, c.t, c.run, x.a, x.p, c.long + 1 from chain c join wr x on x.rid = c.rid and x.t = c.t and x.run = c.run and x.a > c.a and x.p > c.p),
s as (select rid, t, run, max(long) as long from chain group by rid, t, run),
v as (select rid, label, base, long / n::double as cover, start from s join likely using (rid, t, run) join tf using (t) where long / n::double >= case when base then 1.0 else {MIN_COVER} end)
select d.doc_id, len(w)::bigint as n_words, count(*) filter (where base)::bigint as n_base, (min(start) filter (where base))::bigint as first_word, (max(start) filter (where base))::bigint as last_word,
       coalesce(string_agg(distinct label, ',' order by label) filter (where base), '') as base_labels, coalesce(string_agg(distinct label, ',' order by label), '') as labels, coalesce(max(cover), 0.0)::double as score
from d left join v on v.rid = d.rid group by d.rid, d.doc_id, w
"""


ORACLE = _oracle()
