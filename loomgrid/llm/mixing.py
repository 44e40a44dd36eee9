"""Mixing sources to target weights with DataFrame operations only.

Tokens are summed per source, a source's repetition rate is its target over its size, and each document is emitted
floor(rate) times plus one copy drawn by a hash-seeded Bernoulli trial whose probability is the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.llm.common import WORD, join_classes, materialize, rank_rows

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MAX_REPEAT = 2
SEED = "mix-1"
#: A table of at most so many sources is broadcast; beyond it sources are joined by a salted shuffle.
BROADCAST_SOURCES = 10_000
SALTS = 64


def text_size(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = TOTAL_SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(mix_source, source_size, target) from rows (mix_source, mix_size), in a scratch table.

    Sources share `share` times all sizes by weight, none above `max_repeat` times its size; what exceeds that goes to the others by weight until none is above. Every
    round is an aggregation over one row per source: what is left to share, by the weights of those that are not capped yet. A list of more than `BROADCAST_SOURCES` sources is
    numbered by a range sort, so that it is no single task's either.
    """
    per = materialize(sizes.groupBy("mix_source").agg(F.sum("mix_size").alias("source_size")).withColumn("one", F.lit(0)))
    by_name = F.col("mix_source").asc_nulls_last()
    if per.count() <= BROADCAST_SOURCES:
        ranked = per.withColumn("r_rank", F.row_number().over(Window.partitionBy("one").orderBy(by_name)) - 1)
    else:
        ranked = rank_rows(per, "one", [by_name])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("r_rank") % len(WEIGHTS) + 1).cast("int"))
    per = materialize(ranked.select("mix_source", "source_size", weight.alias("w"), (F.col("source_size") * F.lit(float(max_repeat))).alias("cap")))
    whole = (per.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while True:
        over = F.col("cap") <= F.lit(level) * F.col("w")
        now = per.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("cap"))).alias("caps"), F.sum(F.when(~over, F.col("w"))).alias("weights")).first()
        if now["n"] == capped or not now["weights"]:
            break
        capped, level = now["n"], (whole - (now["caps"] or 0.0)) / now["weights"]
    return materialize(per.select("mix_source", "source_size", F.least("cap", F.lit(level) * F.col("w")).alias("target")))


def unit_draw(key: Column) -> Column:
    """A number in [0, 1) from a key of hex digits."""
    return F.conv(F.substring(F.md5(F.encode(key, "UTF-8")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def draw_key(doc_id: Column, source: Column, text: Column, seed: str = SEED) -> Column:
    """What a row's draw depends on besides its number among equal rows: the seed, id, source and text, so that reruns and other layouts agree."""
    parts = [F.coalesce(doc_id.cast("string"), F.lit("-")), F.coalesce(source, F.lit("-")), F.coalesce(F.md5(F.encode(text, "UTF-8")), F.lit("-"))]
    return F.md5(F.encode(F.concat_ws(":", F.lit(seed), *parts), "UTF-8"))


def copy_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False, seed: str = SEED) -> DataFrame:
    """Rows of `docs` with mix_size, source_size, target and mix_copies: how often the mix takes each document.

    Sizes are counted once into a scratch table and summed from there. A null source is a source of its own, last in order; a null text has size 0. A row's draw comes from its id,
    source and text, so rows that share an id, or have none, are drawn each; rows equal in all three are numbered, which a range sort does for those alone, and drawn by number. With
    `carry` the columns of `docs` come along as the struct mix_row, otherwise only id_col.
    """
    text, source = F.col(text_col), F.col(source_col)
    rows = docs.select(*([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_row")] if carry else []), F.col(id_col).alias("mix_id"), source.alias("mix_source"), text_size(text).alias("mix_size"), draw_key(F.col(id_col), source.cast("string"), text, seed).alias("mix_key"))
    narrow = materialize(rows.drop("mix_row").withColumn("mix_at", F.monotonically_increasing_id()))
    targets = source_targets(narrow.select("mix_source", "mix_size")).withColumn("mix_rate", F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))).withColumnRenamed("mix_source", "mix_of")
    repeated = materialize(narrow.groupBy("mix_key").agg(F.count("*").alias("mix_times")).filter("mix_times > 1").withColumnRenamed("mix_key", "mix_twin"))
    if repeated.isEmpty():
        sized = (rows.withColumn("mix_at", F.monotonically_increasing_id()) if carry else narrow).withColumn("mix_number", F.lit(0).cast("long"))
    else:
        whole = materialize(rows.withColumn("mix_at", F.monotonically_increasing_id())) if carry else narrow
        twins = join_classes(whole, repeated, "mix_key", "mix_twin", "mix_times", narrow.count()).drop("mix_twin", "mix_times")
        numbered = rank_rows(twins, "mix_key", [F.col("mix_at")]).withColumnRenamed("r_rank", "mix_number").drop("r_part", "r_total")
        single = whole.join(repeated.select("mix_twin"), F.col("mix_key") == F.col("mix_twin"), "left_anti")
        sized = single.withColumn("mix_number", F.lit(0).cast("long")).unionByName(numbered)
    if targets.count() <= BROADCAST_SOURCES:
        joined = sized.join(F.broadcast(targets), F.col("mix_source").eqNullSafe(F.col("mix_of")), "inner")
    else:
        salt = F.pmod(F.xxhash64("mix_at"), F.lit(SALTS)).cast("int")
        salted = targets.withColumn("mix_salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        same = F.col("mix_source").eqNullSafe(F.col("mix_of")) & (F.col("mix_salt") == F.col("mix_salt_of"))
        joined = sized.withColumn("mix_salt", salt).join(salted, same, "inner")
    whole = F.floor("mix_rate")
    extra = (unit_draw(F.concat("mix_key", F.lit(":"), F.col("mix_number").cast("string"))) < F.col("mix_rate") - whole).cast("long")
    joined = joined.withColumn("mix_copies", (whole + extra).cast("long"))
    return joined.select(*(["mix_row"] if carry else []), "mix_id", "mix_source", "mix_size", "source_size", "target", "mix_copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """The mix itself: the columns of `docs`, each row as many times as `copy_counts` says (0, 1 or more)."""
    counted = copy_counts(docs, id_col, text_col, source_col, carry=True, seed=seed)
    copies = counted.filter("mix_copies > 0").select("mix_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))).alias("mix_copy"))
    return copies.select("mix_row.*")


ORACLE = """
with d as (select doc_id, source, md5('mix-1:' || coalesce(doc_id::varchar, '-') || ':' || coalesce(source, '-') || ':' || coalesce(md5(text), '-')) as k, row_number() over (partition by doc_id, source, text) - 1 as twin, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select source, source_size, ([5.0, 2.0, 1.0]::double[])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::bigint] as w, source_size * 2.0::double as cap from s),
l as (
    select *, (sum(source_size) over () * 1.5::double - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0.0::double))
              / sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as level from w),
c as (select *, cap <= level * w as capped from l),
t as (select source, source_size, case when capped then cap else least(cap, (select arg_min(level, cap / w) from c where not capped) * w) end as target from c),
r as (
    select doc_id, size, source_size, target, coalesce(case when source_size > 0 then target / source_size end, 0.0::double) as rate,
           ('0x' || substr(md5(k || ':' || twin), 1, 13))::bigint / 4503599627370496.0::double as u
    from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target::double as target, (size * (floor(rate)::bigint + (u < rate - floor(rate))::bigint))::bigint as taken from r
"""
