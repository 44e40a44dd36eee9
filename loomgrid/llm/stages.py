"""Pipeline stages: each takes and returns rows of documents and lets one operator's decisions take effect.

All but packing return the columns that they were given, in their order. A row goes through an operator as one struct beside the columns that the operator reads, so
that a document may have columns of any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.llm import language_id, mixing, packing, quality_rules, simhash
from loomgrid.llm.common import materialize

#: Ids of dropped copies up to this number (8 bytes each) are broadcast; beyond it documents are joined to them by a shuffle.
BROADCAST_IDS = 1_000_000
#: Documents are rejected if their words are less certain than this: the mean, over words, of the largest probability that any language has there.
MIN_LANGUAGE_SCORE = 0.5


def _wrapped(docs: DataFrame, names: list[str], **needed: str) -> DataFrame:
    """st_row, a struct of the columns `names`, and the columns that an operator needs under the names given."""
    return docs.select(F.struct(F.lit(0).alias("st_any"), *[F.col(f"`{c}`") for c in names]).alias("st_row"), *[F.col(f"`{c}`").alias(to) for to, c in needed.items()])


def _field(name: str) -> Column:
    return F.col("st_row").getField(name)


def keep_quality(docs: DataFrame) -> DataFrame:
    """Documents that pass the quality rules, without boilerplate lines. n_chars, where there is such a column, counts what is left."""
    names = docs.columns
    rows = _wrapped(docs, [c for c in names if c != "text"], st_text="text", st_host="source")
    judged = quality_rules.apply_rules(rows, "st_text", "st_host", carry=("st_row",), rewrite=True).filter("q_kept")
    columns = {"text": F.col("q_text")} | ({"n_chars": F.length("q_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {})
    return judged.select(*[columns.get(c, _field(c)).alias(c) for c in names])


def keep_language(docs: DataFrame) -> DataFrame:
    """Documents in learned languages; `und` and documents whose words are not told with certainty go.

    Certainty is judged word by word, so a document of several languages stays even if none has half of it.

    The field is fitted on the documents at hand. Without any lang to learn from, nothing can be judged and all documents with a letter stay.
    """
    names = docs.columns
    model = language_id.fit(docs)
    if not model.labels:
        return docs.filter(F.regexp_like("text", F.lit(r"\p{L}")))
    rows = _wrapped(docs, [c for c in names if c != "text"], st_text="text")
    judged = language_id.identify(rows, model, carry=("st_row", "st_text"), text_col="st_text", certainty=True)
    kept = judged.filter((F.col("lid_lang") != language_id.UNKNOWN) & (F.col("lid_sure") >= MIN_LANGUAGE_SCORE))
    return kept.select(*[F.col("st_text").alias(c) if c == "text" else _field(c).alias(c) for c in names])


def keep_one_of_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each SimHash group: the one with the smallest id, or of several rows with that id in the group the least row.

    Ids decide where an id stands in one row, or in dropped rows only. Rows of other ids, and rows without an id, are told apart by id and
    fingerprint, since an id's rows can lie in different groups; a row without an id stays only if its group has no id.
    """
    names = docs.columns
    found = materialize(simhash.groups(docs))
    first = F.col("sim_id").eqNullSafe(F.col("sim_component"))
    ids = found.filter("sim_id is not null").groupBy("sim_id").agg(F.bool_or(first).alias("first"), F.count("*").alias("times"))
    out = materialize(ids.filter("not first or times > 1").select(F.col("sim_id").alias("sim_out"), "first"))
    few = out.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    sized = lambda table: F.broadcast(table) if few else table
    rows = _wrapped(docs, names, st_id="doc_id", st_text="text")
    given = lambda table: table.select(*[_field(c).alias(c) for c in names])
    kept = rows.join(sized(out.select("sim_out")), F.col("st_id") == F.col("sim_out"), "left_anti")
    # Rare: ids that stand in more than one row, and rows without an id.
    again = out.filter("first").select("sim_out")
    nulls = found.filter("sim_id is null").limit(1).count()
    if again.isEmpty() and not nulls:
        return given(kept)
    rest = rows.join(sized(again), F.col("st_id") == F.col("sim_out"), "left_semi").unionByName(rows.filter("st_id is null"))
    rest = simhash.with_fingerprints(rest, "st_text").groupBy("st_id", F.col("sim_fp").alias("sim_mark")).agg(F.min("st_row").alias("st_row"))
    roots = found.filter(first).select("sim_id", "sim_fp", "sim_root").distinct()
    rest = rest.join(roots, F.col("st_id").eqNullSafe(F.col("sim_id")) & (F.col("sim_mark") == F.col("sim_fp")))
    rest = rest.groupBy("sim_root").agg(F.min("st_row").alias("st_row"))
    return given(kept.filter("st_id is not null").select("st_row").unionByName(rest.select("st_row")))


def mix_sources(docs: DataFrame) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mix(docs)


def pack_sequences(docs: DataFrame) -> DataFrame:
    """The packed pieces of all documents."""
    return packing.pack(docs).withColumnRenamed("pk_id", "doc_id")
