"""Quality rules: per-text counts, and cross-document line frequency by host.

Lines are normalised and hashed, the distinct documents that hold a line are counted per host, lines above the limit
are removed, and a document left with too little is rejected. Rows with equal texts are copies of one document and count once: a
text that was copied a thousand times would otherwise condemn all its lines, and removing copies is another operator's work.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomgrid.llm.common import LOWER, UPPER, materialize, text_batches

#: Base rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is boilerplate in a host if it stands in at least so many distinct texts there, and in more than this share of them. Prose does not
#: repeat whole lines in one text of a hundred; the count keeps small hosts from losing lines that two or three texts share.
MIN_TEXTS = 5
MAX_SHARE = 0.01
#: A document is depleted if removal leaves less than this share of its words, or fewer than `MIN_WORDS`.
MIN_LEFT = 0.3
#: Boilerplate lines of at most this number (16 bytes each) are broadcast; beyond it documents look them up by a shuffled join.
BROADCAST_LINES = 200_000

SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_CONTINUES = (np.arange(256) & 0xC0) == 0x80


def line_key(words: list[bytes]) -> int:
    """Hash of a line's words, lower-cased in A-Z and joined by one space, as a signed 64-bit integer."""
    return xxhash.xxh64_intdigest(b" ".join(words).lower()) - (1 << 63)


def line_keys(data: bytes) -> set[int]:
    """Keys of the lines that hold a word."""
    return {line_key(words) for line in data.split(b"\n") if (words := line.split())}


def text_counts(data: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a UTF-8 text.

    >>> text_counts(b"a b c\\nx\\na b c\\n\\nx")
    (8, 8, 0, 2, 6)
    """
    if not data:
        return 0, 0, 0, 0, 0
    codes = np.frombuffer(data, np.uint8)
    per = np.bincount(codes, minlength=256)
    word_chars = len(data) - int(per[_IS_SPACE].sum() + per[_CONTINUES].sum())
    lines = [line for line in data.split(b"\n") if line and not line.isspace()]
    words = data.split()
    repeated = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(windows) > len(set(windows)):
        times = Counter(windows)
        end = 0  # words before this one are counted
        for at, window in enumerate(windows):
            if times[window] > 1:
                repeated += at + 3 - max(at, end)
                end = at + 3
    return len(words), word_chars, int(per[_IS_SYMBOL].sum()), len(lines) - len(set(lines)), repeated


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def boilerplate(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(host_key, line_key): the lines above the limit, in a scratch table.

    Counting goes by two partial aggregations, (host, line, text) and then (host, line), so a line that a third of
    all documents hold reaches its final task as one count per map task. A null host is a host of its own.
    """

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, texts, keys = [], [], []
            for host, key, text in zip(batch["host_key"].to_pylist(), batch["text_key"].to_pylist(), batch["text"], strict=True):
                found = line_keys((text.as_py() or "").encode())
                keys += found
                hosts += [host] * len(found)
                texts += [key] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (hosts, texts, keys)], names=["host_key", "text_key", "line_key"])

    narrow = text_batches(docs).select(F.xxhash64(F.col(host_col)).alias("host_key"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    per_host = narrow.groupBy("host_key", "text_key").agg(F.lit(1)).groupBy("host_key").agg(F.count("*").alias("texts"))
    held = narrow.mapInArrow(lines, "host_key long, text_key long, line_key long").groupBy("host_key", "line_key", "text_key").agg(F.lit(1))
    often = held.groupBy("host_key", "line_key").agg(F.count("*").alias("held")).filter(F.col("held") >= MIN_TEXTS)
    return materialize(often.join(per_host, "host_key").filter(F.col("held") > F.lit(MAX_SHARE) * F.col("texts")).select("host_key", "line_key"))


def _left(data: bytes, frequent: set[int], rewrite: bool) -> tuple[int, bytes]:
    """Words in lines that stay, and the text without the others."""
    if not frequent:
        return len(data.split()), data
    lines = data.split(b"\n")
    stay = [line for line in lines if not (w := line.split()) or line_key(w) not in frequent]
    return sum(len(line.split()) for line in stay), b"\n".join(stay) if rewrite and len(stay) < len(lines) else data


def apply_rules(docs: DataFrame, text_col: str = "text", host_col: str = "source", carry: tuple[str, ...] = ("doc_id",), rewrite: bool = False) -> DataFrame:
    """The columns `carry`, then q_words, q_word_chars, q_symbols, q_dup_lines, q_repeat_words, q_failed, q_kept; with `rewrite` also q_text.

    q_text is the text without boilerplate lines. A null text has no words and fails; a text of white space too. Every
    row gets its own verdict, repeated rows the same one. The verdict needs only the row and the boilerplate lines of its
    host: where those are few enough to broadcast no text is shuffled, otherwise they are joined to the documents by
    host and line.
    """
    lines = boilerplate(docs, text_col, host_col)
    few = lines.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    narrow = docs.select(*[F.col(f"`{c}`") for c in carry], F.xxhash64(F.col(host_col)).alias("q_host"), F.col(text_col).alias("q_in"))
    if few:
        by_host: dict[int, set[int]] = {}
        for host, line in lines.collect():
            by_host.setdefault(host, set()).add(line)
        held = docs.sparkSession.sparkContext.broadcast(by_host)
        narrow = narrow.withColumn("q_lines", F.lit(None).cast("array<long>"))
    else:
        narrow, held = _with_lines(narrow, lines), None

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none: set[int] = set()
        for batch in batches:
            rows, texts = [], []
            for host, own, text in zip(batch["q_host"].to_pylist(), batch["q_lines"].to_pylist(), batch["q_in"], strict=True):
                value = text.as_py()
                data = (value or "").encode()
                counts = text_counts(data)
                stay, kept_text = _left(data, held.value.get(host, none) if held else set(own or ()), rewrite)
                failed = base_failed(counts[0], counts[4])
                rows.append((*counts, failed, not failed and stay >= max(MIN_WORDS, MIN_LEFT * counts[0])))
                if rewrite:
                    texts.append(None if value is None else kept_text.decode())
            out = list(zip(*rows, strict=True)) if rows else [()] * 7
            arrays = [batch[c] for c in carry] + [pa.array(x, pa.int64()) for x in out[:5]] + [pa.array(x, pa.bool_()) for x in out[5:]]
            names = [*carry, "q_words", "q_word_chars", "q_symbols", "q_dup_lines", "q_repeat_words", "q_failed", "q_kept"]
            if rewrite:
                arrays, names = [*arrays, pa.array(texts, pa.string())], [*names, "q_text"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    counts = "q_words long, q_word_chars long, q_symbols long, q_dup_lines long, q_repeat_words long, q_failed boolean, q_kept boolean" + ", q_text string" * rewrite
    return narrow.mapInArrow(judge, StructType([*[narrow.schema[c] for c in carry], *StructType.fromDDL(counts)]))


def _with_lines(narrow: DataFrame, lines: DataFrame) -> DataFrame:
    """Adds q_lines, the boilerplate lines that a row's own text holds, by joining its lines to theirs.

    The join is on (host, line); the optimiser splits a line that very many documents hold.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(h, t, k) for h, t, x in zip(batch["h"].to_pylist(), batch["t"].to_pylist(), batch["x"], strict=True) for k in line_keys((x.as_py() or "").encode())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["host_key", "q_text_key", "line_key"])

    keyed = narrow.withColumn("q_text_key", F.xxhash64("q_in"))
    each = keyed.select(F.col("q_host").alias("h"), F.col("q_text_key").alias("t"), F.col("q_in").alias("x")).mapInArrow(own, "host_key long, q_text_key long, line_key long")
    hit = each.join(lines, ["host_key", "line_key"]).groupBy(F.col("host_key").alias("q_host"), "q_text_key").agg(F.collect_set("line_key").alias("q_lines"))
    return keyed.join(hit, ["q_host", "q_text_key"], "left").drop("q_text_key")


ORACLE = f"""
with d as (select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
b as (
    select doc_id, source, text, w, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
           list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from d),
g as (select doc_id, i, concat_ws(chr(9), w[i], w[i + 1], w[i + 2]) as gram from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
a as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, gram) as n from g) where n > 1),
p as (select doc_id, count(distinct j) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as j from a) group by doc_id),
l as (
    select doc_id, source, text, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) as n,
           array_to_string(regexp_extract_all(translate(line, '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+'), ' ') as k
    from (select doc_id, source, text, unnest(ls) as line from b)),
h as (select source, count(distinct text) as texts from d group by source),
f as (select l.source, k from l join h on h.source is not distinct from l.source group by l.source, k, texts having count(distinct text) >= {MIN_TEXTS} and count(distinct text) > {MAX_SHARE}::double * texts),
r as (select doc_id, sum(n) as gone from l join f on f.source is not distinct from l.source and f.k = l.k group by doc_id)
select b.doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
       coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
       (n_words < {MIN_WORDS} or 100 * coalesce(n_repeat_words, 0) > {MAX_REPEAT_PERCENT} * n_words) as base_failed,
       not (n_words < {MIN_WORDS} or 100 * coalesce(n_repeat_words, 0) > {MAX_REPEAT_PERCENT} * n_words) and n_words - coalesce(gone, 0) >= greatest({MIN_WORDS}::double, {MIN_LEFT}::double * n_words) as kept
from b left join p on p.doc_id = b.doc_id left join r on r.doc_id = b.doc_id
"""
