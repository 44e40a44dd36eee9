"""Line dedup: lines that stand in many documents go from all of them but one.

The lines that are repeated often enough get a sharded minimal perfect hash: a shard is a cascade of bit arrays, in which a key's bit is set on the first level where no other key of
the shard falls on it, and the number of set bits before it is its place in compact arrays: a fingerprint, the number of documents and the keeper, the largest id. Documents hash
their own lines and probe the arrays, so no line is joined and no text is shuffled. A line's key has 128 bits: with the shard and the level they give its place, and 64 of them are
its fingerprint, so of 10^12 lines that are not in the index one would be taken for another with a probability of 10^-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import materialize, text_batches

#: A line is dropped if its key has at least so many code points and stands in at least so many documents.
MIN_CHARS, MIN_DOCS = 40, 5
#: Keys of a shard; keys (about 21 bytes each) that are broadcast at most, the most frequent ones; lines that one task probes beyond that.
SHARD_KEYS, BROADCAST_KEYS, PROBES = 1 << 16, 500_000, 500_000
#: Bits of a level for each key that is left, and levels at most: each level leaves about 39 % of its keys.
ROOM, LEVELS = 2, 200
_MIX = np.uint64(0x9E3779B97F4A7C15)


def line_key(line: bytes) -> bytes:
    """A line without white space at its ends and in lower case (A-Z)."""
    return line.strip().lower()


def long_lines(lines: list[bytes], min_chars: int) -> Iterator[tuple[int, bytes]]:
    """(number, 128-bit hash) of the lines whose keys are long enough."""
    for number, line in enumerate(lines):
        if len(line) >= min_chars:
            key = line.strip().lower()
            if len(key) >= min_chars and (key.isascii() or len(key.decode(errors="replace")) >= min_chars):
                yield number, xxhash.xxh3_128_digest(key)


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _mixed(high: np.ndarray, low: np.ndarray, level: int) -> np.ndarray:
    """A hash of both halves for one level."""
    with np.errstate(over="ignore"):
        x = (high + np.uint64(level + 1) * _MIX) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29)) ^ low) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def shard_of(low: np.ndarray, shards: int) -> np.ndarray:
    return (low >> np.uint64(33)) % np.uint64(shards)


def shard_column(low: str, shards: int) -> Column:
    return F.pmod(F.shiftrightunsigned(low, 33), F.lit(shards).cast("long"))


def build_shard(high: np.ndarray, low: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(words of each level, bits of all levels as 64-bit words, place of each key) of a minimal perfect hash of distinct keys."""
    sizes, bits, place, left, done = [], [], np.zeros(len(high), np.int64), np.arange(len(high)), 0
    for level in range(LEVELS):
        if not len(left):
            return sizes, np.concatenate(bits) if bits else np.zeros(0, np.uint64), place
        words = -(-ROOM * len(left) // 64)
        at = (_mixed(high[left], low[left], level) % np.uint64(64 * words)).astype(np.int64)
        alone = np.bincount(at, minlength=64 * words) == 1
        packed = np.packbits(alone, bitorder="little").view("<u8").astype(np.uint64)
        settled = alone[at]
        rank = np.cumsum(alone) - 1
        place[left[settled]] = done + rank[at[settled]]
        done += int(alone.sum())
        sizes.append(words)
        bits.append(packed)
        left = left[~settled]
    raise ValueError("keys of a shard are not distinct")


INDEX = "i_shard long, i_sizes array<long>, i_bits binary, i_prints binary, i_counts binary, i_keepers binary"


def index(lines: DataFrame, shards: int) -> DataFrame:
    """One row for each shard that has keys (the columns `INDEX`). `lines` has (l_high, l_low, l_docs, l_keeper), one row for each key."""

    def build(table: pa.Table) -> pa.Table:
        columns = [np.asarray(table[c].combine_chunks()) for c in ("l_high", "l_low", "l_docs", "l_keeper")]
        high, low = (c.view(np.uint64) for c in columns[:2])
        sizes, bits, place = build_shard(high, low)
        order = np.argsort(place)
        arrays = (bits, high[order], np.minimum(columns[2][order], (1 << 32) - 1).astype(np.uint32), columns[3][order])
        out = {"i_shard": [int(shard_of(low[:1], shards)[0])], "i_sizes": [sizes]} | {n: [a.tobytes()] for n, a in zip(("i_bits", "i_prints", "i_counts", "i_keepers"), arrays, strict=True)}
        return pa.table(out, pa.schema([("i_shard", pa.int64()), ("i_sizes", pa.list_(pa.int64())), *[(n, pa.binary()) for n in ("i_bits", "i_prints", "i_counts", "i_keepers")]]))

    return lines.withColumn("l_shard", shard_column("l_low", shards)).groupBy("l_shard").applyInArrow(build, INDEX)


class Probe:
    """The arrays of some shards, for looking up many keys at once."""

    def __init__(self, rows: list[dict], shards: int) -> None:
        self.shards = shards
        depth = max((len(r["i_sizes"]) for r in rows), default=0)
        self.words, self.first = np.zeros((shards, depth), np.int64), np.zeros((shards, depth), np.int64)
        at = 0
        for r in rows:
            self.words[r["i_shard"], : len(r["i_sizes"])] = r["i_sizes"]
            self.first[r["i_shard"], : len(r["i_sizes"])] = at + np.cumsum([0, *r["i_sizes"][:-1]])
            at += sum(r["i_sizes"])
        join = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in rows]) if rows else np.zeros(0, kind)
        self.bits, self.prints, self.counts, self.keepers = join("i_bits", np.uint64), join("i_prints", np.uint64), join("i_counts", np.uint32), join("i_keepers", np.int64)
        # Shards follow each other in all arrays, so the set bits before a bit, over all shards, are its key's place.
        self.before = np.cumsum(np.bitwise_count(self.bits).astype(np.int64)) - np.bitwise_count(self.bits)

    def find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Each key's place in the arrays, or -1."""
        found = np.full(len(high), -1)
        left, shard = np.arange(len(high)), shard_of(low, self.shards).astype(np.int64)
        for level in range(self.words.shape[1]):
            words = self.words[shard[left], level]
            left, words = left[words > 0], words[words > 0]
            if not len(left):
                break
            bit = _mixed(high[left], low[left], level) % (64 * words).astype(np.uint64)
            word, within = self.first[shard[left], level] + (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
            row = self.bits[word]
            is_set = (row >> within & np.uint64(1)).astype(bool)
            place = self.before[word] + np.bitwise_count(row & ((np.uint64(1) << within) - np.uint64(1)))
            hit = is_set.copy()
            hit[is_set] = self.prints[place[is_set]] == high[left[is_set]]
            found[left[hit]] = place[hit]
            left = left[~is_set]
        return found


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(l_high, l_low, l_docs, l_keeper): the hash of every key that stands in at least `min_docs` documents, their number and the largest id, in a scratch table.

    A document is an id; rows without an id count as one. A key goes to its last task as one count for each task before.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, found = [], []
            for i, text in enumerate(batch["x"]):
                digests = {d for _, d in long_lines((text.as_py() or "").encode().split(b"\n"), min_chars)}
                found += digests
                own += [i] * len(digests)
            high, low = _halves(found)
            for part in range(0, len(own), 100_000):
                at = slice(part, part + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(high[at].view(np.int64)), pa.array(low[at].view(np.int64)), batch["l_id"].take(pa.array(own[at], pa.int64()))], names=["l_high", "l_low", "l_id"])

    narrow = text_batches(docs).select(F.col(id_col).cast("long").alias("l_id"), F.col(text_col).alias("x"))
    held = narrow.mapInArrow(keys, "l_high long, l_low long, l_id long").groupBy("l_high", "l_low", "l_id").agg(F.lit(1))
    return materialize(held.groupBy("l_high", "l_low").agg(F.count("*").alias("l_docs"), F.max("l_id").alias("l_keeper")).filter(F.col("l_docs") >= min_docs))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per row of `docs`: l_id, the columns `carry`, l_lines (lines before), l_dropped, l_text (the lines that stay, joined by \\n).

    A line goes if its key is in the index, unless the row's id is the key's keeper; every row of the keeper keeps all its lines. Ids are integers; a null id
    keeps nothing that is repeated. A null text has one empty line and stays null, an empty one stays empty; a line dropped from between two others leaves no trace. White space and
    case count only in keys. An empty table gives an empty result; other columns are not read.
    """
    lines = repeated_lines(docs, id_col, text_col, min_chars, min_docs)
    count = lines.count()
    rest = None
    if count > BROADCAST_KEYS:
        # The most frequent keys are broadcast: those above the least power of two that leaves few enough.
        sizes = {r.p: r["count"] for r in lines.groupBy(F.floor(F.log2("l_docs")).alias("p")).count().collect()}
        bound = next(b for b in range(65) if sum(n for p, n in sizes.items() if p >= b) <= BROADCAST_KEYS)
        rest, lines = lines.filter(F.col("l_docs") < F.lit(1 << bound)), lines.filter(F.col("l_docs") >= F.lit(1 << bound))
    shards = max(1, -(-min(count, BROADCAST_KEYS) // SHARD_KEYS))
    # At most BROADCAST_KEYS keys.
    held = docs.sparkSession.sparkContext.broadcast(Probe([r.asDict() for r in index(lines, shards).collect()], shards))
    narrow = text_batches(docs).select(F.col(id_col).cast("long").alias("l_id"), *[F.col(f"`{c}`") for c in carry], F.col(text_col).alias("l_in"))
    more = narrow.withColumn("l_more", F.lit(None).cast("array<binary>")) if rest is None else _with_rare(narrow, rest, count, min_chars)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = held.value
        for batch in batches:
            split, ids, row_of, number_of, digests = [], batch["l_id"].to_pylist(), [], [], []
            for i, text in enumerate(batch["l_in"]):
                own = (text.as_py() or "").encode().split(b"\n")
                split.append(own)
                for number, digest in long_lines(own, min_chars):
                    row_of.append(i)
                    number_of.append(number)
                    digests.append(digest)
            gone: list[set[int]] = [set() for _ in split]
            place = probe.find(*_halves(digests))
            for at in np.flatnonzero(place >= 0).tolist():
                if probe.keepers[place[at]] != ids[row_of[at]]:
                    gone[row_of[at]].add(number_of[at])
            for i, extra in enumerate(batch["l_more"].to_pylist()):
                if extra:
                    extra = set(extra)
                    gone[i] |= {number for number, digest in long_lines(split[i], min_chars) if digest in extra}
            kept = [None if not x.is_valid else x if not g else b"\n".join(line for n, line in enumerate(s) if n not in g).decode(errors="replace") for x, s, g in zip(batch["l_in"], split, gone, strict=True)]
            arrays = [batch["l_id"], *[batch[c] for c in carry], pa.array(map(len, split), pa.int64()), pa.array(map(len, gone), pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["l_id", *carry, "l_lines", "l_dropped", "l_text"])

    shape = "".join(f"`{c}` {narrow.schema[c].dataType.simpleString()}, " for c in carry)
    return more.mapInArrow(judge, f"l_id long, {shape}l_lines long, l_dropped long, l_text string")


def _with_rare(narrow: DataFrame, lines: DataFrame, count: int, min_chars: int) -> DataFrame:
    """Adds l_more: the hashes of a row's lines that are in the index of `lines` and that the row does not keep.

    Lines meet the shard that would have them, which is dealt over as many tasks as keep a task at `PROBES` lines; rows equal in id and text probe once. No line here is among
    the most frequent, so no shard has much more than its share.
    """
    shards = max(1, -(-count // SHARD_KEYS))
    arrays = materialize(index(lines, shards))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, found = [], []
            for i, text in enumerate(batch["l_in"]):
                digests = {d for _, d in long_lines((text.as_py() or "").encode().split(b"\n"), min_chars)}
                found += digests
                own += [i] * len(digests)
            high, low = _halves(found)
            for part in range(0, len(own), 100_000):
                at, taken = slice(part, part + 100_000), pa.array(own[part : part + 100_000], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(high[at].view(np.int64)), pa.array(low[at].view(np.int64)), batch["l_id"].take(taken), batch["l_text_key"].take(taken)], names=["l_high", "l_low", "l_id", "l_text_key"])

    keyed = narrow.withColumn("l_text_key", F.xxhash64("l_in"))
    probes = materialize(keyed.select("l_id", "l_text_key", "l_in").mapInArrow(keys, "l_high long, l_low long, l_id long, l_text_key long").distinct())
    salts = max(1, -(-probes.count() // (shards * PROBES)))
    probes = probes.withColumn("l_shard", shard_column("l_low", shards)).withColumn("l_salt", F.pmod(F.xxhash64("l_id", "l_text_key"), F.lit(salts)).cast("int"))
    arrays = arrays.withColumn("i_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def look_up(key: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        schema = pa.schema([("l_id", pa.int64()), ("l_text_key", pa.int64()), ("l_hit", pa.binary())])
        if not len(mine) or not len(theirs):
            return schema.empty_table()
        probe = Probe(theirs.drop_columns(["i_salt"]).to_pylist(), shards)
        high, low = (np.asarray(mine[c].combine_chunks()).view(np.uint64) for c in ("l_high", "l_low"))
        place = probe.find(high, low)
        ids = mine["l_id"].to_pylist()
        hit = [i for i in np.flatnonzero(place >= 0).tolist() if probe.keepers[place[i]] != ids[i]]
        both = np.stack([high[hit], low[hit]], axis=1).astype(">u8")
        taken = mine.select(["l_id", "l_text_key"]).take(pa.array(hit, pa.int64()))
        return taken.append_column("l_hit", pa.array([row.tobytes() for row in both], pa.binary())).cast(schema)

    hits = probes.groupBy("l_shard", "l_salt").cogroup(arrays.groupBy("i_shard", "i_salt")).applyInArrow(look_up, "l_id long, l_text_key long, l_hit binary")
    per = hits.groupBy(F.col("l_id").alias("h_id"), F.col("l_text_key").alias("h_key")).agg(F.collect_list("l_hit").alias("l_more"))
    return keyed.join(per, F.col("l_id").eqNullSafe(F.col("h_id")) & (F.col("l_text_key") == F.col("h_key")), "left").drop("h_id", "h_key", "l_text_key")


ORACLE = f"""
with d as (select row_number() over () as r, doc_id, text from documents),
e as (select r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from d),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from e),
f as (select key, max(doc_id) as keeper from k where length(key) >= {MIN_CHARS} group by key having count(distinct doc_id) + max((doc_id is null)::int) >= {MIN_DOCS}),
m as (select k.*, f.key is not null and keeper is distinct from doc_id as gone from k left join f on f.key = k.key)
select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from m group by r, doc_id
"""
