"""Best-fit packing of tokenised documents into sequences of a fixed capacity, in bulk-synchronous rounds.

A length is an integer of at most the capacity, and documents of one length are interchangeable. So the tables of the rounds hold classes: lengths with
ranges of ranks, and gaps with ranges of sequences. Lengths are taken in bands from the longest down; a band never joins lengths of which a sequence holds different numbers. In a
round, documents and gaps of a band are sorted by size into range partitions, and a sweep matches every document to its successor, the smallest gap that holds it: running sums
within a partition, carried across partition borders. Conflicts over a gap are resolved by rank: documents that find their successor taken get the gaps after it, and the longest
are left over if there are too few. Gaps are updated and the round repeats, opening new sequences only as far as all gaps together cannot hold what is left, until a round gains
little; then as many as are needed open. A match is a range of ranks and sequences; documents get their ranks within their length by one range sort over all pieces at the end, and look
their matches, few whatever the input, up in a broadcast table.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm.common import materialize, text_batches

CAPACITY, END_ID = 4096, 1
#: Fixed value: how the tokenizer whose texts can be encoded run by run splits them.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = END_ID.to_bytes(4, "little")
TOKENIZER = "word_bpe_49k.json"
#: A band reaches down to so much of its longest length, or to half of it where more than `FINE` of that fill a sequence. After a round that placed less than `GAIN` of
#: what it was given, as many sequences as are needed open.
BAND, FINE, GAIN = 0.75, 6, 0.9
#: Range partitions of a round; pieces of a range partition of the last sort (more only beyond `MOST_PARTS` of them).
PARTS, PART_PIECES, MOST_PARTS = 16, 100_000, 20_000
#: The sign that byte-level BPE writes for each byte: itself where it is visible, the others from U+0100 on in order.
_BYTE_SIGNS = {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 255 and b != 173))}
_ENCODERS: dict[str, ChunkEncoder] = {}


class Memo(dict):
    """What a function gave, by argument: two generations of at most `limit` entries, so that the common ones stay when it is full."""

    def __init__(self, compute: Callable[[str], bytes], limit: int) -> None:
        super().__init__()
        self.compute, self.limit, self.older = compute, limit, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.older = self.copy()
            self.clear()
        self[key] = value
        return value


class Common(dict):
    """What a function gave for the first `limit` arguments; it starts afresh after a hundred times as many that it did not know, and so follows the texts."""

    def __init__(self, compute: Callable[[str], bytes], limit: int) -> None:
        super().__init__()
        self.compute, self.limit, self.unknown = compute, limit, 0

    def __missing__(self, key: str) -> bytes:
        value = self.compute(key)
        if len(self) < self.limit:
            self[key] = value
            return value
        self.unknown += 1
        if self.unknown >= 100 * self.limit:
            self.clear()
            self.unknown = 0
        return value


class ChunkEncoder:
    """Token ids of texts as little-endian 32-bit integers; the ids of runs of letters and of other runs are remembered, and those of the words that are met first.

    That holds for a tokenizer that splits as `SPLIT` says; any other one encodes whole texts. It drops white space, never joins across it, and parts letters from anything else. So a text's ids are the ids of its
    runs of letters and of its other runs, in order; a text with no character beyond U+00FF is lower-cased and cut that way, as nothing in it
    composes. Apostrophes (contractions) and `<|` (special tokens) join letters and marks: a text with one of these, or with a later
    character, is cut at white space only, and one with U+001C to U+001F, no white space to the tokenizer, goes there whole.
    """

    LIMIT, WORDS = 60_000, 150_000
    #: Runs of letters and of anything else but white space. Characters up to U+00FF are listed, so that they are found in half the time.
    RUN = re.compile("|".join(f"[{''.join(re.escape(c) for c in map(chr, range(256)) if re.fullmatch(kind, c))}]+" for kind in (r"[^\W\d_]", r"[^\s\w]|[\d_]")))

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.known, self.words = Memo(self._run, self.LIMIT), Common(self._word, self.WORDS)
        self.by_runs = self._parts_runs()

    def _parts_runs(self) -> bool:
        """Whether the tokenizer's file normalises and splits as encoding run by run needs. Any other one gets whole texts."""
        form = json.loads(self.full.to_str())
        normal, split = (form[k] or {} for k in ("normalizer", "pre_tokenizer"))
        kinds = [n["type"] for n in normal.get("normalizers", [])]
        patterns = [p.get("pattern", {}).get("Regex") for p in split.get("pretokenizers", [])]
        return kinds == ["NFC", "Replace", "Lowercase"] and normal["normalizers"][1]["pattern"] == {"Regex": r"\s+"} and patterns == [SPLIT, None] and form["model"]["type"] == "BPE"

    def _exact(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _run(self, run: str) -> bytes:
        if not (run.isalpha() and run.islower() and (run.isascii() or _is_latin(run))):
            return self._exact(run)
        # A lower-case word of letters up to U+00FF is what normalising and splitting would leave of it.
        ids = [t.id for t in self.full.model.tokenize(run if run.isascii() else run.encode().decode("latin-1").translate(_BYTE_SIGNS))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        """Ids of what stands between white space in a lower-case text of characters up to U+00FF: those of its runs."""
        runs = self.RUN.findall(word)
        return self.known[word] if len(runs) == 1 else b"".join([self.known[run] for run in runs])

    def encode(self, text: str) -> bytes:
        if not self.by_runs or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return self._exact(text)
        if "'" in text or "<|" in text or not (text.isascii() or _is_latin(text)):
            return b"".join(map(self.known.__getitem__, text.split()))
        return b"".join(map(self.words.__getitem__, text.lower().split()))


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def encoder(tokenizer: str) -> ChunkEncoder:
    """The encoder of this worker process for a tokenizer file: a path, or the name of a public one."""
    if tokenizer not in _ENCODERS:
        if "/" in tokenizer:
            _ENCODERS[tokenizer] = ChunkEncoder(tokenizer)
        else:
            import public_tokenizers

            _ENCODERS[tokenizer] = ChunkEncoder(public_tokenizers.path(tokenizer))
    return _ENCODERS[tokenizer]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(pk_id, piece, start, length, ids_crc32[, ids]) for every document: its ids and the end id, cut after every `capacity` ids.

    A null or empty text is the end id alone.
    """
    names = ["pk_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            kept: list[np.ndarray] = []
            for i, text in enumerate(batch["x"]):
                ids = encode(text.as_py() or "") + END
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    some = ids[4 * start : 4 * (start + capacity)]
                    rows.append((i, piece, start, len(some) // 4, zlib.crc32(some)))
                    if keep_ids:
                        kept.append(np.frombuffer(some, "<i4"))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            arrays = [batch["pk_id"].take(pa.array(columns[0], pa.int64()))] + [pa.array(c, t) for c, t in zip(columns[1:], (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(kept, pa.list_(pa.int32()))] if keep_ids else []), names=names)

    narrow = text_batches(docs).select(F.col(id_col).alias("pk_id"), F.col(text_col).alias("x"))
    shape = f"pk_id {narrow.schema['pk_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return narrow.mapInArrow(cut, shape)


#: Classes: `many` documents of length `size` with ranks from `first` on (kind 0), or `many` sequences from `first` on with a gap of `size` (kind 1).
CLASS = "kind int, size long, first long, many long"
#: Matches (kind 2): `many` documents of length `size` with ranks from `first` on lie `per` to a sequence from `sequence` and `offset` on.
MATCHES = ("size", "first", "many", "per", "sequence", "offset")
_ROUND = f"{CLASS}, per long, sequence long, offset long"
_NEVER = -(1 << 60)


def _rows(schema: str, rows: list[tuple[int, ...]]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64()}
    fields = [(name, kinds[kind]) for name, kind in (field.split() for field in schema.split(", "))]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


class Sweep:
    """The classes of one range partition in order of size, documents before slots, with the documents and slots before each within the partition.

    A gap of at least `top` has as many slots as documents of length `top` fit, a smaller one has one slot. `lift` is how far documents up to a
    class must move on from the slot of their own number to find one that holds them.
    """

    def __init__(self, table: pa.Table, top: int) -> None:
        kind, size, first, many = (np.asarray(table[c].combine_chunks()).astype(np.int64) for c in ("kind", "size", "first", "many"))
        order = np.lexsort((first, size, kind, np.where(kind == 1, np.minimum(size, top), size)))
        self.kind, self.size, self.first, self.many = kind[order], size[order], first[order], many[order]
        self.units = self.many * np.where(self.kind == 1, np.maximum(1, self.size // top), 1)
        docs, slots = np.where(self.kind == 0, self.units, 0), np.where(self.kind == 1, self.units, 0)
        self.docs, self.slots = int(docs.sum()), int(slots.sum())
        self.docs_before, self.slots_before = np.cumsum(docs) - docs, np.cumsum(slots) - slots
        self.lift = np.maximum.accumulate(np.where(self.kind == 0, self.slots_before - self.docs_before, _NEVER))


def _fill(table: pa.Table, top: int, fresh: int, capacity: int) -> list[tuple[int, ...]]:
    """Matches and gaps of one range partition of slots, from its classes of slots and the documents that were given their numbers (`at`)."""
    rows = sorted(zip(*[table[c].to_pylist() for c in ("at", "kind", "size", "first", "many")], strict=True), key=lambda r: (r[0], -r[1]))
    out: list[tuple[int, ...]] = []
    slots, docs = [r for r in rows if r[1] == 1], [r for r in rows if r[1] == 0]
    at_doc = 0
    for start, _, gap, sequence, many in slots:
        per = max(1, gap // top)
        end, covered = start + many * per, 0
        filled = 0  # of the sequence that was begun last
        while at_doc < len(docs) and docs[at_doc][0] < end:
            at, _, length, rank, n = docs[at_doc]
            now, unit = min(n, end - at), at - start
            covered = unit + now
            if now < n:
                docs[at_doc] = (end, 0, length, rank + now, n - now)
            else:
                at_doc += 1
            head = min(now, -unit % per)
            whole = (now - head) // per
            if head:
                out.append((2, length, rank, head, head, sequence + unit // per, capacity - gap + filled))
                filled += head * length
                if (unit + head) % per == 0:
                    out.append((1, gap - filled, sequence + unit // per, 1, 0, 0, 0))
                    filled = 0
            if whole:
                out.append((2, length, rank + head, whole * per, per, sequence + (unit + head) // per, capacity - gap))
                out.append((1, gap - per * length, sequence + (unit + head) // per, whole, 0, 0, 0))
            if tail := now - head - whole * per:
                out.append((2, length, rank + head + whole * per, tail, tail, sequence + (covered - tail) // per, capacity - gap))
                filled = tail * length
        touched = -(-covered // per)
        if filled:
            out.append((1, gap - filled, sequence + touched - 1, 1, 0, 0, 0))
        if many > touched and sequence < fresh:
            out.append((1, gap, sequence + touched, many - touched, 0, 0, 0))
    return [r for r in out if r[0] != 1 or r[1] > 0]


def match_round(classes: DataFrame, low: int, top: int, fresh: int, capacity: int) -> DataFrame:
    """What one round over the band (low, top] leaves: classes of documents and gaps, and matches (the columns of `_ROUND`), in a scratch table.

    Sequences from `fresh` on that nothing was put in stay closed. Tables of classes do not grow with the input.
    """
    banded = classes.filter(f"kind = 0 or size > {low}").withColumn("part", F.expr(f"cast((least(size, {top}L) - {low + 1}) * {PARTS} div {top - low} as int)"))

    def survey(key: tuple, table: pa.Table) -> pa.Table:
        own = Sweep(table, top)
        return _rows("part int, docs long, slots long, lift long", [(key[0].as_py(), own.docs, own.slots, int(own.lift[-1]))])

    totals = {r.part: r for r in banded.groupBy("part").applyInArrow(survey, "part int, docs long, slots long, lift long").collect()}
    carried, docs_before, slots_before, lift = [], 0, 0, _NEVER
    for part in range(PARTS):  # what the partitions before each carry over
        carried.append((docs_before, slots_before, lift))
        if part in totals:
            own = totals[part]
            lift = max(lift, own.lift + slots_before - docs_before) if own.lift > _NEVER else lift
            docs_before, slots_before = docs_before + own.docs, slots_before + own.slots
    ends = [(p, c[1], c[1] + totals[p].slots) for p, c in enumerate(carried) if p in totals and totals[p].slots]

    def route(key: tuple, table: pa.Table) -> pa.Table:
        """Slots with their numbers, documents to the partition of the slots whose numbers they get, and those that get none."""
        own, part = Sweep(table, top), key[0].as_py()
        docs_carry, slots_carry, lift_carry = carried[part]
        start = np.where(own.kind == 0, own.docs_before + docs_carry + np.maximum(own.lift + slots_carry - docs_carry, lift_carry), own.slots_before + slots_carry).tolist()
        out = []
        for kind, size, first, many, units, at in zip(own.kind.tolist(), own.size.tolist(), own.first.tolist(), own.many.tolist(), own.units.tolist(), start, strict=True):
            if kind == 1:
                out.append((part, kind, size, first, many, at))
                continue
            placed = max(0, min(units, slots_before - at))
            for to, a, b in ends:
                if (many_there := min(at + placed, b) - max(at, a)) > 0:
                    out.append((to, kind, size, first + max(at, a) - at, many_there, max(at, a)))
            if placed < units:
                out.append((-1, kind, size, first + placed, units - placed, at))
        return _rows(f"to int, {CLASS}, at long", out)

    def match(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() >= 0:
            return _rows(_ROUND, _fill(table, top, fresh, capacity))
        return _rows(_ROUND, [(*r, 0, 0, 0) for r in zip(*[table[c].to_pylist() for c in ("kind", "size", "first", "many")], strict=True)])

    met = banded.groupBy("part").applyInArrow(route, f"to int, {CLASS}, at long").groupBy("to").applyInArrow(match, _ROUND)
    return materialize(met.unionByName(classes.filter(f"kind = 1 and size <= {low}").selectExpr("*", "0L as per", "0L as sequence", "0L as offset")))


def band_below(top: int, capacity: int = CAPACITY) -> int:
    """The length that a band from `top` down ends above: a sequence holds as many documents of any length in the band."""
    fine = top > capacity // FINE
    return max(int(top * BAND), capacity // (capacity // top + 1)) if fine else top // 2


def match_classes(spark: SparkSession, counts: dict[int, int], capacity: int = CAPACITY) -> DataFrame:
    """Matches (the columns `MATCHES`) that place `counts[size]` documents of every length; sequences are numbered from 0 without a break."""
    names = [field.split()[0] for field in CLASS.split(", ")]
    classes, found, used, room, top = spark.createDataFrame([], CLASS), spark.createDataFrame([], ", ".join(f"{c} long" for c in MATCHES)), 0, 0, max(counts, default=0)
    while top:
        low = band_below(top, capacity)
        band = [(0, k, 0, n) for k, n in sorted(counts.items()) if low < k <= top]
        below = max((k for k in counts if k <= low), default=0)
        following = band_below(below, capacity) if below else 0
        classes = classes.unionByName(spark.createDataFrame(band, CLASS))
        units, tokens, longest, gained = sum(r[3] for r in band), sum(r[1] * r[3] for r in band), top, 1.0
        while units:
            slots = capacity // longest
            fresh = -(-units // slots) if gained < GAIN or slots == 1 else max(0, -(-(tokens - room) // capacity))
            opened = classes.unionByName(spark.createDataFrame([(1, capacity, used, fresh)], CLASS)) if fresh else classes
            state = match_round(opened, low, longest, used, capacity)
            found = found.unionByName(state.filter("kind = 2").select(*MATCHES))
            classes = state.filter("kind < 2").select(*names)
            # One row: what is left of the band, its longest length, the last sequence, and the room for this band and for the next one.
            sums = {"units": "if(kind = 0, many, 0L)", "tokens": "if(kind = 0, many * size, 0L)", "same": f"if(kind = 1 and size > {low}, many * size, 0L)", "following": f"if(kind = 1 and size > {following}, many * size, 0L)"}
            tops = {"longest": "if(kind = 0, size, 0L)", "last": "if(kind = 2, sequence + (many + per - 1) div per, 0L)"}
            now = state.selectExpr(*[f"coalesce({f}({x}), 0L) as {n}" for f, xs in (("sum", sums), ("max", tops)) for n, x in xs.items()]).first()
            gained, units, tokens, longest, used = 1 - now.units / units, now.units, now.tokens, now.longest, max(used, now["last"])
            room = now.same if units else now.following
        top = below
    return found


def ranked(cut: DataFrame) -> DataFrame:
    """The rows of `cut`, range-sorted by length and pk_row, which tells rows apart, with pk_part and pk_at, which rises within a part. In a scratch table."""
    parts = min(MOST_PARTS, max(1, -(-cut.count() // PART_PIECES)))
    placed = cut.repartitionByRange(parts, "length", "pk_row").sortWithinPartitions("length", "pk_row").withColumn("pk_at", F.monotonically_increasing_id())
    return materialize(placed.withColumn("pk_part", F.shiftright("pk_at", 33)))


class Places:
    """Where each piece goes: the ranks of a part's pieces of one length, and the matches by length and rank."""

    def __init__(self, runs: list[tuple[int, int, int, int]], matches: list[tuple[int, ...]]) -> None:
        runs, before, self.shift = sorted(runs, key=lambda r: (r[1], r[0])), Counter(), {}
        for part, length, first, count in runs:
            self.shift[part, length] = before[length] - first
            before[length] += count
        self.length, self.rank, _, self.per, self.sequence, self.offset = np.array(sorted(matches), np.int64).reshape(-1, len(MATCHES)).T
        self.first = np.searchsorted(self.length, np.arange(self.length.max(initial=0) + 2))

    def find(self, part: np.ndarray, length: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces; equal lengths stand together."""
        sequence, offset = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        borders = np.flatnonzero((length[1:] != length[:-1]) | (part[1:] != part[:-1])) + 1
        for low, high in zip([0, *borders.tolist()], [*borders.tolist(), len(at)], strict=True):
            if low == high:
                continue
            own, size = slice(low, high), int(length[low])
            rank = at[own] + self.shift[int(part[low]), size]
            start, stop = self.first[size], self.first[size + 1]
            match = start + np.searchsorted(self.rank[start:stop], rank, side="right") - 1
            ahead = rank - self.rank[match]
            sequence[own], offset[own] = self.sequence[match] + ahead // self.per[match], self.offset[match] + ahead % self.per[match] * size
        return sequence, offset


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece: pk_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Rows that repeat a document are packed each; equal pieces take their places in any order, which gives the same rows. A null id is an id
    like any other; an empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, id_col, text_col, tokenizer, capacity, keep_ids).withColumn("pk_row", F.monotonically_increasing_id()))
    counts = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    matches = match_classes(spark, counts, capacity)
    ordered = ranked(cut)
    # A row for each length and for each part besides, at most; and classes of lengths by classes of gaps, as bounded by the capacity.
    runs = [tuple(r) for r in ordered.groupBy("pk_part", "length").agg(F.min("pk_at"), F.count("*")).collect()]
    places = spark.sparkContext.broadcast(Places(runs, [tuple(r) for r in matches.collect()]))
    names = [c for c in cut.columns if c != "pk_row"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = places.value.find(*(np.asarray(batch[c]) for c in ("pk_part", "length", "pk_at")))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], *map(pa.array, found)], names=[*names, "sequence_id", "offset"])

    shape = ", ".join(f"{c} {cut.schema[c].dataType.simpleString()}" for c in names)
    return ordered.select(*names, "pk_part", "pk_at").mapInArrow(place, f"{shape}, sequence_id long, offset long")
