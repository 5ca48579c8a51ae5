"""Removal of byte strings that occur elsewhere, by suffix arrays over what repeats around common anchors.

A byte goes if a string of ``length`` bytes that covers it starts anywhere
else, in the same document or another one.

1. **Anchors.** Of every ``length`` bytes the grams of half that length with
   the least hash are anchors (``anchors_of``), so equal strings have equal
   least grams at equal places. Each string is looked at from its least gram; an
   anchor's context is what the strings reach whose least gram it is.
2. **Contexts.** Anchors that occur once fall away by a count of hashes. A
   context that occurs twice repeats as a whole. Only anchors with several
   contexts need a comparison of bytes, so only a context's first occurrence
   sends them. Where many contexts share an anchor they are parted again and
   again: two that share a string share half of what is missing before or
   after it. So groups stay bounded, however common an anchor is.
3. **Suffix arrays.** A task gets whole groups. Contexts are written in symbols
   that end where two of the group part (``symbols_of``), as equal ones can end
   nowhere else, and all texts of the task are sorted by linear grouping
   (``lyndon``). A suffix shares most with a neighbour in that order; where that
   is ``length`` bytes or more, the bytes are marked.
4. Marks go back to all anchors with that context and are united by document.

Hashes that decide alone have 128 bits: a context's, beside its anchor's.

Nulls: a null text is empty, so nothing is removed of it. A document without id
is a document like others. Equal rows are documents like others too, so they
lose what they share. Ties do not occur: a byte goes or stays. Very long texts
are read in overlapping blocks, whole. Matches never cross documents. An empty
table gives no rows. Only the two named columns are read, so other columns may
have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, lean, mixed, modest_batches, stored, string_buffers, table, text_or_empty
from .lyndon import longest_matches, suffix_array

LENGTH = 200
#: Bytes of text whose anchors are found at a time.
BLOCK_BYTES = 1 << 20
#: Contexts that one group may have, and bytes of the groups that a task sorts at a time.
GROUP, SORT_BYTES = 2000, 2 << 20

#: Odd bases of two rolling hashes.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _extreme(values: np.ndarray, width: int, of) -> np.ndarray:
    """The minimum or maximum (``of``) of every ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        values, size = of(values[:-size], values[size:]), 2 * size
    rest = width - size
    return of(values[: len(values) - rest], values[rest:]) if rest else values


class _Rolling:
    """Hashes of any stretch of some bytes, the same wherever the stretch stands."""

    def __init__(self, data: np.ndarray, base: int):
        powers = np.full(len(data) + 1, base, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=self.sums[1:])
        self.back = np.full(len(data) + 1, pow(base, -1, 1 << 64), np.uint64)
        self.back[0] = 1
        self.back = np.multiply.accumulate(self.back)

    def grams(self, width: int) -> np.ndarray:
        return mixed((self.sums[width:] - self.sums[:-width]) * self.back[: len(self.sums) - width])

    def stretches(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start])


def _nearest(at: np.ndarray, names: np.ndarray, step: int, room: int) -> np.ndarray:
    """Of each anchor the place of the nearest one before it (step -1) of no greater name, or after it (1) of a less one; of those further than ``room``, a place that is further."""
    other, open_ = np.arange(len(at)) + step, np.arange(len(at))
    while len(open_):
        other_in = (other[open_] >= 0) & (other[open_] < len(at))
        open_ = open_[other_in]
        met = other[open_]
        pass_by = (names[met] > names[open_]) if step < 0 else (names[met] >= names[open_])
        open_ = open_[pass_by & (np.abs(at[met] - at[open_]) <= room)]
        other[open_] += step
    inside = (other >= 0) & (other < len(at))
    far = at + step * (room + 1)
    found = np.where(inside, at[np.clip(other, 0, max(len(at) - 1, 0))], far) if len(at) else at
    return np.maximum(found, far) if step < 0 else np.minimum(found, far)


def anchors_of(data: np.ndarray, rows: np.ndarray, length: int = LENGTH, contexts: bool = True) -> tuple[np.ndarray, ...]:
    """(row, place in it, bytes before, bytes after, key, context) of all anchors of the rows whose bytes and offsets are given; only the keys unless ``contexts``."""
    gram = length // 2
    if len(data) < length:
        return (np.zeros(0, np.int64),) * (6 if contexts else 1)
    first = _Rolling(data, _BASES[0])
    names = first.grams(gram)
    owner = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    width = length - gram + 1
    least = _extreme(names, width, np.minimum)
    least[owner[: len(owner) - length + 1] != owner[length - 1 :]] = 0  # strings that cross rows
    edge = np.zeros(width - 1, np.uint64)
    reach = _extreme(np.concatenate([edge, least, edge]), width, np.maximum)
    at = np.flatnonzero((names == reach) & (reach > 0))
    if not contexts:
        return (names[at].view(np.int64),)
    row = owner[at]
    room = length - gram
    # a string belongs to its least gram, the first one of equal ones: no anchor in it may be less
    start = np.maximum(np.maximum(_nearest(at, names[at], -1, room) + 1, rows[row]), at - room)
    end = np.minimum(np.minimum(_nearest(at, names[at], 1, room) + gram - 1, rows[row + 1]), at + length)
    context = _Rolling(data, _BASES[1]).stretches(start, end) ^ mixed(((at - start) * 4096 + (end - at)).astype(np.uint64))
    return row, at - rows[row], at - start, end - at, names[at].view(np.int64), context.view(np.int64)


def _blocks(data: np.ndarray, rows: np.ndarray, length: int):
    """(bytes, offsets, rows, begin of each in its row, first and end of the places that count) of blocks of bounded bytes; long rows are cut into parts that overlap."""
    margin = 4 * length
    parts = []
    for row, (a, b) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist())):
        if b - a < length:
            continue
        for start in range(0, b - a, BLOCK_BYTES):
            stop = min(start + BLOCK_BYTES, b - a)
            parts.append((row, a, max(0, start - margin), min(b - a, stop + margin), start, stop))
    while parts:
        taken, total = 0, 0
        while taken < len(parts) and (not taken or total + parts[taken][3] - parts[taken][2] <= BLOCK_BYTES):
            total += parts[taken][3] - parts[taken][2]
            taken += 1
        now, parts = parts[:taken], parts[taken:]
        offsets = np.concatenate([[0], np.cumsum([p[3] - p[2] for p in now])])
        yield np.concatenate([data[p[1] + p[2] : p[1] + p[3]] for p in now]), offsets, *(np.array([p[i] for p in now]) for i in (0, 2, 4, 5))


def _anchor_keys(length: int):
    def work(batches):
        for batch in batches:
            for block, offsets, _, begin, first, last in _blocks(*string_buffers(batch.column("text")), length):
                whole = (begin == first).all() and (offsets[1:] - offsets[:-1] == last - begin).all()
                if whole:
                    (keys,) = anchors_of(block, offsets, length, contexts=False)
                else:
                    row, place, _, _, keys, _ = anchors_of(block, offsets, length)
                    place = place + begin[row]
                    keys = keys[(place >= first[row]) & (place < last[row])]
                values, counts = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], names=["key", "c"])

    return lean(work)


def _anchor_rows(length: int):
    def work(batches):
        for batch in batches:
            for block, offsets, rows, begin, first, last in _blocks(*string_buffers(batch.column("text")), length):
                row, place, before, after, key, context = anchors_of(block, offsets, length)
                place = place + begin[row]
                own = (place >= first[row]) & (place < last[row])
                at = pa.array(rows[row[own]])
                cells = [pa.array(place[own]), pa.array(before[own].astype(np.int16)), pa.array(after[own].astype(np.int16)), pa.array(key[own]), pa.array(context[own])]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("text_hash").take(at), *cells], names=["id", "text_hash", "place", "before", "after", "key", "context"])

    return lean(work)


def _cut_contexts(batches):
    """(key, context, before, bytes) of the anchors listed beside each text."""
    for batch in batches:
        for text, listed in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("listed").to_pylist()):
            for k in range(0, len(listed), 8192):
                part = listed[k : k + 8192]
                cells = pa.array([text[r["place"] - r["before"] : r["place"] + r["after"]] for r in part], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in part], kind) for c, kind in (("key", pa.int64()), ("context", pa.int64()), ("before", pa.int16()))] + [cells], names=["key", "context", "before", "bytes"])


def _in_order(cells: list[bytes], groups: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the cells by group, then bytes; of each in that order what it shares with the one before it, -1 if that is of another group)."""
    padded = np.frombuffer(b"".join(c.ljust(width, b"\0") for c in cells), np.uint8).reshape(len(cells), width)
    words = padded.view(">u8").astype(np.uint64)
    sizes = np.array([len(c) for c in cells])
    order = np.lexsort((sizes, *(words[:, i] for i in range(words.shape[1] - 1, -1, -1)), groups))
    padded, sizes, groups = padded[order], sizes[order], groups[order]
    same = padded[1:] == padded[:-1]
    shared = np.minimum(np.where(same.all(axis=1), width, np.argmin(same, axis=1)), np.minimum(sizes[1:], sizes[:-1]))
    shared[groups[1:] != groups[:-1]] = -1
    return order, np.concatenate([[-1], shared])


def symbols_of(cells: list[bytes], groups: np.ndarray, width: int) -> list[list[tuple[int, int]]]:
    """Of each cell its (end, name) pairs: the ends at which two cells of its group can part, as far as it goes, and names that are equal for cells of the group that are equal up to there."""
    order, shared = _in_order(cells, groups, width)
    sizes = np.array([len(c) for c in cells])
    found: list[list[tuple[int, int]]] = [[] for _ in cells]
    edges = np.flatnonzero(shared < 0).tolist() + [len(cells)]
    for a, b in zip(edges, edges[1:]):
        own = order[a:b].tolist()
        ends = sorted({e for e in shared[a + 1 : b].tolist() if e > 0} | {n for n in sizes[order[a:b]].tolist() if n > 0})
        # how far two neighbours agree when what is padded counts, as no cell is followed by more than it has
        begun = [a] * len(ends)
        for r, i in enumerate(own, a):
            if r > a:
                s = int(shared[r])
                for k in range(len(ends) - 1, -1, -1):
                    if ends[k] <= s:
                        break
                    begun[k] = r
            n = int(sizes[i])
            found[i] = [(e, begun[k] * (width + 1) + e) for k, e in enumerate(ends) if e <= n]
    return found


def marked(rows: list[tuple], length: int) -> list[tuple[int, int, int, int]]:
    """(key, context, bytes before, bytes after) that repeat around the anchors of rows (group, key, context, before, bytes): the suffixes of all contexts are sorted as one text."""
    width = -(-length // 8) * 8
    groups = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)[1]
    ahead = symbols_of([r[4][r[3] :] for r in rows], groups, width)
    behind = symbols_of([r[4][: r[3]][::-1] for r in rows], groups, width)
    text, sizes, places = [], [], []
    offset = (len(rows) + 1) * (width + 1)
    for i, (after, before) in enumerate(zip(ahead, behind)):
        if not after or (before[-1][0] if before else 0) + after[-1][0] < length:
            continue
        steps = [e for e, _ in before]
        places.append((i, len(text), [*reversed(steps), 0]))
        text += [len(rows) + 1 + offset + name for _, name in reversed(before)]
        sizes += [e - d for d, e in zip([0, *steps], steps)][::-1]
        text += [len(rows) + 1 + name for _, name in after]
        sizes += [e - d for (d, _), (e, _) in zip([(0, 0), *after], after)]
        text.append(i + 1)  # ends a context, and is nowhere else
        sizes.append(0)
    if not text:
        return []
    symbols = np.array([*text, 0], np.int64)
    most = longest_matches(symbols, suffix_array(symbols))
    reach = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    found = []
    for i, at, starts in places:
        good = [(back, reach[at + k + most[at + k]] - reach[at + k]) for k, back in enumerate(starts)]
        good = [(back, n) for back, n in good if n >= length]
        if good:
            found.append((rows[i][1], rows[i][2], max(back for back, _ in good), max(n - back for back, n in good)))
    return found


def _sort_groups(length: int):
    def work(data: pa.Table) -> pa.Table:
        rows = {(r["group"], r["key"], r["context"]): (r["group"], r["key"], r["context"], r["before"], r["bytes"]) for r in data.to_pylist()}
        found = marked(list(rows.values()), length) if rows else []
        return pa.table([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64()))], names=["key", "context", "lo", "hi"])

    return work


def _parted(rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows in groups of at most GROUP contexts, marks of strings that whole groups share) of rows (key, context, before, bytes).

    A group knows a string of lo bytes before and hi bytes after its anchor's
    start that all its contexts hold.
    """
    small, marks = None, None
    named = stored(rows.select(F.col("key").alias("group"), "key", "context", "before", "bytes", F.lit(0).alias("lo"), F.lit(length // 2).alias("hi")))
    while True:
        sizes = named.groupBy("key", "group", "lo", "hi").agg(F.count("*").alias("c")).where("c > 1")
        sized = named.join(sizes.select("key", "group", "lo", "hi", "c"), ["key", "group", "lo", "hi"])
        few = sized.where(F.col("c") <= GROUP).select("group", "key", "context", "before", "bytes")
        small = few if small is None else small.unionByName(few)
        if sizes.where(F.col("c") > GROUP).isEmpty():
            return small, marks
        rest = F.lit(length) - F.col("lo") - F.col("hi")
        half = F.ceil(rest / 2).cast("int")
        ways = F.explode(F.array(F.struct((F.col("lo") + half).alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), (F.col("hi") + half).alias("hi"))))
        big = sized.where(F.col("c") > GROUP).select("key", "context", "before", "bytes", ways.alias("w")).select("key", "context", "before", "bytes", "w.lo", "w.hi")
        big = big.where((F.col("before") >= F.col("lo")) & (F.length("bytes") - F.col("before") >= F.col("hi")))
        shared = F.substring("bytes", F.col("before") - F.col("lo") + 1, F.col("lo") + F.col("hi"))
        named = stored(big.select(F.xxhash64("key", "lo", "hi", shared).alias("group"), "key", "context", "before", "bytes", "lo", "hi").distinct())
        whole = named.where(F.col("lo") + F.col("hi") >= length)
        again = whole.groupBy("key", "group", "lo", "hi").agg(F.count("*").alias("c")).where("c > 1")
        mark = whole.join(again, ["key", "group", "lo", "hi"]).select("key", "context", F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi"))
        marks = mark if marks is None else marks.unionByName(mark)
        named = named.where(F.col("lo") + F.col("hi") < length)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, text_hash, start, end): pieces whose union is what repeats, of rows (id, text_hash, text) without nulls."""
    keys = docs.select("text").mapInArrow(_anchor_keys(length), "key bigint, c bigint")
    again = stored(keys.groupBy("key").agg(F.sum("c").alias("c")).where("c > 1").select("key"))
    anchors = docs.mapInArrow(_anchor_rows(length), "id bigint, text_hash bigint, place bigint, before smallint, after smallint, key bigint, context bigint")
    alive = stored(anchors.join(again, "key"))
    contexts = stored(alive.groupBy("key", "context").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("id", "text_hash", "place", "before", "after"))))
    twice = contexts.where((F.col("n") > 1) & (F.col("before") + F.col("after") >= length)).select("key", "context", F.col("before").cast("bigint").alias("lo"), F.col("after").cast("bigint").alias("hi"))
    several = contexts.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    asked = contexts.join(several, "key").groupBy("id", "text_hash").agg(F.collect_list(F.struct("place", "before", "after", "key", "context")).alias("listed"))
    cut = docs.join(asked, ["id", "text_hash"]).select("text", "listed").mapInArrow(lean(_cut_contexts), "key bigint, context bigint, before smallint, bytes binary")
    small, marks = _parted(cut, length)
    small = stored(small)
    total = small.agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0))).head()[0]
    dealt = small.withColumn("bucket", F.pmod(F.xxhash64("key", "group"), F.lit(total // SORT_BYTES + 1)))
    found = dealt.groupBy("bucket").applyInArrow(_sort_groups(length), "key bigint, context bigint, lo bigint, hi bigint").unionByName(twice)
    if marks is not None:
        found = found.unionByName(marks)
    widest = stored(found.groupBy("key", "context").agg(F.max("lo").alias("lo"), F.max("hi").alias("hi")))
    return alive.join(widest, ["key", "context"]).select("id", "text_hash", (F.col("place") - F.col("lo")).alias("start"), (F.col("place") + F.col("hi")).alias("end"))


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal stretches that the spans cover."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(s) for s in out]


REMOVED = "array<struct<start:bigint,end:bigint>>"


def _remove(texts: bool):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def work(batches):
        for batch in batches:
            for a, b in chunks(batch.column("text")):
                part = batch.slice(a, b - a)
                spans, sizes, kept, sha = [], [], [], []
                for text, listed in zip(part.column("text").cast(pa.large_binary()).to_pylist(), part.column("listed").to_pylist()):
                    own = united([(s["start"], s["end"]) for s in listed or ()])
                    edges = [0, *(x for s in own for x in s), len(text)]
                    rest = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2]))
                    spans.append([{"start": x, "end": y} for x, y in own])
                    sizes.append(len(text))
                    kept.append(rest if texts else None)
                    sha.append(hashlib.sha256(rest).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()), pa.array(sha, pa.string())], names=["id", "n_bytes", "removed", "kept", "sha"])

    return lean(work)


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, texts: bool = True) -> DataFrame:
    """(id, n_bytes, removed, kept, kept_sha256) of every row: the stretches (start, end) of bytes that go, and what is left; only its checksum unless ``texts``."""
    modest_batches(docs.sparkSession)
    keyed = docs.select(F.col(id_column).cast("bigint").alias("real_id"), text_or_empty(text_column).alias("text"))
    keyed = keyed.select("real_id", F.coalesce("real_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    spans = repeated_spans(keyed.select("id", "text_hash", "text"), length)
    listed = spans.groupBy("id", "text_hash").agg(F.collect_list(F.struct("start", "end")).alias("listed"))  # of one document
    met = keyed.join(listed, ["id", "text_hash"], "left").select(F.col("real_id").alias("id"), "text", "listed")
    done = met.mapInArrow(_remove(texts), f"id bigint, n_bytes bigint, removed {REMOVED}, kept binary, sha string")
    return done.select(F.col("id").alias(id_column), "n_bytes", "removed", "kept", F.col("sha").alias("kept_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    """op12: all documents without what repeats over 200 bytes."""
    found = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), texts=False)
    lost = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", lost.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), "kept_sha256")
