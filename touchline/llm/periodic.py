"""Periodic runs of words: tiles per scale of periods, boundary Z-functions, stitched intervals.

A run is a stretch of words that repeats with a smallest period q, at least
max(24, 3 q) words long, as long as it can be. Periods are taken in scales: 1
to 7, then octaves [g, 2 g). Of each scale

1. documents are cut into tiles that overlap by 4 g words, so that whatever
   repeats three times lies in tiles whose common parts tell that they belong
   together. Only tiles leave the task in which the g words at some multiple of
   g come again within the scale, by rolling names of 64 bits; every run has
   such a boundary in each tile that holds a piece of it. Equal words have equal
   names, so no run is lost, and what only looks alike goes in the next step;
2. tiles spread over all tasks by a hash of their place, and are solved on
   their own. At each such boundary one Z-function of the words after it and one
   of the reversed words before it tell for every period of the scale how far
   its repetition reaches (``solved``), compared word by word;
3. the intervals are shuffled by document and period, and those that share at
   least a period are one. Of equal intervals the least period is the smallest
   one, because two periods of a stretch of three periods imply their divisor.

Only documents with such a tile send their words through a shuffle.

Nulls: a null text has no words. A document without id is a document like
others. Ties of the greatest length by period go to the smallest start, then
period. Rows that share id and text share their result, a row each; rows that
share only the id are told apart by a hash of the text. A very long text has
more tiles, none longer than eight times the greatest period of its scale or
4096 words. An empty table gives no rows. Only the two named columns are read,
so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, lean, mixed, modest_batches, split_words, stored, table, text_or_empty

LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Periods below this are one scale; octaves follow.
FIRST_OCTAVE = 8
#: Words of a tile, at least.
TILE_WORDS = 4096
#: Bytes of tiles in an Arrow batch, about.
TILE_BYTES = 2 << 20
#: Fixed values of the contract: one document in ten gets a made run.
MADE_ONE_IN, MADE_SHARES = 10, 8

KEY = ("id", "text_hash")


def scale(number: int) -> tuple[int, int, int]:
    """(least period, end of periods, g) of a scale."""
    g = FIRST_OCTAVE << max(number - 1, 0)
    return (1, FIRST_OCTAVE, g) if number == 0 else (g, 2 * g, g)


def tile_step(g: int) -> tuple[int, int]:
    """(words of a tile, words from one tile's start to the next) of a scale."""
    size = max(TILE_WORDS, 8 * g)
    return size, size - 4 * g


def renamed(names: np.ndarray, width: int) -> np.ndarray:
    """Names of stretches of 2 * width from those of width; the last ones are not meant to be read."""
    longer = names.copy()
    if width < len(names):
        longer[:-width] = mixed(names[:-width] * np.uint64(0xD6E8FEB86659FD93) + names[width:])
    return longer


def gram_names(words: np.ndarray, g: int) -> np.ndarray:
    """Names of the g words from each place on (g a power of two)."""
    names, width = mixed(words.astype(np.uint64) + np.uint64(1)), 1
    while width < g:
        names, width = renamed(names, width), 2 * width
    return names


def recurring(names: np.ndarray, place: np.ndarray, size: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, boundary's place) of every place whose g words are those of the boundary one period of the scale before it."""
    _, _, g = scale(number)
    boundary = (place & ~(g - 1)) - (0 if number == 0 else g)
    at = np.flatnonzero((boundary >= 0) & (boundary != place) & (place + g <= size))
    at = at[names[at] == names[at - (place[at] - boundary[at])]]
    return at, boundary[at]


def tiles_of(words: np.ndarray, rows: np.ndarray):
    """(document, scale, start, end) of the tiles that may hold a piece of a run; words of all documents, rows their offsets."""
    n = np.diff(rows)
    doc = np.repeat(np.arange(len(n)), n)
    place, size = np.arange(len(doc)) - np.repeat(rows[:-1], n), np.repeat(n, n)
    names, width, number = mixed(words.astype(np.uint64) + np.uint64(1)), 1, 0
    while True:
        _, _, g = scale(number)
        stay = size >= max(LEAST_WORDS, LEAST_PERIODS * (g if number else 1))
        doc, place, size, names = doc[stay], place[stay], size[stay], names[stay]
        if not len(doc):
            return
        while width < g:
            names, width = renamed(names, width), 2 * width
        at, boundary = recurring(names, place, size, number)
        if len(at):
            length, step = tile_step(g)
            tile = boundary // step
            both = (tile > 0) & (place[at] + g <= (tile - 1) * step + length)
            found = np.unique(np.stack([np.concatenate([doc[at], doc[at][both]]), np.concatenate([tile, tile[both] - 1])]), axis=1)
            for d, t in found.T.tolist():
                yield d, number, t * step, min(t * step + length, int(n[d]))
        number += 1


def z_function(s: list) -> list:
    """Of each place of s how many symbols from it on are those from the start on."""
    n, left, right = len(s), 0, 0
    z = [0] * n
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def solved(words: np.ndarray, number: int, first: bool, last: bool) -> list[tuple[int, int, int]]:
    """(period, start, end) of what repeats in a tile with a period of its scale, as far as it does inside the tile.

    first, last: whether the tile starts and ends where the document does; what
    ends elsewhere inside the tile and is too short for a run is left out.
    """
    _, _, g = scale(number)
    n = len(words)
    at, boundaries = recurring(gram_names(words, g), np.arange(n), np.full(n, n), number)
    by_period: dict[int, list[list[int]]] = {}
    order = np.argsort(boundaries, kind="stable")
    at, boundaries = at[order], boundaries[order]
    edges = np.flatnonzero(np.diff(boundaries, prepend=-1)).tolist() + [len(at)]
    for a, b in zip(edges, edges[1:]):
        c = int(boundaries[a])
        ahead = z_function(words[c : c + 4 * g].tolist())
        begin, end = max(0, c - 2 * g), min(c + 2 * g, n)
        behind = words[begin:c][::-1].tolist()
        back = z_function([*behind, -1, *words[begin:end][::-1].tolist()])
        for p in (at[a:b] - c).tolist():
            if ahead[p] < g:
                continue  # equal names of other words
            start, stop = c - back[len(behind) + 1 + end - c - p], c + p + ahead[p]
            known = by_period.setdefault(p, [])
            if known and start + p <= known[-1][1]:
                known[-1][0], known[-1][1] = min(known[-1][0], start), max(known[-1][1], stop)
            else:
                known.append([start, stop])
    found: dict[tuple[int, int], list[int]] = {}
    for p, intervals in by_period.items():
        for start, stop in intervals:
            inside = (start > 0 or first) and (stop < n or last)
            if not inside or stop - start >= max(LEAST_WORDS, LEAST_PERIODS * p):
                found.setdefault((start, stop), []).append(p)
    # two periods p < p' < 2 p of a stretch of p + p' words imply a common divisor below both, so neither is the smallest:
    # a smaller scale has that. A piece that stays beside another period is shorter than a run, in whatever tile it lies.
    left = []
    for (start, stop), periods in found.items():
        periods.sort()
        for p in periods:
            other = periods[0] if p > periods[0] else periods[min(1, len(periods) - 1)]
            if number == 0 or len(periods) == 1 or p + other > stop - start:
                left.append((p, start, stop))
    return left


def _cut(texts: bool):
    """Documents as rows of their own (scale null), with their words if they have tiles, and their tiles as rows."""

    def work(batches):
        for batch in batches:
            for a, b in chunks(batch.column("text"), 1 << 20):
                part = batch.slice(a, b - a)
                words, rows = split_words(part.column("text"))
                codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
                found = list(tiles_of(codes, rows))
                has = {d for d, *_ in found}
                raw = part.column("text").cast(pa.large_binary()).to_pylist()
                plain = [b" ".join(t.split()) for t in raw]
                whole = pa.array([t if texts or i in has else None for i, t in enumerate(plain)], pa.large_binary()).cast(pa.large_string()).cast(pa.string())
                sha = pa.array([None if texts or i in has else hashlib.sha256(t).hexdigest() for i, t in enumerate(plain)], pa.string())
                m = b - a
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text_hash"), pa.array(np.diff(rows), pa.int64()), whole, sha, pa.array([i in has for i in range(m)]), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())], names=CUT_NAMES)
                held, taken = [], 0
                for k, (d, number, start, end) in enumerate(found):
                    cell = codes[rows[d] + start : rows[d] + end].astype(np.int32).tobytes()
                    held.append((d, number, start, cell))
                    taken += len(cell)
                    if taken >= TILE_BYTES or k == len(found) - 1:
                        at = pa.array([h[0] for h in held])
                        m = len(held)
                        yield pa.RecordBatch.from_arrays([part.column("id").take(at), part.column("text_hash").take(at), pa.array(np.diff(rows)[[h[0] for h in held]], pa.int64()), pa.nulls(m, pa.string()), pa.nulls(m, pa.string()), pa.nulls(m, pa.bool_()), pa.array([h[1] for h in held], pa.int32()), pa.array([h[2] for h in held], pa.int64()), pa.array([h[3] for h in held], pa.binary())], names=CUT_NAMES)
                        held, taken = [], 0

    return lean(work)


CUT = "id bigint, text_hash bigint, n bigint, words string, sha string, tiled boolean, scale int, start bigint, codes binary"
CUT_NAMES = [part.split(" ")[0] for part in CUT.split(", ")]


def _solve(batches):
    for batch in batches:
        found = []
        sizes, scales, starts, cells = (batch.column(c).to_pylist() for c in ("n", "scale", "start", "codes"))
        for row, (n, number, start, cell) in enumerate(zip(sizes, scales, starts, cells)):
            words = np.frombuffer(cell, np.int32)
            found += [(row, p, start + a, start + b) for p, a, b in solved(words, number, start == 0, start + len(words) == n)]
        rows = pa.array([f[0] for f in found], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("id").take(rows), batch.column("text_hash").take(rows), *(pa.array([f[i] for f in found], pa.int64()) for i in (1, 2, 3))], names=["id", "text_hash", "period", "start", "end"])


def stitched(intervals: DataFrame, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """(id, text_hash, start, length, period) of the runs that intervals (id, text_hash, period, start, end) are pieces of."""
    order = Window.partitionBy(*KEY, "period").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("start") + F.col("period") > reach, F.lit(True))
    numbered = intervals.distinct().withColumn("new", new.cast("int")).withColumn("part", F.sum("new").over(order))
    whole = numbered.groupBy(*KEY, "period", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    long = whole.where(F.col("end") - F.col("start") >= F.greatest(F.lit(least_words), least_periods * F.col("period")))
    return long.groupBy(*KEY, "start", "end").agg(F.min("period").alias("period")).select(*KEY, "start", (F.col("end") - F.col("start")).alias("length"), "period")


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words outside all runs' later periods."""
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(drop).tolist()) if not d]


def _collapse(texts: bool):
    def work(batches):
        for batch in batches:
            collapsed, sha = [], []
            for words, runs in zip(batch.column("words").to_pylist(), batch.column("runs").to_pylist()):
                kept = " ".join(kept_words(words.split(" ") if words else [], [(r["start"], r["length"], r["period"]) for r in runs]))
                collapsed.append(kept if texts else None)
                sha.append(hashlib.sha256(kept.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), batch.column("runs"), pa.array(collapsed, pa.string()), pa.array(sha, pa.string())], names=["id", "n", "runs", "collapsed", "sha"])

    return lean(work)


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", texts: bool = True) -> DataFrame:
    """(id, n_words, runs, collapsed, collapsed_sha256) of every row: its runs (start, length, period) by start, then period, and the words that are kept, joined by one space.

    Without ``texts`` the collapsed text is null and only its checksum is given,
    so that documents without a tile are not stored.
    """
    modest_batches(docs.sparkSession)
    keyed = docs.select(F.col(id_column).cast("bigint").alias("id"), text_or_empty(text_column).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    cut = stored(keyed.mapInArrow(_cut(texts), CUT))
    tiles = cut.where("scale is not null").select(*KEY, "n", "scale", "start", "codes")
    spread = tiles.repartition(F.xxhash64(*KEY, "scale", "start"))
    runs = stitched(stored(spread.mapInArrow(lean(_solve), "id bigint, text_hash bigint, period bigint, start bigint, end bigint")))
    listed = runs.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    listed = listed.select(F.col("id").alias("r_id"), F.col("text_hash").alias("r_hash"), "runs")
    none = F.array().cast(RUNS)
    tiled = cut.where("tiled").join(listed, (F.col("text_hash") == F.col("r_hash")) & F.col("id").eqNullSafe(F.col("r_id")), "left").select("id", "n", "words", F.coalesce("runs", none).alias("runs"))
    with_runs = tiled.mapInArrow(_collapse(texts), f"id bigint, n bigint, runs {RUNS}, collapsed string, sha string")
    plain = cut.where("not tiled").select("id", "n", none.alias("runs"), F.col("words").alias("collapsed"), F.coalesce("sha", F.sha2("words", 256)).alias("sha"))
    return with_runs.unionByName(plain).select(F.col("id").alias(id_column), F.col("n").alias("n_words"), "runs", "collapsed", F.col("sha").alias("collapsed_sha256"))


def with_made_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) whose words are joined by one space; in one document of ten, by its id's checksum, the words from some place on repeat. A null id makes none."""

    def work(batches):
        for batch in batches:
            found = []
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist()):
                h = zlib.crc32(str(doc_id).encode())
                words = raw.split()
                n, g = len(words), h // 10
                if doc_id is not None and h % MADE_ONE_IN == 0 and n:
                    a = g % n
                    p = 1 + (n - a) // (3 + g % MADE_SHARES)
                    words = words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]
                found.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.large_binary()).cast(pa.large_string()).cast(pa.string())], names=["doc_id", "text"])

    return docs.select("doc_id", text_or_empty("text").alias("text")).mapInArrow(lean(work), "doc_id bigint, text string")


def _digests(batches):
    for batch in batches:
        best, sha, n = [], [], []
        for runs in batch.column("runs").to_pylist():
            runs = [(r["start"], r["length"], r["period"]) for r in runs]
            n.append(len(runs))
            sha.append(hashlib.sha256("".join(f"{s},{ln},{p}\n" for s, ln, p in runs).encode()).hexdigest())
            s, ln, p = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
            best.append((s, ln, p, None if s is None else 1000 * ln // p))
        columns = [pa.array([b[i] for b in best], pa.int64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *columns, pa.array(sha, pa.string()), batch.column("collapsed_sha256")], names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])


def query(spark, sf_dir: str) -> DataFrame:
    """op13: runs of all documents, with the runs that the contract makes."""
    docs = with_made_runs(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    return periodic_runs(docs, texts=False).mapInArrow(lean(_digests), "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string")
