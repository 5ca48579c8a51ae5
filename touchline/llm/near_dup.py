"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

1. One pass gives each row the size of its shingle set, a print of the set
   and the band keys of its signature. Rows with equal sets are one class from
   here on, named by a 64-bit hash of the print (``node``).
2. Classes that share a band key are candidates. Elements that no other
   candidate has bound what a class can share with any other, and so which
   pairs can be links at all. Each class is compared with the member of each of
   its buckets that shares most; links join components.
3. Where a bucket still holds several components, its members are compared
   with their neighbours in several random orders, large buckets in parts.
4. What is then still outside the largest component of its bucket is compared
   with all members of the bucket in other components that the bounds allow,
   large buckets block by block. So no link between candidates is lost, while a group of many copies
   costs about as many comparisons as it has members.

Every link is confirmed on the full sets. With 36 bands of 5 rows a pair at the
threshold of 0.8 shares no band with a chance of 6e-7.

Nulls: a null text has no words. A document without words has an empty set
and is linked with nothing. A row without id is linked with nothing, and its
component is null. Rows that share an id are separate documents, linked only if
their texts are: each gets a row, and a component's id is its least one. Of
equal components' ids the row with the smaller hash of its text is the one
that stays. Very long texts have as many shingles as they have; blocks are
bounded by the bytes of their sets. An empty table gives no rows. Only the two
named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, lean, modest_batches, stored, string_buffers, table, text_or_empty
from .components import components
from .superminhash import band_keys, overlap, set_prints, shingle_sets, signatures

BANDS, BAND_ROWS = 36, 5
PERCENT = 80
#: Random orders in which a bucket's members meet their neighbours.
ORDERS = 3
#: Members from which a bucket is compared in blocks, and of a block.
BLOCK = 256
#: Bytes of the sets of a block, about.
BLOCK_SET_BYTES = 2 << 20
#: Bytes of text whose sets and permutations are in memory at a time.
BLOCK_BYTES = 1 << 20


def fingerprints(docs: DataFrame, words: int, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """(id, text_hash, n, print_a, print_b, bands) of rows (id, text_hash, text); a document without words has no band."""

    def work(batches):
        for batch in batches:
            ids, hashes, texts = batch.column("id"), batch.column("text_hash"), batch.column("text")
            for start, end in chunks(texts, BLOCK_BYTES):
                values, rows = shingle_sets(texts.slice(start, end - start), words)
                keys = band_keys(signatures(values, rows, bands * band_rows), bands, band_rows)
                n = np.diff(rows)
                flat = keys[n > 0].ravel()
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))])
                a, b = set_prints(values, rows)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids.slice(start, end - start), hashes.slice(start, end - start), pa.array(n, pa.int64()), pa.array(a), pa.array(b), lists], names=["id", "text_hash", "n", "print_a", "print_b", "bands"])

    return docs.mapInArrow(lean(work), "id bigint, text_hash bigint, n bigint, print_a bigint, print_b bigint, bands array<bigint>")


def shingle_rows(docs: DataFrame, words: int) -> DataFrame:
    """(id, n, elements) of rows (id, text), the id being what the set is known by: the sorted 64-bit hashes of each document's set, as binary."""

    def work(batches):
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            for start, end in chunks(texts, BLOCK_BYTES):
                values, rows = shingle_sets(texts.slice(start, end - start), words)
                raw = values.tobytes()
                cells = [raw[8 * x : 8 * y] for x, y in zip(rows[:-1].tolist(), rows[1:].tolist())]
                yield pa.RecordBatch.from_arrays([ids.slice(start, end - start), pa.array(np.diff(rows), pa.int64()), pa.array(cells, pa.binary())], names=["id", "n", "elements"])

    return docs.mapInArrow(lean(work), "id bigint, n bigint, elements binary")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, both) of pairs (a, b): the sizes of both full sets and of their intersection."""

    def work(batches):
        for batch in batches:
            found = [(len(p), len(q), overlap(p, q)) for p, q in ((np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column("left"), batch.column("right")))]
            table = np.array(found, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *(pa.array(table[:, i]) for i in range(3))], names=["a", "b", "n_a", "n_b", "both"])

    left = sets.select(F.col("id").alias("a"), F.col("elements").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("elements").alias("right"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(lean(work), "a bigint, b bigint, n_a bigint, n_b bigint, both bigint")


def linked(found: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets overlap by at least so many percent of their union."""
    return found.where(100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def reachable(sets: DataFrame) -> DataFrame:
    """(id, shared): how many of a set's elements some other set has too; no overlap can be larger.

    An element that one set alone has is counted for that set: one grouping by
    element, summed before the shuffle.
    """

    def work(batches):
        for batch in batches:
            cells = batch.column("elements").cast(pa.large_binary())
            data, offsets = string_buffers(cells)
            owner = np.repeat(batch.column("id").to_numpy(), np.diff(offsets) // 8)
            values = np.ascontiguousarray(data).view(np.int64)
            for a in range(0, len(values), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(values[a : a + 200_000]), pa.array(owner[a : a + 200_000])], names=["element", "id"])

    seen = sets.select("id", "elements").mapInArrow(lean(work), "element bigint, id bigint").groupBy("element").agg(F.count("*").alias("c"), F.min("id").alias("id"))
    alone = seen.where("c = 1").groupBy("id").agg(F.count("*").alias("alone"))
    return sets.select("id", "n").join(alone, "id", "left").select("id", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared"))


def _may_link(n: str, shared: str, o_n: str, o_shared: str, percent: int):
    """Whether two sets of these sizes could overlap enough: by no more than what each shares with any other set."""
    return (100 + percent) * F.least(shared, o_shared) >= percent * (F.col(n) + F.col(o_n))


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """members with their component so far, of the buckets that hold several."""
    named = members.join(components(links), F.col("id") == F.col("node"), "left").select("bucket", "id", "n", "shared", "away", F.coalesce("component", "id").alias("component"))
    mixed = named.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    return stored(named.join(mixed, "bucket", "left_semi"))


def link_classes(members: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Confirmed links (a, b) that connect the classes of ``members`` (bucket, id, n, shared) as all links would."""
    keep = ["bucket", "id", "n", "shared"]
    centres = members.groupBy("bucket").agg(F.max(F.struct("shared", (-F.col("id")).alias("neg"), "n")).alias("c"))
    starred = members.join(centres, "bucket").select(*keep, (-F.col("c.neg")).alias("o_id"), F.col("c.n").alias("o_n"), F.col("c.shared").alias("o_shared"))
    pair = [F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b")]
    stars = starred.where((F.col("id") != F.col("o_id")) & _may_link("n", "shared", "o_n", "o_shared", percent))
    tested = stored(overlaps(stars.select(*pair).distinct(), sets))
    links = stored(linked(tested, percent))
    # the Jaccard distance of each member to its bucket's centre, where it was computed: a metric, so two members whose
    # distances differ by more than a link allows are no link
    distance = tested.select("a", "b", (1 - F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("d"))
    members = stored(starred.select(*keep, *pair).join(distance, ["a", "b"], "left").select(*keep, F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.col("d")).alias("away")))
    tested = tested.select("a", "b")

    open_members = _labelled(members, links)
    # a part of a bucket has about BLOCK members; what lies apart is met in a later step
    parts = open_members.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    parted = open_members.join(parts, "bucket")
    near = None
    for k in range(ORDERS):
        part = F.xxhash64("bucket", F.pmod(F.xxhash64(F.lit(k), "id"), F.col("parts")))
        order = Window.partitionBy(part).orderBy(F.xxhash64("id", F.lit(k)), "id")
        before = parted.select("id", "n", "shared", "component", F.lag(F.struct("id", "n", "shared", "component")).over(order).alias("o"))
        found = before.where((F.col("o.component") != F.col("component")) & _may_link("n", "shared", "o.n", "o.shared", percent)).select(F.least("id", "o.id").alias("a"), F.greatest("id", "o.id").alias("b"))
        near = found if near is None else near.unionByName(found)
    fresh = stored(near.distinct().join(tested, ["a", "b"], "left_anti"))
    links = stored(links.unionByName(linked(overlaps(fresh, sets), percent)))
    tested = tested.unionByName(fresh)

    open_members = _labelled(members, links)
    sizes = open_members.groupBy("bucket").agg(F.count("*").alias("size"))
    sized = open_members.join(sizes, "bucket")
    counts = open_members.groupBy("bucket", "component").agg(F.count("*").alias("c"))
    largest = counts.groupBy("bucket").agg(F.max(F.struct("c", F.col("component").alias("largest"))).alias("x")).select("bucket", "x.largest")
    placed = sized.where(F.col("size") < BLOCK).join(largest, "bucket")
    outside = placed.where(F.col("component") != F.col("largest"))
    other = placed.select("bucket", F.col("id").alias("o_id"), F.col("n").alias("o_n"), F.col("shared").alias("o_shared"), F.col("away").alias("o_away"), F.col("component").alias("o_component"), (F.col("component") == F.col("largest")).alias("o_in"))
    in_reach = F.coalesce(F.abs(F.col("away") - F.col("o_away")) <= 1 - percent / 100 + 1e-9, F.lit(True))
    rest = (
        outside.join(other, "bucket")
        .where((F.col("component") != F.col("o_component")) & (F.col("o_in") | (F.col("id") < F.col("o_id"))) & _may_link("n", "shared", "o_n", "o_shared", percent) & in_reach)
        .select(F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b"))
        .distinct()
        .join(tested, ["a", "b"], "left_anti")
    )
    large = _links_in_blocks(sized.where(F.col("size") >= BLOCK).select("bucket", "id", "n", "component"), sets, percent)
    return links.unionByName(linked(overlaps(rest, sets), percent)).unionByName(large)


def _links_in_blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) between components of large buckets, given as (bucket, id, n, component).

    Buckets that share members are one group. Its members outside its largest
    component are queries against all its members, block by block: a row holds
    a block of either, and only links leave the task that counts their overlaps.
    """
    members = stored(members)
    least = members.groupBy("bucket").agg(F.min("id").alias("b"))
    grouped = components(members.join(least, "bucket").select(F.col("id").alias("a"), "b")).select(F.col("node").alias("id"), F.col("component").alias("group"))
    rows = members.select("id", "n", "component").distinct().join(grouped, "id")
    counts = rows.groupBy("group", "component").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    totals = counts.groupBy("group").agg(F.greatest(F.ceil(F.sum("c") / BLOCK), F.ceil(8 * F.sum("n") / BLOCK_SET_BYTES)).alias("blocks"), F.max(F.struct("c", F.col("component").alias("largest"))).alias("x")).select("group", "blocks", "x.largest")
    placed = rows.join(totals, "group").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    full = stored(placed.join(sets.select("id", "elements"), "id").select("group", "block", "blocks", (F.col("component") != F.col("largest")).alias("asks"), F.struct("id", "component", "elements").alias("row")))
    asked = full.groupBy("group", "block").agg(F.collect_list("row").alias("right"))
    asking = full.where("asks").groupBy("group", F.col("block").alias("own_block")).agg(F.collect_list("row").alias("left"), F.first("blocks").alias("blocks"))
    met = asking.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(asked, ["group", "block"]).select("left", "right")

    def work(batches):
        for batch in batches:
            for left, right in zip(batch.column("left"), batch.column("right")):
                found = block_links(left.as_py(), right.as_py(), percent)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return met.mapInArrow(lean(work), "a bigint, b bigint")


def block_links(left: list[dict], right: list[dict], percent: int) -> list[tuple[int, int]]:
    """Links between rows (id, component, elements) of two blocks whose components differ, by an inverted index of the second."""
    sizes = np.array([len(r["elements"]) // 8 for r in right])
    values = np.frombuffer(b"".join(r["elements"] for r in right), np.uint64)
    owner = np.repeat(np.arange(len(right)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    part = np.array([r["component"] for r in right])
    found = []
    for row in left:
        own = np.frombuffer(row["elements"], np.uint64)
        first, last = np.searchsorted(values, own, side="left"), np.searchsorted(values, own, side="right")
        many = last - first
        at = np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        both = np.bincount(owner[at], minlength=len(right))
        hits = np.flatnonzero((100 * both >= percent * (len(own) + sizes - both)) & (part != row["component"]))
        found += [(min(row["id"], right[i]["id"]), max(row["id"], right[i]["id"])) for i in hits.tolist()]
    return found


def _components(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, text_hash, n, node, component, group) of rows (id, text_hash, text): component is the least id of the rows linked, group tells components apart even where ids repeat."""
    prints = stored(fingerprints(docs, words).withColumn("node", F.xxhash64("print_a", "print_b", "n")))
    linked = prints.where("n > 0 and id is not null")
    classes = linked.groupBy("node").agg(F.min(F.struct("id", "text_hash")).alias("rep"))
    reps = classes.select("node", F.col("rep.id").alias("id"), F.col("rep.text_hash").alias("text_hash"))
    first = linked.join(reps, ["node", "id", "text_hash"], "left_semi").select(F.col("node").alias("id"), "n", F.explode(F.array_distinct("bands")).alias("bucket")).distinct()
    met = first.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket")
    candidates = stored(first.join(met, "bucket").select("bucket", "id", "n"))
    asked = reps.join(candidates.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    sets = stored(shingle_rows(docs.join(asked, ["id", "text_hash"]).select(F.col("node").alias("id"), "text"), words).dropDuplicates(["id"]))
    # a set of which others share less than the threshold's part has no link
    able = reachable(sets).join(sets.select("id", F.col("n").alias("m")), "id").where(100 * F.col("shared") >= percent * F.col("m")).select("id", "shared")
    members = stored(candidates.join(able, "id"))
    # stored first, so that no task holds the workers of two steps
    grouped = components(stored(link_classes(members, sets, percent))).select("node", F.col("component").alias("group"))
    joint = grouped.join(reps, "node").groupBy("group").agg(F.min("id").alias("component"))
    named = reps.select("node", "id").join(grouped.join(joint, "group"), "node", "left").select("node", F.coalesce("component", "id").alias("component"), F.coalesce("group", "node").alias("group"))
    with_key = prints.select("id", "text_hash", "n", "node")
    alone = with_key.where("n = 0 or id is null").select("*", F.col("id").alias("component"), F.lit(None).cast("bigint").alias("group"))
    return with_key.where("n > 0 and id is not null").join(named, "node").select("id", "text_hash", "n", "node", "component", "group").unionByName(alone)


def _numbered(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return df.select(F.col(id_column).cast("bigint").alias("id"), text_or_empty(text_column).alias("text")).withColumn("text_hash", F.xxhash64("text"))


def near_duplicates(df: DataFrame, words: int = 5, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row: kept is true for the least id of a component, and for rows without id."""
    modest_batches(df.sparkSession)
    found = _components(_numbered(df, id_column, text_column), words, percent)
    return found.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def drop_near_duplicates(df: DataFrame, words: int = 5, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows and columns of ``df`` without all but one row of each component: that of the least id. Of equal rows without words one stays; rows without id stay."""
    modest_batches(df.sparkSession)
    found = _components(_numbered(df, id_column, text_column), words, percent).where("id is not null")
    of_groups = found.where("group is not null").groupBy("group").agg(F.min(F.struct("id", "text_hash")).alias("first")).select("first.*")
    kept = of_groups.unionByName(found.where("group is null").select("id", "text_hash").distinct())
    whole = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("whole"), F.col(id_column).cast("bigint").alias("id"), F.xxhash64(text_or_empty(text_column)).alias("text_hash"))
    stay = whole.where("id is not null").join(kept, ["id", "text_hash"], "left_semi").dropDuplicates(["id", "text_hash"])
    return stay.unionByName(whole.where("id is null")).select("whole.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: components of all documents over their 2-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=2)
