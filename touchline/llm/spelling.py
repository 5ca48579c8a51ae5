"""Groups of spelling variants: near words by a relational trie frontier, forms and roots by counts.

The vocabulary is a distributed trie. Its edge table has a row a node with the
at most 90 edges that leave it (the alphabet bounds them); a node is named by
the 64-bit hash of its prefix, and a branch that leads to one word alone ends
in that word. The frontier holds states (word, position, node, edits). At each
level the states of that depth join the edge table: a state without an edit
replaces its letter by a greater one or drops it, a state with one edit follows
its next letter. States that reach a word are neighbours, after their rest is
compared letter by letter, so that equal hashes cannot make a pair.

Either word of a pair finds the other, so letters are never inserted and only
replaced by greater ones. An edit lies in the second half of a word or of the
reversed word; so there is a trie of each direction, the states start in the
middle, and shallow nodes, where everything meets, are never expanded. Nodes of
a level travel to all tasks only if the level has few edges, else they are
joined by node, which AQE may split.

Words of 64 code points and more would need as many levels. They meet by what
is left when one letter is dropped, in a number of rows that is their length;
Spark's bounded edit distance confirms the pairs. Pairs of 64 letters come from
both ways and are counted once.

Nulls: a null text has no words; a null id counts as the empty text in the
checksum. Ties of a form go to the smallest word in code-point order. Repeated
rows are counted as often as they occur. Long texts and words are taken whole.
An empty table gives no rows. Only the two named columns are read, so other
columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, mixed, modest_batches, shared_folder, stored, table, text_or_empty

#: Fixed values of the word definition: letters, and the share of runs that lose one.
LETTERS, DROP_ONE_IN = "[A-Za-zÀ-ÿ]+", 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Code points from which words meet by what is left without a letter.
LONG = 64
#: Edges of a level that are sent to all tasks.
BROADCAST_EDGES = 200_000

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: An odd base of the rolling hash, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def vocabulary(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all texts: lower-cased runs of letters, some without one letter as their checksum tells."""
    runs = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_or_empty(text_column), F.lit(LETTERS), F.lit(0))).alias("run"))
    lower = runs.select(F.concat("id", F.lit(":"), F.translate("run", _CAPITALS, _CAPITALS.lower())).alias("tagged"), F.translate("run", _CAPITALS, _CAPITALS.lower()).alias("run"))
    hashed = lower.select("run", F.crc32(F.col("tagged").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = hashed.select(F.when(F.col("h") % DROP_ONE_IN == 0, short).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _node(depth) -> F.Column:
    """The name of the node that the first ``depth`` letters of ``s`` lead to."""
    return F.xxhash64("side", F.substring("s", F.lit(1), depth))


def edge_table(directed: DataFrame) -> DataFrame:
    """(depth, node, kids) of both tries' nodes below the middles of their words, where two words or more pass: kids (c, child, word), the word only if no other passes; c is empty where a word ends."""
    depth = F.col("depth")
    steps = directed.select("side", "s", F.explode(F.sequence("middle", "size")).alias("depth"))
    edges = steps.select("depth", _node(depth).alias("node"), F.substring("s", depth + 1, F.lit(1)).alias("c"), _node(depth + 1).alias("child"), "s")
    passed = edges.groupBy("depth", "node", "c", "child").agg(F.count("*").alias("words"), F.min("s").alias("s"))
    kids = F.collect_list(F.struct("c", "child", F.when(F.col("words") == 1, F.col("s")).alias("word")))
    return passed.groupBy("depth", "node").agg(F.sum("words").alias("words"), kids.alias("kids")).where("words > 1").drop("words")


def frontier_step(states: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """(side, s, pos, node, word): where the states of a depth get to by one edge; a word is a neighbour, else node is a state of the next depth."""
    met = states.join(nodes, "node").select("side", "s", "pos", "edits", F.explode("kids").alias("kid"))
    letter = F.substring("s", F.col("pos") + 1, F.lit(1))
    moved = met.where(F.when(F.col("edits") == 0, F.col("kid.c") > letter).otherwise(F.col("kid.c") == letter))
    same_rest = F.substring("kid.word", F.lit(depth + 2), F.char_length("kid.word")) == F.substring("s", F.col("pos") + 2, F.char_length("s"))
    return moved.where(F.col("kid.word").isNull() | same_rest).select("side", "s", (F.col("pos") + 1).alias("pos"), F.col("kid.child").alias("node"), F.col("kid.word").alias("word"))


def trie_pairs(words: DataFrame) -> DataFrame:
    """(a, b) of near words among ``words`` (word), each pair at least once."""
    spark = words.sparkSession
    directed = words.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("s")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("s")))).alias("d")).select("d.*")
    directed = stored(directed.withColumn("size", F.char_length("s")).withColumn("middle", F.floor((F.col("size") - 1) / 2).cast("int")))
    nodes = stored(edge_table(directed))
    edges = {r["depth"]: r["edges"] for r in nodes.groupBy("depth").agg(F.sum(F.size("kids")).alias("edges")).collect()}  # at most LONG rows
    base = shared_folder(spark)
    schema = "side int, s string, pos int, node bigint, word string"
    before = None
    for depth in range(min(edges, default=0), max(edges, default=-1) + 1):
        begun = directed.where((F.col("middle") <= depth) & (F.col("size") > depth)).select("side", "s", _node(F.lit(depth)).alias("node"), F.explode(F.array(F.lit(0), F.lit(1))).alias("edits"))
        states = begun.select("side", "s", (F.lit(depth) + F.col("edits")).alias("pos"), "node", "edits")
        if before is not None:
            states = states.unionByName(before.where("word is null").select("side", "s", "pos", "node", F.lit(1).alias("edits")))
        here = nodes.where(F.col("depth") == depth).select("node", "kids")
        frontier_step(states, F.broadcast(here) if edges.get(depth, 0) <= BROADCAST_EDGES else here, depth).write.parquet(f"{base}/depth={depth}")
        before = spark.read.schema(schema).parquet(f"{base}/depth={depth}")
    if before is None:
        return words.select(F.col("word").alias("a"), F.col("word").alias("b")).where("false")
    found = spark.read.schema(schema + ", depth int").parquet(base).where("word is not null")
    restored = [F.when(F.col("side") == 1, F.reverse(c)).otherwise(F.col(c)) for c in ("s", "word")]
    return found.select(restored[0].alias("a"), restored[1].alias("b"))


def rest_hashes(word: str) -> np.ndarray:
    """64-bit hashes of the word and of what is left of it without its first, second, ... code point; equal strings have equal ones."""
    codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    powers = np.full(len(codes) + 1, _BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers[:-1], dtype=np.uint64)])
    left = sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(_INVERSE)
    return mixed(np.concatenate([sums[-1:], left])).view(np.int64)


def long_pairs(words: DataFrame) -> DataFrame:
    """(a, b) of near words among long ``words`` (word): those that are equal once a letter of one is dropped, or the same letter of both."""

    def work(batches):
        for batch in batches:
            for key, word in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist()):
                hashes = rest_hashes(word)
                for start in range(0, len(hashes), 200_000):
                    part = hashes[start : start + 200_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), key)), pa.array(np.arange(start, start + len(part)) - 1), pa.array(part)], names=["id", "at", "rest"])

    named = stored(words.select(F.xxhash64("word").alias("id"), "word"))
    rests = stored(named.mapInArrow(lean(work), "id bigint, at bigint, rest bigint"))
    whole, less = rests.where("at < 0").select(F.col("id").alias("a"), "rest"), rests.where("at >= 0").select(F.col("id").alias("b"), "at", "rest")
    dropped = whole.join(less, "rest").select("a", "b")
    replaced = less.select(F.col("b").alias("a"), "at", "rest").join(less, ["at", "rest"]).where("a < b").select("a", "b")  # at most 90 words a group
    a, b = (named.select(F.col("id").alias(x), F.col("word").alias(f"word_{x}")) for x in "ab")
    pairs = dropped.unionByName(replaced).distinct().join(a, "a").join(b, "b").where("word_a <> word_b")
    return pairs.where(F.levenshtein("word_a", "word_b", 1) == 1).select(F.col("word_a").alias("a"), F.col("word_b").alias("b"))


def near_words(words: DataFrame) -> DataFrame:
    """(a, b): every ordered pair of ``words`` (word) that differ by one inserted, deleted or replaced code point, once."""
    pairs = trie_pairs(words.where(F.char_length("word") <= LONG))
    long = words.where(F.char_length("word") >= LONG)
    if not long.isEmpty():
        pairs = pairs.unionByName(long_pairs(long))
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): forms followed to the last by doubling; counts at least double along a chain, so it has no cycle and few links."""
    chain = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        further = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(chain.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        chain = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return chain


def spelling_variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word: form is its near word of largest count if that is at least twice its own."""
    modest_batches(docs.sparkSession)
    words = stored(vocabulary(docs, id_column, text_column, least_length, least_count))
    counted = near_words(words.select("word")).join(words.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b")
    best = counted.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), "b")).alias("best"))
    judged = words.join(best.select(F.col("a").alias("word"), "n_near", "best"), "word", "left")
    fits = -F.col("best.less") >= 2 * F.col("n")
    formed = stored(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.b")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")))
    rooted = roots(formed.where("form is not null"))
    return formed.join(rooted, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    """op11: forms and roots of the words of all documents."""
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
