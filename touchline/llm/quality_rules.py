"""Quality rules as a short-circuit cascade of DataFrame expressions.

A rule is a condition over measures of a text. ``order_rules`` estimates on a
bounded sample how long each rule takes, with the measures that it needs, and
how much it rejects, and puts the rules in order of rejections per second.
``first_failed`` asks them in that order and stops at the first that fails:
each rule's measures stand inside its own branch, so those of later rules are
never computed for a document that an earlier one rejects. Only the number of
words, which nearly all rules compare with, is counted once for all. The two
halves of the base rule take part like all others. A verdict is the same in any order,
only its price differs, so the sample can never change a result.

``judged`` returns all measures, so it pays for them whatever the verdict;
``passing`` returns none and pays only for the rules that are asked.

Everything is built-in expressions: no Python runs on the executors and
nothing is shuffled.

Nulls: a null text has no words and fails the base rule. Empty texts likewise.
Repeated rows are judged alike. A very long text, or one very long word, is
measured whole. A document that fails several rules is booked to the first in
the order. An empty table gives no rows. Other columns stay as they are,
whatever their names; in ``judged`` columns of the names that it adds are replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, text_or_empty

NOT_SPACE = r"[^\x20\x09-\x0D]"
SPACE_CHAR, SPACE_RUN = r"[\x20\x09-\x0D]", r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
FEWEST_WORDS, MOST_REPEAT_PERCENT = 50, 50
#: Documents of the sample that orders the rules.
SAMPLE_ROWS = 512
#: How many times a job's own time a rule must take to be timed, and the most passes over the sample for it.
TIMED_FACTOR, MOST_PASSES = 3, 32

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``fails`` gives the condition of a bad document from its measures (by name: MEASURES and text)."""

    name: str
    fails: Callable[[Mapping[str, Column]], Column]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _window_hashes(text: Column) -> Column:
    """64-bit hashes of all windows of three words, in order."""
    words = F.split(F.btrim(text, F.lit(SPACES)), SPACE_RUN)
    none = F.array().cast("array<bigint>")
    return _let(words, lambda w: F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))).otherwise(none))


def _covered(hashes: Column) -> Column:
    """How many words lie in windows that occur twice or more: one sort of hashes with their positions, however often a window occurs."""
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # in order of hash, a window is repeated if the one before or after it is the same
    seen = _let(placed, lambda p: F.filter(p, lambda w, i: (F.get(p, i - 1)["h"] == w["h"]) | (F.get(p, i + 1)["h"] == w["h"])))
    return F.size(F.array_distinct(F.flatten(F.transform(seen, lambda w: F.array(w["i"], w["i"] + 1, w["i"] + 2)))))


def measure_columns(text: Column) -> dict[str, Column]:
    """The measures of a text that is not null, each an expression of its own."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(NOT_SPACE))
    repeated = _let(_window_hashes(text), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_covered(h)))
    return {
        "text": text,
        "n_words": F.regexp_count(text, F.lit(NOT_SPACE + "++")).cast("long"),
        "word_chars": (F.length(text) - F.regexp_count(text, F.lit(SPACE_CHAR))).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": F.when(~F.contains(text, F.lit("\n")), 0).otherwise(_let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).cast("long"),
        "n_repeat_words": repeated.cast("long"),
    }


def base_rules() -> list[Rule]:
    """The two halves of the base rule."""
    return [
        Rule("few_words", lambda m: m["n_words"] < FEWEST_WORDS),
        Rule("repeats", lambda m: 100 * m["n_repeat_words"] > MOST_REPEAT_PERCENT * m["n_words"]),
    ]


def default_rules() -> list[Rule]:
    """Rules beyond the base rule: what marks lists of junk, shouting, symbols and copied lines."""

    def words(m):
        return F.greatest(m["n_words"], F.lit(1))

    def chars(m):
        return F.greatest(m["word_chars"], F.lit(1))

    return [
        Rule("symbols", lambda m: 100 * m["n_symbols"] > 25 * words(m)),
        Rule("copied_lines", lambda m: m["n_dup_lines"] * 2 > F.size(F.split(m["text"], "\n", -1))),
        Rule("word_length", lambda m: (m["word_chars"] < 2 * words(m)) | (m["word_chars"] > 20 * words(m))),
        Rule("shouting", lambda m: 100 * F.regexp_count(m["text"], F.lit(r"\p{Lu}")) > 40 * chars(m)),
        Rule("exclaiming", lambda m: 10 * F.regexp_count(m["text"], F.lit("!")) > words(m) * 5),
        Rule("few_letters", lambda m: 100 * F.length(F.regexp_replace(m["text"], r"\P{L}+", "")) < 60 * chars(m)),
    ]


@dataclass(frozen=True)
class Estimate:
    """Seconds a pass over the sample, and the share of it that the rule rejects."""

    name: str
    seconds: float
    rejected: float


def order_rules(df: DataFrame, rules: list[Rule], text_column: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[list[Rule], list[Estimate]]:
    """The rules by rejections per second on a sample of ``df``, and what was estimated.

    The sample's rows are spread over the table by hash of their texts and
    their number is bounded; one task holds it. Each rule runs alone, as often
    over the sample as it takes to last several times as long as an empty
    job, whose time is taken off. An empty table keeps the given order.
    """
    texts = df.select(text_or_empty(text_column).alias("sample_text"))
    share = max(1, df.count() // sample_rows)
    picked = texts.where(F.pmod(F.xxhash64("sample_text"), F.lit(share)) == 0).limit(sample_rows).coalesce(1)
    sample = picked.withColumn("sample_words", measure_columns(F.col("sample_text"))["n_words"]).cache()
    try:
        n = sample.count()
        if not n:
            return rules, []
        measured = measure_columns(F.col("sample_text")) | {"n_words": F.col("sample_words")}

        def timed(fails: Column, passes: int) -> tuple[float, float]:
            began = time.perf_counter()
            rows = sample.withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(passes))))
            hits = rows.agg(F.sum(F.when(fails, 1).otherwise(0)).alias("hits")).head()["hits"]
            return time.perf_counter() - began, hits / (n * passes)

        timed(F.lit(False), 1)
        floor = min(timed(F.lit(False), 1)[0] for _ in range(3))
        found = []
        for rule in rules:
            fails, passes = rule.fails(measured), 1
            timed(fails, 1)  # compiles it
            seconds, rejected = timed(fails, 1)
            while seconds < TIMED_FACTOR * floor and passes < MOST_PASSES:
                passes = MOST_PASSES if seconds < 1.5 * floor else min(4 * passes, MOST_PASSES)
                seconds, rejected = timed(fails, passes)
            found.append(Estimate(rule.name, max(seconds - floor, 1e-6) / passes, rejected))
        rate = {e.name: e.rejected / e.seconds for e in found}
        price = {e.name: e.seconds for e in found}
        return sorted(rules, key=lambda r: (-rate[r.name], price[r.name])), found
    finally:
        sample.unpersist()


def first_failed(rules: list[Rule], measured: Mapping[str, Column]) -> Column:
    """The name of the first rule in this order that a document fails, null if it passes all. Later rules aren't asked."""
    verdict = F
    for rule in rules:
        verdict = verdict.when(rule.fails(measured), F.lit(rule.name))
    return verdict.otherwise(F.lit(None).cast("string")) if rules else F.lit(None).cast("string")


def judged(df: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows with their measures, base_failed, failed_rule and kept; columns of these names are replaced.

    As the measures are asked for, the base rule costs nothing more and comes
    first; what only other rules need is computed where they are asked.
    """
    rules, _ = order_rules(df, default_rules(), text_column)
    names = [c for c in df.columns if c not in (*MEASURES, "base_failed", "failed_rule", "kept")]
    whole = df.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("whole"), text_or_empty(text_column).alias("text"))
    measured = whole.withColumns({k: v for k, v in measure_columns(F.col("text")).items() if k != "text"})
    columns = {k: F.col(k) for k in (*MEASURES, "text")}
    base = F.lit(False)
    for rule in base_rules():
        base = base | rule.fails(columns)
    ruled = measured.withColumns({"base_failed": base, "failed_rule": first_failed([*base_rules(), *rules], columns)})
    return ruled.select("whole.*", *MEASURES, "base_failed", "failed_rule", F.col("failed_rule").isNull().alias("kept"))


def passing(df: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows and columns of ``df`` that pass: a filter by the cascade, base rule included in its order."""
    rules, _ = order_rules(df, [*base_rules(), *default_rules()], text_column)
    measured = measure_columns(text_or_empty(text_column))
    return df.where(_let(measured["n_words"], lambda n: first_failed(rules, measured | {"n_words": n}).isNull()))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: measures and verdicts of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_SQL = r"""
WITH words AS (
    SELECT doc_id, coalesce(text, '') AS text,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda v: v <> '') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
), windows AS (
    SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS three
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) > 2)
), repeated AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, three) AS n FROM windows) WHERE n > 1
), covered AS (
    SELECT doc_id, count(DISTINCT i + d) AS n FROM repeated, (SELECT unnest([0, 1, 2]) AS d) GROUP BY doc_id
), counted AS (
    SELECT words.doc_id, text, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(string_split(text, chr(10))) AS n_lines
    FROM words LEFT JOIN covered USING (doc_id)
), based AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR 100 * n_symbols > 25 * greatest(n_words, 1) OR n_dup_lines * 2 > n_lines
        OR word_chars < 2 * greatest(n_words, 1) OR word_chars > 20 * greatest(n_words, 1)
        OR 100 * length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) > 40 * greatest(word_chars, 1)
        OR 10 * (length(text) - length(replace(text, '!', ''))) > 5 * greatest(n_words, 1)
        OR 100 * length(regexp_replace(text, '[^\p{L}]', '', 'g')) < 60 * greatest(word_chars, 1)) AS kept
FROM based
"""
