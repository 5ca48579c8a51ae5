"""Spelling variants against counting and comparing all words by hand."""

import collections
import random
import re
import zlib

import pytest

from touchline.llm import spelling


def expected(rows, least_length=5, least_count=3):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate({i: i + 32 for i in range(65, 91)})):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            cut = h % len(run)
            counts[run if h % 97 else run[:cut] + run[cut + 1 :]] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least_length and c >= least_count}
    near = {w: {v for v in n if v != w and one_edit(v, w)} for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    found = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        found[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return found


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at:] == b[at + 1 :]


def found(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, word string, n int")
    got = spelling.spelling_variants(docs, **options).collect()
    assert len({r["word"] for r in got}) == len(got)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got}


@pytest.mark.parametrize("seed", range(3))
def test_words_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choices("abÀ", k=rng.randint(1, 8))) for _ in range(150)] + ["".join(rng.choices("Éßabcdefg", k=rng.randint(4, 12))) for _ in range(60)]
    weights = [rng.choice((1, 2, 8, 40)) for _ in pool]
    rows = [(rng.choice((None, i, 7)), rng.choice((" ", "\n", "1")).join(rng.choices(pool, weights, k=40))) for i in range(60)]
    assert found(spark, rows) == expected(rows)
    assert found(spark, rows, least_length=1, least_count=1) == expected(rows, 1, 1)


def test_letters_outside_the_pattern_and_capitals(spark):
    rows = [(i, "Kitchen KITCHEN kitchén kitchen× naïve_naïve ÀÉÎÕÜ àéîõü") for i in range(4)] + [(9, None), (10, ""), (11, "12 !")]
    assert found(spark, rows) == expected(rows)


def test_long_words_and_the_seam_between_both_ways(spark):
    rng = random.Random(5)
    base = "".join(rng.choices("abc", k=70))
    pool = [base[:k] for k in range(60, 70)] + [base[:64][:i] + "z" + base[:64][i + 1 :] for i in (0, 31, 63)] + [base[:i] + base[i + 1 :] for i in (0, 30, 69)] + ["q" * 3000, "q" * 3001, "q" * 2999 + "r"]
    rows = [(i, " ".join(pool)) for i in range(5)]
    got = found(spark, rows)
    assert got == expected(rows)
    assert got["q" * 3000][3] == 2 and got[base[:64]][3] >= 5


def test_chains_lead_to_the_last_form(spark):
    words = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb"]
    rows = [(0, " ".join(w for k, w in enumerate(words) for _ in range(2**k * 3)))]
    got = found(spark, rows)
    assert got == expected(rows) and {v[1] for v in got.values()} == {max(got, key=lambda w: got[w][2])}


def test_empty_table_repeated_rows_and_hot_words(spark):
    assert found(spark, []) == {}
    rows = [(1, "variant variant variant")] * 50 + [(2, "varient " * 9)]
    assert found(spark, rows) == expected(rows)


def test_joins_without_broadcast_give_the_same(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, " ".join("".join(rng.choices("ab", k=rng.randint(5, 7))) for _ in range(60))) for i in range(20)]
    monkeypatch.setattr(spelling, "BROADCAST_EDGES", 0)
    assert found(spark, rows) == expected(rows)
