"""Spelling variants against all pairs of words, each word counted by itself."""

import random
import re
import zlib
from collections import Counter

import pytest

from textloom.llm import variants
from textloom.llm.queries import op11_spelling_variants


def one_edit(a, b):
    """Exactly one inserted, deleted or replaced code point, tried out."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def counted(rows, letters=6, occurrences=5, every=199):
    found = Counter()
    for number, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if number is None else number}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= letters and n >= occurrences}


def expected(rows, **options):
    words = counted(rows, **options)
    # Words that one edit apart share a half: a cheap way not to try all pairs.
    halves = {}
    for w in words:
        for length in (len(w) - 1, len(w), len(w) + 1):
            cut = length // 2
            for part in {w[:cut], w[:cut - 1], w[:cut + 1]}:
                halves.setdefault(("front", part), set()).add(w)
            for tail in (len(w) - cut - 1, len(w) - cut, len(w) - cut + 1):
                halves.setdefault(("back", w[max(0, tail):]), set()).add(w)
    near = {w: set() for w in words}
    for group in halves.values():
        for a in group:
            near[a] |= {b for b in group if abs(len(a) - len(b)) < 2 and b not in near[a] and one_edit(a, b)}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n, len(near[w]), form[w], words[form[w]] if form[w] else None, root))
    return out


def found(df):
    rows = df.select("word", "n", "n_near", "form", "form_n", "root").collect()
    out = {tuple(r) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = expected([tuple(r) for r in rows])
    assert found(op11_spelling_variants(spark, folder)) == want and len(want) > 100


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_all_pairs_of_dense_words(spark, seed):
    """Few letters, so that words have many neighbours, runs of like letters and chains of forms."""
    draw = random.Random(seed)
    words = ["".join(draw.choice("aabé") for _ in range(draw.randint(3, 6))) for _ in range(150)]
    rows = [(k, " ".join([w] * (5 ** draw.randint(0, 4)))) for k, w in enumerate(words)]
    options = {"letters": 3, "occurrences": 1, "every": 7}
    plain = {w: 0 for w in counted(rows, **options)}
    near = {w: sum(one_edit(w, x) for x in plain) for w in plain}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = found(variants.spelling_variants(df, **options))
    assert {(w, k) for w, _, k, *_ in got} == set(near.items())
    assert got == expected(rows, **options)
    assert any(f and r != f for *_, f, _, r in got)


def test_odd_rows(spark):
    six = "straße Straße STRAßE straße straße"
    rows = [(None, six), (1, None), (2, ""), (3, "12 $$ -"), (4, "ÉCLAIRS " * 6), (4, "ÉCLAIRS " * 6), (5, "éclairs " * 5), (6, "short " * 9)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string")
    got = found(variants.spelling_variants(df))
    assert got == expected(rows)
    assert {w for w, *_ in got} >= {"straße", "Éclairs", "éclairs"}
    empty = df.filter("false")
    assert variants.spelling_variants(empty).collect() == []


def test_groups_are_bounded_by_the_alphabet(spark):
    """However many words there are, a group holds one word for each letter and one that lacks it."""
    letters = [chr(c) for c in range(97, 123)]
    words = [(f"word{a}ing", 5) for a in letters] + [("wording", 5)] + [(f"word{a}{b}ing", 5) for a in letters for b in letters]
    df = spark.createDataFrame(words, "word string, n long")
    sizes = variants.rotations(df).groupBy("key").count().agg({"count": "max"}).first()[0]
    assert sizes <= 27
    near = {r.word: r.n_near for r in variants.neighbours(df).collect()}
    plain = [w for w, _ in words]
    for w in ("wording", "worddding", "wordaing", "wordzzing"):
        assert near.get(w, 0) == sum(one_edit(w, x) for x in plain)
