"""Rows without ids, and ids with several texts, in the stages that keep rows of documents."""

from textloom.llm import mixing, simhash

TEXTS = [" ".join(f"{c}{k}" for k in range(60)) for c in "abcdefgh"]


def test_one_of_each_keeps_a_row_for_each_component_without_an_id(spark):
    rows = [(1, TEXTS[0]), (None, TEXTS[0])] + [(None, t) for t in TEXTS[1:] for _ in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = simhash.one_of_each(docs)
    assert found.columns == docs.columns
    assert sorted((r.text, r.doc_id) for r in found.collect()) == [(t, 1 if t == TEXTS[0] else None) for t in TEXTS]


def test_one_of_each_keeps_an_id_for_each_of_its_texts(spark):
    rows = [(1, TEXTS[0]), (1, TEXTS[1]), (2, TEXTS[0]), (3, TEXTS[1]), (4, TEXTS[2]), (4, TEXTS[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [tuple(r) for r in simhash.one_of_each(docs).collect()]
    assert sorted(found) == [(1, TEXTS[0]), (1, TEXTS[1]), (4, TEXTS[2])]


def test_mixed_documents_count_rows_and_not_ids(spark):
    """Rows of one id, or of none, come as often as the mix reads each of them."""
    rows = [(k, "a", f"t{k} " * (5 + k % 7), k) for k in range(40)]
    rows += [(i, "b", f"{n}x{k} " * (1 + 12 * k), k) for k in range(8) for i, n in ((None, "n"), (7, "s"))]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, row int")
    options = {"share": 0.5}
    sizes, _, found = mixing.mix(docs.withColumn("key", docs["text"]), block_words=4, row_col="key", **options)
    read = {}
    for r in found.collect():
        read[r.row] = read.get(r.row, 0) + r.to_word - r.from_word
    want = {r.row: int(read[r.row] / r["size"] + 0.5) for r in sizes.collect() if r.row in read}
    want = {t: n for t, n in want.items() if n}
    times = {}
    for r in mixing.mixed_documents(docs, block_words=4, **options).collect():
        times[r.text] = times.get(r.text, 0) + 1
    assert len({n for t, n in want.items() if "x" in t} | {0}) > 1 and times == want
