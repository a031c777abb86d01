import pytest
from pyspark.sql import functions as F

from textloom.operators.lines import assemble_lines
from textloom.operators.sessions import chain_summary, previous_results, refinement_chains

def stored():
    """Task, result and error of a turn."""
    return F.col("task"), F.col("result"), F.col("is_error")


# session, turn, task, result, is_error, processed, goes_on
LOG = [
    ("a", 1, "x", "r1", False, True, True),
    ("a", 2, "x", "r2", False, True, True),
    ("a", 3, "y", "r3", False, True, False),
    ("a", 4, "y", None, True, True, True),
    ("a", 5, "y", "r5", False, True, True),
    ("a", 6, "y", None, False, False, True),
    ("a", 7, "y", "r7", False, True, True),
    ("b", 1, "y", "", False, True, True),
    ("b", 2, "y", "r2", False, True, True),
]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(
        LOG,
        "session string, turn int, task string, result string, is_error boolean, "
        "processed boolean, goes_on boolean",
    ).repartition(5)


@pytest.mark.parametrize("chunk_rows", [1, 2, 1000])
def test_previous_results(log, chunk_rows):
    columns = (log, ["session"], ["turn"], *stored(), F.col("processed"))
    got = previous_results(*columns, F.col("goes_on"), chunk_rows)
    rows = got.orderBy("session", "turn").collect()
    assert [r.previous_result for r in rows] == [
        None, "r1", "r2", None, None, "r5", "r5", None, ""
    ]
    assert [r.can_use_previous for r in rows] == [
        False, True, False, False, False, True, True, False, True
    ]
    assert [r.after_error for r in rows] == [False] * 4 + [True] + [False] * 4
    rows = previous_results(*columns, chunk_rows=chunk_rows).orderBy("session", "turn").collect()
    assert [r.previous_result for r in rows] == [
        None, "r1", "r2", "r3", None, "r5", "r5", None, ""
    ]
    assert [r.can_use_previous for r in rows] == [
        False, True, False, True, False, True, True, False, True
    ]
    assert [r.offer_previous for r in rows] == [
        False, True, False, True, False, True, True, False, False
    ]
    assert [r.after_error for r in rows] == [False] * 4 + [True] + [False] * 4
    assert [r.can_continue for r in rows][3:6] == [False, True, False]


@pytest.mark.parametrize("chunk_rows", [1, 2, 1000])
def test_chains(log, chunk_rows):
    turns = log.where("processed")
    got = refinement_chains(
        turns, ["session"], ["turn"], *stored(), F.col("goes_on"), chunk_rows
    )
    rows = got.orderBy("session", "turn").collect()
    assert [r.chain_no for r in rows] == [1, 1, 2, 3, 4, 4, 1, 1]
    summary = chain_summary(got, ["session"], F.col("turn"), F.coalesce(F.col("result"), F.lit("-")))
    first = summary.where("session = 'a' and chain_no = 4").first()
    assert (first.n_turns, first.first_text, first.last_text) == (2, "r5", "r7")


def test_lines_of_a_null_session_and_long_lines(spark):
    rows = [(None, 0, " a"), (None, 1, "b"), (None, 2, "done!!!"), (None, 3, "c"), ("s", 0, "x" * 50), ("s", 1, "y")]
    table = spark.createDataFrame(rows, "session string, n int, line string").repartition(3)
    got = {tuple(r) for r in assemble_lines(table, ["session"], ["n"], page_bytes=40).collect()}
    assert got == {(None, 0, 2, "a\nb"), ("s", 0, 1, "x" * 50), ("s", 1, 1, "y")}


TYPED = {
    "padded": ["a", " b ", "  DONE!!! ", "after", "done!!!"],
    "open": ["", "  x ", "", "y  ", " "],
    "first": ["done!!!", "x"],
    "blank": [" ", "", "done!!!"],
    "long": ["", ""] + [f" l{i} " if i % 3 else "" for i in range(50)] + ["", "Done!!!"],
}


def typed(lines):
    """What a reader that stops at the terminator hands over."""
    kept = []
    for line in lines:
        if line.strip().lower() == "done!!!":
            break
        kept.append(line)
    return "\n".join(kept).strip()


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(s, n, line) for s, all_ in TYPED.items() for n, line in enumerate(all_)]
    return spark.createDataFrame(rows, "session string, n int, line string").repartition(4)


@pytest.mark.parametrize("page_lines,chunk_rows", [(100, 1000), (7, 1000), (7, 5), (1, 3)])
def test_lines(lines, page_lines, chunk_rows):
    got = assemble_lines(
        lines, ["session"], ["n"], page_lines=page_lines, chunk_rows=chunk_rows
    )
    assert got.agg(F.max("n_lines")).first()[0] <= page_lines
    texts = {}
    for r in got.orderBy("session", "page").collect():
        texts[r.session] = texts[r.session] + "\n" + r.text if r.session in texts else r.text
    assert texts == {s: typed(all_) for s, all_ in TYPED.items() if typed(all_)}
