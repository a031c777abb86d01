"""Context words and account numbers among others of their kind."""

import re

from textloom.llm import personal_data


def spans_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.spans for r in personal_data.digests(docs).collect()}
    return [
        [t[int(a) : int(b)] for _, a, b in (s.split(":") for s in found[k].split(",") if s)]
        for k, t in enumerate(texts)
    ]


def plain_context(text, pattern, words):
    """Matches with a word in the 40 characters on both sides, whatever stands there."""
    return [
        m[0]
        for m in re.finditer(pattern, text)
        if re.search(words, text[max(0, m.start() - 40) : m.end() + 40].lower())
    ]


def test_several_numbers_after_one_word(spark):
    phone = r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])"
    numbers = [f"212-555-{k:04d}" for k in range(187, 199)]
    texts = [
        f"Phone: {numbers[0]}, {numbers[1]}",
        f"{numbers[0]}, {numbers[1]} or {numbers[2]} (call)",
        f"fax {', '.join(numbers)}",
        f"{', '.join(numbers)} tel",
        f"call {' '.join(numbers[:3])} {'x' * 50} {' '.join(numbers[3:6])} {'y' * 36} é phone {numbers[7]}",
    ]
    want = [plain_context(t, phone, r"phone|call|tel|mobile|fax|telefon|téléphone|teléfono") for t in texts]
    assert [len(w) for w in want[:2]] == [2, 3] and 2 < len(want[2]) < 12
    assert spans_of(spark, texts) == want
    assert spans_of(spark, ["SSN 078-05-1120 / 219-09-9999"]) == [["078-05-1120", "219-09-9999"]]


def test_account_numbers_before_other_words_and_numbers(spark):
    de, gb = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    flat = de.replace(" ", "")
    after = {
        f"IBAN {de} Please pay": [de],
        f"IBAN {flat} BIC COBADEFFXXX": [flat],
        f"IBAN {de} 2 weeks": [de],
        f"{de} {gb} {flat} {de}": [de, gb, flat, de],
        f"AB12 {flat} AND MORE OF THAT": [flat],
        f"IBAN {flat}X and {flat}x or x{flat}": [],
        f"{de[:-1]}1 Please": [],
        f"é {gb}, {flat}.": [gb, flat],
        "MT84 MALT 0110 0001 2345 MTLC AST0 01S Then": ["MT84 MALT 0110 0001 2345 MTLC AST0 01S"],
        f"{flat} " * 300: [flat] * 300,
    }
    assert spans_of(spark, list(after)) == list(after.values())
