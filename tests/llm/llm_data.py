"""Texts that an operator may meet: null, empty, blank, very long, odd characters, repeats. Fixtures shared by the tests of this folder."""

import pytest

DOCS = [
    None,
    "",
    " \t\n\r\x0b\x0c ",
    "one",
    "UPPER lower ÉÈ ß İ Σς ﬁ",
    "no-break space   line  sep \u0085 nel 　 wide",
    "é ä H̱ 가 combining",
    "x" * 5000,
    "ab " * 4000,
    "emoji 😀😀 zero\x00byte tab\tend",
    "<|endoftext|> and <|startoftext|>a<|ENDOFTEXT|>",
]


@pytest.fixture
def table(spark):
    """Documents from texts, numbered from 0, or from (id, text) pairs; ``clash`` names extra columns."""

    def make(rows, clash=()):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        for name in clash:
            df = df.withColumn(name, df.text)
        return df

    return make


def found(df, key="doc_id"):
    """Rows as dictionaries, sorted by their key."""
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: (r[key] is not None, r[key] or 0, str(r)))
