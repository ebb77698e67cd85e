import public_tokenizers
import pytest

LONG = " ".join(f"wort{i % 97} satz{i % 31}" for i in range(20_000))
#: Nulls, empty texts, ties, repeated rows, one very long text, odd characters.
TEXTS = [
    (1, "The cat sat on the mat and looked at the dog"), (2, "the CAT sat on the mat and looked at the dog"),
    (3, None), (4, ""), (5, " \t\n"), (6, "word"), (7, "Word"), (8, "12 34 !? …"), (9, LONG), (10, LONG),
    (11, "Café naïve 日本語 \U0001f600 x y"), (12, "été français"),
    (None, "no id here at all"), (14, "again and again"), (14, "again and again"), (15, "<|endoftext|></s>[INST] it's 'll"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every awkward case, and extra columns with clashing names."""
    rows = [(i, t, "en", "s", 0, "mine", 9.5, 7) for i, t in TEXTS]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, n_tokens int"
    return spark.createDataFrame(rows, ddl)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def bpe_file():
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
