import base64
import random

import public_tokenizers
import pytest
import tiktoken

from factlake.llm.bpe import EncodedText, TextEncoder, common_pattern, encode_documents, read_ranks

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return TextEncoder(read_ranks(None, PATH), public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encodes_as_the_library_and_round_trips(both):
    mine, theirs = both
    rnd = random.Random(1)
    alphabet = "ab cdethe'\n\t  é日1２²½ 2.,s're \x1c🙂ßÇ"
    texts = ["", " ", "a" * 5000, "-" * 300, "<|endoftext|>", *("".join(rnd.choice(alphabet) for _ in range(rnd.randrange(80))) for _ in range(600))]
    for text, ids in zip(texts, mine.encode_batch(texts), strict=True):
        assert ids == theirs.encode_ordinary(text)
        assert mine.decode(ids) == text.encode()


def test_appends_and_edits_stay_exact_and_recode_little(both):
    mine, theirs = both
    rnd = random.Random(2)
    alphabet = "ab  the's\n1é"
    for _ in range(120):
        text = EncodedText(mine, "".join(rnd.choice(alphabet) for _ in range(60)))
        for _ in range(4):
            a = rnd.randrange(len(text.text) + 1)
            text.replace(a, min(len(text.text), a + rnd.randrange(5)), "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(6))))
            text.append(rnd.choice(["", " x", "s", "\n"]))
            assert text.ids == theirs.encode_ordinary(text.text)
    long = EncodedText(mine, "some words " * 500)
    before = long.recoded
    long.append(" more")
    assert long.recoded - before < 8


def test_patterns_with_other_classes_use_the_full_engine():
    assert common_pattern(r"\p{Lu}+") is None


def test_documents(spark):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, None, "x"), (None, "", "x"), (1, "Hello world", "x"), (3, "y" * 200_000, "x")], "doc_id long, text string, n_tokens string")
    out = encode_documents(df, PATH, public_tokenizers.PATTERN, columns=("n_tokens", "ids", "decoded")).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"] if len(r["decoded"]) < 100 else -1) for r in out) == [(0, 0), (1, 2), (1, 2), (2, 0), (3, -1)]
    assert encode_documents(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
