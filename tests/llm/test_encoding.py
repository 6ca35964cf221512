import random

import pytest
import tiktoken

from theoremill.llm.encoding import PATTERN, VOCABULARY, Encoder, RankSet, encode, read_ranks


@pytest.fixture(scope="module")
def encoder():
    return Encoder(read_ranks())


@pytest.fixture(scope="module")
def other():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(VOCABULARY), special_tokens={})


def test_rank_set():
    r, ranks, known = random.Random(0), RankSet(50_256), set()
    for _ in range(3000):
        x = r.randrange(50_256)
        (known.discard if r.random() < 0.4 else known.add)(x)
        (ranks.add if x in known else ranks.remove)(x)
        assert ranks.first() == min(known, default=-1)


def test_against_another_encoder(encoder, other):
    r = random.Random(1)
    alphabet = "aeiou tnrs'.,\n\t  λé中👩‍💻\x00" + "".join(map(chr, range(33, 127)))
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 200))) for _ in range(400)]
    texts += ["a" * 3000, "ab" * 2500, "don't we'll <|endoftext|> x", " " * 500, "\r\n\r\n  x", "é" * 1000]
    for t in texts:
        assert encoder.encode(t) == other.encode_ordinary(t)


def test_very_long_word(encoder, other):
    r = random.Random(2)
    word = "".join(r.choice("abcdefghij") for _ in range(60_000))
    ids = encoder.encode(word)
    assert other.decode(ids) == word and encoder.encode(word[:5000]) == other.encode_ordinary(word[:5000])


def test_rows(spark):
    rows = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "hello world", 5), (None, "x", 5)], "doc_id long, text string, ids int")
    found = {r.doc_id: r.ids for r in encode(rows).collect()}
    assert found == {1: [], 2: [], 3: [31373, 995], None: [87]}
    assert encode(rows.limit(0)).count() == 0
