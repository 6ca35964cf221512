import datetime as dt
import random

import pytest

from theoremill.llm.pieces import chunk_pieces, cut_ends, split_text

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "id long, text string, code_blocks array<string>, section_path array<string>, built_at timestamp, item string, chunk_id int"


@pytest.mark.parametrize("n", [0, 1, 400, 401, 760, 761, 5000, 123_457])
@pytest.mark.parametrize("boundaries", ["none", "all", "some"])
def test_cuts(n, boundaries):
    r = random.Random(n)
    strong = {i for i in range(n) if r.random() < 0.02}
    ends = cut_ends(n, {"none": lambda i: 0, "all": lambda i: 6, "some": lambda i: 4 * (i in strong)}[boundaries], 400, 40)
    starts = [0, *(e - 40 for e in ends[:-1])]
    assert ends[-1] == n and all(e - s <= 400 for s, e in zip(starts, ends)) and all(a < b for a, b in zip(ends, ends[1:]))
    if boundaries == "none" and n > 400:
        assert len(ends) == -(-(n - 40) // 360)


def test_odd_limits():
    assert cut_ends(10, lambda i: 0, 3, 2)[-1] == 10
    with pytest.raises(ValueError):
        cut_ends(10, lambda i: 0, 3, 3)


def test_text_is_kept_and_cut_at_paragraphs():
    paragraphs = [" ".join(f"w{i}.{k}" for k in range(70)) for i in range(20)]
    text = "\n\n".join(paragraphs)
    found = split_text(text)
    words = text.split()
    for s, e, a, z in found:
        assert text[a:z].split() == words[s:e]
    assert all(b[0] == a[1] - 40 for a, b in zip(found, found[1:]))
    assert all(e % 70 == 0 for _, e, _, _ in found)


def test_rows(spark):
    long = " ".join(["a"] * 401)
    rows = [
        (1, long, [None, long, ""], ["x", "y"], DAY, "", 0),
        (1, "older", None, None, DAY - dt.timedelta(1), "", 0),
        (2, " ".join(["b"] * 400), None, None, DAY, "", 0),
        (3, None, [None], None, DAY, "", 0),
        (4, "word" * 5000, None, None, DAY, "", 0),
        (None, long, None, None, DAY, "", 0),
    ]
    found = chunk_pieces(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.chunk_id, r.item_no) for r in found} == {(1, 0), (1, 2)} and all(r.section_path == ["x", "y"] for r in found)
    assert chunk_pieces(spark.createDataFrame([], SCHEMA)).count() == 0
