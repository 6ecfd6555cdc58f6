import random

import numpy as np
import pytest

from lexmill.llm.splitting import SparseTable, cut, split_oversized
from lexmill.llm.tokens import counter


def test_sparse_table_as_brute_force():
    rng = random.Random(1)
    values = np.array([rng.randrange(4) for _ in range(200)])
    table = SparseTable(values)
    for _ in range(2000):
        low, high = sorted((rng.randrange(200), rng.randrange(200)))
        part = values[low : high + 1]
        assert table.best(low, high) == low + max(i for i in range(len(part)) if part[i] == part.max())


def test_sparse_table_keeps_no_level_beyond_its_window():
    values = np.arange(100_000) % 5
    table = SparseTable(values, 64)
    assert len(table.levels) == 7 and table.best(10, 70) == 69


def test_every_piece_has_its_size(spark):
    df = spark.createDataFrame([(1, "corto"), (2, ""), (3, "uno dos tres. " * 2000)], "doc_id long, body string")
    for r in split_oversized(df, "doc_id", "body").collect():
        assert abs(r.n_tokens - counter().count(r.piece_text)) <= 1
    assert "piece_text" not in split_oversized(df, "doc_id", "body", with_text=False).columns


def check(text, limit, overlap):
    # parts of a word without end have more tokens one by one than together
    endless = max(map(len, text.split()), default=0) > 1000 or not text.strip()
    own = counter()
    pieces = cut(text, own, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for start, end, tokens, _ in pieces:
        assert own.count(text[start:end]) <= limit and tokens <= limit and (end > start or not text)
    for (s0, e0, *_), (s1, e1, *_) in zip(pieces, pieces[1:], strict=False):
        assert s0 < s1 <= e0 < e1
        shared = own.count(text[s1:e0])
        assert shared >= (overlap // 4 if endless else overlap) - 3 and shared <= overlap + max(limit // 16, 8) + 3, (shared, overlap)
    return pieces


def test_pieces_of_all_kinds_of_text():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(1, 12)))
    texts = [
        "", "corto", "\n\n".join(f"Artículo {i}.- " + " ".join(word() for _ in range(60)) + "." for i in range(40)), " ".join(word() for _ in range(3000)), "x" * 20_000, "ñ" * 9000,
        "\n" * 5000, "palabra " * 4000, "«" + "граница" * 2000 + "»", " ".join(word() + rng.choice(["", ".", "\n", "\n\n"]) for _ in range(3000)),
    ]
    for text in texts:
        for limit, overlap in ((256, 16), (2048, 128), (64, 0)):
            check(text, limit, overlap)


def test_strongest_boundary_wins():
    text = "\n\n".join(f"Artículo {i}.- " + "uno dos tres. " * 20 for i in range(30))
    pieces = check(text, 400, 16)
    assert {kind for *_, kind in pieces[:-1]} == {"article"}
    assert all(text[end:].lstrip("\n").startswith("Artículo") for _, end, *_ in pieces[:-1])
    with pytest.raises(ValueError):
        cut(text, counter(), 100, 90)


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "corto"), (4, "uno dos tres. " * 2000), (4, "uno dos tres. " * 2000), (5, "\U0001F600ñ" * 3000)]
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], "doc_id long, body string, piece string, n_pieces int")
    got = split_oversized(df, "doc_id", "body").collect()
    by = {i: sorted((r for r in got if r.doc_id == i), key=lambda r: (r.piece, r.start)) for i in range(1, 6)}
    assert not by[1] and [r.piece_text for r in by[2]] == [""] and [r.piece_text for r in by[3]] == ["corto"]
    assert len(by[4]) == 2 * by[4][0].n_pieces and by[4][0].n_pieces > 1
    text = rows[5][1]
    assert all(r.piece_text == text[r.start : r.end] for r in by[5]) and len(by[5]) > 1
    assert split_oversized(df.limit(0), "doc_id", "body").count() == 0
