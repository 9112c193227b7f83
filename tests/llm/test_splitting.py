import random
import unicodedata

import pytest

from hypothesis import given, settings
from hypothesis import strategies as st

from quaystone.llm.splitting import WINDOW, cut_points, rolling_hashes, split_oversized, split_text


def _rebuilt(text, pieces):
    return "".join(text[a + lead : b] for a, b, lead in pieces)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n\r!é☃😀́", max_size=400), st.integers(1, 60), st.integers(0, 30), st.integers(0, 40))
def test_round_trip_limits_and_overlap(text, most, least, overlap):
    if overlap >= most:
        with pytest.raises(ValueError):
            split_text(text, most, least, overlap)
        return
    pieces = split_text(text, most, least, overlap)
    assert _rebuilt(text, pieces) == text
    assert all(b - a <= most for a, b, _ in pieces)
    for (_, before, _), (a, _, lead) in zip(pieces, pieces[1:]):
        assert a + lead == before and lead <= min(overlap, before)
        # Shorter only to begin with a whole word or a whole character.
        assert lead == min(overlap, before) or lead == 0 or text[a - 1].isspace() or text[a - 1 : a + 1] != "\r\n"


def _prose(n, seed):
    rng = random.Random(seed)
    return "\n\n".join(" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(6, 14))) + "." for _ in range(n))


def test_hash_depends_on_the_window_only():
    text = _prose(5, 3)
    whole = rolling_hashes(text)
    for first in (0, 7, 100):
        part = rolling_hashes(text[first:])
        assert (part[WINDOW - 1 :] == whole[first + WINDOW - 1 :]).all()


def test_very_long_text():
    pieces = split_text("x" * 1_000_000, 3000, 120, 0)
    assert pieces[-1][1] == 1_000_000 and all(b - a <= 3000 for a, b, _ in pieces)


def test_cuts_stand_at_natural_ends():
    text = _prose(80, 1)
    cuts = cut_points(text, 700, 120)[:-1]
    assert cuts and all(text[:c].endswith("\n\n") for c in cuts)
    sentences = text.replace("\n\n", " ")
    assert all(sentences[:c].endswith(". ") for c in cut_points(sentences, 700, 120)[:-1])


def test_overlap_begins_with_a_whole_character_and_word():
    marked = "e\u0301" * 3000
    pieces = split_text(marked, 200, 20, 51)
    assert len(pieces) > 30 and not any(unicodedata.combining(marked[a]) for a, _, _ in pieces)
    lines = "word word word\r\n" * 500
    pieces = split_text(lines, 200, 20, 50)
    assert all(lines[a - 1 : a + 1] != "\r\n" and (a == 0 or lines[a - 1].isspace()) for a, _, _ in pieces)
    assert all(25 <= lead <= 50 for _, _, lead in pieces[1:])


def test_an_overlap_over_half_is_honoured():
    text = "x" * 1000
    pieces = split_text(text, 100, 10, 80)
    assert all(lead == min(80, a + lead) for a, _, lead in pieces) and all(b - a <= 100 for a, b, _ in pieces)
    assert _rebuilt(text, pieces) == text


def test_edit_alters_only_neighbours():
    text = _prose(400, 2)
    at = len(text) // 2
    edited = text[:at] + " inserted words here " + text[at:]
    a = {text[x:y] for x, y, _ in split_text(text, 800, 120)}
    b = {edited[x:y] for x, y, _ in split_text(edited, 800, 120)}
    assert len(a - b) <= 6 and len(a) > 30


def test_operator_cases(spark):
    schema = "doc_id string, chunk_index int, heading string, content string, profile string, piece_no string"
    long = "word. " * 400
    rows = [("a", 0, "H", long, "p", "x"), ("b", 0, None, None, "p", "x"), ("c", 0, "", "", "p", "x"), ("d", 0, "H", long, None, "x"), ("e", 0, "H", long, "unknown", "x"), ("f", 0, "H", "é" * 100, "p", "x"), ("a", 0, "H", long, "p", "x")]
    config = spark.createDataFrame([("p", 100, 20, 10), ("p", 300, 20, 10)], "profile string, max_chars int, min_chars int, overlap_chars int")
    out = split_oversized(spark.createDataFrame(rows, schema), config, ["doc_id", "chunk_index"])
    got = out.collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert all(len(r.content) <= 100 and r.heading == "H" and r.was_split for r in by["a"]) and len(by["a"]) % 2 == 0
    one = sorted({(r.piece_no, r.overlap, r.content) for r in by["a"]})
    assert "".join(c[o:] for _, o, c in one) == long
    for k, content in (("b", None), ("c", ""), ("d", long), ("e", long), ("f", "é" * 100)):
        assert [(r.content, r.was_split) for r in by[k]] == [(content, False)]
    assert split_oversized(spark.createDataFrame([], schema), config, ["doc_id", "chunk_index"]).count() == 0
