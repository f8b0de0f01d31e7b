import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from latticework.llm import pieces


def check(text, limit, overlap):
    out = pieces.split_text(text, limit, overlap)
    assert out[0][0] == 0 and out[-1][1] == len(text)
    for (a, z, _), (b, y, _) in zip(out, out[1:], strict=False):
        assert b == z - overlap and y > z
    assert all(z - a <= limit for a, z, _ in out)
    return out


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n。", min_size=0, max_size=700), st.integers(20, 90), st.integers(0, 10))
def test_pieces_cover_the_text_within_the_limit(text, limit, overlap):
    check(text, limit, overlap)


def test_least_number_of_pieces_and_natural_cuts():
    text = " ".join(["word"] * 600)
    out = check(text, 1200, 120)
    assert len(out) == 3 and all(x[2] for x in out)
    assert max(z - a for a, z, _ in out) - min(z - a for a, z, _ in out) < 20


def test_strongest_boundary_wins():
    text = "a" * 500 + ". " + "b" * 80 + "\n\n" + "c" * 40 + " " + "d" * 560
    assert check(text, 1000, 10)[0][1] == 584


def test_solid_run_is_forced():
    assert pieces.has_solid_run("x" * 1201, 1200) and not pieces.has_solid_run("x" * 1200, 1200)
    assert not pieces.has_solid_run("x" * 700 + "。" + "x" * 700, 1200)
    out = check("x" * 5000, 1200, 120)
    assert not all(n for *_, n in out)


def test_bad_overlap():
    with pytest.raises(ValueError):
        pieces.split_text("x" * 50, 10, 10)


def test_items_nulls_blanks_and_repeated_pages(spark):
    rng = random.Random(1)
    long = " ".join("".join(rng.choice("abc") for _ in range(6)) for _ in range(400))
    rows = [("p1", [None, "", " ", long, "short"], 1), ("p1", [None, "", " ", long, "short"], 1), ("p2", None, 2), ("p3", [], 3), (None, [long], 4), ("p4", ["y" * 3000], 5)]
    df = spark.createDataFrame(rows, "ori_id string, context array<string>, piece int")
    got = pieces.split_items(pieces.once_per_page(df)).collect()
    assert {(r.ori_id, r.item_no, r.cut) for r in got} == {("p1", 3, "natural"), (None, 0, "natural"), ("p4", 0, "forced")}
    back = sorted((r for r in got if r.ori_id == "p1"), key=lambda r: r.piece_no)
    assert back[0].piece + "".join(r.piece[120:] for r in back[1:]) == long
    assert pieces.oversized_items(pieces.split_items(df)).count() == 3
    assert pieces.split_items(df.limit(0)).count() == 0
    assert pieces.split_items(df, keep_short=True).where("item_no = 4").count() == 2


def test_boundaries_agree_with_patterns():
    import re

    rng = random.Random(5)
    base = re.compile(r"\s+|[.!?。！？]")
    for _ in range(300):
        text = "".join(rng.choices(["a", "b", " ", "\n", "\r\n", ".", "!", "。", "”", ")", "\t", "　", "𝒳"], k=rng.randint(1, 60)))
        positions, strengths, longest = pieces.boundaries(text)
        got = dict(zip(positions.tolist(), strengths.tolist(), strict=True))
        ends = {m.end() for m in base.finditer(text)} | {m.end() for m in re.finditer(r"[。！？]+[”’」』）]*\s*", text)}
        assert set(got) == ends - {0, len(text)}
        for kind, pattern in ((pieces.PARAGRAPH, r"\n[^\S\n]*\n\s*"), (pieces.LINE, r"[\r\n]\s*"), (pieces.SENTENCE, r"[.!?]+[\"')\]»”’]*\s+|[。！？]+[”’」』）]*\s*")):
            assert all(got[m.end()] <= kind for m in re.finditer(pattern, text) if m.end() in got), (text, kind)
        assert longest == max(len(r) for r in re.split(r"[\s.!?。！？]", text))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aaab .\n", min_size=0, max_size=900), st.integers(20, 60), st.integers(0, 10))
def test_only_runs_that_no_piece_holds_are_cut_inside(text, limit, overlap):
    import re

    out = check(text, limit, overlap)
    if len(text) > limit:
        ends = [overlap, *sorted({m.end() for m in re.finditer(r"\s+|[.!?]", text)} - {len(text)} - set(range(overlap + 1))), len(text)]
        need = sum(-(-(b - a) // (limit - overlap)) - 1 for a, b in zip(ends, ends[1:], strict=False))
        assert sum(not x[2] for x in out) <= need


def test_a_long_item_with_a_solid_run_takes_linear_time():
    import time

    rng = random.Random(2)
    text = " ".join("word" * rng.randint(1, 3) for _ in range(1_300_000))
    text = text[:5_000_000] + "x" * 1300 + " " + text[5_000_000:]
    began = time.process_time()
    out = check(text, 1200, 120)
    assert len(text) > 10_000_000 and sum(not x[2] for x in out) == 1
    assert time.process_time() - began < 6  # half a second or so; the machine may be slow
