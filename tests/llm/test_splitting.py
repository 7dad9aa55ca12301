import re

import pytest
from hypothesis import given, settings, strategies as st

from foliant.llm.splitting import boundary_of, split_sections, split_text

TEXT = st.text(alphabet=st.sampled_from("ab .。!\n\r　#-|𠮷あ̀"), max_size=200)


@given(TEXT, st.integers(1, 40), st.integers(0, 30))
@settings(max_examples=400, deadline=None)
def test_round_trip_limit_and_overlap(text, target, overlap):
    got = split_text(text, target, overlap)
    assert "".join(text[b:e] for _, b, e, _ in got) == text
    assert all(e - a <= target for a, _, e, _ in got)
    lap = overlap if overlap < target else target // 2
    assert all(b - a == min(lap, b) for a, b, _, _ in got[1:])
    assert (len(got) == 1) == (len(text) <= target) or len(text) <= target
    assert all(b == p[2] for p, (_, b, _, _) in zip(got, got[1:]))


@pytest.mark.parametrize(
    ("text", "target", "want"),
    [
        ("aaaa\n\nbbbb", 5, "paragraph"),
        ("aaaa\n 　\r\nbbbb", 5, "paragraph"),
        ("aaaa\nbbbb", 5, "line"),
        ("aaaa。bbbb", 5, "sentence"),
        ("aa. bbbb", 5, "sentence"),
        ("aa.bbbbb", 5, "none"),
        ("aaaaaaa", 5, "none"),
        ("aaaa", 5, None),
        ("𠮷" * 5, 5, None),
        ("aa   \n　\n  ", 5, "paragraph"),
    ],
)
def test_boundary(text, target, want):
    assert boundary_of(text, target) == want


def test_headings_hold_together():
    text = "# A\n" + "a" * 30 + "\n## A1\n" + "b" * 20 + "\n## A2\n" + "c" * 20 + "\n# B\n" + "d" * 30
    got = [text[b:e] for _, b, e, _ in split_text(text, 65, 0)]
    assert [g.split("\n")[0] for g in got] == ["# A", "## A2"] and "# B" in got[1]
    assert [g.split("\n")[0] for g in (text[b:e] for _, b, e, _ in split_text(text, 35, 0))] == ["# A", "## A1", "## A2", "# B"]


def plain_boundary(text, target):
    """The definition, without a tree."""
    if len(text) <= target:
        return None
    fits = lambda parts: all(len(x.strip()) <= target for x in parts)
    lines = text.split("\n")
    blocks, held = [], []
    for x in lines:
        if x.strip():
            held.append(x)
        else:
            blocks.append("\n".join(held))
            held = []
    if fits([*blocks, "\n".join(held)]):
        return "paragraph"
    if fits(lines):
        return "line"
    return "sentence" if fits(re.split(r"(?<=[。！？!?])|(?<=\.)(?=\s)|\n", text)) else "none"


@given(TEXT, st.integers(1, 40))
@settings(max_examples=600, deadline=None)
def test_boundary_equals_the_definition(text, target):
    assert boundary_of(text, target) == plain_boundary(text, target)


def test_lists_and_tables_are_nodes():
    text = "- one\n  more\n  - sub a\n  - sub b\n- two\n  - sub c\n- three"
    assert [text[b:e] for _, b, e, _ in split_text(text, 34, 0)] == ["- one\n  more\n  - sub a\n  - sub b\n", "- two\n  - sub c\n- three"]
    assert [text[b:e] for _, b, e, _ in split_text(text, 22, 0)] == ["- one\n  more\n", "  - sub a\n  - sub b\n", "- two\n  - sub c\n", "- three"]
    table = "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\n| 5 | 6 |"
    assert [table[b:e] for _, b, e, _ in split_text(table, 30, 0)] == ["| a | b |\n|---|---|\n| 1 | 2 |\n", "| 3 | 4 |\n| 5 | 6 |"]


def test_overlap_is_as_asked_where_it_leaves_room():
    assert {b - a for a, b, _, _ in split_text("x" * 5_000, 700, 400)[1:]} == {400} and split_text("x" * 5_000, 700, 400)[0][2] == 600
    assert {b - a for a, b, _, _ in split_text("x" * 5_000, 700, 700)[1:]} == {350}


def test_in_spark(spark):
    rows = [(1, "v", "d", "H > I", "x" * 900, None, None, 1), (2, "v", "d", None, None, 10, 1, 1), (3, "v", "d", "h", "", 10, 1, 1), (4, "v", "d", "h", "ab\n\ncd", 3, 0, 1), (5, "v", "d", "h", "abcd", 0, -1, 1)]
    df = spark.createDataFrame(rows, "section_id long, version_id string, document_id string, heading_path string, text string, target_size int, overlap int, piece_no int")
    got = split_sections(df).collect()
    one = [r for r in got if r["section_id"] == 1]
    assert len(one) == 2 and all(len(r["text"]) <= 700 and r["heading_path"] == "H > I" and r["boundary"] == "none" for r in one) and one[1]["body"] - one[1]["start"] == 100
    assert [r["text"] for r in got if r["section_id"] == 4] == ["ab\n", "\ncd"] or [r["boundary"] for r in got if r["section_id"] == 4][0] == "paragraph"
    assert {r["section_id"] for r in got} == {1, 3, 4, 5}
    assert split_sections(df.where("false")).count() == 0
