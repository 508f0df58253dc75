"""Substring dedup sees that the second scan reads other texts than the first."""

from ledgerloom.llm import substrings


def test_marks_see_ids_and_texts():
    marks = {substrings._mark(*x) for x in (([1], ["a b c"]), ([1], ["x y z"]), ([2], ["a b c"]), ([1], [None]), ([1], [""]), ([1, 2], ["a", "b c"]), ([1, 2], ["a ", "bc"]), ([], []))}
    assert len(marks) == 8
    assert substrings._mark([1, None], ["\ud800", None]) == substrings._mark([1, None], ["\ud800", None])
