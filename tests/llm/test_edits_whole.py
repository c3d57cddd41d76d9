"""Redaction of numbers in digits of any script."""

import pytest

from kwhrecon.llm import edits


@pytest.mark.parametrize("zero", [0x0030, 0x0660, 0x0966])
@pytest.mark.parametrize("number,kind", [("1234567890123456", "<number>"), ("10.20.30.40", "<ip>"), ("+12 (345) 678-9012", "<phone>")])
def test_numbers_in_any_digits_are_redacted(zero, number, kind):
    written = "".join(chr(zero + int(c)) if c.isdigit() else c for c in number)
    text = f"call {written} now"
    assert edits.redactions(text) == [{"start": 5, "length": len(written), "insert": kind}]


def test_texts_without_signs_have_no_edits():
    assert not any(edits.redactions(t) for t in ("", "plain words", "слова без чисел", "½ Ⅻ ²"))
