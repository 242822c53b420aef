"""What the generators of personal data propose."""

import pytest

from wakeline.llm import pii


@pytest.mark.parametrize("form", ["jane.doe @ example.com", "jane.doe@ example.com", "jane.doe @example.com", "jane.doe at example.com", "jane.doe@example .com", "jane.doe at example dot com", "Jane AT Example DOT com"])
def test_every_spelled_form_is_proposed(form):
    text = f"write to {form}, thanks"
    at = text.index(form)
    assert (pii.EMAIL, at, at + len(form)) in pii.proposals(text, pii.base_spans(text))


def test_numbers_spaced_digit_by_digit_are_proposed():
    card = " ".join("4111111111111111")
    text = f"7 7 7 {card} 9 9"
    assert (pii.CARD, 6, 6 + len(card)) in pii.proposals(text, pii.base_spans(text))
    phone = "+" + " ".join("49301234567890")
    text = f"{phone} 5 5 5"
    assert (pii.PHONE, 0, len(phone)) in pii.proposals(text, pii.base_spans(text))
