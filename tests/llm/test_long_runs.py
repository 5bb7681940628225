import time

import pytest

from stellate.llm import sentences

THAI = "วันนี้อากาศดีมาก"


def cut(text):
    return [text[a:b] for a, b in sentences.spans(text)]


@pytest.mark.parametrize("words", [5, 120, 2000])
def test_a_sentence_of_any_length_after_thai(words):
    latin = "The " + "word " * words + "ends here."
    assert cut(f"{THAI} {latin}") == [THAI, latin]


def test_a_decimal_where_a_window_would_end():
    head = "The value " + "x" * 380 + " is "
    for shift in range(12):
        text = f"{THAI} {head}{'y' * shift}3.5 units"
        assert len(cut(text)) == 1


def test_a_verb_of_saying_after_long_words():
    said = f'"Is it ready?" {"A" + "b" * 70} asked.'
    assert cut(f"It was late. {said} Then it rained.") == ["It was late.", said, "Then it rained."]


def test_linear_in_length():
    def took(n):
        began = time.process_time()
        sentences.spans(f"{THAI} Word " * n + "end")
        sentences.spans('"Go!" ' + '"Is it?"xx' * n)
        return time.process_time() - began

    took(100)
    assert took(8000) < 16 * max(took(2000), 0.02)


@pytest.mark.parametrize("part, head", [("7. one item\n", ""), ("say this. ", '"'), ('"Go!" He ran. ', ""), ("(a) b. ", "("), ("he wrote text\n12. ", "")])
def test_lists_and_quotations_take_linear_time(part, head):
    def took(n):
        text = head + part * n + ('"' if head == '"' else ")" if head else "")
        began = time.process_time()
        sentences.spans(text)
        return time.process_time() - began

    took(100)
    assert took(40_000) < 6 * max(took(10_000), 0.03)


def test_a_span_is_weighed_as_a_whole():
    """Where a span begins decides whether the quotation that closes it ends it, and a piece without a word is no sentence."""
    assert cut('Look. "Is it?" asked Anna. Go.') == ["Look.", '"Is it?" asked Anna.', "Go."]
    assert cut('She said: "Is it?" Anna left.') == ['She said: "Is it?"', "Anna left."]
    assert cut("It took 5 min. 30 sec. Then it ended.") == ["It took 5 min. 30 sec.", "Then it ended."]
