"""The encoder by units against the tokenizers library."""

from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hitlake.llm import token_output

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
TEXTS = [
    "ab\n \ncd", "ab\n ", "ab\t  cd", "ab \ncd", "ab\r\n \r\ncd", " \n x", "ab\xa0 \xa0cd", "ab \n", " ", "\n \n", "ab \u3000 cd", "ab\n \t cd ef",
    "It's we'll 'tis don't. 'S", "Thon*** erth.### |x| (ab) ab) [c], d.e,f; g!? h?!", "Él èenier. ñas, ÿœ ªº ²³ a²", "x1 1x 12, 3.4.", "one", "", "a.", ".", " a", " .", "日本 語。 ab 語, c", "\U0001f600 x \U0001f600.",
]


@pytest.mark.parametrize("text", TEXTS)
def test_equals_library(text):
    tok, own = Tokenizer.from_file(PATH), token_output.encoder(PATH)
    for t in (text, "the " + text, text + " the", f"a {text} {text} b\n{text}"):
        want = tok.encode(t, add_special_tokens=False).ids
        for _ in range(2):  # new and met before
            assert list(array("I", own([t])[0])) == want


def test_words_are_cut_once(monkeypatch):
    """Words, words with signs and words over a line's end do without the pattern, and share their word."""
    monkeypatch.setattr(token_output, "_loaded", {})
    own = token_output.encoder(PATH)
    monkeypatch.setattr(token_output, "_CUT", None)
    want = Tokenizer.from_file(PATH).encode("a reeuxé reeuxé,", add_special_tokens=False).ids
    assert list(array("I", own(["a reeuxé reeuxé,"])[0])) == want
    assert own(["a reeuxé, tech***\nThe reeuxé"])[0]
    assert " reeuxé" not in token_output._loaded[PATH][3]
