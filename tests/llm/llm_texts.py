"""Awkward texts for the tests of this folder."""

import os
import random

SMALL = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


def odd_texts(seed: int, n: int) -> list:
    """Texts of awkward characters, words, repeats, empties and nulls."""
    rng = random.Random(seed)
    words = ["the", "Thé", "a", "x.y", "foo,", "it's", "İ", "ß", "é", "é", "́", "<|endoftext|>", "12", "..", "Σας", "\x1c",
             "日本", "😀", "don't", "'s", "\xa0", "#", "|", "%%", "foo"]
    blanks = [" ", " ", " ", " ", "\n", "  ", "\t", "\r\n", " \n", "\n\n", "\x0b", " ", "   ", ""]
    made: list = [None, "", " ", "\n", "  a", "a  "]
    while len(made) < n:
        made.append("".join(rng.choice(words) + rng.choice(blanks) for _ in range(rng.choice([1, 3, 10, 60]))))
    return made
