import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.llm import rules, words


def brute_base(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(found[i : i + 3]) for i in range(len(found) - 2))
    covered = {j for i in range(len(found) - 2) if windows[tuple(found[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(found)
    return n, sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def base(texts):
    data = [(t or "").encode() for t in texts]
    return rules.base_counts(data, *words.word_codes(data))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n\t\x0b\xa0#é|"), max_size=80), max_size=6))
def test_base(texts):
    assert base(texts) == [brute_base(t) for t in texts]


def test_base_of_long_texts(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "b", "cc", "é#", "\n"]) for _ in range(n)) for n in (0, 5000, 3, 900, 40, 2000)] + [None, "x" * 3000, " " * 700]
    whole = base(texts)
    assert whole == [brute_base(t) for t in texts]
    monkeypatch.setattr(words, "SLICE", 512)
    assert base(texts) == whole


def test_words_differ():
    """No two of many short words share a code."""
    kinds = [f"{a}{b}{c}{d}".encode() for a in "abcdefghij" for b in "klmnopqrst" for c in "0123456789" for d in ("", "x", "yz", "yy", "zy", "ü")]
    codes, counts = words.word_codes(kinds)
    assert (counts == 1).all() and len(np.unique(codes)) == len(kinds) and (codes & 1 == 1).all()
    assert (words.word_codes([b"| -- #"])[0] & 1 == 0).all()
