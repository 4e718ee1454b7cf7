"""Encoding against the tokenizers library itself."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidewheel.llm.bpe import Codec
from tidewheel.llm.queries import vocabulary


@pytest.fixture(scope="module")
def both():
    return Codec(vocabulary()), Tokenizer.from_file(vocabulary())


ALPHABETS = {
    "words": ["the ", "lorem", " ipsum", "123", "!?", "\n", "  ", "it's ", "\t\t", "ß", "é ", "日本", "<|endoftext|>", "<|end", "　", "\xa0"],
    "one run": list("abcdefghijklmnop"),
    "spaces": [" ", "\n", "\t", " ", "x"],
    "marks": list("!#.,-=") + [" "],
    "wide": list("日本語文字列漢字"),
    "emoji": ["😀", "👨‍👩‍👧", "é", " "],
}


@pytest.mark.parametrize("kind", ALPHABETS)
def test_tree_concatenation_equals_the_library(both, kind):
    codec, library = both
    rng = random.Random(kind)
    for _ in range(25):
        text = "".join(rng.choices(ALPHABETS[kind], k=rng.randint(1, 1500)))
        size = rng.choice([7, 40, 160, 700])
        parts = [codec.encode(text[i : i + size]) for i in range(0, len(text), size)]
        want = library.encode(text, add_special_tokens=False).ids
        assert codec.tree(parts).tolist() == want
        assert codec.encode(text).tolist() == want
        assert codec.decode(np.array(want)) == library.decode(want, skip_special_tokens=False) == text


def test_empty(both):
    codec, _ = both
    assert codec.encode("").tolist() == [] and codec.decode([]) == "" and codec.tree([]).tolist() == []


LONG = {
    "english": lambda r: " ".join("".join(r.choices("etaoinshr", k=r.randint(1, 9))) for _ in range(12_000)),
    "cyrillic": lambda r: " ".join("".join(r.choices("абвгдежзиклмнопрст", k=r.randint(1, 9))) for _ in range(12_000)),
    "wide with marks": lambda r: "".join(r.choice("日本語文字列漢字仮名交") + (r.choice("、。") if r.random() < 0.1 else "") for _ in range(65_536)),
    "wide": lambda r: "".join(r.choices("日本語文字列漢字仮名交", k=65_536)),
    "numbers": lambda r: ",".join(str(r.randint(0, 10**6)) for _ in range(10_000)),
    "digits": lambda r: "".join(r.choices("0123456789", k=65_536)),
    "arabic": lambda r: " ".join("".join(r.choices("ابتثجحخدذرزسشصضطظ", k=r.randint(1, 9))) for _ in range(12_000)),
    "lines": lambda r: "\n".join("".join(r.choices("abc", k=r.randint(0, 5))) for _ in range(16_000)),
    "spaces": lambda r: " " * 65_536,
    "emoji": lambda r: "".join(r.choices("😀😁😂🤣", k=65_536)),
    "one letter": lambda r: "x" * 65_536,
    "apostrophes": lambda r: "".join(r.choice(["it's", "'ll", "'", "we've ", "''", "'t"]) for _ in range(16_000)),
}


@pytest.mark.parametrize("kind", LONG)
def test_a_join_of_long_halves_encodes_little_again(both, kind):
    codec, library = both
    rng = random.Random(kind)
    text = LONG[kind](rng)[:65_536]
    cut = len(text) // 2 + rng.randint(-50, 50)
    joined = codec.join(codec.encode(text[:cut]), codec.encode(text[cut:]))
    assert joined.tolist() == library.encode(text, add_special_tokens=False).ids
    # a run of one letter is cut elsewhere in the whole than in the halves: there all of it changes
    assert codec.encoded < (4096 if kind != "one letter" else 2 * len(text))


def test_classes_agree_with_the_pattern():
    import regex

    from tidewheel.llm.bpe import kind_of

    tests = {1: regex.compile(r"\p{L}"), 2: regex.compile(r"\p{N}"), 3: regex.compile(r"[^\s\p{L}\p{N}]"), 4: regex.compile(r"\s")}
    chars = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    assert all(tests[k].fullmatch(c) for c in chars if (k := kind_of(c)))
