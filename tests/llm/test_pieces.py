import sys

import public_tokenizers
import regex

from furrow.llm.pieces import Encoded
from furrow.llm.token_planes import disputed_letters, plain_words


def as_points(pieces):
    return [b"".join(ord(c).to_bytes(4, "little") for c in x) for x in pieces]


def test_full_cache_keeps_recurring_pieces():
    asked = []

    def encode(new):
        asked.extend(new)
        return as_points(new)

    encoded = Encoded(encode, entries=40)
    for turn in range(30):
        texts = ["", "often seen  é\n", "often " + " ".join(f"once{turn}x{i}" for i in range(20))]
        assert encoded(texts) == as_points(texts)
        assert len(encoded.numbers) <= 40 + 25
    assert asked.count(" seen  é\n") == 1 and asked.count("often") == 1
    assert asked.count(" once7x7") == 1


def test_small_caches_give_the_same():
    texts = ["a b  c", " a", "", "\n b", "a b b a"]
    for entries in (0, 1, 2, 5):
        encoded = Encoded(as_points, entries)
        for _ in range(3):
            assert encoded(texts) == as_points(texts)
            assert encoded([]) == []


def test_plain_words_are_the_patterns():
    find = regex.compile(public_tokenizers.PATTERN).findall
    letters = ["a", "Zß", "é", "ª", "日本", "é", "ǅ", "a1", "'s", "'", "", "Ⅰ", "a_b", "x\x00", "\t"]
    pieces = [space + x + sign for space in ("", " ", "  ") for x in letters for sign in ("", ".", ",", "!", "'", "..", "?!", " ", "\n")]
    pieces += [c for c in map(chr, range(0x3000)) if c.isalpha()] + [f" {c}." for c in disputed_letters()]
    plain = [x for x in pieces if plain_words(x)]
    assert " Zß." in plain and "日本" in plain
    assert all(list(plain_words(x)) == find(x) for x in plain)
    assert all(regex.fullmatch(r"\p{L}", c) for c in map(chr, range(sys.maxunicode + 1)) if c.isalpha() and c not in disputed_letters())
