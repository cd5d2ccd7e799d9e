import copy
import json
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallymap.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def automaton():
    return bpe.compile_merges(PATH)


def words(n):
    draw = random.Random(3)
    letters = ["a", "e", "n", "th", "ing", "tion", "é", "漢", "0", "'", "-", "😀", "ll", "ß"]
    return ["".join(draw.choice(letters) for _ in range(draw.randrange(1, 14))) for _ in range(n)]


def test_one_entry_a_symbol(automaton):
    """The table's entries spell the word: next states, and the token that ends with each symbol."""
    table = bpe.Transitions(automaton)
    symbols = bpe.byte_symbols()
    for word in words(300):
        spelled = "".join(symbols[b] for b in word.encode())
        path = table.walk(spelled)
        assert "".join(automaton.labels[t] for t in path) == spelled + automaton.end
        state = 0
        for i, symbol in enumerate(spelled[:-1], 1):
            number, token, length = table.rows[state][symbol]
            assert automaton.labels[token] == spelled[i - length : i]
            assert table.states[number][-1] == (0, token)
            state = number
        assert table.ends[state, spelled[-1]] == (path[-1], len(automaton.labels[path[-1]]) - len(automaton.end))
    met = len(table.states)
    for word in words(300):
        table.walk("".join(symbols[b] for b in word.encode()))
    assert len(table.states) == met  # known words make no new states


def test_a_full_table_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 40)
    library = Tokenizer.from_file(PATH)
    codec = bpe.Codec(bpe.compile_merges(PATH))
    for word in words(200):
        ids = codec.encode(word)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library.encode(word, add_special_tokens=False).ids


def test_normalisers_are_read(tmp_path):
    with open(PATH, encoding="utf-8") as file:
        spec = json.load(file)
    plain = copy.deepcopy(spec)
    plain["normalizer"] = {"type": "NFC"}
    (tmp_path / "plain.json").write_text(json.dumps(plain))
    library = Tokenizer.from_file(str(tmp_path / "plain.json"))
    codec = bpe.Codec(bpe.compile_merges(str(tmp_path / "plain.json")))
    for text in ("Capital LETTERS stay", "e\u0301 É"):
        ids = codec.encode(text)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library.encode(text, add_special_tokens=False).ids
    spec["normalizer"] = {"type": "StripAccents"}
    (tmp_path / "other.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="StripAccents"):
        bpe.compile_merges(str(tmp_path / "other.json"))
