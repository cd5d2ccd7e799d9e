"""BPE encoding and decoding with a merge automaton (operator 4).

The automaton's states are tokens (the last one emitted) plus a start, its arcs are
labelled with tokens.  It begins with arcs for the base symbols only.  Merges are
compiled in order: the gadget of a merge (u, v) -> uv takes the arc v out of state u,
lets every state with an arc u have an arc uv, and gives state uv the arcs that v has
at that time.  The result is deterministic in what a word spells: each word has
exactly one path, and the path's labels are its BPE tokens.

The full table would hold the square of the vocabulary.  A gadget is therefore kept
as one row (parts, birth, arc removed and when); an arc is derived by
following the gadgets back to base symbols, and remembered.

What is walked is a table over single symbols, made deterministic as it is met: its states
are the sets of (piece of a token read since a place, arc state at that place), and a
row's entry for a symbol is the next state with the one token that ends there.  Encoding
follows one entry a symbol and then the tokens back from the end.  Rows stay in the task; a bound on
states starts the table anew.  Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import few_rows, text_or_empty, tidy

MEMO = 200_000
START = -1


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


@dataclass
class Automaton:
    """``labels``: token by id.  ``born``, ``left``, ``right``: the gadget that made a token (-1: base)."""

    ids: dict[str, int]
    labels: list[str]
    born: list[int]
    left: list[int]
    right: list[int]
    removed: dict[tuple[int, int], int]
    end: str
    pattern: str
    special: list[str]
    steps: list[str]
    #: Tokens on some path, by spelling: inside a word and at its end.
    inner: dict[str, int] = field(default_factory=dict)
    final: dict[str, int] = field(default_factory=dict)
    arcs: dict[tuple[int, int], bool] = field(default_factory=dict)
    table: Transitions | None = None

    def has_arc(self, state: int, token: int) -> bool:
        """Whether ``state`` has an arc ``token`` after all gadgets."""
        known = self.arcs.get((state, token))
        if known is None:
            if len(self.arcs) > MEMO:
                self.arcs.clear()
            known = self.arcs[(state, token)] = self._derive(state, token)
        return known

    def _derive(self, u: int, v: int) -> bool:
        time = len(self.labels) + len(self.removed)
        born, left, right = self.born, self.left, self.right
        while True:
            if self.removed.get((u, v), time) < time:
                return False
            if born[u] < 0 and born[v] < 0:
                return True
            if born[u] >= born[v]:  # state u was made later: it has what its right part had then
                time = born[u]
                if u == v:
                    v = left[v]
                u = right[u]
            else:  # arc v was made later: it is where its left part was then
                time = born[v]
                if u == left[v] == right[v]:  # equal symbols pair up from the left
                    return False
                v = left[v]

    def encode(self, word: str) -> list[int]:
        """The path of one word, given as a string of base symbols (the last one ends the word)."""
        if self.table is None or len(self.table.states) > MEMO // 2:
            self.table = Transitions(self)
        return self.table.walk(word)

    def reachable(self, token: int) -> bool:
        """Whether any path ends with the token: its parts must have been neighbours when it was born."""
        if self.born[token] < 0:
            return True
        known = self.arcs.get((START, token))
        if known is None:
            known = self.arcs[(START, token)] = self._whole(token)
        return known

    def _whole(self, token: int) -> bool:
        u, v, time = self.left[token], self.right[token], self.born[token]
        if not (self.reachable(u) and self.reachable(v)):
            return False
        saved, self.removed = self.removed, _Before(self.removed, time)
        try:
            return self._derive(u, v)
        finally:
            self.removed = saved


class Transitions:
    """Table of an automaton over single symbols, with a row for each state that was met.

    ``rows[state][symbol]`` is (next state, token that ends with the symbol, its length); ``ends[state, symbol]`` has
    the token and its length for a word's last symbol.  Equal words take equal ways whatever was met before.
    """

    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton
        # Tokens by spelling, a node a beginning: children by symbol, token inside a word and at its end, length.
        self.children: list[dict[str, int]] = [{}]
        self.inner, self.final, self.depth = [-1], [-1], [0]
        for tokens, at in ((automaton.inner, self.inner), (automaton.final, self.final)):
            for spelling, token in tokens.items():
                at[self._node(spelling)] = token
        begin = ((0, START),)
        self.states: list[tuple[tuple[int, int], ...]] = [begin]
        self.numbers = {begin: 0}
        self.rows: list[dict[str, tuple[int, int, int]]] = [{}]
        self.ends: dict[tuple[int, str], tuple[int, int]] = {}

    def _node(self, spelling: str) -> int:
        node = 0
        for symbol in spelling:
            child = self.children[node].get(symbol)
            if child is None:
                child = self.children[node][symbol] = len(self.children)
                self.children.append({})
                for values, first in ((self.inner, -1), (self.final, -1), (self.depth, self.depth[node] + 1)):
                    values.append(first)
            node = child
        return node

    def _moved(self, state: int, symbol: str, tokens: list[int]) -> tuple[list[tuple[int, int]], int, int]:
        """Places after a symbol, the token that ends with it and the token's length."""
        automaton, places, token, length = self.automaton, [], -1, 0
        for node, before in self.states[state]:
            child = self.children[node].get(symbol)
            if child is None:
                continue
            ending = tokens[child]
            if token < 0 <= ending and (before == START or automaton.has_arc(before, ending)):
                token, length = ending, self.depth[child]
            if self.children[child]:
                places.append((child, before))
        return places, token, length

    def entry(self, state: int, symbol: str) -> tuple[int, int, int]:
        places, token, length = self._moved(state, symbol, self.inner)
        key = (*places, (0, token))
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
            self.rows.append({})
        found = self.rows[state][symbol] = (number, token, length)
        return found

    def end(self, state: int, symbol: str) -> tuple[int, int]:
        _, token, length = self._moved(state, symbol, self.final)
        found = self.ends[state, symbol] = (token, length)
        return found

    def walk(self, word: str) -> list[int]:
        rows, state, way = self.rows, 0, []
        for symbol in word[:-1]:
            step = rows[state].get(symbol) or self.entry(state, symbol)
            way.append(step)
            state = step[0]
        if not word:
            return []
        token, length = self.ends.get((state, word[-1])) or self.end(state, word[-1])
        path, at = [token], len(word) - length
        while at:
            _, token, length = way[at - 1]
            path.append(token)
            at -= length
        return path[::-1]


class _Before:
    """Removals that gadgets before ``time`` made."""

    def __init__(self, removed: dict, time: int) -> None:
        self.all, self.time = removed, time

    def get(self, key, default):
        at = self.all.get(key, default)
        return at if at < self.time else default

    def __len__(self) -> int:
        return len(self.all)


def normalising(spec: dict) -> list[str]:
    """The steps that a tokenizer file prescribes before words are cut; ValueError for one that is not known here."""
    wanted = spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
    steps = []
    for step in wanted["normalizers"] if wanted["type"] == "Sequence" else [wanted]:
        if step["type"] in ("NFC", "Lowercase"):
            steps.append(step["type"])
        elif step != {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}:  # white space is in no word
            raise ValueError(f"no normaliser {step}")
    return steps


def compile_merges(path: str) -> Automaton:
    """The automaton of a tokenizer file: vocabulary, merges in order, word end, pattern, special tokens."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    ids = dict(model["vocab"])
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    size = max([*ids.values(), *special.values()]) + 1
    labels = [""] * size
    for token, at in [*ids.items(), *special.items()]:
        labels[at] = token
    born, left, right = [-1] * size, [-1] * size, [-1] * size
    removed: dict[tuple[int, int], int] = {}
    for rank, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
        u, v, w = ids[a], ids[b], ids[a + b]
        removed.setdefault((u, v), rank)
        if born[w] < 0:
            born[w], left[w], right[w] = rank, u, v
    split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    out = Automaton(
        ids, labels, born, left, right, removed,
        model["end_of_word_suffix"] or "", split["pattern"]["Regex"], list(special), normalising(spec),
    )
    for token, at in ids.items():
        if out.reachable(at):
            ends = out.end and token.endswith(out.end) and token != out.end
            (out.final if ends or not out.end else out.inner)[token.removesuffix(out.end)] = at
    out.inner = out.inner or out.final
    out.ids = {**ids, **special}
    return out


class Codec:
    """Whole texts to ids and back, as the library does for files of this kind."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton
        self.words: dict[str, bytes] = {}
        self.symbols = byte_symbols()
        self.split = regex.compile(automaton.pattern)
        self.special = regex.compile("(" + "|".join(map(regex.escape, automaton.special)) + ")")

    def word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= MEMO:
                self.words.clear()
            path = self.automaton.encode("".join([self.symbols[b] for b in word.encode()]))
            found = self.words[word] = struct.pack(f"<{len(path)}I", *path)
        return found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        for piece in self.special.split(text) if self.automaton.special else [text]:
            if piece in self.automaton.special:
                out.append(struct.pack("<I", self.automaton.ids[piece]))
            elif piece:
                for step in self.automaton.steps:
                    # Lower-casing goes character by character: a capital sigma has one small form here.
                    piece = unicodedata.normalize("NFC", piece) if step == "NFC" else piece.replace("Σ", "σ").lower()
                get = self.words.get
                for word in self.split.findall(piece):
                    out.append(get(word) or self.word(word))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Labels of the arcs, set apart by spaces: files of this kind name no decoder."""
        return " ".join(map(self.automaton.labels.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids)))


def tokenize(docs: DataFrame, path: str, with_text: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row, null texts as empty ones.

    With ``with_text`` also ``ids`` (little-endian unsigned 32-bit) and ``decoded``.  Every
    task compiles the automaton from the file at ``path``, which each machine needs.
    """
    schema = "doc_id {}, n_tokens long, ids_sha256 string, decoded_sha256 string".format(
        docs.schema["doc_id"].dataType.simpleString()
    ) + (", ids binary, decoded string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in few_rows(batches):
            codec = codec or Codec(compile_merges(path))
            encoded = [codec.encode(t.as_py()) for t in batch.column(1)]
            decoded = [codec.decode(x) for x in encoded]
            columns = [
                batch.column(0),
                pa.array([len(x) // 4 for x in encoded], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in encoded], pa.string()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_text:
                columns += [pa.array(encoded, pa.binary()), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id"), text_or_empty().alias("text")).mapInArrow(tidy(run), schema)
