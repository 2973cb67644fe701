"""BPE encoding and decoding through a tokenization automaton (operator 8).

The merges of a tokenizer are compiled into a deterministic automaton whose arcs are tokens and
whose paths are exactly the tokenizations that the merges produce (after Berglund, Martens and
van der Merwe, "Constructing a BPE tokenization DFA"). At first every letter may follow every
letter. Then there is one gadget per merge ``u v -> w``, in order of rank: w leaves every state
that u leaves and ends in a state of its own, a copy of v's state as it is now; the arc v, and with
it every later token that begins with v, goes from the state behind u.

The table holds for each state the arcs that it lacks, as these are few. Arcs are numbered so that
what one gadget takes from a state is one run of numbers: tokens stand before those that begin
with them as left part, and of these the later ones first. States with the same arcs are one. The
table of 48,894 merges so has some 12,000 states and 700,000 runs, and is built in a second.

A word has one path, so it is encoded from left to right: for each prefix the one token that
ends there and whose arc leaves the state in which the path of what precedes it ends. Decoding
emits the arc labels.

Edge cases: a null or empty text gives no ids and an empty text; strings of special
tokens in a text become their ids, as the tokenizers library does by default; a null id stays null;
repeated ids give one row each; an empty table gives none; long texts are encoded whole, a text at a
time where it fills a slice; other columns are ignored. A file in which two merges make
the same token is refused.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sentinela.llm.common import slices

SCHEMA = "doc_id long, ids array<int>, decoded string"
# Entries of a worker's memo of words and of text between white space; it is then begun anew.
MEMO = 400_000

# Fixed value: how the tokenizer's file splits words. Other splits are refused.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPLIT = regex.compile(SPLIT)
# Scripts whose letters and cases all Unicode versions agree on, without the separators
# that Python counts as white space and the tokenizer does not.
_PLAIN = regex.compile(r"[^\x1c-\x1f԰-\U0010ffff]*")


def byte_letters() -> dict[int, str]:
    """Byte-level alphabets: printable bytes stand for themselves, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TokenAutomaton:
    """The automaton of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        splits = spec["pre_tokenizer"]["pretokenizers"]
        if (model["type"] != "BPE" or splits[0]["pattern"]["Regex"] != SPLIT
                or spec["decoder"] is not None or spec["post_processor"] is not None):
            raise ValueError(f"{path} is not a word-level BPE file of the known kind")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max(*self.ids.values(), *self.special.values()) + 1
        self.labels = [""] * size
        for token, i in chain(self.ids.items(), self.special.items()):
            self.labels[i] = token
        self.cut = (regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
                    if self.special else None)
        self._compile([pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]],
                      size)
        # Arc labels inside and at the end of a word, with all their suffixes (-1 if no label):
        # reading backwards from a place stops as soon as no label can end there.
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for token, i in self.ids.items():
            ends = bool(self.end) and token.endswith(self.end) and token != self.end
            token, known = (token[:-len(self.end)], self.final) if ends else (token, self.inner)
            known[token] = i
            for at in range(1, len(token)):
                known.setdefault(token[at:], -1)
        if not self.end:
            self.final = self.inner
        self.letters = byte_letters()
        self.bytes = {letter: byte for byte, letter in self.letters.items()}
        # Memos: ids as the bytes of 32-bit integers, which join fast and need no tracking.
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _compile(self, merges: list[list[str]], size: int) -> None:
        """Build states and arcs, a gadget per merge."""
        ids = self.ids
        begun: list[list[int]] = [[] for _ in range(size)]      # tokens by their left part
        made = [-1] * size                                      # the merge that makes a token
        for k, (u, v) in enumerate(merges):
            token = ids[u + v]
            if made[token] >= 0:
                raise ValueError(f"two merges make {u + v!r}")
            made[token] = k
            begun[ids[u]].append(token)
        # Numbers of arcs: each token, then what it begins, latest first.
        self.arc = arc = array("i", [0]) * size
        past = array("i", [0]) * size                           # after all that a token begins
        number, todo = 0, [t for t in reversed(range(size)) if made[t] < 0]
        while todo:
            token = todo.pop()
            if token < 0:
                past[~token] = number
                continue
            arc[token], number = number, number + 1
            todo.append(~token)
            todo.extend(begun[token])

        lacks = [array("q") for _ in range(size)]               # runs of arcs gone from a state
        for k, (u, v) in enumerate(merges):
            left, right, token = ids[u], ids[v], ids[u + v]
            lacks[token] = lacks[right][:]
            # Tokens made of v before now have kept v's place behind u; later ones never get it.
            earlier = [t for t in begun[right] if made[t] < k]
            until = arc[earlier[-1]] if earlier else past[right]
            lacks[left].append(arc[right] << 32 | until)

        # States of equal runs are one; the first is where a word begins and lacks nothing.
        states: dict[bytes, int] = {b"": 0}
        self.after = array("i", (states.setdefault(self._joined(own), len(states)) for own in lacks))
        runs = [np.frombuffer(own, np.int32).reshape(-1, 2) for own in states]
        self.first = array("i", np.concatenate([[0], np.cumsum([len(r) for r in runs])]).tolist())
        flat = np.concatenate(runs)
        self.gone, self.back = (array("i", flat[:, side].tobytes()) for side in (0, 1))

    @staticmethod
    def _joined(runs: array) -> bytes:
        """Runs in order, those within others left out, as pairs of 32-bit integers."""
        if not runs:
            return b""
        both = np.sort(np.frombuffer(runs, np.int64))
        start, end = both >> 32, both & 0xFFFFFFFF
        most = np.maximum.accumulate(end)
        # Runs of a tree of tokens lie in each other or apart.
        new = np.concatenate([[True], start[1:] >= most[:-1]])
        at = np.flatnonzero(new)
        return np.stack([start[at], np.maximum.reduceat(end, at)], 1).astype(np.int32).tobytes()

    def leaves(self, state: int, token: int) -> bool:
        """Whether the table has an arc of this token out of the state."""
        low, arc = self.first[state], self.arc[token]
        at = bisect_right(self.gone, arc, low, self.first[state + 1])
        return at == low or self.back[at - 1] <= arc

    def encode_word(self, word: str) -> list[int]:
        """The path of one pre-split word."""
        text = "".join(map(self.letters.__getitem__, word.encode()))
        after, leaves, n = self.after, self.leaves, len(text)
        # Per prefix: where its last token starts, its id and the state it ends in.
        starts, tokens, states = [0], [-1], [0]
        for i in range(1, n + 1):
            known = self.inner if i < n else self.final
            found, j = [], i - 1
            while j >= 0 and (token := known.get(text[j:i])) is not None:
                if token >= 0:
                    found.append((j, token))
                j -= 1
            for start, token in reversed(found):
                if leaves(states[start], token):
                    break
            else:
                raise ValueError(f"no path for {word!r}")
            starts.append(start)
            tokens.append(token)
            states.append(after[token])
        path, at = [], n
        while at:
            path.append(tokens[at])
            at = starts[at]
        path.reverse()
        return path

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= MEMO:
                self.words.clear()
            self.words[word] = found = array("i", self.encode_word(word)).tobytes()
        return found

    def _plain(self, text: str) -> bytes:
        """No word crosses white space, so what stands between is looked up whole."""
        text = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
        # Lower case letter by letter: a final sigma is not told apart.
        pieces, known = text.replace("Σ", "σ").lower().split(), self.chunks
        for piece in set(pieces).difference(known):
            known[piece] = b"".join(map(self._word, _SPLIT.findall(piece)))
        ids = b"".join(map(known.__getitem__, pieces))
        if len(known) >= MEMO:
            known.clear()
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text, as 32-bit integers."""
        parts = []
        for part in self.cut.split(text or "") if self.cut else [text or ""]:
            if part in self.special:
                parts.append(array("i", [self.special[part]]).tobytes())
            elif _PLAIN.fullmatch(part):
                parts.append(self._plain(part))
            else:
                normal = self.library.normalizer.normalize_str(part)
                for word, _ in self.library.pre_tokenizer.pre_tokenize_str(normal):
                    parts.append(self._word(bytes(map(self.bytes.__getitem__, word)).decode()))
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.labels.__getitem__, ids.tolist()))


@lru_cache(maxsize=1)
def automaton(path: str) -> TokenAutomaton:
    return TokenAutomaton(path)


def encode_documents(docs: DataFrame, tokenizer: str, *, id_column: str = "doc_id",
                     text_column: str = "text") -> DataFrame:
    """One row per document: its ids and what they decode to.

    ``tokenizer`` is a path that every executor can open.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(tokenizer)
        for part in slices(batches, "text"):
            rows = [machine.encode(t) for t in part.column("text").to_pylist()]
            offsets = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(r) for r in rows], out=offsets[1:])
            flat = np.concatenate([np.empty(0, np.int32), *rows])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.ListArray.from_arrays(offsets, flat),
                 pa.array([machine.decode(r) for r in rows], pa.string())],
                ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"),
                       F.col(text_column).cast("string").alias("text")).mapInArrow(encoded, SCHEMA)
