"""Secret scans (operator 9): keyword prefilter, anchored expressions, embedded checksums.

An Aho-Corasick automaton finds all keywords of all kinds in one pass over a text; a kind's
expression is tried only where one of its keywords begins, anchored there. Hexadecimal keys
have no keyword: their prefilter is a run of their alphabet. Tokens that carry a checksum
(CRC-32 of the body in base 62, the last six characters) count only if it is right.

Edge cases: a null or empty text has no spans; spans are half open and in code points;
equal ids give one row each; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela.llm.common import slices, with_texts

# The kinds in the order that breaks ties.
KINDS = ("assign", "access", "hex", "github", "npm")
BASE_KINDS = KINDS[:3]
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
GITHUB_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

# Letters of the keywords in either case; written out because ignoring case would also
# admit letters beyond ASCII.
_ASSIGN = re.compile(
    "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
                   for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")         # a run has no shorter match inside
_CHECKED = re.compile(r"(?:gh[opusr]_|npm_)([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_WORD_BEFORE = re.compile(r"[A-Za-z0-9]")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

SCHEMA = "doc_id long, spans array<struct<kind:string,start:int,end:int>>"


def base62(number: int, width: int = 6) -> str:
    digits = ""
    while number:
        number, digit = divmod(number, 62)
        digits = BASE62[digit] + digits
    return digits.rjust(width, "0")


def checksum_holds(body: str, check: str) -> bool:
    return base62(zlib.crc32(body.encode())) == check


@lru_cache(maxsize=1)
def keywords() -> ahocorasick.Automaton:
    """All keywords in lower case, with their kind and length."""
    automaton = ahocorasick.Automaton()
    for kind, words in (("assign", ASSIGN_WORDS), ("access", ("akia",)),
                        ("github", GITHUB_WORDS), ("npm", ("npm_",))):
        for word in words:
            automaton.add_word(word, (kind, len(word)))
    automaton.make_automaton()
    return automaton


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; leftmost and non-overlapping in each kind."""
    if not text:
        return []
    spans = [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    end = dict.fromkeys(KINDS, 0)           # where a kind's last match ended, valid or not
    for last, (kind, length) in keywords().iter(text.translate(_LOWER)):
        start = last + 1 - length
        if start < end[kind]:
            continue
        if kind == "assign":
            found = _ASSIGN.match(text, start)
            valid = found and found.end() - found.start(2) >= 6
        elif kind == "access":
            found = _ACCESS.match(text, start)
            valid = found and found.end() - start >= 20
        else:
            found = _CHECKED.match(text, start)
            valid = (found and not (start and _WORD_BEFORE.match(text, start - 1))
                     and checksum_holds(*found.groups()))
        if found:
            end[kind] = found.end()
        if valid:
            spans.append((kind, start, found.end()))
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return spans


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind; overlapping spans become one."""
    spans = find_spans(text)
    if not spans:
        return text
    parts, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            parts += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def find_secrets(docs: DataFrame, *, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """One row per document with all its spans."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for part in slices(batches, "text"):
            found = [[dict(zip(("kind", "start", "end"), s)) for s in find_spans(t)]
                     for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(found, pa.list_(span))], ["doc_id", "spans"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"),
                       F.col(text_column).cast("string").alias("text")).mapInArrow(scanned, SCHEMA)


def redact_documents(docs: DataFrame, *, text_column: str = "text",
                     length_column: str = "n_chars") -> DataFrame:
    """The same rows and columns, with secrets in the text replaced by their kind."""

    def redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_column):
            yield with_texts(part, text_column, length_column,
                             [redact(t) for t in part.column(text_column).to_pylist()])

    return docs.mapInArrow(redacted, docs.schema)
