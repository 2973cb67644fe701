"""Quality rules: line-first cleaning (operator 10).

Every line is judged by itself: punctuation, navigation and boilerplate rules. Lines that
fail are removed, and a document that loses too much of its text is rejected. A phrase of
boilerplate fails a line only where such phrases make up a stated share of its characters, so that
an article on one long line may speak of a privacy policy. Word lists are in English, German,
French and Spanish. Documents are independent, so the work is one pass without a shuffle.

Edge cases: a null or empty text has no words and is rejected; blank lines are neutral; a
null id stays null; repeated ids give one row each; an empty table gives none; long texts are judged
whole; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela.llm.common import slices, with_texts

# Fixed values of the rules.
SYMBOLS = "#*$%&|<>"
TERMINAL = (".", "!", "?", ":", ";", "…", "\"", "'", ")", "”", "»")
NAVIGATION = (
    "about", "archive", "blog", "categories", "contact", "faq", "help", "home", "login", "menu", "next",
    "previous", "register", "search", "sitemap", "tags",
    "anmelden", "archiv", "hilfe", "impressum", "kategorien", "kontakt", "startseite", "suche",
    "accueil", "aide", "connexion", "inscription", "recherche", "sommaire",
    "ayuda", "buscar", "contacto", "inicio", "registrarse")
BOILERPLATE = (
    "all rights reserved", "accept cookies", "use of cookies", "enable javascript", "lorem ipsum",
    "privacy policy", "terms of use", "terms of service", "click here", "subscribe to our", "sign up for",
    "alle rechte vorbehalten", "cookies akzeptieren", "verwendet cookies", "aktivieren sie javascript",
    "klicken sie hier", "newsletter abonnieren",
    "tous droits réservés", "accepter les cookies", "utilisation de cookies", "activer javascript",
    "politique de confidentialité", "conditions d'utilisation", "cliquez ici", "mentions légales",
    "todos los derechos reservados", "aceptar las cookies", "uso de cookies", "habilite javascript",
    "política de privacidad", "condiciones de uso", "haga clic aquí", "aviso legal")


@dataclass(frozen=True)
class Rules:
    """Thresholds. Shares compare counts as integers, so that SQL gives the same answer."""

    symbols_per_5_words: int = 1        # a line with more symbols fails
    shouts_per_2_words: int = 1         # "!!", more of them fail
    short_line_words: int = 5           # shorter lines need a terminal mark
    least_boilerplate_percent: int = 20     # of a line's characters in such phrases
    least_words: int = 50
    most_repeated_percent: int = 50     # of words in repeated 3-word windows
    most_removed_percent: int = 50      # of the characters of lines with words


RULES = Rules()
SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, n_removed_lines long, removed_chars long, line_chars long, "
          "failed_punctuation long, failed_navigation long, failed_boilerplate long, "
          "base_failed boolean, kept boolean, cleaned string")

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)))
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_fault(line: str, words: list[str], rules: Rules = RULES) -> str | None:
    """The rule that a line with words fails, if any."""
    n, pipes = len(words), line.count("|")
    symbols = sum(map(line.count, SYMBOLS))
    if 5 * pipes > rules.symbols_per_5_words * n:
        return "navigation"
    if (5 * symbols > rules.symbols_per_5_words * n
            or 2 * line.count("!!") > rules.shouts_per_2_words * n):
        return "punctuation"
    if n < rules.short_line_words:
        if all(w.translate(_LOWER) in NAVIGATION for w in words):
            return "navigation"
        if not words[-1].endswith(TERMINAL):
            return "punctuation"
    phrases = sum(map(len, _BOILERPLATE.findall(line.translate(_LOWER))))
    if phrases and 100 * phrases >= rules.least_boilerplate_percent * len(line):
        return "boilerplate"
    return None


def repeated_words(words: list[str]) -> int:
    """Words in 3-word windows that occur at least twice in the list."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered, end = 0, 0     # words before ``end`` are counted
    for at, window in enumerate(windows):
        if counts[window] > 1:
            covered += at + 3 - max(end, at)
            end = at + 3
    return covered


def judge(text: str | None, rules: Rules = RULES) -> dict:
    """All columns of a document but its id."""
    text = text or ""
    words: list[str] = []
    seen: set[str] = set()
    kept_lines: list[str] = []
    repeats = removed = removed_chars = line_chars = 0
    failed = Counter()
    for line in text.split("\n"):
        own = _WORD.findall(line)
        if not own:
            kept_lines.append(line)
            continue
        words += own
        line_chars += len(line)
        if again := line in seen:
            repeats += 1
        seen.add(line)
        if fault := "boilerplate" if again else line_fault(line, own, rules):
            failed[fault] += 1
            removed += 1
            removed_chars += len(line)
        else:
            kept_lines.append(line)
    n, again_words = len(words), repeated_words(words)
    base = n < rules.least_words or 100 * again_words > rules.most_repeated_percent * n
    return {
        "n_words": n, "word_chars": sum(map(len, words)),
        "n_symbols": sum(map(text.count, SYMBOLS)), "n_dup_lines": repeats,
        "n_repeat_words": again_words, "n_removed_lines": removed,
        "removed_chars": removed_chars, "line_chars": line_chars,
        "failed_punctuation": failed["punctuation"], "failed_navigation": failed["navigation"],
        "failed_boilerplate": failed["boilerplate"], "base_failed": base,
        "kept": not base and 100 * removed_chars <= rules.most_removed_percent * line_chars,
        "cleaned": "\n".join(kept_lines) if removed else text}


def clean_documents(docs: DataFrame, rules: Rules = RULES, *, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """One row per document: counts, verdict and the text without the failed lines."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = [{"doc_id": i} | judge(t, rules) for i, t in
                    zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist())]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    arrow = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in SCHEMA.split(", "))])
    return docs.select(F.col(id_column).cast("long").alias("doc_id"),
                       F.col(text_column).cast("string").alias("text")).mapInArrow(judged, SCHEMA)


def filter_documents(docs: DataFrame, rules: Rules = RULES, *, text_column: str = "text",
                     length_column: str = "n_chars") -> DataFrame:
    """The kept documents with all their columns, the text without its failed lines.

    ``length_column``, if there is one, gets the new length.
    """

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_column):
            found = [judge(t, rules) for t in part.column(text_column).to_pylist()]
            part = with_texts(part, text_column, length_column, [f["cleaned"] for f in found])
            yield part.filter(pa.array([f["kept"] for f in found], pa.bool_()))

    return docs.mapInArrow(filtered, docs.schema)
