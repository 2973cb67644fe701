"""The whole pipeline beside plain Python, on awkward rows among those of the table."""

from __future__ import annotations

import glob
import os
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sentinela.llm import common, quality, secrets
from sentinela.llm.queries import BYTE_BPE, QUERIES

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, n_chars long, copy string, row int, spans long"


def article(first, lines, words=9):
    """Lines of words that occur nowhere else."""
    return "\n".join(" ".join(f"w{first}x{k}y{j}" for j in range(words)) + "." for k in range(lines))


def awkward():
    one, two, passage = article(1, 40), article(2, 30), article(3, 4)
    return [
        (9000, one), (9001, one), (9002, one + "\nA last line that only this one has."), (9000, one),
        (9003, two + "\n" + passage), (9004, passage + "\n" + article(4, 40)), (9004, article(5, 20)),
        (None, article(6, 30)), (None, article(6, 30)), (None, None), (9005, None), (9006, ""),
        (9007, " \n\t "), (9008, "too short."), (9009, article(7, 4_000)), (9010, "Home | About\n" + article(8, 30)),
        (9011, article(9, 30) + "\npassword = hunter2222 and more words here."),
        (9012, "\n".join(["The same line again and again here."] * 200)),
        (2**63 - 1, article(10, 30)), (-5, article(11, 30))]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    own = words((text or "").translate(LOWER))
    return {tuple(own[k:k + 5]) for k in range(max(1, len(own) - 4))} if own else set()


def near_copies_dropped(rows):
    """Of all documents that links lead to, those of the smallest id stay."""
    sets = [(i, shingles(t)) for i, t in rows]
    least = {i: i for i, _ in rows if i is not None}
    links = [(a, b) for k, (a, s) in enumerate(sets) for b, t in sets[:k]
             if a is not None and b is not None and s and 100 * len(s & t) >= 75 * len(s | t)]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return [(i, t) for i, t in rows if i is None or least[i] == i]


def repeats_cut(rows):
    """Bytes of 100-byte strings that start earlier go, halves of letters with them."""
    first = {}
    place = lambda i, s: (i is None, i or 0, s)     # noqa: E731
    for i, text in rows:
        data = (text or "").encode()
        for s in range(len(data) - 99):
            own = data[s:s + 100]
            first[own] = min(place(i, s), first.get(own, place(i, s)))
    kept = []
    for i, text in rows:
        data = (text or "").encode()
        covered = np.zeros(len(data), bool)
        for s in range(len(data) - 99):
            if first[data[s:s + 100]] != place(i, s):
                covered[s:s + 100] = True
        if covered.any():
            text = bytes(np.frombuffer(data, np.uint8)[~covered]).decode("utf-8", "ignore")
            if not text.strip():
                continue
        kept.append((i, text))
    return kept


def expected(rows):
    rows = [(i, found["cleaned"]) for i, t in rows if (found := quality.judge(t))["kept"]]
    return [(i, secrets.redact(t)) for i, t in repeats_cut(near_copies_dropped(rows))]


def pieces(rows):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    tokenizer.no_truncation()
    out = []
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        out += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return out


def test_pipeline_beside_plain_python(spark, tmp_path):
    rows = awkward() + [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    spark.createDataFrame([(i, t, 7, "c", 1, 2) for i, t in rows], SCHEMA).repartition(5).write.parquet(
        f"{tmp_path}/documents.parquet")
    got = QUERIES["pipeline"](spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(pieces(expected(rows)))
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by_sequence) <= 1.1 * sum(r.length for r in got) / 1024 + 1


def test_pipeline_of_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_steps_go_with_their_block(spark, tmp_path):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    rows = spark.range(10).withColumn("b", F.col("id") * 2)
    with common.temporary_steps(spark):
        inner = common.stored(rows, "inside")
        with common.temporary_steps(spark):
            common.stored(inner, "deeper").write.parquet(f"{tmp_path}/result")
        assert inner.count() == 10 and not glob.glob(f"{folder}/deeper-*")
    after = common.stored(rows, "after")
    assert {os.path.dirname(f).split("/")[-1] for f in after.inputFiles()} == set(os.listdir(folder)) - before
    assert spark.read.parquet(f"{tmp_path}/result").count() == 10
