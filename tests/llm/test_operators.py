"""The training-data operators beside brute force, on made texts with the awkward cases."""

from __future__ import annotations

import base64
import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from oracle_check import compare, database
from sentinela.llm import (
    bpe_automaton, common, embedding_graph, hamming_dedup, licenses, packing, quality, secrets,
    suffix_dedup, toxicity, warc,
)
from sentinela.llm.oracles import ORACLES
from sentinela.llm.queries import BYTE_BPE, BYTE_RANKS, QUERIES, WORD_BPE
from sentinela.llm.suffix_array import permuted_prefixes, suffix_array

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed: int, words: int) -> str:
    pick = random.Random(seed)
    return " ".join("".join(pick.choice("abcdefghijklmnoprstuvé") for _ in range(pick.randrange(1, 9)))
                    for _ in range(words))


BASE = prose(1, 400)
GHP = "a1" * 15
TEXTS = [
    (1, BASE), (2, BASE), (3, BASE + " tail end."), (4, BASE.replace("a", "A")),
    (5, " ".join(BASE.split()[:360]) + " " + prose(2, 30)), (6, prose(3, 500)), (7, None), (8, ""),
    (9, "one two"), (10, "One  two\n"), (11, "x"), (12, "ab" * 4000), (13, "a" * 900), (14, "a" * 120),
    (15, prose(4, 6000)), (16, f"password = hunter22 token:ab AKIA{'B' * 16} " + "0f" * 14),
    (17, f"ghp_{GHP}{secrets.base62(zlib.crc32(GHP.encode()))} and ghp_{GHP}000000 secret=token: abcdefgh"),
    (18, "Home\nLine one ends here with enough words.\n" * 30), (19, "don't ΣΑΣ İ 日本語 <|endoftext|> é \x1c z"),
    (20, prose(5, 40) + " Released under the MIT License. " + prose(6, 40)), (21, " \n\t "),
    (None, prose(7, 80)), (23, "é" * 150), (24, "x" + "é" * 100),
]


@pytest.fixture(scope="module")
def docs(spark):
    common.ship(spark)
    # Further columns with names that operators use themselves.
    rows = [(i, t, "a", 1, b"k") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, component_id string, rep int, kept binary"
                                 ).repartition(3)


@pytest.fixture(scope="module")
def none(spark, docs):
    return spark.createDataFrame([], docs.schema)


def by_id(df):
    return {r[0]: r for r in df.collect()}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_suffix_array_and_prefixes():
    pick = random.Random(3)
    for _ in range(300):
        letters = pick.choice([1, 2, 3, 250])
        text = bytes(pick.randrange(letters) for _ in range(pick.randrange(0, 50))) * pick.choice([1, 3])
        order = suffix_array(np.frombuffer(text, np.uint8))
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        if text:
            shared = permuted_prefixes(np.frombuffer(text, np.uint8), order)
            for a, b in zip(order, order[1:]):
                k = 0
                while max(a, b) + k < len(text) and text[a + k] == text[b + k]:
                    k += 1
                assert shared[b] == k


@pytest.mark.parametrize("hot", [None, 300])
def test_suffix_dedup(docs, none, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(suffix_dedup, "HOT_BYTES", hot)
    first, want = {}, {}
    for doc, text in sorted(TEXTS, key=lambda r: (r[0] is None, r[0])):
        data = (text or "").encode()
        covered = bytearray(len(data))
        for s in range(len(data) - 99):
            if first.setdefault(data[s:s + 100], (doc, s)) != (doc, s):
                covered[s:s + 100] = b"\1" * 100
        kept = bytes(b for b, c in zip(data, covered) if not c)
        want[doc] = (doc, len(data), sum(covered), len(re.findall(b"\1+", covered)), kept)
    got = by_id(suffix_dedup.remove_repeats(docs))
    assert {k: (*r[:4], bytes(r[4])) for k, r in got.items()} == want
    if not hot:
        assert suffix_dedup.remove_repeats(none).count() == 0
        cut = suffix_dedup.drop_repeats(docs)
        assert cut.schema == docs.schema
        texts = by_id(cut)
        assert texts[1].text == BASE and 2 not in texts and texts[7].text is None


@pytest.mark.parametrize("hot", [None, 300])
def test_suffix_dedup_of_repeated_rows(spark, hot, monkeypatch):
    """Rows equal in id and text, or of null id and equal text, start at the same place."""
    if hot:
        monkeypatch.setattr(suffix_dedup, "HOT_BYTES", hot)
    one, two, three = prose(31, 60), prose(32, 60), prose(33, 60)
    rows = [(1, one), (1, one), (2, two + one), (3, three), (3, three + two), (3, three + prose(34, 60)),
            (5, prose(35, 40) + three), (None, prose(36, 60)), (None, prose(36, 60)), (None, two), (None, two)]
    first = {}
    for doc, text in rows:
        data = text.encode()
        for s in range(len(data) - 99):
            place = (doc is None, doc or 0, s)
            first[data[s:s + 100]] = min(place, first.get(data[s:s + 100], place))
    want = []
    for doc, text in rows:
        data, covered = text.encode(), bytearray(len(text.encode()))
        for s in range(len(data) - 99):
            if first[data[s:s + 100]] != (doc is None, doc or 0, s):
                covered[s:s + 100] = b"\1" * 100
        want.append((doc or 0, bytes(b for b, c in zip(data, covered) if not c)))
    made = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 4):        # repeated rows in one task and in several
        got = suffix_dedup.remove_repeats(made.repartition(parts)).collect()
        assert sorted((r.doc_id or 0, bytes(r.kept)) for r in got) == sorted(want)
    kept = Counter(r.doc_id for r in suffix_dedup.drop_repeats(made).collect())
    assert kept[1] == 2 and kept[None] == 2
    alone = suffix_dedup.remove_repeats(spark.createDataFrame([(1, one)], made.schema)).collect()
    assert [bytes(r.kept) for r in alone] == [one.encode()]


def test_near_groups(docs, none):
    sets = {}
    for doc, text in TEXTS:
        w = words_of((text or "").translate(LOWER))
        sets[doc] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}
    group = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if None not in (a, b) and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    got = by_id(hamming_dedup.near_groups(docs))
    assert {d: tuple(r) for d, r in got.items()} == {
        d: (d, len(sets[d]), group[d], d is None or group[d] == d) for d in sets}
    assert hamming_dedup.near_groups(none).count() == 0
    kept = hamming_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(d or 0 for d in sets if group[d] == d)


def test_near_family_in_small_blocks(spark, monkeypatch):
    """Near copies whose likenesses lie around the threshold, over several blocks."""
    monkeypatch.setattr(hamming_dedup, "BLOCK", 7)
    pick, base = random.Random(8), prose(9, 220).split()
    rows = []
    for k in range(60):
        own = list(base)
        for _ in range(pick.randrange(2, 11)):
            own[pick.randrange(len(own))] = f"new{k}x{pick.random()}"
        rows.append((k, " ".join(own)))
    sets = {k: {tuple(t.split()[i:i + 5]) for i in range(216)} for k, t in rows}
    group = {k: k for k in sets}
    for _ in range(8):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    got = by_id(hamming_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {k: r.component_id for k, r in got.items()} == group and len(set(group.values())) > 1


def test_pairs_at_the_threshold_are_within_reach():
    """Pairs of exactly 75 per cent, 12 of 16 shingles, meet and pass the filter of signatures."""
    runs = np.random.default_rng(21).integers(0, 1 << 64, (12_000, 16), dtype=np.uint64)
    sides = np.stack([runs[:, :14], np.delete(runs, [12, 13], axis=1)], 1)
    symbols = hamming_dedup.signatures(sides.ravel(), np.arange(24_001) * 14).reshape(12_000, 2, -1)
    differ = symbols[:, 0] != symbols[:, 1]
    assert (differ.sum(1) <= hamming_dedup.REACH).all()
    chunks = differ.reshape(-1, hamming_dedup.CHUNKS, hamming_dedup.CHUNK)
    assert (chunks.sum(2) <= hamming_dedup.ERRORS).any(1).all()


def test_secrets(docs, none):
    base = {"assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"""
                      r"""[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
            "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
    least = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20,
             "hex": lambda m: len(m[0]) >= 24}
    for doc, row in by_id(secrets.find_secrets(docs)).items():
        text = dict(TEXTS)[doc] or ""
        want = [(k, m.start(), m.end()) for k in base for m in re.finditer(base[k], text) if least[k](m)]
        assert sorted(want) == sorted(tuple(s) for s in row.spans if s.kind in base)
    spans = by_id(secrets.find_secrets(docs))[17].spans
    assert [(s.kind, s.start) for s in spans if s.kind == "github"] == [("github", 0)]
    assert secrets.find_secrets(none).count() == 0
    assert secrets.redact("token = abcdef, rest") == "[assign], rest"
    assert secrets.redact(None) is None


def test_quality(docs, none):
    good = "\n".join(prose(k, 12).capitalize() + "." for k in range(20))
    cases = [(1, good, True), (2, good + "\nHome | About | Contact", True),
             (3, "\n".join("a | b | c | d" for _ in range(40)), False), (4, "too short.", False),
             (5, "same words again. " * 40, False),
             (6, good + "\n" + "\n".join(prose(k, 12).replace(" ", "!! ") + "!!" for k in range(50, 90)), False)]
    for _, text, kept in cases:
        assert quality.judge(text)["kept"] is kept
    assert quality.judge(cases[1][1])["cleaned"] == good
    got = by_id(quality.clean_documents(docs))
    for doc, text in TEXTS:
        w, row = words_of(text), got[doc]
        windows = Counter(zip(w, w[1:], w[2:]))
        again = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if windows[g] > 1 for k in range(3)}
        lines = [line for line in (text or "").split("\n") if words_of(line)]
        assert (row.n_words, row.word_chars, row.n_repeat_words, row.n_dup_lines) == (
            len(w), sum(map(len, w)), len(again), len(lines) - len(set(lines)))
    assert quality.clean_documents(none).count() == 0
    assert quality.filter_documents(docs).schema == docs.schema


def test_a_phrase_fails_a_short_line_only():
    """A long article on one line may mention a phrase; a footer line may not."""
    article = prose(61, 300).replace("é", "e") + " as our privacy policy and the terms of use say. " + prose(62, 200)
    found = quality.judge(article)
    assert found["kept"] and found["cleaned"] == article and found["n_removed_lines"] == 0
    for footer in ("Copyright 2020. All Rights Reserved.", "Diese Seite verwendet Cookies, klicken Sie hier.",
                   "Cliquez ici pour lire la politique de confidentialité.", "Lea la política de privacidad aquí."):
        again = quality.judge(article + "\n" + footer)
        assert again["failed_boilerplate"] == 1 and again["cleaned"] == article and again["kept"]
    assert quality.line_fault("Kontakt Impressum Hilfe", ["Kontakt", "Impressum", "Hilfe"]) == "navigation"


def test_bpe_automaton(docs, none):
    library = Tokenizer.from_file(WORD_BPE)
    machine = bpe_automaton.automaton(WORD_BPE)
    pick = random.Random(2)
    some = [t or "" for _, t in TEXTS] + [
        "".join(pick.choice("abcdefghijklmnopqrstuvwxyz' .,éßñÜ0123ΣİЖ日́\t\n!") for _ in range(60))
        for _ in range(300)]
    for text in some:
        ids = library.encode(text, add_special_tokens=False).ids
        assert machine.encode(text).tolist() == ids
        assert machine.decode(machine.encode(text)) == library.decode(ids, skip_special_tokens=False)
    got = by_id(bpe_automaton.encode_documents(docs, WORD_BPE))
    assert got[7].ids == [] and got[7].decoded == "" and len(got) == len(TEXTS)
    assert bpe_automaton.encode_documents(none, WORD_BPE).count() == 0


def test_arcs_are_the_tokens_that_may_follow():
    """An arc leaves the state behind a token if the library cuts the two in that way."""
    library = Tokenizer.from_file(WORD_BPE)
    machine = bpe_automaton.automaton(WORD_BPE)
    inner = [t for t in machine.ids if re.fullmatch("[a-z]+", t)]
    final = [t for t in machine.ids if re.fullmatch("[a-z]+</w>", t)]
    pick, seen = random.Random(31), Counter()
    pairs = [(pick.choice(inner), pick.choice(final)) for _ in range(4000)]
    # Pairs whose halves were cut from a token: most of them merge, so the arc is gone.
    pairs += [(t[:k], t[k:]) for t in pick.sample(final, 2000) for k in range(1, len(t) - 4)
              if t[:k] in machine.ids and t[k:] in machine.ids]
    for a, b in pairs:
        arc = machine.leaves(machine.after[machine.ids[a]], machine.ids[b])
        assert arc == (library.encode(a + b[:-4], add_special_tokens=False).tokens == [a, b])
        seen[arc] += 1
    assert min(seen.values()) > 500
    assert all(machine.leaves(0, i) for i in machine.ids.values())


def test_a_token_made_twice_is_refused(tmp_path):
    with open(WORD_BPE, encoding="utf-8") as file:
        spec = json.load(file)
    spec["model"]["merges"].append("a bc" if isinstance(spec["model"]["merges"][0], str) else ["a", "bc"])
    spec["model"]["merges"].append("ab c" if isinstance(spec["model"]["merges"][0], str) else ["ab", "c"])
    path = tmp_path / "twice.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError):
        bpe_automaton.TokenAutomaton(str(path))


def test_repeated_ids_and_long_texts_of_one_pass(spark):
    """Each row of an id gives a row; a text longer than a slice is read whole."""
    long = prose(41, 300_000)
    rows = [(1, "password = hunter22"), (1, "password = hunter22"), (1, "another text"), (2, long),
            (None, "no id"), (None, None)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    library = Tokenizer.from_file(WORD_BPE)
    want = Counter((d, tuple(library.encode(t or "", add_special_tokens=False).ids)) for d, t in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in
                   bpe_automaton.encode_documents(made, WORD_BPE).collect()) == want
    assert Counter((r.doc_id, r.n_words) for r in quality.clean_documents(made).collect()) == Counter(
        (d, len(words_of(t))) for d, t in rows)
    assert Counter((r.doc_id, len(r.spans)) for r in secrets.find_secrets(made).collect()) == Counter(
        (d, len(secrets.find_spans(t))) for d, t in rows)
    pieces = packing.pack(packing.cut_documents(made, BYTE_BPE, ranks=BYTE_RANKS)).collect()
    own = Tokenizer.from_file(BYTE_BPE)
    assert sum(r.length for r in pieces) == sum(
        len(own.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)


def test_packing(spark, docs, none):
    library = Tokenizer.from_file(BYTE_BPE)
    rows = packing.pack(packing.cut_documents(docs, BYTE_BPE, ranks=BYTE_RANKS)).collect()
    by_doc, sequences = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, text in TEXTS:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for piece, r in enumerate(sorted(by_doc[doc], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (piece, at) and (piece == 0 or r.length == 1024)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(packing.cut_documents(none, BYTE_BPE)).count() == 0
    # One item per partition: the tree joins them.
    sizes = spark.createDataFrame([(600 if k < 64 else 424,) for k in range(128)], "length long").repartition(128)
    packed = packing.pack(sizes)
    assert packed.select("sequence_id").distinct().count() == 64
    with pytest.raises(ValueError):
        packing.best_fit(np.array([1025]), 1024)


def test_embeddings(spark):
    pick = np.random.default_rng(4)
    rows = [(k, [float(x) for x in pick.normal(size=16)]) for k in range(300)]
    near = [(300 + k, [float(x) for x in np.array(rows[k % 5][1]) + pick.normal(size=16) * 0.12]) for k in range(200)]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [1.0, None]),
           (904, []), (905, rows[0][1]), (906, [2 * x for x in rows[0][1]]), (907, rows[0][1][:8]),
           (908, [1e200 * x for x in rows[0][1]])]
    everything = rows + near + odd
    valid = {i: np.array(v) / np.abs(v).max() for i, v in everything
             if v and None not in v and np.isfinite(v).all() and np.any(v)}
    units = {i: v / np.linalg.norm(v) for i, v in valid.items()}
    links = {i: {j for j in units if j != i and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.95}
             if i in units else set() for i, _ in everything}
    group = {i: i for i in links}
    for _ in range(20):
        for i, near_ in links.items():
            for j in near_:
                group[i] = group[j] = min(group[i], group[j])
    got = by_id(embedding_graph.near_vectors(
        spark.createDataFrame(everything, "vec_id long, embedding array<double>")))
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {
        i: (len(links[i]), group[i]) for i in links}
    assert {r.audited_recall for r in got.values()} == {1.0}
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_graph.near_vectors(empty).count() == 0


def group_vectors(seed, size, rest):
    """Unit vectors, the first ``size`` of them different ones around one direction."""
    pick = np.random.default_rng(seed)
    rows = pick.normal(size=(size + rest, 64))
    rows[:size] = rows[0] / np.linalg.norm(rows[0]) + rows[:size] * 0.022
    return rows / np.linalg.norm(rows, axis=1)[:, None]


def test_linked_vectors_share_a_shard():
    """A group of 10,000 different vectors among 30,000, which draws many centres."""
    rows = group_vectors(11, 10_000, 20_000)
    pick = np.random.default_rng(12)
    centres = embedding_graph.fit_centres(rows[pick.permutation(len(rows))[:embedding_graph.SAMPLE]],
                                          len(rows) // embedding_graph.SHARD)
    first = embedding_graph.joined_centres(centres)
    dealt = [set(embedding_graph.shards_near(row, centres, first)) for row in rows[:10_000]]
    assert np.mean([len(d) for d in dealt]) < 5
    some = pick.integers(0, 10_000, (200_000, 2))
    due = [(a, b) for a, b in some[np.einsum("nd,nd->n", rows[some[:, 0]], rows[some[:, 1]])
                                   >= embedding_graph.LEAST_COSINE].tolist()]
    assert len(due) > 50_000 and all(dealt[a] & dealt[b] for a, b in due)


def test_links_of_a_large_group(spark, monkeypatch):
    """All links of a group that has many centres and several blocks."""
    monkeypatch.setattr(embedding_graph, "SHARD", 10)
    monkeypatch.setattr(embedding_graph, "MOST", 150)
    rows = group_vectors(13, 400, 400)
    links = (rows @ rows.T >= embedding_graph.LEAST_COSINE).sum(1) - 1
    got = by_id(embedding_graph.near_vectors(spark.createDataFrame(
        list(enumerate(rows.tolist())), "vec_id long, embedding array<double>")))
    assert [got[k].n_links for k in range(800)] == links.tolist() and links.max() > 100


def test_licenses(spark, docs, none):
    found = licenses.scan_licenses(docs).collect()
    assert [(r.doc_id, r.license, r.start_word) for r in found] == [(20, "MIT", 40)]
    grant = licenses.TEMPLATES["MIT"][1].replace("deal in", "deal fairly in")
    rows = [(1, prose(1, 900) + " " + grant + " " + prose(2, 900)), (2, grant + "\n" + grant), (3, prose(3, 4000))]
    # Exact containment over all windows, without bands.
    known, want = licenses.Templates(licenses.TEMPLATES), set()
    for doc, text in rows:
        runs, _, _ = licenses.text_shingles(pa.array([text]))
        for t, own in enumerate(known.shingles):
            block = next(b for b, ts in known.blocks.items() if t in ts)
            for a in range(0, len(runs), block):
                if 100 * len(set(runs[a:a + 2 * block]) & set(own)) >= 75 * len(own):
                    want.add((doc, *known.names[t]))
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.license, r.template) for r in got} == want
    assert Counter(r.doc_id for r in got) == {1: 1, 2: 2}
    assert licenses.scan_licenses(none).count() == 0
    with pytest.raises(ValueError):
        licenses.scan_licenses(docs, {"short": ["four words only here"]})


@pytest.mark.parametrize("name, k", [(n, k) for n, own in licenses.TEMPLATES.items() for k in range(len(own))])
def test_every_template_is_found_as_its_own_license(name, k):
    text = prose(51, 70) + " " + licenses.TEMPLATES[name][k] + ". " + prose(52, 70)
    templates = licenses.Templates(licenses.TEMPLATES)
    found = [templates.names[t] for _, t, *_ in licenses.matches(pa.array([text]), templates)]
    assert (name, k) in found and {n for n, _ in found} == {name}
    assert not licenses.matches(pa.array([prose(51, 70) + " " + prose(52, 70), None, ""]), templates)


def test_toxicity_beside_plain_python(spark):
    """Features, counts of the telling ones, likelihood and severity without numpy's flat arrays."""
    mask, levels = (1 << toxicity.BITS) - 1, toxicity.LEVELS

    def mixed(value):
        value &= (1 << 64) - 1
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            value = ((value ^ value >> shift) * factor) & ((1 << 64) - 1)
        return value

    def plain(text):
        out = set()
        own = [w.translate(LOWER).strip(toxicity.EDGES) for w in words_of(text)]
        for kind, prefix in enumerate((None, *toxicity.PREFIXES)):
            some = own if prefix is None else [w[:prefix] for w in own if len(w) > prefix]
            if prefix is None:
                some = [w for w in some if w]
            counts = Counter(mixed(xxhash.xxh3_64_intdigest(w) + kind) & mask for w in some)
            out |= {mixed(n * levels + level) & mask for n, c in counts.items()
                    for level in range(levels) if c >= 1 << level}
        return out

    pick = random.Random(71)
    rows = []
    for k in range(90):
        some = prose(700 + k, 30).split() + ["idiot", "moron!"] * (2 * (k % 3)) + ["nothing"] * (k % 5)
        pick.shuffle(some)
        rows.append((k, " ".join(some)))
    sets = [plain(t) for _, t in rows]
    found, starts = toxicity.features(pa.array([t for _, t in rows]))
    assert [set(found[a:b].tolist()) for a, b in zip(starts, starts[1:])] == sets
    labels = [(k, 1 if k % 3 < 2 else 0, int(k % 3 > 0)) for k in range(90)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    own = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(made, own)
    grades = [k % 3 for k in range(90)]
    with_, all_ = Counter(), Counter()
    for g, s in zip(grades, sets):
        all_.update(s)
        with_.update(s if g else ())
    telling = sorted(f for f, c in all_.items() if c >= toxicity.LEAST_DOCUMENTS and np.log(
        ((with_[f] + 0.5) / 61) / ((c - with_[f] + 0.5) / 31)) >= toxicity.LEAST_RATIO)
    assert model.known.tolist() == telling and telling

    def chance(score, thresholds, grade):
        above = [1.0, *(1 / (1 + np.exp(t - score)) for t in thresholds), 0.0]
        return above[grade] - above[grade + 1]

    def likelihood(weights, thresholds):
        by_feature = dict(zip(telling, weights))
        return sum(np.log(max(chance(sum(by_feature.get(f, 0) for f in s), thresholds, g), 1e-300))
                   for g, s in zip(grades, sets))

    best = likelihood(model.weights, model.thresholds)
    assert best > likelihood(0 * model.weights, np.log([0.5, 2.0])) / 4
    noise = np.random.default_rng(72)
    for _ in range(10):
        assert best > likelihood(model.weights + noise.normal(size=len(telling)), model.thresholds)
    by_feature = dict(zip(telling, model.weights))
    for r in toxicity.score_documents(made, model).collect():
        score = sum(by_feature.get(f, 0) for f in sets[r.doc_id])
        assert abs(r.expected_severity - sum(1 / (1 + np.exp(t - score)) for t in model.thresholds)) < 1e-9
        assert r.grade == sum(score >= t for t in model.thresholds)


def test_toxicity(spark, docs, none):
    pick = random.Random(6)
    rows, labels = [], []
    for k in range(600):
        bad = k % 3
        words = prose(k, 60).split() + ["idiot", "moron"] * (3 * bad)
        pick.shuffle(words)
        rows.append((k, " ".join(words)))
        if k < 400:
            labels.append((k, 1 if bad < 2 else 0, int(bad > 0)))
    labels += [(None, 1, 1), (1, None, 1), (2, 0, None)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    own = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = by_id(toxicity.grade_toxicity(made, own))
    held_out = [k for k in range(400, 600)]
    assert all(got[k].toxic == (k % 3 > 0) for k in held_out)
    assert np.mean([got[k].grade == k % 3 for k in held_out]) > 0.95
    model = toxicity.train(made, own)
    assert (np.diff(model.thresholds) > 0).all()
    assert len(by_id(toxicity.score_documents(docs.select("doc_id", "text"), model))) == len(TEXTS)
    nothing = spark.createDataFrame([], own.schema)
    assert not any(r.toxic for r in toxicity.grade_toxicity(docs, nothing).collect())
    assert toxicity.grade_toxicity(none, own).count() == 0


def test_warc(spark, tmp_path):
    trap = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
    rows = [(1, "http://a.b/c?d#e", None), (2, "http://a.b/", ""), (3, None, trap), (4, "u\nv", trap),
            (5, "http://ü/", "é\n\n\r\n"), (6, "q", "\n"), (7, "q", "\n"), (8, "q", "big" * 300000), (9, "q", "\r")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    first, want = {}, {}
    for page, _, html in rows:
        data = (html or "").encode()
        of = first.setdefault(data, page)
        want[page] = (page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                      "response" if of == page else "revisit", None if of == page else of)
    assert {i: tuple(r) for i, r in by_id(QUERIES["op1_warc"](spark, str(tmp_path))).items()} == want
    path = f"{tmp_path}/archives"
    warc.write_archives(spark.read.parquet(f"{tmp_path}/pages.parquet"), path, least_revisit=3)
    captures = warc.assemble(warc.read_records(spark, path)).collect()
    assert sum(c.response.type == "revisit" for c in captures) == 1     # smaller payloads are all responses
    assert all(c.request and c.metadata and c.response.digest_holds is not False for c in captures)
    assert any(bytes(c.response.block).endswith(trap.encode()) for c in captures)
    with pytest.raises(ValueError):
        list(warc.parse_stream(iter([[b"WARC/1.1\r", b"Content-Length: 9\r", b"\r", b"abc"]])))


def test_assembly_follows_identifiers(spark):
    rows = [("a", "response", ["r"]), ("r", "request", []), ("m", "metadata", ["r"]),
            ("b", "response", []), ("q", "request", ["b"]), ("n", "metadata", ["b"]), ("z", "request", ["gone"])]
    got = warc.assemble(spark.createDataFrame(rows, "record_id string, type string, concurrent_to array<string>"))
    assert sorted((r.capture, r.request.record_id, r.metadata.record_id) for r in got.collect()) == [
        ("a", "r", "m"), ("b", "q", "n")]


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100), (201, 200), (200, 202), (None, 1)]
    got = by_id(common.components(spark.createDataFrame(edges, "a long, b long")))
    assert {i: r[1] for i, r in got.items()} == dict.fromkeys(range(61), 0) | dict.fromkeys((200, 201, 202), 200)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twins(spark, name):
    assert compare(spark, database(SMALL), SMALL, QUERIES[name], ORACLES[name]) is None


def test_pipeline(spark, docs):
    """Each stage beside plain Python on its own input."""
    now = common.table(spark, SMALL, "documents")
    stages = dict(corpus_pipeline.STAGES)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "suffix_array_dedup", "secret_scan", "best_fit_packing"]
    for name in names[:-1]:
        before = {r.doc_id: r.text for r in now.collect()}
        schema = now.schema
        now = common.stored(stages[name](spark, now, SMALL), "test")
        after = {r.doc_id: r.text for r in now.collect()}
        assert now.schema == schema and set(after) <= set(before)
        if name == "quality_rules":
            found = {d: quality.judge(t) for d, t in before.items()}
            assert after == {d: f["cleaned"] for d, f in found.items() if f["kept"]}
        elif name == "near_dedup":
            assert all(before[d] == t for d, t in after.items())
            assert len(set(after.values())) == len(after)
        elif name == "suffix_array_dedup":
            seen = set()
            for _, text in sorted(after.items()):
                data = text.encode()
                own = {data[k:k + 100] for k in range(len(data) - 99)}
                if text == before[_]:
                    assert not own & seen
                    seen |= own
        else:
            assert after == {d: secrets.redact(t) for d, t in before.items()}
    rows = stages[names[-1]](spark, now, SMALL)
    assert {r.doc_id for r in rows.select("doc_id").collect()} == {r.doc_id for r in now.collect()}
    assert corpus_pipeline.ORACLE_SQL is None
    total = rows.agg(F.sum("length")).first()[0]
    assert rows.select("sequence_id").distinct().count() <= 1.1 * total / 1024 + 1
