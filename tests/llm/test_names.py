"""Extra columns with the names that operators use themselves, and settings in other units."""

from __future__ import annotations

from sentinela.llm import common, hamming_dedup, packing


def test_packing_with_names_of_its_own(spark):
    rows = [(1, 400, "b", 7, 8, 9, "x"), (2, 700, "c", 1, 2, 3, None), (3, 600, "d", 0, 0, 0, "y")]
    pieces = spark.createDataFrame(rows, "doc_id long, length long, bin string, at int, fill int, item int, row string")
    packed = packing.pack(pieces)
    assert packed.columns == [*pieces.columns, "sequence_id", "offset"]
    got = {r.doc_id: r for r in packed.collect()}
    assert [(got[k].bin, got[k].at, got[k].row) for k in (1, 2, 3)] == [("b", 7, "x"), ("c", 1, None), ("d", 0, "y")]
    assert got[1].sequence_id == got[3].sequence_id != got[2].sequence_id
    again = packing.pack(packed)
    assert again.columns == packed.columns and again.count() == 3


def test_near_copies_with_names_of_its_own(spark):
    text = " ".join(f"word{k}" for k in range(80))
    rows = [(1, text, 5, 6), (2, text + " more", 7, 8), (3, "another text of a few words", 9, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, copy int, _copy int")
    kept = hamming_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


def test_batches_given_in_other_units(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for given, want in (("4m", "4m"), ("64m", str(common.BATCH_BYTES)), ("1g", str(common.BATCH_BYTES))):
            spark.conf.set(name, given)
            common.ship(spark)
            assert spark.conf.get(name) == want
    finally:
        spark.conf.set(name, before)
