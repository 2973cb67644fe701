"""Mixing sources to target weights in fixed-length blocks (operator 11).

Each source's documents, in an order by hash, form one stream of words, cut into blocks of
``BLOCK_WORDS``. The mix is a row of slots, dealt to output shards of ``SHARD_SLOTS``. For each shard
a multinomial draw says how many slots each source gets; where the draws of all shards exceed a
source's number of slots, the last ones go to the sources that fall short, so that the mix holds
every source's target to the word. A source's k-th slot takes the block that a pseudorandom
permutation of its blocks has at place k; each further pass over a source has a permutation of its
own. Slots and blocks are joined by source and block index.

All of it is DataFrame operations. Words are counted where the text is read; everything after that
moves a few numbers per document, piece or slot. Sums over a source run in two steps, within
buckets of about ``BUCKET`` documents and over the buckets, so no task holds a source.

Edge cases: a null text has no words; documents without words are in no block and are taken 0
times; a source without words gets the target 0; a null source is one source, the last in order; rows
that share id and text are dealt as documents of their own; an empty table gives no rows. The result
depends on the rows alone, not on their order or partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentinela.llm.common import stored

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3              # a source's target stops at so many times its size
BLOCK_WORDS = 256
SHARD_SLOTS = 4096
TASK_SLOTS = 8 * SHARD_SLOTS    # made in one task
BUCKET = 4096               # documents whose places are summed in one task
COPIES = 1024               # equal rows dealt as one
ROUNDS = 24                 # of the permutation
SEED = 11

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def documents_by_size(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    """(source, doc_id, content, size, chunk, copies): equal rows as one, of at most ``COPIES``.

    ``content`` is a hash of the text. A row with very many copies becomes several chunks.
    """
    text = F.col(text_column).cast("string")
    rows = docs.select(
        F.col(source_column).cast("string").alias("source"), F.col(id_column).cast("long").alias("doc_id"),
        F.xxhash64(text).alias("content"), word_count(text).alias("size"))
    equal = rows.groupBy(*rows.columns).agg(F.count("*").alias("_rows"))
    last = F.floor((F.col("_rows") - 1) / COPIES)
    return equal.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn(
        "copies", F.least(F.lit(COPIES), F.col("_rows") - F.col("chunk") * COPIES)).drop("_rows")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """(source, source_size, weight): by code point with null last, weights repeating.

    Sorted by range; a source's rank is its place in its partition after the partitions before.
    """
    by_source = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    place = F.monotonically_increasing_id()
    ordered = stored(by_source.orderBy(F.col("source").asc_nulls_last()).select(
        "*", F.shiftright(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("place")),
        "mix-sources")
    # One row per partition of the sort, however many sources there are.
    parts = ordered.groupBy("part").agg(F.count("*").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rank = (F.col("place") + F.col("before")) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank + 1).cast("int"))
    return ordered.join(before, "part").select("source", "source_size", weight.alias("weight"))


def source_targets(sources: DataFrame) -> DataFrame:
    """Add ``target``: shares of all words by weight, stopped at ``MOST_TIMES`` the source's size.

    What the stopped ones leave is shared again among the others. A round needs three sums; a
    share only grows, so a source once stopped remains so.
    """
    cap = F.col("source_size") * MOST_TIMES
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    share, stopped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(share) > cap
        now, fixed, weights = sources.agg(
            F.count_if(over), F.sum(F.when(over, cap).otherwise(0)),
            F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        if now == stopped or not weights:
            break
        share, stopped = (total - fixed) / weights, now
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(share), cap.cast("double")))


def source_budgets(sources: DataFrame) -> DataFrame:
    """Add how many words and slots each source gets, and its ``low``..``high`` range of all slots.

    ``blocks`` counts its full blocks; the shorter block of what remains comes last in every pass.
    """
    words = F.floor(F.col("target") + 0.5)
    known = sources.where("source_size > 0").withColumn("words", words).withColumns({
        "blocks": F.floor(F.col("source_size") / BLOCK_WORDS),
        "pass_slots": F.ceil(F.col("source_size") / BLOCK_WORDS),
        "passes": F.floor(F.col("words") / F.col("source_size"))})
    rest = F.col("words") - F.col("passes") * F.col("source_size")
    known = known.withColumn("slots", F.col("passes") * F.col("pass_slots") + F.ceil(rest / BLOCK_WORDS))
    # Running sum in two steps: sources by hash into groups, then over the groups.
    groups = known.withColumn("_group", F.pmod(F.xxhash64("source", F.lit(SEED)), F.lit(1024)))
    inner = Window.partitionBy("_group").orderBy("source")
    totals = groups.groupBy("_group").agg(F.sum("slots").alias("n"))
    before = totals.select("_group", (F.sum("n").over(Window.orderBy("_group")) - F.col("n")).alias("_before"))
    return groups.withColumn("high", F.sum("slots").over(inner)).join(before, "_group").withColumns({
        "high": F.col("high") + F.col("_before"),
        "low": F.col("high") + F.col("_before") - F.col("slots")}).drop("_group", "_before")


def drawn_counts(budgets: DataFrame, slots: int) -> DataFrame:
    """(shard, source, count, first): the slots of each shard by source, from multinomial draws.

    Every slot draws a number below ``slots``, and the source whose range holds it. ``first`` is
    how many slots of the source the shards before have.
    """
    spark = budgets.sparkSession
    step = SHARD_SLOTS
    numbers = spark.range(slots).select(
        F.floor(F.col("id") / SHARD_SLOTS).alias("shard"),
        F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(slots)).alias("drawn"))
    ranges = budgets.where("slots > 0").select(
        "source", "low", "high",
        F.explode(F.sequence(F.floor(F.col("low") / step), F.floor((F.col("high") - 1) / step))).alias("cell"))
    draws = (numbers.withColumn("cell", F.floor(F.col("drawn") / step)).join(ranges, "cell")
             .where("low <= drawn and drawn < high").groupBy("shard", "source").agg(F.count("*").alias("drawn")))
    own = budgets.select(F.col("source").alias("_source"), "slots")
    before = Window.partitionBy("source").orderBy("shard")
    # What a source's earlier shards have drawn bounds what this one may keep.
    draws = stored(
        draws.withColumn("before", F.sum("drawn").over(before) - F.col("drawn"))
        .join(own, F.col("source").eqNullSafe(F.col("_source"))).select(
            "shard", "source", "drawn",
            F.greatest(F.lit(0), F.least("drawn", F.col("slots") - F.col("before"))).alias("count")),
        "mix-draws")
    return _completed(draws, budgets)


def _completed(draws: DataFrame, budgets: DataFrame) -> DataFrame:
    """Give the slots drawn beyond a source's budget to the sources that fall short."""
    free = draws.groupBy("shard").agg(F.sum(F.col("drawn") - F.col("count")).alias("n")).where("n > 0")
    got = draws.groupBy(F.col("source").alias("_source")).agg(F.sum("count").alias("got"))
    missing = budgets.join(got, F.col("source").eqNullSafe(F.col("_source")), "left").select(
        "source", (F.col("slots") - F.coalesce("got", F.lit(0))).alias("n")).where("n > 0")

    def units(rows: DataFrame, key: str) -> DataFrame:
        """One row per slot free or missing, numbered through."""
        grouped = rows.withColumn("_group", F.pmod(F.xxhash64(key, F.lit(SEED)), F.lit(1024)))
        totals = grouped.groupBy("_group").agg(F.sum("n").alias("_all"))
        before = totals.select(
            "_group", (F.sum("_all").over(Window.orderBy("_group")) - F.col("_all")).alias("_before"))
        start = F.sum("n").over(Window.partitionBy("_group").orderBy(key)) - F.col("n")
        return grouped.withColumn("_start", start).join(before, "_group").select(
            key, F.explode(F.sequence(F.col("_before") + F.col("_start"),
                                      F.col("_before") + F.col("_start") + F.col("n") - 1)).alias("unit"))

    moved = units(free, "shard").join(units(missing, "source"), "unit").select(
        "shard", "source", F.lit(1).cast("long").alias("count"))
    both = draws.select("shard", "source", "count").unionByName(moved).groupBy("shard", "source").agg(
        F.sum("count").alias("count")).where("count > 0")
    before = Window.partitionBy("source").orderBy("shard")
    return both.withColumn("first", F.sum("count").over(before) - F.col("count"))


def permuted(place: Column, count: Column, key: Column) -> Column:
    """The place that a pseudorandom permutation of ``count`` places, chosen by ``key``, gives.

    Swap-or-not shuffle: a round pairs each place x with (k - x) mod count, and one bit of a hash of
    the pair says whether both change places.
    """
    def step(x: Column, turn: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, turn), count) - x, count)
        swap = F.xxhash64(key, turn, F.greatest(x, partner)).bitwiseAND(1) == 1
        return F.when(swap, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), place, step)


def mix_slots(counts: DataFrame, budgets: DataFrame, slots: int) -> DataFrame:
    """(shard, place, source, pass, block, words): which block each slot holds and how much of it.

    A few counts become many slots, so the shards are dealt by the number of slots, not by bytes.
    """
    counts = counts.repartition(max(1, math.ceil(slots / TASK_SLOTS)), "shard")
    own = budgets.select(F.col("source").alias("_source"), "source_size", "blocks", "pass_slots",
                         F.col("words").alias("_words"))
    dealt = counts.join(own, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "k", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)))
    dealt = dealt.withColumn("pass", F.floor(F.col("k") / F.col("pass_slots"))).withColumn(
        "nth", F.col("k") - F.col("pass") * F.col("pass_slots"))
    full = F.col("nth") < F.col("blocks")
    block = F.when(full, permuted(
        F.col("nth"), F.greatest("blocks", F.lit(1)), F.xxhash64(F.lit(SEED), "source", "pass")
    )).otherwise(F.col("blocks"))
    left = F.col("_words") - F.col("pass") * F.col("source_size") - F.col("nth") * BLOCK_WORDS
    length = F.when(full, F.lit(BLOCK_WORDS)).otherwise(F.col("source_size") - F.col("blocks") * BLOCK_WORDS)
    # A shard has at most SHARD_SLOTS slots, in an order of its own.
    order = Window.partitionBy("shard").orderBy(F.xxhash64("source", "k"), "source", "k")
    return dealt.select(
        "shard", (F.row_number().over(order) - 1).alias("place"), "source", "pass",
        block.alias("block"), F.least(length, left).alias("words"))


def placed_documents(sizes: DataFrame, sources: DataFrame, buckets: int) -> DataFrame:
    """Add ``start``, where the words of the row's first copy lie in its source's stream, and the
    source's figures. Within a source, buckets follow each other, and documents in them by hash."""
    rows = sizes.withColumn("bucket", F.pmod(
        F.xxhash64("doc_id", "content", "chunk", F.lit(SEED)), F.lit(buckets)))
    words = F.col("size") * F.col("copies")
    totals = rows.groupBy("source", "bucket").agg(F.sum(words).alias("n"))
    begin = F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")
    own = sources.select(F.col("source").alias("_source"), "source_size", "target")
    begins = totals.withColumn("begin", begin).join(
        own, F.col("source").eqNullSafe(F.col("_source"))).select(
        F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), "begin", "source_size", "target")
    order = Window.partitionBy("source", "bucket").orderBy("doc_id", "content", "size", "chunk")
    return (rows.withColumn("within", F.sum(words).over(order) - words)
            .join(begins, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
            .select("source", "doc_id", "content", "size", "copies", "source_size", "target",
                    (F.col("begin") + F.col("within")).alias("start")))


def document_copies(placed: DataFrame) -> DataFrame:
    """One row per input row again."""
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    return placed.withColumn("_copy", copy).withColumn(
        "start", F.col("start") + F.col("_copy") * F.col("size")).drop("_copy", "copies")


def block_pieces(copies: DataFrame) -> DataFrame:
    """(source, block, at, doc_id, content, start, first_word, n_words): what blocks are made of.

    ``at`` is the piece's place in its block, ``first_word`` its first word's place in the document.
    """
    end = F.col("start") + F.col("size")
    cut = copies.where("size > 0").withColumn("block", F.explode(F.sequence(
        F.floor(F.col("start") / BLOCK_WORDS), F.floor((end - 1) / BLOCK_WORDS))))
    low = F.greatest("start", F.col("block") * BLOCK_WORDS)
    high = F.least(end, (F.col("block") + 1) * BLOCK_WORDS)
    return cut.select(
        "source", "block", (low - F.col("block") * BLOCK_WORDS).alias("at"), "doc_id", "content", "start",
        (low - F.col("start")).alias("first_word"), (high - low).alias("n_words"))


def mix_sources(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
                source_column: str = "source") -> tuple[DataFrame, DataFrame]:
    """The documents with their source's figures, and the mix as pieces of documents.

    Documents: ``doc_id, source, content, size, source_size, target, start``. Mix: ``shard, place,
    at, source, pass, block, doc_id, content, start, first_word, n_words``, a row for each
    document of each slot; by shard, place and at it is the mixed text (``mixed_texts``).
    """
    sizes = stored(documents_by_size(docs, id_column, text_column, source_column), "mix-sizes")
    sources = stored(source_targets(stored(ranked_sources(sizes), "mix-ranks")), "mix-targets")
    buckets = max(1, math.ceil(sizes.count() / BUCKET))
    copies = stored(document_copies(placed_documents(sizes, sources, buckets)), "mix-documents")
    budgets = stored(source_budgets(sources), "mix-budgets")
    slots = budgets.agg(F.sum("slots")).first()[0] or 0
    dealt = mix_slots(drawn_counts(budgets, max(1, slots)), budgets, slots).alias("slot")
    pieces = block_pieces(copies).alias("piece")
    # The last slot of a source may take only the beginning of its block.
    taken = F.least("piece.n_words", F.col("slot.words") - F.col("piece.at"))
    mix = dealt.join(
        pieces, F.col("slot.source").eqNullSafe(F.col("piece.source"))
        & (F.col("slot.block") == F.col("piece.block"))).where("piece.at < slot.words").select(
        "shard", "place", "at", "slot.source", "pass", "slot.block", "doc_id", "content", "start",
        "first_word", taken.alias("n_words"))
    return copies, mix


def mixed_texts(mix: DataFrame, docs: DataFrame, *, id_column: str = "doc_id",
                text_column: str = "text") -> DataFrame:
    """Add ``text`` to pieces of the mix: their words with a space between."""
    text = F.col(text_column).cast("string")
    texts = docs.select(F.col(id_column).cast("long").alias("_id"), F.xxhash64(text).alias("_content"),
                        text.alias("_text")).groupBy("_id", "_content").agg(F.first("_text").alias("_text"))
    words = F.regexp_extract_all("_text", F.lit(WORD), F.lit(0))
    own = F.slice(words, (F.col("first_word") + 1).cast("int"), F.col("n_words").cast("int"))
    return mix.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("content") == F.col("_content"))
                    ).withColumn("text", F.array_join(own, " ")).drop("_id", "_content", "_text")


def words_taken(copies: DataFrame, mix: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken``: one row per document."""
    taken = mix.groupBy(F.col("source").alias("_source"), F.col("start").alias("_start")).agg(
        F.sum("n_words").alias("_taken"))
    # Documents without words begin where the next one does.
    return copies.join(
        taken, F.col("source").eqNullSafe(F.col("_source")) & (F.col("start") == F.col("_start"))
        & (F.col("size") > 0), "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))
