"""Quotations looked up in all texts of a corpus.

Short ones are looked for by an Aho-Corasick automaton, one pass over each text for
all of them. A long one is looked up by the rarest of its runs of six words: two
passes over the texts, in each of which a bitmap decides which runs are of use, so that
only matching runs, and texts that have one, are moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_ws, quote_fragments, quote_matches

#: Words in a run, and words of a needle that is looked up by runs: its first and last can be parts of a text's words, those between are whole.
RUN, LONG = 6, 8
#: Characters of needles in one automaton (each takes some tens of bytes in a task); bits of a bitmap for each run, at least and at
#: most (32 MB); digests (8 bytes each) up to which what passes the bitmap is compared exactly before it is moved.
AUTOMATON_CHARS, BITS_EACH, LEAST_BITS, MOST_BITS, EXACT = 4_000_000, 256, 2**16, 2**28, 1_000_000


def _runs(words: Column, first: Column | int, count: Column) -> Column:
    """Digests of `count` runs of RUN words from the place `first` (from 1)."""
    digest = lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(RUN)), " "))
    none = F.array().cast("array<bigint>")
    return F.when(count > 0, F.transform(F.sequence(F.lit(first), F.lit(first) + count - 1), digest)).otherwise(none)


def needles(quotes: DataFrame, key: str, quote: str) -> DataFrame:
    """(key, n, needles, long): the normalised quotation, what must be in a text (it, or its fragments if ellipses part them), and the words of the longest needle if it is long."""
    n = norm_ws(quote)
    rows = quotes.where(F.col(quote).isNotNull()).select(F.col(key).alias("key"), n.alias("n"))
    parts = quote_fragments(F.col("n"))
    rows = rows.withColumn("needles", F.when(F.size(parts) <= 1, F.array("n")).otherwise(parts))
    words = F.transform("needles", lambda x: F.split(x, " "))
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.size(w).alias("size"), w.alias("w"))))
    return rows.withColumn("__l", longest).withColumn("long", F.when(F.col("__l.size") >= LONG, F.col("__l.w"))).drop("__l")


def _short(short: DataFrame, sources: DataFrame, chars: int) -> DataFrame:
    """(key, source) by automata: as many passes as parts of `chars` characters that the needles are cut into."""
    short = short.select("key", "needles").checkpoint()
    spark, kind, of = short.sparkSession, short.schema["key"].dataType, sources.schema["source"].dataType.simpleString()
    size = F.sum(F.aggregate("needles", F.lit(0).cast("long"), lambda a, x: a + F.length(x)))
    total = short.agg(size).first()[0]
    found = spark.createDataFrame([], f"key {kind.simpleString()}, source {of}")
    if total is None:
        return found
    parts = max(1, -(-2 * total // chars))  # so that no part is likely to have more, and each is checked
    dealt = short.withColumn("part", F.pmod(F.xxhash64("needles"), F.lit(parts)))
    for part in range(parts):
        rows = dealt.where(F.col("part") == part).select("key", "needles")
        if parts > 1 and (rows.agg(size).first()[0] or 0) > 2 * chars:
            raise ValueError(f"needles of more than {2 * chars} characters are one part; set a larger limit")
        given = spark.sparkContext.broadcast([(r["key"], r["needles"]) for r in rows.collect()])  # of checked size

        def look(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton, number = ahocorasick.Automaton(), {}
            wanted = []
            for key, own in given.value:
                own = list(dict.fromkeys(x for x in own if x))
                for x in own:
                    if number.setdefault(x, len(number)) == len(number) - 1 and x not in automaton:
                        automaton.add_word(x, number[x])
                wanted.append((key, [number[x] for x in own]))
            if number:
                automaton.make_automaton()
            always = [key for key, own in wanted if not own]  # an empty quotation is in every text
            single: dict[int, list] = {}
            several: dict[int, list[int]] = {}
            for i, (key, own) in enumerate(wanted):
                if len(own) == 1:
                    single.setdefault(own[0], []).append(key)
                elif own:
                    several.setdefault(own[0], []).append(i)
            key_kind = pa.array([key for key, _ in given.value]).type if given.value else pa.null()
            for batch in batches:
                source, text = batch.column("source"), batch.column("h")
                keys, rows = [], []
                for row in range(batch.num_rows):
                    seen = {number for _, number in automaton.iter(text[row].as_py())} if number else set()
                    own = list(always)
                    for x in seen:
                        own += single.get(x, ())
                        own += [wanted[i][0] for i in several.get(x, ()) if all(y in seen for y in wanted[i][1])]
                    keys += own
                    rows += [row] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(keys, key_kind), source.take(pa.array(rows, pa.int64()))], names=["key", "source"])

        found = found.unionByName(sources.select("source", "h").mapInArrow(look, f"key {kind.simpleString()}, source {of}"))
    return found


def _kept_runs(sources: DataFrame, runs: DataFrame, texts: bool) -> DataFrame:
    """(source, h if texts, hits): the texts' runs whose bit is set in a bitmap of the digests `runs` (g), for texts that have any.

    The bitmap is sized by their number; where it is too small for them, and they are too many to be given to each task, more pass, never fewer.
    """
    spark, of = sources.sparkSession, sources.schema["source"].dataType.simpleString()
    n = runs.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * n).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("g").to_numpy(zero_copy_only=False) & (bits - 1)
            word, inverse = np.unique(at >> 6, return_inverse=True)
            value = np.zeros(len(word), np.int64)
            np.bitwise_or.at(value, inverse, np.left_shift(np.int64(1), at & 63))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value)], names=["word", "value"])

    marked = runs.select("g").mapInArrow(places, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toPandas()  # bits / 64 rows at most
    bitmap = np.zeros(bits >> 6, np.int64)
    bitmap[marked["word"].to_numpy()] = marked["value"].to_numpy()
    exact = np.sort(runs.select("g").toPandas()["g"].to_numpy()) if 0 < n <= EXACT else None
    shared = spark.sparkContext.broadcast((bitmap, exact))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, exact = shared.value
        for batch in batches:
            runs = batch.column("runs")
            flat, offsets = runs.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(np.array([len(x) for x in runs], np.int64))))
            at = flat & (bits - 1)
            hit = (given[at >> 6] >> (at & 63)) & 1 == 1
            if exact is not None:
                few = np.nonzero(hit)[0]
                hit[few] = exact[np.minimum(np.searchsorted(exact, flat[few]), n - 1)] == flat[few]
            upto = np.concatenate(([0], np.cumsum(hit)))[offsets]
            lists = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(flat[hit], pa.int64()))
            some = pa.array(np.diff(upto) > 0)
            columns = [batch.column(c) for c in batch.schema.names if c != "runs"]
            out = pa.RecordBatch.from_arrays([*columns, lists], names=[c for c in batch.schema.names if c != "runs"] + ["hits"])
            yield out.filter(some)

    words = sources.select("source", "h", F.split("h", " ").alias("w"))
    every = F.array_distinct(_runs(F.col("w"), 1, F.size("w") - (RUN - 1)))
    columns = ["source", *(["h"] if texts else [])]
    return words.select(*columns, every.alias("runs")).mapInArrow(keep, f"source {of}, {'h string, ' if texts else ''}hits array<bigint>")


def quote_pairs(quotes: DataFrame, sources: DataFrame, key: str, source: str, quote: str = "quote", text: str = "text", chars: int = AUTOMATON_CHARS) -> DataFrame:
    """(key, source): the texts that hold a quotation, whole or, if ellipses part it, all its fragments in any order; each pair once.

    Both are normalised (quotes, dashes, white space). Null quotations and null
    texts are in no pair; an empty quotation is in every text. Each text is read once for the short quotations, unless these are more
    than `chars` characters, and twice for the long ones.
    """
    q = needles(quotes, key, quote).dropDuplicates(["key", "n"]).checkpoint()
    docs = sources.where(F.col(text).isNotNull()).select(F.col(source).alias("source"), norm_ws(text).alias("h"))
    out = _short(q.where(F.col("long").isNull()), docs, chars)
    long = q.where(F.col("long").isNotNull()).withColumn("runs", _runs(F.col("long"), 2, F.size("long") - (RUN + 1)))
    runs = long.select(F.explode("runs").alias("g")).distinct().checkpoint()
    if runs.limit(1).count():
        # how many texts have each run of a quotation; sums by run leave a task
        seen = _kept_runs(docs, runs, False).select(F.explode("hits").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("k"))
        placed = long.select("key", "n", F.posexplode("runs").alias("at", "g")).join(seen, F.col("g") == F.col("h"), "left")
        # a run that no text has rules its quotation out
        best = placed.groupBy("key", "n").agg(F.min(F.struct(F.coalesce("k", F.lit(0)).alias("k"), "at", "g")).alias("best"))
        chosen = best.where("best.k > 0").select("key", "n", F.col("best.g").alias("g")).checkpoint()
        hits = _kept_runs(docs, chosen.select("g").distinct(), True).select("source", "h", F.explode("hits").alias("__g"))
        met = hits.join(chosen, F.col("__g") == F.col("g")).where(quote_matches("n", "h"))
        out = out.unionByName(met.select("key", "source"))
    return out.distinct().withColumnsRenamed({"key": key, "source": source})
