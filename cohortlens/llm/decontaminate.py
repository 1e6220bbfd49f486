"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman scores the copies.

1. Test items become word trigrams. A bitmap of their hashes, of fixed size, goes to every task.
2. One pass over the documents keeps the stretches around places where two or more trigrams hit the bitmap within an
   item's length; an item of just three words has one trigram, and one hit on a second bitmap of those is enough. The bitmap only pre-selects: false hits fall away in the next join.
3. Seeds are each item's rarer trigrams: of its trigrams, three quarters with the lowest document frequency. Rarity is
   relative to the item, so a passage that stands in a third of all documents still has seeds.
4. Seeds that agree on an offset (document position minus item position, within half an item) make a candidate.
5. Each candidate's stretch is aligned with the whole item by words: match 2, mismatch -1, gap -1. A document is
   contaminated by an item when the score reaches ``MIN_RATIO`` of a perfect copy's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.lineage import cut

from .blocks import U64, Words, mix, spans, text_blocks
from .joins import sized

GRAM = 3
BITS = 1 << 23
MIN_RATIO = 0.5
MATCH, MISS, GAP = 2, -1, -1
STEP = [U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)]


def gram_hashes(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the trigrams that stay in one text."""
    if len(h) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at = np.flatnonzero(doc[GRAM - 1:] == doc[: len(doc) - GRAM + 1])
    return at, mix(sum((h[at + j] * STEP[j] for j in range(GRAM)), np.zeros(len(at), U64)), 3)


def lists(parts: np.ndarray, kind: pa.DataType, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(parts, kind))


def short(h: np.ndarray) -> np.ndarray:
    """32-bit word codes; 0 and 1 are kept for padding."""
    return np.maximum(h >> U64(32), U64(2)).astype(np.uint32)


def item_table(items: DataFrame) -> DataFrame:
    """(item, item_id, n_words, words, grams) of the items with at least three words; one row for each text of an id, known as item."""

    def run(batches):
        words = Words("alnum", latin=True)
        for rows, raw, at in text_blocks(batches):
            doc, start, end, sums, _ = words(raw, at)
            h = words.hashes(sums, start, end)
            first, g = gram_hashes(h, doc)
            code = short(h)
            edge = np.searchsorted(doc, np.arange(rows.num_rows + 1))
            yield pa.RecordBatch.from_arrays([
                rows.column(0).cast(pa.int64()), pa.array(np.diff(edge).astype(np.int32)), pa.array([code[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary()),
                lists(g.view(np.int64), pa.int64(), np.searchsorted(doc[first], np.arange(rows.num_rows + 1)))], ["item_id", "n_words", "words", "grams"])

    table = items.select("item_id", "text").filter("item_id is not null").mapInArrow(run, "item_id long, n_words int, words binary, grams array<long>")
    return table.filter(F.col("n_words") >= GRAM).dropDuplicates(["item_id", "words"]).withColumn("item", F.xxhash64("item_id", "words"))


def bitmap_of(grams: DataFrame) -> np.ndarray:
    """A bit for each slot that a trigram of the items falls into: at most BITS slots, whatever the size of the benchmark."""
    slots = grams.select(F.pmod("gram", F.lit(BITS)).cast("int").alias("slot")).distinct().toArrow().column(0).to_numpy()
    return np.packbits(np.bincount(slots, minlength=BITS).astype(bool), bitorder="little") if len(slots) else np.zeros(BITS // 8, np.uint8)


def hits_of(bits: np.ndarray, g: np.ndarray) -> np.ndarray:
    slot = (g & U64(BITS - 1)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


def stretches(docs: DataFrame, bitmap: np.ndarray, lone: np.ndarray, reach: int) -> DataFrame:
    """(seg, doc_id, start, words, pos, gram): stretches of documents with at least two bitmap hits close together, or one that is also in ``lone``."""
    shared = docs.sparkSession.sparkContext.broadcast((bitmap, lone))

    def run(batches):
        words, (bits, lone_bits) = Words("alnum", latin=True), shared.value
        for rows, raw, at in text_blocks(batches):
            doc, start, end, sums, _ = words(raw, at)
            h = words.hashes(sums, start, end)
            first, g = gram_hashes(h, doc)
            hit = hits_of(bits, g)
            first, g = first[hit], g[hit]
            if not len(first):
                continue
            d = doc[first]
            new = np.r_[True, (d[1:] != d[:-1]) | (first[1:] - first[:-1] > reach)]
            cluster = np.cumsum(new) - 1
            keep = ((np.bincount(cluster) > 1) | (np.bincount(cluster, hits_of(lone_bits, g)) > 0))[cluster]
            first, g, d, cluster = first[keep], g[keep], d[keep], cluster[keep]
            if not len(first):
                continue
            head = np.flatnonzero(np.r_[True, cluster[1:] != cluster[:-1]])
            tail = np.r_[head[1:], len(first)] - 1
            edge = np.searchsorted(doc, np.arange(rows.num_rows + 1))
            lo = np.maximum(first[head] - reach, edge[d[head]])
            hi = np.minimum(first[tail] + GRAM + reach, edge[d[head] + 1])
            code = short(h)
            parts = [code[a:b].tobytes() for a, b in zip(lo, hi, strict=True)]
            ids = rows.column(0).cast(pa.int64()).take(pa.array(d[head]))
            total = np.r_[U64(0), np.cumsum(mix(h))]
            text = mix(total[edge[d[head] + 1]] - total[edge[d[head]]])
            seg = mix(text ^ mix((lo - edge[d[head]]).astype(U64), 5)) ^ mix(ids.fill_null(-1).to_numpy().astype(np.int64).view(U64), 6)
            yield pa.RecordBatch.from_arrays([
                pa.array(seg.view(np.int64)), ids, pa.array((lo - edge[d[head]]).astype(np.int64)), pa.array(parts, pa.binary()),
                lists((first - np.repeat(lo, tail - head + 1)).astype(np.int32), pa.int32(), np.r_[head, len(first)]), lists(g.view(np.int64), pa.int64(), np.r_[head, len(first)])],
                ["seg", "doc_id", "start", "words", "pos", "gram"])

    return docs.select("doc_id", "text").mapInArrow(run, "seg long, doc_id long, start long, words binary, pos array<int>, gram array<long>")


def align(item: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman of many pairs at once: rows of word codes, padded with 0 (item) and 1 (text).
    Returns best score and the 1-based ends in item and text (the first best)."""
    n, width = text.shape
    h = np.zeros((n, width + 1), np.int32)
    best, at_item, at_text = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    ramp = np.arange(width, dtype=np.int32) * -GAP
    for i in range(item.shape[1]):
        step = np.maximum(h[:, :-1] + np.where(text == item[:, i: i + 1], MATCH, MISS), h[:, 1:] + GAP)
        step = np.maximum.accumulate(np.maximum(step, 0) + ramp, axis=1) - ramp
        h[:, 1:] = step
        j = step.argmax(1)
        s = step[np.arange(n), j]
        better = s > best
        best[better], at_item[better], at_text[better] = s[better], i + 1, j[better] + 1
    return best, at_item, at_text


def padded(parts: list[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((len(parts), max(map(len, parts))), fill, np.uint32)
    for row, p in zip(out, parts, strict=True):
        row[: len(p)] = p
    return out


def contaminated(docs: DataFrame, items: DataFrame, min_ratio: float = MIN_RATIO) -> DataFrame:
    """(doc_id, item_id, ratio, word_start, word_end, n_seeds): one row per document and test item that it copies.

    docs (doc_id, text), items (item_id, text). Words are runs of ASCII letters, digits and other characters than ASCII,
    lower-cased (A-Z and Latin-1). ratio is the alignment score over a perfect copy's, word_start and word_end (exclusive) the
    aligned words of the document; of several copies of an item in one document the best, then the first, is reported.
    Items under three words are skipped; null and empty texts match nothing; repeated rows give one result; a
    null doc_id is kept as null. Every text of items that repeat an id is looked for; the best copy of any is the id's row.
    """
    spark = docs.sparkSession
    table = cut(item_table(items))
    grams = table.select("item", "n_words", F.posexplode("grams").alias("ipos", "gram"))
    reach = int(table.agg(F.max("n_words")).first()[0] or GRAM)
    segments = cut(stretches(docs, bitmap_of(grams), bitmap_of(grams.filter(F.col("n_words") == GRAM)), reach).dropDuplicates(["seg"]))

    hits = segments.select("seg", "doc_id", F.explode(F.arrays_zip("pos", "gram")).alias("hit")).select("seg", "doc_id", "hit.pos", "hit.gram")
    spread = (hits.join(grams.select("gram").distinct(), "gram", "left_semi").select("gram", "doc_id").distinct()
              .groupBy("gram").agg(F.count("*").alias("df")))
    by_rarity = Window.partitionBy("item").orderBy("df", "ipos")  # as many rows as the item has words
    seeds = cut(grams.join(spread, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
                .withColumns({"rank": F.row_number().over(by_rarity), "m": F.count("*").over(Window.partitionBy("item"))})
                .filter(F.col("rank") <= F.ceil(F.col("m") * 0.75)).select("item", "n_words", "gram", "ipos", F.ceil(F.col("m") * 0.75).alias("seeds")))
    half = F.greatest(F.lit(8), F.floor(F.col("n_words") / 2))
    near = (hits.join(seeds, "gram").withColumn("diag", F.col("pos") - F.col("ipos"))
            .withColumn("b", F.explode(F.array(F.floor(F.col("diag") / half), F.floor(F.col("diag") / half) - 1)))
            .groupBy("seg", "item", "b", "ipos").agg(F.min("diag").alias("lo"), F.max("diag").alias("hi"), F.first("n_words").alias("n_words"), F.first("seeds").alias("seeds"))
            .groupBy("seg", "item", "b").agg(F.count("*").alias("n_seeds"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("n_words").alias("n_words"), F.first("seeds").alias("seeds"))
            .filter(F.col("n_seeds") >= F.least(F.lit(2), "seeds")).select("seg", "item", "n_seeds", "lo", "hi", "n_words"))
    pairs = (near.join(segments.select("seg", "doc_id", "start", F.col("words").alias("text_words")), "seg")
             .join(table.select("item", "item_id", "words"), "item")
             .withColumn("pad", F.floor(F.col("n_words") / 4) + 4)
             .withColumn("from", F.greatest(F.lit(0), F.col("lo") - F.col("pad")))
             # only the window travels on: four bytes a word
             .select("doc_id", "item_id", "n_seeds", (F.col("start") + F.col("from")).alias("start"), "words",
                     F.substring(F.col("text_words"), (F.col("from") * 4 + 1).cast("int"), ((F.col("hi") + F.col("n_words") + F.col("pad") - F.col("from")) * 4).cast("int")).alias("window")))

    def run(batches):
        for batch in batches:
            (ri, oi), (rt, ot) = spans(batch.column(4)), spans(batch.column(5))
            item = [np.frombuffer(ri[a:b].tobytes(), np.uint32) for a, b in zip(oi[:-1], oi[1:], strict=True)]
            text = [np.frombuffer(rt[a:b].tobytes(), np.uint32) for a, b in zip(ot[:-1], ot[1:], strict=True)]
            n = len(item)
            ratio, lo, hi = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
            order = np.array(sorted(range(n), key=lambda i: (len(text[i]), len(item[i]))), np.int64)
            at = 0
            while at < n:
                cells, end = 0, at
                while end < n and cells < 1 << 18:  # a few MB at a time
                    cells += len(text[order[end]]) + 1
                    end += 1
                some = order[at:end]
                at = end
                a, b = [item[i] for i in some], [text[i] for i in some]
                best, ei, et = align(padded(a, 0), padded(b, 1))
                ratio[some] = best / (MATCH * np.array([len(x) for x in a]))
                hi[some] = et
                good = np.flatnonzero(ratio[some] >= min_ratio)
                if len(good):  # the same backwards from the end gives the start
                    _, _, back = align(padded([a[k][: ei[k]][::-1] for k in good], 0), padded([b[k][: et[k]][::-1] for k in good], 1))
                    lo[some[good]] = et[good] - back
            keep = ratio >= min_ratio
            start = batch.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ratio), pa.array(start + lo), pa.array(start + hi), batch.column(2)],
                                             ["doc_id", "item_id", "ratio", "word_start", "word_end", "n_seeds"]).filter(pa.array(keep))

    found = pairs.mapInArrow(run, "doc_id long, item_id long, ratio double, word_start long, word_end long, n_seeds long")
    best = F.max(F.struct("ratio", (-F.col("word_start")).alias("first"), "word_end", "n_seeds")).alias("s")
    return (found.groupBy("doc_id", "item_id").agg(best)
            .select("doc_id", "item_id", "s.ratio", (-F.col("s.first")).alias("word_start"), "s.word_end", "s.n_seeds"))


def drop_contaminated(docs: DataFrame, items: DataFrame, min_ratio: float = MIN_RATIO) -> DataFrame:
    """The rows of ``docs`` that copy no test item; rows without doc_id stay unless another row without it copies one."""
    bad = cut(contaminated(docs, items, min_ratio).select(F.col("doc_id").alias("_bad")).distinct())
    kept = docs.alias("d").join(sized(bad).alias("b"), F.col("d.doc_id").eqNullSafe(F.col("b._bad")), "left_anti")
    return kept.select(*[F.col(f"d.`{c}`") for c in docs.columns])
