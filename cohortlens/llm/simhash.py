"""SimHash near-dedup: fingerprints of word shingles, pigeonhole blocks, Hamming verification, components.

A fingerprint is cut into four blocks of 16 bits. Two that differ in at most two bits agree in two whole blocks, so they meet
in one of six buckets, each keyed by two blocks. A bucket of more than ``BUCKET`` fingerprints is not compared: its members, which
agree in those blocks, are cut again in their other bits, four blocks of 8 and then of 4 bits, by the same argument. After
the third cut 8 bits are free, so no bucket holds more than 256 fingerprints and no group of any kind is compared all against all.

Equal fingerprints are one node from the start. A bucket's members are compared in place, and a spanning forest of the pairs
within two bits leaves it: fewer rows than members.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.lineage import cut

from .blocks import Words, text_blocks
from .components import components
from .joins import sized

WORDS, SEED, BITS = 3, 42, 2
BUCKET = 256
BLOCKS = 4


def shingle_hashes(words: Words, raw: np.ndarray, at: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(document index, XXH64) of every word shingle, repeats included: words lower-cased (A-Z), joined by a space."""
    doc, start, end, _, folded = words(raw, at)
    if not len(doc):
        return doc, np.zeros(0, np.uint64)
    size = end - start + 1  # with the space after
    put = np.r_[0, np.cumsum(size)]
    joined = np.full(put[-1], 32, np.uint8)
    inside = np.ones(put[-1], bool)
    inside[put[1:] - 1] = False
    joined[inside] = folded[words.word[folded]]
    # a text's last words begin no shingle, unless it has fewer words than one
    last = np.searchsorted(doc, doc, "right") - 1
    first = np.flatnonzero((np.arange(len(doc)) + n - 1 <= last) | (np.r_[True, doc[1:] != doc[:-1]] & (last - np.arange(len(doc)) < n - 1)))
    lo, hi = put[first].tolist(), (put[np.minimum(first + n - 1, last[first]) + 1] - 1).tolist()
    text, digest = memoryview(joined), xxhash.xxh64_intdigest
    return doc[first], np.fromiter((digest(text[a:b], SEED) for a, b in zip(lo, hi, strict=True)), np.uint64, len(lo))


def majority(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """The fingerprint of each document: a bit is 1 if more than half of its hashes have it."""
    ones, many = np.zeros((n, 64), np.int32), np.bincount(owner, minlength=n)
    for lo in range(0, len(h), 1 << 17):  # bounded temporaries
        own, bits = owner[lo: lo + (1 << 17)], np.unpackbits(h[lo: lo + (1 << 17)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        head = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        ones[own[head]] += np.add.reduceat(bits, head, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > many[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long; 0 for a text without words."""

    def run(batches):
        words = Words("blank")
        for rows, raw, at in text_blocks(batches):
            owner, h = shingle_hashes(words, raw, at, n)
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(majority(owner, h, rows.num_rows).view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def cuts(agreed: int, width: int) -> list[int]:
    """Masks of the bits that two fingerprints which agree in ``agreed`` may agree in as well: two of the four blocks of the rest."""
    free = [b for b in range(64) if not agreed >> b & 1]
    blocks = [sum(1 << b for b in free[i * width: (i + 1) * width]) for i in range(BLOCKS)]
    return [agreed | x | y for x, y in combinations(blocks, BLOCKS - BITS)]


def as_long(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def keyed(rows: DataFrame, width: int) -> DataFrame:
    """(mask, bits, fp) of the next buckets of (mask, fp): one row a cut."""
    known = [0]
    for before in (16, 8)[: (16, 8, 4).index(width)]:
        known = sorted({c for m in known for c in cuts(m, before)})  # some come about in two ways
    long = lambda m: F.lit(as_long(m)).cast("long")
    following = F.create_map(*[x for m in known for x in (long(m), F.array(*[long(c) for c in cuts(m, width)]))])
    return rows.withColumn("mask", F.explode(following[F.col("mask")])).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("bits"), "fp")


def forest(fp: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (child, parent) of a spanning forest of the fingerprints within ``bits`` of each other: breadth first from the smallest."""
    left = np.unique(fp)
    children, parents = [], []
    while len(left):
        wave, left = left[:1], left[1:]
        while len(wave) and len(left):
            apart = np.bitwise_count(wave[:, None] ^ left[None, :])
            near = apart <= bits
            hit = near.any(axis=0)
            children.append(left[hit])
            parents.append(wave[near.argmax(axis=0)[hit]])
            wave, left = left[hit], left[~hit]
    empty = np.zeros(0, fp.dtype)
    return np.concatenate([empty, *children]), np.concatenate([empty, *parents])


def linked(rows: DataFrame) -> DataFrame:
    """Links (a, b) inside the buckets of (mask, bits, fp); a bucket holds few fingerprints, all in one task."""

    def run(batches):
        held = np.zeros((3, 0), np.int64)
        out_a, out_b = [], []

        def close(table: np.ndarray) -> None:
            head = np.flatnonzero(np.r_[True, (table[:2, 1:] != table[:2, :-1]).any(axis=0)])
            tail = np.r_[head[1:], table.shape[1]]
            several = tail - head > 1
            for lo, hi in zip(head[several], tail[several], strict=True):
                child, parent = forest(table[2, lo:hi].view(np.uint64))
                if len(child):
                    out_a.append(child.view(np.int64)), out_b.append(parent.view(np.int64))

        def done():
            batch = pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (out_a, out_b)], ["a", "b"])
            out_a.clear(), out_b.clear()
            return batch

        for batch in batches:
            table = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
            if not table.shape[1]:
                continue
            same = (table[:2] == table[:2, -1:]).all(axis=0)
            last = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            held = np.ascontiguousarray(table[:, last:])
            if last:
                close(np.ascontiguousarray(table[:, :last]))
                yield done()
        if held.shape[1]:
            close(held)
            yield done()

    return rows.repartition("mask", "bits").sortWithinPartitions("mask", "bits", "fp").mapInArrow(run, "a long, b long")


def near_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``nodes`` (fp, distinct) within two bits."""
    rows, found = nodes.select(F.lit(0).cast("long").alias("mask"), "fp"), None
    for width in (16, 8, 4):
        placed = cut(keyed(rows, width))
        if width > 4:
            crowded = cut(placed.groupBy("mask", "bits").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET).select(F.col("mask").alias("_mask"), F.col("bits").alias("_bits")))
            there = (F.col("mask") == F.col("_mask")) & (F.col("bits") == F.col("_bits"))
            small = linked(placed.join(sized(crowded), there, "left_anti"))
            rows = placed.join(sized(crowded), there, "left_semi").select("mask", "fp")
        else:
            small = linked(placed)
        small = cut(small)
        found = small if found is None else found.unionByName(small)
    return found


def simhash_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    Words are ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; a text with fewer than three words is one shingle, one without words (null,
    empty, blank) has fingerprint zero and is linked like any other. Two rows link when their fingerprints differ in at most two
    bits; component_id is the smallest doc_id reachable, the row's own included. Repeated rows and ids each get their row;
    a null doc_id is never the smallest unless all are. Other columns are ignored.
    """
    table = cut(fingerprints(docs))
    nodes = cut(table.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(nodes.select("fp")))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("component"))
    placed = cut(rooted.join(lowest, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "component"))
    text = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return table.join(placed, F.col("fp") == F.col("_fp")).select("doc_id", text.alias("fingerprint"), F.col("component").alias("component_id"))


def drop_similar(docs: DataFrame) -> DataFrame:
    """One document of each class stays, the one with the smallest doc_id; rows that share a doc_id stay together, a row without one stays."""
    gone = simhash_classes(docs).filter(F.col("doc_id") > F.col("component_id")).select(F.col("doc_id").alias("_id"))
    kept = docs.alias("d").join(sized(cut(gone.distinct())).alias("g"), F.col("d.doc_id") == F.col("g._id"), "left_anti")
    return kept.select(*[F.col(f"d.`{c}`") for c in docs.columns])
