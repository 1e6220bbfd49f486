"""N-gram Jaccard join: parity sketches, a pigeonhole join per size band, exact verification, components.

Two shingle sets of sizes a <= b reach the similarity t (per cent) only if b * t <= 100 * a and their symmetric
difference is at most D = (a + b) * (100 - t) / (100 + t).

* **Sketch.** Every shingle flips bits in a sketch. A shingle that two documents share flips the same bits in both,
  so the sketches differ in at most as many places as the sets.
* **Pigeonhole per size band.** In a band the sketch is cut into k > D blocks, so two sets within D agree in a whole
  block. A block's bits are read as one 64-bit parity word (the XOR of its shingles' hashes): one row a block, and
  documents meet where (band, block, parity) agree. Blocks without shingles say nothing: k has some to spare, and
  a document with too few filled blocks sends its empty ones as well, which keeps the argument exact.
* **Sketch test.** A narrow bit sketch, about a bit a shingle, is folded to the smaller one's width; pairs whose
  Hamming distance exceeds D go before any set is fetched.
* **Verification** counts common shingles exactly.

Texts with equal sets are one class from the start. A meeting place (bucket) never yields all its pairs: each member
is paired with the bucket's first and with the one before it, and the verified links are joined to components. Buckets that
still hold several components, one of those with the same members and without members whose shingles no other component has, are
compared in place. In a bucket of at most ``FEW`` members the pairs that pass the sketch test go on to verification. In a larger one the members
first meet by chance in cells of that size, which joins most components of a group of near copies, and what is left is compared
tile by tile; cells and tiles verify on the spot, and a spanning forest leaves them.
Sets and classes are known by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.lineage import cut

from .blocks import U64, Words, grouped_order, mix, spans, text_blocks
from .components import components
from .joins import sized

WORDS = 5
PERCENT = 80
TILE, TILE_BYTES = 512, 4 << 20
FEW = 64
SAMPLE = 4096  # classes in which heavy shingles are looked for
STEP = [U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9), U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F),
        U64(0xE7037ED1A0B428DB), U64(0x8EBC6AF09C88C6E3), U64(0x589965CC75374CC3)]


class Bands:
    """Size bands for a similarity: band i holds sizes edge[i] to edge[i+1]-1, and for pairs whose smaller set is in it
    D is at most bound[i]; the sketch has blocks[i] blocks, 0 where D = 0 (only equal sets reach t)."""

    def __init__(self, percent: int):
        edge = [1]
        while edge[-1] < 1 << 40:
            edge.append(max(edge[-1] + 1, edge[-1] * 100 // percent))
        self.edge = np.array(edge, np.int64)
        top = self.edge[1:] - 1
        self.partner = top * 100 // percent  # the largest partner of a set in the band
        self.bound = (top + self.partner) * (100 - percent) // (100 + percent)
        self.blocks = np.where(self.bound > 0, self.bound + 1 + self.bound // 10 + 3, 0)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edge, sizes, "right") - 1


def shingle_sets(words: Words, raw: np.ndarray, at: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(document index, shingle hash), distinct and sorted, of a block of texts."""
    doc, start, end, sums, _ = words(raw, at)
    h = words.hashes(sums, start, end)
    if not len(h):
        return doc, h
    full = np.zeros(0, np.int64)
    if len(h) >= n:
        full = np.flatnonzero(doc[n - 1:] == doc[: len(doc) - n + 1])
    value = np.zeros(len(full), U64)
    for j in range(n):
        value += h[full + j] * STEP[j % len(STEP)] * U64(2 * (j // len(STEP)) + 1)
    value, owner = mix(value, n), doc[full]
    count = np.bincount(doc, minlength=len(at) - 1)
    few = np.flatnonzero((count > 0) & (count < n))  # texts with fewer words: the sequence is the shingle
    if len(few):
        first = np.searchsorted(doc, few)
        short = np.zeros(len(few), U64)
        for j in range(n - 1):
            here = count[few] > j
            short[here] += h[first[here] + j] * STEP[j % len(STEP)] * U64(2 * (j // len(STEP)) + 1)
        value = np.concatenate([value, mix(short + count[few].astype(U64), 0)])
        owner = np.concatenate([owner, few])
    order = grouped_order(owner, value)
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]


def folded_sum(owner: np.ndarray, value: np.ndarray, n: int, reduce) -> np.ndarray:
    """``reduce`` of the values of each document, 0 for documents without any; owner is sorted."""
    out = np.zeros(n, U64)
    if len(owner):
        head = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        out[owner[head]] = reduce.reduceat(value, head)
    return out


def classes_of(owner: np.ndarray, value: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The class of each set: a 64-bit hash of the set, whatever the order of its shingles."""
    a = folded_sum(owner, mix(value, 11), len(size), np.bitwise_xor)
    b = folded_sum(owner, mix(value, 12), len(size), np.add)
    return mix(a ^ mix(b + size.astype(U64) * STEP[0]))


def width_of(size: np.ndarray) -> np.ndarray:
    """Bits of the narrow sketch: a power of two, at least 64 and at least the size."""
    return np.maximum(64, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))


def narrow_sketches(owner: np.ndarray, value: np.ndarray, size: np.ndarray) -> list[bytes]:
    width = width_of(size)
    base = np.r_[0, np.cumsum(width)]
    bit = (mix(value, 21) & (width[owner] - 1).astype(U64)).astype(np.int64) + base[owner]
    parity = (np.bincount(bit, minlength=base[-1]) & 1).astype(np.uint8)
    packed = np.packbits(parity, bitorder="little")
    return [packed[lo // 8: hi // 8].tobytes() for lo, hi in zip(base[:-1], base[1:], strict=True)]


def blocks_of(owner: np.ndarray, value: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, ...]:
    """The blocks of all sketches side by side: (document index, number in the sketch, parity word, is filled)."""
    base = np.r_[0, np.cumsum(k)]
    # blocks are ranges of the hash, and the hashes of a document are sorted
    cell = base[owner] + (((value >> U64(32)) * k[owner].astype(U64)) >> U64(32)).astype(np.int64)
    parity, filled = np.zeros(base[-1], U64), np.zeros(base[-1], bool)
    if len(cell):
        head = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        parity[cell[head]] = np.bitwise_xor.reduceat(mix(value, 31), head)
        filled[cell[head]] = True
    doc = np.repeat(np.arange(len(k)), k)
    return doc, np.arange(base[-1]) - base[doc], parity, filled


def block_rows(owner: np.ndarray, value: np.ndarray, size: np.ndarray, bands: Bands, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document index, signature) of the blocks, in the document's own band and, where a smaller partner can be in the
    band below, in that one as well.

    Shingles in ``heavy`` (sorted) are left out of both sides' sketches, which cannot raise the difference. A document
    left with too few filled blocks also sends the sketch of its whole set, and its empty blocks if that has too few.
    Of two linked documents either one has enough filled blocks, or both send the fuller sketch: they meet.
    A signature has 48 bits, for they are most of what is shuffled; a chance meeting costs one sketch test.
    """
    common = np.zeros(len(value), bool)
    if len(heavy):
        common = heavy[np.minimum(np.searchsorted(heavy, value), len(heavy) - 1)] == value
    own = bands.of(np.maximum(size, 1))
    docs, signs = [], []
    for step in (0, 1):
        band = own - step
        short = (size > 0) & (band >= 0)
        band = np.maximum(band, 0)
        short &= (bands.blocks[band] > 0) & (size <= bands.partner[band])
        for whole in (False, True):
            use = short[owner] & (True if whole else ~common)
            doc, block, parity, filled = blocks_of(owner[use], value[use], np.where(short, bands.blocks[band], 0))
            short = short & (np.bincount(doc[filled], minlength=len(size)) <= bands.bound[band])
            send = filled | short[doc] if whole else filled
            place = band[doc[send]].astype(U64) << U64(42) | block[send].astype(U64) << U64(2) | filled[send].astype(U64) << U64(1) | U64(whole)
            docs.append(doc[send])
            signs.append(mix(parity[send] ^ mix(place, 32)) >> U64(16))
    return np.concatenate(docs), np.concatenate(signs)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def class_table(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, node, sketch): the class of each row's set; node and sketch are null for empty sets."""

    def run(batches):
        words = Words("blank")
        for rows, raw, at in text_blocks(batches):
            owner, value = shingle_sets(words, raw, at, n)
            size = np.bincount(owner, minlength=rows.num_rows)
            node = classes_of(owner, value, size)
            empty = size == 0
            yield pa.RecordBatch.from_arrays([
                rows.column(0).cast(pa.int64()), pa.array(size.astype(np.int64)), pa.array(node.view(np.int64), mask=empty),
                pa.array(narrow_sketches(owner, value, size), pa.binary(), mask=empty)], ["doc_id", "n_shingles", "node", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, node long, sketch binary")


def heavy_shingles(docs: DataFrame, nodes: DataFrame, n: int = WORDS) -> np.ndarray:
    """Shingles in at least three of about ``SAMPLE`` classes, sorted: a hint which shingles would crowd buckets.

    The sample bounds what comes to the driver; results do not depend on it.
    """
    total = nodes.count()
    some = nodes.select("node") if total <= SAMPLE else nodes.select("node").filter(F.col("node") < -(1 << 63) + (1 << 64) * SAMPLE // total)
    sets = sets_of(docs, nodes, some, n)

    def run(batches):
        for batch in batches:
            raw, _ = raw_rows(batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(raw.view(np.int64))], ["shingle"])

    often = sets.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).filter("n >= 3").select("shingle")
    return np.sort(often.toArrow().column(0).to_numpy().astype(np.int64).view(U64))


def signatures(docs: DataFrame, bands: Bands, shared, n: int = WORDS) -> DataFrame:
    """(sign, node) of every class; copies within a task send theirs once. shared: the heavy shingles, broadcast."""

    def run(batches):
        words, seen = Words("blank"), np.zeros(0, U64)
        for rows, raw, at in text_blocks(batches):
            owner, value = shingle_sets(words, raw, at, n)
            size = np.bincount(owner, minlength=rows.num_rows)
            node = classes_of(owner, value, size)
            _, first = np.unique(node, return_index=True)
            fresh = np.zeros(len(node), bool)
            fresh[first] = True
            fresh &= (size > 0) & ~np.isin(node, seen)
            seen = np.concatenate([seen, node[fresh]])
            use = fresh[owner]
            d, sign = block_rows(owner[use], value[use], np.where(fresh, size, 0), bands, shared.value)
            yield pa.RecordBatch.from_arrays([signed(sign), signed(node[d])], ["sign", "node"])

    return docs.select("doc_id", "text").mapInArrow(run, "sign long, node long")


def buckets(rows: DataFrame) -> DataFrame:
    """(sign, node, head, prev) for signatures that several classes share: the bucket's first class and the one before.

    One shuffle and an external sort; the task then walks along the rows and remembers only the bucket it is in,
    so a bucket of any size passes.
    """

    def run(batches):
        sign = head = last = None  # the open bucket
        single = True  # its first row is still held back
        for b in batches:
            s, v = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            if not len(s):
                continue
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (v[1:] != v[:-1])
            s, v = s[new], v[new]
            out_s, out_v, out_h, out_p = [], [], [], []
            if sign is not None and s[0] == sign:
                mine = int(np.searchsorted(s, sign, "right"))
                rest = v[:mine][v[:mine] != head]
                if len(rest):
                    if single:
                        out_s.append(s[:1]), out_v.append(np.array([head])), out_h.append(np.array([head])), out_p.append(np.array([head]))
                        single = False
                    out_s.append(np.full(len(rest), sign)), out_v.append(rest), out_h.append(np.full(len(rest), head)), out_p.append(np.r_[last, rest[:-1]])
                    last = rest[-1]
                s, v = s[mine:], v[mine:]
            if len(s):
                start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
                length = np.diff(np.r_[start, len(s)])
                first = np.repeat(v[start], length)
                many = np.repeat(length > 1, length)
                out_s.append(s[many]), out_v.append(v[many]), out_h.append(first[many]), out_p.append(np.r_[v[0], v[:-1]][many])
                sign, head, last, single = s[-1], v[start[-1]], v[-1], length[-1] == 1
            if out_s:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (out_s, out_v, out_h, out_p)], ["sign", "node", "head", "prev"])

    return rows.repartition("sign").sortWithinPartitions("sign", "node").mapInArrow(run, "sign long, node long, head long, prev long")


def sketch_test(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and narrow sketches allow the similarity."""
    left = nodes.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    right = nodes.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
    fits = (F.col("na") * percent <= F.col("nb") * 100) & (F.col("nb") * percent <= F.col("na") * 100)

    def run(batches):
        for batch in batches:
            na, nb = (batch.column(i).to_numpy() for i in (2, 3))
            keep = np.zeros(len(na), bool)
            (ra, oa), (rb, ob) = raw_rows(batch.column(4)), raw_rows(batch.column(5))
            for i in range(len(na)):
                x, y = ra[oa[i]: oa[i + 1]].view(np.uint64), rb[ob[i]: ob[i + 1]].view(np.uint64)
                while len(x) > len(y):
                    x = x[: len(x) // 2] ^ x[len(x) // 2:]
                while len(y) > len(x):
                    y = y[: len(y) // 2] ^ y[len(y) // 2:]
                keep[i] = int(np.bitwise_count(x ^ y).sum()) * (100 + percent) <= (na[i] + nb[i]) * (100 - percent)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return (pairs.join(left, "a").join(right, "b").filter(fits).select("a", "b", "na", "nb", "sa", "sb")
            .mapInArrow(run, "a long, b long"))


def raw_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without nulls, from 0."""
    raw, at = spans(column)
    return np.ascontiguousarray(raw[at[0]: at[-1]]), at - at[0]


def sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, n: int = WORDS) -> DataFrame:
    """(node, set): the sorted shingle hashes of the wanted classes, made from one text each."""
    ids = cut(nodes.join(wanted, "node", "left_semi").select(F.col("doc_id").alias("_doc"), F.col("node").alias("_node")))
    texts = docs.select("doc_id", "text").join(sized(ids), F.col("doc_id") == F.col("_doc")).select("doc_id", "text", "_node")

    def run(batches):
        words = Words("blank")
        for rows, raw, at in text_blocks(batches):
            owner, value = shingle_sets(words, raw, at, n)
            size = np.bincount(owner, minlength=rows.num_rows)
            right = classes_of(owner, value, size).view(np.int64) == rows.column(2).to_numpy()  # rows may repeat an id
            cut_at = np.r_[0, np.cumsum(size)]
            sets = [value[lo:hi].tobytes() for lo, hi in zip(cut_at[:-1], cut_at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(2), pa.array(sets, pa.binary())], ["node", "shingles"]).filter(pa.array(right))

    return texts.mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose exact similarity reaches the limit, from the sets of their nodes."""
    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            (rx, ox), (ry, oy) = raw_rows(batch.column(2)), raw_rows(batch.column(3))
            for i in range(batch.num_rows):
                x, y = rx[ox[i]: ox[i + 1]].view(np.uint64), ry[oy[i]: oy[i + 1]].view(np.uint64)
                keep[i] = similar(x, y, percent)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def could_link(members: DataFrame, sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The members (node, root, ...) of which enough shingles occur in another component of the members.

    A linked pair shares at least ``percent`` per cent of either set, so a node with more shingles that no
    other component has cannot gain a link. Counts per shingle, no pairs; nodes that go may take others along, so it runs twice.
    """

    def run(batches):
        for batch in batches:
            raw, at = raw_rows(batch.column(1))
            many = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(at) // 8))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(many), batch.column(2).take(many), pa.array(raw.view(np.int64))], ["node", "root", "shingle"])

    for _ in range(2):
        placed = members.select("node", "root").distinct()
        rows = sets.join(placed, "node").select("node", "shingles", "root").mapInArrow(run, "node long, root long, shingle long")
        abroad = rows.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("shingle")
        met = rows.join(abroad, "shingle").groupBy("node").agg(F.count("*").alias("met"))
        able = met.join(nodes.select("node", "n_shingles"), "node").filter(F.col("met") * 100 >= F.col("n_shingles") * percent).select("node")
        members = cut(members.join(sized(cut(able)), "node", "left_semi"))
    return members


def tiled(members: DataFrame) -> DataFrame:
    """(sign, i, j, tile, node, root, n_shingles, sketch): members dealt to pairs of tiles of their bucket.

    The members of a bucket's largest component need not meet one another: they have tiles of their own, which meet only those of the
    other members. A tile has about ``TILE`` members and ``TILE_BYTES`` of shingles.
    """
    by_root = members.groupBy("sign", "root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"))
    big = F.max_by("root", F.struct("n", "root")).alias("big")
    total = by_root.groupBy("sign").agg(big, F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.max("n").alias("n_big"), F.max_by("weight", F.struct("n", "root")).alias("w_big"))
    many = lambda n, w: F.greatest(F.lit(1), F.ceil(n / TILE), F.ceil(w * 8 / TILE_BYTES)).cast("int")
    total = cut(total.select(F.col("sign").alias("_sign"), "big", many(F.col("n") - F.col("n_big"), F.col("weight") - F.col("w_big")).alias("others"), many(F.col("n_big"), F.col("w_big")).alias("bigs")))
    rows = members.join(sized(total), F.col("sign") == F.col("_sign"))
    in_big = F.col("root") == F.col("big")
    tile = F.when(in_big, F.col("others") + F.pmod(F.xxhash64("node"), "bigs")).otherwise(F.pmod(F.xxhash64("node"), "others")).cast("int")
    met = F.sequence(F.lit(0), F.when(in_big, F.col("others")).otherwise(F.col("others") + F.col("bigs")) - 1)
    rows = rows.withColumn("tile", tile)
    meets = F.explode(F.transform(met, lambda o: F.struct(F.least("tile", o).alias("i"), F.greatest("tile", o).alias("j"))))
    return rows.withColumn("m", meets).select("sign", "m.i", "m.j", "tile", "node", "root", "n_shingles", "sketch")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def passing_pairs(t: pa.Table, percent: int):
    """Pairs of rows of ``t``, whole groups (sign, i, j) one after the other, whose sketches allow a link between two components.

    Yields (first row of the group, rows, rows), a bounded number at a time. Sketches are compared with whole-array operations.
    """
    sign, i, j, tile, node, root, size = (t.column(c).to_numpy() for c in ("sign", "i", "j", "tile", "node", "root", "n_shingles"))
    raw, at = raw_rows(t.column("sketch").chunk(0))
    head = np.flatnonzero(np.r_[True, (sign[1:] != sign[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
    for lo, hi in zip(head, np.r_[head[1:], len(sign)], strict=True):
        width = int(np.diff(at[lo: hi + 1]).min()) // 8  # every sketch folds to the narrowest
        folded = np.array([np.bitwise_xor.reduce(raw[at[r]: at[r + 1]].view(np.uint64).reshape(-1, width), axis=0) for r in range(lo, hi)])
        n, r, c = size[lo:hi], root[lo:hi], node[lo:hi]
        left = np.arange(hi - lo) if i[lo] == j[lo] else np.flatnonzero(tile[lo:hi] == i[lo])
        right = left if i[lo] == j[lo] else np.flatnonzero(tile[lo:hi] == j[lo])
        for part in range(0, len(left), 64):  # bounded temporaries
            x = left[part: part + 64]
            apart = np.bitwise_count(folded[x][:, None] ^ folded[right][None]).sum(2, dtype=np.int64)
            nx, ny = n[x][:, None], n[right][None]
            good = ((apart * (100 + percent) <= (nx + ny) * (100 - percent)) & (nx * percent <= ny * 100) & (ny * percent <= nx * 100)
                    & (r[x][:, None] != r[right][None]) & (c[x][:, None] < c[right][None] if i[lo] == j[lo] else True))
            p, q = np.nonzero(good)
            yield lo, lo + x[p], lo + right[q]


def by_group(rows: DataFrame, compared, schema: str) -> DataFrame:
    """``compared`` of tables of whole groups (sign, i, j)."""

    def run(batches):
        held = None  # the group that may go on in the next batch
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            if not t.num_rows:
                continue
            key = [t.column(c).to_numpy() for c in ("sign", "i", "j")]
            last = int(np.flatnonzero(np.any([k != k[-1] for k in key], axis=0)).max(initial=-1)) + 1
            held = t.slice(last)
            if last:
                yield compared(t.slice(0, last).combine_chunks())
        if held is not None and held.num_rows:
            yield compared(held.combine_chunks())

    return rows.repartition("sign", "i", "j").sortWithinPartitions("sign", "i", "j").mapInArrow(run, schema)


def meeting(rows: DataFrame, percent: int) -> DataFrame:
    """The rows of ``tiled`` members that have a partner in their pair of tiles: only these need their sets there."""

    def compared(t: pa.Table) -> pa.RecordBatch:
        keep = np.zeros(t.num_rows, bool)
        for _, a, b in passing_pairs(t, percent):
            keep[a] = keep[b] = True
        return t.filter(pa.array(keep)).combine_chunks().to_batches()[0] if keep.any() else t.to_batches()[0].slice(0, 0)

    return by_group(rows, compared, "sign long, i int, j int, tile int, node long, root long, n_shingles long, sketch binary")


def links_across(members: DataFrame, nodes: DataFrame, sets: DataFrame | None, percent: int) -> DataFrame:
    """Links (a, b) that join different components (root) of the buckets (sign, node, root).

    Each pair of tiles is one bounded group. Sketches are compared first; the members with a partner that passes are compared again with their
    sets: pairs that pass and are not yet joined there are verified on the spot, and a spanning forest of what they join leaves it.
    Without ``sets`` the pairs that pass leave it unverified.
    """
    members = members.select("sign", "node", "root").join(nodes.select("node", "n_shingles", "sketch"), "node")
    rows, verify = tiled(members), sets is not None
    if verify:
        rows = meeting(rows, percent).join(sets, "node")

    def compared(t: pa.Table) -> pa.RecordBatch:
        node, root = t.column("node").to_numpy(), t.column("root").to_numpy()
        shingle, set_at = raw_rows(t.column("shingles").chunk(0)) if verify else (None, None)
        found: list[tuple[int, int]] = []
        group, parent = None, {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        of = lambda k: shingle[set_at[k]: set_at[k + 1]].view(np.uint64)
        for lo, left, right in passing_pairs(t, percent):
            if lo != group:
                group = lo
                parent.clear()
            for a, b in zip(left.tolist(), right.tolist(), strict=True):
                if verify:
                    ra, rb = find(root[a]), find(root[b])
                    if ra == rb or not similar(of(a), of(b), percent):
                        continue
                    parent[ra] = rb
                found.append((min(node[a], node[b]), max(node[a], node[b])))
        return pa.RecordBatch.from_arrays([pa.array(np.array([f[k] for f in found], np.int64)) for k in (0, 1)], ["a", "b"])

    return by_group(rows, compared, "a long, b long")


def with_roots(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` (sign, node) with the root of each node."""
    return members.join(components(links), "node", "left").select("sign", "node", F.coalesce("root", "node").alias("root"))


def open_buckets(placed: DataFrame) -> DataFrame:
    """(sign, rows) of the buckets that hold several components, one of those with the same members."""
    return (placed.groupBy("sign").agg(F.count("*").alias("rows"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("who"))
            .filter("lo <> hi and rows > 2").groupBy("who", "rows").agg(F.min("sign").alias("sign")).select("sign", "rows"))


def neighbours(members: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of each bucket as a star and a chain."""
    near = members.filter("node <> head").select("node", F.explode(F.array("head", "prev")).alias("other"))
    return near.select(F.least("other", "node").alias("a"), F.greatest("other", "node").alias("b")).distinct()


def by_chance(members: DataFrame) -> DataFrame:
    """The members (sign, node, root, rows) dealt to cells of about ``FEW``, each a bucket of its own."""
    cell = F.pmod(F.xxhash64("node"), F.ceil(F.col("rows") / FEW))
    return members.select(F.xxhash64("sign", cell).alias("sign"), "node", "root")


def similarity_classes(docs: DataFrame, percent: int = PERCENT, n: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    A set holds the distinct n-word shingles of the text (A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``); a text with
    fewer words is one shingle; a null, empty or blank text has none and links with nothing. Two rows link when
    100 * intersection >= percent * union; component_id is the smallest doc_id reachable, the row's own included (its
    own doc_id for empty sets). Equal rows and rows that repeat a doc_id are allowed; each gets its own row back.
    A null doc_id is never the smallest, unless all are. Other columns are ignored.
    """
    bands = Bands(percent)
    table = cut(class_table(docs, n))
    nodes = cut(table.filter("node is not null").groupBy("node")
                .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")))
    shared = docs.sparkSession.sparkContext.broadcast(heavy_shingles(docs, nodes, n))
    members = cut(buckets(signatures(docs, bands, shared, n)))

    # every bucket as a chain and a star
    tested = cut(sketch_test(cut(neighbours(members)), nodes, percent))
    sets = cut(sets_of(docs, nodes, tested.select(F.col("a").alias("node")).union(tested.select("b")).distinct(), n))
    links = cut(verified(tested, sets, percent))

    # what still holds several components
    placed = with_roots(members, links)
    rest = cut(placed.join(open_buckets(placed), "sign").select("sign", "node", "root", "rows"))
    sets = cut(sets_of(docs, nodes, rest.select("node").distinct(), n))
    rest = could_link(rest.drop("rows"), sets, nodes, percent)
    crowded = cut(rest.groupBy("sign").agg(F.count("*").alias("rows")).filter(F.col("rows") > FEW))
    # in a bucket of few members a member meets few others: those pairs go to where the sets are, in a larger one the sets come to the tiles
    few = cut(links_across(rest.join(sized(crowded.select("sign")), "sign", "left_anti"), nodes, None, percent).distinct())
    links = links.unionByName(cut(verified(few, sets, percent)))
    if not crowded.isEmpty():
        many = cut(rest.join(sized(crowded), "sign"))
        links = links.unionByName(cut(links_across(by_chance(many), nodes, sets, percent)))
        placed = with_roots(many.select("sign", "node"), links)
        still = placed.groupBy("sign").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("sign")
        links = links.unionByName(cut(links_across(cut(placed.join(still, "sign")), nodes, sets, percent)))

    roots = components(links)
    placed = table.select("doc_id", "n_shingles", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.filter("root is not null").groupBy(F.col("root").alias("_root")).agg(F.min("doc_id").alias("least"))
    return (placed.join(least, F.col("root") == F.col("_root"), "left")
            .select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id")))


def drop_near_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without those whose text is linked, directly or not, with a smaller doc_id.

    Rows that share a doc_id are one document and stay together; a row without doc_id stays.
    """
    gone = similarity_classes(docs, percent).filter(F.col("doc_id") > F.col("component_id")).select(F.col("doc_id").alias("_gone"))
    kept = docs.alias("d").join(sized(cut(gone.distinct())).alias("g"), F.col("d.doc_id") == F.col("g._gone"), "left_anti")
    return kept.select(*[F.col(f"d.`{c}`") for c in docs.columns])
