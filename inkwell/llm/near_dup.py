"""Near-duplicate documents by improved consistent weighted sampling (ICWS) over TF-IDF-weighted word shingles.

1. The document frequencies of all shingles of five words are counted into a sketch of fixed size; its excess over the mean
   load of a bucket gives a shingle's document frequency, and 1 + ln((N + 1) / (df + 1)) / ln(N + 1) its weight per use.
2. Each text gets ICWS samples (Ioffe 2010).  A light text's are all drawn from its whole list of shingles.  In a heavier
   one each round deals the uses of shingles into bins anew and draws one sample per bin, so a use costs a draw per round,
   not per sample; an empty bin borrows from the next that has any.  Texts between SHORT and SHORT / least get both, as
   the lighter of two similar texts weighs at least ``least`` of the other: every similar pair has samples of one kind.
3. Samples are banded; texts that share a band's key are candidates.  All pairs of a small bucket are compared.  In a
   larger one all members are compared with a few leaders; then, wherever it still holds several components, the members
   outside the most common one with a few leaders of that one, as long as there are many and this joins many of them; and
   at last the members still outside with all members of other components.  So every pair of different texts that shares a
   bucket is either compared or already in one class.  That last comparison runs in blocks of members, and only links that
   join components leave it.
4. Pairs are verified on whole texts: weighted Jaccard similarity of at least 0.8.  The text of a leader goes once to each
   block of the members that are compared with it.
5. Classes are the connected components, found by minimum labels and pointer jumping over the verified pairs.

Exact copies are one node from the start (128-bit hash of the text), so groups of copies cost a row each.  Keys with many
rows (a bucket, a leader, a label, the text of many copies) are dealt to several tasks in every join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.text import Scratch, Words, chunks, dealt_join, hot_keys, mixed, quoted, saved, tidied

SHINGLE, SIMILARITY = 5, 0.8
BINS, ROUNDS, BANDS, ROWS = 8, 15, 24, 5  # BINS * ROUNDS == BANDS * ROWS
#: Texts of a weight up to SHORT / least have samples of the whole text; those of SHORT or more have samples by bins.
SHORT = 200.0
#: Buckets of the document-frequency sketch (log2), and its slices.
SKETCH_BITS, SLICES = 22, 64
#: Buckets with up to as many members have all their pairs compared.
SMALL = 16
#: Leaders of a large bucket; rounds go on while they leave at most this share of the outsiders.
LEADERS, WORTHWHILE = 4, 0.5
#: So few comparisons of outsiders with members are done in blocks at once, without rounds of leaders before.
FEW_COMPARISONS = 50_000_000
#: Outsiders and members of a block (about).
BLOCK_OUTSIDE, BLOCK_MEMBERS = 32, 128
#: Blocks of outsiders of a bucket (about) that meet all its members in one task.
BLOCKS_AT_ONCE = 4
#: Members (about) that are compared with a leader in one block.
HUB_MEMBERS = 256
#: Bits of a filter of nodes (log2): it is broadcast as at most 2^18 rows of 64, however many nodes there are.
FILTER_BITS = 24

_GRAM_BITS = np.uint64(48)


def shingles(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, 48-bit shingle hash, uses), sorted by text and hash; a text of fewer words is one shingle of all its words."""
    words = Words(texts)
    grams, at = words.grams(size)
    doc = words.doc[at]
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            more = count[short] > j
            own[more] = mixed(own[more] + words.hash[words.first[short[more]] + j] + np.uint64(j + 1))
        grams, doc = np.concatenate([grams, own]), np.concatenate([doc, short])
    key = (doc.astype(np.uint64) << _GRAM_BITS) | (grams >> np.uint64(16))
    key, uses = np.unique(key, return_counts=True)
    return (key >> _GRAM_BITS).astype(np.int64), key & np.uint64((1 << 48) - 1), uses


def _bucket(gram: np.ndarray) -> np.ndarray:
    return (mixed(gram + np.uint64(0x51ED)) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _uniform(bits: np.ndarray) -> np.ndarray:
    return (bits.astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-32)


def icws(doc: np.ndarray, gram: np.ndarray, weight: np.ndarray, n: int, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """(n, BINS * ROUNDS) samples, ``bins`` a round; and which texts have any shingle.  Input sorted by text."""
    rounds = BINS * ROUNDS // bins
    out = np.zeros((n, rounds, bins), np.uint64)
    has = np.zeros((n, rounds, bins), bool)
    if len(doc):
        log_w = np.log(weight).astype(np.float32)
        low = np.uint64(0xFFFFFFFF)
        half = np.uint64(32)
        small = np.min_scalar_type(n * bins)  # 16 bits are sorted by radix
        for r in range(rounds):
            a = mixed(gram + np.uint64((2 * r + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            b = mixed(a ^ np.uint64(0xA0761D6478BD642F))
            c = mixed(b ^ np.uint64(0xE7037ED1A0B428DB))
            rate = -np.log(_uniform(a & low) * _uniform(a >> half))  # Gamma(2, 1)
            scale = np.log(-np.log(_uniform(b & low) * _uniform(b >> half)))  # log of Gamma(2, 1)
            beta = _uniform(c & low)
            t = np.floor(log_w / rate + beta)
            score = scale - rate * (t - beta + 1)
            cell, order = doc, None
            if bins > 1:  # dealt anew each round, so that a shingle of one text alone cannot spoil the same bin every time
                cell = doc * bins + ((c >> half) * np.uint64(bins) >> half).astype(np.int64)
                order = np.argsort(cell.astype(small), kind="stable")
                cell, score = cell[order], score[order]
            start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            least = np.repeat(np.minimum.reduceat(score, start), np.diff(np.append(start, len(cell))))
            hit = np.flatnonzero(score == least)
            first = hit[np.searchsorted(hit, start)]
            first = first if order is None else order[first]
            d, k = np.divmod(cell[start], bins)
            out[d, r, k] = mixed(gram[first] ^ (t[first].astype(np.int64).view(np.uint64) * np.uint64(0x9FB21C651E98DF25)))
            has[d, r, k] = True
    filled = has.copy()
    for step in range(1, bins):
        need = ~filled & np.roll(has, -step, axis=2)
        if need.any():
            d, r, b = np.nonzero(need)
            out[d, r, b] = mixed(out[d, r, (b + step) % bins] + np.uint64(step))
            filled |= need
    return out.reshape(n, rounds * bins), has.any(axis=(1, 2))


def band_keys(samples: np.ndarray, first: int = 1) -> np.ndarray:
    """(n, BANDS) keys, each of ROWS samples and the band's number (from ``first`` on)."""
    parts = samples.reshape(len(samples), BANDS, ROWS)
    key = np.broadcast_to(np.arange(first, first + BANDS, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key


def text_bands(doc: np.ndarray, gram: np.ndarray, uses: np.ndarray, weight: np.ndarray, n: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The keys of n texts, one text after another, and how many each has: BANDS, or twice as many between the two kinds.
    ``weight`` is that of a single use."""
    total = np.bincount(doc, uses * weight, minlength=n)
    # the margin is for sums of floats; texts at it have both kinds
    kinds = np.stack([(total > 0) & (total * least <= SHORT * (1 + 1e-6)), total >= SHORT * (1 - 1e-6)], axis=1)
    keys = np.zeros((n, 2, BANDS), np.uint64)
    for i, bins in enumerate((1, BINS)):
        own = np.flatnonzero(kinds[:, i])
        if len(own):
            mine = np.flatnonzero(kinds[doc, i])
            many, name = uses[mine], gram[mine]
            if bins > 1:  # each use apart, weighing 1 to 2: a shingle of many uses would lie in one bin and a rare one fill another
                mine = np.repeat(mine, many)
                nth = np.arange(len(mine)) - np.repeat(np.cumsum(many) - many, many)
                name, many = np.where(nth > 0, mixed(gram[mine] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), gram[mine]), 1
            keys[own, i] = band_keys(icws(np.searchsorted(own, doc[mine]), name, many * weight[mine], len(own), bins)[0], 1 + i * BANDS)
    return keys[kinds].ravel(), kinds.sum(axis=1) * BANDS


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted (shingle, weight) lists."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    both = np.minimum(a[1][same], b[1][at[same]]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


class Weights:
    """Shingle weights per use, in steps of 1/255 between 1 and 2, by sketch bucket."""

    def __init__(self, counts: np.ndarray, n: int) -> None:
        self.step = np.empty(len(counts), np.uint8)
        load, size = counts.sum() / len(counts), 1 << 16
        for at in range(0, len(counts), size):
            df = np.maximum(1.0, counts[at : at + size] - load)
            self.step[at : at + size] = np.round(255 * np.clip(np.log((n + 1) / (df + 1)) / np.log(max(n, 2) + 1), 0, 1))

    def of(self, gram: np.ndarray) -> np.ndarray:
        return 1 + self.step[_bucket(gram)] / np.float32(255)


def _nodes_and_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    return docs.select(F.col(quoted(id_col)).alias("id"), F.unhex(F.md5(text)).alias("node"), text.alias("text"))


def shingle_weights(docs: DataFrame, text_col: str = "text") -> Weights:
    """Count document frequencies over all documents.  Slices of the sketch are summed apart; A few MB come to the driver."""
    source = docs.select(F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text"))
    size = 1 << SKETCH_BITS
    each = size // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(size, np.int32), 0
        for batch in batches:
            for _, texts in chunks(batch, "text"):
                _, gram, _ = shingles(texts)
                np.add.at(counts, _bucket(gram), 1)
                n += len(texts)
        if n:
            blobs = [pa.compress(counts[i * each : (i + 1) * each].tobytes(), codec="zstd", asbytes=True) for i in range(SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(blobs, pa.binary()), pa.array([n] + [0] * (SLICES - 1), pa.int64())], names=["slice", "counts", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        n: dict[int, int] = {}
        for batch in batches:
            for i, blob, m in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                part = np.frombuffer(pa.decompress(blob, decompressed_size=4 * each, codec="zstd", asbytes=True), np.int32)
                total[i] = total[i] + part if i in total else part.astype(np.int64)
                n[i] = n.get(i, 0) + m
        if total:
            blobs = [pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(blobs, pa.binary()), pa.array([n[i] for i in total], pa.int64())], names=["slice", "counts", "n"])

    schema = "slice int, counts binary, n bigint"
    rows = source.mapInArrow(tidied(count), schema).repartitionById(SLICES, F.col("slice")).mapInArrow(add, schema).collect()
    counts = np.zeros(size, np.int64)
    for r in rows:
        counts[r[0] * each : (r[0] + 1) * each] = np.frombuffer(pa.decompress(r[1], decompressed_size=8 * each, codec="zstd", asbytes=True), np.int64)
    return Weights(counts, sum(r[2] for r in rows))


def signatures(docs: DataFrame, weights, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(id, node, bands) of every document; no bands for a text without words."""
    source = _nodes_and_texts(docs, id_col, text_col)
    schema = T.StructType([source.schema["id"], T.StructField("node", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: Weights = weights.value
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                doc, gram, uses = shingles(texts)
                keys, count = text_bands(doc, gram, uses, table.of(gram), len(texts), least)
                offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["id", "node", "bands"])

    return source.mapInArrow(tidied(run), schema)


def verified(pairs: DataFrame, texts: DataFrame, weights, least: float, scratch: Scratch) -> DataFrame:
    """The saved pairs (a, b) of nodes whose texts are similar enough.  ``lead`` tells that b may be in many pairs, not a.

    The members of a leader's pairs are dealt to blocks; rows are sorted so that each block's leader comes before them.
    """
    sides = pairs.select(F.when(F.col("lead"), F.col("b")).otherwise(F.col("a")).alias("hub"), F.when(F.col("lead"), F.col("a")).otherwise(F.col("b")).alias("node"))
    many = scratch.saved(sides.groupBy("hub").agg(F.count("*").alias("__n")).where(F.col("__n") > HUB_MEMBERS), "hubs")
    blocks = many.select("hub", F.ceil(F.col("__n") / HUB_MEMBERS).alias("blocks"))
    placed = dealt_join(sides, blocks, "hub", "left", counts=many).select("hub", "node", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).alias("block"))
    placed = scratch.saved(placed, "placed")
    heads = scratch.saved(placed.select("hub", "block").distinct(), "heads")
    first = dealt_join(heads, texts.select(F.col("node").alias("hub"), "text"), "hub").select("hub", "block", F.lit(False).alias("member"), F.col("hub").alias("node"), "text")
    rest = placed.join(texts.select("node", "text"), "node").select("hub", "block", F.lit(True).alias("member"), "node", "text")
    rows = first.union(rest).repartition("hub", "block").sortWithinPartitions("hub", "block", "member").select("member", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: Weights = weights.value
        hub, its = b"", (np.empty(0), np.empty(0))
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                doc, gram, uses = shingles(texts)
                weight = uses * table.of(gram)
                cut = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
                links: list[tuple[bytes, bytes]] = []
                for member, node, i, j in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), cut[:-1], cut[1:], strict=True):
                    if not member:
                        hub, its = node, (gram[i:j].copy(), weight[i:j].copy())
                    elif similarity(its, (gram[i:j], weight[i:j])) >= least - 1e-9:
                        links.append((min(hub, node), max(hub, node)))
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(tidied(run), "a binary, b binary")


def _linked_in_blocks(rows: DataFrame, texts: DataFrame, weights, least: float) -> DataFrame:
    """Links (a, b) between the members (key, node, label, most) of a key with a label other than ``most`` and all members
    of other labels.  Blocks of members meet blocks of outsiders; a row is one pair of blocks, and of the links in it those
    are given that join labels which no link before them has joined."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("m"), F.sum((F.col("label") != F.col("most")).cast("long")).alias("f"))
    full = dealt_join(rows, sizes, "key").join(texts.select("node", "text"), "node").withColumn("h", F.xxhash64("node", F.lit("block")))
    member = F.struct("node", "label", "text")
    outside = full.where(F.col("label") != F.col("most")).groupBy("key", F.pmod("h", F.ceil(F.col("f") / BLOCK_OUTSIDE)).alias("i")).agg(F.collect_list(member).alias("xs"))
    members = full.groupBy("key", F.pmod("h", F.ceil(F.col("m") / BLOCK_MEMBERS)).alias("j")).agg(F.collect_list(member).alias("ys"))
    met = dealt_join(outside, members, "key", number=F.col("i"), least=BLOCKS_AT_ONCE).select("xs", "ys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: Weights = weights.value
        for batch in batches:
            for xs, ys in zip(batch.column(0), batch.column(1), strict=True):
                xs, ys = xs.as_py(), ys.as_py()
                doc, gram, uses = shingles([m["text"].encode() for m in (*xs, *ys)])
                weight = uses * table.of(gram)
                total = np.bincount(doc, weight, minlength=len(xs) + len(ys))
                names, place = np.unique(gram, return_inverse=True)
                split = int(np.searchsorted(doc, len(xs)))
                doc_y, place_y, weight_y, total_y = doc[split:] - len(xs), place[split:], weight[split:], total[len(xs) :]
                links: list[tuple[bytes, bytes]] = []
                joined: dict[bytes, bytes] = {}

                def root(label: bytes, joined=joined) -> bytes:
                    while (up := joined.get(label, label)) != label:
                        label = up
                    return label

                own = np.zeros(len(names))
                for i, x in enumerate(xs):
                    a, b = np.searchsorted(doc, (i, i + 1))
                    own[place[a:b]] = weight[a:b]
                    both = np.bincount(doc_y, np.minimum(weight_y, own[place_y]), minlength=len(ys))
                    own[place[a:b]] = 0
                    for j in np.flatnonzero(both >= (least - 1e-9) * (total[i] + total_y - both)).tolist():
                        mine, theirs = root(x["label"]), root(ys[j]["label"])
                        if mine != theirs and both[j] > 0:
                            joined[mine] = theirs
                            links.append((min(x["node"], ys[j]["node"]), max(x["node"], ys[j]["node"])))
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return met.mapInArrow(tidied(run), "a binary, b binary").distinct()


def components(edges: DataFrame, saved: Callable[[DataFrame, str], DataFrame] = saved) -> DataFrame:
    """(node, label) for every node of the edges (a, b): the least node of its component.

    Each round takes the least label among a node's neighbours and then its label's label; rounds are written to the shared
    folder, so a lost executor costs no more than a round.
    """
    both = saved(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    hot = hot_keys(both, "b")
    while True:
        near = dealt_join(both, labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b", hot=hot).groupBy(F.col("a").alias("node")).agg(F.min("l").alias("m"))
        step = saved(labels.join(near, "node", "left").select("node", "label", F.least("label", "m").alias("next")), "steps")
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("jumped"))
        step = saved(dealt_join(step, jump, "next", "left").select("node", "label", F.least("next", "jumped").alias("next")), "labels")
        more = step.where(F.col("next") != F.col("label")).limit(1).count()
        labels = step.select("node", F.col("next").alias("label"))
        if not more:
            return labels


def _leaders(seed: int = 0) -> Column:
    """A few members of each group, picked by hash."""
    return F.array_distinct(F.array(*[F.min_by("node", F.xxhash64("node", F.lit(i), F.lit(seed))) for i in range(LEADERS)])).alias("leaders")


def _among(rows: DataFrame, nodes: DataFrame, there: bool = True) -> DataFrame:
    """Rows whose node may be (``there=False``: is surely not) among ``nodes``.

    The filter has 2^FILTER_BITS bits, whatever the number of nodes; of N nodes' hashes it lets about N / 2^FILTER_BITS of
    the other rows through, so beyond some ten millions of nodes it turns few away.
    """
    place = F.pmod(F.xxhash64("node"), F.lit(1 << FILTER_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    words = nodes.select(F.floor(place / 64).alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    found = rows.withColumn("__word", F.floor(place / 64)).join(F.broadcast(words), "__word", "left_outer")
    may = F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))
    return found.where(may if there else ~may).select(*rows.columns)


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(id, node) of every document, and (node, label, class_id, class_size, copies) of every different text.

    ``label`` names the class; ``class_id`` is its least id (null if all are), ``class_size`` its number of documents, and
    ``copies`` that of the text.
    """
    weights = docs.sparkSession.sparkContext.broadcast(shingle_weights(docs, text_col))  # 4 MB whatever the data
    signed = saved(signatures(docs, weights, id_col, text_col, least), "signatures")
    with Scratch(docs.sparkSession) as scratch:
        nodes = scratch.saved(signed.groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "nodes")
        keyed = nodes.select("node", F.explode("bands").alias("key"))
        shared = scratch.saved(keyed.groupBy("key").agg(F.count("*").alias("n"), _leaders()).where("n > 1"), "buckets")
        members = scratch.saved(dealt_join(keyed, shared, "key", counts=shared.select("key", F.col("n").alias("__n")), number=F.xxhash64("node")), "members")

        small = members.where(F.col("n") <= SMALL).select("key", "node")
        pairs = small.select("key", F.col("node").alias("a")).join(small.select("key", F.col("node").alias("b")), "key").where("a < b").select("a", "b", F.lit(False).alias("lead"))
        stars = members.where(F.col("n") > SMALL).select("node", F.explode("leaders").alias("y")).where("node <> y")
        tested = scratch.saved(_distinct(pairs.union(_oriented(stars.withColumnRenamed("node", "x")))), "pairs")
        taking_part = members.select("node").distinct()
        texts = _among(_nodes_and_texts(docs, id_col, text_col), taking_part).groupBy("node").agg(F.min("text").alias("text"))
        texts = scratch.saved(texts, "texts")
        edges = scratch.saved(verified(tested, texts, weights, least, scratch), "links")
        labels = components(edges, scratch.saved)

        large = members.where(F.col("n") > SMALL).select("key", "node")
        before = None
        while True:
            named = scratch.saved(large.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")), "named")
            counts = named.groupBy("key", "label").agg(F.count("*").alias("c"))
            several = counts.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("most"), F.count("*").alias("m"), F.sum("c").alias("__n")).where("m > 1")
            several = scratch.saved(several, "several")
            open_ = scratch.saved(dealt_join(named, several.select("key", "most"), "key", counts=several.select("key", "__n")), "open")
            outside = open_.where(F.col("label") != F.col("most")).select("key", F.col("node").alias("x"), F.col("label").alias("lx"))
            sizes = open_.groupBy("key").agg(F.count("*").alias("m"), F.sum((F.col("label") != F.col("most")).cast("long")).alias("f"))
            left, work = sizes.agg(F.coalesce(F.sum("f"), F.lit(0)), F.coalesce(F.sum(F.col("f") * F.col("m")), F.lit(0))).first()
            if not left:
                break
            last = work <= FEW_COMPARISONS or before is not None and left > WORTHWHILE * before
            before = left
            if last:
                found = scratch.saved(_linked_in_blocks(open_, texts, weights, least), "links")
            else:
                inside = open_.where(F.col("label") == F.col("most")).groupBy("key").agg(_leaders(left))
                leaders = inside.select("key", F.explode("leaders").alias("y"))
                more = _distinct(_oriented(dealt_join(outside, leaders, "key", number=F.xxhash64("x"))))
                more = scratch.saved(more.join(tested, ["a", "b"], "left_anti"), "pairs")
                found = scratch.saved(verified(more, texts, weights, least, scratch), "links")
                tested = tested.union(more)
            if found.limit(1).count():
                edges = edges.union(found)
                labels = components(edges, scratch.saved)
            if last:
                break

        labelled = scratch.saved(nodes.select("node", "id", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
        groups = labelled.groupBy("label").agg(F.min("id").alias("class_id"), F.sum("copies").alias("class_size"))
        result = saved(dealt_join(labelled.select("node", "label", "copies"), groups, "label").select("node", "label", "class_id", "class_size", "copies"), "classes")
    return signed.select("id", "node"), result


def _oriented(rows: DataFrame) -> DataFrame:
    """Members x and leaders y as pairs."""
    return rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.col("y") > F.col("x")).alias("lead"))


def _distinct(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.max("lead").alias("lead"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row per document: ``id_col``, ``class_id``, ``class_size``.

    Documents are similar if the weighted Jaccard similarity of their shingles of five words (A-Z lower-cased; a text of
    one to four words is one shingle) is at least ``least``; classes are the connected components, exact copies included.
    A null text counts as empty; texts without words are in a class only with their exact copies.  Repeated rows count as
    copies.  Every document of a class has the same ``class_id``, its least id.
    """
    rows, found = classes(docs, id_col=id_col, text_col=text_col, least=least)
    return dealt_join(rows, found, "node", counts=_copies(found)).select(F.col("id").alias(id_col), "class_id", "class_size")


def _copies(found: DataFrame) -> DataFrame:
    return found.select("node", F.col("copies").alias("__n"))


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The documents, all columns as they are, with one of each class: that with its least id.

    Classes are those of ``near_duplicates``.  Of repeated rows one stays; a null id is the least only where all are null;
    an empty table gives an empty one; columns of any name are passed on.  Documents in no class stay where they lie; those
    that may be in one by a filter of fixed size (see ``_among``) are shuffled.
    """
    _, found = classes(docs, id_col=id_col, text_col=text_col, least=least)
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), F.col(quoted(id_col)).alias("id"), F.unhex(F.md5(text)).alias("node"))
    groups = saved(found.where("class_size > 1").select("node", "label", "class_id", "copies"), "groups")
    alone = _among(rows, groups, False).select("row.*")
    maybe = _among(rows, groups)
    named = dealt_join(maybe, groups.drop("copies"), "node", "left", counts=_copies(groups), number=F.xxhash64("id"))
    unique = named.where(F.col("label").isNull()).select("row.*")
    first = named.where(F.col("label").isNotNull() & F.col("id").eqNullSafe(F.col("class_id"))).groupBy("label").agg(F.first("row").alias("row")).select("row.*")
    return alone.unionByName(unique).unionByName(first)
