"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint has one or more 64-bit words; bit b is set where more than half of a text's
shingle hashes have it set. Candidates meet in blocks: for a small radius all pairs of four
16-bit parts of the fingerprint (two differing bits leave two parts whole, so no link is
lost), else bands of minima of the shingle hashes. Inside the blocks of a task the bit planes
of all rows lie vertically, 64 rows to a machine word. Row i is compared with row i + d for
all i at once: planes are combined three at a time by carry-save adders and counted in
bit-sliced counters, and a machine word is abandoned once all its rows exceed the radius.
Each task returns a spanning forest of its links; components follow by contraction in Spark.

The pipeline stage takes such links as candidates only. The documents of one candidate component
meet again with their shingle sets, and pairs within the radius are linked where the Jaccard
similarity of the sets is exactly 0.8 or more; only links that passed count as joined.

A block above ``BLOCK`` rows is cut into parts of about that size that meet pairwise, so one
huge block is spread over many tasks and still compared whole. Equal fingerprints are one row
before anything is compared, so copies cost nothing.

Cases: null and empty texts have fingerprint zero and link like any other; a null id is never
a component's id unless no other is there; repeated rows share their component; an empty table
gives no rows; extra columns pass by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from topicloom.llm.common import fresh, slices, small_batches
from topicloom.operators.components import connected_components
from topicloom.scratch import materialize
from topicloom.skew import hot_join

SEED = 42
#: The registered query: three words, 64 bits, radius 2.
WIDTH, WORDS, RADIUS = 3, 1, 2
#: The pipeline stage: five words, 256 bits. Jaccard similarity 0.8 means 39 differing bits on
#: average, with a spread of about 6, so the radius of the candidates loses none but by rare chance.
NEAR_WIDTH, NEAR_WORDS, NEAR_RADIUS = 5, 4, 64
#: Least Jaccard similarity of a link of the stage, as a fraction.
NEAR_LEAST = (4, 5)
#: Bands of minima: at similarity 0.8 a pair shares one of them in 99.98 % of the cases.
BANDS, PER_BAND = 12, 3
BLOCK = 16_384
#: Rows that a task gathers, block by block, before it compares them.
GATHER = 100_000
#: Shingles of a part of a block, and of the rows that a task gathers.
SHINGLES = 4_000_000
#: Shifts after which blocks that have become one component are looked for.
SETTLE = 32
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` lower-cased words, repeats included."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n
    )


def majority(hashes: np.ndarray, words: int) -> np.ndarray:
    """Fingerprint words: bits set in over half of the hashes; none: zero."""
    counts = np.zeros(64 * words, np.int64)
    for i in range(0, len(hashes), 255):
        part = hashes[i : i + 255]
        wide = np.stack([part] + [_mix(part + np.uint64(w)) for w in range(1, words)], axis=1)
        bits = np.unpackbits(wide.astype("<u8").view(np.uint8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key per band, from minima of the hashes under different multipliers."""
    factors = _mix(np.arange(1, BANDS * PER_BAND + 1, dtype=np.uint64)) | np.uint64(1)
    low = np.full(len(factors), ALL)
    for i in range(0, len(hashes), 4096):
        low = np.minimum(low, (hashes[i : i + 4096, None] * factors).min(axis=0))
    keys = np.arange(BANDS, dtype=np.uint64)
    for j in range(PER_BAND):
        keys = _mix(keys ^ low.reshape(BANDS, PER_BAND)[:, j])
    return keys


def fingerprints(docs: DataFrame, width: int, words: int, bands: bool) -> DataFrame:
    """doc_id, text_hash, words (array<long>), keys (array<long>, bands or null), node.

    With bands, repeats of a shingle don't count, and the node stands for the set of shingles.
    """
    import xxhash

    kind = docs.schema["doc_id"].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                prints, keys, nodes = [], [], []
                for text in part.column(2).cast(pa.binary()).to_pylist():
                    hashes = shingle_hashes(text, width)
                    if bands:
                        hashes = np.unique(hashes)
                        nodes.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))
                    prints.append(majority(hashes, words).view(np.int64))
                    keys.append(band_keys(hashes).view(np.int64) if bands else None)
                    if not bands:
                        nodes.append(int(prints[-1].view(np.uint64)[0]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(prints, pa.list_(pa.int64())),
                     pa.array(keys, pa.list_(pa.int64())), pa.array(np.array(nodes, np.uint64).view(np.int64))],
                    names=["doc_id", "text_hash", "words", "keys", "node"],
                )

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), text).mapInArrow(
        run, f"doc_id {kind}, text_hash long, words array<bigint>, keys array<bigint>, node long"
    )


def shingle_sets(rows: DataFrame, width: int) -> DataFrame:
    """node, words, keys, shingles (distinct and sorted) of rows with a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 3):
                sets = [
                    np.unique(shingle_hashes(text, width).view(np.int64))
                    for text in part.column(3).cast(pa.binary()).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(sets, pa.list_(pa.int64()))],
                    names=["node", "words", "keys", "shingles"],
                )

    return rows.select("node", "words", "keys", "text").mapInArrow(
        run, "node long, words array<bigint>, keys array<bigint>, shingles array<bigint>"
    )


class Alike:
    """Exact check of pairs of rows: Jaccard similarity of their sorted sets, least or more."""

    def __init__(self, values: np.ndarray, lengths: np.ndarray, least: tuple[int, int]):
        known, ids = np.unique(values, return_inverse=True)
        self.least, self.lengths, self.base = least, lengths, max(1, len(known))
        self.starts = np.cumsum(lengths) - lengths
        self.ids = ids
        # Rows ascend and each set is sorted, so these are sorted.
        self.placed = np.repeat(np.arange(len(lengths)), lengths) * self.base + ids

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        part, whole = self.least
        swap = self.lengths[a] > self.lengths[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        few, many = self.lengths[a], self.lengths[b]
        good = few * whole >= many * part
        todo = np.flatnonzero(good & (few > 0))
        upto = np.cumsum(few[todo])
        start = 0
        while start < len(todo):
            before = upto[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(upto, before + (1 << 20), side="right")))
            some = todo[start:end]
            n = few[some]
            first = np.cumsum(n) - n
            at = np.arange(n.sum()) + np.repeat(self.starts[a[some]] - first, n)
            wanted = np.repeat(b[some], n) * self.base + self.ids[at]
            place = np.minimum(np.searchsorted(self.placed, wanted), len(self.placed) - 1)
            both = np.add.reduceat((self.placed[place] == wanted).astype(np.int64), first)
            good[some] = both * whole >= part * (n + many[some] - both)
            start = end
        return good


class Links:
    """Running spanning forest: every row points to the smallest row it is linked with."""

    def __init__(self, n: int):
        self.low = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        low = self.low
        while len(a):
            ra, rb = low[a], low[b]
            differ = ra != rb
            a, b = np.minimum(ra, rb)[differ], np.maximum(ra, rb)[differ]
            np.minimum.at(low, b, a)
            while not np.array_equal(low, up := low[low]):
                low[:] = up


def _shifted(plane: np.ndarray, at: np.ndarray, d: int) -> np.ndarray:
    """Words ``at`` of a plane moved down by d rows."""
    q, r = divmod(d, 64)
    low = plane[at + q]
    if not r:
        return low
    return (low >> np.uint64(r)) | (plane[at + q + 1] << np.uint64(64 - r))


def _count(counter: list[np.ndarray], level: int, carry: np.ndarray) -> None:
    """Add a plane of weight 2 ** level to bit-sliced counters; the last one saturates."""
    for i in range(level, len(counter) - 1):
        counter[i], carry = counter[i] ^ carry, counter[i] & carry
    counter[-1] |= carry


def _above(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Rows whose counter exceeds the radius; the last plane means it surely does."""
    above, equal = counter[-1].copy(), ~counter[-1]
    for i in range(len(counter) - 2, -1, -1):
        if radius >> i & 1:
            equal &= counter[i]
        else:
            above |= equal & counter[i]
            equal &= ~counter[i]
    return above


def compare(keys: np.ndarray, prints: np.ndarray, radius: int, alike: Alike | None = None) -> np.ndarray:
    """Forest of links between rows of equal key, rows sorted by key; prints is n x words.

    Pairs that earlier links have joined already are not compared again. Pairs within the
    radius that ``alike`` refuses are no links.
    """
    n = len(keys)
    links = Links(n)
    change = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    size = np.repeat(np.diff(change), np.diff(change))
    first = np.repeat(change[:-1], np.diff(change))
    left = np.repeat(change[1:], np.diff(change)) - np.arange(n)  # rows of the block from here
    longest = int(size.max(initial=1))
    # Planes of all bits; zero words at the end serve the shifts.
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    padded = np.zeros((bits.shape[1], (n // 64 + longest // 64 + 3) * 64), np.uint8)
    padded[:, :n] = bits.T
    planes = np.packbits(padded, axis=1, bitorder="little").view("<u8")
    steps = max(1, (radius + 1).bit_length()) + 1
    words = np.arange((n + 63) // 64)
    for d in range(1, longest):
        if d % SETTLE == 0:
            # A block whose rows are all linked already has nothing more to tell.
            whole = np.logical_and.reduceat(links.low == first, change[:-1])
            left[np.repeat(whole, np.diff(change))] = 0
            if left.max() <= d:
                break
        lanes = np.zeros(len(words) * 64, np.uint8)
        lanes[: n - d] = (left[: n - d] > d) & (links.low[: n - d] != links.low[d:])
        alive = np.packbits(lanes, bitorder="little").view("<u8")
        at = np.flatnonzero(alive)
        if not len(at):
            continue
        alive = alive[at]
        counter = [np.zeros(len(at), np.uint64) for _ in range(steps)]
        group = 0
        for p in range(0, len(planes), 3):
            x, *rest = (planes[i][at] ^ _shifted(planes[i], at, d) for i in range(p, min(p + 3, len(planes))))
            y = rest[0] if rest else np.zeros_like(x)
            z = rest[1] if len(rest) > 1 else np.zeros_like(x)
            half = x ^ y
            _count(counter, 0, half ^ z)
            _count(counter, 1, (x & y) | (half & z))
            group += 1
            if group % 4 == 0 or p + 3 >= len(planes):
                alive &= ~_above(counter, radius)
                going = alive != 0
                if not going.all():
                    at, alive = at[going], alive[going]
                    counter = [c[going] for c in counter]
                    if not len(at):
                        break
        if len(at):
            lane = np.unpackbits(alive.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            word, bit = np.nonzero(lane)
            row = at[word] * 64 + bit
            if alike is not None:
                row = row[alike(row, row + d)]
            links.add(row, row + d)
    return links.low


def _compare_blocks(radius: int, words: int, least: tuple[int, int] | None = None):
    """Task over rows (key, node, words[, shingles]) sorted by key: links as (a, b)."""
    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        keys, nodes = table.column(0).to_numpy(), table.column(1).to_numpy()
        flat = np.concatenate([c.flatten().to_numpy() for c in table.column(2).chunks])
        alike = None
        if least is not None:
            values = np.concatenate([c.flatten().to_numpy() for c in table.column(3).chunks])
            alike = Alike(values, pc.list_value_length(table.column(3)).to_numpy().astype(np.int64), least)
        low = compare(keys, flat.view(np.uint64).reshape(-1, words), radius, alike)
        linked = np.flatnonzero(low != np.arange(len(low)))
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes[linked]), pa.array(nodes[low[linked]])], names=["a", "b"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, shingles = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if least is not None:
                shingles += len(batch.column(3).flatten())
            if n < GATHER and shingles < SHINGLES:
                continue
            # All but the last block, which may go on in the next batch.
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield flush(table.slice(0, cut).to_batches())
                held = table.slice(cut).to_batches()
                n = len(keys) - cut
                shingles = sum(len(b.column(3).flatten()) for b in held) if least is not None else 0
        if held:
            yield flush(held)

    return run


def links(
    rows: DataFrame, radius: int, words: int, block: int = BLOCK, least: tuple[int, int] | None = None
) -> DataFrame:
    """Written (a, b) links between the nodes of ``rows``: node, words, keys.

    With ``least`` rows have sorted shingles too, whose Jaccard similarity decides.
    """
    sets = ["shingles"] if least is not None else []
    dealt = materialize(
        rows.select(F.explode("keys").alias("key"), "node", "words", *sets), "simhash-blocks"
    )
    # Blocks of one row have no pair, large ones are cut into parts that meet pairwise.
    weight = F.sum(F.size("shingles")) / SHINGLES if sets else F.lit(0)
    sizes = dealt.groupBy("key").agg(
        F.count("*").alias("_n"), F.ceil(F.greatest(F.count("*") / block, weight)).alias("_parts")
    ).filter("_n > 1")
    part = F.pmod(F.xxhash64("node"), F.col("_parts"))
    parts = dealt.join(sizes, "key").withColumn("_part", part).withColumn(
        "_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))
    )
    met = F.when(F.col("_parts") == 1, F.col("key")).otherwise(
        F.xxhash64("key", F.least("_part", "_other"), F.greatest("_part", "_other"))
    )
    ready = parts.select(met.alias("key"), "node", "words", *sets)
    ready = ready.repartition("key").sortWithinPartitions("key")
    found = ready.mapInArrow(_compare_blocks(radius, words, least), "a long, b long")
    return materialize(found, "simhash-links")


def _pigeon_keys(word):
    """Keys of a 64-bit word: each pair of its four 16-bit parts, marked with the pair."""
    parts = [F.shiftrightunsigned(word, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i)]
    return F.array(*[
        F.shiftleft(F.lit(n).cast("long"), 32).bitwiseOR(F.shiftleft(parts[i], 16)).bitwiseOR(parts[j])
        for n, (i, j) in enumerate(pairs)
    ])


def _grouped(edges: DataFrame) -> DataFrame:
    """node, component of the linked nodes."""
    edges = edges.select(F.lit(0).alias("graph"), "a", "b")
    nodes = edges.select("graph", F.col("a").alias("node")).union(
        edges.select("graph", F.col("b").alias("node"))
    ).distinct()
    return connected_components(nodes, edges, "graph").select("node", "component")


def _checked(
    docs: DataFrame, kinds: DataFrame, grouped: DataFrame, width: int, words: int, radius: int, block: int
) -> DataFrame:
    """Links (a, b) inside candidate components between sets of shingles that are alike."""
    candidates = kinds.join(grouped, "node").select(
        "node", "words", F.array("component").alias("keys"), F.col("low.doc_id").alias("_id"),
        F.col("low.text_hash").alias("_hash"),
    )
    candidates = materialize(candidates, "simhash-candidates")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), text)
    # One text stands for all copies, so no text is hot here.
    same = rows["doc_id"].eqNullSafe(candidates["_id"]) & (rows["text_hash"] == candidates["_hash"])
    texts = rows.join(candidates, same).dropDuplicates(["node"])
    return links(shingle_sets(texts, width), radius, words, block, NEAR_LEAST)


def components(
    docs: DataFrame, width: int = WIDTH, words: int = WORDS, radius: int = RADIUS, block: int = BLOCK
) -> DataFrame:
    """doc_id, text_hash, fingerprint, component_id, first: one row per document.

    ``first`` tells the document of each component that has its smallest id (then text hash).
    """
    exact = words == 1 and radius <= 2
    if words == 1 and not exact:
        raise ValueError("a radius above 2 needs more than one word")
    found = materialize(fingerprints(docs, width, words, bands=not exact), "simhash-prints")
    lowest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    if exact:
        kinds = found.groupBy("node").agg(lowest.alias("low")).withColumn("words", F.array("node"))
        kinds = kinds.withColumn("keys", _pigeon_keys(F.col("node")))
    else:
        # Equal sets of shingles have equal fingerprints and bands.
        kinds = found.groupBy("node").agg(
            lowest.alias("low"), F.min("words").alias("words"), F.min("keys").alias("keys")
        )
    kinds = materialize(kinds, "simhash-kinds")
    grouped = _grouped(links(kinds, radius, words, block))
    if not exact:
        grouped = _grouped(_checked(docs, kinds, grouped, width, words, radius, block))
    joined = kinds.select("node", "low").join(grouped, "node", "left")
    joined = materialize(joined, "simhash-joined")
    alone = joined.filter("component is null").select("node", F.col("low").alias("best"))
    linked = materialize(joined.filter("component is not null"), "simhash-linked")
    best = linked.groupBy("component").agg(F.min("low").alias("best"))
    # A component may hold a third of all rows.
    classes = alone.union(hot_join(linked, best, ["component"]).select("node", "best"))
    hexed = F.concat(*[F.lpad(F.lower(F.hex(F.col("words")[i])), 16, "0") for i in range(words)])
    same = F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.text_hash") == F.col("text_hash"))
    return found.join(classes, "node").select(
        "doc_id", "text_hash", hexed.alias("fingerprint"), F.col("best.doc_id").alias("component_id"),
        same.alias("first"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates, with the columns of ``docs``.

    Five-word shingles, Jaccard similarity 0.8 or more; the smallest id stays.
    """
    marked = materialize(
        components(docs, NEAR_WIDTH, NEAR_WORDS, NEAR_RADIUS).select("doc_id", "text_hash", "first"),
        "simhash-marked",
    )
    gone = marked.filter(~F.col("first")).select("doc_id", "text_hash").distinct()
    mark = fresh(docs, "_t")
    keyed = docs.withColumn(mark, F.xxhash64("text"))
    kept = keyed.join(
        gone, keyed["doc_id"].eqNullSafe(gone["doc_id"]) & (keyed[mark] == gone["text_hash"]), "left_anti"
    )
    first = marked.filter("first")
    if first.count() != first.distinct().count():  # repeated rows of one document
        kept = kept.dropDuplicates(["doc_id", mark])
    return kept.drop(mark)
