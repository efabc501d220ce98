"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint's 64 bits are split into six blocks. Two fingerprints that differ in three bits or fewer agree in three
whole blocks at least, so that rows which share the bits of one of the twenty choices of three blocks are the only
candidates; their Hamming distance is then verified. Only different fingerprints are compared: exact copies meet in
one row beforehand. A block shared by more than ``LARGE`` fingerprints is split again by four blocks of its remaining
bits, up to three times, after which at most 2**14 different fingerprints can share one. Within a block the links
are reduced to a spanning forest as they are found, so that a block of n fingerprints gives n - 1 edges at most and
connects just what its links connect.

Null and empty texts have no words and the fingerprint 0, which is compared like any other. Texts are read whole,
however long. Repeated rows keep their fingerprint and component each, and an id given twice is two rows. A bit that
exactly half of the shingles set is 0. A null id never names a component unless all ids of the component are null. An
empty table gives no rows. ``near_duplicates`` returns its three columns only, whatever the others are called;
``keep_one`` returns the columns that it got.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import own_name, partitions, stable, values
from quern.llm.components import components

SHINGLE, SEED, MOST_BITS = 3, 42, 3
#: Fingerprints in a block before it is split again, and how often that may happen.
LARGE, LEVELS = 4096, 3


def _hashes(raw: bytes | None, shingle: int) -> np.ndarray:
    """Of all shingles, repeats included; a shorter text is one."""
    words = (raw or b"").lower().split()  # bytes: only A-Z, and only the six ASCII spaces
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if n > 1 or len(words) == shingle else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)


def _majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def simhash(raw: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text, as an unsigned number."""
    return _majority(_hashes(raw, shingle))


def wide_simhash(raw: bytes | None, shingle: int = SHINGLE, parts: int = 8) -> list[int]:
    """``parts`` fingerprints: that of the hashes, and those of the hashes mixed anew."""
    hashes, out = _hashes(raw, shingle), []
    for i in range(parts):
        x = hashes + np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64))
        if i:
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
        out.append(_majority(x))
    return out


@F.arrow_udf(T.LongType())
def _fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for part in values(batches):
        yield pa.array(np.fromiter(map(simhash, part), np.uint64, len(part)).view(np.int64))


def fingerprint(text: Column) -> Column:
    """64 bits as a signed long."""
    return _fingerprints(text.cast("binary"))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _parts(bits: list[int], n: int) -> list[int]:
    """The bit positions in n blocks of nearly equal size, as masks."""
    return [sum(1 << int(b) for b in x) for x in np.array_split(bits, n)]


def masks() -> list[int]:
    return [a | b | c for a, b, c in combinations(_parts(list(range(64)), 6), 3)]


def _finer(mask: int) -> list[int]:
    return [mask | x for x in _parts([b for b in range(64) if not mask >> b & 1], MOST_BITS + 1)]


def _forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted different fingerprints of one block: each that is linked to an earlier one reached, with that one."""
    n = len(fps)
    left, parent, seen = np.arange(n), np.full(n, -1), np.zeros(n, bool)
    for start in range(n):  # breadth first from the smallest not yet reached
        if seen[start]:
            continue
        seen[start] = True
        left = left[left != start]
        reach = np.array([start])
        while len(reach) and len(left):
            best, by = np.full(len(left), 65), np.zeros(len(left), np.int64)
            for i in range(0, len(reach), 64):
                part = reach[i : i + 64]
                x = np.bitwise_count(fps[left][:, None] ^ fps[part][None, :])
                at = x.argmin(axis=1)
                least = x[np.arange(len(left)), at]
                by = np.where(least < best, part[at], by)
                best = np.minimum(best, least)
            near = best <= MOST_BITS
            reach = left[near]
            parent[reach] = by[near]
            seen[reach] = True
            left = left[~near]
    tied = np.flatnonzero(parent >= 0)
    return fps[parent[tied]], fps[tied]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (part, mask, key, fp), of which a block may go on in the next batch, to edges."""
    held = np.zeros((4, 0), np.int64)
    for batch in _with_end(batches):
        new = np.zeros((4, 0), np.int64) if batch is None else np.stack([batch.column(n).to_numpy() for n in (*BLOCK, "fp")])
        rows = np.concatenate([held, new], axis=1)
        if not rows.shape[1]:
            continue
        part, fps = rows[0], rows[3].view(np.uint64)
        cut = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0)) + 1
        starts = np.concatenate([[0], cut]).astype(int)
        ends = np.concatenate([cut, [len(fps)]]).astype(int)
        if batch is not None:  # the last block may go on
            held = rows[:, starts[-1] :]
            starts, ends = starts[:-1], ends[:-1]
        sizes = ends - starts
        two = starts[sizes == 2]
        two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= MOST_BITS] if len(two) else two
        g, a, b = [part[two]], [fps[two]], [fps[two + 1]] if len(two) else [fps[:0]]
        for s, e in zip(starts[sizes > 2], ends[sizes > 2], strict=True):
            x, y = _forest(fps[s:e])
            g.append(np.full(len(x), part[s]))
            a.append(x)
            b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (g, a, b)], names=["part", "a", "b"])


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


BLOCK = ("part", "mask", "key")


def _key() -> Column:
    """The bits of a block."""
    return F.col("fp").bitwiseAND(F.col("mask"))


#: The table of crowded blocks is broadcast up to this many; beyond, it is joined by block, of which AQE splits large ones.
MOST_BLOCKS = 100_000


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", _key())


def _crowded(rows: DataFrame, large: int, n_rows: int) -> DataFrame:
    """Blocks of more than ``large`` fingerprints, counted in partial sums, so that none is in one task before its split.

    Only blocks of which one fingerprint in ``every``, chosen by hash, makes half the number are counted. One that is
    missed by such odds (1 in 10**5) is compared in one piece: that takes longer and gives the same links.
    """
    rows, every = _keyed(rows), max(1, large // 64)
    count = lambda x: x.groupBy(*BLOCK).agg(F.count("*").alias("n"))
    some = rows.filter(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0)
    if every == 1:
        return stable(count(some).filter(F.col("n") > large).select(*BLOCK), n_rows)
    suspects = stable(count(some).filter(F.col("n") > large // every // 2).select(*BLOCK), n_rows // every)
    n = suspects.count()
    if not n:
        return suspects
    near = rows.join(F.broadcast(suspects) if n <= MOST_BLOCKS else suspects, list(BLOCK), "left_semi")
    return stable(count(near).filter(F.col("n") > large).select(*BLOCK), n_rows)


def links(fps: DataFrame, large: int = LARGE, n_rows: int | None = None) -> DataFrame:
    """From different fingerprints (part, fp) to edges (part, a, b), each of two that differ in three bits or fewer,
    that connect all of one part that do."""
    now = masks()
    n_rows = len(now) * (fps.count() if n_rows is None else n_rows)
    # the key is computed anew on either side of an exchange, which then carries a third less
    rows, found = fps.select("part", F.explode(F.array(*[F.lit(_signed(m)) for m in now])).alias("mask"), "fp"), None
    for level in range(LEVELS + 1):
        last = level == LEVELS
        use, crowded, n = rows, None, 0
        if not last:
            crowded = _crowded(rows, large, n_rows)
            n = crowded.count()
        if n:
            hint = F.broadcast(crowded) if n <= MOST_BLOCKS else crowded
            use = _keyed(rows).join(hint, list(BLOCK), "left_anti").select("part", "mask", "fp")
        dealt = use.repartition(partitions(fps.sparkSession), "part", "mask", _key())
        edges = _keyed(dealt).sortWithinPartitions(*BLOCK, "fp").select(*BLOCK, "fp").mapInArrow(_links, "part long, a long, b long").distinct()
        found = edges if found is None else found.union(edges)
        if not n:
            return found
        finer = {m: _finer(m) for m in now}
        table = F.create_map(*[F.lit(x) for m, f in finer.items() for x in (_signed(m), F.array(*[F.lit(_signed(y)) for y in f]))])
        rest = _keyed(rows).join(hint, list(BLOCK), "left_semi")
        rows = stable(rest.select("part", F.explode(F.element_at(table, F.col("mask"))).alias("mask"), "fp"))
        n_rows = rows.count()
        now = [y for f in finer.values() for y in f]
    return found


def _named(rows: DataFrame, large: int) -> DataFrame:
    """From rows with fp to (fp, root): each fingerprint and the one that names its component."""
    n = rows.count()
    fps = stable(rows.select("fp").distinct(), n)
    edges = links(fps.select(F.lit(0).cast("long").alias("part"), "fp"), large, n).select("a", "b")
    tied = stable(components(edges, most=len(masks()) * n), n)
    return fps.join(tied.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", large: int = LARGE) -> DataFrame:
    """One row (id, fp, component_id) for each row of the documents."""
    rows = stable(docs.select(F.col(id), fingerprint(F.col(text)).alias("fp")))
    firsts = rows.groupBy("fp").agg(F.min(id).alias("first"))
    grouped = firsts.join(_named(rows, large), "fp")
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = grouped.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(id, "fp", "component_id")


#: Parts of a wide fingerprint, and the bits of all of them in which near duplicates differ at most. Texts that share
#: 0.8 of their 5-word shingles, by words that were replaced, share 0.875 of their 3-word ones: an angle of 21 degrees.
PARTS, MOST_WIDE_BITS = 8, 60


def wide_edges(nodes: DataFrame, large: int = LARGE, n: int | None = None) -> DataFrame:
    """From different wide fingerprints (w: array of ``PARTS`` longs) to edges (a, b) of near ones.

    Candidates are those that are linked in one part at least, or equal in it; then all parts decide. Of those that
    share a part's value the least stands for all in that part's links.
    """
    n = nodes.count() if n is None else n
    each = nodes.select("w", F.posexplode("w").alias("part", "fp")).withColumn("part", F.col("part").cast("long"))
    firsts = stable(each.groupBy("part", "fp").agg(F.min("w").alias("first")), PARTS * n)
    same = each.join(firsts, ["part", "fp"]).select(F.col("first").alias("a"), F.col("w").alias("b"))
    found = links(firsts.select("part", "fp"), large, PARTS * n)
    of = lambda x: firsts.select("part", F.col("fp").alias(x), F.col("first").alias(f"{x}_w"))
    linked = found.join(of("a"), ["part", "a"]).join(of("b"), ["part", "b"]).select(F.col("a_w").alias("a"), F.col("b_w").alias("b"))
    both = same.unionByName(linked).filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    bits = F.aggregate(F.zip_with("a", "b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return both.filter(bits <= MOST_WIDE_BITS)


def keep_one(docs: DataFrame, text: str = "text", id: str = "doc_id", large: int = LARGE) -> DataFrame:
    """One document of each component: that of smallest id, null ids last, and of equal ids the one of smallest hash.

    Documents are near duplicates if their wide fingerprints are (see ``wide_edges``), which estimates that they share
    0.8 of their 5-word shingles. A row is named by 128 bits hashed from all its columns, so that rows which share an
    id are told apart; of rows that are equal in every column one stays.
    """

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def wide(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in values(batches):
            yield pa.array([[_signed(y) for y in wide_simhash(x, parts=PARTS)] for x in part], pa.list_(pa.int64()))

    a, b = own_name(docs, "_row_a"), own_name(docs, "_row_b")
    nested = {f.name for f in docs.schema if isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))}
    whole = [F.to_json(F.struct(c), {"ignoreNullFields": "false"}) if c in nested else F.col(c) for c in docs.columns]
    whole += [F.col(c).isNull() for c in docs.columns if c not in nested]  # a hash passes over nulls
    marked = docs.withColumns({a: F.xxhash64(F.lit(7), *whole), b: F.xxhash64(F.lit(8), *whole)})
    rows = stable(marked.select(F.col(id).alias("i"), F.col(a).alias("a"), F.col(b).alias("b"), wide(F.col(text).cast("binary")).alias("w")))
    n = rows.count()
    firsts = stable(rows.groupBy("w").agg(F.min(F.struct(F.col("i").isNull(), "i", "a", "b")).alias("first")), n)
    tied = stable(components(wide_edges(firsts.select("w"), large, n), most=PARTS * len(masks()) * n), n)
    rooted = firsts.join(tied.withColumnRenamed("node", "w"), "w", "left").select("first", F.coalesce("root", "w").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first"))
    kept = kept.select(F.col("first.a").alias(a), F.col("first.b").alias(b))
    return marked.join(kept, [a, b], "left_semi").dropDuplicates([a, b]).select(*docs.columns)
