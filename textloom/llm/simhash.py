"""SimHash fingerprints and near duplicates, compared through pivot distance tables.

The pivot table holds the Hamming distance of every fingerprint to fixed reference fingerprints. By
the triangle inequality two fingerprints within r bits differ by at most r in each coordinate, so a
pair whose largest coordinate difference exceeds r is discarded before its bits are compared.

Distances of 64-bit fingerprints to any pivot lie close together (32 with a deviation of 4), so
coordinates alone can't be a join key. Pairs to be tested are met by equal bit groups: of g groups all
but four are equal in any two fingerprints that differ in at most four bits. g follows the number of
distinct fingerprints, so that the fingerprints of a key stay few however many there are.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, few, texts
from textloom.llm.components import components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
N_PIVOTS = 16
CHUNK = 1 << 16
#: Bands of minimum hashes for the similarity of shingle sets, and the factors and shifts of the hash functions.
BANDS, ROWS = 20, 5
MINHASH_CHUNK = 1 << 13
#: The fingerprints of sets of at most so many shingles are too rough for the distance to discard a pair of them.
SMALL = 16
FOLD = np.uint64(0x9E3779B97F4A7C15)
FACTORS, SHIFTS = (np.random.default_rng(seed).integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(odd) for seed, odd in ((31, 1), (32, 0)))


def shingle_bounds(text: str, words: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The text's words joined by one space, and where each shingle starts and ends in it."""
    w = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    sizes = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(sizes + 1) - 1
    n = max(1, len(w) - words + 1) if w else 0
    return b" ".join(w), (ends - sizes)[:n], ends[min(words, len(w)) - 1 :] if w else ends


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 with seed 42 of every shingle, repeats included."""
    joined, starts, ends = shingle_bounds(text, words)
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half the hashes; no hashes give zero. Signed, as Spark has it."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[i : i + CHUNK])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 4, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, fp) of every row, and the columns to keep: one scan, no shuffle."""
    keep = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(shingle_hashes(t.as_py(), words)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), *b.columns[2:]], ["doc_id", "fp", *keep])

    rows = docs.select("doc_id", "text", *keep) if keep else texts(docs)
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(["doc_id long, fp long", *[f"{c} {kinds[c]}" for c in keep]]))


def pivots(n: int = N_PIVOTS) -> list[int]:
    """Reference fingerprints: Walsh patterns, which differ from each other in half their bits."""
    out = []
    for k in range(n):
        row = 2 * k + 1
        v = sum(1 << i for i in range(64) if bin(i & row).count("1") % 2)
        out.append(v - (1 << 64) if v >= 1 << 63 else v)
    return out


def with_pivots(df: DataFrame, fp: str = "fp") -> DataFrame:
    """Adds the table of distances to the reference fingerprints as columns p0, p1, ..."""
    return df.withColumns({f"p{i}": F.bit_count(F.col(fp).bitwiseXOR(F.lit(v))).cast("byte") for i, v in enumerate(pivots())})


def within(a: str, b: str, bits: int) -> Column:
    """The pivot test on both rows' coordinates, then the distance itself."""
    near = F.lit(True)
    for i in range(N_PIVOTS):
        near = near & (F.abs(F.col(f"{a}.p{i}") - F.col(f"{b}.p{i}")) <= bits)
    return near & (F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= bits)


def groups_for(n: int) -> int:
    """How many bit groups: keys of all but four have about 21, 27 or 32 bits, at least those of n less 6."""
    return 6 if n <= 1 << 27 else 7 if n <= 1 << 33 else 8


def _fields(groups: int) -> list[tuple[int, int]]:
    """(shift, width) of each bit group; together 64 bits."""
    out, at = [], 0
    for g in range(groups):
        w = 64 // groups + (g < 64 % groups)
        out.append((at, w))
        at += w
    return out


def links(fps: DataFrame, scratch: Scratch, bits: int = 4, hot: int = 2000, groups: int | None = None) -> DataFrame:
    """Edges (a, b) of distinct fingerprints: their components are those of all pairs within 4 bits.

    A key is a choice of all but four groups and their bits. Keys of up to `hot` fingerprints give their
    linked pairs. Of a larger one every fingerprint names all words within two bits of it that keep the
    key; two fingerprints are within four bits just if they name a common word, so each is linked to the
    smallest that names it. That costs 500 to 1000 rows for each member, however many there are.
    """
    if not 0 <= bits <= 4:
        raise ValueError("all but four equal groups prove at most 4 differing bits")
    groups = groups or groups_for(fps.count())
    fields, chosen = _fields(groups), list(itertools.combinations(range(groups), groups - 4))
    part = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in fields]

    def key(n: int, own: tuple[int, ...]) -> Column:
        out = F.lit(n).cast("long")
        for g in own:
            out = F.shiftleft(out, fields[g][1]).bitwiseOR(part[g])
        return F.struct(F.lit(n).alias("n"), out.alias("key"))

    rows = with_pivots(fps).select("fp", *[f"p{i}" for i in range(N_PIVOTS)], F.explode(F.array(*[key(n, own) for n, own in enumerate(chosen)])).alias("x")).select("fp", *[f"p{i}" for i in range(N_PIVOTS)], "x.n", "x.key")
    many = scratch.save(rows.groupBy("n", "key").agg(F.count("*").alias("size")).where(F.col("size") > hot).select("n", "key"), "hot")
    some_hot = bool(many.take(1))
    cool = rows.join(many, ["n", "key"], "left_anti") if some_hot else rows
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    same = [F.when(F.shiftrightunsigned(x, s).bitwiseAND(F.lit((1 << w) - 1)) == 0, 1 << g).otherwise(0) for g, (s, w) in enumerate(fields)]
    # a pair that shares several keys is reported by the first of them: its lowest equal groups
    rest = sum(same[1:], same[0])
    first = F.lit(0)
    for _ in range(groups - 4):
        lowest = rest.bitwiseAND(-rest)
        first, rest = first + lowest, rest - lowest
    mine = F.get(F.array(*[F.lit(sum(1 << g for g in own)) for own in chosen]), F.col("a.n"))
    # Spark takes the exploded keys for as small as the fingerprints and would broadcast them through the driver
    a, b = cool.alias("a"), cool.hint("merge").alias("b")
    met = (F.col("a.n") == F.col("b.n")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & within("a", "b", bits)
    met = met if some_hot else met & (first == mine)
    out = a.join(b, met).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    if not some_hot:
        return out
    if bits < 4:  # a midpoint proves four bits; a smaller radius is checked on the pairs themselves
        raise ValueError("keys above the hot size are linked at 4 bits only")
    free = [[b for g, (s, w) in enumerate(fields) if g not in own for b in range(s, s + w)] for own in chosen]
    flips = [[0] + [1 << i for i in bits_] + [(1 << i) | (1 << j) for i, j in itertools.combinations(bits_, 2)] for bits_ in free]
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    spark = fps.sparkSession
    near = spark.createDataFrame([(n, signed(v)) for n, vs in enumerate(flips) for v in vs], "n int, flip long")
    named = rows.join(many, ["n", "key"]).select("n", "fp").join(F.broadcast(near), "n").select("n", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"), "fp")
    low = named.groupBy("n", "word").agg(F.min("fp").alias("m"), F.max("fp").alias("top")).where("m < top").drop("top")
    starred = named.join(low, ["n", "word"]).where("fp != m").select(F.col("fp").alias("a"), F.col("m").alias("b"))
    return out.union(starred).distinct()


def simhash_components(docs: DataFrame, words: int = 4, bits: int = 4, hot: int = 2000, groups: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    component_id is the smallest doc_id that links reach. Null and empty texts have fingerprint zero
    and link like any other; equal fingerprints always link; a null doc_id is never the smallest.
    Only distinct fingerprints are compared. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.save(fingerprints(docs, words), "fps")
    firsts = scratch.save(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
    roots = components(links(firsts.select("fp"), scratch, bits, hot, groups), scratch)
    lowest = firsts.join(roots, F.col("fp") == F.col("node")).groupBy("root").agg(F.min("first").alias("component_id"))
    named = scratch.save(firsts.join(roots, F.col("fp") == F.col("node"), "left").join(lowest, "root", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")), "named")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of shingle hashes, each of ROWS minimum hashes; equal sets have equal keys."""
    x = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), MINHASH_CHUNK):
        low = np.minimum(low, (x[None, i : i + MINHASH_CHUNK] * FACTORS[:, None] + SHIFTS[:, None]).min(1))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * FOLD
    for part in low.reshape(BANDS, ROWS).T:
        keys = (keys ^ part) * FOLD
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, h, n, fp, bands, small) of every row: hash and length of the text, fingerprint and band keys of its
    set of shingles, and whether that is a small set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = (np.unique(shingle_hashes(t.as_py(), words)) for t in b.column(3))
            fps, bands, small = zip(*[(fingerprint(s), band_keys(s), len(s) <= SMALL) for s in sets], strict=True) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(small, pa.bool_())], ["doc_id", "h", "n", "fp", "bands", "small"])

    rows = texts(docs).select("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("n"), "text")
    return rows.mapInArrow(run, "doc_id long, h long, n int, fp long, bands array<long>, small boolean")


def met_pairs(keys: DataFrame, reach: int, bits: int) -> DataFrame:
    """(a, b) of rows (key, fp, doc_id, small) with equal keys, at most `reach` places apart in sorted partitions,
    that the pivot table and the distance of the fingerprints don't discard; pairs with a small set all stay."""
    table = np.array(pivots(), np.int64).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: list[np.ndarray] = [*[np.zeros(0, np.int64)] * 3, np.zeros(0, bool)]
        for b in batches:
            key, fp, ids, small = (np.concatenate([x, b.column(i).to_numpy(zero_copy_only=False)]) for i, x in enumerate(tail))
            held, tail = len(tail[0]), [key[-reach:], fp[-reach:], ids[-reach:], small[-reach:]]
            u = fp.view(np.uint64)
            for k in range(1, reach + 1):
                x = np.flatnonzero(key[:-k] == key[k:])
                x = x[x + k >= held]
                free = small[x] | small[x + k]
                kept, x = x[free], x[~free]
                for p in table:  # one coordinate at a time
                    d = np.bitwise_count(u[x] ^ p).astype(np.int16) - np.bitwise_count(u[x + k] ^ p).astype(np.int16)
                    x = x[np.abs(d) <= bits]
                x = np.concatenate([kept, x[np.bitwise_count(u[x] ^ u[x + k]) <= bits]])
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[x], ids[x + k])), pa.array(np.maximum(ids[x], ids[x + k]))], ["a", "b"])

    return keys.select("key", "fp", "doc_id", "small").mapInArrow(run, "a long, b long")


def hub_pairs(crowd: DataFrame, scratch: Scratch, bits: int) -> DataFrame:
    """(a, b) of each row (key, fp, doc_id, small) and two hubs of its key: the smallest doc_id and the one whose
    fingerprint is nearest to the majority of the key's fingerprints, bit by bit."""
    ones = [F.sum(F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1))).alias(f"s{i}") for i in range(64)]
    sums = crowd.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "fp", "small")).alias("first"), *ones)
    centre = F.lit(0).cast("long")
    for i in range(64):
        centre = centre.bitwiseOR(F.when(2 * F.col(f"s{i}") > F.col("n"), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)))
    centres = scratch.save(sums.select("key", "first", centre.alias("centre")), "centres")
    off = F.bit_count(F.col("fp").bitwiseXOR(F.col("centre")))
    nearest = F.min(F.struct(off.alias("off"), "doc_id", "fp", "small"))
    hubs = crowd.join(few(centres), "key").groupBy("key").agg(nearest.alias("mid"), F.min("first").alias("first"))
    hubs = hubs.select("key", F.explode(F.array(F.struct("mid.doc_id", "mid.fp", "mid.small"), "first")).alias("hub"))
    met = crowd.join(few(scratch.save(hubs, "hubs")), "key").where("doc_id != hub.doc_id")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("hub.fp"))) <= bits
    for v in pivots():
        near = (F.abs(F.bit_count(F.col("fp").bitwiseXOR(F.lit(v))) - F.bit_count(F.col("hub.fp").bitwiseXOR(F.lit(v)))) <= bits) & near
    return met.where(F.col("small") | F.col("hub.small") | near).select(F.least("doc_id", "hub.doc_id").alias("a"), F.greatest("doc_id", "hub.doc_id").alias("b"))


def open_groups(crowd: DataFrame, roots: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows (key, fp, doc_id, small, root) of the large groups, and those groups (key, main, n, out) that are not one
    component yet: the largest component's root, how many rows there are, and how many stand outside of it."""
    label = crowd.join(roots, F.col("doc_id") == F.col("node"), "left").select("key", "fp", "doc_id", "small", F.coalesce("root", "doc_id").alias("root"))
    label = scratch.save(label, "label")
    sizes = label.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("n"))
    rest = main.select("key", F.col("main.root").alias("main"), "n", (F.col("n") - F.col("main.n")).alias("out")).where("out > 0")
    return label, scratch.save(rest, "open")


def prefix_size(n: int, similarity: float) -> int:
    """Two sets with this Jaccard similarity have a common element among so many first ones of n, in any one order for both."""
    return n - ceil(similarity * n - 1e-9) + 1


def shingle_lists(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, s): the set of each text's shingles. A text without shingles has the one element 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, t in zip(b.column(0), b.column(1), strict=True):
                s = np.unique(shingle_hashes(t.as_py(), words)).view(np.int64)
                s = s if len(s) else np.zeros(1, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(s)], pa.int32()), pa.array(s))], ["doc_id", "s"])

    return docs.mapInArrow(run, "doc_id long, s array<long>")


def rare_first(elements: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Sets of these sizes, which lie one after another, as rising ranks of their elements: 0 is that which fewest of the sets have."""
    values, at, df = np.unique(elements, return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(values))
    return [np.sort(x) for x in np.split(rank[at], np.cumsum(sizes)[:-1])]


def outside_links(label: DataFrame, rest: DataFrame, similarity: float, bits: int, block: int = 1024, room: int = 1 << 21) -> DataFrame:
    """(a, b) of rows (key, fp, doc_id, small, root, s) with equal keys, different roots and similar sets s: enough of
    them to join all that are linked.

    Only a group's rows outside its largest component are held against all its rows, in cells of at most about
    `block` by `block` rows and `room` elements a side, so no task holds a group and no pair of a group is passed
    over. Inside a cell rows meet by the elements of their sets that are rarest in it, the pivot table and the distance discard
    pairs (none with a small set), and the sets decide unless earlier links of the cell have joined the two.
    """
    table = np.array(pivots(), np.int64).view(np.uint64)

    def cell(t: pa.Table) -> pa.Table:
        side, fp, ids, root, small = (t.column(c).to_numpy() for c in ("side", "fp", "doc_id", "root", "small"))
        lists = t.column("s").combine_chunks()
        sets = rare_first(lists.flatten().to_numpy(), lists.value_lengths().to_numpy())
        heads = [s[: prefix_size(len(s), similarity)] for s in sets]
        u, root = fp.view(np.uint64), root.copy()
        coords = np.stack([np.bitwise_count(u ^ p).astype(np.int16) for p in table])
        inner = np.flatnonzero(side == 1)
        listed, holder = np.concatenate([heads[y] for y in inner] or [np.zeros(0, np.int64)]), np.repeat(inner, [len(heads[y]) for y in inner])
        order = np.argsort(listed, kind="stable")
        listed, holder = listed[order], holder[order]
        a, b = [], []
        for x in np.flatnonzero(side == 0):
            met = np.zeros(len(ids), bool)
            for i, j in zip(np.searchsorted(listed, heads[x], "left").tolist(), np.searchsorted(listed, heads[x], "right").tolist(), strict=True):
                met[holder[i:j]] = True
            y = np.flatnonzero(met & (root != root[x]))
            near = (np.abs(coords[:, y] - coords[:, x, None]) <= bits).all(0) & (np.bitwise_count(u[y] ^ u[x]) <= bits)
            for z in y[near | small[y] | small[x]]:
                if root[z] != root[x]:
                    both = len(np.intersect1d(sets[x], sets[z], assume_unique=True))
                    if both >= similarity * (len(sets[x]) + len(sets[z]) - both):
                        root[root == root[z]] = root[x]
                        a.append(min(ids[x], ids[z]))
                        b.append(max(ids[x], ids[z]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = label.join(few(rest), "key")
    out = F.col("root") != F.col("main")
    parts = lambda n, size: F.greatest(F.ceil(n / F.lit(block)), F.ceil(size / F.lit(room)))
    size = F.sum(F.size("s"))
    cells = rows.groupBy("key").agg(parts(F.count("*"), size).alias("nj"), parts(F.count_if(out), F.sum(F.when(out, F.size("s")).otherwise(0))).alias("ni"))
    rows = rows.join(few(cells), "key")
    mine = lambda n: F.pmod(F.xxhash64("doc_id"), n)
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    kept = ["fp", "doc_id", "root", "small", "s"]
    outer = rows.where(out).select("key", mine("ni").alias("i"), all_of("nj").alias("j"), F.lit(0).alias("side"), *kept)
    inner = rows.select("key", all_of("ni").alias("i"), mine("nj").alias("j"), F.lit(1).alias("side"), *kept)
    return outer.union(inner).groupBy("key", "i", "j").applyInArrow(cell, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, bits: int = 22, reach: int = 15, hot_reach: int = 4) -> DataFrame:
    """(doc_id, first): rows whose sets of word shingles have a Jaccard similarity of `similarity` or more
    link; first is the smallest doc_id that links reach. Rows with a null doc_id are left out.

    Texts this similar differ in about 10 of 64 bits, too many for bit groups, so pairs are met by an
    equal band of minimum hashes: a pair at 0.8 shares none of 20 bands of 5 once in 3000 times, with
    however many rows. All pairs of a band's group of up to reach + 1 distinct texts are tested. Larger
    groups are sorted by fingerprint, in another order for each band, and dealt out in ranges; each
    text is tested with the next `hot_reach` and with two hubs, which makes most groups one component.
    In those that are not, every text outside the largest component is then held against all texts of
    the group with which it shares one of its rarest shingles, as any text at 0.8 does. The pivot table
    and the distance discard pairs of sets of over 16 shingles (at 0.8 those differ in over 22 bits less
    than once in 10,000 times), and the shingle sets themselves decide. Texts without words are alike. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    body = texts(docs).where("doc_id is not null")
    rows = scratch.save(sketches(body, words), "rows")
    only = rows.groupBy("h", "n").agg(F.min("doc_id").alias("doc_id"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("small").alias("small"))
    keys = only.select("doc_id", "fp", "small", F.posexplode("bands").alias("band", "key"))
    keys = scratch.save(keys, "keys")
    large = scratch.save(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > reach + 1).select("key"), "large")
    large = few(large)
    near = met_pairs(keys.join(large, "key", "left_anti").repartition("key").sortWithinPartitions("key"), reach, bits)
    turned = F.expr("shiftleft(fp, 3 * band) | shiftrightunsigned(fp, 64 - 3 * band)").alias("turned")
    crowd = keys.join(large, "key").select("key", "fp", "doc_id", "small", turned)
    near = near.union(hub_pairs(crowd, scratch, bits))
    near = near.union(met_pairs(crowd.repartitionByRange("key", "turned", "doc_id").sortWithinPartitions("key", "turned", "doc_id"), hot_reach, bits))
    roots = components(_linked(near.distinct(), body, words, similarity, scratch, "near"), scratch)
    label, rest = open_groups(crowd, roots, scratch)
    if rest.take(1):
        label = label.join(few(rest.select("key")), "key")
        ends = few(scratch.save(label.select("doc_id").distinct(), "members"))
        sets = shingle_lists(body.join(ends, "doc_id").dropDuplicates(["doc_id"]), words)
        members = scratch.save(label.join(sets, "doc_id"), "member_sets")
        more = scratch.save(outside_links(members, rest, similarity, bits), "outside")
        roots = components(roots.toDF("a", "b").union(more), scratch, "joined")
    groups = rows.groupBy("h", "n").agg(F.min("doc_id").alias("rep"))
    named = groups.join(roots, F.col("rep") == F.col("node"), "left").select("h", "n", F.coalesce("root", "rep").alias("first"))
    return rows.join(named, ["h", "n"]).select("doc_id", "first")


def _linked(near: DataFrame, body: DataFrame, words: int, similarity: float, scratch: Scratch, step: str) -> DataFrame:
    """The pairs (a, b) whose sets of shingles are alike."""
    near = scratch.save(near, step)
    ends = near.select(F.col("a").alias("doc_id")).union(near.select(F.col("b").alias("doc_id"))).distinct()
    ends = scratch.save(ends, f"{step}_ends")
    sets = scratch.save(_shingle_sets(body.join(few(ends), "doc_id").dropDuplicates(["doc_id"]), words), f"{step}_sets")
    pairs = near.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = (np.frombuffer(v.as_py(), np.int64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                either = len(p) + len(q) - both
                ok.append(either == 0 or both >= similarity * either)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.select("a", "b", "sa", "sb").mapInArrow(decide, "a long, b long")


def _shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, s): the sorted distinct shingle hashes of a text as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.unique(shingle_hashes(t.as_py(), words)).view(np.int64).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "s"])

    return docs.mapInArrow(run, "doc_id long, s binary")

