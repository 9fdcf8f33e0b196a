"""Near-duplicates by HyperMinHash sketches, banding, estimates and exact verification.

A document is its set of distinct word shingles. Equal sets are one class from the start. A sketch
has a register for each of M buckets: leading zeros and mantissa bits of the smallest hash in it; a
bucket that no shingle falls into takes its smallest hash under a permutation of its own, so registers
of short texts agree with probability equal to the Jaccard similarity too. Bands of registers name
buckets of candidates.

Links are sought without all pairs of a group: in a few rounds every class is held against two centres
of other components that share a band with it, links are confirmed on the full sets, and components
found. What is left are members of different components in one band. They are dealt into cells of bounded
size, and in each cell the sketches are compared first: those that have a partner which the
collision-corrected estimate can't rule out get their full sets sent to the cell. There the pairs are
confirmed, the likeliest first and none whose ends are joined already, so a cell yields fewer links than it
has members, and no pair that isn't a link ever leaves it. A pair is looked at in the first band it shares only.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, slices
from tidemark.llm.graph import components

M_BITS, MANTISSA = 7, 10
M = 1 << M_BITS
ROWS = 5
BANDS = M // ROWS
#: Expected chance equalities among M registers, from the sketch's published approximation.
CHANCE = 0.169919487159739 * M / 2**MANTISSA
#: Standard errors below the threshold at which an estimate rules a pair out.
ERRORS = 4.5
#: Members, and shingles of all their sets, in a block of a band; a cell holds two blocks.
BLOCK, BLOCK_SHINGLES = 2048, 4 << 20
#: Rounds of centres before members are compared with each other.
ROUNDS = 2

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = (np.arange(1, M + 2, dtype=np.uint64) * _GOLD) ^ np.uint64(0xD6E8FEB86659FD93)
_EDGES = np.arange(M, dtype=np.uint64) << np.uint64(64 - M_BITS)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words; of all words if there are fewer; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    run = min(size, len(h))
    out = np.full(n, run, np.uint64)
    for k in range(run):
        out = mix(out * _GOLD + h[k : k + n])
    return np.unique(out)


def _registers(x: np.ndarray, width: int) -> np.ndarray:
    """Leading zeros (31 at most) and mantissa of `width`-bit values."""
    f = x.astype(np.float64)
    top = np.where(x > 0, np.frexp(np.maximum(f, 1))[1] - 1, 0).astype(np.int64)
    wrong = (x >> top.astype(np.uint64)) == 0
    top = np.where(wrong, np.maximum(top - 1, 0), top)
    zeros = np.minimum(width - 1 - top, 31)
    shift = top - MANTISSA
    m = np.where(shift >= 0, x >> np.maximum(shift, 0).astype(np.uint64), x << np.maximum(-shift, 0).astype(np.uint64))
    return ((zeros.astype(np.uint64) << np.uint64(MANTISSA)) | (m & np.uint64((1 << MANTISSA) - 1))).astype(np.uint16)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """M registers of 16 bits; the highest bit marks a bucket that was filled by its own permutation."""
    x = np.sort(mix(hashes ^ _SEEDS[M]))
    at = np.searchsorted(x, _EDGES)
    ends = np.append(at[1:], len(x))
    full = at < ends
    out = np.zeros(M, np.uint16)
    out[full] = _registers(x[at[full]] & np.uint64((1 << (64 - M_BITS)) - 1), 64 - M_BITS)
    empty = np.flatnonzero(~full)
    for i in range(0, len(empty), 16):
        some = empty[i : i + 16]
        own = mix(hashes[:, None] ^ _SEEDS[some][None, :]).min(axis=0)
        out[some] = _registers(own >> np.uint64(1), 63) | np.uint16(0x8000)
    return out


def bands(registers: np.ndarray) -> list[int]:
    return [xxhash.xxh3_64_intdigest(registers[b * ROWS : (b + 1) * ROWS].tobytes(), seed=b) - (1 << 63) for b in range(BANDS)]


def estimate(equal: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the count of equal registers, without those equal by chance."""
    return np.maximum(0.0, (equal - CHANCE) / (M - CHANCE))


def least_estimate(threshold: float) -> float:
    return threshold - ERRORS * (threshold * (1 - threshold) / M) ** 0.5


def _arrays(df: DataFrame, schema: str, per_row, columns: list[str]) -> DataFrame:
    """mapInArrow in slices of bounded bytes; per_row(*values) yields rows."""
    from tidemark.llm.common import _arrow

    out = pa.schema(_arrow(df.sparkSession, schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4 << 20):
                rows = [r for values in zip(*[c.to_pylist() for c in part.columns], strict=True) for r in per_row(*values)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), out, strict=True)], schema=out)

    return df.select(*columns).mapInArrow(run, schema)


def sketches(docs: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, sid, regs) for each row; sid is a 128-bit hash of the set, null for an empty one."""

    def one(i, text):
        s = shingles(text, size)
        yield (i, len(s), xxhash.xxh3_128_digest(s.tobytes()), sketch(s).tobytes()) if len(s) else (i, 0, None, None)

    return _arrays(docs, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_shingles long, sid binary, regs binary", one, [id_col, text_col])


def band_rows(reps: DataFrame) -> DataFrame:
    """(band, sid, n): the bands in which each class stands, those of one class alone left out."""
    return _arrays(reps, "band long, sid binary, n long", lambda sid, regs, n: [(b, sid, n) for b in bands(np.frombuffer(regs, np.uint16))], ["sid", "regs", "n"])


def _filter_of(ids: DataFrame, col: str, bits: int) -> np.ndarray:
    """A Bloom filter as an array of 64-bit words, of a fixed size: it is collected and broadcast."""
    pos = ids.select(F.explode(F.array(F.pmod(F.xxhash64(col), F.lit(bits)), F.pmod(F.xxhash64(F.lit(7), col), F.lit(bits)))).alias("p"))
    words = pos.groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("m")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words["w"].to_numpy()] = words["m"].to_numpy()
    return out


def full_sets(docs: DataFrame, wanted: DataFrame, size: int, id_col: str, text_col: str, bits: int = 1 << 24) -> DataFrame:
    """(sid, shingles) of the wanted (rid, sid): a second scan that lets only their rows through.

    The filter has false positives only, so the join after it loses nothing, and its size is fixed
    (2 MB), so it can be broadcast whatever the corpus: a full filter costs shuffle, not rows.
    """
    f = docs.sparkSession.sparkContext.broadcast(_filter_of(wanted, "rid", bits))
    hashed = docs.select(F.pmod(F.xxhash64(id_col), F.lit(bits)).alias("p"), F.pmod(F.xxhash64(F.lit(7), F.col(id_col)), F.lit(bits)).alias("q"), F.col(text_col).alias("t"))

    def one(p, q, text):
        if f.value[p >> 6] >> (p & 63) & 1 and f.value[q >> 6] >> (q & 63) & 1:
            s = shingles(text, size)
            if len(s):
                yield xxhash.xxh3_128_digest(s.tobytes()), s.tobytes()

    sets = _arrays(hashed, "sid binary, shingles binary", one, ["p", "q", "t"])
    return sets.join(wanted.select("sid").distinct(), "sid", "left_semi").groupBy("sid").agg(F.first("shingles").alias("shingles"))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int, most: int = 2000) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets.

    The set of `a` meets its partners in a sorted stream, one set in memory at a time; a centre with
    many partners is spread over tasks, `most` partners each.
    """
    n = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_n")).withColumn("_s", F.ceil(F.col("_n") / most).cast("int"))
    left = n.select("a", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)).alias("salt")).join(sets, F.col("a") == F.col("sid"))
    left = left.select("a", "salt", F.lit(None).cast("binary").alias("b"), "shingles")
    right = pairs.join(n.select("a", "_s"), "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("_s")).cast("int"))
    right = right.join(sets, F.col("b") == F.col("sid")).select("a", "salt", "b", "shingles")
    stream = left.unionByName(right).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, of = np.zeros(0, np.uint64), None
        for batch in batches:
            found = []
            for a, b, s in zip(batch.column(0), batch.column(2), batch.column(3), strict=True):
                mine = np.frombuffer(s.as_buffer(), np.uint64)
                a, b = a.as_py(), b.as_py()
                if b is None:
                    centre, of = mine.copy(), a
                    continue
                assert of == a
                at = np.searchsorted(centre, mine)
                both = int(np.count_nonzero(centre[np.minimum(at, len(centre) - 1)] == mine))
                if 100 * both >= percent * (len(centre) + len(mine) - both):
                    found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())], names=["a", "b"])

    return stream.mapInArrow(run, "a binary, b binary")


def likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs whose estimate and set sizes don't rule them out."""
    low = least_estimate(percent / 100)
    both = pairs.join(reps.select(F.col("sid").alias("a"), F.col("regs").alias("ra"), F.col("n").alias("na")), "a").join(reps.select(F.col("sid").alias("b"), F.col("regs").alias("rb"), F.col("n").alias("nb")), "b")
    both = both.where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ra, rb = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(-1, M) for c in batch.columns[2:])
            ok = estimate((ra == rb).sum(axis=1)) >= low
            yield batch.select([0, 1]).filter(pa.array(ok))

    return both.select("a", "b", "ra", "rb").mapInArrow(run, "a binary, b binary")


def stars(banded: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """Two pairs (centre, class) at most for each class in a band with other components.

    A band's centres stand for the first and the last component in an order that differs with `turn`;
    of the centres in all its bands a class takes the first of the first and the last of the last.
    """
    t = banded.join(labels, F.col("sid") == F.col("v"), "left").select("band", "sid", F.coalesce("label", "sid").alias("label"))
    t = t.withColumn("x", F.struct(F.xxhash64("label", F.lit(turn)).alias("o"), "label", "sid"))
    ends = t.groupBy("band").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo.label <> hi.label")
    t = t.join(ends, "band")
    other = lambda end: F.when(F.col(f"{end}.label") != F.col("label"), F.col(end))
    chosen = t.groupBy("sid").agg(F.min(other("lo")).alias("lo"), F.max(other("hi")).alias("hi"))
    pairs = chosen.select(F.explode(F.array("lo.sid", "hi.sid")).alias("a"), F.col("sid").alias("b")).where("a is not null")
    return pairs.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")).distinct().select("a", "b")


def cells(banded: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, cell, k, i, sid, label, n) of the bands that hold several components, dealt out by pairs of k blocks; i is the member's."""
    t = banded.join(labels, F.col("sid") == F.col("v"), "left").select("band", "sid", "n", F.coalesce("label", "sid").alias("label"))
    size = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)
    mixed = t.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.ceil(size).cast("long").alias("k")).where("lo <> hi")
    t = t.join(mixed.select("band", "k"), "band").withColumn("i", F.pmod(F.xxhash64("sid"), F.col("k")))
    cell = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda j: F.least("i", j) * F.col("k") + F.greatest("i", j)))
    return t.withColumn("cell", cell).select("band", "cell", "k", "i", "sid", "label", "n")


CELL = "band long, cell long, k long, i long, sid binary, label binary, n long"


def _in_cells(df: DataFrame, schema: str, per_cell) -> DataFrame:
    """mapInArrow over whole cells; df's columns begin with those of CELL; per_cell(rows) gives rows of `schema`."""
    from tidemark.llm.common import _arrow

    out = pa.schema(_arrow(df.sparkSession, schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            for part in slices(batch, 8 << 20):
                found = []
                for row in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    if group and group[0][:2] != row[:2]:
                        found += per_cell(group)
                        group = []
                    group.append(row)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*found), out, strict=True)], schema=out)
        if group and (found := per_cell(group)):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*found), out, strict=True)], schema=out)

    return df.repartition("band", "cell").sortWithinPartitions("band", "cell").mapInArrow(run, schema)


class _Cell:
    """The members of a cell and the pairs of them that the estimate doesn't rule out and no earlier band has."""

    def __init__(self, group: list[tuple], percent: int):
        band, cell, k = group[0][:3]
        self.percent, self.low, self.cross = percent, least_estimate(percent / 100), cell // k != cell % k
        self.regs = np.frombuffer(b"".join(g[7] for g in group), np.uint16).reshape(-1, M)
        _, self.part = np.unique(np.array([g[5].hex() for g in group]), return_inverse=True)  # components, as far as they are known
        self.n, self.block = np.array([g[6] for g in group]), np.array([g[3] for g in group])
        self.place = bands(self.regs[0]).index(band)

    def partners(self, x: int) -> np.ndarray:
        """Places after x of its possible partners in other components, the likeliest first."""
        y = np.arange(x + 1, len(self.n))
        y = y[(self.part[y] != self.part[x]) & (100 * np.minimum(self.n[y], self.n[x]) >= self.percent * np.maximum(self.n[y], self.n[x]))]
        if self.cross:
            y = y[self.block[y] != self.block[x]]
        same = self.regs[y] == self.regs[x]
        e = estimate(same.sum(axis=1))
        ok = np.flatnonzero(e >= self.low)
        ok = ok[same[ok][:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == self.place]
        return y[ok][np.argsort(-e[ok], kind="stable")]


def suspects(members: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The rows of cells() that have a possible partner in their cell."""

    def per_cell(group: list[tuple]) -> list[tuple]:
        cell, some = _Cell(group, percent), np.zeros(len(group), bool)
        for x in range(len(group)):
            y = cell.partners(x)
            some[y] = True
            some[x] |= len(y) > 0
        return [group[i][:7] for i in np.flatnonzero(some)]

    return _in_cells(members.join(reps.select("sid", "regs"), "sid").select("band", "cell", "k", "i", "sid", "label", "n", "regs"), CELL, per_cell)


def settled(found: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): confirmed links that join the components of each cell, as many as that takes. No list of pairs is held:
    each member meets its likeliest partner first, and then all those in components that are still others."""

    def per_cell(group: list[tuple]) -> list[tuple]:
        cell, own, out = _Cell(group, percent), [np.frombuffer(g[8], np.uint64) for g in group], []
        both = _meeting(own)
        for most in (1, len(group)):
            for x in range(len(group)):
                y = cell.partners(x)[:most]
                for at in range(0, len(y), 256):
                    some = y[at : at + 256]
                    some = some[cell.part[some] != cell.part[x]]
                    for j, shared in zip(some.tolist(), both(x, some), strict=True):
                        if cell.part[x] != cell.part[j] and 100 * shared >= percent * (len(own[x]) + len(own[j]) - shared):
                            cell.part[cell.part == cell.part[j]] = cell.part[x]
                            out.append((min(group[x][4], group[j][4]), max(group[x][4], group[j][4])))
        return out

    full = found.join(reps.select("sid", "regs"), "sid").join(sets, "sid")
    return _in_cells(full.select("band", "cell", "k", "i", "sid", "label", "n", "regs", "shingles"), "a binary, b binary", per_cell)


def _meeting(own: list[np.ndarray], few: int = 64, most_bytes: int = 64 << 20):
    """A function of a place x and places y that gives the sizes of the sets' intersections: by bits if there are many sets, else by search."""
    if len(own) > few:
        shared, of = np.unique(np.concatenate(own), return_inverse=True)
        often = np.bincount(of) > 1
        number = np.cumsum(often) - 1
        width = -(-int(often.sum()) // 64)
        if 0 < len(own) * width * 8 <= most_bytes:
            bits, at = np.zeros((len(own), width * 8), np.uint8), 0
            for i, s in enumerate(own):
                mine = of[at : at + len(s)]
                row = np.zeros(width * 64, bool)
                row[number[mine[often[mine]]]] = True
                bits[i], at = np.packbits(row), at + len(s)
            bits = bits.view(np.uint64)
            return lambda x, y: np.bitwise_count(bits[y] & bits[x]).sum(axis=1, dtype=np.int64).tolist()

    def search(x, y):
        for j in y.tolist():
            a, b = (own[x], own[j]) if len(own[x]) <= len(own[j]) else (own[j], own[x])
            yield int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))

    return search


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row: links where 100 * intersection >= percent * union.

    component_id is the smallest id reachable over links, kept tells id = component_id. Rows without
    words have an empty set and are linked with nothing. Rows with a null id are never a component's
    name: one that reaches no other id has a null component and is kept. Equal rows get equal results; other
    columns are left out, whatever their names; an empty table gives an empty one; texts are taken whole.
    """
    scratch = Scratch(docs.sparkSession)
    sk = scratch.write(sketches(docs, size, id_col, text_col), "sketches")
    reps = scratch.write(sk.where("sid is not null").groupBy("sid").agg(F.min(id_col).alias("rid"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs")), "classes")
    # a set of up to `low` shingles has no different partner: one that differs in one shingle is already too far
    low = percent // (100 - percent)
    rows = scratch.write(band_rows(reps.where(F.col("n") >= low).where(F.col("rid").isNotNull())), "bands")
    ends = rows.groupBy("band").agg(F.min("sid").alias("c1"), F.max("sid").alias("c2")).where("c1 <> c2")
    banded = scratch.write(rows.join(ends.select("band"), "band", "left_semi"), "banded")
    known = reps.limit(0).select(F.col("sid").alias("v"), F.col("sid").alias("label"))
    links: DataFrame | None = None
    for turn in range(ROUNDS + 1):
        if turn < ROUNDS:
            found = scratch.write(likely(stars(banded, known, turn), reps, percent), "pairs")
            sids = found.select(F.col("a").alias("sid")).union(found.select("b")).distinct()
        else:
            found = scratch.write(suspects(cells(banded, known), reps, percent), "suspects")
            sids = found.select("sid").distinct()
        if found.isEmpty():
            continue
        sets = scratch.write(full_sets(docs, sids.join(reps.select("sid", "rid"), "sid"), size, id_col, text_col), "sets")
        new = confirm(found, sets, percent) if turn < ROUNDS else settled(found, reps, sets, percent).distinct()
        new = scratch.write(new, "links")
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            known = components(links, scratch)
        scratch.clear(sk, reps, banded, known, *scratch.of("links"))
    # a class's component by its label, named by the smallest id in it
    named = reps.select("sid", "rid").join(known, F.col("sid") == F.col("v"), "left").select("sid", "rid", F.coalesce("label", "sid").alias("label"))
    least = named.groupBy("label").agg(F.min("rid").alias("component_id"))
    of = scratch.write(named.join(least, "label").select("sid", "component_id"), "named")
    scratch.clear(sk, of)
    linked = sk.where("sid is not null").join(of, "sid").select(id_col, "n_shingles", "component_id")
    # rows without words pass by the join, or all of them would meet on a null key
    out = linked.unionByName(sk.where("sid is null").select(id_col, "n_shingles", F.col(id_col).alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.col("component_id").isNull()))
