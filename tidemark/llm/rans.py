"""Token ids as binary blocks of a static range asymmetric numeral system (rANS).

The file format is a folder with two Parquet tables that Spark's committers write: `table` has the
shared frequency table (symbol, frequency; sums to 2**bits), `blocks` one row a block. A block is
independent and holds whole documents in order; `lanes` interleaved 64-bit coders share its one
stream of 32-bit words, so numpy codes all lanes at once. Every few steps the lane states and the
place in the stream are kept as a checkpoint from which decoding can begin, and a CRC-32 guards the
payload. Blocks are decoded in parallel and in any order.

Two passes: ids are written once, counted, and only then coded, as the table must cover all of them.
"""

import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import CHUNKS, Memo
from tidemark.llm.common import shared_dir, slices, written

MAGIC = b"RAB1"
HEADER = struct.Struct("<4sIIII")  # magic, tokens, lanes, steps, steps between checkpoints
LOW = np.uint64(1 << 32)
WORD = np.uint64(32)
BLOCK_TOKENS, LANES, EVERY = 1 << 20, 4096, 64
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: A word of Latin letters and the ASCII symbols after it: the library's pattern cuts there, and nowhere else in it.
PLAIN = re.compile(rf"([{LETTERS}]+)([!-/:-@\[-`{{-~]*)\Z")
#: A byte-level vocabulary writes bytes as characters: visible ones of Latin-1 as themselves, the others from U+0100 on.
_OWN = [b for b in range(256) if 0x21 <= b <= 0x7E or b >= 0xA1 and b != 0xAD]
_CHARS = {b: chr(b) for b in _OWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _OWN)}
BYTES = {c: "".join(_CHARS[b] for b in chr(c).encode()) for c in range(256)}
SPACES = frozenset(chr(c) for c in [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


class Table:
    """Symbol frequencies scaled to 2**bits, with the decoder's slot tables built when first used."""

    def __init__(self, symbols: np.ndarray, freqs: np.ndarray, bits: int):
        self.bits, self.symbols, self.freqs = np.uint64(bits), symbols.astype(np.uint32), freqs.astype(np.uint64)
        size = int(symbols.max(initial=0)) + 1
        self.f, self.c = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.f[symbols] = self.freqs
        self.c[symbols] = np.cumsum(self.freqs) - self.freqs
        self.slots: np.ndarray | None = None

    @classmethod
    def of_counts(cls, symbols: np.ndarray, counts: np.ndarray, bits: int = 20) -> "Table":
        """Every counted symbol gets a slot at least; no symbol gets all (its state would overflow)."""
        bits = max(bits, int(len(symbols) + 1).bit_length() + 1)
        missing = [k for k in range(2) if k not in symbols][: max(0, 2 - len(symbols))]
        symbols, counts = np.append(symbols.astype(np.int64), missing).astype(np.int64), np.append(counts.astype(np.float64), [1.0] * len(missing))
        order = np.argsort(symbols)
        symbols, counts = symbols[order], counts[order]
        total = 1 << bits
        freqs = np.maximum(1, np.floor(counts / counts.sum() * (total - len(symbols)))).astype(np.int64)
        order = np.argsort(-freqs, kind="stable")
        while over := int(freqs.sum()) - total:
            if over < 0:
                freqs[order[0]] -= over
            else:
                for i in order:
                    take = min(over, int(freqs[i]) - 1)
                    freqs[i] -= take
                    over -= take
        return cls(symbols, freqs, bits)

    def decoder(self) -> np.ndarray:
        """The symbol of each slot; frequencies and starts are looked up by symbol, in tables that caches hold."""
        if self.slots is None:
            self.slots = np.repeat(self.symbols, self.freqs.astype(np.int64))
        return self.slots


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = EVERY) -> bytes:
    n = len(ids)
    while lanes > 1 and n < 16 * lanes:
        lanes //= 2
    steps = -(-n // lanes)
    if not n:
        return HEADER.pack(MAGIC, 0, lanes, 0, every)
    grid = np.full(steps * lanes, ids[-1], np.int64)
    grid[:n] = ids
    grid = grid.reshape(steps, lanes)
    x, words, made = np.full(lanes, LOW, np.uint64), [], 0
    states, marks = np.zeros((-(-steps // every), lanes), np.uint64), []
    shift = np.uint64(64) - table.bits
    for t in range(steps - 1, -1, -1):
        f = table.f[grid[t]]
        over = x >= f << shift
        if over.any():
            words.append(x[over].astype(np.uint32))
            made += len(words[-1])
            x[over] >>= WORD
        q = x // f
        x = (q << table.bits) + (x - q * f) + table.c[grid[t]]
        if t % every == 0:
            states[t // every] = x
            marks.append(made)
    starts = np.array([made - m for m in reversed(marks)], np.uint64)
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    return HEADER.pack(MAGIC, n, lanes, steps, every) + starts.astype("<u8").tobytes() + states.astype("<u8").tobytes() + stream.astype("<u4").tobytes()


def decode_block(payload: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids from checkpoint `first` up to checkpoint `last` (to the end if None)."""
    magic, n, lanes, steps, every = HEADER.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a block of this format")
    marks = -(-steps // every)
    starts = np.frombuffer(payload, "<u8", marks, HEADER.size)
    states = np.frombuffer(payload, "<u8", marks * lanes, HEADER.size + 8 * marks).reshape(marks, lanes)
    words = np.frombuffer(payload, "<u4", offset=HEADER.size + 8 * marks * (lanes + 1)).astype(np.uint64)
    until = steps if last is None else min(steps, last * every)
    begin = first * every
    if begin >= until:
        return np.zeros(0, np.uint32)
    sym, freq, start = table.decoder(), table.f, table.c
    mask = (np.uint64(1) << table.bits) - np.uint64(1)
    x, at, out = states[first].copy(), int(starts[first]), np.empty((until - begin, lanes), np.uint32)
    for t in range(until - begin):
        slot = x & mask
        s = sym[slot]
        out[t] = s
        x = freq[s] * (x >> table.bits) + (slot - start[s])
        under = x < LOW
        k = int(np.count_nonzero(under))
        if k:
            x[under] = (x[under] << WORD) | words[at : at + k]
            at += k
    return out.reshape(-1)[: max(0, n - begin * lanes)]


class Encoder:
    """Ids of whole texts by the tokenizers library, as little-endian integers of `width`.

    A text is cut before each single space in front of a visible character, where the library's own splitting
    cuts too. Arrow numbers the distinct pieces of many texts, each piece's ids are worked out or remembered
    once, and numpy puts the texts' ids together. A piece that is a word of Latin letters, with ASCII symbols
    behind it or not, is two pieces of the library's: its word goes to the library's model at once, in the
    characters that stand for bytes there. Texts with other runs of white space are cut by CHUNKS, and those
    that hold an added token (which the library takes out before it splits) go to it as they are.
    """

    def __init__(self, path: str, memo: int):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.width = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = {2: "H", 4: "I"}[self.width.itemsize]
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values() if t.content]
        self.known: dict[str, bytes | None] = {}  # ids of " " and the key; None where that isn't a piece by itself
        self.before: dict[str, bytes | None] = {}  # what was known the time before, so that frequent pieces outlive a full memory
        self.limit = max(1, memo // 2)
        self.tails = Memo(self._whole, 10_000)
        self.other = Memo(self._bare, 10_000)

    def blob(self, text: str | None) -> bytes:
        ids, _ = self.ids(pa.array([text], pa.string()))
        return ids.tobytes()

    def ids(self, texts: pa.StringArray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (and the last one's end). end_id goes behind each."""
        if len(self.known) > self.limit:
            self.known, self.before = {}, self.known
        texts = pc.fill_null(texts, "")
        pieces = pc.split_pattern(texts, " ")
        ends = pieces.offsets.to_numpy()
        heads, ends = ends[:-1] - ends[0], ends[1:] - ends[0]
        flat = pieces.flatten().dictionary_encode()
        at = flat.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        inner = np.ones(len(at), bool)
        inner[heads] = False
        used = np.zeros(len(flat.dictionary), bool)
        used[at[inner]] = True
        known, table = self.known, []
        for p, u in zip(flat.dictionary.to_numpy(zero_copy_only=False).tolist(), used.tolist(), strict=True):
            if not u:
                table.append(b"")
            elif p in known:
                table.append(known[p])
            else:
                known[p] = ids = self._piece(p)
                table.append(ids)
        odd = np.array([x is None for x in table], bool)
        alone = np.zeros(len(texts), bool)  # texts that aren't put together from pieces
        if odd.any():
            alone[np.searchsorted(ends, np.flatnonzero(odd[at] & inner), "right")] = True
            table = [x or b"" for x in table]
        special = np.zeros(len(texts), bool)
        for a in self.added:
            special |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        # a text's first piece has no space before it: it has a place of its own in the table, as the whole of some texts has
        at[heads] = len(table) + np.arange(len(texts))
        for i, (head, whole, lib) in enumerate(zip(pc.list_element(pieces, 0).to_numpy(zero_copy_only=False).tolist(), alone.tolist(), special.tolist(), strict=True)):
            table.append(self._whole(texts[i].as_py()) if lib else self._chunks(texts[i].as_py() if whole else head))
        size = np.fromiter(map(len, table), np.int64, len(table)) // self.width.itemsize
        first = np.cumsum(size) - size
        pool = np.frombuffer(b"".join(table), self.width)
        n = size[at]
        if (alone | special).any():
            n[inner & np.repeat(alone | special, ends - heads)] = 0
        if end_id is not None:
            first, pool = np.append(first, len(pool)), np.append(pool, np.array([end_id], self.width))
            at, n = np.insert(at, ends, len(first) - 1), np.insert(n, ends, 1)
            ends = ends + np.arange(1, len(texts) + 1)
        upto = np.concatenate([[0], np.cumsum(n)])
        where = np.repeat(first[at] - upto[:-1], n)
        where += np.arange(len(where))
        return pool[where], upto[np.concatenate([[0], ends])]

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _chunks(self, text: str) -> bytes:
        out = []
        for c in CHUNKS.findall(text):
            if c[0] == " " and len(c) > 1 and c[1] not in SPACES:
                ids = self.known.get(c[1:])
                if ids is None:
                    ids = self.known[c[1:]] = self._piece(c[1:])
            else:
                ids = self.other[c]
            out.append(ids)
        return b"".join(out)

    def _piece(self, piece: str) -> bytes | None:
        if piece.isascii() and piece.isalpha():
            return self.before.get(piece) or self._word(f"\u0120{piece}")
        if not piece or piece[0] in SPACES:
            return None
        if piece in self.before:
            return self.before[piece]
        word = PLAIN.match(piece)
        if not word:
            return self._whole(f" {piece}") if SPACES.isdisjoint(piece) else self._chunks(f" {piece}")
        stem, tail = word.groups()
        ids = self.known.get(stem) or self.before.get(stem)
        if ids is None:
            ids = self.known[stem] = self._word(f" {stem}".translate(BYTES))
        return ids + self.tails[tail] if tail else ids

    def _bare(self, chunk: str) -> bytes:
        """Ids of a chunk without a space before it."""
        word = PLAIN.match(chunk)
        if not word:
            return self._whole(chunk)
        ids = self._word(word[1].translate(BYTES))
        return ids + self.tails[word[2]] if word[2] else ids

    def _word(self, chars: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(chars)]).tobytes()


def tokenize(docs: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", memo: int = 1_000_000) -> DataFrame:
    """(id, n_tokens, width, ids as little-endian integers of 2 or 4 bytes) by the tokenizers library, end_id last.

    Null and empty texts have end_id alone. Other columns are left out; repeated and null ids stay rows of their own.
    """
    from tidemark.llm.common import _arrow

    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens long, width int, ids binary"
    out = pa.schema(_arrow(docs.sparkSession, schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _loaded:
            _loaded.clear()
            _loaded[path] = Encoder(path, memo)
        encoder = _loaded[path]
        size = encoder.width.itemsize
        for batch in batches:
            for part in slices(batch, 8 << 20):
                ids, starts = encoder.ids(part.column(1).cast(pa.string()), end_id)
                blobs = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(np.ascontiguousarray(starts * size, np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
                cols = [part.column(0), pa.array(np.diff(starts)), pa.array(np.full(len(starts) - 1, size, np.int32)), blobs]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


_loaded: dict[str, Encoder] = {}


def count_symbols(tokens: DataFrame) -> DataFrame:
    """(symbol, n) over all ids: one bincount a task, then a sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch, 8 << 20):
                blobs, widths = part.column(0).to_pylist(), part.column(1).to_pylist()
                for width in set(widths):
                    ids = np.frombuffer(b"".join([x for x, w in zip(blobs, widths, strict=True) if w == width]), f"<u{width}")
                    got = np.bincount(ids, minlength=len(total))
                    got[: len(total)] += total
                    total = got
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["symbol", "n"])

    return tokens.select("ids", "width").mapInArrow(run, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))


def write(tokens: DataFrame, folder: str, id_col: str = "doc_id") -> None:
    """Write tokenize()'s rows in ascending id order (null ids first, equal ids by their ids' bytes).

    The frequency table is collected: it has a row for each symbol of the vocabulary at most.
    """
    spark = tokens.sparkSession
    counts = count_symbols(tokens).collect()
    table = Table.of_counts(np.array([r[0] for r in counts], np.int64), np.array([r[1] for r in counts], np.int64))
    bits = int(table.bits)
    spark.createDataFrame([(int(s), int(f), bits) for s, f in zip(table.symbols, table.freqs)], "symbol long, frequency long, bits int").coalesce(1).write.parquet(f"{folder}/table")
    shared = spark.sparkContext.broadcast((table.symbols, table.freqs, bits))
    kind = tokens.schema[id_col].dataType.simpleString()
    schema = f"part int, block int, ids array<{kind}>, lengths array<long>, n_tokens long, crc long, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part, block = Table(*shared.value), TaskContext.get().partitionId(), 0
        ids, arrays, held = [], [], 0

        def flush():
            nonlocal ids, arrays, held, block
            payload = encode_block(np.concatenate(arrays), t)
            row = [[part], [block], [ids], [[len(a) for a in arrays]], [held], [zlib.crc32(payload)], [payload]]
            block, ids, arrays, held = block + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, out, strict=True)], schema=out)

        for batch in batches:
            for i, width, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids.append(i)
                arrays.append(np.frombuffer(blob.as_py(), f"<u{width}"))
                held += len(arrays[-1])
                if held >= BLOCK_TOKENS:
                    yield flush()
        if ids:
            yield flush()

    from tidemark.llm.common import _arrow

    out = pa.schema(_arrow(spark, schema))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = tokens.select(id_col, "width", "ids").repartitionByRange(parts, id_col).sortWithinPartitions(id_col, "ids")
    ordered.mapInArrow(run, schema).write.option("compression", "none").parquet(f"{folder}/blocks")


def read(spark: SparkSession, folder: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]) of every document; start counts all ids before it.

    Offsets are summed in two levels: blocks within their part, then parts. Raises on a wrong checksum.
    """
    rows = spark.read.parquet(f"{folder}/table").collect()
    rows.sort(key=lambda r: r["symbol"])
    shared = spark.sparkContext.broadcast((np.array([r["symbol"] for r in rows]), np.array([r["frequency"] for r in rows]), rows[0]["bits"]))
    blocks = spark.read.parquet(f"{folder}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("part_start"))
    inner = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("part", "block", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)).alias("in_part")).join(parts, "part").select("part", "block", (F.col("in_part") + F.col("part_start")).alias("start"))
    placed = blocks.join(starts, ["part", "block"]).select("ids", "lengths", "start", "crc", "payload")
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    schema = f"{id_col} {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(*shared.value)
        for batch in batches:
            for part in slices(batch, 1):
                ids, lengths, start, crc, payload = (c[0].as_py() for c in part.columns)
                if zlib.crc32(payload) != crc:
                    raise ValueError("a block's checksum is wrong")
                got = decode_block(payload, table)
                ends = np.cumsum(np.array(lengths, np.int64))
                offsets = np.concatenate([[0], ends])
                bytes_ = memoryview(got.astype("<u4").tobytes())
                crcs = [zlib.crc32(bytes_[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:])]
                cols = [pa.array(ids, id_type), pa.array(offsets[:-1] + start, pa.int64()), pa.array(np.array(lengths, np.int64)), pa.array(crcs, pa.int64())]
                names = [id_col, "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(got.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(blocks.schema["ids"].dataType.elementType)
    return placed.mapInArrow(run, schema)


def written_and_read(docs: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """tokenize(), write() to the shared folder and read() back. Null texts count as empty: end_id alone."""
    import uuid

    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/rans-{uuid.uuid4().hex}"
    write(written(tokenize(docs, path, end_id, id_col, text_col), "tokens"), folder, id_col)
    return read(spark, folder, id_col, with_ids)
