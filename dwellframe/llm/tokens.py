"""Token ids in fixed-width, bit-packed blocks.

``write`` orders documents by id (a range partitioning: shard k holds smaller
ids than shard k + 1), encodes each shard in order and packs its ids with the
fewest bits that hold the vocabulary. A block is a row of the written table:

    shard int, block int, start long     place of the block; ids before it in its shard
    bits int, n_ids int, payload binary  n_ids ids of ``bits`` bits each, least significant bit first
    doc_ids array<long>, ends array<int> documents of the block and where each ends in it

Blocks end with a document (the first end at or after ``block_ids`` ids), so one
block is enough to read a document. Eight ids fill ``bits`` bytes exactly;
``unpack`` reads any run of ids with vectorised shifts from the bytes it needs.
Files are written by Spark (a lost task is run again, a failed one leaves
nothing behind), in any store that Spark can write.

Encoding: text is cut before a single space between two other characters, where
a byte-level BPE vocabulary always starts a new piece; a worker has the
tokenizers library encode each distinct piece when it first meets it. Pieces are found and
counted once for a chunk of texts by Arrow, and ids are put together by numpy.
Two generations of pieces are kept, of about ``CACHE`` / 2 each: what is still in
use passes to the new one, so frequent pieces are never encoded anew. A
vocabulary of another kind encodes whole texts.

Defined results: null and empty texts have only the end id; rows without an id
come first; rows with equal ids stand next to each other, by a hash of their
text; an empty table gives no blocks.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_path, small_batches

SCHEMA = "shard int, block int, start long, bits int, n_ids int, payload binary, doc_ids array<long>, ends array<int>"
CACHE = 1_000_000
#: Bytes of text encoded at once: the arrays of a chunk take about fifteen times as much.
CHUNK = 2 << 20
#: What no text without an odd place holds: it marks first pieces.
FIRST = "\0"
_WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Texts in which a space or a line break may not be a cut (RE2 has no class of all white space), and empty ones.
_ODD = f"^ | $|[{_WHITE}][{_WHITE}]|\0|^$"
#: First characters of pieces that no space precedes.
_STARTS = (FIRST, "\n")
#: Marks that form a piece of their own behind a word, and the end of the letters that every version of Unicode knows as such.
_MARKS, _COMMON = ".,;:!?*#$%&", "\u0250"


#: Widths of whole bytes, which need no shifts.
_WHOLE = {8: np.dtype("u1"), 16: np.dtype("<u2"), 32: np.dtype("<u4")}


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids of ``bits`` bits each (1 to 32), one after the other, least significant bit first."""
    if bits in _WHOLE:
        return ids.astype(_WHOLE[bits]).tobytes()
    groups = -(-len(ids) // 8)
    v = np.zeros(groups * 8, np.uint64)
    v[:len(ids)] = ids
    v = v.reshape(groups, 8)
    out = np.zeros((groups, bits + 8), np.uint8)
    for j in range(8):
        byte, shift = divmod(j * bits, 8)
        part = v[:, j] << np.uint64(shift)
        for k in range((shift + bits + 7) // 8):
            out[:, byte + k] |= (part >> np.uint64(8 * k)).astype(np.uint8)
    return out[:, :bits].tobytes()[:-(-len(ids) * bits // 8)]


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a block, from the bytes that hold them."""
    if bits in _WHOLE:
        return np.frombuffer(payload, _WHOLE[bits], count=stop - start, offset=start * bits // 8).astype(np.uint32)
    first, last = start // 8, -(-stop // 8)
    raw = np.frombuffer(payload, np.uint8, count=max(0, min(len(payload), last * bits) - first * bits), offset=min(first * bits, len(payload)))
    groups = last - first
    data = np.zeros((groups, bits + 8), np.uint8)
    full = np.zeros(groups * bits, np.uint8)
    full[:len(raw)] = raw
    data[:, :bits] = full.reshape(groups, bits)
    out = np.empty((groups, 8), np.uint32)
    for j in range(8):
        byte, shift = divmod(j * bits, 8)
        value = np.zeros(groups, np.uint64)
        for k in range((shift + bits + 7) // 8):
            value |= data[:, byte + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, j] = (value >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
    return out.reshape(-1)[start - first * 8:stop - first * 8]


class Pieces:
    """Ids of distinct pieces, one after the other in one array; a piece is known by its number."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts, self.sizes = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self.used = 0

    def add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Distinct new pieces, whose ids follow one another."""
        n, k = len(self.numbers), len(pieces)
        while len(self.flat) < self.used + len(ids):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.starts) < n + k:
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.flat[self.used:self.used + len(ids)] = ids
        self.sizes[n:n + k] = sizes
        self.starts[n:n + k] = self.used + np.cumsum(sizes) - sizes
        self.numbers.update(zip(pieces, range(n, n + k), strict=True))
        self.used += len(ids)

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces of these numbers, joined, and how many each has."""
        return _gather(self.flat, self.starts, self.sizes, numbers)


class Encoder:
    """Ids of whole texts; every distinct piece is encoded once.

    A piece is what stands between two cuts, without its leading space. The first
    piece of a text has none; it is known by its characters behind a ``FIRST``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bits = max(1, max(vocabulary.values()).bit_length())
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        self.breaks = np.zeros(len(self.spaced), bool)
        self.breaks[vocabulary.get("\u010a", 0)] = True
        made = json.loads(self.tokenizer.to_str())
        cut, model = made.get("pre_tokenizer") or {}, made["model"]
        #: Byte-level pieces, cut by the usual rule: only then are cuts known before the library sees the text.
        self.cuts = (cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not made.get("normalizer")
                     and model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges"))
        self.known, self.before = Pieces(), Pieces()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def numbers_of(self, pieces: list[str]) -> np.ndarray:
        """Numbers of distinct pieces; new ones are encoded, those of the generation before pass over."""
        if len(self.known.numbers) > CACHE // 2:
            self.known, self.before = Pieces(), self.known
        get, old = self.known.numbers.get, self.before.numbers
        found = np.array([get(p, -1) for p in pieces], np.int32)
        missing = [pieces[i] for i in np.flatnonzero(found < 0).tolist()]
        if missing:
            if old:
                kept = [p for p in missing if p in old]
                self.known.add(kept, *self.before.ids(np.array([old[p] for p in kept], np.int64)))
                missing = [p for p in missing if p not in old]
            self._learn(missing)
            found[found < 0] = [get(pieces[i]) for i in np.flatnonzero(found < 0).tolist()]
        return found

    def _learn(self, pieces: list[str]) -> None:
        plain = [p for p in pieces if p and " " not in p and p[0] not in _STARTS]
        lines = [p for p in pieces if p[:1] == "\n" and p[1:].isalpha() and p[-1] < _COMMON]
        # One text of many pieces: only the first id of a piece holds a space, or is the line break.
        self._together(plain, " ", self.spaced)
        self._together(lines, "", self.breaks)
        if len(plain) + len(lines) < len(pieces):
            rest = [p for p in pieces if p not in self.known.numbers]
            ids_of = [self.whole(p[1:] if p[:1] == FIRST else p if p[:1] == "\n" else " " + p) for p in rest]
            self.known.add(rest, np.concatenate(ids_of), np.array([len(i) for i in ids_of]))

    def _together(self, pieces: list[str], lead: str, begins: np.ndarray) -> None:
        for k in range(0, len(pieces), 1024):
            some = pieces[k:k + 1024]
            ids = np.array(self.tokenizer.encode_batch_fast([lead + lead.join(some)], add_special_tokens=False)[0].ids, np.uint32)
            self.known.add(some, ids, np.diff(np.append(np.flatnonzero(begins[ids]), len(ids))))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none), joined, and how many each has."""
        texts = texts.cast(pa.string()).fill_null("")
        odd = pc.match_substring_regex(texts, _ODD)
        if not self.cuts or pc.any(odd).as_py():
            flags = odd.to_pylist()
            parts, k = [], 0
            while k < len(flags):  # runs of plain texts go together
                if flags[k] or not self.cuts:
                    parts.append(self._odd(texts[k].as_py()))
                    k += 1
                    continue
                end = next((j for j in range(k, len(flags)) if flags[j]), len(flags))
                parts.append(self._plain(texts.slice(k, end - k)))
                k = end
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        return self._plain(texts)

    def _odd(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """A text with spaces at its ends or beside other white space: only some spaces are cuts."""
        if not text:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if not self.cuts or FIRST in text:
            ids = self.whole(text)
        else:
            first, *rest = _CUT.split(text)
            pieces = [FIRST + first, *(p[1:] for p in rest)]
            place = {p: k for k, p in enumerate(dict.fromkeys(pieces))}
            ids, _ = self.known_ids(list(place), np.array([place[p] for p in pieces], np.int64))
        return ids, np.array([len(ids)])

    def known_ids(self, distinct: list[str], places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        numbers = self.numbers_of(distinct)
        return self.known.ids(numbers[places])

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts in which every space is a cut, and every line break a piece of its own."""
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        begins = split.offsets.to_numpy()
        begins, words = begins[:-1] - begins[0], split.flatten()
        coded = words.dictionary_encode()
        stems, tails = (x.dictionary_encode() for x in _stems(coded.dictionary))
        firsts = words.take(pa.array(begins)).dictionary_encode()
        marks = [FIRST + w for x in (tails, firsts) for w in x.dictionary.to_pylist()]
        marked = {m: k for k, m in enumerate(dict.fromkeys([FIRST, *marks]), len(stems.dictionary))}
        # Two pieces for every distinct word, its stem and its marks; first words stand whole, behind the others.
        n = len(coded.dictionary)
        stem, mark = np.arange(len(stems.dictionary), dtype=np.int32), np.array([marked[m] for m in marks], np.int32)
        pairs = np.empty((n + len(firsts.dictionary), 2), np.int32)
        pairs[:n, 0], pairs[:n, 1] = stem[stems.indices.to_numpy()], mark[tails.indices.to_numpy()]
        pairs[n:, 0], pairs[n:, 1] = mark[len(tails.dictionary):], marked[FIRST]
        flat, sizes = self.known_ids([*stems.dictionary.to_pylist(), *marked], pairs.reshape(-1))
        sizes = sizes[::2] + sizes[1::2]
        places = coded.indices.to_numpy().copy()
        places[begins] = n + firsts.indices.to_numpy()
        ids, sizes = _gather(flat, np.cumsum(sizes, dtype=np.int32) - sizes, sizes, places)
        return ids, np.add.reduceat(sizes, begins)


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs (start, size) of ``flat`` that ``which`` names, joined, and their sizes."""
    own = sizes[which]
    ends = np.cumsum(own, dtype=np.int32)
    place = np.repeat(starts[which] - (ends - own), own)
    place += np.arange(len(place), dtype=np.int32)
    return flat[place], own


def _stems(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Each word without the marks at its end, and the marks; words that are not letters before their marks stay whole."""
    bare = pc.utf8_rtrim(words, characters=_MARKS)
    letters = pc.and_(pc.utf8_is_alpha(pc.utf8_ltrim(bare, characters="\n")), pc.less(pc.utf8_slice_codeunits(bare, -1), _COMMON))
    bare = pc.if_else(letters, bare, words)
    sizes, offsets = pc.binary_length(bare).to_numpy().astype(np.int64), np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1]
    first, length = offsets[:-1] + sizes, np.diff(offsets) - sizes
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    data = np.frombuffer(words.buffers()[2], np.uint8)[np.arange(total) + np.repeat(first - (ends - length), length)] if total else np.zeros(0, np.uint8)
    tails = pa.StringArray.from_buffers(len(words), pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data.tobytes()))
    return bare, tails


@functools.lru_cache(maxsize=4)
def encoder_of(path: str) -> Encoder:
    """One encoder for each tokenizer file in a Python worker: what one task learned serves the next."""
    return Encoder(path)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) in parts of about ``CHUNK`` bytes of text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // CHUNK
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def write(docs: DataFrame, path: str, tokenizer: str, text: str = "text", key: str = "doc_id", end_id: int = 0, block_ids: int = 1 << 16) -> None:
    """Write the blocks of all documents to ``path``; ``tokenizer`` is a file that every executor can read."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("t"), F.xxhash64(F.col(f"`{text}`")).alias("h"))
    ordered = rows.repartitionByRange(F.asc_nulls_first("id"), F.asc("h")).sortWithinPartitions(F.asc_nulls_first("id"), "h")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encoder = TaskContext.get().partitionId(), encoder_of(tokenizer)
        block, start, size = 0, 0, 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        ends: list[int] = []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "start": pa.array([start], pa.int64()), "bits": pa.array([encoder.bits], pa.int32()),
                "n_ids": pa.array([size], pa.int32()), "payload": pa.array([pack(np.concatenate(ids), encoder.bits)], pa.binary()),
                "doc_ids": pa.array([names], pa.list_(pa.int64())), "ends": pa.array([ends], pa.list_(pa.int32()))})

        end = np.array([end_id], np.uint32)
        for part in _chunks(batches):
            flat, sizes = encoder.encode(part.column(1))
            at = 0
            for name, n in zip(part.column(0).to_pylist(), sizes.tolist(), strict=True):
                ids += [flat[at:at + n], end]
                at += n
                size += n + 1
                names.append(name)
                ends.append(size)
                if size >= block_ids:
                    yield row()
                    block, start, size = block + 1, start + size, 0
                    ids, names, ends = [], [], []
        if names:
            yield row()

    with small_batches(docs.sparkSession):
        ordered.select("id", "t").mapInArrow(encode, SCHEMA).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document in the files."""
    blocks = spark.read.schema(SCHEMA).parquet(path)
    # One row for each shard: their number is that of the write's tasks, whatever the corpus holds.
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = sizes.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("before"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                shard, start, bits, n, payload, names, ends = (batch.column(c)[r].as_py() for c in range(7))
                ids = unpack(payload, bits, 0, n).astype("<u4")
                firsts = [0, *ends[:-1]]
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(firsts, ends, strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([shard] * len(ends), pa.int32()), "doc_id": pa.array(names, pa.int64()), "start": pa.array([start + a for a in firsts], pa.int64()),
                    "n_tokens": pa.array([b - a for a, b in zip(firsts, ends, strict=True)], pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})

    docs = blocks.select("shard", "start", "bits", "n_ids", "payload", "doc_ids", "ends").mapInArrow(scan, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return docs.join(before, "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def document(blocks: DataFrame, doc_id: int) -> list[np.ndarray]:
    """The ids of one document (random access): only blocks that hold it are read, only its ids unpacked."""
    out = []
    for r in blocks.where(F.array_contains("doc_ids", doc_id)).orderBy("shard", "block").toLocalIterator():
        for k, name in enumerate(r.doc_ids):
            if name == doc_id:
                out.append(unpack(r.payload, r.bits, r.ends[k - 1] if k else 0, r.ends[k]))
    return out


def write_and_read(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write to a fresh folder in the shared place, and read the files back."""
    spark = docs.sparkSession
    path = shared_path(spark, "tokens")
    write(docs, path, tokenizer, **options)
    return read(spark, path)
