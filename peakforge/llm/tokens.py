"""Token ids in binary files: patched frame-of-reference blocks with an index of blocks and documents.

A file is a stream of ids, cut into blocks of BLOCK ids whatever the documents are, followed by its indexes:

    block:   minimum u32, width u8, exceptions u16, then the low `width` bits of (id - minimum) packed in order,
             then the exceptions' places (u8) and their high bits (u32)
    index:   start of each block (u64), ids of the documents (i64, and a byte each: is it null), their starts in ids (u64)
    trailer: documents u64, blocks u64, ids u64, place of the index u64, MAGIC
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakforge.llm import text as T
from peakforge.llm.store import narrow_batches, new_path, written

BLOCK = 256
GROUP = 2048  # blocks handled at once
MAGIC = b"PFOR0001"
TRAILER = 40
END_ID = 0
#: Words whose ids a worker keeps; beyond that it starts anew, which costs time only.
KEPT = 200_000
#: What stands for the end of a text among its words; a text with a NUL of its own is encoded whole.
END = "\0\0"
_WHITE = "".join(f"\\x{{{ord(c):x}}}" for c in map(chr, range(0x110000)) if c.isspace())
#: Parts that neither begin nor end with white space, but for the NUL or newline that marks what stands before them.
PLAIN = f"(?s)^[\\x00\n]?[^{_WHITE}](.*[^{_WHITE}])?$"
#: Bytes of text that are encoded at once; a longer text is one batch.
BATCH = 1 << 22


# blocks


def pack(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bytes of the blocks of ids, and the size of each. The last block may be short; its rest is filled with its minimum.

    The width is the percentile of the bit lengths that makes the block smallest: what is longer becomes an exception.
    """
    n = -(-len(ids) // BLOCK)
    full = np.empty(n * BLOCK, np.uint32)
    full[: len(ids)] = ids
    if len(ids) % BLOCK:
        full[len(ids) :] = ids[(n - 1) * BLOCK :].min()
    v = full.reshape(n, BLOCK)
    low = v.min(axis=1)
    v = v - low[:, None]
    length = np.frexp(v.astype(np.float32 if v.max(initial=0) < 1 << 24 else np.float64))[1]
    row = np.arange(n)[:, None] * 33
    longer = BLOCK - np.cumsum(np.bincount((length + row).reshape(-1), minlength=n * 33).reshape(n, 33), axis=1)
    width = (np.arange(33) * (BLOCK // 8) + longer * 5).argmin(axis=1)
    odd_block, odd_place = np.nonzero(length > width[:, None])
    high = (v[odd_block, odd_place].astype(np.uint64) >> width[odd_block].astype(np.uint64)).astype("<u4")
    first = np.searchsorted(odd_block, np.arange(n + 1)).tolist()
    places, heads = odd_place.astype(np.uint8), low.astype("<u4").tobytes()
    out: list[bytes] = [b""] * n
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        unit = np.uint8 if w <= 8 else np.dtype("<u2") if w <= 16 else np.dtype("<u4")
        bits = np.unpackbits(v[at].astype(unit).view(np.uint8).reshape(len(at), BLOCK, -1), axis=2, bitorder="little")[:, :, :w]
        body = np.packbits(bits.reshape(len(at), BLOCK * w), axis=1, bitorder="little")
        for i, k in enumerate(at.tolist()):
            x, y = first[k], first[k + 1]
            out[k] = heads[4 * k : 4 * k + 4] + bytes((w, y - x & 255, y - x >> 8)) + body[i].tobytes() + places[x:y].tobytes() + high[x:y].tobytes()
    return b"".join(out), np.array([len(x) for x in out], np.int64)


def unpack(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at starts in data."""
    raw = np.frombuffer(data, np.uint8)
    out = np.empty((len(starts), BLOCK), np.uint32)
    low = raw[starts[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
    width = raw[starts + 4].astype(np.int64)
    odd = raw[starts + 5].astype(np.int64) | raw[starts + 6].astype(np.int64) << 8
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        size = int(w) * BLOCK // 8
        if not w:
            out[at] = 0
            continue
        bits = np.unpackbits(raw[starts[at][:, None] + 7 + np.arange(size)], axis=1, bitorder="little")
        unit = 8 if w <= 8 else 16 if w <= 16 else 32
        wide = np.zeros((len(at) * BLOCK, unit), np.uint8)
        wide[:, :w] = bits.reshape(-1, w)
        out[at] = np.packbits(wide, axis=1, bitorder="little").view(f"<u{unit // 8}").reshape(len(at), BLOCK)
    for k in np.flatnonzero(odd):
        n, w = int(odd[k]), int(width[k])
        p = int(starts[k]) + 7 + w * BLOCK // 8
        high = raw[p + n : p + 5 * n].copy().view("<u4").astype(np.uint64) << np.uint64(w)
        out[k, raw[p : p + n]] |= high.astype(np.uint32)
    return (out + low[:, None]).reshape(-1)


class Writer:
    def __init__(self, path: str):
        system, name = fs.FileSystem.from_uri(path)
        system.create_dir(name.rpartition("/")[0], recursive=True)
        self.file = system.open_output_stream(name)
        self.rest = np.zeros(0, np.uint32)
        self.starts: list[np.ndarray] = []
        self.docs: list[tuple[int | None, int]] = []
        self.place = self.ids = 0

    def add(self, doc_ids: list, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.docs += zip(doc_ids, (self.ids + np.cumsum(sizes) - sizes).tolist(), strict=True)
        self.ids += len(ids)
        self.rest = np.concatenate([self.rest, ids])
        while len(self.rest) >= GROUP * BLOCK:
            self._blocks(self.rest[: GROUP * BLOCK])
            self.rest = self.rest[GROUP * BLOCK :]

    def _blocks(self, ids: np.ndarray) -> None:
        data, sizes = pack(ids)
        self.file.write(data)
        self.starts.append(self.place + np.cumsum(sizes) - sizes)
        self.place += len(data)

    def close(self) -> None:
        if len(self.rest):
            self._blocks(self.rest)
        starts = np.concatenate([*self.starts, np.zeros(0, np.int64)])
        self.file.write(starts.astype("<u8").tobytes())
        self.file.write(np.array([d or 0 for d, _ in self.docs], "<i8").tobytes())
        self.file.write(bytes(d is None for d, _ in self.docs))
        self.file.write(np.array([s for _, s in self.docs], "<u8").tobytes())
        self.file.write(np.array([len(self.docs), len(starts), self.ids, self.place], "<u8").tobytes() + MAGIC)
        self.file.close()


class Reader:
    """Random access to a file by document or by block."""

    def __init__(self, path: str):
        system, name = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(name)
        size = self.file.size()
        self.file.seek(size - TRAILER)
        tail = self.file.read(TRAILER)
        if tail[32:] != MAGIC:
            raise ValueError(f"{path} is no token file")
        self.n_docs, self.n_blocks, self.n_ids, place = np.frombuffer(tail, "<u8", 4).astype(np.int64).tolist()
        self.file.seek(place)
        index = self.file.read(size - TRAILER - place)
        at = 8 * self.n_blocks
        self.blocks = np.append(np.frombuffer(index, "<u8", self.n_blocks).astype(np.int64), place)
        self.doc_ids = np.frombuffer(index, "<i8", self.n_docs, at)
        self.null = np.frombuffer(index, np.uint8, self.n_docs, at + 8 * self.n_docs).astype(bool)
        self.starts = np.append(np.frombuffer(index, "<u8", self.n_docs, at + 9 * self.n_docs).astype(np.int64), self.n_ids)

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids at places first to last - 1, from the blocks that hold them alone."""
        if first >= last:
            return np.zeros(0, np.uint32)
        lo, hi = first // BLOCK, -(-last // BLOCK)
        self.file.seek(int(self.blocks[lo]))
        data = self.file.read(int(self.blocks[hi] - self.blocks[lo]))
        return unpack(data, self.blocks[lo:hi] - self.blocks[lo])[first - lo * BLOCK : last - lo * BLOCK]

    def close(self) -> None:
        self.file.close()


# encoding


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes, dtype=np.int32) - sizes


class Encoder:
    """Ids of a byte-level BPE tokenizer, as encode(text, add_special_tokens=False) gives them, remembering the ids of words.

    Its splitting never joins what stands before a space with what follows, if neither neighbour of the space is white
    space, and the same holds for a newline; so such texts are cut into words, and each different word of a batch is
    looked up once. Any other text, and one that holds an added token such as <|endoftext|> (which becomes that token's
    id, as the library does it), is encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [str(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.bytes = np.zeros(self.tok.get_vocab_size(), np.int64)
        for token, i in self.tok.get_vocab().items():  # in a byte-level vocabulary a character stands for a byte
            self.bytes[i] = len(token)
        self.known = pa.array([END])  # words, and for each: where its ids are, how many, how often used, is its text encoded whole
        self.at, self.size, self.uses, self.odd = np.zeros(1, np.int32), np.ones(1, np.int32), np.zeros(1, np.int32), np.zeros(1, bool)
        self.pool = np.array([END_ID], np.uint32)

    def forget(self) -> None:
        """Drop the words that only one batch has had."""
        self.uses[0] = 2
        row = np.flatnonzero(self.uses > 1)
        self.known = self.known.take(pa.array(row))
        self.pool, self.size, self.odd = self._ids(row), self.size[row], self.odd[row]
        self.at, self.uses = _starts(self.size), np.zeros(len(row), np.int32)

    def _ids(self, row: np.ndarray) -> np.ndarray:
        """The ids of rows, one after the other."""
        size = self.size[row]
        at = np.repeat(self.at[row] - _starts(size), size)
        at += np.arange(len(at), dtype=np.int32)
        return self.pool[at]

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, each encoded alone, in a row; and how many each has."""
        ids = [np.array(e.ids, np.uint32) for i in range(0, len(texts), 32) for e in self.tok.encode_batch_fast(texts[i : i + 32], add_special_tokens=False)]
        return np.concatenate([*ids, np.zeros(0, np.uint32)]), np.array([len(x) for x in ids], np.int64)

    def together(self, parts: pa.Array, some: int = 400) -> tuple[np.ndarray, np.ndarray]:
        """As whole, but many of parts are encoded in one text: the ids' lengths in bytes tell where each part ends."""
        ends = np.cumsum(pc.binary_length(parts).to_numpy())
        if not len(parts):
            return self.whole([])
        data = parts.buffers()[2][np.frombuffer(parts.buffers()[1], np.int32)[parts.offset] :]
        cuts = [0, *ends[some - 1 : -1 : some].tolist(), int(ends[-1])]
        ids, _ = self.whole([data[x:y].to_pybytes().decode() for x, y in zip(cuts[:-1], cuts[1:], strict=True)])
        upto = np.cumsum(self.bytes[ids])
        cut = np.searchsorted(upto, ends)
        if len(upto) != cut[-1] + 1 or (upto[cut] != ends).any():
            return self.whole(parts.to_pylist())
        return ids, np.diff(cut, prepend=-1)

    def _learn(self, parts: pa.Array) -> None:
        """Add parts to the known: words with what stands before them, a NUL for the start of a text, a newline, or nothing for a space."""
        odd = ~pc.match_substring_regex(parts, PLAIN).to_numpy(zero_copy_only=False)
        for token in self.added:
            odd |= pc.match_substring(parts, token).to_numpy(zero_copy_only=False)
        start = pc.starts_with(parts, "\0").to_numpy(zero_copy_only=False)
        first, inner = parts.filter(pa.array(~odd & start)), parts.filter(pa.array(~odd & ~start))
        whole = self.whole(pc.binary_replace_slice(first.cast(pa.binary()), 0, 1, b"").cast(pa.string()).to_pylist())
        together = self.together(pc.if_else(pc.starts_with(inner, "\n"), inner, pc.binary_join_element_wise(pa.scalar(" "), inner, "")))
        self.known = pa.concat_arrays([self.known, first, inner, parts.filter(pa.array(odd))])
        sizes = np.concatenate([whole[1], together[1], np.zeros(int(odd.sum()))]).astype(np.int32)
        self.at = np.concatenate([self.at, len(self.pool) + _starts(sizes)])
        self.size = np.concatenate([self.size, sizes])
        self.uses = np.concatenate([self.uses, np.zeros(len(sizes), np.int32)])
        self.odd = np.concatenate([self.odd, np.arange(len(sizes)) >= len(sizes) - int(odd.sum())])
        self.pool = np.concatenate([self.pool, whole[0], together[0]])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts in a row, END_ID after each, and how many each has with it."""
        if len(self.known) > KEPT:
            self.forget()
        n = len(texts)
        odd = pc.match_substring(texts, "\0").to_numpy(zero_copy_only=False)
        for token in self.added:
            odd = odd | pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        marked = pc.binary_join_element_wise(pa.scalar("\0"), pc.replace_substring(texts, "\n", " \n"), pa.scalar(" " + END), "")
        lists = pc.split_pattern(marked, " ")
        words = lists.flatten().dictionary_encode()
        rows = pc.index_in(words.dictionary, self.known)
        if rows.null_count:
            self._learn(words.dictionary.filter(rows.is_null()))
            rows = pc.index_in(words.dictionary, self.known)
        rows = rows.to_numpy()
        self.uses[rows] += 1
        row = rows[words.indices.to_numpy()]
        starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        strange = self.odd[row]
        if strange.any():
            odd = odd | np.logical_or.reduceat(strange, starts[:-1])
        if not odd.any():
            return self._ids(row), np.add.reduceat(self.size[row], starts[:-1], dtype=np.int64)
        text = np.repeat(np.arange(n), np.diff(starts))
        row = row[~odd[text]]
        ids = self._ids(row)
        sizes = np.bincount(text[~odd[text]], self.size[row], n).astype(np.int64)
        some = np.flatnonzero(odd)
        rest, sizes[some] = self.whole(texts.take(pa.array(some)).to_pylist())
        out = np.empty(len(ids) + len(rest) + len(some), np.uint32)
        sizes[some] += 1
        whole = np.repeat(odd, sizes)
        out[~whole] = ids
        ends = np.cumsum(sizes)[some] - 1
        whole[ends] = False
        out[whole], out[ends] = rest, END_ID
        return out, sizes


_ENCODERS: dict[str, Encoder] = {}


def _write(folder: str, tokenizer: str) -> Callable:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = Encoder(tokenizer)
        encoder = _ENCODERS[tokenizer]
        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.pfor"  # a task that is run again leaves a file that no manifest names
        out = None
        for b in batches:
            texts = b.column(1).fill_null("")
            for lo, hi, _, _ in T.slices(b, b.schema.names[1], BATCH):
                ids, sizes = encoder(texts.slice(lo, hi - lo))
                out = out or Writer(path)
                out.add(b.column(0).slice(lo, hi - lo).to_pylist(), sizes, ids)
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([len(out.docs)], pa.int64()), pa.array([out.ids], pa.int64())], names=["part", "path", "n_docs", "n_ids"])

    return f


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Encode docs (doc_id, text) in ascending doc_id order (null first) into token files below folder.

    Returns the manifest: part, path, n_docs, n_ids, start (ids in all files before it), one row per file. Each task
    writes one file of its range of ids; only files that the manifest names count. Null texts are empty; END_ID ends
    each document. An added token in a text, such as <|endoftext|>, becomes that token's id. An empty table gives no
    files. Rows that share a doc_id are ordered by text; other columns, whatever their names, are not read.
    """
    folder = folder or new_path(docs.sparkSession, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    with narrow_batches(docs.sparkSession):
        manifest = written(ordered.mapInArrow(T.trimmed(_write(folder, tokenizer)), "part int, path string, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    return manifest.withColumn("start", F.sum("n_ids").over(before) - F.col("n_ids"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            r = Reader(path)
            i = 0
            while i < r.n_docs:
                j = max(i + 1, int(np.searchsorted(r.starts, r.starts[i] + GROUP * BLOCK, "right")) - 1)
                crc, at = [], r.starts[i : j + 1]
                if j == i + 1:  # a long document, a group of blocks at a time
                    sum_ = 0
                    for p in range(int(at[0]), int(at[1]), GROUP * BLOCK):
                        sum_ = zlib.crc32(r.ids(p, min(p + GROUP * BLOCK, int(at[1]))).astype("<u4").tobytes(), sum_)
                    crc.append(sum_)
                else:
                    data = memoryview(r.ids(int(at[0]), int(at[-1])).astype("<u4").tobytes())
                    rel = (4 * (at - at[0])).tolist()
                    crc = [zlib.crc32(data[x:y]) for x, y in zip(rel[:-1], rel[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(r.doc_ids[i:j], mask=r.null[i:j]), pa.array(at[:-1] + start), pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                i = j
            r.close()


def read_digests(manifest: DataFrame) -> DataFrame:
    """From the files of a manifest, per document: doc_id, start, n_tokens, ids_crc32 (of its ids as little-endian u32)."""
    files = manifest.select("path", "start").repartition(max(1, manifest.count()))
    return files.mapInArrow(T.trimmed(_read), "doc_id long, start long, n_tokens long, ids_crc32 long")
