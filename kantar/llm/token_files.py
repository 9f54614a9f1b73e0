"""Token ids in length-delimited binary records, with an index of offsets beside them.

A record is framed as in TFRecord files (all numbers little-endian)::

    uint64 length | uint32 masked CRC-32C of the length | payload | uint32 masked CRC-32C of the payload

and its payload is ``int64 id | uint8 width | uint8 1 if the id is null | 2 bytes of zero``
and the document's token ids in ``width`` bytes each (2 while the vocabulary allows).
Records follow each other in ascending order of the id over all shards. A shard
``*.records`` has an index ``*.index`` (uint64 each: the number n of records, n + 1
offsets of frames, n + 1 counts of ids before the record within the shard), so that
a reader can take any record with one seek. ``manifest.json`` lists the shards that were
committed, in order, with their sizes; a lost or repeated task leaves files that no
manifest names.

Spark divides and sorts the documents (by ranges of id, then text, then row, so that
neither a hot id nor repeated rows make one large shard), and each task writes one
shard as a stream. ``DataSource`` classes do the writing and reading, so files are
read by ``spark.read.format("token_records").load(path)``: every frame's two checksums
are verified. ``shuffled`` reads the records in an order drawn by a seed, by the index.

The encoder cuts texts at single spaces between characters that are no white space, where
byte-level pre-tokenizers always cut, and asks the tokenizer once for each distinct piece
that it has not met lately; any other tokenizer gets whole texts. The ids are the same.

Defined results: a null text is empty and is the end id alone; a null id comes first
and stays null; rows that share an id are in order of their texts' digests, and rows alike in
both cannot be told apart; strings of special tokens inside a text are ordinary
text; an empty table gives a manifest without shards. Other columns are not read.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from kantar.llm.shared import shared_dir, table, text_id

FORMAT = "token_records"
END_ID = 0
#: Characters encoded, and bytes of records read, at a time.
CHUNK = 4 << 20
#: Shards of more bytes are read in parts.
PART_BYTES = 128 << 20
#: Distinct pieces whose ids an encoder keeps; the cache is emptied beyond.
KEPT_PIECES = 300_000
HEAD = 12

# ---- checksums ---------------------------------------------------------------

POLYNOMIAL = 0x82F63B78  # fixed value: CRC-32C, bits reversed
MASK = 0xA282EAD8  # fixed value: what masked checksums are moved by
BLOCK = 64


def _apply(op: np.ndarray, x: np.ndarray) -> np.ndarray:
    return op[0][x & 255] ^ op[1][(x >> 8) & 255] ^ op[2][(x >> 16) & 255] ^ op[3][x >> 24]


@functools.cache
def _tables() -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(tables for four bytes at a time, what 2**k zero bytes do to a checksum for each k)."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1).astype(np.uint32)
    words = [one]
    for _ in range(3):
        words.append(one[words[-1] & 255] ^ (words[-1] >> 8))
    every = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], dtype=np.uint32)
    zeros = [one[every & 255] ^ (every >> 8)]
    for _ in range(40):
        zeros.append(_apply(zeros[-1], zeros[-1]))
    return words, zeros


def crc32c(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32C of each slice of ``data`` (bytes): by blocks side by side, which are then joined in pairs."""
    words, zeros = _tables()
    counts = np.maximum(-(-lengths // BLOCK), 1)
    ends = np.cumsum(counts) * BLOCK
    padded = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    for s, n, e in zip(starts.tolist(), lengths.tolist(), ends.tolist()):
        padded[e - n : e] = data[s : s + n]  # zeros before a message leave its sum as it is
    columns = padded.view("<u4").reshape(-1, BLOCK // 4)
    sums = np.zeros(len(columns), dtype=np.uint32)
    for k in range(BLOCK // 4):
        x = sums ^ columns[:, k]
        sums = words[3][x & 255] ^ words[2][(x >> 8) & 255] ^ words[1][(x >> 16) & 255] ^ words[0][x >> 24]
    level = BLOCK.bit_length() - 1
    while len(counts) and counts.max() > 1:
        pairs = -(-counts // 2)
        out = np.zeros(int(pairs.sum()) * 2, dtype=np.uint32)
        odd = counts % 2
        # A record with an odd number gets a zero before its blocks.
        shift = np.repeat(np.cumsum(pairs * 2) - np.cumsum(counts), counts)
        out[np.arange(len(sums)) + shift] = sums
        sums = _apply(zeros[level], out[0::2]) ^ out[1::2]
        counts, level = (counts + odd) // 2, level + 1
    start = np.full(len(counts), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(int(lengths.max()).bit_length() if len(lengths) else 0):
        start = np.where((lengths >> k) & 1, _apply(zeros[k], start), start).astype(np.uint32)
    return sums ^ start ^ np.uint32(0xFFFFFFFF)


def masked(sums: np.ndarray) -> np.ndarray:
    return ((sums >> np.uint32(15)) | (sums << np.uint32(17))) + np.uint32(MASK)


# ---- encoding ----------------------------------------------------------------

# Fixed value: where byte-level pre-tokenizers cut (tried here on single pieces, below U+0500 alone).
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Marks that are cut off letters before them.
ENDS = frozenset(".,;:!?")
BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones themselves, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def _strings(texts: pa.Array) -> list[str]:
    """As ``to_pylist``, without a scalar for each."""
    return texts.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Token ids of texts, with the ids of pieces that were met before kept."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        told = json.loads(self.tokenizer.to_str())
        pre, model = told["pre_tokenizer"] or {}, told["model"]
        self.in_pieces = (
            told["normalizer"] is None and told["post_processor"] is None and told["truncation"] is None and told["padding"] is None
            and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
            and model["type"] == "BPE" and not model.get("ignore_merges") and model.get("dropout") is None
        )
        self.cuts, self.letters = regex.compile(CUTS), _byte_letters()
        self._empty()

    def _empty(self) -> None:
        # Places in the pool by piece: those that follow a space, and those that begin a text.
        self.inner: dict[str, int] = {}
        self.first: dict[str, int] = {}
        self.marks: dict[str, list[int]] = {}
        self.starts, self.sizes, self.flags, self.pool = array("q"), array("q"), array("b"), array("I")

    def _word(self, word: str) -> list[int]:
        """Ids of what is not cut any more."""
        told = word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.tokenizer.model.tokenize(told)]

    def _mark(self, mark: str) -> list[int]:
        ids = self.marks.get(mark)
        if ids is None:
            ids = self.marks[mark] = self._word(mark)
        return ids

    def _ids(self, piece: str) -> list[int]:
        if piece and max(piece) >= "\u0500":
            return self.tokenizer.encode(piece, add_special_tokens=False).ids
        # Most pieces are letters alone after their space, and are not cut.
        if piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()):
            return self._word(piece)
        out: list[int] = []
        for word in self.cuts.findall(piece):
            out += self._word(word) if len(word) > 2 else self._mark(word)
        return out

    def _learn(self, piece: str, known: dict[str, int], before: str) -> int:
        stem = piece[:-1]
        if piece[-1:] in ENDS and piece and stem.isalpha() and max(stem) < "\u0500":
            # Letters before a mark that is always cut off are looked up by themselves.
            at = known.get(stem)
            at = self._learn(stem, known, before) if at is None else at
            start = self.starts[at]
            ids = [*self.pool[start : start + self.sizes[at]], *self._mark(piece[-1])]
        else:
            ids = self._ids(before + piece)
        at = known[piece] = len(self.starts)
        self.starts.append(len(self.pool))
        self.sizes.append(len(ids))
        # 1: may not follow a cut, 2: may not stand before one.
        self.flags.append((not piece or piece[0].isspace()) + 2 * (not piece or piece[-1].isspace()))
        self.pool.extend(ids)
        return at

    def _places(self, pieces: list[str], known: dict[str, int], before: str) -> np.ndarray:
        at = np.array([known.get(p, -1) for p in pieces], dtype=np.int64)
        for k in np.flatnonzero(at < 0).tolist():
            p = pieces[k]
            at[k] = known[p] if p in known else self._learn(p, known, before)
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, how many each text has); no text is null."""
        if not self.in_pieces:
            ids = [e.ids for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.array([x for one in ids for x in one], dtype=np.uint32), np.array([len(one) for one in ids], dtype=np.int64)
        if len(self.inner) + len(self.first) > KEPT_PIECES:
            self._empty()
        places, counts = self._pieces(texts)
        starts, sizes, pool = np.frombuffer(self.starts, np.int64), np.frombuffer(self.sizes, np.int64), np.frombuffer(self.pool or array("I", [0]), np.uint32)
        size = sizes[places]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = pool[np.repeat(starts[places] - (ends - size), size) + np.arange(total)]
        upto = np.concatenate([[0], ends])[np.cumsum(counts)]
        return ids, np.diff(upto, prepend=0)

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the places of all pieces in order, how many each text has)."""
        split = pc.split_pattern(texts, " ")
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = split.flatten()
        coded = flat.dictionary_encode()
        known = self._places(_strings(coded.dictionary), self.inner, " ")
        places = known[coded.indices.to_numpy(zero_copy_only=False)]
        last = np.cumsum(counts) - 1
        begin = last - counts + 1
        flags = np.frombuffer(self.flags, np.int8)[places]
        inside = np.ones(len(places), dtype=bool)
        inside[begin] = False
        wrong = inside & ((flags & 1) > 0)
        inside[begin], inside[last] = True, False
        wrong |= inside & ((flags & 2) > 0)
        del flags
        places[begin] = self._places(_strings(flat.take(pa.array(begin))), self.first, "")
        if not wrong.any():
            return places, counts
        # Texts with other white space than single spaces are cut where two characters let it.
        owner = np.repeat(np.arange(len(counts)), counts)
        hard = np.unique(owner[wrong])
        keep = ~np.isin(owner, hard)
        more, whose = [], []
        for k in hard.tolist():
            one, *rest = BETWEEN.split(texts[k].as_py())
            more += [*self._places([one], self.first, ""), *self._places(rest, self.inner, " ")]
            whose += [k] * (1 + len(rest))
            counts[k] = 1 + len(rest)
        owner = np.concatenate([owner[keep], np.array(whose, dtype=owner.dtype)])
        order = np.argsort(owner, kind="stable")
        return np.concatenate([places[keep], np.array(more, dtype=np.int64)])[order], counts


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


def _chunks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of items that are at most so large together, one item at least."""
    at, ends = 0, np.cumsum(sizes)
    while at < len(sizes):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, to
        at = to


# ---- files -------------------------------------------------------------------


def _store(path: str):
    """(file system, path there); the path may have a scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


def frames(doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the framed records, the length of each frame)."""
    payload = HEAD + counts * width
    size = payload + 16
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint8)
    heads = b"".join(struct.pack("<qBBxx", d or 0, width, d is None) for d in doc_ids)
    put = lambda where, rows: out.__setitem__(where[:, None] + np.arange(rows.shape[1]), rows)
    put(at, payload.astype("<u8").view(np.uint8).reshape(-1, 8))
    put(at + 12, np.frombuffer(heads, np.uint8).reshape(-1, HEAD))
    body, ends = ids.astype(f"<u{width}").view(np.uint8), np.cumsum(counts * width)
    for a, s, e in zip((at + 12 + HEAD).tolist(), (ends - counts * width).tolist(), ends.tolist()):
        out[a : a + e - s] = body[s:e]
    put(at + 8, masked(crc32c(out, at, np.full(len(at), 8))).astype("<u4").view(np.uint8).reshape(-1, 4))
    put(at + 12 + payload, masked(crc32c(out, at + 12, payload)).astype("<u4").view(np.uint8).reshape(-1, 4))
    return out, size


def read_frames(data: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, token ids, how many each has) of framed records at ``offsets``; raises where a checksum is wrong."""
    take = lambda where, n: data[where[:, None] + np.arange(n)]
    number = lambda where, kind: take(where, np.dtype(kind).itemsize).copy().view(kind)[:, 0]
    length = number(offsets, "<u8").astype(np.int64)
    if (number(offsets + 8, "<u4") != masked(crc32c(data, offsets, np.full(len(offsets), 8)))).any() or (length + 16 != sizes).any():
        raise ValueError("a record's length does not agree with its checksum or the index")
    if (number(offsets + 12 + length, "<u4") != masked(crc32c(data, offsets + 12, length))).any():
        raise ValueError("a record does not agree with its checksum")
    ids = number(offsets + 12, "<i8").tolist()
    width, none = data[offsets + 20], data[offsets + 21]
    counts = (length - HEAD) // width
    parts = [data[a : a + n].view(f"<u{w}") for a, n, w in zip((offsets + 12 + HEAD).tolist(), (length - HEAD).tolist(), width.tolist())]
    tokens = np.concatenate(parts).astype("<u4") if parts else np.zeros(0, "<u4")
    return [None if n else d for d, n in zip(ids, none.tolist())], tokens, counts.astype(np.int64)


@dataclass
class Shard(WriterCommitMessage):
    partition: int
    name: str
    records: int
    tokens: int
    bytes: int


class Writer(DataSourceArrowWriter):
    """Each task writes its rows, in the order they come, as one shard and its index."""

    def __init__(self, path: str, tokenizer: str, end_id: int):
        self.path, self.tokenizer, self.end_id = path.rstrip("/"), tokenizer, end_id

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Shard:
        name = f"shard-{uuid.uuid4().hex}"
        store, root = _store(self.path)
        enc = encoder(self.tokenizer)
        out, sizes, counts = None, [], []
        for batch in iterator:
            doc_ids, texts = batch.column(0), batch.column(1).fill_null("")
            for a, b in _chunks(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64), CHUNK):
                ids, n = enc.encode(texts.slice(a, b - a))
                ids, n = np.insert(ids, np.cumsum(n), self.end_id), n + 1
                data, size = frames(doc_ids.slice(a, b - a).to_pylist(), ids, n, enc.width)
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}.records")
                out.write(data)
                sizes.append(size)
                counts.append(n)
        if out is not None:
            out.close()
            total = sum(map(len, sizes))
            sums = [np.concatenate([[0], np.cumsum(np.concatenate(x))]).astype("<u8") for x in (sizes, counts)]
            with store.open_output_stream(f"{root}/{name}.index") as index:
                index.write(np.concatenate([np.array([total], "<u8"), *sums]).tobytes())
            return Shard(TaskContext.get().partitionId(), name, total, int(sums[1][-1]), int(sums[0][-1]))
        return Shard(TaskContext.get().partitionId(), name, 0, 0, 0)

    def commit(self, messages: list) -> None:
        """A row for each shard with rows; ``first`` is the number of ids in the shards before."""
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        told, first = [], 0
        for s in sorted((m for m in messages if m is not None and m.records), key=lambda m: m.partition):
            told.append({"name": s.name, "records": s.records, "tokens": s.tokens, "bytes": s.bytes, "first": first})
            first += s.tokens
        with store.open_output_stream(f"{root}/manifest.tmp") as out:
            out.write(json.dumps({"format": FORMAT, "version": 1, "end_id": self.end_id, "tokens": first, "shards": told}).encode())
        store.move(f"{root}/manifest.tmp", f"{root}/manifest.json")

    def abort(self, messages: list) -> None:
        store, root = _store(self.path)
        for m in messages:
            for end in ("records", "index") if m is not None and m.records else ():
                store.delete_file(f"{root}/{m.name}.{end}")


@dataclass
class Part(InputPartition):
    """Records ``at``/``of`` to (``at`` + 1)/``of`` of a shard."""

    name: str
    first: int
    at: int
    of: int


def _index(store, root: str, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids before) of a shard, one more than it has records."""
    with store.open_input_stream(f"{root}/{name}.index") as f:
        told = np.frombuffer(f.read(), "<u8").astype(np.int64)
    n = int(told[0])
    return told[1 : n + 2], told[n + 2 :]


def _rows(doc_ids: list, first: np.ndarray, tokens: np.ndarray, counts: np.ndarray, **more) -> pa.RecordBatch:
    ends = np.concatenate([[0], np.cumsum(counts * 4)]).astype(np.int32)
    ids = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(tokens.tobytes())])
    columns = {k: pa.array(v, pa.int64()) for k, v in more.items()} | {"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(first, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids": ids}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


class Reader(DataSourceReader):
    def __init__(self, path: str, index: bool):
        self.path, self.index = path.rstrip("/"), index

    def partitions(self) -> list[Part]:
        store, root = _store(self.path)
        with store.open_input_stream(f"{root}/manifest.json") as f:
            shards = json.loads(f.read())["shards"]
        parts = [Part(s["name"], s["first"], k, n) for s in shards for n in [min(s["records"], -(-s["bytes"] // PART_BYTES))] for k in range(n)]
        return parts or [Part("", 0, 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        store, root = _store(self.path)
        offsets, before = _index(store, root, partition.name)
        n = len(offsets) - 1
        a, b = n * partition.at // partition.of, n * (partition.at + 1) // partition.of
        if self.index:
            told = {"record": np.arange(a, b), "offset": offsets[a:b], "bytes": np.diff(offsets[a : b + 1]), "start": partition.first + before[a:b], "n_tokens": np.diff(before[a : b + 1])}
            columns = [pa.array([partition.name] * (b - a), pa.string()), *[pa.array(v, pa.int64()) for v in told.values()]]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", *told])
            return
        with store.open_input_file(f"{root}/{partition.name}.records") as f:
            for x, y in _chunks(np.diff(offsets[a : b + 1]), CHUNK):
                at = offsets[a + x : a + y + 1]
                data = np.frombuffer(f.read_at(int(at[-1] - at[0]), int(at[0])), np.uint8)
                doc_ids, tokens, counts = read_frames(data, at[:-1] - at[0], np.diff(at))
                if (counts != np.diff(before[a + x : a + y + 1])).any():
                    raise ValueError("a record has another number of ids than the index says")
                yield _rows(doc_ids, partition.first + before[a + x : a + y], tokens, counts)


class TokenRecords(DataSource):
    """Options: ``tokenizer`` and ``end_id`` to write; ``index`` (true: rows of the index instead of records) to read."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        if self.options.get("index", "false") == "true":
            return "shard string, record long, offset long, bytes long, start long, n_tokens long"
        return "doc_id long, start long, n_tokens long, ids binary"

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self.options.get("index", "false") == "true")

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], self.options["tokenizer"], int(self.options.get("end_id", END_ID)))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, shards: int | None = None) -> None:
    """Write the documents' token ids under ``path``, a new folder, in ascending order of ``key``.

    ``shards``: about so many ranges of documents; without it, as many as Spark's settings
    for shuffles say, and small ones are joined.
    """
    docs.sparkSession.dataSource.register(TokenRecords)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    keyed = rows.withColumn("tid", text_id(F.col("text"))).withColumn("row", F.monotonically_increasing_id())
    by = ("doc_id", "tid", "row")
    dealt = keyed.repartitionByRange(shards, *by) if shards else keyed.repartitionByRange(*by)
    sorted_rows = dealt.sortWithinPartitions("doc_id", "tid").select("doc_id", "text")
    sorted_rows.write.format(FORMAT).mode("append").option("tokenizer", tokenizer).option("end_id", str(end_id)).save(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): a row per record; ``ids`` are unsigned numbers of 32 bits, ``start`` counts those of all records before."""
    spark.dataSource.register(TokenRecords)
    return spark.read.format(FORMAT).load(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(shard, record, offset, bytes, start, n_tokens) of every record, from the indexes alone."""
    spark.dataSource.register(TokenRecords)
    return spark.read.format(FORMAT).option("index", "true").load(path)


def shuffled(spark: SparkSession, path: str, seed: int, readers: int) -> DataFrame:
    """The records with ``place``, their order drawn by ``seed``, in about ``readers`` partitions that follow it.

    Only rows of the index are shuffled; each reader seeks its records, some megabytes at a time.
    """

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path.rstrip("/"))
        for batch in batches:
            for a, b in _chunks(batch.column("bytes").to_numpy(), CHUNK):
                part = batch.slice(a, b - a)
                names, at, size = part.column("shard").to_pylist(), part.column("offset").to_numpy(), part.column("bytes").to_numpy()
                ends = np.cumsum(size)
                data = np.empty(int(ends[-1]), dtype=np.uint8)
                for name in dict.fromkeys(names):
                    with store.open_input_file(f"{root}/{name}.records") as f:
                        for k in sorted((k for k, x in enumerate(names) if x == name), key=lambda k: at[k]):
                            data[ends[k] - size[k] : ends[k]] = np.frombuffer(f.read_at(int(size[k]), int(at[k])), np.uint8)
                doc_ids, tokens, counts = read_frames(data, ends - size, size)
                yield _rows(doc_ids, part.column("start").to_numpy(), tokens, counts, place=part.column("place").to_numpy())

    drawn = read_index(spark, path).withColumn("place", F.xxhash64(F.lit(seed), "start"))
    ordered = drawn.repartitionByRange(readers, "place").sortWithinPartitions("place", "start")
    return ordered.mapInArrow(fetch, "place long, doc_id long, start long, n_tokens long, ids binary")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
