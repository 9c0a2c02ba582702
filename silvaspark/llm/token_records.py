"""Token ids in length-delimited binary records, with an offset index beside each file.

Record: uint64 length of the payload, uint32 masked CRC-32 of those eight bytes, payload, uint32 masked CRC-32 of the
payload; all little-endian. Payload: int64 doc_id, uint8 1 if there is a doc_id, uint8 bytes of an id (2 or 4), ids.
Index (same name, .idx): for each record int64 doc_id, uint64 offset, uint64 ids. A mask is a rotation by 15 bits plus
a constant, so that a checksum stored among checksummed bytes does no harm.

Files go through pyarrow's file systems (local, S3, GCS, HDFS), so the folder must be one that all machines share. Each
attempt of a task writes files under its own name and only what a finished task returns is listed in the manifest:
a lost executor's half-written files are never read.
"""

from __future__ import annotations

import functools
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME, HEAD, ENTRY = "<QI", "<qBB", "<qQQ"  # length and its check; start of a payload; entry of the index
KEPT = 1_000_000  # entries of each table of encoded pieces that a worker holds; a full one is emptied
LONG = 100  # characters of a piece from which it is not remembered
JOINED = 2_000  # units that go to the library in one text
ROWS, CHARS = 4096, 4 << 20  # of texts that are encoded at once, at most (a longer text alone)


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    payload = struct.pack(HEAD, doc_id or 0, doc_id is not None, width) + ids
    length = struct.pack("<Q", len(payload))
    return struct.pack(FRAME, len(payload), masked(length)) + payload + struct.pack("<I", masked(payload))


def read_frame(f, at: str = "") -> tuple[int | None, np.ndarray] | None:
    """The next record of an open file, checked; None at its end."""
    head = f.read(struct.calcsize(FRAME))
    if not head:
        return None
    if len(head) < struct.calcsize(FRAME):
        raise ValueError(f"{at}: cut off within a record's length")
    length, check = struct.unpack(FRAME, head)
    if masked(head[:8]) != check:
        raise ValueError(f"{at}: wrong checksum of a length")
    payload, tail = f.read(length), f.read(4)
    if len(payload) < length or len(tail) < 4 or masked(payload) != struct.unpack("<I", tail)[0]:
        raise ValueError(f"{at}: wrong checksum of a record")
    doc_id, given, width = struct.unpack_from(HEAD, payload)
    return doc_id if given else None, np.frombuffer(payload, f"<u{width}", offset=struct.calcsize(HEAD)).astype("<u4")


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class Encoder:
    """Ids of whole texts as the tokenizers library gives them for a byte-level BPE file.

    The library's word pattern never lets a token span two of its words, and a word that begins in white space goes no
    further than the text up to the next white space. So a text's ids are those of its units in a row: each unit is a
    run of white space with what follows it. Units are encoded by the library once and remembered; texts are cut and
    their units told apart in columns, so that each unit is looked up once for many texts.
    """

    # White space other than single blanks and line ends, which makes a text odd.
    ODD = ["  ", " \n", "\n ", "\n\n", *map(chr, [9, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]
    UNITS = regex.compile(r"\s*+\S++|\s++")
    UNSURE = re.compile("[\x1c-\x1f]")  # white space for some, not for others: the library takes such texts whole

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.width = 2 if self.lib.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        added = self.lib.get_added_tokens_decoder()
        self.special = {t.content: np.array([i], self.dtype).tobytes() for i, t in added.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        # tokens that begin in a blank, and in a line end, by the characters that stand for these bytes
        self.lead = {c: np.zeros(self.lib.get_vocab_size(), bool) for c in " \n"}
        for token, i in self.lib.get_vocab().items():
            for c, shown in ((" ", "\u0120"), ("\n", "\u010a")):
                self.lead[c][i] = token[0] == shown
        self.after: dict[str, bytes] = {}  # unit -> its ids, with the blank in front of those that don't begin with white space
        self.first: dict[str, bytes] = {}  # first unit of a text -> its ids

    def pack(self, ids) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def whole(self, texts: list[str]) -> list[bytes]:
        return [self.pack(e.ids) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def units(self, text: str) -> list[str]:
        """Units of an odd text: the first as it is; of the others, those that begin with one blank stand without it."""
        found = self.UNITS.findall(text)
        if text[0].isspace():
            found.insert(0, "")
        return [found[0], *(u[1:] if u[0] == " " and not u[1:2].isspace() else u for u in found[1:])]

    def cut(self, texts: list[str]) -> tuple[np.ndarray, pa.Array]:
        """``(ends, units)``: where the units of each text end, and all of them in a row."""
        import pyarrow.compute as pc  # 10 MB, of workers only

        plain = [not any(x in t for x in self.ODD) for t in texts]
        rows = pa.array([t if p else "" for t, p in zip(texts, plain, strict=True)], pa.large_string())
        lists = pc.split_pattern(pc.replace_substring(rows, "\n", " \n"), " ")
        if all(plain):
            return lists.offsets.to_numpy()[1:], lists.values
        odd = pa.array([[] if p else self.units(t) for t, p in zip(texts, plain, strict=True)], pa.large_list(pa.large_string()))
        lists = pc.if_else(pa.array(plain), lists.cast(odd.type), odd)
        return lists.offsets.to_numpy()[1:], lists.values

    def learn(self, units: Iterable[str]) -> None:
        """Encode units that aren't known yet, many in a text: a unit's first token is known by the blank or line end it begins with."""
        kinds: dict[str, list[str]] = {" ": [], "\n": [], "": []}
        for u in units:
            kinds[" " if u and not u[0].isspace() else "\n" if u[:1] == "\n" and not u[1:2].isspace() and len(u) > 1 else ""].append(u)
        self.after.update((u, x) for u, x in zip(kinds[""], self.whole([u or " " for u in kinds[""]]), strict=True))
        for lead, glue in ((" ", " "), ("\n", "")):
            for i in range(0, len(kinds[lead]), JOINED):
                some = kinds[lead][i : i + JOINED]
                joined = glue + glue.join(some)
                ids = np.array(self.lib.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.dtype)
                at = np.flatnonzero(self.lead[lead][ids]) * self.width
                packed = ids.tobytes()
                self.after.update((u, packed[x:y]) for u, x, y in zip(some, at.tolist(), [*at[1:].tolist(), len(packed)], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        out: list = []
        for t in texts:
            if any(s in t for s in self.special):
                parts = self.split.split(t)
                out.append(b"".join(self.special[p] if p in self.special else self.whole([p])[0] for p in parts if p))
            elif self.UNSURE.search(t):
                out.append(self.whole([t])[0])
            else:
                out.append(None if t else b"")
        found = iter(self.from_units([t for t, ids in zip(texts, out, strict=True) if ids is None]))
        return [next(found) if ids is None else ids for ids in out]

    def from_units(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts that aren't empty, from those of their units."""
        if not texts:
            return []
        ends, units = self.cut(texts)
        begins = np.concatenate(([0], ends[:-1]))
        firsts = units.take(pa.array(begins)).to_pylist()
        coded = units.dictionary_encode()
        each, at = coded.dictionary.to_pylist(), coded.indices.to_numpy().copy()
        new, new_first = list(filterfalse(self.after.__contains__, each)), list(set(firsts).difference(self.first))
        self.learn(new)
        self.first.update(zip(new_first, self.whole(new_first), strict=True))
        pieces = [*map(self.after.__getitem__, each), *map(self.first.__getitem__, firsts)]
        for table, fresh in ((self.after, new), (self.first, new_first)):
            if len(table) > KEPT:
                table.clear()
            for u in [u for u in fresh if len(u) > LONG]:  # text without white space
                table.pop(u, None)
        at[begins] = len(each) + np.arange(len(firsts))  # the first unit of a text has no blank in front
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // self.width
        starts, n = np.cumsum(sizes) - sizes, sizes[at]
        upto = np.cumsum(n)
        kind = np.int32 if max(upto[-1], sizes.sum()) < 1 << 31 else np.int64  # places of ids, the most room of all
        place = np.repeat((starts[at] - upto + n).astype(kind), n)
        place += np.arange(upto[-1], dtype=kind)
        ids = np.frombuffer(b"".join(pieces), self.dtype)[place].tobytes()
        bounds = [0, *(upto[ends - 1] * self.width).tolist()]
        return [ids[x:y] for x, y in zip(bounds, bounds[1:], strict=False)]


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``ROWS`` rows and about ``CHARS`` bytes of a text column."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto, lo = np.cumsum(size, dtype=np.int64), 0
    while lo < batch.num_rows:
        within = int(np.searchsorted(upto, upto[lo] - size[lo] + CHARS, "right"))
        hi = max(lo + 1, min(lo + ROWS, within))
        yield batch.slice(lo, hi - lo)
        lo = hi


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_token_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> list[dict]:
    """Encode ``doc_id, text``, end each document with ``end_id``, write records in ascending doc_id order.

    Returns the manifest, in order: ``part, file, docs, tokens`` of each file (as many entries as tasks that wrote).
    A null text is an empty document (only the end id); null doc_ids come first; repeated doc_ids stand in a row,
    ordered by text; empty tables write nothing; other columns are not read. Texts move and are encoded where they
    arrive: ids of rare words take more room than the words.
    """
    fs, at = file_system(folder)
    fs.create_dir(at, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, out = encoder(tokenizer), TaskContext.get().partitionId(), None
        end, n_docs, n_ids, offset = enc.pack([end_id]), 0, 0, 0
        fs, at = file_system(folder)
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        for some in (some for batch in batches for some in slices(batch, 1)):
            if out is None:
                out, index = fs.open_output_stream(f"{at}/{name}.rec"), fs.open_output_stream(f"{at}/{name}.idx")
            texts = [t or "" for t in some.column(1).to_pylist()]
            for doc_id, ids in zip(some.column(0).to_pylist(), enc.encode(texts), strict=True):
                ids += end
                n = len(ids) // enc.width
                record = frame(doc_id, ids, enc.width)
                out.write(record)
                index.write(struct.pack(ENTRY, doc_id or 0, offset, n))
                offset, n_docs, n_ids = offset + len(record), n_docs + 1, n_ids + n
        if out is not None:
            out.close()
            index.close()
            yield pa.record_batch([pa.array([part], pa.int64()), pa.array([f"{folder}/{name}"]), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())], names=["part", "file", "docs", "tokens"])

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    found = ordered.mapInArrow(run, "part long, file string, docs long, tokens long").collect()  # a row a task
    return sorted((r.asDict() for r in found), key=lambda r: r["part"])


def read_token_records(spark: SparkSession, manifest: list[dict], with_ids: bool = False) -> DataFrame:
    """Read every record of a manifest back, checksums verified, one task a file.

    Per document: ``doc_id, start`` (ids of all documents before it), ``n_tokens, ids_crc32`` (of the ids as
    little-endian unsigned 32-bit integers) and, if wanted, ``ids``.
    """
    starts = np.cumsum([0, *(m["tokens"] for m in manifest)]).tolist()
    files = [m["file"] for m in manifest]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in schema.split(", ")]
        for batch in batches:
            for part in batch.column(0).to_pylist():
                fs, at = file_system(f"{files[part]}.rec")
                start, rows = starts[part], []
                with fs.open_input_stream(at, buffer_size=1 << 20) as f:
                    while (record := read_frame(f, at)) is not None:
                        doc_id, ids = record
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), *([ids.tolist()] if with_ids else [])))
                        start += len(ids)
                        if len(rows) == 1000:
                            yield batch_of(rows, names, with_ids)
                            rows = []
                if rows:
                    yield batch_of(rows, names, with_ids)

    def batch_of(rows: list[tuple], names: list[str], with_ids: bool) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * with_ids
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    if not files:
        return spark.createDataFrame([], schema)
    return spark.range(0, len(files), 1, len(files)).mapInArrow(run, schema)


def shuffled_records(spark: SparkSession, manifest: list[dict], seed: int = 0) -> DataFrame:
    """All records in a random order that ``seed`` fixes, each fetched by its place in the offset index.

    Rows: ``place long`` (hash that gives the order), ``doc_id, ids``; sorted within and across partitions by place.
    """
    files = [m["file"] for m in manifest]
    if not files:
        return spark.createDataFrame([], "place long, doc_id long, ids array<long>")

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                fs, at = file_system(f"{files[part]}.idx")
                with fs.open_input_stream(at) as f:
                    offsets = [e[1] for e in struct.iter_unpack(ENTRY, f.read())]
                yield pa.record_batch([pa.array([part] * len(offsets), pa.int64()), pa.array(offsets, pa.int64())], names=["part", "offset"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[int, object] = {}
        for batch in batches:
            rows = []
            for place, part, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part not in opened:
                    if len(opened) > 64:
                        opened.popitem()[1].close()
                    fs, at = file_system(f"{files[part]}.rec")
                    opened[part] = fs.open_input_file(at)
                opened[part].seek(offset)
                doc_id, ids = read_frame(opened[part], files[part])
                rows.append((place, doc_id, ids.tolist()))
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["place", "doc_id", "ids"])

    index = spark.range(0, len(files), 1, len(files)).mapInArrow(entries, "part long, offset long")
    placed = index.select(F.xxhash64(F.lit(seed), "part", "offset").alias("place"), "part", "offset")
    ordered = placed.repartitionByRange("place").sortWithinPartitions("place", "part", "offset")
    return ordered.mapInArrow(fetch, "place long, doc_id long, ids array<long>")
