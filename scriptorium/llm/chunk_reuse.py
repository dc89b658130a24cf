"""BPE ids and decoded text of whole documents, with content-defined chunks encoded once.

Method. A rolling hash over ``WINDOW`` bytes cuts texts where its top ``BITS`` bits are
zero, at character boundaries and ``LEAST`` bytes apart, so copied passages are cut alike
wherever they stand. Three scans of the documents follow. The first tells the digests of
the chunks of each scan partition; digests met more than once are counted together, and the
first partition that has one is to encode it. The second scan encodes those chunks, each
once. A partition's shared chunks and their ids are then joined on the digest and laid in
the shared folder as one file for each partition, and the third scan puts documents
together: chunks found in that file bring their ids, what is between them is encoded in
place. Documents themselves are never shuffled.

Joins are repaired by encoding the text around them again, from a word start before the
join to one after it, until the new ids agree with those held for the first word and the
last; if they don't, the window grows, up to both sides whole. A space before a printable
ASCII character always starts a piece of byte-level splitting, whatever stands around it,
so agreement means that the ids outside the window are those of the joined text too.
Brought ids are used only if they decode to the very bytes of the chunk; a partition whose
file is missing or made for other rows loses reuse, never right ids.

Chunks are reused for byte-level files; texts with the string of an added token, and files
of other kinds, are encoded whole. Results: null is the empty text, without ids; rows are
worked on one by one, so repeated rows, ties and null keys give a row each; an empty table
gives an empty one; other columns are not read, whatever their names. A task holds
``CHARS_AT_ONCE`` characters (or one document) and the file of its scan partition."""

from __future__ import annotations

import bisect
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_bytes, scratch_path, shared_fs, slices, written
from .tokens import byte_letters, encoder

WINDOW, BITS, LEAST = 16, 9, 64
CHARS_AT_ONCE = 1 << 22
DIGEST = 16
BLOCK = 1 << 16
SPREAD, LIMIT = np.uint32(0x9E3779B1), np.uint32(1 << (32 - BITS))


def cut_places(data: np.ndarray) -> np.ndarray:
    """Where the rolling hash of the last ``WINDOW`` bytes cuts: the sum of the bytes, each
    doubled once more than the next, times a constant. Blocks that stay in the cache."""
    out = []
    for lo in range(0, len(data), BLOCK):
        start = max(0, lo - WINDOW + 1)
        rolled = data[start : lo + BLOCK].astype(np.uint32)
        step = 1
        while step < WINDOW:
            rolled[step:] += rolled[:-step] << np.uint32(step)
            step *= 2
        rolled *= SPREAD
        out.append(np.flatnonzero(rolled[lo - start :] < LIMIT) + lo)
    ends = np.concatenate(out) + 1
    return ends[(ends == len(data)) | (data[np.minimum(ends, len(data) - 1)] & 0xC0 != 0x80)]


def cuts_of(texts: list[bytes]) -> list[list[int]]:
    """The chunk ends of each text, its own end included; none for an empty text."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(data):
        return [[] for _ in texts]
    ends = cut_places(data).tolist()
    out, base = [], 0
    for t in texts:
        cuts, last, end = [], base, base + len(t)
        i = bisect.bisect_left(ends, last + LEAST)
        while i < len(ends) and ends[i] <= end - LEAST:
            last = ends[i]
            cuts.append(last - base)
            i = bisect.bisect_left(ends, last + LEAST, i)
        if t:
            cuts.append(len(t))
        out.append(cuts)
        base = end
    return out


def digests_of(text: bytes, cuts: list[int]) -> list[bytes]:
    from xxhash import xxh3_128_digest

    return [xxh3_128_digest(text[a:b]) for a, b in zip([0, *cuts], cuts, strict=False)]


class ChunkEncoder:
    """Ids of texts as arrays of unsigned 32-bit integers, put together from known chunks."""

    def __init__(self, path: str):
        self.encoder = encoder(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.chunks = self.encoder.glue and self.encoder.cuts
        letters = byte_letters()
        n = self.encoder.vocab_size
        self.bytes_of = [b""] * n
        kind = (spec.get("decoder") or {}).get("type")
        if kind == "ByteLevel":
            for token, i in self.encoder.lib.get_vocab(with_added_tokens=True).items():
                known = all(c in letters for c in token)
                self.bytes_of[i] = bytes(letters[c] for c in token) if known else token.encode()
        self.own_decoding = kind == "ByteLevel"
        self.chunks = self.chunks and self.own_decoding
        self.starts = [len(b) > 1 and b[0] == 32 and 33 <= b[1] < 127 for b in self.bytes_of]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u4") for x in self.encoder.encode(texts)]

    def whole(self, text: str) -> bool:
        return not self.chunks or any(x in text for x in self.encoder.added)

    def bytes_from(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        if self.own_decoding:
            return self.bytes_from(ids).decode("utf-8", "replace")
        return self.encoder.lib.decode(ids.tolist(), skip_special_tokens=False)

    def repaired(self, a: np.ndarray, b: np.ndarray) -> tuple[int, np.ndarray, int]:
        """(i, ids, j): the text of ``a`` and ``b`` together has a[:i], ids, b[j:]."""
        width, is_start = 2, self.starts
        while True:
            look = 16 * width
            left, right = a[-look:].tolist(), b[:look].tolist()
            starts_a = [n for n, x in enumerate(left) if is_start[x]]
            starts_b = [n for n, x in enumerate(right) if is_start[x] and n]
            # The window, and within it the first word of the left side and the last of the right.
            i, i1 = (starts_a[-width], starts_a[1 - width]) if len(starts_a) >= width else (0, 0)
            j0, j = (starts_b[width - 2], starts_b[width - 1]) if len(starts_b) >= width else (len(right), len(right))
            if (i == 0 and len(left) < len(a)) or (j == len(right) and len(right) < len(b)):
                width *= 2  # too few words among the tokens looked at
                continue
            text = b"".join(map(self.bytes_of.__getitem__, left[i:] + right[:j])).decode()
            ids = self.encode([text])[0]
            own = ids.tolist()
            if own[: i1 - i] == left[i:i1] and own[len(own) - (j - j0) :] == right[j0:j]:
                return len(a) - len(left) + i, ids, j
            width *= 2

    def put_together(self, parts: list[np.ndarray]) -> np.ndarray:
        done: list[np.ndarray] = []
        last = np.empty(0, "<u4")
        for b in parts:
            if not len(last):
                last = b
                continue
            i, ids, j = self.repaired(last, b)
            # What is kept for the next join begins at a word start or the text's start.
            done.append(last[:i])
            last = np.concatenate([ids, b[j:]])
        return np.concatenate([*done, last])

    def encode_with(self, texts: list[bytes], known: dict) -> list[np.ndarray]:
        """``known``: digest -> a function that gives the chunk's ids."""
        plain, where = [], []  # texts to encode in place, and for each document its parts
        for t, cuts in zip(texts, cuts_of(texts) if known else [[]] * len(texts), strict=True):
            parts: list = []
            start = at = 0
            if cuts and not self.whole(t.decode()):
                for end, d in zip(cuts, digests_of(t, cuts), strict=True):
                    ids = known[d]() if d in known else None
                    if ids is not None and self.bytes_from(ids) == t[at:end]:
                        if start < at:
                            parts.append(len(plain))
                            plain.append(t[start:at].decode())
                        parts.append(ids)
                        start = end
                    at = end
            if start < len(t):
                parts.append(len(plain))
                plain.append(t[start:].decode())
            where.append(parts)
        got = self.encode(plain)
        return [self.put_together([got[p] if isinstance(p, int) else p for p in parts]) for parts in where]


_KEPT: dict[str, ChunkEncoder] = {}


def chunk_encoder(path: str) -> ChunkEncoder:
    if path not in _KEPT:
        _KEPT[path] = ChunkEncoder(path)
    return _KEPT[path]


def write_part(folder: str, part: int, digests: list[bytes], ids: list[bytes]) -> None:
    """A partition's file: count, digests, ends of the ids, ids. The same bytes whichever
    attempt of a task writes it."""
    fs, root = shared_fs(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{part}") as f:
        f.write(np.array([len(digests)], "<i8").tobytes())
        f.write(b"".join(digests))
        f.write(np.cumsum([len(x) for x in ids], dtype="<i8").tobytes())
        for x in ids:
            f.write(x)


def read_part(folder: str, part: int, kind: str) -> dict:
    """digest -> function giving its ids, over the file's memory-mapped bytes."""
    fs, root = shared_fs(folder)
    if not fs.get_file_info(f"{root}/{part}").is_file:
        return {}
    data = read_bytes(f"{folder}/{part}")
    n = int(np.frombuffer(data[:8], "<i8")[0])
    at = 8 + DIGEST * n
    ends = [0, *np.frombuffer(data[at : at + 8 * n], "<i8").tolist()]
    at += 8 * n

    def ids(i):
        return lambda: np.frombuffer(data[at + ends[i] : at + ends[i + 1]], kind).astype("<u4")

    return {bytes(data[8 + DIGEST * i : 8 + DIGEST * (i + 1)]): ids(i) for i in range(n)}


def _lay_out(rows: DataFrame, folder: str) -> None:
    """Write (part, digest, ids) as one file for each part; a part's rows are bounded by the
    chunks of one scan partition."""

    def write(batches):
        at, digests, ids = None, [], []
        for b in batches:
            for p, d, x in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if p != at:
                    if at is not None:
                        write_part(folder, at, digests, ids)
                    at, digests, ids = p, [], []
                digests.append(d)
                ids.append(x)
        if at is not None:
            write_part(folder, at, digests, ids)
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32())], names=["part"])

    laid = rows.repartition("part").sortWithinPartitions("part", "digest").mapInArrow(write, "part int")
    laid.write.format("noop").mode("overwrite").save()


def _texts(batches, column: int):
    """(batch, from, to, texts as bytes) of a bounded size."""
    import pyarrow.compute as pc

    for b in batches:
        texts = b.column(column).cast(pa.binary())
        for lo, hi in slices(pc.binary_length(texts).to_pylist(), CHARS_AT_ONCE):
            yield b, lo, hi, texts.slice(lo, hi - lo).to_pylist()


def lay_out_shared_chunks(texts: DataFrame, tokenizer: str, folder: str, kind: str) -> None:
    """Find the chunks that come more than once in ``texts`` (one column), encode each once
    and write, for each scan partition, those it has to ``folder``."""

    def scan(batches):
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), chunk_encoder(tokenizer)
        for _, _, _, ts in _texts(batches, 0):
            counts: dict[bytes, int] = {}
            for t, cuts in zip(ts, cuts_of(ts), strict=True):
                if len(cuts) and not enc.whole(t.decode()):
                    for d in digests_of(t, cuts):
                        counts[d] = counts.get(d, 0) + 1
            arrays = [pa.array(list(counts), pa.binary()), pa.array([part] * len(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["digest", "part", "n"])

    met = texts.mapInArrow(scan, "digest binary, part int, n long").groupBy("digest", "part").agg(F.sum("n").alias("n"))
    met = written(met, "chunks-met")
    shared = written(met.groupBy("digest").agg(F.sum("n").alias("n"), F.min("part").alias("part")).where("n > 1").drop("n"), "chunks-shared")
    asked = f"{folder}/asked"
    _lay_out(shared.select("part", "digest", F.lit(b"").alias("ids")), asked)

    def encode(batches):
        from pyspark import TaskContext

        enc = chunk_encoder(tokenizer)
        wanted = set(read_part(asked, TaskContext.get().partitionId(), kind))
        for _, _, _, ts in _texts(batches, 0):
            if not wanted:
                continue
            found: dict[bytes, str] = {}
            for t, cuts in zip(ts, cuts_of(ts), strict=True):
                if len(cuts) and not enc.whole(t.decode()):
                    for a, b, d in zip([0, *cuts], cuts, digests_of(t, cuts), strict=False):
                        if d in wanted:
                            wanted.discard(d)
                            found[d] = t[a:b].decode()
            ids = [x.astype(kind).tobytes() for x in enc.encode(list(found.values()))]
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(ids, pa.binary())], names=["digest", "ids"])

    once = written(texts.mapInArrow(encode, "digest binary, ids binary"), "chunks-encoded")
    _lay_out(met.join(once, "digest").select("part", "digest", "ids"), f"{folder}/known")


def encode_and_decode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded) of each row: the ids of the whole text as the ``tokenizers``
    library gives them without special tokens, and the text decoded from them."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    enc = chunk_encoder(tokenizer)
    kind = "<u2" if enc.encoder.vocab_size <= 1 << 16 else "<u4"
    folder = scratch_path(spark, "chunk-reuse")
    if enc.chunks:
        lay_out_shared_chunks(rows.select("t"), tokenizer, folder, kind)

    def assemble(batches):
        from pyspark import TaskContext

        enc = chunk_encoder(tokenizer)
        known = read_part(f"{folder}/known", TaskContext.get().partitionId(), kind)
        for b, lo, hi, ts in _texts(batches, 1):
            ids = enc.encode_with(ts, known)
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = pa.array(np.concatenate(ids).astype(np.int32))
            arrays = [b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array([enc.decode(x) for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["k", "ids", "decoded"])

    found = rows.mapInArrow(assemble, f"k {rows.schema['k'].dataType.simpleString()}, ids array<int>, decoded string")
    return found.withColumnRenamed("k", key)
