"""Removal of passages that an earlier document holds, by joining fingerprints of a cover sample of suffixes.

Suffixes are grouped by names and never put in their order. Names are not checked against bytes: the surroundings of a sampled suffix have 56 bits
(besides those of its core), a string has 88, of two independent kinds.

A byte goes if it lies in a string of ``length`` bytes that also starts in a document with a smaller id. Two suffixes that agree on
``length`` bytes are told apart, or found tied, by a sample of suffixes that covers them: in every ``length``-byte string the sample holds
at least one position, and equal strings have it at equal offsets (the position whose first ``CORE`` bytes have the least
rank in the string, the leftmost of equals). That is a difference cover's property for tied suffixes, at a thirteenth of all
positions where a fixed cover of this span needs a fifth.

1. Each block of documents names its sampled suffixes: a rank name of their first ``CORE`` bytes and one of all strings they stand for.
2. Sampled suffixes are dealt to suffix buckets by name, and one bucket at a time is sorted. A name in one document only is done with. A
   long tie (all strings alike in several documents) is settled by the names alone: the least id.
3. Only where a name is shared but the strings around it differ, the strings themselves are sorted, again one bucket at a time, from one
   document for each kind of surroundings.
4. Each block marks its bytes and cuts them out.

Buckets and blocks are bounded by the parameters; a block sends one entry a name and surroundings however many of its documents share it, so a
passage in a third of all documents costs a bucket one entry a block. Texts are shuffled once, compressed, and read by
steps 1, 3 and 4.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_text, documents, small_batches

LENGTH, CORE = 50, 26
BLOCK_BYTES, SLICE_BYTES, BUCKET_ENTRIES = 2 << 20, 1 << 18, 150_000
NULL_ID = -(1 << 63)
#: Bytes of a second name that travel with the first, by level: of the surroundings of a sampled suffix, and of a string by itself.
CONTEXT_BYTES = {1: 7, 2: 3}
MULTIPLIERS = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93
MANY_DOCS = 1
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
OUT = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(SPAN))])
BLOCK = pa.schema([("block", pa.int64()), ("docs", pa.binary())])
ENTRY = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("level", pa.int32()), ("body", pa.binary())])
ANSWER = pa.schema([("block", pa.int64()), ("level", pa.int32()), ("body", pa.binary())])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


LETTERS = [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(k)) for k in (0xD1342543DE82EF95, 0xA24BAED4963EE407)]


@functools.lru_cache(maxsize=2)
def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, MULTIPLIERS[which], np.uint64), np.full(n, pow(MULTIPLIERS[which], -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Slice:
    """Concatenated documents with names for their substrings and their cover sample."""

    def __init__(self, texts: list[bytes], length: int, core: int):
        self.text = np.frombuffer(b"".join(texts), np.uint8)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        n = len(self.text)
        self.size = 1 << max(20, int(n + 1).bit_length())
        self.up, self.sums = self._sums(0)
        self.second: tuple[np.ndarray, np.ndarray] | None = None
        self.length = length
        empty = np.zeros(0, np.int64)
        self.at = self.first = self.last = empty
        self.rank = np.zeros(0, np.uint64)
        if n < length:
            return
        rank = mix((self.sums[core:] - self.sums[: n + 1 - core]) * self.up[: n + 1 - core])
        window = np.arange(n + 1 - length)
        inside = np.flatnonzero(window + length <= np.repeat(self.ends, self.sizes)[: len(window)])
        if not len(inside):
            return
        least, where, wide, span = rank, np.arange(len(rank), dtype=np.int32), 1, length - core + 1
        while wide < span:  # the leftmost least rank of a growing window
            step = min(wide, span - wide)
            left, right = least[:-step], least[step:]
            keep = left <= right
            least, where = np.where(keep, left, right), np.where(keep, where[:-step], where[step:])
            wide += step
        owner = where[inside]
        heads = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        self.at = owner[heads].astype(np.int64)
        self.first = inside[heads]
        self.last = inside[np.concatenate((heads[1:], [len(inside)])) - 1]
        self.rank = rank[self.at]

    def _sums(self, which: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = _powers(self.size, which)
        sums = np.zeros(len(self.text) + 1, np.uint64)
        np.cumsum(LETTERS[which][self.text] * down[: len(self.text)], out=sums[1:])
        return up, sums

    def names(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.up[start])

    def second_names(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Names of another kind, which share nothing with the first."""
        self.second = self.second or self._sums(1)
        up, sums = self.second
        return mix((sums[stop] - sums[start]) * up[start])

    def contexts(self) -> np.ndarray:
        """One name for all the strings a sampled suffix stands for, and where it stands in them."""
        whole = self.names(self.first, self.last + self.length)
        place = (self.at - self.first).astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + (self.last - self.first).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)
        return mix(whole + place)

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, side="right")

    def strings(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and both names of the strings that the chosen sampled suffixes stand for."""
        first, n = self.first[chosen], (self.last - self.first)[chosen] + 1
        start = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return start, self.names(start, start + self.length), self.second_names(start, start + self.length)


def slices(docs: list[tuple[int, bytes]]):
    """Runs of documents of about ``SLICE_BYTES``; a longer document is a run of its own."""
    held, size = [], 0
    for doc in docs:
        if held and size + len(doc[1]) > SLICE_BYTES:
            yield held
            held, size = [], 0
        held.append(doc)
        size += len(doc[1])
    if held:
        yield held


def key_bits(bucket_bits: int) -> int:
    """Bits of a core's name besides its bucket that travel along. A bucket has some 2^18 names, so few cores share one by chance; where they do, their surroundings
    tell them apart."""
    return min(34, 64 - bucket_bits)


def keyed(names: np.ndarray, bucket_bits: int) -> np.ndarray:
    low = key_bits(bucket_bits)
    return (names >> np.uint64(64 - bucket_bits) << np.uint64(low)) | (names & np.uint64((1 << low) - 1))


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of unsigned 64-bit numbers, byte by byte."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(data: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width).reshape(width, n).T
    return out.view("<u8").ravel()


def write_body(key: np.ndarray, context: np.ndarray | None, width: int, doc: np.ndarray, flag: np.ndarray) -> bytes:
    """Entries as a compressed block: steps between keys (8 bytes), contexts (``width`` bytes), ids (steps in a table, and places), flags."""
    ids, which = np.unique(doc, return_inverse=True)
    head = np.array([len(key), len(ids), width], "<i8").tobytes()
    steps = lambda x: _planes(np.diff(x.astype(np.int64).view(np.uint64), prepend=np.uint64(0)), 8)
    parts = [head, steps(ids), steps(key), _planes(context, width) if width else b"", _planes(which.astype(np.uint64), 4), flag.astype(np.uint8).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def read_body(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = memoryview(zstandard.ZstdDecompressor().decompress(body))
    n, n_ids, width = np.frombuffer(data, "<i8", 3).tolist()
    ids = np.cumsum(_unplanes(data[24:], n_ids, 8)).view(np.int64)
    at = 24 + 8 * n_ids
    key = np.cumsum(_unplanes(data[at:], n, 8))
    at += 8 * n
    context = np.zeros(n, np.uint64)
    if width:
        context = _unplanes(data[at:], n, width)
        at += width * n
    which = _unplanes(data[at:], n, 4)
    return key, context, ids[which.astype(np.int64)], np.frombuffer(data, np.uint8, n, at + 4 * n)


def pair(key: np.ndarray, context: np.ndarray, level: int) -> np.ndarray:
    """One name for a key and what of a context travels along."""
    return mix(mix(key * np.uint64(0xA0761D6478BD642F) + np.uint64(1)) + (context & np.uint64((1 << 8 * CONTEXT_BYTES[level]) - 1)))


def heads_of(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def spread(heads: np.ndarray, total: int) -> np.ndarray:
    """The run of each row."""
    return np.repeat(np.arange(len(heads)), np.diff(np.concatenate((heads, [total]))))


def dealt(block: int, level: int, key: np.ndarray, context: np.ndarray, doc: np.ndarray, shift: int) -> list[tuple]:
    """A block's entries, one a key and context, as rows by suffix bucket: the bits of the key above ``shift``."""
    if not len(key):
        return []
    held = context & np.uint64((1 << 8 * CONTEXT_BYTES[level]) - 1)
    order = np.lexsort((doc, held, key))
    key, held, doc = key[order], held[order], doc[order]
    heads = heads_of(key, held)
    flag = np.where(doc[heads] != doc[np.concatenate((heads[1:], [len(doc)])) - 1], MANY_DOCS, 0).astype(np.uint8)
    key, held, doc = key[heads], held[heads], doc[heads]
    bucket = (key >> np.uint64(shift)).astype(np.int64)  # ascending, as the keys are
    cuts = np.append(heads_of(bucket), len(bucket))
    return [(int(bucket[a]), block, level, write_body(key[a:b], held[a:b], CONTEXT_BYTES[level], doc[a:b], flag[a:b])) for a, b in zip(cuts[:-1], cuts[1:])]


def settle(table: pa.Table) -> pa.Table:
    """Sort one suffix bucket. A block that needs it learns of a key and context: the least id that has both, and whether the key has other
    contexts, so that the strings must be looked at.

    Rows of level 0 are answers on their way and pass through.
    """
    rows = []
    levels, blocks, bodies = (table.column(c).to_pylist() for c in ("level", "block", "body"))
    for level in sorted(set(levels)):
        mine = [k for k, x in enumerate(levels) if x == level]
        if level == 0:
            rows += [(blocks[k], 1, bodies[k]) for k in mine]
            continue
        parts = [read_body(bodies[k]) for k in mine]
        key, context, doc, flag = (np.concatenate(x) for x in zip(*parts))
        source = np.repeat(np.arange(len(mine)), [len(p[0]) for p in parts])
        order = np.lexsort((context, key))
        key, context, doc, flag, source = (x[order] for x in (key, context, doc, flag, source))
        by_key, by_both = heads_of(key), heads_of(key, context)
        of_key, of_both = spread(by_key, len(key)), spread(by_both, len(key))
        shared = (np.minimum.reduceat(doc, by_key) != np.maximum.reduceat(doc, by_key)) | (np.bitwise_or.reduceat(flag, by_key) > 0)
        many = np.minimum.reduceat(context, by_key) != np.maximum.reduceat(context, by_key)
        least = np.minimum.reduceat(doc, by_both)[of_both]
        many = many[of_key]
        tell = shared[of_key] & (many | (least < doc) | (flag > 0))
        name, source, answer, many = pair(key[tell], context[tell], level), source[tell], least[tell], many[tell]
        back = np.lexsort((name, source))
        name, source, answer, many = name[back], source[back], answer[back], many[back]
        cuts = np.append(heads_of(source), len(source)) if len(source) else []
        rows += [(blocks[mine[source[a]]], level, write_body(name[a:b], None, 0, answer[a:b], many[a:b])) for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.table([pa.array(x, f.type) for x, f in zip(list(zip(*rows)) or [[], [], []], ANSWER)], schema=ANSWER)


def pack_docs(ids: list, texts: list[str]) -> bytes:
    raw = [t.encode() for t in texts]
    head = np.array([len(raw), *(NULL_ID if k is None else k for k in ids), *map(len, raw)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(raw))


def unpack_docs(body: bytes) -> list[tuple[int, bytes]]:
    data = zstandard.ZstdDecompressor().decompress(body)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    ids, sizes = np.frombuffer(data, "<i8", n, 8).tolist(), np.frombuffer(data, "<i8", n, 8 + 8 * n).tolist()
    out, at = [], 8 + 16 * n
    for k, size in zip(ids, sizes):
        out.append((k, data[at : at + size]))
        at += size
    return out


def docs_of(table: pa.Table) -> list[tuple[int, bytes]]:
    return [d for body in table.column("docs").to_pylist() for d in unpack_docs(body)]


def _known(answers: pa.Table, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (ascending), least ids and flags that a block was told."""
    parts = [read_body(b) for x, b in zip(answers.column("level").to_pylist(), answers.column("body").to_pylist()) if x == level]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    key, _, doc, flag = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key)
    return key[order], doc[order], flag[order]


def _look(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``wanted`` are known, and their places."""
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    hit = np.flatnonzero(known[place] == wanted)
    return hit, place[hit]


def cut_passages(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id, kept, spans``: the bytes that stay, and the removed ones as ``(start, end)`` in the input's bytes, ascending and apart.

    A span can begin or end within a character, so ``kept`` is binary. Texts are UTF-8 bytes, null counts as empty; strings never cross rows. A byte is removed if a ``length``-byte string over it
    also starts in a row with a smaller id; rows of one id don't remove from one another, and a null id is smaller
    than every other. Strings are judged on the input. Texts shorter than ``length`` stay whole. An empty table gives no
    rows; other columns are ignored. Strings are known by names of 56 bits beside those of their core, and of 88 bits. A row is one unit of work: memory is about ten times its length.
    """
    rows = doc_text(df, id_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    core = min(CORE, length)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // (16 << 20))
    bits = max(1, int(max(parts, 2 * total // (length - core + 2) // BUCKET_ENTRIES)).bit_length())

    def to_blocks(batches):
        """Compressed runs of documents, named by their first id and text, which makes them the same in every attempt."""
        for batch in small_batches(batches, rows=1 << 16, byte_budget=BLOCK_BYTES):
            body = pack_docs(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            name = int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little", signed=True)
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([body], pa.binary())], schema=BLOCK)

    def entries(rows):
        return pa.table([pa.array(x, f.type) for x, f in zip(list(zip(*rows)) or [[], [], [], []], ENTRY)], schema=ENTRY)

    def sample(batches):
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, contexts, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for run in slices(unpack_docs(body)):
                    piece = Slice([t for _, t in run], length, core)
                    keys.append(keyed(piece.rank, bits))
                    contexts.append(piece.contexts())
                    docs.append(np.array([k for k, _ in run], np.int64)[piece.owner(piece.at)])
                yield from entries(dealt(block, 1, np.concatenate(keys), np.concatenate(contexts), np.concatenate(docs), key_bits(bits))).to_batches()

    def look_closer(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        known, least, many = _known(answers, 1)
        out = []
        if blocks.num_rows and len(known):
            block = blocks.column("block")[0].as_py()
            keys, seconds, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for run in slices(docs_of(blocks)):
                piece = Slice([t for _, t in run], length, core)
                ids = np.array([k for k, _ in run], np.int64)
                hit, place = _look(known, pair(keyed(piece.rank, bits), piece.contexts(), 1))
                first = (many[place] > 0) & (least[place] == ids[piece.owner(piece.at[hit])])
                start, names, others = piece.strings(hit[first])  # each context is looked at in one document
                keys.append(names)
                seconds.append(others)
                docs.append(ids[piece.owner(start)])
            out = dealt(block, 2, np.concatenate(keys), np.concatenate(seconds), np.concatenate(docs), 64 - bits)
            out += [(block % (1 << bits), block, 0, body) for body in answers.column("body").to_pylist()]
        return entries(out)

    def cut(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        known, least, many = _known(answers, 1)
        strings, least_of = _known(answers, 2)[:2]
        out = []
        for run in slices(docs_of(blocks)):
            piece = Slice([t for _, t in run], length, core)
            ids = np.array([k for k, _ in run], np.int64)
            edge = np.zeros(len(piece.text) + 1, np.int32)
            hit, place = _look(known, pair(keyed(piece.rank, bits), piece.contexts(), 1))
            earlier = least[place] < ids[piece.owner(piece.at[hit])]
            gone = hit[earlier]
            np.add.at(edge, piece.first[gone], 1)
            np.add.at(edge, piece.last[gone] + length, -1)
            start, names, others = piece.strings(hit[~earlier & (many[place] > 0)])
            told, where = _look(strings, pair(names, others, 2))
            start = start[told][least_of[where] < ids[piece.owner(start[told])]]
            np.add.at(edge, start, 1)
            np.add.at(edge, start + length, -1)
            removed = np.cumsum(edge[:-1]) > 0
            for (k, text), a, b in zip(run, piece.starts.tolist(), piece.ends.tolist()):
                bad = removed[a:b]
                edges = np.flatnonzero(np.diff(bad, prepend=False, append=False))
                kept = text if not len(edges) else piece.text[a:b][~bad].tobytes()
                out.append((None if k == NULL_ID else k, kept, edges))
        docs, kept, edges = list(zip(*out)) or [[]] * 3
        bounds = np.concatenate((np.zeros(1, np.int64), *edges))[1:]
        spans = pa.StructArray.from_arrays([bounds[::2], bounds[1::2]], fields=list(SPAN))
        offsets = np.cumsum([0, *(len(e) // 2 for e in edges)]).astype(np.int32)
        return pa.table([pa.array(docs, pa.int64()), pa.array(kept, pa.binary()), pa.ListArray.from_arrays(offsets, spans)], schema=OUT)

    blocks = rows.mapInArrow(to_blocks, "block bigint, docs binary").repartition(parts, "block")
    entry, answer = "bucket bigint, block bigint, level int, body binary", "block bigint, level int, body binary"
    first = blocks.mapInArrow(sample, entry).groupBy("bucket").applyInArrow(settle, answer)
    closer = blocks.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(look_closer, entry)
    second = closer.groupBy("bucket").applyInArrow(settle, answer)
    return blocks.groupBy("block").cogroup(second.groupBy("block")).applyInArrow(cut, "doc_id bigint, kept binary, spans array<struct<start:bigint,end:bigint>>")


def remove_passages(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``cut_passages`` in digest: per row ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    n_removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, span: n + span["end"] - span["start"])
    out = cut_passages(df, length, id_col, text_col).withColumn("n_removed", n_removed)
    return out.select("doc_id", (F.octet_length("kept") + F.col("n_removed")).alias("n_bytes"), "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_passages(spark, sf_dir):
    return remove_passages(documents(spark, sf_dir))
