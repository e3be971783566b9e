"""Exact Jaccard join of word-shingle sets in metric space.

1. Sets meet in groups: two sets within the bound have equal projections on some small part of the shingle space
   (``shingles.signatures``), and projections are the keys of the groups. No pair within the bound is lost. A block of documents sends one set for each key;
   blocks with several sets of a key are joined with their own lists, so that no task sees more than one entry a block and key.
2. The least member of a group is its pivot. All groups of a pivot are its region; a set on a border lies in several regions. Every pair
   within the bound lies together in some region.
3. Fixed pivots for all sets are 32 parts of the space. How far a set lies from each (its profile) bounds its distance from any other set
   by the triangle inequality: the symmetric difference of two sets is at least the sum of the differences of their profiles. Long sets that share nothing
   have profiles alike, so each set has a sketch too, of a bit or more for each element: the difference of two sets is at least that of their sketches. In
   regions of a few parts, sets outside of the windows of all others leave, before any text is read.
4. A small region is joined by one task, pivot after pivot, on the shingles of the texts: with a pivot at distance d(x), x and y can link
   only if d(x) and d(y) differ by at most r = 1 - t, so each further pivot meets only the sets in its window.
5. A large region is dealt over many tasks, each with a pivot's text. Sets at most r from the pivot link to it, and through it to one another.
   Only sets that are not linked to it, and linked ones within r of them by distance, go on. Since x and y differ where their
   differences from the pivot differ, they meet again in groups by the first shingles of these differences, those rare in the region
   first. Groups that links have joined already are done; the others form the regions of the next level, with pivots of their own, and so on. A region of a
   few parts (or, after ``MOST_LEVELS`` levels, of any number) is then joined in pairs of parts of bounded size.

Equal sets are one class throughout. Links are verified on the shingles of the texts; the components of verified links are those of
all links.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, compact, doc_text, documents, forget, give_back, small_batches
from .components import components
from .passages import NULL_ID, docs_of, pack_docs, unpack_docs
from .shingles import CELLS, TOGETHER, Sketches, profiles, set_name, shingle_sets, signatures, sketch_bytes, sketches

BLOCK_BYTES, BUCKET_ENTRIES, SMALL_REGION = 2 << 20, 400_000, 512
#: Sets of a region whose profiles one task compares; the sets of a region of more parts than ``SIEVE_PARTS`` all go on.
SIEVE_PART, SIEVE_PARTS = 4096, 16
BLOCK = pa.schema([("block", pa.int64()), ("docs", pa.binary())])
ENTRY = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("body", pa.binary())])
#: Large regions are dealt again by their pivots so many times; what is large then is joined in pairs of parts.
MOST_LEVELS = 8
#: From the second level on, a region of up to so many parts is joined in pairs of its parts and not dealt again.
LEAF_PARTS = 8
MET = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64()), ("profile", pa.binary())])
TRIPLE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64())])
NEAR = pa.schema([("p", pa.int64()), ("x", pa.int64())])
TEXT = pa.schema([("set", pa.int64()), ("body", pa.binary())])
FOUND = pa.schema([("kind", pa.int32()), ("p", pa.int64()), ("x", pa.int64()), ("d", pa.float64()), ("linked", pa.bool_()), ("need", pa.int32()), ("delta", pa.list_(pa.int64()))])
DOC, GROUP, LOCAL, MANY = 0, 1, 2, 3
LINK, LARGE = 0, 1


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(x, f.type) for x, f in zip(list(zip(*rows)) or [[]] * len(schema), schema)], schema=schema)


def _sql(schema: pa.Schema) -> str:
    kinds = {"int32": "int", "int64": "bigint", "binary": "binary", "double": "double", "bool": "boolean"}
    return ", ".join(f"`{f.name}` {kinds.get(str(f.type), 'array<bigint>')}" for f in schema)


def to_blocks(batches):
    """Compressed runs of documents under a name made from their content, the same in every attempt."""
    forget()
    for batch in small_batches(batches, rows=1 << 16, byte_budget=BLOCK_BYTES):
        body = pack_docs(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        name = int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little", signed=True)
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([body], pa.binary())], schema=BLOCK)


def prefix_length(n: np.ndarray, numerator: int, denominator: int) -> np.ndarray:
    """How many first shingles of a set of ``n`` must be looked at."""
    return n * (denominator - numerator) // numerator + 1


def planes(x: np.ndarray) -> np.ndarray:
    """Numbers byte by byte."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)


def write_meeting(key: np.ndarray, which: np.ndarray, many: np.ndarray, sets: np.ndarray) -> bytes:
    """Entries of a block: ascending keys, the set (by place) and whether the block has other sets with the key."""
    used, which = np.unique(which, return_inverse=True)
    steps = np.diff(key, prepend=np.uint64(0))
    body = np.array([len(key), len(used)], "<i8").tobytes() + sets[used].astype("<i8").tobytes() + planes(steps).tobytes() + planes(which)[:4].tobytes() + many.astype(np.uint8).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(body)


def read_meeting(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(body)
    n, used = np.frombuffer(data, "<i8", 2).tolist()
    sets = np.frombuffer(data, "<i8", used, 16)
    at = 16 + 8 * used
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n, at).reshape(8, n).T).view("<u8").ravel()
    which = np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n, at + 8 * n).reshape(4, n).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint64), sets[which], np.frombuffer(data, np.uint8, n, at + 12 * n) > 0


def _met(kind: int, a, b, c, profile) -> pa.Table:
    return pa.table([pa.array(np.full(len(a), kind, np.int32)), *(pa.array(x.astype(np.int64)) for x in (a, b, c)), profile], schema=MET)


def _bodies(kind: int, bodies: list[bytes], block: int = 0) -> pa.Table:
    """Rows that hold many triples each."""
    a = np.full(len(bodies), block, np.int64)
    return _met(kind, a, a * 0, a * 0, pa.array(bodies, pa.binary()))


def write_triples(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> bytes:
    """Triples by ascending ``a``, with few different ``c``."""
    used, which = np.unique(c, return_inverse=True)
    steps = np.diff(a, prepend=np.int64(0))
    body = np.array([len(a), len(used)], "<i8").tobytes() + used.astype("<i8").tobytes() + planes(steps).tobytes() + planes(b).tobytes() + planes(which)[:4].tobytes()
    return zstandard.ZstdCompressor(level=1).compress(body)


def read_triples(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(body)
    n, used = np.frombuffer(data, "<i8", 2).tolist()
    column = lambda at, width, kind: np.ascontiguousarray(np.frombuffer(data, np.uint8, width * n, at).reshape(width, n).T).view(kind).ravel()
    at = 16 + 8 * used
    return np.cumsum(column(at, 8, "<i8"), dtype=np.int64), column(at + 8 * n, 8, "<i8"), np.frombuffer(data, "<i8", used, 16)[column(at + 16 * n, 4, "<u4")]


def triples(batches):
    """The triples of rows ``kind, a, profile``; those of a block's own groups are ``key, set, block``."""
    for batch in batches:
        for kind, block, body in zip(*(batch.column(c).to_pylist() for c in ("kind", "a", "profile"))):
            if kind == LOCAL:
                key, own = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), "<i8").reshape(2, -1)
                found = key, own, np.full(len(key), block)
            else:
                found = read_triples(body)
            for k in range(0, len(found[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + (1 << 16)], pa.int64()) for x in found], schema=TRIPLE)


def meet(table: pa.Table) -> pa.Table:
    """One bucket of keys. For the groups of two sets and more: ``pivot, set, block`` where a block has one set with the key, each pair once, and
    ``pivot, key, block`` where it has several, many in a row; a key has one entry a block, however many sets there have it. A pair of sets that share many keys
    is found in many buckets, so these rows are kept short. Documents and the rows of a block's own groups pass through."""
    out, keys, sets, blocks, flags = [], [], [], [], []
    for kind, block, body in zip(*(table.column(c).to_pylist() for c in ("kind", "block", "body"))):
        if kind == DOC:
            raw = zstandard.ZstdDecompressor().decompress(body)
            n = int(np.frombuffer(raw, "<i8", 1)[0])
            rows, held = np.frombuffer(raw, "<i8", 4 * n, 8).reshape(-1, 4), raw[8 + 32 * n :]
            ends = np.cumsum(np.where(rows[:, 3] > 0, CELLS + sketch_bytes(rows[:, 1]), 0)).tolist()
            shapes = [held[a:b] if fresh else None for a, b, fresh in zip([0, *ends], ends, rows[:, 3].tolist())]
            out.append(_met(DOC, rows[:, 0], rows[:, 1], rows[:, 2], pa.array(shapes, pa.binary())))
        elif kind == LOCAL:
            out.append(_bodies(LOCAL, [body], block))
        else:
            k, s, f = read_meeting(body)
            keys.append(k)
            sets.append(s)
            flags.append(f)
            blocks.append(np.full(len(k), block, np.int64))
    if keys:
        key, which, block, many = map(np.concatenate, (keys, sets, blocks, flags))
        order = np.lexsort((block, which, key))
        key, which, block, many = key[order], which[order], block[order], many[order]
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        n = np.diff(np.concatenate((heads, [len(key)])))
        pivot = np.repeat(which[heads], n)  # sets ascend within a key
        met = np.repeat((np.maximum.reduceat(which, heads) != which[heads]) | np.logical_or.reduceat(many, heads), n)
        one, several = met & ~many, met & many
        order = np.argsort(pivot[several], kind="stable")
        if len(order):
            out.append(_bodies(MANY, [write_triples(pivot[several][order], key[several][order].view(np.int64), block[several][order])]))
        pivot, which, block = pivot[one], which[one], block[one]
        order = np.lexsort((block, which, pivot))
        pivot, which, block = pivot[order], which[order], block[order]
        new = np.ones(len(pivot), bool)
        new[1:] = (pivot[1:] != pivot[:-1]) | (which[1:] != which[:-1])
        if len(new):
            out.append(_bodies(GROUP, [write_triples(pivot[new], which[new], block[new])]))
    return pa.concat_tables(out) if out else _table([], MET)


def linked(inter, a, b, numerator: int, denominator: int):
    return denominator * inter >= numerator * (a + b - inter)


def region_links(sets: list[np.ndarray], numerator: int, denominator: int, labels: list | None = None, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between sets, by place, that join those which any links join: pivot after pivot, each in the window that the distances to
    the pivots before it leave. Sets of one label are joined already; with ``sides``, only sets of different sides are compared."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
    r, root, links = 1 - numerator / denominator, np.arange(len(sets)), []
    if labels is not None:
        root = np.unique(np.array(labels), return_inverse=True)[1]
    distances: list[np.ndarray] = []
    for pivot in range(len(sets)):
        if (root == root[0]).all():
            break
        fits = (root != root[pivot]) & linked(np.minimum(sizes, sizes[pivot]), sizes, sizes[pivot], numerator, denominator)
        fits[: pivot if sides is None else 0] = False
        if sides is not None:
            fits &= (sides != sides[pivot]) & (sides[pivot] == sides[0])
        for d in distances:
            fits &= np.abs(d - d[pivot]) <= r + 1e-9
        rest = np.flatnonzero(fits)
        if not len(rest):
            continue
        if len(distances) < 4 and 2 * len(rest) >= len(sets):
            rest_of = np.arange(len(sets))
        else:
            rest_of = rest
        inter = _overlaps(flat, starts, sizes, rest_of, sets[pivot])
        if len(rest_of) == len(sets):
            distances.append(1 - inter / (sizes + sizes[pivot] - inter))
            inter = inter[rest]
        for k in rest[linked(inter, sizes[rest], sizes[pivot], numerator, denominator)].tolist():
            if root[k] != root[pivot]:
                root[root == root[k]] = root[pivot]
                links.append((pivot, k))
    return links


def _overlaps(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, chosen: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    """Elements that each chosen set shares with the pivot; all are ascending."""
    n = sizes[chosen]
    heads = np.cumsum(n) - n
    picked = flat if len(chosen) == len(sizes) else flat[np.repeat(starts[chosen] - heads, n) + np.arange(n.sum())]
    place = np.minimum(np.searchsorted(pivot, picked), len(pivot) - 1)
    return np.add.reduceat((pivot[place] == picked).astype(np.int64), heads)


def jaccard_classes(df: DataFrame, words: int, numerator: int, denominator: int, id_col: str = "doc_id", text_col: str = "text", small_region: int = SMALL_REGION) -> tuple[DataFrame, DataFrame]:
    """The join's own outputs: ``doc_id, n_shingles, set`` for every row, and verified links ``a, b`` between sets.

    ``set`` names a class of equal shingle sets in 64 bits; rows without words have a null set. Links: every two sets that a chain of pairs of
    Jaccard similarity at least ``numerator / denominator`` joins are joined by a chain of the links returned, each of which is such a
    pair. An empty table gives empty outputs; null ids, repeated ids and repeated rows are separate members of their classes.
    """
    if not 0 < numerator < denominator:
        raise ValueError("the similarity must lie between 0 and 1")
    spark, rows = df.sparkSession, doc_text(df, id_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (16 << 20))
    bits = max(1, int(max(parts, total // 16 // BUCKET_ENTRIES)).bit_length())

    def enter(batches):
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs = unpack_docs(body)
                out, held, known, fresh = [], [], set(), ([], [], [])
                for k in range(0, len(docs), TOGETHER):
                    part = docs[k : k + TOGETHER]
                    sets = shingle_sets([t.decode() for _, t in part], words)
                    ids = [set_name(s) if len(s) else 0 for s in sets]
                    new = []
                    for place, (s, i) in enumerate(zip(sets, ids)):
                        if len(s) and i not in known:
                            known.add(i)
                            new.append(place)
                    first = set(new)
                    out += [(d, len(s), i, k in first) for k, ((d, _), s, i) in enumerate(zip(part, sets, ids))]
                    if new:
                        own = [sets[p] for p in new]
                        held += [x for pair in zip(map(bytes, profiles(own)), sketches(own)) for x in pair]
                        owner, key = signatures([sets[p] for p in new], numerator, denominator)
                        fresh[0].append(key)
                        fresh[1].append(owner + len(fresh[2]))
                        fresh[2].extend(ids[p] for p in new)
                rows = [(block % (1 << bits), block, DOC, zstandard.ZstdCompressor(level=1).compress(np.array([len(docs)], "<i8").tobytes() + np.array(out, "<i8").tobytes() + b"".join(held)))]
                if fresh[2]:
                    key, which, sets = np.concatenate(fresh[0]), np.concatenate(fresh[1]), np.array(fresh[2], np.int64)
                    order = np.lexsort((sets[which], key))
                    key, which = key[order], which[order]
                    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                    n = np.diff(np.concatenate((heads, [len(key)])))
                    shared = np.repeat(n > 1, n)
                    if shared.any():
                        body = np.concatenate((key[shared].view(np.int64), sets[which[shared]])).astype("<i8").tobytes()
                        rows.append((block % (1 << bits), block, LOCAL, zstandard.ZstdCompressor(level=1).compress(body)))
                    key, which, many = key[heads], which[heads], n > 1
                    bucket = (key >> np.uint64(64 - bits)).astype(np.int64)
                    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
                    rows += [(int(bucket[a]), block, GROUP, write_meeting(key[a:b], which[a:b], many[a:b], sets)) for a, b in zip(cuts[:-1], cuts[1:])]
                yield from _table(rows, ENTRY).to_batches()
        give_back()

    blocks = rows.mapInArrow(to_blocks, _sql(BLOCK))
    met = checkpointed(blocks.repartition(parts, "block").mapInArrow(enter, _sql(ENTRY)).groupBy("bucket").applyInArrow(meet, _sql(MET)))
    members = met.filter(F.col("kind") == DOC).select(
        F.when(F.col("a") != NULL_ID, F.col("a")).alias("doc_id"), F.col("b").alias("n_shingles"), F.when(F.col("b") > 0, F.col("c")).alias("set")
    )
    rows_of = lambda kind, *names: met.filter(F.col("kind") == kind).select("kind", "a", "profile").mapInArrow(triples, _sql(TRIPLE)).toDF(*names)
    local, many, grouped = rows_of(LOCAL, "key", "x", "block"), rows_of(MANY, "p", "key", "block"), rows_of(GROUP, "p", "x", "block")
    grouped = checkpointed(grouped.unionByName(many.join(local, ["key", "block"]).select("p", "x", "block")).groupBy("p", "x").agg(F.min("block").alias("block")))
    together = grouped.select("p", "x")
    homes = grouped.groupBy("x").agg(F.min("block").alias("block"))
    shapes = met.filter((F.col("kind") == DOC) & (F.col("b") > 0)).groupBy(F.col("c").alias("x")).agg(F.min("b").alias("n"), F.min("profile").alias("profile"))

    def sets_of(bodies):
        return shingle_sets([zstandard.ZstdDecompressor().decompress(b).decode() for b in bodies], words)

    def sieve(table: pa.Table) -> pa.Table:
        """Of two parts of a region (or one with itself), the sets with another in their window."""
        n, part = table.column("n").to_numpy(), table.column("part").to_numpy()
        shapes = table.column("profile").to_pylist()
        profile = np.frombuffer(b"".join(s[:CELLS] for s in shapes), np.uint8).reshape(-1, CELLS).astype(np.int16)
        sketch = Sketches([s[CELLS:] for s in shapes])
        one = np.flatnonzero(part == table.column("i")[0].as_py())
        two = np.flatnonzero(part == table.column("j")[0].as_py())
        near = np.zeros(len(n), bool)
        for k in one:
            apart = np.abs(profile[two] - profile[k]).sum(1, dtype=np.int64)
            met = two[(apart * (denominator + numerator) <= (n[two] + n[k]) * (denominator - numerator)) & (two != k)]
            if len(met):
                met = met[sketch.apart(k, met) * (denominator + numerator) <= (n[met] + n[k]) * (denominator - numerator)]
            near[met] = True
            near[k] |= len(met) > 0
        return pa.table([table.column("p").filter(pa.array(near)), table.column("x").filter(pa.array(near))], schema=NEAR)

    def compare(table: pa.Table, pivots: pa.Table) -> pa.Table:
        """One deal of a large region with its pivot."""
        if not table.num_rows or not pivots.num_rows:
            return _table([], FOUND)
        p, names = table.column("p")[0].as_py(), table.column("x").to_pylist()
        pivot, *sets = sets_of([pivots.column("head")[0].as_py(), *table.column("text").to_pylist()])
        out = []
        for name, s in zip(names, sets):
            delta = np.setxor1d(s, pivot, assume_unique=True)
            inter = (len(s) + len(pivot) - len(delta)) // 2
            is_linked = bool(linked(inter, len(s), len(pivot), numerator, denominator))
            out.append((LARGE, p, name, len(delta) / (inter + len(delta)), is_linked, int(prefix_length(np.int64(len(s)), numerator, denominator)), delta.astype(np.int64)))
        return _table(out, FOUND)

    def compare_parts(table: pa.Table) -> pa.Table:
        """A small region, or two parts of a larger one (or one part with itself)."""
        names, parts_of = table.column("x").to_pylist(), table.column("part").to_numpy()
        order = np.argsort(parts_of, kind="stable")
        bodies, labels = table.column("text").to_pylist(), table.column("label").to_pylist()
        sides = parts_of[order] if table.column("i")[0].as_py() != table.column("j")[0].as_py() else None
        found = region_links(sets_of([bodies[k] for k in order]), numerator, denominator, [labels[k] for k in order], sides)
        return _table([(LINK, names[order[a]], names[order[b]], 0.0, True, 0, []) for a, b in found], FOUND)

    def regions(groups: DataFrame) -> DataFrame:
        """``p, x``: the sets of each region, its pivot too."""
        pivots = groups.groupBy("g").agg(F.min("x").alias("p"), F.count("*").alias("n")).filter("n > 1").select("g", "p")
        return groups.join(pivots, "g").select("p", "x").distinct()

    def in_parts(members: DataFrame, part: int) -> DataFrame:
        """``members`` and ``i, j, part``: every two parts of a region together, each of about ``part`` sets; a small region is one part."""
        sizes = members.groupBy("p").agg(F.ceil(F.count("*") / part).cast("int").alias("deals"))
        parts = members.join(sizes, "p").withColumn("part", F.pmod(F.xxhash64("x"), F.col("deals")).cast("int"))
        parts = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
        return parts.select(*members.columns, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part")

    pairs = lambda rows: rows.filter("linked").select(F.col("p").alias("a"), F.col("x").alias("b"))
    counts = together.groupBy("p").agg(F.count("*").alias("size"))
    sized = together.join(counts, "p")
    shaped = in_parts(sized.filter(F.col("size") <= SIEVE_PART * SIEVE_PARTS).select("p", "x"), SIEVE_PART).join(shapes, "x")
    sieved = shaped.groupBy("p", "i", "j").applyInArrow(sieve, _sql(NEAR))
    near = compact(checkpointed(sieved.unionByName(sized.filter(F.col("size") > SIEVE_PART * SIEVE_PARTS).select("p", "x")).distinct()))
    wanted = near.select("x").distinct().join(homes, "x")

    def fetch(table: pa.Table, wanted: pa.Table) -> pa.Table:
        want, out = set(wanted.column("x").to_pylist()), []
        if not want or not table.num_rows:
            return _table([], TEXT)
        docs = docs_of(table)
        for k in range(0, len(docs), TOGETHER):
            texts = [t for _, t in docs[k : k + TOGETHER]]
            for t, s in zip(texts, shingle_sets([t.decode() for t in texts], words)):
                name = set_name(s) if len(s) else 0
                if len(s) and name in want:
                    want.discard(name)
                    out.append((name, zstandard.ZstdCompressor(level=1).compress(t)))
        return _table(out, TEXT)

    texts = checkpointed(blocks.repartition(parts, "block").groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(fetch, _sql(TEXT)))
    texts_of = lambda name: texts.select(F.col("set").alias(name), F.col("body").alias("text"))
    near, links, level = near.withColumn("label", F.col("x")), None, 0
    while True:
        level += 1
        sized = near.join(near.groupBy("p").agg(F.count("*").alias("size"), F.min("x").alias("pivot")), "p")
        bound = small_region * (1 if level == 1 else LEAF_PARTS)
        leaf = sized.filter(F.col("size") <= bound) if level < MOST_LEVELS else sized
        dealt = in_parts(leaf.select("p", "x", "label"), small_region)
        found = pairs(dealt.join(texts_of("x"), "x").groupBy("p", "i", "j").applyInArrow(compare_parts, _sql(FOUND)))
        large = sized.filter((F.col("size") > bound) & (F.col("x") != F.col("pivot"))).select(F.col("pivot").alias("p"), "x").distinct() if level < MOST_LEVELS else None
        if large is not None:
            large = compact(checkpointed(large))
        if large is None or large.isEmpty():
            links = compact(checkpointed(found if links is None else links.unionByName(found)))
            break
        deals = large.groupBy("p").agg(F.ceil(F.count("*") / small_region).cast("int").alias("deals"))
        each = large.join(deals, "p").withColumn("salt", F.pmod(F.xxhash64("x"), F.col("deals")).cast("int")).join(texts_of("x"), "x").select("p", "salt", "x", "text")
        heads = deals.select("p", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("salt")).join(texts_of("p"), "p")
        heads = heads.select(F.col("p").alias("pivot"), F.col("salt").alias("deal"), F.col("text").alias("head"))
        big = checkpointed(each.groupBy("p", "salt").cogroup(heads.groupBy("pivot", "deal")).applyInArrow(compare, _sql(FOUND)))
        found = found.unionByName(pairs(big))
        links = compact(checkpointed(found if links is None else links.unionByName(found)))
        nearest = big.filter("not linked").groupBy("p").agg(F.min("d").alias("nearest"))
        going = big.join(nearest, "p").filter(F.col("d") >= F.col("nearest") - F.lit(1 - numerator / denominator + 1e-9))  # the window
        pieces = going.select("p", "x", "need", F.size("delta").alias("all"), F.explode("delta").alias("e"))
        # Elements of one set alone come first in its order and meet nothing; the rest of the prefix is what they leave.
        often = pieces.groupBy("p", "e").agg(F.count("*").alias("n")).filter("n > 1")
        own = Window.partitionBy("p", "x")  # a set's difference
        shared = pieces.join(often, ["p", "e"]).withColumn("rank", F.row_number().over(own.orderBy("n", "e"))).withColumn("some", F.count("*").over(own))
        first = shared.filter(F.col("rank") + F.col("all") - F.col("some") <= F.col("need"))
        again = compact(checkpointed(first.select(F.xxhash64("p", "e").alias("g"), "x")))
        if again.isEmpty():
            break
        # Groups that links have joined already are done; the others are the regions of the next level.
        roots = components(links)
        labelled = again.join(roots, F.col("x") == F.col("node"), "left").select("g", "x", F.coalesce("root", "x").alias("label"))
        open_groups = labelled.groupBy("g").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least != most").select("g")
        after = regions(again.join(open_groups, "g", "left_semi")).join(roots, F.col("x") == F.col("node"), "left")
        near = compact(checkpointed(after.select("p", "x", F.coalesce("root", "x").alias("label"))))
        if near.isEmpty():
            break
    return members, links


def jaccard_components(df: DataFrame, words: int = 5, numerator: int = 80, denominator: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id, n_shingles, component_id``: the size of its set of ``words``-word shingles, and the smallest id that links
    of Jaccard similarity at least ``numerator / denominator`` reach, its own included.

    A-Z are lower-cased and words end at ASCII white space. Texts of fewer words have their whole sequence as one shingle; null, empty and
    blank texts have none and link with nothing. Null ids never stand for a component that has another id. Repeated rows
    link; an empty table gives no rows; other columns are ignored.
    """
    members, links = jaccard_classes(df, words, numerator, denominator, id_col, text_col)
    classes = members.filter(F.col("set").isNotNull()).groupBy("set").agg(F.min("doc_id").alias("least"))
    roots = components(links)
    of_class = classes.join(roots, F.col("set") == F.col("node"), "left").select("set", "least", F.coalesce("root", "set").alias("root"))
    best = of_class.groupBy("root").agg(F.min("least").alias("component"))
    by_set = of_class.join(best, "root").select(F.col("set").alias("its"), "component")
    joined = members.join(by_set, F.col("set") == F.col("its"), "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op2_jaccard_join(spark, sf_dir):
    return jaccard_components(documents(spark, sf_dir), 3, 90, 100)
