"""Sampled sentence-piece segmentation: forward filtering, backward sampling over the piece lattice; lossless decoding.

A text is its dummy space and characters; spaces are written as the word mark. The lattice is cut where no piece of the vocabulary can cross: before a run
of spaces, if no piece has a mark behind another character, and nowhere else. Each unit (a run of spaces and the word behind it) so has a lattice of
its own whose edges are all pieces of the vocabulary, those of several marks too. Characters that are no piece, and a literal word mark, become byte
pieces, so decoding returns the text exactly.

Pieces of a unigram model weigh their scores, which are log-probabilities. A merge model has ranks instead; the piece of rank r
weighs ``-log(r + 2)``, as in a text where words follow Zipf's law.

Forward sums are kept per distinct unit, for all units of a batch at once; backward sampling draws the last piece of a prefix, then the
one before, for all units of a batch at once. Draws come from a counter-based generator over (seed, row key, unit
number, step), so a row's segmentation depends neither on other rows nor on how rows are dealt to tasks.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import SentencePieceProcessor

from .common import doc_text, kept_in_worker, record_batch, small_batches

MARK = 0x2581
#: Stands for a word mark that is part of a text; no piece holds it.
LITERAL_MARK = 0x110000
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Leading bits of a piece's hash in the filter before the search.
SEEN_BITS = 19
#: Characters of the units whose tables a worker keeps; they only save time.
UNIT_LIMIT = 3_000_000
SCHEMA = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string()), ("lossless", pa.bool_())])


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def row_seed(doc_id: int | None, seed: int) -> int:
    key = "null" if doc_id is None else str(doc_id)
    return int.from_bytes(hashlib.blake2b(f"{seed}:{key}".encode(), digest_size=8).digest(), "little")


def _fields(data: bytes):
    """``number, value`` of the fields of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size


def is_unigram(proto: bytes) -> bool:
    """Whether the model's trainer says unigram, which is also its default."""
    trainer = b"".join(v for n, v in _fields(proto) if n == 2)
    return dict(_fields(trainer)).get(3, 1) == 1


class Vocabulary:
    """Pieces with log-probabilities, hashed by length; byte pieces apart."""

    def __init__(self, proto: bytes):
        sp = SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        plain = [k for k in range(n) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k))]
        score = np.array([sp.get_score(k) for k in plain])
        floor = float(-np.log(n + 2.0))
        weight = np.maximum(floor, -np.log(np.maximum(-score, 0) + 2.0))
        if is_unigram(proto):
            weight, floor = score, float(score.min())
        #: Units of a text (with its dummy space first): all of it, if a piece may cross from a word into the spaces behind it.
        crossing = any(re.search(f"[^{chr(MARK)}]{chr(MARK)}", sp.id_to_piece(k)) for k in plain)
        self.units = (lambda text: [text]) if crossing else re.compile(" +[^ ]*").findall
        self.byte_logp = 1.5 * floor
        self.first_byte = next((k for k in range(n) if sp.is_byte(k)), None)
        if self.first_byte is None:
            raise ValueError("the model has no byte pieces, so unknown characters could not be kept")
        self.bytes_of = [b""] * n
        by_length: dict[int, list] = {}
        for k, w in zip(plain, weight.tolist()):
            piece = sp.id_to_piece(k)
            self.bytes_of[k] = piece.replace(chr(MARK), " ").encode()
            by_length.setdefault(len(piece), []).append((piece, k, w))
        for b in range(256):
            self.bytes_of[self.first_byte + b] = bytes([b])
        self.longest = max(by_length)
        self.tables = {}
        for length, items in by_length.items():
            points = np.array([[ord(c) for c in p] for p, _, _ in items], np.uint64)
            h = np.zeros(len(items), np.uint64)
            for c in range(length):
                h = h * BASE + points[:, c] + np.uint64(1)
            order = np.argsort(h)
            seen = np.zeros(1 << SEEN_BITS, bool)
            seen[h >> np.uint64(64 - SEEN_BITS)] = True
            self.tables[length] = (seen, h[order], np.array([k for _, k, _ in items], np.int32)[order], np.array([w for _, _, w in items])[order])


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.kept, self.n = np.empty(1024, kind), 0

    def append(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.kept):
            bigger = np.empty(max(2 * len(self.kept), self.n + len(more)), self.kept.dtype)
            bigger[: self.n] = self.kept[: self.n]
            self.kept = bigger
        self.kept[self.n : self.n + len(more)] = more
        self.n += len(more)


class Lattices:
    """Backward-sampling tables of the distinct units met so far."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.held = 0  # characters of these units
        self.last_node = Grown(np.int32)  # by unit: its final node; the nodes of a unit follow one another
        self.first_edge = Grown(np.int32)  # by node
        self.cumulative = Grown(np.float32)  # by edge: probability of this edge or one before it, 1 at a node's last
        self.origin = Grown(np.int32)  # by edge: the node it starts at, -1 for the unit's start
        self.piece = Grown(np.int32)  # by edge: piece id, or -1 - code point

    def edges(self, text: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, last character, piece and log-probability of every edge; ``end`` bounds the unit of each character."""
        v = self.vocabulary
        points = text.astype(np.uint64) + np.uint64(1)
        starts, stops, pieces, weights = [], [], [], []
        known, at = np.zeros(len(text), bool), np.arange(len(text), dtype=np.int32)
        rolling = np.zeros(len(text), np.uint64)
        for length in range(1, v.longest + 1):
            if length > 1:
                inside = at + length <= end[at]
                at, rolling = at[inside], rolling[inside]
            if not len(at):
                break
            rolling = rolling * BASE + points[at + (length - 1)]
            if length not in v.tables:
                continue
            seen, hashes, ids, logp = v.tables[length]
            maybe = np.flatnonzero(seen[rolling >> np.uint64(64 - SEEN_BITS)])
            wanted = rolling[maybe]
            place = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
            right = hashes[place] == wanted
            hit, place = at[maybe[right]], place[right]
            if length == 1:
                known[hit] = True
            starts.append(hit)
            stops.append(hit + np.int32(length - 1))
            pieces.append(ids[place])
            weights.append(logp[place])
        odd = np.flatnonzero(~known).astype(np.int32)
        point = np.where(text[odd] == LITERAL_MARK, MARK, text[odd])
        width = 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)
        join = np.concatenate
        return join([*starts, odd]), join([*stops, odd]), join([*pieces, (-1 - point).astype(np.int32)]), join([*weights, v.byte_logp * width])

    def add(self, units: list[str]) -> None:
        """Forward filtering for new distinct units."""
        lengths = np.array([len(u) for u in units], np.int32)
        text = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        first = (np.cumsum(lengths) - lengths).astype(np.int32)
        text[text == MARK] = LITERAL_MARK
        text[text == 0x20] = MARK
        total, unit_first = len(text), np.repeat(first, lengths)
        starts, stops, pieces, weights = self.edges(text, np.repeat(first + lengths, lengths))
        # Edges by depth of their end within the unit, then by node: all that end at one depth are summed together.
        depth = stops - unit_first[stops]
        deepest = int(depth.max())
        key = depth.astype(np.int64) * total + stops
        order = np.argsort(key, kind="stable")
        starts, stops, pieces, weights, depth = starts[order], stops[order], pieces[order], weights[order], depth[order]
        begins = starts == unit_first[starts]
        forward, share = np.zeros(total), np.empty(len(starts))
        bounds = np.searchsorted(depth, np.arange(deepest + 2))
        for a, b in zip(bounds[:-1], bounds[1:]):
            node = stops[a:b]
            value = weights[a:b] + np.where(begins[a:b], 0.0, forward[starts[a:b] - 1])
            new = np.concatenate(([True], node[1:] != node[:-1]))
            heads, group = np.flatnonzero(new), np.cumsum(new) - 1
            top = np.maximum.reduceat(value, heads)
            e = np.exp(value - top[group])
            summed = np.add.reduceat(e, heads)
            forward[node[heads]] = top + np.log(summed)
            share[a:b] = e / summed[group]
        order = np.argsort(stops - 0.999 * share)  # by node, likeliest edge first
        starts, stops, begins, share, pieces = starts[order], stops[order], begins[order], share[order], pieces[order]
        heads = np.flatnonzero(np.concatenate(([True], stops[1:] != stops[:-1])))
        tails = np.concatenate((heads[1:], [len(stops)])) - 1
        running = np.cumsum(share)
        running -= np.repeat(np.concatenate(([0.0], running[tails[:-1]])), tails - heads + 1)
        running[tails] = 2.0
        nodes = self.first_edge.n
        self.first_edge.append(self.piece.n + heads)
        self.cumulative.append(running)
        self.origin.append(np.where(begins, -1, nodes + starts - 1))
        self.piece.append(pieces)
        self.last_node.append(nodes + first + lengths - 1)
        known = len(self.index)
        self.index.update(zip(units, range(known, known + len(units))))
        self.held += total

    def sample(self, keys: list[int], texts: list[str]) -> list[np.ndarray]:
        """Piece ids of each text; ``keys`` are the row seeds."""
        split = [self.vocabulary.units(" " + t) if t else [] for t in texts]
        if self.held > UNIT_LIMIT:
            self.reset()
        new = set().union(*split).difference(self.index)
        if new:
            self.add(list(new))
        counts = np.array([len(us) for us in split], np.int64)
        if not counts.sum():
            return [np.zeros(0, np.int32) for _ in texts]
        look = self.index.__getitem__
        unit = np.array([k for us in split for k in map(look, us)], np.int64)
        number = (np.arange(len(unit)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.uint64)
        key = mix(np.repeat(np.array(keys, np.uint64), counts) + number * np.uint64(0xD1342543DE82EF95))
        who, node, step = np.arange(len(unit)), self.last_node.kept[unit], 0
        drawn_by, drawn_piece, pieces_of = [], [], np.zeros(len(unit), np.int64)
        while len(who):
            draw = ((mix(key[who] + np.uint64((step + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(40)) * 2.0**-24).astype(np.float32)
            edge = self.first_edge.kept[node]
            left = np.flatnonzero(draw >= self.cumulative.kept[edge])
            while len(left):
                edge[left] += 1
                left = left[draw[left] >= self.cumulative.kept[edge[left]]]
            drawn_by.append(who)
            drawn_piece.append(self.piece.kept[edge])
            pieces_of[who] += 1
            node = self.origin.kept[edge]
            on = node >= 0
            who, node, step = who[on], node[on], step + 1
        place = np.cumsum(pieces_of)  # the first draw is a unit's last piece
        out = np.empty(place[-1], np.int64)
        for k, (by, piece) in enumerate(zip(drawn_by, drawn_piece)):
            out[place[by] - 1 - k] = piece
        owner = np.repeat(np.repeat(np.arange(len(texts)), counts), pieces_of)
        odd = np.flatnonzero(out < 0)
        if len(odd):
            spelled = [chr(-1 - p).encode("utf-8", "surrogatepass") for p in out[odd].tolist()]
            widths = np.ones(len(out), np.int64)
            widths[odd] = [len(s) for s in spelled]
            wide = np.repeat(out, widths)
            wide[np.repeat(out < 0, widths)] = np.frombuffer(b"".join(spelled), np.uint8).astype(np.int64) + self.vocabulary.first_byte
            owner, out = np.repeat(owner, widths), wide
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        out = out.astype(np.int32)
        return [out[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def decode_ids(vocabulary: Vocabulary, ids) -> bytes:
    """The text of a segmentation, as UTF-8: piece texts joined, without the dummy space."""
    return b"".join(map(vocabulary.bytes_of.__getitem__, ids))[1:]


def _shared_model(df: DataFrame, model_path: str):
    with open(model_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # bounded by the vocabulary file


def _lattices(proto: bytes) -> Lattices:
    return kept_in_worker(("lattices", hash(proto)), lambda: Lattices(Vocabulary(proto)))


def sample_encode(df: DataFrame, model_path: str, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: one sampled segmentation of every whole text, the same for the same seed and id.

    Null and empty texts have no ids; null ids share one seed; repeated rows get equal segmentations; an empty table
    gives no rows; other columns are ignored. One map over the scan, no shuffle.
    """
    shared = _shared_model(df, model_path)

    def run(batches):
        lattices = _lattices(shared.value)
        for batch in small_batches(batches, byte_budget=2 << 20):
            keys = [row_seed(k, seed) for k in batch.column(0).to_pylist()]
            yield record_batch(SCHEMA, [batch.column(0), lattices.sample(keys, batch.column(1).to_pylist())])

    return doc_text(df, id_col, text_col).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of segmentations; null ids decode to an empty text."""
    shared = _shared_model(df, model_path)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        vocabulary = _lattices(shared.value).vocabulary
        for batch in small_batches(batches):
            yield record_batch(schema, [batch.column(0), [decode_ids(vocabulary, ids or []).decode() for ids in batch.column(1).to_pylist()]])

    return df.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{ids_col}` as ids").mapInArrow(run, "doc_id bigint, text string")


def sample_digest(df: DataFrame, model_path: str, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``sample_encode`` and decoding in one pass, as ``doc_id, n_pieces, ids_crc32`` (of little-endian 32-bit ids)``,
    decoded_sha256, lossless`` (the decoded bytes equal the text's)."""
    shared = _shared_model(df, model_path)

    def run(batches):
        lattices = _lattices(shared.value)
        for batch in small_batches(batches, byte_budget=2 << 20):
            keys, texts = [row_seed(k, seed) for k in batch.column(0).to_pylist()], batch.column(1).to_pylist()
            ids = lattices.sample(keys, texts)
            decoded = [decode_ids(lattices.vocabulary, x.tolist()) for x in ids]
            columns = [[len(x) for x in ids], [zlib.crc32(x.astype("<i4").tobytes()) for x in ids], [hashlib.sha256(d).hexdigest() for d in decoded], [d == t.encode() for d, t in zip(decoded, texts)]]
            yield record_batch(DIGEST, [batch.column(0), *columns])

    return doc_text(df, id_col, text_col).mapInArrow(run, "doc_id bigint, n_pieces bigint, ids_crc32 bigint, decoded_sha256 string, lossless boolean")
