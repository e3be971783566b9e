"""Order-preserving packing of documents into token windows by dynamic programming.

Documents keep their id order. The token stream of a run of documents is cut into windows of at most ``size`` tokens; a
cut may fall at a document end (free), a sentence end (small penalty) or, inside very long sentences, at fixed
steps (large penalty). With ``P`` the cut positions, ``f(j) = pen(j) + min(size - P_j + min_i(f(i) + P_i), f(i) where P_j - P_i is a
power of two)`` over the positions at most ``size`` back. The inner minimum slides, so a monotone queue gives every
transition in amortised constant time.

Documents are range-partitioned by id once; each task packs its own run, so no task sees more than one range and memory
is bounded by a block of tokens (or the longest document).
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import Memo, doc_text, kept_in_worker, record_batch, small_batches
from .token_counts import byte_alphabet

END_ID = 1
SENTENCE_PENALTY, HARD_PENALTY, HARD_STEP = 4, 64, 256
#: Windows of these lengths need no padding.
LEAST_POWER = 256
BLOCK_TOKENS = 1 << 20
#: Bytes that a generation of the words a worker remembers may take; they only save time.
MEMO_LIMIT = 56 << 20
#: Printable ASCII and the Latin letters to U+017F, but for the one that two characters are in lower case.
PLAIN_WORD = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+").fullmatch
#: Fixed value: the vocabulary's split pattern, over such words in lower case.
PLAIN_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u017f]+").findall
#: What the bytes of those letters stand as in the vocabulary.
_LETTERS = {b: c for c, b in byte_alphabet().items()}
STAND_INS = {p: "".join(_LETTERS[b] for b in chr(p).encode()) for p in range(0xC0, 0x180)}
#: Marks that end a word after a letter or digit are a part of their own. Without the apostrophe, which takes letters along, and the marks of added tokens.
CLOSES = re.compile(rb"[!-&(-/:;=?@[-`{}~](?:(?<=[A-Za-z0-9].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))[!-&(-/:;=?@[-`{}~]*(?=\s|\Z)")
#: Bytes of added tokens, which letters in lower case could make up, and of combining marks, with which small letters compose otherwise than capitals.
CASED = (b"<|", b"\xcc", b"\xcd")
SCHEMA = pa.schema([(c, pa.list_(pa.int32()) if c == "ids" else pa.int64()) for c in ("doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
SQL_SCHEMA = "doc_id bigint, start bigint, length bigint, ids array<int>, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class WordIds(Memo):
    """Word (bytes between ASCII white space) -> its ids as little-endian unsigned 32-bit.

    The vocabulary's splitter drops white space and never joins across it, and its normaliser never composes across it,
    so the ids of a text are those of its words in order.
    """

    def __init__(self, spec: str):
        super().__init__(MEMO_LIMIT)
        self.tokenizer = Tokenizer.from_str(spec)
        self.merge = self.tokenizer.model.tokenize
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or r"(?!)").search

    def compute(self, word: bytes) -> bytes:
        text = word.decode()
        if self.added(text) or not PLAIN_WORD(text):
            found = self.tokenizer.encode(text, add_special_tokens=False).ids
        elif word.isalpha():
            # ASCII letters are one part, in which each byte stands for itself.
            found = [t.id for t in self.merge(text.lower())]
        else:
            # Lower-casing is the whole normalisation.
            found = [t.id for part in PLAIN_PARTS(text.lower()) for t in self.merge(part if part.isascii() else part.translate(STAND_INS))]
        return array("I", found).tobytes()

    def encode(self, text: str) -> bytes:
        """Words are looked up without the marks at their end and, where the ids are the same, in lower case: fewer different ones."""
        raw = CLOSES.sub(rb" \g<0>", text.encode())
        if not any(map(raw.__contains__, CASED)):
            raw = raw.lower()
        return b"".join(map(self.__getitem__, raw.split()))


def sentence_ends(tokenizer: Tokenizer) -> np.ndarray:
    """Boolean by id: the token closes a sentence."""
    vocab = tokenizer.get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocab.values()) + 1, bool)
    for piece, k in vocab.items():
        out[k] = piece.endswith((".</w>", "!</w>", "?</w>"))
    return out


def cut_candidates(ids: np.ndarray, doc_ends: np.ndarray, closes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending positions after 0 where a window may end, and the penalty of each; the stream's end is the last."""
    sentence = np.flatnonzero(closes[ids]) + 1
    marks = np.union1d(sentence, doc_ends)
    before = np.concatenate(([0], marks[:-1]))
    wide = np.flatnonzero(marks - before > HARD_STEP)
    if len(wide):
        marks = np.union1d(marks, np.concatenate([np.arange(before[k] + HARD_STEP, marks[k], HARD_STEP) for k in wide]))
    penalty = np.full(len(marks), HARD_PENALTY, np.int64)
    penalty[np.searchsorted(marks, sentence)] = SENTENCE_PENALTY
    penalty[np.searchsorted(marks, doc_ends)] = 0
    return marks, penalty


def best_cuts(marks: list[int], penalties: list[int], size: int) -> list[int]:
    """Window ends minimising padding plus penalties; ``marks`` leave no gap over ``size``."""
    total, infinite = marks[-1], 1 << 60
    cost, back = [infinite] * (total + 1), {}
    cost[0] = 0
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (f(i) + P_i, P_i), values ascending from the left
    powers = []
    power = size
    while power >= min(LEAST_POWER, size):
        if power & (power - 1) == 0:
            powers.append(power)
        power //= 2
    powers = [p for p in powers if p < size]
    for at, penalty in zip(marks, penalties):
        while queue[0][1] < at - size:
            queue.popleft()
        value, origin = queue[0]
        best = value + size - at
        for p in powers:
            if at >= p and cost[at - p] < best:
                best, origin = cost[at - p], at - p
        best += penalty
        cost[at], back[at] = best, origin
        key = best + at
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, at))
    cuts, at = [], total
    while at:
        cuts.append(at)
        at = back[at]
    return cuts[::-1]


def pack_block(doc_ids: list, encoded: list[bytes], closes: np.ndarray, size: int, first_sequence: int) -> tuple[pa.RecordBatch, int]:
    """Pieces of one run of documents, and the number of sequences made. Every document has at least its end token."""
    lengths = np.array([len(e) // 4 for e in encoded], np.int64)
    ids = np.frombuffer(b"".join(encoded), "<i4")
    doc_ends = np.cumsum(lengths)
    marks, penalties = cut_candidates(ids, doc_ends, closes)
    cuts = np.array(best_cuts(marks.tolist(), penalties.tolist(), size), np.int64)
    ends = np.union1d(cuts, doc_ends)
    starts = np.concatenate(([0], ends[:-1]))
    doc = np.searchsorted(doc_ends, starts, side="right")
    sequence = np.searchsorted(cuts, starts, side="right")
    window_start = np.concatenate(([0], cuts[:-1]))[sequence]
    doc_start = doc_ends[doc] - lengths[doc]
    owners = pa.array(doc_ids, pa.int64()).take(pa.array(doc))
    pieces = pa.ListArray.from_arrays(np.append(starts, ends[-1]).astype(np.int32), ids)
    view = memoryview(ids).cast("B")
    crcs = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
    batch = record_batch(SCHEMA, [owners, starts - doc_start, ends - starts, pieces, crcs, lengths[doc], first_sequence + sequence, starts - window_start])
    return batch, len(cuts)


def pack_tokens(df: DataFrame, tokenizer_path: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces ``doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset`` in sequences of at most ``size`` tokens.

    ``ids`` are the token ids of the piece, and the checksum is of them as little-endian 32-bit numbers; a sequence is the ids of its pieces by
    ``offset``. A document's ids are those of the tokenizer without special tokens, then id 1; a null or empty text is that id
    alone. Every id lies in exactly one piece, offsets are gapless from 0 in each sequence, documents keep their id order within a
    range and no sequence crosses a range. ``sequence_id`` is unique, not dense. Null ids form one document each and
    stand first; rows repeated under one id are separate documents of that id. An empty table gives no rows; other
    columns are ignored. A text longer than a block is a block of its own.
    """
    if size < HARD_STEP:
        raise ValueError(f"size must be at least {HARD_STEP}")
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    shared = df.sparkSession.sparkContext.broadcast(spec)  # bounded by the vocabulary file

    def run(batches):
        words = kept_in_worker(("words", hash(shared.value)), lambda: WordIds(shared.value))
        closes = sentence_ends(words.tokenizer)
        end = np.array([END_ID], "<u4").tobytes()
        sequence, held, doc_ids, encoded = TaskContext.get().partitionId() << 32, 0, [], []
        for batch in small_batches(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc_ids.append(doc_id)
                encoded.append(words.encode(text) + end)
                held += len(encoded[-1]) // 4
                if held >= BLOCK_TOKENS:
                    out, n = pack_block(doc_ids, encoded, closes, size, sequence)
                    yield out
                    sequence, held, doc_ids, encoded = sequence + n, 0, [], []
        if doc_ids:
            yield pack_block(doc_ids, encoded, closes, size, sequence)[0]

    ordered = doc_text(df, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, SQL_SCHEMA)


def pack(df: DataFrame, tokenizer_path: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``pack_tokens`` without the ids, which are made and given to Spark all the same."""
    return pack_tokens(df, tokenizer_path, size, id_col, text_col).drop("ids")
