"""Token counts by the whole-token shortcut.

A byte-level BPE vocabulary holds many strings that encode, on their own, as exactly one token. That is proved
once on the driver by running every vocabulary string through the merge model; the proof set is bounded by the vocabulary,
not by the data. A pre-token that is in the set counts as one token without any merging; only the rest goes through
the merge model, once for each distinct string a worker meets (bounded memo).
"""

from __future__ import annotations

import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import doc_text, record_batch, small_batches

#: Fixed value: the split pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern over ASCII text alone, for the faster ``re``.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"
MEMO_LIMIT = 800_000
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary, by its rule: printable Latin-1 bytes stand
    for themselves and the others take code points from 256 up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def prove_whole_tokens(tokenizer: Tokenizer) -> set[str]:
    """Vocabulary strings (as text) that the merge model encodes alone as one token.

    Strings that are not valid UTF-8 cannot be a pre-token of a text and are left out.
    """
    letters, proved = byte_alphabet(), set()
    for piece in tokenizer.get_vocab(with_added_tokens=False):
        try:
            text = bytes(letters[c] for c in piece).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if len(tokenizer.model.tokenize(piece)) == 1:
            proved.add(text)
    return proved


#: Planes from here on hold no letters, digits or spaces that both sides are sure to know; they always go to the library.
LAST_POINT = 0x33480


def odd_characters(tokenizer: Tokenizer) -> str:
    """A character class (``re`` syntax, without brackets) of the code points that this Python's ``regex`` and the
    tokenizer's own splitter class differently, as their Unicode versions differ. Texts with one of them are counted
    by the library as a whole."""
    split, own, odd = regex.compile(PATTERN), tokenizer.pre_tokenizer, set()
    points = [p for p in range(LAST_POINT) if not 0xD800 <= p < 0xE000]
    for at in range(0, len(points), 8192):
        chunk = points[at : at + 8192]
        text = "".join(f"a{c}1{c}!{c}{c} " for c in map(chr, chunk))  # eight characters a probe
        differ = {o for _, o in own.pre_tokenize_str(text)} ^ {m.span() for m in split.finditer(text)}
        odd.update(chunk[k] for span in differ for k in range(span[0] // 8, min(len(chunk), (span[1] + 7) // 8)))
    ranges, start = [], None
    for p in range(LAST_POINT + 1):
        if p in odd and start is None:
            start = p
        elif p not in odd and start is not None:
            ranges.append((start, p - 1))
            start = None
    ranges.append((LAST_POINT, 0x10FFFF))
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


class Counter(dict):
    """Pre-token -> number of tokens. Proved whole tokens are there from the start; others merge when first met."""

    def __init__(self, spec: str, whole: set[str], odd: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_str(spec)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = tuple(added)
        self.odd = re.compile(f"[{odd}]").search
        self.split = regex.compile(PATTERN).findall
        self.split_ascii = re.compile(ASCII_PATTERN).findall
        self.whole = dict.fromkeys(whole, 1)
        self.update(self.whole)
        self.own = len(self.whole)

    def __missing__(self, pre_token: str) -> int:
        # A pre-token is never split further, so encoding it alone equals merging it.
        n = len(self.tokenizer.encode(pre_token, add_special_tokens=False).ids)
        if len(self) - self.own >= MEMO_LIMIT:
            self.clear()
            self.update(self.whole)
        self[pre_token] = n
        return n

    def count(self, text: str) -> int:
        plain = text.isascii()
        if any(map(text.__contains__, self.added)) or not plain and self.odd(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return sum(map(self.__getitem__, (self.split_ascii if plain else self.split)(text)))


_PROOFS: dict[int, tuple[set[str], str]] = {}


def _proof(spec: str) -> tuple[set[str], str]:
    key = hash(spec)
    if key not in _PROOFS:
        tokenizer = Tokenizer.from_str(spec)
        _PROOFS[key] = (prove_whole_tokens(tokenizer), odd_characters(tokenizer))
    return _PROOFS[key]


def token_counts(df: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id, n_bytes, n_tokens, over_limit``, as the tokenizer library counts the whole text.

    No begin, end or padding tokens are added; the strings of added tokens inside a text count as the library's default
    has them (one token). Null text counts as empty: 0 bytes, 0 tokens. A null id stays null, repeated rows give
    repeated rows, an empty table gives no rows, and other columns are ignored. The read is one map over
    the scan: no shuffle.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    shared = df.sparkSession.sparkContext.broadcast((spec, *_proof(spec)))  # bounded by the vocabulary file

    def run(batches):
        counter = Counter(*shared.value)
        for batch in small_batches(batches):
            texts = batch.column(1).to_pylist()
            yield record_batch(SCHEMA, [batch.column(0), [len(t.encode()) for t in texts], [counter.count(t) for t in texts]])

    return doc_text(df, id_col, text_col).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
