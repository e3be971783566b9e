"""Token counts, packing and sampled segmentations, against the tokenizer libraries."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import public_tokenizers
from edge_rows import ROWS, as_rows
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from loomglot.llm import packing, queries, sampled_pieces, token_counts

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def test_counts_equal_the_library(edge, documents, texts):
    library = Tokenizer.from_file(BYTE)
    for df, rows in ((edge, ROWS), (documents, texts)):
        want = [(k, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for k, t in rows]
        assert as_rows(token_counts.token_counts(df, BYTE)) == sorted(want, key=str)
    assert token_counts.token_counts(edge.limit(0), BYTE).count() == 0


def test_count_fuzz():
    spec = open(BYTE, encoding="utf-8").read()
    library = Tokenizer.from_str(spec)
    counter = token_counts.Counter(spec, *token_counts._proof(spec))
    rnd = random.Random(3)
    letters = list("ab1.' \t\n\r\x0b\x1c\x85\xa0éΣ　​́😀꟎Ό") + ["<|endoftext|>", "'s", "  "]
    for _ in range(4000):
        t = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 12)))
        assert counter.count(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t)


def test_whole_tokens_are_proved():
    library = Tokenizer.from_file(BYTE)
    proved = token_counts.prove_whole_tokens(library)
    assert len(proved) > 40_000
    stand_in = {v: k for k, v in token_counts.byte_alphabet().items()}
    own = [p.span() == (0, len(t)) for t in sorted(proved)[::40] for p in [re.match(token_counts.ASCII_PATTERN, t)] if t.isascii()]
    assert np.mean(own) > 0.9  # nearly all are pre-tokens themselves
    for t in random.Random(1).sample(sorted(proved), 2000):
        assert len(library.model.tokenize("".join(stand_in[b] for b in t.encode()))) == 1
        if library.pre_tokenizer.pre_tokenize_str(t)[0][1] == (0, len(t)):
            assert len(library.encode(t, add_special_tokens=False).ids) == 1


def test_packing_covers_every_id(edge, documents, texts):
    library = Tokenizer.from_file(WORD)
    for df, rows in ((edge, ROWS), (documents, texts)):
        want = collections.Counter()
        for k, t in rows:
            ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
            want[(k, ids.tobytes())] += 1
        pieces = [r.asDict() for r in packing.pack(df, WORD).collect()]
        sequences = collections.defaultdict(list)
        for p in pieces:
            sequences[p["sequence_id"]].append(p)
        for parts in sequences.values():
            at = 0
            for p in sorted(parts, key=lambda p: p["offset"]):
                assert p["offset"] == at and p["length"] > 0
                at += p["length"]
            assert at <= 2048
        assert sum(p["length"] for p in pieces) == sum(len(b) // 4 * n for (_, b), n in want.items())
        ids_of = collections.defaultdict(list)
        for k, b in want.elements():
            ids_of[k].append(b)
        for p in pieces:
            a, b = 4 * p["start"], 4 * (p["start"] + p["length"])
            assert any(len(x) // 4 == p["doc_tokens"] and zlib.crc32(x[a:b]) == p["ids_crc32"] for x in ids_of[p["doc_id"]])
    assert packing.pack(edge.limit(0), WORD).count() == 0


def test_packing_gives_the_ids(spark, edge):
    library = Tokenizer.from_file(WORD)
    want = collections.Counter((k, *library.encode(t or "", add_special_tokens=False).ids, 1) for k, t in ROWS)
    pieces = packing.pack_tokens(edge, WORD).collect()
    found, sequences, whole = collections.Counter(), collections.defaultdict(list), []
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        sequences[p["sequence_id"]] += p["ids"]
        whole = p["ids"] if p["start"] == 0 else whole + p["ids"]
        assert len(p["ids"]) == p["length"] and len(sequences[p["sequence_id"]]) == p["offset"] + p["length"]
        if len(whole) == p["doc_tokens"]:
            found[(p["doc_id"], *whole)] += 1
    assert found == want and max(map(len, sequences.values())) <= 2048
    assert packing.pack_tokens(edge.limit(0), WORD).count() == 0
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    others = ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")
    assert sorted((str([p[c] for c in others]), crc(p["ids"])) for p in pieces) == sorted((str([p[c] for c in others]), p["ids_crc32"]) for p in packing.pack(edge, WORD).collect())


def test_cuts_are_best():
    rnd = random.Random(5)
    size = 512
    for _ in range(30):
        marks = sorted(rnd.sample(range(1, 1600), 12))
        marks = sorted({*marks, *range(400, marks[-1], 400)})
        penalties = [rnd.choice([0, 4, 64]) for _ in marks]

        def cost(cuts):
            total, before = 0, 0
            for c in cuts:
                n = c - before
                if n > size:
                    return math.inf
                total += (0 if n & (n - 1) == 0 and n >= packing.LEAST_POWER else size - n) + penalties[marks.index(c)]
                before = c
            return total

        inner = marks[:-1]
        best = min(cost([*c, marks[-1]]) for n in range(len(inner) + 1) for c in itertools.combinations(inner, n))
        assert cost(packing.best_cuts(marks, penalties, size)) == best


def test_words_equal_the_library():
    spec = open(WORD, encoding="utf-8").read()
    words, library, rnd = packing.WordIds(spec), Tokenizer.from_str(spec), random.Random(2)
    letters = list("abSsT|<>#1.' \t\n\r\x0b\x0c\x1c\x85\xa0éÀ̀́ΣςİK　�한가ᄀ㍿²½😀") + ["<|endoftext|>", "<|startoftext|>", "'s", "'LL"]
    for _ in range(4000):
        t = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 14)))
        assert np.frombuffer(words.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_segmentations_are_lossless_and_repeatable(spark, edge, documents, texts):
    library = SentencePieceProcessor(model_file=PIECE)
    for df, rows in ((edge, ROWS), (documents, texts)):
        out = sampled_pieces.sample_encode(df, PIECE)
        got = out.collect()
        plain = collections.Counter((r["doc_id"], library.decode(r["ids"])) for r in got if "▁" not in library.decode(r["ids"]))
        want = collections.Counter((k, t or "") for k, t in rows)
        assert sampled_pieces.decode(out, PIECE).count() == len(rows)
        assert collections.Counter((r["doc_id"], r["text"]) for r in sampled_pieces.decode(out, PIECE).collect()) == want
        assert all(want[x] for x in plain)
        assert as_rows(sampled_pieces.sample_encode(df.repartition(7), PIECE)) == as_rows(out)
        digest = sampled_pieces.sample_digest(df, PIECE).collect()
        assert all(r["lossless"] for r in digest)
        assert collections.Counter((r["doc_id"], r["n_pieces"]) for r in digest) == collections.Counter((r["doc_id"], len(r["ids"])) for r in got)
    assert as_rows(sampled_pieces.sample_encode(documents, PIECE, seed=1)) != as_rows(sampled_pieces.sample_encode(documents, PIECE))
    assert sampled_pieces.sample_encode(edge.limit(0), PIECE).count() == 0


def unigram_model(pieces):
    """The protocol buffer of a small unigram model, written by hand: pieces with log-probabilities, and byte pieces."""
    import struct

    def field(number, value):
        if isinstance(value, float):
            return bytes([number << 3 | 5]) + struct.pack("<f", value)
        if isinstance(value, int):
            head = b""
            for k in (number << 3, value):
                while k > 127:
                    head, k = head + bytes([k & 127 | 128]), k >> 7
                head += bytes([k])
            return head
        value = value.encode() if isinstance(value, str) else value
        size, head = len(value), b""
        while size > 127:
            head, size = head + bytes([size & 127 | 128]), size >> 7
        return bytes([number << 3 | 2]) + head + bytes([size]) + value

    rows = [("<unk>", 0.0, 2)] + [(f"<0x{b:02X}>", -12.0, 6) for b in range(256)] + [(p, float(w), 1) for p, w in pieces.items()]
    body = b"".join(field(1, field(1, p) + field(2, w) + field(3, kind)) for p, w, kind in rows)
    return body + field(2, field(3, 1) + field(35, 1)) + field(3, field(1, "identity") + field(5, 0))


UNIGRAM = {"▁": -2.0, "a": -1.5, "b": -3.0, "▁a": -1.0, "ab": -2.5, "▁ab": -4.0, "▁▁": -1.2, "▁▁a": -2.2, "b▁": -2.0, "b▁▁a": -3.0}


@pytest.mark.parametrize("model, text", [("merge", "there"), ("merge", "    a"), ("merge", "is   "), ("unigram", "ab  ab"), ("unigram", "b a"), ("uncrossed", "ab  ab")])
def test_segmentations_follow_the_lattice(model, text):
    """All segmentations that the vocabulary allows are drawn as often as their weights say, also through runs of spaces."""
    kept = UNIGRAM if model == "unigram" else {k: w for k, w in UNIGRAM.items() if not k.startswith("b▁")}
    proto = open(PIECE, "rb").read() if model == "merge" else unigram_model(kept)
    vocabulary, library = sampled_pieces.Vocabulary(proto), SentencePieceProcessor(model_proto=proto)
    assert sampled_pieces.is_unigram(proto) == (model != "merge")
    logp = {library.id_to_piece(int(k)): w for _, _, ids, ws in vocabulary.tables.values() for k, w in zip(ids, ws)}
    if model != "merge":
        assert {p: pytest.approx(w) for p, w in kept.items()} == logp
    marked, n, weight = "▁" + text.replace(" ", "▁"), 60_000, {}
    for r in range(len(marked)):
        for cut in itertools.combinations(range(1, len(marked)), r):
            ends = [0, *cut, len(marked)]
            parts = [marked[a:b] for a, b in zip(ends, ends[1:])]
            if all(p in logp for p in parts):
                weight[tuple(library.piece_to_id(p) for p in parts)] = math.exp(sum(logp[p] for p in parts))
    assert len(weight) >= 3
    total = sum(weight.values())
    lattices = sampled_pieces.Lattices(vocabulary)
    drawn = [x for k in range(0, n, 20_000) for x in lattices.sample([sampled_pieces.row_seed(j, 9) for j in range(k, k + 20_000)], [text] * 20_000)]
    assert all(sampled_pieces.decode_ids(vocabulary, x.tolist()) == text.encode() for x in drawn[:100])
    count = collections.Counter(tuple(x.tolist()) for x in drawn)
    assert set(count) <= set(weight)
    for parts, w in weight.items():
        share = w / total
        assert abs(count[parts] / n - share) <= 5 * math.sqrt(share * (1 - share) / n) + 1e-5


def test_registered(spark):
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and len(queries.QUERIES) == 10


def test_packing_looks_words_up_by_their_stems():
    """Ids are the library's for words in any case and with any ending; variants of a word are one entry of the memo."""
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        words = packing.WordIds(f.read())
    library = Tokenizer.from_file(path)
    pieces = ["Word", "word", "WORD.", "word,", "it's.", "IT'S", "3.", "a1,", "x\u0301.", "J\u030c", "H\u0331.", "\u00c9t\u00e9.", "I\u0307", "\u0130.", "\u03a3\u03a3.", "A\u03a3", "..", ".", "a.,", "a.b.", "a.\u00a0b", "<|endoftext|>", "<|ENDOFTEXT|>.", "<|", "\u2028", "\u212a."]
    rnd = random.Random(3)
    texts = [*pieces, *(rnd.choice([" ", "\n", "\t "]).join(rnd.choice(pieces) + rnd.choice(["", ".", ",", "\x0b"]) for _ in range(rnd.randrange(1, 7))) for _ in range(1500)), ""]
    for text in texts:
        assert np.frombuffer(words.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
    words.clear()
    words.encode("Plain plain. PLAIN, plain")
    assert set(words) == {b"plain", b".", b","}


def test_packing_merges_latin_words_without_the_library(monkeypatch):
    """Every Latin letter to U+017F but one, and any marks at a word's end: the ids are the library's, and only the words that need it go to its whole ``encode``."""
    with open(WORD, encoding="utf-8") as f:
        spec = f.read()
    library, words = Tokenizer.from_str(spec), packing.WordIds(spec)
    rnd, marks = random.Random(4), "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    for c in [chr(p) for p in range(0x21, 0x180) if not 0x7F <= p < 0xA1] + [*"\u0300\u0301\u03a3\u0436\u4f60"]:
        for t in [c, f"a{c}b", f"{c}'s{c}", f"\u00c9{c}.", *(f"{rnd.choice('aZ7\u00fc\u00d7')}{c}{rnd.choice(marks)}{rnd.choice(marks)}{rnd.choice(['', ' ', chr(0x301), '<|endoftext|>'])}" for _ in range(40))]:
            assert np.frombuffer(words.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)

    whole = []

    class Counted:
        def encode(self, text, **kw):
            whole.append(text)
            return library.encode(text, **kw)

    words.clear(), words.old.clear()
    monkeypatch.setattr(words, "tokenizer", Counted())
    words.encode("Stra\u00dfe \u00c9t\u00e9. na\u00efve,*** ni\u00f1o$$$ \u0141\u00f3d\u017a!? \u0130zmir \u0416 a\u0301")
    assert whole == ["\u0130zmir", "\u0416", "a\u0301"]
    words.clear(), words.old.clear()
    words.encode("plain plain*** plain$$$ plain.%%% plain!! caf\u00e9 caf\u00e9, it's")
    assert set(words) == {b"plain", b"***", b"$$$", b".%%%", b"!!", "caf\u00e9".encode(), b",", b"it's"}
