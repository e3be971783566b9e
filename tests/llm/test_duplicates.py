"""Near duplicates, repeated passages, exact copies and boilerplate lines, against brute force."""

import collections
import functools
import hashlib
import random
import re

import numpy as np
import pytest
from helpers import DATA, same_as_sql
from edge_rows import ROWS, as_rows

from loomglot.llm import exact_dedup, jaccard_join, line_dedup, passages, queries, shingles
from loomglot.llm.components import components


def brute_components(rows, words, numerator, denominator):
    sets = []
    for _, t in rows:
        found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(found[k : k + words]) for k in range(len(found) - words + 1)} if len(found) >= words else {tuple(found)} if found else set())
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and denominator * both >= numerator * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted(((k, len(sets[i]), least.get(find(i))) for i, (k, _) in enumerate(rows)), key=str)


def near_copies(seed=4, n=400):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rnd.choice(vocabulary) for _ in range(k)] for k in (3, 8, 12, 30, 60, 150)]
    rows = []
    for i in range(n):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5])):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        rows.append((i, " ".join(words)))
    return rows + [(600, "A B"), (601, "a  b"), (602, "a"), (3, rows[7][1]), (605, "é x"), (606, "É x")]


@pytest.mark.parametrize("small_region", [256, 4])
@pytest.mark.parametrize("words, numerator, denominator", [(3, 90, 100), (5, 80, 100), (1, 1, 2)])
def test_jaccard_components(spark, monkeypatch, small_region, words, numerator, denominator):
    monkeypatch.setattr(jaccard_join, "jaccard_classes", functools.partial(jaccard_join.jaccard_classes, small_region=small_region))
    rows = near_copies(n=400 if small_region > 4 else 150) + ROWS
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert as_rows(jaccard_join.jaccard_components(df, words, numerator, denominator)) == brute_components(rows, words, numerator, denominator)


def test_jaccard_many_sets_of_one_template(spark, monkeypatch):
    """Pages of one template with many links among them: as one region that the sieve lets pass whole, level after level."""
    monkeypatch.setattr(jaccard_join, "SIEVE_PARTS", 0)
    rnd = random.Random(5)
    head = " ".join(f"t{k}" for k in range(120))
    own = [[f"o{i}_{k}" for k in range(40)] for i in range(120)]
    rows = []
    for i in range(800):
        words = list(own[i % 120])
        for _ in range(rnd.choice([0, 1, 2, 30])):
            words[rnd.randrange(40)] = f"n{rnd.randrange(10**6)}"
        rows.append((i, head + " " + " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert as_rows(jaccard_join.jaccard_components(df, 3, 90, 100)) == brute_components(rows, 3, 90, 100)


def test_sketches_never_exceed_the_difference():
    rnd = np.random.default_rng(5)
    pool = np.unique(rnd.integers(0, 1 << shingles.NAME_BITS, 3000).astype(np.uint64))
    sets = [np.zeros(0, np.uint64), *(np.sort(rnd.choice(pool, int(n), replace=False)) for n in rnd.integers(1, 2900, 60))]
    held = shingles.Sketches(shingles.sketches(sets))
    everyone = np.arange(len(sets))
    for k, s in enumerate(sets):
        assert [int(x) for x in held.apart(k, everyone) > [len(np.setxor1d(s, o)) for o in sets]] == [0] * len(sets)
        assert held.apart(k, everyone[k : k + 1]) == 0


def test_long_sets_that_are_not_alike_leave_before_texts_are_read(spark, monkeypatch):
    """Texts of which a half is shared meet by many keys, and their profiles are alike."""
    frames, kept = [], jaccard_join.checkpointed
    monkeypatch.setattr(jaccard_join, "checkpointed", lambda df: frames.append(kept(df)) or frames[-1])
    common = " ".join(f"c{k}" for k in range(1000))
    rows = [(d, common + " " + " ".join(f"w{d}x{k}" for k in range(1000))) for d in range(12)]
    rows += [(12, rows[3][1] + " end"), (13, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert as_rows(jaccard_join.jaccard_components(df, 5, 80, 100)) == brute_components(rows, 5, 80, 100)
    fetched = next(f for f in frames if f.columns == ["set", "body"])
    assert fetched.count() == 2
    met = frames[0].groupBy("kind").count().collect()
    assert sum(r["count"] for r in met if r["kind"] != jaccard_join.DOC) < 200  # many pairs in a row


def test_jaccard_query(spark, texts):
    assert as_rows(queries.QUERIES["op2_jaccard_join"](spark, DATA)) == brute_components(texts, 3, 90, 100)


def test_jaccard_edges(spark, edge):
    assert as_rows(jaccard_join.jaccard_components(edge)) == brute_components(ROWS, 5, 80, 100)
    assert jaccard_join.jaccard_components(edge.limit(0)).count() == 0
    with pytest.raises(ValueError):
        jaccard_join.jaccard_classes(edge, 3, 1, 1)


def test_every_close_pair_shares_a_signature():
    rnd = np.random.default_rng(7)
    for numerator, denominator in ((90, 100), (80, 100), (1, 2)):
        for _ in range(300):
            n = int(rnd.integers(1, 120))
            a = np.unique(rnd.integers(0, 1 << shingles.NAME_BITS, n).astype(np.uint64))
            keep = a[rnd.random(len(a)) > rnd.random() * 0.3]
            b = np.unique(np.concatenate((keep, rnd.integers(0, 1 << shingles.NAME_BITS, int(rnd.integers(0, 1 + n // 6))).astype(np.uint64))))
            both = len(np.intersect1d(a, b))
            if len(b) and denominator * both >= numerator * (len(a) + len(b) - both):
                owner, found = shingles.signatures([a, b], numerator, denominator)
                assert set(found[owner == 0].tolist()) & set(found[owner == 1].tolist())


def test_components(spark):
    rnd = random.Random(1)
    pairs = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)]
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {a: find(a) for a in list(root)}


def brute_passages(rows, length=50):
    first, none = {}, -(1 << 63)
    for k, t in rows:
        b, k = (t or "").encode(), none if k is None else k
        for i in range(len(b) - length + 1):
            first[b[i : i + length]] = min(first.get(b[i : i + length], 1 << 63), k)
    out = []
    for k, t in rows:
        b, own = (t or "").encode(), none if k is None else k
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < own:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((k, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, x in zip(b, gone) if not x)).hexdigest()))
    return sorted(out, key=str)


def test_passages(spark, monkeypatch, edge):
    rnd = random.Random(2)
    base = ["".join(rnd.choice("ab é.") for _ in range(300)) for _ in range(5)]
    rows = [(i, "".join(rnd.choice([b[rnd.randint(0, 200) :][: rnd.randint(0, 120)], "x" * rnd.randint(0, 80), "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 60)))]) for b in base)) for i in range(120)]
    rows += [(None, base[0]), (7, base[1]), (1000, None), (1001, ""), (1002, "y" * 5000), (1003, "y" * 49), (1004, "z" + "y" * 50), (3, rows[3][1])]
    assert as_rows(passages.remove_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == brute_passages(rows)
    monkeypatch.setattr(passages, "SLICE_BYTES", 2000)
    assert as_rows(passages.remove_passages(edge)) == brute_passages(ROWS)
    assert passages.remove_passages(edge.limit(0)).count() == 0


def test_passages_query(spark, texts):
    assert as_rows(queries.QUERIES["op3_passages"](spark, DATA)) == brute_passages(texts)


def test_passages_give_texts_and_spans(spark):
    shared = "é" + "repeated words of one passage, " * 3
    rows = [(1, "ab" + shared + "cd"), (2, shared + "own" + shared), (3, "©" + shared[1:] + "é"), (4, "alone"), (None, None)]
    out = passages.cut_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    got = {r["doc_id"]: (bytes(r["kept"]), [tuple(s) for s in r["spans"]]) for r in out.collect()}
    text = {k: (t or "").encode() for k, t in rows}
    n = len(shared.encode())
    assert got[2] == (b"own", [(0, n), (n + 3, 2 * n + 3)])
    # The letters share their last byte, so the span begins within a character.
    assert got[3] == (b"\xc2" + "é".encode(), [(1, n)])
    assert [got[k] for k in (1, 4, None)] == [(text[k], []) for k in (1, 4, None)]
    for k, (kept, spans) in got.items():
        gone = {i for a, b in spans for i in range(a, b)}
        assert kept == bytes(c for i, c in enumerate(text[k]) if i not in gone)


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for k, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((k, t or ""))
    out = []
    for norm, members in groups.items():
        order = sorted(members, key=lambda m: (-len(m[1]), m[0] is not None, m[0] or 0))
        keep = order[0][0] if len(members) > 1 else members[0][0]
        out += [(k, keep, len(members), k == keep, hashlib.sha256(norm.encode()).hexdigest()) for k, _ in members]
    return sorted(out, key=str)


def test_exact_dedup(spark, duck, edge, monkeypatch):
    same_as_sql(duck, queries.QUERIES["op5_exact_dedup"](spark, DATA), exact_dedup.ORACLE)
    assert as_rows(exact_dedup.exact_dedup(edge)) == brute_exact(ROWS)
    assert exact_dedup.exact_dedup(edge.limit(0)).count() == 0
    from pyspark.sql import functions as F

    # Chunks that share their hash are told apart by their text.
    poor = lambda chunk: F.struct((F.length(chunk) * 0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))
    monkeypatch.setattr(exact_dedup, "chunk_hash", poor)
    assert as_rows(exact_dedup.exact_dedup(edge)) == brute_exact(ROWS)


def test_chunks_join_to_the_text(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(1)
    rows = [("".join(rnd.choice("ab.é你😀") for _ in range(rnd.choice([0, 1, 511, 513, 9000]))),) for _ in range(30)] + [("x" * 100_000,), ("\n\x85 " * 2000,)]
    df = spark.createDataFrame(rows, "t string").select("t", exact_dedup.chunks_of(F.col("t")).alias("c"))
    assert df.filter(F.array_join("c", "") != F.col("t")).count() == 0


def test_line_dedup(spark, duck, documents, edge):
    same_as_sql(duck, queries.QUERIES["op8_line_dedup"](spark, DATA), line_dedup.ORACLE)
    for df in (documents, edge):
        small = line_dedup.drop_boilerplate(df, 0.05, 2)
        assert as_rows(small) == as_rows(line_dedup.drop_boilerplate(df, 0.05, 2, broadcast_lines=0))
    assert line_dedup.drop_boilerplate(edge.limit(0)).count() == 0


def test_line_dedup_brute(spark):
    rows = [(k, "\n".join([f"only {k}", "nav", "", "nav"] + (["half"] if k % 2 else []) + [f"x{k}"]), "h") for k in range(10)] + [(10, "nav\nnav", None), (11, None, "h"), (12, "nav", "lone")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["text"], r["lines_before"], r["lines_dropped"]) for r in line_dedup.drop_boilerplate(df, 0.5, 5).collect()}
    for k, text, host in rows:
        if k < 10:  # nav: 10 of 11 pages; half: 5 of 11, under the ratio
            lines = [x for x in text.split("\n") if x != "nav"]
            assert got[k] == ("\n".join(lines), len(text.split("\n")), 2)
    assert got[10] == ("nav\nnav", 2, 0) and got[11] == (None, 0, 0) and got[12] == ("nav", 1, 0)


def test_line_dedup_on_small_hosts(spark):
    """The ratio alone decides about every repeated line; a floor is a choice of the caller."""
    on = lambda k: [f"on {n}" for n in (2, 4, 5) if k < n]
    rows = [(k, "\n".join([f"only {k}", *on(k)]), "ten") for k in range(10)] + [(100 + k, f"only {k}\nall", "four") for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    lines = lambda out: {r["doc_id"]: r["text"].split("\n") for r in out.collect()}
    floor, ratio, tie = lines(line_dedup.drop_boilerplate(df, least_pages=5)), lines(line_dedup.drop_boilerplate(df)), lines(line_dedup.drop_boilerplate(df, 0.5))
    for k in range(10):
        assert floor[k] == [f"only {k}", *(x for x in on(k) if x != "on 5")]
        assert ratio[k] == [f"only {k}"]
        assert tie[k] == [f"only {k}", *on(k)]  # exactly at the limit stays
    for k in range(4):
        assert floor[100 + k] == [f"only {k}", "all"] and ratio[100 + k] == [f"only {k}"]


def test_line_dedup_with_colliding_hashes(spark, monkeypatch):
    """Lines are told apart by their texts where all hashes are alike."""
    from pyspark.sql import functions as F

    rows = [(k, f"own {k}\nnav\n{'rare' if k < 3 else 'x'}", "h") for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = as_rows(line_dedup.drop_boilerplate(df, 0.4))
    monkeypatch.setattr(F, "xxhash64", lambda *cols: F.length(cols[0]).cast("bigint") * 0)
    assert as_rows(line_dedup.drop_boilerplate(df, 0.4)) == want
    assert all(r[1].startswith("own") and "nav" not in r[1] for r in want)
