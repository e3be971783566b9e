"""The pipeline stage by stage, each against a plain computation over what the stage before kept."""

import collections
import re

import public_tokenizers
from edge_rows import ROWS
from helpers import DATA
from test_duplicates import brute_components
from test_models import base_spans
from tokenizers import Tokenizer

import corpus_pipeline
from loomglot.llm import line_dedup, quality


def rows_of(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_stages(spark, documents):
    docs, labels = documents, {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality", "line_dedup", "near_duplicates", "pii", "packing"]

    good = stage["quality"](spark, docs, DATA).cache()
    scored = {r["doc_id"]: r["predicted"] for r in quality.quality_scores(docs, spark.read.parquet(f"{DATA}/labels.parquet")).collect()}
    assert set(rows_of(good)) == {k for k, p in scored.items() if p == 1}
    kept = [k for k in labels if labels[k] == 1]
    assert sum(k in rows_of(good) for k in kept) >= 0.9 * len(kept) and good.columns == docs.columns

    lines = stage["line_dedup"](spark, good, DATA).cache()
    before, after = rows_of(good), rows_of(lines)
    pages, having = collections.Counter(r["source"] for r in before.values()), collections.Counter()
    for r in before.values():
        having.update((r["source"], x) for x in set(r["text"].split("\n")) if x.strip(" \t\r\x0b\x0c"))
    bad = {k for k, n in having.items() if n >= line_dedup.LEAST_PAGES and n > line_dedup.RATIO * pages[k[0]]}
    assert set(after) == set(before)
    for k, r in after.items():
        assert r["text"] == "\n".join(x for x in before[k]["text"].split("\n") if (r["source"], x) not in bad) and r["n_chars"] == len(r["text"])

    single = stage["near_duplicates"](spark, lines, DATA).cache()
    found = brute_components([(k, r["text"]) for k, r in sorted(after.items())], 5, 80, 100)
    assert set(rows_of(single)) == {k for k, _, c in found if k == c}
    assert all(rows_of(single)[k] == after[k] for k in rows_of(single))

    hidden = stage["pii"](spark, single, DATA).cache()
    assert set(rows_of(hidden)) == set(rows_of(single))
    for k, r in rows_of(hidden).items():
        was = rows_of(single)[k]["text"]
        assert not base_spans(r["text"])
        if not re.search("[0-9@]|[A-Za-z0-9+/_]{16}", was):
            assert r["text"] == was

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = collections.Counter()
    for r in stage["packing"](spark, hidden, DATA).collect():
        pieces[r["doc_id"]] += r["length"]
    assert pieces == {k: len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for k, r in rows_of(hidden).items()}

    whole = collections.Counter()
    for r in corpus_pipeline.run(spark, DATA).collect():
        whole[r["doc_id"]] += r["length"]
    assert whole == pieces


def test_awkward_rows(spark, edge):
    docs = edge
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA).cache()
        if name != "packing":
            assert out.columns == list(corpus_pipeline.COLUMNS)
            docs = out
    assert 0 < out.select("doc_id").distinct().count() <= len(ROWS)
    empty = edge.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0


def test_the_end_has_the_token_ids(spark, edge):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {}
    for r in sorted(dict(corpus_pipeline.STAGES)["packing"](spark, edge.filter("doc_id in (0, 4, 8, 10)"), DATA).collect(), key=lambda r: (r["doc_id"], r["start"])):
        ids[r["doc_id"]] = ids.get(r["doc_id"], []) + r["ids"]
    assert ids == {k: [*library.encode(t, add_special_tokens=False).ids, 1] for k, t in ROWS if k in (0, 4, 8, 10)}
