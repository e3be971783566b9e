"""Quality, personal data and media columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from helpers import DATA
from edge_rows import ROWS, as_rows

from loomglot.llm import media, pii, quality, queries, trees

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(n if k % 2 == 0 else 2 * n - 9 * (n > 4) for k, n in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fits = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if fits:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_base_spans(spark, edge, texts):
    rnd = random.Random(3)
    letters = list("a.@1-+ ()0é😀") + ["4111111111111111", "1.2.3.4", "x@y.z", "+1 555 010 0200 99"]
    rows = [(1000 + k, "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30)))) for k in range(1500)]
    rows += [(1, "1 " * 20_000), (2, "a" * 60_000 + "@"), (3, "1." * 30_000), (4, "+1" + "0" * 50_000), (5, "4111 1111 1111 1111 " * 1000)]
    for df, source in ((spark.createDataFrame(rows, "doc_id long, text string"), rows), (edge, ROWS), (spark.createDataFrame(texts, "doc_id long, text string"), texts)):
        got = as_rows(pii.find_pii(df).drop("spans"))
        want = []
        for k, t in source:
            spans = base_spans(t or "")
            joined = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
            want.append((k, *(sum(s[3] == kind for s in spans) for kind in BASE), hashlib.sha256(joined.encode()).hexdigest()))
        assert got == sorted(want, key=str)
    assert pii.find_pii(edge.limit(0)).count() == 0


def test_added_spans(spark):
    rows = [
        (0, 'set token = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b" now'),
        (1, "write to jane(at)site(dot)org today"),
        (2, "call 555-010-0200 or mail x@y.org"),
        (3, "version 1.2.30.4 of order 12345678, in 1990-1995, plain words only"),
        (4, "pneumonoultramicroscopicsilicovolcanoconiosis"),
    ]
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == "secret:13:53" and got[1] == "email:9:29" and got[2] == "phone:5:17,email:26:33"
    assert got[3] == "ip:8:16" and got[4] == ""


def test_added_spans_of_unseen_forms(spark):
    """Of each kind nine tenths of the spans in forms that the model was neither fitted nor calibrated on, and few clean ones."""
    rnd = random.Random(11)
    pick = lambda alphabet, n: "".join(rnd.choice(alphabet) for _ in range(n))
    d, h, a = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"

    def passing(n):
        while not luhn(x := "4" + pick(d, n - 1)):
            pass
        return x

    cut = lambda x, sep: sep.join(x[k : k + 4] for k in range(0, len(x), 4))
    forms = {
        "email": [lambda: f"{pick(a, 5)}.{pick(a, 4)}(at){pick(a, 6)}[dot]info", lambda: f"{pick(a, 4)}-{pick(a, 4)} [at] {pick(a, 5)}.{pick(a, 4)}.de"],
        "phone": [lambda: f"phone: ({pick(d, 4)}) {pick(d, 6)}", lambda: f"mobile 0{pick(d, 3)}-{pick(d, 3)} {pick(d, 4)}"],
        "secret": [lambda: f"password = {pick(h + a.upper(), 28)}", lambda: f"api-key: {pick(h, 48)}"],
        "card": [lambda: "paid with " + cut(passing(16), " . "[1:]), lambda: "credit card " + cut(passing(16), "--")],
        "ip": [lambda: "address " + ":".join(pick(h, 4) for _ in range(7)) + ":1f2a", lambda: "host 10[.]{}[.]{}(.)7".format(rnd.randint(0, 255), rnd.randint(0, 255))],
        "": [lambda: pick(a, 20), lambda: f"page {rnd.randint(100, 999)} of {rnd.randint(1000, 9999)}", lambda: f"{rnd.randint(10, 23)}:{rnd.randint(10, 59)}:{rnd.randint(10, 59)}", lambda: "in 1998-2004 and 2011", lambda: f"{pick(a, 6)} @ {pick(a, 4)}"],
    }
    rows = [(kind, f"we saw this week {make()} and went on") for kind, makers in forms.items() for make in makers for _ in range(30)]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    found = {r["doc_id"]: {x.split(":")[0] for x in r["spans"].split(",") if x} for r in pii.find_pii(df).collect()}
    for kind in forms:
        mine = [found[k] for k, (x, _) in enumerate(rows) if x == kind]
        if kind:
            assert np.mean([kind in f for f in mine]) >= 0.9, kind
        else:
            assert np.mean([bool(f) for f in mine]) <= 0.05


def test_many_spans_in_one_text(spark):
    """A megabyte of numbers and fifty thousand mails end soon; sweeps over blocks equal a plain walk."""
    rows = [(0, "12 a " * 200_000), (1, "a@b.cd " * 20_000), (2, "call 555-010-0200, x@y.zz or +1 (555) 010-0200; " * 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find_pii(df).collect()}
    assert got[0]["spans"] == "" and got[1]["n_email"] == 20_000 and got[2]["n_email"] == got[2]["n_phone"] == 700
    assert got[1]["spans"] == ",".join(f"email:{7 * k}:{7 * k + 6}" for k in range(20_000))
    one = pii.find_pii(spark.createDataFrame([(0, rows[2][1][:49])], "doc_id long, text string")).first()["spans"]
    parts = [(kind, int(x), int(y)) for kind, x, y in (p.split(":") for p in one.split(","))]
    assert len(parts) == 3 and got[2]["spans"] == ",".join(f"{kind}:{x + 48 * k}:{y + 48 * k}" for k in range(700) for kind, x, y in parts)
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert clean[0] == rows[0][1] and clean[1] == "[EMAIL] " * 20_000 and clean[2] == "call [PHONE], [EMAIL] or [PHONE]; " * 700


def test_redaction(spark, edge):
    rows = [(0, "mail a@b.c, or +1 (555) 010-0200 😀 end", "mine"), (1, None, "mine"), (2, "clean", "mine")]
    df = spark.createDataFrame(rows, "doc_id long, text string, base_spans string")
    assert as_rows(pii.redact(df)) == [(0, "mail [EMAIL], or [PHONE] 😀 end", "mine"), (1, None, "mine"), (2, "clean", "mine")]
    assert pii.redact(edge).columns == edge.columns and pii.redact(edge).count() == len(ROWS)


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = queries.QUERIES["op6_quality"](spark, folder).collect()
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r["held_out"] == (quality.crc_fold(r["doc_id"]) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) >= 0.95


def test_quality_edges(spark, edge):
    labels = spark.createDataFrame([(0, 1), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    got = quality.quality_scores(edge, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality.quality_scores(edge, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(edge.limit(0), labels).count() == 0


def test_quality_with_few_labels(spark):
    """Eight labelled rows are enough to tell two kinds of text apart."""
    good, bad = "The house stands by a river, and the children play there. They like it.", "BUY NOW!!! $$$ ### CLICK @@@ 999 !!! %%% WIN"
    rows = [(k, (good if k % 2 else bad) + f" {k}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = [k for k in range(40) if quality.crc_fold(k) != 1][:8]
    labels = spark.createDataFrame([(k, k % 2) for k in seen], "doc_id long, quality int")
    assert all(r["predicted"] == r["doc_id"] % 2 for r in quality.quality_scores(docs, labels).collect())


def test_rules():
    rnd = np.random.default_rng(1)
    x = rnd.random((600, len(quality.RATIOS)))
    y = ((x[:, 0] > 0.4) & (x[:, 3] <= 0.7)).astype(float)
    rules = quality.fit_rules(x, y)
    fired = quality.rule_matrix(x, [r for _, r in rules.weighted])
    p = trees.sigmoid(rules.bias + fired @ np.array([w for w, _ in rules.weighted]))
    assert ((p >= 0.5) == (y == 1)).mean() > 0.97
    grown = trees.boost(x, y, 20, 2, 0.3)
    assert ((trees.sigmoid(grown[0] + sum(trees.predict_tree(t, x) for t in grown[1])) >= 0.5) == (y == 1)).mean() > 0.97


def test_media_digest(spark, edge, texts):
    for df, rows in ((edge, ROWS), (spark.createDataFrame(texts, "doc_id long, text string"), texts)):
        found = as_rows(media.media_digest(df))
        want = []
        for k, t in rows:
            raw = (t or "").encode()
            payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
            want.append((k, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
        assert [r[:5] for r in found] == sorted(want, key=str) or sorted((r[:5] for r in found), key=str) == sorted(want, key=str)
        by_payload = {}
        for r in found:
            assert by_payload.setdefault(r[3], r[5:]) == r[5:]
    assert media.media_digest(edge.limit(0)).count() == 0
    row = media.media_columns(edge.filter("doc_id = 2").limit(1)).first()
    assert len(row["rgb"]) == 3 * row["height"] * row["width"] and row["media"][:2] == b"\xff\xd8"


def test_fixed_fields_equal_the_bit_reader(monkeypatch):
    payload = media.padded(np.random.default_rng(1).integers(0, 256, 1700).astype(np.uint8).tobytes())
    file = media.write_payload(payload)
    quick = media.read_progressive(file)
    assert media.payload_of(quick) == payload
    monkeypatch.setattr(media, "_scan", lambda out, tables, restart, chosen, a, b, h, l, d: media._scan_bits(tables, restart, chosen, media._block_order(chosen), a, b, h, l, d))
    slow = media.read_progressive(file)
    assert all((x.coefficients == y.coefficients).all() for x, y in zip(quick.components, slow.components))


def written_by_the_jvm(jvm, pixels):
    """A progressive file of the JVM's own writer, and what its reader makes of it."""
    high, wide, _ = pixels.shape
    image = jvm.java.awt.image.BufferedImage(wide, high, 1)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    for y in range(high):
        for x in range(wide):
            r, g, b = pixels[y, x].tolist()
            image.setRGB(x, y, r << 16 | g << 8 | b)
    parameters = writer.getDefaultWriteParam()
    parameters.setProgressiveMode(1)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), parameters)
    stream.close()
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytes(out.toByteArray())))
    seen = np.array([[back.getRGB(x, y) & 0xFFFFFF for x in range(wide)] for y in range(high)])
    return bytes(out.toByteArray()), np.stack([seen >> 16, seen >> 8 & 255, seen & 255], axis=2)


@pytest.mark.parametrize("colours", ["grey", "gradients", "chroma"])
def test_reads_files_of_another_writer(spark, colours):
    """Files of an independent writer, its decoder's pixels as the measure: it agrees but for its smoother chroma. Colour files have halved chroma."""
    try:
        spark._jvm.java.awt.image.BufferedImage(2, 2, 1)
    except Exception:
        pytest.skip("the JVM has no image classes")
    ys, xs = np.mgrid[0:37, 0:53]
    grey = (2 * xs + 3 * ys) % 256 // 2 + 40
    planes = {"grey": [grey] * 3, "gradients": [60 + 2 * xs, 220 - 3 * ys, 40 + xs + ys], "chroma": [128 + 2 * xs, 128 + 0 * xs, 230 - 2 * xs]}[colours]
    pixels = np.stack(planes, axis=2)
    file, theirs = written_by_the_jvm(spark._jvm, pixels)
    picture = media.read_progressive(file)
    rgb = media.to_rgb(picture).astype(int)
    assert rgb.shape == (37, 53, 3)
    if colours == "grey":
        assert np.abs(rgb - theirs).max() <= 3
    else:
        assert [(c.h, c.v) for c in picture.components] == [(2, 2), (1, 1), (1, 1)]
        assert np.abs(rgb - theirs).mean() <= 2 and np.abs(rgb - theirs).max() <= 12 and np.abs(rgb - pixels).mean() <= 5
    with pytest.raises(ValueError):
        media.read_progressive(b"no picture")
