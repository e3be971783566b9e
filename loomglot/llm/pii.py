"""Personal data: base patterns plus candidates selected by gradient-boosted trees, in DataFrame operations only.

High-recall generators propose spans that may overlap. Each proposal gets format features (lengths, character classes, checksum)
and context features (words shortly before it); boosted trees of its kind, compiled into column expressions, score it, and
proposals at or above the threshold of their kind are added to the base spans. Trees are trained here, on the driver, from
generated examples whose features the same column expressions compute; thresholds are calibrated on forms that the trees have not seen.

Offsets are code points, end exclusive. They come from the pieces between matches: ``split`` and ``regexp_extract_all`` by
the same pattern alternate, and the running length of both gives every start. Running sums and sweeps go by blocks (``scan``), so that
time grows with the number of matches and not with its square. Patterns are possessive and anchored to the start of a run
(or the end of the match before), which leaves the matches as they are and keeps them linear on long runs.
"""

from __future__ import annotations

import functools
import json
import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import trees
from .common import doc_text, documents

KINDS = ("email", "ip", "card", "phone")
LOCAL, LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[{LABEL}]++(?:\.[{LABEL}]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of the trained part: kind -> pattern. Of selected proposals that start together the first listed stays.
GENERATORS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++ ?(?:@|\(at\)|\[at\]) ?[{LABEL}]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[{LABEL}]++)*+",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20._/-]{0,2}+[0-9]){12,18}+(?![0-9])",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){2,7}+[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])|(?<![0-9.])[0-9]{1,3}(?:\x20?[\[(]?(?:\.|dot)[\])]?\x20?[0-9]{1,3}){3}(?![0-9.])",
    "phone": r"(?:\G|(?<![0-9]))[0-9(](?:[\x20().-]{0,2}[0-9]){6,}+",
    "secret": r"(?:\G|(?<![A-Za-z0-9+/_]))[A-Za-z0-9+/_]{16,}+",
}
CONTEXT = {
    "c_secret": r"(?i)(?:token|secret|password|api.?key|bearer|credential)\W{0,6}$",
    "c_contact": r"(?i)(?:tel|phone|call|mobile|fax|contact|mail)\W{0,6}$",
    "c_number": r"(?i)(?:version|isbn|page|order|invoice|licen[cs]e|chapter|year|time|mac)\W{0,6}$",
    "c_card": r"(?i)(?:card|visa|credit|debit|paid with|payment)\W{0,6}$",
    "c_net": r"(?i)(?:\bip|host|address|server|ping|login from)\W{0,6}$",
}
BEFORE = 24
ROUNDS, DEPTH, RATE, PRECISION = 15, 2, 0.4, 0.95
MAY_HOLD = r"[0-9@]|\((?:at)\)|\[at\]|[A-Za-z0-9+/_]{16}|:[A-Fa-f]{0,4}:"
BLOCK = 64
SPAN = "struct<s:int,rank:int,e:int,kind:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blocks(items: Column) -> Column:
    """An array as an array of runs of ``BLOCK`` elements."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda k: F.slice(items, k * BLOCK + 1, BLOCK))


def scan(items: Column, state: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What ``step`` gives out, in order: from the state so far and an element it makes the next state and a value of type ``kind`` or null.

    Appending copies an array, so values are gathered by blocks: n elements cost n * BLOCK / 2 + (n / BLOCK) ** 2 / 2 copied references.
    """
    empty = lambda t: F.expr(f"cast(array() as array<{t}>)")
    acc_of = lambda state, out: F.struct(state.alias("state"), out.alias("out"))

    def one(acc, x):
        after, given = step(acc["state"], x)
        return acc_of(after, F.concat(acc["out"], F.array_compact(F.array(given))))

    def block(acc, part):
        return F.aggregate(part, acc_of(acc["state"], empty(kind)), one, lambda r: acc_of(r["state"], F.concat(acc["out"], F.array(r["out"]))))

    def whole(a):
        few = F.aggregate(a, acc_of(state, empty(kind)), one, lambda r: r["out"])
        return F.when(F.size(a) <= BLOCK, few).otherwise(F.aggregate(blocks(a), acc_of(state, empty(f"array<{kind}>")), block, lambda r: F.flatten(r["out"])))

    return let(items, whole)


def spans_of(text: Column, pattern: str, valid: Callable[[Column], Column]) -> Column:
    """``array<struct<s, e, hit, gap>>`` of the leftmost non-overlapping matches that are ``valid``; ``gap`` ends the text between the match
    before and this one."""
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def step(at, x):
        s = at + F.char_length(x["gap"])
        e = s + F.char_length(F.coalesce(x["hit"], F.lit("")))
        span = F.struct(s.alias("s"), e.alias("e"), x["hit"].alias("hit"), F.right(x["gap"], F.lit(BEFORE)).alias("gap"))
        return e, F.when(x["hit"].isNotNull() & valid(x["hit"]), span)

    return scan(both, F.lit(0), "struct<s:int,e:int,hit:string,gap:string>", step)


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The checksum of a string of digits: true where every second digit from the right, doubled, sums up to a multiple of ten."""
    backwards = F.split(F.reverse(digits), "")

    def term(d, i):
        n = d.cast("int")
        return F.when(i % 2 == 1, n * 2 - F.when(n > 4, F.lit(9)).otherwise(F.lit(0))).otherwise(n)

    return F.aggregate(F.transform(F.filter(backwards, lambda d: d != ""), term), F.lit(0), lambda a, t: a + t) % 10 == 0


def base_valid(kind: str, hit: Column) -> Column:
    n = F.length(digits_of(hit))
    if kind == "ip":
        octet = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return hit.rlike(rf"^{octet}(?:\.{octet}){{3}}$")
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits_of(hit))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All base spans as ``array<struct<s, rank, e, kind>>`` by start, then kind as listed."""

    def valid(rank, kind):
        return F.transform(spans_of(text, BASE[kind], lambda hit: base_valid(kind, hit)), lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("rank"), x["e"].alias("e"), F.lit(kind).alias("kind")))

    return F.array_sort(F.concat(*(valid(rank, kind) for rank, kind in enumerate(KINDS))))


FEATURES = ("n", "digits", "upper", "lower", "separators", "groups", "at", "dots", "luhn", "mixed", "colons", "long", "short", *CONTEXT)


def candidates(text: Column) -> Column:
    """Proposals with their features: ``array<struct<s, rank, e, kind, f array<double>>>``; they may overlap. Context is what stands between a
    proposal and the one of its generator before it, at most ``BEFORE`` characters."""

    def proposed(rank, kind):
        hits = spans_of(text, GENERATORS[kind], lambda hit: F.lit(True))
        return F.transform(hits, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("rank"), x["e"].alias("e"), F.lit(kind).alias("kind"), x["hit"].alias("hit"), x["gap"].alias("gap")))

    def featured(x):
        hit = x["hit"]
        count = lambda pattern: F.regexp_count(hit, F.lit(pattern)).cast("double")
        flag = lambda condition: condition.cast("double")
        n = F.length(digits_of(hit))
        values = {
            "n": F.char_length(hit).cast("double"),
            "digits": n.cast("double"),
            "upper": count("[A-Z]"),
            "lower": count("[a-z]"),
            "separators": count("[^A-Za-z0-9]"),
            "groups": count("[0-9]+"),
            "at": flag(hit.rlike(r"@|\(at\)|\[at\]")),
            "dots": flag(hit.rlike(r"[.]|\(dot\)|\[dot\]")),
            "luhn": flag(F.when(n.between(13, 19), luhn(digits_of(hit))).otherwise(F.lit(False))),
            "mixed": count("[0-9][A-Za-z]|[A-Za-z][0-9]"),
            "colons": count(":") + flag(hit.contains("::")),
            "long": count("[0-9A-Fa-f]{3,}"),
            "short": count("(?<![0-9])(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?![0-9])"),
        } | {name: flag(x["gap"].rlike(pattern)) for name, pattern in CONTEXT.items()}
        return F.struct(x["s"].alias("s"), x["rank"].alias("rank"), x["e"].alias("e"), x["kind"].alias("kind"), F.array(*(values[f] for f in FEATURES)).alias("f"))

    return F.transform(F.concat(*(proposed(len(KINDS) + k, kind) for k, kind in enumerate(GENERATORS))), featured)


def with_check_digit(rnd: random.Random, n: int, right: bool = True) -> str:
    """``n`` digits that pass the checksum, or just don't."""
    body = [rnd.choice("3456")] + [rnd.choice("0123456789") for _ in range(n - 2)]
    total = sum(v if k % 2 else (2 * v - 9 if v > 4 else 2 * v) for k, v in enumerate(map(int, reversed(body))))
    return "".join(body) + str((-total + (0 if right else rnd.randint(1, 9))) % 10)


def forms() -> list[tuple[str, bool, bool, Callable[[random.Random], tuple[str, str]]]]:
    """``kind, personal, for calibration, maker of (context before, span)``: the forms of examples. Trees are grown on the first lot and
    thresholds chosen on the second, so that these are for forms not seen before."""
    hexes, letters, digits = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    pick = lambda r, alphabet, least, most=None: "".join(r.choice(alphabet) for _ in range(r.randint(least, most or least)))
    word = lambda r: pick(r, letters, 3, 9)
    cut = lambda text, sep, k=4: sep.join(text[i : i + k] for i in range(0, len(text), k))
    number = lambda r: [pick(r, digits, 3), pick(r, digits, 3), pick(r, digits, 4)]
    quad = lambda r: [str(r.randint(0, 255)) for _ in range(4)]
    hextets = lambda r, n: [pick(r, hexes, 3, 4) for _ in range(n)]
    return [
        ("email", True, False, lambda r: ("", f"{word(r)}(at){word(r)}(dot)org")),
        ("email", True, False, lambda r: ("mail ", f"{word(r)}.{word(r)} [at] {word(r)} [dot] net")),
        ("email", True, False, lambda r: ("", f"{word(r)}{pick(r, digits, 1, 3)} (at) {word(r)}.com")),
        ("email", False, False, lambda r: ("", f"{word(r)} @ {word(r)}")),
        ("email", False, False, lambda r: ("", f"@{word(r)}")),
        ("email", True, True, lambda r: ("contact ", f"{word(r)}[at]{word(r)}.co.uk")),
        ("email", True, True, lambda r: ("", f"{word(r)}_{word(r)} (at) {word(r)} (dot) edu")),
        ("email", False, True, lambda r: ("", f"{word(r)}@{word(r)}")),
        ("phone", True, False, lambda r: (r.choice(["call ", "phone "]), "-".join(number(r)))),
        ("phone", True, False, lambda r: (r.choice(["tel: ", "mobile: "]), ".".join(number(r)))),
        ("phone", True, False, lambda r: (r.choice(["", "fax "]), "({}) {}-{}".format(*number(r)))),
        ("phone", True, False, lambda r: ("", "-".join(number(r)))),
        ("phone", True, False, lambda r: (r.choice(["call ", "phone: ", "tel "]), f"0{pick(r, digits, 3, 4)}{r.choice('- /')}{pick(r, digits, 6, 7)}".replace("/", " "))),
        ("phone", False, False, lambda r: (r.choice(["order ", "invoice ", "", "isbn "]), pick(r, digits, 7, 16))),
        ("phone", False, False, lambda r: ("in ", f"{r.randint(1800, 2030)}-{r.randint(1800, 2030)}")),
        ("phone", False, False, lambda r: ("", " ".join(str(r.randint(1, 99)) for _ in range(r.randint(5, 9))))),
        ("phone", False, False, lambda r: ("", cut(with_check_digit(r, 16, r.random() < 0.5), r.choice([".", "  ", "-"])))),
        ("phone", True, True, lambda r: ("call ", "0{} {} {}".format(*number(r)))),
        ("phone", True, True, lambda r: ("fax: ", " ".join(number(r)))),
        ("phone", False, True, lambda r: ("", f"{r.randint(1800, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}")),
        ("phone", False, True, lambda r: ("", pick(r, digits, 9, 14))),
        ("secret", True, False, lambda r: ('token = "', pick(r, hexes, 32, 40))),
        ("secret", True, False, lambda r: ("password: ", pick(r, letters + digits + letters.upper(), 20, 40))),
        ("secret", True, False, lambda r: ("api_key=", pick(r, hexes.upper(), 24, 64))),
        ("secret", False, False, lambda r: ("", pick(r, letters, 16, 40))),
        ("secret", False, False, lambda r: ("", pick(r, letters, 16, 24).capitalize())),
        ("secret", False, False, lambda r: (r.choice(["order ", ""]), pick(r, digits, 16, 24))),
        ("secret", False, False, lambda r: ("", f"{pick(r, letters, 9)}_{pick(r, letters, 12)}")),
        ("secret", True, True, lambda r: ("Bearer ", pick(r, letters + digits, 24, 40))),
        ("secret", True, True, lambda r: ("secret '", pick(r, hexes, 32, 40))),
        ("secret", False, True, lambda r: ("", f"{pick(r, letters, 5, 9)}/{pick(r, letters, 9)}/{pick(r, letters, 5)}")),
        ("secret", False, True, lambda r: ("", pick(r, letters.upper(), 16, 22))),
        ("card", True, False, lambda r: ("", cut(with_check_digit(r, 16), "."))),
        ("card", True, False, lambda r: ("card ", cut(with_check_digit(r, 16), "  "))),
        ("card", True, False, lambda r: (r.choice(["visa ", "credit card: "]), with_check_digit(r, 13))),
        ("card", False, False, lambda r: ("", cut(with_check_digit(r, 16, False), r.choice([".", "  "])))),
        ("card", False, False, lambda r: (r.choice(["order ", "isbn ", "page "]), with_check_digit(r, 13, r.random() < 0.1))),
        ("card", False, False, lambda r: ("", ".".join(str(r.randint(1, 99)) for _ in range(9)))),
        ("card", True, True, lambda r: ("", cut(with_check_digit(r, 16), "/"))),
        ("card", True, True, lambda r: ("payment: ", cut(with_check_digit(r, 16), "_"))),
        ("card", False, True, lambda r: ("", cut(with_check_digit(r, 16, False), r.choice("/_")))),
        ("ip", True, False, lambda r: (r.choice(["", "host "]), ":".join(hextets(r, 8)))),
        ("ip", True, False, lambda r: ("", "fe80::" + ":".join(hextets(r, r.randint(2, 4))))),
        ("ip", True, False, lambda r: (r.choice(["", "server "]), "[.]".join(quad(r)))),
        ("ip", True, False, lambda r: ("ip ", "(dot)".join(quad(r)))),
        ("ip", False, False, lambda r: ("", f"{r.randint(0, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}")),
        ("ip", False, False, lambda r: (r.choice(["mac ", ""]), ":".join(pick(r, hexes, 2) for _ in range(6)))),
        ("ip", False, False, lambda r: ("", ":".join(str(r.randint(1, 9)) for _ in range(r.randint(3, 5))))),
        ("ip", False, False, lambda r: ("", ". ".join(str(r.randint(300, 999)) for _ in range(4)))),
        ("ip", True, True, lambda r: ("", "2001:db8::" + ":".join(hextets(r, 3)))),
        ("ip", True, True, lambda r: ("login from ", "(.)".join(quad(r)))),
        ("ip", False, True, lambda r: ("time ", f"{r.randint(0, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}:{r.randint(10, 99)}")),
        ("ip", False, True, lambda r: ("", ":".join(pick(r, hexes.upper(), 2) for _ in range(6)))),
    ]


def examples(seed: int = 7, each: int = 25) -> list[dict]:
    """Texts with one span each: ``text, s, e, kind, personal, calibration``."""
    rnd, words, out = random.Random(seed), "the order was sent over this week and then our team made some notes about it".split(), []
    for kind, personal, calibration, make in forms():
        for _ in range(each):
            before, hit = make(rnd)
            lead = " ".join(rnd.choices(words, k=rnd.randint(1, 6))) + " " + before
            text = f"{lead}{hit}{rnd.choice([' ', '. ', '!! ', ', '])}{' '.join(rnd.choices(words, k=3))}"
            out.append({"text": text, "s": len(lead), "e": len(lead) + len(hit), "kind": kind, "personal": personal, "calibration": calibration})
    return out


_MODELS: dict[int, dict[str, tuple]] = {}


def model(spark: SparkSession, seed: int = 7) -> dict[str, tuple]:
    """Of each kind the base log-odds, trees and calibrated threshold; the same for every session and input, and fitted once a process."""
    if seed not in _MODELS:
        _MODELS[seed] = _fit(spark, seed)
    return _MODELS[seed]


def _fit(spark: SparkSession, seed: int) -> dict[str, tuple]:
    schema = "array<struct<text:string,s:int,e:int,kind:string,personal:boolean,calibration:boolean>>"
    frame = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(examples(seed))), schema)).alias("x")).select("x.*")
    frame = frame.select("s", "e", "kind", "personal", "calibration", F.explode(candidates(F.col("text"))).alias("c")).filter("c.kind = kind")
    frame = frame.selectExpr("kind", "cast(personal and c.s < e and c.e > s as int) as y", "calibration", "c.f")
    got = frame.collect()  # bounded: the generated examples
    out = {}
    for kind in GENERATORS:
        mine = [r for r in got if r["kind"] == kind]
        x, y, held = np.array([r["f"] for r in mine]), np.array([r["y"] for r in mine], float), np.array([r["calibration"] for r in mine])
        base, grown = trees.boost(x[~held], y[~held], ROUNDS, DEPTH, RATE)
        score = trees.sigmoid(base + sum(trees.predict_tree(t, x[held]) for t in grown))
        right = [float(t) for t in np.linspace(0.3, 0.95, 14) if (score >= t).any() and y[held][score >= t].mean() >= PRECISION]
        out[kind] = base, tuple(grown), min(right, default=np.inf)  # a kind that never reaches the precision adds nothing
    return out


def span_columns(spark: SparkSession, text: Column) -> tuple[Column, Column]:
    """Base spans, and the selected proposals, as ``array<struct<s, rank, e, kind>>`` by start."""
    fitted = {k: v for k, v in model(spark).items() if np.isfinite(v[2])}

    def selected(c):
        f = [c["f"][i] for i in range(len(FEATURES))]
        out = F.lit(False)
        for kind, (base, grown, threshold) in fitted.items():
            score = functools.reduce(lambda a, b: a + b, (trees.tree_column(t, f) for t in grown), F.lit(base))
            out = F.when(c["kind"] == kind, score >= F.lit(float(np.log(threshold / (1 - threshold))))).otherwise(out)
        return out

    chosen = F.transform(F.filter(candidates(text), selected), lambda c: F.struct(c["s"].alias("s"), c["rank"].alias("rank"), c["e"].alias("e"), c["kind"].alias("kind")))
    return base_spans(text), F.array_sort(chosen)


def add_disjoint(base: Column, chosen: Column) -> Column:
    """``base`` and, from the left, those of ``chosen`` that touch neither a base span nor one taken before: two sweeps over the spans by
    start, one from the right that knows the next base span, one from the left that knows how far spans have reached."""
    is_base = lambda x: x["rank"] < len(KINDS)

    def from_right(following, x):
        return F.when(is_base(x), x["s"]).otherwise(following), F.when(is_base(x) | (following >= x["e"]), x)

    def from_left(reached, x):
        stays = is_base(x) | (x["s"] >= reached)
        return F.when(stays, F.greatest(reached, x["e"])).otherwise(reached), F.when(stays, x)

    free = scan(F.reverse(F.array_sort(F.concat(base, chosen))), F.lit(2**31 - 1), SPAN, from_right)
    return scan(F.reverse(free), F.lit(0), SPAN, from_left)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def with_spans(rows: DataFrame, text: Column) -> DataFrame:
    """``rows`` and the columns ``__text`` (null as empty), ``__base`` and ``__all``: the spans of a text. One map, no shuffle; rows that no
    pattern can match skip the work."""
    spark, own = rows.sparkSession, F.col("__text")
    may = own.rlike(MAY_HOLD)
    base, chosen = span_columns(spark, own)
    empty = F.expr(f"cast(array() as array<{SPAN}>)")
    out = rows.withColumn("__text", F.coalesce(text, F.lit(""))).withColumn("__base", F.when(may, base).otherwise(empty)).withColumn("__chosen", F.when(may, chosen).otherwise(empty))
    return out.withColumn("__all", F.when(F.size("__chosen") > 0, add_disjoint(F.col("__base"), F.col("__chosen"))).otherwise(F.col("__base"))).drop("__chosen")


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    Counts and ``base_sha256`` cover the base spans; ``spans`` holds base spans and those the trees add (kinds also
    ``secret``), each as kind:start:end. Null text counts as empty: no spans, the hash of an empty string.
    Null ids and repeated rows stay as they are; a very long text is one row of work for a task, in
    time that grows with its length and its matches; an empty table gives no rows; other columns are ignored.
    """
    rows = with_spans(doc_text(df, id_col, text_col), F.col("text"))
    count = lambda kind: F.size(F.filter("__base", lambda x: x["kind"] == kind)).cast("bigint")
    return rows.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(joined(F.col("__base")), 256).alias("base_sha256"), joined(F.col("__all")).alias("spans"))


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with every span of ``text_col`` replaced by its kind in brackets; overlapping spans become one, named by the
    first. Rows (repeated ones too), other columns and null texts stay; an empty table gives no rows. A very long text is one row of work for a task, in
    time that grows with its length and its spans.
    """
    rows = with_spans(df, F.col(text_col))
    own = F.col("__text")
    cuts = scan(F.col("__all"), F.lit(0), "struct<a:int,b:int,kind:string>", lambda at, x: (F.greatest(at, x["e"]), F.when(x["s"] >= at, F.struct(at.alias("a"), x["s"].alias("b"), x["kind"].alias("kind")))))

    def rewrite(part):
        """The text of a block of cuts is taken out once, so that a cut costs the length of its block and not of the text."""
        first, last = F.element_at(part, 1)["a"], F.element_at(part, -1)["b"]
        piece = lambda sub: F.transform(part, lambda x: F.concat(F.substring(sub, x["a"] - first + 1, x["b"] - x["a"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))
        return let(F.substring(own, first + 1, last - first), lambda sub: F.array_join(piece(sub), ""))

    reach = F.array_max(F.transform("__all", lambda x: x["e"]))
    clean = F.concat(let(cuts, lambda c: F.array_join(F.transform(blocks(c), rewrite), "")), F.substring(own, reach + 1, F.char_length(own)))
    return rows.withColumn(text_col, F.when(F.size("__all") > 0, clean).otherwise(F.col(text_col))).select(df.columns)


def op9_pii(spark, sf_dir):
    return find_pii(documents(spark, sf_dir))
