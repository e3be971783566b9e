"""Reading and writing catalog files.

Files are parsed whole, by executors, as their formats need; a catalog of many files is read in parallel, one task a group of files. The driver lists names only.
"""

from __future__ import annotations

import functools
import glob
import itertools
import os
import re
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.languages import language_of_path, valid_tag
from ..schema import ENTRIES, RESOURCES, CatalogError
from . import android, apple_strings, json_maps, string_catalog, xliff
from .model import Entry, Resource, decoded
from .tables import parse_table, render_table

#: Fixed value: keys of ``custom`` that tell where a resource comes from begin so.
PROVENANCE = "provenance."
#: Resources of one file are numbered within this step.
PER_FILE = 1 << 20


def _table(separator: str):
    def parse(content: bytes, language: str | None = None) -> list[Resource]:
        out = []
        for name, pairs in parse_table(decoded(content), separator):
            out.append(Resource(name, entries=[Entry(k, "singular", v, status="translated") for k, v in pairs]))
        names = [r.language for r in out]
        for r in out:
            r.custom = {"source_language": min(names), "version": "1.0"}
        return out

    def render(resources: list[Resource]) -> str:
        texts: dict[tuple[str, str], str] = {}
        for r in resources:
            own: dict[str, str] = {}
            for e in r.entries:
                own.setdefault(e.id, (e.text or "") if e.kind == "singular" else "")
            texts |= {(k, r.language): v for k, v in own.items()}
        return render_table(sorted({k for k, _ in texts}), sorted({r.language for r in resources}), texts, separator)

    return parse, render


_CSV, _TSV = _table(","), _table("\t")
PARSERS = {
    "strings": apple_strings.parse,
    "android": android.parse,
    "xcstrings": string_catalog.parse,
    "xliff": xliff.parse,
    "csv": _CSV[0],
    "tsv": _TSV[0],
    "resources": json_maps.parse_resources,
    "json_map": json_maps.parse_map,
    "json_array": json_maps.parse_array,
    "yaml_map": json_maps.parse_yaml,
}
RENDERERS = {
    "strings": apple_strings.render,
    "android": android.render,
    "xcstrings": string_catalog.render,
    "xliff": xliff.render,
    "csv": _CSV[1],
    "tsv": _TSV[1],
    "resources": json_maps.render_resources,
}
EXTENSIONS = {"strings": "strings", "xml": "android", "xcstrings": "xcstrings", "xliff": "xliff", "xlf": "xliff", "csv": "csv", "tsv": "tsv", "resources": "resources", "yaml": "yaml_map", "yml": "yaml_map"}
#: Formats of one language, whose language comes from outside.
SINGLE = ("strings", "android")


def format_of(path: str, content: bytes | None = None) -> str:
    """The format by extension; of a JSON file by what it holds."""
    extension = path.rsplit(".", 1)[-1].lower() if "." in os.path.basename(path) else ""
    if extension in EXTENSIONS:
        return EXTENSIONS[extension]
    if extension == "json" and content is not None:
        start = decoded(content).lstrip()
        if start.startswith("["):
            return "resources" if re.search(r'"metadata"\s*:', start) else "json_array"
        return "json_map"
    raise CatalogError("unknown_format", f"no format is known for {path}")


def named_format(name: str) -> str:
    """A format by name, in any case and without hyphens and underscores."""
    wanted = re.sub("[-_ ]", "", name).lower()
    aliases = {"androidstrings": "android", "jsonlanguagemap": "json_map", "jsonarraylanguagemap": "json_array", "yamllanguagemap": "yaml_map"}
    found = aliases.get(wanted) or next((f for f in PARSERS if f.replace("_", "") == wanted), None)
    if found is None:
        raise CatalogError("unknown_format", f"no such format: {name}")
    return found


def expand(patterns: list[str]) -> list[str]:
    """Paths for patterns, each once, sorted within a pattern, without files that ignore files name; a plain path, and a pattern that matches nothing, stays as it is."""
    out: list[str] = []
    for pattern in patterns:
        if not re.search(r"[*?\[{]", pattern):
            out.append(pattern)
            continue
        found = {p for one in _alternatives(pattern) for p in glob.glob(one, recursive=True, include_hidden=True)}
        out += sorted(p for p in found if not ignored(p)) or [pattern]
    return list(dict.fromkeys(out))


@functools.lru_cache(maxsize=4096)
def _ignore_rules(folder: str, stamp: tuple) -> list[tuple[re.Pattern, bool, bool]]:
    """Rules of a folder's ignore files in their order: pattern over paths below the folder, whether it takes back, whether it is for folders alone."""
    rules = []
    for name, _ in stamp:
        with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
            for line in (x.rstrip("\n") for x in f):
                rule = line.rstrip() if not line.endswith("\\ ") else line
                if not rule or rule.startswith("#"):
                    continue
                back, rule = rule.startswith("!"), rule.removeprefix("!")
                folders, rule = rule.endswith("/"), rule.rstrip("/")
                anchored = "/" in rule
                body = re.escape(rule.lstrip("/")).replace(r"\*\*/", "(?:.*/)?").replace(r"/\*\*", "/.*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
                rules.append((re.compile(("" if anchored else "(?:.*/)?") + body), back, folders))
    return rules


def ignored(path: str) -> bool:
    """Whether ``.gitignore`` or ``.ignore`` files in the folders above leave a file out. The nearest folder's last matching rule counts; what lies in an ignored
    folder is ignored."""
    full = os.path.abspath(path)
    parts = full.split(os.sep)
    for depth in range(2, len(parts) + 1):  # each folder on the way, then the file itself
        target, decided = os.sep.join(parts[:depth]), False
        for k in range(1, depth):
            folder = os.sep.join(parts[:k]) or os.sep
            stamp = tuple((n, os.stat(os.path.join(folder, n)).st_mtime_ns) for n in (".gitignore", ".ignore") if os.path.isfile(os.path.join(folder, n)))
            for rule, back, folders in _ignore_rules(folder, stamp) if stamp else ():
                if rule.fullmatch(os.sep.join(parts[k:depth])) and (not folders or depth < len(parts)):
                    decided = not back
        if decided:
            return True
    return False


def _alternatives(pattern: str) -> list[str]:
    """``a{b,c}`` as ``ab`` and ``ac``."""
    m = re.search(r"\{([^{}]*)\}", pattern)
    return [pattern] if not m else [x for part in m[1].split(",") for x in _alternatives(pattern[: m.start()] + part + pattern[m.end() :])]


def parse_file(path: str, content: bytes, format: str | None = None, language: str | None = None, strict: bool = False) -> list[Resource]:
    """Resources of a file. A format of one language takes it from ``language``, then the path, then the file; strict: one of the first two."""
    format = named_format(format) if format else format_of(path, content)
    hint = language or (language_of_path(path) if format in SINGLE else None)
    if format in SINGLE and hint is None and strict:
        raise CatalogError("missing_language", f"{path} names no language")
    found = PARSERS[format](content, hint)
    stem = re.sub(r"\.[^.]*$", "", os.path.basename(path))
    for r in found:
        r.domain = r.domain or stem
        r.custom = {"format": format} | r.custom
        if r.language and not valid_tag(r.language) and format in SINGLE:
            raise CatalogError("invalid_language", f"{r.language} is no language tag")
    return found


#: One row a resource (``entry_ord`` is null) and one an entry.
PARSED = T.StructType([*ENTRIES.fields, T.StructField("source_path", T.StringType())])


def parsed(files: DataFrame, format: str | None = None, language: str | None = None, strict: bool = False, keep: bool = True, provenance: bool = False) -> tuple[DataFrame, DataFrame]:
    """``resources, entries`` of files given as ``path, content`` (binary), in the order of their paths. With ``provenance``, resources say in ``custom`` where
    they come from (path, format and language).

    Each file is parsed once: both outputs are parts of one frame, which is kept in memory and on disk when ``keep`` is set. Paths are ranked by
    Spark; contents take no part in that.
    """
    ranked = files.select("path").distinct().withColumn("rank", F.row_number().over(Window.orderBy("path")) - 1)  # names alone
    files = files.select("path", "content").join(ranked, "path")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content, rank in zip(batch["path"], batch["content"], batch["rank"]):
                out = []
                plain = re.sub(r"^file:/+", "/", path)
                for k, r in enumerate(parse_file(plain, bytes(content), format, language, strict)):
                    ord_ = int(rank) * PER_FILE + k
                    if provenance:
                        r.custom |= {PROVENANCE + "source_path": plain, PROVENANCE + "source_format": r.custom["format"], PROVENANCE + "source_language": r.language}
                    out.append((ord_, None, r.language, r.domain, *[None] * 7, r.custom, path))
                    out += [(ord_, n, r.language, r.domain, e.id, e.kind, e.text, e.plural_id, e.forms, e.comment, e.status, e.custom, None) for n, e in enumerate(r.entries)]
                frame = pd.DataFrame(out, columns=PARSED.names)
                yield frame.astype({"entry_ord": "Int64"})

    both = files.mapInPandas(rows, PARSED)
    if keep:
        both = both.persist(StorageLevel.MEMORY_AND_DISK)
    return both.filter("entry_ord is null").select(*RESOURCES.names), both.filter("entry_ord is not null").select(*ENTRIES.names)


def read_catalog(spark: SparkSession, paths: list[str], format: str | None = None, language: str | None = None, strict: bool = False, provenance: bool = False) -> tuple[DataFrame, DataFrame]:
    """``resources, entries`` of files, in the order of their paths."""
    return parsed(spark.read.format("binaryFile").load(paths), format, language, strict, provenance=provenance)


def formats_match(a: str, b: str, language_of_a: str | None = None, language_of_b: str | None = None) -> bool:
    """Whether two formats can hold the same languages: those of many languages go with any, two of one language need the same."""
    many = ("xcstrings", "xliff", "csv", "tsv")
    return named_format(a) in many or named_format(b) in many or language_of_a == language_of_b


def _entry(row: pd.Series) -> Entry:
    pairs = lambda x: dict(x) if x is not None else None
    return Entry(row["id"], row["kind"], row["text"], pairs(row["forms"]), row["plural_id"], row["comment"], row["status"], pairs(row["custom"]) or {})


def _complete(out: list[Resource]) -> None:
    """A catalog from elsewhere gets the metadata it lacks."""
    for r in out:
        r.custom = {"source_language": next((x.custom["source_language"] for x in out if x.custom.get("source_language")), out[0].language), "version": "1.0"} | r.custom


def rendered(resources: DataFrame, entries: DataFrame, format: str, name: str | None = None) -> DataFrame:
    """``path, content``: the files of a catalog. A format of one language gives a file a language, the others one file ``name``; each is rendered whole
    by one task, as the formats need. ``name`` may hold ``{language}``."""
    format = named_format(format)
    if format not in RENDERERS:
        raise CatalogError("unsupported_format", f"{format} can only be read")
    extension = next(k for k, v in EXTENSIONS.items() if v == format)
    name = name or ("{language}." if format in SINGLE else "catalog.") + extension
    path = F.replace(F.lit(name), F.lit("{language}"), F.col("language"))
    meta = resources.select("resource_ord", F.col("language").alias("__language"), F.col("domain").alias("__domain"), F.col("custom").alias("__meta"))
    rows = meta.join(entries, "resource_ord", "left").withColumn("language", F.col("__language")).withColumn("path", path)

    def render(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.astype(object).where(pdf.notna(), None)
        out = []
        for _, part in pdf.sort_values(["resource_ord", "entry_ord"]).groupby("resource_ord", sort=True):
            head = part.iloc[0]
            out.append(Resource(head["__language"], head["__domain"] or "", dict(head["__meta"] or {}), [_entry(r) for _, r in part.iterrows() if r["id"] is not None]))
        if format == "xcstrings":
            _complete(out)
        return pd.DataFrame([(pdf["path"].iloc[0], RENDERERS[format](out))], columns=["path", "content"])

    return rows.groupBy("path").applyInPandas(render, "path string, content string")


#: Characters of a piece of a file.
PIECE = 1 << 15


def rendered_pieces(resources: DataFrame, entries: DataFrame, name: str = "catalog.xcstrings") -> DataFrame:
    """``path, piece, content``: string catalogs, as ``rendered`` gives them, in pieces by ``piece``. Keys are rendered by many tasks, each of a range of them."""
    path = F.replace(F.lit(name), F.lit("{language}"), F.col("language"))
    meta = resources.select("resource_ord", F.col("language").alias("__language"), F.col("custom").alias("__meta"), path.alias("path"))
    rows = entries.filter("id is not null").join(meta, "resource_ord").select("path", "id", "resource_ord", "entry_ord", "__language", "kind", "text", "plural_id", "forms", "comment", "status", "custom")
    least = rows.groupBy("path").agg(F.min("id").alias("least"))

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("resource_ord")
        own = [Resource(language, custom=dict(m) if m is not None else {}) for language, m in zip(pdf["__language"], pdf["__meta"])]
        _complete(own)
        before, after = string_catalog.file_ends(*string_catalog.heading(own), bool(pdf["least"].notna().iloc[0]))
        return pd.DataFrame([(pdf["path"].iloc[0], -1, before), (pdf["path"].iloc[0], 1 << 62, after)], columns=["path", "piece", "content"])

    def items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held, size, now, item, first = TaskContext.get().partitionId() << 32, [], 0, None, {}, False
        for batch in batches:
            batch = batch.astype(object).where(batch.notna(), None)
            for row in zip(*(batch[c] for c in ("path", "id", "__language", "kind", "text", "plural_id", "forms", "comment", "status", "custom", "least"))):
                if now != row[:2]:
                    if item:
                        held.append(("" if first else ",") + "\n" + string_catalog.rendered_item(now[1], item))
                        size += len(held[-1])
                    if held and (size >= PIECE or now[0] != row[0]):
                        yield pd.DataFrame([(now[0], number, "".join(held))], columns=["path", "piece", "content"])
                        number, held, size = number + 1, [], 0
                    now, item, first = row[:2], {}, row[1] == row[10]
                pairs = lambda x: dict(x) if x is not None else None
                string_catalog.add_entry(item, row[2], Entry(row[1], row[3], row[4], pairs(row[6]), row[5], row[7], row[8], pairs(row[9]) or {}))
        if item:
            held.append(("" if first else ",") + "\n" + string_catalog.rendered_item(now[1], item))
        if held:
            yield pd.DataFrame([(now[0], number, "".join(held))], columns=["path", "piece", "content"])

    kind = "path string, piece bigint, content string"
    own = meta.join(least, "path", "left").groupBy("path").applyInPandas(ends, kind)
    return own.unionByName(rows.join(least, "path").repartitionByRange("path", "id").sortWithinPartitions("path", "id", "resource_ord", "entry_ord").mapInPandas(items, kind))


def parsed_pieces(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``resources, entries`` of string catalogs given as ``path, piece, content``, as ``parsed`` gives them for whole files. A task holds one key of a file at a time;
    the file itself is spooled to the task's temporary folder, as it is read more than once. A file whose keys do not ascend is parsed whole."""
    ranked = pieces.select("path").distinct().withColumn("rank", F.row_number().over(Window.orderBy("path")) - 1)  # names alone

    def rows_of(path: str, rank: int, spool) -> Iterator[tuple]:
        def read():
            spool.seek(0)
            return iter(lambda: spool.read(1 << 20) or None, None)

        plain = re.sub(r"^file:/+", "/", path)
        domain = re.sub(r"\.[^.]*$", "", os.path.basename(plain))
        try:
            source, version, languages = string_catalog.survey(read())
        except string_catalog.Unordered:
            for k, r in enumerate(parse_file(plain, "".join(read()).encode(), "xcstrings")):
                yield (rank * PER_FILE + k, None, r.language, r.domain, *[None] * 7, r.custom, path)
                for n, e in enumerate(r.entries):
                    yield (rank * PER_FILE + k, n, r.language, r.domain, e.id, e.kind, e.text, e.plural_id, e.forms, e.comment, e.status, e.custom, None)
            return
        custom = {"format": "xcstrings", "source_language": source, "version": version}
        ords, counts = {x: rank * PER_FILE + k for k, x in enumerate(languages)}, dict.fromkeys(languages, 0)
        for x in languages:
            yield (ords[x], None, x, domain, *[None] * 7, custom, path)
        for x, e in string_catalog.entries_in_order(read, source):
            yield (ords[x], counts[x], x, domain, e.id, e.kind, e.text, e.plural_id, e.forms, e.comment, e.status, e.custom, None)
            counts[x] += 1

    def frames(path: str, rank: int, spool) -> Iterator[pd.DataFrame]:
        found = rows_of(path, rank, spool)
        while out := list(itertools.islice(found, 5000)):
            yield pd.DataFrame(out, columns=PARSED.names).astype({"entry_ord": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = ((path, int(rank), content) for batch in batches for path, rank, content in zip(batch["path"], batch["rank"], batch["content"]))
        for (path, rank), own in itertools.groupby(texts, key=lambda x: x[:2]):
            with tempfile.TemporaryFile("w+", encoding="utf-8", newline="") as spool:
                spool.writelines(content for _, _, content in own)
                yield from frames(path, rank, spool)

    whole = pieces.join(ranked, "path").repartition("path").sortWithinPartitions("path", "piece").select("path", "rank", "content")
    both = whole.mapInPandas(run, PARSED)
    return both.filter("entry_ord is null").select(*RESOURCES.names), both.filter("entry_ord is not null").select(*ENTRIES.names)


def write_catalog(resources: DataFrame, entries: DataFrame, folder: str, format: str, name: str | None = None) -> list[str]:
    """Write the files of a catalog into a folder and return their paths; files come to the driver one at a time."""
    os.makedirs(folder, exist_ok=True)
    out = []
    for row in rendered(resources, entries, format, name).toLocalIterator():
        path = os.path.join(folder, row["path"])
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8", newline="") as f:
            f.write(row["content"])
        out.append(path)
    return sorted(out)


def convert(spark: SparkSession, paths: list[str], folder: str, format: str, input_format: str | None = None, language: str | None = None, name: str | None = None) -> list[str]:
    """Read files and write them in another format."""
    return write_catalog(*read_catalog(spark, paths, input_format, language), folder, format, name)


def save_snapshot(resources: DataFrame, entries: DataFrame, folder: str) -> None:
    """A catalog as Parquet, entries by language so that a language's filter prunes files."""
    resources.write.mode("overwrite").parquet(f"{folder}/resources")
    entries.write.mode("overwrite").partitionBy("language").parquet(f"{folder}/entries")


def load_snapshot(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    entries = spark.read.parquet(f"{folder}/entries").withColumn("language", F.col("language").cast("string"))
    return spark.read.parquet(f"{folder}/resources"), entries.select(ENTRIES.names)
