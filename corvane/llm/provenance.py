"""Problem 1: files that nobody of the project wrote by hand.

Attribute files (``.gitattributes``) that mark paths as generated or vendored are parsed and
resolved as git does: the file in the deepest directory wins, within a file the last line. What
no attribute declares is decided by equivalent patterns of paths, directory names and name
endings, mined from the whole collection: those whose files are mostly declared by the attribute
files of other projects or show evidence in their content (a generator's header, minified or
packed text, data saved as code, machine idioms, text equal to third-party code). Well-known
patterns need no support, but one for generated files that the collection contradicts is dropped.
Only files that no pattern decides are decided by the evidence of their own content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import stage

# Directory names and name endings that say vendored or generated wherever they stand.
VENDORED_DIRS = """vendor _vendor third_party third-party thirdparty 3rdparty extern external externals site-packages
    dist-packages node_modules bower_components""".split()
VENDORED_PATHS = ["libs/ext", "lib/ext", "deps/src"]
GENERATED_DIRS = ["_generated", "__generated__", ".generated"]
GENERATED_ENDINGS = ["_pb2", "_pb2_grpc", ".min", "-min", ".bundle", "-bundle", ".packed", "_packed", ".generated", "_generated"]

# What generators write on top of a file, in several languages.
_GENERATED = re.compile(
    r"(?im)code generated by|@generated\b|\bdo not edit\b|auto[- ]?generated (?:by|file|from|code)|generated by the protocol"
    r"|\b(?:file|module|code|source)\b.{0,40}\b(?:is|was|been) (?:auto(?:matically)?[- ]?)?generated|automatically generated"
    r"|^\W*generated (?:by|from|with) \S+|otomatik\s+(?:olarak\s+)?(?:üretil|oluşturul|türetil)|elle değiştirmeyin|elle düzenlemeyin"
    r"|maschinell .{0,80}erzeugt|automatisch .{0,80}(?:erzeugt|generiert)|nicht von hand (?:ändern|bearbeiten)"
    r"|généré automatiquement|ne pas modifier à la main|generado automáticamente|no editar a mano|自动生成|自動生成"
    r"|^\W*source: \S+\.(?:proto|thrift|xsd|xsl|wsdl|graphql|idl|avsc|fbs|capnp|y|g4|ui)\b"
)
_TAKEN = re.compile(
    r"(?im)\b(?:taken|copied|vendored|imported|borrowed|extracted) (?:verbatim |unchanged )?from\b.{0,60}\b(?:\d+\.\d+|licen[cs]e|upstream|https?:)|\bvendored (?:copy|version)\b"
)
_PACKED = re.compile(r"\b(?:exec|eval)\s*\(.{0,80}(?:decompress|b64decode|b85decode|a85decode|unhexlify|marshal\.loads)", re.S)
_HEX = re.compile(r"0x[0-9A-Fa-f]{6,}")
_ATOM = r"(?:[rbuRBU]?\"[^\"]*\"|[rbuRBU]?'[^']*'|[-+]?\d[\w.]*|None|True|False|null|true|false)"
_DATA_LINE = re.compile(rf"[\s\[\]{{}}(),:]*(?:{_ATOM}[\s\[\]{{}}(),:]+)*{_ATOM}?[\s\[\]{{}}(),:]*\Z")
_ASSIGNED = re.compile(r"^\s*\w+\s*(?::[^=]{1,80})?=\s*(?=[\[({\"'])")
_COMMENT = re.compile(r"\s*(?:#|//|/\*|\*|;|--|<!--)")

CHUNK = (
    "ord bigint, seen bigint, project_id string, path string, code boolean, chars bigint, long_chars bigint, data_chars bigint, digits bigint, hexes bigint, "
    "generated boolean, taken boolean, packed boolean, lines array<bigint>"
)
_LONG_LINE, _SOLID_LINE = 300, 30
_NO_PROJECT = "\x00"  #: stands for a null project_id


def leading_text(text: str) -> str:
    """The comment lines and the docstring above the first line of code."""
    out: list[str] = []
    quote = ""
    for line in text.lstrip("﻿").split("\n"):
        bare = line.strip()
        if quote:
            out.append(bare)
            if quote in bare:
                quote = ""
            continue
        m = re.match(r"[rRuU]?(\"\"\"|''')", bare)
        if m and not out or m and all(_COMMENT.match(x) or not x for x in out):
            quote = m.group(1)
            out.append(bare)
            if quote in bare[m.end() :]:
                quote = ""
        elif not bare or _COMMENT.match(line):
            out.append(bare)
        else:
            break
    return "\n".join(out)


def is_dense(line: str) -> bool:
    """Whether a long line holds many statements, or nearly no white space; a long pattern or sentence doesn't."""
    return line.count(";") >= len(line) / 150 or len(line) >= 1000 and line.count(" ") < 0.03 * len(line)


def features(text: str, kind: str | None) -> tuple:
    """Evidence of one chunk, in the order of ``CHUNK`` from ``chars`` on."""
    lines = text.split("\n")
    long_chars = sum(len(x) for x in lines if len(x) > _LONG_LINE and is_dense(x))
    data = sum(len(x) for x in lines if len(x) > 2 and _DATA_LINE.match(_ASSIGNED.sub("", x, count=1)))
    head = leading_text(text) if kind in ("module", "section", None) else ""
    # lines long enough to be told from anyone else's; imports and constants of a module aren't
    solid = {x for x in map(str.strip, lines) if len(x) >= _SOLID_LINE} if kind != "module" else ()
    return (
        len(text),
        long_chars,
        data,
        sum(map(str.isdigit, text)) if re.search(r"\d\d", text) else 0,
        len(_HEX.findall(text)),
        bool(head and _GENERATED.search(head)),
        bool(head and _TAKEN.search(head)),
        bool(_PACKED.search(text)),
        [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x in solid],
    )


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in CHUNK.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()] + [pa.int64()] * 5 + [pa.bool_()] * 3 + [pa.list_(pa.int64())]
    for b in batches:
        rows = [
            (o, seen, p, path, source != "doc", *features(text or "", kind))
            for o, seen, p, path, source, kind, text in zip(*(b.column(i).to_pylist() for i in range(7)))
        ]
        cols = zip(*rows) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def glob_to_regex(glob: str) -> str | None:
    """Regex for a path below the attribute file's directory, or None for what git ignores."""
    if not glob or glob.startswith("!") or glob.endswith("/"):
        return None  # negative patterns and directories are not allowed there
    anchored = "/" in glob
    glob = glob.lstrip("/")
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i:] == "**":
            out, i = out + ".*", i + 2
        elif c == "*":
            while i < len(glob) and glob[i] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        else:
            if c == "\\" and i + 1 < len(glob):
                i, c = i + 1, glob[i + 1]
            out, i = out + re.escape(c), i + 1
    return "^" + ("" if anchored else "(?:.*/)?") + out + "$"


#: what the last line that names an attribute says of it
UNSPECIFIED, UNSET, SET = -1, 0, 1


def parse_attributes(text: str) -> list[tuple[int, str, int | None, int | None]]:
    """(line number, regex, generated, vendored) of the lines that name either; macros expand.

    The values are ``SET``, ``UNSET`` (``-name``, ``name=false``) or ``UNSPECIFIED`` (``!name``,
    which takes back what other lines said); None where the line doesn't name the attribute.
    """
    out, macros = [], {}
    for n, line in enumerate(text.splitlines()):
        line = line.strip()
        if not line or line[0] == "#":
            continue
        if line[0] == '"' and (end := line.find('"', 1)) > 0:
            glob, rest = line[1:end], line[end + 1 :].split()
        else:
            glob, *rest = line.split()
        if glob.startswith("[attr]"):
            macros[glob[6:]] = rest
            continue
        value: dict[str, int] = {}
        for a in (a for r in rest for a in (*macros.get(r, []), r)):
            name, _, set_to = a.lstrip("-!").partition("=")
            off = a[0] == "-" or set_to.lower() in ("false", "0", "no")
            value[name] = UNSPECIFIED if a[0] == "!" else UNSET if off else SET
        regex = glob_to_regex(glob)
        generated, vendored = value.get("linguist-generated"), value.get("linguist-vendored")
        if regex and (generated is not None or vendored is not None):
            out.append((n, regex, generated, vendored))
    return out


@lru_cache(maxsize=256)
def _compiled(text: str) -> list[tuple[re.Pattern, int | None, int | None]]:
    """The rules of an attribute file, the last line first; a pattern that is none matches nothing."""
    out = []
    for _, regex, generated, vendored in reversed(parse_attributes(text)):
        try:
            out.append((re.compile(regex), generated, vendored))
        except re.error:
            continue
    return out


DECLARED = "project_id string, path string, depth int, generated int, vendored int"


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(project, path, directory, text of the attribute file there) -> what that file says of the path."""
    types = [pa.string(), pa.string()] + [pa.int32()] * 3
    names = [x.split()[0] for x in DECLARED.split(", ")]
    for b in batches:
        rows = []
        for p, path, directory, text in zip(*(b.column(i).to_pylist() for i in range(4))):
            below = path[len(directory) + 1 :] if directory else path
            said: list[int | None] = [None, None]
            for regex, *values in _compiled(text):
                if None in said and regex.match(below):
                    said = [old if old is not None else new for old, new in zip(said, values)]
            if said != [None, None]:
                rows.append((p, path, len(directory), *said))
        cols = zip(*rows) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def declared(attributes: DataFrame, files: DataFrame) -> DataFrame:
    """``project_id path declared_generated declared_vendored`` of the files that a rule decides.

    ``attributes``: ``project_id path text`` of attribute files. A file meets the attribute files
    of its own directories only, each once with all its lines.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n")
    rules = attributes.groupBy("project_id", F.regexp_replace("path", r"/?[^/]*$", "").alias("directory")).agg(text.alias("text"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    met = files.select("project_id", "path", F.explode(above).alias("directory")).hint("merge").join(rules, ["project_id", "directory"])
    said = met.select("project_id", "path", "directory", "text").mapInArrow(_resolve, DECLARED)
    last = said.groupBy("project_id", "path").agg(
        *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("depth"))).alias(c) for c in ("generated", "vendored"))
    )
    value = lambda c: F.when(F.col(c) >= UNSET, F.col(c) == SET).alias(f"declared_{c}")
    return last.select("project_id", "path", value("generated"), value("vendored"))


def _vendored(path: Column) -> Column:
    dirs = "|".join(re.escape(d) for d in [*VENDORED_DIRS, *VENDORED_PATHS])
    return F.coalesce(path.rlike(f"(^|/)({dirs})/"), F.lit(False))


def classify_files(
    chunks: DataFrame,
    projects: DataFrame,
    attributes: DataFrame | None = None,
    *,
    min_support: int = 5,
    min_projects: int = 3,
    precision: float = 0.7,
    copied_share: float = 0.5,
) -> DataFrame:
    """``project_id path reason`` of the files that no one of the project wrote by hand.

    Needs ``project_id path source kind text`` of chunks and ``id repo`` of projects (and takes
    the latest row of an ``ord`` where ``ord`` and ``indexed_at`` are there); further columns are
    ignored. Attribute files are those among the chunks and those of ``attributes``
    (``project_id path text``), as ``sources.tree.attribute_files`` reads them. ``reason`` is one
    of ``declared project pattern generated minified packed data machine copied``. Rows with a
    null path belong to no file; a null text is an empty one; null ``project_id`` is one project
    without a registration; chunks without a registered project are judged without ``repo``;
    repeated rows of an ``ord`` count once; empty tables give no rows.
    """
    project = F.coalesce(F.col("project_id").cast("string"), F.lit(_NO_PROJECT)).alias("project_id")
    has = set(chunks.columns)
    order = F.col("ord").cast("bigint") if "ord" in has else F.lit(None).cast("bigint")
    seen = F.unix_micros(F.col("indexed_at").cast("timestamp")) if "indexed_at" in has else F.lit(None).cast("bigint")
    src = chunks.filter(F.col("path").isNotNull()).select(
        order.alias("ord"), seen.alias("seen"), project, "path", "source", "kind", F.col("text").cast("string").alias("text")
    )
    facts = src.mapInArrow(_features, CHUNK)
    if "ord" in has:
        # the latest row of an ord; rows without one are each their own
        same = F.coalesce("ord", -F.abs(F.xxhash64("project_id", "path", "chars", "lines")) - 1)
        newest = Window.partitionBy(same).orderBy(F.desc_nulls_last("seen"), "project_id", "path", "chars", F.xxhash64("lines"))
        facts = facts.withColumn("rn", F.row_number().over(newest)).filter("rn = 1").drop("rn")
    facts = stage(facts.drop("ord", "seen"), "provenance")
    rules = src.filter(F.col("path").rlike(r"(^|/)\.gitattributes$") & F.col("text").isNotNull()).select(project, "path", "text", "ord").distinct()
    if attributes is not None:
        rules = rules.unionByName(attributes.filter("path is not null and text is not null").select(project, "path", "text", F.lit(0).cast("bigint").alias("ord")))

    # the whole project is someone else's if every registration stands in a vendored place
    place = F.concat(F.regexp_replace("repo", r"\\", "/"), F.lit("/"))
    foreign = projects.filter(F.col("repo").isNotNull()).groupBy(F.col("id").cast("string").alias("project_id")).agg(F.min(_vendored(place)).alias("foreign"))
    name = F.lower(F.regexp_replace("project_id", "-", "_"))
    root = F.lower(F.regexp_extract("path", r"^(?:src/|lib/|python/)?([^/]+)/", 1))

    files = facts.groupBy("project_id", "path").agg(
        F.max("code").alias("code"),
        *(F.sum(c).alias(c) for c in ("chars", "long_chars", "data_chars", "digits", "hexes")),
        F.sum(F.size("lines")).alias("solid_lines"),
        *(F.max(c).alias(c) for c in ("generated", "taken", "packed")),
    )
    files = files.join(foreign, "project_id", "left").withColumn("foreign", F.coalesce("foreign", F.lit(False)))
    files = files.withColumn("own", F.coalesce((root == name) & ~F.col("foreign"), F.lit(False)))
    files = files.withColumn("vendored", _vendored(F.col("path")) & ~F.col("own"))

    # third-party text: what stands in vendored places or in the package a project is named after;
    # a project that is foreign as a whole holds much that isn't a library's, so it is no source
    where = files.select("project_id", "path", F.col("vendored").alias("there"), "own")
    solid = facts.select("project_id", "path", F.explode("lines").alias("digest"))
    owned = facts.join(where.filter("there or own").hint("merge"), ["project_id", "path"]).select("project_id", "there", "own", F.explode("lines").alias("digest"))
    owner = F.when(F.col("own"), F.col("project_id"))
    # vendored text counts wherever it is met again, a library's own outside its project
    third = owned.groupBy("digest").agg(F.max("there").alias("there"), F.min(owner).alias("p1"), F.max(owner).alias("p2"))
    met = solid.join(third.hint("merge"), "digest").filter(F.col("there") | ~(F.col("project_id").eqNullSafe(F.col("p1")) & F.col("project_id").eqNullSafe(F.col("p2"))))
    shared = met.groupBy("project_id", "path").agg(F.count("*").alias("shared_lines"))
    # tables of files grow with the collection: none of them is broadcast
    files = files.join(shared.hint("merge"), ["project_id", "path"], "left")

    share = lambda c: F.try_divide(F.col(c), F.col("chars"))
    code = F.col("code") & (F.col("chars") > 0)
    content = (
        F.when(code & F.col("generated"), "generated")
        .when(code & F.col("packed"), "packed")
        .when(code & (share("long_chars") > 0.5), "minified")
        .when(code & (F.col("chars") >= 400) & ((share("data_chars") > 0.6) | (share("digits") > 0.25)), "data")
        .when(code & (F.col("hexes") >= 3) & (share("hexes") > 0.001), "machine")
        .when(code & F.col("taken") & ~F.col("own"), "copied")
        .when(code & ~F.col("own") & (F.try_divide(F.col("shared_lines"), F.col("solid_lines")) >= copied_share), "copied")
    )
    files = stage(files.withColumn("content", content), "files")

    # patterns: each directory name, well-known pairs of them, and what follows the last separator of the file's name
    said = declared(rules, files)
    files = files.join(said.hint("merge"), ["project_id", "path"], "left")
    yes = F.coalesce("declared_generated", F.lit(False)) | F.coalesce("declared_vendored", F.lit(False))
    no = F.coalesce((F.col("declared_generated") == False) | (F.col("declared_vendored") == False), F.lit(False))  # noqa: E712
    parts = F.split("path", "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    ending = F.regexp_extract(stem, r"[^._-]([._-][^._-]+)$", 1)
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    pairs = F.zip_with(dirs, F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda a, b: F.concat(F.lit("dir "), a, F.lit("/"), b))
    keys = F.array_distinct(
        F.concat(
            F.transform(dirs, lambda d: F.concat(F.lit("dir "), d)),
            F.filter(pairs, lambda x: x.isin([f"dir {d}" for d in VENDORED_PATHS])),
            F.when(ending != "", F.array(F.concat(F.lit("end "), ending))).otherwise(F.array().cast("array<string>")),
        )
    )
    shown = F.when(yes | (F.col("content").isNotNull() & ~no), F.lit(1))
    free = files.filter(F.col("code") & ~F.col("own") & ~F.col("foreign")).select("project_id", "path", shown.alias("shown"), F.explode(keys).alias("key"))
    score = free.groupBy("key").agg(
        F.count("*").alias("n"), F.count("shown").alias("hits"), F.approx_count_distinct(F.when(F.col("shown") == 1, F.col("project_id"))).alias("where_")
    )
    generated = [f"dir {d}" for d in GENERATED_DIRS] + [f"end {e}" for e in GENERATED_ENDINGS]
    vendored = [f"dir {d}" for d in [*VENDORED_DIRS, *VENDORED_PATHS]]
    rate = (F.col("hits") + 1) / (F.col("n") + 2)
    mined = (F.col("hits") >= min_support) & (F.col("where_") >= min_projects) & (rate >= precision)
    listed = F.col("key").isin(vendored) | (F.col("key").isin(generated) & ~((F.col("n") >= 10) & (rate < 0.3)))
    # documents are foreign in vendored places too, other patterns are about code
    every = files.filter(~F.col("own")).select("project_id", "path", "code", F.explode(keys).alias("key"))
    patterns = score.filter(mined | listed).select("key").unionAll(every.filter(F.col("key").isin(vendored)).select("key")).distinct()
    by_pattern = every.hint("merge").join(patterns, "key").filter(F.col("code") | F.col("key").isin(vendored))
    by_pattern = by_pattern.select("project_id", "path").distinct().withColumn("pattern", F.lit(True))

    out = files.join(by_pattern.hint("merge"), ["project_id", "path"], "left")
    reason = (
        F.when(yes, "declared")
        .when(no, None)
        .when(F.col("foreign"), "project")
        .when(F.col("pattern"), "pattern")
        .when(F.col("content").isNotNull(), F.col("content"))
    )
    out = out.withColumn("reason", reason).filter(F.col("reason").isNotNull())
    return out.select(F.nullif("project_id", F.lit(_NO_PROJECT)).alias("project_id"), "path", "reason")
