"""Scalar functions on code and prose, as column expressions.

Everything here stays inside the JVM: no Python worker is started for any of it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: line separators that a text is split at, as ``str.splitlines`` does
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"

# Question words and connectives that narrowing drops.
STOP_WORDS = (
    "bir bu şu ne neden nasıl nerede nereden hangi hangisi kaç kim kimler var yok mı mi mu mü ve ile için olan olarak "
    "gibi daha sonra önce en de da ki"
).split()

# What makes a path a test, a citation, a relative import, a re-export.
TEST_PATH = r"(^|/)(tests?|testing)(/|$)|(^|/)test_[^/]*$|_test\.[a-z]+$"
CITATION = r"`?([\p{L}\p{N}_./\\-]+\.[A-Za-z]{1,6}):(\d+)`?"
RELATIVE_IMPORT = r"(?m)^from (\.+)([\p{L}\p{N}_.]*) import"
REEXPORT_LINE = r"^[\p{L}\p{N}_]+(\s*:[^=]+)?\s*=\s*[A-Za-z_][\p{L}\p{N}_.]*\s*$"
IGNORED_LINE = r"^\s*(import |from |__all__\s*=|#|\"\"\"|$)"
TURKISH_LETTERS = "[ğĞşŞıİçÇöÖüÜ]"

#: weight of a class chunk that only lists fields (and, where asked for, of a re-export module)
TYPE_ONLY_WEIGHT = 0.4
#: price per million tokens: fresh input, cache write, cache read, output
TOKEN_WEIGHTS = (1.0, 1.25, 0.1, 5.0)


def tokenize(text: Column) -> Column:
    """Lower-cased terms: split at everything but letters and digits, and at camel humps."""
    humps = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    parts = F.filter(F.split(humps, r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.transform(parts, lambda x: F.lower(x))


def lines(text: Column) -> Column:
    """Lines of a text; one trailing break doesn't open another line."""
    parts = F.split(text, LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def is_reexport(text: Column) -> Column:
    """Whether a module chunk only gives other names to imported things."""
    rest = F.filter(lines(text), lambda x: ~x.rlike(IGNORED_LINE))
    return ~text.contains("def ") & ~text.contains("class ") & F.forall(rest, lambda x: F.trim(x).rlike(REEXPORT_LINE))


def chunk_weight(kind: Column, text: Column, demote_reexports: bool = False) -> Column:
    """Information density: classes without methods (and re-export modules) weigh less."""
    w = F.when((kind == "class") & ~F.coalesce(text, F.lit("")).contains("def "), TYPE_ONLY_WEIGHT)
    if demote_reexports:
        w = w.when((kind == "module") & is_reexport(text), TYPE_ONLY_WEIGHT)
    return w.otherwise(F.lit(1.0))


def directory(path: Column) -> Column:
    """Directory of a path; empty for the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def facet_directory(location: Column) -> Column:
    """Directory of a ``path:line``; ``.`` for the root."""
    d = directory(F.split_part(location, F.lit(":"), F.lit(1)))
    return F.when(d == "", ".").otherwise(d)


def ancestors(d: Column) -> Column:
    """A directory and all directories above it, without the root."""
    parts = F.filter(F.split(d, "/"), lambda x: (x != "") & (x != "."))
    return F.when(
        F.size(parts) > 0,
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")),
    ).otherwise(F.array().cast("array<string>"))


def resolve_relative_import(importer: Column, dots: Column, module: Column) -> Column:
    """Path of the file that ``from <dots><module> import`` names; dots beyond the root stop there."""
    package = F.slice(F.split(importer, "/"), 1, F.size(F.split(importer, "/")) - 1)
    up = F.length(dots) - 1
    base = F.slice(package, 1, F.greatest(F.size(package) - up, F.lit(0)))
    parts = F.when(module == "", base).otherwise(F.concat(base, F.split(module, r"\.")))
    return F.when(F.size(parts) > 0, F.concat(F.array_join(parts, "/"), F.lit(".py")))


def slug(name: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "proje").otherwise(s)


def citations(text: Column) -> Column:
    """Distinct ``path:line`` references in their order, with ``/`` in paths."""
    found = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(CITATION), F.lit(1)).alias("p"), F.regexp_extract_all(text, F.lit(CITATION), F.lit(2)).alias("n")
    )
    return F.array_distinct(F.transform(found, lambda c: F.concat(F.replace(c["p"], F.lit("\\"), F.lit("/")), F.lit(":"), c["n"])))


def cited_files(refs: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(refs, lambda c: F.regexp_replace(c, ":[^:]*$", ""))))


def narrow(question: Column, keep: int = 1) -> Column:
    """The first ``keep`` words that carry meaning, lower-cased by Turkish rules."""
    folded = F.lower(F.translate(question, "İI", "iı"))
    words = F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(*STOP_WORDS) & (F.length(w) > 2))
    return F.array_join(F.slice(kept, 1, keep), " ")


def token_cost(fresh: Column, written: Column, read: Column, output: Column) -> Column:
    a, b, c, d = TOKEN_WEIGHTS
    return (fresh * a + written * b + read * c + output * d) / F.lit(1e6)


def snippet(text: Column, most: int = 40) -> Column:
    """The first lines and how many more there are."""
    rows = lines(text)
    head = F.array_join(F.slice(rows, 1, most), "\n")
    more = F.size(rows) - most
    return F.when(more > 0, F.concat(head, F.lit("\n... ("), more.cast("string"), F.lit(" more lines)"))).otherwise(head)


def numbered(text: Column, start_line: Column) -> Column:
    """Lines with their numbers, right-aligned in five places; longer numbers stay whole."""
    number = lambda i: (start_line + i).cast("string")
    return F.array_join(
        F.transform(
            lines(text), lambda x, i: F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(0), 5 - F.length(number(i)))), number(i), F.lit(" | "), x)
        ),
        "\n",
    )


def content_hash(context: Column, text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of context, blank line and text."""
    whole = F.concat(F.coalesce(context, F.lit("")), F.lit("\n\n"), F.coalesce(text, F.lit("")))
    return F.substring(F.sha2(F.encode(whole, "UTF-8"), 256), 1, 16)


def normal_path(path: Column) -> Column:
    """Path with ``/`` and without leading ``./``."""
    return F.regexp_replace(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), r"^(\./+)+", "")
