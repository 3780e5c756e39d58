"""Scalar functions on text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed by the engine's contract: characters and words of query syntax.
SYNTAX = r'[\^"~*():\[\]{}\\!+]'
BOOLEAN = r"(^|\s)(AND|OR|NOT)(\s|$)"


def identifier_words(text: Column) -> Column:
    """camelCase, acronyms and snake_case as words with one space between."""
    text = F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2")
    text = F.regexp_replace(text, r"([A-Z])([A-Z][a-z])", "$1 $2")
    return F.trim(F.regexp_replace(text, r"[^A-Za-z0-9]+", " "))


def tokens(text: Column) -> Column:
    """Distinct lower-case alphanumeric tokens of more than one character; a change from lower to upper case splits."""
    text = F.lower(F.regexp_replace(text, r"([a-z])([A-Z])", "$1 $2"))
    return F.array_sort(F.array_distinct(F.filter(F.split(text, r"[^a-z0-9]+"), lambda t: F.length(t) > 1)))


def trigrams(token: Column) -> Column:
    """Sorted distinct trigrams of a token of 6 to 64 characters, else none."""
    grams = F.transform(F.sequence(F.lit(1), F.length(token) - 2), lambda i: F.substr(token, i, F.lit(3)))
    return F.when(F.length(token).between(6, 64), F.array_sort(F.array_distinct(grams))).otherwise(F.array().cast("array<string>"))


def near_match(a: Column, b: Column) -> Column:
    """2000 x shared / (a + b) of two trigram sets; 0 unless three are shared and the value reaches 700."""
    shared = F.size(F.array_intersect(a, b))
    value = F.floor(2000 * shared / (F.size(a) + F.size(b)))
    return F.when((shared >= 3) & (value >= 700), value).otherwise(F.lit(0)).cast("long")


def ngrams(text: Column, low: int = 3, high: int = 10) -> Column:
    """All substrings of `low` to `high` characters."""

    def of(n: int) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n)))
        return F.when(F.length(text) >= n, grams).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*map(of, range(low, high + 1))))


def query_terms(query: Column) -> Column:
    """Discovery terms of a query; null if it has syntax, is longer than 4096 bytes, or has fewer than two terms."""
    terms = F.array_distinct(F.filter(F.split(F.lower(query), r"[^a-z0-9]+"), lambda t: F.length(t) > 0))
    plain = ~query.rlike(SYNTAX) & ~query.rlike(BOOLEAN) & (F.octet_length(query) <= 4096)
    return F.when(plain & (F.size(terms) >= 2), terms)


def is_identifier(text: Column) -> Column:
    return (F.octet_length(text) <= 96) & text.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$")


def slug(text: Column) -> Column:
    """Lower case; white space becomes a hyphen; only letters, digits, _ and - stay."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"\s", "-"), r"[^\p{L}\p{N}_-]", "")


def preview(text: Column, n: int) -> tuple[Column, Column]:
    """(the first `n` characters, whether there were more)."""
    return F.substring(text, 1, n), F.length(text) > n


def kwic(text: Column, term: str, width: int) -> Column:
    """A window of about `width` characters around the first match, marked where it is cut."""
    at = F.locate(term, text)
    begin = F.greatest(F.lit(1), at - width // 2)
    window = F.substr(text, begin, F.lit(width))
    return F.when(at > 0, F.concat(F.when(begin > 1, "...").otherwise(""), window, F.when(begin + width <= F.length(text), "...").otherwise("")))


def comment_text(line: Column) -> Column:
    """A comment line without its marker."""
    return F.trim(F.regexp_replace(line, r"^\s*(//!|///|//|#+|--|\*)\s?", ""))


def portable_path(path: Column, base: str) -> Column:
    """Forward slashes, and `base` stripped where it is a whole-segment prefix."""
    flat = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(flat.startswith(base.rstrip("/") + "/"), F.substr(flat, F.lit(len(base.rstrip("/")) + 2))).otherwise(flat)


def in_prefix(path: Column, prefix: str) -> Column:
    """Whether whole segments of `path` begin with `prefix`; absolute prefixes and `..` are refused."""
    parts = [p for p in prefix.replace("\\", "/").split("/") if p not in ("", ".")]
    if prefix.startswith("/") or ".." in parts or parts[:1] and parts[0][1:2] == ":":
        raise ValueError("a relative prefix without .. is asked for")
    clean = "/".join(parts)
    return F.lit(True) if not clean else (path == clean) | path.startswith(clean + "/")


def headings(text: Column) -> Column:
    """Lines of one to six hashes, without them."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^(#{1,6} +\S.*)$"), 1)


def backticks(text: Column, most: int = 8) -> Column:
    """The first `most` distinct bare identifiers in single backticks, a documented limit of the operator."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(r"`([A-Za-z_][A-Za-z0-9_]*)`"), 1)), 1, most)


def links(html: Column) -> Column:
    """Targets of href attributes."""
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), 1)


def fuzzy(text: Column, word: str, most: int) -> Column:
    """Whether a text is `most` edits from a word; two neighbouring characters in each other's place are one edit, once."""
    out = F.levenshtein(text, F.lit(word)) <= most
    if most > 0:
        for swapped in swaps(word):
            out |= F.levenshtein(text, F.lit(swapped)) <= most - 1
    return out


def swaps(word: str) -> list[str]:
    """The word with each pair of unlike neighbours exchanged."""
    return [word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1) if word[i] != word[i + 1]]


#: What a path tells of a file, by patterns.
PATHS = {
    "is_document": r"\.(md|mdx|txt|rst|adoc|html)$",
    "is_config": r"\.(json|toml|ya?ml|ini|cfg)$",
    "is_test": r"(^|/)(tests?|spec)(/|$)|[._-](test|spec)\.",
    "is_manifest": r"(^|/)(package\.json|Cargo\.toml|go\.mod|pyproject\.toml|pom\.xml)$",
    "is_entry": r"(^|/)(main|index|__main__|lib|mod)\.[a-z]+$",
}


def path_kinds(path: Column) -> dict[str, Column]:
    return {name: path.rlike(pattern) for name, pattern in PATHS.items()}


def markdown_links(text: Column) -> Column:
    """Targets of inline Markdown links."""
    return F.regexp_extract_all(text, F.lit(r"\]\(([^)\s]*)\)"), 1)


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts, each with its length before it."""
    return F.sha2(F.concat(*[F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts]), 256)


def highlight(text: Column, words: list[str]) -> Column:
    """Matches of words, whatever their case, between double asterisks; matches with only blanks between are one."""
    marked = F.regexp_replace(text, "(?i)(" + "|".join(words) + ")", r"**$1**")
    return F.regexp_replace(marked, r"\*\*([ \t]*)\*\*", "$1")


def module_path(path: Column, root: str, prefix: str, separator: str) -> Column:
    """A file's path as a module: without its extension, the source root replaced by `prefix`, `separator` between segments."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.[a-z]+$", ""), f"^{root}", prefix)
    return F.replace(bare, F.lit("/"), F.lit(separator))


def parameter_type(signature: Column, name: str) -> Column:
    """The type that a signature gives a parameter; empty if it has none."""
    return F.regexp_extract(signature, rf"[(,]\s*{name}\s*:\s*&?\s*([A-Za-z_][A-Za-z0-9_]*)", 1)


def declared_bases(signature: Column) -> Column:
    """The base classes of a class signature, keyword arguments left out."""
    inside = F.regexp_extract(signature, r"^\s*class\s+\w+\s*\(([^)]*)\)", 1)
    return F.filter(F.transform(F.split(inside, ","), lambda x: F.trim(x)), lambda x: (x != "") & ~x.contains("="))


def receiver(context: Column) -> tuple[Column, Column]:
    """(receiver, whether the call is static) of `receiver:...,static:...`."""
    pattern = r"^receiver:([^,]*),static:(true|false)$"
    return F.regexp_extract(context, pattern, 1), F.regexp_extract(context, pattern, 2) == "true"


def parsed_kind(text: Column, known: dict[str, str], default: str) -> Column:
    """The kind that a word names, whatever its case, else the default."""
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(names[F.lower(text)], F.lit(default))


def segments(n: Column, most: int = 8) -> Column:
    """At most `most` of `n` segments, sorted: the centre, the first, the last, and others evenly between."""
    div = lambda a, b: F.floor(a / b).cast("int")
    every = F.array(div(n, 2), F.lit(0), n - 1, *[div((n - 1) * k, most - 1) for k in range(1, most - 1)])
    return F.slice(F.array_sort(F.array_distinct(every)), 1, most)


def embedding_input(headings: Column, content: Column) -> Column:
    """What is embedded of a chunk: its headings, a blank line, its text."""
    return F.concat(F.array_join(headings, " > "), F.lit("\n\n"), content)


def lexical_score(fields: list[tuple[Column, int]], terms: list[str]) -> tuple[Column, Column]:
    """(terms found in any field, the sum of the weights of the fields they are found in)."""
    found, weight = F.lit(0), F.lit(0)
    for term in terms:
        hits = [(F.array_contains(words, term), w) for words, w in fields]
        any_of = hits[0][0]
        for hit, _ in hits[1:]:
            any_of |= hit
        found += any_of.cast("int")
        for hit, w in hits:
            weight += hit.cast("int") * w
    return found, weight


def local_target(path: Column, target: Column) -> tuple[Column, Column]:
    """(path, fragment) that a relative link leads to from a file; null for what has a scheme, is absolute or leaves the root."""
    bare, fragment = F.split_part(target, F.lit("#"), F.lit(1)), F.split_part(target, F.lit("#"), F.lit(2))
    folder = F.when(bare == "", path).otherwise(F.concat(F.regexp_replace(path, "[^/]*$", ""), bare))
    parts = F.filter(F.split(folder, "/"), lambda x: (x != "") & (x != "."))
    none = F.lit(None).cast("array<string>")
    up = lambda done: F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(none)
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda done, x: F.when(done.isNull(), none).when(x == "..", up(done)).otherwise(F.concat(done, F.array(x))))
    outside = target.rlike("^([A-Za-z][A-Za-z0-9+.-]*:|/)")
    return F.when(~outside, F.array_join(walked, "/")), F.when(~outside & (fragment != ""), fragment)
