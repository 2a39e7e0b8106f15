"""Text expressions: tokenizer, excerpts, extraction from documents and commits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters written without spaces; marks that occur inside such runs belong to them.
_CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}ー-ヾゝ-ゞ"
_WORD = r"[\p{L}\p{Nd}_]+"
#: Boundaries inside a compound: lower-Upper, UPPER-Upper+lower, letter-digit, digit-letter.
_CAMEL = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=\p{L})(?=\p{Nd})|(?<=\p{Nd})(?=\p{L})"
#: Words without a boundary inside: one case, an initial and lower case, or digits only.
_PLAIN = r"^(?:[A-Z]?[a-z]+|\p{Lu}?\p{Ll}+|\p{Lu}+|\p{Nd}+)\z"


def split_words(text: Column) -> Column:
    """Runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_WORD), F.lit(0))


def split_compound(word: Column) -> Column:
    """Parts of a word between underscores and camel-case boundaries."""
    snake = F.filter(F.split(word, "_"), lambda s: s != "")
    return F.flatten(F.transform(snake, lambda s: F.filter(F.split(s, _CAMEL), lambda p: p != "")))


def _compound_terms(word: Column) -> Column:
    """Lower-cased parts and then the whole word, or just the word."""
    parts = split_compound(word)
    whole = F.array(F.lower(word))
    return F.when(F.size(parts) > 1, F.concat(F.transform(parts, F.lower), whole)).otherwise(whole)


def _bigrams(run: Column) -> Column:
    """Overlapping pairs of characters; a lone character stays."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substr(run, i, F.lit(2)))
    return F.when(F.length(run) > 1, pairs).otherwise(F.array(run))


def word_terms(word: Column) -> Column:
    """Terms of one word of ``split_words``, in order."""
    runs = F.lit(f"[{_CJK}]+|[^{_CJK}]+")
    mixed = F.flatten(F.transform(F.regexp_extract_all(word, runs, F.lit(0)), lambda r: F.when(r.rlike(f"^[{_CJK}]"), _bigrams(r)).otherwise(_compound_terms(r))))
    return F.when(word.rlike(_PLAIN), F.array(F.lower(word))).when(word.rlike(f"[{_CJK}]"), mixed).otherwise(_compound_terms(word))


def tokenize(text: Column) -> Column:
    """Terms of a text in order; a term's place in the array is its position."""
    return F.flatten(F.transform(split_words(text), word_terms))


def tokens_for(body: Column) -> Column:
    """Approximate token cost: words times 1.3, rounded up."""
    words = F.size(F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"\S+"), F.lit(0)))
    return F.ceil(words * F.lit(1.3)).cast("int")


def first_line(text: Column) -> Column:
    """First line that is not blank after its heading marks, or ``(untitled)``."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^(#+\s*)+", "")))
    return F.coalesce(F.get(F.filter(lines, lambda x: x != ""), F.lit(0)), F.lit("(untitled)"))


def title_of(text: Column, most: int = 200) -> Column:
    """``first_line`` cut to a number of characters."""
    return F.substring(first_line(text), 1, most)


def slugify(text: Column) -> Column:
    """Lower case; runs of anything but letters and digits become one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]+", "-"), r"^-+|-+$", "")


def commit_type(message: Column) -> Column:
    """Conventional type of a commit's first line, else ``unknown``."""
    kinds = "feat|fix|refactor|breaking|docs|test|chore|perf|ci|build|style|revert"
    found = F.regexp_extract(F.split_part(message, F.lit("\n"), F.lit(1)), rf"^({kinds})(\(.+?\))?!?:\s", 1)
    return F.when(found != "", found).otherwise(F.lit("unknown"))


_DECISION = r"(?i)^(decision|adr|rfc):"


def is_commit_decision(message: Column) -> Column:
    """Whether a commit's first line that is not blank marks a decision."""
    return first_line(message).rlike(_DECISION)


def commit_decision_id(sha: Column) -> Column:
    """Decision id of a commit: its hash's first twelve digits."""
    return F.concat(F.lit("commit:"), F.substring(sha, 1, 12))


def commit_decision_title(message: Column) -> Column:
    """The subject without its marker; the whole subject if nothing is left."""
    subject = first_line(message)
    rest = F.ltrim(F.regexp_replace(subject, _DECISION, ""))
    return F.substring(F.when(rest == "", subject).otherwise(rest), 1, 200)


def comment_text(line: Column) -> Column:
    """Inner text of a one-line comment (``//``, ``#``, ``*``), else empty."""
    t = F.trim(line)
    return (
        F.when(t.startswith("//"), F.trim(F.substring(t, 3, 1 << 30)))
        .when(t.startswith("#"), F.trim(F.substring(t, 2, 1 << 30)))
        .when(t.startswith("*") & ~t.startswith("*/"), F.trim(F.substring(t, 2, 1 << 30)))
        .otherwise(F.lit(""))
    )


def annotation(line: Column, tag: str) -> Column:
    """``struct<type, name, description>`` of an annotation comment, else null.

    ``tag`` is the project's marker: with ``@kb``, ``@kb-rule name: text`` and
    ``@kb-lesson name: text`` are annotations.
    """
    c = comment_text(line)
    kind = F.when(c.startswith(f"{tag}-rule"), F.lit("rule")).when(c.startswith(f"{tag}-lesson"), F.lit("lesson"))
    rest = F.trim(F.when(kind == "rule", F.substring(c, len(tag) + 6, 1 << 30)).otherwise(F.substring(c, len(tag) + 8, 1 << 30)))
    at = F.instr(rest, ":")
    name = F.trim(F.when(at > 0, F.substring_index(rest, ":", 1)).otherwise(rest))
    text = F.when(at > 0, F.trim(F.substr(rest, at + 1))).otherwise(F.lit(""))
    return F.when(kind.isNotNull() & (name != ""), F.struct(kind.alias("type"), name.alias("name"), text.alias("description")))


def severity_of_name(name: Column) -> Column:
    """Severity that an annotation's name asks for."""
    n = F.lower(name)
    return F.when(n.startswith("must-"), F.lit("must")).when(n.startswith("may-"), F.lit("may")).otherwise(F.lit("should"))


def annotation_body(file: Column, line: Column, description: Column) -> Column:
    """A decision's body with its file anchor first."""
    anchor = F.when(line > 0, F.concat(F.lit("[file: "), file, F.lit(":"), line.cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("[file: "), file, F.lit("]")))
    return F.when(F.coalesce(file, F.lit("")) == "", description).when(description == "", anchor).otherwise(F.concat(anchor, F.lit("\n\n"), description))


def file_anchor(body: Column) -> Column:
    """Path of the first ``[file: path:line]`` in a body, without its line."""
    return F.regexp_replace(F.regexp_extract(F.coalesce(body, F.lit("")), r"\[file: ([^\]]*)\]", 1), r"(?<=.):[0-9]*$", "")


def h2_sections(text: Column) -> Column:
    """``array<struct<title, body>>``: one item per ``## `` heading of a document."""
    parts = F.slice(F.split(F.concat(F.lit("\n"), F.coalesce(text, F.lit(""))), r"\n## "), 2, 1 << 30)
    return F.transform(parts, lambda p: F.struct(F.trim(F.split_part(p, F.lit("\n"), F.lit(1))).alias("title"), F.trim(F.regexp_replace(p, r"^[^\n]*\n?", "")).alias("body")))


def escape_id(id: Column) -> Column:
    r"""An id with ``\`` and ``:`` escaped, as it stands in a key."""
    return F.replace(F.replace(id, F.lit("\\"), F.lit("\\\\")), F.lit(":"), F.lit("\\c"))


def unescape_id(id: Column) -> Column:
    """What ``escape_id`` was given; one pass, by a stand-in character."""
    hidden = F.replace(id, F.lit("\\\\"), F.lit("\u0001"))
    return F.replace(F.replace(hidden, F.lit("\\c"), F.lit(":")), F.lit("\u0001"), F.lit("\\"))


def version_key(prefix: Column, id: Column, version: Column) -> Column:
    """Storage key of one version of an event."""
    return F.concat(prefix, escape_id(id), F.lit(":v"), F.lpad(version.cast("string"), 16, "0"))


def split_ref(ref: Column) -> Column:
    """``struct<kind, id>`` of a typed reference, a trailing version dropped."""
    kind = F.create_map(*[F.lit(x) for p in (("e", "entity"), ("d", "decision"), ("l", "link"), ("o", "observation"), ("x", "outcome")) for x in p])
    bare = F.regexp_replace(ref, r":v[0-9]+$", "")
    head = F.when(F.substring(bare, 2, 1) == ":", F.element_at(kind, F.substring(bare, 1, 1)))
    return F.when(head.isNotNull() & (F.length(bare) >= 3), F.struct(head.alias("kind"), F.substring(bare, 3, 1 << 30).alias("id")))
