"""Secret scans (operator 8), with DataFrame functions only.

Four fixed kinds of pattern give the base spans.  The method adds spans: a
candidate string, a run of one character class, is read through a window of
``WINDOW`` characters whose Shannon entropy is kept up by incremental counts as
one character enters and one leaves; a run with a window over its class's
threshold is a secret unless the allow-list suppresses it.

Positions come from the text between matches: ``regexp_extract_all`` gives the
matches, ``split`` the gaps (where there is a match), and the running sum of
both lengths the start of each match.  The sums run in a window over match
rows, not in one expression, so a text with very many matches costs linear
time.  The table is read once, for all kinds.  Only match lengths are shuffled,
never text.

Defined cases: a null text counts as empty; repeated rows give equal results,
as often as they stand; a text without a match gives zeros and the digest of
the empty string.  Rows with a null id are scanned as well; an empty table
gives an empty result.  Other columns are not kept, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotlog.llm._common import table

#: Pattern, group that must be long enough, its least length.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
}
#: Characters in the sliding window.
WINDOW = 20
#: Candidate runs of each class, and the bits a character that its window needs.
CLASSES = {
    "entropy_hex": (r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{20,}", 3.2),
    "entropy_base64": (r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", 3.7),
}
#: A candidate, or a piece of one between allowed words, with a match of any of these is no secret.
ALLOW = (
    r"^[^0-9]*$",  # no digit at all
    r"^[0-9_=+/-]*$",  # no letter at all
    r"^(.{1,4})\1+.{0,3}$",  # one short piece over and over
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
)
#: Words that no window of a secret has; the rest of the candidate is still read.
ALLOW_WORDS = r"(?i)(?:example|sample|dummy|placeholder|changeme|xxxx|abcdefgh|12345678|01234567|qwerty)"


def window_entropy(text: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy (bits) of any ``window`` characters of a text.

    The state holds a count for each distinct character and the sum of
    ``n log2 n`` over them; a step changes two counts and two terms of the sum.
    """
    term = [0.0, *[n * math.log2(n) for n in range(1, window + 2)]]
    terms = F.array(*[F.lit(x) for x in term])
    f = lambda n: F.get(terms, n)
    chars = F.split(text, "")
    alphabet = F.array_distinct(chars)
    code = F.transform(chars, lambda c: (F.array_position(alphabet, c) - 1).cast("int"))

    def over(codes: Column) -> Column:
        start = F.struct(F.transform(alphabet, lambda c: F.lit(0)).alias("n"), F.lit(0.0).alias("s"), F.lit(float("inf")).alias("low"))

        def step(a: Column, i: Column) -> Column:
            new = F.get(codes, i)
            old = F.when(i >= window, F.get(codes, i - window)).otherwise(F.lit(-1))
            had, lost = F.get(a["n"], new), F.when(old >= 0, F.get(a["n"], old)).otherwise(F.lit(0))
            n = F.transform(a["n"], lambda x, k: x + F.when(k == new, 1).otherwise(0) - F.when(k == old, 1).otherwise(0))
            s = F.when(old == new, a["s"]).otherwise(a["s"] + f(had + 1) - f(had) + F.when(old >= 0, f(lost - 1) - f(lost)).otherwise(0.0))
            return F.struct(n.alias("n"), s.alias("s"), F.when(i >= window - 1, F.least(a["low"], s)).otherwise(a["low"]).alias("low"))

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda a: F.lit(math.log2(window)) - a["low"] / window)

    # one-element transform: the codes are computed once for the whole fold
    return F.get(F.transform(F.array(code), over), F.lit(0))


def _allowed(x: Column) -> Column:
    out = F.lit(False)
    for rule in ALLOW:
        out = out | x.rlike(rule)
    return out


def _verdict(value: Column, bits: float) -> Column:
    """Whether a candidate has a window over ``bits`` that the allow-list lets through."""
    secret = lambda x: F.when(_allowed(x), F.lit(False)).otherwise(window_entropy(x) >= bits)
    pieces = F.filter(F.split(value, ALLOW_WORDS, -1), lambda x: F.length(x) >= WINDOW)
    return F.when(_allowed(value), F.lit(False)).otherwise(F.exists(pieces, secret))


def _spans(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Spans of every different row, and a row of kind -1 that says how often it stands (``_times``)."""
    source = docs.select(F.col(id).alias("_id"), F.xxhash64(F.lit(5), F.col(text)).alias("_mark"), F.col(text).alias("_text"))
    kinds = {**{n: (pattern, group) for n, (pattern, group, _) in KINDS.items()}, **{n: (pattern, 0) for n, (pattern, _) in CLASSES.items()}}
    found = source.select("*", *[F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)).alias(f"_m{k}") for k, (pattern, _) in enumerate(kinds.values())])
    per_kind = []
    for k, (pattern, group) in enumerate(kinds.values()):
        m = F.col(f"_m{k}")
        value = F.regexp_extract_all("_text", F.lit(pattern), F.lit(group)) if group else m
        parts = F.arrays_zip(F.split("_text", pattern, -1).alias("g"), m.alias("m"), value.alias("v"))
        per_kind.append(F.struct(F.lit(k).alias("kind"), F.when(F.size(m) > 0, parts).alias("x")))
    # a row without a match of its own counts the rows alike
    none = F.struct(F.lit(-1).alias("kind"), F.array(F.struct(F.lit("").alias("g"), F.lit("").alias("m"), F.lit("").alias("v"))).alias("x"))
    each = found.select("_id", "_mark", F.explode(F.array(none, *per_kind)).alias("_k")).where("_k.x IS NOT NULL")
    rows = each.select("_id", "_mark", F.col("_k.kind").alias("_kind"), F.posexplode("_k.x").alias("_no", "_x")).where("_x.m IS NOT NULL")
    kind, value, keep = F.col("_kind"), F.col("_x.v"), F.lit(False)
    for k, (_, _, least) in enumerate(KINDS.values()):
        keep = F.when(kind == k, F.length(value) >= least).otherwise(keep)
    for k, (_, bits) in enumerate(CLASSES.values(), len(KINDS)):
        keep = F.when(kind == k, _verdict(value, bits)).otherwise(keep)
    rows = rows.select("_id", "_mark", "_kind", "_no", F.length("_x.g").alias("_gap"), F.length("_x.m").alias("_len"), keep.alias("_keep"))
    rows = rows.groupBy("_id", "_mark", "_kind", "_no").agg(F.count("*").alias("_times"), F.first("_gap").alias("_gap"), F.first("_len").alias("_len"), F.first("_keep").alias("_keep"))
    so_far = Window.partitionBy("_id", "_mark", "_kind").orderBy("_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_end", F.sum(F.col("_gap") + F.col("_len")).over(so_far)).where("_keep OR _kind < 0")
    name = F.get(F.array(*[F.lit(n) for n in kinds]), F.when(kind >= 0, kind))
    return rows.select("_id", "_mark", "_kind", "_times", name.alias("kind"), (F.col("_end") - F.col("_len")).alias("start"), F.col("_end").alias("end"))


def secret_spans(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, mark, kind, start, end`` of every span; positions in code points.

    ``mark`` is a hash of the text, which tells apart rows that share an id.
    """
    return _spans(docs, id, text).where("_kind >= 0").select(F.col("_id").alias(id), F.col("_mark").alias("mark"), "kind", "start", "end")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and digest, and all spans, of every document."""
    spans = _spans(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    item = F.struct("start", "_kind", F.concat_ws(":", "kind", "start", "end").alias("s"))
    base = F.col("_kind").between(0, len(KINDS) - 1)
    joined = lambda c: F.array_join(F.transform(F.sort_array(c), lambda x: x["s"]), ",")
    per_doc = spans.groupBy("_id", "_mark").agg(
        *[F.count_if(F.col("_kind") == k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(F.encode(joined(F.collect_list(F.when(base, item))), "UTF-8"), 256).alias("base_sha256"),
        joined(F.collect_list(F.when(F.col("_kind") >= 0, item))).alias("spans"),
        F.max(F.when(F.col("_kind") < 0, F.col("_times"))).alias("times"),
    )
    per_row = per_doc.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return per_row.select(F.col("_id").alias("doc_id"), *[F.col(f"n_{name}").cast("long").alias(f"n_{name}") for name in KINDS], "base_sha256", "spans")
