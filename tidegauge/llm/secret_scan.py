"""Secret scans with multipart credential linking.

Strong patterns (assignments, access identifiers, long hexadecimal strings) are reported
wherever they match. Weak ones (account names, mixed tokens, endpoints) are everywhere, and
are reported only when complementary parts of a credential co-occur in their scope: an
interval join widens every weak part by the scope and matches it with the parts of the other
groups (identifier, secret, endpoint) that touch the widened interval. The join is an
equi-join on (document, cell of scope length) and then the exact bounds. Parts of one kind
don't overlap and have a least length, so a cell holds few parts, however long the document
and however many parts it has.

Matching is by Spark's regular expressions over whole texts: the pieces between matches and
the matches give every position, in code points. Running sums over the pieces are a window
over one document's matches. Documents get a number in a narrow stored table, so null and
repeated identifiers and equal texts need no care.

Null and empty texts have no spans. Columns other than those named pass through ``scan``
untouched; ``n_*``, ``spans``, ``base_spans`` replace columns of these names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.llm.base import materialize, packed, query, table, unpacked

# Code points between two parts of one credential.
SCOPE = 200


@dataclass(frozen=True)
class Kind:
    """A pattern; ``least`` bounds group 2 (or the match) after matching, ``guard`` is a cheap test before."""

    name: str
    group: str
    pattern: str
    strong: bool
    guard: str
    least: int = 0


_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
# The three strong kinds, in the order in which they are listed. A run of one
# character class that is too short can be left out by the pattern itself; an assignment
# that is too short still takes its text, so it is dropped after matching.
KINDS = (
    Kind("assign", "secret",
         r"(?i)(password|passwd|secret|token|api_?key)" + _VALUE + "([A-Za-z0-9+/_.=-]+)", True,
         "rlike(text, '[:=]')", 8),
    Kind("access", "identifier", "AKIA[A-Z0-9]{12,}", True, "contains(text, 'AKIA')"),
    Kind("hex", "secret", "(?<![0-9a-f])[0-9a-f]{32,}", True, "rlike(text, '[0-9a-f]{32}')"),
    Kind("account", "identifier",
         r"(?i)(?:client|tenant|account|user|access)[_-]?(?:id|name)" + _VALUE + "[A-Za-z0-9@+/_.=-]{4,}", False,
         "rlike(text, '[:=]')"),
    Kind("mixed", "secret",
         "(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])"
         "[A-Za-z0-9+/_-]{20,}", False, "rlike(text, '[A-Za-z0-9+/_-]{20}')"),
    Kind("endpoint", "endpoint",
         r"""(?i)(?:https?|ftp|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\x20\x09-\x0D"'<>]+""",
         False, "contains(text, '://')"),
)


def _pieces(kind: Kind):
    """Lengths of the text before each match and of the match, and whether the match counts."""
    pattern = F.lit(kind.pattern)
    found = F.regexp_extract_all("text", pattern, F.lit(0))
    gaps = F.transform(F.split("text", kind.pattern, -1), lambda x: F.char_length(x))
    lengths = F.transform(found, lambda x: F.char_length(x))
    if kind.least:
        values = F.transform(F.regexp_extract_all("text", pattern, F.lit(2)), lambda x: F.char_length(x))
        counts = F.transform(values, lambda n: n >= kind.least)
    else:
        counts = F.transform(found, lambda x: F.lit(True))
    pieces = F.arrays_zip(gaps.alias("gap"), lengths.alias("len"), counts.alias("ok"))
    none = F.lit(None).cast("array<struct<gap:int,len:int,ok:boolean>>")
    return F.when(F.expr(kind.guard) & F.col("text").rlike(kind.pattern), pieces).otherwise(none)


def _parts(numbered: DataFrame, kind: Kind, order: int) -> DataFrame:
    """Every counted match: document number, kind and its place, start and end."""
    own = numbered.where(F.col(kind.name).isNotNull()).select("row", F.posexplode(kind.name).alias("at", "piece"))
    upto = W.partitionBy("row").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    gap, length = F.col("piece")["gap"].cast("long"), F.coalesce(F.col("piece")["len"], F.lit(0)).cast("long")
    ends = own.select("row", "piece", F.sum(gap + length).over(upto).alias("end"))
    return ends.where("piece.ok").select(
        "row", F.lit(order).alias("kind"), (F.col("end") - length).alias("start"), "end"
    )


def _linked(parts: DataFrame, scope: int) -> DataFrame:
    """The weak parts that share a scope with a part of another group, and lie in no other part."""
    names = [k.group for k in KINDS]
    group = F.element_at(F.array(*map(F.lit, names)), F.col("kind") + 1)
    cells = lambda a, b: F.explode(F.sequence(F.expr(f"{a} div {scope}"), F.expr(f"{b} div {scope}")))
    weak_kinds = [i for i, k in enumerate(KINDS) if not k.strong]
    weak = parts.where(F.col("kind").isin(weak_kinds)).withColumn("group", group).withColumn(
        "cell", cells(f"greatest(start - {scope}, 0L)", f"(end + {scope})")
    )
    other = parts.select(
        "row", F.col("kind").alias("kind2"), F.col("start").alias("start2"), F.col("end").alias("end2"),
        group.alias("group2"), cells("start", "end").alias("cell"),
    )
    near = weak.join(other, ["row", "cell"]).where(
        (F.col("start2") <= F.col("end") + scope) & (F.col("end2") >= F.col("start") - scope)
        & (F.col("kind") != F.col("kind2"))
    )
    mixed = [k.name for k in KINDS].index("mixed")
    inside = (F.col("kind") == mixed) & (F.col("start2") < F.col("end")) & (F.col("end2") > F.col("start"))
    complements = (F.col("group") != F.col("group2")) & (
        (F.col("group") == "secret") | (F.col("group2") == "secret")
    )
    return (
        near.groupBy("row", "kind", "start", "end")
        .agg(F.max(complements).alias("linked"), F.max(inside).alias("inside"))
        .where("linked AND NOT inside").drop("linked", "inside")
    )


def _text(spans: str):
    """``kind:start:end`` of sorted spans, joined by commas."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
    return F.array_join(F.transform(spans, one), ",")


def scan(df: DataFrame, text: str = "text", scope: int = SCOPE, keep: list[str] | None = None) -> DataFrame:
    """Add ``spans`` and ``base_spans``, arrays of (start, kind, end, before) by start, then kind.

    ``kind`` counts in ``KINDS``. Positions are code points, ends exclusive; ``before`` is the
    furthest end of the spans before. ``keep`` names the columns wanted, else all: what is
    not kept is not stored.
    """
    added = ("spans", "base_spans")
    kept = [c for c in (keep or df.columns) if c not in added]
    own = df.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("kept"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    )
    numbered = materialize(
        own.select(F.monotonically_increasing_id().alias("row"), "kept", *[_pieces(k).alias(k.name) for k in KINDS]),
        "matches",
    )
    parts = _parts(numbered, KINDS[0], 0)
    for order, kind in enumerate(KINDS[1:], 1):
        parts = parts.unionByName(_parts(numbered, kind, order))
    parts = materialize(parts, "parts")
    strong = [i for i, k in enumerate(KINDS) if k.strong]
    reported = parts.where(F.col("kind").isin(strong)).unionByName(_linked(parts, scope))
    earlier = W.partitionBy("row").orderBy("start", "kind").rowsBetween(W.unboundedPreceding, -1)
    reported = reported.withColumn("before", F.coalesce(F.max("end").over(earlier), F.lit(0)))
    spans = reported.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end", "before"))).alias("spans")
    )
    none = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint,before:bigint>>)")
    joined = numbered.select("row", "kept").join(spans, "row", "left")
    spans = F.coalesce("spans", none)
    return joined.select(
        "kept.*", spans.alias("spans"), F.filter(spans, lambda s: s["kind"].isin(strong)).alias("base_spans")
    )


def redact(df: DataFrame, text: str = "text", mask: str = "[secret]", scope: int = SCOPE) -> DataFrame:
    """Replace every reported span of ``text`` by ``mask``; overlapping spans by one.

    Null texts stay null. All columns are kept.
    """
    done = scan(packed(df, text), text, scope)
    # The text between a span and the furthest end before it, then the mask; the rest at the end.
    piece = f"concat(substr(`{text}`, cast(s.before + 1 as int), cast(s.start - s.before as int)), '{mask}')"
    walk = F.expr(
        f"""concat(array_join(transform(spans, s -> if(s.start > s.before OR s.before = 0, {piece}, '')), ''),
            substr(`{text}`, cast(array_max(transform(spans, s -> s.end)) + 1 as int)))"""
    )
    redacted = F.when(F.size("spans") > 0, walk).otherwise(F.col(f"`{text}`"))
    return unpacked(done.withColumn(text, redacted), df.columns, text)


@query("op4_credential_links")
def _secrets(spark, folder):
    """Strong spans of every document, and weak ones whose complement is near."""
    found = scan(table(spark, folder, "documents"), keep=["doc_id"])
    counts = [
        F.expr(f"cast(size(filter(spans, s -> s.kind = {i})) AS bigint) AS n_{k.name}")
        for i, k in enumerate(KINDS)
        if k.strong
    ]
    return found.select(
        "doc_id", *counts, F.sha2(_text("base_spans"), 256).alias("base_sha256"), _text("spans").alias("spans")
    )
