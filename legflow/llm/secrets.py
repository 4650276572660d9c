"""Secret scans: strong patterns, and weak candidates reported only where complementary parts meet.

DataFrame functions only.  Positions are code points, end exclusive; they
come from the lengths of the pieces between matches, so no position function
is called per match.

Strong kinds (always reported): ``assign``, ``access``, ``hex``.  Weak parts
prove nothing alone:

* ``weak_key``: a word of 40 or more characters of the base64 alphabet with
  lower case, upper case and digits (the form of a secret key without its name);
* ``weak_host``: a URL of http, https or a database scheme;
* ``weak_id``: a name for an account or client, such as ``client_id=...``.

A weak part is reported, as ``linked_key``, ``linked_host`` or
``linked_id``, when its scope (at most ``SCOPE`` characters between the end of
one part and the start of the other) also holds an identifier (``access`` or ``weak_id``), a secret (``assign``,
``hex`` or ``weak_key``) and an endpoint (``weak_host``), the part itself
counting as one of them.  The scope join is an interval join: parts are
keyed by text and by the ``SCOPE``-wide bins that they touch, looked up in
these bins and the two beside them, and compared by distance.  At most
SCOPE parts of a kind touch a bin, so the join is bounded by bin, not by text.

Nulls count as empty; empty texts have no spans.  Spans are a function of the
text, so repeated texts are linked once and every row gets its result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legflow.llm.shared import cut, text_key

SCOPE = 300
RUN = 256
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A shorter match of AKIA[A-Z0-9]+ or [0-9a-f]+ fails as a whole run, so the matches that are left are the long runs.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KEY = r"(?<![A-Za-z0-9+/=])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[0-9])[A-Za-z0-9+/]{40,}={0,2}(?![A-Za-z0-9+/=])"
HOST = r"\b(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+"
IDENTIFIER = r"(?i:client_?id|account_?id|user_?name|access_?key_?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@-]{4,}"

#: Spans (about 40 bytes each) that a join may send to every executor.
BROADCAST_SPANS = 300_000

KINDS = ["assign", "access", "hex", "linked_key", "linked_host", "linked_id"]
SPAN = "array<struct<start:bigint,end:bigint,kind:string>>"


def found(text: Column, pattern: str, kind: str, value: str | None = None, least: int = 0) -> Column:
    """Spans of all matches of ``pattern``; with ``value``, only those whose group 1 has ``least`` characters.

    Positions are running sums over (piece before, match) lengths.  They are
    summed in blocks of ``RUN`` matches, since an array that grows in a fold
    is copied at every step: a text of n matches takes about RUN * n steps.
    """
    between = F.transform(F.split(text, pattern, -1), F.length)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if value else matches
    rows = F.arrays_zip(between.alias("gap"), F.transform(matches, F.length).alias("size"), F.transform(group, F.length).alias("value"))
    empty = F.array().cast(SPAN)
    zero = F.lit(0).cast("bigint")

    def total(block):
        return F.aggregate(block, zero, lambda s, r: s + r["gap"] + F.coalesce(r["size"], F.lit(0)))

    def begin(state, size):
        return F.struct((state["at"] + size).alias("at"), F.concat(state["starts"], F.array(state["at"])).alias("starts"))

    def step(state, r):
        start = state["at"] + r["gap"]
        end = start + r["size"]
        span = F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind")))
        more = F.when(r["size"].isNotNull() & (r["value"] >= least), span).otherwise(empty)
        return F.struct(F.coalesce(end, state["at"]).alias("at"), F.concat(state["spans"], more).alias("spans"))

    def spans(block, at):
        return F.aggregate(block, F.struct(at.alias("at"), empty.alias("spans")), step, lambda s: s["spans"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / RUN).cast("int")), lambda b: F.slice(rows, b * RUN + 1, RUN))
    starts = F.aggregate(F.transform(blocks, total), F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("starts")), begin,
                         lambda s: s["starts"])
    return F.when(text.rlike(pattern), F.flatten(F.zip_with(blocks, starts, spans))).otherwise(empty)


def parts_of(text: Column) -> list[Column]:
    """Strong and weak spans of a text, each by start."""
    strong = F.concat(found(text, ASSIGN, "assign", "value", 8), found(text, ACCESS, "access"), found(text, HEX, "hex"))
    weak = F.concat(found(text, KEY, "weak_key"), found(text, HOST, "weak_host"), found(text, IDENTIFIER, "weak_id"))
    return [strong.alias("strong"), weak.alias("weak")]


ROLE = {"access": "identifier", "weak_id": "identifier", "assign": "secret", "hex": "secret", "weak_key": "secret",
        "weak_host": "endpoint"}


def linked(scan: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(k1, k2, links): weak spans whose scope holds an identifier, a secret and an endpoint."""
    texts = scan.filter(F.size("weak") > 0).groupBy("k1", "k2").agg(F.first("strong").alias("strong"), F.first("weak").alias("weak"))
    part = texts.select("k1", "k2", F.explode(F.concat("strong", "weak")).alias("p")).select("k1", "k2", "p.*")
    roles = F.create_map(*[F.lit(x) for kv in ROLE.items() for x in kv])
    low, high = F.floor(F.col("start") / scope), F.floor((F.col("end") - 1) / scope)
    part = cut(part.withColumn("role", roles[F.col("kind")]).withColumn("low", low).withColumn("high", high))
    weak = part.filter(F.col("kind").startswith("weak_"))
    near = weak.withColumn("bin", F.explode(F.sequence(F.col("low") - 1, F.col("high") + 1)))
    # one row for each role and place: parts of a role are interchangeable for the test
    other = part.select("k1", "k2", F.explode(F.sequence("low", "high")).alias("bin"), F.col("role").alias("other_role"),
                        F.col("start").alias("other_start"), F.col("end").alias("other_end")).distinct()
    gap = F.greatest(F.col("start") - F.col("other_end"), F.col("other_start") - F.col("end"))
    met = (near.join(other, ["k1", "k2", "bin"])
           .filter((F.col("role") != F.col("other_role")) & (gap <= scope))
           .groupBy("k1", "k2", "start", "end", "kind").agg(F.countDistinct("other_role").alias("n")).filter("n = 2"))
    span = F.struct("start", "end", F.regexp_replace("kind", "^weak_", "linked_").alias("kind"))
    return met.groupBy("k1", "k2").agg(F.collect_list(span).alias("links"))


def ordered(spans: Column) -> Column:
    """Spans by start, then kind as listed."""
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"),
                                                  s["kind"].alias("kind")))
    return F.array_sort(keyed)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def spans_of(docs: DataFrame, keep: list[str], scope: int = SCOPE) -> DataFrame:
    """``keep`` columns of every row with k1, k2, strong and links (both arrays of spans)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    scan = cut(docs.select(*keep, *text_key(), *parts_of(text)))
    return (scan.join(linked(scan, scope), ["k1", "k2"], "left")
            .select(*keep, "k1", "k2", "strong", F.coalesce("links", F.array().cast(SPAN)).alias("links")))


def secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked) for every row of ``docs``."""
    found_ = spans_of(docs, ["doc_id"], scope)
    count = lambda kind: F.size(F.filter("strong", lambda s: s["kind"] == kind)).cast("bigint")
    return found_.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(ordered(F.col("strong"))), 256).alias("base_sha256"),
        joined(ordered(F.concat("strong", "links"))).alias("spans"),
        F.size("links").cast("bigint").alias("n_linked"))


def redacted(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by ``[REDACTED]``; n_chars follows if it is there.

    Overlapping spans are replaced once.  Rows without spans keep their text
    (null stays null).
    """
    spans = spans_of(docs, [], scope).filter("size(strong) + size(links) > 0").groupBy("k1", "k2").agg(
        F.first(F.concat("strong", "links")).alias("__llm_spans"))
    spans = cut(spans.select(F.col("k1").alias("__llm_k1"), F.col("k2").alias("__llm_k2"), ordered(F.col("__llm_spans")).alias("__llm_spans")))
    # up to a counted number of spans they go to the texts; beyond it both are shuffled
    held = spans.agg(F.sum(F.size("__llm_spans") + 1)).head()[0] or 0
    k1, k2 = text_key()
    rows = docs.withColumns({"__llm_k1": k1, "__llm_k2": k2}).join(
        F.broadcast(spans) if held <= BROADCAST_SPANS else spans, ["__llm_k1", "__llm_k2"], "left")
    text = F.col("text")
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state, s):
        gap = F.when(s["start"] >= state["at"],
                     F.array(F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")), F.lit("[REDACTED]")))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"),
                        F.concat(state["parts"], F.coalesce(gap, F.array().cast("array<string>"))).alias("parts"))

    done = F.aggregate("__llm_spans", zero, step, lambda s: F.concat(
        F.array_join(s["parts"], ""), F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
    new = F.when(F.col("__llm_spans").isNull(), text).otherwise(done)
    rows = rows.withColumn("__llm_new", new)
    keep = []
    for c in docs.columns:
        if c == "text":
            keep.append(F.col("__llm_new").alias("text"))
        elif c == "n_chars":
            keep.append(F.when(F.col("__llm_spans").isNull(), F.col("n_chars"))
                        .otherwise(F.length("__llm_new").cast(docs.schema["n_chars"].dataType)).alias("n_chars"))
        else:
            keep.append(F.col(f"`{c}`"))
    return rows.select(*keep)
