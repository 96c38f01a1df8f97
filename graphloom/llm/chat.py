"""Chat formatting by prefix-target expansion (DataFrame functions only).

A conversation becomes one formatted text, a marked segment per turn, held in
chunks of ``CHUNK_TURNS`` turns.  Every assistant turn is an example: its context
is the formatted text of all turns before it, [0, context_end), and only its reply,
[loss_start, loss_end), is trainable.  Contexts are prefixes of one text, so an
example holds its end and not a copy: n turns take n segments, not n*n/2.
:func:`render_examples` writes the copies out where a trainer wants them.

Template: ``<|role|>\\ntext<|end|>\\n``.  In texts ``&`` and ``<`` are written
``&amp;`` and ``&lt;`` (in roles ``>`` and ``|`` too), so no text can hold a mark,
and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK_TURNS = 64
END = "<|end|>\n"


def escape(x: Column, role: bool = False) -> Column:
    """Control characters as references; null is empty."""
    x = F.replace(F.coalesce(x, F.lit("")), F.lit("&"), F.lit("&amp;"))
    x = F.replace(x, F.lit("<"), F.lit("&lt;"))
    if role:
        x = F.replace(F.replace(x, F.lit(">"), F.lit("&gt;")), F.lit("|"), F.lit("&#124;"))
    return x


def unescape(x: Column) -> Column:
    """The inverse of :func:`escape`."""
    for mark, plain in (("&#124;", "|"), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")):
        x = F.replace(x, F.lit(mark), F.lit(plain))
    return x


def format_conversations(rows: DataFrame) -> DataFrame:
    """``conv_id, chunk, start, formatted, n_turns, examples`` from ``conv_id, turn, role, text``.

    ``start`` is the chunk's place in the conversation's text; ``examples`` has
    ``context_end, loss_start, loss_end`` (code points from the conversation's start)
    of each assistant turn.  Turns are ordered by turn, then role, then text; a null
    turn comes first; a null conv_id is one conversation; repeated rows are turns of
    their own; other columns are ignored.
    """
    turns = rows.select(
        "conv_id", F.coalesce(F.floor(F.col("turn") / CHUNK_TURNS), F.lit(-(2**62))).cast("long").alias("chunk"),
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    chunks = turns.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def segment(t: Column) -> Column:
        head = F.concat(F.lit("<|"), escape(t["role"], role=True), F.lit("|>\n"))
        return F.struct(
            (t["role"] == "assistant").alias("trained"), F.length(head).cast("long").alias("head"),
            F.concat(head, escape(t["text"]), F.lit(END)).alias("text"),
        )

    segments = chunks.select("conv_id", "chunk", F.transform("turns", segment).alias("segments"))
    empty = F.array().cast("array<struct<context_end:bigint,loss_start:bigint,loss_end:bigint>>")

    def step(acc: Column, s: Column) -> Column:
        end = acc["end"] + F.length(s["text"])
        one = F.struct(
            acc["end"].alias("context_end"), (acc["end"] + s["head"]).alias("loss_start"), (end - len(END)).alias("loss_end")
        )
        return F.struct(
            end.cast("long").alias("end"), F.when(s["trained"], F.concat(acc["examples"], F.array(one))).otherwise(acc["examples"]).alias("examples")
        )

    start = F.struct(F.lit(0).cast("long").alias("end"), empty.alias("examples"))
    local = segments.select(
        "conv_id", "chunk", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.size("segments").cast("long").alias("n_turns"), F.aggregate("segments", start, step).alias("walk"),
    )
    before = W.partitionBy("conv_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    placed = local.withColumn("start", F.coalesce(F.sum("walk.end").over(before), F.lit(0)))
    moved = F.transform(
        "walk.examples", lambda x: F.struct(*[(x[k] + F.col("start")).alias(k) for k in ("context_end", "loss_start", "loss_end")])
    )
    return placed.select("conv_id", "chunk", "start", "formatted", "n_turns", moved.alias("examples"))


def _with_targets() -> Column:
    """A chunk's examples, each with its reply, so that exploding them leaves the chunk's text behind."""

    def one(e: Column) -> Column:
        at, n = e["loss_start"] - F.col("start") + 1, e["loss_end"] - e["loss_start"]
        target = F.substring(F.col("formatted"), at.cast("int"), n.cast("int"))
        return F.struct(e["context_end"].alias("context_end"), e["loss_start"].alias("loss_start"), e["loss_end"].alias("loss_end"), target.alias("target"))

    return F.transform("examples", one)


def examples(chunks: DataFrame) -> DataFrame:
    """One row per assistant turn: ``conv_id, chunk, context_end, loss_start, loss_end, target``.

    ``target`` is the trainable reply as formatted; the context is the conversation's
    formatted text up to ``context_end``.
    """
    one = chunks.select("conv_id", "chunk", F.explode(_with_targets()).alias("e"))
    return one.select("conv_id", "chunk", "e.context_end", "e.loss_start", "e.loss_end", "e.target")


def render_examples(chunks: DataFrame) -> DataFrame:
    """Examples with their whole text: ``conv_id, context_end, text, loss_start, loss_end``.

    Writes every context out, so a conversation of n turns gives text of size n*n/2:
    for export of conversations of bounded length.
    """
    parts = chunks.select("conv_id", F.col("chunk").alias("of"), "formatted")
    rows = examples(chunks).alias("x").join(parts.alias("p"), F.col("x.conv_id").eqNullSafe(F.col("p.conv_id")) & (F.col("of") <= F.col("chunk")))
    keys = [F.col("x.conv_id").alias("conv_id"), "context_end", "loss_start", "loss_end"]
    whole = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("of", "formatted"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda x: x["formatted"]), "")
    return whole.select("conv_id", "context_end", F.substring(text, F.lit(1), F.col("loss_end").cast("int")).alias("text"), "loss_start", "loss_end")


def read_back(chunks: DataFrame) -> DataFrame:
    """Digests of what a reader of the formatted output gets, one row per conversation; the loss is read from the exploded examples."""

    def parsed(s: Column) -> Column:
        return F.struct(
            unescape(F.regexp_extract(s, r"^<\|([^<>|]*)\|>\n", 1)).alias("role"), unescape(F.regexp_replace(s, r"^<\|[^<>|]*\|>\n", "")).alias("text")
        )

    pieces = F.filter(F.split("formatted", r"<\|end\|>\n"), lambda s: s != "")
    turns = F.transform(pieces, parsed)
    seen = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    by_chunk = chunks.select(
        "conv_id", "chunk", F.size(pieces).cast("long").alias("n"), seen.alias("seen"), F.length("formatted").cast("long").alias("chars"),
        _with_targets().alias("examples"),
    )
    # a row per example; what belongs to the chunk is counted with its first
    rows = by_chunk.select("*", F.posexplode_outer("examples").alias("pos", "e"))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    part = F.struct("chunk", "pos", F.when(first, F.col("seen")).otherwise("").alias("seen"), F.coalesce(unescape(F.col("e.target")), F.lit("")).alias("loss"))
    whole = rows.groupBy("conv_id").agg(
        F.sum(F.when(first, F.col("n"))).alias("n_turns"), F.array_sort(F.collect_list(part)).alias("parts"), F.sum(F.when(first, F.col("chars"))).alias("formatted_chars")
    )
    joined = lambda k: F.array_join(F.transform("parts", lambda x: x[k]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(joined("seen"), 256).alias("turns_sha256"), F.length(joined("loss")).cast("long").alias("loss_chars"),
        F.sha2(joined("loss"), 256).alias("loss_sha256"), "formatted_chars",
    )
