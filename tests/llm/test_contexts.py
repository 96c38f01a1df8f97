"""Counts of places that no identifier fills, the filter of trusted ids, and results that do not hang on the size of the table."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("graphloom.llm")
from graphloom.llm import privacy, rules  # noqa: E402

TOKEN = re.compile(r"[^\s\"'()\[\]<>{}=]+")
LABEL = re.compile("[A-Za-z\x80-\U0010ffff][0-9A-Za-z_\x80-\U0010ffff]*[:#]")
BITS = ["foo", "bar_x", "é", "—", "name:", "x#", '"', "(", ". ", ", ", " ", "=", "12345678", "Zk9_secret-77", "a@b.cd", "+1 (212)", "\n", "日本:語", "_y:"]


def _plain(text):
    """Patterns of every token of a lowered text that is no identifier, place by place."""
    for m in TOKEN.finditer(text):
        start, stop = m.span()
        label = LABEL.match(text, start, stop)
        inner = end = label.end() if label else start
        end = inner + len(text[inner:stop].rstrip(privacy.TRAILING))
        if len(text[inner:end]) >= 6 and re.search("[0-9]", text[inner:end]):
            continue
        after = privacy._AFTER.match(text, end)
        for place in sorted({start, inner}):
            if place == stop or text[place] in "0123456789+":
                continue
            words = [w.start() for w in privacy._WORD.finditer(text) if w.start() < place][-3:][::-1]
            for k, w in enumerate(words):
                yield text[w:place] + privacy.SLOT
                if after and k < 2:
                    yield text[w:place] + privacy.SLOT + after.group()


@pytest.mark.parametrize("seed", range(3))
def test_unfilled_places_against_plain_search(seed):
    rng = random.Random(seed)
    lowered = [privacy._lowered("".join(rng.choices(BITS, k=rng.randint(0, 40)))) for _ in range(200)]
    want = Counter(p for t in lowered for p in _plain(t))
    codes = dict(zip(want, privacy.pattern_codes(list(want)).tolist(), strict=True))
    assert len(set(codes.values())) == len(want) > 500
    assert Counter(privacy.unfilled_codes(lowered).tolist()) == {codes[p]: n for p, n in want.items()}
    # texts do not reach into each other
    alone = Counter(c for t in lowered for c in privacy.unfilled_codes([t]).tolist())
    assert alone == Counter(privacy.unfilled_codes(lowered).tolist())


def test_unfilled_places_of_odd_texts():
    assert len(privacy.unfilled_codes([])) == len(privacy.unfilled_codes(["", " ", "..."])) == 0
    assert len(privacy.unfilled_codes(["word"])) == 0  # nothing stands before it
    assert len(privacy.unfilled_codes(["a b"])) == 1
    assert len(privacy.unfilled_codes(["x" * 3_000_000 + " b"])) == 1


def test_rare_contexts_are_learned_in_a_table_of_any_size(spark):
    """A context of three known numbers finds the fourth, whatever many others the table holds."""
    rng = random.Random(4)
    phone = lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    few = [f"my member line {phone()} please" for _ in range(3)] + ["my member line KT-4471-W please"]
    # links of 40,000 certain instances stand in other contexts
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(3000)]
    many = [" ".join(f"{rng.choice(words)} {rng.choice(words)} {phone()}" for _ in range(40)) for _ in range(1000)]
    found = []
    for texts in (few, few + many):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        rows = privacy.annotate(docs).filter("doc_id < 4").collect()
        found.append({r["text"][s["start"] : s["end"]] for r in rows for s in r["spans"] if s["kind"] == "ident"})
    assert found == [{"KT-4471-W"}] * 2


def test_trusted_rows_are_marked(spark):
    """The filter loses no trusted row, and the join behind it lets no other one through."""
    docs = spark.range(20_000).select("id", F.concat(F.lit("t"), "id").alias("text")).withColumn("doc_id", F.when(F.col("id") % 7 > 0, F.col("id"))).drop("id")
    docs = docs.unionByName(docs.filter("doc_id < 100"))
    trusted = spark.range(0, 30_000, 3).select(F.col("id").cast("int").alias("doc_id")).unionByName(spark.range(9).select(F.lit(None).cast("int").alias("doc_id")))
    got = Counter(map(tuple, rules.marked(docs, trusted).collect()))
    assert got == Counter((r["text"], int(r["doc_id"] is not None and r["doc_id"] % 3 == 0)) for r in docs.collect())
    assert not any(r["trusted"] for r in rules.marked(docs, trusted.limit(0)).collect())
    bits = rules.id_filter(trusted.filter("doc_id is not null")).first()["bits"]
    assert len(bits) == rules.FILTER_LONGS
    assert 9_900 <= sum((b & (2**64 - 1)).bit_count() for b in bits) <= 10_000
