"""Packing and mixing against direct computations."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("graphloom.llm")
from graphloom.llm import mixing, packing  # noqa: E402

HAS_TOKENIZER = True
try:
    packing.default_tokenizer()
except ImportError:
    HAS_TOKENIZER = False


def _check_plan(counts, capacity):
    rows = packing.plan(counts, capacity)
    seen, space = defaultdict(set), defaultdict(list)
    for length, a, b, first, offset in rows:
        for k in range(a, b):
            assert k not in seen[length]
            seen[length].add(k)
            space[first + k - a].append((offset, length))
    assert {k: len(v) for k, v in seen.items()} == {k: v for k, v in counts.items() if v}
    for parts in space.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(space)


@pytest.mark.parametrize("seed", range(12))
def test_plans_are_gapless_and_tight(seed):
    rng = random.Random(seed)
    capacity = rng.choice([16, 64, 300])
    counts = Counter(min(capacity, max(1, int(rng.expovariate(4 / capacity)))) for _ in range(rng.randint(1, 900)))
    used = _check_plan(dict(counts), capacity)
    least = -(-sum(k * v for k, v in counts.items()) // capacity)
    assert least <= used <= least + max(2, 0.03 * least)


def test_plans_of_odd_histograms():
    assert _check_plan({}, 8) == 0
    assert _check_plan({8: 3}, 8) == 3
    assert _check_plan({5: 4}, 8) == 4
    assert _check_plan({3: 9}, 8) == 5
    assert _check_plan({4: 3}, 8) == 2
    assert _check_plan({6: 2, 1: 4}, 8) == 2
    assert len(packing.plan({k: 10**6 for k in range(1, 4097)}, 4096)) < 60_000


@pytest.mark.skipif(not HAS_TOKENIZER, reason="no tokenizer files")
def test_pieces_and_places(spark):
    from tokenizers import Tokenizer

    rng = random.Random(0)
    texts = ["", None, "  \n", "Hello, World's 42 things", "naïve café é  x y", "<|endoftext|> a", "İstanbul ΣΑΣ", "a\x0bb\x1cc", "word " * 9000]
    texts += [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(rng.randint(1, 1500))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(3, texts[3], 7), (None, "x", 7)], "doc_id long, text string, length int")
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = {}
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for p in range(-(-len(ids) // 4096)):
            part = ids[p * 4096 : (p + 1) * 4096]
            want[i, p] = (p * 4096, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()))
    rows = packing.pack_documents(docs).collect()
    assert len(rows) == len(want) + 2
    for r in rows:
        if r["doc_id"] is not None:
            assert (r["start"], r["length"], r["ids_crc32"]) == want[r["doc_id"], r["piece"]]
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        assert [o for o, _ in sorted(parts)] == list(np.cumsum([0, *[n for _, n in sorted(parts)]])[:-1])
        assert sum(n for _, n in parts) <= 4096
    assert len(by_sequence) <= -(-sum(r["length"] for r in rows) // 4096) + 1
    assert packing.pack_documents(docs.limit(0)).count() == 0
    placed = packing.pack(packing.tokenize(docs, with_ids=True).cache())
    whole = packing.sequences(placed).collect()
    assert sum(len(r["ids"]) for r in whole) == sum(r["length"] for r in rows)


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, size string")


def _mixed_rows():
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 90), f"s{int(rng.random() ** 3 * 7)}", 1, "clash") for i in range(800)]
    return rows + [(900, None, "s1", 1, "x"), (901, "", None, 1, "x"), (902, "a b\tc\x0bd é", None, 1, "x"), (903, "a b c", "é", 1, "x"), (903, "a b c", "é", 1, "x"), (None, "q r", "s2", 1, "x")]


def test_mix(spark):
    rows = _mixed_rows()
    words = lambda t: len([x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x])
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += words(r[1])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, free, room = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        level = room / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            room -= target[s]
            free.discard(s)
    target |= {s: level * weight[s] for s in free}
    got = mixing.mix_sizes(_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    source = {r[0]: r[2] for r in rows}
    taken = defaultdict(int)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.51 for s in order)
    again = mixing.mix_sizes(_docs(spark, rows[::-1]).repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix_sizes(_docs(spark, [])).count() == 0


def test_mixed_documents(spark):
    rows = _mixed_rows()
    words = lambda t: len([x for x in (t or "").replace("\t", " ").replace("\x0b", " ").split(" ") if x])
    docs = _docs(spark, rows)
    taken = {}
    for r in mixing.mix_sizes(docs).collect():
        taken.setdefault(r["doc_id"], []).append(r["taken"])
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    got = defaultdict(int)
    assert {r["size"] for r in out.collect()} == {"clash", "x"}
    for r in out.collect():
        got[r["doc_id"]] += words(r["text"])
    assert {k: v for k, v in got.items() if v} == {k: sum(v) for k, v in taken.items() if sum(v)}


def test_ticket_is_seeded(spark):
    row = spark.range(3, 4).selectExpr("id as doc_id")
    assert row.select(mixing.ticket(row.doc_id, "s")).first()[0] == hashlib.md5(b"s:3").hexdigest()


@pytest.mark.skipif(not HAS_TOKENIZER, reason="no tokenizer")
def test_new_words_are_encoded_a_few_thousand_at_a_time():
    known = packing._Known(packing.default_tokenizer())
    real, sizes = known.tokenizer, []

    class Counting:
        def encode_batch_fast(self, words, **options):
            sizes.append(len(words))
            return real.encode_batch_fast(words, **options)

    known.tokenizer = Counting()
    words = [f"w{k}x" for k in range(20_000)]
    numbers = known.numbered(words)
    assert sum(sizes) == len(words) and max(sizes) <= 4096
    for k in (0, 4095, 4096, 19_999):
        first = int(known.sizes[: numbers[k]].sum())
        assert known.ids[first : first + known.sizes[numbers[k]]].tolist() == real.encode(words[k], add_special_tokens=False).ids
