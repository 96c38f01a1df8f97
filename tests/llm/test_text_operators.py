"""Rules, chat, privacy, extraction, line quality and the pipeline against direct computations."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("graphloom.llm")
from graphloom.llm import chat, crf, extraction, lines, privacy, rules  # noqa: E402

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def _words(t):
    return [x for x in SPACE.split(t or "") if x]


# rules ------------------------------------------------------------------------------------


def _rule_texts():
    rng = random.Random(3)
    vocabulary = ["the", "of", "and", *("".join(rng.choices("abcdef", k=5)) for _ in range(80))]
    good = [" ".join(rng.choices(vocabulary, k=rng.randint(50, 200))) for _ in range(60)]
    bad = [" ".join(w.upper() + "!!" for w in rng.choices(vocabulary, k=80)) for _ in range(20)]
    odd = [None, "", " \n\t", "a b c", "a b a b a b " * 20, "x\ny\nx\n \n\nx y\n" * 3, "#*$ %&|<>", "w " * 5000, "ä ö ü " * 30, good[0]]
    return good, bad, odd


def test_base_counts(spark):
    good, bad, odd = _rule_texts()
    texts = good + bad + odd
    docs = spark.createDataFrame([(i, t, 1, i, "r") for i, t in enumerate(texts)], "doc_id long, text string, score int, rules long, ratios string")
    trusted = spark.createDataFrame([(i,) for i in range(len(good))], "doc_id long")
    # a corpus of 10,000 words: the default strength is that of a target of 130,000
    rows = {r["doc_id"]: r for r in rules.quality_rules(docs, trusted, strength=1).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        t, w, r = t or "", _words(t), rows[i]
        assert (r["rules"], r["ratios"]) == (i, "r")
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        seen = Counter(windows)
        marked = {k + d for k, x in enumerate(windows) if seen[x] > 1 for d in range(3)}
        rows_with_words = [x for x in t.split("\n") if _words(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(rows_with_words) - len(set(rows_with_words)), len(marked))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, t[:50]
        assert r["base_failed"] == (len(w) < 50 or 100 * len(marked) > 50 * len(w))
    assert all(rows[i]["kept"] for i in range(len(good)) if not rows[i]["base_failed"])
    assert not any(rows[len(good) + i]["kept"] for i in range(len(bad)))


def test_ratio_by_hand(spark):
    texts = {1: "a b a", 2: "b c", 3: "a b c", 4: "c c a", 5: "b a", 6: "a b a", 7: "c", 8: "b b c a"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").union(spark.createDataFrame([(None, "b a")], "doc_id long, text string"))
    trusted = spark.createDataFrame([(1,), (3,), (5,), (5,), (None,)], "doc_id long")
    fold = {r["text"]: r["k"] for r in docs.select("text", rules.fold_of(F.col("text")).alias("k")).collect()}
    assert len(set(fold.values())) > 1

    def grams(t):
        w = t.split()
        return [(x,) for x in w] + list(zip(w, w[1:]))

    def score(t):
        raw = Counter(g for x in [*texts.values(), "b a"] if fold[x] != fold[t] for g in grams(x))
        target = Counter(g for i in (1, 3, 5) if fold[texts[i]] != fold[t] for g in grams(texts[i]))
        prior = rules.STRENGTH * rules.BUCKETS
        share = lambda g: (raw[g] + 1) / (raw.total() + rules.BUCKETS)
        return sum(math.log((target[g] + prior * share(g)) / (target.total() + prior)) - math.log(share(g)) for g in grams(t)) / len(grams(t))

    for r in rules.quality_rules(docs, trusted).collect():
        assert r["score"] == pytest.approx(score(r["text"]), rel=1e-6, abs=1e-12)
    assert {r["score"] for r in rules.quality_rules(docs, trusted.limit(0)).collect()} == {0.0}
    assert rules.quality_rules(docs.limit(0), trusted.limit(0)).count() == 0


# chat -------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|end|>\n", "&lt;|user|&gt;", "<|assistant|>\nhi<|end|>\n", "", None, "a\n\nb", "\U0001f600 é", "&amp;amp;"]
    rows = [(c, t, ["user", "assistant", "system", None, "a|>b"][(c + t) % 5], nasty[(c * 3 + t) % len(nasty)], "x") for c in range(6) for t in range(c * 40)]
    rows += [(None, 1, "assistant", "n", "x"), (7, None, "user", "first", "x"), (7, 0, "assistant", "same", "x"), (7, 0, "assistant", "same", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chunk string")
    chunks = chat.format_conversations(df).cache()
    got = {r["conv_id"]: r for r in chat.read_back(chunks).collect()}
    by = {}
    for c, t, role, text, _ in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        seen = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(seen.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.examples(chunks).count() == sum(r[2] == "assistant" for r in rows)
    full = {c: "".join(r["formatted"] for r in chunks.filter(F.col("conv_id").eqNullSafe(F.lit(c))).orderBy("chunk").collect()) for c in (2, 7)}
    for r in chat.render_examples(chunks.filter("conv_id in (2, 7)")).collect():
        assert r["text"] == full[r["conv_id"]][: r["loss_end"]]
        assert r["text"][: r["loss_start"]].endswith("<|assistant|>\n")
        assert "<" not in r["text"][r["loss_start"] :]
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


# privacy ----------------------------------------------------------------------------------


def _plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0

    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], privacy.KINDS.index(s[0])))


def test_base_spans_against_the_plain_patterns():
    rng = random.Random(8)
    bits = ["a@b.c", "x.y@mail.example.com", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-0100", "+", "é", " ", "-", "007", "12345678901234567890", "a@b", "@@", "%+", "\n", "٣"]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 12)))
        assert privacy.base_spans(text) == _plain_spans(text), text
    assert privacy.base_spans("a" * 200_000 + "@") == []
    assert privacy.base_spans("1" * 200_000) == []


def test_contexts_find_unknown_identifiers(spark):
    rng = random.Random(2)
    key = lambda: "".join(rng.choices("0123456789abcdef", k=40))
    texts = [f'words token = "{key()}" words' for _ in range(12)] + ['say token = "Zk9_secret-77" now'] + [f"name: value{k}x" for k in range(20)] + ["mail a@b.cd x", "", None, "name: a1b2c3d4"]
    docs = spark.createDataFrame([(i, t, [1], "p", i) for i, t in enumerate(texts)], "doc_id long, text string, spans array<int>, places string, row_id long")
    found = privacy.annotate(docs).cache()
    rows = {r["doc_id"]: r for r in found.collect()}
    assert len(rows) == len(texts)
    assert all((r["places"], r["row_id"]) == ("p", i) for i, r in rows.items())
    assert [(s["kind"], texts[12][s["start"] : s["end"]]) for s in rows[12]["spans"]] == [("ident", "Zk9_secret-77")]
    assert not any(rows[i]["spans"] for i in range(13, 33))
    assert [tuple(s) for s in rows[33]["spans"]] == [("email", 5, 11)]
    masked = {r["doc_id"]: r["m"] for r in found.select("doc_id", privacy.masked("text", "spans").alias("m")).collect()}
    assert masked[33] == "mail [EMAIL] x"
    assert masked[12] == 'say token = "[IDENT]" now'
    assert (masked[34], masked[35]) == ("", None)
    digest = found.filter("doc_id = 33").select(F.sha2(privacy.joined_spans("base"), 256)).first()[0]
    assert digest == privacy.spans_digest([("email", 5, 11)])
    assert privacy.annotate(docs.limit(0)).count() == 0


def test_contexts_without_delimiters(spark):
    """Patterns of words alone are induced; common words in front of a seed are none; found instances induce more patterns."""
    rng = random.Random(6)
    phone = lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    texts = [f"so please call me at {phone()} today" for _ in range(24)] + ["or call me at ZX-99817-Q today"]
    # a number of unseen form that is known from above stands behind new words, three of them
    texts += [f"call me at QA-7{k}4-R now" for k in range(4)] + [f"member code is QA-7{k}4-R then" for k in range(4)] + ["member code is LM-5501-T then"]
    texts += ["we looked at 2000km of road", "they met at 10:30:00 there", *["it was at home in the code is law"] * 40, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: {texts[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "ident"} for r in privacy.annotate(docs).collect()}
    want = {24: {"ZX-99817-Q"}, 33: {"LM-5501-T"}} | {25 + k + d: {f"QA-7{k}4-R"} for k in range(4) for d in (0, 4)}
    assert {i: f for i, f in found.items() if f} == want


@pytest.mark.parametrize("noise", [{"p": 1, "z": 1}, {"z": 1}])
def test_graph_by_hand(spark, noise):
    """All rounds of a small graph, in plain numbers."""
    rows = [*[("p", i, True) for i in "abcde"], ("p", "x", False), ("q", "a", True), ("q", "x", False), ("r", "x", False), ("r", "y", False)]
    score, trust = {}, {(p, i): float(c) for p, i, c in rows}
    for _ in range(3):
        for p in "pqr":
            own = [t for (k, _), t in trust.items() if k == p and t >= 0.8]
            score[p] = sum(own) / (sum(k == p for k, _ in trust) + noise.get(p, 0)) if own else 0.0
        trust = {(p, i): 1.0 if c else max(score[k] for k, j, _ in rows if j == i) for p, i, c in rows}
    edges = spark.createDataFrame(rows, "pattern string, instance string, certain boolean")
    got = {r["pattern"]: r["score"] for r in privacy.scored_patterns(edges, spark.createDataFrame(list(noise.items()), "pattern string, n long"), support=1, confident=0.8).collect()}
    assert got == pytest.approx(score)
    assert (score["q"] > 0.9) == ("p" not in noise)  # x is trusted through p alone
    assert (score["r"] > 0) == ("p" not in noise)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no tables")
def test_held_out_keys(spark):
    """Keys that begin with a letter are no seeds; their context finds them, and nothing else."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = privacy.annotate(docs, seed_keys="(?=[0-9])" + privacy._KEY.pattern).collect()
    found = {r["text"][s["start"] : s["end"]] for r in rows for s in r["spans"] if s["kind"] == "ident"}
    keys = {k for r in rows for k in re.findall(r"\b[0-9a-f]{40}\b", r["text"] or "")}
    assert any(k[0] in "abcdef" for k in keys)
    assert found == keys


# fields -----------------------------------------------------------------------------------


def test_field_against_enumeration():
    rng = np.random.default_rng(0)
    x, lengths = rng.normal(size=(14, 3)), np.array([5, 1, 4, 4])
    y = (x[:, 0] + rng.normal(scale=0.1, size=14) > 0).astype(int)
    model = crf.ChainCRF(2, steps=40).fit(x, y, lengths)
    e = model._scaled(x) @ model.emit
    got, path = model.marginals(x, lengths), model.decode(x, lengths)
    at = 0
    for n in lengths:
        weights = np.zeros((2,) * n)
        for labels in np.ndindex(*weights.shape):
            s = model.start[labels[0]] + sum(e[at + t, k] for t, k in enumerate(labels)) + sum(model.move[a, b] for a, b in zip(labels, labels[1:], strict=False))
            weights[labels] = s
        best = np.unravel_index(weights.argmax(), weights.shape)
        p = np.exp(weights - weights.max())
        p /= p.sum()
        for t in range(n):
            assert got[at + t, 1] == pytest.approx(p.take(1, axis=t).sum())
            assert path[at + t] == best[t]
        at += n


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<div class="ad">Buy this now.</div><article><h1>Head &amp; title</h1><p><b>First   para%(k)s.<br><p>Second&nbsp;one <i>in</i>line, long enough to be told from a menu.</p></article>
<footer>&copy; host</footer></body></html>"""


def test_extraction(spark):
    pages = [(k, f"u{k}", PAGE % {"k": k}, 3) for k in range(30)] + [(50, None, None, 3), (51, "u", "", 3), (52, "u", "<p></p><!-- x -->", 3), (53, "u", "<" * 2000, 3)]
    pages += [(54, "u", "<p>a</p><![foo[bar]]>", 3), (54, "u", "<p>a</p><![foo[bar]]>", 3), (None, "u", "<nav><a href=x>menu</a></nav>", 3)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text int")
    model = extraction.fit()
    rows = {r["page_id"]: r for r in extraction.extract(df, model).collect()}
    for k in range(30):
        assert rows[k]["text"] == f"Head & title First para{k}. Second one inline, long enough to be told from a menu."
        assert rows[k]["n_chars"] == len(rows[k]["text"])
    assert [rows[k]["text"] for k in (50, 51, 52)] == [""] * 3
    assert extraction.extract(df, model).count() == len(pages)
    assert extraction.extract(df.limit(0), model).count() == 0


def test_blocks():
    blocks = extraction.page_blocks("<div class='comment-list'>a<span>b</span> c<p>d<br>e</div><template>no</template>&eacute;&#x41;")
    assert [b.text for b in blocks] == ["ab c", "d", "e", "éA"]
    assert "comment" in blocks[0].marks
    assert not blocks[-1].marks


def test_line_quality(spark):
    good, bad, odd = _rule_texts()
    rng = random.Random(1)
    cut = lambda t: "\n".join(t[i : i + 90] for i in range(0, len(t), 90))
    rows = [(i, cut(t), 1) for i, t in enumerate(good)] + [(100 + i, cut(t), 0) for i, t in enumerate(bad)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 5.0) for i, t, _ in rows] + [(500 + i, t, 5.0) for i, t in enumerate(odd)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 4 != 2], "doc_id long, quality int")
    model = lines.fit(docs, labels)
    got = {r["doc_id"]: r for r in lines.score_documents(docs, model).collect()}
    assert len(got) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    held_out = [(i, y) for i, _, y in rows if i % 4 == 2]
    assert sum(got[i]["predicted"] == y for i, y in held_out) >= 0.95 * len(held_out)
    assert got[500]["score"] == got[501]["score"] == got[502]["score"]
    assert lines.score_documents(docs.limit(0), lines.fit(docs.limit(0), labels.limit(0))).count() == 0


def test_training_rows_of_repeated_ids(spark):
    # one text stands for a labelled id, however many rows repeat it and in whatever order
    rows = [(i, f"line {i} of prose. and more of it" if i % 2 else "WIN!! $$$ NOW!!") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    again = [(1, "zz later in order"), (2, "zz later in order")] * 50 + [(3, None)]
    plain = lines.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    repeated = lines.fit(spark.createDataFrame([*again, *rows], "doc_id long, text string"), labels)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scores = lambda m: [(r["doc_id"], r["score"]) for r in lines.score_documents(docs, m).orderBy("doc_id").collect()]
    assert scores(plain) == scores(repeated)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no tables")
def test_rules_keep_labelled_good_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = rules.quality_rules(docs.select("doc_id", "text"), labels.filter("quality = 1")).filter("not base_failed")
    shares = {r["quality"]: r["kept"] for r in judged.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert shares[1] >= 0.99 and shares[0] <= 0.6


# pipeline ---------------------------------------------------------------------------------

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="no tables")
def test_pipeline(spark):
    import corpus_pipeline
    from graphloom.llm import minhash, mixing

    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    assert len(corpus_pipeline.STAGES) == 5
    now, texts = docs, {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, step in corpus_pipeline.STAGES[:-1]:
        before, now = now, step(spark, now, SF).cache()
        assert now.columns == docs.columns, name
        if name == "quality rules":
            judged = rules.quality_rules(before, spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1"))
            assert {r["doc_id"] for r in now.collect()} == {r["doc_id"] for r in judged.filter("kept").collect()}
        if name == "MinHash near-dedup":
            ids = sorted(r["doc_id"] for r in now.collect())
            groups = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(before, percent=corpus_pipeline.NEAR_PERCENT).collect()}
            assert ids == sorted(set(groups.values()))
        if name == "PII":
            for r in now.collect():
                spans = privacy.base_spans(texts[r["doc_id"]])
                assert not spans or r["text"] != texts[r["doc_id"]]
                assert not any(k == "email" for k, _, _ in privacy.base_spans(r["text"]))
                assert r["n_chars"] == len(r["text"])
        if name == "mixing":
            words = sum(len(_words(r["text"])) for r in now.collect())
            assert words == mixing.mix_sizes(before).agg(F.sum("taken")).first()[0]
    placed = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert placed.filter("piece = 0").count() == now.count()
    run = corpus_pipeline.run(spark, SF)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, run.select(*columns).collect())) == sorted(map(tuple, placed.select(*columns).collect()))
