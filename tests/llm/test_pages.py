"""Malformed pages, and the block field on makes of site that it was not fitted on."""

from __future__ import annotations

import random

import numpy as np
import pytest

pytest.importorskip("graphloom.llm")
from graphloom.llm import extraction, labelled_pages  # noqa: E402


@pytest.mark.parametrize(("page", "texts"), [
    ("<p>a</p><![foo[bar]]>", ["a"]), ("<![1", []), ("<!-- x <nav>menu", []), ('<p>a<div class="x', ["a"]), ("a < b", ["a < b"]),
    ("<script>if(a<b)</p></script>t", ["t"]), ("<p title='a>b'>q", ["q"]), ("<p>x<?php z?>w</>v", ["xwv"]), ("<script>never ends <p>x", []),
    ("<p hidden>x<p>y", ["y"]), ("<div style='color:red; display : none'>h<p>i</p></div>ok", ["ok"]), ("a&#0;&#99999999999;&amp;lt;", ["a��&lt;"]),
    ("<title>t</title><textarea><p>no</textarea>yes", ["yes"]),
])
def test_malformed(page, texts):
    assert [b.text for b in extraction.page_blocks(page)] == texts


def test_broken_pages_never_fail():
    rng = random.Random(3)
    bits = ["<!", "<![x[", "<!--", "<", "</", '"', "'>", "<p ", "&#x", "<!DOCTYPE [", ">", "<?", "<script>", "<textarea", "\0", "<a b='", "-->", "<p hidden>"]
    pages = [page[:900] for page in labelled_pages.rendered(each=2)]
    for _ in range(10_000):
        page = rng.choice(pages)
        for _ in range(rng.randint(1, 5)):
            i = rng.randrange(len(page) + 1)
            page = page[:i] + rng.choice(bits) + page[i + rng.randint(0, 20) :]
        for block in extraction.page_blocks(page):
            assert "</p" not in block.text
            assert "<div" not in block.text
            assert "<!--" not in block.text


def test_unseen_makes():
    """Every make is extracted by a field fitted on the others."""
    makes = list(labelled_pages.MAKES)
    scores = []
    for k in range(6):
        apart = makes[k::6]
        scores.append(extraction.agreement(extraction.fit([m for m in makes if m not in apart]), apart))
    precision, recall = np.mean(scores, axis=0)
    assert precision >= 0.95
    assert recall >= 0.9
    assert min(extraction.agreement(extraction.fit(), makes, 5)) >= 0.99
