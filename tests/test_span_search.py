"""Spans found by tokens: against a plain search, and on a page of many words and citations."""

from __future__ import annotations

import random
import re
import time

from deedflow.operators import evidence

GAPS = [" ", "  ", "\n", " ", " \t", " ​ ", " "]


def plain(page: str, span: str):  # noqa: ANN201
    """Every token tried in turn."""
    drop = lambda t: re.sub(f"[{evidence.ZERO_WIDTH}]", "", t)
    cut = [m for m in re.finditer(f"[^{evidence.WHITE}]+", page) if drop(m.group())]
    want = [drop(t) for t in re.split(f"[{evidence.WHITE}]+", span) if drop(t)]
    for i in range(len(cut) - len(want) + 1):
        if want and [drop(m.group()) for m in cut[i : i + len(want)]] == want:
            first, last = cut[i], cut[i + len(want) - 1]
            lead = len(first.group()) - len(first.group().lstrip(evidence.ZERO_WIDTH))
            trail = len(last.group()) - len(last.group().rstrip(evidence.ZERO_WIDTH))
            return first.start() + lead, last.end() - trail
    return None


def test_places_are_those_of_a_plain_search():
    draw = random.Random(2)
    word = lambda: draw.choice(["a", "b", "​c", "d‌", "e﻿f", "‍", "é", "aa"])
    text = lambda n: "".join(word() + draw.choice(GAPS) for _ in range(n))
    hits = 0
    for _ in range(300):
        page = text(draw.randrange(0, 30))
        spans = [text(draw.randrange(0, 4)) for _ in range(8)] + [page[draw.randrange(0, len(page) + 1) :]]
        found = evidence.places(page, spans)
        assert found == [plain(page, s) for s in spans]
        hits += sum(f is not None for f in found)
    assert hits > 300


def test_a_long_page_with_many_citations(spark):
    draw = random.Random(4)
    words = [f"w{draw.randrange(5000)}" for _ in range(50_000)]
    page = "\n".join(words)
    starts = [draw.randrange(0, 49_000) for _ in range(1000)]
    spans = [" ".join(words[i : i + 3 + i % 40]) for i in starts]
    pages = spark.createDataFrame([(1, 1, page), (2, 1, "only this page")], "document_id int, page_number int, text string")
    claims = spark.createDataFrame([(1, k, 1, 1, s) for k, s in enumerate(spans)] + [(2, 5000, 1, 1, "only  this"), (2, 5001, 1, 1, "not this"), (2, 5002, 1, 1, "only this"), (1, 5003, 1, 1, "w1 zzz")], "document_id int, k int, page_start int, page_end int, source_span string")
    began = time.time()
    found = {r.k: r for r in evidence.resolve(claims, pages).collect()}
    assert time.time() - began < 60
    text = {1: page, 2: "only this page"}
    for k, s in enumerate(spans):
        r = found[k]
        assert r.validation_status == "VALID" and text[1][r.char_start : r.char_end].split() == s.split()
    assert (found[5000].match_type, found[5001].reason, found[5002].match_type, found[5003].reason) == ("normalized_whitespace", "SPAN_NOT_FOUND_ON_PAGE", "exact", "SPAN_NOT_FOUND_ON_PAGE")


def test_only_likely_spans_are_looked_up(spark, monkeypatch):
    """A span that is nowhere on its page goes to no Python task; one that differs in white space and zero-width characters does."""
    asked, whole = [], evidence.tolerant
    monkeypatch.setattr(evidence, "tolerant", lambda missed, texts: asked.extend(r.span for r in missed.collect()) or whole(missed, texts))
    pages = spark.createDataFrame([(1, 1, "Buyer shall pay​ now. End")], "document_id long, page_number int, text string")
    rows = [(1, "party", i, "x", 1, 1, s, None) for i, s in enumerate(["shall pay now.", "not there", "Buyer shall"])]
    kinds = "document_id long, claim_type string, ordinal int, claim_text string, page_start int, page_end int, source_span string, section string"
    found = {r.source_span: (r.match_type, r.reason) for r in evidence.resolve(spark.createDataFrame(rows, kinds), pages).collect()}
    assert asked == ["shall pay now."]
    assert found == {"shall pay now.": ("normalized_whitespace", None), "not there": ("unmatched", "SPAN_NOT_FOUND_ON_PAGE"), "Buyer shall": ("exact", None)}
