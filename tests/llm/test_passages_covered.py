"""Passages whose first text is itself explained by another one: every word of a verbatim passage of 50 words goes, against all pairs of places."""

from __future__ import annotations

from deedflow.llm import passages


def invented(n: int, name: str) -> list[str]:
    return [f"{name}{k}" for k in range(n)]


def repeated_words(texts: list[list[str]], width: int = 50) -> list[set[int]]:
    """Words of every text that stand in a run of ``width`` words which an earlier text has."""
    seen: set[tuple[str, ...]] = set()
    out = []
    for t in texts:
        runs = [tuple(t[k : k + width]) for k in range(len(t) - width + 1)]
        out.append({k + i for k, r in enumerate(runs) if r in seen for i in range(width)})
        seen.update(runs)
    return out


def kept_words(spark, texts: list[list[str]]) -> dict[int, list[str]]:
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: r.text.split() for r in passages.without_repeats(docs).collect()}


def all_cut(spark, texts: list[list[str]]) -> None:
    kept = kept_words(spark, texts)
    for i, (t, gone) in enumerate(zip(texts, repeated_words(texts), strict=True)):
        assert not {t[k] for k in gone} & set(kept[i]), i


def test_a_near_copy_of_an_earlier_text_still_gives_its_verbatim_passages(spark):
    """C is near A as a whole but not in the passage that B has of C."""
    texts = []
    for k in range(8):
        p = invented(60, f"p{k}.")
        other = [*p[:20], f"x{k}", *p[21:40], f"y{k}", *p[41:]]
        head, tail = invented(120, f"h{k}."), invented(120, f"t{k}.")
        texts += [[*head, *other, *tail], [*head, *p, *tail], [*invented(40, f"b{k}."), *p, *invented(40, f"c{k}.")]]
    all_cut(spark, texts)


def test_a_passage_that_goes_on_in_a_later_text_is_cut_to_its_end(spark):
    """B shares 50 words with A and 75, with these among them, with C."""
    texts = []
    for k in range(8):
        p = invented(75, f"p{k}.")
        texts += [[*invented(40, f"{name}{k}."), *p[:n], *invented(40, f"{name}{k}-")] for name, n in (("a", 50), ("c", 75), ("b", 75))]
    all_cut(spark, texts)
