"""Operator 3: quality by weakly supervised rules, DataFrame functions only.

Rules look at cheap measures of a text; each votes good, votes bad, or abstains.
Votes are counted per pattern over all documents. Expectation-maximisation over
these counts estimates, without labels, how often each rule votes what and how
often it abstains in good and in bad texts: its accuracy. It starts from the
share of good votes, so that no rule alone decides, and the posterior probability
of quality replaces the demand that all rules pass: one bad vote of a weak rule is
outvoted, and several abstentions where good texts rarely have them count against
a text that fails nothing. Some rules are weak on purpose (line ends, short words,
punctuation): they disagree with the others in good texts too. Rules that look at
related measures are not independent, which drives posteriors to the ends, so a
text goes only where bad is nine times likelier than good.

Scale: one narrow pass measures whole texts inside their rows (no shuffle); the
measures are written once and read for counting and for the verdict. Pattern
counts are bounded by 3 to the number of rules (a few hundred in practice) and so is the join with their
posteriors, which is broadcast. The rounds of expectation-maximisation run inside
one row over the counted patterns.

Defined cases: null, empty and blank texts have no words and fail the base rule;
null ids and repeated rows are rows like others; other columns are not read; equal
patterns have equal posteriors; an empty table gives none; with one pattern only,
its posterior is what its votes begin with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, materialise

WINDOW = 8
#: Signs that a whole line ends with.
ENDS = ".!?…。！？\"”»')]"


def let(value: Column, body) -> Column:  # noqa: ANN001
    """``body`` of ``value``, evaluated once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words in 8-word windows that stand twice or more in the array, the first time included."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(sorted_pairs: Column) -> Column:
        # a window is repeated if its neighbour in hash order has the same hash
        m = F.size(sorted_pairs)
        same_next = F.zip_with(F.slice(sorted_pairs, 1, m - 1), F.slice(sorted_pairs, 2, m - 1), lambda a, b: a["h"] == b["h"])
        flags = F.zip_with(F.concat(F.array(F.lit(False)), same_next), F.concat(same_next, F.array(F.lit(False))), lambda a, b: a | b)
        marked = F.zip_with(sorted_pairs, flags, lambda p, f: F.when(f, p["i"]))
        places = F.sort_array(F.array_compact(marked))
        return let(places, gaps)

    def gaps(places: Column) -> Column:
        k = F.size(places)
        steps = F.zip_with(F.slice(places, 1, k - 1), F.slice(places, 2, k - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
        return F.when(k == 0, 0).otherwise(F.aggregate(steps, F.lit(WINDOW), lambda x, y: x + y))

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(pairs, covered))

    return F.when(n <= WINDOW, 0).otherwise(let(hashes, count)).cast("long")


def measured(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_distinct, n_short, n_repeat_words, n_symbols, n_lines, n_dup_lines, n_ended, upper_chars, letters, dots, marks) of every whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    body = F.btrim("text", F.lit(SEPARATORS))
    words = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SEPARATORS)) != "")
    measures = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            F.size(F.filter(w, lambda x: F.length(x) <= 3)).cast("long").alias("n_short"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    ended = lambda line: F.instr(F.lit(ENDS), F.right(F.btrim(line, F.lit(SEPARATORS)), F.lit(1))) > 0
    by_line = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(x, ended)).cast("long").alias("n_ended"),
        ),
    )
    only = lambda signs: F.length(F.regexp_replace("text", f"[^{signs}]+", "")).cast("long")
    return d.select(
        "doc_id",
        measures.alias("m"),
        by_line.alias("l"),
        only(r"#*$%&|<>").alias("n_symbols"),
        only("A-Z").alias("upper_chars"),
        only(r"\p{L}\p{N}").alias("letters"),
        (F.length("text") - F.length(F.replace("text", F.lit(".")))).cast("long").alias("dots"),
        only(r"\p{P}").alias("marks"),
    ).select("doc_id", "m.*", "l.*", "n_symbols", "upper_chars", "letters", "dots", "marks")


def rules() -> dict[str, tuple[Column, Column]]:
    """Name -> (votes bad, votes good); a rule abstains where neither holds."""
    n, chars = F.col("n_words"), F.greatest(F.col("word_chars"), F.lit(1))
    repeated, symbols, upper, letters, dots, distinct, duplicates = (F.col(c) for c in ("n_repeat_words", "n_symbols", "upper_chars", "letters", "dots", "n_distinct", "n_dup_lines"))
    lines, ended, short, marks = (F.col(c) for c in ("n_lines", "n_ended", "n_short", "marks"))
    return {
        "length": (n < 20, n >= 50),
        "symbols": (symbols > 0.05 * n, symbols <= 0.002 * n),
        "repeats": (repeated > 0.3 * n, repeated <= 0.01 * n),
        "lines": ((duplicates >= 3) & (duplicates > 0.1 * lines), (duplicates == 0) & (lines >= 3)),
        "case": (upper > 0.1 * chars, (upper >= 0.002 * chars) & (upper <= 0.05 * chars)),
        "letters": (letters < 0.9 * chars, letters >= 0.93 * chars),
        "word length": ((chars < 4.2 * n) | (chars > 6.2 * n), (chars >= 4.6 * n) & (chars <= 5.8 * n)),
        "vocabulary": ((distinct < 0.3 * n) & (n < 5000), distinct >= 0.5 * n),
        "sentences": ((dots < 0.03 * n) | (dots > 0.22 * n), (dots >= 0.04 * n) & (dots <= 0.18 * n)),
        "line ends": ((lines >= 2) & (ended < 0.7 * lines), (lines >= 2) & (ended >= 0.95 * lines)),
        "short words": ((short < 0.15 * n) | (short > 0.42 * n), (short >= 0.22 * n) & (short <= 0.38 * n)),
        "punctuation": ((marks < 0.1 * n) | (marks > 0.2 * n), (marks >= 0.12 * n) & (marks <= 0.18 * n)),
    }


def votes() -> Column:
    """Array of one vote per rule: 0 bad, 1 good, 2 abstains."""
    return F.array(*[F.when(bad, 0).when(good, 1).otherwise(2) for bad, good in rules().values()])


def posteriors(patterns: DataFrame, rounds: int = 40) -> DataFrame:
    """(votes, quality) from (votes, n): expectation-maximisation for two classes with independent votes.

    Starts from each pattern's share of good votes. A parameter is smoothed by one half observation; abstaining
    is an outcome like a vote.
    """
    rule = F.sequence(F.lit(0), F.lit(len(rules()) - 1))
    vote = F.sequence(F.lit(0), F.lit(2))
    cast = lambda k: F.size(F.filter("votes", lambda v: v == k))
    start = (cast(1) + 1.0) / (cast(0) + cast(1) + 2.0)
    one = patterns.withColumn("p", start).agg(F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n"), "p"))).alias("ps"))

    def fitted(ps: Column) -> Column:
        """Share of the good class, and log odds of every vote of every rule."""

        def weight(keep, good: bool) -> Column:  # noqa: ANN001
            return F.aggregate(ps, F.lit(0.0), lambda s, x: s + F.when(keep(x), x["n"] * (x["p"] if good else 1 - x["p"])).otherwise(0.0))

        everything = lambda x: F.lit(True)

        def odds(r: Column, k: Column, good_all: Column, bad_all: Column) -> Column:
            mine = lambda x: F.get(x["votes"], r) == k
            return F.log((weight(mine, True) + 0.5) / (good_all + 1.5)) - F.log((weight(mine, False) + 0.5) / (bad_all + 1.5))

        totals = F.struct(weight(everything, True).alias("good"), weight(everything, False).alias("bad"))
        return let(
            totals,
            lambda t: F.struct(
                F.log((t["good"] + 0.5) / (t["bad"] + 0.5)).alias("prior"),
                F.transform(rule, lambda r: F.transform(vote, lambda k: odds(r, k, t["good"], t["bad"]))).alias("odds"),
            ),
        )

    def step(ps: Column, _: Column) -> Column:
        def posterior(model: Column) -> Column:
            def renew(x: Column) -> Column:
                logit = F.aggregate(F.transform(x["votes"], lambda v, r: F.get(F.get(model["odds"], r), v)), model["prior"], lambda s, o: s + o)
                return F.struct(x["votes"].alias("votes"), x["n"].alias("n"), (1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), logit))))).alias("p"))

            return F.transform(ps, renew)

        return let(fitted(ps), posterior)

    done = one.select(F.explode(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.col("ps"), step)).alias("x"))
    return done.select("x.votes", F.col("x.p").alias("quality"))


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_from: float = 0.1) -> DataFrame:
    """Measures, base verdict, posterior quality and verdict of every document.

    ``base_failed``: fewer than 20 words, or over 30 % of them in repeated 8-word windows. ``kept``: not failed
    and a posterior of ``keep_from`` or more.
    """
    table = materialise(measured(docs, id_col=id_col, text_col=text_col), "measures").withColumn("votes", votes())
    patterns = materialise(table.groupBy("votes").agg(F.count("*").alias("n")), "patterns")  # 3 ** rules rows at most
    known = materialise(posteriors(patterns), "posteriors")
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = table.join(F.broadcast(known), "votes").withColumn("base_failed", base)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_from)).drop("votes")
