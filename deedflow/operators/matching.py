"""Greedy one-to-one matching of two ordered sides, and the comparisons and version diffs built on it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deedflow.functions import rules, text
from deedflow.sources.scratch import ship, written


@dataclass(frozen=True)
class Equal:
    """Two entities fit if this is equal (null: to nothing); ``key`` makes it of a function that gives an entity's field."""

    key: Callable[[Callable[[str], Column]], Column]


@dataclass(frozen=True)
class Within:
    """Two entities fit if their ``group`` is equal and the text of one stands in that of the other.

    ``a_in_b`` and ``b_in_a`` say of the contained text whether that direction counts.
    """

    text: Callable[[Callable[[str], Column]], Column]
    group: Callable[[Callable[[str], Column]], Column] = lambda x: F.lit("")
    a_in_b: Callable[[Column], Column] = lambda t: F.lit(True)
    b_in_a: Callable[[Column], Column] = lambda t: F.lit(True)


Rule = Equal | Within

#: Pairs of documents with at most so many pairs of entities are compared entity by entity inside their row.
FEW = 10_000


def field_of(side: str) -> Callable[[str], Column]:
    return lambda name: F.col(f"{side}.{name}")


def keys(rules: list[Rule]) -> Column:
    """What the rules compare of an entity ``x``, made once an entity."""
    x, parts = field_of("x"), []
    for r, rule in enumerate(rules):
        if isinstance(rule, Equal):
            parts.append(rule.key(x).alias(f"key{r}"))
        else:
            t = rule.text(x)
            parts += [t.alias(f"text{r}"), rule.group(x).alias(f"group{r}"), rule.a_in_b(t).alias(f"forth{r}"), rule.b_in_a(t).alias(f"back{r}")]
    return F.struct(*parts)


def holds(rules: list[Rule], a: Column, b: Column) -> Column:
    """Whether two entities with keys ``a`` and ``b`` fit by any of the rules."""
    out = F.lit(False)
    for r, rule in enumerate(rules):
        if isinstance(rule, Equal):
            fits = a[f"key{r}"] == b[f"key{r}"]
        else:
            ta, tb = a[f"text{r}"], b[f"text{r}"]
            fits = (a[f"group{r}"] == b[f"group{r}"]) & ((F.contains(tb, ta) & a[f"forth{r}"]) | (F.contains(ta, tb) & b[f"back{r}"]))
        out = out | F.coalesce(fits, F.lit(False))
    return out


def matched(sided: DataFrame, rules: list[Rule]) -> DataFrame:
    """(pair_id, a, b) of entities (pair_id, side, x struct with ``ordinal``): each A in order takes the first free B that fits.

    Rows left alone come with the other side null. Pairs of few entities are folded in their row; a pair of many is
    matched through an index of its keys.
    """
    sided = written(sided.withColumn("k", keys(rules)), "sides")
    n = lambda s: F.count_if(F.col("side") == s)
    many = written(sided.groupBy("pair_id").agg((n("a") * n("b")).alias("n")).filter(F.col("n") > FEW).select("pair_id"), "large_pairs")
    if many.isEmpty():
        return fit_in_row(sided, rules)
    few = sided.join(many.hint("merge"), "pair_id", "left_anti")
    return fit_in_row(few, rules).unionByName(keyed_fit(sided.join(many.hint("merge"), "pair_id", "left_semi").drop("k"), rules))


def grams(t: Column) -> Column:
    """Distinct substrings of three characters; a shorter text is its own."""
    n = F.length(t)
    return F.when(n <= 3, F.array(t)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(t, i, F.lit(3)))))


def all_grams(t: Column) -> Column:
    """Distinct substrings of three characters or fewer, the empty one too."""
    n = F.length(t)
    of = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(t, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(F.lit("")), of(1), of(2), of(3)))


def containing(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(pair_id, group, inner, outer): texts (pair_id, group, text) of one table that stand in texts of the other.

    A text is looked for among those that hold its rarest three characters.
    """
    index = written(outer.select("pair_id", "group", F.col("text").alias("outer"), F.explode(all_grams(F.col("text"))).alias("gram")), "grams")
    counts = index.groupBy("pair_id", "group", "gram").agg(F.count("*").alias("n"))
    probes = inner.select("pair_id", "group", F.col("text").alias("inner"), F.explode(grams(F.col("text"))).alias("gram"))
    rare = probes.join(counts.hint("merge"), ["pair_id", "group", "gram"], "left").groupBy("pair_id", "group", "inner").agg(F.min_by("gram", F.coalesce("n", F.lit(0))).alias("gram"))
    return written(rare, "probes").join(index.hint("merge"), ["pair_id", "group", "gram"]).filter(F.contains("outer", F.col("inner"))).select("pair_id", "group", "inner", "outer")


def keyed_fit(sided: DataFrame, rules: list[Rule]) -> DataFrame:
    """As ``first_fit``, by keys: what each B offers and each A accepts, so that no pair of entities is made.

    Equal values are a key; a text that stands in another is one key for all entities that have it. A pair's keys
    meet in one pass: of all its keys an A takes the first free B.
    """
    x = field_of("x")
    offers, accepts = [], []
    tag = lambda r, *parts: F.xxhash64(F.lit(r), *parts)
    side = lambda s: F.col("side") == s
    for r, rule in enumerate(rules):
        if isinstance(rule, Equal):
            keyed = sided.withColumn("key", F.when(rule.key(x).isNotNull(), tag(r, rule.key(x)))).filter("key is not null")
            offers.append(keyed.filter(side("b")).select("pair_id", "x.ordinal", "key"))
            accepts.append(keyed.filter(side("a")).select("pair_id", "x.ordinal", "key"))
            continue
        texts = sided.select("pair_id", "side", F.col("x.ordinal").alias("ordinal"), rule.group(x).alias("group"), rule.text(x).alias("text"))
        texts = written(texts.filter("`group` is not null and text is not null"), "texts")
        of = lambda s: texts.filter(side(s))  # noqa: B023, E731
        once = lambda s: of(s).select("pair_id", "group", "text").distinct()  # noqa: B023, E731
        forth = containing(once("a").filter(rule.a_in_b(F.col("text"))), once("b")).select("pair_id", "group", F.col("inner").alias("ta"), F.col("outer").alias("tb"))
        back = containing(once("b").filter(rule.b_in_a(F.col("text"))), once("a")).select("pair_id", "group", F.col("outer").alias("ta"), F.col("inner").alias("tb"))
        fits = forth.unionByName(back).distinct().withColumnRenamed("ta", "text")
        offers.append(of("b").select("pair_id", "ordinal", tag(r, "group", "text").alias("key")))
        accepts.append(of("a").join(fits.hint("merge"), ["pair_id", "group", "text"]).select("pair_id", "ordinal", tag(r, "group", "tb").alias("key")))
    every = None
    for kind, parts in (("b", offers), ("a", accepts)):
        for p in parts:
            p = p.select("pair_id", F.lit(kind).alias("side"), F.col("ordinal").cast("long").alias("ordinal"), "key")
            every = p if every is None else every.unionByName(p)
    ship(sided.sparkSession)
    kind = dict(sided.dtypes)["pair_id"]
    taken = written(every.groupBy("pair_id").applyInArrow(take_first, f"pair_id {kind}, i long, j long"), "taken")
    x_type = dict(sided.dtypes)["x"]
    of = lambda s: sided.filter(side(s)).select("pair_id", F.col("x.ordinal").cast("long").alias("i" if s == "a" else "j"), F.col("x").alias(s))
    left = of("a").join(taken.hint("merge"), ["pair_id", "i"], "left").join(of("b").hint("merge"), ["pair_id", "j"], "left")
    free = of("b").join(taken.hint("merge"), ["pair_id", "j"], "left_anti")
    return left.select("pair_id", "a", "b").unionByName(free.select("pair_id", F.lit(None).cast(x_type).alias("a"), "b"))


def take_first(keys: pa.Table) -> pa.Table:
    """(pair_id, i, j) of one pair's keys (side, ordinal, key): each A in order and the first free B of all its keys."""
    keys = keys.sort_by("ordinal")
    offered: dict[int, list[int]] = {}
    wanted: dict[int, list[int]] = {}
    for side, ordinal, key in zip(keys["side"].to_pylist(), keys["ordinal"].to_pylist(), keys["key"].to_pylist(), strict=True):
        (offered if side == "b" else wanted).setdefault(key if side == "b" else ordinal, []).append(ordinal if side == "b" else key)
    at = dict.fromkeys(offered, 0)
    taken: set[int] = set()
    i, j = [], []
    for a, of in wanted.items():  # in order of A
        best = None
        for key in of:
            line = offered.get(key, [])
            while at.get(key, 0) < len(line) and line[at[key]] in taken:  # what is taken stays so: each place is passed once
                at[key] += 1
            if line and at[key] < len(line) and (best is None or line[at[key]] < best):
                best = line[at[key]]
        if best is not None:
            taken.add(best)
            i.append(a)
            j.append(best)
    return pa.table({"pair_id": pa.array([keys["pair_id"][0].as_py()] * len(i), keys.schema.field("pair_id").type), "i": pa.array(i, pa.int64()), "j": pa.array(j, pa.int64())})


def first_fit(sided: DataFrame, fits: Column) -> DataFrame:
    """(pair_id, a, b) of entities (pair_id, side, x struct with ``ordinal``): each A in order takes the first free B that fits.

    ``fits`` is a condition on columns ``a`` and ``b``; rows left alone come with the other side null. One shuffle
    by pair; work in a pair is bounded by its entities.
    """
    of = lambda s: F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct(F.col("x.ordinal").alias("o"), F.col("x").alias("x")))))
    both = sided.groupBy("pair_id").agg(of("a").alias("left"), of("b").alias("right")).select("pair_id", F.col("left.x").alias("left"), F.col("right.x").alias("right"))
    every = both.select("pair_id", "left", "right", F.explode_outer("left").alias("a")).select("*", F.explode_outer("right").alias("b"))
    edge = F.when(F.coalesce(fits, F.lit(False)) & F.col("a").isNotNull() & F.col("b").isNotNull(), F.struct(F.col("a.ordinal").alias("i"), F.col("b.ordinal").alias("j")))
    edges = every.groupBy("pair_id").agg(F.first("left").alias("left"), F.first("right").alias("right"), F.sort_array(F.collect_list(edge)).alias("edges"))
    return taken(edges)


def fit_in_row(sided: DataFrame, rules: list[Rule]) -> DataFrame:
    """As ``first_fit``, by rules, of entities that have their keys ``k`` (see ``keys``).

    Keys meet inside the pair's row, so that no entity is copied for another.
    """
    of = lambda s: F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct(F.col("x.ordinal").alias("o"), "k", "x"))))
    both = sided.groupBy("pair_id").agg(of("a").alias("as"), of("b").alias("bs"))
    met = lambda a: F.transform(F.filter("bs", lambda b: holds(rules, a["k"], b["k"])), lambda b: F.struct(a["o"].alias("i"), b["o"].alias("j")))
    edges = both.select("pair_id", F.col("as.x").alias("left"), F.col("bs.x").alias("right"), F.flatten(F.transform("as", met)).alias("edges"))
    return taken(edges)


def taken(edges: DataFrame) -> DataFrame:
    """(pair_id, a, b) of (pair_id, left, right, edges): edges are taken in order, each if both its ends are free."""
    none = F.struct(F.array().cast("array<int>").alias("i"), F.array().cast("array<int>").alias("j"))
    step = lambda s, e: F.when(F.array_contains(s["i"], e["i"]) | F.array_contains(s["j"], e["j"]), s).otherwise(F.struct(F.array_append(s["i"], e["i"]).alias("i"), F.array_append(s["j"], e["j"]).alias("j")))
    done = edges.withColumn("t", F.aggregate("edges", none, step))
    partner = lambda a: F.get(F.col("t.j"), F.array_position(F.col("t.i"), a["ordinal"]).cast("int") - 1)
    own = F.transform("left", lambda a: F.struct(a.alias("a"), F.get(F.filter("right", lambda b: b["ordinal"] == partner(a)), F.lit(0)).alias("b")))
    free = F.filter("right", lambda b: ~F.array_contains(F.col("t.j"), b["ordinal"]))
    rest = F.transform(free, lambda b: F.struct(F.get(F.slice("left", 1, 0), F.lit(0)).alias("a"), b.alias("b")))
    return done.select("pair_id", F.inline(F.concat(own, rest)))


def sides(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, side, x): entities of the two documents of each pair (pair_id, a_document_id, b_document_id)."""
    packed = entities.select("document_id", F.struct(*[c for c in entities.columns if c != "document_id"]).alias("x"))
    ends = pairs.select("pair_id", F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_document_id").alias("document_id")) for s in ("a", "b")])))
    return ends.join(packed.hint("merge"), "document_id").select("pair_id", "side", "x")


def _found(both: DataFrame, kind: Column, same: Column, changed: str, same_name: str, only: tuple[str, str], label: Column) -> DataFrame:
    # entities without page and span are compared, but cite nothing
    fields = both.schema["a"].dataType.fieldNames()
    place = lambda s: [F.col(f"{s}.{c}").alias(c) if c in fields else F.lit(None).cast(t).alias(c) for c, t in (("page_number", "int"), ("source_span", "string"))]
    ref = lambda s: F.when(F.col(s).isNotNull() & F.lit("source_span" in fields), F.struct(F.lit(s).alias("side"), *place(s)))
    refs = F.array_compact(F.array(ref("a"), ref("b"))).alias("refs")
    verdict = F.when(F.col("b").isNull(), only[0]).when(F.col("a").isNull(), only[1]).when(same, same_name).otherwise(changed)
    return both.select("pair_id", kind.alias("category"), verdict.alias("classification"), label.alias("label"), F.col("a.ordinal").alias("a_ordinal"), F.col("b.ordinal").alias("b_ordinal"), refs)


ONLY = ("PRESENT_IN_ONE_ONLY", "PRESENT_IN_ONE_ONLY")
CHANGED = ("REMOVED", "ADDED")


def either(c: str) -> Column:
    return F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}"))


def low(c: Column) -> Column:
    return F.lower(text.strip(F.coalesce(c, F.lit(""))))


def some(c: Column) -> Column:
    """The text, null if it is empty."""
    return F.when(c != "", c)


def compare_parties(parties: DataFrame, pairs: DataFrame) -> DataFrame:
    name = lambda x: text.match_key(x("name"))
    longer = lambda t: F.length(t) > 3
    found = matched(sides(parties, pairs), [Equal(name), Within(name, a_in_b=longer, b_in_a=longer)])
    same = text.match_key(F.col("a.role")) == text.match_key(F.col("b.role"))
    return _found(found, F.lit("PARTIES"), same, "DIFFERENT", "MATCH", ONLY, either("name"))


def compare_dates(dates: DataFrame, pairs: DataFrame) -> DataFrame:
    found = matched(sides(dates, pairs), [Equal(lambda x: text.match_key(x("date_type"))), Equal(lambda x: text.match_key(x("description")))])
    value = lambda s: F.coalesce(F.col(f"{s}.normalized_date"), text.strip(F.col(f"{s}.raw_text")))
    return _found(found, F.lit("DATES"), value("a") == value("b"), "POTENTIAL_INCONSISTENCY", "MATCH", ONLY, either("description"))


def compare_obligations(obligations: DataFrame, pairs: DataFrame) -> DataFrame:
    duty = lambda x: text.match_key(x("duty"))
    obligor = lambda x: text.match_key(x("obligor"))
    days = lambda x: text.day_count(F.concat(x("duty"), F.lit(" "), F.coalesce(x("deadline"), F.lit(""))))
    notice = lambda x: F.when(F.contains(duty(x), F.lit("notice")) | F.contains(duty(x), F.lit("terminat")), "notice")
    dated = lambda x: F.when(days(x).isNotNull(), obligor(x))
    both = matched(sides(obligations, pairs), [Equal(notice), Equal(dated), Within(duty, group=obligor)])
    a, b = field_of("a"), field_of("b")
    differ = F.coalesce(days(a) != days(b), F.lit(False)) & F.col("a").isNotNull() & F.col("b").isNotNull()
    out = _found(both.withColumn("differ", differ), F.when(F.col("differ"), "NOTICE").otherwise("OBLIGATIONS"), ~F.col("differ") & (duty(a) == duty(b)), "DIFFERENT", "MATCH", ONLY, either("obligor"))
    return out.withColumn("classification", F.when((F.col("category") == "NOTICE"), "POTENTIAL_INCONSISTENCY").otherwise(F.col("classification")))


def compare_clauses(clauses: DataFrame, pairs: DataFrame) -> DataFrame:
    key = lambda s, c: text.match_key(F.col(f"{s}.{c}"))
    title = lambda x: some(text.match_key(x("title")))
    kind = lambda x: F.when(~text.match_key(x("category")).isin("other", "general"), text.match_key(x("category")))
    found = matched(sides(clauses, pairs), [Equal(kind), Equal(title), Within(title, a_in_b=lambda t: F.length(t) > 4, b_in_a=lambda t: F.lit(False))])
    return _found(found, rules.comparison_category(either("category")), key("a", "text") == key("b", "text"), "DIFFERENT", "MATCH", ONLY, either("title"))


def diff_parties(parties: DataFrame, pairs: DataFrame) -> DataFrame:
    name = lambda x: text.party_key(x("name"))
    found = matched(sides(parties, pairs), [Equal(name), Within(lambda x: some(name(x)))])
    role = lambda s: F.lower(text.strip(F.col(f"{s}.role")))
    return _found(found, F.lit("PARTIES"), role("a") == role("b"), "MODIFIED", "UNCHANGED", CHANGED, either("name"))


def diff_dates(dates: DataFrame, pairs: DataFrame) -> DataFrame:
    key = lambda x: some(low(F.coalesce(x("description"), x("date_type"))))
    value = lambda s: F.coalesce(F.col(f"{s}.normalized_date"), F.col(f"{s}.raw_text"))
    return _found(matched(sides(dates, pairs), [Within(key)]), F.lit("DATES"), value("a") == value("b"), "MODIFIED", "UNCHANGED", CHANGED, either("description"))


def diff_obligations(obligations: DataFrame, pairs: DataFrame) -> DataFrame:
    obligor = lambda x: low(x("obligor"))
    triggered = lambda x: F.when(low(x("trigger")) != "", F.struct(obligor(x), low(x("trigger"))))
    found = matched(sides(obligations, pairs), [Equal(triggered), Within(lambda x: x("duty"), group=obligor)])
    same = (low(F.col("a.duty")) == low(F.col("b.duty"))) & (low(F.col("a.deadline")) == low(F.col("b.deadline")))
    return _found(found, F.lit("OBLIGATIONS"), same, "MODIFIED", "UNCHANGED", CHANGED, either("obligor"))


def diff_clauses(clauses: DataFrame, pairs: DataFrame) -> DataFrame:
    kind = lambda x: F.when((low(x("category")) != "") & (low(x("category")) != "general"), low(x("category")))
    found = matched(sides(clauses, pairs), [Equal(kind), Within(lambda x: some(low(x("title"))))])
    same = text.strip(F.col("a.text")) == text.strip(F.col("b.text"))
    return _found(found, rules.diff_category(either("category")), same, "MODIFIED", "UNCHANGED", CHANGED, either("title"))


def summary(findings: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """Counts of each classification and in total, per pair."""
    return findings.groupBy("pair_id").agg(*[F.count_if(F.col("classification") == c).alias(f"n_{c.lower()}") for c in classes], F.count("*").alias("total"))


COMPARISON_CLASSES = ("MATCH", "DIFFERENT", "PRESENT_IN_ONE_ONLY", "POTENTIAL_INCONSISTENCY", "UNRESOLVED")
DIFF_CLASSES = ("UNCHANGED", "MODIFIED", "ADDED", "REMOVED", "POTENTIAL_CHANGE", "UNRESOLVED")


def compatible(parties: DataFrame, clauses: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, shares_party, shares_category, compatible): some party in common and, of two clauses a side, a category."""
    tokens = parties.select("document_id", text.party_tokens(F.col("name")).alias("t"), F.lower("name").alias("n"))
    side = lambda c, p: pairs.select("pair_id", F.col(c).alias("document_id")).join(tokens, "document_id").select("pair_id", F.col("t").alias(f"{p}t"), F.col("n").alias(f"{p}n"))
    both = side("a_document_id", "a").join(side("b_document_id", "b"), "pair_id")
    party = both.groupBy("pair_id").agg(F.bool_or(F.arrays_overlap("at", "bt") | F.contains("an", F.col("bn")) | F.contains("bn", F.col("an"))).alias("shares_party"))
    kinds = clauses.groupBy("document_id").agg(F.count("*").alias("n"), F.collect_set(F.when(F.col("category") != "general", F.col("category"))).alias("c"))
    kind = lambda c, p: pairs.select("pair_id", F.col(c).alias("document_id")).join(kinds, "document_id", "left").select("pair_id", F.col("n").alias(f"{p}_n"), F.col("c").alias(f"{p}_c"))
    known = kind("a_document_id", "a").join(kind("b_document_id", "b"), "pair_id")
    enough = (F.coalesce("a_n", F.lit(0)) >= 2) & (F.coalesce("b_n", F.lit(0)) >= 2) & (F.size("a_c") > 0) & (F.size("b_c") > 0)
    category = known.select("pair_id", F.when(enough, F.arrays_overlap("a_c", "b_c")).otherwise(True).alias("shares_category"))
    joined = pairs.select("pair_id").join(party, "pair_id", "left").join(category, "pair_id").withColumn("shares_party", F.coalesce("shares_party", F.lit(False)))
    return joined.withColumn("compatible", F.col("shares_party") & F.col("shares_category"))
