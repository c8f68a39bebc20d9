"""Operator 12: the trie of conversation prefixes by whole-sequence collapse.

Conversations whose turns are all equal are one weighted sequence, with the list of
those that end there. Sequences that are proper prefixes of others fall to an
anti-join; what remains are the trie's leaves. Every sequence's prefixes, weighted by
its conversations, are summed to the nodes.

A prefix is told by its depth and by 128 bits: the exclusive or of two 64-bit hashes
of (place, role, text) of its turns, so that it is a running aggregate and a parent's
key follows from its child's. Texts are hashed where they are read and never move.

A node's saving (repeats times words) belongs to its smallest member's sequence; sums
from the end of each sequence, added over the sequences through a node, are the sum
over its subtree. All tables are as long as the turns.

Scale: copies collapse before prefixes are made. Turns get their places by a range sort
(``numbered``); running values are two-level, over blocks of 1000 turns. The root
never joins, and what joins by a parent that many share is written, so that AQE can
split it. Lists of ends are strings of 5000 ids at most, made in parallel; a list of
several goes through one hash in order, a string at a time.

Defined cases: null role and text are empty; null turns come first, turns of equal
number follow each other by their hash; a null conv_id is one conversation without a
shared beginning, its id comes last and is spelt ``null``; the remainder of a
negative id has its sign; a conversation without
turns ends at the root; other columns are not read; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, numbered, ship, small, word_count

#: Conversations that share one beginning, and turns that may be shared.
FAMILY, SHARED = 20, 4
BLOCK, IDS = 1_000, 5_000


def running(df: DataFrame, keys: list[str], place: str, values: dict[str, Column], fold, *, backwards: bool = False) -> DataFrame:  # noqa: ANN001
    """Adds aggregates of each value over a group's rows up to the row by ``place`` (from the row on: ``backwards``).

    ``fold`` is ``F.sum`` or ``F.bit_xor``. The table is read twice: hand over a written one.
    """
    cut = df.withColumn("__block", F.floor(F.col(place) / BLOCK).cast("long"))
    order = (lambda c: F.col(c).desc()) if backwards else F.col
    inner = Window.partitionBy(*keys, "__block").orderBy(order(place))
    inside = cut.select("*", *[fold(v).over(inner).alias(name) for name, v in values.items()])
    if df.agg(F.max(place)).first()[0] in (None, *range(BLOCK)):
        return inside.drop("__block")
    outer = Window.partitionBy(*keys).orderBy(order("__block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut.groupBy(*keys, "__block").agg(*[fold(v).alias(name) for name, v in values.items()])
    blocks = materialise(blocks.select(*[F.col(c).alias(f"__b_{c}") for c in [*keys, "__block"]], *[fold(F.col(n)).over(outer).alias(f"__before_{n}") for n in values]), "blocks")
    same = F.lit(True)
    for c in [*keys, "__block"]:
        same = same & F.col(c).eqNullSafe(F.col(f"__b_{c}"))
    both = lambda n: (F.col(n) + F.coalesce(f"__before_{n}", F.lit(0))) if fold is F.sum else F.col(n).bitwiseXOR(F.coalesce(f"__before_{n}", F.lit(0).cast("long")))
    joined = inside.join(small(blocks, blocks.count()), same)
    return joined.select(*df.columns, *[both(n).alias(n) for n in values])


def turns(conversations: DataFrame, columns: tuple[str, str, str, str]) -> DataFrame:
    """(conv, turn, a, b, words, place): every turn as two hashes, with its place in its conversation, from 0."""
    conv, turn, role, text = columns
    said = [F.coalesce(F.col(c), F.lit("")) for c in (role, text)]
    read = conversations.select(
        F.col(conv).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        F.xxhash64(F.lit(1), *said).alias("a"),
        F.xxhash64(F.lit(2), *said).alias("b"),
        word_count(F.col(text)).alias("words"),
    )
    return materialise(numbered(materialise(read, "turns"), "place", ["conv"], ["turn", "a", "b"]), "placed")


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, a, b, words) of rebuilt conversations, depth from 1, and (conv) of all of them."""
    own = materialise(placed.groupBy("conv").agg(F.count(F.lit(1)).alias("n")), "conversations")
    head = F.when(F.col("conv").isNull(), 0).otherwise(F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED)
    base = F.col("conv") - F.col("conv") % FAMILY
    sizes = own.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    heads = own.select("conv", head.alias("head"), base.alias("base")).join(sizes.hint("merge"), "base", "left")
    heads = materialise(heads.withColumn("given", F.least("head", F.coalesce("base_n", F.lit(0)))), "heads")
    shared = placed.filter(F.col("place") < SHARED - 1).select(F.col("conv").alias("base"), "place", "a", "b", "words")
    first = heads.filter("given > 0").select("conv", "base", "given").join(shared.hint("merge"), "base").filter(F.col("place") < F.col("given"))
    kept = heads.select(F.col("conv").alias("__conv"), "head", "given")
    rest = placed.join(small(kept, own.count()), F.col("conv").eqNullSafe(F.col("__conv"))).filter(F.col("place") >= F.col("head"))
    columns = lambda depth: ("conv", depth.cast("long").alias("depth"), "a", "b", "words")
    both = first.select(*columns(F.col("place") + 1)).unionByName(rest.select(*columns(F.col("place") - F.col("head") + F.col("given") + 1)))
    label = lambda c: F.xxhash64("depth", c).alias(c)
    return materialise(both.select("conv", "depth", label("a"), label("b"), "words"), "rebuilt"), own.select("conv")


def hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each sequence's strings, joined by commas; strings come in order, a sequence's one after another."""
    now, state = None, None
    for batch in batches:
        done = []
        for key, ids in zip(zip(*(batch[c].to_pylist() for c in ("length", "x", "y")), strict=True), batch["ids"].to_pylist(), strict=True):
            if key != now:
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield as_batch(done)
    if now is not None:
        yield as_batch([(*now, state.hexdigest())])


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    length, x, y, digest = map(list, zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(length, pa.int64()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(digest, pa.string())], ["length", "x", "y", "ends_sha256"])


def end_lists(whole: DataFrame) -> DataFrame:
    """(length, x, y, ends_sha256) of every sequence from (conv, length, x, y) of the conversations."""
    key = ["length", "x", "y"]
    # ids are numbered in each list, nulls last, and joined in strings of a bounded number
    ordered = materialise(whole.select(*key, "conv", F.col("conv").isNull().alias("unknown")), "ends")
    line = numbered(ordered, "place", key, ["unknown", "conv"])
    spelt = F.struct("place", F.coalesce(F.col("conv").cast("string"), F.lit("null")).alias("id"))
    strings = line.groupBy(*key, F.floor(F.col("place") / IDS).cast("long").alias("block")).agg(F.sort_array(F.collect_list(spelt)).alias("ids"))
    strings = materialise(strings.withColumn("ids", F.array_join("ids.id", ",")), "strings")
    long = materialise(strings.filter("block > 0").select(*key).distinct(), "long")
    n = long.count()
    short = strings.join(small(long, n), key, "left_anti").select(*key, F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    if n == 0:
        return short
    chained = strings.join(small(long, n), key, "left_semi").repartition(*key).sortWithinPartitions(*key, "block")
    return short.unionByName(chained.select(*key, "ids").mapInArrow(hash_lists, "length long, x long, y long, ends_sha256 string"))


def prefix_trie(conversations: DataFrame, *, columns: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text")) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    ``columns`` names the conversation, the turn's number, its role and its text.
    """
    ship(conversations.sparkSession)
    said, convs = rebuilt(turns(conversations, columns))
    zero = F.lit(0).cast("long")
    sums = said.groupBy("conv").agg(F.max("depth").alias("length"), F.bit_xor("a").alias("x"), F.bit_xor("b").alias("y"))
    whole = convs.withColumnRenamed("conv", "__conv").join(sums.hint("merge"), F.col("__conv").eqNullSafe(F.col("conv")), "left")
    whole = materialise(whole.select(F.col("__conv").alias("conv"), *[F.coalesce(c, zero).alias(c) for c in ("length", "x", "y")]), "whole")
    # identical conversations are one sequence
    key = ["length", "x", "y"]
    sequences = materialise(whole.groupBy(*key).agg(F.count(F.lit(1)).alias("weight"), F.min("conv").alias("first")), "sequences")
    ends = materialise(end_lists(whole), "end_lists")
    # the prefixes of each, once
    one = sequences.select(F.col("first").alias("__first"), "weight", "length")
    spoken = materialise(said.join(one.hint("merge"), F.col("conv").eqNullSafe(F.col("__first"))).drop("__first"), "sequence_turns")
    run = running(spoken, ["conv"], "depth", {"x": F.col("a"), "y": F.col("b")}, F.bit_xor)
    run = materialise(run.withColumns({"px": F.col("x").bitwiseXOR(F.col("a")), "py": F.col("y").bitwiseXOR(F.col("b"))}).drop("a", "b"), "prefixes")
    at = ["depth", "x", "y"]
    proper = run.filter("depth < length").select(F.col("depth").alias("length"), "x", "y").distinct()
    leaves = sequences.join(proper.hint("merge"), key, "left_anti").filter("length > 0")
    leaves = materialise(leaves.select(F.col("first").alias("__leaf"), F.lit(1).cast("long").alias("leaf")), "leaves")
    # a node's saving stands with its first sequence, at its depth
    weighed = run.groupBy(*at).agg(F.sum("weight").alias("n"), F.min("conv").alias("__conv"), F.min("words").alias("words"))
    own = weighed.select("__conv", F.col("depth").alias("__depth"), ((F.col("n") - 1) * F.col("words")).alias("own")).filter("own > 0")
    first_at = F.col("conv").eqNullSafe(F.col("__conv")) & (F.col("depth") == F.col("__depth"))
    marked = run.join(own.hint("merge"), first_at, "left").join(leaves.hint("merge"), F.col("conv").eqNullSafe(F.col("__leaf")), "left")
    marked = materialise(marked.withColumns({"own": F.coalesce("own", zero), "leaf": F.coalesce("leaf", zero)}).drop("__conv", "__depth", "__leaf", "words"), "marked")
    summed = running(marked, ["conv"], "depth", {"saved": F.col("own")}, F.sum, backwards=True)
    sums = [F.sum(c).alias(name) for c, name in (("weight", "n_convs"), ("leaf", "n_leaves"), ("saved", "saved_tokens"))]
    nodes = materialise(summed.groupBy(*at).agg(F.min("conv").alias("conv_id"), *sums, F.min("px").alias("px"), F.min("py").alias("py")), "nodes")
    top = whole.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id")).first()
    below = nodes.filter("depth = 1").agg(F.count(F.lit(1)).alias("n"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).first()
    as_long = lambda v: F.lit(v).cast("long")
    root = conversations.sparkSession.range(1 if top["n_convs"] else 0).select(
        zero.alias("depth"),
        zero.alias("x"),
        zero.alias("y"),
        as_long(top["conv_id"]).alias("conv_id"),
        as_long(top["n_convs"]).alias("n_convs"),
        as_long(below["leaves"] or 1).alias("n_leaves"),
        as_long(below["saved"] or 0).alias("saved_tokens"),
        as_long(None).alias("parent_conv_id"),
        as_long(below["n"]).alias("n_children"),
    )
    up = lambda *c: [F.col(a).alias(f"__{b}") for a, b in zip(c, at, strict=True)]
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = nodes.join(children.hint("merge"), at, "left").withColumn("n_children", F.coalesce("n_children", zero))
    parents = nodes.select(*up(*at), F.col("conv_id").alias("parent_conv_id"))
    deep = counted.filter("depth > 1").join(parents.hint("merge"), (F.col("depth") - 1 == F.col("__depth")) & (F.col("px") == F.col("__x")) & (F.col("py") == F.col("__y")))
    shallow = counted.filter("depth = 1").withColumn("parent_conv_id", as_long(top["conv_id"]))
    every = root.unionByName(deep.select(*root.columns)).unionByName(shallow.select(*root.columns))
    listed = every.join(ends.withColumnRenamed("length", "depth").hint("merge"), at, "left")
    nothing = F.lit(hashlib.sha256().hexdigest())
    return listed.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
