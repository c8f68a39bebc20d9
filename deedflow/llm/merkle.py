"""Operator 11: a Merkle manifest whose parents keep the state of their hash before each child.

A node's hash is SHA-256 over the hexadecimal digests of its children, 64 bytes
each: one block of SHA-256. The state before a child's slot is therefore eight
words, and a parent's row keeps one for each child. A changed child is folded in by
resuming the state before its slot with the new digest and the siblings to its
right; what stands left of it is never hashed again.

Every value of ``lang`` has a tree over its rows in order of ``doc_id``; the trees'
roots, in order of ``lang``, are the leaves of one more tree.

Scale: leaves are hashed in the JVM; after that only digests move. Places in a tree
come from a range sort (``numbered``), so that a language with most rows is many
tasks. A task builds the four lowest levels over 4096 neighbours and writes their
parents; the next round does the same with the 1/4096 nodes that are left. Folding
meets each run of 4096 leaves with its own parents and with one path from its top to
the root. No task holds more than a run.

Defined cases: any null column counts as ``-``, and so has a place in a leaf; null
ids come first, rows that repeat an id follow each other in order of their leaf
digests; a null language is a tree of its own, before all others; a lone leaf is
its tree's root, and a lone root the root; where nothing stands beside a leaf on any
level, its proof is the hash of nothing. Rows without an id are never tampered
with. Other columns are not read. An empty table has no rows (and no root).
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, numbered, ship, small

#: Children of a node; levels built by one task; leaves below such a task.
FAN, HEIGHT = 8, 4
RUN = FAN**HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

U32 = np.uint32


def primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def cube_root(n: int) -> int:
    lo, hi = 0, 1 << 40
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if mid**3 <= n else (lo, mid - 1)
    return lo


#: SHA-256's first state and round constants, by its definition: fractions of the roots of the first primes.
FIRST = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in primes(8)], U32)[:, None]
ROUND = [U32(cube_root(p << 96) & 0xFFFFFFFF) for p in primes(64)]
#: Four hexadecimal digits of a half word, as the word of their ASCII bytes.
DIGITS = np.array([int.from_bytes(b"%04x" % i, "big") for i in range(1 << 16)], U32)


def turned(x: np.ndarray, *by: int) -> np.ndarray:
    """Exclusive or of the words turned right by each number of bits."""
    out = np.zeros_like(x)
    for r in by:
        out ^= (x >> U32(r)) | (x << U32(32 - r))
    return out


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """SHA-256 states (8, n) after one more block (16, n) each."""
    w = list(block)
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        i = t & 15
        if t >= 16:
            x, y = w[(t - 15) & 15], w[(t - 2) & 15]
            w[i] = w[i] + (turned(x, 7, 18) ^ (x >> U32(3))) + w[(t - 7) & 15] + (turned(y, 17, 19) ^ (y >> U32(10)))
        one = h + turned(e, 6, 11, 25) + ((e & f) ^ (~e & g)) + ROUND[t] + w[i]
        two = turned(a, 2, 13, 22) + ((a & b) ^ (a & c) ^ (b & c))
        h, g, f, e, d, c, b, a = g, f, e, d + one, c, b, a, one + two
    return state + np.stack([a, b, c, d, e, f, g, h])


def spelt(digests: np.ndarray) -> np.ndarray:
    """Digests (8, n) as blocks (16, n) of their hexadecimal text."""
    out = np.empty((16, digests.shape[1]), U32)
    out[0::2], out[1::2] = DIGITS[digests >> U32(16)], DIGITS[digests & U32(0xFFFF)]
    return out


def finished(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests of states that have seen whole blocks only, as many as stated."""
    last = np.zeros((16, state.shape[1]), U32)
    last[0], last[15] = U32(1 << 31), (blocks * 512).astype(U32)
    return compress(state, last)


def words(binary: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of 32-byte digests as (8, n) words."""
    joined = b"".join(binary.to_pylist())
    return np.frombuffer(joined, ">u4").reshape(-1, 8).T.astype(U32)


def packed(digests: np.ndarray) -> list[bytes]:
    raw = np.ascontiguousarray(digests.T).astype(">u4").tobytes()
    return [raw[i : i + 32] for i in range(0, len(raw), 32)]


class Level:
    """Parents of one level: children's digests and states before them, (8, parents, FAN), and numbers of children."""

    def __init__(self, children: np.ndarray, counts: np.ndarray, states: np.ndarray | None = None) -> None:
        self.children, self.counts = children, counts
        self.states = self.made() if states is None else states

    @classmethod
    def over(cls, digests: np.ndarray) -> Level:
        n = digests.shape[1]
        parents = -(-n // FAN)
        children = np.zeros((8, parents * FAN), U32)
        children[:, :n] = digests
        counts = np.full(parents, FAN)
        counts[-1] = n - FAN * (parents - 1)
        return cls(children.reshape(8, parents, FAN), counts)

    def made(self) -> np.ndarray:
        states = np.zeros_like(self.children)
        state = np.repeat(FIRST, len(self.counts), 1)
        for j in range(FAN):
            on = np.flatnonzero(self.counts > j)
            if len(on):
                states[:, on, j] = state[:, on]
                state[:, on] = compress(state[:, on], spelt(self.children[:, on, j]))
        self.digests = finished(state, self.counts)
        return states

    def folded(self, place: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Digests of the parents of the children at ``place``, had each the digest ``value``."""
        parent, slot = place // FAN, place % FAN
        state = compress(self.states[:, parent, slot], spelt(value))
        for j in range(1, FAN):
            on = np.flatnonzero(slot + j < self.counts[parent])
            if len(on):
                state[:, on] = compress(state[:, on], spelt(self.children[:, parent[on], slot[on] + j]))
        return finished(state, self.counts[parent])


def levels_of(n: int) -> int:
    """Levels above n nodes, HEIGHT of them at most."""
    height = 0
    while n > 1 and height < HEIGHT:
        n, height = -(-n // FAN), height + 1
    return height


NODE = "tree long, run long, n long, level int, node int, digest binary, children binary, states binary, top boolean"


def build_run(items: pa.Table) -> pa.Table:
    """The parents over one run of neighbours, up to its top; a lone node is its own top, on level 0."""
    items = items.sort_by("pos")
    tree, run, n = (items[c][0].as_py() for c in ("tree", "run", "n"))
    rows = []
    digests = words(items["digest"])
    height = levels_of(n)
    if height == 0:
        rows.append((0, 0, packed(digests)[0], b"", b"", True))
    for level in range(1, height + 1):
        made = Level.over(digests)
        digests = made.digests
        for p, (digest, count) in enumerate(zip(packed(digests), made.counts.tolist(), strict=True)):
            rows.append((level, p, digest, b"".join(packed(made.children[:, p, :count])), b"".join(packed(made.states[:, p, :count])), level == height))
    level, node, digest, children, states, top = map(list, zip(*rows, strict=True))
    k = len(rows)
    return pa.table(
        {
            "tree": pa.array([tree] * k, pa.int64()),
            "run": pa.array([run] * k, pa.int64()),
            "n": pa.array([n] * k, pa.int64()),
            "level": pa.array(level, pa.int32()),
            "node": pa.array(node, pa.int32()),
            "digest": pa.array(digest, pa.binary()),
            "children": pa.array(children, pa.binary()),
            "states": pa.array(states, pa.binary()),
            "top": pa.array(top, pa.bool_()),
        }
    )


def read_levels(nodes: pa.Table) -> tuple[list[Level], list[dict], bytes | None]:
    """The levels of a run from its parents' rows, the path from its top to the root, and its tree's root."""
    nodes = nodes.sort_by([("level", "ascending"), ("node", "ascending")])
    level = np.asarray(nodes["level"])
    out = []
    for k in range(1, int(level.max()) + 1):
        of = nodes.filter(pa.array(level == k))
        kids, states = of["children"].to_pylist(), of["states"].to_pylist()
        wide = lambda rows: np.frombuffer(b"".join(r.ljust(32 * FAN, b"\0") for r in rows), ">u4").reshape(-1, FAN, 8).transpose(2, 0, 1).astype(U32)
        out.append(Level(wide(kids), np.array([len(r) // 32 for r in kids]), wide(states)))
    top = nodes.filter(nodes["top"])
    return out, top["path"][0].as_py() or [], top["subroot"][0].as_py()


STEP = "array<struct<count:int,state:binary,left:binary,right:binary>>"
STEP_ARROW = pa.list_(pa.struct([("count", pa.int32()), ("state", pa.binary()), ("left", pa.binary()), ("right", pa.binary())]))


def paths_of_run(items: pa.Table, nodes: pa.Table) -> pa.Table:
    """The path to the root of every node of a run: per level the state before it, and its siblings."""
    levels, above, subroot = read_levels(nodes)
    paths = []
    for pos in items["pos"].to_pylist():
        path, at = [], pos
        for level in levels:
            parent, slot, count = at // FAN, at % FAN, int(level.counts[at // FAN])
            kids = packed(level.children[:, parent, :count])
            path.append({"count": count, "state": packed(level.states[:, parent, slot : slot + 1])[0], "left": b"".join(kids[:slot]), "right": b"".join(kids[slot + 1 :])})
            at = parent
        paths.append(path + above)
    return pa.table({"tree": items["tree"], "index": items["index"], "path": pa.array(paths, STEP_ARROW), "subroot": pa.array([subroot] * len(paths), pa.binary())})


def same_once(place: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (place, value), and which of them each item is."""
    rows = np.ascontiguousarray(np.vstack([place.astype(U32)[None], value]).T)
    _, first, back = np.unique(rows.view(np.dtype((np.void, rows.shape[1] * 4))).ravel(), return_index=True, return_inverse=True)
    return place[first], value[:, first], back


def fold_run(items: pa.Table, nodes: pa.Table) -> pa.Table:
    """Proof and folded root of every leaf of a run, in hexadecimal."""
    levels, above, subroot = read_levels(nodes)
    place = np.asarray(items["pos"]).astype(np.int64)
    changed = pa.array([t if t is not None else d for t, d in zip(items["tampered"].to_pylist(), items["digest"].to_pylist(), strict=True)], pa.binary())
    value, of = words(changed), np.arange(len(place))
    spelled = []
    at = place
    for level in levels:
        spelled.append([b"".join(d.hex().encode() for d in packed(level.children[:, p, :c])) for p, c in enumerate(level.counts.tolist())])
        at, value, back = same_once(at, value)
        of = back[of]
        at, value = at // FAN, level.folded(at, value)
    for step in above:
        at, value, back = same_once(np.zeros(value.shape[1], np.int64), value)
        of = back[of]
        state = compress(np.repeat(words(pa.array([step["state"]])), value.shape[1], 1), spelt(value))
        for i in range(0, len(step["right"]), 32):
            state = compress(state, np.repeat(spelt(words(pa.array([step["right"][i : i + 32]]))), value.shape[1], 1))
        value = finished(state, np.full(value.shape[1], step["count"]))
    upper = "".join((step["left"] + step["right"]).hex() for step in above).encode()
    proofs = []
    for p in place.tolist():
        h = hashlib.sha256()
        for runs in spelled:
            slot, p = p % FAN * 64, p // FAN
            h.update(runs[p][:slot])
            h.update(runs[p][slot + 64 :])
        h.update(upper)
        proofs.append(h.hexdigest())
    roots = [d.hex() for d in packed(value)]
    return pa.table(
        {
            "doc_id": items["doc_id"],
            "leaf": pa.array([d.hex() for d in items["digest"].to_pylist()], pa.string()),
            "subroot": pa.array([subroot.hex()] * len(proofs), pa.string()),
            "proof_sha256": pa.array(proofs, pa.string()),
            "folded_root": pa.array([roots[i] for i in of.tolist()], pa.string()),
        }
    )


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each ``-`` if null, else its UTF-8 length, a colon and itself."""
    said = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*map(said, fields)).cast("binary"), 256))


def leaves(docs: DataFrame, changed: Column, *, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(doc_id, tree, n, index, digest, tampered, row): a leaf per row with its tree's number and size and its place there.

    ``fields`` names the columns of doc_id, source, lang, n_chars and text. ``changed`` says of which rows a digest
    with its text in lower case (A to Z only) is made too.
    """
    doc_id, _, lang, _, text = fields
    upper = "".join(map(chr, range(65, 91)))
    plain = [F.col(c) for c in fields]
    lowered = [F.translate(F.col(text), upper, upper.lower()) if c == text else F.col(c) for c in fields]
    hashed = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(lang).alias("lang"),
        leaf_digest(plain).alias("digest"),
        F.when(changed, leaf_digest(lowered)).alias("tampered"),
        F.monotonically_increasing_id().alias("row"),
    )
    hashed = materialise(hashed, "leaves")
    langs = materialise(hashed.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "langs")
    langs = materialise(numbered(langs, "tree", [], ["lang"]), "trees")
    right = small(langs.withColumnRenamed("lang", "__lang"), langs.count())
    placed = hashed.join(right, F.col("lang").eqNullSafe(F.col("__lang"))).drop("lang", "__lang")
    return numbered(materialise(placed, "placed"), "index", ["tree"], ["doc_id", "digest", "row"])


def in_runs(items: DataFrame) -> DataFrame:
    return items.withColumn("run", F.floor(F.col("index") / RUN).cast("long")).withColumn("pos", (F.col("index") % RUN).cast("int"))


def forest(items: DataFrame) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """Rounds of (items, parents' rows) over (tree, index, n, digest), and the trees' roots, as items."""
    rounds = []
    while True:
        items = in_runs(items)
        nodes = materialise(items.select("tree", "run", "pos", "n", "digest").groupBy("tree", "run").applyInArrow(build_run, NODE), "nodes")
        rounds.append((items, nodes))
        items = nodes.filter("top").select("tree", F.col("run").alias("index"), F.ceil(F.col("n") / RUN).cast("long").alias("n"), "digest")
        if items.filter("n > 1").isEmpty():
            return rounds, items


def with_paths(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Parents' rows, the top of each run with the path from there to the root (a few KB)."""
    right = small(paths.select(F.col("tree").alias("__tree"), F.col("index").alias("__run"), "path", "subroot"), paths.count(), 2_000)
    return nodes.join(right, F.col("top") & (F.col("tree") == F.col("__tree")) & (F.col("run") == F.col("__run")), "left").drop("__tree", "__run")


def meet(items: DataFrame, nodes: DataFrame, function, schema: str) -> DataFrame:  # noqa: ANN001
    return items.groupBy("tree", "run").cogroup(nodes.groupBy("tree", "run")).applyInArrow(function, schema)


def manifest(docs: DataFrame, changed: Column, *, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    ``folded_root`` is the root that follows from the row's leaf, tampered with where ``changed`` says so, and all
    other leaves as they are; ``verified`` says whether it is the root.
    """
    spark = docs.sparkSession
    ship(spark)
    placed = materialise(leaves(docs, changed, fields=fields), "items")
    rounds, tops = forest(placed)
    tops = materialise(tops, "subroots")
    trees = tops.count()
    upper, roots = forest(tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("index"), F.lit(trees).cast("long").alias("n"), "digest"))
    found = roots.select(F.lower(F.hex("digest"))).first()
    root = F.lit(found[0] if found else None).cast("string")
    path_schema = f"tree long, index long, path {STEP}, subroot binary"
    paths = roots.select("tree", "index", F.array().cast(STEP).alias("path"), F.lit(None).cast("binary").alias("subroot"))
    for items, nodes in reversed(upper):
        paths = materialise(meet(items.select("tree", "run", "pos", "index"), with_paths(nodes, paths), paths_of_run, path_schema), "paths")
    paths = paths.select(F.col("index").alias("tree"), "path").join(small(tops.select("tree", "index", F.col("digest").alias("subroot")), trees), "tree")
    paths = materialise(paths.select("tree", "index", "path", "subroot"), "paths")
    for items, nodes in reversed(rounds[1:]):
        paths = materialise(meet(items.select("tree", "run", "pos", "index"), with_paths(nodes, paths), paths_of_run, path_schema), "paths")
    (items, nodes) = rounds[0]
    schema = f"doc_id {dict(placed.dtypes)['doc_id']}, leaf string, subroot string, proof_sha256 string, folded_root string"
    folded = meet(items.select("tree", "run", "pos", "doc_id", "digest", "tampered"), with_paths(nodes, paths), fold_run, schema)
    return folded.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
