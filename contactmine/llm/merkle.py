"""Merkle manifest of a table: a binary tree of SHA-256 digests per language, a tree over their
roots, and a proof for every row by octopus multiproofs.

Leaves get their places by one range shuffle of digests and sums over the partitions' counts. A
leaf partition is the 2^SPAN leaves under one node; what lies below that node is never stored, and
the levels above are made SPAN at a time, each node from one group of at most 2^SPAN children. To prove
its leaves a partition works out the least set of node coordinates that it can't derive from
its own leaves, all partitions fetch theirs by one join, derive the nodes that their proofs share,
and expand the proof of each leaf on the spot. Texts stay in their scan; only digests move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmine.llm.common import ranked, saved

SPAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER = 7
TOP = ""  # the name of the tree over the roots; the others start with "-" (null) or "="
NODE = "tree string, size bigint, level int, at bigint, h string, is_root boolean"
COORDINATE = "tree string, block bigint, top boolean, level int, at bigint"
PROOF = "doc_id bigint, leaf string, subroot string, root string, proof array<string>, folded_root string"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(size: int) -> int:
    """Levels above the leaves of a tree of ``size`` leaves."""
    return max(0, size - 1).bit_length()


def width(size: int, level: int) -> int:
    """Nodes of a level."""
    return -(-size >> level)


def above(nodes: dict[int, str], size: int, level: int) -> dict[int, str]:
    """The next level's nodes, of those of a level that are known with all their siblings."""
    out, last = {}, width(size, level) - 1
    for at in {i >> 1 for i in nodes}:
        left, right = nodes.get(2 * at), nodes.get(2 * at + 1)
        if left is not None and (right is not None or 2 * at == last):
            out[at] = digest(left, right or "")
    return out


def missing(places: Iterable[int], size: int) -> list[tuple[int, int]]:
    """The least set of ``(level, place)`` from which, with the leaves at ``places``, the proofs of all of them follow."""
    own, out = set(places), []
    for level in range(height(size)):
        out += [(level, i ^ 1) for i in sorted(own) if i ^ 1 not in own and i ^ 1 < width(size, level)]
        own = {i >> 1 for i in own}
    return out


def derived(leaves: dict[int, str], fetched: dict[tuple[int, int], str], size: int) -> list[dict[int, str]]:
    """Level by level, the nodes that the proofs of ``leaves`` need and the root."""
    levels, nodes = [], dict(leaves)
    for level in range(height(size)):
        nodes.update({at: h for (of, at), h in fetched.items() if of == level})
        levels.append(nodes)
        nodes = above(nodes, size, level)
    return [*levels, nodes]


def siblings(levels: list[dict[int, str]], at: int) -> list[str]:
    return [nodes[at >> k ^ 1] for k, nodes in enumerate(levels[:-1]) if at >> k ^ 1 in nodes]


def fold(leaf: str, at: int, size: int, siblings: Iterator[str]) -> str:
    """The root that ``leaf`` and its siblings give."""
    for level in range(height(size)):
        if at ^ 1 >= width(size, level):
            leaf = digest(leaf)
        else:
            leaf = digest(next(siblings), leaf) if at & 1 else digest(leaf, next(siblings))
        at >>= 1
    return leaf


def leaf_digest(values: Iterable[Column]) -> Column:
    """SHA-256 of values with their lengths; nulls are ``-``."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in texts]), 256)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time: a row holds a whole partition."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    names, types = zip(*(f.split() for f in schema.split(", ")))
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types)], list(names))


def _climb(level: int, span: int, whole: bool):
    """The nodes above groups of neighbours of ``level``; above leaves the last alone, or with ``whole`` all and the leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            size, nodes, out = row["size"], {n["at"]: n["h"] for n in row["nodes"]}, []
            top = min(level + span, height(size))
            first = level + 1 if level else 0 if whole else top
            for at_level in range(level, top + 1):
                if at_level >= first:
                    out += [(row["tree"], size, at_level, at, h, at_level == height(size)) for at, h in nodes.items()]
                nodes = above(nodes, size, at_level)
            yield _batch(out, NODE)

    return run


def _grouped(nodes: DataFrame, span: int) -> DataFrame:
    block = F.shiftright("at", span).alias("block")
    return nodes.groupBy("tree", "size", block).agg(F.collect_list(F.struct("at", "h")).alias("nodes"))


def _tree(groups: DataFrame, span: int, whole: bool) -> DataFrame:
    """``[tree, size, level, at, h]`` of the nodes above groups of 2^span leaves; with ``whole`` those below too."""
    largest = groups.agg(F.max("size")).first()[0] or 0
    nodes = saved(groups.select("tree", "size", "nodes").mapInArrow(_climb(0, span, whole), NODE), "nodes")
    level, every = span, nodes
    while height(largest) > level:  # a round for each factor of 2^span
        higher = _grouped(nodes.where(F.col("level") == level), span).mapInArrow(_climb(level, span, whole), NODE)
        nodes = saved(higher.where(F.col("level") > level), "nodes")
        level, every = level + span, every.unionAll(nodes)
    return every


def _wanted(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own = range(row["block"] << span, min((row["block"] + 1) << span, row["size"]))
                out += [(row["tree"], row["block"], False, *found) for found in missing(own, row["size"])]
                out += [(row["tree"], row["block"], True, *found) for found in missing([row["top_at"]], row["top_size"])]
            yield _batch(out, COORDINATE)

    return run


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The proof of each leaf of a partition, and the root that its leaf, tampered with or not, folds to."""
    for row in _rows(batches):
        size, top_at, top_size, leaves = (row[c] for c in ("size", "top_at", "top_size", "leaves"))
        own, over = ({(n["level"], n["at"]): n["h"] for n in row["fetched"] or () if n["top"] == top} for top in (False, True))
        levels = derived({x["at"]: x["h"] for x in leaves}, own, size)
        top = derived({top_at: levels[-1][0]}, over, top_size)
        shared, out = siblings(top, top_at), []
        for x in leaves:
            proof = siblings(levels, x["at"])
            folded = fold(x["changed"] or x["h"], x["at"], size, iter(proof))
            folded = fold(folded, top_at, top_size, iter(shared))
            out.append((x["doc_id"], x["h"], levels[-1][0], top[-1][0], proof + shared, folded))
        yield _batch(out, PROOF)


def manifest(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """``[doc_id, leaf, subroot, root, proof, folded_root]`` for every row of ``[doc_id, source, lang, n_chars, text]``.

    ``proof`` has the siblings' digests from the leaf up; ``folded_root`` is what it gives with the leaf
    computed anew, where 7 divides the CRC-32 of doc_id from a row whose n_chars is one more. Null
    values are leaves of their own kind, not empty texts; null langs are the first tree, rows without
    doc_id its first leaves, and those aren't tampered with. Rows that share a doc_id are ordered by
    their digests; rows that repeat are leaves each. A tree of one leaf is that leaf. An empty
    table gives an empty result; other columns are ignored."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    values = {c: F.col(c) for c in FIELDS}
    changed = values | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0, F.lit(False))
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")).alias("tree"), F.col("doc_id").cast("bigint").alias("doc_id"),
        leaf_digest(values.values()).alias("h"), F.when(tampered, leaf_digest(changed.values())).alias("changed"),
        F.monotonically_increasing_id().alias("tie"),
    )
    leaves = ranked(saved(leaves, "leaves"), "tree", ["doc_id", "h", "tie"])
    # a row for each leaf partition
    leaf = F.struct("at", "h", "doc_id", "changed")
    parts = saved(leaves.groupBy("tree", "size", F.shiftright("at", span).alias("block")).agg(F.collect_list(leaf).alias("leaves")), "parts")
    pairs = F.transform("leaves", lambda x: F.struct(x["at"].alias("at"), x["h"].alias("h")))
    nodes = _tree(parts.select("tree", "size", "block", pairs.alias("nodes")), span, False)
    roots = nodes.where("is_root").select("tree", "h")
    tops = saved(ranked(saved(roots.withColumn("all", F.lit(TOP)), "roots"), "all", ["tree"]), "tops")
    top_leaves = tops.select(F.col("all").alias("tree"), "size", "at", "h")
    over = _tree(_grouped(top_leaves, span), span, True)
    stored = nodes.select(F.lit(False).alias("top"), F.col("tree").alias("of"), "level", "at", "h").unionAll(
        over.select(F.lit(True), "tree", "level", "at", "h")
    )
    own = parts.select("tree", "size", "block").join(
        tops.select("tree", F.col("at").alias("top_at"), F.col("size").alias("top_size")), "tree"
    )
    own = saved(own, "own")
    wanted = own.mapInArrow(_wanted(span), COORDINATE).withColumn("of", F.when(F.col("top"), F.lit(TOP)).otherwise(F.col("tree")))
    fetched = wanted.join(stored, ["top", "of", "level", "at"]).groupBy("tree", "block").agg(
        F.collect_list(F.struct("top", "level", "at", "h")).alias("fetched")
    )
    ready = parts.join(own.drop("size"), ["tree", "block"]).join(fetched, ["tree", "block"], "left")
    return ready.select("size", "top_at", "top_size", "leaves", "fetched").mapInArrow(_expand, PROOF)


def verified(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """``[doc_id, leaf, subroot, root, proof_sha256, folded_root, verified]``: the manifest with its proofs as digests."""
    return manifest(docs, span).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.concat_ws("", "proof"), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
