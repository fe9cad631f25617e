"""Exact k nearest neighbours within one table.

The usual all-pairs form is avoided in five ways:

* equal vectors are answered once, and only their k + 1 smallest ids are
  candidates, so a large group of copies costs what one vector costs;
* a tree of pivots deals the candidates to leaves, with few distances each;
* a vector is first compared in its own leaf, then only with leaves that may
  hold something nearer than the k + 1 best found there;
* large leaves are cut into blocks of bounded size by a hash of the id, and two
  blocks of one leaf meet once for both; leaves that are visited lie in sections
  of many leaves, and a vector is sent once to each section that it visits, with
  the leaves in there marked, in blocks of bounded size too;
* in a block a matrix product rules out what is surely too far, so that few
  distances are taken, and each block returns its k + 1 best per vector.

The result is exact: pruning uses true bounds and nothing is capped. In very
high dimensions the bounds rule out little and the work nears all pairs of
blocks, still in bounded pieces.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daypanel.operators.pivot_tree import PivotTree, closest
from daypanel.sources.tables import written

BLOCK_ROWS = 4096
#: Sections of leaves that are aimed at, and bytes of one's vectors from which on there are more sections.
SECTIONS, SECTION_BYTES = 12, 32 << 20
#: Vectors per leaf that are aimed at, and most leaves; beyond that leaves grow and are cut into more blocks.
LEAF_ROWS, MAX_LEAVES = 1024, 16_384
#: Vectors that the tree is fitted on, about. Any sample gives the same neighbours.
SAMPLE = 65_536


def nearest(
    df: DataFrame,
    id: str,
    vector: str,
    k: int,
    carry: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """(id, neighbour, distance, place, neighbour_<carried>), `place` 1..k.

    Euclidean distance over an array<double> column without nulls; ties go to
    the smaller neighbour id. `carry` names columns of the neighbour's row.
    """
    rows = df.select(
        F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("vector"), *carry
    )
    heads = distinct_heads(rows, k)
    if heads.isEmpty():
        return _result(rows, heads, None, k, carry)
    placed, tree = plant(heads, leaf_rows)
    first = written(_within_leaves(placed, tree, k, carry, block_rows))
    size = section_rows(tree, block_rows)
    plan = sections(tree, size)
    sent = written(section_visits(placed, _best(first, k, carry), tree, k, plan))
    further = _search_sections(placed, sent, plan, size, k, carry)
    return _result(rows, heads, _best(first.unionByName(further), k, carry), k, carry)


def distinct_heads(rows: DataFrame, k: int) -> DataFrame:
    """Of equal vectors the k + 1 rows with the smallest ids, numbered by `copy`."""
    # The hash comes first so that sorting seldom compares whole vectors. The limit
    # on `copy` is applied before the exchange, so copies do not pile up in a task.
    copies = Window.partitionBy("hash", "vector").orderBy("id")
    hashed = rows.withColumn("hash", F.xxhash64("vector"))
    return written(hashed.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("hash"))


def plant(heads: DataFrame, leaf_rows: int = LEAF_ROWS) -> tuple[DataFrame, PivotTree]:
    """`heads` with the `path` to their leaves and the distances `far` to its pivots, and the tree with its counts and radii."""
    firsts = heads.where(F.col("copy") == 1)
    distinct = firsts.count()
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < math.ceil(min(1.0, SAMPLE / distinct) * (1 << 30))
    chosen = firsts.where(share).orderBy(F.xxhash64("id"), "id").select("vector").toPandas()["vector"]
    sample = _matrix(chosen if len(chosen) else firsts.select("vector").limit(1).toPandas()["vector"])
    tree = PivotTree(sample, max(1, min(MAX_LEAVES, math.ceil(distinct / leaf_rows))))
    sent = heads.sparkSession.sparkContext.broadcast(tree)

    def place(batches):
        for batch in batches:
            if len(batch):
                paths, far = sent.value.place(_matrix(batch["vector"]))
                yield batch.assign(path=paths, far=far, leaf=np.array([p[-1] if p else 0 for p in paths], np.int32))

    placed = written(heads.mapInPandas(place, f"{_ddl(heads)}, path array<int>, far array<double>, leaf int"))
    steps = placed.select(F.inline(F.arrays_zip("path", "far")))
    nodes = steps.groupBy("path").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()
    tree.measure({r["path"]: (r["n"], r["radius"]) for r in nodes}, placed.count())
    return placed, tree


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in vectors])


def _leaf_chunks(tree: PivotTree, spark, block_rows: int) -> DataFrame:
    """(leaf, chunks): blocks of the candidates of each leaf; a row per leaf."""
    leaves = np.flatnonzero((tree.children == 0) & (tree.counts > 0)).tolist()
    return F.broadcast(spark.createDataFrame([(leaf, max(1, math.ceil(int(tree.counts[leaf]) / block_rows))) for leaf in leaves], "leaf int, chunks int"))


def section_rows(tree: PivotTree, block_rows: int) -> int:
    """Vectors of a section: as many as make some `SECTIONS`, but no more than `SECTION_BYTES` hold."""
    most = SECTION_BYTES // (8 * max(1, tree.pivots.shape[1]))
    return max(block_rows, min(most, math.ceil(int(tree.counts[0]) / SECTIONS)))


def sections(tree: PivotTree, size: int) -> pd.DataFrame:
    """(leaf, section, slot, rows): neighbouring leaves in sections of some `size` vectors, numbered within by `slot`."""
    leaves = np.flatnonzero((tree.children == 0) & (tree.counts > 0))
    counts = tree.counts[leaves]
    section = (np.cumsum(counts) - counts) // size
    out = pd.DataFrame({"leaf": leaves, "section": section, "rows": counts})
    return out.assign(slot=out.groupby("section").cumcount())


def _nearest_of(
    ids: np.ndarray,
    vectors: np.ndarray,
    block: pd.DataFrame,
    k: int,
    carry: Sequence[str],
    limit: np.ndarray | None = None,
    meetings: Iterable[tuple[np.ndarray, np.ndarray]] | None = None,
) -> pd.DataFrame:
    """The k + 1 best of `block`, which is ordered by id, for each id; with a limit only those within it."""
    other = _matrix(block["vector"])
    limit = np.full(len(ids), np.inf) if limit is None else limit
    meetings = [(np.arange(len(ids)), np.arange(len(block)))] if meetings is None else meetings
    # Columns are in the order of the ids: ties go to the smaller id.
    row, column, distance = closest(vectors, other, limit, min(k + 1, len(block)), meetings)
    found = {"query": ids[row], "distance": distance, "neighbour": block["id"].to_numpy()[column]}
    return pd.DataFrame({**found, **{c: block[c].to_numpy()[column] for c in carry}})


def _none(carry: Sequence[str]) -> pd.DataFrame:
    return pd.DataFrame(columns=["query", "distance", "neighbour", *carry])


def _found_ddl(placed: DataFrame, carry: Sequence[str]) -> str:
    kind = placed.schema["id"].dataType.simpleString()
    return f"query {kind}, distance double, neighbour {kind}" + "".join(f", {c} {placed.schema[c].dataType.simpleString()}" for c in carry)


def _within_leaves(placed: DataFrame, tree: PivotTree, k: int, carry: Sequence[str], block_rows: int) -> DataFrame:
    """(query, distance, neighbour, carried): the k + 1 best of every block of the vector's own leaf."""
    plan = _leaf_chunks(tree, placed.sparkSession, block_rows)
    chunk = F.pmod(F.xxhash64("id"), "chunks").cast("int")
    dealt = placed.join(plan, "leaf").withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = dealt.select(
        "leaf", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "id", "vector", "copy", *carry
    )

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        i, j = frame["i"].iloc[0], frame["j"].iloc[0]
        one, two = frame[frame["chunk"] == i], frame[frame["chunk"] == j]
        sides = [(one, two)] if i == j else [(one, two), (two, one)]
        out = []
        for asking, asked in sides:
            asking = asking[asking["copy"] == 1]
            if len(asking) and len(asked):
                out.append(_nearest_of(asking["id"].to_numpy(), _matrix(asking["vector"]), asked, k, carry))
        return pd.concat(out, ignore_index=True) if out else _none(carry)

    return met.groupBy("leaf", "i", "j").applyInPandas(search, _found_ddl(placed, carry))


def _best(found: DataFrame, k: int, carry: Sequence[str]) -> DataFrame:
    """(query, near): the k + 1 best candidates found for each vector, in order."""
    near = F.slice(F.sort_array(F.collect_list(F.struct("distance", "neighbour", *carry))), 1, k + 1)
    return found.groupBy("query").agg(near.alias("near"))


def visits(placed: DataFrame, first: DataFrame, tree: PivotTree, k: int) -> DataFrame:
    """(query, vector, limit, leaf): the leaves besides its own that may hold one of a vector's k + 1 nearest.

    `limit` is the distance of the last of the k + 1 found so far, or, with
    fewer, a radius that holds as many.
    """
    kind = placed.schema["id"].dataType.simpleString()
    asking, sent_to = _asking(placed, first, tree, k)

    def send(batches):
        for batch, limit, row, leaf in sent_to(batches):
            edges = np.searchsorted(row, np.arange(len(batch) + 1))
            leaves = [leaf[a:b].astype("int32") for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pd.DataFrame({"query": batch["id"], "vector": batch["vector"], "limit": limit, "leaves": leaves})

    mapped = asking.mapInPandas(send, f"query {kind}, vector array<double>, limit double, leaves array<int>")
    return mapped.select("query", "vector", "limit", F.explode("leaves").alias("leaf"))


def section_visits(placed: DataFrame, first: DataFrame, tree: PivotTree, k: int, plan: pd.DataFrame) -> DataFrame:
    """(query, vector, limit, sections, leaves): a row per vector, `leaves` with a bit for each leaf of a section that it visits."""
    kind = placed.schema["id"].dataType.simpleString()
    asking, sent_to = _asking(placed, first, tree, k)
    section, slot = np.zeros(len(tree.counts), np.int64), np.zeros(len(tree.counts), np.int64)
    section[plan["leaf"]], slot[plan["leaf"]] = plan["section"], plan["slot"]
    # The bits of a section are whole bytes.
    width = -(-plan.groupby("section")["slot"].max().add(1).reindex(range(int(plan["section"].max()) + 1), fill_value=0).to_numpy() // 8)
    start = np.append(0, np.cumsum(width))
    bit = 8 * start[section] + slot

    def send(batches):
        for batch, limit, row, leaf in sent_to(batches):
            marks = np.zeros((len(batch), 8 * int(start[-1])), bool)
            marks[row, bit[leaf]] = True
            packed = np.packbits(marks, axis=1)
            visited = [np.unique(s).astype("int32") for s in np.split(section[leaf], np.searchsorted(row, np.arange(1, len(batch))))]
            leaves = [[p[start[s] : start[s + 1]].tobytes() for s in v.tolist()] for p, v in zip(packed, visited, strict=True)]
            yield pd.DataFrame({"query": batch["id"], "vector": batch["vector"], "limit": limit, "sections": visited, "leaves": leaves})

    return asking.mapInPandas(send, f"query {kind}, vector array<double>, limit double, sections array<int>, leaves array<binary>")


def _asking(placed: DataFrame, first: DataFrame, tree: PivotTree, k: int):
    """The distinct vectors with what they found so far, and a reader of their batches: (batch, limits, rows, leaves to visit)."""
    sent = placed.sparkSession.sparkContext.broadcast(tree)
    last = first.select("query", F.get("near", F.lit(k))["distance"].alias("found"))
    firsts = placed.where(F.col("copy") == 1).select("id", "vector", "path", "far", "leaf")
    asking = firsts.join(last, firsts["id"] == last["query"], "left").select("id", "vector", "path", "far", "leaf", "found")

    def sent_to(batches):
        for batch in batches:
            if not len(batch):
                continue
            known = sent.value
            bound = np.array([known.reach(list(p), list(f), k + 1) for p, f in zip(batch["path"], batch["far"], strict=True)])
            limit = np.fmin(batch["found"].to_numpy(float), bound)
            row, leaf = known.visits(_matrix(batch["vector"]), limit)
            other = leaf != batch["leaf"].to_numpy()[row]
            order = np.argsort(row[other], kind="stable")
            yield batch, limit, row[other][order], leaf[other][order]

    return asking, sent_to


def _search_sections(placed: DataFrame, sent: DataFrame, plan: pd.DataFrame, size: int, k: int, carry: Sequence[str]) -> DataFrame:
    """(query, distance, neighbour, carried): the best of each block of the sections that are visited, within the limit."""
    spark = placed.sparkSession
    visited = sent.select("query", "vector", "limit", F.inline(F.arrays_zip("sections", "leaves")).alias("section", "leaves"))
    asked = {r["section"]: r["n"] for r in sent.select(F.explode("sections").alias("section")).groupBy("section").agg(F.count("*").alias("n")).collect()}
    n = lambda rows: max(1, math.ceil(rows / size))
    held = plan.groupby("section")["rows"].sum()
    # A section is larger than aimed at by a part of its last leaf; only where that is large is it cut.
    rows = [(int(s), n(int(held[s]) // 2), n(asked[s])) for s in held.index if s in asked]
    blocks = F.broadcast(spark.createDataFrame(rows, "section int, chunks int, parts int"))
    slots = F.broadcast(spark.createDataFrame(plan[["leaf", "section", "slot"]].astype("int32")))
    candidates = (
        placed.join(slots, "leaf")
        .join(blocks, "section")
        .withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks").cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("section", "chunk", "part", "slot", "id", "vector", *carry)
    )
    asking = (
        visited.join(blocks, "section")
        .withColumn("part", F.pmod(F.xxhash64("query"), "parts").cast("int"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("section", "chunk", "part", "query", "vector", "limit", "leaves")
    )

    def search(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(block):
            return _none(carry)
        block = block.sort_values("id", kind="stable").reset_index(drop=True)
        bits = np.unpackbits(np.frombuffer(b"".join(queries["leaves"]), np.uint8).reshape(len(queries), -1), axis=1)
        slot = block["slot"].to_numpy()
        meetings = ((np.flatnonzero(bits[:, s]), np.flatnonzero(slot == s)) for s in np.unique(slot))
        return _nearest_of(queries["query"].to_numpy(), _matrix(queries["vector"]), block, k, carry, queries["limit"].to_numpy(), meetings)

    key = ["section", "chunk", "part"]
    return asking.groupBy(*key).cogroup(candidates.groupBy(*key)).applyInPandas(search, _found_ddl(placed, carry))


def _result(rows: DataFrame, heads: DataFrame, lists: DataFrame | None, k: int, carry: Sequence[str]) -> DataFrame:
    """Back from distinct vectors to rows: a row's own id is left out of its list."""
    extras = [F.col(f"at.{c}").alias(f"neighbour_{c}") for c in carry]
    if lists is None:
        near = F.array(F.struct(F.lit(0.0).alias("distance"), F.col("id").alias("neighbour"), *carry))
        answered = heads.select(F.col("vector"), near.alias("near"))
    else:
        firsts = heads.where(F.col("copy") == 1).select(F.col("id").alias("query"), "vector")
        answered = firsts.join(lists, "query").select("vector", "near")
    # Copies of one vector may be a large share of the rows; the hash finds them,
    # the vector itself decides (hash twins share a list of rows to filter).
    keyed = rows.select("id", "vector").withColumn("hash", F.xxhash64("vector"))
    sided = answered.select(F.xxhash64("vector").alias("hash"), F.col("vector").alias("head"), "near")
    mine = keyed.join(sided, "hash").where(F.col("vector") == F.col("head"))
    others = F.slice(F.filter("near", lambda e: e["neighbour"] != F.col("id")), 1, k)
    return mine.select("id", F.posexplode(others).alias("pos", "at")).select(
        "id",
        F.col("at.neighbour").alias("neighbour"),
        F.col("at.distance").alias("distance"),
        (F.col("pos") + 1).alias("place"),
        *extras,
    )


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
