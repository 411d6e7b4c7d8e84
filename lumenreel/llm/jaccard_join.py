"""Jaccard self-join on word shingles as a blocked sparse matrix product.

Documents are rows and shingles columns of a sparse matrix; the product with its transpose counts overlaps. The
columns are cut into blocks by hash, and every block is multiplied in a task of its own. Bounds that follow from
the sizes of two sets keep the product small without losing a pair:

1. Sets are taken once per distinct content. Blocks of columns count in how many sets each shingle occurs, and
   tell every set its shingles that occur elsewhere. A set with fewer than 3/4 of its shingles elsewhere has no
   partner and is done: for most texts that is all.
2. In the order of rarity, linked sets of sizes n and m share a shingle among the first n - ceil(3n/4) + 1 of
   one and m - ceil(3m/4) + 1 of the other. Only these are columns of the product. A pair is dropped if its
   sizes are too different or if what is left after the shared place can't reach ceil(3 (n + m) / 7).
3. Remaining pairs get their exact overlap from the two lists of shared shingles.

Long columns (groups of near copies, common passages) aren't listed as pairs: at first each of their sets meets a
few hubs only, those with the smallest numbers, which are the same in all columns of a group. Links make components.
The sets of long columns that still have several components are then multiplied in tiles of two slices, with all
their shared shingles: a task has the exact overlaps of its tile at hand, and hands on only links that join
components, fewer than its rows. So every link between components is found, and no pair leaves a task unverified.

Defined results: a null text counts as empty. A text without words has no shingles and is linked with nothing.
Fewer than five words are one shingle. Equal sets are linked. Repeated rows give repeated rows of one component.
An empty table gives no rows. Other columns are ignored. Shingles are told apart by a hash of 64 bits, in the
product by 48 of them and the block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, written
from .components import components
from .shingles import set_digest, shingle_sets

#: Shingles gathered before a task hands on a row per block.
GATHERED = 250_000
#: Columns up to this length are multiplied as a whole at once; longer ones meet this many hubs first.
SHORT, HUBS = 48, 6
#: Cells of a block, about.
BLOCK = 4_000_000
#: Sets and cells of a slice, about; a tile is two slices. Dense columns and counted cells that are looked at together.
TILE, TILE_CELLS, WIDE, EXPANDED = 1024, 1_000_000, 2048, 1_000_000

SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("node", pa.int64())])
CELLS = "block int, nodes binary, counts binary, cells binary"
LISTS = "node long, n long, shared binary, known long"
POSTINGS = "block int, column long, node long, n long, place long"


def _node(digest: bytes, clashes: dict[bytes, int]) -> int:
    """63 bits of the digest; the few digests that agree in them have negative numbers of their own."""
    return clashes.get(digest) or int.from_bytes(digest[:8], "little") >> 1


def set_rows(docs: DataFrame) -> tuple[DataFrame, dict[bytes, int]]:
    """Per row: doc_id, n_shingles, and the number of its set (node); the numbers of digests that clash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text"))
            digests = [set_digest(s) if len(s) else None for s in sets]
            nodes = [None if d is None else _node(d, {}) for d in digests]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(nodes, pa.int64())], schema=SETS,
            )

    rows = written(texts(docs).mapInArrow(run, "doc_id long, n_shingles long, digest binary, node long"))
    # two of n sets agree in 63 bits n * n / 2 ** 64 times: none, or a handful
    twice = rows.groupBy("node").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a != b")
    twice = rows.join(twice.select("node"), "node", "left_semi").select("digest").distinct()
    clashes = {bytes(r["digest"]): -1 - k for k, r in enumerate(twice.orderBy("digest").collect())}
    for digest, node in clashes.items():
        rows = rows.withColumn("node", F.when(F.col("digest") == F.lit(digest), F.lit(node)).otherwise(F.col("node")))
    return rows, clashes


def _six(numbers: np.ndarray) -> np.ndarray:
    """The upper 48 bits as six bytes each."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]


def _from_six(data: bytes, low: int = 0) -> np.ndarray:
    """The numbers again, with ``low`` as their lower 16 bits."""
    found = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    found[:, 2:] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return found.view("<u8").ravel() | np.uint64(low)


def _packed_by(keys: np.ndarray, nodes: np.ndarray, cells: np.ndarray) -> list[tuple[int, bytes, bytes, bytes]]:
    """Rows (key, nodes, cells per node, cells) of cells that are sorted by key and, within it, by node."""
    if not len(keys):
        return []
    new_node = np.empty(len(keys), dtype=bool)
    new_node[0] = True
    new_node[1:] = (nodes[1:] != nodes[:-1]) | (keys[1:] != keys[:-1])
    starts = np.flatnonzero(new_node)
    counts = np.diff(np.append(starts, len(keys))).astype("<u4")
    heads = keys[starts]
    cuts = np.flatnonzero(np.append(True, heads[1:] != heads[:-1]))
    rows = []
    for a, b in zip(cuts, np.append(cuts[1:], len(starts))):
        lo, hi = starts[a], starts[b] if b < len(starts) else len(keys)
        rows.append((int(heads[a]), nodes[starts[a:b]].astype("<i8").tobytes(), counts[a:b].tobytes(), cells[lo:hi].tobytes()))
    return rows


def _cells(docs: DataFrame, clashes: dict[bytes, int], blocks: int) -> DataFrame:
    """The matrix in blocks of columns: of each set that a task meets, the shingles of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        sets: list[np.ndarray] = []
        nodes: list[int] = []
        gathered = 0

        def handed_on() -> pa.RecordBatch:
            cells = np.concatenate(sets)
            owner = np.repeat(np.array(nodes, dtype=np.int64), [len(s) for s in sets])
            block = (cells & np.uint64(blocks - 1)).astype(np.int32)
            order = np.argsort(block, kind="stable")
            rows = _packed_by(block[order], owner[order], _six(cells[order]))
            sets.clear()
            nodes.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))],
                names=["block", "nodes", "counts", "cells"],
            )

        for batch in batches:
            for found in shingle_sets(batch.column("text")):
                if not len(found) or (node := _node(set_digest(found), clashes)) in met:
                    continue
                met.add(node)
                sets.append(found)
                nodes.append(node)
                gathered += len(found)
                if gathered >= GATHERED:
                    gathered = 0
                    yield handed_on()
        if sets:
            yield handed_on()

    return texts(docs).select("text").mapInArrow(run, CELLS)


def _unpacked(rows: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Node of every cell, and the cells' bytes."""
    nodes = np.frombuffer(b"".join(rows["nodes"]), dtype="<i8")
    counts = np.frombuffer(b"".join(rows["counts"]), dtype="<u4")
    return np.repeat(nodes, counts), np.frombuffer(b"".join(rows["cells"]), dtype=np.uint8).reshape(-1, width)


def _shared(blocks: int):
    """In a block: the shingles of more than one set, with a code of how many, by the sets' buckets."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        block = int(rows["block"].iloc[0])
        nodes, cells = _unpacked(rows, 6)
        columns = _from_six(cells.tobytes())
        order = np.argsort(columns)
        columns, nodes = columns[order], nodes[order]
        same = columns[1:] == columns[:-1]
        again = np.append(False, same) | np.append(same, False)
        columns, nodes = columns[again], nodes[again]
        order = np.lexsort((nodes, columns))  # a set may come from several tasks
        columns, nodes = columns[order], nodes[order]
        once = np.append(True, (columns[1:] != columns[:-1]) | (nodes[1:] != nodes[:-1]))[: len(columns)]
        columns, nodes = columns[once], nodes[once]
        starts = np.flatnonzero(np.append(True, columns[1:] != columns[:-1])[: len(columns)])
        lengths = np.diff(np.append(starts, len(columns)))
        often = np.repeat(lengths, lengths)
        code = np.minimum(255, np.round(8 * np.log2(np.maximum(often, 1)))).astype(np.uint8)
        keep = often > 1
        columns, nodes, code = columns[keep], nodes[keep], code[keep]
        bucket = (nodes % blocks).astype(np.int32)
        order = np.lexsort((nodes, bucket))
        cells = np.concatenate([_six(columns[order]), code[order, None]], axis=1)
        found = pd.DataFrame(_packed_by(bucket[order], nodes[order], cells), columns=["bucket", "nodes", "counts", "cells"])
        return found.assign(block=block)[["bucket", "block", "nodes", "counts", "cells"]]

    return run


def _least(n: np.ndarray) -> np.ndarray:
    """Smallest overlap of a set of n with any partner."""
    return (3 * n + 3) // 4


def _list_rows(_, rows: pd.DataFrame, sizes: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket's sets that can have partners: their shared shingles, rarest first.

    ``known`` is the number of shingles before them in that order, those of no other set.
    """
    out = {"node": [], "n": [], "shared": [], "known": []}
    if len(rows):
        parts = [_unpacked(rows.iloc[k : k + 1], 7) for k in range(len(rows))]
        nodes = np.concatenate([p[0] for p in parts])
        cells = np.concatenate([p[1] for p in parts])
        blocks = np.repeat(rows["block"].to_numpy(), [len(p[0]) for p in parts])
        columns = _from_six(np.ascontiguousarray(cells[:, :6]).tobytes()) | (blocks.astype(np.uint64) & np.uint64(0xFFFF))
        order = np.lexsort((columns, cells[:, 6], nodes))
        nodes, columns = nodes[order], columns[order]
        starts = np.flatnonzero(np.append(True, nodes[1:] != nodes[:-1]))
        ends = np.append(starts[1:], len(nodes))
        n_of = dict(zip(sizes["node"], sizes["n"]))
        for a, b in zip(starts, ends):
            n = int(n_of[int(nodes[a])])
            if b - a >= _least(n):
                for name, value in zip(out, (int(nodes[a]), n, columns[a:b].tobytes(), n - (b - a))):
                    out[name].append(value)
    return pd.DataFrame(out)


def _postings(blocks: int):
    """The columns of the product: each set's first shared shingles, with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for node, n, shared, known in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "shared", "known"))):
                first = np.frombuffer(shared, dtype="<u8")[: n - _least(n) + 1 - known]
                parts.append((first, node, n, known))
            columns = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
            lengths = [len(p[0]) for p in parts]
            spread = lambda k, p=parts, le=lengths: np.repeat(np.array([x[k] for x in p], dtype=np.int64), le)
            place = spread(3) + (np.concatenate([np.arange(x) for x in lengths]) if parts else np.zeros(0, np.int64))
            block = ((columns >> np.uint64(20)) & np.uint64(blocks - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block), pa.array(columns.view(np.int64)), pa.array(spread(1)), pa.array(spread(2)), pa.array(place)],
                names=["block", "column", "node", "n", "place"],
            )

    return run


def _bounded(n: np.ndarray, m: np.ndarray, left_n: np.ndarray, left_m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m whose first shared shingle leaves so many can still be linked."""
    return (4 * np.minimum(n, m) >= 3 * np.maximum(n, m)) & (7 * np.minimum(left_n, left_m) >= 3 * (n + m))


def _product(rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs of a block: of short columns all, of long ones each set with the hubs."""
    rows = rows.sort_values(["column", "node"], kind="stable")
    column, node, n = rows["column"].to_numpy(), rows["node"].to_numpy(), rows["n"].to_numpy()
    left = n - rows["place"].to_numpy()
    starts = np.flatnonzero(np.append(True, column[1:] != column[:-1]))
    ends = np.append(starts[1:], len(column))
    found: set[tuple[int, int]] = set()
    for a, b in zip(starts, ends):
        for k in range(a, a + HUBS if b - a > SHORT else b - 1):
            others = np.arange(k + 1, b)
            fit = others[_bounded(n[k], n[others], left[k], left[others])]
            found.update((int(node[k]), int(x)) for x in node[fit])
    return pd.DataFrame(list(found), columns=["a", "b"], dtype="int64")


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for n, m, a, b in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "shared_a", "shared_b"))):
            both = len(np.intersect1d(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8"), assume_unique=True))
            keep.append(100 * both >= 75 * (n + m - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verified(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """The pairs whose exact overlap links them."""
    side = lambda name: lists.select(
        F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("shared").alias(f"shared_{name}")
    )
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_linked, "a long, b long")


def _overlaps(x: np.ndarray, x_of: np.ndarray, y: np.ndarray, y_of: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """The product of two slices: how many shingles each of the first has in common with each of the second.

    ``x`` and ``y`` are the shingles of all sets of a slice, ``x_of`` and ``y_of`` the rows they belong to. Columns
    that many sets have are multiplied as dense matrices, ``WIDE`` at a time; of the others every cell is counted.
    """
    both = np.intersect1d(x, y)
    counts = np.zeros(shape, dtype=np.float32)
    if not len(both):
        return counts
    sides = []
    for cells, owner in ((x, x_of), (y, y_of)):
        column = np.searchsorted(both, cells)
        column[column == len(both)] = 0
        has = both[column] == cells
        column, owner = column[has], owner[has]
        order = np.argsort(column, kind="stable")
        sides.append((column[order], owner[order], np.bincount(column, minlength=len(both))))
    (x_col, x_row, x_len), (y_col, y_row, y_len) = sides
    x_at, y_at = np.append(0, np.cumsum(x_len)), np.append(0, np.cumsum(y_len))
    dense = x_len * y_len * 64 >= shape[0] * shape[1]
    places = np.flatnonzero(dense)
    for k in range(0, len(places), WIDE):
        some = places[k : k + WIDE]
        new = np.full(len(both), -1)
        new[some] = np.arange(len(some))
        factors = []
        for column, row, size in ((x_col, x_row, shape[0]), (y_col, y_row, shape[1])):
            at = new[column]
            matrix = np.zeros((size, len(some)), dtype=np.float32)
            matrix[row[at >= 0], at[at >= 0]] = 1
            factors.append(matrix)
        counts += factors[0] @ factors[1].T
    flat = counts.reshape(-1)
    keep = np.flatnonzero(~dense[x_col])  # cells of the first slice in short columns: each meets its column's others
    width = y_len[x_col[keep]]
    upto = np.cumsum(width)
    at = 0
    while at < len(keep):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + EXPANDED, side="right")))
        cells, times = keep[at:to], width[at:to]
        inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        partner = y_row[np.repeat(y_at[x_col[cells]], times) + inner]
        np.add.at(flat, np.repeat(x_row[cells], times) * shape[1] + partner, np.float32(1))
        at = to
    return counts


def _tile_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Links of a tile that join different components, no more of them than join them: fewer than the tile has rows."""
    nothing = pd.DataFrame({"a": [], "b": []}, dtype="int64")
    first = rows[~rows["second"]]
    second = rows[rows["second"]] if rows["second"].any() else first
    if not len(first) or rows["root"].nunique() < 2:
        return nothing
    cells = lambda side: np.frombuffer(b"".join(side["shared"]), dtype="<u8")
    owners = lambda side: np.repeat(np.arange(len(side)), side["shared"].str.len().to_numpy() // 8)
    both = _overlaps(cells(first), owners(first), cells(second), owners(second), (len(first), len(second)))
    n, m = first["n"].to_numpy(), second["n"].to_numpy()
    label, other = first["root"].to_numpy().copy(), second["root"].to_numpy().copy()
    found = []
    for k in range(len(first)):
        fit = np.flatnonzero((175 * both[k].astype(np.int64) >= 75 * (n[k] + m)) & (other != label[k]))
        if len(fit):
            merged, at = np.unique(other[fit], return_index=True)
            found.extend((first["node"].iloc[k], second["node"].iloc[j]) for j in fit[at])
            here = label[k]
            label[np.isin(label, merged)] = here
            other[np.isin(other, merged)] = here
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64") if found else nothing


def _open_members(postings: DataFrame, roots: DataFrame) -> DataFrame:
    """Sets of long columns with several components: anchor, node, n, root.

    The columns of a passage or of a group have nearly the same sets, so they are put together by their smallest one,
    the anchor; sets that share an open column share an anchor.
    """
    rows = postings.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    columns = rows.groupBy("column").agg(
        F.count("*").alias("length"), F.min("node").alias("anchor"), F.min("root").alias("lo"), F.max("root").alias("hi")
    )
    columns = columns.filter((F.col("length") > SHORT) & (F.col("lo") < F.col("hi"))).select("column", "anchor")
    return rows.join(written(columns), "column").select("anchor", "node", "n", "root").distinct()


def _tiles(members: DataFrame, lists: DataFrame) -> DataFrame:
    """Every two sets of an anchor that can be linked, in different components, side by side in some tile of bounded size.

    Sets are parted by size class (partners are in the same or the next class) and by whether they belong to the
    component that most sets of the anchor are in, whose sets don't meet each other. Parts are cut into slices.
    """
    by_root = members.groupBy("anchor", "root").agg(F.count("*").alias("sets"))
    main = by_root.groupBy("anchor").agg(F.max_by("root", F.struct("sets", "root")).alias("main"))
    members = members.join(main, "anchor").select(
        "anchor", "node", "n", "root",
        (F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(4 / 3) * 1.000001)) * 2
         + (F.col("root") == F.col("main")).cast("int")).alias("part"),
    )
    parts = written(members.groupBy("anchor", "part").agg(
        F.greatest(F.ceil(F.count("*") / F.lit(TILE)), F.ceil(F.sum("n") / F.lit(TILE_CELLS))).alias("slices")
    ))
    members = members.join(parts, ["anchor", "part"]).select(
        "anchor", "node", "n", "root",
        (F.shiftleft(F.col("part"), 40) + F.pmod(F.xxhash64("node"), F.col("slices"))).alias("slice"),
    )
    size_class, is_main = (lambda c: F.shiftright(c, 1)), (lambda c: c.bitwiseAND(F.lit(1)))
    one = parts.select("anchor", F.col("part").alias("p"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("i"))
    two = parts.select("anchor", F.col("part").alias("q"), F.col("slices").alias("_q_slices"))
    pairs = one.join(two, "anchor").filter(
        (F.col("p") <= F.col("q")) & (size_class(F.col("q")) - size_class(F.col("p")) <= 1)
        & (is_main(F.col("p")) + is_main(F.col("q")) < 2)
    )
    pairs = pairs.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("_q_slices") - 1)))
    pairs = pairs.filter((F.col("p") < F.col("q")) | (F.col("i") <= F.col("j"))).select(
        "anchor", (F.shiftleft(F.col("p"), 40) + F.col("i")).alias("x"), (F.shiftleft(F.col("q"), 40) + F.col("j")).alias("y")
    )
    pairs = written(pairs)
    placed = members.withColumnRenamed("slice", "x").join(pairs, ["anchor", "x"]).withColumn("second", F.lit(False))
    placed = placed.unionByName(
        members.withColumnRenamed("slice", "y").join(pairs.filter("x <> y"), ["anchor", "y"]).withColumn("second", F.lit(True))
    )
    return placed.join(lists.select("node", "shared"), "node")


def _blocks(rows: DataFrame) -> int:
    """Blocks of about ``BLOCK`` cells, a power of two, at least as many as partitions."""
    cells = rows.filter("node is not null").groupBy("node").agg(F.max("n_shingles").alias("n")).agg(F.sum("n")).first()[0]
    least = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), (cells or 0) // BLOCK)
    return min(1 << (least - 1).bit_length(), 1 << 30)


def links(docs: DataFrame, rows: DataFrame, clashes: dict[bytes, int]) -> DataFrame:
    """Links (a, b) between numbers of sets, enough of them to connect every component."""
    blocks = _blocks(rows)
    shared = _cells(docs, clashes, blocks).groupBy("block").applyInPandas(
        _shared(blocks), "bucket int, block int, nodes binary, counts binary, cells binary"
    )
    sizes = rows.filter("node is not null").select(
        F.pmod("node", F.lit(blocks)).cast("int").alias("bucket"), "node", F.col("n_shingles").alias("n")
    ).distinct()
    lists = written(
        shared.groupBy("bucket").cogroup(sizes.groupBy("bucket")).applyInPandas(
            lambda key, x, y: _list_rows(key, x, y), LISTS
        )
    )
    postings = written(lists.mapInArrow(_postings(blocks), POSTINGS))
    pairs = postings.groupBy("block").applyInPandas(_product, "a long, b long").distinct()
    found = written(_verified(pairs, lists))
    members = written(_open_members(postings, written(components(found))))
    more = _tiles(members, lists).groupBy("anchor", "x", "y").applyInPandas(_tile_links, "a long, b long")
    return found.unionByName(written(more))


def joined(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the smallest doc_id that links reach."""
    rows, clashes = set_rows(docs)
    roots = written(components(links(docs, rows, clashes)))
    classes = rows.filter("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("size")
    )
    classes = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    linked = classes.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("size").alias("size"))
    linked = written(linked.filter("size > 1"))
    classes = classes.select("node", "root").join(linked, "root").select("node", "component_id")
    return rows.join(classes, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are the smallest of their component.

    Documents are told apart by doc_id; rows without one stay.
    """
    gone = joined(docs).filter("component_id < doc_id").select(F.col("doc_id").alias("_llm_gone")).distinct()
    return docs.join(written(gone), docs["doc_id"].cast("bigint") == F.col("_llm_gone"), "left_anti")
