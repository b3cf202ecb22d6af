"""The trie of all conversations' prefixes, with sums over every subtree by centroid decomposition.

A node is a distinct sequence of first turns. It is told by 120 bits: SHA-256 of each place and turn, combined by XOR, which can be
computed in runs of a long conversation and carried on.

Sums over subtrees: the components of the forest of parent edges begin as the whole trie. Each step takes the centroid of every
component, the deepest node under which more than half of its weight lies, adds the total of what is under it to all nodes on the path from the
centroid to the component's top, and takes it away; the centroid's children and the rest are components of at most half the weight. A path is
read off the conversation that stands for the centroid, an ancestor off the one that stands for the node, so nothing is walked.
Weights are members of nodes, whose sums over subtrees need no trie. Components that fit into a task take the same steps there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import WORD, Shelf, materialize, ordered_positions

#: Turns of one conversation that are combined by one task; nodes of a component that fits into a task; neighbouring ids whose decimals are joined at once.
RUN, TASK_NODES, ID_BITS = 4096, 4096, 12
NODE, TOP = ["x", "y"], ["cx", "cy"]


def ordered_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): ``conv``, ``i`` (0-based place), ``digest`` (of role and text) and ``words`` of every turn; ``conv`` and ``n`` of every conversation.

    Turns are in the order of their numbers, null first, equal ones by role, then text; a null role or text counts as empty. Rows without a
    conversation are left out; repeated rows stay; other columns are ignored. Rows are dealt by ranges, also inside a
    conversation, and their texts are shuffled once.
    """
    role_, text_ = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    rows = df.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), role_.alias("role"), text_.alias("text"))
    rows = rows.withColumns({"digest": F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256), "words": F.regexp_count("text", F.lit(WORD)).cast("long")})
    placed = ordered_positions(rows, ["conv", F.asc_nulls_first("turn"), "role", "text"], name="turns", keep=["conv", "digest", "words"])
    convs = placed.groupBy("conv").agg(F.min("pos").alias("start"), F.count("*").alias("n"))
    turns = placed.join(convs, "conv").select("conv", (F.col("pos") - F.col("start")).alias("i"), "digest", "words")
    return turns, convs.select("conv", "n")


def _prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each conversation and depth from 0 on: the node ``x``, ``y`` of its first ``depth`` turns, its parent ``px``, ``py``, ``words`` of the last turn, and the conversation's ``n``."""
    bits = F.sha2(F.concat(F.col("i").cast("string"), F.lit(":"), "digest"), 256)
    part = lambda at: F.conv(F.substring("bits", at, 15), 16, 10).cast("long")
    rows = turns.join(convs, "conv").withColumn("bits", bits)
    rows = rows.select("conv", "i", "words", "n", F.floor(F.col("i") / RUN).alias("run"), part(1).alias("gx"), part(16).alias("gy"))
    inside = Window.partitionBy("conv", "run").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # a row for each run
    runs = rows.filter(F.col("n") > RUN).groupBy("conv", "run").agg(F.bit_xor("gx").alias("rx"), F.bit_xor("gy").alias("ry"))
    runs = runs.select("conv", "run", F.bit_xor("rx").over(before).alias("bx"), F.bit_xor("ry").over(before).alias("by"))
    found = rows.withColumns({"x": F.bit_xor("gx").over(inside), "y": F.bit_xor("gy").over(inside)}).join(runs, ["conv", "run"], "left")
    carried = lambda c, b: F.col(c).bitwiseXOR(F.coalesce(F.col(b), F.lit(0)))
    found = found.select("conv", (F.col("i") + 1).alias("depth"), carried("x", "bx").alias("x"), carried("y", "by").alias("y"), "gx", "gy", "words", "n")
    found = found.select("conv", "depth", "x", "y", F.col("x").bitwiseXOR(F.col("gx")).alias("px"), F.col("y").bitwiseXOR(F.col("gy")).alias("py"), "words", "n")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    return found.unionByName(convs.select("conv", zero.alias("depth"), zero.alias("x"), zero.alias("y"), none.alias("px"), none.alias("py"), zero.alias("words"), "n"))


def split_off(parent: np.ndarray, depth: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the values' columns over every subtree of a forest (parent -1: a top), by the steps of the module for all its components at once.

    weight is the sum over the node's subtree of positive weights.
    """
    order = np.argsort(depth, kind="stable")
    weight, sums, top = weight.copy(), np.zeros_like(values), np.arange(len(parent))

    def levels(nodes: np.ndarray) -> list[np.ndarray]:
        return np.split(nodes, np.flatnonzero(np.diff(depth[nodes])) + 1) if len(nodes) else []

    for nodes in levels(order):
        inner = nodes[parent[nodes] >= 0]
        top[inner] = top[parent[inner]]
    left, centre, under = order, np.full(len(parent), -1), np.full(len(parent), -1)
    while len(left):
        heavy = left[2 * weight[left] > weight[top[left]]]
        centre[top[heavy]] = heavy  # nodes are in the order of their depths: the deepest is the last
        mine = centre[top[left]]
        centres = left[mine == left]
        under[left] = -1
        for nodes in levels(left):
            inner = nodes[top[nodes] != nodes]
            above = parent[inner]
            under[inner] = np.where(centre[top[inner]] == above, inner, under[above])
        low = under[left] >= 0
        total = np.zeros_like(values)
        np.add.at(total, mine[low | (mine == left)], values[left[low | (mine == left)]])
        sums[centres] += total[centres]
        at, of = centres, centres
        while len(at):
            going = top[at] != at
            at, of = parent[at[going]], of[going]
            sums[at] += total[of]
            weight[at] -= weight[of]
        top[left[low]] = under[left[low]]
        left = left[mine != left]
    return sums


def _in_tasks(nodes: DataFrame, values: list[str]) -> DataFrame:
    """The steps for components of at most TASK_NODES nodes, many of them at once."""
    names = [*NODE, *values]

    def sums(held: pa.Table) -> pa.RecordBatch:
        keys = list(zip(held["x"].to_pylist(), held["y"].to_pylist()))
        place = {k: i for i, k in enumerate(keys)}
        is_top = (held["x"].to_numpy() == held["cx"].to_numpy()) & (held["y"].to_numpy() == held["cy"].to_numpy())
        parent = np.array([-1 if t else place[k] for t, k in zip(is_top.tolist(), zip(held["px"].to_pylist(), held["py"].to_pylist()))], np.int64)
        added = split_off(parent, held["depth"].to_numpy(), held["weight"].to_numpy(), np.stack([held[v].to_numpy() for v in values], 1))
        return pa.RecordBatch.from_arrays([held["x"].combine_chunks(), held["y"].combine_chunks(), *(pa.array(c) for c in added.T)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            cx, cy = held["cx"].to_numpy(), held["cy"].to_numpy()
            cuts = np.flatnonzero((cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1]))
            if len(cuts):  # all but the last component are whole
                yield sums(held.slice(0, cuts[-1] + 1))
                held = held.slice(cuts[-1] + 1)
        if held is not None:
            yield sums(held)

    rows = nodes.select(*TOP, *NODE, "px", "py", "depth", "weight", *values)
    return rows.repartition(*TOP).sortWithinPartitions(*TOP, "depth").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def rolled_up(nodes: DataFrame, prefixes: DataFrame, values: list[str], task_nodes: int = TASK_NODES) -> DataFrame:
    """``x``, ``y`` and the sums of the values over the subtree of every node of a trie.

    nodes has ``x``, ``y``, ``px``, ``py``, ``depth``, ``conv`` (a member), ``weight`` (sum over the subtree of positive weights) and the values;
    prefixes are the nodes of every conversation by depth. Steps over all components with more than ``task_nodes`` nodes are taken until none is left;
    each halves a component's weight, so that they grow with the logarithm of the trie.
    """
    shelf, added, small = Shelf(), [], []
    now = nodes.select(*NODE, "px", "py", "depth", "conv", "weight", *values, *(F.lit(0).cast("long").alias(c) for c in TOP))
    paths = prefixes.select(F.col("conv").alias("_conv"), F.col("depth").alias("_depth"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("px").alias("_px"), F.col("py").alias("_py"))
    same = lambda a, b: (F.col(f"{a}x") == F.col(f"{b}x")) & (F.col(f"{a}y") == F.col(f"{b}y"))
    total = [F.sum(v).alias(v) for v in values]
    while True:
        sizes = now.groupBy(*TOP).agg(F.count("*").alias("size"), F.max("weight").alias("whole"), F.min("depth").alias("highest"))
        now = shelf.put(now.join(sizes, TOP), "components")
        small.append(now.filter(F.col("size") <= task_nodes).drop("size", "whole", "highest"))
        large = now.filter(F.col("size") > task_nodes)
        if large.isEmpty():
            break
        centre = F.max_by(F.struct("x", "y", "depth", "conv", "weight"), "depth")
        centres = large.filter(2 * F.col("weight") > F.col("whole")).groupBy(*TOP).agg(centre.alias("g"), F.min("highest").alias("highest"))
        names = {"x": "gx", "y": "gy", "depth": "gdepth", "conv": "gconv", "weight": "gweight"}
        centres = shelf.put(centres.select(*TOP, "highest", *(F.col(f"g.{a}").alias(b) for a, b in names.items())), "centroids")
        on_path = paths.join(centres, (F.col("_conv") == F.col("gconv")) & (F.col("_depth") < F.col("gdepth")) & (F.col("_depth") >= F.col("highest")))
        on_path = shelf.put(on_path.select(*TOP, "_x", "_y"), "paths")
        # the ancestor just below the centroid's depth: the centroid's child, if the node is below the centroid
        seen = large.drop("highest").join(centres.drop("highest"), TOP)
        seen = seen.join(paths, (F.col("_conv") == F.col("conv")) & (F.col("_depth") == F.col("gdepth") + 1) & (F.col("depth") > F.col("gdepth")), "left")
        seen = seen.withColumns({"below": F.coalesce(same("_p", "g"), F.lit(False)), "is_centre": same("", "g")}).withColumnsRenamed({"_x": "ax", "_y": "ay"})
        seen = seen.join(on_path.select("_x", "_y", F.lit(True).alias("on_path")), same("", "_"), "left").drop("_x", "_y")
        seen = shelf.put(seen.select(*NODE, "px", "py", "depth", "conv", "weight", *values, *TOP, "gweight", "below", "is_centre", "on_path", "ax", "ay"), "split")
        under = seen.filter("below OR is_centre").groupBy(*TOP).agg(*total)
        ends = on_path.select(*TOP, F.col("_x").alias("x"), F.col("_y").alias("y")).unionByName(centres.select(*TOP, F.col("gx").alias("x"), F.col("gy").alias("y")))
        added.append(ends.join(under, TOP).select(*NODE, *values))
        kept = seen.filter(~F.col("is_centre"))
        less = F.when(F.col("on_path"), F.col("weight") - F.col("gweight")).otherwise(F.col("weight"))
        tops = [F.when(F.col("below"), F.col(a)).otherwise(F.col(c)).alias(c) for a, c in zip(("ax", "ay"), TOP)]
        now = kept.select(*NODE, "px", "py", "depth", "conv", less.alias("weight"), *values, *tops)
    added.append(_in_tasks(reduce(DataFrame.unionByName, small), values))
    out = materialize(reduce(DataFrame.unionByName, added).groupBy(*NODE).agg(*total), "subtrees")
    shelf.clear()
    return out


def _digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined decimal ids that end at each node, in ascending order.

    Neighbouring ids become one string in Spark; a node's strings, in order, are fed to one hash, which cannot be split but holds a string at a time.
    """
    near = F.shiftright("conv", ID_BITS)
    text = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    chunks = ends.groupBy(*NODE, near.alias("near")).agg(text.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for x, y, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (x, y) != node:
                    if state:
                        out.append((*node, state.hexdigest()))
                    node, state = (x, y), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*NODE, "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([node[0]]), pa.array([node[1]]), pa.array([state.hexdigest()])], names=[*NODE, "ends_sha256"])

    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "near").select(*NODE, "ids").mapInArrow(run, "x long, y long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, task_nodes: int = TASK_NODES) -> DataFrame:
    """A row for each distinct prefix: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.

    turns and convs are as :func:`ordered_turns` gives them, with a row in convs for conversations without turns too; those end at the root, the
    prefix of depth 0. ``n_leaves`` counts the childless nodes of the subtree, which its top belongs to; ``saved_tokens`` adds up the words of
    each node's last text that are there more than once. Equal conversations share all nodes; no conversations give no rows.
    """
    shelf = Shelf()
    prefixes = shelf.put(_prefixes(turns, convs), "prefixes")
    found = prefixes.groupBy(*NODE).agg(
        F.min("conv").alias("conv"), F.min("depth").alias("depth"), F.min("px").alias("px"), F.min("py").alias("py"),
        F.count("*").alias("n_convs"), F.min("words").alias("words"), F.sum(F.col("n") - F.col("depth") + 1).alias("weight"),
    )
    found = shelf.put(found, "found")
    children = found.groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("n_children"))
    nodes = found.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")})
    nodes = shelf.put(nodes.drop("words"), "nodes")
    sums = rolled_up(nodes, prefixes, ["n_leaves", "saved_tokens"], task_nodes)
    parents = nodes.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv").alias("parent_conv_id"))
    out = nodes.drop("n_leaves", "saved_tokens").join(parents, ["px", "py"], "left").join(sums, NODE)
    out = out.join(_digests(prefixes.filter("depth = n").select(*NODE, "conv")), NODE, "left")
    nothing: Column = F.lit(hashlib.sha256(b"").hexdigest())
    out = out.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
    out = materialize(out, "trie")
    shelf.clear()
    return out
