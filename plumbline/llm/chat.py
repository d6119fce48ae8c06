"""Reply trees as conversations: paths by iterative self-joins, branches by score, one text for each path.

Messages point to the message they answer. Joining the pointers with themselves doubles their reach, so
that a tree of depth d takes log2(d) joins; joining the leaves with the pointers, from the widest to the
narrowest, then gives every leaf each of its ancestors once. A branch's score is the mean of its messages';
a tree's best branches are formatted.

The template marks turns by control strings. Where a text holds a control string, or a backslash, it is
escaped: backslashes are doubled, and one is put behind a control string's first character. Reading back
removes a backslash and keeps what follows it, which is unambiguous, as control strings hold none.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import scratch

#: Strings that chat tokenizers may read as marks (fixed values).
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


@dataclass(frozen=True)
class Template:
    """`begin`role\\ntext`end`\\n for each turn; the texts of `trained` roles make the loss mask."""

    begin: str = "<|im_start|>"
    end: str = "<|im_end|>"
    trained: tuple[str, ...] = ("assistant",)
    controls: tuple[str, ...] = field(default=CONTROLS)

    def __post_init__(self):
        if any("\\" in c or "\n" in c or len(c) < 2 for c in self.controls) or not {self.begin, self.end} <= {*self.controls}:
            raise ValueError("control strings need two characters, no backslash or line end, and begin and end among them")

    def escape(self, text: str) -> str:
        text = text.replace("\\", "\\\\")
        for c in self.controls:
            text = text.replace(c, f"{c[0]}\\{c[1:]}")
        return text

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def format(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The text, and the spans (code points, ends exclusive) under the loss mask."""
        out, at, spans = [], 0, []
        for role, text in turns:
            head = f"{self.begin}{self.escape(role).replace(chr(10), chr(92) + chr(10))}\n"
            body = self.escape(text)
            tail = f"{self.end}\n"
            if role in self.trained:
                spans.append((at + len(head), at + len(head) + len(body)))
            out += [head, body, tail]
            at += len(head) + len(body) + len(tail)
        return "".join(out), spans

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """The turns of format's text."""
        turns, at = [], 0
        while at < len(formatted):
            if not formatted.startswith(self.begin, at):
                raise ValueError(f"no turn begins at {at}")
            stop = formatted.index(self.end, at)
            turn = formatted[at + len(self.begin) : stop]
            cut = re.search(r"(?<!\\)(?:\\\\)*\n", turn).end() - 1
            turns.append((self.unescape(turn[:cut]), self.unescape(turn[cut + 1 :])))
            at = stop + len(self.end) + 1
        return turns


def pointers(edges: DataFrame) -> list[DataFrame]:
    """[(tree, id, up, total)] where up is the ancestor 1, 2, 4, ... messages above, and total their scores' sum.

    edges: (tree, id, up, total) of messages and their parents.
    """
    out = [scratch(edges, "up")]
    while True:
        last = out[-1]
        up = last.select("tree", F.col("id").alias("up"), F.col("up").alias("far"), F.col("total").alias("more"))
        wider = scratch(last.join(up, ["tree", "up"]).select("tree", "id", F.col("far").alias("up"), (F.col("total") + F.col("more")).alias("total")), "up")
        if wider.isEmpty():
            return out
        out.append(wider)


def _pointers(messages: DataFrame) -> list[DataFrame]:
    known = messages.select("tree", F.col("id").alias("up"), F.col("score").alias("total"))
    return pointers(messages.where("parent is not null").select("tree", "id", F.col("parent").alias("up")).join(known, ["tree", "up"]).select("tree", "id", "up", "total"))


def leaf_scores(messages: DataFrame, ups: list[DataFrame]) -> DataFrame:
    """(tree, leaf, score): the mean score of the messages from each leaf up to its root, a row a leaf at every step."""
    parents = ups[0].select("tree", F.col("up").alias("id")).distinct()
    at = messages.select("tree", F.col("id").alias("leaf"), "id", F.col("score").alias("sum"), F.lit(1).cast("long").alias("n")).join(parents, ["tree", "id"], "left_anti")
    for k in range(len(ups) - 1, -1, -1):
        jump = at.join(ups[k], ["tree", "id"], "left")
        n = F.col("n") + F.when(F.col("up").isNull(), 0).otherwise(1 << k)
        at = jump.select("tree", "leaf", F.coalesce("up", "id").alias("id"), (F.col("sum") + F.coalesce("total", F.lit(0.0))).alias("sum"), n.alias("n"))
    return scratch(at.select("tree", "leaf", (F.col("sum") / F.col("n")).alias("score")), "leaves")


def root_to_leaf_paths(messages: DataFrame, ups: list[DataFrame] | None = None, leaves: DataFrame | None = None) -> DataFrame:
    """(tree, leaf, id, distance): each leaf with all messages from it (0) up to its root.

    messages: (tree, id, parent, score), where (tree, id) is unique and none is null but parent. A parent that
    is missing makes a root; messages that answer each other in a circle have no leaf and give no path.
    leaves: (tree, leaf) of the paths that are wanted, all by default.
    """
    ups = ups or _pointers(messages)
    if leaves is None:
        parents = ups[0].select("tree", F.col("up").alias("id")).distinct()
        leaves = messages.select("tree", "id").join(parents, ["tree", "id"], "left_anti").withColumnRenamed("id", "leaf")
    paths = leaves.select("tree", "leaf", F.col("leaf").alias("id"), F.lit(0).cast("long").alias("distance"))
    for k in range(len(ups) - 1, -1, -1):
        above = paths.join(ups[k], ["tree", "id"]).select("tree", "leaf", F.col("up").alias("id"), (F.col("distance") + (1 << k)).alias("distance"))
        paths = scratch(paths.unionByName(above), "paths")
    return paths


def format_trees(messages: DataFrame, branches: int = 1, template: Template | None = None) -> DataFrame:
    """(tree, leaf, rank, score, n_turns, formatted, loss) of each tree's `branches` best paths.

    messages: (tree, id, parent, role, text, score). Null roles and texts are empty, null scores 0. Of
    paths with equal scores the smaller leaf comes first; a path's score is its messages' mean. Only the
    best paths are enumerated. loss: array<struct<start, end>>, code points.
    """
    template = template or Template()
    m = messages.select("tree", "id", "parent", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    m = scratch(m, "messages")
    ups = _pointers(m)
    order = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    best = leaf_scores(m, ups).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches)
    paths = root_to_leaf_paths(m, ups, best.select("tree", "leaf"))
    chosen = paths.join(best, ["tree", "leaf"]).join(m.select("tree", "id", "role", "text"), ["tree", "id"])
    turn = F.struct((-F.col("distance")).alias("at"), "role", "text")
    whole = chosen.groupBy("tree", "leaf", "rank", "score").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                n, text, loss = [], [], []
                for turns in part.column(4).to_pylist():
                    formatted, spans = template.format([(t["role"], t["text"]) for t in turns])
                    n.append(len(turns))
                    text.append(formatted)
                    loss.append([{"start": s, "end": e} for s, e in spans])
                arrays = [*[part.column(c) for c in range(4)], pa.array(n, pa.int64()), pa.array(text, pa.string()), pa.array(loss, span)]
                yield pa.RecordBatch.from_arrays(arrays, names=["tree", "leaf", "rank", "score", "n_turns", "formatted", "loss"])

    key = lambda c: f"{c} {whole.schema[c].dataType.simpleString()}"
    kinds = f"{key('tree')}, {key('leaf')}, rank int, score double, n_turns long, formatted string, loss array<struct<start: long, end: long>>"
    return whole.mapInArrow(run, kinds)


def linear_messages(rows: DataFrame) -> DataFrame:
    """(tree, id, parent, role, text, score) of conversations given as rows by turn: each answers the one before.

    rows: (conv_id, turn, role, text). Rows of one turn follow each other by role and text; a null turn
    comes first; rows of a null conv_id are one conversation.
    """
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = rows.withColumn("id", F.row_number().over(by).cast("long"))
    parent = F.when(F.col("id") > 1, F.col("id") - 1)
    return n.select(F.col("conv_id").alias("tree"), "id", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))
