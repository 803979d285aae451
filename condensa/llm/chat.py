"""Chat formatting as a prefix tree: turns that conversations share from their beginning are emitted once.

A node is a turn after a certain history, named by 16 bytes of a hash chain over (role, text). A conversation's path is its nodes' names,
one after the other, and conversations in the order of their paths are the tree depth-first: each lays out the nodes that the
one before it does not share. So a first pass over the turns makes paths; they alone are sorted, by ranges of path and conversation, and
compared with their neighbour (the first of a range with the last one of the range before); a second pass takes from each conversation
the turns that are its own to lay out. A node's own tokens have one place, `start`, in the emission. With it go its position (tokens of its
ancestors) and the intervals of the emission that it may attend to: its ancestors', neighbours merged. A task keeps the
ancestors of its latest node on a stack; those laid out by ranges before it are on the stack with which the range before ended.

A hot first turn is one node, copies of a conversation are spread by their ids and lay out nothing, and names have one size, so
a conversation of many turns costs its turns and 16 bytes each. Turns of one conversation stream through one task.

The template is <|im_start|>role, line break, text, <|im_end|>, line break. Escaping doubles every
backslash and sets one after the first character of each control string (and writes a line break in a
role as \\n), so the text of a conversation never holds one, and unescape() gives back what came in.

Nulls: a null text or role is empty; rows without conv_id are one conversation; a null turn comes first.
Ties in turn go by role and text; repeated rows are turns each. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import blocks_of, materialise
from .token_cache import encoder

#: What templates in use take as control strings.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_NAME = 16  # bytes of a node's name
#: Characters of conversations in a range of paths, which one task lays out as they stream through it; small tables have as many ranges
#: as the session has use for, of LEAST_RANGE characters or more.
RANGE_CHARS, LEAST_RANGE = 128 << 20, 1 << 19


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    """Head, body and tail of a turn."""
    return f"<|im_start|>{escape(role).replace('\n', '\\n')}\n", escape(text), "<|im_end|>\n"


def parse_turn(formatted: str) -> tuple[str, str]:
    head, body = formatted.removeprefix("<|im_start|>").removesuffix("<|im_end|>\n").split("\n", 1)
    return re.sub(r"\\(n|\\?)", lambda m: "\n" if m[1] == "n" else m[1], head), unescape(body)


def _batch(rows: list[tuple], types, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _name(before: bytes, role: str, text: str) -> bytes:
    return hashlib.sha256(before + f"{len(role)}\n{role}{text}".encode()).digest()[:_NAME]


_ONE = object()  # equal to no conversation


def _paths(batches):
    """(conv_id, path, size in characters) of turns (conv_id, role, text) in order."""
    types, names = (pa.int64(), pa.binary(), pa.int64()), ["conv_id", "path", "size"]
    conv, path, size, done = _ONE, bytearray(), 0, []
    for batch in batches:
        for c, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if c != conv or conv is _ONE:
                if conv is not _ONE:
                    done.append((conv, bytes(path), size))
                conv, path, size = c, bytearray(), 0
            path += _name(bytes(path[-_NAME:]), role or "", text or "")
            size += len(text or "")
        if done:
            yield _batch(done, types, names)
            done = []
    if conv is not _ONE:
        yield _batch([(conv, bytes(path), size)], types, names)


def _common(a: bytes, b: bytes) -> int:
    """Nodes that two paths share from their beginning."""
    n = min(len(a), len(b)) // _NAME
    x, y = (np.frombuffer(p, "<u8", 2 * n).reshape(n, 2) for p in (a, b))
    differ = (x != y).any(1).nonzero()[0]
    return int(differ[0]) if len(differ) else n


_ORDER = "part int, nth long, conv_id long, n_shared int, edge binary"
_ORDER_ARROW = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())


def _ordered_paths(batches):
    """A row a conversation of a range: its place there and how many nodes it shares with the one before. The first has its path for
    an edge, and a row with place -1 has the last path."""
    names = [c.split()[0] for c in _ORDER.split(", ")]
    part, nth, last = TaskContext.get().partitionId(), 0, None
    for batch in batches:
        rows = []
        for c, path in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            rows.append((part, nth, c, 0 if last is None else _common(last, path), path if last is None else None))
            nth, last = nth + 1, path
        if rows:
            yield _batch(rows, _ORDER_ARROW, names)
    if last is not None:
        yield _batch([(part, -1, None, 0, last)], _ORDER_ARROW, names)


def _own_turns(batches):
    """Of turns (none, key, part, nth, n_shared, role, text) in order: those that their conversation lays out, with depth and name."""
    types, names = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.string()), ["part", "nth", "depth", "node", "role", "text"]
    conv, node, depth = _ONE, b"", 0
    for batch in batches:
        rows = []
        for none, key, part, nth, shared, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if (none, key) != conv:
                conv, node, depth = (none, key), b"", 0
            node, depth = _name(node, role or "", text or ""), depth + 1
            if depth > shared:
                rows.append((part, nth, depth, node, role or "", text or ""))
        if rows:
            yield _batch(rows, types, names)


def _joined(intervals: list[tuple[int, int]], own: tuple[int, int]) -> list[tuple[int, int]]:
    """intervals with a later one, which lengthens the last if it follows on it."""
    if intervals and intervals[-1][1] == own[0]:
        return [*intervals[:-1], (intervals[-1][0], own[1])]
    return [*intervals, own]


_SPANS = "array<struct<begin:bigint,end:bigint>>"
_LAID = f"part int, node binary, depth int, place long, n_tokens long, ids binary, loss_begin long, loss_end long, n_outer int, inner {_SPANS}"
_LAID_ARROW = (pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))


def _laid_out(tokenizer: str):
    """Nodes of whole ranges in order. A range ends with a row without a name: its tokens, and the stack it ends with (how many
    ancestors of ranges before are left on it, and the places of those after them); loss_begin: how many there were at first."""
    names = [c.split()[0] for c in _LAID.split(", ")]
    spans = lambda some: [{"begin": b, "end": e} for b, e in some]

    def run(batches):
        enc = encoder(tokenizer)
        part, at, outer, first = None, 0, 0, 0
        stack: list[tuple[tuple[int, int], list[tuple[int, int]]]] = []  # the latest node and its ancestors here; merged up to each

        def tail():
            return (part, None, 0, at, at, None, first, 0, outer, spans(own for own, _ in stack))

        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                some = batch.slice(i, 2048)
                parts, depths, nodes, roles, texts = (some.column(c).to_pylist() for c in (0, 2, 3, 4, 5))
                cuts = [enc.encode(pa.array(x, pa.string())) for x in zip(*map(format_turn, roles, texts), strict=True)]
                ends = [np.concatenate([[0], np.cumsum(n)]) for _, n in cuts]
                rows = []
                for k, (p, depth) in enumerate(zip(parts, depths, strict=True)):
                    if p != part:
                        if part is not None:
                            rows.append(tail())
                        part, at, outer, first, stack = p, 0, depth - 1, depth - 1, []
                    ids = np.concatenate([c[0][e[k] : e[k + 1]] for c, e in zip(cuts, ends, strict=True)])
                    head, body = int(cuts[0][1][k]), int(cuts[1][1][k])
                    loss = (head, head + body) if roles[k] == "assistant" else (0, 0)
                    outer = min(outer, depth - 1)
                    del stack[depth - 1 - outer :]
                    inner = stack[-1][1] if stack else []
                    rows.append((part, nodes[k], depth, at, len(ids), ids.tobytes(), *loss, outer, spans(inner)))
                    own = (at, at + len(ids))
                    stack.append((own, _joined(inner, own)))
                    at += len(ids)
                yield _batch(rows, _LAID_ARROW, names)
        if part is not None:
            yield _batch([tail()], _LAID_ARROW, names)

    return run


def _steps(df: DataFrame) -> DataFrame:
    """A row for each node of `path`, in place of it."""
    names = F.transform(F.sequence(F.lit(1), (F.length("path") / _NAME).cast("int")), lambda i: F.substring("path", (i - 1) * _NAME + 1, F.lit(_NAME)))
    return df.select(*[c for c in df.columns if c != "path"], F.explode(names).alias("node"))


def build_tree(conversations: DataFrame, tokenizer: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(emission, attention, leaves) of conversations (conv_id, turn, role, text).

    emission, a row a node: node, depth, start (place in the emission), n_tokens, ids (little-endian and
    unsigned, 16 bits where the vocabulary has at most 65,536 ids, else 32), loss_begin and loss_end
    (tokens of the node under the loss mask), position and ancestors (intervals of the emission, begin
    and end). attention: node, position and ancestors alone. leaves: conv_id, path of its last node."""
    spark = conversations.sparkSession
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    paths = materialise(ordered.mapInArrow(_paths, "conv_id long, path binary, size long"), "paths")
    leaves = paths.select("conv_id", "path")
    total = paths.agg(F.sum("size")).first()[0] or 0
    ranges = blocks_of(total, RANGE_CHARS, least=min(2 * spark.sparkContext.defaultParallelism, 1 + total // LEAST_RANGE))
    sorted_ = leaves.repartitionByRange(ranges, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    order = materialise(sorted_.mapInArrow(_ordered_paths, _ORDER), "order")
    edges = sorted((r.part, r.nth, bytes(r.edge)) for r in order.filter("edge is not null").select("part", "nth", "edge").collect())  # two rows a range
    shared, last = [], b""
    for part, nth, edge in sorted(edges, key=lambda e: (e[0], e[1] < 0)):
        if nth == 0:
            shared.append((part, _common(last, edge)))
        last = edge
    firsts = spark.createDataFrame(shared, "part int, n_first int")
    turns_of = order.filter("nth >= 0").join(F.broadcast(firsts), "part").select(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).alias("key"), "part", "nth", F.when(F.col("nth") == 0, F.col("n_first")).otherwise(F.col("n_shared")).alias("n_shared"))
    keyed = rows.select(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).alias("key"), "turn", "role", "text").repartition("none", "key")
    joined = keyed.join(turns_of, ["none", "key"]).sortWithinPartitions("none", "key", "turn", "role", "text").select("none", "key", "part", "nth", "n_shared", "role", "text")
    own = joined.mapInArrow(_own_turns, "part int, nth long, depth int, node binary, role string, text string")
    laid = materialise(own.repartitionById(1 + max((p for p, _ in shared), default=0), F.col("part")).sortWithinPartitions("part", "nth", "depth").mapInArrow(_laid_out(tokenizer), _LAID), "laid-out")
    base, stack, outer = 0, [], []
    for r in sorted(laid.filter("node is null").select("part", "n_tokens", "loss_begin", "n_outer", "inner").collect()):  # a row a range
        outer.append((r.part, base, stack[: r.loss_begin]))
        stack = stack[: r.n_outer] + [(base + x.begin, base + x.end) for x in r.inner]
        base += r.n_tokens
    outer = spark.createDataFrame(outer, f"part int, base long, outer {_SPANS}")
    merge = f"aggregate(a, cast(array() as {_SPANS}), (acc, x) -> if(size(acc) > 0 and acc[size(acc) - 1].end = x.begin, concat(slice(acc, 1, size(acc) - 1), array(named_struct('begin', acc[size(acc) - 1].begin, 'end', x.end))), concat(acc, array(x))))"
    placed = laid.filter("node is not null").join(F.broadcast(outer), "part").withColumn("start", F.col("base") + F.col("place"))
    placed = placed.withColumn("a", F.expr("concat(slice(outer, 1, n_outer), transform(inner, x -> named_struct('begin', base + x.begin, 'end', base + x.end)))"))
    placed = placed.withColumn("position", F.expr("aggregate(a, 0L, (acc, x) -> acc + x.end - x.begin)")).withColumn("ancestors", F.expr(merge))
    emission = placed.select("node", "depth", "start", "n_tokens", "ids", "loss_begin", "loss_end", "position", "ancestors")
    return emission, emission.select("node", "position", "ancestors"), leaves


def _letters() -> dict[str, int]:
    from .bpe_count import _byte_letters

    return {c: b for b, c in enumerate(_byte_letters())}


def read_back(emission: DataFrame, leaves: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from the emitted ids.
    Position and ancestors of every node are read with them; an error if they are not those of the turns before."""
    spans = F.flatten(F.transform("ancestors", lambda x: F.array(x["begin"], x["end"]))).alias("spans")
    walks = _steps(leaves).join(emission.select("node", "depth", "ids", "loss_begin", "loss_end", "start", "position", spans), "node")
    ordered = walks.drop("node").repartition("conv_id").sortWithinPartitions("conv_id", "depth")

    def run(batches):
        letters, width = _letters(), encoder(tokenizer).dtype
        with open(tokenizer, encoding="utf-8") as f:
            own = {i: bytes(letters[c] for c in t) for t, i in json.load(f)["model"]["vocab"].items()}
        decode = lambda ids: b"".join(map(own.__getitem__, ids.tolist())).decode()
        conv, begun = None, False
        n = chars = loss_chars = before = 0
        seen: list[tuple[int, int]] = []
        turns, loss = hashlib.sha256(), hashlib.sha256()
        done: list[tuple] = []
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        for batch in batches:
            for c, depth, raw, a, b, start, position, spans in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if not begun or c != conv:
                    if begun:
                        done.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    conv, begun, n, chars, loss_chars = c, True, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                    before, seen = 0, []
                ids = np.frombuffer(raw, width)
                if position != before or spans != [x for span in seen for x in span]:
                    raise ValueError(f"conversation {c}, turn {depth}: position {position} and intervals {spans}, not {before} and {seen}")
                before, seen = before + len(ids), _joined(seen, (start, start + len(ids)))
                formatted = decode(ids)
                role, text = parse_turn(formatted)
                turns.update(f"{role}\n{text}\n".encode())
                under = unescape(decode(ids[a:b]))
                loss.update(under.encode())
                n, chars, loss_chars = n + 1, chars + len(formatted), loss_chars + len(under)
            if done:
                yield table(done)
                done = []
        if begun:
            yield table([(conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)])

    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
