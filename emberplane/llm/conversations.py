"""Repair of conversation structure: the cheapest edits to a legal order of roles, ties by prefix-doubling ranks of audits.

A legal conversation is empty or an optional system turn and then pairs of user and assistant. Rows are numbered in each
conversation (by turn, role and the text's digest) and become one byte each: the role's initial and its faults. Nodes of
the edit graph are (row, state), the state being what was last put out; arcs are Keep, Rerole, Delete and Insert.

- Costs: a dynamic programme from the end to the start. Conversations are cut into blocks of BLOCK rows; a block's costs
  between its 4 entry and 4 exit states are a small matrix, and the matrices of one conversation fold to the cost left after
  each of its blocks, so no task holds a long conversation's rows.
- Paths: arcs on which the costs differ by just their own are optimal. Their nodes are ranked by the least audit of length
  1, 2, 4, ...: the rank at twice a length is that of the pair (rank, rank of the node that many letters on), and pointers
  double alongside. The arc of least letter and rank is a node's step. (Arcs of one node carry different letters, so its
  least audit is one path, and one pointer for each node is enough.) The path itself is read through the doubled pointers.

Texts move once, in order, past the audit of their conversation: rows stream, none are collected. What one task must
hold is a conversation's audit, which is one string of the result anyway.

A null role or text is one space, an empty or other role has no legal initial. A null conv_id is a conversation of its own.
Rows of one turn (null turns first) are ordered by role and then by the SHA-256 of the text; equal rows are duplicates.
A conversation without rows has zeros and an empty audit. A very long text takes memory in proportion in one task. Other
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import files
from .common import discard, written

BLOCK = 4096
WHITE = " \t\n\x0b\x0c\r"
FIRST = 16  # the marker of a row whose role and text come for the first time
LETTERS = np.frombuffer(b"\0DIKR", np.uint8)  # in the order of their bytes; 0 ends an audit
#: Which state follows when user or assistant is put out; states are start, system, user, assistant.
NEXT = np.array([2, 2, 3, 2])
CLOSE = np.array([0, 4, 2, 0], np.int64)  # inserts after the last row: none, user and assistant, assistant, none
FAR = np.int64(1 << 40)


def plain(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) without nulls in role and text."""
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with one of five faults put in by the checksum of `conv_id:turn` (nulls: one space): dropped, emptied, unended, repeated, given to the user."""
    key = F.concat(*(F.coalesce(x, F.lit(" ")) for x in (F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))))
    rows = plain(rows).withColumn("fault_", F.crc32(key.cast("binary")) % 20).filter("fault_ <> 0")
    rows = rows.withColumns({"text": F.when(F.col("fault_") == 1, "").when(F.col("fault_") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")), "role": F.when(F.col("fault_") == 4, "user").otherwise(F.col("role"))})
    return rows.withColumn("copy_", F.explode(F.sequence(F.lit(1), F.when(F.col("fault_") == 3, 2).otherwise(1)))).drop("fault_", "copy_")


def text_key() -> Column:
    return F.unhex(F.sha2(F.col("text"), 256)).alias("key_")


def coded(rows: DataFrame) -> DataFrame:
    """(conv_id, block, codes, blank, duplicate, truncated, illegal): a byte per row in order, and the faults of the block's rows."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    ended = F.right(F.rtrim(F.col("text"), F.lit(WHITE)), F.lit(1))
    initial = F.coalesce(F.nullif(F.instr(F.lit("sua"), F.left("role", F.lit(1))), F.lit(0)), F.lit(4)) - 1
    initial = F.when(F.col("role") == "", 3).otherwise(initial)
    code = (initial + F.when(ended == "", 4).otherwise(0) + F.when(ended.isin(".", "!", "?"), 0).otherwise(8)).cast("int")
    # The running id parts equal rows among tasks; among them any order is the same.
    facts = rows.select("conv_id", "turn", "role", text_key(), code.alias("code"), F.monotonically_increasing_id().alias("id_"))
    placed = files.numbered(facts, ["conv_id"], ["turn", "role", "key_", "id_"], "pos")
    first = placed.groupBy("conv_id", "role", "key_").agg(F.min("pos").alias("pos")).select("conv_id", "pos", F.lit(FIRST).alias("code"))
    both = placed.select("conv_id", "pos", "code").unionByName(first).withColumn("block", F.floor(F.col("pos") / BLOCK).cast("int"))
    lists = both.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("rows"))  # of BLOCK rows at most
    return lists.mapInArrow(_code, f"conv_id {kind}, block int, codes binary, blank long, duplicate long, truncated long, illegal long")


def _code(batches):
    for batch in batches:
        rows = batch.column("rows")
        ends = rows.offsets.to_numpy() - rows.offsets[0].as_py()
        code = rows.flatten().field("code").to_numpy().astype(np.uint8)
        mark = code == FIRST
        again = np.append(~mark[1:], True)[~mark]  # a marker directly follows its row
        ends = (ends - np.concatenate([[0], np.cumsum(mark)])[ends]).astype(np.int64)
        code = code[~mark]
        blank = (code & 4) > 0
        twice = again & ~blank
        cut = ((code & 8) > 0) & ~blank & ~twice
        role = code & 3
        code = (role | (blank | twice) * np.uint8(4) | cut * np.uint8(8)).astype(np.uint8)
        inner = np.ones(len(code), bool)
        inner[ends[:-1]] = False
        wrong = np.append(False, ~legal(role[:-1], role[1:])) & inner
        sums = [pa.array(np.add.reduceat(x, ends[:-1], dtype=np.int64) if len(x) else [], pa.int64()) for x in (blank, twice, cut, wrong)]
        raw = code.tobytes()
        codes = pa.array([raw[s:e] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), codes, *sums], ["conv_id", "block", "codes", "blank", "duplicate", "truncated", "illegal"])


def legal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which neighbours of initials are su, ua or au."""
    return ((a == 0) | (a == 2)) & (b == 1) | (a == 1) & (b == 2)


def arcs(code: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs of going on by Delete, Keep and Rerole from each of the 4 states, given the costs after the row (rows, ..., 4)."""
    shape = (len(code),) + (1,) * (after.ndim - 2)
    role, bound, cut = (x.reshape(shape) for x in (code & 3, (code & 4) > 0, ((code & 8) > 0).astype(np.int64)))
    put = after[..., NEXT]
    rerole = np.where(bound[..., None], FAR, put + 2 + cut[..., None])
    keep = np.full(after.shape, FAR)
    for q in range(4):
        fits = ~bound & ((role == 2) if q == 2 else (role == 1))
        keep[..., q] = np.where(fits, put[..., q] + cut, FAR)
    keep[..., 0] = np.where(~bound & (role == 0), after[..., 1] + cut, keep[..., 0])
    return after + 3, keep, rerole


def costs(code: np.ndarray, first: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Least cost from every node (row, state) of all blocks, `ends` (blocks, exits, 4) being the costs at their ends.
    Block b has the nodes first[b] to first[b] + sizes[b]; the last is its end. All blocks step back one row at a time together."""
    out = np.zeros((int((sizes + 1).sum()), *ends.shape[1:]), np.int64)
    at = first + sizes
    out[at] = ends
    rows = at - np.arange(len(at))  # `code` has no byte for a block's end
    order = np.argsort(-sizes, kind="stable")
    live = np.searchsorted(-sizes[order], -np.arange(1, (sizes.max() if len(sizes) else 0) + 1), "right")
    for back, n in enumerate(live.tolist(), 1):
        b = order[:n]
        node = at[b] - back
        least = np.minimum.reduce(arcs(code[rows[b] - back], out[node + 1]))
        two, three = least[..., 2].copy(), least[..., 3].copy()
        least[..., 2], least[..., 3] = np.minimum(two, three + 2), np.minimum(three, two + 2)
        least[..., :2] = np.minimum(least[..., :2], least[..., 2:3] + 2)
        out[node] = least
    return out


def paths(code: np.ndarray, first: np.ndarray, sizes: np.ndarray, cost: np.ndarray, closing: np.ndarray, starts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The least audit from each start (node * 4 + state), and the node at which it ends. `closing` blocks may insert at their ends."""
    n = len(cost)
    at = first + sizes
    step, letter = np.tile(np.arange(4 * n).reshape(n, 4), (5, 1, 1)), np.zeros((5, n, 4), bool)
    inner = np.ones(n, bool)
    inner[at] = False
    node = np.flatnonzero(inner)
    go = arcs(code, cost[node + 1])
    state = np.arange(4)
    for k, (way, to) in enumerate(zip((1, 3, 4), (state, NEXT, NEXT), strict=True)):
        letter[way][node] = go[k] == cost[node]
        step[way][node] = (node[:, None] + 1) * 4 + to
    kept_system = np.flatnonzero((code & 3) == 0)
    step[3][node[kept_system], 0] = (node[kept_system] + 1) * 4 + 1
    step[2] = np.arange(n)[:, None] * 4 + NEXT
    letter[2] = cost[:, NEXT] + 2 == cost
    letter[2][at[~closing]] = False
    letter[0][at] = ~letter[2][at]

    step, letter = step.reshape(5, -1), letter.reshape(5, -1)
    rank = np.argmax(letter, 0)  # the least audit of one letter
    jump, length = step[rank, np.arange(4 * n)], (rank > 0).astype(np.int64)
    jumps, ranks = [jump], rank
    while (length[jump] > 0).any():
        ranks = np.unique(ranks.astype(np.int64) * (ranks.max() + 1) + ranks[jump], return_inverse=True)[1]
        length = length + length[jump]
        jump = jump[jump]
        jumps.append(jump)
    # The step of a node: of its optimal arcs the one with the least letter and then the least rank beyond it.
    beyond = np.where(letter, np.arange(5)[:, None] * (int(ranks.max(initial=0)) + 1) + ranks[step], np.iinfo(np.int64).max)
    chosen = np.argmin(beyond, 0)
    assert (step[chosen, np.arange(4 * n)] == jumps[0]).all()

    sizes = length[starts]
    stops = np.cumsum(sizes)
    place = np.arange(int(sizes.sum())) - np.repeat(stops - sizes, sizes)
    now, end = np.repeat(starts, sizes), starts.copy()
    for k, jump in enumerate(jumps):
        now = np.where(place >> k & 1, jump[now], now)
        end = np.where(sizes >> k & 1, jump[end], end)
    raw = LETTERS[chosen[now]].tobytes()
    return [raw[e - s : e] for s, e in zip(sizes.tolist(), stops.tolist(), strict=True)], end


def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    texts = batch.column("codes").to_pylist()
    sizes = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes + 1) - sizes - 1, sizes


def _matrices(batches):
    """Costs of each block from its entry states to each of its exit states."""
    exits = np.where(np.eye(4, dtype=bool), 0, FAR)
    for batch in batches:
        if batch.num_rows:
            code, first, sizes = unpacked(batch)
            between = costs(code, first, sizes, np.tile(exits, (len(sizes), 1, 1)))[first]
            ends = [pa.array([x[k] & 3 for x in batch.column("codes").to_pylist()], pa.int32()) for k in (0, -1)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), pa.array(between.reshape(len(sizes), 16).tolist(), pa.list_(pa.int64())), *ends], ["conv_id", "block", "between", "opens", "closes"])


def _left(table: pa.Table) -> pa.Table:
    """The costs left after each block of one conversation, and whether its first row is an illegal neighbour of the block before."""
    table = table.sort_by("block")
    opens, closes = (table.column(c).to_numpy().astype(np.int64) for c in ("opens", "closes"))
    left, now = [], CLOSE
    for between in reversed(table.column("between").to_pylist()):
        left.append(now.tolist())
        now = (np.array(between).reshape(4, 4) + now[:, None]).min(0)
    seam = np.append(0, (~legal(closes[:-1], opens[1:])).astype(np.int64))
    return pa.table({"conv_id": table.column("conv_id"), "block": table.column("block"), "left": pa.array(left[::-1], pa.list_(pa.int64())), "last": pa.array(np.arange(len(left)) == len(left) - 1), "seam": pa.array(seam)})


def _audits(batches):
    """Per block: least audits and exit states from its entry states (of a whole conversation: from the start only), and the cost from the start."""
    for batch in batches:
        if not batch.num_rows:
            continue
        code, first, sizes = unpacked(batch)
        left, last = batch.column("left").to_pylist(), batch.column("last").to_pylist()
        whole = np.array([x is None for x in last])
        ends = np.array([x if x is not None else CLOSE for x in left], np.int64)
        cost = costs(code, first, sizes, ends[:, None])[:, 0]
        many = np.where(whole, 1, 4)
        starts = np.repeat(first * 4, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        found, at = paths(code, first, sizes, cost, whole | np.array([bool(x) for x in last]), starts)
        stops = pa.array(np.append(0, np.cumsum(many)), pa.int32())
        lists = [pa.ListArray.from_arrays(stops, x) for x in (pa.array([f.decode() for f in found], pa.string()), pa.array(at % 4, pa.int32()))]
        names = ["conv_id", "block", "blank", "duplicate", "truncated", "illegal"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(cost[first, 0]), *lists, pa.array(whole)], [*names, "cost", "audits", "exits", "whole"])


def _joined(table: pa.Table) -> pa.Table:
    """The blocks of one conversation: each is entered in the state in which the one before is left."""
    table = table.sort_by("block")
    state, parts = 0, []
    for audits, exits in zip(table.column("audits"), table.column("exits"), strict=True):
        parts.append(audits[state].as_py())
        state = exits[state].as_py()
    sums = {c: [sum(table.column(c).to_pylist())] for c in ("blank", "duplicate", "truncated", "illegal")}
    return pa.table({"conv_id": table.column("conv_id").slice(0, 1), **{c: pa.array(v, pa.int64()) for c, v in sums.items()}, "cost": table.column("cost").slice(0, 1), "audit": ["".join(parts)]})


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation that has rows(conv_id, turn, role, text)."""
    rows = plain(rows)
    kind = rows.schema["conv_id"].dataType.simpleString()
    blocks = written(coded(rows), "blocks")
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"])
    long = blocks.filter("block > 0").select("conv_id").distinct().alias("l")
    parts = blocks.alias("b").join(long, F.expr("b.conv_id <=> l.conv_id"), "left_semi")
    left = parts.mapInArrow(_matrices, f"conv_id {kind}, block int, between array<long>, opens int, closes int").groupBy("conv_id").applyInArrow(_left, f"conv_id {kind}, block int, left array<long>, last boolean, seam long")
    left = left.alias("l")
    met = blocks.alias("b").join(left, F.expr("b.conv_id <=> l.conv_id AND b.block = l.block"), "left")
    met = met.select("b.conv_id", "b.block", "codes", "blank", "duplicate", "truncated", (F.col("illegal") + F.coalesce("seam", F.lit(0))).alias("illegal"), "left", "last")
    done = written(met.mapInArrow(_audits, f"conv_id {kind}, block int, blank long, duplicate long, truncated long, illegal long, cost long, audits array<string>, exits array<int>, whole boolean"), "audits")
    names = ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost"]
    short = done.filter("whole").select(*names, F.col("audits")[0].alias("audit"))
    joined = done.filter("NOT whole").drop("whole").groupBy("conv_id").applyInArrow(_joined, f"conv_id {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    turns = rows.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    found, turns = short.unionByName(joined).alias("f"), turns.alias("t")
    out = written(found.join(turns, F.expr("f.conv_id <=> t.conv_id")).select("f.conv_id", "gaps", *names[1:], "audit"), "audited")
    discard(blocks, done)
    return out


def _walk(batches):
    """Rows in order behind the head row that carries their conversation's audit: the repaired conversation."""
    roles = (None, None, "user", "assistant")
    audit, at, state, place, conv = "", 0, 0, 0, None

    for batch in batches:
        out: list[tuple] = []
        for c, head, turn, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "audit", "turn", "role", "text")), strict=True):
            if head is not None:
                conv, audit, at, state, place = c, head, 0, 0, 0
            else:
                edit = audit[at]
                at += 1
                if edit != "D":
                    state = 1 if edit == "K" and role[0] == "s" else int(NEXT[state])
                    out.append((conv, place, turn, role if edit == "K" else roles[state], text, edit))
                    place += 1
            while at < len(audit) and audit[at] == "I":
                state = int(NEXT[state])
                out.append((conv, place, None, roles[state], "", "I"))
                at, place = at + 1, place + 1
        kinds = (batch.column("conv_id").type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        columns = zip(*out, strict=True) if out else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, kinds, strict=True)], ["conv_id", "place", "turn", "role", "text", "edit"])


def repaired(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """(conv_id, place, turn, role, text, edit): the conversations after their audits, each in order in one partition.
    A row's edit is K, R or I; inserted rows have no turn."""
    rows = plain(rows)
    kind = rows.schema["conv_id"].dataType.simpleString()
    heads = audited.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(None).cast("binary").alias("key_"), "audit")
    both = rows.select("conv_id", "turn", "role", "text", text_key(), F.lit(None).cast("string").alias("audit")).unionByName(heads)
    laid = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), "turn", "role", "key_").drop("key_")
    return laid.mapInArrow(_walk, f"conv_id {kind}, place long, turn long, role string, text string, edit string")


def _digest(batches):
    held, now, kind = None, None, None
    for batch in batches:
        kind = batch.column("conv_id").type
        done: list[tuple] = []
        for conv, place, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "place", "role", "text")), strict=True):
            if place == 0:
                if held is not None:
                    done.append((now, held.hexdigest()))
                held, now = hashlib.sha256(), conv
            else:
                held.update(b"\n")
            held.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], kind), pa.array([x for _, x in done], pa.string())], ["conv_id", "repaired_sha256"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([held.hexdigest()])], ["conv_id", "repaired_sha256"])


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the result of `repaired`: SHA-256 of `role:text` lines, streamed."""
    return turns.mapInArrow(_digest, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")


def repair_report(rows: DataFrame, everyone: DataFrame) -> DataFrame:
    """One row for each conv_id of `everyone`: faults, cost, audit and the digest of the repaired conversation."""
    audited = audits(rows)
    ids, a, d = everyone.select("conv_id").distinct().alias("i"), audited.alias("a"), digests(repaired(rows, audited)).alias("d")
    out = ids.join(a, F.expr("i.conv_id <=> a.conv_id"), "left").join(d, F.expr("i.conv_id <=> d.conv_id"), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("i.conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
