"""Chat formatting with a prefix tree over conversations.

A turn is written ``<|role|>text</s>``.  Inside roles and texts a backslash is doubled and one
is put after every ``<``, ``[`` and ``|``, so no control string can occur there, and the text
can be read back.  Tokens are the UTF-8 bytes of the written text (ids 0-255), so the packed
tokens are kept as binary.

Conversations that share initial turns share the nodes of a prefix tree.  Distinct paths are
ranked by a global sort of their node keys, which puts every subtree together; a node belongs
to the first path that has it.  The new nodes of a path are consecutive in depth-first order
and form one segment.  Output:

* ``segments``: segment, seq_start (offset of its first token in the depth-first sequence of
  all tokens), position_start (number of tokens before it on its path: the position id of its
  first token, the others follow), tokens, loss (spans [start, end) of assistant texts, from
  the segment's start) and attend (spans [start, end) of the sequence that hold its
  ancestors; inside the segment attention is causal);
* ``index``: conv_id, segments' spans [start, end) on its path in order: reading them gives the
  conversation.

The tree is never held in one place: node keys are prefix hashes (128 bits and the depth),
nodes and segments come from grouping and joining on them, offsets from sums per range
partition.  What one task holds is one conversation.

Edge cases: a null text or role is written as empty; turns are ordered by turn (null first),
then role and text, so ties and repeated rows have a fixed order and all stay; rows with a
null conversation id form one conversation (id null); an empty table gives empty outputs;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandlens.llm.stage import partitions, staged

NO_ID = -(1 << 63)
OPEN, CLOSE, END = "<|", "|>", "</s>"
TURN = re.compile(r"<\|(.*?)\|>(.*?)</s>", re.DOTALL)
ESCAPED = re.compile(r"([<\[|])\\|\\\\")


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for x in "<[|":
        c = F.replace(c, F.lit(x), F.lit(x + "\\"))
    return c


def unescape(s: str) -> str:
    return ESCAPED.sub(lambda m: m[1] or "\\", s)


class Packed(NamedTuple):
    segments: DataFrame
    index: DataFrame
    convs: DataFrame  # conv_id -> path


def pack(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
         text_col: str = "text", loss_role: str = "assistant") -> Packed:
    """Prefix tree of the conversations; see the module's text for the outputs.  ``index`` has one row per
    distinct path, ``convs`` the path of every conversation."""
    spark = conversations.sparkSession
    rows = conversations.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    order = W.partitionBy("conv").orderBy("turn", "role", "text")
    so_far = W.partitionBy("conv").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    turns = rows.withColumn("d", F.row_number().over(order))
    for k in (1, 2):
        turns = turns.withColumn(f"x{k}", F.bit_xor(F.xxhash64(F.lit(k), "d", "role", "text")).over(so_far))
    turns = staged(turns.select("conv", "d", "x1", "x2", "role", "text"), "turns")
    node = ["d", "x1", "x2"]

    sequence = F.array_sort(F.collect_list(F.struct("d", "x1")))
    convs = staged(turns.groupBy("conv").agg(
        F.max_by(F.struct("d", "x1", "x2"), "d").alias("leaf"),
        F.array_join(F.transform(sequence, lambda s: F.lpad(F.hex(s["x1"]), 16, "0")), "").alias("path"))
        .select("conv", "leaf.*", "path"), "convs")
    paths = convs.groupBy(*node).agg(F.min("conv").alias("conv"), F.min("path").alias("path"))
    ranked = staged(paths.repartitionByRange(partitions(spark), "path", "x2").sortWithinPartitions("path", "x2")
                    .select("conv", F.col("d").alias("n_turns"), F.col("x1").alias("leaf1"), F.col("x2").alias("leaf2"),
                            F.monotonically_increasing_id().alias("rank")), "paths")

    on_path = staged(turns.join(ranked.select("conv", "rank"), "conv").select("rank", *node, "role", "text"), "nodes")
    owner = staged(on_path.groupBy(*node).agg(F.min("rank").alias("owner")), "owner")
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE))
    own = (on_path.join(owner, node).filter("rank = owner")
           .select("rank", *node, "role", head.alias("head"), escape(F.col("text")).alias("body"))
           .withColumn("n", F.octet_length("head") + F.octet_length("body") + len(END)))
    before = W.partitionBy("rank").orderBy("d").rowsBetween(W.unboundedPreceding, -1)
    own = staged(own.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0))), "own")

    body = F.col("at") + F.octet_length("head")
    loss = F.when(F.col("role") == loss_role, F.struct(body.alias("start"), (body + F.octet_length("body")).alias("end")))
    grouped = own.groupBy("rank").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("d", F.concat("head", "body", F.lit(END)).alias("s")))),
                                 lambda s: s["s"]), "").cast("binary").alias("tokens"),
        F.array_sort(F.collect_list(loss)).alias("loss"), F.sum("n").alias("n_tokens"))
    # rank >> 33 is the range partition that ranked the path: offsets are sums inside the
    # partition plus the totals of the partitions before it (one row for each partition).
    part = F.shiftright("rank", 33)
    inside = W.partitionBy("part").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    local = staged(grouped.withColumn("part", part).withColumn("local", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))), "segments")
    totals = local.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    offsets = totals.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("offset"))
    placed = local.join(F.broadcast(offsets), "part").withColumn("seq_start", F.col("local") + F.col("offset"))
    starts = staged(placed.select("rank", "seq_start"), "starts")

    placed_node = staged(own.select("rank", *node, "at", "n").join(starts, "rank")
                         .select(*node, F.col("rank").alias("owner"), (F.col("seq_start") + F.col("at")).alias("start"),
                                 (F.col("seq_start") + F.col("at") + F.col("n")).alias("end")), "placed")
    spans = (on_path.select("rank", *node).join(placed_node, node)
             .groupBy("rank", "owner").agg(F.min("start").alias("start"), F.max("end").alias("end")))
    index = staged(spans.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("start", "end", "owner"))).alias("spans")), "index")
    attend = F.filter("spans", lambda s: s["owner"] != F.col("rank"))
    length = F.aggregate("attend", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    segments = (placed.join(index, "rank").withColumn("attend", attend)
                .select(F.col("rank").alias("segment"), "seq_start", length.alias("position_start"), "n_tokens", "tokens", "loss",
                        F.transform("attend", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("attend")))
    named = ranked.select("rank", "n_turns", "leaf1", "leaf2")
    convs = (convs.select("conv", "d", "x1", "x2")
             .join(named, (F.col("d") == F.col("n_turns")) & (F.col("x1") == F.col("leaf1")) & (F.col("x2") == F.col("leaf2")))
             .select(F.col("conv").alias("conv_id"), "rank"))
    return Packed(segments, index, convs)


def read_back(packed: Packed) -> DataFrame:
    """Turns and loss texts of every distinct path, from the packed segments alone:
    (rank, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)."""
    seg = packed.segments.select(F.col("segment").alias("owner"), "seq_start", "tokens", "loss")
    cuts = packed.index.select("rank", F.explode("spans").alias("s")).select("rank", "s.start", "s.end", "s.owner")
    lo, hi = F.col("start") - F.col("seq_start"), F.col("end") - F.col("seq_start")
    piece = (cuts.join(seg, "owner")
             .select("rank", "start", F.substring("tokens", lo + 1, hi - lo).alias("tokens"), F.filter(
                 "loss", lambda s: (s["start"] >= lo) & (s["end"] <= hi)).alias("loss"), lo.alias("lo")))
    whole = piece.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("start", "tokens", F.transform(
        "loss", lambda s: F.struct((s["start"] - F.col("lo")).alias("a"), (s["end"] - F.col("lo")).alias("b"))).alias("loss")))).alias("p"))

    def parse(batches):
        for b in batches:
            out = []
            for rank, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = b"".join(p["tokens"] for p in parts).decode()
                loss = "".join(unescape(p["tokens"][s["a"]:s["b"]].decode()) for p in parts for s in p["loss"])
                turns, at = hashlib.sha256(), 0
                n = 0
                while at < len(text):
                    m = TURN.match(text, at)
                    if m is None:
                        raise ValueError(f"path {rank}: no turn at character {at}")
                    turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                    at, n = m.end(), n + 1
                out.append((rank, n, turns.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*out)) if out else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             ["rank", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return whole.mapInArrow(parse, "rank bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                                   "loss_sha256 string, formatted_chars bigint")


def conversation_digests(packed: Packed) -> DataFrame:
    """The read-back digests of every conversation."""
    done = staged(read_back(packed), "digests")
    return (packed.convs.join(done, "rank")
            .select(F.when(F.col("conv_id") != NO_ID, F.col("conv_id")).alias("conv_id"), *done.columns[1:]))


def oracle(table: str) -> str:
    """DuckDB SQL for conversation_digests(): turns in order, the template's length and the loss texts."""
    def escaped(c: str) -> str:
        out = f"replace({c}, '\\', '\\\\')"
        for x in "<[|":
            out = f"replace({out}, '{x}', '{x}\\')"
        return out

    control = len(OPEN) + len(CLOSE) + len(END)
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {table})
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length({escaped('role')}) + length({escaped('text')}) + {control})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""
