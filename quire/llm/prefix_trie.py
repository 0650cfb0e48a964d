"""Prefix trie of conversations by partition refinement.

All conversations start as one class.  Each round looks at one more turn of the conversations that still share their class and splits the class by it; a class of a
single sequence retires and gives the rest of its turns as a chain without branches.  Only shared turns cost rounds, and a round reads only the turns at its depth.
Conversations with equal turns are one sequence that is counted as often as it is there, so a large group of copies retires like any other.

A node is named by its depth and the smallest conversation that starts with it.  Sums over subtrees are folded back without walking the tree: what a sequence adds
below the nodes that it names is added up first, and each shared node then sums this over its members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import BROADCAST_ROWS, cut, discard

#: Hash of no conversation at all.
NO_END = hashlib.sha256(b"").hexdigest()
#: Turns that are taken from another conversation are fewer than this; a conversation takes them from the one at the start of its hundred.
HEADS, HUNDRED = 6, 100


def positions(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(conv, at, digest, chars, upto, total) of each turn and (conv, n) of each conversation.

    ``at`` counts a conversation's turns from 0 in the order of ``turn``, null first, ties in the order of ``digest``, a hash of role and text in which null is the
    same as empty.  ``upto`` are the code points of its texts up to and with this one, ``total`` those of all.  Rows without a conversation take no part.

    Rows are dealt by ranges of this order, which also cut through a conversation; ranks and sums are formed inside a range, and each range starts where those
    before it in the same conversation end.
    """
    who, what = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, what)))
    rows = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), digest.alias("digest"), F.length(what).cast("long").alias("chars"))
    order = [F.col("turn").asc_nulls_first(), F.col("digest")]
    ranged = cut(rows.repartitionByRange("conv", *order).withColumn("range", F.spark_partition_id()))
    ends = ranged.groupBy("range", "conv").agg(F.count("*").alias("n"), F.sum("chars").alias("total"))
    per = Window.partitionBy("conv")
    before = per.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    past = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long")
    told = ends.select("range", "conv", past("n").alias("start"), past("total").alias("past"), F.sum("n").over(per).alias("n"), F.sum("total").over(per).alias("total"))
    own = Window.partitionBy("range", "conv").orderBy(*order)
    at = (F.row_number().over(own) - 1).cast("long")
    upto = F.sum("chars").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = ranged.withColumn("at", at).withColumn("upto", upto).join(told, ["range", "conv"])
    turns = cut(placed.select("conv", (F.col("at") + F.col("start")).alias("at"), "digest", "chars", (F.col("upto") + F.col("past")).alias("upto"), "total"))
    return turns, ranged.groupBy("conv").agg(F.count("*").alias("n"))


def taken(conv: Column) -> Column:
    """How many first turns a conversation takes from another: its id's CRC-32 modulo HEADS."""
    return F.crc32(conv.cast("string").cast("binary")) % HEADS


def rebuilt(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, pos, digest, chars, rest) and conversations (conv, len), each conversation with its first turns taken from the one at the start of its hundred.

    ``rest`` are the code points from a turn on to the last.  A conversation may be left without turns; it is still there.
    """
    base = F.col("conv") - F.col("conv") % HUNDRED
    whole = convs.where(F.col("conv") % HUNDRED == 0).select(F.col("conv").alias("base"), F.least("n", F.lit(HEADS)).alias("there"))
    heads = taken(F.col("conv"))
    plan = convs.withColumn("base", base).join(whole, "base", "left").select("conv", "base", heads.alias("h"), F.least(heads, F.coalesce("there", F.lit(0))).alias("m"), "n")
    plan = cut(plan.withColumn("len", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    late = turns.where(F.col("at") >= taken(F.col("conv"))).withColumn("rest", F.col("total") - F.col("upto") + F.col("chars"))
    own = late.join(plan.select("conv", "h", "m"), "conv").select("conv", (F.col("m") + F.col("at") - F.col("h")).alias("pos"), "digest", "chars", "rest")
    first = turns.where((F.col("conv") % HUNDRED == 0) & (F.col("at") < HEADS)).select(F.col("conv").alias("base"), F.col("at").alias("pos"), "digest", "chars")
    begun = plan.join(first, "base").where(F.col("pos") < F.col("m"))
    after = late.groupBy("conv").agg(F.sum("chars").alias("later"))
    down = Window.partitionBy("conv").orderBy(F.desc("pos"))
    head = begun.withColumn("rest", F.sum("chars").over(down)).join(after, "conv", "left")
    head = head.select("conv", "pos", "digest", "chars", (F.col("rest") + F.coalesce("later", F.lit(0))).alias("rest"))
    return head.unionByName(own), plan.select("conv", "len")


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each group's ids; a group's rows follow each other in order, and only the running hash is held."""
    key, running = None, None
    for batch in batches:
        done = []
        for a, b, n, ids in zip(*[c.to_pylist() for c in batch.columns]):
            if (a, b, n) != key:
                if key is not None:
                    done.append((*key, running.hexdigest()))
                key, running = (a, b, n), hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        yield _of(done)
    if key is not None:
        yield _of([(*key, running.hexdigest())])


def _of(done: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["a", "b", "len", "ends"])


def sequences(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """seq (the smallest conversation), copies, len, total (code points), ends (SHA-256 of the conversations' ids): the different sequences of turns.

    Sequences are told apart by their length and 128 bits of hashes of (place, turn), which are joined by exclusive or, so a long conversation is summed in parts.
    Ids are put in order inside ranges of ids; of a group, the hash then takes one string for each range.
    """
    mark = lambda *salt: F.bit_xor(F.xxhash64("pos", "digest", *salt))
    marks = turns.groupBy("conv").agg(mark().alias("a"), mark(F.lit("second")).alias("b"), F.sum("chars").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    told = convs.join(marks, "conv", "left").select("conv", "len", zero("a"), zero("b"), zero("total"))
    told = cut(told.repartitionByRange("conv").withColumn("range", F.spark_partition_id()))
    in_order = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    parts = told.groupBy("a", "b", "len", "range").agg(in_order.alias("ids"))
    hashed = parts.repartition("a", "b", "len").sortWithinPartitions("a", "b", "len", "range").select("a", "b", "len", "ids").mapInArrow(_hashed, "a long, b long, len long, ends string")
    groups = told.groupBy("a", "b", "len").agg(F.min("conv").alias("seq"), F.count("*").alias("copies"), F.max("total").alias("total"))
    out = cut(groups.join(hashed, ["a", "b", "len"]).drop("a", "b"))
    discard(told)
    return out


def refined(turns: DataFrame, seqs: DataFrame) -> DataFrame:
    """Written as Parquet: depth, cls, parent, seq, copies, len, ends, chars, left, n: the class of each sequence at each depth down to where it is alone or ends.

    ``cls`` is the class's smallest sequence, ``n`` how many sequences it has, ``chars`` those of the turn at this depth, ``left`` those of the turns below.
    """
    whole = seqs.agg(F.min("seq").alias("cls"), F.count("*").alias("n"))
    level = seqs.crossJoin(F.broadcast(whole)).select(  # one row
        F.lit(0).cast("long").alias("depth"), "cls", F.lit(None).cast("long").alias("parent"), "seq", "copies", "len", "ends", F.lit(0).cast("long").alias("chars"), F.col("total").alias("left"), "n"
    )
    levels, depth, cuts = level, 0, []
    while True:
        active = level.where((F.col("n") > 1) & (F.col("len") > depth)).select(F.col("cls").alias("parent"), "seq", "copies", "len", "ends")
        at = turns.where(F.col("pos") == depth).select(F.col("conv").alias("seq"), "digest", "chars", (F.col("rest") - F.col("chars")).alias("left"))
        met = cut(active.join(at, "seq"))
        split = cut(met.groupBy("parent", "digest").agg(F.min("seq").alias("least"), F.count("*").alias("n")).where("n > 1"))
        cuts += [met, split]
        depth, found = depth + 1, split.count()
        level = met.join(F.broadcast(split) if found <= BROADCAST_ROWS else split, ["parent", "digest"], "left").select(
            F.lit(depth).cast("long").alias("depth"), F.coalesce("least", "seq").alias("cls"), "parent", "seq", "copies", "len", "ends", "chars", "left", F.coalesce("n", F.lit(1).cast("long")).alias("n")
        )
        levels = levels.unionByName(level)
        if not found:
            break
    out = cut(levels)
    for part in cuts:
        discard(part)
    return out


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each different sequence of first turns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has conv, pos (from 0), digest (what makes turns equal), chars (the turn's size) and rest (sizes from it on); ``convs`` has conv and len, also of
    conversations without turns.  No conversations give no rows; else the root has depth 0.
    """
    turns = cut(turns.repartitionByRange("pos", "conv").sortWithinPartitions("pos", "conv"))
    seqs = sequences(turns, convs)
    classes = refined(turns, seqs)
    alone, here = F.col("n") == 1, F.col("len") == F.col("depth")
    nodes = classes.groupBy("depth", "cls").agg(
        F.min("parent").alias("parent"), F.sum("copies").alias("n_convs"), F.max("chars").alias("chars"), F.max(F.when(here, F.col("ends"))).alias("ends"),
        F.max(F.when(alone, F.lit(1)).otherwise(0)).alias("leaf"), F.max(F.when(alone & ~here, 1).otherwise(0)).alias("goes_on"), F.coalesce(F.max(F.when(alone, (F.col("copies") - 1) * F.col("left"))), F.lit(0)).alias("tail"),
    )
    # What a sequence saves at the nodes that it names, from a node down; a sequence names at most one node of a depth.
    saves = (F.col("n_convs") - 1) * F.col("chars") + F.col("tail")
    nodes = cut(nodes.withColumn("below", F.sum(saves).over(Window.partitionBy("cls").orderBy(F.desc("depth")))))
    each = nodes.groupBy(F.col("cls").alias("seq")).agg(F.max("below").alias("all_below"), F.max("leaf").alias("ends_alone"))
    members = classes.select("depth", "cls", "seq").join(each, "seq", "left")
    sums = members.groupBy("depth", "cls").agg(F.coalesce(F.sum("ends_alone"), F.lit(0)).alias("n_leaves"), F.coalesce(F.sum(F.when(F.col("seq") != F.col("cls"), F.col("all_below"))), F.lit(0)).alias("others"))
    kids = nodes.where(F.col("parent").isNotNull()).groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("cls")).agg(F.count("*").alias("kids"))
    none = F.lit(NO_END)
    shared = nodes.join(sums, ["depth", "cls"]).join(kids, ["depth", "cls"], "left").select(
        F.col("cls").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", (F.coalesce("kids", F.lit(0)) + F.col("goes_on")).cast("long").alias("n_children"),
        F.col("n_leaves").cast("long").alias("n_leaves"), (F.col("below") + F.col("others")).cast("long").alias("saved_tokens"), F.coalesce("ends", none).alias("ends_sha256"),
    )
    retired = classes.where(alone & ~here).select(F.col("seq").alias("conv"), "depth", "copies", "len", "ends")
    below = F.col("pos") + 1
    chains = turns.join(retired, "conv").where(F.col("pos") >= F.col("depth")).select(
        F.col("conv").alias("conv_id"), below.alias("depth"), F.col("conv").alias("parent_conv_id"), F.col("copies").alias("n_convs"), F.when(below < F.col("len"), 1).otherwise(0).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), ((F.col("copies") - 1) * F.col("rest")).cast("long").alias("saved_tokens"), F.when(below == F.col("len"), F.col("ends")).otherwise(none).alias("ends_sha256"),
    )
    return shared.unionByName(chains)


def with_turns(nodes: DataFrame, turns: DataFrame, *columns: str) -> DataFrame:
    """nodes with ``columns`` of the last turn of each (conv, pos, columns), for instance its role and text; null at the root."""
    last = turns.select(F.col("conv").alias("conv_id"), (F.col("pos") + 1).alias("depth"), *columns)
    return nodes.join(last, ["conv_id", "depth"], "left")


def conversation_trie(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``trie`` of rebuilt conversations, whose first turns come from the conversation at the start of their hundred; sizes are code points of texts.

    Rows without a conversation id take no part, null role and text are empty, rows of a conversation with the same turn are ordered by their digest, and repeated rows
    are turns of their own.  Other columns do not matter.
    """
    return trie(*rebuilt(*positions(conversations, conv, turn, role, text)))
