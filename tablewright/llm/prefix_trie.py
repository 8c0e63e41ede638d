"""Trie of conversation prefixes with subtree totals, by time-forward processing.

A node is a distinct sequence of first turns; its number is a running digest of them, so
every turn of every conversation names its node without meeting another conversation.

Conversations are ordered by their first turns and cut into shards, so that most nodes have
all their members in one shard.  Nodes go to a shard's task in reverse level order, sorted
outside memory by Spark.  A node sends its totals forward in time to its parent
through a priority queue that spills, and by the time the parent's turn comes all its
children have done so.  What is addressed to a node that other shards share leaves the
shard.  Those nodes, the shards' roots, go on in the same way: in each further round
``FAN_IN`` neighbouring shards are one, until none is left.  A round's task holds no more than the
nodes on the seams between its shards, whatever the number of conversations behind them.

Any cut into shards gives right results, as a node belongs to the first round in which all shards of its
members are one; the order only keeps the shared nodes few.

Results of odd input: null roles and texts are empty; turns are in order of turn (null
first), those of one turn in order of a digest of role and text; rows without conversation id belong to no
conversation; repeated rows are turns of their own; an empty table gives an empty table; columns other than the
four are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import checkpointed, map_arrow, pick

#: Neighbouring shards that become one in each round.
FAN_IN = 64
#: Conversations of one base: those from a multiple of ``FAMILY`` on.
FAMILY, MOST_BORROWED = 5, 9
#: Turns whose digests order the conversations; others follow by id.
KEY_TURNS = 16
#: Messages in memory; more are written to sorted runs.
QUEUE = 100_000
#: Sub-keys for the children of a shared node.
SALTS = 64
ROOT = bytes(16)
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def rebuilt(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(family, conv_id, place, digest, n_bytes)``: each conversation's turns, the first ones of its base.

    Conversation c takes the first h turns of c - c % 5, h = crc32(c) % 9, and then its own after its
    first h.  A row with place 0 says that the conversation exists.  Texts are not shuffled, only digests are,
    and all conversations of one base meet in one shuffle.
    """
    rows = pick(df, conv_id=(conv_col, "bigint"), turn=(turn_col, "bigint"), role=(role_col, "string"), text=(text_col, "string"))
    rows = rows.where("conv_id IS NOT NULL").fillna("", ["role", "text"])
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    rows = rows.select(base.alias("family"), "conv_id", "turn", turn_digest(F.col("role"), F.col("text")).alias("digest"), F.octet_length("text").cast("bigint").alias("n_bytes"))
    place = F.row_number().over(Window.partitionBy("family", "conv_id").orderBy("turn", "digest"))
    rows = rows.repartition("family").withColumn("place", place)
    borrowed = lambda c: F.crc32(c.cast("string").cast("binary")) % MOST_BORROWED
    copy = lambda conv, at: F.struct(conv.alias("conv_id"), at.cast("long").alias("place"))
    here, nothing = F.col("conv_id"), F.lit(None).cast("struct<conv_id:bigint,place:bigint>")
    copies = [F.when(F.col("place") == 1, copy(here, F.lit(0))), F.when(F.col("place") > borrowed(here), copy(here, F.col("place")))]
    for step in range(-FAMILY + 1, FAMILY):
        # The remainder has the sign of its number, so a base below 0 is above its conversations.
        other = F.try_add(here, F.lit(step).cast("bigint"))
        is_base = (here % FAMILY == 0) & (other - other % FAMILY == here)
        copies.append(F.when(is_base & (F.col("place") <= borrowed(other)), copy(other, F.col("place"))))
    rows = rows.withColumn("copy", F.explode(F.filter(F.array(*copies, nothing), lambda c: c.isNotNull())))
    return rows.select("family", F.col("copy.conv_id").alias("conv_id"), F.col("copy.place").alias("place"), "digest", "n_bytes")


MEMBERS = pa.schema(
    [
        ("conv_id", pa.int64()), ("depth", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("n_bytes", pa.int64()),
        ("ends", pa.bool_()), ("key", pa.binary()),
    ]
)


class _Path:
    """Nodes of one conversation, in order; the first ones wait until the key is known."""

    def __init__(self, conv_id: int):
        self.conv_id, self.depth, self.last, self.running = conv_id, 0, ROOT, hashlib.blake2b(digest_size=16)
        self.key, self.wait = b"", [(0, ROOT, None, 0)]

    def add(self, digest: bytes, n_bytes: int, out: list[tuple]) -> None:
        self.depth += 1
        self.running.update(digest)
        parent, self.last = self.last, self.running.digest()
        if self.depth <= KEY_TURNS:
            self.key += digest[:8]
        else:
            self._give(out)
        self.wait.append((self.depth, self.last, parent, n_bytes))

    def _give(self, out: list[tuple], ends: bool = False) -> None:
        last = len(self.wait) - 1
        out += [(self.conv_id, *node, ends and i == last, self.key) for i, node in enumerate(self.wait)]
        self.wait.clear()

    def finish(self, out: list[tuple]) -> None:
        self._give(out, ends=True)


def members(turns: DataFrame) -> DataFrame:
    """Every node of every conversation with its shard, see :data:`MEMBERS`."""
    ordered = turns.sortWithinPartitions("family", "conv_id", "place").select("conv_id", "place", "digest", "n_bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, last = None, None
        for batch in batches:
            out: list[tuple] = []
            for conv_id, place, digest, n_bytes in zip(*[c.to_pylist() for c in batch.columns]):
                if place == 0:
                    if path is not None:
                        path.finish(out)
                    path, last = _Path(conv_id), conv_id
                elif conv_id == last:  # else the base's turns have no conversation to go to
                    path.add(digest, n_bytes, out)
            if out:
                yield _batch(out, MEMBERS)
        if path is not None:
            out = []
            path.finish(out)
            yield _batch(out, MEMBERS)

    found = map_arrow(ordered, run, MEMBERS).repartitionByRange("key", "conv_id").drop("key")
    return checkpointed(found.withColumn("shard", F.spark_partition_id().cast("long")))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


ENDS = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])


def end_digests(found: DataFrame) -> DataFrame:
    """SHA-256 of the ids of the conversations that end at a node; they are read in order and never gathered."""
    rows = found.where("ends").select("node", "conv_id").repartition("node").sortWithinPartitions("node", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            done = []
            for node, conv_id in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
                if node == at:
                    digest.update(b",%d" % conv_id)
                    continue
                if at is not None:
                    done.append((at, digest.hexdigest()))
                at, digest = node, hashlib.sha256(b"%d" % conv_id)
            if done:
                yield _batch(done, ENDS)
        if at is not None:
            yield _batch([(at, digest.hexdigest())], ENDS)

    return map_arrow(rows, run, ENDS)


def nodes(found: DataFrame, last_shard: int, fan_in: int = FAN_IN) -> DataFrame:
    """Every node once, with the round and the shard of that round in which it is worked on."""
    rows = found.groupBy("node").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.max("n_bytes").alias("n_bytes"), F.min("shard").alias("low"), F.max("shard").alias("high"),
    )
    turn, place, width, no = F.when(F.col("low") == F.col("high"), 0), F.when(F.col("low") == F.col("high"), F.col("low")), fan_in, 1
    while True:
        one = F.expr(f"low div {width} = high div {width}")
        turn, place = turn.when(one, no), place.when(one, F.expr(f"low div {width}"))
        if last_shard // width == 0:
            break
        width, no = width * fan_in, no + 1
    rows = rows.join(end_digests(found), "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
    return checkpointed(rows.withColumn("turn", turn).withColumn("place", place).drop("low", "high"))


class SpillingQueue:
    """Priority queue of tuples; beyond ``limit`` in memory, the rest is in sorted runs in the task's own scratch files."""

    def __init__(self, limit: int = QUEUE, block: int = 512):
        self.limit, self.block = limit, block
        self.heap: list[tuple] = []
        self.heads: list[tuple] = []  # (first item, number of the run, the rest of the run)
        self.runs = 0

    def __bool__(self) -> bool:
        return bool(self.heap or self.heads)

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            items, self.heap = sorted(self.heap), []
            self._run(iter(items))
            if len(self.heads) > 64:
                heads, self.heads = self.heads, []
                self._run(heapq.merge(*[_chain(first, rest) for first, _, rest in heads]))

    def _run(self, items: Iterator[tuple]) -> None:
        file, block = tempfile.TemporaryFile(), []
        for item in items:
            block.append(item)
            if len(block) == self.block:
                pickle.dump(block, file, 5)
                block = []
        pickle.dump(block, file, 5)
        file.seek(0)
        self._head(_blocks(file))

    def _head(self, rest: Iterator[tuple], number: int | None = None) -> None:
        first = next(rest, None)
        if first is not None:
            self.runs += number is None
            heapq.heappush(self.heads, (first, self.runs if number is None else number, rest))

    def first(self) -> tuple:
        return min(self.heap[0], self.heads[0][0]) if self.heap and self.heads else self.heap[0] if self.heap else self.heads[0][0]

    def pop(self) -> tuple:
        if not self.heads or (self.heap and self.heap[0] <= self.heads[0][0]):
            return heapq.heappop(self.heap)
        first, number, rest = heapq.heappop(self.heads)
        self._head(rest, number)
        return first


def _chain(first: tuple, rest: Iterator[tuple]) -> Iterator[tuple]:
    yield first
    yield from rest


def _blocks(file) -> Iterator[tuple]:
    with file:
        while True:
            try:
                yield from pickle.load(file)
            except EOFError:
                return


#: What a node sends forward: its own row of the result, to the parent's number.
RESULT = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TOTALS = pa.schema(
    [("parent", pa.binary()), ("parent_conv_id", pa.int64()), ("open", pa.bool_())]
    + [(n, pa.string() if n == "ends_sha256" else pa.int64()) for n in RESULT]
)
_NODE = ["node", "parent", "depth", "conv_id", "n_convs", "n_bytes", "ends_sha256", "n_children", "n_leaves", "saved_tokens"]


def time_forward(rows: Iterator[tuple], limit: int = QUEUE) -> Iterator[tuple]:
    """Rows of :data:`TOTALS` of nodes that come deepest first, then by number.

    A node's row is given once its parent is met; those whose parent is not among the nodes are ``open``.
    """
    queue = SpillingQueue(limit)
    for node, parent, depth, conv_id, n_convs, n_bytes, ends, n_children, n_leaves, saved in rows:
        now = (-depth, node)
        while queue and queue.first()[:2] < now:
            yield _left(queue.pop())
        while queue and queue.first()[:2] == now:
            child = queue.pop()
            n_children, n_leaves, saved = n_children + 1, n_leaves + child[6], saved + child[7]
            yield (node, conv_id, False, *child[2:])
        own = (conv_id, depth, n_convs, n_children, n_leaves or 1, saved + (n_convs - 1) * n_bytes, ends)
        if parent is None:
            yield (None, None, False, *own)
        else:
            queue.push((1 - depth, parent, *own))
    while queue:
        yield _left(queue.pop())


def _left(child: tuple) -> tuple:
    return (child[1], None, True, *child[2:])


def totals(found: DataFrame, sent: DataFrame | None, limit: int = QUEUE) -> DataFrame:
    """One round over nodes that have their shard in ``place``; ``sent`` are the open rows of the rounds before."""
    if sent is None:
        rows = found.withColumns({n: F.lit(0).cast("bigint") for n in ("n_children", "n_leaves", "saved_tokens")})
    else:
        sums = sent.groupBy(F.col("parent").alias("node")).agg(
            F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")
        )
        rows = found.join(sums, "node", "left").fillna(0, ["n_children", "n_leaves", "saved_tokens"])
    rows = rows.repartition("place").sortWithinPartitions(F.col("depth").desc(), "node").select(*_NODE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for row in time_forward((row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns])), limit):
            out.append(row)
            if len(out) == 4096:
                yield _batch(out, TOTALS)
                out = []
        if out:
            yield _batch(out, TOTALS)

    return map_arrow(rows, run, TOTALS)


def prefix_trie(df: DataFrame, fan_in: int = FAN_IN, limit: int = QUEUE) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``n_leaves`` and ``saved_tokens`` are sums over the node's subtree.
    """
    found = members(rebuilt(df))
    last_shard = found.agg(F.max("shard")).first()[0] or 0
    every = nodes(found, last_shard, fan_in)
    rounds, shards = [totals(every.where("turn = 0"), None, limit)], last_shard
    no = 0
    while shards > 0:
        shards, no = shards // fan_in, no + 1
        rounds[-1] = checkpointed(rounds[-1])
        sent = rounds[0].where("open")
        for earlier in rounds[1:]:
            sent = sent.union(earlier.where("open"))
        rounds.append(totals(every.where(F.col("turn") == no), sent, limit))
    done = rounds[0]
    for later in rounds[1:]:
        done = done.union(later)
    # Parents of open rows are the few nodes on seams; a parent of many children is dealt over sub-keys.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    shared = every.where("turn > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("shared_conv_id"), salts)
    left = done.where("open").withColumn("salt", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALTS)).cast("int"))
    left = left.join(shared, ["parent", "salt"], "left").withColumn("parent_conv_id", F.col("shared_conv_id"))
    names = [*RESULT[:2], "parent_conv_id", *RESULT[2:]]
    return done.where("NOT open").select(*names).union(left.select(*names))
