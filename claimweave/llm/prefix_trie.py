"""Prefix trie of conversations, built from adaptive radix trees over fixed-width turn ids.

A turn is named by 20 bytes: the big-endian byte length of its text, then 128 bits of a SHA-256 of role and text. A
conversation's key is its turns' ids one after another. All (key, conversation) rows are sorted by ranges; a task
walks its range in blocks of bounded size and puts each block's keys into an adaptive radix tree: inner nodes grow from
4 over 16 and 48 to 256 places, and chains without branches are one compressed path. Only byte depths that are a whole
number of turns give nodes of the trie.

A block knows all of its nodes but those on the paths of its first and its last key, which may go on in other blocks
(as does a key with very many conversations: a block may end within one). Such open nodes are emitted as partial sums, named by the
hash of their prefix, and added up by Spark. Sums over subtrees of open nodes need no further walk: each open node
belongs to the first path it lies on, running sums along the paths (from the deepest node up) carry its share to all
its ancestors, and a node adds up what its paths carry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.llm.stages import small_batches, staged

WIDTH = 20  # bytes of a turn's id: 4 for the length of the text, 16 for the hash
LENGTH_BYTES = 4
BLOCK = 8 << 20  # bytes of keys and of joined ids in one block
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    """The id of a turn; null role or text is empty. The role's length keeps ("ab", "c") and ("a", "bc") apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    length = F.octet_length(text)
    name = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return F.unhex(F.concat(F.lpad(F.hex(length.cast("long")), 2 * LENGTH_BYTES, "0"), F.substring(name, 1, 2 * (WIDTH - LENGTH_BYTES))))


class _Leaf:
    """A key's remaining bytes below its parent, and what is known of the key."""

    __slots__ = ("path", "entry")

    def __init__(self, path: bytes, entry: int) -> None:
        self.path, self.entry = path, entry


class _Inner:
    """A node with children by next byte; ``path`` is the compressed path above the branch, ``entry`` a key that ends here.

    Up to 4 and up to 16 children are two parallel lists in order of the bytes, up to 48 a table of 256 places into a
    list of children, and beyond that a list of 256 children.
    """

    __slots__ = ("path", "entry", "bytes", "places", "children", "size")

    def __init__(self, path: bytes) -> None:
        self.path, self.entry = path, -1
        self.bytes, self.places, self.children, self.size = bytearray(), None, [], 4

    def get(self, byte: int):
        if self.size <= 16:
            at = self.bytes.find(byte)
            return self.children[at] if at >= 0 else None
        if self.size == 48:
            at = self.places[byte]
            return self.children[at] if at < 255 else None
        return self.children[byte]

    def put(self, byte: int, child) -> None:
        """Set the child of a byte, in a larger layout if this one is full."""
        if self.size <= 16:
            at = self.bytes.find(byte)
            if at >= 0:
                self.children[at] = child
                return
            if len(self.children) == self.size:
                self._grow()
                self.put(byte, child)
                return
            at = sum(b < byte for b in self.bytes)
            self.bytes.insert(at, byte)
            self.children.insert(at, child)
        elif self.size == 48:
            at = self.places[byte]
            if at < 255:
                self.children[at] = child
            elif len(self.children) == 48:
                self._grow()
                self.children[byte] = child
            else:
                self.places[byte] = len(self.children)
                self.children.append(child)
        else:
            self.children[byte] = child

    def _grow(self) -> None:
        if self.size == 4:
            self.size = 16
        elif self.size == 16:
            self.places = bytearray(b"\xff" * 256)
            for at, byte in enumerate(self.bytes):
                self.places[byte] = at
            self.bytes, self.size = None, 48
        else:
            wide = [None] * 256
            for byte, at in enumerate(self.places):
                if at < 255:
                    wide[byte] = self.children[at]
            self.places, self.children, self.size = None, wide, 256

    def each(self) -> list:
        if self.size == 48:
            return [self.children[at] for at in self.places if at < 255]
        return [c for c in self.children if c is not None]


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] agrees, a[:high] does not
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class RadixTree:
    """Adaptive radix tree over byte strings of which none repeats; a key may be a prefix of another."""

    def __init__(self) -> None:
        self.root = None

    def insert(self, key: bytes, entry: int) -> None:
        if self.root is None:
            self.root = _Leaf(key, entry)
            return
        above, byte, node, at = None, 0, self.root, 0
        while True:
            rest = key[at:]
            same = _common(node.path, rest)
            if same < len(node.path) or isinstance(node, _Leaf):
                # The path is cut where the keys part, or a leaf gets a key below it.
                fork = _Inner(node.path[:same])
                if same < len(node.path):
                    fork.put(node.path[same], node)
                    node.path = node.path[same:]
                else:
                    fork.entry = node.entry
                if same == len(rest):
                    fork.entry = entry
                else:
                    fork.put(rest[same], _Leaf(rest[same:], entry))
                if above is None:
                    self.root = fork
                else:
                    above.put(byte, fork)
                return
            if same == len(rest):
                node.entry = entry
                return
            at += same
            above, byte = node, key[at]
            child = node.get(byte)
            if child is None:
                node.put(byte, _Leaf(key[at:], entry))
                return
            node = child


class _Below:
    """Sums over what lies below a point of the tree, up to the next trie nodes."""

    __slots__ = ("n", "least", "first", "last", "closed", "leaves", "saved", "tops", "waiting", "entry")

    def __init__(self) -> None:
        self.n, self.least, self.first, self.last = 0, None, False, False
        self.closed, self.leaves, self.saved, self.tops = 0, 0, 0, 0
        self.waiting: list[list] = []  # rows of child nodes that do not yet know their parent
        self.entry = -1

    def add(self, other: _Below) -> None:
        self.n += other.n
        self.least = other.least if self.least is None else min(self.least, other.least)
        self.first |= other.first
        self.last |= other.last
        self.closed += other.closed
        self.leaves += other.leaves
        self.saved += other.saved
        self.tops += other.tops
        if len(other.waiting) > len(self.waiting):
            self.waiting, other.waiting = other.waiting, self.waiting
        self.waiting += other.waiting
        self.entry = max(self.entry, other.entry)


# A node of the trie as emitted by a block. Closed ones are whole (but for the parent's conversation if that is open);
# open ones hold this block's share, and closed counts their closed children.
NODE = (
    "kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, bytes long, name binary, "
    "parent binary, ends string, text string, on_first boolean, on_last boolean, block long"
)
CLOSED, OPEN, ENDS = 0, 1, 2
_FIELDS = [f.split()[0] for f in NODE.split(", ")]
_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
_TYPES = [_ARROW[f.split()[1]] for f in NODE.split(", ")]


def name_of(prefix: bytes) -> bytes:
    return hashlib.sha256(prefix).digest()


def block_rows(keys: list[bytes], members: list[list[int]], block: int) -> Iterator[tuple]:
    """Rows of ``NODE`` of one block of keys in ascending order, with the ascending conversations of each."""
    tree = RadixTree()
    for entry, key in enumerate(keys):
        tree.insert(key, entry)
    done: dict[int, _Below] = {}
    # Children before parents, without recursion: a conversation may have any number of turns.
    walk: list[tuple] = [(tree.root, 0, False)]
    final = len(keys) - 1
    while walk:
        node, start, back = walk.pop()
        inner = isinstance(node, _Inner)
        end = start + len(node.path)
        if inner and not back:
            walk.append((node, start, True))
            walk += [(child, end, False) for child in node.each()]
            continue
        here = _Below()
        ends = node.entry
        if inner:
            for child in node.each():
                here.add(done.pop(id(child)))
        if ends >= 0:
            own = members[ends]
            here.n += len(own)
            here.least = own[0] if here.least is None else min(here.least, own[0])
            here.first |= ends == 0
            here.last |= ends == final
            here.entry = max(here.entry, ends)
        key = keys[here.entry]
        # Trie nodes on this path: whole numbers of turns in (start, end], and the root at 0; deepest first.
        low = start // WIDTH if start or node is not tree.root else -1
        for depth in range(end // WIDTH, low, -1):
            size = int.from_bytes(key[(depth - 1) * WIDTH : (depth - 1) * WIDTH + LENGTH_BYTES], "big") if depth else 0
            is_end = ends >= 0 and depth * WIDTH == end
            if here.first or here.last:
                prefix = key[: depth * WIDTH]
                name, parent = name_of(prefix), name_of(prefix[:-WIDTH]) if depth else None
                for row in here.waiting:
                    row[10] = name
                    yield tuple(row)
                yield (OPEN, here.least, depth, None, here.n, here.closed, here.leaves, here.saved, size, name, parent, None, None, here.first, here.last, block)
                if is_end:
                    yield (ENDS, members[ends][0], depth, None, None, None, None, None, None, name, None, None, ",".join(map(str, members[ends])), None, None, block)
                here.waiting, here.closed, here.leaves, here.saved = [], 0, 0, 0
            else:
                for row in here.waiting:
                    row[3] = here.least
                    yield tuple(row)
                here.saved += (here.n - 1) * size
                here.leaves += here.tops == 0
                ended = hashlib.sha256(",".join(map(str, members[ends])).encode()).hexdigest() if is_end else NO_ENDS
                here.waiting = [[CLOSED, here.least, depth, None, here.n, here.tops, here.leaves, here.saved, None, None, None, ended, None, None, None, None]]
                here.closed = 1
            here.tops = 1
        done[id(node)] = here


def _batches(rows: Iterator[tuple], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    held = []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _TYPES)], _FIELDS)

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield made()
            held = []
    if held:
        yield made()


def _walk(limit: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        task, nth, used = TaskContext.get().partitionId() << 32, 0, 0
        keys: list[bytes] = []
        members: list[list[int]] = []
        for batch in batches:
            for key, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
                if used > limit:
                    yield from block_rows(keys, members, task | nth)
                    keys, members, used, nth = [], [], 0, nth + 1
                if keys and keys[-1] == key:
                    members[-1].append(conv)
                else:
                    keys.append(key)
                    members.append([conv])
                    used += len(key)
                used += 64
        if keys:
            yield from block_rows(keys, members, task | nth)

    return lambda batches: _batches(blocks(batches))


def rebuilt(rows: DataFrame, head: Column) -> DataFrame:
    """(conv_id, key) of each conversation c: the first ``head`` turns of conversation c - c % 5, then its own after those.

    ``rows(conv_id, turn, role, text)``. Only ids of turns are shuffled, not texts. One task holds the ids of at most
    five conversations at a time. Turns are in order of turn (null first), then role, then the hash of the text.
    """
    turns = rows.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), turn_id(F.col("role"), F.col("text")).alias("id")).alias("t")
    )
    own = turns.withColumn("base", F.expr("conv_id - conv_id % 5")).repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    whole = own.groupBy("base").agg(F.collect_list(F.struct("conv_id", F.col("t.id").alias("ids"))).alias("all"))
    first = F.get(F.filter("all", lambda c: c["conv_id"] == F.col("base")), F.lit(0))["ids"]
    each = whole.select(F.coalesce(first, F.array().cast("array<binary>")).alias("first"), F.inline("all")).withColumn("head", head)
    joined = F.concat(F.slice("first", F.lit(1), F.col("head")), F.slice("ids", F.col("head") + 1, F.size("ids")))
    return each.select("conv_id", F.coalesce(F.array_join(F.transform(joined, lambda i: F.hex(i)), ""), F.lit("")).alias("key")).select("conv_id", F.unhex("key").alias("key"))


def _streamed_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each name's texts joined by commas; rows come sorted, so only one state is held."""
    at, state, names, hashes = None, None, [], []
    for batch in batches:
        for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist()):
            if name == at:
                state.update(b"," + text.encode())
                continue
            if state:
                names.append(at)
                hashes.append(state.hexdigest())
            at, state = name, hashlib.sha256(text.encode())
    if state:
        names.append(at)
        hashes.append(state.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(hashes, pa.string())], ["name", "ends"])


def trie(keys: DataFrame, block: int = BLOCK) -> DataFrame:
    """Nodes of the prefix trie of ``keys(conv_id, key)``: one row for each distinct sequence of first turns.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. A conversation without turns is a member of the root alone. No conversations, no rows.
    """
    ordered = keys.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    rows = staged(ordered.mapInArrow(_walk(block), NODE), "trie_blocks")
    # Open nodes: shares of all blocks added up.
    parts = rows.where(F.col("kind") == OPEN)
    sums = parts.groupBy("name").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("closed"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("saved"), F.first("bytes").alias("bytes"),
    )
    open_children = parts.select("name", "parent").distinct().groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("opened"))
    nodes = sums.join(open_children, "name", "left").withColumn("n_children", F.col("closed") + F.coalesce("opened", F.lit(0)))
    # What a node brings to itself and its ancestors: its own value and the closed subtrees that hang from it.
    own = (F.col("n_convs") - 1) * F.col("bytes") + F.col("saved")
    nodes = staged(nodes.withColumn("own", own).withColumn("leaf", F.col("leaves") + (F.col("n_children") == 0).cast("long")), "trie_open")
    sides = F.explode(F.filter(F.array(F.when(F.col("on_first"), 0), F.when(F.col("on_last"), 1)), lambda s: s.isNotNull()))
    paths = parts.select("name", "depth", "block", sides.alias("side")).withColumn("path", F.struct("block", "side"))
    # A node's own share rides on the first path it lies on; each path sums from its deepest node up.
    home = paths.groupBy("name").agg(F.min("path").alias("home"))
    carried = paths.join(home.join(nodes.select("name", "own", "leaf"), "name"), "name")
    up = Window.partitionBy("path").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = F.col("path") == F.col("home")
    carried = carried.select("name", *(F.sum(F.when(here, F.col(c)).otherwise(F.lit(0))).over(up).alias(c) for c in ("own", "leaf")))
    below = carried.groupBy("name").agg(F.sum("own").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    texts = rows.where(F.col("kind") == ENDS).select("name", "conv_id", "text")
    ends = texts.repartition("name").sortWithinPartitions("name", "conv_id").mapInArrow(_streamed_hash, "name binary, ends string")
    heads = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    opened = nodes.join(below, "name").join(ends, "name", "left").join(heads, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    closed = rows.where(F.col("kind") == CLOSED).withColumnsRenamed({"saved": "saved_tokens", "ends": "ends_sha256"})
    orphans = closed.where("parent IS NOT NULL").drop("parent_conv_id").join(heads, "parent")
    return closed.where("parent IS NULL").select(*out).unionByName(orphans.select(*out)).unionByName(opened.select(*out))


def conversation_trie(rows: DataFrame, head: Column | None = None, block: int = BLOCK) -> DataFrame:
    """``trie`` of the rebuilt conversations of ``rows(conv_id, turn, role, text)``; other columns are ignored.

    ``head`` is the number of turns taken from conversation c - c % 5, by default crc32 of c's decimal digits modulo
    9; ``lit(0)`` leaves conversations as they are. Null role or text is empty; rows with a null conv_id belong to no
    conversation and are left out. Repeated rows are turns of their own.
    """
    small_batches(rows.sparkSession)
    if head is None:
        head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    return trie(rebuilt(rows, head), block)
