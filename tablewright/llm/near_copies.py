"""Near copies: texts whose sets of word shingles are alike, and the groups they form.

1. Every text becomes its set of hashed shingles, of which only a digest and a HyperMinHash
   sketch are kept: per bucket the leading zeros and mantissa bits of the smallest hash;
   empty buckets borrow from others by fixed probes.
2. Texts with equal sets are one class from here on.
3. Bands of registers are the keys of candidate buckets.  Every class is held against its
   bucket's leader: first by the sketches' collision-corrected estimate, then by the full
   sets, made again from the texts.  Links give components.
4. Buckets that still hold several components are looked at again with leaders of their
   largest one, and at last all members outside it are held against all members of other
   components, so no candidate is left out.  A group of thousands of copies is one
   component long before that.

With 56 bands of 7 registers a pair of similarity 0.8 is missed by all bands with a
chance of about 2 in a million; the estimate leaves 4.5 standard errors of room.

Words: A-Z lower-cased, maximal runs without blanks (x20, x09 to x0D).  Shingles are told
apart by 64 bits.  Results of odd input: null texts and texts without words have no
shingles and are linked with nothing; a text of fewer words than a shingle is one shingle;
texts of any length are taken whole; every row gets a row, and rows that repeat an id are
all kept if that id is; rows without id are linked with nothing, with a null component,
and kept; an empty table gives an empty table; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import checkpointed, map_batches, pick, tree_sum

PERCENT, WORDS = 80, 2
REGISTERS, MANTISSA, BANDS, BAND_ROWS = 256, 10, 56, 7
#: Standard errors that the estimate and the register bits leave to a pair, and rounds of leaders.
ERRORS, ROUNDS = 6.0, 2
#: Rows of ids and keys to a task, and rows of a bucket that one task holds against the outsiders.
TASK_ROWS, BUCKET_ROWS = 1 << 18, 1 << 13
#: Least and greatest size of the bit filter that keeps texts without candidates out of the
#: shuffle.  It holds 16 bits per candidate up to 32 MB; beyond that it only saves less work.
FILTER_BITS = (1 << 20, 1 << 28)
#: Words of 64 bits of a set's parities.
PARITY_WORDS = 16

_U = np.uint64
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_IS_WORD = np.array([b not in (32, 9, 10, 11, 12, 13) for b in range(256)])
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_SEGMENT = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64 bits in which every bit depends on all."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        ones = np.ones(n, _U)
        up, down = ones.copy(), ones.copy()
        up[1:], down[1:] = _U(_BASE), _U(_INVERSE)
        return np.cumprod(up), np.cumprod(down)


def _hash_segment(raw: bytes) -> np.ndarray:
    signs = np.frombuffer(raw, np.uint8)
    is_word = _IS_WORD[signs]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], is_word, [False]))))
    starts, ends = edges[::2], edges[1::2]
    size = 1 << max(12, int(len(raw)).bit_length())
    up, down = _powers(size) if size <= 2 * _SEGMENT else _powers.__wrapped__(size)
    sums = np.concatenate((np.zeros(1, _U), np.cumsum((signs.astype(_U) + _U(1)) * up[: len(raw)])))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


def word_hashes(raw: bytes) -> np.ndarray:
    """Hash of every word of a folded text, a segment at a time, cut at blanks."""
    if len(raw) <= _SEGMENT:
        return _hash_segment(raw)
    out, at = [], 0
    while at < len(raw):
        to = min(len(raw), at + _SEGMENT)
        while to < len(raw) and _IS_WORD[raw[to]]:
            to += 1
        out.append(_hash_segment(raw[at:to]))
        at = to
    return np.concatenate(out)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The text's set of shingle hashes, ascending."""
    h = word_hashes(text.translate(_FOLD))
    if not len(h):
        return h
    n = max(1, len(h) - words + 1)
    out = np.full(n, words, _U)
    for i in range(min(words, len(h))):
        out = mix(out * _U(0x9DDFEA08EB382D69) + h[i : i + n])
    return np.unique(out)


@lru_cache(maxsize=1)
def _probes() -> np.ndarray:
    """For every bucket the order in which it asks others when it is empty."""
    random = np.random.Generator(np.random.Philox(key=11))
    return np.argsort(random.random((REGISTERS, REGISTERS)), axis=1)


@lru_cache(maxsize=1)
def _bands() -> np.ndarray:
    random = np.random.Generator(np.random.Philox(key=23))
    return np.stack([random.permutation(REGISTERS)[:BAND_ROWS] for _ in range(BANDS)])


def sketch(found: np.ndarray) -> np.ndarray:
    """Registers of a set: 6 bits of leading zeros and the mantissa of each bucket's smallest hash."""
    bucket = (found & _U(REGISTERS - 1)).astype(np.int64)
    rest = found >> _U(11)  # 53 bits, exact as double
    smallest = np.full(REGISTERS, np.iinfo(np.uint64).max, _U)
    np.minimum.at(smallest, bucket, rest)
    filled = smallest != np.iinfo(np.uint64).max
    value = np.where(filled, smallest, _U(1))
    length = np.frexp(value.astype(float))[1].astype(np.int64)  # bits up to the leading one
    shift = length - (MANTISSA + 1)
    mantissa = np.where(shift >= 0, value >> np.maximum(shift, 0).astype(_U), value << np.maximum(-shift, 0).astype(_U))
    registers = (np.minimum(53 - length, 63) << MANTISSA) | (mantissa & _U((1 << MANTISSA) - 1)).astype(np.int64)
    donor = np.where(filled, np.arange(REGISTERS), _probes()[np.arange(REGISTERS), filled[_probes()].argmax(axis=1)])
    return registers[donor].astype(np.uint16)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One key per row of registers and band."""
    keys = np.broadcast_to(np.arange(BANDS, dtype=_U), (len(registers), BANDS)).copy()
    for column in _bands().T:
        keys = mix(keys * _U(0x9DDFEA08EB382D69) + registers[:, column].astype(_U))
    return keys.view(np.int64)


def collision(n: np.ndarray) -> np.ndarray:
    """Chance of each count of leading zeros in one register of a set of n."""
    per = np.maximum(1.0, n / REGISTERS)[:, None]
    zeros = np.arange(54.0)
    none_below = lambda x: (1.0 - x) ** per
    return none_below(2.0 ** -(zeros + 1)) - none_below(2.0**-zeros)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity by equal registers, less those expected to be equal by chance."""
    chance = (collision(n_a) * collision(n_b)).sum(axis=1) / (1 << MANTISSA)
    return ((a == b).mean(axis=1) - chance) / (1.0 - chance)


SKETCHES = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.int64()), ("registers", pa.binary())])


def parities(found: np.ndarray) -> np.ndarray:
    """Whether each of ``64 * PARITY_WORDS`` places, dealt out by hash, holds an odd number of the set.

    Every place in which two sets differ takes at least one shingle that only one of them
    has, so the places that differ never exceed those shingles.
    """
    places = 64 * PARITY_WORDS
    odd = np.bincount(((found >> _U(8)) % _U(places)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _class(found: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    return [shingles(t.as_buffer().to_pybytes() if t.is_valid else b"", words) for t in texts]


def sketches(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """Size, class and registers of every row's set; rows without shingles have no class."""

    def run(batch: pa.RecordBatch) -> dict:
        found = _sets(batch.column("text"), words)
        return {
            "doc_id": batch.column("doc_id"), "text_key": batch.column("text_key"), "n_shingles": [len(f) for f in found],
            "class": [_class(f) if len(f) else None for f in found],
            "registers": [sketch(f).tobytes() if len(f) else None for f in found],
        }

    return map_batches(rows.withColumn("text_key", F.xxhash64("text")), SKETCHES, run)


def _buckets(classes: DataFrame) -> DataFrame:
    """``(key, class)`` of every band of every class."""
    schema = pa.schema([("key", pa.int64()), ("class", pa.int64())])

    def run(batch: pa.RecordBatch) -> dict:
        return {"key": band_keys(_registers(batch, "registers")).ravel(), "class": np.repeat(batch.column("class").to_numpy(), BANDS)}

    return map_batches(classes.select("class", "registers"), schema, run)


def _registers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _shared_buckets(classes: DataFrame) -> DataFrame:
    """The rows of buckets with several classes, which are few beside all rows."""
    buckets = _buckets(classes)
    shared = buckets.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("key")
    return buckets.join(shared, "key")


def _active(members: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes in shared buckets, with one bit of each register besides."""
    some = classes.join(members.select("class").distinct(), "class", "left_semi")
    words = [f"bits_{i}" for i in range(REGISTERS // 64)]
    schema = pa.schema(
        [("class", pa.int64()), ("rep", pa.int64()), ("n", pa.int64()), ("registers", pa.binary())] + [(w, pa.int64()) for w in words]
    )

    def run(batch: pa.RecordBatch) -> dict:
        bits = np.packbits((_registers(batch, "registers") & 1).astype(np.uint8), axis=1).view(np.int64)
        return {n: batch.column(n) for n in ("class", "rep", "n", "registers")} | dict(zip(words, bits.T))

    return map_batches(some.select("class", "rep", "n", "registers"), schema, run)


def _sets_of(rows: DataFrame, active: DataFrame, words: int) -> DataFrame:
    """``(class, set, parities)`` of the active classes, made from their representatives' texts where these are."""
    n = active.count()
    size = min(FILTER_BITS[1], max(FILTER_BITS[0], 1 << (16 * n).bit_length()))

    def mark(batches) -> np.ndarray:
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            at = _filter_place(batch.column("class").to_numpy(), batch.column("rep").to_numpy(), size)
            np.bitwise_or.at(bits, at >> _U(3), np.left_shift(np.uint8(1), (at & _U(7)).astype(np.uint8)))
        return bits

    marked = tree_sum(active.select("class", "rep"), mark, np.bitwise_or, np.zeros(size // 8, np.uint8))
    bits = rows.sparkSession.sparkContext.broadcast(marked)
    names = [f"odd_{i}" for i in range(PARITY_WORDS)]
    schema = pa.schema([("class", pa.int64()), ("set", pa.binary())] + [(name, pa.int64()) for name in names])

    def needed(batch: pa.RecordBatch) -> dict:
        found = _sets(batch.column("text"), words)
        classes = np.array([_class(f) if len(f) else 0 for f in found], np.int64)
        at = _filter_place(classes, batch.column("doc_id").to_numpy(), size)
        wanted = (bits.value[at >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & 1
        kept = [i for i, f in enumerate(found) if wanted[i] and len(f)]
        odd = np.array([parities(found[i]) for i in kept], np.int64).reshape(-1, PARITY_WORDS)
        return {"class": classes[kept], "set": [found[i].tobytes() for i in kept]} | dict(zip(names, odd.T))

    sets = map_batches(rows.where("doc_id IS NOT NULL AND text IS NOT NULL"), schema, needed)
    return sets.dropDuplicates(["class"]).join(active.select("class"), "class", "left_semi")


def _filter_place(classes: np.ndarray, ids: np.ndarray, size: int) -> np.ndarray:
    return mix(classes.astype(np.int64).view(_U) ^ mix(ids.astype(np.int64).view(_U))) & _U(size - 1)


def _few(df: DataFrame, rows: int) -> DataFrame:
    """The same rows in no more partitions than their number asks for, as each partition costs files in every shuffle."""
    return df.coalesce(max(1, math.ceil(rows / TASK_ROWS)))


def _open_buckets(members: DataFrame, rank: Column, rows: int) -> DataFrame:
    """The members of buckets with several components, and of each such bucket its rows, its largest
    component, and the first of that one's members by ``rank``.

    Components only grow together, so buckets of one component need no later look.
    """
    first = F.min(F.struct(rank.alias("rank"), F.col("class").alias("a"))).alias("first")
    sizes = _few(members.groupBy("key", "comp").agg(F.count("*").alias("size"), first), rows)
    lead = F.max(F.struct("size", "first.rank", "first.a", F.col("comp").alias("a_comp"))).alias("lead")
    leads = sizes.groupBy("key").agg(lead, F.count("*").alias("n_comps"), F.sum("size").alias("total")).where("n_comps > 1")
    return _few(members.join(leads.select("key", "lead.a", "lead.a_comp", "total"), "key"), rows)


def _rank(step: int) -> Column:
    """Order of the members that may lead a bucket.

    At first all buckets of a group share few leaders, which settles most of the group by few
    pairs.  Later each bucket has its own, so whoever is left meets as many leaders as it has
    buckets, all of the component that most of the bucket belongs to.
    """
    return F.xxhash64("class", F.lit(step)) if step == 0 else F.xxhash64("class", "key", F.lit(step))


def _leader_pairs(held: DataFrame, rows: int) -> DataFrame:
    """Pairs of a bucket's leader and its members of other components."""
    pairs = held.where("comp <> a_comp").select(F.least("a", "class").alias("a"), F.greatest("a", "class").alias("b"))
    return _few(pairs.distinct(), rows)


def _differ(names: list[str]) -> Column:
    """Number of bits in which the columns differ from those of the other side."""
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_b"))) for c in names])


def _rest_pairs(held: DataFrame, active: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in the buckets that still hold several, if sizes, parities and register bits allow a link.

    One of the two is always outside the bucket's largest component, so only those are held
    against the bucket, of which each task takes some rows.  Parities that differ are a lower
    bound of the shingles that do, so they rule out no link, and few but links pass them in
    sets that are not much larger than the parities.  For larger ones, bits of two registers
    differ with half the chance that the registers do; :data:`ERRORS` standard errors are
    left, of as many independent bits as the smaller set can have.
    """
    bits, odd = ([c for c in df.columns if c.startswith(p)] for df, p in ((active, "bits_"), (sets, "odd_")))
    parts = F.ceil(F.col("total") / BUCKET_ROWS).cast("int")
    there = held.select("key", "class", "comp", F.expr("comp <> a_comp").alias("outside"), parts.alias("parts"))
    known = there.join(active.select("class", "n", *bits), "class").join(sets.select("class", *odd), "class")
    right = known.withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")).drop("parts")
    left = known.where("outside").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    left = left.select(*[F.col(c).alias(f"{c}_b") for c in ("key", "part", "class", "comp", "n", *bits, *odd)])
    apart = (1 - percent / 100) / 2
    room = F.sqrt(F.lit(apart * (1 - apart)) / F.least(F.col("n"), F.col("n_b"), F.lit(REGISTERS)))
    alike = (100 * F.least("n", "n_b") >= percent * F.greatest("n", "n_b")) & (
        (100 + percent) * _differ(odd) <= (100 - percent) * (F.col("n") + F.col("n_b"))
    )
    other = F.expr("NOT outside OR comp < comp_b") & (F.col("comp") != F.col("comp_b"))
    fits = alike & (_differ(bits) <= REGISTERS * (apart + ERRORS * room))
    pairs = left.join(right, (F.col("key") == F.col("key_b")) & (F.col("part") == F.col("part_b")) & other & fits)
    return pairs.select(F.least("class", "class_b").alias("a"), F.greatest("class", "class_b").alias("b")).distinct()


def _likely(pairs: DataFrame, active: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and estimated similarity allow a link."""
    side = {s: active.select(F.col("class").alias(s), F.col("n").alias(f"n_{s}"), F.col("registers").alias(f"reg_{s}")) for s in "ab"}
    both = pairs.join(side["a"], "a").join(side["b"], "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")

    def run(batch: pa.RecordBatch) -> dict:
        n = [batch.column(f"n_{s}").to_numpy() for s in "ab"]
        least = percent / 100
        error = np.sqrt(least * (1 - least) / np.minimum(REGISTERS, np.minimum(*n)))
        good = estimate(_registers(batch, "reg_a"), _registers(batch, "reg_b"), *n) >= least - ERRORS * error
        return {c: batch.column(c).filter(pa.array(good)) for c in PAIRS.names}

    return map_batches(both, PAIRS, run)


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that the full sets confirm."""
    both = pairs
    for s in "ab":
        both = both.join(sets.select(F.col("class").alias(s), F.col("set").alias(f"set_{s}")), s)

    def confirm(batch: pa.RecordBatch) -> dict:
        good = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b")):
            x, y = (np.frombuffer(v.as_py(), _U) for v in (x, y))
            shared = len(np.intersect1d(x, y, assume_unique=True))
            good.append(100 * shared >= percent * (len(x) + len(y) - shared))
        return {c: batch.column(c).filter(pa.array(good, pa.bool_())) for c in PAIRS.names}

    return map_batches(both, PAIRS, confirm)


def components(links: DataFrame) -> DataFrame:
    """``(node, comp)`` of all nodes of the links ``(a, b)``; comp is the component's smallest node.

    Labels move along the links and then to their label's label, until none changes, so
    the rounds grow with the logarithm of a component's width.
    """
    links = checkpointed(links)
    n = 2 * links.count()
    ways = _few(links.select(F.col("a").alias("node"), F.col("b").alias("to")).union(links.select("b", "a")), n)
    labels = ways.groupBy("node").agg(F.min("to").alias("low")).select("node", F.least("node", "low").alias("comp"))
    labels = checkpointed(_few(labels, n))
    while True:
        heard = _few(ways.join(labels, "node"), n).groupBy(F.col("to").alias("node")).agg(F.min("comp").alias("heard"))
        nearer = labels.join(heard, "node", "left").select("node", F.col("comp").alias("before"), F.least("comp", "heard").alias("comp"))
        nearer = checkpointed(_few(nearer, n))
        up = nearer.select(F.col("node").alias("comp"), F.col("comp").alias("upper"))
        moved = nearer.join(up, "comp", "left").select("node", "before", F.least("comp", "upper").alias("comp"))
        moved = checkpointed(_few(moved, n))
        labels = moved.select("node", "comp")
        if moved.where("before <> comp").isEmpty():
            return labels


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row; see :func:`groups`."""
    return groups(df, id_col, text_col, percent, words).drop("text_key", "group")


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """``(doc_id, text_key, n_shingles, group, component_id, kept)`` of every row.

    ``text_key`` is xxhash64 of the text and ``group`` a label of the component (null without
    shingles); both tell rows of one id apart.
    Rows are linked if their sets share at least ``percent`` in a hundred of their union;
    the component is named by its smallest id, whose row is kept.
    """
    rows = pick(df, doc_id=(id_col, "bigint"), text=(text_col, "string"))
    drawn = checkpointed(sketches(rows, words))
    classes = checkpointed(
        drawn.where("doc_id IS NOT NULL AND class IS NOT NULL")
        .groupBy("class")
        .agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.first("registers").alias("registers"))
    )
    members = checkpointed(_shared_buckets(classes))
    active = checkpointed(_active(members, classes))
    sets = checkpointed(_sets_of(rows, active, words))
    now, n = members.withColumn("comp", F.col("class")), members.count()
    tested = links = comps = None
    for step in range(ROUNDS + 1):
        held = checkpointed(_open_buckets(_few(now, n), _rank(step), n))
        n = held.count()
        pairs = _leader_pairs(held, n) if step < ROUNDS else _rest_pairs(held, active, sets, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        likely = checkpointed(_likely(pairs, active, percent))
        now = held.select("key", "class", "comp")
        if likely.isEmpty():
            continue
        found = checkpointed(_links(likely, sets, percent))
        tested = likely if tested is None else tested.union(likely)
        links = found if links is None else links.union(found)
        comps = components(links)
        now = held.select("key", "class").join(comps.withColumnRenamed("node", "class"), "class", "left")
        now = now.withColumn("comp", F.coalesce("comp", "class"))
    if comps is None:
        named = classes.select("class", F.col("class").alias("group"), F.col("rep").alias("component_id"))
    else:
        linked = classes.select("class", "rep").join(comps.withColumnRenamed("node", "class"), "class")
        names = linked.groupBy("comp").agg(F.min("rep").alias("name"))
        of = linked.join(names, "comp").select("class", "comp", "name")
        named = classes.join(of, "class", "left").select(
            "class", F.coalesce("comp", "class").alias("group"), F.coalesce("name", "rep").alias("component_id")
        )
    out = drawn.select("doc_id", "text_key", "n_shingles", "class").join(named, "class", "left")
    own = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component_id")), F.col("doc_id"))
    kept = F.coalesce(F.col("doc_id") == own, F.lit(True))
    return out.select("doc_id", "text_key", "n_shingles", "group", own.alias("component_id"), kept.alias("kept"))
