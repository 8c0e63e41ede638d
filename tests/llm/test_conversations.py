"""Exact copies, conversation repair and the prefix trie against brute force, and on odd input."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tablewright.llm import exact_copies, prefix_trie, repair

NOTHING = hashlib.sha256(b"").hexdigest()
DOCS = "doc_id long, text string, keep_id string, digest int, run int, place string"
TURNS = "conv_id long, turn long, role string, text string, signature string, depth int, n_convs string, shard string"


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Exact copies


def _copies(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    out = []
    for i, text in rows:
        ids = [x for x in groups[text or ""] if x is not None]
        out.append((i, max(ids, default=None), len(groups[text or ""]), _sha(text or "")))
    return out


@pytest.mark.parametrize("fan_in, parts", [(16, 1), (2, 9), (3, 30)])
def test_exact_copies(spark, fan_in, parts):
    dice = random.Random(4)
    texts = [None, "", " ", "a", "a\n", "A", "é", "é", "😀", "x" * 1_000_000, "x" * 999_999 + "y", "\x00", "hot"]
    rows = [(i, "hot" if i % 3 == 0 else dice.choice(texts)) for i in dice.sample(range(-500, 500), 600)]
    rows += [(None, "hot"), (None, "lone"), (None, "twice"), (None, "twice"), (7_000, "same id"), (7_000, "same id"), (7_000, "other text")]
    df = spark.createDataFrame([(*r, "q", 1, 2, None) for r in rows], DOCS).repartition(parts)
    got = exact_copies.exact_copies(df, fan_in=fan_in).collect()
    assert sorted(map(repr, [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got])) == sorted(map(repr, _copies(rows)))
    stays = defaultdict(list)
    for r in got:
        stays[r.text_sha256] += [r.doc_id] * r.kept
    # One row of each text stays, the one with the largest id, repeated rows and rows without id included.
    assert {k: v for k, v in stays.items()} == {r[3]: [r[1]] for r in _copies(rows)}


def test_exact_copies_smallest_and_normalised(spark):
    rows = [(5, "A b", "q", 1, 2, None), (3, "a B", "q", 1, 2, None), (9, "a c", "q", 1, 2, None), (None, "A B", "q", 1, 2, None)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = exact_copies.exact_copies(df, keep=exact_copies.SMALLEST, normalise=F.lower, fan_in=2).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {(5, 3, 3, False), (3, 3, 3, True), (9, 9, 1, True), (None, 3, 3, False)}
    assert exact_copies.exact_copies(df.where("false")).count() == 0
    with pytest.raises(ValueError, match="Unknown rule"):
        exact_copies.exact_copies(df, keep="any")


def test_exact_copies_stay_in_the_jvm(spark, sf_dir):
    plan = exact_copies.exact_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)


# Conversation repair


def _faults(rows):
    """Rows (turn, role, text) in order, each with its first fault."""
    seen, out = set(), []
    for turn, role, text in rows:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def _best(rows):
    """Least (cost, audit, repaired rows) over every sequence of edits with at most two inserts in a row."""
    rest = {}
    for at, inserts, state in itertools.product(range(len(rows), -1, -1), (2, 1, 0), ("", "s", "u", "a")):
        found = [(0, "", ())] if at == len(rows) and state in ("", "a") else []
        puts = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        role = {"u": "user", "a": "assistant"}[puts]
        ways = [] if inserts == 2 else [(2, "I", (f"{role}:",), (at, inserts + 1, puts))]
        if at < len(rows):
            _, own, text, fault = rows[at]
            ways.append((3, "D", (), (at + 1, 0, state)))
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                ways.append((2 + cut, "R", (f"{role}:{text}",), (at + 1, 0, puts)))
                if own[:1] == puts or (own[:1] == "s" and not state):
                    ways.append((cut, "K", (f"{own}:{text}",), (at + 1, 0, own[:1])))
        found += [(cost + rest[to][0], edit + rest[to][1], put + rest[to][2]) for cost, edit, put, to in ways if to in rest]
        if found:
            rest[at, inserts, state] = min(found, key=lambda f: f[:2])
    return rest[0, 0, ""]


def _repair(table):
    """Expected rows of a table of (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for conv, turn, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        convs[conv] += [(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        faults = _faults(rows)
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts = [sum(f[3] == n for f in faults) for n in ("blank", "duplicate", "truncated")]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, mended = _best(faults) if rows else (0, "", ())
        out[conv] = (gaps, *counts, illegal, cost, audit, _sha("\n".join(mended)))
    return out


def test_audits_against_every_edit(spark):
    texts = {0: "One {}.", 1: "two {}", 2: "  "}
    signatures, want = [], []
    for n in range(5):
        for symbols in itertools.product("sSuUaAoOx", repeat=n):
            if n == 4 and hash(symbols) % 3:
                continue
            rows = [(i, {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}[c.lower()], texts[2 if c == "x" else int(c.isupper())].format(i)) for i, c in enumerate(symbols)]
            signatures.append("".join(symbols)[::-1])
            want.append((signatures[-1], *_best(_faults(rows))[:2]))
    want.sort()
    assert [(s, *a) for s, a in zip(sorted(signatures), repair.audits(sorted(signatures)))] == want
    # The order of the signatures decides only how much is shared.
    random.Random(1).shuffle(signatures)
    assert sorted((s, *a) for s, a in zip(signatures, repair.audits(signatures))) == want


def test_repair(spark):
    dice = random.Random(11)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "ua"], ["Yes.", "no", "", " \t\n", None, "What? ", "é!", "x" * 70_000, " "]
    table = [
        (conv, dice.choice([None, t, t, t, t + 3, 2]), dice.choice(roles[: 3 if conv % 2 else 7]), dice.choice(texts))
        for conv in range(-20, 180) for t in range(dice.choice([1, 2, 4, 6]))
    ]
    table += [(None, 1, "user", "Lost."), (None, None, None, None), (None, 2, "assistant", "Found.")]
    # A conversation that loses all rows, and one far longer than any other.
    gone = next(i for i in range(1000, 9999) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    table += [(gone, 0, "user", "Gone.")] + [(5000, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(150)]
    df = spark.createDataFrame([(*r, "s", 1, "c", "q") for r in table], TURNS)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(df.repartition(5)).collect()}
    assert got == _repair(table)
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", NOTHING)
    assert repair.repair(df.where("false")).count() == 0


def test_long_conversation_is_streamed():
    text = "aU" * 200_000
    ((cost, audit),) = repair.audits([text[::-1]])
    # An inserted user row, then the pairs, each with a truncated user row; to answer the last one costs as much as to delete it.
    assert audit == "I" + "K" * 399_999 + "D" and cost == 2 + 199_999 + 3
    state = repair._Repair(audit)
    for i in range(400_000):
        state.add(("assistant", "user")[i % 2], "t")
    assert len(state.hexdigest()) == 64


# Prefix trie


def _trie(table):
    convs = defaultdict(list)
    for conv, turn, role, text in table:
        if conv is not None:
            convs[conv].append((turn, role or "", text or ""))
    for rows in convs.values():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    nodes, ends = defaultdict(list), defaultdict(list)
    for conv in sorted(convs):
        h, base = zlib.crc32(str(conv).encode()) % 9, conv - int(abs(conv) % 5) * (1 if conv >= 0 else -1)
        path = tuple(r[1:] for r in convs.get(base, [])[:h] + convs[conv][h:])
        for d in range(len(path) + 1):
            nodes[path[:d]].append(conv)
        ends[path].append(conv)
    children = defaultdict(int)
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted(
        (m[0], len(p), nodes[p[:-1]][0] if p else -(10**9), len(m), children[p], leaves[p], saved[p], _sha(",".join(map(str, ends[p]))))
        for p, m in nodes.items()
    )


def _table(dice):
    first = [("user", "Hello"), ("assistant", "Hé"), ("user", "again"), (None, "x" * 3000), ("system", None)]
    table = []
    for conv in [*range(-12, 260), 10**12, 10**12 + 3]:
        turns = first[: dice.choice([0, 2, 3, 5])] + [(dice.choice(["user", "assistant"]), dice.choice(["a", "b", "é", ""])) for _ in range(dice.choice([0, 1, 4, 9]))]
        table += [(conv, t, *x) for t, x in enumerate(turns)]
    table += [(conv, t, "user", f"copy {t}") for conv in range(300, 400) for t in range(12)]
    return table + [(3, None, "user", "no turn"), (3, None, "user", "no turn"), (None, 1, "user", "no id"), (-(2**63), 0, "user", "a"), (2**63 - 1, 0, "user", "a")]


@pytest.mark.parametrize("fan_in, limit, shuffles", [(64, 100_000, 8), (2, 3, 40), (3, 40, 1)])
def test_prefix_trie(spark, fan_in, limit, shuffles):
    table = _table(random.Random(fan_in))
    df = spark.createDataFrame([(*r, "s", 1, "c", "q") for r in table], TURNS)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = prefix_trie.prefix_trie(df, fan_in, limit).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(tuple(-(10**9) if r[n] is None else r[n] for n in names) for r in got) == _trie(table)


def test_prefix_trie_without_turns(spark):
    df = spark.createDataFrame([], TURNS)
    assert prefix_trie.prefix_trie(df).count() == 0
    # A conversation that takes turns of an absent base and has none left is a member of the root alone.
    lone = next(i for i in range(10**6, 10**6 + 99) if i % 5 and zlib.crc32(str(i).encode()) % 9 > 1)
    row = prefix_trie.prefix_trie(spark.createDataFrame([(lone, 0, "user", "a", "s", 1, "c", "q")], TURNS)).collect()
    assert [tuple(r) for r in row] == [(lone, 0, None, 1, 0, 1, 0, _sha(str(lone)))]


def test_spilling_queue():
    dice, queue, want = random.Random(2), prefix_trie.SpillingQueue(limit=7, block=3), []
    for _ in range(4000):
        if dice.random() < 0.6 or not want:
            item = (dice.randrange(500), bytes([dice.randrange(256)]), dice.randrange(9))
            queue.push(item)
            want.append(item)
        else:
            want.sort()
            assert queue.first() == want[0] and queue.pop() == want.pop(0)
    assert [queue.pop() for _ in want] == sorted(want) and not queue
