"""The text operators against brute force, public libraries and SQL, and on odd input."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import (
    catalog,
    chat,
    contamination,
    language,
    lm_scoring,
    near_copies,
    pieces,
    quality_model,
    quality_rules,
    token_counts,
    toxicity,
)
from tablewright.llm.common import public_file, read

WORDS_FILE, PIECES_FILE = public_file("word_bpe_49k.json"), public_file("piece_bpe_32k.model")
ODD = [
    None, "", " ", "\n\n", "  a", "▁a b▁", "a\x00b", "</s> x <s>", "😀é\n\tq", "<|endoftext|>x <|STARTOFTEXT|>", "ΑΣ İx", "it's I'LL ½²",
    "x" * 5000, "ab " * 3000, "文字 テスト 　e", "same same same same", "same same same same", "é ﬁ Ⅷ \x1c\x85", "<0x41> ²., a.b",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts beside columns whose names clash with results."""
    rows = [(i, t, "q", 1, None) for i, t in enumerate(ODD)] + [(None, "no id", "q", 1, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, n_words int, `class` string")


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    engine = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        engine.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    result = engine.execute(catalog.SQL[name])
    order = [[d[0] for d in result.description].index(n) for n in names]
    want = sorted(tuple(r[i] for i in order) for r in result.fetchall())
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == want


def test_token_counts(spark, odd, sf_dir):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS_FILE)
    texts = dict(enumerate(ODD)) | {None: "no id"}
    texts |= {r.doc_id + 1000: r.text for r in read(spark, sf_dir, "documents").collect()}
    table = odd.select("doc_id", "text").union(read(spark, sf_dir, "documents").select(F.col("doc_id") + 1000, "text"))
    # A table of few entries and a cache of few words take every path.
    for r in token_counts.token_counts(table, WORDS_FILE, entries=50, cache=20).collect():
        text = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(tokenizer.encode(text, add_special_tokens=False))), text[:50]


def test_pieces_equal_the_library(spark, odd, sf_dir):
    import sentencepiece

    library, model = sentencepiece.SentencePieceProcessor(model_file=PIECES_FILE), pieces.Pieces(PIECES_FILE, cache=50)
    draw = random.Random(4)
    signs = "abcdefgh  \n▁éßñ.,-0123😀日\t\x00"
    texts = [t or "" for t in ODD] + ["".join(draw.choice(signs) for _ in range(draw.randint(1, 60))) for _ in range(500)]
    for text in texts:
        ids = model.encode(text)
        assert ids == library.encode(text) and model.decode(ids) == library.decode(ids), text[:50]
        assert ",".join(map(model.joined_ids, model.parts_of(text))) == ",".join(map(str, ids))
    invalid = [model.bytes[b] for b in (0xE3, 0x81, 0x41, 0xFF)]
    assert model.decode(invalid) == library.decode(invalid)
    texts = {r.doc_id: r.text for r in read(spark, sf_dir, "documents").collect()}
    for r in catalog.QUERIES["op9_pieces"](spark, sf_dir).collect():
        ids = library.encode(texts[r.doc_id])
        joined, decoded = ",".join(map(str, ids)), library.decode(ids)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(joined.encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert pieces.encode(odd, PIECES_FILE).count() == odd.count()


def _rules_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, dup, len(inside), len(words) < 10 or 100 * len(inside) > 20 * len(words)


def test_quality_rules(spark, odd, sf_dir):
    small = read(spark, sf_dir, "documents").where("n_chars < 4000")
    texts = {r.doc_id: r.text for r in small.collect()}
    for r in quality_rules.quality_rules(small).collect():
        assert tuple(r)[1:7] == _rules_by_hand(texts[r.doc_id])
        assert r.kept == (not r.base_failed and quality_rules.compression(texts[r.doc_id].encode())[0])
    for r in quality_rules.quality_rules(odd).where("doc_id IS NOT NULL AND doc_id <> 13").collect():
        assert tuple(r)[1:7] == _rules_by_hand(ODD[r.doc_id])
    draw = np.random.default_rng(1)
    noise = " ".join("".join(chr(33 + c) for c in draw.integers(0, 90, 9)) for _ in range(600))
    pattern = "\n".join(f"entry {i:04d} of the list is as all the others are and has nothing new" for i in range(300))
    prose = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").where("quality = 1"), "doc_id")
    assert not quality_rules.compression(noise.encode())[0] and not quality_rules.compression(pattern.encode())[0]
    judged = quality_rules.quality_rules(prose).where("NOT base_failed")
    assert judged.where("NOT kept").count() == 0 and judged.count() > 20
    assert quality_rules.keep_good(odd).columns == odd.columns


def _held_out_accuracy(rows, labels, label):
    return rows.where("held_out").join(labels, "doc_id").select(F.avg((F.col(label) == F.col("predicted")).cast("int"))).first()[0]


def test_quality_model(spark, odd):
    folder = "/root/testdata/sf0.01"
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    rows = catalog.QUERIES["op2_quality_model"](spark, folder)
    assert _held_out_accuracy(rows, labels, "quality") > 0.93
    trees = quality_model.fit(docs, labels)
    x = np.stack([quality_model.statistics((t or "").encode()) for t in ODD])
    for row, want in zip(x, trees.scores(x)):  # every tree walked node by node
        total = trees.base
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            at = 0
            while at < len(feature):
                at = 2 * at + 1 + (row[feature[at]] > threshold[at])
            total += leaf[at - len(feature)]
        assert abs(1 / (1 + np.exp(-total)) - want) < 1e-9
    assert quality_model.score(odd, trees).count() == odd.count()
    assert {r.score for r in quality_model.score(odd, quality_model.fit(odd, labels.limit(0))).collect()} == {0.5}


def test_toxicity(spark, odd):
    folder = "/root/testdata/sf0.01"
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    assert _held_out_accuracy(catalog.QUERIES["op7_toxicity"](spark, folder), labels, "toxic") > 0.9
    model = toxicity.fit(docs, labels)
    for r in toxicity.score(odd, model).where("doc_id IS NOT NULL").collect():
        seen = set(toxicity.grams(ODD[r.doc_id] or "").tolist())
        z = model.intercept + sum(w for b, w in zip(model.buckets.tolist(), model.weights) if b in seen)
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9
    assert toxicity.keep_clean(odd, model).columns == odd.columns
    none = toxicity.fit(odd, labels.limit(0))
    assert all(r.score < 1e-6 for r in toxicity.score(odd, none).collect())


def test_toxicity_keeps_rare_and_weak_evidence(spark):
    """Thousands of surer n-grams of one source leave room for the evidence of a small one."""
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abcdefghijklm") for _ in range(7))
    bad, plain = [word() for _ in range(900)], [word() for _ in range(300)]
    rows = [(" ".join(draw.sample(bad, 60) + draw.sample(plain, 10)), 1) for _ in range(300)]
    rows += [(" ".join(draw.sample(plain, 70)), 0) for _ in range(300)]
    rows += [(f"{'zorvux' if i % 2 else 'wyquop'} {' '.join(draw.sample(plain, 5))}", i % 2) for i in range(24)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int"))
    assert set(toxicity.grams("zorvux").tolist()) <= set(model.buckets.tolist())
    table, rest = model.table(), " ".join(plain[:5])
    assert model.score(f"zorvux {rest}", table) > model.score(f"wyquop {rest}", table) + 0.3
    # The sample's counts by hand: every n-gram that a row holds has a weight, however rare or even its counts.
    sampled = [t for i, (t, _) in enumerate(rows) if zlib.crc32(str(i).encode()) % toxicity.MODULUS != toxicity.REST]
    assert set(model.buckets.tolist()) == {g for t in sampled for g in toxicity.grams(t).tolist()}


def test_language(spark, odd):
    folder = "/root/testdata/sf0.01"
    docs = read(spark, folder, "documents")
    rows = catalog.QUERIES["op5_language"](spark, folder).where("held_out").join(docs.where("lang IS NOT NULL"), "doc_id")
    assert rows.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    learned = language.learn(docs)
    for r in language.predict(odd, learned).where("doc_id IS NOT NULL").collect():
        grams, times = language.trigrams(ODD[r.doc_id] or "")
        if not any(c.isalpha() for c in (ODD[r.doc_id] or "").lower()):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        total = sum((language.bind(grams[i : i + 1])[0].astype(float) * t for i, t in enumerate(times)), np.zeros(language.WIDTH))
        cosines = {k: float(total @ v / np.linalg.norm(total)) for k, v in learned.items()}
        assert r.lang_pred == max(sorted(cosines), key=cosines.get) and abs(r.score - max(0, max(cosines.values()))) < 1e-4
    assert {r.lang_pred for r in language.predict(odd, {}).collect()} == {"und"}


def test_contamination(spark, odd):
    docs = spark.createDataFrame([(1, "x " + " ".join(f"w{i}" for i in range(14)) + " y"), (2, "w1 W2, w3"), (3, None), (3, "w3 gap w4 w5")], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(f"w{i}" for i in range(14))), (8, "w2 w3"), (8, "w2 w3"), (9, "--"), (10, None), (11, "w3 w4 w5")], "item_id long, text string")
    want = {(1, 16, 14, 3, 3), (2, 3, 2, 1, 1), (3, 0, 0, 0, 0), (3, 4, 0, 0, 1)}
    for block_words in (1000, 3):  # one block of items, and several
        rows = contamination.contamination(docs, items, block_words=block_words).collect()
        assert {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.n_near_items) for r in rows} == want
        assert {r.items_sha256 for r in rows if r.doc_id == 1} == {hashlib.sha256(b"11,7,8").hexdigest()}
    assert contamination.contamination(odd, items).count() == odd.count()
    assert contamination.contamination(odd, items.limit(0)).where("contaminated").count() == 0


def test_contamination_by_items_without_id(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "x y")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "b c"), (5, "p q r s"), (6, "c d")], "item_id long, text string")
    for block_words in (1000, 2):
        rows = contamination.contamination(docs, items, block_words=block_words).collect()
        assert {(r.doc_id, r.n_hit, r.n_items, r.contaminated) for r in rows} == {(1, 3, 1, True), (2, 0, 0, False)}
        alone = contamination.contamination(docs, items.where("item_id IS NULL"), block_words=block_words).collect()
        assert {(r.doc_id, r.n_hit, r.n_items, r.contaminated) for r in alone} == {(1, 2, 0, True), (2, 0, 0, False)}


def test_near_copies_of_planted_groups(spark):
    draw = random.Random(2)
    words = [f"w{i}" for i in range(4000)]
    rows, n = [], 0
    for size in (400, 60, 8, 2, 1, 1):  # the first group holds most rows
        base = [draw.choice(words) for _ in range(draw.choice((12, 60, 250)))]
        for _ in range(size):
            text = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // 20))):
                text[draw.randrange(len(text))] = draw.choice(words)
            rows.append((n, " ".join(text)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "one"), (n + 3, "ONE"), (n + 3, "ONE"), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = {tuple(w)} if len(w) == 1 else set(zip(w, w[1:]))
    name = {i: i for i in sets if i is not None}

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for a, b in itertools.combinations(sorted(name), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            low, high = sorted((root(a), root(b)))
            name[high] = low
    found = near_copies.near_copies(df).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), root(r.doc_id) == r.doc_id)


def test_sketches_estimate_similarity():
    draw = np.random.default_rng(3)
    for share in (0.2, 0.6, 0.9):
        both = draw.integers(0, 2**63, int(3000 * share)).astype(np.uint64)
        own = [draw.integers(0, 2**63, int(3000 * (1 - share) / 2)).astype(np.uint64) for _ in "ab"]
        sets = [np.unique(near_copies.mix(np.concatenate((both, o)))) for o in own]
        n = [np.array([len(s)]) for s in sets]
        guess = near_copies.estimate(*[near_copies.sketch(s)[None] for s in sets], *n)[0]
        assert abs(guess - share) < 0.12
    long = " ".join(f"word{i}" for i in range(400_000)).encode()  # several segments
    assert len(near_copies.shingles(long)) == 399_999


def test_chat_round_trip(spark):
    draw = random.Random(3)
    parts = ["\\", "<s>", "</s>", "[INST]", "[/INST]", "<", "]", "/s>", "<<SYS>>", "<</SYS>>", " ", "a", "\n", "[ROLE]", "[/ROLE]", '"', " [/INST]"]
    rows = [(i // 5, i % 5, draw.choice(["user", "assistant", "system", "tool", 'a\n"<s>[/ROLE]']), "".join(draw.choices(parts, k=draw.randint(0, 7)))) for i in range(3000)]
    rows += [(9000, None, None, None), (9000, 1, "assistant", None), (9000, 1, "assistant", None), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rendered", F.lit(1))
    want = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        entry = want.setdefault(conv, ["", "", 0])
        entry[0] += f"{role or ''}\n{text or ''}\n"
        entry[1] += (text or "") if role == "assistant" else ""
        entry[2] += 1
    found = chat.read_back(chat.format_turns(df)).collect()
    assert len(found) == len(want)
    for r in found:
        turns, loss, n = want[r.conv_id]
        digests = hashlib.sha256(turns.encode()).hexdigest(), hashlib.sha256(loss.encode()).hexdigest()
        assert (r.turns_sha256, r.loss_sha256, r.n_turns, r.loss_chars) == (*digests, n, len(loss))
    assert Counter(chat.safe_render("user", t)[3] for t in ("a", "[INST]", "a\\")) == {0: 2, 1: 1}
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_lm_scores(spark, odd):
    random_state = random.Random(1)
    words = "the cat sat on a mat and then it ran to see the dog".split()
    likely = [" ".join(words * 20)] * 60
    shuffled = " ".join(random_state.sample(words * 20, len(words) * 20))
    rows = [(i, t) for i, t in enumerate([*likely, shuffled])] + [(-1, None), (-2, "")]
    scores = {r.doc_id: r for r in lm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert scores[0].per_word > scores[60].per_word + 0.2 and scores[0].n_words == 280
    assert (scores[-1].n_words, scores[-1].log_chance, scores[-2].per_word) == (0, 0.0, 0.0)
    network = lm_scoring.Network.start(np.log(np.full(lm_scoring.CLASSES, 1 / lm_scoring.CLASSES)))
    around = [np.array([3, 5], np.uint8)] * 4
    chances = np.stack([network.log_chances(around, np.full(2, c)) for c in range(lm_scoring.CLASSES)])
    assert np.allclose(np.exp(chances).sum(axis=0), 1, atol=1e-4)
    assert lm_scoring.lm_scores(odd).count() == odd.count()


def test_lm_trains_on_every_word(spark):
    """Texts of three words teach the network as long ones do, and each word is trained on in one round."""
    phrases = [[f"a{i}", f"b{i}", f"c{i}"] for i in range(20)]
    rows = [(i, " ".join(phrases[i % 20])) for i in range(20_000)]
    rows += [(-1 - i, f"a{i} b{(i + 7) % 20} c{i}") for i in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    scores = {r.doc_id: r.per_word for r in lm_scoring.lm_scores(table).where("doc_id < 20").collect()}
    assert min(scores[i] - scores[-1 - i] for i in range(20)) > 0.3
    padded = lm_scoring.windows([np.arange(n) for n in (1, 0, 40, 2)], np.arange(50))
    parts = [lm_scoring.middles_of(padded, turn, 3).tolist() for turn in range(3)]
    assert sorted(sum(parts, [])) == [i for i, c in enumerate(padded) if c != lm_scoring.PAD] and sum(map(len, parts)) == 43


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_empty_tables(spark, tmp_path, sf_dir, name):
    for t in ("documents", "benchmark", "labels", "conversations"):
        read(spark, sf_dir, t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert catalog.QUERIES[name](spark, str(tmp_path)).count() == (1 if name == "op10_chat_format" else 0)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = read(spark, sf_dir, "documents")
    extra = docs.withColumns({"n_words": F.lit(1), "kept": F.lit("x"), "class": F.lit(None).cast("string")})
    odd_rows = docs.limit(1).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra.unionByName(odd_rows, allowMissingColumns=True), sf_dir)
        assert out.columns == extra.columns, name
    kept = docs
    kept = kept.join(quality_rules.quality_rules(kept).where("kept").select("doc_id"), "doc_id", "left_semi")
    model = toxicity.fit(kept, read(spark, sf_dir, "labels"))
    kept = kept.join(toxicity.score(kept, model).where("predicted = 0").select("doc_id"), "doc_id", "left_semi")
    kept = kept.join(near_copies.near_copies(kept).where("kept").select("doc_id"), "doc_id", "left_semi")
    bad = contamination.contamination(kept, read(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id")
    kept = kept.join(bad, "doc_id", "left_anti")
    want = sorted(map(tuple, pieces.encode_digests(kept, PIECES_FILE).collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == want and len(want) > 50


def test_parities_rule_out_no_link():
    """Places that differ never exceed the shingles that only one of two sets has."""
    random = np.random.Generator(np.random.Philox(key=5))
    for size in (0, 1, 40, 150, 3000):
        base = random.integers(0, 1 << 63, size, dtype=np.uint64)
        for own in (0, 1, 20, 700):
            other = np.union1d(base[: size - min(size, own)], random.integers(0, 1 << 63, own, dtype=np.uint64))
            differ = int(np.bitwise_count((near_copies.parities(base) ^ near_copies.parities(other)).view(np.uint64)).sum())
            assert differ <= len(np.setxor1d(base, other))


def test_large_group_around_the_limit(spark):
    """Many texts of one base, most pairs of them just below the limit: the groups are those of all pairs."""
    random = np.random.Generator(np.random.Philox(key=9))
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(150):
        words = list(base)
        for at in random.choice(150, int(random.integers(4, 14)), replace=False):
            words[at] = f"x{i}_{at}"
        texts.append(" ".join(words))
    sets = [set(near_copies.shingles(t.encode()).tolist()) for t in texts]
    comp = list(range(150))
    for i in range(150):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared) and comp[i] != comp[j]:
                low, high = sorted((comp[i], comp[j]))
                comp = [low if c == high else c for c in comp]
    assert 1 < len(set(comp)) < 150
    found = near_copies.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in found.collect()} == dict(enumerate(comp))


def test_quality_rules_judge_the_last_part(spark):
    """A rest shorter than a chunk is judged; a short text is one chunk with the limits of its length."""
    draw = np.random.default_rng(3)
    kinds = [draw.choice(list(b"etaoinshrdlu"), int(draw.integers(2, 9))).astype(np.uint8).tobytes() for _ in range(150)]
    prose = b" ".join(kinds[i] for i in draw.integers(0, 150, 3000))[: 2 * 4096]
    assert quality_rules.compression(prose)[2:] == (0, 2)
    assert quality_rules.compression(prose + b"a" * 4000)[2:] == (1, 3)
    assert quality_rules.compression(prose[:3000])[2:] == (0, 1) and quality_rules.compression(b"a" * 3000)[2:] == (1, 1)


def test_chat_long_texts_and_ties(spark):
    """Escaping takes time in proportion to the text, and turns of one number stand in the order of role and text."""
    text = "\\" * 2_000_000 + "[INST]" + "\\" * 1001
    rendered, begin, end, level = chat.safe_render("assistant", text)
    assert chat.read_turn(rendered)[1] == text and level == 2
    rows = [(1, 0, "user", "A"), (1, 0, "user", "<s>"), (1, 0, "user", "[INST]"), (1, 0, "user", "Z")]
    found = chat.read_back(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    want = "".join(f"{r[2]}\n{r[3]}\n" for r in sorted(rows))
    assert found.turns_sha256 == hashlib.sha256(want.encode()).hexdigest()


@pytest.mark.parametrize("size", [0, 1, 7, 30, 63, 64, 100, 500])
def test_most_frequent_words(spark, size):
    """Exactly as many words as asked for, none of them less frequent than one left out, and the same ones whatever the partitions."""
    rows = [(f"w{i}".encode(), 1000 if i < 40 else 997 if i < 60 else 5 if i < 64 else 1) for i in range(200)]
    counts = spark.createDataFrame(rows, "word binary, n long")
    found = [(bytes(r.word), r.n) for r in lm_scoring.most_frequent(counts, size).collect()]
    assert len(set(found)) == len(found) == min(size, 200)
    assert sorted((n for _, n in found), reverse=True) == sorted((n for _, n in rows), reverse=True)[:size]
    again = lm_scoring.most_frequent(counts.repartition(5), size).collect()
    assert sorted(found) == sorted((bytes(r.word), r.n) for r in again)


def test_bounded_sample_is_the_same_in_every_run(spark):
    from tablewright.llm.samples import labelled

    labels = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    draws = [sorted(r.doc_id for r in labelled(df, "toxic", 100, 3, 1).collect()) for df in (labels, labels.repartition(7))]
    assert draws[0] == draws[1] and 50 < len(draws[0]) <= 100


def test_pipeline_tells_rows_of_one_id_apart(spark, tmp_path):
    """Of rows that share an id each text is judged for itself, and no clean text is lost."""
    import corpus_pipeline

    item = " ".join(f"q{i}" for i in range(20))
    texts = {n: " ".join(f"{n}{i}" for i in range(40)) for n in "abcd"}
    rows = [(1, texts["a"], 7), (1, texts["b"], 8), (1, texts["b"], 8), (2, texts["a"] + " z", 9), (1, item, 10), (None, item, 11), (None, texts["c"], 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text_key int")
    benchmark = spark.createDataFrame([(5, item)], "item_id long, text string")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    one = corpus_pipeline.one_of_each(spark, docs, str(tmp_path))
    assert one.columns == docs.columns
    assert sorted(r._text_key for r in one.collect()) == [7, 8, 10, 11, 12]
    clean = corpus_pipeline.uncontaminated(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and sorted(r._text_key for r in clean.collect()) == [7, 8, 8, 9, 12]


def test_hot_buckets_are_cut_without_losing_links(spark, monkeypatch):
    """Buckets taken by a few rows at a time give the groups that whole buckets give."""
    draw = np.random.Generator(np.random.Philox(key=4))
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(120):
        words = list(base)
        for at in draw.choice(120, int(draw.integers(4, 12)), replace=False):
            words[at] = f"x{i}_{at}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = sorted(map(tuple, near_copies.near_copies(df).collect()))
    monkeypatch.setattr(near_copies, "BUCKET_ROWS", 5)
    monkeypatch.setattr(near_copies, "ROUNDS", 0)
    assert sorted(map(tuple, near_copies.near_copies(df).collect())) == whole


def test_lm_scores_against_a_plain_loop(spark):
    """Scores of ten texts, word by word, with the network and vocabulary that the operator trains."""
    draw = random.Random(8)
    names = [f"t{i}" for i in range(30)]
    texts = [" ".join(draw.choice(names) for _ in range(draw.choice([0, 1, 2, 5, 90]))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    known = lm_scoring.Vocabulary.of(lm_scoring.word_counts(df))
    shared = spark.sparkContext.broadcast(known)
    net = lm_scoring.train(lm_scoring.coded_texts(df, shared).select("classes"), known.prior)
    numbers = known.numbers()
    found = {r.doc_id: r for r in lm_scoring.lm_scores(df).collect()}
    for i, text in list(enumerate(texts))[:10]:
        own = [numbers[w.encode()] for w in text.split()]
        classes = [lm_scoring.PAD] * 2 + [int(known.classes[n]) for n in own] + [lm_scoring.PAD] * 2
        want = 0.0
        for at, n in enumerate(own):
            hidden = np.tanh(sum(net.tables[j][classes[at + k]] for j, k in enumerate((0, 1, 3, 4))) + net.bias)
            scores = hidden @ net.out + net.out_bias
            want += scores[classes[at + 2]] - np.log(np.exp(scores).sum()) + known.shares[n]
        assert found[i].n_words == len(own) and abs(found[i].log_chance - want) < 1e-3 * max(1, len(own))
