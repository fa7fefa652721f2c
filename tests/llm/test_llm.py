"""Corpus and label-set operators against brute force and public libraries, with dirty inputs."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from gridweave.llm import bpe, components, leak, overlap, spans, split

DOCS = "doc_id bigint, text string, h int, pos int, doc int, ids int, item_id int, spots int"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 0, 0, 0, 0, 0, 0) for i, t in texts], DOCS)


# --- tokens -------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    t = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    return t


def test_encoding_equals_the_library(tokenizer):
    rng = random.Random(3)
    chars = "aab'st rel vmd  \n\t\r 　\x1c\x1f\x85\x0b\x00 é中😀1٣²_.,--<|endoftext|>ßǅⅫ​́"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["a" * 5000, " " * 3000, "ab" * 700 + "'s", "", "'s", "'", "'l", "'ll", "x'll", " 's", "\n's", "''s", "'s's", "'re've", "  x", "é" * 900, "<|endoftext|>", "Zq" * 2000, "x\r\n\r\n y"]
    v = bpe.Vocabulary()
    got = bpe.encode_texts(v, pa.array(texts)).to_pylist()
    assert got == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    # The same in small slices, and for one slice of an array.
    assert bpe.encode_texts(v, pa.array(texts).slice(5, 50)).to_pylist() == got[5:55]


def test_encode_frames(spark, tokenizer):
    df = docs(spark, [(1, "hello world"), (2, None), (3, ""), (4, "hello world"), (4, "hello world"), (None, "x")])
    got = [(r["doc_id"], r["ids"]) for r in bpe.encode(df).collect()]
    hello = tokenizer.encode("hello world").ids
    assert sorted(got, key=str) == sorted([(1, hello), (2, []), (3, []), (4, hello), (4, hello), (None, tokenizer.encode("x").ids)], key=str)
    assert bpe.encode(df.limit(0)).count() == 0


# --- leaks --------------------------------------------------------------------


def brute_leaks(texts, items, run=12):
    out = set()
    for d, t in texts:
        grams = {tuple(w[i : i + run]) for w in [leak.words_of(t)] for i in range(len(w) - run + 1)}
        out |= {(d, i) for i, q in items for w in [leak.words_of(q)] if any(tuple(w[k : k + run]) in grams for k in range(len(w) - run + 1))}
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(1)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split())
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 25)))) for i in range(60)] + [(60, None), (61, ""), (3, None)]
    items.append((62, items[0][1] if len(items[0][1].split()) >= 12 else "one two three four five six seven eight nine ten eleven twelve"))
    texts = []
    for d in range(150):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30)))]
        if rng.random() < 0.7:
            w = (rng.choice(items[:60])[1]).split()
            k = rng.randint(0, max(0, len(w) - 11))
            parts.append(rng.choice([" ", "\n+", ", "]).join(x.upper() if rng.random() < 0.3 else x for x in w[k : k + rng.randint(9, 14)]))
        parts.append("é" + " ".join(word() for _ in range(rng.randint(0, 30))))
        texts.append((d, rng.choice(["\n", "--", "ß"]).join(parts)))
    texts += [(900, None), (901, ""), (902, " ".join(word() for _ in range(200_000)))]
    df = docs(spark, texts + texts[:3])
    it = spark.createDataFrame(items + items[:2], "item_id bigint, text string")
    got = [tuple(r) for r in leak.leaked_items(df, it).collect()]
    assert set(got) == brute_leaks(texts, [i for i in items]) and len(set(got)) == len(got) and len(got) > 30
    sharded = leak.leaked_items(df, it, shard_bytes=1500)
    assert sorted(tuple(r) for r in sharded.collect()) == sorted(got)
    assert leak.leaked_items(df, it.limit(0)).count() == 0 and leak.leaked_items(df.limit(0), it).count() == 0


def test_wand_finds_what_scoring_everything_finds():
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(400)]
    zipf = rng.zipf(1.3, 10**6) % 400
    draw = iter(zipf.tolist())
    text = lambda n: " ".join(words[next(draw)] for _ in range(n))
    items = [(i, text(int(rng.integers(10, 40)))) for i in range(500)]
    index = leak.ItemIndex(items, block=8)
    rows = np.full((300, 24), -1, np.int32)
    number = {w: i for i, w in enumerate(sorted({x for _, t in items if len(leak.words_of(t)) >= 12 for x in leak.words_of(t)}))}
    for r in range(300):
        if r % 2:
            w = leak.words_of(items[int(rng.integers(500))][1])
            k = int(rng.integers(0, max(1, len(w) - 14)))
            w = [x if rng.random() > 0.1 else b"w1" for x in w[k : k + 24]]
        else:
            w = leak.words_of(text(24))
        rows[r, : len(w)] = [number.get(x, -1) for x in w]
    pairs = np.full((300, 23), -1, np.int64)
    for r in range(300):
        pairs[r] = index.pairs(rows[r], np.zeros(24, int))[:23]
    got = set(zip(*(x.tolist() for x in leak.candidates(index, pairs))))
    want = set()
    for r in range(300):
        score, varied = np.zeros(index.n), np.zeros(index.n, int)
        for x in set(pairs[r].tolist()) - {-1}:
            a, b = index.post_start[x], index.post_start[x + 1]
            score[index.post_item[a:b]] += index.weights[a:b]
            varied[index.post_item[a:b]] += 1
        want |= {(r, int(j)) for j in np.flatnonzero((score >= index.threshold - 1e-9) & (varied >= index.varied))}
    assert got == want and len(want) > 100
    # Words longer than two machine words, and lookups of words that share their first bytes.
    long_ = [b"a" * k for k in range(1, 40)]
    table = leak.Words(long_)
    low = np.frombuffer(b"".join(long_) + b"a" * 40, np.uint8)
    lens = np.array([*map(len, long_), 40])
    assert table.numbers(low, np.cumsum(lens) - lens, np.cumsum(lens)).tolist() == [*range(39), -1]


# --- shared spans ---------------------------------------------------------------


def brute_shared(texts, span):
    by = {}
    for d, t in texts:
        for i in range(len(t or "") - span + 1):
            by.setdefault(t[i : i + span], set()).add(d)
    out = {}
    for d, t in texts:
        hit = set()
        for i in range(len(t or "") - span + 1):
            if len(by[t[i : i + span]]) > 1:
                hit.update(range(i, i + span))
        if hit:
            out[d] = len(hit)
    return out


def shared_texts(seed):
    rng = random.Random(seed)
    letters = lambda n, a="abcdefgh ü😀\n": "".join(rng.choice(a) for _ in range(n))
    pieces = [letters(rng.randint(30, 90)) for _ in range(6)]
    texts = []
    for d in range(60):
        body = [letters(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(pieces)
            a = rng.randint(0, 20)
            body += [p[a : a + rng.randint(20, 90)], letters(rng.randint(0, 9))]
        texts.append((d, "".join(body)))
    texts += [(100, texts[5][1]), (101, texts[5][1]), (102, "a" * 100), (103, "a" * 130), (104, "ab" * 60), (105, "x" + "ab" * 50), (106, ""), (107, "short"), (108, pieces[0] * 3), (109, letters(30) + texts[7][1])]
    return texts


@pytest.mark.parametrize("hot", [4096, 1])
def test_shared_characters_equal_brute_force(spark, hot):
    texts = shared_texts(hot)
    df = docs(spark, texts + [(200, None), (None, texts[0][1])])
    got = {r["doc_id"]: r["shared_chars"] for r in spans.shared_chars(df, span=40, seed=8, hot_runs=hot).collect()}
    assert got == brute_shared(texts, 40)


def test_texts_that_share_an_id_are_one_document(spark):
    texts = shared_texts(3)
    df = docs(spark, texts + [(d, t[::-1]) for d, t in texts[:20]] + [(texts[9][0], None)])
    got = {r["doc_id"]: r["shared_chars"] for r in spans.shared_chars(df, span=40, seed=8).collect()}
    want = brute_shared(texts, 40)
    assert all(got[d] == want[d] for d in want if d >= 20)


def test_passages_and_empty_input(spark):
    rng = random.Random(2)
    a, b = ("".join(rng.choice("abcdefghij") for _ in range(n)) for n in (120, 90))
    texts = [(1, a + "0123456789" + b), (2, a + "XY" + b + "zz"), (3, None), (4, "")]
    rows = spans.passages(docs(spark, texts), span=80, piece=32).collect()
    assert {(r["doc_id"], r["other_id"]) for r in rows} == {(1, 2), (2, 1)}
    assert all(r["n_blocks"] == 2 and r["exact_chars"] == 210 and r["from_char"] == 0 and 0.9 < r["identity"] < 1 for r in rows)
    assert spans.shared_chars(docs(spark, texts).limit(0)).count() == 0
    assert spans.passages(docs(spark, texts).limit(0)).count() == 0 and spans.passage_members(docs(spark, texts).limit(0)).count() == 0


def links(spark, df, **options):
    """Pairs of documents that passages link, directly, as members of one class, or as copies."""
    of, out = {}, set()
    for r in spans.passage_members(df, **options).collect():
        of.setdefault(r["class_id"], set()).add(r["doc_id"])
    for r in spans.passages(df, **options).collect():
        out.add((r["doc_id"], r["other_id"]))
        out |= {(x, y) for x in of.get(r["class_id"], ()) for y in of.get(r["other_class"], ())}
    out |= {(x, y) for members in of.values() for x in members for y in members}
    return {(x, y) for x, y in out if x < y}


def test_a_text_edited_every_200_characters_is_linked_with_its_source(spark):
    rng = random.Random(11)
    source = "".join(rng.choice("abcdefghijklmnop ") for _ in range(2000))
    edited = "".join(c if i % 200 else "#" for i, c in enumerate(source))
    df = docs(spark, [(1, "intro " + source), (2, edited + " outro"), (3, "".join(rng.choice("abc") for _ in range(900)))])
    (r,) = spans.passages(df).filter("doc_id = 1").collect()
    assert r["other_id"] == 2 and r["n_blocks"] == 10 and r["exact_chars"] == 1990 and r["identity"] > 0.99
    assert spans.shared_chars(df).count() == 0  # no piece of 240 characters


def test_pieces_that_others_hold_too_still_link_two_documents(spark):
    rng = random.Random(12)
    p1, p2, *rest = ("".join(rng.choice("abcdefghij ") for _ in range(n)) for n in (260, 250, *[400] * 8))
    texts = [(1, rest[0] + p1 + rest[1]), (2, rest[2] + p1 + rest[3]), (3, rest[4] + p2), (4, p2 + rest[5]), (5, rest[6] + p1 + "first edit" + p2), (6, p1 + "2nd" + p2 + rest[7])]
    want = {(a, b) for group in ((1, 2, 5, 6), (3, 4, 5, 6)) for a in group for b in group if a < b}
    assert links(spark, docs(spark, texts)) >= want
    (r,) = spans.passages(docs(spark, texts)).filter("doc_id = 5 and other_id = 6").collect()
    assert r["n_blocks"] == 2 and r["exact_chars"] == 510
    got = {r["doc_id"]: r["shared_chars"] for r in spans.shared_chars(docs(spark, texts)).collect()}
    assert got == {1: 260, 2: 260, 3: 250, 4: 250, 5: 510, 6: 510}


def test_links_against_brute_force(spark):
    """Every two documents with a common piece of ``span`` characters are linked; recall is 1."""
    rng = random.Random(13)
    pool = ["".join(rng.choice("abcdefghij ") for _ in range(rng.randint(60, 140))) for _ in range(25)]
    texts = [(d, "".join(rng.choice([rng.choice(pool), "".join(rng.choice("xyz") for _ in range(30))]) for _ in range(12))) for d in range(60)]
    span, grams = 80, {}
    for d, t in texts:
        for i in range(len(t) - span + 1):
            grams.setdefault(t[i : i + span], set()).add(d)
    want = {(a, b) for members in grams.values() if len(members) > 1 for a in members for b in members if a < b}
    assert want and want <= links(spark, docs(spark, texts), span=span, piece=48, reach=80)


def test_copies(spark):
    assert {(r["doc_id"], r["rep_id"]) for r in spans.copies(docs(spark, [(1, "a"), (7, "bb"), (9, "bb"), (5, "c"), (6, None)])).collect()} == {(1, 1), (5, 5), (7, 7), (9, 7)}


def test_a_hot_class_is_members_not_pairs(spark):
    rng = random.Random(14)
    licence = "".join(rng.choice("abcdefghij ") for _ in range(500))
    texts = [(d, "".join(rng.choice("klmnop ") for _ in range(150)) + licence + "".join(rng.choice("qrstuv ") for _ in range(150))) for d in range(90)]
    df = docs(spark, texts)
    # Windows across an end may choose one of a few seeds there; the classes differ in nothing else.
    members = spans.passage_members(df).collect()
    n = len({r["class_id"] for r in members})
    assert n < 16 and {r["doc_id"] for r in members} == set(range(90)) and spans.passages(df).count() <= n * (n - 1)
    got = {r["doc_id"]: r["shared_chars"] for r in spans.shared_chars(df).collect()}
    assert set(got) == set(range(90)) and all(500 <= n < 510 for n in got.values())


def test_alignment_of_gaps():
    rng = random.Random(7)
    for _ in range(50):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            up = row[:]
            for j, y in enumerate(b):
                row[j + 1] = up[j] + 1 if x == y else max(up[j + 1], row[j])
        assert spans.alike(a, b) == row[-1]


def test_very_long_text_in_parts(spark, monkeypatch):
    monkeypatch.setattr(spans, "SLICE_CHARS", 64)
    rng = random.Random(2)
    t = "".join(rng.choice("abcd") for _ in range(700))
    parts = [s for b in spans._seed_map(40, 8)(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([t])], names=["doc", "text"])])) for s in b.to_pylist()]
    got = sorted({p["pos"] for p in parts})
    monkeypatch.undo()
    whole = [s for b in spans._seed_map(40, 8)(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([t])], names=["doc", "text"])])) for s in b.to_pylist()]
    assert got == sorted({p["pos"] for p in whole})
    assert sum(p["n"] + 1 for p in parts) == sum(p["n"] + 1 for p in whole) == 700 - 40 + 1


def test_chains_are_optimal_and_complete():
    rng = random.Random(5)
    for _ in range(200):
        blocks = spans.blocks_of([(rng.randint(0, 60), rng.randint(0, 60), rng.randint(1, 9)) for _ in range(rng.randint(1, 7))])
        best = 0.0

        def grow(score, last, i=0, blocks=blocks):
            nonlocal best
            best = max(best, score)
            for p, q, k in blocks:
                if last is None or (p >= last[0] and q >= last[1]):
                    grow(score + k - (0.5 * (p + q - last[0] - last[1]) if last else 0), (p + k, q + k))

        grow(0.0, None)
        out = spans.chain(blocks)
        assert abs(out[0][0] - best) < 1e-9
        assert sorted(b for _, path in out for b in path) == sorted(blocks)


# --- set overlaps ----------------------------------------------------------------


def test_overlaps_exact_for_small_sets_and_close_for_sampled(spark):
    rng = np.random.default_rng(0)
    ids = rng.permutation(30_000) + 1
    sets = {"big": ids[:20_000], "half": np.concatenate([ids[:6000], ids[25_000:29_000]]), "tiny": ids[100:160], "none": ids[29_500:29_600]}
    rows = [(f" {n.upper()} ", int(i)) for n, v in sets.items() for i in v] + [("big", int(ids[0])), ("tiny", 0), (None, 5), ("tiny", None)]
    m = overlap.members(spark.createDataFrame(rows, "label_name string, labels bigint"), "label_name", "labels")
    exact = {(a, b): len(set(sets[a]) & set(sets[b])) for a in sets for b in sets if a < b and set(sets[a]) & set(sets[b])}
    got = {(r["name_a"], r["name_b"]): r for r in overlap.overlaps(m, sample=10**6).collect()}
    assert {k: r["shared"] for k, r in got.items()} == exact
    got = {(r["name_a"], r["name_b"]): r for r in overlap.overlaps(m, sample=512, z=4).collect()}
    assert all(r["low"] <= exact[k] <= r["high"] for k, r in got.items())
    assert got["big", "tiny"]["shared"] == 60  # a small set is compared in full
    assert {tuple(r) for r in overlap.heavy_pairs(m, sample=512).collect()} == {("big", "half"), ("big", "tiny"), ("half", "tiny")}
    # Blocks of the sets of one identifier give the same pairs.
    assert {(r["name_a"], r["name_b"]): r["shared"] for r in overlap.overlaps(m, sample=10**6, fan=2).collect()} == exact
    assert overlap.overlaps(m.limit(0)).count() == 0


def test_heavy_pairs_among_sampled_sets(spark):
    """All 40 sets are far larger than the sample; every pair on the right side of one half, and nearly all intervals hold the truth."""
    rng = np.random.default_rng(1)
    sets = {}
    for k in range(20):
        base = rng.choice(200_000, int(rng.integers(1500, 9000)), replace=False) + 1 + 300_000 * (k // 2)
        share = rng.choice([0.1, 0.3, 0.7, 0.9])
        n = int(share * len(base))
        sets[f"a{k}"], sets[f"b{k}"] = base, np.concatenate([base[:n], np.arange(len(base)) + 10**8 + k * 10**5])
    sets["everywhere"] = np.unique(np.concatenate([v[:700] for v in sets.values()]))
    rows = [(n, int(i)) for n, v in sets.items() for i in v]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["name", "id"]))
    truth = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a in sets for b in sets if a < b}
    want = {k for k, n in truth.items() if n >= 0.5 * min(len(sets[k[0]]), len(sets[k[1]]))}
    near = {k for k, n in truth.items() if abs(n / min(len(sets[k[0]]), len(sets[k[1]])) - 0.5) < 0.15}
    assert {tuple(r) for r in overlap.heavy_pairs(df).collect()} - near == want - near and len(want) >= 10
    got = overlap.overlaps(df, z=3).collect()
    assert sum(r["rate"] < 1 for r in got) > 0.9 * len(got)
    held = [r["low"] <= truth[r["name_a"], r["name_b"]] <= r["high"] for r in got]
    assert np.mean(held) > 0.97


# --- splitting --------------------------------------------------------------------


def test_pack_rules():
    got = list(split.pack(100, 40, 4, [split.at_multiples(16)]))
    assert got == [(0, 32), (28, 64), (60, 100)]
    assert list(split.pack(10, 4, 1, [split.at_multiples(50)])) == [(0, 4), (3, 7), (6, 10)]
    assert list(split.pack(5, 5, 9, [])) == [(0, 5)]
    with pytest.raises(ValueError):
        list(split.pack(10, 4, 4, []))


def test_tiles(spark):
    rows = [
        (1, [4, 100], 160, None, [1, 16]), (1, [4, 100], 160, None, [1, 16]), (2, [4, 100], 160, "4", [1, 16]), (3, [100, 100], 5000, "[3, 7]", None), (4, [4, 100], None, "0", None),
        (5, [4, 100], 160, "[1]", None), (6, [4, 100], 160, "-1", None), (7, [4, 100], 160, "auto", None), (8, [4, 100], 400, "0", None), (9, None, 5, "0", None), (10, [4, 100], 160, "true", None), (11, [2, 2, 50], 4, "5", None),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], "manifest_id bigint, tile_shape array<int>, max_voxels bigint, overlap string, chunk_shape array<int>, piece_no int")
    got = {}
    for r in split.split_tiles(df).orderBy("manifest_id", "piece_no").collect():
        got.setdefault(r["manifest_id"], []).append((r["axis"], r["piece_from"], r["piece_to"]))
    assert got[1] == [("x", 0, 32), ("x", 32, 64), ("x", 64, 100)] and got[2] == [("x", 0, 32), ("x", 28, 64), ("x", 60, 100)]
    assert got[3] == [("y", 0, 50), ("y", 47, 97), ("y", 94, 100)] and set(got) == {1, 2, 3}
    assert split.split_tiles(df.limit(0)).count() == 0


def test_texts(spark):
    t = "One sentence. Two words here.\n\nNext paragraph goes on. " + "x" * 90 + " end 😀"
    for limit, lap in ((20, 5), (40, 0), (64, 16)):
        got = split.text_pieces(t, limit, lap)
        assert got[0][0] == 0 and got[-1][1] == len(t) and all(0 < b - a <= limit for a, b in got)
        assert all(p[1] - q[0] == lap and q[1] > p[1] for p, q in zip(got, got[1:]))
    assert split.text_pieces(t, 40, 0)[0] == (0, 31)  # the paragraph
    df = docs(spark, [(1, t), (2, None), (3, ""), (4, "tiny")])
    rows = split.split_texts(df, 40, 4).collect()
    assert {r["doc_id"] for r in rows} == {1, 4} and all(r["piece"] == t[r["piece_from"] : r["piece_to"]] for r in rows if r["doc_id"] == 1)


# --- groups -----------------------------------------------------------------------


def test_groups_equal_union_find(spark):
    rng = random.Random(8)
    pairs = [(rng.randint(1, 120), rng.randint(1, 120)) for _ in range(90)] + [(i + 1, i) for i in range(300, 340)] + [(400, k) for k in range(401, 440)] + [(5, 5), (None, 3), (3, None), (0, 7), (900, 1)]
    known = [*range(1, 500), None, 0]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a and b and a != b and a in known and b in known:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    want = {v: find(v) for v in list(root)}
    p = spark.createDataFrame(pairs + pairs[:5], "lo bigint, hi bigint")
    s = spark.createDataFrame([(k, 1) for k in known], "labels bigint, m int")
    assert {r["labels"]: r["group_id"] for r in components.groups(p, s).collect()} == want
    assert components.groups(p.limit(0), s).count() == 0 and components.groups(p, s.limit(0)).count() == 0


def adaptive_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.files.maxPartitionBytes": "128k",
}


@pytest.fixture
def without_broadcast(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW}
    for k, v in SKEW.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_vertices_and_seeds_are_split(spark, without_broadcast):
    from gridweave.runtime import Materialized, materialize

    hot = spark.range(60_000).selectExpr("IF(id % 3 = 0, 1L, id) AS v", "id * 7919 % 100003 AS u")
    sets = materialize(hot, "test-sets")
    least = materialize(sets.groupBy("v").agg({"u": "min"}).withColumnRenamed("min(u)", "m"), "test-least")
    assert "skew=true" in adaptive_plan(components.messages(sets, least))
    found = Materialized(spark.range(60_000).selectExpr("id AS doc", "IF(id % 3 = 0, 1L, id) AS h", "id * 7919 % 100003 AS pos"), "test-seeds")
    keys = materialize(spark.range(60_000).selectExpr("id AS h"), "test-keys")
    assert "skew=true" in adaptive_plan(found.df.join(keys, "h", "left_semi"))


def test_a_group_with_a_third_of_all_pairs(spark, without_broadcast):
    pairs = spark.range(1, 30_001).selectExpr("IF(id % 3 = 0, 0L, id - id % 5) + 100000 AS lo", "id + 100000 AS hi")
    got = {r["id"]: r["group_id"] for r in components.hash_to_min(pairs).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in pairs.collect():
        if r["lo"] != r["hi"]:
            x, y = find(r["lo"]), find(r["hi"])
            root[max(x, y)] = min(x, y)
    assert got == {v: find(v) for v in list(root)}


def test_sets_stay_small_on_any_order():
    n = 4096
    rng = np.random.default_rng(0)
    ids = np.concatenate([rng.integers(-(2**63), 2**63 - 1, 1000), [0, -1, 2**63 - 1, -(2**63)]])
    assert (components.unmixed(components.mixed(ids)) == ids).all()
    most, unique = [0], np.unique

    def counted(x, *args, **kwargs):
        most[0] = max(most[0], len(x))
        return unique(x, *args, **kwargs)

    components.np.unique = counted
    try:
        for a, b in ((np.arange(n), np.arange(1, n + 1)), (np.zeros(n, int), np.arange(1, n + 1)), (rng.integers(0, n, n), rng.integers(0, n, n))):
            v, u = components.local_rounds(components.mixed(a), components.mixed(b))
            assert len(v) == len(set(v.tolist())) and (u < v).all()
    finally:
        components.np.unique = unique
    assert most[0] < 16 * n
