"""The corpus operators against brute force, and on nulls, ties, repeats, long texts and empty tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import chat, eliasfano, encode, html, kmtree, mixing, mtree, packing, pii, quality, simhash
from tidemark.llm.components import components
from tidemark.llm.queries import ORACLES, QUERIES, vocabulary
from tests.conftest import rows
from tools.check import canonical, compare, connect

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"wort{n % 977}" for n in range(60_000))


def docs_of(spark, texts, schema=SCHEMA):
    made = [(n, text, "en", None if n % 5 == 4 else f"s{n % 3}", len(text or "")) for n, text in enumerate(texts)]
    return spark.createDataFrame(made, schema)


ODD_TEXTS = [None, "", "   ", "one", "one", "a b c d e f g", "a b c d e f g", LONG, "tab\tsep  double \n x ", "mail a@b.co 1.2.3.4", "é ñ 日本 😀"]


@pytest.fixture(scope="module")
def odd(spark):
    more = docs_of(spark, ODD_TEXTS)
    nameless = spark.createDataFrame([(None, "no number here", None, None, 1)], SCHEMA)
    frame = more.unionByName(nameless).unionByName(more.where("doc_id = 5"))
    return frame.withColumn("group", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("key", F.lit(2))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# --- mixing

def water_fill(sizes, weights, share, limit):
    total = share * sum(sizes.values())
    target, open_ = {}, set(sizes)
    while open_:
        level = (total - sum(target.values())) / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * level > limit * sizes[s]}
        if not over:
            target |= {s: weights[s] * level for s in open_}
            break
        target |= {s: limit * sizes[s] for s in over}
        open_ -= over
    return target


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(1)
    texts = ["w " * int(rng.integers(0, 60)) for _ in range(400)]
    frame = docs_of(spark, texts)
    found = mixing.mix(frame).toPandas()
    assert len(found) == 400
    sizes = {n: g["size"].sum() for n, g in found.groupby(found["source"].fillna("~"))}
    weights = dict(zip(sorted(sizes), (5.0, 2.0, 1.0, 5.0)))
    want = water_fill(sizes, weights, 1.5, 2)
    for name, group in found.groupby(found["source"].fillna("~")):
        assert group["source_size"].iloc[0] == sizes[name]
        assert abs(group["target"].iloc[0] - want[name]) < 1e-6 * max(1, want[name])
        assert abs(group["taken"].sum() - want[name]) <= 5
        tilted = group[(group["size"] > 0) & (group["rate"] < 2)]
        if len(tilted) > 1:  # one exponent for the source
            tilt = np.log(tilted["rate"]) / tilted["size"]
            assert np.ptp(tilt) < 1e-9
    assert (found["taken"] <= 2 * found["size"]).all() and (found["taken"] == found["copies"] * found["size"]).all()
    again = mixing.mix(frame).toPandas()
    assert canonical(found) == canonical(again)


def test_mix_odd_rows(spark, odd, nothing):
    found = mixing.mix(odd)
    assert found.count() == odd.count()
    assert {r["size"] for r in found.where("doc_id in (0, 1, 2)").collect()} == {0}
    assert mixing.mix(nothing).count() == 0
    assert mixing.mix(docs_of(spark, ["", None])).count() == 2
    wide = mixing.mix(odd, narrow=False)
    assert set(odd.columns) - {"n"} <= set(wide.columns) and wide.count() == odd.count()


# --- tokens

@pytest.mark.parametrize("name, end", [("byte_bpe_50k.json", 2), ("word_bpe_49k.json", 0)])
def test_encoder_equals_library(name, end):
    import pyarrow as pa

    from tokenizers import Tokenizer

    encoder, library = encode.Encoder.of(vocabulary(name)), Tokenizer.from_file(vocabulary(name))
    texts = ["<|startoftext|>x<|endoftext|>", "a <|ENDOFTEXT|>", "<|endoftext|>", "  a  b", "a\t b", "", "x ", "a\n\n b", "foo's  bar,'s don't 12ab…¿ que?", "<|endoftext|> a", "日本 語  a", "a\xa0 b  　c",
             None, "é̂, é, ﬁ ǅ İx Σας ΣΑΣ ", "A,b.c|d  a,", "a\rc", *ODD_TEXTS]
    ids, where = encoder.batch(pa.array(texts), end)
    for n, text in enumerate(texts):
        want = [*library.encode(text or "", add_special_tokens=False).ids, end]
        assert ids[where[n]:where[n + 1]].tolist() == want, text


def test_encoder_memory_turns_over(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(encode, "KEPT", 4_000)
    encoder = encode.Encoder(vocabulary("byte_bpe_50k.json"))
    texts = [" ".join(f"w{n % k}x{n}," for n in range(200)) for k in (3, 7, 3)]
    for text in texts:
        ids, _ = encoder.batch(pa.array([text, text]), 2)
        want = [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert ids.tolist() == want * 2
    assert encoder.spaced.held <= 4_000 and encoder.parts.held <= 4_000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5_000), min_size=1, max_size=700))
def test_boundaries_round_trip(sizes):
    ends = np.cumsum(sizes)
    coded = eliasfano.Boundaries.of(ends)
    assert coded.all().tolist() == ends.tolist()
    for i in {0, len(ends) // 2, len(ends) - 1}:
        assert coded.select(i) == ends[i]
    assert coded.highs.nbytes + coded.lows.nbytes <= len(ends) * (2 + np.log2(max(2, ends[-1] / len(ends)))) / 8 + 16


def test_token_files(spark, odd, nothing, tmp_path):
    eliasfano.write_tokens(odd, str(tmp_path / "t"), vocabulary("byte_bpe_50k.json"), 2)
    found = rows(eliasfano.read_tokens(spark, str(tmp_path / "t")), "start")
    tokenizer = encode.Encoder.of(vocabulary("byte_bpe_50k.json")).tokenizer
    want = sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for got, (doc_id, text) in zip(found, want, strict=True):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got["doc_id"], got["start"], got["n_tokens"], got["ids_crc32"]) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    payload = spark.read.parquet(str(tmp_path / "t")).first()["payload"]
    segment = eliasfano.Segment(payload)
    assert segment.document(segment.n - 1)[-1] == 2
    eliasfano.write_tokens(nothing, str(tmp_path / "e"), vocabulary("byte_bpe_50k.json"), 2)
    assert eliasfano.read_tokens(spark, str(tmp_path / "e")).count() == 0


# --- packing

def test_vector_best_fit_respects_all_capacities():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 400, 3_000)
    for rule in ("norm", "dot"):
        for room in (packing.Capacities(512, 512, 512 * 512, rule=rule), packing.Capacities(512, 3, 90_000, (1, 1, 1), rule)):
            bins, offsets, n = packing.vector_best_fit(lengths, room)
            for b in range(n):
                mine = np.flatnonzero(bins == b)
                assert lengths[mine].sum() <= room.tokens and len(mine) <= room.pieces
                assert np.square(lengths[mine]).sum() <= room.attention or len(mine) == 1
                order = mine[np.argsort(offsets[mine])]
                assert (np.cumsum(lengths[order]) - lengths[order] == offsets[order]).all()
    bins, _, n = packing.vector_best_fit(lengths, packing.Capacities(512, 512, 512 * 512))
    assert n <= np.ceil(lengths.sum() / 512) * 1.02 + 1


def test_place_pieces(spark, odd, nothing):
    pieces = packing.pieces_of(odd, vocabulary("word_bpe_49k.json"), 0)
    found = packing.place(pieces).toPandas()
    assert len(found) == pieces.count()
    for _, group in found.sort_values("offset").groupby("sequence_id"):
        assert group["length"].sum() <= 2048 and (group["length"].cumsum() - group["length"] == group["offset"]).all()
    longest = found[found["doc_id"] == 7].sort_values("piece")
    assert (longest["length"].iloc[:-1] == 2048).all() and longest["piece"].tolist() == list(range(len(longest)))
    assert found.loc[found["doc_id"] == 0, "length"].tolist() == [1]
    assert packing.place(packing.pieces_of(nothing, vocabulary("word_bpe_49k.json"), 0)).count() == 0


# --- personal data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def good(kind, match):
        digits = [int(c) for c in match if c.isdigit() and c.isascii()]
        if kind == "ip":
            return all(int(part) <= 255 for part in match.split("."))
        if kind == "card":
            odd = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
            return 16 <= len(digits) <= 19 and (sum(digits[::-2]) + sum(odd)) % 10 == 0
        return kind != "phone" or 8 <= len(digits) <= 15

    return ",".join(f"{kind}:{m.start()}:{m.end()}" for kind in PLAIN for m in re.finditer(PLAIN[kind], text or "") if good(kind, m[0]))


def test_base_spans_equal_plain_patterns(spark, odd, nothing):
    rng = np.random.default_rng(3)
    letters = list("ab.@+-() 0123456789%é😀")
    texts = ["".join(rng.choice(letters, 120)) for _ in range(400)] + [
        "a@b.c+d@e.f @x a@b.c.d@e.f..g", "😀 1.2.3.4.5.6.7.8 256.1.1.1 007.0.0.1 0000300.1.1.1",
        "4465758382889437 4465-7583 8288 9437 44657583828894370", "+1 (743) 555-3824 +1(((( ++49 30 1234567", "9" * 30_000, "a." * 30_000]
    for frame in (docs_of(spark, texts), odd):
        found = {(r["doc_id"], r["base_sha256"]) for r in pii.report(pii.find(frame)).collect()}
        assert found == {(r["doc_id"], hashlib.sha256(plain_spans(r["text"]).encode()).hexdigest()) for r in frame.collect()}
    assert pii.report(pii.find(nothing)).count() == 0


def test_disclosing_terms(spark):
    made = [f"{'abc'[i % 3]}x{i} {['foo', 'bar', 'baz', 'qux'][i % 4]} zz{i % 5} Project-Falcon mail joe@corp.example.com the w{i}" for i in range(12)]
    made += [f"the foo bar baz qux mail {i} zz{i % 5} other" for i in range(60)]
    frame = docs_of(spark, made)
    kept = rows(pii.sanitise(pii.find(frame)), "doc_id")
    assert kept[0]["text"] == "ax0 foo zz0 [term] mail [email] the w0" and kept[20]["text"] == made[20]
    copies = docs_of(spark, [made[0]] * 30 + made[12:])  # one passage is one piece of evidence
    assert "term" not in {s.split(":")[0] for r in pii.report(pii.find(copies)).collect() for s in r["spans"].split(",")}
    everywhere = docs_of(spark, [f"x{i} secret-word a@b.co the y{i}" for i in range(5)])  # no information in the value
    assert all("term" not in r["spans"] for r in pii.report(pii.find(everywhere)).collect())


def test_terms_disclose_from_anywhere_in_two_texts(spark):
    far = " the foo bar baz" * 12
    made = [f"a{n} Project-Falcon{far} mail joe@corp.example.com the w{n}" for n in range(2)]
    made += [f"the foo bar baz mail x{n} other" for n in range(200)]
    made += [f"b{n} Alone-Word the mail only@once.example.com foo" for n in range(1)] * 2  # one text: no evidence
    kept = rows(pii.sanitise(pii.find(docs_of(spark, made))), "doc_id")
    assert [r["text"] for r in kept[:2]] == [f"a{n} [term]{far} mail [email] the w{n}" for n in range(2)]
    assert [r["text"] for r in kept[2:202]] == made[2:202]
    assert {r["text"] for r in kept[202:]} == {"b0 Alone-Word the mail [email] foo"}


# --- vectors

def vectors_of(spark, values):
    return spark.createDataFrame(values, "vec_id long, embedding array<float>, label int")


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 8))
    made = [(n, (centers[n % 12] + rng.normal(size=8) * 0.3).tolist(), 1) for n in range(1_500)]
    made += [(2_000 + n, made[0][1], 1) for n in range(400)]  # a common vector
    return made


@pytest.fixture(scope="module")
def broken():
    return [(3_000, None, 1), (3_050, [], 1), (3_100, [None] * 8, 1), (3_150, [float("nan")] * 8, 1), (3_200, [float("inf")] * 8, 1), (None, [1.0] * 8, 1)]


def test_mtree_is_exact(spark, cloud, broken, monkeypatch):
    monkeypatch.setattr(mtree, "TREE", 300)
    found = rows(mtree.top_k(vectors_of(spark, cloud + broken)), "query_id", "rank")
    ids = np.array([row[0] for row in cloud])
    values = np.floor(256 * np.array([row[1] for row in cloud], np.float32).astype(float)).astype(int)
    want = []
    for at in np.flatnonzero(ids % 50 == 0):
        scores = values @ values[at]
        order = [n for n in np.lexsort((ids, -scores)) if n != at][:5]
        want += [{"query_id": ids[at], "rank": r + 1, "vec_id": ids[n], "score": scores[n]} for r, n in enumerate(order)]
    assert found == sorted(want, key=lambda r: (r["query_id"], r["rank"]))
    assert mtree.top_k(vectors_of(spark, broken)).count() == 0
    few = [(0, [1.0, 0.0], 1), (50, [0.0, 1.0], 1), (7, [1.0, 0.0], 1), (8, [1.0], 1)]
    assert [(r["query_id"], r["vec_id"]) for r in rows(mtree.top_k(vectors_of(spark, few)), "query_id", "rank")] == [(0, 7), (0, 50), (50, 0), (50, 7)]


@pytest.fixture(scope="module")
def mixed():
    """Two lengths, and vec_ids that repeat with another vector, another length, and exactly."""
    rng = np.random.default_rng(12)
    made = [(n, rng.normal(size=4).tolist(), 1) for n in range(1, 300)] + [(10_000 + n, rng.normal(size=6).tolist(), 1) for n in range(200)]
    made += [(50, rng.normal(size=2).tolist(), 1), (50, rng.normal(size=3).tolist(), 1), (7, [1.0, 2.0], 1), (8, [2.0, 1.0], 1), (9, [0.5, 3.0], 1)]
    return made + [(100, rng.normal(size=4).tolist(), 1), (200, made[199][1], 1), (10_000, rng.normal(size=6).tolist(), 1)] + [made[20]] * 3


def plain_search(rows_, every, k, score, down):
    """Per vec_id its shortest, then smallest vector asks all other vec_ids' rows of its length."""
    asked = {}
    for name, vector, _ in rows_:
        if name % every == 0:
            asked[name] = min(asked.get(name, (99, [])), (len(vector), vector)) if name in asked else (len(vector), vector)
    out = []
    for name, (dims, vector) in asked.items():
        found = sorted((-score(vector, other) if down else score(vector, other), n) for n, other, _ in rows_ if n != name and len(other) == dims)
        out += [(name, rank, n, -s if down else s) for rank, (s, n) in enumerate(found[:k], 1)]
    return sorted(out)


def test_mtree_with_lengths_and_repeats(spark, mixed, monkeypatch):
    monkeypatch.setattr(mtree, "TREE", 40)
    exact = [(n, np.array(v, np.float32).astype(float).tolist(), 1) for n, v, _ in mixed]
    whole = [(n, np.floor(256 * np.array(v)).tolist(), 1) for n, v, _ in exact]
    found = sorted(tuple(r) for r in mtree.top_k(vectors_of(spark, mixed)).collect())
    assert found == plain_search(whole, 50, 5, lambda a, b: int(np.dot(a, b)), True)
    assert len([r for r in found if r[0] == 50]) == 3


def test_kmeans_tree_with_lengths_and_repeats(spark, mixed, monkeypatch):
    monkeypatch.setattr(kmtree, "LEAF_ROWS", 30)
    exact = [(n, np.array(v, np.float32).astype(float).tolist(), 1) for n, v, _ in mixed]
    want = plain_search(exact, 50, 5, lambda a, b: float(np.sqrt(np.square(np.array(b) - np.array(a)).sum())), False)
    found = sorted(tuple(r) for r in kmtree.nearest(vectors_of(spark, mixed), k=5, every=50).collect())
    assert len(found) == len(want) and {r[0] for r in found} == {r[0] for r in want}
    assert len({(r[0], r[2]) for r in found} & {(r[0], r[2]) for r in want}) >= 0.9 * len(want)


def test_kmeans_tree_leaves_leaves_out(spark, monkeypatch):
    monkeypatch.setattr(kmtree, "LEAF_ROWS", 20)
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(40, 6)) * 30
    made = [(n, (centers[n % 40] + rng.normal(size=6)).tolist(), 1) for n in range(2_000)]
    seen = []
    real = kmtree.calibrate
    monkeypatch.setattr(kmtree, "calibrate", lambda tree, *rest: seen.append((real(tree, *rest), tree.leaves)) or seen[-1][0])
    found = {(r[0], r[2]) for r in kmtree.nearest(vectors_of(spark, made)).collect()}
    values = np.array([row[1] for row in made], np.float32).astype(float)
    true = {(q, int(n)) for q in range(0, 2_000, 100)
            for n in [n for n in np.argsort(np.square(values - values[q]).sum(1), kind="stable") if n != q][:10]}
    assert seen[0][0] * 4 <= seen[0][1] and len(found & true) >= 0.9 * len(true)


def test_mtree_leaves_distances_out():
    rng = np.random.default_rng(5)
    values = np.vstack([rng.normal(size=(500, 4)) + shift for shift in (0, 40, -40, 80)]).round(1) * 256
    tree = mtree.Tree.load(mtree.Tree(np.arange(2_000), np.floor(values)).dump())
    far = tree.root["values"][0] * 0
    assert tree.bound(far, 0.0) >= 0
    seen = Counter()
    real = np.rint
    try:
        np.rint = lambda x: (seen.update(n=len(x)), real(x))[1]
        tree.search(np.floor(values[1_700]), 5, -1, -np.inf)
    finally:
        np.rint = real
    assert 0 < seen["n"] < 1_000


def test_kmeans_tree_recall(spark, cloud, broken):
    zero = [(4_000, [0.0] * 8, 1)]
    found = kmtree.nearest(vectors_of(spark, cloud + broken + zero)).toPandas()
    ids = np.array([row[0] for row in cloud])
    values = np.array([row[1] for row in cloud], np.float32).astype(float)
    hit = total = 0
    for at in np.flatnonzero(ids % 100 == 0):
        apart = np.sqrt(np.square(values - values[at]).sum(1))
        order = [n for n in np.lexsort((ids, apart)) if n != at][:10]
        mine = found[found["query_id"] == ids[at]].sort_values("rank")
        place = {i: n for n, i in enumerate(ids)}
        assert np.allclose(mine["score"], apart[[place[i] for i in mine["vec_id"]]], atol=0, rtol=1e-15)
        assert list(zip(mine["score"], mine["vec_id"])) == sorted(zip(mine["score"], mine["vec_id"])) and len(mine) == 10
        hit, total = hit + len(set(mine["vec_id"]) & set(ids[order])), total + 10
    assert hit >= 0.9 * total
    assert kmtree.nearest(vectors_of(spark, broken + zero)).count() == 0
    few = [(0, [1.0, 0.0], 1), (3, [0.0, 1.0], 1)]
    assert rows(kmtree.nearest(vectors_of(spark, few))) == [{"query_id": 0, "rank": 1, "vec_id": 3, "score": 2 ** 0.5}]


def test_kmeans_tree_sends_the_driver_its_sample_only(spark, monkeypatch):
    rng = np.random.default_rng(21)
    values = rng.normal(size=(4_000, 64)).astype(np.float32)
    frame = vectors_of(spark, [(n, row.tolist(), 1) for n, row in enumerate(values)]).repartition(16, "vec_id")
    settings = {"spark.sql.files.openCostInBytes": "128k", "spark.sql.files.maxPartitionBytes": "256k"}  # many tasks
    monkeypatch.setattr(kmtree, "SAMPLE", 500)
    monkeypatch.setattr(kmtree, "LEAF_ROWS", 40)
    monkeypatch.setattr(kmtree, "GROUP_ROWS", 300)
    monkeypatch.setattr(kmtree, "GROUPS", 1_000)
    monkeypatch.setattr(kmtree, "calibrate", lambda tree, *rest: tree.leaves)  # every query asks every leaf
    old = {key: spark.conf.get(key) for key in settings}
    listed = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(
        None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jvm.java.util.ArrayList())
    before = max([listed().apply(n).stageId() for n in range(listed().size())], default=-1)
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        found = kmtree.nearest(frame)
        got = sorted(tuple(row) for row in found.collect())
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    stages = [stage for n in range(listed().size()) if (stage := listed().apply(n)).stageId() > before]
    assert len(stages) > 5 and max(stage.resultSize() for stage in stages) < 1.5 * 500 * 64 * 8
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    doubles = [(n, row.astype(float).tolist(), 1) for n, row in enumerate(values)]
    want = plain_search(doubles, 100, 10, lambda a, b: float(np.sqrt(np.square(np.array(b) - np.array(a)).sum())), False)
    assert got == want


def test_kmeans_tree_measures_the_nearest_exactly():
    rng = np.random.default_rng(6)
    for scale in (1.0, 1e-170, 1e160):  # squares that vanish and that overflow
        values = rng.integers(-3, 4, (3_000, 5)) * scale  # many ties
        ids = rng.permutation(3_000)
        ids[:40] = 7
        names = np.array([7, *ids[100:130]])
        asked = np.vstack([values[:1], values[100:130]])
        near = kmtree.Candidates(ids, values)
        spans = [(0, 500, np.arange(31)), (500, 505, np.arange(0, 31, 2)), (900, 3_000, np.arange(1, 31))]
        seen = np.concatenate([near.nearest(names[a:a + 9], asked[a:a + 9], 10, [
            (first, last, np.flatnonzero(np.isin(np.arange(a, min(a + 9, 31)), who))) for first, last, who in spans]).to_pandas() for a in range(0, 31, 9)])
        with np.errstate(over="ignore"):
            want = [(names[n], ids[row], score) for n in range(31) for score, _, row in sorted(
                (np.sqrt(np.square(values[row] - asked[n]).sum()), ids[row], row)
                for a, b, who in spans if n in who for row in range(a, b) if ids[row] != names[n])[:10]]
        assert sorted(map(tuple, seen)) == sorted(want)


def test_kmeans_tree_groups_hold_every_leaf():
    groups = kmtree.Groups([2, 0, 1, 4, 3], {0: 40, 1: 250, 2: 50, 3: 100}, 100)
    assert [leaves.tolist() for leaves in groups.leaves] == [[1], [1], [1], [2, 0, 4], [3]]
    assert groups.first.tolist() == [3, 0, 3, 4, 3] and groups.lots.tolist() == [1, 3, 1, 1, 1]


def test_kmeans_tree_combines_a_tasks_answers(monkeypatch):
    rng = np.random.default_rng(9)
    parts = [kmtree.rows_out([(np.full(5, q), rng.integers(0, 90, 5), rng.integers(0, 9, 5) / 4)]) for q in rng.integers(0, 6, 80)]
    every = [row for part in parts for row in part.to_pylist()]
    order = lambda r: (r["query_id"], r["score"], r["vec_id"])
    want = [r for q in range(6) for r in sorted((r for r in every if r["query_id"] == q), key=order)[:7]]
    for held in (10, 90, 10_000):  # handed on early, cut now and then, cut at the end
        monkeypatch.setattr(kmtree, "HELD", held)
        out = [row for part in kmtree.combined(iter(parts), 7) for row in part.to_pylist()]
        assert [r for q in range(6) for r in sorted((r for r in out if r["query_id"] == q), key=order)[:7]] == want
        assert held < 10_000 or sorted(out, key=order) == want
    assert list(kmtree.combined(iter([]), 7)) == []


# --- copies

def plain_print(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(run, 42) for run in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def roots_of(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("chunk", [8_192, 20])
def test_simhash_components(spark, odd, chunk, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "LOOKED_AT", 1)
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 40)
    prints = [int(base[n % 40]) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for n in range(600)]
    prints = sorted({simhash.signed(p) for p in prints})
    edges = simhash.linked_prints(spark.createDataFrame([(p,) for p in prints], "print long"), 4)
    found = {r["node"]: r["root"] for r in components(edges).collect()}
    links = [(i, j) for i in range(len(prints)) for j in range(i) if ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= 4]
    for at, root in enumerate(roots_of(len(prints), links)):
        assert found.get(prints[at], prints[at]) == prints[root]


def test_near_duplicates_of_odd_rows(spark, odd, nothing):
    found = simhash.near_duplicates(odd)
    got = {(r["doc_id"], r["fingerprint"]) for r in found.collect()}
    assert got == {(r["doc_id"], f"{plain_print(r['text'], 4):016x}") for r in odd.collect()}
    ids = {r["doc_id"]: r["component_id"] for r in found.collect()}
    assert ids[0] == ids[1] == ids[2] == 0 and ids[4] == 3 and ids[6] == 5 and found.count() == odd.count()
    assert simhash.near_duplicates(nothing).count() == 0


def test_planes_equal_counted_bits():
    rng = np.random.default_rng(7)
    prints = np.concatenate([rng.integers(0, 2**63, 90), rng.integers(0, 4, 200)]).astype(np.uint64)
    sizes = np.array([90, 130, 70])
    for radius in (0, 4, 20):
        found = {(int(a), int(b)) for x, y in simhash.Planes(prints, sizes).near(radius) for a, b in zip(x, y)}
        group = np.repeat([0, 1, 2], sizes)
        want = {(i, j) for i in range(290) for j in range(i + 1, 290) if group[i] == group[j] and int(prints[i] ^ prints[j]).bit_count() <= radius}
        assert found == want


def test_keep_one_of_each_group(spark, odd, nothing):
    rng = np.random.default_rng(8)
    texts = []
    for group in range(12):
        words = [f"g{group}w{n}" for n in rng.permutation(150)]
        for copy in range(4):
            mine = list(words)
            for at in rng.choice(150, copy % 3, replace=False):
                mine[at] = f"new{group}{copy}{at}"
            texts.append(" ".join(mine))
    texts += [f"clean text number {n} " + " ".join(f"u{n}v{k}" for k in range(40)) for n in range(30)]
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    kept = sorted(r["doc_id"] for r in simhash.keep_one(docs_of(spark, texts)).collect())
    assert kept == sorted(set(roots_of(len(texts), links)))
    left = simhash.keep_one(odd)
    assert left.columns == odd.columns and sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None) == [0, 3, 5, 7, 8, 9, 10]
    assert left.where("doc_id is null").count() == 1 and simhash.keep_one(nothing).count() == 0


def test_keep_one_counts_repeated_lines_once(spark):
    texts, line = [], " ".join(f"again{n}" for n in range(12))
    for group in range(12):
        words = " ".join(f"r{group}w{n}" for n in range(300))
        texts += [f"{words} {line}", f"{words} " + " ".join([line] * 40)]
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs_of(spark, texts)).collect()) == list(range(0, 24, 2))


def test_keep_one_joins_beyond_the_radius(spark, monkeypatch):
    monkeypatch.setattr(simhash, "COPY_RADIUS", 0)
    texts = [" ".join(f"g{group}w{n}" for n in range(first, first + 400)) for group in range(8) for first in (0, 10, 20)]
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs_of(spark, texts)).collect()) == list(range(0, 24, 3))


def test_keep_one_decides_on_whole_sets(spark):
    texts = []
    for size in (600, 1_500, 5_000):
        for group in range(10):
            words = [f"s{size}g{group}w{n}" for n in range(size + 4)]
            # shared / (2 size - shared) is 0.8 at shared = 8 / 9 size: just below it, or at it
            shared = -(-8 * size // 9) - 4 * (group % 2)
            texts += [" ".join(words), " ".join(words[:shared + 4] + [f"s{size}g{group}o{n}" for n in range(size - shared)])]
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    ratios = [len(sets[n] & sets[n + 1]) / len(sets[n] | sets[n + 1]) for n in range(0, len(texts), 2)]
    assert 0.78 < min(ratios) < 0.8 <= max(ratios) < 0.81
    linked = [n for n in range(0, len(texts), 2) if set(sorted(sets[n])[:4]) & set(sorted(sets[n + 1])[:4])]
    want = sorted({n for n in range(len(texts))} - {n + 1 for n in linked if ratios[n // 2] >= 0.8})
    assert len(linked) >= len(ratios) - 1 and sorted(r["doc_id"] for r in simhash.keep_one(docs_of(spark, texts)).collect()) == want


def test_components_settle(spark):
    chain = [(n, n + 1) for n in range(50)] + [(100, n) for n in range(101, 160)] + [(7, 7)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(found[n] == 0 for n in range(51)) and all(found[n] == 100 for n in range(100, 160))


# --- quality

def labelled(spark, n=600):
    rng = np.random.default_rng(9)
    made, labels = [], []
    for i in range(n):
        words = [f"w{rng.integers(0, 300)}" for _ in range(60)]
        junk, toxic = i % 7 == 0, i % 5 == 1
        if junk:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            words[10], words[30] = "scoundrel", "knave"
        made.append((i, " ".join(words), "en", f"s{i % 4}", 1))
        labels.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(made, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark, odd, nothing):
    docs, labels = labelled(spark)
    found = quality.classify(docs, labels.where("doc_id < 400")).join(labels, "doc_id").where("doc_id >= 400")
    right = found.select(F.avg((F.col("keep") == ((F.col("quality") == 1) & (F.col("toxic") == 0))).cast("double"))).first()[0]
    assert right > 0.98
    all_ = quality.classify(odd, labels)
    assert all_.count() == odd.count() and all_.where("probability is null").count() == 0
    assert quality.classify(nothing, labels).count() == 0
    none = labels.where("false")
    assert quality.classify(odd, none).select(F.round("probability", 9)).distinct().count() == 1
    narrow = quality.classify(odd, labels, whole=False)
    assert "text" not in narrow.columns and narrow.count() == odd.count()


def test_sites_leave_the_document_out(spark):
    docs, labels = labelled(spark)
    lone = spark.createDataFrame([(9_000, "w1 w2 w3 w4", "fr", "alone", 1), (9_001, "W1!! W2!! W3!! W4!!", None, None, 1)], SCHEMA)
    docs = docs.unionByName(lone)
    base = quality.fit(docs, labels).base
    found = quality.classify(docs, labels).toPandas()
    p = 1 / (1 + np.exp(-(found["evidence"].to_numpy() + base)))
    host, path = found["source"].fillna("~").to_numpy(), (found["source"].fillna("~") + "/" + found["lang"].fillna("~")).to_numpy()

    def by(keys):
        return {key: p[keys == key] for key in set(keys)}

    hosts, paths = by(host), by(path)
    mean = p.mean()
    spread = sum(len(v) * v.mean() ** 2 for v in hosts.values()) / len(p) - mean ** 2
    noise = sum(v.var() for v in hosts.values()) / len(p)
    k = min(1e6, max(1.0, mean * (1 - mean) / max(spread - noise, 1e-9) - 1))
    shrunk = {h: (v.sum() + k * mean) / (len(v) + k) for h, v in hosts.items()}
    between = max(0.0, sum(len(v) * ((v.mean() - shrunk[q.split("/")[0]]) ** 2 - v.var() / len(v)) for q, v in paths.items()) / len(p))
    for n in range(len(found)):
        h, q = hosts[host[n]], paths[path[n]]
        of_host = (h.sum() - p[n] + k * mean) / (len(h) - 1 + k)
        k_path = min(1e6, max(1.0, of_host * (1 - of_host) / max(between, 1e-9) - 1))
        of_path = (q.sum() - p[n] + k_path * of_host) / (len(q) - 1 + k_path)
        inside = min(0.999, max(0.001, of_path))
        whole = 1 / (1 + np.exp(-(found["evidence"][n] + np.log(inside / (1 - inside)))))
        assert np.allclose([found["host_posterior"][n], found["path_posterior"][n], found["probability"][n]], [of_host, of_path, whole], rtol=1e-6)
    alone = found[found["doc_id"] == 9_000].iloc[0]
    assert abs(alone["host_posterior"] - mean) < 1e-9  # nothing but the corpus speaks for a site of one document


# --- chat and pages

@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<|\\im_startend> a\n", max_size=40))
def test_escape_round_trip(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text and "<|" not in out


def test_chat_states_and_digests(spark):
    made = [(1, 0, "system", "s"), (1, 1, "user", "<|im_end|>"), (1, 2, "assistant", "yes <\\|x"), (2, 1, "assistant", "b"), (2, 0, "user", None),
            (3, 0, "assistant", "first"), (3, 1, "user", "u"), (4, None, "user", "x"), (4, None, "user", "x"), (None, 0, "user", "q"), (5, 0, None, None)]
    frame = spark.createDataFrame(made, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1))
    found = {r["conv_id"]: r for r in chat.read_back(chat.segments(frame)).collect()}
    assert {k for k, r in found.items() if r["valid"]} == {1, 2, None}
    assert found[1]["turns_sha256"] == hashlib.sha256("system\ns\nuser\n<|im_end|>\nassistant\nyes <\\|x\n".encode()).hexdigest()
    assert found[1]["loss_sha256"] == hashlib.sha256(b"yes <\\|x").hexdigest() and found[1]["loss_chars"] == 8
    assert found[2]["loss_chars"] == 1 and found[5]["n_turns"] == 1 and found[4]["n_turns"] == 2
    assert chat.read_back(chat.segments(frame.where("false"))).count() == 0


PAGES = [
    ("<html><head><title>t</title></head><body><nav><a href='/'>Home</a></nav><article><header><h1>A &amp; B</h1><p>by me</p></header><p>One <b>two</b>"
     "<br>three<p>Four<div class='comments'><p>nice!</p></div></article><aside>more</aside><footer>foot</footer>", "A & B One two three Four"),
    ("<body><div id='cookie-notice'>We use cookies</div><div><p>" + "This is the text of the page and it is long enough for the rules to see. " * 4
     + "</p><p>Short one.</p><p>" + "And this is the end of the text, which is as long as it was in the first block. " * 3
     + "</p></div><ul><li><a href=x>link one</a></li><li><a href=y>link two</a></li></ul><script>var a = '<p>no</p>';</script>", None),
    ("", ""), (None, ""), ("<p", ""), ("<article>&#8364; &lt;b&gt; &nosuch; x</article>", "€ <b> &nosuch; x"),
    ("<article><form>f</form><style>p{}</style><p title='a>b'>kept</p><p title=\"open>also</p></article>", "kept also"),
]


def test_page_text(spark):
    for page, want in PAGES:
        if want is not None:
            assert html.main_text(page) == want
    text = html.main_text(PAGES[1][0])
    assert text.startswith("This is the text") and "Short one." in text and text.endswith("first block.") and "cookies" not in text and "link" not in text
    assert len(html.main_text("<article>" + "<div><p>word</p>" * 20_000)) == 20_000 * 5 - 1
    frame = spark.createDataFrame([(n, f"u{n}", page, 1) for n, (page, _) in enumerate(PAGES)], "page_id long, url string, html string, text int")
    assert html.extract(frame).count() == len(PAGES) and html.extract(frame.where("false")).count() == 0


PROSE = "This is the text of the page and it is long enough for the rules to see. " * 4
OTHER = "And that was the end of it, as they have said to all of us in the morning. " * 2


@pytest.mark.parametrize("page, want", [
    # cards and comments in article elements beside a main text in a div
    (f"<div><p>{PROSE}</p><p>Short one.</p><p>{PROSE}</p></div><article class='card'><h3><a href=x>Next story</a></h3></article>"
     "<article><a href=y>Another story of the day</a></article>", f"{PROSE}Short one. {PROSE}"),
    (f"<div><p>{PROSE}</p></div><article class='comment-body'><p>{OTHER}</p></article>", PROSE),
    # links inside an article, and its short blocks up to the end
    (f"<nav>Home</nav><article><h1><a href=z>Title</a></h1><p>{PROSE}</p><ul><li><a href=x>link one</a></li><li><a href=y>link two</a></li></ul>"
     "<p>Tail.</p><p>End.</p></article><footer>foot</footer>", f"Title {PROSE}Tail. End."),
    # the article with the most text, of several
    (f"<article><p>{PROSE}</p><p>{PROSE}</p></article><article><p>Small teaser.</p></article>", PROSE * 2),
    (f"<main><div><p>{PROSE}</p></div></main><div>All rights are with us.</div>", PROSE),
    # names that only hold a part of a notice's, and pairs that are a notice's
    (f"<div class='content-with-sidebar'><p class='share-price'>{PROSE}</p></div><div class='site-footer'><p>{PROSE}</p></div>", PROSE),
    (f"<div><p>{PROSE}</p><ul><li><a href=x>link one</a></li></ul></div>", PROSE),
])
def test_blocks_are_scored(page, want):
    assert html.main_text(page) == want.strip()


@pytest.mark.parametrize("page, want", [
    ("<div><p>Der Laden ist zu.</p></div>", "Der Laden ist zu."),
    ("<h2>Titel</h2><div><p>" + "xylo qwer " * 40 + "</p></div>", "Titel " + ("xylo qwer " * 40).strip()),
    ("<nav><a href=x>Start</a></nav><div><p>Krótki tekst.</p><p><a href=y>więcej</a></p></div><footer>stopka</footer>", "Krótki tekst."),
    ("<h1>Nadpis</h1><main><p>" + "slovo dlouho " * 30 + "</p></main><aside>bokem</aside>", "Nadpis " + ("slovo dlouho " * 30).strip()),
    ("<footer>only this</footer>", ""),
])
def test_pages_without_good_blocks_are_kept(page, want):
    assert html.main_text(page) in (want, want.removeprefix("Nadpis "))


def test_repeated_pages_stay(spark):
    made = spark.createDataFrame([(1, "u", "<p>Ein Satz.</p>")] * 3 + [(None, None, None)], "page_id long, url string, html string")
    assert sorted(r["text"] for r in html.extract(made).collect()) == [""] + ["Ein Satz."] * 3


# --- queries and pipeline

@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    got, want = QUERIES[name](spark, FOLDER).toPandas(), connect(FOLDER).sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) and compare(canonical(got), canonical(want)) == ""


def test_thirteen_queries():
    assert [int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES] == list(range(1, 14))


CLASHING = ("spans", "_key", "_node", "_least", "_times", "_row", "_rest", "_text", "_evidence", "keep", "probability", "evidence",
            "host_posterior", "_document", "size", "copies", "rate", "taken", "col", "key", "n", "node", "root", "ids", "piece", "start")


def test_stages_keep_clashing_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = docs.withColumns({name: F.concat(F.lit(name), F.col("doc_id").cast("string")) for name in CLASHING})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        wrong = [F.coalesce(F.col(c) != F.concat(F.lit(c), F.col("doc_id").cast("string")), F.lit(True)) for c in CLASHING]
        assert out.where(F.array_contains(F.array(*wrong), True)).count() == 0 < out.count(), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() > 0


def test_pipeline_stages(spark, odd, nothing):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and out.count() > 0, name
        extra = stage(spark, odd.select(*docs.columns, F.lit(1).alias("extra")), FOLDER)
        assert "extra" in extra.columns, name
        assert stage(spark, nothing, FOLDER).count() == 0, name
    packed = corpus_pipeline.run(spark, FOLDER)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and packed.count() > 0
