"""Near duplicates, repeated passages, neighbours, mixing, pipeline."""

import itertools
import os
import random
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from ashlar.llm import components, jaccard_join, mixing, paragraph_dedup, spann

from .conftest import prose


def brute_force(texts):
    """(class: least place, links) of every text."""
    known = jaccard_join.WordHashes()
    sets = [frozenset(jaccard_join.shingles(t, known).tolist()) for t in texts]
    links, root = [0] * len(texts), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if (not a and not b) or len(a & b) >= 0.8 * len(a | b) and (a & b):
            links[i] += 1
            links[j] += 1
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return [(find(i), links[i]) for i in range(len(texts))]


def test_jaccard_against_brute_force(spark, edge_rows):
    r = random.Random(5)
    texts = [t for _, t, *_ in edge_rows]
    base = prose(50, 150).split()
    for _ in range(320):  # more than one block of near copies
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = "changed%d" % r.randrange(1000)
        texts.append(" ".join(w))
    texts += [" ".join(base)] * 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {x["doc_id"]: (x["class_id"], x["n_links"]) for x in jaccard_join.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_force(texts)


def test_jaccard_odd_rows(edge, none, edge_rows):
    assert jaccard_join.near_duplicates(edge).count() == len(edge_rows)
    assert jaccard_join.near_duplicates(none).count() == 0
    kept = jaccard_join.one_of_each(edge)
    assert kept.columns == edge.columns
    texts = [x["text"] for x in kept.select("text").collect()]
    assert len(texts) == len({c for c, _ in brute_force([t for _, t, *_ in edge_rows])})


def test_pruning_keeps_what_reaches_the_threshold():
    for n in range(16, 161, 16):
        m = jaccard_join.least_matches(n)
        assert m <= 0.8 * n
    assert jaccard_join.least_matches(160) > 60


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 3000 + i) for i in range(200)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}


def test_passages(spark, edge, none):
    r = random.Random(8)
    passage = prose(77, 70)
    rows = []
    for i in range(60):
        w = prose(1000 + i, 200).split()
        at = r.randrange(len(w))
        rows.append((i, " ".join([*w[:at], passage, *w[at:]]) if i % 3 == 0 else " ".join(w)))
    got = paragraph_dedup.passages(paragraph_dedup.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string"))).toPandas()
    assert set(got["doc_id"]) == {i for i in range(60) if i % 3 == 0}
    assert got[~got["removed"]]["doc_id"].tolist() == [0]
    texts = dict(rows)
    for x in got.itertuples():
        # a paragraph at the edge may hold a word or two of what stands around the passage
        words = texts[x.doc_id][x.start : x.end].split()
        assert sum(w in passage for w in words) >= 0.8 * len(words)
    assert paragraph_dedup.repeated_paragraphs(none).count() == 0
    odd = paragraph_dedup.passages(paragraph_dedup.repeated_paragraphs(edge)).toPandas()
    assert {1, 2, 3, 12} <= set(odd["doc_id"].dropna())


def shared_runs(texts, least):
    """The documents that share a run of ``least`` words with another one, by brute force."""
    held = defaultdict(set)
    for i, t in enumerate(texts):
        w = re.findall(r"[^\W_]+", t.lower())
        for j in range(len(w) - least + 1):
            held[tuple(w[j : j + least])].add(i)
    return {i for s in held.values() if len(s) > 1 for i in s}


def found_passages(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return paragraph_dedup.passages(paragraph_dedup.repeated_paragraphs(docs)).toPandas()


def lines(words, n=5):
    return "\n".join(" ".join(words[i : i + n]) for i in range(0, len(words), n))


def test_passages_of_short_lines(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(60)]
    texts = []
    for i in range(40):
        around = [word() for _ in range(100)]
        at = 5 * r.randrange(20)
        texts.append(lines([*around[:at], *passage, *around[at:]] if i % 4 == 0 else around))
    texts += [lines([word() for _ in range(25)])] * 2  # short documents that are the same
    got = found_passages(spark, texts)
    assert set(got["doc_id"]) == shared_runs(texts, 25) == {*range(0, 40, 4), 40, 41}
    assert set(got[~got["removed"]]["doc_id"]) == {0, 40}
    for x in got.itertuples():
        words = texts[x.doc_id][x.start : x.end].split()
        assert x.words <= len(words)
        assert x.doc_id >= 40 or set(words) <= set(passage)


def test_passages_of_scripts_without_blanks(spark):
    r = random.Random(13)
    text = lambda n: "".join(chr(r.randrange(0x4E00, 0x9F00)) for _ in range(n))
    passage = text(200)
    texts = [text(150) + (passage if i % 3 == 0 else "") + "。" + text(150) for i in range(12)]
    got = found_passages(spark, texts)
    assert set(got["doc_id"]) == {0, 3, 6, 9}
    assert all(texts[x.doc_id][x.start : x.end] in passage for x in got.itertuples())


def test_passages_without_marks(spark):
    r = random.Random(14)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    texts = []
    for _ in range(300):  # pairs that share 51 words
        passage = [word() for _ in range(51)]
        for _ in range(2):
            around = [word() for _ in range(120)]
            at = r.randrange(121)
            texts.append(" ".join([*around[:at], *passage, *around[at:]]))
    texts += [" ".join(word() for _ in range(150)) for _ in range(50)]
    got = found_passages(spark, texts)
    assert set(got["doc_id"]) == shared_runs(texts, 51) == set(range(600))
    run = ["echo " * n + prose(90 + n, 40) for n in (70, 90)]  # a run of one word, equal windows within each other
    got = found_passages(spark, run)
    assert sorted(got["doc_id"]) == [0, 1] and got.set_index("doc_id")["removed"].to_dict() == {0: False, 1: True}
    assert (got["words"] <= 90).all()


def test_passages_of_a_whole_corpus(spark):
    """Every document of the synthetic corpus that shares a run of 50 words with another, by brute force, is found."""
    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no synthetic corpus here")
    docs = spark.read.parquet(path)
    rows = docs.select("doc_id", "text").toPandas()
    got = paragraph_dedup.passages(paragraph_dedup.repeated_paragraphs(docs)).toPandas()
    texts = rows["text"].fillna("").tolist()
    ids = rows["doc_id"].tolist()
    assert {ids[i] for i in shared_runs(texts, 50)} <= set(got["doc_id"])
    # and what is found shares 20 words at least, or is near another document's paragraph
    shingled = [set(jaccard_join.shingles(t, jaccard_join.WordHashes()).tolist()) for t in texts]
    alike = {ids[i] for i in shared_runs(texts, 20)}
    for i in set(got["doc_id"]) - alike:
        mine = shingled[ids.index(i)]
        assert any(len(mine & s) >= 16 for j, s in zip(ids, shingled) if j != i)


def test_near_paragraphs_are_linked_by_bands(spark):
    """Paragraphs that share no window of 20 words are found through their bands; others at under 0.8 are left."""
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    base = [word() for _ in range(1000)]
    layout = paragraph_dedup.Layout(" ".join(base))
    first, last = int(layout.first[2]), int(layout.last[2])
    paragraph = base[first : last + 1]
    b = pd.DataFrame({"node": [3, 5, 9, 11], "root": [1, 1, 1, 2], "block": [0, 0, 0, 0], "i": 0, "j": 0})
    near = [*paragraph[:-1], "other"]
    b["text"] = [" ".join(paragraph), " ".join(near), " ".join(paragraph[: len(paragraph) // 2]), " ".join(paragraph)]
    assert paragraph_dedup.tile_edges(b).to_numpy().tolist() == [[3, 5]]
    # every paragraph of a text is cut alike, whatever stands before and after it
    moved = paragraph_dedup.Layout(" ".join([word() for _ in range(300)] + base[first - 120 : last + 120] + [word() for _ in range(300)]))
    assert any(moved.text(i) == " ".join(paragraph) for i in range(len(moved.first)))
    assert sum(layout.last - layout.first + 1) == 1000 and (layout.last - layout.first + 1).min() >= paragraph_dedup.LEAST_WORDS


def test_bands_are_tuned_for_recall():
    bands, rows = paragraph_dedup.tune()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.998


def test_distance_ratio_prunes():
    """On clustered vectors few lists are read and nearly all neighbours found."""
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(60, 32))
    x = centre[rng.integers(0, 60, 6000)] + 0.25 * rng.normal(size=(6000, 32))
    c = spann.fit(x[:4000], len(x), 10)
    held = c.lists_for_vectors(x)
    sizes = np.bincount(np.concatenate(held), minlength=len(c.at))
    share = hit = 0
    for i in range(0, 6000, 100):
        read = c.widened(x[i], sizes, spann.ENOUGH * 10 + spann.COPIES)
        share += sizes[read].sum() / sizes.sum()
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        hit += sum(len(np.intersect1d(read, held[j])) > 0 for j in np.argpartition(d, 10)[:10])
    assert hit / 600 >= 0.9 and share / 60 <= 0.3


def test_neighbours_of_mixed_lengths_and_repeated_ids(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(size=3)]) for i in range(47)]
    rows += [(100, [1.0, 2.0]), (200, [3.0, 4.0])]  # queries of another length take no part
    rows += [(7, rows[7][1])] * 3 + [(300, rows[7][1]), (7, [9.0, 9.0, 9.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = spann.nearest(vectors, vectors.where("vec_id IN (7, 100, 200, 300)")).toPandas()
    assert set(got["query_id"]) == {7, 300}
    assert (got.groupby("query_id").size() == 10).all() and not got.duplicated(["query_id", "vec_id"]).any()
    assert got[(got["query_id"] == 300) & (got["rank"] == 1)][["vec_id", "score"]].to_numpy().tolist() == [[7, 0.0]]
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(0, 500)], "vec_id long, embedding array<double>")
    got = spann.nearest(same, same.where("vec_id = 300")).orderBy("rank")
    assert [r["vec_id"] for r in got.collect()] == list(range(10))


def test_neighbours(spark, none):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[500:900] = x[7]  # a common vector
    rows = [(i, [float(v) for v in x[i]]) for i in range(3000)] + [(5000, None), (5100, []), (5200, [0.0] * 16), (5300, [float("nan")] + [1.0] * 15), (5400, [1.0] * 3), (None, [1.0] * 16)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in spann.nearest(vectors, vectors.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 3000, 100))
    hit = 0
    y = x.astype(float)
    for q, found in got.items():
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        want = [j for j in np.lexsort((np.arange(3000), d)) if j != q][:10]
        hit += len({i for i, _ in found} & set(want))
        assert [s for _, s in found] == sorted(s for _, s in found) and np.allclose([s for _, s in found], [d[i] for i, _ in found], rtol=1e-12)
        if q in (500, 600):
            assert [i for i, _ in found] == [i for i in [7, *range(500, 900)] if i != q][:10]
    assert hit / (10 * len(got)) >= 0.9
    empty = vectors.where("false")
    assert spann.nearest(empty, empty).count() == 0
    few = vectors.where("vec_id < 3")
    assert spann.nearest(few, few.where("vec_id = 0")).count() == 2


def test_neighbours_of_outliers(spark, monkeypatch):
    monkeypatch.setattr(spann, "LIST", 4)  # lists as small, beside the sample's parts, as those of large tables
    rng = np.random.default_rng(15)
    x = rng.normal(size=(400, 8))
    x[:3] = 1000 * np.eye(8)[:3]  # alone
    x[3:9] = 500 * np.eye(8)[4] + 1e-3 * rng.normal(size=(6, 8))  # a tight group of 6
    vectors = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in spann.nearest(vectors, vectors.where("vec_id < 20")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert {q: len(v) for q, v in got.items()} == dict.fromkeys(range(20), 10)
    for q in range(3, 9):
        assert set(got[q]) >= set(range(3, 9)) - {q}
    # one id in many rows: its postings are one neighbour
    ids = [0] * 60 + list(range(1, 31))
    near = spark.createDataFrame([(i, [1.0 + i, 1.0, float(j % 2)]) for j, i in enumerate(ids)], "vec_id long, embedding array<double>")
    assert spann.nearest(near, near.where("vec_id = 30")).count() == 10
    assert spann.nearest(near, near.where("vec_id = 1")).count() == 10


def test_queries_and_vectors_are_written_once(spark, monkeypatch):
    """Neither grows with the pairs of lists and queries, also where vectors are spread evenly and most lists are read."""
    monkeypatch.setattr(spann, "LIST", 4)
    monkeypatch.setattr(spann, "SHARD", 64, raising=False)
    written, stored = defaultdict(int), spann.stored

    def counted(df, what):
        out = stored(df, what)
        written[what] += out.count()
        return out

    monkeypatch.setattr(spann, "stored", counted)
    x = np.random.default_rng(21).normal(size=(2000, 16))
    vectors = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    assert spann.nearest(vectors, vectors.where("vec_id % 100 = 0")).count() == 200
    assert written["spann-routed"] == 20 and written["spann-postings"] == 2000


def test_neighbours_in_rounds(spark, monkeypatch):
    x = np.random.default_rng(22).normal(size=(600, 8))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5, [float(v) for v in r]) for r in x[100:140]]  # one id asks often
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = vectors.where("vec_id < 30")
    want = sorted(spann.nearest(vectors, asked).collect())
    monkeypatch.setattr(spann, "ASKED", 7)
    assert len(want) == 300 and sorted(spann.nearest(vectors, asked).collect()) == want


@pytest.mark.parametrize("dense", [0.0, 0.1, 2.0])
def test_reading_against_brute_force(monkeypatch, dense):
    """Both ways to compare give the nearest ids of the lists asked for: ties, ids that repeat, vectors far from the origin."""
    monkeypatch.setattr(spann, "DENSE", dense)
    rng = np.random.default_rng(23)
    x = 1e6 + rng.integers(0, 4, (900, 3)).astype(float)
    x[:300] += 1e-3 * rng.normal(size=(300, 3))
    ids = rng.integers(0, 500, 900)
    lists = np.full((900, spann.COPIES), -1, dtype=np.int32)
    for i, row in enumerate(lists):
        row[: 1 + i % spann.COPIES] = rng.choice(21, 1 + i % spann.COPIES, replace=False)
    asks = rng.random((40, 21)) < np.linspace(0, 1, 40)[:, None]
    near = spann.Nearest(ids[:40], x[:40], np.packbits(asks, axis=1).T, 10)
    for lo in range(0, 900, 70):
        near.read(lists[lo : lo + 70], ids[lo : lo + 70], x[lo : lo + 70])
    for i in range(40):
        best = {}
        for j in range(900):
            if ids[j] != ids[i] and asks[i, lists[j][lists[j] >= 0]].any():
                best[ids[j]] = min(best.get(ids[j], np.inf), np.sqrt(((x[j] - x[i]) ** 2).sum()))
        want = sorted((d, j) for j, d in best.items())[:10]
        assert [(d, j) for d, j in zip(near.d[i], near.ids[i], strict=True) if np.isfinite(d)] == want


def test_sample_of_vectors(spark, monkeypatch):
    monkeypatch.setattr(spann, "SAMPLE", 50)
    for ids in (range(1000), [7] * 1000):  # where all ids are one, none or all lie below the bound
        rows = spark.createDataFrame([(i, [float(j)]) for j, i in enumerate(ids)], "vec_id long, v array<float>")
        want = rows.selectExpr("*", "xxhash64(vec_id) h").orderBy("h", "vec_id", "v").drop("h").limit(50)
        assert spann.sampled(rows, 1000).collect() == want.collect()


def test_mixing(edge, none, edge_rows):
    got = mixing.mix(edge).toPandas()
    assert len(got) == len(edge_rows)
    assert (got["taken"] <= 3 * got["size"]).all() and (got["target"] <= 3 * got["source_size"] + 1e-6).all()
    assert mixing.mix(none).count() == 0
    again = mixing.mix(edge.repartition(1)).toPandas()
    assert sorted(got["taken"]) == sorted(again["taken"])


@pytest.mark.parametrize("hot", [False, True])
def test_mix_meets_targets(spark, hot):
    r = random.Random(2)
    rows = [(i, "w " * r.randint(0, 40), "abc"[0 if hot and i % 3 else i % 3]) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).selectExpr("row.source AS s", "target", "taken").toPandas()
    per = got.groupby("s").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(per["target"] - per["taken"]) <= 40).all()
    assert abs(got["taken"].sum() - sum(t.count("w") for _, t, _ in rows)) <= 120


def test_mix_with_repeated_ids(spark):
    def words(docs):
        got = mixing.mix(docs).selectExpr("row.source AS s", "target", "taken", "copies").toPandas()
        return got.groupby("s").agg(target=("target", "first"), taken=("taken", "sum")), sorted(got["copies"])

    # sources of 1,000 rows of 12 words each: targets are 1/2, 1 and 3/2 of them
    for same in (False, True):
        rows = [(None if i % 2 else i, "w " * 12 + ("" if same else f"v{i}"), "abc"[i % 3]) for i in range(3000)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
        per, copies = words(docs.repartition(7))
        assert (abs(per["target"] - per["taken"]) <= 13).all()
        assert words(docs.repartition(2))[1] == copies
    rows = [(i % 5, "w " * (1 + i % 7), "ab"[i % 2]) for i in range(2000)]
    per, _ = words(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert (abs(per["target"] - per["taken"]) <= 7).all()


def test_pipeline(spark, edge, none, tmp_path, labels):
    import corpus_pipeline

    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (edge, none):
        now, texts = docs, None
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, str(tmp_path))
            if name != "packing":
                assert out.columns == docs.columns
                path = f"{tmp_path}/{name}-{docs is none}"
                out.write.parquet(path)
                now = spark.read.parquet(path)
                texts = [x["text"] for x in now.select("text").collect()]
            else:
                pieces = list(out.toPandas().itertuples())
                from .test_text import check_packing

                check_packing(pieces, texts)
        if docs is edge:
            assert not any("abcdefghijkl12345" in (t or "") for t in texts)
        else:
            assert not texts


def test_pipeline_stages(spark, edge_rows, tmp_path):
    import corpus_pipeline
    from ashlar.llm import toxicity

    from .test_text import check_packing

    rude = lambda i: prose(600 + i, 20) + " you idiot, you pathetic worthless scum! " + prose(700 + i, 20)
    rows = [r[:4] for r in edge_rows] + [(100 + i, rude(i) if i % 2 else prose(500 + i, 60), "en", "ab"[i % 4 > 1]) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    # without a model nothing is dropped
    assert toxicity.keep_clean(docs, toxicity.fit(docs, spark.createDataFrame([(100, 1)], "doc_id long, toxic int"))).count() == len(rows)
    spark.createDataFrame([(100 + i, i % 2) for i in range(160)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    def run(k, before):
        name, stage = corpus_pipeline.STAGES[k]
        stage(spark, before, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        return now, now.collect()

    tuples = lambda got: sorted(map(repr, map(tuple, got)))
    now, clean = run(0, docs)
    ids = {r["doc_id"] for r in clean}
    assert {100 + i for i in range(0, 160, 2)} <= ids and not ids & {100 + i for i in range(1, 160, 2)}
    now, single = run(1, now)
    classes = {c for c, _ in brute_force([r["text"] for r in clean])}
    assert len(single) == len(classes) == len({c for c, _ in brute_force([r["text"] for r in single])}) > 80
    now, masked = run(2, now)
    assert len(masked) == len(single) and not any("abcdefghijkl12345" in (r["text"] or "") for r in masked)
    assert tuples(r for r in masked if r["doc_id"] != 10) == tuples(r for r in single if r["doc_id"] != 10)
    plan = mixing.mix(now).selectExpr("row.*", "copies").collect()
    now, mixed = run(3, now)
    assert tuples(mixed) == sorted(repr(tuple(r)[:-1]) for r in plan for _ in range(r["copies"])) and len(mixed) > 40
    _, pieces = run(4, now)
    check_packing(list(spark.read.parquet(f"{tmp_path}/packing").toPandas().itertuples()), [r["text"] for r in mixed])
    assert pieces
