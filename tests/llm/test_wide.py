"""What a small table can't show by itself: many lengths, grades and names, blocks, whole tables against plain versions."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodespar.llm import _rows, bagminhash, mixing, ordinal_quality, queries, rp_forest, sentencepiece_unigram, site_style_tree, toxicity_kn
from lodespar.llm._words import Words, shingles


def brute_groups(vectors, labels, ids):
    """(links, smallest id reachable) of each row by all pairs."""
    n = len(vectors)
    parent, links = list(range(n)), [0] * n

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if len(vectors[i]) == len(vectors[j]) and labels[i] == labels[j]:
                a, b = np.array(vectors[i]), np.array(vectors[j])
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98:
                    links[i] += 1
                    links[j] += 1
                    x, y = find(i), find(j)
                    parent[max(x, y)] = min(x, y)
    low = {}
    for i in range(n):
        low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return [(ids[i], links[i], low[find(i)]) for i in range(n)]


def test_vectors_of_many_lengths(spark):
    """More lengths than any list that a plan could hold, three vectors of each: two near each other, one not."""
    rng = np.random.default_rng(3)
    rows = []
    for dim in range(2, 72):
        x = rng.standard_normal(dim)
        rows += [(len(rows), x.tolist(), 1), (len(rows) + 1, (x + 1e-3).tolist(), 1), (len(rows) + 2, (-x).tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in rp_forest.near_duplicates(df).collect())
    assert got == sorted(brute_groups([r[1] for r in rows], [1] * len(rows), [r[0] for r in rows])) and sum(n for _, n, _ in got) == 140


def test_vectors_with_one_id(spark):
    """Rows of one id are vectors of their own."""
    rows = [(1, [1.0, 0.0], 1, "x"), (1, [0.0, 1.0], 1, "x"), (2, [0.0, 1.0], 1, "x"), (None, [1.0, 1.0], 1, None), (5, [1.0, 1.0], 1, None), (6, [1.0, 1.0], 2, None)]
    got = sorted(((r.vec_id or -1), r.n_links, r.component_id, r.kept) for r in rp_forest.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, row string")).collect())
    assert got == [(-1, 1, 5, False), (1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (5, 1, 5, True), (6, 0, 6, True)]


def test_vectors_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(rp_forest, "BLOCK", 8)
    rng = np.random.default_rng(5)
    base = rng.standard_normal((3, 16))
    rows = [(i, (base[i % 3] + 0.08 * rng.standard_normal(16)).tolist(), 0) for i in range(120)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in rp_forest.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect())
    assert got == sorted(brute_groups([r[1] for r in rows], [0] * 120, list(range(120))))


def test_many_grades(spark):
    rows = [(i, f"grade{i % 40:02d} " * (3 + i % 5), i % 40) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, grade int")
    model = ordinal_quality.fit(docs, docs.select("doc_id", "grade"))
    assert model.grades.tolist() == list(range(40)) and len(model.thresholds) == 39 and (np.diff(model.thresholds) > 0).all()


def test_repeated_ids_don_t_multiply_the_sample(spark):
    docs = spark.createDataFrame([(i % 10, f"words {i % 10} of " + ("good" if i % 2 else "bad")) for i in range(200)], "doc_id bigint, text string")
    ratings = spark.createDataFrame([(i, i % 2) for i in range(10)] * 3, "doc_id bigint, grade int")
    assert len(ordinal_quality.fit(docs, ratings).grades) == 2


CLASHES = ["last", "rest", "full", "before", "total", "budget", "domain", "n_tokens", "range", "copies", "__domain", "row", "key", "component", "kept", "score", "host", "c", "a.b"]


def test_names_that_clash(spark):
    text = "plain words about a thing and some other things that stand here " * 6
    docs = spark.createDataFrame([(i, f"{text} {i} {' '.join(f'w{i}x{j}' for j in range(60))}", "en", "site1") for i in range(12)] + [(99, None, None, None), (98, "", "en", "site1")], "doc_id bigint, text string, lang string, source string")
    docs = docs.select("*", *[F.col("doc_id").alias(c) for c in CLASHES])
    whole = mixing.mixed_documents(docs, budget_pct=100, max_epochs=1, weights=({}, {}, {}))
    assert whole.columns == docs.columns and {r.doc_id for r in whole.collect()} >= set(range(12)) and all(r["last"] == r.doc_id == r["a.b"] for r in whole.collect())
    assert mixing.mix(docs).columns == ["doc_id", "domain", "lang", "source", "n_tokens", "epoch"]
    kept = bagminhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == 14
    scorer = toxicity_kn.Scorer(None, None)
    scored = toxicity_kn.score(docs, scorer)
    assert sorted(scored.columns) == sorted(docs.columns) and {r.score for r in scored.collect()} == {0.0}


@pytest.fixture(scope="module")
def odd_lake(spark, tmp_path_factory):
    """A folder of tables whose documents have nulls, empty and long texts, repeats and clashing names."""
    folder = tmp_path_factory.mktemp("odd")
    good = lambda i: " ".join(f"calm{(i * 31 + j * 7) % 997}" for j in range(80))
    bad = "zzz ### $$$ " * 30
    rows = [(i, good(i), "en", "site1", 80, i) for i in range(40)] + [(100 + i, bad + str(i), "en", "site2", 5, i) for i in range(20)]
    rows += [(200, None, None, None, None, None), (201, "", "de", "site1", 0, 1), (1, good(1), "en", "site1", 80, 1), (None, good(500), "en", "site1", 80, 2), (203, good(3) + " " + " ".join(f"long{j}" for j in range(50_000)), "en", "site3", 9, 3)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, last bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(100 + i, 0, 0) for i in range(20)] + [(None, 1, 0), (200, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline_of_odd_rows(spark, odd_lake):
    """Each stage over what the one before kept, and over an empty table."""
    docs = spark.read.parquet(f"{odd_lake}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, odd_lake)
        none = stage(spark, docs.limit(0), odd_lake)
        if name != "sentencepiece":
            assert out.columns == docs.columns, name
        assert none.count() == 0, name
        docs = out
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        ids = {r.doc_id for r in docs.collect()}
        assert not ids & set(range(100, 120)), name
        assert len(ids & set(range(40))) >= (1 if name in ("mixing", "sentencepiece") else 38), name


def test_planes_query_equals_a_plain_encoder(spark, sf_dir):
    """All columns of the whole table against the library itself, document by document."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    want, start = [], 0
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = queries.op10_bitplane(spark, sf_dir).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want


def test_pieces_of_whole_texts(spark, sf_dir):
    """Whole texts give what their stretches solved one by one give, with runs of spaces and long stretches."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece_unigram.load(path)
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()] + ["  two  spaces ", "x" * 3000 + " y " + "é" * 500, " " * 50, "a\nb c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: list(r.ids) for r in sentencepiece_unigram.encode(docs, path).collect()}
    for i, text in enumerate(texts):
        runs = sentencepiece_unigram._RUNS.findall(" " + text) if text else []
        assert got[i] == [x for r in runs for x in model.solve_one(r.replace(" ", sentencepiece_unigram.MARK).encode())], i


def test_near_groups_lose_no_link(spark, sf_dir):
    """All pairs of the whole table by exact overlap: similar texts stand in one group, and groups hold nothing else."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    row, item, count = shingles(Words.of(pa.array([t for _, t in rows])))
    bags = [dict(zip(item[row == i].tolist(), count[row == i].tolist())) for i in range(len(rows))]
    got = {r.id: r.component_id for r in bagminhash.deduplicated(docs).collect()}
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            both = sum(min(n, bags[j].get(k, 0)) for k, n in bags[i].items())
            if both and both >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert got == {d: find(d) for d, _ in rows} and len(set(got.values())) < len(got)


def test_families_in_several_blocks(spark, monkeypatch):
    """Edited copies of one text, far from each other but for chains, dealt into small blocks."""
    monkeypatch.setattr(bagminhash, "BLOCK_ROWS", 6)
    monkeypatch.setattr(bagminhash, "BLOCK_ITEMS", 600)
    rng = np.random.default_rng(9)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for i in range(60):
        t = list(base)
        for k in rng.choice(150, rng.integers(1, 9), replace=False):
            t[k] = f"e{i}x{k}"
        texts.append(" ".join(t))
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "key bigint, component bigint, text string")
    families = spark.createDataFrame([(i, 0) for i in range(60)], "component bigint, family bigint")
    links = {(r.a, r.b) for r in bagminhash._family_links(rows, families).collect()}
    bags = [set(zip(*[t.split()[k:] for k in range(5)])) for t in texts]
    similar = {(i, j) for i in range(60) for j in range(60) if i != j and len(bags[i] & bags[j]) >= 0.8 * len(bags[i] | bags[j])}

    def groups(pairs):
        parent = list(range(60))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[max(find(a), find(b))] = min(find(a), find(b))
        return [find(i) for i in range(60)]

    assert links <= similar and groups(links) == groups(similar) and len(set(groups(similar))) < 60


def test_row_tables(spark):
    df = spark.range(0, 1000, 1, 7).select("id", F.monotonically_increasing_id().alias("row"))
    listed = df.where("id % 3 = 0").select("row", F.array("id", "id").alias("to"))
    table = _rows.RowTable(listed.unionAll(df.where("id = 1").select("row", F.array().cast("array<bigint>").alias("to"))))
    got = {r.id: (r.to, r.here) for r in df.select("id", table.get(F.col("row")).alias("to"), table.has(F.col("row")).alias("here")).collect()}
    assert got == {i: ([i, i] if i % 3 == 0 else [] if i == 1 else None, i % 3 == 0 or i == 1) for i in range(1000)}
    table.drop()


def menu(i, n=6):
    return "".join(f"<li><a href='/{i}/{j}'>link {i * 17 + j}</a></li>" for j in range(n - i % 2))


def test_the_tree_decides_on_unmarked_pages(spark):
    """No article, no telling tag, role or class: menus of links with other words on each page, a repeated line, a repeated branch."""
    page = lambda i: f"<body><div class=b1><ul>{menu(i)}</ul></div><div class=b2><p>story {i} begins here</p><p>and has an end {i * 13}</p></div><p class=x9>Call our office</p><div class=b3><ul>{menu(i + 50)}</ul></div></body>"
    rows = spark.createDataFrame([(i, f"http://h/{i}", page(i)) for i in range(10)], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in site_style_tree.extract(rows).collect()}
    assert got == {i: f"story {i} begins here\nand has an end {i * 13}" for i in range(10)}
    assert all(site_style_tree.Page(page(i)).text() != got[i] for i in range(10))  # marks alone remove none of it


def test_importance_equals_brute_force(spark):
    import math

    pages = [f"<body><div class=a><p>same</p>{'<h2>head</h2>' if i % 3 else ''}</div><div class=c><p>own {i}</p><p>pair {i // 2}</p></div></body>" for i in range(6)]
    seen: dict[int, dict] = {}
    for html in pages:
        page = site_style_tree.Page(html)
        nodes = {}
        for (_, paths), f in zip(page.all, page.features):
            for depth, path in enumerate(paths, 1):
                nodes.setdefault(path, (depth, set()))[1].add(f)
        styles = {}
        for path, style in page.styles:
            styles.setdefault(path, set()).add(style)
        for path, (depth, features) in nodes.items():
            s = seen.setdefault(path, {"depth": depth, "n": 0, "content": {}, "style": {}})
            s["n"] += 1
            for f in features:
                s["content"][f] = s["content"].get(f, 0) + 1
            for x in styles.get(path, ()):
                s["style"][x] = s["style"].get(x, 0) + 1
    want = {}
    for path, s in seen.items():
        m = s["n"]
        total = sum(s["content"].values())
        # of all places where something stands below the node: how spread over the pages is what stands there
        content = 1 - sum(n / total * math.log(n, m) for n in s["content"].values()) if m > 1 else 1.0
        t = sum(s["style"].values())
        style = 1.0 if m == 1 else -sum(n / t * math.log(n / t, m) for n in s["style"].values()) if t else 0.0
        fade = 0.9 ** s["depth"]
        want[path] = content if not t else (1 - fade) * style + fade * content
    rows = spark.createDataFrame([("h", p) for p in pages], "host string, html string")
    got = {r.path: r.importance for r in site_style_tree.style_tree(rows).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and min(want.values()) < 0.1 < max(want.values())


def test_deep_pages():
    """Depth costs no more than length: nested elements, each with text and a wrong end tag."""
    n = 3000
    page = site_style_tree.Page("".join(f"<div>x{i}</b>" for i in range(n)))
    assert page.text() == "\n".join(f"x{i}" for i in range(n)) and max(len(p) for _, p in page.all) <= site_style_tree.DEEP


def test_held_out_is_never_null(spark, tmp_path):
    spark.createDataFrame([(None, "you are kind"), (1, None), (2, "x y z")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 1), (2, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r.held_out for r in queries.op3_toxicity(spark, str(tmp_path)).collect()} <= {True, False}


def test_families_send_rows_to_their_buckets_only(spark, monkeypatch, tmp_path):
    """Groups of four texts of similarity 0.7, in a ring by rare passages of two texts: rows meet those of their buckets, not the whole ring."""
    monkeypatch.setattr(bagminhash, "BLOCK_ROWS", 8)
    seen, compare = str(tmp_path / "rows"), bagminhash._links_between

    def counted(key, table):
        with open(seen, "a") as f:
            f.write(f"{table.num_rows}\n")
        return compare(key, table)

    monkeypatch.setattr(bagminhash, "_links_between", counted)
    words = lambda n, *k: [f"{'x'.join(map(str, k))}y{i}" for i in range(n)]
    texts = [" ".join(words(247, "own", i) + words(27, i, j) + words(27, (i + 1) % 30, j)) for i in range(30) for j in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert all(r.id == r.component_id for r in bagminhash.deduplicated(docs).collect())
    assert 60 <= sum(map(int, open(seen))) <= 200


@pytest.mark.parametrize("shared", [True, False])
def test_large_families_by_buckets(spark, monkeypatch, shared):
    """Pairs of similar texts, all in one family that is larger than a block: split by prefixes, or where all share rare shingles, compared bucket by bucket."""
    monkeypatch.setattr(bagminhash, "BLOCK_ROWS", 4)
    words = lambda n, k: [f"{k}y{i}" for i in range(n)]
    passage = lambda i: words(20, f"p{i if shared else i // 2}") + words(20, f"p{(i + 1) % 40 if shared else i // 2}")
    texts = [passage(i) + words(160, f"own{i // 2 * 2}" if i % 2 == 0 or i % 4 == 1 else f"own{i}") for i in range(40)]
    rows = spark.createDataFrame([(i, i, " ".join(t)) for i, t in enumerate(texts)], "key bigint, component bigint, text string")
    families = spark.createDataFrame([(i, 0) for i in range(40)], "component bigint, family bigint")
    buckets = spark.createDataFrame([(i // 2, i) for i in range(40)] + [(100 + i // 4, i) for i in range(40)], "bucket bigint, key bigint")
    links = {(min(r.a, r.b), max(r.a, r.b)) for r in bagminhash._family_links(rows, families, buckets).collect()}
    bags = [set(zip(*[t[k:] for k in range(5)])) for t in texts]
    similar = {(i, j) for i in range(40) for j in range(i + 1, 40) if len(bags[i] & bags[j]) >= 0.8 * len(bags[i] | bags[j])}
    assert links == similar and (shared or similar)


def test_toxicity_learns_from_every_labelled_row_and_word(spark):
    """More ordinary rows than 4,000 and more words than 320,000 / 2, without a sign of the label in them."""
    rng = np.random.default_rng(5)
    words = ["".join(w) for w in rng.choice(list("abcdefghij"), (9500 * 25, 6))]
    docs = spark.createDataFrame([(i, " ".join(words[25 * i : 25 * i + 25])) for i in range(9500)], "doc_id bigint, text string").repartition(4).localCheckpoint()
    scorer = toxicity_kn.fit(docs, docs.select("doc_id", (F.col("doc_id") % 19 == 0).cast("int").alias("toxic")))
    runs = {m[max(0, i - 5) : i + 1] for w in set(words) for m in [f"<{w}>"] for i in range(1, len(m))}
    assert len(scorer.model.gram) == len(runs)
    # of measures that tell nothing the calibration gives the share of toxic rows among all
    assert abs(1 / (1 + np.exp(-scorer.weights[0] - scorer.weights[1:] @ [np.median(x) for x in scorer.model.features(toxicity_kn.lower_words(pa.array([" ".join(words[k : k + 25]) for k in range(3, 5000, 25)]))).T])) - 1 / 19) < 0.02


def test_logistic_sums_by_parts():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 2))
    y = (rng.random(3000) < 1 / (1 + np.exp(1 - 2 * x[:, 0] + x[:, 1]))).astype(float)
    t = toxicity_kn._logistic(lambda t: sum(toxicity_kn._sums(x[k::7], y[k::7], t) for k in range(7)), 2)
    assert np.allclose(t, [-1, 2, -1], atol=0.25)
    assert np.allclose(toxicity_kn._sums(x, y, t)[:3], [0, *(0.1 * t[1:])], atol=1e-3)


def test_cells_and_leaves_find_the_same(spark, monkeypatch):
    """Links of near copies whether sent by cell, by leaf, or some by each; a vector goes to fewer cells than leaves."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((900, 16))
    x = np.concatenate((base, base[:300] + 0.02 * rng.standard_normal((300, 16)), base[:1] + 0.01 * rng.standard_normal((200, 16))))
    df = spark.createDataFrame([(i, v, i % 3 // 2) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>, label int").repartition(3).localCheckpoint()
    found = []
    for least, cell, most in ((40, 32_768, 40_960), (40, 300, 40_960), (40, 32_768, 0), (40, 300, 120)):
        monkeypatch.setattr(rp_forest, "LEAF", least)
        monkeypatch.setattr(rp_forest, "CELL", cell)
        monkeypatch.setattr(rp_forest, "MOST", most)
        found.append(sorted((r.vec_id, r.n_links, r.component_id) for r in rp_forest.near_duplicates(df).collect()))
    assert all(f == found[0] for f in found) and sum(n for _, n, _ in found[0]) > 10_000
    forest = rp_forest.Forest(rp_forest._unit(x), len(x))
    leaves, to = forest.leaves(rp_forest._unit(x))
    assert len(np.unique(np.stack((np.repeat(np.arange(len(x)), np.diff(to)), forest.cells[leaves])), axis=1).T) < len(leaves) / 1.5


def test_groups_and_shared_leaves():
    rng = np.random.default_rng(9)
    i, j = rng.integers(0, 400, (2, 300))
    groups = rp_forest.Groups(400)
    kept = [groups.join(i[:100], j[:100]), groups.join(i[100:], j[100:])]
    from lodespar.llm._graph import Union

    plain, forest = Union(400), Union(400)
    most = sum(plain.join(a, b) for a, b in zip(i.tolist(), j.tolist()))
    assert all(forest.join(a, b) for k in kept for a, b in zip(k[0].tolist(), k[1].tolist())) and sum(len(k[0]) for k in kept) == most
    assert [plain.find(k) for k in range(400)] == groups.of.tolist()
    lists = [sorted({99, *rng.integers(0, 60, rng.integers(0, 9)).tolist()}) for _ in range(50)]
    pad = rp_forest._pad(pa.array(lists, pa.list_(pa.int32())))
    i, j = rng.integers(0, 50, (2, 500))
    assert rp_forest._first_shared(pad, i, pad, j).tolist() == [min(set(lists[a]) & set(lists[b])) for a, b in zip(i, j)]
