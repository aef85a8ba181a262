"""Each operator over odd rows and over an empty table."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodespar.llm import bagminhash, bitplane, chat_template, host_rules, mixing, ordinal_quality, rp_forest, sentencepiece_unigram, site_style_tree, toxicity_kn


def scorer(spark):
    docs = spark.createDataFrame([(i, ("you idiot " if i % 2 else "dear friend ") + "words " * (i % 7)) for i in range(40)], "doc_id bigint, text string")
    return docs, toxicity_kn.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic")))


def test_toxicity(spark, odd):
    _, s = scorer(spark)
    got = toxicity_kn.score(odd, s, out="s2").select("text", "s2").collect()
    assert len(got) == odd.count() and all(0 <= r.s2 <= 1 for r in got)
    assert len({r.s2 for r in got if not (r.text or "").strip()}) == 1
    assert toxicity_kn.score(odd.limit(0), s, out="s2").collect() == []
    none = toxicity_kn.fit(odd, odd.limit(0).select("doc_id", F.lit(1).alias("toxic")))
    assert {r.s2 for r in toxicity_kn.score(odd, none, out="s2").collect()} == {0.0}


def test_quality(spark, odd):
    texts = [(i, f"good plain words about thing {i} and other things" if i % 2 else f"### $$$ !!! {i}", i % 2) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, grade int")
    m = ordinal_quality.fit(docs, docs.select("doc_id", "grade"))
    kept = ordinal_quality.select_documents(docs, m, grade=1)
    assert kept.columns == docs.columns and {r.grade for r in kept.collect()} == {1}
    assert ordinal_quality.select_documents(odd, m).columns == odd.columns
    assert ordinal_quality.select_documents(odd.limit(0), m).count() == 0
    one = ordinal_quality.fit(docs, docs.limit(0).select("doc_id", F.col("grade")))
    assert ordinal_quality.select_documents(odd, one, grade=0).count() == odd.count()
    m3 = ordinal_quality.fit(docs, docs.select("doc_id", (F.col("grade") * 2 - (F.col("doc_id") % 3 == 0).cast("int")).alias("grade")))
    assert (np.diff(m3.thresholds) > 0).all()


def test_host_rules(spark, odd):
    got = {(r.doc_id, r.n_words, r.base_failed) for r in host_rules.judge(odd).collect()}
    assert (2, 0, True) in got and (4, 20_000, False) in got and (1, 57, False) in got
    kept = host_rules.keep_documents(odd, max_rate=0.95)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 4]
    assert host_rules.judge(odd.limit(0)).count() == 0 and host_rules.keep_documents(odd.limit(0)).count() == 0


def test_bad_host_is_rejected(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good if i % 10 == 0 else "short", "bad") for i in range(100)] + [(100 + i, good, "good") for i in range(100)] + [(300, good, None)]
    kept = host_rules.judge(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).where("kept").collect()
    assert {r.doc_id for r in kept} == set(range(100, 200)) | {300}


def test_near_duplicates(spark, odd):
    got = bagminhash.deduplicated(odd).collect()
    assert len(got) == odd.count()
    # the two copies and their longer version; "one two" twice; the rest alone
    assert sum(r.kept for r in got) == odd.count() - 3
    kept = bagminhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.where(F.col("text") == "one two").collect()[0].doc_id == 6
    assert bagminhash.deduplicated(odd.limit(0)).count() == 0


def test_mixing(spark, odd):
    got = mixing.mix(odd)
    assert {r.doc_id for r in got.collect()} <= {r.doc_id for r in odd.collect()}
    whole = mixing.mixed_documents(odd, budget_pct=100, max_epochs=1, weights=({}, {}, {}))
    assert whole.columns == odd.columns
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.mixed_documents(odd.limit(0)).count() == 0


def test_pieces(spark, odd):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = sentencepiece_unigram.encode(odd, path)
    back = sentencepiece_unigram.decode(got, path, out="back").select("doc_id", "n_pieces", "back").collect()
    assert sorted(r.back for r in back) == sorted(r.text or "" for r in odd.collect())
    assert sentencepiece_unigram.encode(odd.limit(0), path).count() == 0


def test_planes(spark, odd, tmp_path):
    path, folder = public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/a"
    got = bitplane.read_documents(bitplane.write_shards(odd, path, folder, shards=3), folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 1, 1, 2, 3, 4, 5, 6, 7, 8]
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])
    assert {r.n_tokens for r in got if r.doc_id in (2, 3)} == {1}
    empty = f"file://{tmp_path}/b"
    assert bitplane.read_documents(bitplane.write_shards(odd.limit(0), path, empty), empty).count() == 0


def test_chat(spark):
    rows = spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", "</s>\\ok[INST]"), (1, 1, None, "x"), (None, None, None, None), (2, 0, "assistant", ""), (3, 0, "tool", "a" * 300_000)], "conv_id bigint, turn int, role string, text string")
    got = {r.conv_id: r for r in chat_template.digests(chat_template.format_conversations(rows)).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[None].n_turns, got[2].loss_chars, got[3].n_turns) == (3, len("</s>\\ok[INST]"), 1, 0, 1)
    assert chat_template.format_conversations(rows.limit(0)).count() == 0


def test_pages(spark):
    html = "<html><body><nav>menu</nav><article><h1>T &amp; t</h1><p>one\n two<p>three<aside>no</aside><div class='comments'>no</div></article><footer>f</footer>"
    rows = spark.createDataFrame([(1, "http://a.b/x", html, "z"), (1, "http://a.b/x", html, "z"), (2, None, None, None), (None, "", "", None), (3, "nonsense", "plain <b>text</b> &lt;", None), (4, "http://a.b/y", "<p>" + "long " * 100_000, None)], "page_id bigint, url string, html string, host string")
    got = [(r.page_id, r.text) for r in site_style_tree.extract(rows).collect()]
    assert got.count((1, "T & t\none two\nthree")) == 2 and (2, "") in got and (None, "") in got and (3, "plain text <") in got
    assert site_style_tree.extract(rows.limit(0)).count() == 0


def test_site_tree_removes_repeated_branches(spark):
    page = lambda i: f"<body><div class=box>Call us now</div><div class=story><p>story {i} is told here</p><p>and it ends {i * 7}</p></div></body>"
    rows = spark.createDataFrame([(i, f"http://h/{i}", page(i)) for i in range(12)], "page_id bigint, url string, html string")
    assert {r.text for r in site_style_tree.extract(rows).collect()} == {f"story {i} is told here\nand it ends {i * 7}" for i in range(12)}


@pytest.mark.parametrize(
    "html",
    [
        "<article><div style='overflow:hidden'>a</div><p data-hidden=false>b</p><a href='/the-hidden-costs'>c</a></article>",
        "<div class='content has-sidebar'><p>a</p><p>b</p><p>c</p></div>",
        "<main class='with-sidebar'><p>a</p><p>b</p><p>c</p></main>",
        "<div class='widget'><article><p>a</p><p>b</p><p>c</p></article></div><div class='comments'><div class='comment'><article>no</article></div></div>",
        "<div class='social sidebar'><main id='search'><p>a</p><p>b</p><p>c</p><div class=share>no</div></main></div>",
        "<main><p>a</p><p>b</p><p>c</p><section class=comments><article>no</article></section></main>",
        "<div class=related><article>no</article></div><article><p>a</p><p>b</p><p>c</p><p hidden>no</p><p hidden=''>no</p><p aria-hidden='true'>no</p></article>",
        "<article><p aria-hidden=false title='hidden'>a</p><p alt='it > hidden'>b</p><p id=x class='' data-x=true>c</p></article>",
    ],
)
def test_pages_keep_their_article(html):
    assert site_style_tree.Page(f"<html><body>{html}</body></html>").text() == "a\nb\nc"


def test_site_tree_holds_all_nodes_and_judges_blocks(spark):
    page = lambda i: "<body><nav>menu</nav><article>" + "".join(f"<p>own {i} {j}" for j in range(10)) + "<p>Call us now</article></body>"
    rows = spark.createDataFrame([(i, f"http://h/{i}", page(i), "h") for i in range(12)], "page_id bigint, url string, html string, host string")
    assert {r.text for r in site_style_tree.extract(rows).collect()} == {"\n".join(f"own {i} {j}" for j in range(10)) for i in range(12)}
    assert ("menu", 2) in {(t, len(p)) for t, p in site_style_tree.Page(page(0)).all}
    assert site_style_tree.Page("<p>a <span class=share>no</span> b <button>no</button> c").text() == "a b c"


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 16))
    rows = [(i, [float(v) for v in x[i % 50]], i % 2) for i in range(60)]
    rows += [(100, None, 1), (101, [0.0] * 16, 1), (102, [float("nan")] * 16, 1), (103, [None] * 16, 1), (104, [], 1), (105, rows[0][1], None), (106, [1.0, 2.0], 0), (107, [2.0, 4.0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: r for r in rp_forest.near_duplicates(df).collect()}
    assert len(got) == 68
    assert all(got[i].n_links == 1 and got[i].component_id == i % 50 for i in [*range(10), *range(50, 60)])
    assert all(got[i].n_links == 0 and got[i].kept for i in (100, 101, 102, 103, 104, 105)) and got[107].component_id == 106
    assert rp_forest.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_plane_round_trip(kind):
    rng = np.random.default_rng(0)
    docs = [(i if i % 5 else None, rng.integers(0, 2**32, n, dtype=np.uint64).astype("<u4")) for i, n in enumerate([0, 1, 7, 1000, 3, 0, 4096, 9999])]
    for block in (1, 64, 5000):
        if block == 1:
            continue
        back = bitplane.round_trip(docs, kind, block)
        assert [d for d, _ in back] == [d for d, _ in docs] and all((a == b).all() and len(a) == len(b) for (_, a), (_, b) in zip(docs, back))


def test_near_groups_equal_brute_force(spark):
    """A large group of edited copies, some of them linked by way of others only."""
    import random

    import pyarrow as pa

    from lodespar.llm._words import Words, shingles

    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(120)]
    texts = []
    for i in range(150):
        t = list(base if i < 100 else [rng.choice(words) for _ in range(60)])
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    w = Words.of(pa.array(texts))
    row, item, count = shingles(w)
    bags = [dict(zip(item[row == i].tolist(), count[row == i].tolist())) for i in range(len(texts))]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = sum(min(n, bags[j].get(k, 0)) for k, n in bags[i].items())
            if both >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.id: r.component_id for r in bagminhash.deduplicated(docs).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_near_groups_of_a_template(spark):
    """Texts of one template with words of their own, each with an edited copy: similar pairs must not stay apart because their buckets are full of the template."""
    import random

    rng = random.Random(7)
    template = [f"t{i}" for i in range(263)]
    texts = []
    for i in range(100):
        t = template + [f"own{i}x{j}" for j in range(37)]
        copy = list(t)
        for k in rng.sample(range(5, 255, 5), 6):
            copy[k] = f"edit{i}x{k}"
        texts += [" ".join(t), " ".join(copy)]
    bags = [{hash(tuple(w[j : j + 5])) for j in range(296)} for w in map(str.split, texts)]
    similar = {(i, j) for i in range(200) for j in range(i + 1, 200) if len(bags[i] & bags[j]) >= 0.8 * len(bags[i] | bags[j])}
    assert similar == {(i, i + 1) for i in range(0, 200, 2)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.id: r.component_id for r in bagminhash.deduplicated(docs).collect()}
    assert got == {i: i // 2 * 2 for i in range(200)}


def test_prefixes_hold_the_first_common_shingle():
    rng = np.random.default_rng(4)
    common = rng.integers(0, 3, bagminhash.CELLS)
    for _ in range(200):
        items = rng.integers(0, 2**63, 40).astype(np.uint64)
        a, b = rng.integers(1, 4, 40), rng.integers(1, 4, 40)
        b = np.where(rng.random(40) < 0.85, a, b)
        a, b = a * (rng.random(40) < 0.97), b * (rng.random(40) < 0.97)
        row = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        item, count = np.concatenate((items[a > 0], items[b > 0])), np.concatenate((a[a > 0], b[b > 0]))
        at, behind, weight = bagminhash.prefixes(row, item, count, common)
        both = np.minimum(a, b).sum()
        if both >= 0.8 * np.maximum(a, b).sum():
            x, y = ({int(item[k]): (int(s), int(w)) for k, s, w in zip(at, behind, weight) if row[k] == side} for side in (0, 1))
            assert any(min(x[k][0], y[k][0]) >= 0.8 / 1.8 * (x[k][1] + y[k][1]) - 1e-6 for k in x.keys() & y.keys())


def test_components(spark):
    from lodespar.llm._graph import components, joined

    links = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 150), (7, 7)] + [(300, 300 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 150: 100, 200: 100} | {300 + i: 300 for i in range(50)}
    comp = spark.createDataFrame(list(got.items()), "node bigint, component bigint")
    more = {r.node: r.component for r in joined(comp, spark.createDataFrame([(100, 300), (900, 0)], "a bigint, b bigint")).collect()}
    assert more == {k: 100 if v == 300 else v for k, v in got.items()} | {900: 0}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
