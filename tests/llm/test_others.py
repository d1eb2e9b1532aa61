"""Embeddings, components, WARC, the pipeline and the registered queries."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framewright.llm import embed_dedup, warc
from framewright.llm.components import connected_components
from framewright.llm.queries import ORACLES, QUERIES


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 1), (10, 11), (11, 12), (5, 5), (None, 4), (4, None)] + [(100 + i, 101 + i) for i in range(60)] + [(200, i) for i in range(300, 360)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 1 for i in (1, 2, 3)} | {i: 10 for i in (10, 11, 12)} | {i: 100 for i in range(100, 161)} | {200: 200} | {i: 200 for i in range(300, 360)}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [16, 2048])
def test_embedding_links_against_brute_force(spark, block):
    r = np.random.default_rng(3)
    centers = r.standard_normal((25, 12))
    x = np.concatenate([c + 0.12 * r.standard_normal((n, 12)) for c, n in zip(centers, [1, 2, 3, 40] * 7)]).astype(np.float32)
    rows = [(i, v.tolist(), i % 3, 1) for i, v in enumerate(x)]
    n = len(rows)
    rows += [(n, rows[0][1], 0, 1), (n + 1, None, 0, 1), (n + 2, [0.0] * 12, 0, 1), (n + 3, [float("nan")] * 12, 0, 1), (n + 4, [None] + [1.0] * 11, 0, 1), (n + 5, [1.0, 2.0], 0, 1), (n + 6, [], 0, 1), (0, rows[0][1], 0, 1), (None, rows[0][1], 0, 1), (n + 7, [float("inf")] * 12, 0, 1)]
    got = embed_dedup.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, weight int").repartition(5), block=block, axes=4).collect()
    assert len(got) == len(rows)
    y = np.concatenate([x, x[:1]]).astype(np.float64)
    u = y / np.linalg.norm(y, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    a, b = np.nonzero(link)
    root = embed_dedup.roots(a, b, n + 1)
    for g in got:
        if g.vec_id is None:
            assert g.n_links == 0
        elif g.vec_id <= n:
            assert (g.n_links, g.component_id, g.kept) == (link[g.vec_id].sum(), root[g.vec_id], root[g.vec_id] == g.vec_id), g
        else:
            assert (g.n_links, g.component_id, g.kept) == (0, g.vec_id, True)


def test_vectors_of_every_dimension_link(spark):
    """Three dimensions, the vectors of the rarest among them, as 4-byte and as 8-byte floats; small blocks and intervals, so that sequences are cut."""
    r = np.random.default_rng(8)
    vectors = [v for d, n in ((2, 3), (3, 90), (40, 60)) for c in range(n) for v in [r.standard_normal(d)] for v in (v, v + 0.05 * r.standard_normal(d), 1e-200 * v)]
    vectors += [np.array([1.0, 0.0]), np.array([1.0, 0.01]), np.array([5.0]), np.array([0.25]), np.array([-1.0])]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    unit = [v / np.abs(v).max() for v in vectors]
    unit = [v / np.linalg.norm(v) for v in unit]
    a, b = np.array([(i, j) for i, x in enumerate(unit) for j, y in enumerate(unit) if i != j and len(x) == len(y) and x @ y >= 0.95]).T
    links, root = np.bincount(a, minlength=len(rows)), embed_dedup.roots(a, b, len(rows))
    for options in ({}, {"block": 8, "interval": 32, "axes": 2}, {"sample": 3, "block": 5, "interval": 64}):
        out = embed_dedup.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), **options).collect()
        assert {(g.vec_id, g.n_links, g.component_id) for g in out} == {(i, links[i], root[i]) for i in range(len(rows))}
    assert links[len(rows) - 4] >= 1


def test_ranges_hold_every_near_pair_of_boxes():
    r = np.random.default_rng(0)
    x = np.sort(r.random((200, 1)) * 30, axis=0)
    lo, hi = x[::4], x[3::4]
    near = {(i, j) for i in range(50) for j in range(i, 50) if max(0, lo[j, 0] - hi[i, 0], lo[i, 0] - hi[j, 0]) ** 2 <= 0.3}
    got = [(i, j) for i0, i1, j0, j1 in embed_dedup.near_ranges((lo, hi), None, 0.3, leaf=2) for i in range(i0, i1) for j in range(j0, j1) if i <= j]
    assert near <= set(got) and len(got) == len(set(got)) < 50 * 51 / 4
    got = [(i, j) for i0, i1, j0, j1 in embed_dedup.near_ranges((lo[:20], hi[:20]), (lo[20:], hi[20:]), 0.3) for i in range(i0, i1) for j in range(j0, j1)]
    assert {(i, j - 20) for i, j in near if i < 20 <= j} <= set(got)


def test_embedding_links_of_nothing(spark):
    assert embed_dedup.embedding_links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert embed_dedup.embedding_links(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect()[0].component_id == 1


PAGES = [
    (1, "http://a.example/x/", "<html lang=fr><head><title>T &amp; t</title><style>p{}</style><script>var a='</p>';</script></head><body><!-- c --><p>Un<b>deux</b>&nbsp;trois<br>quatre<a href='../y?z=1'>l</a></body></html>", 9),
    (2, None, None, 9),
    (3, "http://b.example/", "", 9),
    (4, "http://[bad", "<p>open <a href=\"http://[x\">q</a> 1 < 2 <!-- never ends", 9),
    (5, "http://c.example/", "<p title=\"a > b\">x</p>" + "<script>" + "y" * 100_000, 9),
    (None, "http://d.example/", "<" * 20_000, 9),
    (1, "http://a.example/x/", "<html lang=fr>", 9),
]


def test_warc_derivatives(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, block int")
    src = warc.responses(pages)
    out = warc.derive(src).collect()
    assert len(out) == 2 * len(PAGES)
    ids = {r.record_id for r in src.collect()}
    assert {r.refers_to for r in out} == ids
    by = {(r.warc_type, r.refers_to): r for r in out}
    first = src.filter("page_id = 1").orderBy(F.desc("content_length")).first()
    meta, conv = by["metadata", first.record_id], by["conversion", first.record_id]
    assert (meta.concurrent_to, conv.concurrent_to) == (conv.record_id, meta.record_id)
    assert bytes(conv.block).decode() == "Undeux trois\nquatrel"
    text = bytes(meta.block).decode()
    assert "title: T & t\r\n" in text and "language: fr\r\n" in text and "outlink: http://a.example/y?z=1\r\n" in text
    assert f"source-payload-digest: {first.payload_digest}" in text and conv.source_payload_digest == first.payload_digest
    assert "Content-Type: text/html" in conv.source_headers
    for r in out:
        assert r.block_digest == warc.digest(bytes(r.block)) and r.content_length == len(r.block)
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, block int")
    src = warc.responses(pages)
    for compress in (True, False):
        folder = str(tmp_path / f"w{compress}")
        stats = warc.write_warc(src.coalesce(2), folder, compress).collect()
        assert sum(r.records for r in stats) == len(PAGES)
        back = warc.read_warc(spark, folder)
        cols = ["record_id", "block", "block_digest", "payload_digest", "content_length", "warc_date"]
        assert sorted(map(str, back.select(*cols).collect())) == sorted(map(str, src.select(*cols).collect()))
    whole = b"".join(warc.serialise(r.asDict()) for r in src.collect())
    assert len(list(warc.parse_warc(gzip.compress(whole)))) == len(PAGES)
    with pytest.raises(ValueError):
        list(warc.parse_warc(whole[:-40]))


def test_every_query_is_named_once():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)


def test_pipeline_stages(spark):
    """Each stage on what the one before kept, against plain Python."""
    import re

    import public_tokenizers
    from framewright.llm.langid import has_letter
    from framewright.llm.simhash import Shingler

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.createDataFrame([(90_001, "123 456", "en", "src1", 7), (90_002, None, None, None, None), (90_003, "", "en", "src1", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "mix", "pack"]
    rows = {r.doc_id: r.text for r in docs.collect()}
    out = corpus_pipeline.STAGES[0][1](spark, docs, sf).cache()
    assert out.columns == columns and {r.doc_id for r in out.collect()} == {i for i, t in rows.items() if has_letter(t)}
    rows = {r.doc_id: r.text for r in out.collect()}
    nxt = corpus_pipeline.STAGES[1][1](spark, out, sf).cache()
    groups = {}
    for i, t in rows.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i))
    assert nxt.columns == columns and {r.doc_id for r in nxt.collect()} == {min(g)[1] for g in groups.values()}
    rows = {r.doc_id: r.text for r in nxt.collect()}
    near = corpus_pipeline.STAGES[2][1](spark, nxt, sf).cache()
    s, root = Shingler(), {i: i for i in rows}
    sets = {i: set(s.hashes(t).tolist()) for i, t in rows.items()}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    assert near.columns == columns and {r.doc_id for r in near.collect()} == {i for i in root if root[i] == i}
    mixed = corpus_pipeline.STAGES[3][1](spark, near, sf).cache()
    assert mixed.columns == columns
    copies = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert set(copies) <= {r.doc_id for r in near.collect()} and max(copies.values()) <= 3
    packed = corpus_pipeline.STAGES[4][1](spark, mixed, sf)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    want = sum(n * (len(tok.encode(rows[i], add_special_tokens=False).ids) + 1) for i, n in copies.items())
    assert packed.agg(F.sum("length")).first()[0] == want


def test_pipeline_runs_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
