"""Edge cases and brute-force versions of the document operators."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from framewright.llm import langid, mixing, packing, pii, simhash, token_counts, toxicity
from framewright.llm.exact_dedup import drop_exact_copies, exact_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sha string, mix_key int, near_dup_of int, rn int"
LONG = "lorem ipsum dolor " * 12_000


def edge_rows():
    base = "The quick brown fox jumps over the lazy dog and then runs far away from the angry bear in the old wood by the river"
    words = base.split()
    near = " ".join(words[:-1] + ["lake"])
    texts = [base, base, " " + base + "\n", near, None, "", "   \t\n", "a", "a", "12345 !!", LONG, LONG, "Ein kleiner Text über Straßen", "北京 is 北京", "x" * 5000, "one two three", "one two three four"]
    rows = [(i, t, ("en", "de", None)[i % 3], ("s1", "s2", None)[i % 3], None, "clash", 1, 2, 3) for i, t in enumerate(texts)]
    return rows + [(None, base, None, None, None, None, None, None, None), (0, base, "en", "s1", None, None, None, None, None), (0, base, "en", "s1", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def strip(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_dedup_against_brute_force(docs, empty):
    got = exact_dedup(docs).collect()
    groups = defaultdict(list)
    for r in edge_rows():
        groups[strip(r[1])].append((-len(r[1] or ""), r[0] is None, r[0]))
    assert len(got) == len(edge_rows())
    kept = defaultdict(int)
    for g in got:
        norm = next(n for n in groups if hashlib.sha256(n.encode()).hexdigest() == g.text_sha256)
        best = min(groups[norm], key=lambda x: (x[0], x[1], x[2] if x[2] is not None else 0))
        assert (g.keep_id, g.group_size) == (best[2], len(groups[norm]))
        kept[norm] += g.kept
    assert all(n == 1 for n in kept.values()) and len(kept) == len(groups)
    assert exact_dedup(empty).count() == 0


def test_drop_exact_copies_keeps_columns_and_one_row(docs, empty):
    out = drop_exact_copies(docs)
    assert out.columns == docs.columns
    texts = [strip(r.text) for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({strip(r[1]) for r in edge_rows()})
    assert drop_exact_copies(empty).count() == 0


def test_near_duplicates_against_brute_force(docs, empty):
    classes, links = simhash.near_duplicates(docs)
    got = {(r.doc_id, r.class_id) for r in classes.collect()}
    s = simhash.Shingler()
    sets = {r[0]: set(s.hashes(r[1]).tolist()) for r in edge_rows() if r[0] is not None}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    assert got == {(i, root[i]) for i in sets} | {(None, None)}
    assert classes.count() == len(edge_rows())
    assert root[3] == 0 and root[4] == 4 and root[5] == 5
    assert all(r.jaccard >= 0.8 for r in links.collect())
    assert simhash.near_duplicates(empty)[0].count() == 0
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {i for i in sets if root[i] == i} | {None}


def test_language_id(spark, docs, empty):
    out = {(r.doc_id, r.lang_pred, r.held_out) for r in langid.identify(docs).collect()}
    by = defaultdict(set)
    for i, lang, held in out:
        by[i].add((lang, held))
    for i in (4, 5, 6, 9):
        assert {x for x, _ in by[i]} == {"und"}
    assert all(held == (i is None or zlib.crc32(str(i).encode()) % 5 == 0) for i, _, held in out)
    assert langid.identify(empty).count() == 0
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    scores = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, (lang, score) in scores.items() if lang != "und" and score >= langid.LEAST}


def test_identified_languages_are_filled_in_and_corrected(spark):
    """Labels that are missing or plainly wrong become the predicted ones, doubtful predictions change nothing, undecided texts go; all else stays."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    spoilt = d.withColumn("lang", F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 50 == 1, F.lit("es")).otherwise(F.col("lang")))
    spoilt = spoilt.unionByName(spark.createDataFrame([(-1, "12 -- 34", None, None, 8)], d.schema))
    out = {r.doc_id: r.lang for r in langid.keep_identified(spoilt).collect()}
    true = {r.doc_id: r.lang for r in d.collect()}
    assert set(out) == set(true)
    assert np.mean([out[i] == true[i] for i in true if i % 7 == 0]) > 0.95 and np.mean([out[i] == true[i] for i in true]) > 0.97
    none = langid.keep_identified(spoilt, least=1.1)
    assert none.count() == 0


def slow_features(text):
    """Character n-grams of the lowered text, letters alone, everything else one zero."""
    c = [ord(x) if ord(x) >= 0x3000 or x.isalpha() else 0 for x in text.lower()]
    c = [0] + [x for i, x in enumerate(c) if x or i == 0 or c[i - 1]] + [0]
    out, at = np.zeros(sum(langid.BUCKETS)), 0
    for n, m in enumerate(langid.BUCKETS):
        count = Counter()
        for i in range(len(c) - n):
            h = c[i]
            for k in range(1, n + 1):
                h = (h * 0x9E3779B1 + c[i + k]) % 2**64
            h = ((h ^ (h >> 15)) * 0x85EBCA6B) % 2**64
            count[(h ^ (h >> 13)) % m] += 1
        for b, k in count.items():
            out[at + b] = (k / sum(count.values())) ** 0.5
        at += m
    return out


def test_language_votes_against_a_slow_version(spark):
    """Family by the best of its machines, then every pair inside it votes; with codes that no family lists."""
    r = np.random.default_rng(2)
    alphabet = {"en": "abcde", "de": "cdefg", "fr": "klmno", "es": "mnopq", "xx": "uvwxy", "yy": "wxyzu", "zz": "hijab"}
    make = lambda c: " ".join("".join(r.choice(list(alphabet[c]), 4)) for _ in range(30))
    langs = [c for c in alphabet for _ in range(12)]
    model = langid.HierarchicalModel([make(c) for c in langs], langs)
    assert len(model.pairs) == 5 and "unlisted" in model.families
    texts = [make(c) for c in langs] + ["abc uvw klm", "é ab\u4e2d\u6587 x", "a"]
    got, score = model.predict(texts)
    for k, t in enumerate(texts):
        margin = slow_features(t) @ model.w[:-1] + model.w[-1]
        n = len(model.families)
        e = np.exp(4 * (margin[:n] - margin[:n].max()))
        f = int(e.argmax())
        votes = {i: 0.0 for i in model.members[f]}
        for (a, b), m in zip(model.pairs, margin[n:]):
            if a in votes:
                p = 1 / (1 + np.exp(-4 * np.clip(m, -20, 20)))
                votes[a] += p
                votes[b] += 1 - p
        best = max(votes, key=votes.get)
        share = votes[best] / (len(votes) - 1) if len(votes) > 1 else 1.0
        assert got[k] == model.langs[best] and abs(score[k] - e[f] / e.sum() * share) < 1e-4
    assert np.mean([a == b for a, b in zip(got, langs)]) > 0.9


def test_language_id_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out and lang_pred != 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert r[0] > 0.95 and 0 <= r[1] <= r[2] <= 1


def test_pii_base_spans_equal_the_patterns(docs, empty):
    pats = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    digits = lambda s: re.sub("[^0-9]", "", s)
    ok = [lambda s: True, lambda s: all(int(p) <= 255 for p in s.split(".")), lambda s: 12 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), lambda s: 9 <= len(digits(s)) <= 15]
    r = np.random.default_rng(0)
    alphabet = list("0123456789.@-+() ab\n")
    for _ in range(3000):
        t = "".join(r.choice(alphabet, int(r.integers(0, 60))))
        want = sorted((m.start(), k, m.end()) for k, p in enumerate(pats) for m in re.finditer(p, t) if ok[k](m[0]))
        assert pii.base_spans(t) == want, t
    assert pii.base_spans("9" * 100_000 + "a" * 100_000) == []
    model = pii.Tagger()  # untrained: only the base spans count here
    rows = pii.digest(pii.detect_pii(docs, model)).collect()
    assert len(rows) == len(edge_rows()) and pii.detect_pii(empty, model).count() == 0
    assert next(r for r in rows if r.doc_id == 4).base_sha256 == hashlib.sha256(b"").hexdigest()


def test_packing_is_exact(spark, docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    for d, with_ids in ((docs, True), (docs, False), (spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), False)):
        rows = packing.pack_documents(d, path, with_ids=with_ids).collect()
        want = defaultdict(int)
        for r in d.select("doc_id", "text").collect():
            ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
            want[(r.doc_id, tuple(ids))] += 1
        by_seq, by_doc = defaultdict(list), defaultdict(list)
        for r in rows:
            by_seq[r.sequence_id].append((r.offset, r.length))
            by_doc[r.doc_id].append(r)
        for pieces in by_seq.values():
            pieces.sort()
            assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))] and sum(n for _, n in pieces) <= 2048
        for (doc, ids), n in want.items():
            same = [r for r in by_doc[doc] if r.doc_tokens == len(ids)]
            assert sum(r.length for r in same) == n * len(ids)
            for r in same:
                part = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
                assert r.ids_crc32 == zlib.crc32(part)
                if with_ids:
                    assert bytes(r.ids) == part
        used = sum(r.length for r in rows)
        assert 1 - used / (2048 * len(by_seq)) < 0.05
    assert packing.pack_documents(empty, path).count() == 0


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["hello <|endoftext|> world", "a<|endoftext|>b <|EndOfText|> <|endof text|>\n<|startoftext|>it's", "It's I'LL 'tis a\tb\x0bc\rd  e", "Ünïcode ŒUVRE straße ΑΣ İstanbul é  x\x85y ½²١", "<|endoftext|> a<|startoftext|>b", "😀👍🏽 a​b Ǆ ǅ ﬁ", "\x1c\x1d a\x1fb", "3.14,15-92", LONG[:2000], ""]
    for as_text in (False, True):
        tok = Tokenizer.from_file(path)
        if as_text:
            tok.encode_special_tokens = True
        for t, raw in zip(texts, packing.CachedEncoder(path, special_as_text=as_text).encode_batch(texts)):
            assert np.frombuffer(raw, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_token_counts_against_plain_dynamic_programming(docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    v = token_counts.load_vocabulary(path)

    def plain(word):
        w, best = token_counts.MARK + word, [(0.0, 0)]
        for i in range(1, len(w) + 1):
            c = [(v.pieces[w[i - n : i]] + best[i - n][0], best[i - n][1] + 1) for n in range(1, min(i, v.longest) + 1) if w[i - n : i] in v.pieces]
            n = len(w[i - 1].encode())
            c.append((best[i - 1][0] + n * v.byte_score, best[i - 1][1] + n))
            top = max(x[0] for x in c)
            best.append((top, min(n for s, n in c if s >= top)))
        return best[-1]

    words = ["", "the", "there", "therefore", "北京", "é😀x", "a" * 700, "Straße", "ththththe", "the"[::-1]]
    n, s, nodes = token_counts.trie_counts(words, v)
    assert [(round(b, 9), a) for a, b in zip(n.tolist(), s.tolist())] == [(round(p[0], 9), p[1]) for p in map(plain, words)]
    assert nodes < sum(len(w) + 1 for w in words)  # prefixes are shared
    rows = {(r.doc_id, r.n_pretokens, r.n_tokens) for r in token_counts.token_counts(docs, path).collect()}
    assert {(4, 0, 0), (5, 0, 0), (6, 0, 0)} <= rows and (15, 3, sum(plain(w)[1] for w in ("one", "two", "three"))) in rows
    assert token_counts.token_counts(empty, path).count() == 0


def test_mixing_against_plain_arithmetic(spark, docs, empty):
    for d in (docs, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        rows = mixing.taken_words(mixing.mix_schedule(d, block_words=64)).collect()
        src = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in d.select("doc_id", "source", "text").collect()]
        assert sorted((str(r.doc_id), r.source or "", r.size) for r in rows) == sorted((str(i), s or "", n) for i, s, n in src)
        size = defaultdict(int)
        for _, s, n in src:
            size[s] += n
        names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
        weight = {s: 1 + i % 3 for i, s in enumerate(names)}
        target, open_, left = {}, set(names), sum(size.values())
        while True:
            level = left / sum(weight[s] for s in open_)
            full = [s for s in open_ if weight[s] * level > 3 * size[s]]
            if not full:
                break
            for s in full:
                target[s], left = 3.0 * size[s], left - 3 * size[s]
                open_.discard(s)
        target |= {s: weight[s] * level for s in open_}
        taken = defaultdict(int)
        for r in rows:
            assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source] and 0 <= r.taken <= 3 * r.size
            taken[r.source] += r.taken
        assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-6 for s in names)
    assert mixing.mix_schedule(empty).count() == 0
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and mixing.mixed_documents(empty).count() == 0


def test_mixing_schedule_is_interleaved_and_repeatable(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a = mixing.mix_schedule(d, block_words=256).filter("slot is not null").select("source", "slot", "epoch", "doc_id", "start_word", "n_words")
    b = mixing.mix_schedule(d.repartition(7), block_words=256).filter("slot is not null").select(*a.columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    slots = a.select("slot", "source").distinct()
    assert slots.count() == slots.select("slot").distinct().count()  # one source to a slot
    # Any stretch of the schedule holds each source in about its share.
    n = slots.count()
    for row in slots.groupBy("source").agg(F.count("*").alias("n"), F.sum((F.col("slot") < n / 2).cast("int")).alias("early")).collect():
        assert abs(row.early - row.n / 2) <= 6


def test_toxicity(spark, docs, empty):
    r = np.random.default_rng(1)
    bad, good = ["scum", "moron", "idiot"], [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        words = list(r.choice(good, 40))
        if toxic:
            words[int(r.integers(40))] = str(r.choice(bad))
        rows.append((i, " ".join(words), "en", "s", 0, "", 0, 0, 0))
        labels.append((i, 1, int(toxic)))
    d, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (None, 1, 1), (5, None, None), (10_000, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(d, lab)
    out = toxicity.score_toxicity(d, lab, model).join(lab.filter("toxic is not null"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in out]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    edge = toxicity.score_toxicity(docs, lab, model).collect()
    assert len(edge) == len(edge_rows()) and len({r.score for r in edge if r.doc_id in (4, 5, 6)}) == 1
    assert toxicity.score_toxicity(empty, lab.limit(0)).count() == 0


def test_near_duplicates_in_a_large_boilerplate_cluster(spark):
    """20,000 documents that share half their shingles, 5,000 of them with a partner at Jaccard 0.80: every pair of a bucket is found."""
    r = np.random.default_rng(3)
    shared = " ".join(f"common{i}" for i in range(40))
    rows = []
    for k in range(15_000):
        own = [f"w{x}" for x in r.integers(0, 10**9, 36)]
        rows.append((k, f"{shared} {' '.join(own)}"))
        if k < 5_000:
            rows.append((100_000 + k, f"{shared} {' '.join(own[:-8])} {' '.join(f'w{x}' for x in r.integers(0, 10**9, 8))}"))
    links = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))[1]
    s, order = simhash.Shingler(), simhash.sampled_order(simhash.plan_tables(20_000)[0])[:, : simhash.BASE_BITS]
    bits = {k: np.unpackbits(np.frombuffer(simhash.fingerprint(s.hashes(t)), np.uint8)) for k, t in rows if k % 100_000 < 5_000}
    differ = {k: bits[k] != bits[100_000 + k] for k in range(5_000)}
    want = {(k, 100_000 + k) for k, d in differ.items() if d.sum() <= simhash.max_distance() and (~d[order].any(axis=1)).any()}
    # Dense buckets are compared whole, so pairs that share no bucket may be found too.
    got = {(x.a, x.b) for x in links.collect()}
    assert len(rows) == 20_000 and want <= got <= {(k, 100_000 + k) for k in range(5_000)}
    assert len(want) / 5_000 > 0.98


def test_mixed_documents_counts_rows_with_null_or_repeated_identifiers(spark):
    """Each row comes as often as its own share of the schedule says, whatever others share its identifier."""
    rows = [(None if i % 2 else 7, " ".join(f"{s}{i}x{j}" for j in range(20 + i)), s) for s in "abc" for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    want = Counter()
    for r in mixing.taken_words(mixing.mix_schedule(d, block_words=64)).collect():
        want[r.doc_id, r.source, r.size] += int(r.taken / r.size + 0.5)
    got = Counter((r.doc_id, r.source, len(r.text.split())) for r in mixing.mixed_documents(d, block_words=64).collect())
    assert got == +want and len(+want) < len(rows) and max(want.values()) > 1


def test_keep_identified_without_a_labelled_row(docs):
    """No label at all, or only held-out ones: documents with letters stay."""
    want = sorted((r[0] is None, r[0] or 0) for r in edge_rows() if langid.has_letter(r[1]))
    for d in (docs.withColumn("lang", F.lit(None).cast("string")), docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.col("lang")))):
        kept = langid.keep_identified(d)
        assert kept.columns == docs.columns
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == want
