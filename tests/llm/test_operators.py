"""The corpus operators against brute force, on small tables with every odd case and on the sf0.01 tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quadrat.llm import embeddings, langid, licences, mixing, ngram_join, packing, queries, spotsigs, substrings, token_counts, warc
from quadrat.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
LINE = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (1, None, "en", None), (2, "", "en", "a"), (3, "  \t\n ", None, "a"), (4, "One", "de", "b"), (5, "one two", "de", "b"), (6, LINE, "en", "b"),
    (7, "Intro words " + LINE + " and an end", "en", "c"), (8, LINE, "en", "c"), (8, LINE, "en", "c"), (9, "12 34 !!", "fr", ""), (10, " ".join(f"v{i % 7}" for i in range(400)), "fr", "d"),
    (11, "漢字 ábc <|endoftext|> <s> cc by, CC-BY. General  Public\nLicense All rights reserved", "fr", "d"), (12, " ".join(f"long{i}" for i in range(30000)), "en", "e"), (8, "another text of one id", "en", "c"),
]
COLUMNS = "doc_id long, text string, lang string, source string"
CLASHING = ("rid", "k", "row", "label", "n", "spans", "copies", "w", "_w", "size", "cid", "n_chars")


@pytest.fixture(scope="module")
def small(spark):
    df = spark.createDataFrame(ROWS, COLUMNS)
    for c in CLASHING:
        df = df.withColumn(c, df["doc_id"] * 2)
    return df.cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS + ", n_chars long")


@pytest.fixture(scope="module")
def real(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


def words(text):
    return WORD.findall(text or "")


def brute_removals(rows, width=35):
    seen = Counter(tuple(w[i : i + width]) for _, t in rows for w in [words(t)] for i in range(len(w) - width + 1))
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [1000, 1])
def test_removals(small, real, none, hot):
    for df in (small, real):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        assert sorted(map(tuple, substrings.removals(df, hot_rows=hot).collect())) == brute_removals(rows)
    assert substrings.removals(none).count() == 0


def test_cut_texts(small, none):
    got = substrings.dedup_text(small)
    assert got.columns == small.columns and got.count() == len(ROWS)
    by = {r.doc_id: r for r in got.where("doc_id <> 8").collect()}
    assert by[6].text == "" and by[7].text == "Intro words and an end" and by[3].text == "  \t\n " and by[1].text is None
    assert by[7].n_chars == len(by[7].text) and by[5].n_chars == 10 and by[5].rid == 10
    assert substrings.dedup_text(none).count() == 0


def test_index_in_batches(spark):
    batch = lambda *fps: spark.createDataFrame([(f,) for f in fps], "fp long")
    index = substrings.FingerprintIndex(spark, fan_in=2)
    assert index.history().count() == 0 and index.seen(batch(1)).count() == 0
    index.append(batch(1, 2, 2, None))
    index.append(batch(3, 4))
    assert [r.fp for r in index.seen(batch(1, 4, 9)).orderBy("fp").collect()] == [1, 4]
    index.append(batch(4, 5))
    assert len(index.runs) == 1
    assert sorted(map(tuple, index.repeated().collect())) == [(2, 2), (4, 2)]


def shingles(text, n=3):
    w = words((text or "").translate(LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)])


def brute_components(rows, percent=90):
    sets = [(i, d, shingles(t)) for i, (d, t) in enumerate(rows)]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, _, a in sets:
        for j, _, b in sets[:i]:
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                o = len(a & b)
                if 100 * o >= percent * (len(a) + len(b) - o):
                    parent[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 60)
    for i, d, _ in sets:
        least[find(i)] = min(least[find(i)], d)
    return sorted((d, len(s), least[find(i)]) for i, d, s in sets)


@pytest.mark.parametrize("hot", [1000, 1])
def test_windows_of_earlier_batches_are_repeats(spark, hot):
    words = lambda a, n: " ".join(f"w{i}" for i in range(a, a + n))
    batch = lambda *texts: spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, rid long")
    index = substrings.FingerprintIndex(spark, fan_in=2)
    spans = lambda b: sorted({(r.rid, r.at + i) for r in substrings.repeated_spans(b, hot_rows=hot, index=index).collect() for i in range(r.n)})
    assert spans(batch(words(0, 60), words(1000, 40))) == []
    assert spans(batch(words(500, 50), words(300, 20) + " " + words(10, 40) + " " + words(700, 20))) == [(1, i) for i in range(20, 26)]
    assert spans(batch(words(2000, 40))) == []
    assert spans(batch(words(505, 40), words(1000, 40))) == [(rid, i) for rid in (0, 1) for i in range(6)]
    assert len(index.runs) == 2


def test_a_table_is_merged_batch_by_batch(spark, small, monkeypatch):
    joined, add = [], substrings.FingerprintIndex.add
    monkeypatch.setattr(substrings.FingerprintIndex, "add", lambda self, *how: joined.append(len(self.runs)) or add(self, *how))
    substrings.removals(small).collect()
    assert joined == [0, 1, 2]


def test_ngram_components(spark, small, real, none):
    rng = np.random.default_rng(1)
    base = [f"b{i}" for i in range(150)]
    near = []
    for i in range(120):
        w = list(base)
        for at in rng.integers(0, 150, rng.integers(0, 4)):
            w[at] = f"x{rng.integers(0, 40)}"
        near.append((i, " ".join(w)))
    for df in (small, spark.createDataFrame(near, "doc_id long, text string")):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        assert sorted(map(tuple, ngram_join.ngram_components(df).collect())) == brute_components(rows)
    assert ngram_join.ngram_components(none).count() == 0
    assert sorted(map(tuple, ngram_join.ngram_components(real).collect())) == brute_components([(r.doc_id, r.text) for r in real.select("doc_id", "text").collect()])


def test_one_of_each(small, none):
    got = ngram_join.one_of_each(small)
    assert got.columns == small.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter([1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12])  # 7 holds all of 6 and little else
    assert ngram_join.one_of_each(none).count() == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {x: x for p in links for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    own = {x for p in links if p[0] != p[1] for x in p}
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {x: find(x) for x in own}
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_languages(small, real, none):
    filters = langid.train(real)
    got = langid.predict(real, filters).join(real.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    odd = {r.doc_id: r for r in langid.predict(small, filters).where("doc_id <> 8").collect()}
    assert [odd[i].lang_pred for i in (1, 2, 3, 9)] == ["und"] * 4 and odd[11].lang_pred != "und"
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in odd.values())
    assert langid.train(none).languages == [] and langid.predict(none, langid.train(none)).count() == 0
    assert {r.lang_pred for r in langid.predict(small, langid.train(none)).collect()} == {"und"}
    kept = langid.keep_known(small, filters)
    assert kept.columns == small.columns and kept.where("doc_id in (1, 2, 3, 9)").count() == 0


def test_token_counts(small, real, none):
    library = token_counts.load(token_counts.model_path()).library
    for df in (small, real):
        rows = df.select("doc_id", "text").collect()
        want = sorted((r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "")), n > 4096) for r in rows)
        assert sorted(map(tuple, token_counts.token_counts(df).collect())) == want
    assert token_counts.token_counts(none).count() == 0
    short = small.where("doc_id < 12 and length(text) < 300 or text is null")
    for r, c in zip(short.orderBy("doc_id", "text").collect(), token_counts.prefix_table(short.orderBy("doc_id", "text")).collect()):
        assert c.counts == [len(library.encode((r.text or "")[:i])) for i in range(len(r.text or "") + 1)]
    assert token_counts.Counter.longest_within(np.array([0, 1, 2, 2, 3]), 2) == 3


def test_mixing(small, real, none):
    for df in (small, real):
        got = mixing.mix_plan(df).toPandas()
        sizes = defaultdict(int)
        for r in df.select("text", "source").collect():
            sizes[r.source] += len(words(r.text))
        names = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: 1 + i % 3 for i, s in enumerate(names)}
        full, total = set(), sum(sizes.values())
        while True:
            level = (total - sum(3 * sizes[s] for s in full)) / max(1, sum(weight[s] for s in names if s not in full))
            if not (more := {s for s in names if s not in full and level * weight[s] > 3 * sizes[s] + 1e-6}):
                break
            full |= more
        target = {s: 3 * sizes[s] if s in full else level * weight[s] for s in names}
        want = sorted((r.doc_id, len(words(r.text)), sizes[r.source], round(target[r.source], 3)) for r in df.select("doc_id", "text", "source").collect())
        assert sorted(zip(got.doc_id, got["size"], got.source_size, got.target.round(3))) == want
        assert (got.taken <= 3 * got["size"]).all()
    source = {r.doc_id: r.source for r in real.collect()}
    by = got.assign(source=got.doc_id.map(source)).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
    assert ((by.taken - by.target).abs() <= 1.5 * by.most).all()
    assert got.equals(mixing.mix_plan(real).toPandas().set_index("doc_id").loc[got.doc_id].reset_index())
    assert mixing.mix_plan(none).count() == 0
    mixed = mixing.mix(small)
    assert mixed.columns == small.columns
    plan = mixing.mix_plan(small).where("doc_id = 12").first()
    assert mixed.where("doc_id = 12").count() * plan["size"] == plan.taken


def test_spotsigs(small, real, none):
    for df in (small, real):
        rows = sorted({(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()}, key=lambda r: r[0])
        if df is small:
            rows = [r for r in rows if r[0] != 8]
        got = {r.doc_id: r for r in spotsigs.edited_fingerprints(df.where("doc_id <> 8") if df is small else df).collect()}
        prints = {}
        for i, (d, t) in enumerate(rows):
            t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
            half = len(t) // 2
            edited = t[: len(t) - half] + after[:half]
            assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert prints.setdefault(t, got[d].fingerprint) == got[d].fingerprint
            a, b, c = (set(x.split()) for x in (got[d].fingerprint, got[d].edited_fingerprint, got[rows[(i + 1) % len(rows)][0]].fingerprint))
            like = lambda x, y: 1.0 if not x and not y else len(x & y) / len(x | y)
            assert got[d].near_edited == pytest.approx(like(a, b)) and got[d].near_next == pytest.approx(like(a, c))
    assert spotsigs.edited_fingerprints(small).count() == len(ROWS)
    assert spotsigs.edited_fingerprints(none).count() == 0


def test_spotsig_pairs(spark, real):
    some = real.where("doc_id < 300")
    sigs = {r.doc_id: frozenset(r.s) for r in spotsigs.with_signatures(some, "text", "s").collect()}
    least = {}
    for d in sorted(sigs):
        least.setdefault(sigs[d], d)
    reps = sorted((d, s) for s, d in least.items() if s)
    want = {(a, b) for i, (a, x) in enumerate(reps) for b, y in reps[i + 1 :] if len(x & y) >= 0.8 * len(x | y) - 1e-9}
    assert {(r.x, r.y) for r in spotsigs.near_pairs(some).collect()} == want


def test_licences(small, real, none):
    for df in (small, real):
        got = defaultdict(list)
        for r in licences.scan(df).collect():
            got[r.doc_id].append(tuple(r)[1:6])
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        want = defaultdict(list)
        for r in df.select("doc_id", "text").collect():
            w = licences.plain_words(r.text)
            at = [(i, label) for label, p in licences.BASE for p in [p.split()] for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            want[r.doc_id].append((len(w), len(at), min((a for a, _ in at), default=None), max((a for a, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
        key = lambda v: sorted(v, key=str)
        assert {k: key(v) for k, v in got.items()} == {k: key(v) for k, v in want.items()}
    assert licences.scan(none).count() == 0
    # every block of a template's length, by brute force
    rows = {r.doc_id: set(r.labels.split(",")) for r in licences.scan(real).collect()}
    blocks = {r.doc_id: set(r.block_labels.split(",")) - {""} for r in licences.scan(real).collect()}
    for r in real.select("doc_id", "text").collect():
        w = licences.plain_words(r.text)
        met, whole = defaultdict(list), set()
        for label, must, text in licences.TEMPLATES:
            t, own, must = len(text.split()), set(text.split()), set(must.split())
            whole |= {label for i in range(max(1, len(w) - t + 1)) if len(set(w[i : i + t]) & own) >= 0.8 * len(own) - 1e-9}
            met[label] += [(i, i + t) for i in range(max(1, len(w) - t + 1)) for b in [set(w[i : i + t]) & own] if len(b) >= 0.8 * len(own) - 1e-9 and must <= b]
        for label, found in met.items():
            others = [x for o in licences.GIVES_WAY.get(label, ()) for x in met[o]]
            found[:] = [x for x in found if not any(o[0] < x[1] and x[0] < o[1] for o in others)]
        assert {k for k, v in met.items() if v} == rows[r.doc_id] - {k for k, _ in licences.BASE} - {""}, r.doc_id
        assert whole == blocks[r.doc_id], r.doc_id


def test_warc(spark, sf, tmp_path):
    html = ["<p>a</p>", None, "", "ü" * 5000, "<p>a</p>", "<p>b\r\n\r\nWARC/1.1</p>", "<p>a</p>"]
    pages = spark.createDataFrame([(i, f"http://x/{i}\n", h) for i, h in enumerate(html)], "page_id long, url string, html string").unionByName(spark.read.parquet(f"{sf}/pages.parquet").selectExpr("page_id + 100 as page_id", "url", "html"))
    rows = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    largest = {}
    for k in sorted(rows):
        largest[rows[k]] = k
    want = sorted((k, len(b), warc.payload_digest(b), "response" if largest[b] == k else "revisit", None if largest[b] == k else largest[b]) for k, b in rows.items())
    for split in (warc.SPLIT_BYTES, 700):
        assert sorted(map(tuple, warc.round_trip(pages, split_bytes=split).collect()), key=lambda r: r[0]) == want
    files = warc.write_archives(pages, f"file://{tmp_path}/w")
    texts = {r.page_id: r.payload for r in warc.read_archives(files, payloads=True).where("record_type = 'response'").collect()}
    assert all(rows[k] == t.encode() for k, t in texts.items())
    assert warc.round_trip(pages.limit(0)).count() == 0
    twice = pages.where("page_id = 5")
    assert [r.record_type for r in warc.round_trip(twice.unionByName(twice)).collect()] == ["response"] * 2


def brute_near(rows, cosine=0.9):
    ok = [(i, np.array(v, float) / np.abs(np.array(v, float)).max()) for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, parent = Counter(), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(ok):
        for j, b in ok[:n]:
            if len(a) == len(b) and (a / np.linalg.norm(a)) @ (b / np.linalg.norm(b)) >= cosine:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 60)
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], d)
    return sorted((d, links[i], least[find(i)], least[find(i)] == d) for i, (d, _) in enumerate(rows))


def test_embeddings(spark, sf):
    rng = np.random.default_rng(4)
    c = rng.standard_normal(16)
    v = [(i, (c + 0.05 * rng.standard_normal(16)).tolist()) for i in range(60)] + [(100 + i, rng.standard_normal(16).tolist()) for i in range(200)]
    v += [(400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] + [1.0] * 15), (404, [None] + [1.0] * 15), (405, v[3][1]), (406, v[3][1]), (407, [2.0]), (408, [3.0]), (409, [1e300] * 16), (410, [1e-300] * 16), (411, [float("inf")] * 16)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, embeddings.near_duplicates(df).collect())) == brute_near(v)
    real = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert sorted(map(tuple, embeddings.near_duplicates(real).collect())) == brute_near([(r.vec_id, list(r.embedding)) for r in real.collect()])
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_cap_recall_at_the_threshold():
    rng = np.random.default_rng(6)
    a = rng.standard_normal((400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((400, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
    shared = [len(np.intersect1d(x, y)) > 0 for x, y in zip(embeddings.decode(a, 64, 0.9), embeddings.decode(b, 64, 0.9))]
    assert np.mean(shared) > 0.97


@pytest.mark.parametrize(("dim", "k"), [(2, 64), (8, 64), (16, 64), (16, 1024), (32, 1024), (64, 256), (64, 4096), (256, 1024), (768, 1024)])
def test_cap_recall_holds_for_every_k_and_dimension(dim, k):
    rng = np.random.default_rng(8)
    a, b = rng.standard_normal((2, 400, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
    shared = [len(np.intersect1d(x, y)) > 0 for x, y in zip(embeddings.decode(a, k, 0.9), embeddings.decode(b, k, 0.9))]
    assert np.mean(shared) > 0.98


def test_long_lists_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 20)
    rng = np.random.default_rng(7)
    c = rng.standard_normal(8)
    v = [(i, (c + 0.2 * rng.standard_normal(8)).tolist()) for i in range(120)]
    assert sorted(map(tuple, embeddings.near_duplicates(spark.createDataFrame(v, "vec_id long, embedding array<double>")).collect())) == brute_near(v)


def test_packing(small, real, none):
    library = packing.text_ids(str(__import__("public_tokenizers").path(packing.TOKENIZER))).library
    for df in (small.where("doc_id <> 8"), real):
        got = packing.pack(df).toPandas()
        ids = {r.doc_id: np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in df.select("doc_id", "text").collect()}
        done = defaultdict(int)
        for r in got.sort_values(["doc_id", "start"]).itertuples():
            own = ids[r.doc_id]
            assert r.start == done[r.doc_id] and r.doc_tokens == len(own) and 0 < r.length <= 2048
            assert zlib.crc32(own[r.start : r.start + r.length].tobytes()) == r.ids_crc32
            done[r.doc_id] += r.length
        assert done == {k: len(v) for k, v in ids.items()}
        used = defaultdict(int)
        for r in got.sort_values(["sequence_id", "offset"]).itertuples():
            assert r.offset == used[r.sequence_id]
            used[r.sequence_id] += r.length
        assert max(used.values()) <= 2048
    assert sum(used.values()) / (2048 * len(used)) > 0.98
    assert packing.pack(none).count() == 0


def test_first_fit_decreasing():
    rng = np.random.default_rng(8)
    lengths = rng.integers(1, 101, 300)
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    room, where = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        b = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
        if b == len(room):
            room.append(100)
        where[i] = (b, 100 - room[b])
        room[b] -= lengths[i]
    assert where == {i: (bins[i], offsets[i]) for i in range(300)}


def test_every_query_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))
