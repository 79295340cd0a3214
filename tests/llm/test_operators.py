"""Each operator against a brute-force version, on small fixtures and on cases with nulls, ties, repeats and clashing names."""

import gzip
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import codec, embeddings, html_text, induced, mixing, ngram_join, packing, quality, suffix_dedup, token_counts, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, row string, size string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh\u00e9", k=rng.randint(1, 8))) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    passage = text(90)
    base = [text(rng.randint(1, 300)) for _ in range(50)]
    near = [" ".join(w if rng.random() > 0.01 else "x" for w in t.split(" ")) for t in base[:20]]
    shared = [f"{text(40)} {passage} {text(30)}" for _ in range(12)]
    odd = [None, "", " \n\t ", "a", "A b c d", "a B c d", "x | y\nx | y\nz", base[0].upper(), "caf\u00e9\u00a0#1 " * 30, "ab" * 3000]
    texts = [*base, *near, *shared, *odd, base[3], base[3]]
    out = [(i, t, rng.choice(["en", None]), rng.choice(["s1", "s2", "\u00e9", None]), 1, "k", "r", "s") for i, t in enumerate(texts)]
    return [*out, out[0]]  # a repeated row


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_suffix_arrays():
    rng = np.random.default_rng(3)
    for n in range(1, 80):
        text = np.append(np.tile(rng.integers(1, 4, max(1, n // 3)), 3), 0)
        order = induced.suffix_array(text)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
        found = induced.common_prefixes(text, order, len(text))
        for a, b in zip(order, order[1:], strict=False):
            same = 0
            while text[a + same] == text[b + same]:
                same += 1
            assert found[b] == same


@pytest.mark.parametrize("length", [40, 400])
def test_repeats(docs, rows, empty, length):
    got = suffix_dedup.removed_repeats(docs, length).collect()
    want, passages = (brute.repeats([r[:2] for r in rows], n) for n in (length, min(length, suffix_dedup.PASSAGE)))
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)
    assert sorted((r.doc_id, r.n_bytes - r.n_kept, r.n_repeated) for r in got) == sorted((w[0], w[2], p[2]) for w, p in zip(want, passages, strict=True))
    assert suffix_dedup.removed_repeats(empty).count() == 0
    assert suffix_dedup.drop_repeats(docs).columns == docs.columns


def test_ngram_join(docs, rows, empty):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_groups(docs).collect()}
    assert got == {(d, n, c) for d, (n, c) in brute.jaccard_groups([r[:2] for r in rows]).items()}
    assert ngram_join.similar_groups(empty).count() == 0
    kept = ngram_join.keep_one_of_each_group(docs)
    groups = {c for d, (n, c) in brute.jaccard_groups([r[:2] for r in rows]).items()}
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(groups)


@pytest.mark.parametrize(("block", "shingles"), [(2000, 1 << 20), (60, 9000)])
def test_ngram_join_of_a_large_group(spark, monkeypatch, block, shingles):
    """Texts that are 0.7 to 0.8 similar to each other, and texts that share a passage; in one task, and in many blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "SHINGLES", shingles)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    base, rows = rng.choices(words, k=300), []
    for i in range(2000):
        text = list(base)
        for p in rng.sample(range(300), rng.choice([4, 5, 6])):
            text[p] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(text)))
    for i in range(400):
        rows.append((5000 + i, " ".join(rng.choices(words, k=rng.randint(30, 200)) + base[:100] + rng.choices(words, k=rng.randint(30, 200)))))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute.jaccard_groups(rows)


def test_tasks_join_components():
    rng = np.random.default_rng(8)
    base = np.unique(rng.integers(0, 1 << 64, 200, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[rng.permutation(len(base))[:185]], rng.integers(0, 1 << 64, rng.integers(0, 40), dtype=np.uint64)])) for _ in range(40)]
    node, every = np.arange(40), np.arange(40)
    links = [(i, j) for i in range(40) for j in range(i) if ngram_join.similar(sets[i], sets[j])]
    want = brute.components(range(40), links)
    assert links and ngram_join.similar_components(every, every, sets, node).tolist() == [want[i] for i in range(40)]
    counts = ngram_join._counts([ngram_join.sketch(x) for x in sets])
    possible = ngram_join.possible_components(every, every, np.array(list(map(len, sets))), counts, node)
    assert all(possible[i] == possible[j] for i, j in links)


def test_signatures_meet_for_every_similar_pair():
    rng = np.random.default_rng(1)
    for size in [4, 5, 8, 9, 12, 13, 14, 16, 20, 22, 35, 60, 150, 400, 1500] * 3:
        a = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
        most = int(0.25 * len(a))
        for gone, come in ((len(a) // 5, 0), (0, most), (len(a) // 10, len(a) // 10)):
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[gone:]], rng.integers(0, 1 << 64, come, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                (x, spare_x), (y, spare_y) = ngram_join.signatures(a), ngram_join.signatures(b)
                assert len(np.intersect1d(x, y)) > spare_x + spare_y


def test_quality(docs, rows, empty):
    got = quality.judge_quality(docs).collect()
    want = {r[0]: brute.base_figures(r[1]) for r in rows}
    assert all(tuple(r)[1:6] == want[r.doc_id] for r in got) and len(got) == len(rows)
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert quality.judge_quality(empty).count() == 0 and quality.keep_good(docs).columns == docs.columns


def test_quality_on_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    got = quality.judge_quality(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r.quality: r.kept for r in got}
    assert share[1] > 0.99 and share[0] < 0.05


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_quality_against_exact_quantiles(spark, sf):
    """The verdicts of whole tables; the sketches' error of one in a hundred, five times over in a fence, may turn what lies next to it."""
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    want = brute.quality_verdicts([tuple(r) for r in docs.collect()], quality.LEAST)
    got = {r.doc_id: r.kept for r in quality.judge_quality(docs).collect()}
    assert all(got[d] == kept for d, (kept, near) in want.items() if near > 0.08)
    assert sum(near > 0.08 for _, near in want.values()) > 0.97 * len(want) and sum(got[d] != kept for d, (kept, _) in want.items()) <= 0.002 * len(want)


def test_fences_follow_their_groups(spark):
    """Fences of sf0.1 differ by group."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = quality.fences(quality.sketches(docs.select("lang", "source", quality._figures(F.coalesce("text", F.lit(""))).alias("q")))).collect()
    different = lambda name: len({round(r.high[name], 4) for r in found})
    # A cell of the sketch is two in a hundred wide, and the quantiles of "letters" lie within a few cells.
    assert different("capitals") > 20 and different("letters") > 5
    assert len(found) >= 64


def test_mixing(docs, rows, empty):
    got = mixing.mixture(docs).collect()
    sizes: dict = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(brute.WORD.findall(r[1] or ""))
    want, source = brute.targets(sizes), {r[0]: r[3] for r in rows}
    assert all(r.target == pytest.approx(want[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]] for r in got)
    taken: dict = {}
    for r in got:
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 0.05 * want[s] + 20 for s in taken)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mixture(docs).collect()), key=str)
    assert mixing.mixture(empty).count() == 0 and mixing.mix_documents(docs).columns == docs.columns


def test_packing(docs, rows, empty):
    import zlib

    got = packing.pack(docs).collect()
    encode = codec.encoder(codec.default_path())
    ids = {r[0]: [*encode(r[1] or ""), 2] for r in rows}
    used: dict = {}
    for r in got:
        part = np.asarray(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4")
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and len(part) == r.length
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(len(ids[r[0]]) for r in rows)
    assert sum(r.length for r in got) == total and len(used) <= 1.05 * -(-total // 1024) + 1
    assert packing.pack(empty).count() == 0


def test_crossover_keeps_every_piece_once():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 60, 300).tolist()
    a, b = (packing.best_fit(rng.permutation(300).tolist(), sizes, 100, []) for _ in range(2))
    child = packing.crossover(a, b, sizes, 100, rng)
    assert sorted(i for x in child for i in x) == list(range(300)) and all(sum(sizes[i] for i in x) <= 100 for x in child)


def test_refill_beats_best_fit():
    rng = np.random.default_rng(7)
    sizes = rng.integers(1, 1024, 600).tolist()
    seed = packing.best_fit(sorted(range(600), key=lambda i: -sizes[i]), sizes, 1024, [])
    full = packing.refill(seed, sizes, 1024, rng, 200)
    assert sorted(i for b in full for i in b) == list(range(600)) and all(sum(sizes[i] for i in b) <= 1024 for b in full)
    for room in (0, 1, 7, 100):
        some = sorted(rng.integers(1, 40, 9).tolist(), reverse=True)
        best = max(x for x in (sum(some[k] for k in range(9) if m >> k & 1) for m in range(512)) if x <= room)
        chosen = packing.fullest(room, list(range(9)), some)
        assert sum(some[k] for k in chosen) == best and len(set(chosen)) == len(chosen)


def test_crossovers_beat_best_fit_on_triplets(monkeypatch):
    """Bins of exactly three pieces, where best-fit decreasing takes a sixth more; by crossovers alone, and with refills."""
    for bins in (20, 60, 200):
        rng = np.random.default_rng(bins)
        sizes: list[int] = []
        while len(sizes) < 3 * bins:
            a, b = int(rng.integers(380, 490)), int(rng.integers(251, 300))
            sizes += [a, b, 1000 - a - b] if 250 < 1000 - a - b < 500 else []
        rng.shuffle(sizes)
        seed = len(packing.best_fit(np.argsort(-np.asarray(sizes), kind="stable").tolist(), sizes, 1000, []))
        with monkeypatch.context() as m:
            m.setattr(packing, "refill", lambda p, *_: p)
            crossed = packing.evolve(sizes, 1000, 1, [], 12, 150)
        best = packing.evolve(sizes, 1000, 1, [])
        assert sorted(i for b in best for i in b) == list(range(3 * bins)) and all(sum(sizes[i] for i in b) <= 1000 for b in best)
        assert len(crossed) < seed and len(best) <= bins + 2 < seed


def test_packing_reaches_the_lower_bound(spark):
    """Best-fit decreasing gives 964 sequences here."""
    got = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert len(got) == -(-sum(r.n for r in got) // 1024) == 962 and max(r.n for r in got) <= 1024


def test_token_counts(docs, rows, empty):
    lib = codec.library(codec.default_path())
    exact = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    assert all(r.n_tokens == exact(next(x[1] for x in rows if x[0] == r.doc_id) or "") for r in token_counts.token_counts(docs).collect())
    assert token_counts.token_counts(empty).count() == 0
    whole = "\n".join(r[1] or "<|endoftext|>" for r in rows) + " " * 700 + "z" * 2500 + " it's \u65e5\u672c\u8a9e\U0001f642" * 50
    for chunk, overlap in ((700, 40), (1500, 200), (4000, 300)):
        assert token_counts.count_tokens(whole, codec.default_path(), chunk, overlap) == exact(whole)


def test_token_counts_splice_anywhere():
    """Small chunks of texts made of what a tokenizer's pattern minds."""
    path, rng = codec.default_path(), random.Random(5)
    lib = codec.library(path)
    parts = ["a", "b", " ", "  ", "\n", "'s", "<|endoftext|>", "\u00e9", "\u65e5", "\U0001f642", "1", "23", "!", "\t", "\u3000", "'", "word", " the"]
    for _ in range(200):
        text = "".join(rng.choices(parts, k=rng.randint(100, 900)))
        assert token_counts.count_tokens(text, path, rng.choice([60, 130, 260]), rng.choice([10, 40]), 16) == len(lib.encode(text, add_special_tokens=False).ids)


def test_token_counts_of_long_documents(spark):
    """The texts of sf0.1 that are counted by chunks."""
    lib = codec.library(codec.default_path())
    long = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(F.length("text") > token_counts.CHUNK).collect()]
    assert len(long) > 50 and all(token_counts.count_tokens(t, codec.default_path()) == len(lib.encode(t, add_special_tokens=False).ids) for t in long)


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 6))
    rows = [(i, (base[i % 12] + rng.normal(scale=0.05 * (i % 5), size=6)).tolist(), i % 2) for i in range(120)]
    rows += [(200, None, 1), (201, [0.0] * 6, 1), (202, [float("nan")] * 6, 1), (203, rows[0][1], None), (204, rows[0][1], 0), (205, rows[0][1][:3], 0), (206, [None, 1.0, 1.0, 1.0, 1.0, 1.0], 0), (207, [], 0)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n long".replace("n long", "n string"))
    want = brute.vector_groups(rows)
    for block, cell in ((2000, 1000), (5, 4)):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(table, block=block, cell=cell).collect()}
        assert got == want
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def test_urls(spark):
    urls = ["http://WWW.Spam-Farm.example.org/en/x?q", "https://a.example.com/en/7#t", "ftp://example.com/en/8", "http://b.net/de/1", "http://example.net/de/85", "no scheme", None, "http://", "http://user@free-bets.example.com:80/p", "http://xspam-farm.example.org/", "x\n://\u00c9.org/es/?"]
    table = spark.createDataFrame([(i, u, "x") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, host string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(table).orderBy("page_id").collect()]
    assert got == [
        ("www.spam-farm.example.org", "/en/x", None, "block"), ("a.example.com", "/en/7", "example.com/en/7", "allow"), ("example.com", "/en/8", "com/en/", "block"),
        ("b.net", "/de/1", "net/de/", "allow"), ("example.net", "/de/85", "example.net/de/8", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("user@free-bets.example.com:80", "/p", None, "block"), ("xspam-farm.example.org", "/", None, "allow"), ("\u00c9.org", "/es/", "org/es/", "block"), ("www.spam-farm.example.org", "/en/x", None, "block"),
    ]


def test_a_table_of_listed_domains(spark):
    pages = spark.createDataFrame([(1, "http://a.b.example.net/x"), (2, "http://b.example.net"), (3, "http://example.net/"), (4, None)], "page_id long, url string")
    listed = spark.createDataFrame([("b.example.net",), (None,), ("b.example.net",)], "key string")
    assert [r.verdict for r in url_filter.judge_urls(pages, listed).orderBy("page_id").collect()] == ["block", "block", "allow", "allow"]
    assert [r.verdict for r in url_filter.judge_urls(pages, listed.limit(0)).orderBy("page_id").collect()] == ["allow"] * 4
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_cascade_has_several_levels_on_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("host")).distinct()
    universe = hosts.select(F.explode(url_filter.keys_of(F.col("host"), 3)).alias("key")).distinct()
    assert len(url_filter.build_cascade(url_filter._listed_frame(spark, url_filter.BLOCKED), universe)) > 1


def test_embeddings_beyond_squares(spark):
    """Components whose squares under- or overflow have a cosine like any other."""
    rows = [(1, [1e-200, 2e-200], 1), (2, [1e200, 2e200], 1), (3, [1.0, 2.0], 1), (4, [2.0, -1.0], 1)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).orderBy("vec_id").collect()
    assert [(r.n_links, r.component_id) for r in got] == [(2, 1), (2, 1), (2, 1), (0, 4)]


def test_cascade_is_exact(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BITS_PER_KEY", 3)  # many false positives, so several levels
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("substr(key, -1) = '7'")
    levels = url_filter.build_cascade(listed, universe)
    assert len(levels) > 2
    wrong = universe.where(url_filter.member(levels, F.col("key")) != (F.substring("key", -1, 1) == "7"))
    assert wrong.count() == 0


def test_archives(spark, tmp_path):
    long = "<p>" + "\u00e9\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(1, "http://a/", long), (7, "http://b c/", long), (3, None, long), (4, "u", None), (5, "u", "short"), (6, "u", "short"), (None, "u", long), (7, "http://b c/", long)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive(table).collect()), key=str)
    n = len(long.encode())
    assert got == sorted([(1, n, "revisit", 7), (7, n, "response", None), (7, n, "response", None), (3, n, "revisit", 7), (4, 0, "response", None), (5, 5, "response", None), (6, 5, "response", None), (None, n, "revisit", 7)], key=str)
    assert warc.archive(table.limit(0)).count() == 0
    for version in (1, 2):
        bodies = [("http://x/", "text/html; charset=a b", b"one\n\ntwo"), ("http://y/", "text/plain", b"")]
        raw = warc.arc_file(version, "n.arc", bodies, warc.datetime(1999, 1, 2, tzinfo=warc.timezone.utc))
        assert [(f["URL"], f["Content-type"], b, f["Archive-date"]) for _, f, b in warc.arc_records(raw)] == [(u, k, b, "19990102000000") for u, k, b in bodies]
        with pytest.raises(ValueError):
            list(warc.arc_records(raw[:-12]))
    hostile = [("filedesc://x.arc", "text/html", b"HTTP/1.1 200 OK\r\n\r\nx"), ("filedesc://1.1.1.1 0 alexa/dat 2", "text/plain", b"")]
    raw = warc.arc_file(1, "n.arc", hostile[:1], warc.AT)
    assert [(f["URL"], b) for _, f, b in warc.arc_records(raw)] == [(hostile[0][0], hostile[0][2])]


def test_archives_of_hostile_pages(spark, tmp_path):
    """Written files, read by a parser of their own: lengths, digests, ids and what revisits refer to."""
    import base64
    import hashlib

    body = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\n" + "y" * 1000
    rows = [(1, "filedesc://a.arc 1 2 3 4", body), (2, "filedesc://b", body), (3, "http://c/\n1 0 Archive", "\n\nfiledesc://d"), (4, None, None), (5, "HTTP/1.1", "HTTP/1.1 200 OK\r\n\r\nz")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive(table).collect()}
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    assert got == {i: (len((t or "").encode()), sha(t), "revisit" if i == 1 else "response", 2 if i == 1 else None) for i, _, t in rows}
    warc.write_warc(table, f"{tmp_path}/w")
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "w").glob("part-*")))
    records = []
    while raw:
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        assert lines[0] == b"WARC/1.1"
        fields = dict(x.decode().split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        assert rest[n : n + 4] == b"\r\n\r\n"
        records.append((fields, rest[:n]))
        raw = rest[n + 4 :]
    assert [f["WARC-Type"] for f, _ in records].count("warcinfo") == 1 and records[0][0]["WARC-Type"] == "warcinfo"
    named = {f["WARC-Record-ID"]: f for f, _ in records}
    assert len(named) == len(records)
    for fields, block in records[1:]:
        assert fields["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() and fields["Content-Type"] == "application/http; msgtype=response"
        if fields["WARC-Type"] == "revisit":
            first = named[fields["WARC-Refers-To"]]
            assert first["WARC-Type"] == "response" and first["WARC-Target-URI"] == fields["WARC-Refers-To-Target-URI"] and first["WARC-Payload-Digest"] == fields["WARC-Payload-Digest"]


def test_main_text(spark):
    page = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href="/">Menu</a></li></ul></nav><div class="cookie-notice">We use</div>
    <article><h1>Head &amp; <i>line</i></h1><p>First\n  part<br>of it.<p>Short.</p><aside>Side</aside><p>Last &lt;one&gt;&nbsp;x</p><div id="comments"><p>Nice</p></div></article><form>f</form><footer>&copy;</footer></body></html>"""
    bare = "<div><a href='/'>One</a></div><div class='sidebar'>x</div>" + "".join(f"<p>{'word ' * 30}{i}</p>" for i in range(3)) + "<div class='footer'>y</div>"
    table = spark.createDataFrame([(1, "u", page, "a"), (2, "u", None, "a"), (3, None, "", "a"), (4, "u", bare, "a")], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_text.extract(table).collect()}
    assert got[1] == "Head & line\nFirst part of it.\nShort.\nLast <one> x" and got[2] == got[3] == ""
    assert [len(x) for x in got[4].split("\n")[-3:]] == [151] * 3 and "y" not in got[4].split("\n")


def test_main_text_of_odd_pages(spark):
    """Unclosed tags, tables in tables, a very long page, repeated rows and an empty table."""
    prose = [f"{'word ' * 30}{i}." for i in range(4)]
    assert html_text.main_text(f"<div><p>{prose[0]}<p>{prose[1]}<ul><li>{prose[2]}<div><b>{prose[3]}").split("\n") == prose
    assert html_text.main_text(f"<table><tr><td><table><tr><td>{prose[0]}</td></tr></table></td><td>{prose[1]}</td></tr></table>").split("\n") == prose[:2]
    assert html_text.main_text(f"<p>{prose[0]}</p><script>var x = '</p>{prose[1]}'").split("\n") == prose[:1]
    long = [f"{'word ' * 40}{i}." for i in range(20_000)]
    assert html_text.main_text("<ul><li><a href='/'>Menu</a></li></ul>" + "".join(f"<p>{x}</p>" for x in long)) == "\n".join(long)
    table = spark.createDataFrame([(1, "u", f"<p>{prose[0]}</p>")] * 2, "page_id long, url string, html string")
    assert [r.text for r in html_text.extract(table).collect()] == prose[:1] * 2 and html_text.extract(table.limit(0)).count() == 0


def test_main_text_windows():
    """Surge and dive decide with and without <article>; tags are only gaps."""
    links = "".join(f"<li><a href='/{i}'>Menu entry number {i}</a></li>" for i in range(6))
    prose = [f"{'word ' * 30}{i}." for i in range(4)]
    body = f"<h1>Title</h1><p>By A. B.</p><p>{prose[0]}</p><p>Yes.</p><p>No, not at all.</p><p>Why?</p><p>{prose[1]}</p><p>The end.</p>"
    want = ["Title", "By A. B.", prose[0], "Yes.", "No, not at all.", "Why?", prose[1], "The end."]
    foot = "<p>\u00a9 2024 Some Company</p><p>Imprint</p><p>Contact</p>"
    for page in (
        f"<ul>{links}</ul>{body}{foot}",  # an unclassed menu and a footer of plain paragraphs
        f"<div>{''.join(f'<div>Entry {i}</div>' for i in range(6))}</div>{body}<div>{links}</div>{foot}",  # a menu without links
        f"<ul>{links}</ul>{body}<h3>Read on</h3><ul>{links}</ul>",
        f"<ul>{links}</ul><main>{body}</main>{foot}",
        f"<article><ul>{links}</ul>{body}<ul>{links}</ul></article>",  # link windows dive inside an article too
    ):
        assert html_text.main_text(page).split("\n") == want
    apart = f"<p>{prose[0]}</p><ul>{links}</ul><p>{prose[1]}</p>"
    for page in (apart, f"<article>{apart}</article>"):
        assert html_text.main_text(page).split("\n") == prose[:2]
    assert html_text.main_text(f"<article><p>{prose[0]}</p></article><div><p>{prose[1][:100]}</p></div>") == prose[0]
    teaser = f"<div><p>{prose[0]}</p><p>{prose[1]}</p></div><article><p>{prose[2][:90]}</p></article>"
    assert html_text.main_text(teaser).split("\n")[:2] == prose[:2]  # a small article does not drop the text beside it


def test_main_text_hints():
    """Whole class tokens only, and never what holds the text."""
    prose = [f"{'word ' * 30}{i}." for i in range(4)]
    body = "<h1 class='page-header'>Title</h1>" + "".join(f"<p>{x}</p>" for x in prose)
    want = ["Title", *prose]
    bare = "".join(f"<p>{x}</p>" for x in prose)
    for page in (
        f"<div class='content no-sidebar'>{body}</div>",
        f"<div class='elementor-widget elementor-widget-text-editor'>{body}</div>",
        f"<div class='widget'><div><h1 class='page-header'><a href='/'>Title</a></h1>{bare}</div></div>",  # most of the text
        f"<form><main>{body}</main></form>",
        f"<div class='modal'><article>{body}</article></div>",
        f"<article>{body}</article>",
    ):
        assert html_text.main_text(page).split("\n") == want
    inside = "<article><p>" + prose[0] + " <math><mi>x</mi></math></p><object><p>Held text of an object.</p></object></article>"
    assert html_text.main_text(inside).split("\n") == [f"{prose[0]} x", "Held text of an object."]
    around = "".join(f"<div class='{c}'><p>{prose[3]}</p></div>" for c in ("sidebar", "site-footer", "cookie-banner", "widget", "comments-area", "related posts", "share_buttons"))
    assert html_text.main_text(f"{around}<div>{bare * 3}</div>").split("\n") == prose * 3
    talk = "<section id='comments'>" + f"<article class='comment-body'><p>{prose[3]}</p></article>" * 9 + "</section>"
    assert html_text.main_text(f"<article>{body}</article>{talk}").split("\n") == want
    assert html_text.main_text(f"<article>{body}{talk}</article>").split("\n") == want


def test_pipeline(spark, tmp_path, docs, rows):
    import corpus_pipeline

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == docs.columns
    assert "sequence_id" in corpus_pipeline.run(spark, str(tmp_path)).columns


def test_pipeline_of_nothing(spark, tmp_path, empty, docs):
    """An empty table, and a first stage that keeps nothing."""
    import corpus_pipeline

    empty.write.parquet(f"{tmp_path}/a/documents.parquet")
    docs.where("length(text) < 3").write.parquet(f"{tmp_path}/b/documents.parquet")
    for name in "ab":
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.count() == 0 and "sequence_id" in out.columns


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Each stage on what its predecessor kept of a whole table."""
    import hashlib
    from collections import Counter

    import corpus_pipeline

    folder, frames = "/root/testdata/sf0.001", []
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    frames.append(frame.collect())
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, folder).write.parquet(f"{tmp_path}/{k}")
        frame = spark.read.parquet(f"{tmp_path}/{k}")
        frames.append(frame.collect())
    docs, good, single, cut, mixed, packed = frames

    verdicts = quality.judge_quality(spark.createDataFrame(docs)).collect()
    assert sorted(r.doc_id for r in good) == sorted(r.doc_id for r in verdicts if r.kept) and set(good) <= set(docs)
    for r in good:
        n_words, *_, n_repeat_words = brute.base_figures(r.text)
        assert n_words >= 10 and 100 * n_repeat_words <= 20 * n_words

    groups = brute.jaccard_groups([(r.doc_id, r.text) for r in good])
    assert sorted(r.doc_id for r in single) == sorted({c for _, c in groups.values()}) and set(single) <= set(good)
    assert len(single) < len(good) < len(docs)

    want = {d: x for d, *x in brute.repeats([(r.doc_id, r.text) for r in single], suffix_dedup.PASSAGE)}
    assert sorted(r.doc_id for r in cut) == sorted(want)
    for r in cut:
        raw = r.text.encode()
        n_bytes, n_removed, n_spans, kept = want[r.doc_id]
        # Characters that lose some of their bytes go: up to three bytes at both ends of a span.
        assert hashlib.sha256(raw).hexdigest() == kept or 0 < n_bytes - n_removed - len(raw) <= 6 * n_spans
        assert r.n_chars == len(r.text)

    assert set(mixed) <= set(cut) and max(Counter(mixed).values()) <= 3
    size = lambda r: len(brute.WORD.findall(r.text))
    sizes, taken = Counter(), Counter()
    for r in cut:
        sizes[r.source] += size(r)
    for r in mixed:
        taken[r.source] += size(r)
    for source, target in brute.targets(dict(sizes)).items():
        assert abs(taken[source] - target) <= max(size(r) for r in cut if r.source == source)

    encode = codec.encoder(codec.default_path())
    ids = Counter()
    for r in mixed:
        ids[r.doc_id] += len(encode(r.text)) + 1
    got, places = Counter(), {}
    for r in packed:
        got[r.doc_id] += r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == ids
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
