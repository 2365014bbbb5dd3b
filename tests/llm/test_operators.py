"""The operators against brute force on a small fixture with nulls, empty and long texts, ties, repeated rows and clashing names."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagegrain.llm import importance, langid, line_dedup, media, mixing, ngram_join, packing, quality_rules, sharding, token_output, tokens
from pagegrain.llm.scratch import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label long, size int, id string"


def words(rng, n, kind="en"):
    parts = {"en": ["the", "and", "ing", "th", "er", "on"], "de": ["ung", "sch", "ein", "ü", "ß", "ich"]}[kind]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))


def make():
    rng = random.Random(3)
    base = words(rng, 200).split()
    rows = []
    for i in range(60):
        lang = "de" if i % 3 == 0 else "en"
        rows.append((i, "\n".join(words(rng, rng.randint(5, 40), lang) for _ in range(rng.randint(1, 6))), lang, f"s{i % 4}" if i % 9 else None))
    for i in range(60, 100):  # near copies around the threshold
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "hot"))
    rows += [(100, None, "en", "s1"), (101, "", None, None), (102, " \n\t ", "en", "s1"), (103, "one two", "en", "s2"), (104, "One  TWO", "en", "s2"), (105, words(rng, 20000), "en", "s0")]
    rows += [(7, rows[7][1], "en", "s3"), (7, rows[8][1], "en", "s3"), (None, rows[9][1], None, "s1"), (106, "12 34 !!", "en", "s1"), (107, "é́ 中文 👍 <|endoftext|> a\x1cb", "en", "s1")]
    return [(i, t, lang, s, None if t is None else len(t), 1, 2, "x") for i, t, lang, s in rows]


ROWS = make()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 3 != 0, 0) for i in range(100)], "doc_id long, quality boolean, toxic int").select("doc_id", F.col("quality").cast("int").alias("quality"), "toxic")


def shingles(text):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


@pytest.mark.parametrize(("many", "broadcast"), [(1, 1_000_000), (4, 0), (16, 1_000_000)])
def test_ngram_join(spark, docs, none, monkeypatch, many, broadcast):
    monkeypatch.setattr(ngram_join, "MANY", many)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", broadcast)
    sets = [shingles(r[1]) for r in ROWS]
    parent = list(range(len(ROWS)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    lowest = {}
    for i, r in enumerate(ROWS):
        if r[0] is not None:
            lowest[find(i)] = min(lowest.get(find(i), r[0]), r[0])
    want = sorted(((r[0], len(sets[i]), lowest.get(find(i))) for i, r in enumerate(ROWS)), key=str)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs).collect()), key=str)
    assert got == want
    if many == 16:
        assert ngram_join.ngram_join(none).count() == 0
        kept = ngram_join.representatives(docs)
        assert kept.columns == docs.columns
        assert kept.count() == sum(not (r[0] is not None and lowest.get(find(i), r[0]) < r[0]) for i, r in enumerate(ROWS))


def test_media(spark, docs, none):
    rows = media.media_columns(docs).collect()
    assert len(rows) == len(ROWS)
    want = collections.Counter()
    for r in ROWS:
        data = (r[1] or "").encode()
        payload = data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))
        stored = media.to_png(data)
        level = np.frombuffer(payload, np.uint8).astype(float)
        share = bytes(int((level // 16 == k).sum()) * 255 // len(payload) for k in range(16)).hex()
        want[r[0], len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{level.mean():.4f} {level.std():.4f} {share}"] += 1
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in rows) == want
    assert media.media_columns(none).count() == 0
    data = "é x".encode()
    assert media.from_png(media.to_png(data)) == (media.padded(data), len(data))


def test_media_retries_by_offset(spark, docs):
    scratch = Scratch(spark, "retry")
    media.write_archives(docs, scratch.path("a"))
    reader = media.ArchiveReader({"path": scratch.path("a"), "range_bytes": "3000"})
    parts = reader.partitions()
    assert len(parts) > 3
    first = next(p for p in parts if p.start == 0)
    fs, _ = media.pafs.FileSystem.from_uri(scratch.path("a"))
    members = media._Members(fs, first.archive, 2)
    infos = members.directory()
    good, failures = members._bytes, [2]

    def flaky(at, n):
        if failures[0]:
            failures[0] -= 1
            raise OSError("lost")
        return good(at, n)

    members._bytes = flaky
    assert media.from_png(members.read(infos[0]))[1] >= 0
    got = [o for p in parts for b in reader.read(p) for o in zip(b.column("archive").to_pylist(), b.column("offset").to_pylist())]
    assert len(got) == len(set(got)) == len(ROWS)


def test_line_dedup(docs, none):
    got = {(r.doc_id, r.n_lines): r for r in line_dedup.line_dedup(docs).collect()}
    assert got[(100, 0)].text is None and got[(101, 1)].text == ""
    for r in line_dedup.line_dedup(docs).collect():
        assert len(r.dropped_lines) <= r.n_lines
    kept = line_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    lines = [line for r in kept.collect() for line in (r.text or "").split("\n") if len(line.strip(" ")) >= line_dedup.MIN_CHARS]
    assert max(collections.Counter(lines).values()) == 2  # the row that is there twice keeps its lines twice
    assert line_dedup.line_dedup(none).count() == 0


def test_token_output(docs, none):
    library = tokens.encoder().library
    rows = token_output.token_output(docs).orderBy("start").collect()
    ids = {}
    for r in ROWS:
        found = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        ids.setdefault(r[0], []).append((len(found), zlib.crc32(found.tobytes())))
    at = 0
    for r in rows:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in ids[r.doc_id]
        at += r.n_tokens
    assert [r.doc_id for r in rows if r.doc_id is not None] == sorted(r[0] for r in ROWS if r[0] is not None)
    assert token_output.token_output(none).count() == 0


def test_language_id(docs, none):
    rows = langid.language_id(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (100, 101, 102, 106))
    assert all(by[i].lang_pred == ("de" if i % 3 == 0 else "en") for i in range(60))
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert langid.language_id(none).count() == 0
    kept = langid.accepted(docs.withColumn("_lid", F.lit(7)))
    assert kept.columns == [*docs.columns, "_lid"]
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(r.doc_id for r in rows if r.lang_pred != "und" and r.score >= langid.MIN_SCORE)
    assert langid.accepted(none).count() == 0


def test_language_kernel():
    """One kernel value, the ridge solution and the memory of many short texts."""
    rng = random.Random(2)
    texts = [words(rng, 12, "de" if i % 2 else "en") for i in range(60)]

    def grams(text):
        s = re.sub(r"[^\W\d_]+|.", lambda m: m[0] if m[0][0].isalpha() else " ", text.lower())
        s = re.sub(" +", " ", s)
        return {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)}

    rows, has = langid.presence(texts)
    assert has.all()
    a, b = grams(texts[0]), grams(texts[1])
    shared = int((rows[0] & rows[1]).sum())
    assert abs(shared - len(a & b)) <= 2 and abs(int(rows[0].sum()) - len(a)) <= 2  # hashed cells may meet
    model = langid.fit(np.packbits(rows, axis=1), ["de" if i % 2 else "en" for i in range(60)])
    # the plain form: features against the landmarks, all texts here, then ridge regression
    unit = rows / np.sqrt(rows.sum(1, keepdims=True))
    kernel = unit @ unit.T
    value, vector = np.linalg.eigh(kernel)
    good = value > 1e-6 * value.max()
    mapped = kernel @ (vector[:, good] / np.sqrt(value[good]))
    target = np.array([[1.0, -1.0] if i % 2 else [-1.0, 1.0] for i in range(60)])
    centred = mapped - mapped.mean(0)
    weights = np.linalg.solve(centred.T @ centred / 60 + langid.RIDGE / 60 * np.eye(mapped.shape[1]), centred.T @ (target - target.mean(0)) / 60)
    want = centred @ weights + target.mean(0)
    got = (rows.astype(np.float32) @ model.weights) / np.sqrt(rows.sum(1))[:, None] + model.bias
    assert np.allclose(got, want, atol=1e-3)


def test_language_rows_are_bounded(monkeypatch):
    seen = []
    column = pa.array(["wir sind hier zwanzig"] * 10_000)
    seen = [len(part) for part in langid.array_chunks(column, rows=langid.ROWS)]
    assert sum(seen) == 10_000 and max(seen) <= langid.ROWS


def test_mixing(docs, none):
    rows = mixing.mix_sources(docs).collect()
    size = [len(WORD.findall(r[1] or "")) for r in ROWS]
    assert sorted(r.size for r in rows) == sorted(size)
    assert all(r.taken in (0, r.size, 2 * r.size) for r in rows)
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    for source_size in {r.source_size for r in rows}:
        own = [r for r in rows if r.source_size == source_size]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 * max(r.size for r in own)
    assert mixing.targets({"b": 10, "a": 100, None: 10}) == {"a": 140.0, "b": 20.0, None: 20.0}
    assert mixing.mix_sources(none).count() == 0
    mixed = mixing.mixed(docs.withColumns({c: F.lit(5) for c in ("_mix", "_group", "_plan", "copies")}))
    assert mixed.columns == [*docs.columns, "_mix", "_group", "_plan", "copies"] and mixed.where("_mix = 5 and _group = 5 and _plan = 5 and copies = 5").count() == mixed.count()
    times = collections.Counter((r.doc_id, r.text, r.source) for r in mixed.collect())
    want = collections.Counter()
    for r in rows:
        want[r.doc_id] += r.taken // r["size"] if r["size"] else 1
    assert collections.Counter({k: v for k, v in want.items() if v}) == sum((collections.Counter({k[0]: v}) for k, v in times.items()), collections.Counter())
    assert mixing.mixed(none).count() == 0


def test_quality_rules(docs, labels, none):
    def brute(text):
        w = WORD.findall(text or "")
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        count = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for k in range(3)}
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)

    texts = [r[1] for r in ROWS] + ["a b\n\na b\na b c", "x x x x", "#\n#|\n#"]
    assert [tuple(r) for r in quality_rules.statistics(pa.array(texts))[0].tolist()] == [brute(t) for t in texts]
    rows = quality_rules.quality_rules(docs, labels).collect()
    assert len(rows) == len(ROWS) and not any(r.kept and r.base_failed for r in rows)
    assert quality_rules.quality_rules(docs, labels.limit(0)).where("kept = base_failed").count() == 0
    assert quality_rules.quality_rules(none, labels).count() == 0


def test_trees_keep_monotonic():
    rng = np.random.default_rng(1)
    x = rng.random((2000, len(quality_rules.FEATURES)))
    symbols = quality_rules.FEATURES.index("symbols")
    trees = quality_rules.fit(x, (x[:, 0] + 0.5 * np.sin(9 * x[:, symbols]) - x[:, symbols] + rng.normal(0, 0.2, 2000)) > 0.1)
    probe = np.repeat(x[:20], 50, axis=0)
    probe[:, symbols] = np.tile(np.linspace(0, 1, 50), 20)
    assert (np.diff(trees.probability(probe).reshape(20, 50), axis=1) <= 1e-12).all()


def test_shards(docs, none):
    rows = sharding.hilbert_shards(docs).collect()
    shards = collections.Counter(r.shard for r in rows)
    assert len(rows) == len(ROWS) and max(shards.values()) - min(shards.values()) <= 1
    for s, n in shards.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == collections.Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    assert sharding.hilbert_shards(none).count() == 0
    grid = np.stack(np.meshgrid(np.arange(8), np.arange(8), indexing="ij"), -1).reshape(-1, 2)
    walk = grid[np.argsort(sharding.hilbert(grid, 3))]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_write_shards(spark, docs):
    scratch = Scratch(spark, "shards")
    sharding.write_shards(docs, scratch.path("out"), 5)
    back = spark.read.parquet(scratch.path("out"))
    assert back.count() == len(ROWS) and back.select("shard").distinct().count() == 5


def test_packing(docs, none):
    rows = packing.pack_documents(docs).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    lengths = np.array([r.length for r in rows])
    assert len(by) == packing.lower_bound(lengths, 2048)
    total = collections.Counter()
    for r in rows:
        total[r.doc_id] += r.length
    library = tokens.encoder().library
    want = collections.Counter()
    for r in ROWS:
        want[r[0]] += 1 + len(library.encode(r[1] or "", add_special_tokens=False).ids)
    assert total == want
    # every piece: its place in its document, its ids, and the cut at whole sequences from the end
    pieces = collections.Counter()
    for r in ROWS:
        ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        bounds = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            pieces[r[0], i, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == pieces
    assert {r.gap for r in rows} == {0}
    assert packing.pack_documents(none).count() == 0


def test_lower_bound():
    assert packing.lower_bound(np.array([1100] * 5), 2048) == 5
    assert packing.lower_bound(np.array([700] * 5), 2048) == 3
    rng = np.random.default_rng(0)
    for _ in range(20):
        lengths = rng.integers(1, 2048, 300)
        bins, place, left = packing.best_fit(lengths, 2048)
        assert packing.lower_bound(lengths, 2048) <= len(left)
        assert (2048 - np.bincount(bins, lengths) == left).all()


def test_importance(docs, labels, none):
    rows = importance.importance(docs, labels, 0.5).collect()
    assert len(rows) == len(ROWS)
    chosen = [r for r in rows if r.selected]
    assert abs(len(chosen) - round(0.5 * len(ROWS))) <= 1
    worst = min(r.sample_key for r in chosen)
    assert all(r.sample_key <= worst for r in rows if not r.selected)
    assert importance.importance(none, labels).count() == 0


def test_tokens():
    e = tokens.encoder()
    odd = ["", "a\x1cb  c\x1d ", "don't  we'll\n\n\tx 12³ ½ _a-b ", "é́  x\xa0 y", "中文 テスト👍🏽 <|endoftext|> z", " \n x\x85y", "İıſ'S 'Re", " ʼn ª º ١٢", *(r[1] for r in ROWS if r[1])]
    ids, counts = e.encode([*odd, None])
    ends = np.cumsum(counts)
    assert [ids[b - n : b].tolist() for b, n in zip(ends, counts)] == [*(e.whole(t).tolist() for t in odd), []]


@pytest.mark.parametrize(("chars", "pieces"), [(40, 1_000_000), (1 << 19, 300), (40, 20)])
def test_tokens_in_parts(monkeypatch, chars, pieces):
    monkeypatch.setattr(tokens, "PART_CHARS", chars)
    monkeypatch.setattr(tokens, "KNOWN_PIECES", pieces)
    rng = random.Random(5)
    signs = " \n\t'  stmdrevlalLxé١9.,-\u3000\xa0你\U0001f600\U0010ffff''"
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(400)] + [r[1] for r in ROWS[:40]]
    e = tokens.Encoder()
    for at in range(0, len(texts), 9):
        ids, counts = e.encode(texts[at : at + 9])
        ends = np.cumsum(counts)
        for text, b, n in zip(texts[at : at + 9], ends, counts):
            assert ids[b - n : b].tolist() == e.whole(text).tolist(), text


def test_a_worker_remembers_a_bounded_table():
    """The table of pieces took 65 MB of each worker and the passes over a batch as much."""
    one = tokens.Encoder()
    rng = np.random.default_rng(1)
    for _ in range(12):
        one.encode([" ".join(f"{x:x}" for x in rng.integers(0, 2**62, 9000))])
    known = one.known
    assert sum(x.nbytes for x in (known.keys, known.first, known.count, known.ids)) <= 34 << 20
    assert tokens.KNOWN_IDS * 4 <= 16 << 20 and tokens.PART_CHARS <= 1 << 17


def test_kept_tables_take_few_rows_a_batch(spark):
    """A batch held 10 000 texts, once in the JVM outside its heap and once in the worker."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = Scratch(spark, "batches").keep("n", spark.range(5000).coalesce(1).mapInArrow(sizes, "n long")).collect()
    assert sum(r.n for r in got) == 5000 and max(r.n for r in got) <= 1000
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
