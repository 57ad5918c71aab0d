"""Operators against brute force, and on odd rows: nulls, empty and long texts, repeats, clashing columns, no rows."""

import hashlib
import itertools
import random
import re
import subprocess
import sys
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
import xxhash
import zstandard

from lamina.llm import ann, bpe, learn, merkle, packing, quality, recompress, shard, simhash, tokenfile, toxicity
from lamina.llm.common import materialise, salted_rank, word_lists

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Columns beside id and text have names that the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, row string, fp string, score double, bucket int, own boolean, batch long"


def documents():
    random.seed(11)
    vocabulary = [f"w{i}" for i in range(400)]
    line = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    shared = line(70)
    texts = [line(random.randint(1, 160)) for _ in range(40)]
    texts += [texts[0], texts[1], texts[1] + " tail", texts[2].upper(), line(30) + " " + shared + " " + line(9), shared, line(3) + "\n" + shared, None, "", " \n\t ", "one", "a " * 3000, "a " * 30, line(20000), "Ünïcödé 日本語 " * 40, "x" * 30000]
    rows = [(i * 3, t, "en", "src", 1) for i, t in enumerate(texts)]
    rows += [(None, texts[3], None, None, None), (None, None, None, None, None), rows[5], rows[5], (7, texts[6], "zz", "src0", -5)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = documents()
    return spark.createDataFrame([(*r, 9, "k", "r", "f", 0.5, 1, True, 4) for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_simhash(text, k=4):
    w = WORD.findall((text or "").encode().lower())
    s = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(values, near):
    label = list(range(len(values)))
    for i, j in itertools.combinations(range(len(values)), 2):
        if near(values[i], values[j]):
            a, b = label[i], label[j]
            label = [a if x == b else x for x in label]
    return label


def test_simhash_links(docs, none):
    got = simhash.simhash_components(docs).collect()
    rows = documents()
    assert len(got) == len(rows) and simhash.simhash_components(none).count() == 0
    prints = sorted({brute_simhash(r[1]) for r in rows})
    label = dict(zip(prints, groups(prints, lambda a, b: (a ^ b).bit_count() <= 4), strict=True))
    least = {}
    for r in rows:
        if r[0] is not None:
            g = label[brute_simhash(r[1])]
            least[g] = min(least.get(g, r[0]), r[0])
    expected = sorted((str(r[0]), f"{brute_simhash(r[1]):016x}", str(least.get(label[brute_simhash(r[1])]))) for r in rows)
    assert sorted((str(r["id"]), r["fp"], str(r["component_id"])) for r in got) == expected


@pytest.mark.parametrize(("words", "radius"), [(1, 0), (1, 4), (1, 7), (2, 20), (4, 42)])
def test_bit_sliced_equals_popcount(words, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, (6, words), dtype=np.uint64)
    fps = base[rng.integers(0, 6, 300)] ^ (np.uint64(1) << rng.integers(0, 64, (300, words), dtype=np.uint64)) * rng.integers(0, 2, (300, words), dtype=np.uint64)
    distance = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2)
    rows, near = simhash.within_radius(fps, simhash.planes_of(fps), 300, radius)
    found = np.zeros((300, 300), bool)
    found[rows] = np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, :300]
    assert (found == (distance <= radius)).all()


def test_bands_propose_pairs_at_the_threshold():
    """Random pairs of sets with a likeness of exactly 0.8: all but one in ten thousand share a band, here all of them."""
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(300):
        both = rng.integers(0, 2**63, 80, dtype=np.uint64)
        a, b = (np.unique(np.append(both, rng.integers(0, 2**63, 10, dtype=np.uint64))) for _ in range(2))
        missed += not set(enumerate(simhash.band_keys(a))) & set(enumerate(simhash.band_keys(b)))
    assert missed == 0


@pytest.mark.parametrize("distinct", [5_000, 300_000, 10_000_000])
def test_set_fingerprints_meet_at_the_threshold(distinct):
    """Random pairs of sets with a likeness of exactly 0.8: all within the radius, nearly all in one bucket of bits whatever the number of sets."""
    rng = np.random.default_rng(3)
    tables = simhash.sample_tables(distinct, 64 * simhash.SET_WORDS, simhash.SET_BITS, simhash.SET_MISS)
    far, met = [], 0
    for _ in range(300):
        both = rng.integers(0, 2**63, 80, dtype=np.uint64)
        a, b = (simhash.set_fingerprint(np.unique(np.append(both, rng.integers(0, 2**63, 10, dtype=np.uint64)))) for _ in range(2))
        differ = np.unpackbits((a ^ b).view(np.uint8), bitorder="little")
        far.append(differ.sum())
        met += any(not differ[t].any() for t in tables)
    assert max(far) <= simhash.SET_RADIUS and abs(np.mean(far) - simhash.SET_BITS) < 2 and met > 0.95 * 300


@pytest.mark.parametrize("split", [None, 0, 90])
def test_near_rows_equal_popcount(split):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, (20, 4), dtype=np.uint64)
    fps = base[rng.integers(0, 20, 300)] ^ rng.integers(0, 2**63, (300, 4), dtype=np.uint64) & rng.integers(0, 2**63, (300, 4), dtype=np.uint64)
    roots = np.minimum(rng.integers(0, 12, 300), 6)
    link = (np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2) <= 90) & (roots[:, None] != roots[None])
    if split is not None:
        side = np.arange(300) >= split
        link &= side[:, None] != side[None]
    found = simhash.near_rows(fps[:split], None if split is None else fps[split:], roots, 90, step=64)
    assert (found == link.any(axis=1)).all() and (split == 0 or 0 < found.sum() < 300)


def test_fingerprints_propose_without_bands(spark):
    """No bucket of minimum hashes at all: fingerprint bits bring the alike sets together, the sets decide."""
    rng = np.random.default_rng(6)
    sets = {}
    for i in range(700):
        both = rng.integers(0, 2**63, 95, dtype=np.uint64)
        for side in "ab":
            sets[f"{i:04d}{side}"] = np.unique(np.append(both, rng.integers(0, 2**63, 5 if i % 2 else 40, dtype=np.uint64)))
    firsts = spark.createDataFrame([(n, bytearray(simhash.set_fingerprint(x).tobytes())) for n, x in sets.items()], "name string, fp binary")
    none = spark.createDataFrame([], "bucket long, name string")
    near = simhash._near_places(none, firsts, spark.createDataFrame([], "node string, root string"))
    found = simhash._rest_links(near, spark.createDataFrame([(n, bytearray(x.tobytes())) for n, x in sets.items()], "name string, shingles binary")).collect()
    pairs = {tuple(sorted((r["u"], r["v"]))) for r in found}
    assert pairs <= {(f"{i:04d}a", f"{i:04d}b") for i in range(1, 700, 2)} and len(pairs) > 0.98 * 350


def test_blocks_of_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(2)
    near = {int(x) for x in np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64))}
    far = {int(x) for x in rng.integers(0, 2**63, 60)}
    values = sorted(near | far)
    fps = spark.createDataFrame([(f"{v:016x}", i) for i, v in enumerate(values)], "fp string, first long")
    found = simhash.components(simhash.links(fps, simhash.plan_tables(len(values), 64, 4), 4)).collect()
    root = {r["node"]: r["root"] for r in found}
    label = groups(values, lambda a, b: (a ^ b).bit_count() <= 4)
    mine = [root.get(f"{v:016x}", f"{v:016x}") for v in values]
    assert all((label[i] == label[j]) == (mine[i] == mine[j]) for i, j in itertools.combinations(range(len(values)), 2))


def test_components_of_a_chain_and_a_star(spark):
    edges = [(f"{i:04d}", f"{i + 1:04d}") for i in range(120)] + [("5000", f"{i:04d}") for i in range(5001, 5200)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert {got[f"{i:04d}"] for i in range(121)} == {"0000"} and {got[f"{i}"] for i in range(5000, 5200)} == {"5000"}


def test_near_duplicates_keep_one(docs, none):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and simhash.drop_near_duplicates(none).count() == 0
    texts = [r["text"] for r in kept.collect()]
    rows = documents()
    assert texts.count(rows[0][1]) == 1 and texts.count(rows[5][1]) == 1 and sum(t is None or not t.strip() for t in texts) == 1
    assert {t for t in texts if t} >= {r[1] for r in rows[8:40]}


def brute_repeats(rows, size=13):
    words = [(i, WORD.findall((t or "").encode())) for i, t, *_ in rows]
    least = {}
    for i, w in words:
        for k in range(len(w) - size + 1 if i is not None else 0):
            g = tuple(w[k : k + size])
            least[g] = min(least.get(g, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1 if i is not None else 0):
            if least[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((str(i), len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeats_equal_brute_force(spark, docs, none):
    assert recompress.remove_repeats(none).count() == 0
    random.seed(4)
    more = [(9000 + i, " ".join(random.choice("abcd"[: random.randint(1, 4)]) for _ in range(random.randint(0, 150))), "", "", 0) for i in range(120)]
    rows = documents() + more
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(6)
    got = sorted((str(r[0]), *r[1:]) for r in recompress.remove_repeats(df, digest=True).collect())
    assert got == brute_repeats(rows)
    text = {(str(r["doc_id"]), r["text"] or ""): r for r in recompress.remove_repeats(docs, keep=["doc_id", "text", "row", "batch"]).collect()}
    assert len(text) and all(r["kept"] == (r["text"] or "") for r in text.values() if not r["n_removed"]) and {r["row"] for r in text.values()} == {"r"}


def test_seeds_are_found_without_sorting(monkeypatch):
    """Seeds are numbered in order of their symbols; no sort of all windows is made for that."""
    rng = np.random.default_rng(8)
    words = rng.integers(0, 40, 3000).astype(np.uint64)
    starts, ends = np.array([0, 5, 1200]), np.array([5, 1200, 3000])
    batch = recompress.Batch(np.arange(3), np.arange(3), words, starts, ends)
    monkeypatch.setattr(np, "unique", None)
    names, places, windows, seed = batch.seeds()
    assert len(windows) == len(seed) == 1195 - 12 + 1800 - 12 and (np.bincount(seed, minlength=len(names)) > 0).all()
    assert ((windows <= places[seed]) & (places[seed] < windows + recompress.WINDOW)).all()


def test_symbols_depend_only_on_their_stretch():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 5, 4000).astype(np.uint64)
    names = {}
    s = recompress.recompress(words, np.array([0]), np.array([4000]))
    for name, lo, hi, a, b in zip(s.name, s.lo, s.hi, s.dlo, s.dhi, strict=True):
        if a >= 0 and b <= 4000:
            assert names.setdefault((tuple(words[a:b]), lo - a, hi - a), name) == name


def test_every_plain_character_equals_library():
    import public_tokenizers

    from lamina.llm import wordbpe

    encoder = wordbpe.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), list)
    texts = [t for c in map(chr, range(0x250)) for t in (f"m{c}n", f"m{c}", f"{c}{c}", f"{c}n", f"1{c}2", f",{c}.")]
    assert not any(map(encoder.plain, ("m\xb2", "km\xb3", "\xb9", "\xbc", "\xbd\xbd", "\xbe")))
    for text in texts:
        assert [i for part in encoder.parts(text) for i in part] == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_long_documents_are_joined(spark):
    """Documents of the real table go through halves and joins, and equal the library."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from lamina.llm.queries import op8_bpe

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, encoder = Tokenizer.from_file(path), bpe._encoder(path, "ids")
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    long = [t for t in texts.values() if len(t) > bpe.PART]
    joins = [sum(not a[-1].isspace() and not b[0].isspace() for a, b in itertools.pairwise(p[0] for p in bpe.parts_of(encoder, t))) for t in long]
    assert len(long) >= 5 and sum(joins) >= 5
    for r in op8_bpe(spark, "/root/testdata/sf0.01").collect():
        ids = tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_tokens_equal_library(spark, docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    random.seed(5)
    odd = ["it's we'll DON'T !!'s ''s 12³ x y ́ é é İ J̌ Σας <|endoftext|>a<|startoftext|> ok", "x\x1cy\x85z", "%$" * 4000, "".join(random.choice("abcdefgh") for _ in range(200_000)), "word " * 500 + "q" * 140_000 + "́ end"]
    rows = [(r[0], r[1]) for r in documents()] + [(5000 + i, t) for i, t in enumerate(odd)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ids = sorted((str(r["id"]), list(r["ids"])) for r in bpe.bpe_encode(df, path).collect())
    expected = sorted((str(i), tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in rows)
    assert ids == expected
    assert bpe.bpe_encode(none, path, digest=True).count() == 0
    some = spark.createDataFrame([(1, expected[3][1]), (2, None), (3, [])], "id long, ids array<int>")
    assert {r["id"]: r["text"] for r in bpe.bpe_decode(some, path).collect()} == {1: tokenizer.decode(expected[3][1], skip_special_tokens=False), 2: "", 3: ""}
    # files: order, starts, checksums, and fetching two documents
    manifest = tokenfile.write_token_files(df, path, _folder(spark), end_id=2, partitions=3)
    got = [(r["id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenfile.read_token_files(manifest).orderBy("start").collect()]
    at, want = 0, []
    signed = lambda t: (xxhash.xxh64_intdigest(t, 42) ^ 1 << 63) - (1 << 63)
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0], signed(r[1] or ""))):
        x = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    assert got == want
    asked = spark.createDataFrame([(5001,), (12,), (99999,), (None,)], "doc_id long")
    found = tokenfile.read_documents(manifest, asked).collect()
    fetched = {r["id"]: list(r["ids"]) for r in found}
    assert len(found) == 4 and set(fetched) == {5001, 12, None} and fetched[5001] == [*tokenizer.encode(odd[1], add_special_tokens=False).ids, 2]
    assert tokenfile.token_round_trip(none, path, 2).count() == 0


def _folder(spark):
    from lamina.llm.common import work_path

    return work_path(spark, "test-tokens")


def test_word_caches_are_small():
    """A worker that meets 400,000 different words takes less than 110 MB for vocabulary and caches."""
    code = """
import public_tokenizers
from lamina.llm import tokenfile
from lamina.llm.wordbpe import encoder
size = lambda field: next(int(line.split()[1]) for line in open("/proc/self/status") if line.startswith(field))
before = size("VmRSS")
enc = encoder(public_tokenizers.path("word_bpe_49k.json"), "u32", tokenfile._u32)
for i in range(0, 400_000, 100):
    enc.parts(" ".join("q" + "".join(chr(97 + int(c)) for c in str(j * 7919)) for j in range(i, i + 100)))
print(size("VmHWM") - before)
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, check=True)
    assert int(done.stdout) < 110 * 1024


def test_damage_is_found(tmp_path):
    from pyarrow import fs

    store = fs.LocalFileSystem()
    writer = tokenfile.TokenFileWriter(store.open_output_stream(str(tmp_path / "t")))
    data = np.arange(200_000, dtype="<u4")
    writer.add(1, data.tobytes())
    writer.add(2, b"")
    writer.close()
    reader = tokenfile.TokenFileReader(store.open_input_file(str(tmp_path / "t")))
    assert (reader.read(0) == data).all() and len(reader.read(1)) == 0 and len(reader.frames) == 4
    raw = bytearray((tmp_path / "t").read_bytes())
    raw[int(reader.frames[1][0]) + 40] ^= 1
    (tmp_path / "t").write_bytes(raw)
    reader = tokenfile.TokenFileReader(store.open_input_file(str(tmp_path / "t")))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        reader.read(0)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000])
def test_permutation(n):
    f = shard.Feistel(n, 42)
    p = f.forward(np.arange(n))
    assert sorted(p) == list(range(n)) and (f.inverse(p) == np.arange(n)).all()
    s, k = shard.locate(n - 1, n, 4)
    assert shard.row_at(s, k, n, 4) == n - 1


def test_shards(docs, none):
    rows = shard.shard_documents(docs, 5).collect()
    assert len(rows) == len(documents()) and shard.shard_documents(none).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by.get(i, [])) for i in range(5)]
    assert max(sizes) - min(sizes) <= 1
    for r in rows:
        assert shard.locate(r["row_no"], len(rows), 5) == (r["shard"], r["slot"])
    assert rows == shard.shard_documents(docs, 5).collect() or sorted(map(str, rows)) == sorted(map(str, shard.shard_documents(docs.repartition(2), 5).collect()))


def test_rank_within(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(200)], "b int, k long")
    got = salted_rank(df, ["k"], "r", [df["b"]], 8).collect()
    for b in range(3):
        assert sorted(r["r"] for r in got if r["b"] == b) == list(range(sum(r["b"] == b for r in got)))


def test_rank_with_frequent_keys(spark):
    """A third of all rows have one key: its rows are dealt over salts, and the numbers stay gapless and ordered."""
    df = materialise(spark.createDataFrame([(i % 2, None if i % 3 == 0 else i, 1) for i in range(9000)], "b int, k long, m int"), "hot")
    got = salted_rank(df, ["k", "m"], "r", [df["b"]], 8).collect()
    for b in range(2):
        some = [r for r in got if r["b"] == b]
        assert sorted(r["r"] for r in some) == list(range(4500))
        hot = sorted(r["r"] for r in some if r["k"] is None)
        assert hot == list(range(3000, 4500))
    again = {(r["b"], r["k"]): r["r"] for r in salted_rank(df.repartition(3), ["k", "m"], "r", [df["b"]], 8).collect() if r["k"]}
    assert again == {(r["b"], r["k"]): r["r"] for r in got if r["k"]}


def test_bucket_bounds_are_optimal():
    random.seed(8)
    for _ in range(60):
        n, k = random.randint(1, 8), random.randint(1, 4)
        lengths = sorted(random.sample(range(1, 60), n))
        counts = [random.randint(1, 9) for _ in lengths]
        cost = lambda bounds: sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts, strict=True))  # noqa: E731, B023
        best = min(cost([*c, lengths[-1]]) for m in range(k) for c in itertools.combinations(lengths[:-1], min(m, n - 1)))
        got = packing.bounds_of(np.array(lengths), np.array(counts), k)
        assert len(got) <= k and got[-1] == lengths[-1] and cost(got) == best


def test_packing(docs, none):
    got = packing.pack_documents(docs, buckets=4, budget=500).collect()
    assert len(got) == len(documents()) and packing.pack_documents(none).count() == 0
    batches = {}
    for r in got:
        assert r["length"] <= r["bucket_length"]
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    for rows in batches.values():
        assert len(rows) == 1 or len(rows) * rows[0]["bucket_length"] <= 500
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))


def test_lengths_are_exact(spark):
    """As many buckets as lengths: no padding at all, however long the rows."""
    df = spark.createDataFrame([(i, x) for i, x in enumerate([16384, 16385, 40_000, 10**7 + 3, 5, None])], "id long, length long")
    assert all(r["length"] == r["bucket_length"] for r in packing.pack(df, buckets=6, budget=100).collect())


def test_padding_is_least_over_real_lengths(spark):
    """The whole query's padding equals a plain dynamic programme's over the table's lengths."""
    from lamina.llm.queries import op2_packing

    got = op2_packing(spark, "/root/testdata/sf0.01").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert {r["doc_id"]: r["length"] for r in got} == {i: len(WORD.findall((t or "").encode())) + 1 for i, t in texts.items()}
    x, n = np.unique([r["length"] for r in got], return_counts=True)
    rows, tokens = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(n * x))
    best = np.append(0.0, np.full(len(x), np.inf))
    for _ in range(packing.BUCKETS):
        best = np.minimum(best, [0.0, *[(best[:j] + x[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])).min() for j in range(1, len(x) + 1)]])
    assert sum(r["bucket_length"] - r["length"] for r in got) == best[-1]
    batches = {}
    for r in got:
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    for (bucket, batch), some in batches.items():
        fit = max(1, packing.BUDGET // some[0]["bucket_length"])
        assert sorted(r["slot"] for r in some) == list(range(len(some))) and len(some) <= fit
        assert len(some) == fit or (bucket, batch + 1) not in batches


def brute_nearest(rows, k=5):
    """Every (id, vector) once; rows with a query's id are not its neighbours."""
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for q, a in ok:
        if q % 50:
            continue
        found = []
        for c, b in ok:
            if c != q and len(a) == len(b):
                x, y = np.array(a), np.array(b)
                found.append((-np.add.accumulate(x * y)[-1] / (np.sqrt(np.add.accumulate(x * x)[-1]) * np.sqrt(np.add.accumulate(y * y)[-1])), c))
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(sorted(found)[:k])]
    return sorted(out)


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(ann, "CANDIDATES", 37)
    monkeypatch.setattr(ann, "QUERIES", 3)
    monkeypatch.setattr(ann, "GROUP_Q", 2)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=9).astype("float32").astype(float).tolist()) for i in range(400)]
    hot = rows[0][1]
    rows += [(i, hot) for i in range(400, 470)] + [rows[0]]
    rows += [(500, None), (550, [0.0] * 9), (600, [float("nan")] * 9), (650, [1.0, None] + [0.0] * 7), (700, [float("inf")] + [1.0] * 8), (None, hot), (750, [1.0, 2.0]), (800, [1.0, 2.5]), (850, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, id int").repartition(4)
    got = sorted(tuple(r) for r in ann.nearest(df, df.where("vec_id % 50 = 0")).collect())
    assert got == brute_nearest(rows)
    none = df.where("false")
    assert ann.nearest(none, none).count() == 0 and ann.nearest(none, df).count() == 0


def test_nearest_with_repeated_ids(spark, monkeypatch):
    """Blocks that start with the same id, and ids with several vectors as queries and as candidates."""
    monkeypatch.setattr(ann, "CANDIDATES", 4)
    rng = np.random.default_rng(8)
    rows = [(i % 7 + (50 if i % 11 == 0 else 0), rng.normal(size=5).tolist()) for i in range(120)] + [(0, [1.0, 0.0, 0.0, 0.0, 0.0]), (9, [1.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    assert sorted(tuple(r) for r in ann.nearest(df, df.where("vec_id % 50 = 0")).collect()) == brute_nearest(rows)


def test_error_bound_holds():
    rng = np.random.default_rng(7)
    v = rng.normal(size=(200, 33)) * np.exp(rng.normal(size=(200, 1)) * 5)
    packed = {k: x[0] for k, x in ann.Tile.packed(v).items()}
    t = ann.Tile(33, 1, packed["narrow"], np.arange(200).tobytes(), packed["vectors"], packed["int8"], packed["bounds"])
    about = ann.int8_product(t.q, t.q) / (t.scale[:, None] * t.scale[None, :])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert (np.abs(about - u @ u.T) <= t.rest[:, None] + t.near[:, None] * t.rest[None, :] + 1e-9).all()


def test_tree_fingerprints(spark, docs, none):
    got = merkle.edit_fingerprints(docs).collect()
    rows = documents()
    assert len(got) == len(rows) and merkle.edit_fingerprints(none).count() == 0
    signed = lambda t: (xxhash.xxh64_intdigest(t, 42) ^ 1 << 63) - (1 << 63)
    order = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], signed(r[1] or "")))
    want = []
    for r, nxt in zip(order, [*order[1:], order[0]], strict=True):
        t, n = r[1] or "", nxt[1] or ""
        k = len(t) // 4
        want.append((str(r[0]), len(t), hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()))
    assert sorted((str(r["id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    mean = lambda c: sum(r[c] for r in got) / len(got)
    assert mean("near_edited") > mean("near_next")
    pair = spark.createDataFrame([("a. b.\nc d.\ne", "a. b.\nc x.\ne"), ("same", "same")], "p string, q string")
    pair = merkle.add_tree(merkle.add_tree(pair, "p", "p_"), "q", "q_")
    f, g = pair.p_fingerprint, pair.q_fingerprint
    assert [list(r[0]) for r in pair.select(merkle.differing(f, g)).collect()] == [[1], []]
    moved = spark.createDataFrame([("a\nb\nc\nd", "a\nc\nb\nd"), ("a\nb\nb", "a\nb"), ("a\nc", "a\nb\nc"), ("a\nb\nc", "a\nb\nx\nc")], "p string, q string")
    moved = merkle.add_tree(merkle.add_tree(moved, "p", "p_"), "q", "q_")
    assert [list(r[0]) for r in moved.select(merkle.differing(moved.p_fingerprint, moved.q_fingerprint)).collect()] == [[1, 2], [], [], []]
    fewer = docs.where("doc_id > 3").dropDuplicates(["doc_id", "text"])
    assert merkle.edit_fingerprints(fewer).count() == fewer.count()
    alone = spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")
    assert merkle.edit_fingerprints(alone).first()["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    assert dict(merkle.fingerprints(docs.limit(1)).dtypes)["fingerprint"] == "string"


def test_word_lists_over_slices():
    text = b"  a bb\tccc\x0bd\x0ce\rf\xc2\xa0g " * 50
    assert [w for part in word_lists(text, 17) for w in part] == WORD.findall(text)


SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, spark.read.parquet(f"{SF}/labels.parquet")


def held_out_pairs(scored, labels, label):
    rows = scored.join(labels.selectExpr("doc_id as id", f"{label} as y"), "id").where("held_out").select("y", "score").collect()
    return np.array([r["y"] for r in rows]), np.array([r["score"] for r in rows])


def auc(y, s):
    order = np.argsort(np.argsort(s, kind="stable"))
    return (order[y == 1].mean() - order[y == 0].mean()) / len(s) + 0.5


def test_quality_held_out(labelled):
    docs, labels = labelled
    y, s = held_out_pairs(quality.score_quality(docs, quality.train_quality(docs, labels)), labels, "quality")
    assert auc(y, s) > 0.97 and ((s >= 0.5) == (y == 1)).mean() > 0.95 and (s[y == 1] >= 0.5).mean() > 0.97


def test_toxicity_held_out(labelled):
    docs, labels = labelled
    y, s = held_out_pairs(toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels)), labels, "toxic")
    assert auc(y, s) > 0.97 and ((s >= 0.7) == (y == 1)).mean() > 0.95 and (s[y == 0] < 0.7).mean() > 0.98


def test_classifiers_on_odd_rows(spark, docs, none):
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, 1), (6, 1, 1), (9, 0, 0), (12, None, None), (None, 1, 1), (0, 1, 0)], "doc_id long, quality int, toxic int")
    for train, score, label in ((quality.train_quality, quality.score_quality, "quality"), (toxicity.train_toxicity, toxicity.score_toxicity, "toxic")):
        for lab in (labels, labels.limit(0)):
            model = train(docs, lab, label=label)
            rows = score(docs, model).collect()
            assert len(rows) == len(documents()) and all(0 <= r["score"] <= 1 for r in rows)
            assert score(none, model).count() == 0
            both = score(docs, model, keep=True)
            assert sorted((str(r["row"]["doc_id"]), r["score"]) for r in both.collect()) == sorted((str(r["id"]), r["score"]) for r in rows)
            kept = both.select("row.*")
            assert kept.columns == docs.columns and kept.count() == len(rows)
    assert {r["id"]: r["h"] for r in docs.select("doc_id", learn.held_out(docs["doc_id"]).alias("h")).selectExpr("doc_id as id", "h").collect() if r["id"] is not None} == {r[0]: zlib.crc32(str(r[0]).encode()) % 3 == 1 for r in documents() if r[0] is not None}


def test_gradients():
    rng = np.random.default_rng(1)
    net = toxicity.Net.fresh(rng.normal(size=20))
    docs = [rng.integers(0, 21, n).astype(np.int32) for n in (0, 1, 5, 30)]
    y, w = np.array([0, 1, 1, 0]), np.ones(4, np.float32)

    def loss():
        z = net.logits(docs)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    for p, g in zip(net.params(), net.gradients(docs, y, w), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        if g is net.params()[0] or abs(g[at]) < 1e-5:
            continue
        old = p[at]
        p[at] = old + 2e-3
        up = loss()
        p[at] = old - 2e-3
        down = loss()
        p[at] = old
        assert abs((up - down) / 4e-3 - g[at]) < 0.05 * abs(g[at]) + 2e-3


def test_chunked_pooling_equals_whole(monkeypatch):
    rng = np.random.default_rng(2)
    net = toxicity.Net.fresh(rng.normal(size=50))
    docs = [rng.integers(0, 51, n).astype(np.int32) for n in (0, 3, 200, 77)]
    whole = net.pooled(docs)
    assert np.allclose(whole, np.vstack([net.pooled([d]) for d in docs]), atol=1e-5)
    monkeypatch.setattr(toxicity, "CHUNK", 16)
    assert np.allclose(whole, net.pooled(docs), atol=1e-5)


def test_tables_survive(spark, docs):
    assert materialise(docs, "t").count() == len(documents())


def test_shards_against_plain_integers(spark):
    """The whole query against a permutation written with Python's integers."""
    from lamina.llm.queries import op7_sharding

    mask64 = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask64
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask64
        return x ^ x >> 31

    rows = op7_sharding(spark, "/root/testdata/sf0.01").collect()
    n = len(rows)
    half = -(-(n - 1).bit_length() // 2)
    keys = [mix(r + 42 * 1000003) for r in range(1, shard.ROUNDS + 1)]

    def place(x):
        while True:
            left, right = x >> half, x & (1 << half) - 1
            for k in keys:
                left, right = right, left ^ (mix(right ^ k) & (1 << half) - 1)
            x = left << half | right
            if x < n:
                return x

    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert sorted(r["row_no"] for r in rows) == list(range(n))
    for r in rows:
        p = place(r["row_no"])
        assert (r["shard"], r["slot"]) == (p % 16, p // 16) and r["law"] == "rows" and r["grown_shard"] is None
        assert (r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]]))


def test_network_against_loops():
    """Responses, pooling and the logistic layer written as loops over words."""
    rng = np.random.default_rng(4)
    net = toxicity.Net.fresh(rng.normal(size=30) * 4)
    docs = [rng.integers(0, 31, n).astype(np.int32) for n in (0, 1, 2, 9, 40)]
    for d, got in zip(docs, net.logits(docs), strict=True):
        padded = [net.emb[i] for i in d] + [net.emb[0]] * 4
        features = []
        for w, f, bias in zip(toxicity.WIDTHS, net.filters, net.bias, strict=True):
            best = np.max([sum(padded[a + j] @ f[j] for j in range(w)) for a in range(max(1, len(d)))], axis=0)
            features += list(np.maximum(best + bias, 0))
        assert abs(float(np.array(features) @ net.out + net.out_bias[0]) - got) < 1e-4


def test_squeezed_rows_give_the_same_response():
    rng = np.random.default_rng(5)
    net = toxicity.Net.fresh(rng.normal(size=9) * 4)
    for _ in range(20):
        d = (rng.integers(1, 10, 60) * (rng.random(60) < 0.1)).astype(np.int32)
        short = toxicity.squeeze(d)
        assert len(short) < len(d) and np.allclose(net.logits([d]), net.logits([short]), atol=1e-5)


def test_samples_are_whole_and_bounded(spark):
    rows = [(i, "x" * (50 if i % 4 else 400), "en") for i in range(200)] + [(8, "another", "en")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, y int")
    found = learn.labelled_texts(docs, labels, "y", 30, 1000, lang_col="lang").collect()
    texts = {(i, t) for i, t, _ in rows}
    assert all((r["id"], r["text"]) in texts and zlib.crc32(str(r["id"]).encode()) % 3 != 1 for r in found)
    assert len({r["id"] for r in found}) == len(found)
    for y in (0, 1):
        some = [r["text"] for r in found if r["y"] == y]
        assert 0 < len(some) <= 30 and sum(map(len, some)) <= 1000
    # the size of the sample grows with its bounds up to every row that may be learnt from
    every = learn.labelled_texts(docs, labels, "y", 1000, 1 << 20).count()
    assert every == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(200))


def test_scores_are_the_compressed_sizes(spark):
    """Quality scores against plain zstandard calls with the model's dictionaries."""
    texts = ["good words in a row " * 9, "", "zz zq zz", "good bad " * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = quality.QualityModel(b"good words in a row " * 20, b"zz zq bad " * 20, learn.Logistic(np.random.default_rng(1).normal(size=(40, 9)), np.arange(40) % 2.0))
    got = {r["id"]: r["score"] for r in quality.score_quality(docs, model).collect()}

    def size(dictionary, data):
        plain = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(plain.compress(data))

    for i, t in enumerate(texts):
        g, b, n = size(model.good, t.encode()), size(model.bad, t.encode()), len(t.encode())
        d, r, s = (b - g) / max(g, b), min(g, b) / max(n, 1), np.log1p(n)
        assert abs(got[i] - model.curve(np.array([[d, r, s, d * s, r * s, r * r, d * r, s * s, d * d * np.sign(d)]]))[0]) < 1e-12


def test_sql_of_operators(spark):
    """The registered queries against their SQL over whole tables."""
    import duckdb

    from lamina.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        mine = QUERIES[name](spark, "/root/testdata/sf0.001")
        names = sorted(mine.columns)
        theirs = con.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
        tidy = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
        assert sorted(map(tidy, theirs)) == sorted(tidy(r[n] for n in names) for r in mine.collect()), name


def test_work_tables_and_shuffle_files_go(spark, tmp_path, monkeypatch):
    from lamina.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda s: f"file://{tmp_path}")
    docs = spark.createDataFrame([(i, " ".join(f"w{i // 3}_{j}" for j in range(40 + i % 3))) for i in range(90)], "doc_id long, text string")
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: disk.getAllFiles().mkString("\n").count("shuffle_")
    before = held()
    table = common.materialise(docs.repartition(3, "doc_id"), "dealt")
    until = time.time() + 10
    while held() > before and time.time() < until:
        time.sleep(0.1)
    assert held() <= before and table.count() == 90
    kept = simhash.drop_near_duplicates(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 90, 3))
    # the sketches and roots that the result is read from, and its heads
    assert sorted(p.name.split("-")[1] for p in tmp_path.iterdir()) == ["dealt", "heads", "roots", "sketches"]


@pytest.mark.parametrize("few", [0, 1 << 16])
def test_components_in_one_task_and_in_rounds(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW_LINKS", few)
    rng = np.random.default_rng(8)
    edges = [(f"n{a:03d}", f"n{b:03d}") for a, b in rng.integers(0, 300, (180, 2)).tolist()] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)]
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for u, v in edges * 2:
        if u != v and root[u] != root[v]:
            low, high = sorted((root[u], root[v]))
            root = {x: low if r == high else r for x, r in root.items()}
    got = [(r["node"], r["root"]) for r in simhash.components(spark.createDataFrame(edges, "u string, v string")).collect()]
    assert len(got) == len(root) and dict(got) == root


def test_group_of_many_buckets_comes_once(spark):
    rng = np.random.default_rng(9)
    firsts = [(f"{i:03d}", rng.integers(0, 2**63, 4, dtype=np.uint64)) for i in range(40)]
    firsts += [("copy", firsts[7][1] ^ np.array([1, 0, 2, 0], np.uint64))]
    places = spark.createDataFrame([(b, n) for b in range(5) for n in ("007", "copy", f"{20 + b:03d}")], "bucket long, name string")
    near = simhash._near_places(places, spark.createDataFrame([(n, bytearray(f.tobytes())) for n, f in firsts], "name string, fp binary"), spark.createDataFrame([], "node string, root string")).collect()
    assert sorted(r["name"] for r in near) == ["007", "copy"] and len({r["pair"] for r in near}) == 1


def test_frequent_words_stay_cached(monkeypatch):
    import public_tokenizers

    from lamina.llm import wordbpe

    monkeypatch.setattr(wordbpe, "CACHE", 64)
    made = []
    encoder = wordbpe.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), lambda ids: made.append(tuple(ids)) or ids)
    the = tuple(encoder.tokenizer.encode("the", add_special_tokens=False).ids)
    for i in range(500):
        got = encoder.parts(f"the w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100]}, the")
        assert tuple(got[0]) == the == tuple(got[2])
    assert made.count(the) == 1 and len(encoder.chunks) <= 64 and len(encoder.chunks.older) <= 64


def test_joined_forms_equal_the_library():
    import public_tokenizers

    from lamina.llm import wordbpe

    encoder = wordbpe.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), tokenfile._u32, b"".join)
    for text in ("it's 'tis a,b ,, ...", "don't, 12.5% of x_y (that)!", "&&' 's '' ll'll", "\u00e9t\u00e9, na\u00efve. \u00b1\u00e7"):
        for _ in range(2):
            assert b"".join(encoder.parts(text)) == tokenfile._u32(encoder.tokenizer.encode(text, add_special_tokens=False).ids), text


@pytest.mark.parametrize("size", [1 << 22, 50])
def test_word_hashes_of_a_batch(monkeypatch, size):
    """Equal words, and no others, have equal hashes, wherever they stand and however a text is sliced."""
    monkeypatch.setattr(recompress, "SLICE", size)
    random.seed(14)
    words = [b"", *(bytes(random.choices(b"ab\0\xff", k=k)) for k in [*range(1, 30)] * 4), b"x" * 255, b"x" * 256, b"x" * 257, b"x" * 258, b"y" * 5000]
    texts = [b"", b" \t\n\x0b\x0c\r", *(random.choice(b" \t\n\x0b\x0c\r").to_bytes() * random.randint(0, 2) + b" ".join(random.choices(words, k=60)) for _ in range(40)), b""]
    skip = np.arange(len(texts)) % 7 == 3
    got = recompress.load(np.arange(len(texts)), texts, skip)
    expected = [WORD.findall(t) for t, out in zip(texts, skip, strict=True) if not out]
    assert (got.ends - got.starts).tolist() == list(map(len, expected)) and got.starts[0] == 0 and got.ends[-1] == len(got.words)
    every = [w for t in expected for w in t]
    for hashes in (got.words, got.others):
        assert len(set(zip(every, hashes.tolist(), strict=True))) == len(set(every)) == len(set(hashes.tolist()))
    assert not set(got.words.tolist()) & set(got.others.tolist())


def test_keys_that_begin_alike():
    keys = np.array([[5, 2], [1, 9], [5, 1], [5, 2], [1, 9], [0, 0]], np.uint64)
    found, low, high, place = recompress.distinct_keys(keys, np.array([4, 3, 2, 1, 0, 5]))
    assert found.tolist() == [[0, 0], [1, 9], [5, 1], [5, 2]] and low.tolist() == [5, 0, 2, 1] and high.tolist() == [5, 3, 2, 4] and place.tolist() == [3, 1, 2, 3, 1, 0]
