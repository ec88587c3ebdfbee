"""Each operator on a small table of hard cases, against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("candlework.llm")
from candlework.llm import ann, chat, mixing, packing, quality, rans, simhash, suffix, token_counts, token_files, urls  # noqa: E402
from candlework.llm.tokens import Encoder, public_path  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, tag string, rank int"


def texts():
    draw = random.Random(3)
    words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(draw.choice(words) for _ in range(n))
    base, passage = prose(120), prose(60)
    return [base, base, base.replace(words[0], "changed", 1), prose(40) + "\n" + passage + " end", "start " + passage + "\n" + prose(30), None, "", "  \n ", "one", "Ü, " * 400, prose(6000), prose(15), "a  b\tc it's 12 <|endoftext|>!"]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, "x", 1) for i, (t, s) in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, (t, ("a", "b", None)[i % 3])) for i, t in enumerate(texts())]
    return table(spark, rows), {i: t or "" for i, (t, _) in rows}


def test_encoder_equals_one_call():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = Encoder(public_path(name))
        plain = e.tokenizer.encode_batch([t or "" for t in texts()], add_special_tokens=False)
        assert e.encode(texts()) == [np.array(x.ids, "<u4").tobytes() for x in plain]


def test_packing(spark, docs):
    df, by_id = docs
    rows = packing.pack(packing.pieces(df, capacity=256), 256, group_rows=8).collect()
    e = Encoder(public_path(packing.TOKENIZER))
    ids = {i: e.encode([t])[0] + (2).to_bytes(4, "little") for i, t in by_id.items()}
    filled = Counter()
    for r in rows:
        assert 0 < r.length <= 256 and zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 256 and sum(filled.values()) == sum(len(x) // 4 for x in ids.values())
    for s in filled:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
    sizes = np.array([r.length for r in rows])
    assert packing.bin_bound(sizes, 256) <= len(filled) <= packing.bin_bound(sizes, 256) + 3


def test_bin_bound_never_exceeds_a_packing():
    draw = random.Random(1)
    for _ in range(200):
        sizes = np.array([draw.randint(1, 20) for _ in range(draw.randint(1, 40))])
        assert packing.bin_bound(sizes, 20) <= packing.best_fit_decreasing(sizes, 20)[1]


def brute_components(fps, radius):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash(spark, docs):
    df, by_id = docs
    ids = sorted(by_id)
    fps = [simhash.fingerprint(by_id[i]) for i in ids]
    want = {i: (f"{f:016x}", ids[c]) for i, f, c in zip(ids, fps, brute_components(fps, 4), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()} == want


def test_links_of_random_fingerprints(spark):
    draw = random.Random(5)
    seeds = [draw.getrandbits(64) for _ in range(60)]
    fps = sorted({s ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 5))) for s in seeds for _ in range(8)})
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, node long")
    edges = [(r.u, r.v) for r in simhash.links(nodes, shard=64).collect()]
    root = list(range(len(fps)))
    for _ in range(20):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    assert root == brute_components(fps, 4)


def test_drop_near_duplicates(spark, docs):
    df, _ = docs
    assert {r.doc_id for r in simhash.drop_near_duplicates(df).collect()} >= {0, 9, 12, 24, 27, 30}
    kept = [r.doc_id for r in simhash.drop_near_duplicates(df.unionByName(df)).collect()]
    assert 3 not in kept and len(kept) == len(set(kept))


def test_cover_returns_every_pair_or_both_ends():
    draw = random.Random(8)
    seeds = [draw.getrandbits(64) for _ in range(4)]
    fp = np.array([s ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 8))) for s in seeds for _ in range(40)], np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 11
    for levels in (0, 1, 3, 100):
        a, b, rest = simhash.cover(lambda i, j: near[i, j], len(fp), levels)
        pairs = {frozenset(x) for x in zip(a.tolist(), b.tolist(), strict=True)}
        assert all(near[i, j] for i, j in zip(a, b, strict=True)) and (levels < 100 or not len(rest))
        assert all(frozenset((i, j)) in pairs or {i, j} <= set(rest.tolist()) for i in range(len(fp)) for j in range(i) if near[i, j])


def test_drop_leaves_no_close_pair_and_no_orphan(spark):
    draw = random.Random(9)
    words = ["".join(draw.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    rows = []
    for _ in range(6):
        base = [draw.choice(words) for _ in range(80)]
        for _ in range(40):  # from equal to clearly different, so that many pairs are near in bits only
            own = base[:]
            for k in draw.sample(range(80), draw.choice((0, 0, 1, 2, 4, 8))):
                own[k] = draw.choice(words)
            rows.append(" ".join(own))
    rows += ["", None, "  ", "one two", "One  TWO"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_near_duplicates(df).collect()}
    fps = [simhash.fingerprint(t, 5) for t in rows]
    like = [[j for j in range(i) if simhash.similarity(rows[i], rows[j]) >= 0.8] for i in range(len(rows))]
    assert all(like[i] for i in set(range(len(rows))) - kept)
    assert not [(i, j) for i in kept for j in like[i] if j in kept and (fps[i] ^ fps[j]).bit_count() <= 11]
    assert {240, 243} <= kept and not {241, 242, 244} & kept


def test_drop_judges_copies_of_a_removed_text(spark):
    draw = random.Random(12)
    words = ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    base, rows = [draw.choice(words) for _ in range(400)], []
    for _ in range(40):
        own = base[:]
        for k in draw.sample(range(400), 7):
            own[k] = draw.choice(words)
        rows.append(" ".join(own))
    for at in (0, 1, 20):
        texts_ = rows[:at] + [" ".join(base)] + rows[at:]
        kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")).collect()}
        assert kept == {i for i in range(41) if not any(simhash.similarity(texts_[i], texts_[j]) >= 0.8 for j in range(i))}
        assert len(kept) <= max(1, at)


def test_minhashes_propose_all_pairs_of_the_stated_similarity():
    draw = random.Random(13)
    missed = total = 0
    for _ in range(1500):
        base = [str(draw.randrange(10**6)) for _ in range(200)]
        own = base[:]
        for k in draw.sample(range(200), 4):
            own[k] = "x"
        if not 0.8 <= simhash.similarity(" ".join(base), " ".join(own)) < 0.85:
            continue
        a, b = simhash.minhashes(" ".join(base)), simhash.minhashes(" ".join(own))
        bands = (a == b).reshape(simhash.BANDS, simhash.BAND_ROWS).all(axis=1)
        total, missed = total + 1, missed + (not bands.any() or (a == b).mean() < 0.8 - simhash.SLACK)
    assert total > 500 and missed <= 1


def test_quality(spark, docs):
    df, by_id = docs
    rows = {r.doc_id: r for r in quality.judge(df).collect()}
    for i, t in by_id.items():
        words = t.encode().split()
        seen = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        covered = {p for k in range(len(words) - 4) if seen[tuple(words[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        r = rows[i]
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines) == (len(words), len(covered), len(lines) - len(set(lines)))
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words)) and not (r.kept and r.base_failed)
    assert quality.keep(df).columns == df.columns


def test_mixing(spark):
    draw = random.Random(2)
    rows = [(i, (" ".join(["w"] * draw.randint(1, 40)), draw.choice(["a", "b", "c", None]))) for i in range(400)] + [(1000 + i, ("w " * 5, "tiny")) for i in range(3)] + [(2000, (None, "a"))]
    df = table(spark, rows)
    got = mixing.mix(df).collect()
    assert got == mixing.mix(df).collect() or sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df).collect()), key=str)
    by = {}
    for r in got:
        by.setdefault(r.source, [r.target, r.source_size, 0])[2] += r.copies * r.size
        assert 0 <= r.copies <= 3
    assert sum(x[0] for x in by.values()) == pytest.approx(sum(x[1] for x in by.values()))
    assert all(x[0] <= 3 * x[1] + 1e-9 and abs(x[2] - x[0]) <= 20 for x in by.values())
    assert mixing.mixed(df).columns == df.columns


def test_rans_round_trip():
    draw = np.random.default_rng(1)
    for n in (0, 1, 63, 5000):
        ids = draw.integers(0, 300, n) ** 2
        table_ = rans.Table.of_counts(*np.unique(ids, return_counts=True))
        block = rans.encode(ids, table_, every=8)
        assert (rans.decode(block, table_) == ids).all()
        marks = rans.HEAD.unpack_from(block)[4]
        assert (np.concatenate([rans.decode(block, table_, k, k + 1) for k in range(marks)]) == ids).all()
        if n > 100:
            with pytest.raises(ValueError):
                rans.decode(block[:-1] + bytes([block[-1] ^ 1]), table_)


def test_token_files(spark, docs, tmp_path):
    df, by_id = docs
    token_files.write(token_files.tokens(df), str(tmp_path / "set"), block_tokens=500, shard_tokens=2000)
    rows = {r.doc_id: r for r in token_files.read_back(spark, str(tmp_path / "set")).collect()}
    e, at = Encoder(public_path(token_files.TOKENIZER)), 0
    for i in sorted(by_id):
        ids = e.encode([by_id[i]])[0] + (2).to_bytes(4, "little")
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4


def test_token_counts(spark, docs):
    df, _ = docs
    n = [r.n_tokens for r in token_counts.lengths(df).collect()]
    sums = token_counts.suffix_sums(token_counts.histogram(token_counts.lengths(df)))
    for r in sums.collect():
        assert r.truncated_tokens == sum(min(x, r.context_limit) for x in n) and r.docs_over == sum(x >= r.context_limit for x in n)
    assert token_counts.at_limit(sums, 100).first().truncated_tokens == sum(min(x, 100) for x in n)
    assert token_counts.quantile(sums, 0.5).first()[0] == sorted(n)[(len(n) - 1) // 2]


def brute_repeats(pieces, length):
    seen = Counter(p[i : i + length] for p in pieces for i in range(len(p) - length + 1))
    return [np.array([seen[p[i : i + length]] > 1 for i in range(len(p) - length + 1)], bool) for p in pieces]


def test_suffix_arrays():
    draw = random.Random(4)
    for _ in range(150):
        length, alphabet = draw.choice((3, 8, 13)), draw.choice((b"ab", b"abc\0", bytes(range(256)), b"a"))
        pieces = [bytes(draw.choice(alphabet) for _ in range(draw.randint(0, 50))) for _ in range(draw.randint(1, 6))]
        assert all((a == b).all() for a, b in zip(suffix.repeated(pieces, length), brute_repeats(pieces, length), strict=True))


@pytest.mark.parametrize("hot", [0, 2000])
def test_suffix_dedup(spark, docs, hot, monkeypatch):
    df, by_id = docs
    monkeypatch.setattr(suffix.repeats, "__defaults__", (200, 24, hot))
    rows = {r.doc_id: r for r in suffix.remove_repeats(df).collect()}
    pieces = [by_id[i].encode() for i in sorted(by_id)]
    for i, data, flags in zip(sorted(by_id), pieces, brute_repeats(pieces, 200), strict=True):
        gone = np.zeros(len(data), bool)
        for p in np.flatnonzero(flags):
            gone[p : p + 200] = True
        left = bytes(np.frombuffer(data, np.uint8)[~gone])
        assert (rows[i].n_removed, hashlib.sha256(bytes(rows[i].data)).digest()) == (int(gone.sum()), hashlib.sha256(left).digest())
    assert suffix.clean_texts(df).columns == df.columns


def test_neighbours(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(300, 16)).astype(np.float32)
    x[10:60] = x[5]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(df, df.where("vec_id % 20 = 0").select("vec_id")).collect()
    y = x.astype(np.float64)
    for q in range(0, 300, 20):
        score = (y * y[q]).sum(axis=1)
        score[q] = -np.inf
        best = np.lexsort((np.arange(300), -score))[:20]
        mine = sorted((r.rank, r.vec_id) for r in got if r.query_id == q)
        assert [v for _, v in mine] == best.tolist()
    assert {r.query_id for r in got} == set(range(0, 300, 20))


def test_neighbours_recall_where_the_index_answers(spark):
    x = np.random.default_rng(6).normal(size=(20000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    asked = range(0, 20000, 200)
    got = {q: set() for q in asked}
    for r in ann.search(df, df.where("vec_id % 200 = 0").select("vec_id")).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in asked:
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-score)[:20].tolist()))
    assert 0.95 <= hits / (20 * len(asked))


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://WWW.Example.com/en/x?a#b"), (2, "https://a.example.com/en/1"), (3, "http://b.com"), (4, None), (5, "no scheme"), (6, "http://x.net/es/1"), (7, "http://q.org/a")], "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(pages, urls.train([])).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert (got[2].rule, got[2].verdict) == ("example.com/en/", "block") and got[3].rule is None
    assert (got[4].host, got[4].path, got[5].host, got[5].path) == ("", "", "", "") and got[6].verdict == "block"


def test_url_model_on_held_out_rows(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    rows = [(list(r.x), r.y) for r in urls.labelled(pages).collect()]
    weights = urls.train(rows[::2])
    z = [weights[-1] + sum(weights[b] for b in x) / max(1, len(x)) ** 0.5 for x, _ in rows[1::2]]
    assert np.mean([(a > 0) == bool(y) for a, (_, y) in zip(z, rows[1::2], strict=True)]) > 0.9


def test_chats(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "bot", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "bot", "yo"), (4, 0, None, None), (5, 0, "user", "hi"), (5, 1, "bot", "other"), (None, 0, "user", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.text for r in chat.format_chats(df).collect()}
    assert set(got) == {1, 4, 5} and got[1] == "<|user|>\nhi\n<|bot|>\nyo\n<|end|>\n" and got[4] == "<|user|>\n\n<|end|>\n"


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert packing.pack(packing.pieces(none)).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert quality.judge(none).count() == 0 and mixing.mix(none).count() == 0
    assert suffix.remove_repeats(none).count() == 0
    assert token_counts.suffix_sums(token_counts.histogram(token_counts.lengths(none))).count() == 0
